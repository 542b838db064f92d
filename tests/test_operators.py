"""Literal cases of the operators."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as t
from lakeloom.operators import documents as o
from lakeloom.operators import legacy, market, news, questions, retrieval
from lakeloom.sources import tables as s

D = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_zero_limits_and_dates(spark):
    rows = [("fpt", "28/05/2026", 0, "0", "0.0", "24.5"), ("fpt", "2026-05-27", "24.1", "25.8", "22.4", "24"), ("fpt", "", "1", "1", "1", "1")]
    payload = spark.createDataFrame([tuple(map(str, r)) for r in rows], "symbol string, TradingDate string, RefPrice string, CeilingPrice string, FloorPrice string, Close string")
    a, b = market.normalize_daily(payload).orderBy("trading_date").collect()
    assert (b["ticker"], b["trading_date"], b["ref_price"], b["close_price"]) == ("FPT", D(2026, 5, 28), None, 24.5)
    assert b["anomaly_reason"] == "ref_price_zero,ceiling_price_zero,floor_price_zero" and b["anomaly_floor_zero"]
    assert a["anomaly_reason"] is None and a["ceiling_price"] == 25.8


def test_session_and_backfill(spark):
    at = spark.createDataFrame([("2026-05-29 02:15:00",), ("2026-05-29 05:00:00",), ("2026-05-30 02:15:00",), ("2026-05-29 04:30:00",)], "x string").select(F.col("x").cast("timestamp").alias("x"))
    assert [r[0] for r in at.select(market.in_session(F.col("x"))).collect()] == [True, False, False, True]
    days = spark.sql("SELECT explode(sequence(DATE '2026-04-01', DATE '2026-06-30')) AS trading_date")
    assert market.backfill_window(days, 30, F.lit(D(2026, 5, 30))).agg(F.min("trading_date")).first()[0] == D(2026, 5, 1)
    with pytest.raises(ValueError):
        market.backfill_window(days, 0, F.lit(D(2026, 5, 30)))


def test_ema_skips_missing_prices(spark):
    import numpy as np

    assert market._ema(np.array([1.0, 2.0, 3.0]), 3).tolist() == [1.0, 1.5, 2.25]
    y = market._ema(np.array([np.nan, 1.0, np.nan, 2.0]), 3)
    assert np.isnan(y[0]) and y[2] == 1.0 and y[3] == pytest.approx((0.25 * 1 + 0.5 * 2) / 0.75)


def test_sql_guard():
    assert market.guard_sql("SELECT 1;") == "SELECT 1"
    assert market.guard_sql("with x as (select 'drop') select * from x")
    for bad in ("DELETE FROM x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO b SELECT 1"):
        with pytest.raises(ValueError):
            market.guard_sql(bad)


def test_urls(spark):
    u = "https://WWW.cafef.vn/fpt-cap-nhat-188260528170618458.chn?utm_source=facebook&fbclid=abc123&id=42&gclid=zzz&utm_campaign=spring#top"
    assert one(spark, t.canonicalize_url(F.lit(u))) == "https://cafef.vn/fpt-cap-nhat-188260528170618458.chn?id=42"
    assert one(spark, t.canonicalize_url(F.lit("HTTP://e.vnexpress.net"))) == "http://vnexpress.net/"
    assert one(spark, t.canonicalize_url(F.lit("http://x.vn/a/?b=2&a=&c"))) == "http://x.vn/a?a=&b=2&c="
    assert one(spark, t.url_publish_date(F.lit(u))) == D(2026, 5, 28)
    assert one(spark, t.is_article_url(F.lit(u), F.lit("cafef.vn")))
    assert not one(spark, t.is_article_url(F.lit("https://cafef.vn/tag/fpt-12345678"), F.lit("cafef.vn")))
    assert one(spark, t.title_publish_date(F.lit("Thứ ba, 26/5/2026"))) == D(2026, 5, 26)
    assert one(spark, t.title_publish_date(F.lit("31/2/2026"))) is None


def test_folding(spark):
    assert one(spark, t.norm_free(F.lit("Đường Hòa Phát ß"))) == "duong hoa phat ß"
    assert one(spark, t.fold_text(F.lit("ĐƯỜNG ﬁ ß"))) == "duong fi ss"
    assert one(spark, t.fix_mojibake(F.lit("Ã©tÃ©"))) == "été"
    assert one(spark, t.fix_mojibake(F.lit("été"))) == "été"
    assert one(spark, t.slug(F.lit(" a b/c "))) == "a_b_c" and one(spark, t.slug(F.lit("//"))) == "NA"


def test_news_order_and_selection(spark):
    rows = [
        ("q", "article-1", 2, "u1", "fpt quarterly result strong", ["fpt", "result"], 5.0, 1.0, 0.0, 1.0, 1.0, 9.0, False, False),
        ("q", "article-2", 1, "u2", "fpt wins contract abroad", ["contract", "wins"], 5.0, 1.0, 0.0, 1.0, 1.0, 10.0, False, False),
        ("q", "article-3", 3, "u2", "another title", ["x"], 5.0, 1.0, 0.0, 1.0, 1.0, 8.0, False, False),
        ("q", "article-4", 4, "u4", "fpt quarterly result strongs", ["y"], 5.0, 1.0, 0.0, 1.0, 1.0, 7.0, False, False),
        ("q", "article-5", 5, "u5", "weather", ["z"], 0.0, 1.0, 0.0, 1.0, 1.0, 6.0, False, False),
        ("q", "article-6", 6, "u6", "something else", ["contract", "wins"], 5.0, 1.0, 0.0, 1.0, 1.0, 5.0, False, False),
    ]
    columns = "query_id string, article_id string, rank int, canonical_url string, title string, signature array<string>, relevance double, recency double, negative double, quality double, alignment double, final_score double, latest boolean, negative_query boolean"
    got = {r["article_id"]: r["reason_rejected"] for r in news.select_diverse(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"article-2": None, "article-1": None, "article-3": "duplicate_canonical_url", "article-4": "near_duplicate_title", "article-5": "relevance_score<=0", "article-6": "near_duplicate_topic"}


def test_chunking(spark):
    df = spark.createDataFrame([("d", " ".join(map(str, range(1000)))), ("e", "  "), ("f", "x y")], "doc_id string, text string")
    parts = [(r["doc_id"], r["part"], len(r["text"].split())) for r in o.chunk_text(df).orderBy("doc_id", "part").collect()]
    assert parts == [("d", 0, 512), ("d", 1, 512), ("d", 2, 104), ("f", 0, 2)]
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            o.chunk_text(df, *bad)
    table = spark.createDataFrame([("d", "t1", ["", "30.6.2025 Trieu VND"], [["Tong tai san", "911.617.856"], ["", ""], ["No", "5"]])], "doc_id string, table_id string, header array<string>, rows array<array<string>>")
    chunks = {(r["chunk_type"], r["row_index"]): r for r in o.chunk_table(table).collect()}
    assert chunks["table_row", 0]["content"] == "Tong tai san | col_1=Tong tai san | 30.6.2025 Trieu VND=911.617.856"
    assert chunks["table_row", 0]["linked_id"] == chunks["table_row_window", 0]["retrieval_id"] and ("table_row", 1) not in chunks
    assert "No" not in chunks["table_row_window", 0]["content"]


def test_html_metric_table(spark):
    html = "<table><tr><td></td><td></td><td colspan=2>Triệu VND</td></tr><tr><th>Chỉ tiêu</th><th></th><th>30.6.2025</th><th>31.12.2024</th></tr><tr><td>Lợi nhuận sau thuế</td><td>12</td><td>8.080.817</td><td>7.1</td></tr></table>"
    pages = spark.createDataFrame([("d", 1, html)], "doc_id string, page int, text string")
    got = o.extract_html_tables(pages).withColumn("lines", F.concat(F.array("header"), "rows"))
    cell = retrieval.extract_row_values(got, "loi nhuan sau thue").select("row_values").first()["row_values"]
    assert [(c["key"], c["value"]) for c in cell] == [("30.6.2025", "8.080.817"), ("31.12.2024", "7.1")]


def html_tables(spark, html):
    pages = spark.createDataFrame([("d", 1, html), ("e", 1, None), ("f", 1, "no < table")], "doc_id string, page int, text string")
    return [(r["ordinal"], r["header"], r["rows"]) for r in o.extract_html_tables(pages).orderBy("doc_id", "ordinal").collect()]


def test_nested_and_spanning_tables(spark):
    inner = "<table><tr><td>p</td><td>q</td></tr><tr><td>r</td><td>s &amp; t</td></tr></table>"
    got = html_tables(spark, f"<table><tr><td>a</td><td>b{inner}c</td></tr><tr><td>d</td><td>e</td></tr></table><TABLE><tr><td>1<td>2<tr><td>3<td>4")
    assert got == [(0, ["a", "b c"], [["d", "e"]]), (1, ["p", "q"], [["r", "s & t"]]), (2, ["1", "2"], [["3", "4"]])]
    got = html_tables(spark, "<table><tr><th rowspan=2>k</th><th colspan='2'>both</th></tr><tr><th>x</th><th>y</th></tr><tr><td rowspan=9>m</td><td colspan=0>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>")
    assert got == [(0, ["k", "both", "both"], [["k", "x", "y"], ["m", "1", "2"], ["m", "3", "4"]])]
    assert html_tables(spark, "<table><tr><td>only</td></tr></table><table><tr><td>x</td><td>y</td></tr></table>") == []
    got = html_tables(spark, "<table><thead><tr><th></th><th></th><th>Thuyết minh</th><th colspan=2>Kỳ sáu tháng</th></tr><tr><th></th><th></th><th></th><th>30.6.2025 Triệu VND</th><th>30.6.2024 Triệu VND</th></tr></thead><tbody><tr><td>XIII</td><td>Lợi nhuận sau thuế</td><td></td><td>8.080.817</td><td>8.004.714</td></tr></tbody></table>")
    table = spark.createDataFrame([("d", [got[0][1], *got[0][2]])], "doc_id string, lines array<array<string>>")
    cell = retrieval.extract_row_values(table, "loi nhuan sau thue").select("row_values").first()["row_values"]
    assert [(c["key"], c["value"]) for c in cell] == [("30.6.2025 Triệu VND", "8.080.817"), ("30.6.2024 Triệu VND", "8.004.714")]


def test_functions_from_sql(spark):
    from lakeloom.functions import sql
    from lakeloom.functions import text as t

    sql.register(spark)
    some = ["Đường Hòa Phát", "ÉÀ ñ", "", None, "İstanbul ß", "e\u0301"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "id int, x string")
    df.createOrReplaceTempView("t_some")
    want = {r["id"]: r["y"] for r in df.select("id", t.norm_free(F.col("x")).alias("y")).collect()}
    assert {r["id"]: r["y"] for r in spark.sql("SELECT id, norm_free(x) AS y FROM t_some").collect()} == want
    words = spark.createDataFrame([(n, " \n".join(f"w{i}" for i in range(n))) for n in (0, 1, 5, 6, 7, 11, 12)], "doc_id int, text string")
    words.createOrReplaceTempView("t_words")
    want = sorted((r["doc_id"], r["part"], r["text"]) for r in o.chunk_text(words, 5, 2).collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT doc_id, part, c.text FROM t_words d, LATERAL chunk_text(d.text, 5, 2) c").collect()) == want
    assert spark.sql("SELECT * FROM html_tables('<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>')").first()["header"] == ["a", "b"]


def test_rerank_prefers_the_exact_metric_row(spark):
    rows = [
        (1, "Tổng tài sản của ACB là bao nhiêu?", 1, "table_row", "Bảng cân đối kế toán", "I. Tổng tài sản", "Tổng tài sản | 911.617.856", 0.5),
        (1, "Tổng tài sản của ACB là bao nhiêu?", 2, "table_row", "Rủi ro ngoại bảng", "Nợ phải trả khác", "Nợ | 5", 0.9),
        (1, "Tổng tài sản của ACB là bao nhiêu?", 3, "text", "Mục lục", None, "văn bản", 0.8),
    ]
    df = spark.createDataFrame(rows, "question_id int, question string, point_id int, chunk_type string, section_title string, row_label string, content_for_embedding string, cosine double")
    got = retrieval.rank_candidates(retrieval.rerank(df)).orderBy("rank").collect()
    assert got[0]["point_id"] == 1 and "metric_row_exact:tong tai san" in got[0]["why"]


def test_intent(spark):
    q = ["Giá hiện tại của FPT là bao nhiêu?", "Tin mới nhất về Hòa Phát", "Báo cáo tài chính ACB quý 2 2025", "xyz"]
    got = questions.classify_intent(spark.createDataFrame(enumerate(q), "question_id long, question string")).orderBy("question_id").collect()
    assert [r["primary_intent"] for r in got] == ["market", "news", "financial_reports", "unknown"]
    assert got[0]["tickers"] == ["FPT"] and got[1]["tickers"] == ["HPG"] and (got[2]["quarter"], got[2]["year"]) == (2, 2025) and got[3]["confidence"] == 0.25


def test_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"symbol": "fpt", "dataList": [{"TradingDate": "28/05/2026", "Close": "1"}], "data": []}))
    (tmp_path / "p/b.json").write_text(json.dumps({"symbol": "acb", "message": "no data"}))
    assert [(r["symbol"], r["Close"]) for r in s.read_daily_payload(spark, str(tmp_path / "p")).collect()] == [("fpt", "1")]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"RepeatedInfo": [{"Symbol": "fpt", "SecType": "", "MarketId": "HOSE", "ListedShare": "12.0"}]}]}))
    assert s.read_symbol_profile(spark, str(tmp_path / "s.json")).first()["market"] == "HOSE"
    (tmp_path / "d.json").write_text(json.dumps({"doc_id": "", "result": {"pages": [{"page": 2, "markdown": "# A\nx"}, {"text": "y"}]}}))
    doc = s.read_parsed_documents(spark, str(tmp_path / "d.json"))
    assert [(r["doc_id"], r["page"], r["text"]) for r in o.explode_pages(doc).orderBy("page").collect()] == [("unknown_doc", 2, "# A\nx"), ("unknown_doc", 2, "y")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x.pdf").write_bytes(b"abc")
    (tmp_path / "raw/y.pdf").write_bytes(b"")
    names = spark.createDataFrame([("x.pdf",), ("y.pdf",), ("z.pdf",)], "name string")
    got = {r["name"]: ((r["sha256"] or "")[:8], r["is_error"]) for r in s.raw_file_inventory(spark, str(tmp_path / "raw"), names).collect()}
    assert got == {"x.pdf": ("ba7816bf", False), "y.pdf": ("", True), "z.pdf": ("", True)}
    jobs = spark.createDataFrame([("d", "FPT", None)], "doc_id string, ticker string, scope string")
    parsed = spark.createDataFrame([("d", {"ticker": "OLD", "k": "v"})], "doc_id string, metadata map<string,string>")
    md = spark.createDataFrame([("d", "text")], "doc_id string, markdown string")
    assert s.join_markdown_json(jobs, md, parsed).first()["metadata"] == {"ticker": "FPT", "k": "v"}
    with pytest.raises(ValueError):
        s.write_chunks(spark.createDataFrame([(" ", 1, "a")], "content_for_embedding string, fiscal_year int, ticker string"), str(tmp_path / "c"))


def test_versioned_upsert_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    for _ in range(2):
        s.upsert_table(spark, str(tmp_path / "t"), batch, ["k"], ["n"])
        assert [tuple(r) for r in s.read_table(spark, str(tmp_path / "t"), batch.schema).orderBy("k").collect()] == [(1, "b", 2), (2, "c", 1)]


KIND = "k int, v string, n int"


def rows_of(spark, path):
    return sorted((tuple(r) for r in s.read_table(spark, path, KIND).collect()), key=str)


def test_losing_writer_merges_on_top_of_the_winner(spark, tmp_path, monkeypatch):
    """While one writer has read version 1 and writes, another commits version 2: both batches hold, nothing is removed."""
    path = str(tmp_path / "t")
    s.upsert_table(spark, path, spark.createDataFrame([(i, "old", 1) for i in range(20)], KIND), ["k"], ["n"])
    commit, raced = s._commit, []

    def slow(*some):
        if not raced:
            raced.append(True)
            s.upsert_table(spark, path, spark.createDataFrame([(3, "other", 2), (50, "other", 2)], KIND), ["k"], ["n"])
        return commit(*some)

    monkeypatch.setattr(s, "_commit", slow)
    assert s.upsert_table(spark, path, spark.createDataFrame([(3, "mine", 3), (4, "mine", 3)], KIND), ["k"], ["n"]) == 2
    want = {i: (i, "old", 1) for i in range(20)} | {50: (50, "other", 2), 3: (3, "mine", 3), 4: (4, "mine", 3)}
    assert rows_of(spark, path) == sorted(want.values(), key=str) and s.current_version(spark, path) == 3
    assert not list((tmp_path / "t/_versions").glob(".[0-9a-f]*[0-9a-f]")) and not list((tmp_path / "t/_batches").iterdir())


def test_a_version_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    s.upsert_table(spark, path, spark.createDataFrame([(1, "a", 1)], KIND), ["k"], ["n"])
    state = s._state(spark, path, 1)
    assert s._commit(spark, path, 2, state) and not s._commit(spark, path, 2, {"buckets": 1, "parts": {}})
    assert s._state(spark, path, 2) == state


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    batches = [spark.createDataFrame([(w * 10 + i, f"w{w}", w) for i in range(10)] + [(1000, f"w{w}", w)], KIND) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda b: s.upsert_table(spark, path, b, ["k"], ["n"]), batches)) == [11] * 4
    got = rows_of(spark, path)
    assert [r for r in got if r[0] < 1000] == sorted(((w * 10 + i, f"w{w}", w) for w in range(4) for i in range(10)), key=str)
    assert sum(r[0] == 1000 for r in got) == 1 and s.current_version(spark, path) == 4


def test_half_commit_is_not_seen(spark, tmp_path):
    """Files of a writer that died before its commit belong to no version, and a later cleaning leaves them alone."""
    path = str(tmp_path / "t")
    s.upsert_table(spark, path, spark.createDataFrame([(1, "a", 1)], KIND), ["k"], ["n"])
    (tmp_path / "t/_versions/.0123abc").write_text('{"buck')
    spark.createDataFrame([(9, "lost", 9)], KIND).write.parquet(f"{path}/data-dead/part=0")
    for n in range(2, 5):
        s.upsert_table(spark, path, spark.createDataFrame([(1, "b", n)], KIND), ["k"], ["n"])
        assert rows_of(spark, path) == [(1, "b", n)]
    assert len(list((tmp_path / "t").glob("data-*"))) == 3  # of the last two versions, and the dead writer's


def test_null_keys_are_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (1, "c", 1)], KIND)
    for _ in range(2):
        s.upsert_table(spark, path, batch, ["k"], ["n"])
        assert rows_of(spark, path) == [(1, "c", 1), (None, "b", 2)]
    day = F.when(F.col("k") > 0, F.lit("d"))
    for _ in range(2):
        s.upsert_table(spark, f"{path}-day", batch, ["k"], ["n"], day)
    assert rows_of(spark, f"{path}-day") == [(1, "c", 1), (None, "b", 2)]


def test_parts_grow_in_number_and_touch_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "PART_ROWS", 10)
    path = str(tmp_path / "t")
    s.upsert_table(spark, path, spark.createDataFrame([(i, "a", 1) for i in range(100)], KIND), ["k"], ["n"])
    assert s._state(spark, path, 1)["buckets"] == 16
    s.upsert_table(spark, path, spark.createDataFrame([(i, "b", 2) for i in range(90, 600)], KIND), ["k"], ["n"])
    state = s._state(spark, path, 2)
    assert state["buckets"] == 128 and sum(n for _, n in state["parts"].values()) == 600
    s.upsert_table(spark, path, spark.createDataFrame([(5, "c", 3)], KIND), ["k"], ["n"])
    after = s._state(spark, path, 3)["parts"]
    assert sum(after[k] != v for k, v in state["parts"].items()) == 1
    assert rows_of(spark, path) == sorted(((i, "c" if i == 5 else "b" if i >= 90 else "a", 3 if i == 5 else 2 if i >= 90 else 1) for i in range(600)), key=str)
    assert s.drop_parts(spark, path, lambda k: k == next(iter(after))) == after[next(iter(after))][1]


def test_maps_merge(spark):
    kind = "id int, title string, meta map<string,string>, status string"
    a = spark.createDataFrame([(1, "old", {"a": "1", "b": "1"}, "kept"), (3, "stays", None, "s")], kind)
    b = spark.createDataFrame([(1, "", {"b": "2"}, "new"), (2, "two", None, "new")], kind)
    got = {r["id"]: r for r in market.upsert_merge(a, b, "id", ["title"], [], ["meta"], ["status"]).collect()}
    assert (got[1]["title"], got[1]["meta"], got[1]["status"]) == ("old", {"a": "1", "b": "2"}, "kept") and got[2]["status"] == "new" and got[3]["title"] == "stays"


def test_legacy_clock(spark):
    assert one(spark, legacy.clock_instant(F.lit(D(2024, 1, 2)), F.lit("10:00:00"))) == datetime.datetime(2024, 1, 2, 3)
    assert one(spark, legacy.clock_instant(F.lit(D(2024, 1, 2)), F.lit("10h"))) is None


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in o.embed_chunks(df, "id", "text").collect()}
    assert got[1] == got[2] and sum(x * x for x in got[3]) == pytest.approx(1, rel=1e-5)
    with pytest.raises(Exception, match="lost texts"):
        o.embed_chunks(df, "id", "text", lambda: lambda xs: []).collect()


def test_order_lines_are_shuffled_as_numbers(spark):
    """The cells of order tables are made after the shuffle, so that it holds no texts."""
    from lakeloom.plans.document_queries import doc_tables

    plan = doc_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("collect_list") :]
    assert "cast(" not in below and "RepartitionByExpression" in doc_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_plain_html_is_read_as_by_the_parser(monkeypatch):
    """Texts cut at plain tags give what HTMLParser gives, and pages of plain tables never reach it."""
    from lakeloom.functions import sql

    plain = "x<table border=1><tr><th class='x'>a</th><th>b </th></tr>\n<TR ><td>1 > 0<td id=\"k\">2<b>3</b></td></tr></table><p>y"
    texts = [plain, plain * 2, plain[:-20], "<table><tr><td>" + plain + "<td>q<tr><td>r<td>s</table>", plain + "<", plain.replace("1 >", "1 &lt;"), plain.replace("<b>", "<b/>"), plain.replace("id=", "colspan="), "<!-- " + plain + " -->", "<script>" + plain + "</script>", plain + "<title>" + plain, "<td>a</td></table>" + plain, "a < b" + plain, plain.replace("<p>", "<p a=b/>")]
    quick = [list(sql.html_tables(x)) for x in texts]
    fed = []
    monkeypatch.setattr(sql._Reader, "feed", lambda self, text, f=sql._Reader.feed: (fed.append(text), f(self, text)) and None)
    assert list(sql.html_tables(plain)) == [(0, ["a", "b"], [["1 > 0", "2 3"]])] and not fed
    monkeypatch.setattr(sql, "_plain", lambda text: None)
    assert quick == [list(sql.html_tables(x)) for x in texts] and len(fed) == len(texts)

"""Retrieval operators by brute force and literal cases, and the streams without a SQL twin."""

import collections
import datetime
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom import views
from lakeloom.operators import chunk_index, documents
from lakeloom.operators import retrieval as r
from lakeloom.operators import retrieval_chain as chain
from lakeloom.plans import retrieval_queries as q
from lakeloom.plans import stream_queries as st

SF = "/root/testdata/sf0.001"


def best(rows, k):
    by = collections.defaultdict(list)
    for x in rows:
        by[x["question_id"]].append((x["rank"], x["point_id"]))
    return {key: [p for _, p in sorted(v)][:k] for key, v in by.items()}


def test_vector_cells_change_nothing(spark):
    rng = np.random.default_rng(1)
    chunks = [(i, rng.normal(size=6).tolist(), f"t{i % 3}", i % 4 if i % 7 else None) for i in range(300)] + [(900, [0.0] * 6, "t0", 1), (901, [1.0], "t0", 1), (902, None, "t0", 1)]
    questions = [(i, rng.normal(size=6).tolist(), [None, "t0", "t1", "none"][i % 4], [None, 2][i % 2]) for i in range(24)]
    c = spark.createDataFrame(chunks, "point_id int, vector array<double>, ticker string, quarter int")
    a = spark.createDataFrame(questions, "question_id int, vector array<double>, ticker string, quarter int")
    want = {}
    for i, v, ticker, quarter in questions:
        fit = [(p, w) for p, w, t, u in chunks if w and len(w) == 6 and any(w) and (ticker is None or t == ticker) and (quarter is None or u == quarter)]
        near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), p) for p, w in fit)
        if near:
            want[i] = [p for _, p in near][:12]
    for sizes in ({}, {"cell_chunks": 17, "cell_questions": 3}):
        assert best(r.vector_topk(a, c, **sizes).collect(), 12) == want


def found_share(exact, near):
    return np.mean([len({*exact[i]} & {*near.get(i, [])}) / len(exact[i]) for i in exact])


def met_share(a, c, index):
    """The share of all pairs of a question and a chunk that lie in one cell."""
    by = lambda rows: {x["_cell"]: x["count"] for x in rows.groupBy("_cell").count().collect()}
    chunks, asked = by(r.in_cells(c, index, 1)), by(r.in_cells(a, index, index.probes))
    return sum(n * chunks.get(cell, 0) for cell, n in asked.items()) / (a.count() * c.count())


def test_approximate_search_prunes_and_finds_nine_of_ten(spark):
    """On vectors that lie in bundles: most pairs are never met, and few of the nearest are missed."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, 24))
    vectors = middles[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 24))
    c = spark.createDataFrame([(i, v.tolist(), f"t{i % 3}") for i, v in enumerate(vectors)], "point_id int, vector array<double>, ticker string")
    a = spark.createDataFrame([(i, v.tolist(), "t1" if i % 4 == 0 else None) for i, v in enumerate(middles[rng.integers(0, 60, 100)] + 0.35 * rng.normal(size=(100, 24)))], "question_id int, vector array<double>, ticker string")
    index = r.fit_cells(c)
    exact, near = best(r.vector_topk(a, c).collect(), 12), best(r.vector_topk_approx(a, c, index=index).collect(), 12)
    assert found_share(exact, near) >= 0.9 and met_share(a, c, index) <= 0.1
    assert all(p % 3 == 1 for i, some in near.items() if i % 4 == 0 for p in some)


def test_approximate_search_of_given_vectors(spark):
    """These have hardly any structure, so cells prune little; recall is what is asked for all the same."""
    a, c = q.question_vectors(spark, SF), q.chunks(spark, SF)
    index = r.fit_cells(c)
    exact, near = best(r.vector_topk(a, c).collect(), 12), best(r.vector_topk_approx(a, c, index=index).collect(), 12)
    assert found_share(exact, near) >= 0.9 and met_share(a, c, index) < 1
    tickers = {x["point_id"]: x["ticker"] for x in c.select("point_id", "ticker").collect()}
    asked = {x["question_id"]: x["ticker"] for x in a.select("question_id", "ticker").collect()}
    assert all(asked[i] is None or tickers[p] == asked[i] for i, some in near.items() for p in some)


def test_vectors_without_a_cell(spark):
    """Other lengths, zeros and nulls: found among their like as the exact search finds them, and never in the way."""
    rows = [(i, [float(i % 7 + 1), 1.0, float(i % 5)]) for i in range(200)] + [(500, [1.0, 2.0]), (501, [0.0, 0.0, 0.0]), (502, None), (503, [])]
    c = spark.createDataFrame(rows, "point_id int, vector array<double>")
    a = spark.createDataFrame([(1, [2.0, 1.0, 0.0]), (2, [2.0, 4.0]), (3, [0.0, 0.0, 0.0]), (4, None)], "question_id int, vector array<double>")
    got = best(r.vector_topk_approx(a, c).collect(), 12)
    assert {*got} == {1, 2} and got[2] == [500] and len(got[1]) == 12
    assert r.vector_topk_approx(a, c.filter("false")).count() == 0 and r.vector_topk_approx(a.filter("false"), c).count() == 0


def test_expanded_queries(spark):
    df = spark.createDataFrame([(1, "Tổng tài sản của ACB quý 2 năm 2025 tại ngày 30/06/2025 là bao nhiêu?"), (2, "Đơn vị tính là gì?"), (3, "xin chào")], "question_id int, question string")
    by = collections.defaultdict(list)
    for x in r.expand_queries(df).orderBy("question_id", "ordinal").collect():
        by[x["question_id"]].append(x["query"])
    assert by[1][0].startswith("Tổng tài sản của ACB") and "tong tai san" in by[1] and "tong tai san 30.06.2025" in by[1] and "bảng cân đối kế toán tong tai san" in by[1]
    assert "ACB quý 2 năm 2025 tong tai san" in by[1] and "Đơn vị tính" in by[2] and by[3][0] == "xin chào"
    assert all(len(v) == len(set(v)) for v in by.values())


def test_urls_are_seen_once_within_the_watermark(spark):
    events = st.views.table(spark, SF, "events").select(F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), "event_type"), 256).alias("h"), "ts").collect()
    seen = collections.defaultdict(list)
    for x in sorted(events, key=lambda x: x["ts"]):
        seen[x["h"]].append(x["ts"])
    got = collections.Counter()
    for x in st.stream_url_dedupe(spark, SF).collect():
        assert x["ts"] in [t.replace(tzinfo=None) for t in seen[x["url_hash"]]]
        got[x["url_hash"]] += 1
    assert {*got} == {*seen}
    for h, times in seen.items():  # at most one in each stretch as long as the time to live
        stretches, last = 0, None
        for t in times:
            if last is None or t - last > datetime.timedelta(hours=24):
                stretches, last = stretches + 1, t
        assert 1 <= got[h] <= stretches


WORDS = "tong tai san loi nhuan sau thue cho vay khach hang doanh thu nam quy bao cao so du dau ky cuoi".split()


def word_chunks(n=400, seed=3):
    rng = np.random.default_rng(seed)
    some = [" ".join(rng.choice(WORDS[: 3 + i % (len(WORDS) - 3)], rng.integers(1, 9)).tolist()) for i in range(n)]
    return [(i, f"{'Tổng ' if i % 5 == 0 else ''}{x}{'x' if i % 3 == 0 else ''}", [None, "A", "B"][i % 3], i % 2 + 2024) for i, x in enumerate(some)] + [(900, None, "A", 2024), (901, "", "B", 2025)]


def word_index(spark):
    rows = spark.createDataFrame(word_chunks(), "point_id int, text string, ticker string, year int")
    return chunk_index.postings(rows, F.col("text"))


def covered(question, text):
    """Share of the question's words that the folded text holds somewhere."""
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", (s or "").replace("đ", "d")) if not unicodedata.combining(c)).lower()
    words = dict.fromkeys(w for w in re.findall(r"\w+", fold(question)) if len(w) > 1)
    return sum(w in fold(text) for w in words) / len(words) if words else 0


@pytest.mark.parametrize("k, probe", [(48, 4), (3, 1), (5, 0.2)])
def test_coverage_off_postings_equals_brute_force(spark, monkeypatch, k, probe):
    monkeypatch.setattr(chunk_index, "PROBE", probe)
    questions = [(1, "Tổng tài sản năm nay", None, None), (2, "lợi nhuận sau thuế quý", "A", None), (3, "khách hàng vay", "B", 2025), (4, "zz yy", None, None), (5, " ".join(WORDS), None, 2024), (6, "a ?", None, None), (7, "an", None, None), (8, None, "A", None), (9, "tổng doanh thu zz", "none", None)]
    asked = spark.createDataFrame(questions, "question_id int, question string, ticker string, year int")
    got = {}
    for x in chunk_index.coverage_topk(asked, word_index(spark), k).collect():
        got.setdefault(x["question_id"], []).append((x["rank"], x["point_id"], x["coverage"]))
    for i, question, ticker, year in questions:
        fit = [(-round(covered(question, text), 6), p) for p, text, t, y in word_chunks() if (ticker is None or t == ticker) and (year is None or y == year)]
        want = [(n, p, -c) for n, (c, p) in enumerate(sorted(x for x in fit if x[0] < 0)[:k], 1)]
        assert sorted(got.get(i, [])) == want, i


def test_coverage_of_empty_tables(spark):
    asked = spark.createDataFrame([(1, "tong")], "question_id int, question string")
    assert chunk_index.coverage_topk(asked, word_index(spark).filter("false")).count() == 0
    assert chunk_index.coverage_topk(asked.filter("false"), word_index(spark)).count() == 0


def test_metric_chunks_miss_none(spark):
    found = {x["point_id"] for x in chunk_index.metric_chunks(word_index(spark)).collect()}
    names = {a for m, some in r.METRICS for a in (m, *some)}
    for p, text, *_ in word_chunks():
        if any(a in (text or "").lower().replace("ổ", "o") for a in names):
            assert p in found
    assert len(found) < 400


def report(spark, n=60):
    """Chunks of small reports, and questions about them."""
    kinds = ["table_full", "table_row", "table_row_window", "text"]
    labels = ["Tổng tài sản", "Lợi nhuận sau thuế", "Tiền gửi của khách hàng", "khác"]
    rows = [(i, i, f"r{i}", kinds[i % 4], "Bảng cân đối kế toán" if i % 7 else "Rủi ro", labels[i // 4 % 4] if i % 4 in (1, 2) else None, f"{labels[i // 4 % 4]} {i} 1.234.567", ["ACB", "FPT"][i % 2], 2025, i % 4 + 1, [f"s{i}"], f"r{i - 1}", f"s{i - i % 4}") for i in range(n)]
    c = spark.createDataFrame(rows, "point_id int, doc_id int, retrieval_id string, chunk_type string, section_title string, row_label string, content_for_embedding string, ticker string, year int, quarter int, source_ids array<string>, linked_id string, parent_table_id string")
    c = c.withColumns({"raw_content": F.col("content_for_embedding"), "window_text": F.lit(None).cast("string"), "focus_row_text": F.lit(None).cast("string"), "page": F.lit(1)})
    asked = [(1, "Tổng tài sản của ACB năm 2025 là bao nhiêu?"), (2, "Lợi nhuận sau thuế FPT quý 2"), (3, "Đơn vị tính?"), (4, "Tổng tài sản của ACB năm 2025 là bao nhiêu?")]
    return c, chain.with_filters(spark.createDataFrame(asked, "question_id int, question string"))


def test_chain_candidates_equal_brute_force(spark):
    c, asked = report(spark)
    vector = {x["point_id"]: documents.hash_vector(x["content_for_embedding"]) for x in c.collect()}
    meta = {x["point_id"]: x for x in c.collect()}
    texts = collections.defaultdict(list)
    for x in r.expand_queries(asked.select("question_id", "question")).collect():
        texts[x["question_id"]].append(x["query"])
    index = chunk_index.postings(c, F.concat_ws(" ", "row_label", r.payload_text()))
    got, rescued = collections.defaultdict(dict), collections.defaultdict(set)
    both = [{(x["question_id"], x["point_id"], x["cosine"], x["rescued"]) for x in chain.candidates(asked, c, i, k=5).collect()} for i in (index, None)]
    assert both[0] == both[1]
    for x in chain.candidates(asked, c, index, k=5).collect():
        (rescued[x["question_id"]].add if x["rescued"] else got[x["question_id"]].__setitem__)(*((x["point_id"],) if x["rescued"] else (x["point_id"], x["cosine"])))
    for q_ in asked.collect():
        fit = [p for p, x in meta.items() if all(q_[f] is None or q_[f] == x[f] for f in ("ticker", "year", "quarter"))]
        want = {}
        for text in texts[q_["question_id"]]:
            v = np.array(documents.hash_vector(text), np.float32).astype(float)
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), p) for p in fit for w in [np.array(vector[p], np.float32).astype(float)])[:5]
            for cosine, p in near:
                want[p] = max(want.get(p, -9), -cosine)
        assert got[q_["question_id"]] == want
        metric = {1: "tổng tài sản", 2: "lợi nhuận sau thuế", 4: "tổng tài sản"}.get(q_["question_id"])
        named = {p for p in fit if metric and p % 7 and meta[p]["chunk_type"] != "text" and metric in (meta[p]["row_label"] or meta[p]["content_for_embedding"]).lower()} - {*want}
        assert rescued[q_["question_id"]] == named


def test_chain_ranks_and_assembles(spark):
    c, asked = report(spark)
    index = chunk_index.postings(c, F.concat_ws(" ", "row_label", r.payload_text()))
    ranked = chain.reranked(asked, c, chain.candidates(asked, c, index, k=5))
    rows = ranked.select("question_id", "rank", "retrieval_id", "rerank_score", "why").collect()
    by = {}
    for x in sorted(rows, key=lambda x: (x["question_id"], x["rank"])):
        by.setdefault(x["question_id"], []).append(x)
    assert all([x["rank"] for x in v] == list(range(1, len(v) + 1)) and [x["rerank_score"] for x in v] == sorted((x["rerank_score"] for x in v), reverse=True) for v in by.values())
    assert [(x["retrieval_id"], x["rerank_score"]) for x in by[1]] == [(x["retrieval_id"], x["rerank_score"]) for x in by[4]]
    assert "metric_row_exact:tong tai san" in by[1][0]["why"]
    context = collections.defaultdict(list)
    for x in chain.contexts(ranked, c).collect():
        context[x["question_id"]].append((x["ordinal"], x["retrieval_id"]))
    assert {*context} == {*by} and all(1 <= len(v) <= 4 for v in context.values())
    assert sorted(context[1])[0][1] == by[1][0]["retrieval_id"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_meet_questions_where_they_are(spark):
    """Chunks are made, embedded and searched without a shuffle of their own while the questions are small."""
    tables = spark.createDataFrame([(1, "t1", ["a", "b"], [["x", "1"], ["y", "2"]])], "doc_id int, table_id string, header array<string>, rows array<array<string>>")
    assert "Exchange" not in plan(documents.chunk_table(tables)) and "Window" not in plan(documents.chunk_table(tables))
    c, a = q.chunks(spark, SF), q.question_vectors(spark, SF)
    found = plan(r.vector_topk(a, c))
    assert "CoGroups" not in found and "SortMergeJoin" not in found and found.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("name", ["rerank", "assemble_context", "metric_rescue"])
def test_the_chain_writes_no_chunks(spark, monkeypatch, name):
    made = []
    for module in (q, chain, r):
        monkeypatch.setattr(module, "written", lambda rows, what, own=module.written: made.append((what, rows.columns)) or own(rows, what))
    q.QUERIES[name](spark, SF)
    assert made and not {"chunks", "postings"} & {what for what, _ in made} and not any("content_for_embedding" in columns for what, columns in made if what not in ("ranked",))


def test_every_question_is_asked(spark):
    """The queries read all conversations; what is rescued belongs to all questions that name a metric and a known report."""
    ids = {x["question_id"] for x in views.questions(spark, SF).select("question_id").collect()}
    assert {x["question_id"] for x in q.asked(spark, SF).collect()} == ids and len(ids) == 48
    named = {i for i in ids if i // 100 % len(views.QUESTION_FORMS) in (3, 7)}
    assert {x["question_id"] for x in q.metric_rescue(spark, SF).select("question_id").distinct().collect()} == named and len(named) > 5


def test_hash_vectors_equal_one_by_one():
    texts = ["", "a", "Tổng tài sản", "x" * 5000]
    assert np.array_equal(documents.hash_vectors(texts), np.array([documents.hash_vector(x) for x in texts], np.float32))


def test_vector_best_over_many_blocks(spark, monkeypatch):
    """Blocks that come one after the other, and more questions than a task holds, give the same hits."""
    rng = np.random.default_rng(4)
    c = spark.createDataFrame([(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(500)], "point_id int, vector array<double>").coalesce(1)
    a = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(20)], "question_id int, vector array<double>")
    want = best(r.vector_topk(a, c).collect(), 12)
    monkeypatch.setattr(r, "HELD", 3)
    assert best(r.vector_topk(a, c, cell_chunks=7, cell_questions=2).collect(), 12) == want


@pytest.mark.parametrize("k", [48, 3])
def test_coverage_by_kinds_of_chunks_equals_postings(spark, monkeypatch, k):
    """The same hits, and no rows of a word and a chunk are written."""
    questions = [(1, "Tổng tài sản năm nay", None, None), (2, "lợi nhuận sau thuế quý", "A", None), (3, "khách hàng vay", "B", 2025), (4, "zz yy", None, None), (5, " ".join(WORDS), None, 2024), (7, "an", None, None), (8, None, "A", None), (9, "tổng doanh thu zz", "none", None)]
    asked = spark.createDataFrame(questions, "question_id int, question string, ticker string, year int")
    want = {tuple(x) for x in chunk_index.coverage_topk(asked, word_index(spark), k).collect()}
    made, own = {}, chunk_index.written
    monkeypatch.setattr(chunk_index, "written", lambda rows, what: made.setdefault(what, own(rows, what)))
    rows = spark.createDataFrame(word_chunks(), "point_id int, text string, ticker string, year int")
    assert {tuple(x) for x in chunk_index.coverage_by_words(asked, rows, F.col("text"), k).collect()} == want and want
    assert "lists" not in made and made["kinds"].groupBy("_key", "_kind").count().agg(F.max("count")).first()[0] <= k


def test_python_and_the_jvm_cut_texts_alike(spark):
    """All characters that are not left to the JVM, each between letters, as words; the others are left to it."""
    other = spark.createDataFrame([(f"a{chr(i)}b",) for i in (0x250, 0x300, 0x3A3, 0x1DFF, 0x1F00, 0xFFFD, 0x10000, 0x10FFFF)], "t string")
    assert other.filter(chunk_index.cut_text(F.col("t"))["done"]).count() == 8
    some = [chr(i) for i in (*range(1, 0x250), *range(0x1E00, 0x1F00))]
    rows = spark.createDataFrame([(f"aB{x}cd {x}E{x} {x}{x}",) for x in some], "t string")
    for x in rows.select("t", chunk_index.words_of(F.col("t")).alias("w"), chunk_index.cut_text(F.col("t")).alias("cut")).collect():
        pieces = re.split("[\x00-/:-@\\[-^`{-\x7f]+", x["t"])
        assert {w for p in pieces for w in chunk_index._words_in(p)} == {*x["w"]} and x["cut"] == (False, x["t"]), x["t"]


def test_kinds_of_chunks_in_small_steps(spark, monkeypatch):
    """Texts with foreign letters and marks, words at the ends of texts, and tasks that tell what they hold early."""
    texts = ["", "a", "28", "1283", "12 8", "2", "ΣΑΣ quý", "QUÝ…28", "thép đồng", "x_y", "e\u0301t\u00e9", "dong", "…", None, "28\n28|quy", "ﬁn", "fin٣٣", "DỒNG-28"] * 9
    rows = spark.createDataFrame([(i * 7 % 1000, x, ["A", "B", None][i % 3]) for i, x in enumerate(texts)], "point_id int, text string, ticker string").coalesce(1)
    questions = [(1, "28 quý đồng", None), (2, "σας fi 83", "A"), (3, "été y_ 28", "B"), (4, "٣٣ quy", None), (5, "zz", "C"), (6, "28 quý đồng zz", None)]
    asked = spark.createDataFrame(questions, "question_id int, question string, ticker string")
    want = {tuple(x) for x in chunk_index.coverage_topk(asked, chunk_index.postings(rows, F.col("text")), 5).collect()}
    assert len({x[0] for x in want}) == 5
    for name, n in (("ROWS", 1 << 18), ("ROWS", 2), ("PIECES", 1)):
        monkeypatch.setattr(chunk_index, name, n)
        assert {tuple(x) for x in chunk_index.coverage_by_words(asked, rows, F.col("text"), 5).collect()} == want


@pytest.mark.parametrize("share", [32, 1, 1 << 40])
def test_rescued_without_all_hits(spark, monkeypatch, share):
    """As of all candidates, whatever is searched first, also where questions share an id; and few asks meet all chunks."""
    c, asked = report(spark, 240)
    more = [(i, f"{x} số {i}?") for i in range(5, 45) for x in ("Tổng tài sản của ACB năm 2025", "Lợi nhuận sau thuế", "Khách hàng nào")[i % 3 :][:1]] + [(5, "Lợi nhuận sau thuế FPT"), (6, "Đơn vị tính FPT?")]
    asked = asked.unionByName(chain.with_filters(spark.createDataFrame(more, "question_id int, question string")))
    want = {tuple(x) for x in chain.candidates(asked, c, k=5).filter("rescued").drop("rescued").collect()}
    monkeypatch.setattr(chain, "SHARE", share)
    met, own = [], r.vector_topk
    monkeypatch.setattr(r, "vector_topk", lambda some, *a: met.append(some.count()) or own(some, *a))
    got = [tuple(x) for x in chain.rescued(asked, c, k=5, limit=48).collect()]
    assert {*got} == want and len(got) == len(want) > 500 and len(met) == 2
    assert {x[0] for x in want} < {x[0] for x in chain.candidates(asked, c, k=5).select("question_id").collect()}


def test_products_of_a_block_are_read_once(monkeypatch):
    """Vectors of zeros, chunks' or questions', and blocks of nothing else are no hits, and are not looked for among the products."""
    rng = np.random.default_rng(8)
    v, a = rng.normal(size=(60, 4)).astype(np.float32), rng.normal(size=(7, 4)).astype(np.float32)
    v[::3], a[2] = 0, 0
    asks = pa.StructArray.from_arrays([pa.array(range(7)), pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), 4)], ["question_id", "vector"])
    best = r._Best(asks, 5)
    monkeypatch.setattr(np, "isnan", lambda x: pytest.fail("a pass of its own"))
    for some in (np.arange(0, 60, 3), np.arange(0, 25), np.arange(25, 60)):
        best.meet(some, r._units_of(pa.array(v[some].ravel()), len(some)))
    unit = lambda x: x / np.linalg.norm(x)
    for i in range(7):
        want = sorted((-round(float(unit(a[i].astype(float)) @ unit(v[j].astype(float))), 6), j) for j in range(60) if j % 3)[:5] if i != 2 else []
        assert [(-c, p) for c, p in zip(best.cosines[best.i == i].tolist(), ([] if best.points is None else best.points[best.i == i]).tolist(), strict=True)] == want

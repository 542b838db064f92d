"""Literal cases of the news rules, and brute force for pairs and selections."""

import collections
import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import news


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entity_tokens(spark):
    got = one(spark, news.entity_tokens(F.lit("Tin gần đây của ACB có gì đáng chú ý?")))
    assert got == ["acb", "ngan hang acb", "asia commercial bank"]
    assert one(spark, news.entity_tokens(F.lit("recent news about ACB")))[0] == "acb"
    got = one(spark, news.entity_tokens(F.lit("tin tức HPG hôm nay")))
    assert got == ["hpg", "hoa phat", "tap doan hoa phat", "cong ty hoa phat", "hoa", "phat"]
    got = one(spark, news.entity_tokens(F.lit("tin tức công ty cổ phần tập đoàn Hòa Phát gần đây nhất")))
    assert got == ["cong ty co phan tap doan hoa phat", "cong", "phan", "tap", "doan", "hoa", "phat"]
    assert one(spark, news.entity_phrase(F.lit("giá gì?"))) is None
    assert one(spark, news.expand_aliases(F.array(F.lit("vnm"), F.lit("x")))) == ["vnm", "x", "vinamilk", "cong ty vinamilk"]


def test_relevance_of_the_entity_only(spark):
    tokens = news.entity_tokens(F.lit("Tin gần đây của ACB có gì đáng chú ý?"))
    score = lambda title, snippet, url: one(spark, news.token_score(tokens, F.lit(title), F.lit(snippet), F.lit(url)))
    assert score("ACB đón lượng cổ đông kỷ lục đến dự Đại hội", "6 days ago · ACB công bố kế hoạch lợi nhuận.", "https://cafef.vn/acb-cap-nhat-188260416123456.chn") == 10
    assert score("Sedan cỡ B hồi phục doanh số - Báo VnExpress", "Bài viết có cụm đáng chú ý nhưng không nói về ngân hàng nào.", "https://vnexpress.net/sedan-5060804.html") == 0


def test_search_variants(spark):
    q = "Có tin tức tiêu cực nào gần đây về FPT không?"
    got = one(spark, news.query_candidates(F.lit(q)))
    assert got == [
        "FPT không", "tin tức FPT không", "FPT không chứng khoán", "FPT", "tin tức FPT", "FPT chứng khoán", "FPT tin tức mới nhất", "FPT không kết quả kinh doanh", "FPT không doanh nghiệp",
        "FPT không tin tức gần đây", "FPT không tin tức mới nhất", "FPT không tin tiêu cực gần đây", "FPT không rủi ro cổ phiếu", "FPT không bị phạt", "FPT không khó khăn", q, "Có tin tức tiêu cực nào về FPT không",
    ]
    assert one(spark, news.primary_query(F.lit("tin tức công ty cổ phần tập đoàn Hòa Phát gần đây nhất"))) == "tin tức công ty cổ phần tập đoàn Hòa Phát gần đây nhất"
    assert one(spark, news.primary_query(F.lit("giá?"))) == "giá"
    rows = spark.createDataFrame([(1, q), (2, "tin HPG và ACB"), (3, " ")], "question_id int, question string")
    by = collections.defaultdict(list)
    for r in news.search_query_variants(rows).orderBy("question_id", "ordinal").collect():
        by[r["question_id"]].append(r["query"])
    assert by[1] == ["tin tức FPT không gần đây nhất", "FPT không", "tin tức FPT không", "FPT không chứng khoán", "FPT"]
    assert by[2] == ["tin tức tin HPG và ACB", "tin HPG và ACB", "tin HPG và ACB chứng khoán", "TIN"] and 3 not in by


def test_rewritten_query(spark):
    f = lambda a, b: one(spark, news.rewritten_query(F.lit(a), F.lit(b), F.lit(2026)))
    assert f("recent news about HPG", "Thông tin mới nhất về cổ phiếu HPG") == "tin tức Hòa Phát HPG mới nhất 2026"
    assert f("news about VCB", "") == "tin tức Vietcombank VCB" and f("tin tức FPT mới nhất", "") == "tin tức FPT mới nhất 2026"
    assert f("giá vàng", "x") == "giá vàng" and f("", "chào bạn") == "chào bạn" and f("", "") == ""


def test_intent_and_selection_tokens(spark):
    i = one(spark, news.detect_news_intent(F.lit("Tin xấu gần đây về Hòa Phát?")))
    assert (i["negative"], i["latest"], i["stock"]) == (True, True, True) and i["tokens"] == ["hoa phat", "hoa", "phat"]
    assert not one(spark, news.detect_news_intent(F.lit("lo")))["negative"]


def test_topic_signature_leaves_stop_words_out(spark):
    words = "current price about stock stock khoan khoan the the"
    df = spark.createDataFrame([(1, "", words, None)], "article_id int, title string, summary string, snippet string")
    assert news.topic_signature(df).first()["signature"] == ["khoan", "stock", "the"]


def test_article_text(spark):
    md = """
[](https://cafef.vn/ "Kênh thông tin kinh tế - tài chính Việt Nam")
[](http://liveboard.cafef.vn "Bảng giá điện tử")
MỚI NHẤT!
[Đọc nhanh >>](https://cafef.vn/doc-nhanh.chn "Đọc nhanh")

# ACB đón lượng cổ đông kỷ lục đến dự Đại hội
6 days ago
Đại hội cổ đông thường niên năm nay của ACB ghi nhận hơn 1.070 cổ đông tham dự.
09:30 giá
Ngân hàng cũng chia sẻ [kế hoạch](http://x/y) lợi nhuận và tăng vốn điều lệ trong năm 2026.

[ ![Bài liên quan](https://example.com/image.jpg) ](https://example.com/related)
#### [Tin liên quan](https://example.com/related-2)
bỏ đi
"""
    title = "ACB đón lượng cổ đông kỷ lục đến dự Đại hội"
    rows = [(1, title, "tóm  tắt", md), (2, "t", "tóm <b>tắt</b>", None), (3, title, "s", "ngắn"), (4, "", "s", "chữ " * 25 + "\nXem thêm\nmore " * 3), (5, "", "s", "Mới nhất và bình luận " + "chữ " * 30)]
    df = spark.createDataFrame(rows, "article_id int, title string, snippet string, markdown string")
    got = {r["article_id"]: r["text"] for r in news.extract_article_text(df).collect()}
    assert got[1] == title + " 6 days ago Đại hội cổ đông thường niên năm nay của ACB ghi nhận hơn 1.070 cổ đông tham dự. Ngân hàng cũng chia sẻ kế hoạch lợi nhuận và tăng vốn điều lệ trong năm 2026."
    assert got[2] == "tóm tắt" and got[3] == "s" and got[5] == "s"
    assert got[4] == ("chữ " * 25).strip() + " Xem thêm more Xem thêm more"  # the third marker comes after 120 characters


def test_excerpts(spark):
    f = lambda x, cap=420: one(spark, news.excerpt(F.lit(x), F.lit("none"), cap))
    assert f("09:30 x\nNguồn: báo\nfirst line here\nsecond") == "first line here second"
    assert f("  ") == "none" and f("Nguồn: báo") == "Nguồn: báo" and f("a" * 10, 10) == "a" * 10 and f("a" * 10 + "\nb", 10) == "a" * 10
    assert f("aaaa bbbb cccc", 10) == "aaaa bbbb…"
    assert one(spark, news.polish_summary(F.lit("[cafef.vn] FPT lãi lớn: quý này ** | 10:20 AM tăng. Chia sẻ 5"), F.lit("fpt lãi lớn"))) == "quý này tăng."
    assert one(spark, news.strip_publish_noise(F.lit("Tác giả *** | 12-05-2026 tin. FPT: Công ty cổ phần FPT. hết"))) == "tin. . hết"


def test_pairs_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(q, 100 * q + i, sorted(rng.sample("abcdefghijk", rng.randrange(1, 9)))) for q in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id int, article_id int, signature array<string>")
    for least in (0.5, 0.86, 1.0):
        want = {(q, a, b): len({*x} & {*y}) / min(len(x), len(y)) for (q, a, x), (p, b, y) in itertools.combinations(rows, 2) if p == q}
        want = {k: v for k, v in want.items() if v >= least}
        got = {(r["query_id"], r["first"], r["second"]): r["overlap"] for r in news.near_duplicate_pairs(df, least).collect()}
        assert got == pytest.approx(want)


def test_selection_walks_the_ranks(spark):
    from lakeloom.plans import news_queries as q

    sf = "/root/testdata/sf0.001"
    ranks = {(r["query_id"], r["article_id"]): r for r in q.scored(spark, sf).collect()}
    by = collections.defaultdict(list)
    for r in q.select_diverse_topk(spark, sf).collect():
        by[r["query_id"]].append((r["rank"], r["article_id"], r["reason_rejected"]))
    assert sum(map(len, by.values())) == len(ranks)
    for query_id, rows in by.items():
        taken = 0
        for rank, article, reason in sorted(rows):
            assert ranks[query_id, article]["rank"] == rank
            assert (reason == "over_top_limit") == (taken >= 5)
            if reason == "relevance_score<=0":
                assert ranks[query_id, article]["relevance"] <= 0
            taken += reason is None
        assert taken <= 5


def test_article_cache_round(spark):
    at = "2026-05-29 00:00:00"
    hits = spark.createDataFrame([(1, "h1", "A", "u1"), (1, "h2", "B", "u2"), (1, "h3", "C", "u3"), (2, "h1", "", "u1"), (2, "h4", "D", "u4")], "run_id int, url_hash string, title string, url string")
    cache = spark.createDataFrame([("h1", "old", "u1", "crawled", "k1", "c1", at), ("h2", "old", "u2", "crawled", "gone", "c2", at), ("h9", "z", "u9", "crawled", "k9", "c9", None)], "url_hash string, title string, url string, status string, content_key string, content_hash string, crawled_at string")
    cache = cache.withColumn("crawled_at", F.col("crawled_at").cast("timestamp"))
    content = spark.createDataFrame([("k1",), ("k9",)], "content_key string")
    crawled = spark.createDataFrame([("h2", "text", None, None), ("h3", "snip", None, "timeout"), ("h1", "never asked", None, None)], "url_hash string, cleaned_text string, markdown string, error_message string")
    after, new, counts = news.cache_upsert_flow(hits, cache, content, crawled, F.lit("2026-05-29 12:00:00").cast("timestamp"))
    got = {r["url_hash"]: (r["title"], r["status"], r["content_key"], r["error_message"]) for r in after.collect()}
    key = lambda h: f"articles/{h}/content.json"
    assert got == {"h1": ("A", "crawled", "k1", None), "h2": ("B", "crawled", key("h2"), None), "h3": ("C", "crawled", key("h3"), None), "h4": ("D", "failed", None, "Crawler returned no article."), "h9": ("z", "crawled", "k9", None)}
    assert {r["content_key"] for r in new.collect()} == {key("h2"), key("h3")}
    assert {tuple(r) for r in counts.collect()} == {(1, 3, 1, 2, 1), (2, 2, 1, 0, 1)}


def test_article_detail(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "article_id int, title string")
    c = spark.createDataFrame([(1, "t" * 300, "k")], "article_id int, cleaned_text string, markdown_artifact_key string")
    got = {r["article_id"]: r for r in news.article_detail(a, c).collect()}
    assert (len(got[1]["cleaned_excerpt"]), got[1]["markdown_artifact_key"], got[2]["cleaned_text"]) == (280, "k", None)


def plain_title(x):
    return " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in x.lower()).split())


@pytest.mark.parametrize("cell", [256, 3])
def test_alike_titles_equal_difflib_over_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(news, "TITLE_CELL", cell)
    rng = random.Random(4)
    words = "hoa phat fpt vinamilk loi nhuan quy tang giam co phieu doanh thu nam ngan hang acb vuot ke hoach lai truoc thue".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))) for _ in range(150)]
    for x in titles[:60]:
        y = x.split()
        titles += [" ".join(y[:-1]), x.replace("o", "0", 1) + "!", " ".join(y[::-1]), x.upper()]
    titles += ["", "??", None, "ab", "ab", "abc"]
    rows = [(i, x) for i, x in enumerate(titles)]
    class_of = {}
    for i, x in rows:
        if x and plain_title(x):
            class_of.setdefault(plain_title(x), i)
    first = sorted((i, x) for x, i in class_of.items())
    want = {(i, j): SequenceMatcher(None, y, x).ratio() for k, (i, x) in enumerate(first) for j, y in first[k + 1 :]}
    want = {k: round(v, 6) for k, v in want.items() if v >= news.TITLE_RATIO}
    articles = spark.createDataFrame(rows, "article_id int, title string")
    assert {(x["first"], x["second"]): x["ratio"] for x in news.near_duplicate_titles(articles).collect()} == want and len(want) > 60
    assert {x["article_id"]: x["representative"] for x in news.title_classes(articles).collect()} == {i: class_of[plain_title(x)] for i, x in rows if x and plain_title(x)}
    assert news.near_duplicate_titles(articles.filter("false")).count() == 0


def test_alike_titles_of_pages_equal_difflib(spark):
    """All pairs of titles of the smallest table of pages."""
    from lakeloom.plans import news_queries as q

    sf = "/root/testdata/sf0.001"
    got = {(x["first"], x["second"]): x["ratio"] for x in q.near_duplicate_titles(spark, sf).collect()}
    rows = q.views.hits(spark, sf).select(F.col("position").alias("article_id"), "title")
    first = sorted({(x["representative"], x["_title"]) for x in news.title_classes(rows).collect()})
    want = {}
    for k, (i, x) in enumerate(first):
        for j, y in first[k + 1 :]:
            if 2 * min(len(x), len(y)) >= news.TITLE_RATIO * (len(x) + len(y)) and (m := SequenceMatcher(None, y, x)).real_quick_ratio() >= news.TITLE_RATIO and m.quick_ratio() >= news.TITLE_RATIO and m.ratio() >= news.TITLE_RATIO:
                want[i, j] = round(m.ratio(), 6)
    assert got == want

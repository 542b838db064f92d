"""Queries on tables like those of larger runs: repeated URLs, crowded partitions, and steps that must not be repeated."""

import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text
from lakeloom.operators import documents, news, retrieval
from lakeloom.plans import all_queries
from lakeloom.sources import tables
from tests.test_oracles import plain

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The given tables, with pages that share a URL and not a text."""
    d = tmp_path_factory.mktemp("repeated")
    for name in os.listdir(SF):
        if name != "pages.parquet":
            os.symlink(f"{SF}/{name}", d / name)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    n = pages.agg(F.max("page_id") + 1).first()[0]
    again = pages.withColumns({"page_id": F.col("page_id") + 30 * n, "html": F.concat("html", F.lit("<p>again"))})
    pages.unionByName(again).coalesce(1).write.parquet(str(d / "pages.parquet"))
    return str(d)


def same_as_sql(spark, d, name):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(d):
        path = f"{d}/{t}/*.parquet" if os.path.isdir(f"{d}/{t}") else f"{d}/{t}"
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path}'")
    df, rel = QUERIES[name](spark, d), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [rel.columns.index(x) for x in columns]
    mine = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=str)
    return mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", ["article_content_store", "merge_hits", "rank_in_source", "select_top_hits"])
def test_pages_that_share_a_url(spark, repeated, name):
    assert same_as_sql(spark, repeated, name)


def plan(df, which="optimizedPlan"):
    return str(getattr(df._jdf.queryExecution(), which)())


def test_markdown_tables_are_read_where_they_are(spark):
    pages = spark.createDataFrame([(1, 1, "# A\n| a | b |\n|---|---|\n| 1 | 2 |\n# B | c\n| a | b |\n---\n| 3 | 4 |\n"), (2, 1, "| a | b |"), (3, 1, None)], "doc_id int, page int, text string")
    df = documents.extract_markdown_tables(pages)
    assert "Exchange" not in plan(df, "executedPlan") and "Window" not in plan(df)
    got = [(r["ordinal"], r["section_title"], r["header"], r["rows"]) for r in df.orderBy("ordinal").collect()]
    assert got == [(1, "B | c", ["a", "b"], [["1", "2"], ["# B", "c"]]), (2, "B | c", ["a", "b"], [])]


def test_a_large_chunk_set_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_for_embedding"), F.lit(2025).alias("fiscal_year"), F.lit("A").alias("ticker"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        tables.write_chunks(rows, str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "c" / "fiscal_year=2025" / "ticker=A").glob("*.parquet"))) > 1
    assert tables.read_chunks(spark, str(tmp_path / "c")).count() == 40_000


def test_messages_are_parsed_once(spark):
    job = '"ticker": "f", "period": "Q", "report_type": "x", "report_family": "x", "source": "x", "source_url": "x", "fiscal_year": '
    some = [f'{{"doc_id": "1", {job}2025}}', f'{{"doc_id": 3, "x": {{"doc_id": "n"}}, {job}2025}}', f'{{"doc_id": "2", {job}2025.0}}', "{", None]
    good, bad = documents.validate_jobs(spark.createDataFrame([(x,) for x in some], "value string"), "download")
    assert [r["doc_id"] for r in good.collect()] == ["1"] and bad.count() == 4
    assert all(plan(df).lower().count("parse") == 1 for df in (good, bad))


def test_pairs_work_signatures_out_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, ["aa1", "bb1"]), (1, 2, ["aa1", "bb1"]), (1, 3, ["bb1", "cc1"])], "query_id int, article_id int, signature array<string>")
    made = []
    monkeypatch.setattr(news, "written", lambda rows, what, own=news.written: made.append(what) or own(rows, what))
    assert [tuple(r) for r in news.near_duplicate_pairs(rows).collect()] == [(1, 1, 2, 1.0)] and made == ["signatures"]


def test_alike_titles_are_found_whatever_their_trigrams(spark):
    """Titles with letters changed all over share few trigrams; some of these are longer than a word of bits."""
    rng = random.Random(7)
    titles = []
    for i in range(80):
        x = [rng.choice("abcdefghijklm") for _ in range((50, 51, 64, 65, 100, 210)[i % 6])]
        y = [rng.choice("nopqrstuvwxyz") if k % 7 == 3 else c for k, c in enumerate(x)]
        titles += ["".join(x), "".join(y)]
    rows = list(enumerate(titles))
    want = {(i, j): round(r, 6) for i, x in rows for j, y in rows[i + 1 :] if (r := SequenceMatcher(None, y, x).ratio()) >= news.TITLE_RATIO}
    got = news.near_duplicate_titles(spark.createDataFrame(rows, "article_id int, title string")).collect()
    assert {(x["first"], x["second"]): x["ratio"] for x in got} == want and len(got) == len(want) > 60


def test_links_within_a_document_are_looked_up_in_place(spark):
    rng = random.Random(5)
    kinds = "doc_id int, chunk_type string, retrieval_id string, linked_id string, parent_table_id string, source_ids array<string>"
    rows = []
    for d in (*range(12), None):
        ids = [f"r{d}-{i}" for i in range(rng.randrange(1, 9))]
        pick = lambda: rng.choice([*ids, f"t{d}", f"u{d}", None, "gone"])  # noqa: E731, B023
        for x in (*ids, ids[0], None):
            rows.append((d, rng.choice(["table_full", "table_row"]), x, pick(), pick(), rng.choice([None, [], [f"t{d}"], [f"u{d}", f"t{d}"]])))
    c = spark.createDataFrame(rows, kinds)
    same = lambda df: sorted((tuple(r[x] for x in (*c.columns, "parent_id")) for r in df.collect()), key=repr)
    got = same(retrieval.linked_within(c, ("doc_id",)))
    assert got == same(retrieval.linked_chunks(c, c)) and len(got) == len(rows)
    assert plan(QUERIES["linked_chunk_lookup"](spark, SF), "executedPlan").count("Exchange hashpartitioning") == 1


def test_signatures_of_candidates_are_counted_in_their_rows(spark):
    rng = random.Random(3)
    texts = ["", "a b", "Tin tin news the", *(" ".join(rng.choice("Hòa phát thép thÉp quý lãi loi nhuan abc abd abe abf abg price x1y".split()) for _ in range(rng.randrange(1, 60))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "article_id int, summary string").withColumns({"title": F.lit(""), "snippet": F.lit(None).cast("string")})
    want = {r["article_id"]: r["signature"] for r in news.topic_signature(rows).collect()}
    got = rows.select("article_id", news.signature_of(text.norm_free(F.col("summary"))).alias("s")).collect()
    assert {r["article_id"]: r["s"] for r in got if r["s"]} == want and len(got) == len(texts) and len(want) == len(texts) - 2
    assert plan(QUERIES["select_diverse_topk"](spark, SF), "executedPlan").count("Exchange") == 1

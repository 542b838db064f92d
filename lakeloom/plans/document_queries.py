"""Registered queries over report documents, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom import views
from lakeloom.operators import documents as o
from lakeloom.sources.tables import written
from lakeloom.views import with_views

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return register


views.SQL["v_lines"] = """SELECT l_orderkey, ['line', 'part', '', 'price'] AS header, list([l_linenumber::VARCHAR, l_partkey::VARCHAR, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_quantity::BIGINT::VARCHAR END, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 3 = 0 THEN ' ' ELSE round(l_extendedprice)::BIGINT::VARCHAR END]
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rows FROM lineitem GROUP BY l_orderkey"""


def doc_tables(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as tables with blank headers and some blank cells."""
    names = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    line = F.struct(*names)  # what is shuffled and sorted are numbers, not the cells made of them
    lines = views.table(spark, d, "lineitem").select("l_orderkey", *names).repartition("l_orderkey")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("r"))

    def cells(r: Column) -> Column:
        third = r["l_partkey"] % 3 == 0
        price = F.when((r["l_linenumber"] % 2 == 0) & third, " ").otherwise(F.round(r["l_extendedprice"]).cast("long").cast("string"))
        return F.array(r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), F.when(third, "").otherwise(r["l_quantity"].cast("long").cast("string")), price)

    return rows.select("l_orderkey", F.array(F.lit("line"), F.lit("part"), F.lit(""), F.lit("price")).alias("header"), F.transform("r", cells).alias("rows"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The same tables rendered into markdown pages under a heading, with text around them."""
    text = F.concat(F.lit("# Order\nintro\n"), o.render_markdown(F.col("header"), F.col("rows")), F.lit("\nafter\n## Notes\ntail"))
    return doc_tables(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


@query("SELECT ticker, fiscal_year, exchange FROM (SELECT n_name AS ticker, r_name AS exchange FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'HOSE' FROM nation WHERE n_nationkey % 2 = 1), (VALUES (2024), (2025)) y(fiscal_year)")
def discovery_requests(spark: SparkSession, d: str) -> DataFrame:
    s = views.symbols(spark, d)
    nation = views.table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("ticker"))
    return o.discovery_requests(s, spark.range(2024, 2026).select(F.col("id").cast("int").alias("fiscal_year")), s.join(nation, "ticker"))


_CAND = """SELECT n_name AS ticker, 2025 AS fiscal_year, k.q AS quarter, k.p AS period, r AS report_type, s AS scope, n_name || '_2025_Q' || k.q || '_' || k.p || '_' || r || '_' || s AS doc_id,
    'https://static2.vietstock.vn/data/HOSE/2025/BCTC/VN/QUY%20' || k.q || '/' || n_name || '_Baocaotaichinh_' || k.p || '_2025_' || r || '_' || s || '.pdf' AS source_url
    FROM nation, (SELECT unnest([{'q': 1, 'p': 'Q1'}, {'q': 2, 'p': 'Q2'}, {'q': 2, 'p': '6T'}, {'q': 3, 'p': 'Q3'}, {'q': 3, 'p': '9T'}, {'q': 4, 'p': 'Q4'}]) AS k), (SELECT unnest(['Soatxet', 'KiemToan']) AS r), (SELECT unnest(['Congtyme', 'Hopnhat']) AS s)
    UNION ALL SELECT n_name, 2025, NULL, 'Annual', 'BCTN', NULL, n_name || '_2025_BCTN', 'https://static2.vietstock.vn/data/HOSE/2025/BCTN/VN/' || n_name || '_Baocaothuongnien_2025.pdf' FROM nation"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return o.generate_report_candidates(views.table(spark, d, "nation").select(F.col("n_name").alias("ticker"), F.lit("HOSE").alias("exchange"), F.lit(2025).alias("fiscal_year")))


@query(_CAND)
def generate_report_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("ticker", "fiscal_year", "quarter", "period", "report_type", "scope", "doc_id", "source_url")


@query(f"SELECT doc_id FROM ({_CAND}) WHERE quarter = 2 OR quarter IS NULL")
def candidate_available_join(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return o.available(c, c.filter("quarter = 2 OR quarter IS NULL").select("source_url")).select("doc_id")


@query("SELECT doc_id, CASE WHEN i % 3 = 0 THEN i + 100 ELSE i END AS page, p AS text FROM (SELECT doc_id, i::INTEGER AS i, string_split(coalesce(text, ''), chr(10))[i] AS p FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) t(i))")
def explode_pages(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    page = F.transform(parts, lambda p, i: F.struct(F.when((i + 1) % 3 == 0, "0").when((i + 1) % 3 == 1, (i + 1).cast("string")).otherwise("x").alias("page"), F.when((i + 1) % 3 == 0, (i + 101).cast("string")).alias("page_number"), F.lit(None).cast("string").alias("number"), F.lit("").alias("markdown"), p.alias("text"), F.lit("z").alias("content")))
    rows = o.explode_pages(views.table(spark, d, "documents").select("doc_id", page.alias("pages")))
    return rows.withColumn("text", F.when(F.col("text") == "z", "").otherwise(F.col("text")))


@query("SELECT l_orderkey AS doc_id, 'Order' AS section_title, header, list_transform(rows, lambda r: list_transform(r, lambda c: trim(c))) AS rows FROM v_lines")
def extract_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return o.extract_markdown_tables(pages(spark, d)).select("doc_id", "section_title", "header", "rows")


@query("SELECT l_orderkey AS doc_id, header, list_transform(rows, lambda r: list_transform(r, lambda c: trim(c))) AS rows FROM v_lines")
def extract_html_tables(spark: SparkSession, d: str) -> DataFrame:
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag} class='x'>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    html = F.concat(F.lit("x<table border=1>"), row(F.col("header"), "th"), F.array_join(F.transform("rows", lambda r: row(r, "td")), "\n"), F.lit("</table><p>y"))
    return o.extract_html_tables(doc_tables(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), html.alias("text"))).select("doc_id", "header", "rows")


@query("SELECT l_orderkey AS doc_id, header, list_transform(rows, lambda r: list_transform(r, lambda c: trim(c))) AS rows, len(rows)::INTEGER AS row_count, 4 AS col_count FROM v_lines")
def extract_provider_tables(spark: SparkSession, d: str) -> DataFrame:
    t = F.struct(F.lit(1).alias("page"), F.lit("T").alias("section_title"), F.lit(None).cast("array<string>").alias("header"), F.col("header").alias("columns"), "rows")
    rows = o.extract_provider_tables(doc_tables(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.array(t).alias("tables")))
    return o.table_profile(rows).select("doc_id", "header", "rows", "row_count", "col_count")


@query("SELECT l_orderkey AS doc_id, 0 AS finder, count(*) AS n FROM v_lines GROUP BY 1")
def union_tables(spark: SparkSession, d: str) -> DataFrame:
    t = written(o.extract_markdown_tables(pages(spark, d)).select("doc_id", "page", "ordinal", "section_title", "header", "rows"), "found-tables")
    return o.union_tables(t, t, t).groupBy("doc_id", "finder").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, s.title, s.n::INTEGER AS lines FROM v_lines, (SELECT unnest([{'title': 'Order', 'n': -1}, {'title': 'Notes', 'n': 1}]) AS s)".replace("s.n::INTEGER", "(CASE WHEN s.n = 1 THEN 1 ELSE len(rows) + 4 END)::INTEGER"))
def section_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return o.section_segmentation(pages(spark, d)).select("doc_id", "title", F.size(F.split("text", "\n")).alias("lines"))


@query("""SELECT doc_id, ordinal, list_filter([CASE WHEN h1 IS NOT NULL THEN 'H' || h1 END, CASE WHEN h2 > h1 THEN 'H' || h2 END, CASE WHEN h3 > greatest(h1, h2) THEN 'H' || h3 END], lambda x: x IS NOT NULL) AS heading_path FROM (
    SELECT doc_id, ordinal, max(CASE WHEN ordinal % 12 = 0 THEN ordinal END) OVER w AS h1, max(CASE WHEN ordinal % 12 = 4 THEN ordinal END) OVER w AS h2, max(CASE WHEN ordinal % 12 IN (2, 6) THEN ordinal END) OVER w AS h3 FROM (SELECT doc_id, i::INTEGER AS ordinal FROM documents, range(0, 30) t(i)) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))""")
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("ordinal") % 12
    b = views.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("ordinal"))
    b = b.withColumns({"level": F.when(n == 0, 1).when(n == 4, 2).when(n.isin(2, 6), 3), "text": F.concat(F.lit("H"), F.col("ordinal").cast("string"))})
    return o.heading_path(b).select("doc_id", "ordinal", "heading_path")


@query("""SELECT s.doc_id, p::INTEGER AS page, coalesce(n, 0) AS blocks, coalesce(t, 0) AS tables FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) s, range(1, 8) r(p) LEFT JOIN (
    SELECT l_orderkey AS doc_id, l_linenumber AS page, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS t FROM lineitem GROUP BY 1, 2) b ON b.doc_id = s.doc_id AND b.page = p""")
def page_layout(spark: SparkSession, d: str) -> DataFrame:
    x = views.table(spark, d, "lineitem")
    blocks = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_partkey").cast("string").alias("block_id"), F.when(F.col("l_returnflag") == "R", "table").otherwise("text").alias("kind"))
    spans = x.select(F.col("l_orderkey").alias("doc_id")).distinct().withColumns({"page_start": F.lit(1), "page_end": F.lit(7)})
    return o.page_layout(blocks, spans).select("doc_id", "page", F.size("blocks").cast("long").alias("blocks"), "tables")


views.SQL["v_words"] = "SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM documents"
views.SQL["v_windows"] = """SELECT doc_id, i::INTEGER AS part, array_to_string(words[i * 448 + 1 : i * 448 + 512], ' ') AS text FROM v_words, unnest(range(0, CASE WHEN len(words) = 0 THEN 0 WHEN len(words) <= 512 THEN 1 ELSE ceil((len(words) - 512) / 448.0)::BIGINT + 1 END)) t(i)"""


@query("SELECT doc_id, part, md5(text) AS digest FROM v_windows")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    c = o.chunk_text(views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return c.select("doc_id", "part", F.md5("text").alias("digest"))


@query("SELECT doc_id, part, doc_id || '_chunk_' || lpad(part::VARCHAR, 4, '0') || '_' || substr(sha1(doc_id || '|' || part || '|None|3|' || substr(text, 1, 2000)), 1, 12) AS chunk_id FROM v_windows")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    c = o.chunk_text(views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    seed = o.chunk_seed(F.col("doc_id"), F.col("part"), F.lit(None), F.lit(3), F.col("text"))
    return c.select(F.col("doc_id").cast("long").alias("doc_id"), "part", o.stable_id(F.col("doc_id"), "chunk", F.col("part"), seed).alias("chunk_id"))


@query("SELECT doc_id, ordinal, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1)::INTEGER AS chunk_index FROM v_sections")
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return o.chunk_index(views.sections(spark, d).select("doc_id", "ordinal"), "ordinal")


views.SQL["v_valid"] = "SELECT l_orderkey, header, i::INTEGER - 1 AS row_index, rows[i] AS row, rows FROM v_lines, unnest(range(1, len(rows) + 1)) t(i) WHERE len(list_filter(rows[i], lambda c: trim(c) <> '')) >= 2"
_VALUES = "list_filter(['line=' || trim(row[1]), 'part=' || trim(row[2]), CASE WHEN trim(row[3]) <> '' THEN 'col_3=' || trim(row[3]) END, CASE WHEN trim(row[4]) <> '' THEN 'price=' || trim(row[4]) END], lambda x: x IS NOT NULL)"
_MD = "'| ' || array_to_string({0}, ' | ') || ' |'"


def order_tables(spark: SparkSession, d: str) -> DataFrame:
    return doc_tables(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("table_id"), "header", "rows")


def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return o.chunk_table(order_tables(spark, d))


views.SQL["v_ct"] = f"""SELECT l_orderkey AS doc_id, 'table_full' AS chunk_type, NULL::INTEGER AS row_index, {_MD.format("header")} || chr(10) || '| --- | --- | --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda r: {_MD.format("r")}), chr(10)) AS content, NULL AS linked_id FROM v_lines
    UNION ALL SELECT l_orderkey, 'table_row', row_index, trim(row[1]) || ' | ' || array_to_string({_VALUES}, ' | '), 'financial_report_vi_t' || l_orderkey || '_window_' || lpad(row_index::VARCHAR, 4, '0') FROM v_valid
    UNION ALL SELECT a.l_orderkey, 'table_row_window', a.row_index, {_MD.format("any_value(a.header)")} || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg({_MD.format("b.row")}, chr(10) ORDER BY b.row_index), 'financial_report_vi_t' || a.l_orderkey || '_row_' || lpad(a.row_index::VARCHAR, 4, '0')
        FROM v_valid a JOIN v_valid b ON a.l_orderkey = b.l_orderkey AND abs(a.row_index - b.row_index) <= 1 GROUP BY a.l_orderkey, a.row_index"""


@query("SELECT doc_id, chunk_type, row_index, content, linked_id FROM v_ct")
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    return table_chunks(spark, d).select("doc_id", "chunk_type", "row_index", "content", "linked_id")


@query("SELECT a.l_orderkey AS doc_id, a.row_index, list(b.row_index ORDER BY b.row_index) AS neighbours FROM v_valid a JOIN v_valid b ON a.l_orderkey = b.l_orderkey AND abs(a.row_index - b.row_index) <= 1 GROUP BY 1, 2")
def table_row_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_tables(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.posexplode("rows").alias("row_index", "row")).filter(F.size(F.filter("row", lambda c: F.trim(c) != "")) >= 2)
    return rows.select("doc_id", "row_index", F.sort_array(F.collect_list("row_index").over(Window.partitionBy("doc_id").orderBy("row_index").rangeBetween(-1, 1))).alias("neighbours"))


@query("SELECT doc_id, 2000 + doc_id % 30 AS year, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE lang END AS lang, source FROM documents".replace("2000 + doc_id % 30", "(2000 + doc_id % 30)::INTEGER"))
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    x = views.table(spark, d, "documents")
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("own"))).otherwise(F.create_map(F.lit("k"), F.lit("v")))
    meta = x.select("doc_id", F.create_map(F.lit("year"), (2000 + F.col("doc_id") % 30).cast("string"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    out = o.chunk_metadata(x.select("doc_id", own.alias("chunk_metadata")), meta)
    return out.select("doc_id", "year", F.try_element_at("chunk_metadata", F.lit("lang")).alias("lang"), F.try_element_at("chunk_metadata", F.lit("source")).alias("source"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'provider' ELSE 'own' END AS kind FROM documents")
def chunks_from_provider(spark: SparkSession, d: str) -> DataFrame:
    x = views.table(spark, d, "documents").select("doc_id", F.lit("own").alias("kind"), F.lit("t").alias("text"))
    p = x.withColumns({"kind": F.lit("provider"), "text": F.when(F.col("doc_id") % 3 == 0, "t").otherwise(" ")})
    return o.chunks_from_provider(x, p).select("doc_id", "kind")


@query()
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = o.embed_chunks(views.table(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT::DECIMAL(20, 0) AS point_id FROM documents")
def point_id(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", o.point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END AS content, 2020 AS fiscal_year, CASE WHEN doc_id % 3 = 0 THEN [source] ELSE [doc_id::VARCHAR] END AS source_ids FROM documents")
def build_payload(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    c = views.table(spark, d, "documents").select("doc_id", i.cast("string").alias("chunk_id"), F.when(i % 2 == 1, F.col("lang")).otherwise("").alias("content_for_embedding"), F.col("text").alias("raw_content"), F.lit(None).cast("int").alias("fiscal_year"), F.lit(2020).alias("year"), F.when(i % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("source_ids"))
    return o.build_payload(c).select("doc_id", F.col("content_for_embedding").alias("content"), "fiscal_year", "source_ids")


_R = "CASE {0} WHEN 'DISCOVERED' THEN 10 WHEN 'DOWNLOADED' THEN 20 WHEN 'PARSED' THEN 30 WHEN 'CHUNKED' THEN 40 WHEN 'EMBEDDED' THEN 50 WHEN 'FAILED' THEN 100 ELSE 0 END"


def states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First and last status of each document by the event log."""
    e = views.ingest_events(spark, d).groupBy("doc_id").agg(F.min_by("new_status", "event_id").alias("first"), F.max_by("new_status", "event_id").alias("last"))
    state = e.select("doc_id", F.col("first").alias("status"), F.lit("old").alias("raw_path"), F.lit("t").alias("ticker"))
    return state, e.select("doc_id", F.col("last").alias("status"), F.lit(None).cast("string").alias("raw_path"), F.lit(None).cast("string").alias("ticker"))


@query(f"SELECT doc_id, CASE WHEN {_R.format('l')} < {_R.format('f')} THEN f ELSE l END AS status, 'old' AS raw_path, NULL AS ticker FROM (SELECT doc_id, arg_min(new_status, event_id) AS f, arg_max(new_status, event_id) AS l FROM v_ingest GROUP BY 1)")
def doc_upsert_monotone(spark: SparkSession, d: str) -> DataFrame:
    return o.doc_upsert_monotone(*states(spark, d))


@query("SELECT doc_id, event_id AS seq, coalesce(lag(new_status) OVER (PARTITION BY doc_id ORDER BY event_id), first_value(new_status) OVER (PARTITION BY doc_id ORDER BY event_id)) AS old_status, new_status FROM v_ingest")
def status_transition(spark: SparkSession, d: str) -> DataFrame:
    state, _ = states(spark, d)
    _, events, _ = o.status_transition(state, views.ingest_events(spark, d).select("doc_id", "new_status", F.col("event_id").alias("seq")))
    return events.select("doc_id", "seq", "old_status", "new_status")


@query("SELECT o_orderkey, (o_orderkey % 4 = 0) AS ok FROM orders")
def validate_jobs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    job = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("fpt").alias("ticker"), F.when(n == 1, " ").otherwise("Q1").alias("period"), *(F.lit("x").alias(c) for c in ("report_type", "report_family", "source", "source_url"))))
    year = F.when(n == 2, "true").otherwise("2025")
    value = F.when(n == 3, "{broken").otherwise(F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"fiscal_year":'), year, F.lit(',"quarter":null}')))
    rows = views.table(spark, d, "orders").withColumn("j", job).select("o_orderkey", value.alias("value"))
    good, bad = o.validate_jobs(rows, "download")
    return good.select(F.col("doc_id").cast("long").alias("o_orderkey"), F.lit(True).alias("ok")).unionByName(bad.select("o_orderkey", F.lit(False).alias("ok")))


@query("SELECT user_id::VARCHAR AS doc_id, CASE event_type WHEN 'error' THEN 'CHUNK_FAILED' ELSE 'CHUNK_COMPLETED' END AS event_type, CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'CHUNKED' END AS new_status FROM events")
def stage_outputs(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.when(F.col("event_type") == "error", "boom").alias("error"))
    return o.stage_outputs(e, "chunk")[1].select("doc_id", "event_type", "new_status")


@query("SELECT doc_id FROM (SELECT doc_id, arg_min(new_status, event_id) AS s, min(ts) AS t FROM v_ingest GROUP BY 1) WHERE s = 'DISCOVERED' ORDER BY t, doc_id LIMIT 50")
def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    e = views.ingest_events(spark, d).groupBy("doc_id").agg(F.min_by("new_status", "event_id").alias("status"), F.min("ts").alias("created_at"))
    return o.pending_documents(e).select("doc_id")


@query("SELECT doc_id, part, (doc_id % 50 = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS renewed FROM v_windows")
def reprocess_document(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents; those of chosen ones are made anew and put in place of the old ones, all others stay."""
    docs = views.table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    old = o.chunk_text(docs.select("doc_id", "text")).select("doc_id", "part", F.lit(False).alias("renewed"))
    new = o.chunk_text(docs.filter("doc_id % 50 = 0 AND lang = 'en'").select("doc_id", "text")).select("doc_id", "part", F.lit(True).alias("renewed"))
    kept = old.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(new)

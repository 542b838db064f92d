"""Report documents: discovery, parsing, chunking, identifiers, embeddings, life-cycle."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakeloom.functions.text import slug, squeeze
from lakeloom.operators.market import status_rank
from lakeloom.schemas import STATUS_RANK

TARGET, OVERLAP = 512, 64
#: The report site's layout.
BASE_URL = "https://static2.vietstock.vn/data"
QUARTERS = ((1, "QUY%201", ("Q1",)), (2, "QUY%202", ("Q2", "6T")), (3, "QUY%203", ("Q3", "9T")), (4, "QUY%204", ("Q4",)))
REPORT_TYPES, SCOPES = ("Soatxet", "KiemToan"), ("Congtyme", "Hopnhat")

#: Fiscal years that one discovery can ask for.
MOST_YEARS = 200

# -- discovery --------------------------------------------------------------------------------------------------------


def discovery_requests(tickers: DataFrame, years: DataFrame, exchanges: DataFrame, default: str = "HOSE") -> DataFrame:
    """Every ticker with every fiscal year (one array of distinct years), and its exchange or the default."""
    wanted = sorted(r["fiscal_year"] for r in years.select("fiscal_year").distinct().limit(MOST_YEARS + 1).collect())
    if len(wanted) > MOST_YEARS:
        raise ValueError(f"more than {MOST_YEARS} fiscal years")
    rows = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().withColumn("fiscal_year", F.explode(F.array(*map(F.lit, wanted)).cast(f"array<{dict(years.dtypes)['fiscal_year']}>")))
    return rows.join(exchanges.select("ticker", "exchange"), "ticker", "left").withColumn("exchange", F.coalesce("exchange", F.lit(default)))


def generate_report_candidates(requests: DataFrame, base: str = BASE_URL) -> DataFrame:
    """For each ticker, exchange and year: the quarterly periods by report type and scope, and the annual report."""
    kinds = [F.struct(F.lit(q).alias("quarter"), F.lit(path).alias("path"), F.lit(p).alias("period"), F.lit(r).alias("report_type"), F.lit(s).alias("scope")) for q, path, ps in QUARTERS for p in ps for r in REPORT_TYPES for s in SCOPES]
    annual = F.struct(F.lit(None).cast("int").alias("quarter"), F.lit(None).cast("string").alias("path"), F.lit("Annual").alias("period"), F.lit("BCTN").alias("report_type"), F.lit(None).cast("string").alias("scope"))
    rows = requests.withColumn("k", F.explode(F.array(*kinds, annual))).select("ticker", "exchange", "fiscal_year", "k.*")
    year = F.col("fiscal_year").cast("string")
    once = F.col("quarter").isNull()
    doc_id = F.when(once, F.concat_ws("_", slug(F.col("ticker")), year, F.lit("BCTN"))).otherwise(
        F.concat_ws("_", slug(F.col("ticker")), year, F.concat(F.lit("Q"), F.col("quarter").cast("string")), slug(F.col("period")), slug(F.col("report_type")), slug(F.col("scope")))
    )
    head = F.concat_ws("/", F.lit(base), F.col("exchange"), year)
    url = F.when(once, F.concat(head, F.lit("/BCTN/VN/"), F.col("ticker"), F.lit("_Baocaothuongnien_"), year, F.lit(".pdf"))).otherwise(
        F.concat(head, F.lit("/BCTC/VN/"), "path", F.lit("/"), F.concat_ws("_", "ticker", F.lit("Baocaotaichinh"), "period", year, "report_type", "scope"), F.lit(".pdf"))
    )
    return rows.withColumns({"doc_id": doc_id, "source_url": url, "report_family": F.when(once, "BCTN").otherwise("BCTC")}).drop("path")


def available(candidates: DataFrame, urls: DataFrame) -> DataFrame:
    return candidates.join(urls.select("source_url"), "source_url", "left_semi")


# -- pages, sections, tables ------------------------------------------------------------------------------------------


def explode_pages(documents: DataFrame) -> DataFrame:
    """Pages of parsed documents: the page number if it is a positive whole number, else the place in the list; the text
    under any of its names. ``pages`` is array<struct<page, page_number, number, markdown, text, content: string>>."""
    rows = documents.select("doc_id", F.posexplode("pages").alias("i", "p"))
    number = F.coalesce(*(F.when(F.col(f"p.{c}").try_cast("int") > 0, F.col(f"p.{c}").try_cast("int")) for c in ("page", "page_number", "number")), F.col("i") + 1)
    text = F.coalesce(*(F.nullif(F.col(f"p.{c}"), F.lit("")) for c in ("markdown", "text", "content")), F.lit(""))
    return rows.select("doc_id", number.alias("page"), text.alias("text"))


def section_segmentation(pages: DataFrame) -> DataFrame:
    """A heading begins a section; text before any heading of a document is titled by its page; empty sections go."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = F.regexp_extract("line", r"^\s*#{1,6}\s+(.*\S)\s*$", 1)
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    rows = rows.withColumn("heading", F.nullif(heading, F.lit("")))
    rows = rows.withColumn("section", F.sum(F.col("heading").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(F.col("heading").isNull() & (F.trim("line") != ""), F.struct("page", "line_no", "line"))
    out = rows.groupBy("doc_id", "section").agg(F.max("heading").alias("heading"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_list(body)).alias("lines"))
    out = out.filter(F.size("lines") > 0)
    return out.select("doc_id", "section", F.coalesce("heading", F.concat(F.lit("Page "), F.col("page_start").cast("string"))).alias("title"), "page_start", "page_end", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


_CELLS = r"^\s*\|?(.*?)\|?\s*$"


def split_row(line: Column) -> Column:
    return F.transform(F.split(F.regexp_extract(line, _CELLS, 1), r"\|"), lambda x: F.trim(x))


def extract_markdown_tables(pages: DataFrame) -> DataFrame:
    """Tables of markdown pages: a line of two cells or more, a separator line, then rows up to a line without a bar. A page
    is read where it is: its lines are told apart once, breaks in order give each header's end."""
    rows = pages.select("doc_id", "page", F.split("text", "\n").alias("_lines"))
    separator = lambda x: F.rlike(x, F.lit(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"))
    bar = lambda x: F.contains(x, F.lit("|"))
    heading = lambda x: F.nullif(F.regexp_extract(x, r"^\s*#{1,6}\s+(.*\S)\s*$", 1), F.lit(""))
    header = lambda x, i: bar(x) & F.coalesce(separator(F.get("_lines", i + 1)), F.lit(False)) & ~separator(x) & (F.size(split_row(x)) >= 2)
    told = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), header(x, i).alias("head"), bar(x).alias("bar"), heading(x).alias("title")))
    rows = rows.withColumn("_told", told)
    breaks = F.filter(F.transform("_told", lambda x: F.struct(x["i"], x["head"], x["bar"])), lambda x: x["head"] | ~x["bar"])
    rows = rows.withColumns({"_breaks": breaks, "_titles": F.filter("_told", lambda x: x["title"].isNotNull())}).drop("_told")
    ends = F.transform("_breaks", lambda x, k: F.struct(x["head"], x["i"].alias("first"), F.coalesce(F.get("_breaks", k + 1)["i"], F.size("_lines")).alias("end")))
    rows = rows.select("doc_id", "page", "_lines", "_titles", F.posexplode(F.filter(ends, lambda x: x["head"])).alias("_k", "_t"))
    first, end = F.col("_t.first"), F.col("_t.end")
    before = F.try_element_at(F.transform(F.filter("_titles", lambda x: x["i"] <= first), lambda x: x["title"]), F.lit(-1))
    within = F.transform(F.filter("_titles", lambda x: (x["i"] > first) & (x["i"] < end)), lambda x: x["title"])
    title = F.array_max(F.concat(F.array(before), within))
    body = F.transform(F.slice("_lines", first + 3, F.greatest(end - first - 2, F.lit(0))), split_row)
    return rows.select("doc_id", "page", (F.col("_k") + 1).alias("ordinal"), F.coalesce(title, F.concat(F.lit("Page "), F.col("page").cast("string"))).alias("section_title"), split_row(F.get("_lines", first)).alias("header"), body.alias("rows"))


def extract_html_tables(pages: DataFrame) -> DataFrame:
    """Tables of HTML pages, see ``functions.sql.html_tables``: nested tables on their own, spanning cells repeated. Pages
    are read a batch at a time."""
    from lakeloom.functions.sql import html_tables

    own = [pages.schema[c] for c in ("doc_id", "page")]
    found = [T.StructField("ordinal", T.IntegerType()), T.StructField("header", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]
    schema = T.StructType([*own, *found])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, tables = [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                for table in html_tables(text):
                    at.append(i)
                    tables.append(table)
            kept = [rows.column(c).take(pa.array(at, pa.int64())).cast(arrow.field(c).type) for c in ("doc_id", "page")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([t[k] for t in tables], arrow.field(f.name).type) for k, f in enumerate(found))], schema=arrow)

    return pages.select("doc_id", "page", "text").mapInArrow(run, schema)


def extract_provider_tables(documents: DataFrame) -> DataFrame:
    """Table objects with ``header`` or ``columns``, rows, page and title, trimmed."""
    rows = documents.select("doc_id", F.posexplode("tables").alias("ordinal", "t"))
    trim = lambda a: F.transform(a, lambda x: F.trim(x))
    return rows.select("doc_id", "ordinal", F.col("t.page").alias("page"), F.col("t.section_title").alias("section_title"), trim(F.coalesce("t.header", "t.columns")).alias("header"), F.transform("t.rows", trim).alias("rows"))


def union_tables(*tables: DataFrame) -> DataFrame:
    """Tables of several finders in order, the first of each (page, title, content)."""
    both = None
    for i, x in enumerate(tables):
        x = x.withColumn("finder", F.lit(i))
        both = x if both is None else both.unionByName(x, allowMissingColumns=True)
    mark = F.sha1(F.to_json(F.struct("header", "rows")))
    w = Window.partitionBy("doc_id", "page", "section_title", "mark").orderBy("finder", "ordinal")
    return both.withColumn("mark", mark).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "mark")


def table_profile(tables: DataFrame) -> DataFrame:
    """Row and column counts and a preview of 120 characters."""
    text = render_markdown(F.col("header"), F.col("rows"))
    return tables.withColumns({"row_count": F.size("rows"), "col_count": F.size("header"), "preview": F.substring(text, 1, 120)})


def heading_path(blocks: DataFrame) -> DataFrame:
    """The stack of headings above each block (doc_id, ordinal, level, text; level null for plain blocks): a heading of
    level n drops those of its level and deeper."""
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    out, shallow, parts = blocks, F.lit(-1), []
    for n in range(1, 7):
        at = F.last(F.when(F.col("level") == n, F.struct("ordinal", "text")), ignorenulls=True).over(order)
        out = out.withColumn(f"_{n}", at)
        parts.append(F.when(F.col(f"_{n}.ordinal") > shallow, F.col(f"_{n}.text")))
        shallow = F.greatest(shallow, F.col(f"_{n}.ordinal"))
    path = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return out.withColumn("heading_path", path).drop(*(f"_{n}" for n in range(1, 7)))


def page_layout(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks of each page of a document's span; pages without one are there, empty."""
    pages = spans.select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    found = blocks.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("block_id")).alias("blocks"), F.count_if(F.col("kind") == "table").alias("tables"))
    out = pages.join(found, ["doc_id", "page"], "left")
    return out.withColumns({"blocks": F.coalesce("blocks", F.array().cast("array<string>")), "tables": F.coalesce("tables", F.lit(0))})


# -- chunks -----------------------------------------------------------------------------------------------------------


def stable_id(doc_id: Column, prefix: str, index: Column, seed: Column) -> Column:
    return F.concat_ws("_", doc_id, F.lit(prefix), F.lpad(index.cast("string"), 4, "0"), F.substring(F.sha1(seed), 1, 12))


def chunk_seed(doc_id: Column, index: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    """Parts joined by bars; a null page is the word None."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws("|", doc_id, index.cast("string"), none(page_start), none(page_end), F.substring(text, 1, 2000))


def chunk_text(sections: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``target`` words, ``overlap`` shared, up to the first that reaches the end: doc_id, ordinal, part, text."""
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap smaller than it")
    step = target - overlap
    words = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda x: x != "")
    rows = sections.withColumn("words", words).filter(F.size("words") > 0)
    count = F.when(F.size("words") <= target, 1).otherwise(F.ceil((F.size("words") - target) / F.lit(step)) + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("words", i * step + 1, F.lit(target)), " "))
    return rows.select(*(c for c in sections.columns if c != "text"), F.posexplode(parts).alias("part", "text"))


def chunk_index(chunks: DataFrame, *order: str) -> DataFrame:
    """0-based place among a document's chunks."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def render_markdown(header: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), line(F.transform(header, lambda _: F.lit("---")))), F.transform(rows, line)), "\n")


def row_values(header: Column, row: Column) -> Column:
    """Ordered key and value of each cell; blank headers are col_i."""
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size(header), F.size(row), F.lit(1))), lambda i: F.coalesce(F.nullif(F.trim(F.get(header, i - 1)), F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))
    return F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.coalesce(F.trim(F.get(row, i)), F.lit("")).alias("value")))


def chunk_table(tables: DataFrame) -> DataFrame:
    """One table_full chunk for each table, and for each row with two filled cells or more a table_row and a
    table_row_window with its valid neighbours, linked both ways. Tables have table_id, header and rows; a table's chunks
    are made in narrow steps, nothing is shuffled, and texts are made only of chunks that are left when they are needed."""
    retrieval = lambda c: F.concat(F.lit("financial_report_vi_"), c)
    filled = lambda row: F.filter(row, lambda c: F.trim(c) != "")
    numbered = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r, i: F.struct(i.alias("row_index"), r.alias("row")))
    rows = tables.withColumn("_valid", F.filter(numbered, lambda x: F.size(filled(x["row"])) >= 2))
    kinds = ("table_full", "table_row", "table_row_window")
    of_row = lambda _, i: F.array(*(F.struct(F.lit(k).alias("chunk_type"), i.alias("i")) for k in kinds[1:]))
    every = F.concat(F.array(F.struct(F.lit(kinds[0]).alias("chunk_type"), F.lit(-1).alias("i"))), F.flatten(F.transform("_valid", of_row)))
    rows = rows.select("doc_id", "table_id", "header", "rows", "_valid", F.explode(every).alias("c")).select("doc_id", "table_id", "header", "rows", "_valid", "c.*")
    kind, table_id, header, x = F.col("chunk_type"), F.col("table_id"), F.col("header"), F.get("_valid", F.col("i"))
    full, one = kind == kinds[0], kind == kinds[1]
    place = lambda name: F.concat(table_id, F.lit(f"_{name}_"), F.lpad(x["row_index"].cast("string"), 4, "0"))
    row_id, window_id, label = place("row"), place("window"), F.when(~full, F.trim(F.get(filled(x["row"]), F.lit(0))))
    values = F.filter(row_values(header, x["row"]), lambda v: v["value"] != "")
    text = F.array_join(F.concat(F.array(label), F.transform(values, lambda v: F.concat_ws("=", v["key"], v["value"]))), " | ")
    near = F.filter(F.array(F.get("_valid", F.col("i") - 1), x, F.get("_valid", F.col("i") + 1)), lambda y: y["row_index"].between(x["row_index"] - 1, x["row_index"] + 1))
    window = render_markdown(header, F.transform(near, lambda y: y["row"]))
    return rows.select(
        "doc_id", "table_id", kind, F.when(~full, x["row_index"]).alias("row_index"), label.alias("row_label"), F.when(full, render_markdown(header, F.col("rows"))).when(one, text).otherwise(window).alias("content"),
        retrieval(F.when(full, table_id).when(one, row_id).otherwise(window_id)).alias("retrieval_id"), F.when(one, retrieval(window_id)).when(~full, retrieval(row_id)).alias("linked_id"),
        F.when(full, F.array(table_id)).when(one, F.array(table_id, row_id)).otherwise(F.array(table_id, row_id, window_id)).alias("source_ids"),
    )


def chunk_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Document metadata (a map) put beside every chunk without overriding the chunk's own keys."""
    rows = chunks.join(metadata, "doc_id", "left")
    own = F.map_keys("chunk_metadata")
    more = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(own, k))
    year = F.coalesce(F.try_element_at("metadata", F.lit("fiscal_year")), F.try_element_at("metadata", F.lit("year"))).try_cast("int")
    return rows.withColumns({"year": year, "chunk_metadata": F.map_concat("chunk_metadata", more)}).drop("metadata")


def chunks_from_provider(own: DataFrame, provider: DataFrame) -> DataFrame:
    """A document's provider chunks when it has any with text, else our own."""
    provider = provider.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    return provider.unionByName(own.join(provider.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)


def normalize_provider_chunks(chunks: DataFrame) -> DataFrame:
    """Page from the 0-based grounding page, first box, lower-case type, heading level given or by number signs."""
    g = F.get("grounding", F.lit(0))
    level = F.coalesce(F.col("level"), F.nullif(F.length(F.regexp_extract("text", r"^\s*(#+)\s", 1)), F.lit(0)))
    return chunks.withColumns({"page": g["page"] + 1, "box": g["box"], "chunk_type": F.lower("chunk_type"), "heading_level": level})


# -- embeddings -------------------------------------------------------------------------------------------------------


def hash_vector(text: str, size: int = 32) -> list[float]:
    """A unit vector from the SHA-256 digest: deterministic, for tests and wiring, not for meaning."""
    digest = hashlib.sha256(text.encode()).digest()
    raw = [digest[i % len(digest)] / 255 - 0.5 for i in range(size)]
    norm = math.sqrt(sum(x * x for x in raw)) or 1.0
    return [x / norm for x in raw]


def hash_vectors(texts: list[str], size: int = 32) -> np.ndarray:
    """``hash_vector`` of many texts, in single precision."""
    digests = np.frombuffer(b"".join(hashlib.sha256(x.encode()).digest() for x in texts), np.uint8).reshape(len(texts), 32)
    raw = digests[:, np.arange(size) % 32] / 255 - 0.5
    norm = np.sqrt((raw.astype(np.longdouble) ** 2).sum(1).astype(float))
    return (raw / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)


def embed_chunks(chunks: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, batch: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to ``keep`` and vector of every chunk. ``encoder`` is called once in each worker and gives a function
    over batches; it must give as many vectors as texts."""
    schema = T.StructType([*(chunks.schema[c] for c in (key, *keep)), T.StructField("vector", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder() if encoder else None
        for rows in batches:
            some, vectors = rows.column("_text").to_pylist(), []
            if encode is None:
                found = hash_vectors(some)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            for i in range(0, len(some) if encode else 0, batch):
                found = encode(some[i : i + batch])
                if len(found) != len(some[i : i + batch]):
                    raise ValueError("the encoder lost texts")
                vectors += found
            vectors = vectors.cast(arrow.field("vector").type) if encode is None else pa.array(vectors, arrow.field("vector").type)
            yield pa.RecordBatch.from_arrays([*(rows.column(c).cast(arrow.field(c).type) for c in (key, *keep)), vectors], schema=arrow)

    return chunks.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def point_id(chunk_id: Column) -> Column:
    """The first eight bytes of the SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(chunk_id), 1, 16), 16, 10).cast("decimal(20,0)")


def build_payload(chunks: DataFrame) -> DataFrame:
    """Fields with their fallbacks; source_ids default to the chunk itself."""
    return chunks.withColumns(
        {
            "point_id": point_id(F.col("chunk_id")),
            "content_for_embedding": F.coalesce(F.nullif("content_for_embedding", F.lit("")), "raw_content"),
            "fiscal_year": F.coalesce("fiscal_year", "year"),
            "source_ids": F.when(F.size("source_ids") > 0, F.col("source_ids")).otherwise(F.array("chunk_id")),
        }
    )


# -- life-cycle -------------------------------------------------------------------------------------------------------


def doc_upsert_monotone(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or update by doc_id: the status moves to an equal or higher rank only; paths and errors keep the old value
    when none comes; other columns are replaced."""
    keep = [c for c in state.columns if c.endswith("_path") or c == "error_message"]
    both = state.withColumn("_there", F.lit(True)).alias("o").join(batch.withColumn("_there", F.lit(True)).alias("n"), "doc_id", "full_outer")
    new, old = (F.coalesce(F.col(f"{x}._there"), F.lit(False)) for x in "no")

    def rule(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "status":
            n = F.when(old & (status_rank(n) < status_rank(o)), o).otherwise(n)
        elif c in keep:
            n = F.coalesce(n, o)
        return F.when(new, n).otherwise(o).alias(c)

    return both.select("doc_id", *(rule(c) for c in state.columns if c != "doc_id"))


def status_transition(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set statuses without regard to rank (changes: doc_id, new_status, seq): the new state, the events with old and new
    status, and the changes whose document or status is unknown."""
    known = changes.join(state.select("doc_id", F.col("status").alias("_status")), "doc_id", "left")
    ok = F.col("_status").isNotNull() & F.col("new_status").isin(*STATUS_RANK)
    order = Window.partitionBy("doc_id").orderBy("seq")
    good = known.filter(ok).withColumn("old_status", F.coalesce(F.lag("new_status").over(order), "_status"))
    events = good.select("doc_id", F.concat(F.lit("STATUS_"), "new_status").alias("event_type"), "old_status", "new_status", "seq")
    last = good.groupBy("doc_id").agg(F.max_by("new_status", "seq").alias("_new"))
    out = state.join(last, "doc_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return out, events, known.filter(~ok).drop("_status")


REQUIRED = ("doc_id", "ticker", "period", "report_type", "report_family", "source", "source_url")
STAGE_FIELDS = {"download": (), "parse": ("raw_bucket", "raw_object_key"), "chunk": ("markdown_bucket", "markdown_object_key", "json_bucket", "json_object_key"), "embedding": ("chunks_bucket", "chunks_object_key", "collection")}


def validate_jobs(messages: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """JSON job messages (column ``value``) of a stage: parsed valid jobs, and dead letters with their errors. Strings must
    be there and not blank; fiscal_year must be a whole number (true and false are none); quarter may be null. A message is
    parsed once, whatever is read of it."""
    strings = [*REQUIRED, *STAGE_FIELDS[stage]]
    parsed = F.try_parse_json("value")
    one = lambda n: F.try_variant_get("_json", f"$.{n}", "string")
    kind = lambda n: F.schema_of_variant(F.try_variant_get("_json", f"$.{n}", "variant"))
    said = lambda n: F.get_json_object("value", f"$.{n}")  # noqa: E731  # as it is written: 2025.0 is no whole number
    texts = [*((n, one(n)) for n in strings), *((n, said(n)) for n in ("fiscal_year", "quarter"))]
    read = F.struct(*(F.struct(x.alias("text"), kind(n).alias("kind")).alias(n) for n, x in texts), said("scope").alias("scope"), F.col("_json").isNotNull().alias("_ok"))
    # generators keep what is parsed from being worked out again by the filters that follow
    rows = messages.withColumn("_json", F.explode(F.array(parsed)))
    rows = rows.withColumn("_job", F.explode(F.array(read))).drop("_json")
    get, told = lambda n: F.col(f"_job.{n}.text"), lambda n: F.col(f"_job.{n}.kind")
    whole = lambda n: (told(n) != "STRING") & F.rlike(get(n), F.lit(r"^-?\d+$"))
    errors = [F.when(~F.coalesce((told(n) == "STRING") & (F.trim(get(n)) != ""), F.lit(False)), F.lit(f"{n} must be a non-empty string")) for n in strings]
    errors.append(F.when(~F.coalesce(whole("fiscal_year"), F.lit(False)), F.lit("fiscal_year must be an integer")))
    errors.append(F.when((F.coalesce(told("quarter"), F.lit("VOID")) != "VOID") & ~whole("quarter"), F.lit("quarter must be an integer or null")))
    bad = F.when(~F.col("_job._ok"), F.array(F.lit("not JSON"))).otherwise(F.filter(F.array(*errors), lambda x: x.isNotNull()))
    rows = rows.withColumn("errors", bad)
    fields = [F.upper(get(n)).alias(n) if n == "ticker" else get(n).alias(n) for n in strings]
    good = rows.filter(F.size("errors") == 0).select(*fields, get("fiscal_year").cast("int").alias("fiscal_year"), get("quarter").try_cast("int").alias("quarter"), F.col("_job.scope").alias("scope"))
    return good, rows.filter(F.size("errors") > 0).drop("_job")


NEXT_STAGE = {"download": ("DOWNLOADED", "parse"), "parse": ("PARSED", "chunk"), "chunk": ("CHUNKED", "embedding"), "embedding": ("EMBEDDED", None)}


def stage_outputs(outcomes: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """From a stage's outcomes (jobs with artifact columns and a nullable error): the next stage's jobs, and the status
    events of all."""
    status, _ = NEXT_STAGE[stage]
    failed = F.col("error").isNotNull()
    events = outcomes.select("doc_id", F.concat(F.lit(stage.upper()), F.when(failed, "_FAILED").otherwise("_COMPLETED")).alias("event_type"), F.when(failed, "FAILED").otherwise(status).alias("new_status"), F.col("error").alias("error_detail"))
    return outcomes.filter(~failed).drop("error"), events


def pending_documents(state: DataFrame, limit: int = 50) -> DataFrame:
    """Discovered documents, oldest first."""
    return state.filter(F.col("status") == "DISCOVERED").orderBy("created_at", "doc_id").limit(limit)

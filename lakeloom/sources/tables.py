"""Readers and writers: provider payloads, parsed reports, chunk sets, partitioned and versioned Parquet tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.text import slug
from lakeloom.operators.market import PAYLOAD_FIELDS

# -- folders and versioned tables -------------------------------------------------------------------------------------

#: Hash parts of a new table whose parts the caller does not name, and rows of a part from which on they are multiplied.
BUCKETS, PART_ROWS = 16, 4_000_000
#: How often a writer starts over because another one committed first.
ATTEMPTS = 50


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; one of our own only where none is set and all of Spark runs in
    one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lakeloom-")
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def written(rows: DataFrame, what: str) -> DataFrame:
    """Rows written to the shared folder and read again: worked out once, whatever is made of them."""
    path = scratch(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/_versions")
    if not files.exists(at):
        return []
    return sorted(int(x.getPath().getName()) for x in files.listStatus(at) if x.getPath().getName().isdigit())


def current_version(spark: SparkSession, path: str) -> int:
    """The last committed version of a table, 0 when there is none. A commit is one file that appears whole or not at all."""
    return max(_versions(spark, path), default=0)


def _state(spark: SparkSession, path: str, version: int) -> dict:
    """What a commit holds: the number of hash parts, and the folder and rows of each part."""
    if not version:
        return {"buckets": BUCKETS, "parts": {}}
    files, at = _files(spark, f"{path}/_versions/{version}")
    stream = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _read_parts(spark: SparkSession, path: str, parts: dict[str, list], schema: T.StructType | str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}/part={k}" for k, (folder, _) in sorted(parts.items())))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The current version, or an empty table."""
    return _read_parts(spark, path, _state(spark, path, current_version(spark, path))["parts"], schema)


def _commit(spark: SparkSession, path: str, version: int, state: dict) -> bool:
    """Publish a version; False if that number is there already. The file is written under a name of its own and gets its
    number in one step that fails where the number is taken: a link on a local disk, elsewhere a rename that does not
    overwrite (atomic on file systems such as HDFS; a store whose rename copies allows one writer only).

    Folders that neither this version nor the one before it needs are removed, with their commits; what a writer has not
    committed belongs to no version and is never touched by another."""
    jvm = spark._jvm
    files, temporary = _files(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{version}")
    out = files.create(temporary, False)
    jvm.org.apache.commons.io.IOUtils.write(json.dumps(state), out, "UTF-8")
    out.close()
    try:
        if files.getScheme() == "file":
            local = [jvm.java.nio.file.Paths.get(files.makeQualified(x).toUri()) for x in (target, temporary)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(temporary, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(temporary, False)
    used = [state["parts"], _state(spark, path, version - 1)["parts"] if version - 1 in _versions(spark, path) else {}]
    for old in [x for x in _versions(spark, path) if x < version - 1]:
        for part, (folder, _) in _state(spark, path, old)["parts"].items():
            if not any(folder == f for parts in used for f, _ in parts.values()):
                _remove(spark, f"{path}/{folder}")
            elif not any(parts.get(part, [None])[0] == folder for parts in used):
                _remove(spark, f"{path}/{folder}/part={part}")
        _remove(spark, f"{path}/_versions/{old}")
    return True


def _committed(spark: SparkSession, path: str, change: Callable[[dict, str], tuple[dict, int] | None]) -> tuple[int, int]:
    """Apply a change to the current version until it is the next one: version, rows. ``change`` gets the state and a folder
    of its own for data, and gives the new state and a number of rows, or None for no change. If another writer commits
    first, it is asked again with what that one left, so both changes hold, one after the other."""
    for _ in range(ATTEMPTS):
        version = current_version(spark, path)
        folder = f"data-{uuid.uuid4().hex}"
        try:
            made = change(_state(spark, path, version), folder)
        except Exception:
            _remove(spark, f"{path}/{folder}")
            if current_version(spark, path) == version:
                raise
            continue  # what it read was superseded and removed meanwhile
        if made is None:
            return version, 0
        if _commit(spark, path, version + 1, made[0]):
            return version + 1, made[1]
        _remove(spark, f"{path}/{folder}")
    raise RuntimeError(f"{path}: {ATTEMPTS} times another writer was first")


def write_version(df: DataFrame, path: str) -> int:
    """Write a whole new version beside the old one, then commit it: readers never see half a table, and a frame that reads
    the old version can be written."""

    def change(state: dict, folder: str) -> tuple[dict, int]:
        df.write.parquet(f"{path}/{folder}/part=all")
        return state | {"parts": {"all": [folder, None]}}, 0

    return _committed(df.sparkSession, path, change)[0]


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str], part: Column | None = None) -> int:
    """Keyed upsert into a versioned table; returns the number of rows put in. ``part``, a function of the key such as a
    date, deals the table into parts, and only the parts that the batch touches are written anew. By default parts are
    hashes of the key, and there are more of them as the table grows, so that a part keeps its size.

    A null is a key like any other: a batch that is repeated changes nothing. Writers may run side by side; each writes
    into a folder of its own, and one that finds another's commit merges its batch again on top of it."""
    from lakeloom.operators.market import last_of_batch

    columns = [c for c in batch.columns if not c.startswith("_")]
    stage = f"{path}/_batches/{uuid.uuid4().hex}"  # the batch is read several times and may be costly
    last_of_batch(batch, keys, order).select(*columns).write.parquet(stage)
    schema = batch.select(*columns).schema
    rows = spark.read.schema(schema).parquet(stage)
    dealt = T.StructType([*schema, T.StructField("part", T.StringType())])

    def change(state: dict, folder: str) -> tuple[dict, int] | None:
        def place(buckets: int) -> Column:
            return F.coalesce((F.pmod(F.hash(*keys), F.lit(buckets)) if part is None else part).cast("string"), F.lit("none"))

        buckets, parts = state["buckets"], state["parts"]
        counts = {r["part"]: r["count"] for r in rows.groupBy(place(buckets).alias("part")).count().collect()}
        added = sum(counts.values())
        if not counts:
            return None
        touched = {k: v for k, v in parts.items() if k in counts}
        if part is None and (total := added + sum(n for _, n in parts.values())) > buckets * PART_ROWS:
            while total > buckets * PART_ROWS // 2:
                buckets *= 2
            touched, parts = parts, {}
        target, new = _read_parts(spark, path, touched, schema), rows.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        merged = target.join(new, reduce(Column.__and__, same), "left_anti").unionByName(rows).withColumn("part", place(buckets))
        merged.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{folder}")
        made = spark.read.schema(dealt).parquet(f"{path}/{folder}").groupBy("part").count().collect()
        return {"buckets": buckets, "parts": parts | {r["part"]: [folder, r["count"]] for r in made}}, added

    try:
        return _committed(spark, path, change)[1]
    finally:
        _remove(spark, stage)


def drop_parts(spark: SparkSession, path: str, gone: Callable[[str], bool]) -> int:
    """Drop the parts of a versioned table whose names ``gone`` picks; nothing is written anew. Returns how many rows went."""

    def change(state: dict, folder: str) -> tuple[dict, int] | None:
        old = {k: v for k, v in state["parts"].items() if gone(k)}
        rows = sum(spark.read.parquet(f"{path}/{folder}/part={k}").count() if n is None else n for k, (folder, n) in old.items())
        return (state | {"parts": {k: v for k, v in state["parts"].items() if k not in old}}, rows) if old else None

    return _committed(spark, path, change)[1]


def write_by_year(daily: DataFrame, path: str) -> None:
    """Daily rows by calendar year; only the years that the frame holds are replaced."""
    rows = daily.withColumn("trading_year", F.year("trading_date")).repartition("trading_year").sortWithinPartitions("ticker", "trading_date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trading_year").parquet(path)


def in_years(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """A date range with the bounds on the partition column that let Spark skip years."""
    return rows.filter(F.col("trading_year").between(F.year(start), F.year(end)) & F.col("trading_date").between(start, end))


def partition_inventory(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Row count of every year from first to last and of the years there are; those without rows outside are droppable."""
    years = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("trading_year"))
    counts = rows.groupBy("trading_year").agg(F.count("trading_date").alias("row_count"))
    out = years.join(counts, "trading_year", "full_outer").na.fill(0, ["row_count"])
    return out.withColumn("droppable", (F.col("row_count") == 0) & ~F.col("trading_year").between(first, last))


# -- provider payloads ------------------------------------------------------------------------------------------------

_ROW = T.StructType([T.StructField(n, T.StringType()) for n in PAYLOAD_FIELDS])
PAYLOAD = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("data", T.ArrayType(_ROW)), T.StructField("dataList", T.ArrayType(_ROW))])


def read_daily_payload(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Price payload files (one payload each, or one a line): rows under data or else dataList; none is no rows."""
    raw = spark.read.schema(PAYLOAD).option("multiLine", not lines).json(path)
    rows = F.when(F.size("data") > 0, F.col("data")).otherwise(F.col("dataList"))
    return raw.select("symbol", F.explode(rows).alias("row")).select("symbol", "row.*")


def read_symbol_profile(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The first repeated record of each profile file; the market is the security type, else the market id, else stock."""
    kind = "data array<struct<RepeatedInfo: array<struct<Symbol: string, SymbolName: string, SymbolEngName: string, Exchange: string, SecType: string, MarketId: string, ListedShare: string>>>>"
    raw = spark.read.schema(kind).option("multiLine", not lines).json(path)
    i = F.get(F.get("data", F.lit(0))["RepeatedInfo"], F.lit(0))
    text = lambda n: F.nullif(F.trim(i[n]), F.lit(""))
    return raw.select(
        F.upper(text("Symbol")).alias("ticker"), text("SymbolName").alias("name_vi"), text("SymbolEngName").alias("name_en"), text("Exchange").alias("exchange"),
        F.coalesce(text("SecType"), text("MarketId"), F.lit("stock")).alias("market"), i["ListedShare"].try_cast("double").try_cast("long").alias("current_listed_shares"),
    )


_PAGE = "array<struct<page: string, page_number: string, number: string, markdown: string, text: string, content: string>>"
_TABLE = "array<struct<page: int, section_title: string, header: array<string>, columns: array<string>, rows: array<array<string>>>>"
PARSED = f"doc_id string, metadata map<string, string>, pages {_PAGE}, result struct<pages: {_PAGE}>, markdown string, text string, tables {_TABLE}"


def read_parsed_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Parsed reports: pages under their names, else the inline text as page 1; unknown_doc without an id."""
    raw = spark.read.schema(PARSED).option("multiLine", not lines).json(path)
    inline = F.coalesce(F.nullif("markdown", F.lit("")), F.nullif("text", F.lit("")))
    none = F.lit(None).cast("string")
    one = F.array(F.struct(F.lit("1").alias("page"), none.alias("page_number"), none.alias("number"), inline.alias("markdown"), none.alias("text"), none.alias("content")))
    pages = F.coalesce(F.when(F.size("pages") > 0, F.col("pages")), F.when(F.size("result.pages") > 0, F.col("result.pages")), F.when(inline.isNotNull(), one))
    return raw.select(F.coalesce(F.nullif("doc_id", F.lit("")), F.lit("unknown_doc")).alias("doc_id"), "metadata", pages.alias("pages"), "tables")


def join_markdown_json(jobs: DataFrame, markdown: DataFrame, parsed: DataFrame) -> DataFrame:
    """Markdown and parsed JSON of a job together; the job's fields override the payload's metadata."""
    own = F.map_filter(F.from_json(F.to_json(F.struct(*[c for c in jobs.columns if c != "doc_id"])), "map<string,string>"), lambda _, v: v.isNotNull())
    rows = jobs.select("doc_id", own.alias("_job")).join(markdown, "doc_id").join(parsed, "doc_id", "left")
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("_job"), k)), F.col("_job"))
    return rows.withColumn("metadata", merged).drop("_job")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk sets by fiscal year and ticker; a chunk without text is an error. A large set is written by several tasks."""
    if chunks.filter(F.coalesce(F.trim("content_for_embedding"), F.lit("")) == "").limit(1).count():
        raise ValueError("a chunk has no text")
    chunks.hint("rebalance", "fiscal_year", "ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fiscal_year", "ticker").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("is_valid", F.coalesce(F.trim("content_for_embedding"), F.lit("")) != "")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def write_article_contents(spark: SparkSession, contents: DataFrame, path: str) -> None:
    """Contents keyed by url_hash, under the key articles/{url_hash}/content.json, the latest of a hash winning."""
    rows = contents.withColumn("content_key", F.concat(F.lit("articles/"), "url_hash", F.lit("/content.json")))
    upsert_table(spark, path, rows, ["url_hash"], ["fetched_at"])


def read_article_contents(keys: DataFrame, spark: SparkSession, path: str, schema: str) -> DataFrame:
    return keys.join(read_table(spark, path, schema), "content_key")


def raw_file_inventory(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Digest and length of each expected raw file (column ``name``). Spark's reader passes over empty files, so a file
    that is empty or absent has no digest; both are errors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")
    return expected.select("name").distinct().join(found, "name", "left").withColumn("is_error", F.col("sha256").isNull())


def parsed_document_sink(sections: DataFrame, tables: DataFrame, path: str) -> None:
    """One record for each document with its ordered sections and tables, under a slugged id."""
    s = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("sections"))
    t = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "header", "rows"))).alias("tables"))
    s.join(t, "doc_id", "full_outer").withColumn("record_id", slug(F.col("doc_id").cast("string"))).write.mode("overwrite").parquet(path)


def write_vectors(spark: SparkSession, points: DataFrame, path: str) -> DataFrame:
    """Upsert of embedded chunks (chunk_id, vector, payload) by their stable point id, repeatable at will; points without an
    id or a vector fail and stay out. Returns one row: attempted, upserted and failed points."""
    from lakeloom.operators.documents import point_id

    ok = F.coalesce((F.col("chunk_id") != "") & (F.size("vector") > 0), F.lit(False))
    good = points.filter(ok).withColumn("point_id", point_id(F.col("chunk_id")))
    counts = points.agg(F.count("*").alias("attempted"), F.count_if(~ok).alias("failed")).first()
    upserted = upsert_table(spark, path, good, ["point_id"], ["chunk_id"])
    return spark.createDataFrame([(counts["attempted"], upserted, counts["failed"])], "attempted long, upserted long, failed long")

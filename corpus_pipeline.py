"""The corpus pipeline: quality classifier, SimHash near-dedup, mixing by curriculum, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; it is written
as Parquet and read again before the next one.

Defined results of every stage: null and empty texts are documents like any other (near copies of each other, never mixed
in); an empty table gives an empty result; columns of docs besides those of documents are left out, whatever their names;
ties go to the smaller doc_id, then by hashes of the row, so reruns agree. Repeated rows share their fate in the first
stage; the second keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, mixing, near_copies, quality
from lakeloom.llm.common import dropped, table, written

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: Entries of the encoder's caches; workers of the pipeline also hold what the other stages loaded.
CACHE = 150_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts. Rows of one doc_id go together:
    they stay if any of them is accepted."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    good = scored.groupBy("doc_id").agg(F.max("predicted").alias("predicted")).filter("predicted = 1").select(F.col("doc_id").alias("good"))
    return docs.select(*DOCUMENTS).join(good, F.col("doc_id").eqNullSafe(F.col("good")), "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by a five-word similarity of 0.8 or more, one row: that of the smallest
    doc_id, by hash among rows of it and among rows without an id. Rows of null or repeated id are told apart by content."""
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    values = [x for c in DOCUMENTS for x in (F.col(c).isNull(), F.col(c))]  # a null alone leaves the hash as it is
    row = F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))  # 128 bits: no two rows in 10^10 share it
    roots = near_copies.near_copies(docs)
    rows = docs.select("doc_id", node.alias("node"), row.alias("row")).join(roots, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = rows.groupBy(F.coalesce("root", "node").alias("component")).agg(first).select(F.col("first.row").alias("_row"))
    return docs.select(*DOCUMENTS, row.alias("_row")).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each round in which the mix takes them: the columns of documents, then the
    training position and the round. Null texts and texts without words are never taken."""
    return mixing.curriculum(docs.select(*DOCUMENTS))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the texts decoded from them, with position and round as the mix gave
    them; a null text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), tuple(c for c in ("position", "round") if c in docs.columns), CACHE)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: The classifier, the components and the tokenizer cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(*before)
        before = (docs,)
    return docs

"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Space and the controls 9-13: what the contracts call white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns to ``keep`` only (so clashing extra columns never matter); a null text counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def told_ids(docs: DataFrame) -> DataFrame:
    """doc_id (0 where null), no_id, text: whole numbers stay exact on their way to Python also where some ids are null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Documents that are turned into Python's texts at a time.
ROWS = 1024


def map_texts(docs: DataFrame, run: Callable[[Iterator[tuple[list, list, list]]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Frames that ``run`` makes of slices of doc_ids, no_ids and texts; of an Arrow batch, one slice at a time is turned
    into Python's objects, so that a worker's memory does not follow the size of batches."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (tuple(x.to_pylist() for x in batch.slice(lo, ROWS).columns) for batch in batches for lo in range(0, batch.num_rows, ROWS))
        for frame in run(slices):
            yield pa.RecordBatch.from_pandas(frame, schema=kind, preserve_index=False)
        pa.default_memory_pool().release_unused()  # an idle worker waits beside the next stage

    return told_ids(docs).mapInArrow(each, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as set. One of our own is made only where that is unset and
    all of Spark runs in one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lakeloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written table below the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder, with options of the writer, and read it again."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove written tables from the shared folder once everything made of them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus

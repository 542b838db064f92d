"""Structured Streaming jobs. Each is a plain function that starts a query with its own checkpoint; ``available_now`` runs
it over what there is and ends, so that every job can be compared with its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import documents, market
from lakeloom.operators.market import status_rank
from lakeloom.schemas import STATUS_RANK
from lakeloom.sources.tables import append_events, drop_parts, upsert_table


def available_now(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is available, batch by batch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def stream_intraday(snapshots: DataFrame, path: str, checkpoint: str) -> None:
    """Session snapshots upserted by ticker and minute: late rows replace by key, rows without a key or price go to a
    quarantine beside the table and stop nothing. The table lies by day, and a batch writes the days that it touches.
    Upserts by key make a repeated batch harmless."""
    spark = snapshots.sparkSession

    def each(batch: DataFrame, _: int) -> None:
        ok = F.col("ticker").isNotNull() & F.col("timestamp").isNotNull() & F.col("close").isNotNull()
        append_events(batch.filter(~F.coalesce(ok, F.lit(False))), f"{path}-quarantine")
        upsert_table(spark, path, batch.filter(ok), ["ticker", "timestamp"], ["arrival"], F.to_date("timestamp"))

    available_now(snapshots.filter(market.in_session(F.col("timestamp"))), each, checkpoint)


def latest_prices(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each ticker; the same columns on a stream (update mode) or a batch."""
    return snapshots.groupBy("ticker").agg(F.max(F.struct("timestamp", "close")).alias("last")).select("ticker", "last.timestamp", "last.close")


def purge_intraday(spark: SparkSession, path: str, before: str) -> int:
    """Drop the days before a date from the intraday table; returns how many rows went."""
    return drop_parts(spark, path, lambda day: day < before)


def stream_stage(jobs: DataFrame, stage: str, work: Callable[[DataFrame], DataFrame], next_path: str | None, event_path: str, checkpoint: str) -> None:
    """One stage of the report pipeline: messages are validated, ``work`` adds artifact columns and a nullable error, good
    jobs go to the next stage's directory and every outcome to the event log. A failed job is logged and never retried; a
    batch cut short by a crash is run again from the checkpoint, into directories of its own number."""

    spark = jobs.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.repartition(spark.sparkContext.defaultParallelism)  # few files hold many messages
        good, bad = documents.validate_jobs(batch, stage)
        done = work(good)
        following, events = documents.stage_outputs(done, stage)
        dead = bad.select(F.get_json_object("value", "$.doc_id").alias("doc_id"), F.lit(f"{stage.upper()}_FAILED").alias("event_type"), F.lit("FAILED").alias("new_status"), F.array_join("errors", "; ").alias("error_detail"))
        events.unionByName(dead).write.mode("overwrite").parquet(f"{event_path}/{stage}/batch={number}")
        if next_path:
            following.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").parquet(f"{next_path}/batch={number}")

    available_now(jobs, each, checkpoint)


def rates(calls: DataFrame, keys: list[str], span: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Calls a second over sliding windows, by keys."""
    w = calls.groupBy(F.window("ts", span, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), *keys, (F.col("n") / F.lit(float(seconds))).alias("rate"))


#: Upper bounds of the duration buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def latency_histogram(calls: DataFrame, keys: list[str], span: str = "1 day", buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Count, sum (in whole thousandths) and cumulative buckets of durations over tumbling windows."""
    counts = [F.count_if(F.col("latency") <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    w = calls.groupBy(F.window("ts", span).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("latency") * 1000).cast("long")).alias("sum_ms"), *counts)
    return w.select(F.col("w.start").alias("window_start"), *keys, "n", "sum_ms", *(f"le_{i}" for i in range(len(buckets))))


def ingest_counters(events: DataFrame) -> DataFrame:
    """Documents by status, and chunks in total; numbers that are not positive are ignored."""
    return events.groupBy("status").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("total"))


def stage_backlog(published: DataFrame, completed: DataFrame) -> DataFrame:
    """Jobs of each stage that are published and not completed."""
    stages = published.groupBy("stage").agg(F.count("*").alias("published"))
    open_ = published.join(completed, ["stage", "doc_id"], "left_anti").groupBy("stage").agg(F.count("*").alias("backlog"))
    return stages.join(open_, "stage", "left").na.fill(0, ["backlog"])


def quota_window(calls: DataFrame, key: str, limit: int = 15) -> DataFrame:
    """Calls of the same key in the sixty seconds before each call (strictly within), and whether it is allowed."""
    from pyspark.sql import Window

    rows = calls.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-59_999_999, -1)
    return rows.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") < limit).drop("_us")


def doc_state(events: DataFrame) -> DataFrame:
    """Current status of each document: the highest rank seen. Unknown statuses are not for this stream (see the split)."""
    return events.filter(F.col("new_status").isin(*STATUS_RANK)).groupBy("doc_id").agg(F.max(F.struct(status_rank(F.col("new_status")).alias("rank"), F.col("new_status").alias("status"))).alias("s")).select("doc_id", "s.status")


def url_dedupe(urls: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Canonical URLs that were not seen within the time to live; state is dropped with the watermark."""
    return urls.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["url_hash"])


def to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], part: str | None = None) -> None:
    """A stream's result as a versioned table: each batch in update mode puts its changed rows in place by key."""
    spark = stream.sparkSession
    available_now(stream, lambda batch, _: upsert_table(spark, path, batch, keys, keys, F.col(part) if part else None) and None, checkpoint, "update")

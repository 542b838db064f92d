"""Streams that keep state of their own by key: document statuses, call quotas, backlog, indicators, percentiles.

State lives in RocksDB beside the checkpoint. Each job ends in keyed upserts or in folders named by batch, so a batch that is
run again changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.operators import market
from lakeloom.schemas import STATUS_RANK
from lakeloom.sources.tables import read_table, upsert_table
from lakeloom.streaming.jobs import available_now, purge_intraday

#: The store that processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


# -- document statuses ------------------------------------------------------------------------------------------------


class DocumentStatus(StatefulProcessor):
    """The status of one document: it moves to an equal or higher rank only. A status without a rank is rejected: it goes
    out as it came, and the document stays as it was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "rank int, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        best, bad = old, []
        for some in rows:
            for status in some["new_status"]:
                rank = STATUS_RANK.get(status)
                if rank is None:
                    bad.append(status)
                elif best is None or rank > best[0]:
                    best = (rank, status)
        out = [(key[0], x, True) for x in bad]
        if best is not None and best != old:
            self.state.update(best)
            out.append((key[0], best[1], False))
        yield pd.DataFrame(out, columns=["doc_id", "status", "rejected"])


def stream_doc_status(events: DataFrame, path: str, checkpoint: str) -> None:
    """Events (doc_id, new_status) to a table of current statuses; events of unknown statuses and of no document go to
    ``{path}-rejected``."""
    spark = events.sparkSession
    use_store(spark)
    rows = events.select("doc_id", "new_status")
    states = rows.groupBy("doc_id").transformWithStateInPandas(DocumentStatus(), "doc_id string, status string, rejected boolean", "Update", "None")

    def each(batch: DataFrame, number: int) -> None:
        bad = F.col("rejected") | F.col("doc_id").isNull()
        batch = batch.persist()
        batch.filter(bad).select("doc_id", F.col("status").alias("new_status")).write.mode("overwrite").parquet(f"{path}-rejected/batch={number}")
        upsert_table(spark, path, batch.filter(~bad).select("doc_id", "status"), ["doc_id"], ["status"])
        batch.unpersist()

    available_now(states, each, checkpoint, "update")


# -- quotas -----------------------------------------------------------------------------------------------------------


class CallQuota(StatefulProcessor):
    """The calls of one key in the last minute. Calls of one batch are taken in order of time; a timer forgets a key that has
    been quiet for a minute."""

    SPAN = 60_000_000

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recent = handle, handle.getListState("recent", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(rows).sort_values(["us", "event_id"])
        at = calls["us"].to_numpy()
        before = np.array([x[0] for x in self.recent.get()], np.int64)
        every = np.sort(np.concatenate([before, at]))
        n = np.searchsorted(every, at, "left") - np.searchsorted(every, at - self.SPAN, "right")
        last = int(every[-1])
        self.recent.put([(int(x),) for x in every[every > last - self.SPAN]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.SPAN) // 1000 + 1)
        yield pd.DataFrame({"event_id": calls["event_id"], "recent": n, "allowed": n < self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame({"event_id": [], "recent": [], "allowed": []})


def stream_quota(calls: DataFrame, key: str, path: str, checkpoint: str, limit: int = 15) -> None:
    """Calls (event_id, ts and a key) as they come in order, each with the number of its key's calls in the sixty seconds
    before it and whether it is allowed; see ``jobs.quota_window`` for the batch."""
    use_store(calls.sparkSession)
    rows = calls.withWatermark("ts", "1 second").select(F.col(key).alias("key"), "event_id", "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("key").transformWithStateInPandas(CallQuota(limit), "event_id long, recent long, allowed boolean", "Append", "EventTime")
    available_now(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)


# -- backlog ----------------------------------------------------------------------------------------------------------


def job_outcomes(published: DataFrame, completed: DataFrame, horizon: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each published job (stage, doc_id, ts) with whether it was completed (stage, doc_id, done_ts) within the horizon.
    Completed ones appear at once, others when both watermarks have passed their horizon; then their state is dropped."""
    p = published.withWatermark("ts", late)
    c = completed.withWatermark("done_ts", late).select(F.col("stage").alias("c_stage"), F.col("doc_id").alias("c_doc_id"), "done_ts")
    same = (F.col("stage") == F.col("c_stage")) & (F.col("doc_id") == F.col("c_doc_id"))
    soon = (F.col("done_ts") >= F.col("ts")) & (F.col("done_ts") <= F.col("ts") + F.expr(f"INTERVAL {horizon}"))
    return p.join(c, same & soon, "left_outer").select("stage", "doc_id", F.col("done_ts").isNotNull().alias("done"))


def stream_backlog(published: DataFrame, completed: DataFrame, path: str, checkpoint: str, horizon: str = "1 hour") -> None:
    """Outcomes as a table by stage and job; a job that was completed twice counts once."""
    spark = published.sparkSession
    available_now(job_outcomes(published, completed, horizon), lambda batch, _: upsert_table(spark, path, batch, ["stage", "doc_id"], ["done"]) and None, checkpoint)


def backlog(outcomes: DataFrame) -> DataFrame:
    """Jobs of each stage whose horizon has passed or that are completed, and those that are not completed."""
    return outcomes.groupBy("stage").agg(F.count("*").alias("published"), F.count_if(~F.col("done")).alias("backlog"))


# -- indicators -------------------------------------------------------------------------------------------------------

#: Spans of the exponential means: price fast and slow, signal of their difference.
SPANS = (12, 26, 9)
STATE = "ticker string, trading_date date, y0 double, w0 double, y1 double, w1 double, y2 double, w2 double"


def ema_maps(x: np.ndarray, span: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponential mean as affine maps: y after a row is factor * y before it + offset. A missing value is the identity
    and lets the weight of what was before decay. The third array is that weight after each row."""
    a = 2 / (span + 1)
    known = ~np.isnan(x)
    at = np.arange(len(x))
    last = np.maximum.accumulate(np.where(known, at, -1))
    before = np.concatenate([[-1], last[:-1]])
    gap = np.where(before >= 0, at - before, at + 1)  # rows since the last value; before the first, since the state
    old = np.where(before >= 0, 1.0, weight) * (1 - a) ** gap
    after = np.where(last >= 0, 1.0, weight) * (1 - a) ** np.where(last >= 0, at - last, at + 1)
    return np.where(known, old / (old + a), 1.0), np.where(known, a * np.where(known, x, 0.0) / (old + a), 0.0), after


def compose(factor: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix composition of affine maps, doubling the stretch each round."""
    factor, offset, step = factor.copy(), offset.copy(), 1
    while step < len(factor):
        offset[step:] = factor[step:] * offset[:-step] + offset[step:]
        factor[step:] = factor[step:] * factor[:-step]
        step *= 2
    return factor, offset


def ema_from(x: np.ndarray, span: int, y: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponential means of new rows from the state before them (y and its weight; a y that is not a number: none yet), and
    the weight after each row."""
    if np.isnan(y):
        known = np.flatnonzero(~np.isnan(x))
        if not len(known):
            return np.full(len(x), np.nan), np.ones(len(x))
        i = int(known[0])  # the first value is the mean
        rest, weights = ema_from(x[i + 1 :], span, float(x[i]), 1.0)
        return np.concatenate([np.full(i, np.nan), x[i : i + 1], rest]), np.concatenate([np.ones(i + 1), weights])
    factor, offset, weights = ema_maps(x, span, weight)
    factor, offset = compose(factor, offset)
    return factor * y + offset, weights


#: Calls over which the tickers of ``macd_from`` are dealt by hash, at most.
CALLS = 4096


def macd_from(rows: DataFrame, state: DataFrame) -> DataFrame:
    """macd and macd_signal of new rows (ticker, trading_date, price) that all come after their ticker's state; each row has
    the state after it, so the last one of a ticker is its next state. A call takes many tickers, one after the other."""
    names = [f"{k}{i}" for i in range(3) for k in "yw"]

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values(["ticker", "trading_date"])
        known = dict(zip(old["ticker"], old[names].to_numpy(float), strict=True))
        tickers, prices = new["ticker"].to_numpy(), new["price"].to_numpy(float)
        ends = np.append(np.flatnonzero(tickers[1:] != tickers[:-1]) + 1, len(new)) if len(new) else np.zeros(0, int)
        out, lo = np.zeros((len(new), 8)), 0
        for hi in ends.tolist():
            y0, w0, y1, w1, y2, w2 = known.get(tickers[lo], (np.nan, 1.0) * 3)
            fast, slow = ema_from(prices[lo:hi], SPANS[0], y0, w0), ema_from(prices[lo:hi], SPANS[1], y1, w1)
            macd = fast[0] - slow[0]
            signal = ema_from(macd, SPANS[2], y2, w2)
            out[lo:hi] = np.stack([macd, signal[0], *fast, *slow, *signal], 1)
            lo = hi
        return pd.DataFrame({"ticker": new["ticker"], "trading_date": new["trading_date"]}).assign(**dict(zip(["macd", "macd_signal", *names], out.T, strict=True)))

    kind = f"ticker string, trading_date date, macd double, macd_signal double, {STATE.split(', ', 2)[2]}"
    part = F.pmod(F.xxhash64("ticker"), F.lit(CALLS))
    return rows.select("ticker", "trading_date", "price").groupBy(part).cogroup(state.groupBy(part)).applyInPandas(run, kind)


def stream_eod(daily: DataFrame, symbols: DataFrame, raw_path: str, feature_path: str, checkpoint: str, intraday_path: str | None = None) -> None:
    """Closed days with stored indicator state: daily rows are upserted by year; moving averages and RSI of the touched
    tickers read the years that their longest window reaches; exponential means go on from the state kept for each ticker
    and read no history. A ticker with a row that is not after its state, as in a correction or a batch that is run
    again, is worked out anew from its raw rows. Intraday rows of days before the last one are dropped."""
    spark = daily.sparkSession
    year = F.year("trading_date")
    state_path = f"{feature_path}-state"

    def each(batch: DataFrame, _: int) -> None:
        batch = market.last_of_batch(batch.filter("ticker IS NOT NULL AND trading_date IS NOT NULL"), ["ticker", "trading_date"], ["trading_date"]).persist()
        upsert_table(spark, raw_path, batch, ["ticker", "trading_date"], ["trading_date"], year)
        first, last = batch.agg(F.min("trading_date"), F.max("trading_date")).first()
        if first is None:
            return
        state = read_table(spark, state_path, STATE)
        touched = batch.groupBy("ticker").agg(F.min("trading_date").alias("first"))
        known = touched.join(state.select("ticker", F.col("trading_date").alias("through")), "ticker", "left")
        onward = known.filter(F.col("through") < F.col("first")).select("ticker")
        again = known.filter(~F.coalesce(F.col("through") < F.col("first"), F.lit(False))).select("ticker")
        price: Column = market.effective_close().alias("price")
        history = read_table(spark, raw_path, batch.schema).join(touched.select("ticker"), "ticker", "left_semi")
        fresh = batch.join(onward, "ticker", "left_semi").select("ticker", "trading_date", price)
        anew = history.join(again, "ticker", "left_semi").select("ticker", "trading_date", price)
        means = macd_from(fresh.unionByName(anew), state.join(onward, "ticker", "left_semi")).persist()
        features = market.daily_features(history, symbols, means.select("ticker", "trading_date", "macd", "macd_signal")).filter(F.col("trading_date") >= F.lit(first))
        upsert_table(spark, feature_path, features, ["ticker", "trading_date"], ["trading_date"], year)
        columns = [c.split()[0] for c in STATE.split(", ")]
        upsert_table(spark, state_path, means.select(*columns), ["ticker"], ["trading_date"])
        means.unpersist()
        batch.unpersist()
        if intraday_path:
            purge_intraday(spark, intraday_path, last.isoformat())

    available_now(daily, each, checkpoint)


# -- percentiles ------------------------------------------------------------------------------------------------------


def latency_sketches(calls: DataFrame, keys: list[str], span: str = "1 day", size: int = 200) -> DataFrame:
    """A quantile sketch of durations for each window and keys; sketches merge, so any stretch of windows has percentiles
    without its calls. ``size`` sets the error of a rank: about 1.65 % at 200."""
    w = calls.groupBy(F.window("ts", span).alias("w"), *keys).agg(F.kll_sketch_agg_double(F.col("latency").cast("double"), size).alias("sketch"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "sketch")


def percentiles(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles over all the given windows, by keys."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select(*keys, F.kll_sketch_get_n_double("s").alias("n"), *(F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(f"p{round(p * 100)}") for p in shares))

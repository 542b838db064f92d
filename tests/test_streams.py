"""Stateful streams against their batch twins."""

import collections
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import market
from lakeloom.plans import stream_queries as q
from lakeloom.sources import tables as s
from lakeloom.streaming import jobs
from lakeloom.streaming import stateful as st

DAY = datetime.date(2024, 1, 1)


@pytest.mark.parametrize("span", [9, 12, 26])
def test_composed_maps_equal_the_recursion(span):
    rng = np.random.default_rng(span)
    for n in (1, 2, 3, 40, 257):
        x = rng.normal(50, 5, n)
        x[rng.random(n) < 0.3] = np.nan
        want = market._ema(x, span)
        assert np.allclose(st.ema_from(x, span, np.nan, 1.0)[0], want, rtol=1e-12, atol=0, equal_nan=True)
        for cut in {0, 1, n // 2, n - 1}:  # stopped and gone on with
            y, w = st.ema_from(x[:cut], span, np.nan, 1.0)
            rest, _ = st.ema_from(x[cut:], span, y[-1] if cut else np.nan, w[-1] if cut else 1.0)
            assert np.allclose(np.concatenate([y, rest]), want, rtol=1e-12, atol=0, equal_nan=True)


def days(spark, some):
    rows = [(t, DAY + datetime.timedelta(i), None if p is None else float(p), None) for t, i, p in some]
    return spark.createDataFrame(rows, "ticker string, trading_date date, close_price double, adj_close_price double")


def test_eod_goes_on_from_its_state(spark, tmp_path, monkeypatch):
    """Three batches: more days, then a correction of an old day beside new ones, then nothing but a repeat. Features equal
    the batch's each time, and exponential means see the rows of the batch alone wherever they come after the state."""
    rng = np.random.default_rng(2)
    prices = {(t, i): None if rng.random() < 0.1 else round(float(rng.normal(50, 5)), 2) for t in "AB" for i in range(60)}
    batches = [[(t, i, p) for (t, i), p in prices.items() if i < 40], [(t, i, p) for (t, i), p in prices.items() if i >= 40] + [("B", 10, 77.0), ("C", 0, 1.0)], [("A", 59, prices["A", 59])]]
    seen, macd_from = [], st.macd_from

    def spy(rows, state):
        seen.append({r["ticker"]: r["count"] for r in rows.groupBy("ticker").count().collect()})
        return macd_from(rows, state)

    monkeypatch.setattr(st, "macd_from", spy)
    symbols = spark.createDataFrame([("A", 10), ("B", 20)], "ticker string, current_listed_shares long")
    source, path, held = tmp_path / "in", str(tmp_path / "t"), {}
    for batch in batches:
        days(spark, batch).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(days(spark, []).schema).parquet(str(source))
        st.stream_eod(stream, symbols, f"{path}-raw", f"{path}-features", f"{path}-checkpoint")
        held |= {(t, i): p for t, i, p in batch}
        want = market.daily_features(days(spark, [(t, i, p) for (t, i), p in held.items()]), symbols)
        got = s.read_table(spark, f"{path}-features", want.schema)
        key = lambda r: (r["ticker"], r["trading_date"])
        a, b = (sorted(x.collect(), key=key) for x in (got, want))
        assert [key(r) for r in a] == [key(r) for r in b]
        for c in ("macd", "macd_signal", "ma20", "rsi_14", "market_cap"):
            assert np.allclose([np.nan if r[c] is None else r[c] for r in a], [np.nan if r[c] is None else r[c] for r in b], rtol=1e-9, equal_nan=True), c
    assert seen == [{"A": 40, "B": 40}, {"A": 20, "B": 60, "C": 1}, {"A": 60}]


def test_status_state_survives_between_runs(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    kind = "doc_id string, new_status string"

    def run(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        st.stream_doc_status(spark.readStream.schema(kind).parquet(source), path, f"{path}-checkpoint")
        return {r["doc_id"]: r["status"] for r in s.read_table(spark, path, "doc_id string, status string").collect()}

    assert run(("a", "PARSED"), ("a", "DISCOVERED"), ("b", "LOST"), (None, "PARSED")) == {"a": "PARSED"}
    assert run(("a", "DOWNLOADED"), ("b", "DOWNLOADED"), ("b", None), ("c", "FAILED")) == {"a": "PARSED", "b": "DOWNLOADED", "c": "FAILED"}
    assert run(("a", "EMBEDDED"), ("c", "EMBEDDED")) == {"a": "EMBEDDED", "b": "DOWNLOADED", "c": "FAILED"}
    bad = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{path}-rejected").collect()
    assert collections.Counter((r["doc_id"], r["new_status"]) for r in bad) == {("b", "LOST"): 1, (None, "PARSED"): 1, ("b", None): 1}


def test_quota_equals_the_window(spark, tmp_path):
    """Replayed in order over three batches, with ties, minutes that meet exactly and quiet stretches that timers end."""
    rng = np.random.default_rng(1)
    start = datetime.datetime(2024, 1, 1)
    at = np.sort(rng.integers(0, 900, 300))
    at[-60:] += 5000
    rows = [(i, f"k{i % 3}", start + datetime.timedelta(seconds=int(x), microseconds=int(rng.integers(0, 2)))) for i, x in enumerate(at)]
    calls = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    want = {r["event_id"]: (r["recent"], r["allowed"]) for r in jobs.quota_window(calls, "key", 4).select("event_id", "recent", "allowed").collect()}
    path = str(tmp_path / "quota")
    st.stream_quota(q.in_turn(spark, calls), "key", path, f"{path}-checkpoint", 4)
    got = {r["event_id"]: (r["recent"], r["allowed"]) for r in spark.read.schema("event_id long, recent long, allowed boolean").option("recursiveFileLookup", True).parquet(path).collect()}
    assert got == want and {a for _, a in want.values()} == {True, False}


def test_backlog_tells_late_from_done(spark, tmp_path):
    """Done within the hour, done too late, never done, done twice."""
    start = datetime.datetime(2024, 1, 1)
    t = lambda minutes: start + datetime.timedelta(minutes=minutes)
    jobs_ = spark.createDataFrame([("parse", 1, t(0)), ("parse", 2, t(1)), ("chunk", 3, t(2)), ("chunk", 4, t(3)), ("end", 0, t(9000))], "stage string, doc_id long, ts timestamp")
    done = spark.createDataFrame([("parse", 1, t(20)), ("parse", 2, t(90)), ("chunk", 4, t(5)), ("chunk", 4, t(6)), ("end", 0, t(9000))], "stage string, doc_id long, done_ts timestamp")
    path = str(tmp_path / "t")
    st.stream_backlog(q.in_turn(spark, jobs_), q.in_turn(spark, done, "done_ts"), path, f"{path}-checkpoint")
    out = s.read_table(spark, path, "stage string, doc_id long, done boolean")
    assert {(r["stage"], r["doc_id"]): r["done"] for r in out.filter("stage <> 'end'").collect()} == {("parse", 1): True, ("parse", 2): False, ("chunk", 3): False, ("chunk", 4): True}
    assert {r["stage"]: (r["published"], r["backlog"]) for r in st.backlog(out.filter("stage <> 'end'")).collect()} == {"parse": (2, 1), "chunk": (2, 1)}


def test_percentiles_of_merged_sketches(spark):
    """Sketches of a hundred windows, merged: the rank of each percentile is off by less than two hundredths."""
    rng = np.random.default_rng(3)
    value = np.concatenate([rng.exponential(1, 30_000), rng.normal(20, 1, 10_000)])
    calls = spark.createDataFrame([(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i % 100), "a", float(x)) for i, x in enumerate(value)], "ts timestamp, agent string, latency double")
    sketches = st.latency_sketches(calls, ["agent"])
    assert sketches.count() == 100
    r = st.percentiles(sketches, ["agent"]).first()
    assert r["n"] == 40_000
    for p in (50, 95, 99):
        assert abs(np.mean(value <= r[f"p{p}"]) - p / 100) < 0.02
    assert st.percentiles(sketches.filter("false"), ["agent"]).count() == 0


def test_means_of_many_tickers_in_one_call(spark, monkeypatch):
    """Tickers that share a call have the exponential means that each has alone, from its own state."""
    monkeypatch.setattr(st, "CALLS", 1)
    rows = [(f"T{i}", datetime.date(2024, 1, 1 + k), float(10 + (i * 7 + k * k) % 5) if (i + k) % 4 else None) for i in range(6) for k in range(8)]
    state = [(f"T{i}", datetime.date(2023, 12, 31), 10.0 + i, 1.0, 11.0, 0.5, 0.25, 1.0) for i in range(0, 6, 2)]
    out = st.macd_from(spark.createDataFrame(rows, "ticker string, trading_date date, price double"), spark.createDataFrame(state, st.STATE))
    assert out.rdd.glom().map(len).filter(bool).count() == 1
    got = out.toPandas().sort_values(["ticker", "trading_date"])
    for i in range(6):
        x = np.array([np.nan if p is None else p for t, _, p in rows if t == f"T{i}"])
        y = (10.0 + i, 1.0, 11.0, 0.5, 0.25, 1.0) if i % 2 == 0 else (np.nan, 1.0) * 3
        macd = st.ema_from(x, 12, *y[:2])[0] - st.ema_from(x, 26, *y[2:4])[0]
        own = got[got["ticker"] == f"T{i}"]
        assert np.array_equal(own["macd"], macd, equal_nan=True) and np.array_equal(own["macd_signal"], st.ema_from(macd, 9, *y[4:])[0], equal_nan=True)

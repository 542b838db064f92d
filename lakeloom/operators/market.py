"""Price tables: cleaning, indicators, views, comparisons, audits and keyed upserts, for all tickers at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.schemas import STATUS_RANK

ZONE = "Asia/Ho_Chi_Minh"
FORMULA = "v2_adj_close"

# -- values -----------------------------------------------------------------------------------------------------------


def present(c: Column) -> Column:
    """Null for the ways in which a payload says that a value is missing."""
    return F.nullif(F.nullif(c, F.lit("")), F.lit("None"))


def clean_double(c: Column) -> Column:
    return present(c.cast("string")).try_cast("double")


def clean_long(c: Column) -> Column:
    """Integers truncate toward zero; infinities are null."""
    return clean_double(c).try_cast("long")


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c.cast("string")) for c in columns))


def mixed_date(c: Column) -> Column:
    """Day/month/year when it holds a slash, else ISO; anything else is null."""
    c = F.trim(c)
    return F.when(F.contains(c, F.lit("/")), F.try_to_date(c, "dd/MM/yyyy")).otherwise(F.try_to_date(c, "yyyy-MM-dd"))


def local_timestamp(date: Column, time: Column) -> Column:
    """The instant of a local date and HH:mm:ss."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss")), ZONE)


#: Our column, its type, and the payload's names for it in order.
DAILY_FIELDS = (
    ("open_price", "double", ("OpenPrice", "Open")), ("high_price", "double", ("HighestPrice", "HighPrice", "High")), ("low_price", "double", ("LowestPrice", "LowPrice", "Low")), ("close_price", "double", ("ClosePrice", "Close")),
    ("avg_price", "double", ("AveragePrice",)), ("adj_close_price", "double", ("ClosePriceAdjusted",)), ("matched_volume", "long", ("TotalMatchVol",)), ("matched_value", "double", ("TotalMatchVal",)),
    ("put_through_volume", "long", ("TotalDealVol",)), ("put_through_value", "double", ("TotalDealVal",)), ("total_volume", "long", ("TotalTradedVol",)), ("total_value", "double", ("TotalTradedValue",)),
    ("foreign_buy_vol", "long", ("ForeignBuyVolTotal",)), ("foreign_sell_vol", "long", ("ForeignSellVolTotal",)), ("foreign_buy_value", "double", ("ForeignBuyValTotal",)), ("foreign_sell_value", "double", ("ForeignSellValTotal",)),
    ("foreign_room_left", "long", ("ForeignCurrentRoom", "ForeignRoom")), ("total_buy_orders", "long", ("TotalBuyTrade",)), ("total_buy_vol", "long", ("TotalBuyTradeVol",)), ("total_sell_orders", "long", ("TotalSellTrade",)),
    ("total_sell_vol", "long", ("TotalSellTradeVol",)), ("foreign_net_vol", "long", ("NetBuySellVol", "NetForeignVol")), ("foreign_net_value", "double", ("NetBuySellVal", "NetForeignVal")),
    ("price_change", "double", ("PriceChange",)), ("price_change_pct", "double", ("PerPriceChange",)),
)
INTRADAY_FIELDS = (
    ("open", "double", ("OpenPrice", "Open")), ("high", "double", ("HighestPrice", "HighPrice", "High")), ("low", "double", ("LowestPrice", "LowPrice", "Low")), ("close", "double", ("ClosePrice", "Close", "Value")),
    ("volume", "long", ("TotalTradedVol", "TotalMatchVol", "Volume")), ("api_intraday_value", "double", ("TotalTradedValue", "TotalMatchVal", "Value")),
)
#: All names a price payload may use; a JSON reader takes them as strings.
PAYLOAD_FIELDS = tuple(dict.fromkeys(["TradingDate", "RefPrice", "CeilingPrice", "FloorPrice", "Time", *(n for f in (DAILY_FIELDS, INTRADAY_FIELDS) for _, _, names in f for n in names)]))


def _fields(payload: DataFrame, fields: Iterable[tuple[str, str, tuple[str, ...]]]) -> list[Column]:
    have = set(payload.columns)
    read = {"double": clean_double, "long": clean_long}
    return [read[kind](first_present(*(F.col(n) for n in names if n in have)) if have & set(names) else F.lit(None).cast("string")).alias(out) for out, kind, names in fields]


def zero_limits(rows: DataFrame, reason_empty: Column | None = None) -> DataFrame:
    """Reference, ceiling and floor of 0 become null, with a flag for each and the reasons joined; rows without any have
    ``reason_empty``, null by default."""
    parts = [(n, F.coalesce(F.col(f"{n}_price") == 0, F.lit(False))) for n in ("ref", "ceiling", "floor")]
    reason = F.concat_ws(",", *(F.when(zero, F.lit(f"{n}_price_zero")) for n, zero in parts))
    out = rows.withColumns({f"anomaly_{n}_zero": zero for n, zero in parts} | {"anomaly_reason": F.when(reason != "", reason).otherwise(reason_empty if reason_empty is not None else F.lit(None))})
    return out.withColumns({f"{n}_price": F.nullif(F.col(f"{n}_price"), F.lit(0.0)) for n, _ in parts})


def normalize_daily(payload: DataFrame) -> DataFrame:
    """Daily payload rows (strings, one column ``symbol``) to the raw daily table; rows without a date are dropped."""
    date = mixed_date(F.col("TradingDate"))
    out = payload.select(
        F.upper("symbol").alias("ticker"), date.alias("trading_date"), *(clean_double(F.col(f"{n}Price")).alias(f"{n.lower()}_price") for n in ("Ref", "Ceiling", "Floor")),
        *_fields(payload, DAILY_FIELDS), local_timestamp(date, F.col("Time") if "Time" in payload.columns else F.lit(None).cast("string")).alias("returned_at"),
    )
    return zero_limits(out.filter(F.col("trading_date").isNotNull()))


def normalize_intraday(payload: DataFrame, snapshot_time: Column) -> DataFrame:
    """Snapshot rows; the time is floored to the minute in the local zone."""
    stamp = F.to_utc_timestamp(F.date_trunc("minute", F.from_utc_timestamp(snapshot_time, ZONE)), ZONE)
    out = payload.select(F.upper("symbol").alias("ticker"), stamp.alias("timestamp"), mixed_date(F.col("TradingDate")).alias("trading_date"), *_fields(payload, INTRADAY_FIELDS))
    return out.filter(F.col("trading_date").isNotNull())


def in_session(stamp: Column) -> Column:
    """Monday to Friday, 09:00-11:30 or 13:00-15:00 local time, both ends included."""
    local = F.from_utc_timestamp(stamp, ZONE)
    clock = F.date_format(local, "HH:mm:ss")
    return (F.weekday(local) < 5) & (clock.between("09:00:00", "11:30:00") | clock.between("13:00:00", "15:00:00"))


def date_chunks(spans: DataFrame, days: int = 30) -> DataFrame:
    """Spans start-end cut into pieces of at most ``days`` days: chunk_start, chunk_end."""
    pieces = F.explode(F.sequence("start", "end", F.expr(f"interval {days} days")))
    rows = spans.filter("start <= end").withColumn("chunk_start", pieces)
    return rows.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), "end"))


def backfill_window(rows: DataFrame, days: int, end: Column) -> DataFrame:
    """Rows of the last ``days`` calendar days up to ``end``."""
    if days <= 0:
        raise ValueError("days must be positive")
    return rows.filter(F.col("trading_date").between(F.date_sub(end, days - 1), end))


def resolve_symbols(requests: DataFrame, default: list[str]) -> DataFrame:
    """One row for each ticker of a comma-separated list, trimmed and upper; the defaults for an empty list."""
    parts = F.filter(F.transform(F.split(F.coalesce("symbols", F.lit("")), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return requests.withColumn("ticker", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(*map(F.lit, default)))))


# -- indicators -------------------------------------------------------------------------------------------------------


def effective_close() -> Column:
    return F.coalesce(F.col("adj_close_price"), F.col("close_price"))


def with_ticks(daily: DataFrame) -> DataFrame:
    """The effective price, and the same as whole ten-thousandths so that window sums are exact in any order."""
    return daily.withColumn("price", effective_close()).withColumn("ticks", F.round(F.col("price") * 10000).cast("long"))


def moving_averages(daily: DataFrame, spans: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """Means over the last n rows, null unless all n prices are known."""
    days = Window.partitionBy("ticker").orderBy("trading_date")
    out = with_ticks(daily)
    for n in spans:
        w = days.rowsBetween(1 - n, 0)
        out = out.withColumn(f"ma{n}", F.when(F.count("ticks").over(w) == n, F.sum("ticks").over(w) / F.lit(n * 10000.0)))
    return out.drop("ticks")


def rsi(daily: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean relative strength; null for the first n rows and where nothing was lost."""
    days = Window.partitionBy("ticker").orderBy("trading_date")
    w = days.rowsBetween(1 - n, 0)
    out = with_ticks(daily)
    out = out.withColumn("delta", F.col("ticks") - F.lag("ticks").over(days))
    gain, loss = (F.sum(F.when(F.col("delta").isNotNull(), F.greatest(sign * F.col("delta"), F.lit(0)))).over(w) for sign in (1, -1))
    ratio = F.try_divide(gain, F.nullif(loss, F.lit(0)))
    return out.withColumn("rsi_14", F.when(F.count("delta").over(w) == n, 100 - F.try_divide(F.lit(100.0), 1 + ratio))).drop("ticks", "delta")


def _ema(x: np.ndarray, span: int) -> np.ndarray:
    """y = (1-a) y + a x from the first value on; at a missing value the mean stays and its weight decays."""
    a = 2 / (span + 1)
    out, y, old = np.full(len(x), np.nan), np.nan, 1.0
    for i, v in enumerate(x):
        if np.isnan(y):
            y = v
        else:
            old *= 1 - a
            if not np.isnan(v):
                y, old = (old * y + a * v) / (old + a), 1.0
        out[i] = y
    return out


def ema_macd(daily: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """ticker, trading_date, macd and macd_signal. The recursion has no window form: one call for each ticker, over two
    narrow columns; a ticker has one row a day, so groups stay small."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("trading_date")
        price = rows["price"].to_numpy(float)
        macd = _ema(price, fast) - _ema(price, slow)
        return pd.DataFrame({"ticker": rows["ticker"], "trading_date": rows["trading_date"], "macd": macd, "macd_signal": _ema(macd, signal)})

    return daily.select("ticker", "trading_date", effective_close().alias("price")).groupBy("ticker").applyInPandas(run, "ticker string, trading_date date, macd double, macd_signal double")


def market_cap(close: Column, shares: Column) -> Column:
    return close * F.nullif(shares, F.lit(0))


def signal_flags(rows: DataFrame) -> DataFrame:
    """Three-valued: null where the indicator is."""
    return rows.withColumns({"flag_above_ma50": F.col("close_price") > F.col("ma50"), "flag_overbought": F.col("rsi_14") > 70, "flag_oversold": F.col("rsi_14") < 30})


def daily_features(daily: DataFrame, symbols: DataFrame, macd: DataFrame | None = None) -> DataFrame:
    """All indicators of all tickers: one shuffle by ticker serves the windows and the recursion. ``macd`` (ticker,
    trading_date, macd, macd_signal), where it is known already, names the rows that are wanted."""
    rows = rsi(moving_averages(daily.select("ticker", "trading_date", "close_price", "adj_close_price"))).drop("price")
    rows = rows.join(ema_macd(daily) if macd is None else macd, ["ticker", "trading_date"])
    rows = rows.join(symbols.select("ticker", F.col("current_listed_shares").alias("snapshot_listed_shares")), "ticker", "left")
    rows = signal_flags(rows.withColumn("market_cap", market_cap(F.col("close_price"), F.col("snapshot_listed_shares"))))
    return rows.withColumn("formula_version", F.lit(FORMULA)).drop("close_price", "adj_close_price")


# -- joins and views --------------------------------------------------------------------------------------------------


def daily_view(symbols: DataFrame, daily: DataFrame, features: DataFrame) -> DataFrame:
    """Symbols inner daily rows, left features, with the effective close."""
    extra = [c for c in features.columns if c not in daily.columns or c in ("ticker", "trading_date")]
    return daily.join(symbols, "ticker").join(features.select(*extra), ["ticker", "trading_date"], "left").withColumn("effective_close_price", effective_close())


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key: an aggregate with map-side combine, no sort."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("best"))
    return best.select(key, "best.*").select(*rows.columns)


def intraday_latest(intraday: DataFrame, symbols: DataFrame) -> DataFrame:
    """Latest snapshot of each ticker on the overall latest day; tickers without a row that day are absent."""
    day = intraday.agg(F.max("trading_date").alias("trading_date"))
    return latest_per_key(intraday.join(F.broadcast(day), "trading_date").select(*intraday.columns), "ticker", "timestamp").join(symbols, "ticker")


def merge_history(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("ticker", "trading_date")) -> DataFrame:
    """Rows of both; an incoming row replaces a whole existing one; null dates are dropped."""
    existing, incoming = (x.dropna(subset=list(keys)) for x in (existing, incoming))
    return existing.join(incoming.select(*keys), list(keys), "left_anti").select(*incoming.columns).unionByName(incoming)


def current_price(latest: DataFrame, daily: DataFrame) -> DataFrame:
    """Latest intraday price, and for tickers without one the latest daily effective close: ticker, price, volume, date, source."""
    live = latest.select("ticker", F.col("close").alias("price"), "volume", F.col("trading_date").alias("price_date"), F.lit("intraday").alias("source"))
    rest = daily.select("ticker", effective_close().alias("price"), F.col("total_volume").alias("volume"), F.col("trading_date").alias("price_date"))
    rest = latest_per_key(rest.filter(F.col("price").isNotNull()), "ticker", "price_date").join(live.select("ticker"), "ticker", "left_anti")
    return live.unionByName(rest.withColumn("source", F.lit("daily")))


def compare_two_dates(daily: DataFrame, first: Column, second: Column) -> DataFrame:
    """Prices of each ticker on two dates, their difference and percentage; tickers without both are absent."""
    rows = daily.withColumn("price", effective_close())
    a = rows.filter(F.col("trading_date") == first).select("ticker", F.col("trading_date").alias("date_1"), F.col("price").alias("price_1"))
    b = rows.filter(F.col("trading_date") == second).select("ticker", F.col("trading_date").alias("date_2"), F.col("price").alias("price_2"))
    change = F.col("price_2") - F.col("price_1")
    return a.join(b, "ticker").withColumns({"price_change": F.round(change, 4), "percent_change": F.round(F.try_divide(100 * change, F.nullif(F.col("price_1"), F.lit(0.0))), 2)})


def period_return(daily: DataFrame, period: str) -> DataFrame:
    """First and latest price of each ticker and calendar period ('year' or 'month'), and the change in percent."""
    rows = daily.withColumn("price", effective_close()).filter(F.col("price").isNotNull()).withColumn("period", F.trunc("trading_date", period))
    out = rows.groupBy("ticker", "period").agg(F.min_by("price", "trading_date").alias("start_price"), F.max_by("price", "trading_date").alias("end_price"))
    return out.withColumn("change_pct", F.round(F.try_divide(100 * (F.col("end_price") - F.col("start_price")), F.nullif(F.col("start_price"), F.lit(0.0))), 2))


def screen_signals(view: DataFrame, predicate: Column, limit: int = 200) -> DataFrame:
    """Rows that meet a condition, latest first."""
    return view.filter(predicate).orderBy(F.desc("trading_date"), "ticker").limit(limit)


#: Statements that a read-only surface refuses.
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke", "merge", "copy", "call", "execute")


def guard_sql(sql: str) -> str:
    """One statement that begins with SELECT or WITH and names nothing forbidden; else an error."""
    import re

    text = sql.strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if ";" in text:
        raise ValueError("only one statement is allowed")
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only SELECT statements are allowed")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if found := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", bare):
        raise ValueError(f"{found[1].upper()} is not allowed")
    return text


def sql_surface(spark: SparkSession, views: dict[str, DataFrame], sql: str, args: dict | None = None, limit: int = 200) -> DataFrame:
    """Read-only SQL over the given views, at most ``limit`` rows."""
    text = guard_sql(sql)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {}).limit(limit)


# -- audits -----------------------------------------------------------------------------------------------------------


def is_anomalous() -> Column:
    return F.coalesce(F.col("anomaly_ref_zero") | F.col("anomaly_ceiling_zero") | F.col("anomaly_floor_zero"), F.lit(False))


def _anomalies(rows: DataFrame, *keys: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("total_rows"), F.count_if(is_anomalous()).alias("anomaly_rows"))
    return out.withColumn("anomaly_ratio_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("anomaly_rows"), F.nullif(F.col("total_rows"), F.lit(0))), 4), F.lit(0.0)))


def anomaly_summary(rows: DataFrame) -> DataFrame:
    return _anomalies(rows)


def anomaly_by_ticker(rows: DataFrame, limit: int = 50) -> DataFrame:
    return _anomalies(rows, "ticker").filter("anomaly_rows > 0").orderBy(F.desc("anomaly_rows"), "ticker").limit(limit)


def anomaly_by_day(rows: DataFrame, limit: int = 120) -> DataFrame:
    return _anomalies(rows, "trading_date").orderBy(F.desc("trading_date")).limit(limit)


def validate_latest(latest: DataFrame, daily: DataFrame, symbols: DataFrame, recent: int = 5) -> DataFrame:
    """For each ticker: rows in the intraday view, rows among its latest daily ones, whether it has any."""
    a = latest.groupBy("ticker").agg(F.count("*").alias("intraday_rows"))
    b = daily.groupBy("ticker").agg(F.least(F.count("*"), F.lit(recent)).alias("daily_rows"))
    out = symbols.select("ticker").join(a, "ticker", "left").join(b, "ticker", "left").na.fill(0, ["intraday_rows", "daily_rows"])
    return out.withColumn("has_data", (F.col("intraday_rows") > 0) | (F.col("daily_rows") > 0))


def validate_daily(daily: DataFrame, symbols: DataFrame, start: Column, end: Column) -> DataFrame:
    """For each ticker: its rows between two dates, the latest date, whether there are any."""
    inside = F.col("trading_date").between(start, end)
    b = daily.groupBy("ticker").agg(F.count_if(inside).alias("row_count"), F.max(F.when(inside, F.col("trading_date"))).alias("max_date"))
    out = symbols.select("ticker").join(b, "ticker", "left").na.fill(0, ["row_count"])
    return out.withColumn("has_data", F.col("row_count") > 0)


def retention(rows: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay (trading_date on or after the cut-off), and how many go."""
    old = F.col("trading_date") < cutoff
    return rows.filter(~old), rows.agg(F.count_if(old).alias("deleted"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """For each run: tickers, rows upserted, and the failed tickers with their errors; one failure spoils nothing else."""
    failed = F.col("error").isNotNull()
    return outcomes.groupBy("run_id").agg(
        F.count_distinct("ticker").alias("symbols"), F.sum(F.when(~failed, F.col("rows")).otherwise(0)).alias("rows_upserted"), F.sort_array(F.collect_set(F.when(failed, F.concat_ws(": ", "ticker", "error")))).alias("failed_symbols")
    )


# -- keyed writes -----------------------------------------------------------------------------------------------------


def last_of_batch(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_replace(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target with the batch's rows put in place of those with their keys."""
    batch = last_of_batch(batch, keys, order)
    return target.join(batch.select(*keys), keys, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def upsert_merge(target: DataFrame, batch: DataFrame, key: str, keep_if_empty: list[str], keep_if_null: list[str], merge_maps: list[str], keep: list[str]) -> DataFrame:
    """Column rules on conflict: incoming unless empty, incoming else existing, maps united with the incoming winning,
    existing kept, and all others replaced."""
    new_there, old_there = (F.coalesce(F.col(f"{x}._there"), F.lit(False)) for x in "no")
    both = target.withColumn("_there", F.lit(True)).alias("o").join(batch.withColumn("_there", F.lit(True)).alias("n"), key, "full_outer")

    def rule(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_if_empty:
            new = F.coalesce(F.nullif(n, F.lit("")), o)
        elif c in keep_if_null:
            new = F.coalesce(n, o)
        elif c in merge_maps:
            empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
            o, n = F.coalesce(o, empty), F.coalesce(n, empty)
            new = F.map_concat(F.map_filter(o, lambda k, _: ~F.array_contains(F.map_keys(n), k)), n)
        elif c in keep:
            new = F.when(old_there, o).otherwise(n)
        else:
            new = n
        return F.when(new_there, new).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(key, *(rule(c) for c in target.columns if c != key))


def upsert_keep_id(target: DataFrame, batch: DataFrame, keys: list[str], keep: list[str], order: list[str]) -> DataFrame:
    """Replace on conflict, but keep the columns ``keep`` (ids, creation times) of the existing row."""
    batch = last_of_batch(batch, keys, order)
    old = target.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep), F.lit(True).alias("_there"))
    new = batch.join(old, keys, "left")
    new = new.withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in keep}).select(*target.columns)
    return target.join(batch.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def update_known(target: DataFrame, outcome: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set only the columns that the outcome knows; rows without an outcome stay."""
    o = outcome.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return target.join(o, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*target.columns)


def validate_constraints(daily: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rules broken: key not null, known ticker, no negative volume or value."""
    known = symbols.select("ticker", F.lit(True).alias("_known"))
    rules = {
        "ticker_null": F.col("ticker").isNull(),
        "date_null": F.col("trading_date").isNull(),
        "unknown_ticker": F.col("_known").isNull() & F.col("ticker").isNotNull(),
        "negative_volume": F.col("total_volume") < 0,
        "negative_value": F.col("total_value") < 0,
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return daily.join(known, "ticker", "left").withColumn("violations", F.array_join(broken, ",")).filter("violations <> ''").drop("_known")


def status_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out

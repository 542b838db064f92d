"""Rows of the former price tables in the present ones, and unions of results of several branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.market import local_timestamp, upsert_replace, zero_limits

CLOCK = r"^\d{2}:\d{2}:\d{2}$"
LEGACY_FORMULA = "legacy_v1_migrated"


def clock_instant(date: Column, time: Column) -> Column:
    """The instant of a local date and time, null unless the time is HH:mm:ss."""
    return F.when(F.rlike(time, F.lit(CLOCK)), local_timestamp(date, time))


def migrate_symbols(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """Renamed columns; the market is the security type, else the market id, else stock."""
    market = F.coalesce(F.nullif("sec_type", F.lit("")), F.nullif("market_id", F.lit("")), F.lit("stock"))
    rows = legacy.select(F.col("symbol").alias("ticker"), F.col("symbol_name").alias("name_vi"), F.col("symbol_eng_name").alias("name_en"), "exchange", market.alias("market"), F.col("listed_share").alias("current_listed_shares"))
    return upsert_replace(target, rows, ["ticker"], ["ticker"])


def migrate_daily(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """Zero limits flagged (the reason is an empty text when there is none, unlike for new rows); a zero average is null."""
    rows = legacy.withColumnRenamed("symbol", "ticker").withColumns({"avg_price": F.nullif("avg_price", F.lit(0.0)), "returned_at": clock_instant(F.col("trading_date"), F.col("source_time"))})
    kept = {c: rows[c] for c in ("ref_price", "ceiling_price", "floor_price")}
    rows = zero_limits(rows.withColumns({f"_{c}": x for c, x in kept.items()}), F.lit("")).withColumns({c: F.col(f"_{c}") for c in kept})
    return upsert_replace(target, rows.select(*target.columns), ["ticker", "trading_date"], ["trading_date"])


def migrate_features(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """Flags are null where the indicator that they rest on is."""
    rsi = F.col("rsi_14").isNull()
    rows = legacy.withColumnRenamed("symbol", "ticker").withColumns(
        {
            "flag_above_ma50": F.when(F.col("ma50").isNotNull() & F.col("close_price").isNotNull(), F.col("price_above_ma50")),
            "flag_overbought": F.when(~rsi, F.col("is_overbought")),
            "flag_oversold": F.when(~rsi, F.col("is_oversold")),
            "formula_version": F.lit(LEGACY_FORMULA),
        }
    )
    return upsert_replace(target, rows.select(*target.columns), ["ticker", "trading_date"], ["trading_date"])


def migrate_intraday(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """Bars with a time, at the instant of their local date and time."""
    rows = legacy.filter(F.col("bar_time").isNotNull()).withColumnRenamed("symbol", "ticker").withColumn("timestamp", local_timestamp(F.col("trading_date"), F.col("bar_time")))
    return upsert_replace(target, rows.select(*target.columns), ["ticker", "timestamp"], ["timestamp"])


def union_tool_results(market: DataFrame, news: DataFrame, reports: DataFrame) -> DataFrame:
    """Results of the branches in fixed order, each with its place."""
    out = None
    for i, (name, rows) in enumerate((("market", market), ("news", news), ("financial_reports", reports))):
        rows = rows.withColumns({"tool_name": F.lit(name), "tool_order": F.lit(i)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out

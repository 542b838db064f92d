"""Registered queries over price tables, each with its SQL twin."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import views
from lakeloom.operators import market as m
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


def daily(spark: SparkSession, d: str) -> DataFrame:
    return m.zero_limits(views.daily_payload(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    rows = m.rsi(m.moving_averages(daily(spark, d)))
    rows = rows.join(views.symbols(spark, d), "ticker", "left")
    return m.signal_flags(rows.withColumn("market_cap", m.market_cap(F.col("close_price"), F.col("current_listed_shares"))))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("""SELECT f.ticker, f.trading_date, s.exchange, coalesce(d.adj_close_price, d.close_price) AS effective_close_price, round(ma20, 9) AS ma20, round(ma50, 9) AS ma50, round(rsi_14, 9) AS rsi_14, flag_above_ma50, flag_overbought, flag_oversold
    FROM v_flags f JOIN v_symbols s USING (ticker) JOIN v_daily d USING (ticker, trading_date) WHERE ma20 IS NOT NULL AND (flag_overbought OR flag_oversold OR flag_above_ma50)""")
def market_screen(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: cleaning, indicators, view, screen. Listed tickers carry their exchange and prices through the indicators,
    so the daily rows are aggregated once and shuffled once by ticker."""
    view = features(spark, d).filter(F.col("exchange").isNotNull() & F.col("ma20").isNotNull() & (F.col("flag_overbought") | F.col("flag_oversold") | F.col("flag_above_ma50")))
    view = view.withColumn("effective_close_price", m.effective_close())
    return rounded(view.select("ticker", "trading_date", "exchange", "effective_close_price", "ma20", "ma50", "rsi_14", "flag_above_ma50", "flag_overbought", "flag_oversold"), "ma20", "ma50", "rsi_14")


_RAW = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN event_type WHEN 3 THEN NULL WHEN 4 THEN '-12.9' ELSE (event_id * 3)::VARCHAR || '.75' END AS raw FROM events)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 6
    raw = F.when(n == 0, "").when(n == 1, "None").when(n == 2, F.col("event_type")).when(n == 3, F.lit(None)).when(n == 4, "-12.9").otherwise(F.concat((F.col("event_id") * 3).cast("string"), F.lit(".75")))
    return views.table(spark, d, "events").select("event_id", raw.alias("raw"))


@query(f"SELECT event_id, try_cast(nullif(nullif(raw, ''), 'None') AS DOUBLE) AS as_double, trunc(try_cast(nullif(nullif(raw, ''), 'None') AS DOUBLE))::BIGINT AS as_long FROM {_RAW}")
def clean_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("event_id", m.clean_double(F.col("raw")).alias("as_double"), m.clean_long(F.col("raw")).alias("as_long"))


@query(f"SELECT event_id, coalesce(nullif(nullif(raw, ''), 'None'), nullif(nullif(event_type, ''), 'None')) AS value FROM {_RAW} JOIN events USING (event_id)")
def first_present(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).join(views.table(spark, d, "events").select("event_id", "event_type"), "event_id").select("event_id", m.first_present(F.col("raw"), F.col("event_type")).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN raw LIKE '%/%' THEN try_strptime(raw, '%d/%m/%Y')::DATE ELSE try_strptime(raw, '%Y-%m-%d')::DATE END AS parsed FROM (
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '' ELSE '31/02/2024' END AS raw FROM orders)""")
def parse_mixed_date(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    raw = F.when(n == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(n == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 2, "").otherwise("31/02/2024")
    return views.table(spark, d, "orders").select("o_orderkey", m.mixed_date(raw).alias("parsed"))


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 7 HOUR AS instant FROM events")
def parse_local_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", m.local_timestamp(F.to_date("ts"), F.date_format("ts", "HH:mm:ss")).alias("instant"))


@query("SELECT ticker, trading_date, ref_price, ceiling_price, floor_price, anomaly_ref_zero, anomaly_ceiling_zero, anomaly_floor_zero, anomaly_reason, close_price, total_volume FROM v_daily")
def normalize_daily_raw(spark: SparkSession, d: str) -> DataFrame:
    rows = views.daily_payload(spark, d)
    text = rows.select(
        F.lower("ticker").alias("symbol"), F.date_format("trading_date", "dd/MM/yyyy").alias("TradingDate"), F.col("ref_price").cast("string").alias("RefPrice"), F.col("ceiling_price").cast("string").alias("CeilingPrice"),
        F.col("floor_price").cast("string").alias("FloorPrice"), F.col("close_price").cast("string").alias("Close"), F.col("total_volume").cast("string").alias("TotalTradedVol"), F.lit("10:00:00").alias("Time"),
    )
    out = m.normalize_daily(text)
    names = views.symbols(spark, d).select("ticker")
    return out.join(names, F.upper(names["ticker"]) == out["ticker"]).select(names["ticker"], *[out[c] for c in ("trading_date", "ref_price", "ceiling_price", "floor_price", "anomaly_ref_zero", "anomaly_ceiling_zero", "anomaly_floor_zero", "anomaly_reason", "close_price", "total_volume")])


@query("SELECT 'U' || user_id AS ticker, date_trunc('minute', ts) AS timestamp, ts::DATE AS trading_date, value AS close, event_id AS volume FROM events")
def normalize_intraday(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    payload = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("TradingDate"), F.col("value").cast("string").alias("ClosePrice"), F.col("event_id").cast("string").alias("Volume"), "ts")
    return m.normalize_intraday(payload, F.col("ts")).select("ticker", "timestamp", "trading_date", "close", "volume")


@query("""SELECT event_id FROM (SELECT event_id, ts + INTERVAL 7 HOUR AS l FROM events) WHERE isodow(l) <= 5
    AND (strftime(l, '%H:%M:%S') BETWEEN '09:00:00' AND '11:30:00' OR strftime(l, '%H:%M:%S') BETWEEN '13:00:00' AND '15:00:00')""")
def filter_trading_session(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").filter(m.in_session(F.col("ts"))).select("event_id")


@query("""SELECT ticker, c::DATE AS chunk_start, least(c::DATE + 29, e) AS chunk_end FROM (SELECT ticker, min(trading_date) AS s, max(trading_date) AS e FROM v_payload GROUP BY 1), unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 30 DAY)) t(c)""")
def date_chunks(spark: SparkSession, d: str) -> DataFrame:
    spans = views.daily_payload(spark, d).groupBy("ticker").agg(F.min("trading_date").alias("start"), F.max("trading_date").alias("end"))
    return m.date_chunks(spans).select("ticker", "chunk_start", "chunk_end")


@query("SELECT ticker, trading_date, close_price FROM v_payload WHERE trading_date BETWEEN DATE '2001-07-03' AND DATE '2001-08-01'")
def backfill_window(spark: SparkSession, d: str) -> DataFrame:
    return m.backfill_window(views.daily_payload(spark, d), 30, F.lit(datetime.date(2001, 8, 1))).select("ticker", "trading_date", "close_price")


@query("""SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['FPT', 'HPG'] ELSE [upper(c_mktsegment), 'ACB'] END) AS ticker FROM customer""")
def resolve_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    requests = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " , ").otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(", acb ,"))).alias("symbols"))
    return m.resolve_symbols(requests, ["FPT", "HPG"]).select("c_custkey", "ticker")


@query("SELECT ticker, trading_date, coalesce(adj_close_price, close_price) AS effective_close_price FROM v_daily")
def effective_close(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("ticker", "trading_date", m.effective_close().alias("effective_close_price"))


@query("SELECT ticker, trading_date, round(rsi_14, 9) AS rsi_14 FROM v_flags WHERE flag_above_ma50 AND rsi_14 > 50 ORDER BY trading_date DESC, ticker LIMIT 200")
def screen_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.screen_signals(features(spark, d), F.col("flag_above_ma50") & (F.col("rsi_14") > 50)).select("ticker", "trading_date", "rsi_14"), "rsi_14")


# -- joins and views --


@query("""SELECT s.ticker, s.exchange, d.trading_date, coalesce(d.adj_close_price, d.close_price) AS effective_close_price, round(f.ma50, 9) AS ma50, f.market_cap, d.anomaly_reason
    FROM v_symbols s JOIN v_daily d ON s.ticker = d.ticker LEFT JOIN v_features f ON f.ticker = d.ticker AND f.trading_date = d.trading_date""")
def daily_view(spark: SparkSession, d: str) -> DataFrame:
    view = m.daily_view(views.symbols(spark, d), daily(spark, d), features(spark, d).select("ticker", "trading_date", "ma50", "market_cap"))
    return rounded(view.select("ticker", "exchange", "trading_date", "effective_close_price", "ma50", "market_cap", "anomaly_reason"), "ma50")


_USERS = "(SELECT DISTINCT ticker, 'X' AS exchange FROM v_intraday WHERE ticker <> 'U1')"


def _users(spark: SparkSession, d: str) -> DataFrame:
    return views.intraday(spark, d).filter("ticker <> 'U1'").select("ticker", F.lit("X").alias("exchange")).distinct()


@query(f"""SELECT ticker, timestamp, close, volume, trading_date, exchange FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) AS n FROM v_intraday WHERE trading_date = (SELECT max(trading_date) FROM v_intraday)) JOIN {_USERS} USING (ticker) WHERE n = 1""")
def intraday_latest_view(spark: SparkSession, d: str) -> DataFrame:
    return m.intraday_latest(views.intraday(spark, d), _users(spark, d))


@query("""SELECT ticker, trading_date, close_price FROM v_payload WHERE day(trading_date) % 3 <> 0 UNION ALL SELECT ticker, trading_date, close_price + 1 FROM v_payload WHERE day(trading_date) % 3 = 0""")
def merge_history(spark: SparkSession, d: str) -> DataFrame:
    rows = views.daily_payload(spark, d).select("ticker", "trading_date", "close_price")
    return m.merge_history(rows, rows.filter(F.dayofmonth("trading_date") % 3 == 0).withColumn("close_price", F.col("close_price") + 1))


@query("""WITH live AS (SELECT ticker, close AS price, volume, trading_date AS price_date, 'intraday' AS source FROM (
        SELECT n_name AS ticker, i.close, i.volume, i.trading_date, row_number() OVER (PARTITION BY n_name ORDER BY i.timestamp DESC) AS n FROM v_intraday i JOIN nation ON i.ticker = 'U' || n_nationkey
        WHERE i.trading_date = (SELECT max(trading_date) FROM v_intraday)) WHERE n = 1),
    rest AS (SELECT ticker, coalesce(adj_close_price, close_price) AS price, total_volume AS volume, trading_date AS price_date, 'daily' AS source FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS n FROM v_daily) WHERE n = 1)
    SELECT * FROM live UNION ALL SELECT * FROM rest WHERE ticker NOT IN (SELECT ticker FROM live)""")
def current_price_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    nation = views.table(spark, d, "nation").select(F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("u"), "n_name")
    i = views.intraday(spark, d)
    latest = m.intraday_latest(i.join(nation, i["ticker"] == nation["u"]).drop("ticker", "u").withColumnRenamed("n_name", "ticker"), views.symbols(spark, d).select("ticker"))
    day = i.agg(F.max("trading_date").alias("trading_date"))
    return m.current_price(latest.join(F.broadcast(day), "trading_date", "left_semi"), daily(spark, d))


@query("""SELECT a.ticker, a.trading_date AS date_1, a.price AS price_1, b.trading_date AS date_2, b.price AS price_2, round(b.price - a.price, 4) AS price_change, round(100 * (b.price - a.price) / nullif(a.price, 0), 2) AS percent_change
    FROM v_price a JOIN v_price b ON a.ticker = b.ticker AND a.trading_date = (SELECT min(trading_date) FROM v_price WHERE ticker = (SELECT min(ticker) FROM v_price)) AND b.trading_date = (SELECT max(trading_date) FROM v_price WHERE ticker = (SELECT min(ticker) FROM v_price))""")
def compare_two_dates(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last day of the first ticker, for every ticker with prices on both."""
    prices = daily(spark, d)
    first, last = prices.groupBy("ticker").agg(F.min("trading_date"), F.max("trading_date")).orderBy("ticker").first()[1:]
    return m.compare_two_dates(prices, F.lit(first), F.lit(last))


@query("""SELECT ticker, date_trunc('year', trading_date)::DATE AS period, arg_min(price, trading_date) AS start_price, arg_max(price, trading_date) AS end_price,
    round(100 * (arg_max(price, trading_date) - arg_min(price, trading_date)) / nullif(arg_min(price, trading_date), 0), 2) AS change_pct FROM v_price GROUP BY 1, 2""")
def period_return(spark: SparkSession, d: str) -> DataFrame:
    return m.period_return(daily(spark, d), "year")


@query("SELECT exchange, count(*) AS n, max(coalesce(adj_close_price, close_price)) AS top_price FROM v_daily JOIN v_symbols USING (ticker) WHERE trading_date >= DATE '1997-01-01' GROUP BY exchange")
def sql_surface(spark: SparkSession, d: str) -> DataFrame:
    view = m.daily_view(views.symbols(spark, d), daily(spark, d), features(spark, d).select("ticker", "trading_date", "ma20"))
    return m.sql_surface(spark, {"daily_view": view}, "SELECT exchange, count(*) AS n, max(effective_close_price) AS top_price FROM daily_view WHERE trading_date >= :since GROUP BY exchange;", {"since": datetime.date(1997, 1, 1)})


# -- windows --


@query("SELECT ticker, trading_date, round(ma20, 9) AS ma20, round(ma50, 9) AS ma50, round(ma200, 9) AS ma200 FROM v_features")
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.moving_averages(daily(spark, d)).select("ticker", "trading_date", "ma20", "ma50", "ma200"), "ma20", "ma50", "ma200")


@query("SELECT ticker, trading_date, round(rsi_14, 9) AS rsi_14 FROM v_features")
def rsi14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.rsi(daily(spark, d)).select("ticker", "trading_date", "rsi_14"), "rsi_14")


_EMA = """WITH e AS (
        SELECT ticker, prices, dates, 1 AS rn, prices[1] AS e12, prices[1] AS e26, 0.0::DOUBLE AS sig FROM (
            SELECT ticker, list(price ORDER BY trading_date) AS prices, list(trading_date ORDER BY trading_date) AS dates FROM v_price GROUP BY ticker)
        UNION ALL SELECT ticker, prices, dates, rn, a, b, sig * (1 - 2 / 10.0::DOUBLE) + 2 / 10.0::DOUBLE * (a - b) FROM (
            SELECT ticker, prices, dates, rn + 1 AS rn, sig, e12 * (1 - 2 / 13.0::DOUBLE) + 2 / 13.0::DOUBLE * prices[rn + 1] AS a, e26 * (1 - 2 / 27.0::DOUBLE) + 2 / 27.0::DOUBLE * prices[rn + 1] AS b
            FROM e WHERE rn < len(prices)))
    """


def _recursive(sql: str) -> str:
    return with_views(_EMA + sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def ema_macd(spark: SparkSession, d: str) -> DataFrame:
    return m.ema_macd(daily(spark, d)).withColumns({c: F.round(c, 4) for c in ("macd", "macd_signal")})


ORACLES["ema_macd"] = _recursive("SELECT ticker, dates[rn] AS trading_date, round(e12 - e26, 4) AS macd, round(sig, 4) AS macd_signal FROM e")


@query("SELECT d.ticker, trading_date, d.close_price * nullif(current_listed_shares, 0) AS market_cap FROM v_daily d JOIN v_symbols USING (ticker)")
def market_cap(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).join(views.symbols(spark, d), "ticker").select("ticker", "trading_date", m.market_cap(F.col("close_price"), F.col("current_listed_shares")).alias("market_cap"))


@query("SELECT ticker, trading_date, flag_above_ma50, flag_overbought, flag_oversold FROM v_flags")
def signal_flags(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("ticker", "trading_date", "flag_above_ma50", "flag_overbought", "flag_oversold")


@query()
def daily_features(spark: SparkSession, d: str) -> DataFrame:
    out = m.daily_features(daily(spark, d), views.symbols(spark, d)).withColumns({c: F.round(c, 4) for c in ("macd", "macd_signal")} | {c: F.round(c, 9) for c in ("ma20", "rsi_14")})
    return out.select("ticker", "trading_date", "ma20", "rsi_14", "macd", "macd_signal", "market_cap", "flag_above_ma50", "formula_version")


ORACLES["daily_features"] = _recursive(
    """SELECT f.ticker, f.trading_date, round(ma20, 9) AS ma20, round(rsi_14, 9) AS rsi_14, round(e12 - e26, 4) AS macd, round(sig, 4) AS macd_signal, market_cap, flag_above_ma50, 'v2_adj_close' AS formula_version
    FROM e JOIN v_flags f ON f.ticker = e.ticker AND f.trading_date = e.dates[e.rn]"""
)


@query("SELECT ticker, timestamp, close, volume, trading_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) AS n FROM v_intraday) WHERE n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return m.latest_per_key(views.intraday(spark, d), "ticker", "timestamp")


# -- audits --

_BAD = "coalesce(anomaly_ref_zero OR anomaly_ceiling_zero OR anomaly_floor_zero, false)"
_AUDIT = f"count(*) AS total_rows, count(*) FILTER (WHERE {_BAD}) AS anomaly_rows, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE {_BAD}) / nullif(count(*), 0), 4), 0) AS anomaly_ratio_pct FROM v_daily"


@query(f"SELECT {_AUDIT}")
def anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    return m.anomaly_summary(daily(spark, d))


@query(f"SELECT ticker, {_AUDIT} GROUP BY ticker HAVING anomaly_rows > 0 ORDER BY anomaly_rows DESC, ticker LIMIT 50")
def anomaly_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    return m.anomaly_by_ticker(daily(spark, d))


@query(f"SELECT trading_date, {_AUDIT} GROUP BY trading_date ORDER BY trading_date DESC LIMIT 120")
def anomaly_by_day(spark: SparkSession, d: str) -> DataFrame:
    return m.anomaly_by_day(daily(spark, d))


@query(f"""SELECT ticker, coalesce(i, 0) AS intraday_rows, coalesce(n, 0) AS daily_rows, coalesce(i, 0) > 0 OR coalesce(n, 0) > 0 AS has_data FROM v_symbols
    LEFT JOIN (SELECT n_name AS ticker, count(DISTINCT i.ticker) AS i FROM v_intraday i JOIN nation ON i.ticker = 'U' || n_nationkey WHERE i.trading_date = (SELECT max(trading_date) FROM v_intraday) GROUP BY 1) USING (ticker)
    LEFT JOIN (SELECT ticker, least(count(*), 5) AS n FROM v_daily GROUP BY 1) USING (ticker)""")
def validate_latest(spark: SparkSession, d: str) -> DataFrame:
    nation = views.table(spark, d, "nation").select(F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("ticker"), "n_name")
    latest = m.intraday_latest(views.intraday(spark, d), nation).select(F.col("n_name").alias("ticker"))
    return m.validate_latest(latest, daily(spark, d), views.symbols(spark, d))


@query("""SELECT ticker, coalesce(n, 0) AS row_count, max_date, coalesce(n, 0) > 0 AS has_data FROM v_symbols LEFT JOIN (
    SELECT ticker, count(*) AS n, max(trading_date) AS max_date FROM v_daily WHERE trading_date BETWEEN DATE '2001-07-03' AND DATE '2001-08-01' GROUP BY 1) USING (ticker)""")
def validate_daily(spark: SparkSession, d: str) -> DataFrame:
    return m.validate_daily(daily(spark, d), views.symbols(spark, d), F.lit(datetime.date(2001, 7, 3)), F.lit(datetime.date(2001, 8, 1)))


@query("SELECT count(*) FILTER (WHERE trading_date < DATE '2024-01-15') AS deleted, count(*) FILTER (WHERE trading_date >= DATE '2024-01-15') AS kept FROM v_intraday")
def retention_delete(spark: SparkSession, d: str) -> DataFrame:
    kept, deleted = m.retention(views.intraday(spark, d), F.lit(datetime.date(2024, 1, 15)))
    return deleted.crossJoin(kept.agg(F.count("*").alias("kept")))


@query("""SELECT day AS run_id, count(DISTINCT ticker) AS symbols, sum(CASE WHEN error IS NULL THEN rows ELSE 0 END)::BIGINT AS rows_upserted, coalesce(list_sort(list(DISTINCT ticker || ': ' || error) FILTER (WHERE error IS NOT NULL)), []) AS failed_symbols FROM (
    SELECT ts::DATE AS day, 'U' || user_id AS ticker, count(*) AS rows, CASE WHEN bool_or(event_type = 'error') THEN 'error' END AS error FROM events GROUP BY 1, 2) GROUP BY 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").groupBy(F.to_date("ts").alias("run_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"))
    return m.run_summary(e.agg(F.count("*").alias("rows"), F.when(F.bool_or(F.col("event_type") == "error"), "error").alias("error")))


# -- keyed writes --


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_orderstatus || '2' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, o_orderstatus || '2', o_totalprice FROM orders WHERE o_orderkey % 10 = 5""")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = o.filter("o_orderkey % 5 = 0")
    batch = changed.withColumn("v", F.lit(1)).unionByName(changed.withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit("2"))).withColumn("v", F.lit(2)))
    return m.upsert_replace(o.filter("o_orderkey % 2 = 0"), batch, ["o_orderkey"], ["v"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN o_orderpriority END WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'new' END AS title,
    CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS kept, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'o' END AS body FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    target = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("kept"), F.lit("o").alias("body"))
    batch = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("new").alias("title"), F.lit(None).cast("double").alias("kept"), F.lit("x").alias("body"))
    return m.upsert_merge(target, batch, "o_orderkey", ["title"], [], [], ["kept"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def upsert_article_by_query(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    target = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    batch = c.filter("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_custkey")).alias("id"), F.lit("new").alias("name"))
    return m.upsert_keep_id(target, batch, ["c_custkey"], ["id"], ["id"])


@query("""SELECT ticker, trading_date, CASE WHEN day(trading_date) = 7 THEN 'unknown_ticker,negative_volume' WHEN day(trading_date) = 8 THEN 'negative_volume' END AS violations FROM (
    SELECT CASE WHEN day(trading_date) = 7 THEN '?' ELSE ticker END AS ticker, trading_date FROM v_payload WHERE day(trading_date) IN (7, 8))""")
def validate_constraints(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofmonth("trading_date")
    rows = views.daily_payload(spark, d).withColumn("ticker", F.when(day == 7, "?").otherwise(F.col("ticker"))).withColumn("total_volume", F.when(day.isin(7, 8), -F.col("total_volume")).otherwise(F.col("total_volume")))
    return m.validate_constraints(rows, views.symbols(spark, d)).select("ticker", "trading_date", "violations")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'crawled' WHEN o_orderkey % 4 = 1 THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'k' || o_orderkey END AS content_key FROM orders""")
def mark_content(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("content_key"))
    n = F.col("o_orderkey") % 4
    outcome = o.filter(n < 2).select("o_orderkey", F.when(n == 0, "crawled").otherwise("failed").alias("status"), F.when(n == 0, F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).alias("content_key"))
    return m.update_known(o, outcome, "o_orderkey", ["status", "content_key"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new/' || c_custkey ELSE 'old' END AS raw_path, CASE WHEN c_custkey % 3 = 0 THEN 'md' END AS markdown_path FROM customer")
def artifact_paths_update(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer").select("c_custkey", F.lit("old").alias("raw_path"), F.lit(None).cast("string").alias("markdown_path"))
    news = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new/"), F.col("c_custkey").cast("string"))).alias("raw_path"), F.when(F.col("c_custkey") % 3 == 0, "md").alias("markdown_path"))
    return m.update_known(c, news, "c_custkey", ["raw_path", "markdown_path"])

"""The derived tables from which all queries start, in Spark and, for the oracles, in SQL.

Prices are whole cents divided at the end, so that sums and averages do not depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("ticker"), F.col("r_name").alias("exchange"), F.lit("stock").alias("market"), (1000 + F.col("n_nationkey") * 100).cast("long").alias("current_listed_shares")
    )


def daily_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows as a provider gives them: zeros for missing limits, adjusted close often missing."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", cents.alias("cents"), F.to_date("o_orderdate").alias("trading_date"))
    customer, nation = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    day = rows.groupBy(F.col("n_name").alias("ticker"), "trading_date").agg(
        F.min_by("cents", "o_orderkey").alias("o"), F.max_by("cents", "o_orderkey").alias("c"), F.max("cents").alias("h"), F.min("cents").alias("l"), F.count("*").alias("total_volume"), F.sum("cents").alias("v")
    )
    tenth, fifth = F.dayofmonth("trading_date") % 10 == 0, F.dayofmonth("trading_date") % 5 == 0
    return day.select(
        "ticker",
        "trading_date",
        F.when(tenth, 0.0).otherwise(F.col("o") / 100.0).alias("ref_price"),
        F.when(tenth, 0.0).otherwise(F.col("o") * 107 / 10000.0).alias("ceiling_price"),
        F.when(tenth, 0.0).otherwise(F.col("o") * 93 / 10000.0).alias("floor_price"),
        (F.col("o") / 100.0).alias("open_price"),
        (F.col("h") / 100.0).alias("high_price"),
        (F.col("l") / 100.0).alias("low_price"),
        (F.col("c") / 100.0).alias("close_price"),
        F.when(~fifth, F.col("c") * 98 / 10000.0).alias("adj_close_price"),
        "total_volume",
        (F.col("v") / 100.0).alias("total_value"),
    )


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by user and minute (a few rows a minute: the last event of it counts)."""
    e = table(spark, sf_dir, "events")
    return (
        e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.date_trunc("minute", "ts").alias("timestamp"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("volume"))
        .withColumn("trading_date", F.to_date("timestamp"))
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search hits."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("int").alias("position"),
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.substring(text, 1, 200).alias("snippet"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("site"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ordered sections: their paragraphs that are not empty."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).filter(F.length(F.trim("text")) > 0)


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"signup": "DISCOVERED", "view": "DOWNLOADED", "click": "PARSED", "purchase": "EMBEDDED", "error": "FAILED"}
    status = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), status.alias("new_status"), "event_id", "ts")


def agent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("agent"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("value").alias("latency"), "ts", "event_id", "user_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, and for each some question forms that carry the entities which the rules look for."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    n = F.col("conv_id") % F.lit(len(QUESTION_FORMS))
    form = F.element_at(F.array(*map(F.lit, QUESTION_FORMS)), (n + 1).cast("int"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat(form, F.lit(" "), F.coalesce("text", F.lit(""))).alias("question"))


QUESTION_FORMS = (
    "Giá hiện tại của FPT là bao nhiêu?",
    "So sánh giá HPG ngày 28/05/2026 và 2026-05-29",
    "Tin mới nhất về Hòa Phát",
    "Báo cáo tài chính ACB quý 2 năm 2025 tổng tài sản",
    "RSI và MACD của SSI từ đầu năm",
    "Review opinion for TCB consolidated financial statements q2 2025",
    "Router health status",
    "Lợi nhuận sau thuế của Vinamilk hợp nhất tại ngày 30/06/2025",
    "Hello there",
)

_FORMS_SQL = ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTION_FORMS)
SQL = {
    "v_symbols": "SELECT n_name AS ticker, r_name AS exchange, 'stock' AS market, (1000 + n_nationkey * 100)::BIGINT AS current_listed_shares FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_payload": """SELECT ticker, trading_date, CASE WHEN day(trading_date) % 10 = 0 THEN 0.0::DOUBLE ELSE o / 100.0::DOUBLE END AS ref_price,
        CASE WHEN day(trading_date) % 10 = 0 THEN 0.0::DOUBLE ELSE o * 107 / 10000.0::DOUBLE END AS ceiling_price, CASE WHEN day(trading_date) % 10 = 0 THEN 0.0::DOUBLE ELSE o * 93 / 10000.0::DOUBLE END AS floor_price,
        o / 100.0::DOUBLE AS open_price, h / 100.0::DOUBLE AS high_price, l / 100.0::DOUBLE AS low_price, c / 100.0::DOUBLE AS close_price,
        CASE WHEN day(trading_date) % 5 <> 0 THEN c * 98 / 10000.0::DOUBLE END AS adj_close_price, total_volume, v / 100.0::DOUBLE AS total_value
        FROM (SELECT n_name AS ticker, o_orderdate::DATE AS trading_date, arg_min(round(o_totalprice * 100)::BIGINT, o_orderkey) AS o, arg_max(round(o_totalprice * 100)::BIGINT, o_orderkey) AS c,
            max(round(o_totalprice * 100)::BIGINT) AS h, min(round(o_totalprice * 100)::BIGINT) AS l, count(*) AS total_volume, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
    "v_daily": """SELECT * REPLACE (nullif(ref_price, 0) AS ref_price, nullif(ceiling_price, 0) AS ceiling_price, nullif(floor_price, 0) AS floor_price), ref_price = 0 AS anomaly_ref_zero, ceiling_price = 0 AS anomaly_ceiling_zero,
        floor_price = 0 AS anomaly_floor_zero, CASE WHEN ref_price = 0 THEN 'ref_price_zero,ceiling_price_zero,floor_price_zero' END AS anomaly_reason FROM v_payload""",
    "v_price": "SELECT *, coalesce(adj_close_price, close_price) AS price, round(coalesce(adj_close_price, close_price) * 10000)::BIGINT AS ticks, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) AS rn FROM v_daily",
    "v_delta": "SELECT *, ticks - lag(ticks) OVER (PARTITION BY ticker ORDER BY trading_date) AS d FROM v_price",
    "v_features": """SELECT f.ticker, f.trading_date, f.close_price, f.price, f.ma20, f.ma50, f.ma200, CASE WHEN n14 = 14 AND loss > 0 THEN 100 - 100 / (1 + gain / loss::DOUBLE) END AS rsi_14,
        f.close_price * nullif(s.current_listed_shares, 0) AS market_cap FROM (
        SELECT ticker, trading_date, close_price, price,
            CASE WHEN count(ticks) OVER w20 = 20 THEN sum(ticks) OVER w20 / (20 * 10000.0::DOUBLE) END AS ma20, CASE WHEN count(ticks) OVER w50 = 50 THEN sum(ticks) OVER w50 / (50 * 10000.0::DOUBLE) END AS ma50,
            CASE WHEN count(ticks) OVER w200 = 200 THEN sum(ticks) OVER w200 / (200 * 10000.0::DOUBLE) END AS ma200,
            count(d) OVER w14 AS n14, sum(greatest(d, 0)) OVER w14 AS gain, sum(greatest(-d, 0)) OVER w14 AS loss
        FROM v_delta WINDOW w14 AS (PARTITION BY ticker ORDER BY trading_date ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY trading_date ROWS 19 PRECEDING),
            w50 AS (PARTITION BY ticker ORDER BY trading_date ROWS 49 PRECEDING), w200 AS (PARTITION BY ticker ORDER BY trading_date ROWS 199 PRECEDING)) f LEFT JOIN v_symbols s ON f.ticker = s.ticker""",
    "v_flags": "SELECT *, close_price > ma50 AS flag_above_ma50, rsi_14 > 70 AS flag_overbought, rsi_14 < 30 AS flag_oversold FROM v_features",
    "v_intraday": "SELECT 'U' || user_id AS ticker, date_trunc('minute', ts)::TIMESTAMP AS timestamp, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, date_trunc('minute', ts)::DATE AS trading_date FROM events GROUP BY ALL",
    "v_hits": r"""SELECT page_id::INTEGER AS position, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')), 1, 200) AS snippet,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site FROM pages""",
    "v_sections": "SELECT doc_id, (i - 1)::INTEGER AS ordinal, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) t(i) WHERE length(trim(parts[i])) > 0",
    "v_ingest": """SELECT user_id::VARCHAR AS doc_id, CASE event_type WHEN 'signup' THEN 'DISCOVERED' WHEN 'view' THEN 'DOWNLOADED' WHEN 'click' THEN 'PARSED' WHEN 'purchase' THEN 'EMBEDDED' WHEN 'error' THEN 'FAILED' END AS new_status,
        event_id, ts FROM events""",
    "v_calls": "SELECT event_type AS agent, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS status, value AS latency, ts, event_id, user_id FROM events",
    "v_questions": f"SELECT conv_id * 100 + turn AS question_id, [{_FORMS_SQL}][conv_id % {len(QUESTION_FORMS)} + 1] || ' ' || coalesce(text, '') AS question FROM conversations WHERE role = 'user'",
}


def with_views(sql: str) -> str:
    """Put the definitions of the views that a statement names, and of those they name, before it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in SQL and name not in used:
                need(SQL[name])
                used.append(name)

    need(sql)
    if not used:
        return sql
    head = ",\n".join(f"{name} AS ({SQL[name]})" for name in used)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"

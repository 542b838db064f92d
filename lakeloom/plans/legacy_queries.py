"""Registered queries for migrations, unions of results and table cells, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import views
from lakeloom.operators import documents, legacy, retrieval
from lakeloom.plans.document_queries import doc_tables
from lakeloom.plans.market_queries import features
from lakeloom.plans.question_queries import plans, results
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


@query("SELECT n_name AS ticker, CASE n_nationkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'M' ELSE 'stock' END AS market, (n_nationkey * 10)::BIGINT AS current_listed_shares FROM nation UNION ALL SELECT 'OLD', 'x', 1")
def migrate_legacy_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    old = views.table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_name").alias("symbol_name"), F.lit("").alias("symbol_eng_name"), F.lit("HOSE").alias("exchange"), F.when(n == 0, "ST").otherwise("").alias("sec_type"), F.when(n == 1, "M").alias("market_id"), (F.col("n_nationkey") * 10).cast("long").alias("listed_share"))
    target = spark.range(1).select(F.explode(F.array(F.lit("OLD"), F.lit("NATION_1"))).alias("ticker"), F.lit("a").alias("name_vi"), F.lit("b").alias("name_en"), F.lit("e").alias("exchange"), F.lit("x").alias("market"), F.lit(1).cast("long").alias("current_listed_shares"))
    return legacy.migrate_symbols(old, target).select("ticker", "market", "current_listed_shares")


@query("""SELECT ticker, trading_date, ref_price, ref_price = 0 AS anomaly_ref_zero, CASE WHEN ref_price = 0 THEN 'ref_price_zero,ceiling_price_zero,floor_price_zero' ELSE '' END AS anomaly_reason, CASE WHEN total_volume % 2 = 0 THEN close_price END AS avg_price,
    CASE WHEN total_volume % 3 > 0 THEN trading_date::TIMESTAMP + INTERVAL 3 HOUR END AS returned_at FROM v_payload""")
def migrate_legacy_daily(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("total_volume")
    old = views.daily_payload(spark, d).withColumnRenamed("ticker", "symbol").withColumns({"avg_price": F.when(v % 2 == 0, F.col("close_price")).otherwise(0.0), "source_time": F.when(v % 3 > 0, "10:00:00").otherwise("10h")})
    target = spark.createDataFrame([], "ticker string, trading_date date, ref_price double, anomaly_ref_zero boolean, anomaly_reason string, avg_price double, returned_at timestamp")
    return legacy.migrate_daily(old, target)


@query("SELECT ticker, trading_date, flag_above_ma50, flag_overbought, 'legacy_v1_migrated' AS formula_version FROM v_flags")
def migrate_legacy_features(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).withColumnRenamed("ticker", "symbol")
    old = f.withColumns({"price_above_ma50": F.coalesce("flag_above_ma50", F.lit(False)), "is_overbought": F.coalesce("flag_overbought", F.lit(False)), "is_oversold": F.coalesce("flag_oversold", F.lit(False))})
    target = spark.createDataFrame([], "ticker string, trading_date date, flag_above_ma50 boolean, flag_overbought boolean, formula_version string")
    return legacy.migrate_features(old.drop("flag_above_ma50", "flag_overbought", "flag_oversold"), target)


@query("SELECT 'U' || user_id AS ticker, date_trunc('second', ts) - INTERVAL 7 HOUR AS timestamp, max(value) AS close FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def migrate_legacy_intraday(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    clock = F.when(F.col("event_type") != "error", F.date_format("ts", "HH:mm:ss"))
    old = e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.to_date("ts").alias("trading_date"), clock.alias("bar_time")).agg(F.max("value").alias("close"))
    return legacy.migrate_intraday(old, spark.createDataFrame([], "ticker string, timestamp timestamp, close double"))


@query("SELECT question_id, 'market' AS tool_name, 0 AS tool_order FROM v_plan UNION ALL SELECT question_id, 'news', 1 FROM v_results WHERE role = 'user' UNION ALL SELECT question_id, 'financial_reports', 2 FROM v_results WHERE role = 'assistant'")
def union_tool_results(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return legacy.union_tool_results(plans(spark, d).select("question_id"), r.filter("role = 'user'").select("question_id"), r.filter("role = 'assistant'").select("question_id"))


@query("SELECT l_orderkey AS doc_id, '1.234.567' AS newest FROM v_lines")
def extract_row_values(spark: SparkSession, d: str) -> DataFrame:
    """A metric's row found in tables with two header rows, a code column and two dated columns."""
    line = lambda *cells: F.array(*map(F.lit, cells))
    lines = F.concat(F.array(line("", "note", "Triệu VND"), line("", "", "30.6.2025", "31.12.2024")), F.transform("rows", lambda r: r), F.array(line("Tổng tài sản", "12", "1.234.567", "1.000.000")))
    t = doc_tables(spark, d).select(F.col("l_orderkey").alias("doc_id"), lines.alias("lines"))
    return retrieval.extract_row_values(t, "tong tai san").select("doc_id", F.get("row_values", F.lit(0))["value"].alias("newest"))


@query("""SELECT doc_id, contains(f, 'tong tai san') OR contains(f, 'total assets') AS has_metric FROM (SELECT doc_id, lower(strip_accents(replace(replace(replace(left(t, length(t) // 2) || CASE doc_id % 4 WHEN 0 THEN ' TỔNG tài sản ' WHEN 1 THEN ' Total Assets: 5 ' WHEN 2 THEN ' tong  tai san ' ELSE '' END || substr(t, length(t) // 2 + 1), 'đ', 'd'), 'Đ', 'D'), 'ß', 'ss'))) AS f
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def table_has_metric(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with the metric's names, and one that is not quite a name, put into their middle."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    put = F.when(k == 0, " TỔNG tài sản ").when(k == 1, " Total Assets: 5 ").when(k == 2, " tong  tai san ").otherwise("")
    half = F.floor(F.length(t) / 2).cast("int")
    text = F.concat(F.substring(t, F.lit(1), half), put, F.substring(t, half + 1, F.length(t)))
    return views.table(spark, d, "documents").select("doc_id", retrieval.table_has_metric(text, "tong tai san").alias("has_metric"))


@query("SELECT doc_id, (doc_id % 10 + 1)::INTEGER AS page, 'text' AS chunk_type, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 3 END AS heading_level FROM documents")
def normalize_provider_chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    box = F.array(F.struct((i % 10).cast("int").alias("page"), F.array(F.lit(0.0), F.lit(1.0)).alias("box")))
    c = views.table(spark, d, "documents").select("doc_id", F.lit("TEXT").alias("chunk_type"), F.when(i % 3 == 0, 2).alias("level"), F.when(i % 3 == 1, "### head").otherwise("plain").alias("text"), box.alias("grounding"))
    return documents.normalize_provider_chunks(c).select("doc_id", "page", "chunk_type", "heading_level")

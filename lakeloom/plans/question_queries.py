"""Registered queries over question and result tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import views
from lakeloom.operators import questions as k
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


def _list(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"


def _once(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(folded, '{w}')" for w in words) + ")"


views.SQL["v_q"] = "SELECT question_id, question, strip_accents(replace(lower(question), 'đ', 'd')) AS folded FROM v_questions"
_TICKERS = "list_concat(" + _list((f"regexp_matches(upper(question), '\\b{s}\\b')", s) for s in k.SYMBOLS) + ", " + _list((f"contains(folded, '{a}')", s) for a, s, _ in k.ALIASES) + ")"
views.SQL["v_tagged"] = f"""SELECT *, {_once("t0")} AS tickers, {_once("c0")} AS company_names, {_once("d0")} AS explicit_dates, try_cast(nullif(regexp_extract(question, '\\b(20\\d{{2}})\\b', 1), '') AS INTEGER) AS year,
    try_cast(coalesce(nullif(regexp_extract(question, '(?i)\\bq([1-4])\\b', 1), ''), nullif(regexp_extract(folded, 'quy\\s*([1-4])', 1), ''), nullif(regexp_extract(folded, 'quarter\\s*([1-4])', 1), '')) AS INTEGER) AS quarter FROM (
    SELECT *, {_TICKERS} AS t0, {_list((f"contains(folded, '{a}')", n) for a, _, n in k.ALIASES)} AS c0, list_concat(regexp_extract_all(question, '\\b\\d{{2}}/\\d{{2}}/\\d{{4}}\\b'), regexp_extract_all(question, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')) AS d0 FROM v_q)"""
views.SQL["v_plan0"] = f"""SELECT *, {_any(k.CURRENT)} AS is_current, {_any(k.COMPARISON)} OR len(explicit_dates) >= 2 AS is_comparison, {_any(k.TECHNICAL)} AS is_technical, {_any(k.HEALTH)} AS is_health,
    len(explicit_dates) > 0 OR contains(folded, 'tu dau nam') OR contains(folded, 'lich su') AS is_historical, {_any(k.NEWS)} AS is_news, {_any(k.METRICS)} AS asks_metric,
    ({_any(k.METRICS)} OR {_any(k.REPORTS)}) AND ({_any(k.REPORTS)} OR year IS NOT NULL OR quarter IS NOT NULL OR regexp_matches(question, '\\d{{1,2}}[/.]\\d{{1,2}}[/.]?\\d{{2,4}}') OR contains(folded, '6 thang') OR contains(folded, 'giua nien do')) AS needs,
    {_any(k.REPORTS)} OR {_any(k.METRICS)} AS is_reports FROM v_tagged"""
views.SQL["v_plan1"] = f"SELECT *, {_any(k.MARKET)} OR is_health OR (NOT is_news AND NOT is_reports AND (is_current OR is_comparison OR is_technical OR is_historical OR len(tickers) > 0 OR len(company_names) > 0)) AS is_market FROM v_plan0"
views.SQL["v_plan"] = f"""SELECT *, {_list((("is_market", "market"), ("is_news", "news"), ("is_reports", "financial_reports")))} AS branches,
    CASE WHEN is_news AND NOT is_market THEN 'news' WHEN is_reports AND NOT is_market THEN 'financial_reports' WHEN is_market THEN 'market' ELSE 'unknown' END AS primary_intent FROM v_plan1"""
views.SQL["v_results"] = """SELECT conv_id + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS question_id, turn + CASE WHEN conv_id % 7 = 0 THEN 100000 ELSE 0 END AS ordinal, CASE (conv_id + turn) % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'no_data' WHEN 2 THEN 'error' WHEN 3 THEN 'not_supported_yet' ELSE 'success' END AS status, role, text FROM conversations"""


def plans(spark: SparkSession, d: str) -> DataFrame:
    return k.classify_intent(views.questions(spark, d))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Turns as results; those of every seventh conversation come after the next one's, so that its question has none."""
    n, moved = (F.col("conv_id") + F.col("turn")) % 5, F.col("conv_id") % 7 == 0
    status = F.when(n == 1, "no_data").when(n == 2, "error").when(n == 3, "not_supported_yet").otherwise("success")
    place = (F.col("conv_id") + F.when(moved, 1).otherwise(0)).alias("question_id"), (F.col("turn") + F.when(moved, 100000).otherwise(0)).alias("ordinal")
    return views.table(spark, d, "conversations").select(*place, status.alias("status"), "role", "text")


@query("SELECT question_id, tickers FROM v_tagged")
def tag_tickers(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(spark, d).select("question_id", k.tag_tickers(F.col("question")).alias("tickers"))


@query("SELECT question_id, company_names FROM v_tagged")
def tag_companies(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(spark, d).select("question_id", k.tag_companies(F.col("question")).alias("company_names"))


@query("SELECT question_id, year, quarter FROM v_tagged")
def tag_period(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(spark, d).select("question_id", k.report_year(F.col("question")).alias("year"), k.report_quarter(F.col("question")).alias("quarter"))


@query("SELECT question_id, needs FROM v_plan0")
def needs_reports(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(spark, d).select("question_id", k.needs_reports(F.col("question")).alias("needs"))


@query(f"""SELECT question_id, branches, primary_intent, CASE WHEN primary_intent = 'unknown' THEN 0.25::DOUBLE WHEN primary_intent = 'market' AND len(branches) = 1 THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END AS confidence, is_current, is_comparison, is_technical, is_historical,
    {_list((("is_current", "current_session"), ("contains(folded, 'tu dau nam')", "year_to_date"), ("contains(folded, 'tu dau thang')", "month_to_date")))} AS relative_periods FROM v_plan""")
def classify_intent(spark: SparkSession, d: str) -> DataFrame:
    return plans(spark, d).select("question_id", "branches", "primary_intent", "confidence", "is_current", "is_comparison", "is_technical", "is_historical", "relative_periods")


@query("""SELECT question_id, branch, CASE branch
    WHEN 'market' THEN CASE WHEN tickers[1] IS NULL THEN question WHEN is_technical THEN 'technical indicators for ' || tickers[1] WHEN is_current THEN 'giá hiện tại của ' || tickers[1] ELSE 'dữ liệu thị trường của ' || tickers[1] END
    WHEN 'news' THEN coalesce('tin tức ' || coalesce(tickers[1], company_names[1]) || ' mới nhất', question)
    ELSE CASE WHEN tickers[1] IS NULL OR asks_metric THEN question ELSE coalesce(tickers[1] || ' reviewed financial statements Q' || quarter || ' ' || year || ' opinion', 'financial report for ' || tickers[1]) END END AS branch_query
    FROM (SELECT *, unnest(branches) AS branch FROM v_plan)""")
def branch_queries(spark: SparkSession, d: str) -> DataFrame:
    return k.branch_queries(plans(spark, d)).select("question_id", "branch", "branch_query")


@query("SELECT question_id, branch, branch IN ('market', 'news') AS supported FROM (SELECT question_id, unnest(CASE WHEN is_news AND NOT is_market AND NOT is_reports THEN ['news'] ELSE branches END) AS branch FROM v_plan)")
def route_questions(spark: SparkSession, d: str) -> DataFrame:
    enabled = views.table(spark, d, "region").select(F.when(F.col("r_regionkey") % 2 == 0, "market").otherwise("news").alias("branch")).distinct()
    yes, no = k.route_questions(plans(spark, d), enabled)
    return yes.withColumn("supported", F.lit(True)).unionByName(no.withColumn("supported", F.lit(False)))


@query("""SELECT q.question_id, CASE WHEN ok IS NULL THEN CASE WHEN q.question_id % 3 = 0 THEN 'no_route' WHEN q.question_id % 2 = 0 THEN 'error' ELSE 'no_data' END
    WHEN ok THEN CASE WHEN none OR bad OR un THEN 'partial_success' ELSE 'success' END WHEN none THEN CASE WHEN bad OR un THEN 'partial_no_data' ELSE 'no_data' END WHEN un THEN 'not_supported_yet' ELSE 'error' END AS status
    FROM (SELECT DISTINCT conv_id AS question_id FROM conversations) q LEFT JOIN (SELECT question_id, bool_or(status = 'success') AS ok, bool_or(status = 'no_data') AS none, bool_or(status = 'error') AS bad, bool_or(status = 'not_supported_yet') AS un FROM v_results GROUP BY 1) USING (question_id)""")
def rollup_status(spark: SparkSession, d: str) -> DataFrame:
    q = views.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id")).distinct()
    q = q.withColumns({"selected": (F.col("question_id") % 3 != 0).cast("int"), "errors": (F.col("question_id") % 2 == 0).cast("int")})
    return k.rollup_status(q, results(spark, d))


@query("""WITH e AS (SELECT question_id, role AS tool_name, status AS kind, substr(coalesce(text, ''), 1, 3) AS source_ref, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS tool_order, ordinal FROM v_results),
    f AS (SELECT *, row_number() OVER (PARTITION BY question_id, tool_name, kind, source_ref ORDER BY tool_order, ordinal) AS n FROM e)
    SELECT * FROM (SELECT question_id, tool_name, kind, source_ref, ordinal, row_number() OVER (PARTITION BY question_id ORDER BY tool_order, ordinal)::INTEGER AS rank FROM f WHERE n = 1) WHERE rank <= 3""")
def evidence_topn(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    e = results(spark, d).select("question_id", F.col("role").alias("tool_name"), F.col("status").alias("kind"), F.substring(F.coalesce("text", F.lit("")), 1, 3).alias("source_ref"), order.alias("tool_order"), "ordinal")
    return k.evidence_topn(e, 3).drop("tool_order")


views.SQL["v_limits"] = "SELECT question_id, ordinal AS position, CASE ordinal % 4 WHEN 0 THEN 'Không có dữ liệu' WHEN 1 THEN 'khong co du lieu' WHEN 2 THEN 'Lỗi ' || status ELSE '' END AS text FROM v_results"


@query("""SELECT question_id, min(position) AS position, arg_min(text, (CASE WHEN lower(text) = strip_accents(replace(lower(text), 'đ', 'd')) THEN 1 ELSE 0 END, position)) AS text FROM v_limits WHERE trim(text) <> ''
    GROUP BY question_id, trim(regexp_replace(strip_accents(replace(lower(text), 'đ', 'd')), '\\s+', ' ', 'g'))""")
def limitations_dedupe(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("ordinal") % 4
    text = F.when(n == 0, "Không có dữ liệu").when(n == 1, "khong co du lieu").when(n == 2, F.concat(F.lit("Lỗi "), F.col("status"))).otherwise("")
    return k.dedupe_limitations(results(spark, d).select("question_id", F.col("ordinal").alias("position"), text.alias("text")))


@query("""SELECT question_id, CASE WHEN m IS NOT NULL AND NOT list_contains(tickers, m) THEN list_append(tickers, m) ELSE tickers END AS tickers, coalesce(sites, []) AS sites FROM v_plan
    LEFT JOIN (SELECT conv_id * 100 + turn AS question_id, arg_min(status, ordinal) AS m FROM (SELECT *, question_id AS conv_id, ordinal AS turn FROM v_results) GROUP BY 1) USING (question_id)
    LEFT JOIN (SELECT question_id * 100 + ordinal AS question_id, list_sort(list(DISTINCT role)) AS sites FROM v_results GROUP BY 1) USING (question_id)""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("question_id", F.col("question_id") * 100 + F.col("ordinal"))
    return k.merge_entities(plans(spark, d), r.select("question_id", F.col("status").alias("ticker"), "ordinal"), r.select("question_id", F.col("role").alias("site")))


@query("""SELECT question_id, CASE WHEN regexp_matches(folded, 'co nen mua|nen mua|nen ban|dau tu|should i buy|invest') THEN 'investment_outlook' WHEN coalesce(n, 0) >= 2 THEN 'multi_source' WHEN is_comparison THEN 'comparison' ELSE 'concise' END AS style
    FROM v_plan LEFT JOIN (SELECT question_id * 100 AS question_id, count(*) FILTER (WHERE status = 'success') AS n FROM v_results GROUP BY 1) USING (question_id)""")
def answer_style(spark: SparkSession, d: str) -> DataFrame:
    return k.answer_style(plans(spark, d), results(spark, d).withColumn("question_id", F.col("question_id") * 100))


@query("""SELECT user_id AS question_id, (row_number() OVER w - 1)::INTEGER AS step, event_type AS name, epoch_us(ts)::BIGINT AS at, (epoch_us(ts) - lag(epoch_us(ts)) OVER w)::BIGINT AS latency FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_type)""".replace(" AS at", ' AS "at"'))
def trace_events(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").groupBy(F.col("user_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("name")))).alias("trace"))
    return k.trace_events(e)

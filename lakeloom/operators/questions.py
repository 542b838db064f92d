"""Question tables: tagging, intent, routing; result tables: status, evidence, limitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import any_of, extract_dates, norm_free, squeeze

# Symbols, aliases and keyword lists. Keywords are matched against folded text, so only the folded
# spellings can match.
SYMBOLS = ("ACB", "BCM", "BID", "BVH", "CTG", "FPT", "GAS", "GVR", "HDB", "HPG", "MBB", "MSN", "MWG", "PLX", "POW", "SAB", "SHB", "SSB", "SSI", "STB", "TCB", "TPB", "VCB", "VHM", "VIB", "VIC", "VJC", "VNM", "VPB", "VRE", "VND", "VIX", "PVS", "PVD", "NLG", "KDH", "DXG", "DIG", "KBC", "DCM", "DPM", "REE", "GEX", "EIB", "OCB", "LPB", "SCS", "CTR", "BSR", "IDC")
ALIASES = (
    ("acb", "ACB", "Asia Commercial Bank"), ("ngan hang a chau", "ACB", "Asia Commercial Bank"), ("ngan hang tmcp a chau", "ACB", "Asia Commercial Bank"), ("asia commercial bank", "ACB", "Asia Commercial Bank"),
    ("techcombank", "TCB", "Techcombank"), ("hoa phat", "HPG", "Hòa Phát"), ("ssi", "SSI", "SSI Securities"), ("fpt", "FPT", "FPT"), ("vinamilk", "VNM", "Vinamilk"),
)
MARKET = ("gia", "price", "current price", "co phieu", "stock price", "share price", "thi truong", "ma50", "ma20", "ma200", "macd", "rsi", "chi bao", "khoi luong", "phan tram", "%", "phien truoc", "tang giam", "bien dong gia")
NEWS = ("tin", "tin moi nhat", "tin gan day", "tin tuc", "ban tin", "news", "headline", "bao chi")
REPORTS = (
    "bao cao tai chinh", "financial report", "financial statements", "bctc", "ket qua kinh doanh", "bao cao thuong nien", "annual report", "review opinion", "audit opinion", "review conclusion", "soat xet", "kiem toan",
    "y kien soat xet", "y kien kiem toan", "unqualified review opinion", "doanh thu", "loi nhuan", "eps", "bao cao ket qua hoat dong", "ket qua hoat dong kinh doanh", "giua nien do", "sau 6 thang", "6 thang dau nam",
    "bang can doi", "thuyet minh",
)
METRICS = (
    "tong tai san", "cho vay khach hang", "tien gui cua khach hang", "loi nhuan sau thue", "chi phi du phong", "rui ro tin dung", "thu nhap luan", "lai thuan", "total assets", "customer loans", "customer deposits",
    "profit after tax", "provision expense", "credit risk",
)
CURRENT = ("hien tai", "current", "hom nay", "moi nhat", "latest", "intraday", "trong phien")
COMPARISON = ("so sanh", "chenh", "so voi")
TECHNICAL = ("ma20", "ma50", "ma200", "macd", "rsi", "chi bao", "technical")
HEALTH = ("health", "debug", "trace", "router", "classifier", "status")


def _present(pairs) -> Column:
    """The values whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(v)) for c, v in pairs)), lambda x: x.isNotNull())


def tag_tickers(question: Column, symbols: tuple[str, ...] = SYMBOLS) -> Column:
    """Tracked symbols at word boundaries in list order, then those of aliases."""
    upper, folded = F.upper(question), norm_free(question)
    return F.array_distinct(F.concat(_present((F.rlike(upper, F.lit(rf"\b{s}\b")), s) for s in symbols), _present((F.contains(folded, F.lit(a)), s) for a, s, _ in ALIASES)))


def tag_companies(question: Column) -> Column:
    folded = norm_free(question)
    return F.array_distinct(_present((F.contains(folded, F.lit(a)), n) for a, _, n in ALIASES))


def report_year(question: Column) -> Column:
    return F.regexp_extract(question, r"\b(20\d{2})\b", 1).try_cast("int")


def report_quarter(question: Column) -> Column:
    folded = norm_free(question)
    return F.coalesce(*(F.regexp_extract(c, p, 1).try_cast("int") for c, p in ((question, r"(?i)\bq([1-4])\b"), (folded, r"quy\s*([1-4])"), (folded, r"quarter\s*([1-4])"))))


def needs_reports(question: Column) -> Column:
    """A metric or report keyword, and a filing context."""
    folded = norm_free(question)
    report = any_of(folded, REPORTS)
    context = report | report_year(question).isNotNull() | report_quarter(question).isNotNull() | F.rlike(question, F.lit(r"\d{1,2}[/.]\d{1,2}[/.]?\d{2,4}")) | any_of(folded, ("6 thang", "giua nien do"))
    return (any_of(folded, METRICS) | report) & context


def classify_intent(questions: DataFrame) -> DataFrame:
    """The rule-based plan of each question: entities, flags, branches, primary intent, confidence, periods."""
    q = F.col("question")
    rows = questions.withColumns({"folded": norm_free(q), "tickers": tag_tickers(q), "company_names": tag_companies(q), "explicit_dates": extract_dates(q), "year": report_year(q), "quarter": report_quarter(q)})
    c, dated = F.col("folded"), F.size("explicit_dates")
    rows = rows.withColumns(
        {
            "is_current": any_of(c, CURRENT),
            "is_comparison": any_of(c, COMPARISON) | (dated >= 2),
            "is_technical": any_of(c, TECHNICAL),
            "is_health": any_of(c, HEALTH),
            "is_historical": (dated > 0) | any_of(c, ("tu dau nam", "lich su")),
            "is_news": any_of(c, NEWS),
            "asks_metric": any_of(c, METRICS),
        }
    )
    rows = rows.withColumn("is_reports", needs_reports(q) | any_of(c, REPORTS) | F.col("asks_metric"))
    entity = (F.size("tickers") > 0) | (F.size("company_names") > 0)
    other = F.col("is_current") | F.col("is_comparison") | F.col("is_technical") | F.col("is_historical") | entity
    rows = rows.withColumn("is_market", any_of(c, MARKET) | F.col("is_health") | (~F.col("is_news") & ~F.col("is_reports") & other))
    market, news, reports = F.col("is_market"), F.col("is_news"), F.col("is_reports")
    rows = rows.withColumn("branches", _present(((market, "market"), (news, "news"), (reports, "financial_reports"))))
    rows = rows.withColumn("primary_intent", F.when(news & ~market, "news").when(reports & ~market, "financial_reports").when(market, "market").otherwise("unknown"))
    rows = rows.withColumn("confidence", F.when(F.col("primary_intent") == "unknown", 0.25).when((F.col("primary_intent") == "market") & (F.size("branches") == 1), 0.85).otherwise(0.8))
    periods = _present(((F.col("is_current"), "current_session"), (F.contains(c, F.lit("tu dau nam")), "year_to_date"), (F.contains(c, F.lit("tu dau thang")), "month_to_date")))
    return rows.withColumns({"relative_periods": periods, "normalized_query": squeeze(q)}).drop("folded")


def branch_queries(plans: DataFrame) -> DataFrame:
    """One row for each question and branch with the query derived for it."""
    ticker, company, q = F.get("tickers", F.lit(0)), F.get("company_names", F.lit(0)), F.col("question")
    market = F.when(ticker.isNull(), q).when(F.col("is_technical"), F.concat(F.lit("technical indicators for "), ticker)).when(F.col("is_current"), F.concat(F.lit("giá hiện tại của "), ticker)).otherwise(F.concat(F.lit("dữ liệu thị trường của "), ticker))
    news = F.coalesce(F.concat(F.lit("tin tức "), F.coalesce(ticker, company), F.lit(" mới nhất")), q)
    opinion = F.concat(ticker, F.lit(" reviewed financial statements Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"), F.lit(" opinion"))
    reports = F.when(ticker.isNull() | F.col("asks_metric"), q).otherwise(F.coalesce(F.when(F.col("is_reports"), opinion), F.concat(F.lit("financial report for "), ticker)))
    b = F.col("branch")
    return plans.withColumn("branch", F.explode("branches")).withColumn("branch_query", F.when(b == "market", market).when(b == "news", news).when(b == "financial_reports", reports).otherwise(q))


def route_questions(plans: DataFrame, enabled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """question_id, branch for the enabled branches (the primary intent when a plan has none), and the unsupported ones."""
    wanted = F.when(F.size("branches") > 0, F.col("branches")).when(F.col("primary_intent") != "unknown", F.array("primary_intent")).otherwise(F.array().cast("array<string>"))
    news_only = F.col("is_news") & ~F.col("is_market") & ~F.col("is_reports")
    rows = plans.withColumn("wanted", F.when(news_only, F.array(F.lit("news"))).otherwise(wanted)).select("question_id", F.explode("wanted").alias("branch"))
    return rows.join(enabled, "branch", "left_semi"), rows.join(enabled, "branch", "left_anti")


def rollup_status(questions: DataFrame, results: DataFrame) -> DataFrame:
    """One status for each question from its results'; ``questions`` has selected (branches chosen) and errors counts."""
    has = lambda s: F.bool_or(F.col("status") == s)
    seen = results.groupBy("question_id").agg(has("success").alias("ok"), has("no_data").alias("none"), has("error").alias("bad"), has("not_supported_yet").alias("unsupported"))
    rows = questions.join(seen, "question_id", "left")
    ok, none, bad, unsupported = F.col("ok"), F.col("none"), F.col("bad"), F.col("unsupported")
    status = (
        F.when(ok.isNull() & (F.col("selected") > 0), F.when(F.col("errors") > 0, "error").otherwise("no_data"))
        .when(ok.isNull(), "no_route")
        .when(ok, F.when(none | bad | unsupported, "partial_success").otherwise("success"))
        .when(none, F.when(bad | unsupported, "partial_no_data").otherwise("no_data"))
        .when(unsupported, "not_supported_yet")
        .otherwise("error")
    )
    return rows.select("question_id", status.alias("status"))


def evidence_topn(evidence: DataFrame, n: int = 10) -> DataFrame:
    """The first row of each (tool, kind, source) of a question, then the first ``n`` in tool order."""
    first = Window.partitionBy("question_id", "tool_name", "kind", "source_ref").orderBy("tool_order", "ordinal")
    order = Window.partitionBy("question_id").orderBy("tool_order", "ordinal")
    rows = evidence.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def dedupe_limitations(items: DataFrame) -> DataFrame:
    """Limitations equal but for marks and case are one: at the first's place, in a marked spelling if there is one."""
    fold = squeeze(norm_free(F.col("text")))
    plain = F.lower(F.col("text")) == norm_free(F.col("text"))
    out = items.filter(F.trim("text") != "").groupBy("question_id", fold.alias("fold")).agg(F.min("position").alias("position"), F.min_by("text", F.struct(plain.cast("int").alias("plain"), "position")).alias("text"))
    return out.drop("fold")


def merge_entities(plans: DataFrame, market: DataFrame, news: DataFrame) -> DataFrame:
    """Tickers of the plan and of the market result, in that order; the sorted sites of the news result."""
    m = market.groupBy("question_id").agg(F.min_by("ticker", "ordinal").alias("_ticker"))
    s = news.groupBy("question_id").agg(F.sort_array(F.collect_set("site")).alias("sites"))
    empty = F.array().cast("array<string>")
    rows = plans.join(m, "question_id", "left").join(s, "question_id", "left")
    more = F.when(F.col("_ticker").isNotNull(), F.array("_ticker")).otherwise(empty)
    return rows.select("question_id", F.array_union("tickers", more).alias("tickers"), F.coalesce("sites", empty).alias("sites"))


def answer_style(plans: DataFrame, results: DataFrame) -> DataFrame:
    """Investment questions, then several successful branches, then comparisons; else concise."""
    n = results.groupBy("question_id").agg(F.count_if(F.col("status") == "success").alias("successes"))
    invest = any_of(norm_free(F.col("question")), ("co nen mua", "nen mua", "nen ban", "dau tu", "should i buy", "invest"))
    style = F.when(invest, "investment_outlook").when(F.coalesce("successes", F.lit(0)) >= 2, "multi_source").when(F.col("is_comparison"), "comparison").otherwise("concise")
    return plans.join(n, "question_id", "left").select("question_id", style.alias("style"))


def trace_events(traces: DataFrame) -> DataFrame:
    """One row for each step of a question's trace, with the time since the step before."""
    rows = traces.select("question_id", F.posexplode("trace").alias("step", "event")).select("question_id", "step", "event.*")
    w = Window.partitionBy("question_id").orderBy("step")
    return rows.withColumn("latency", F.col("at") - F.lag("at").over(w))

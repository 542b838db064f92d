"""Registered queries over text, URL and date expressions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import views
from lakeloom.functions import text as t
from lakeloom.functions.sql import register as register_functions
from lakeloom.views import with_views

QUERIES = {}
ORACLES = {}

_HOST = "CASE regexp_replace(lower(trim({0})), '^www\\.', '') WHEN 'vnxpress' THEN 'vnexpress.net' WHEN 'vnxpress.net' THEN 'vnexpress.net' WHEN 'vnexpress' THEN 'vnexpress.net' WHEN 'e.vnexpress.net' THEN 'vnexpress.net' ELSE regexp_replace(lower(trim({0})), '^www\\.', '') END"
views.SQL["v_url"] = f"""SELECT page_id, url, scheme || '://' || {_HOST.format("host")} || CASE regexp_replace(path, '/+$', '') WHEN '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canon, host FROM (
    SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
        array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '{t.TRACKING}')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS q FROM pages)"""
views.SQL["v_dated"] = """SELECT page_id, url, title, snippet, CASE page_id % 6 WHEN 0 THEN '2024-05-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN (page_id % 28 + 1) || '/3/2024' WHEN 2 THEN '2024/2/30' WHEN 3 THEN 'on ' || (page_id % 31 + 1) || '-4-2025, late'
    WHEN 4 THEN '2024-06-01T10:20:30' ELSE '' END AS raw, CASE page_id % 5 WHEN 0 THEN 'https://cafef.vn/a-18824' || lpad((page_id % 14)::VARCHAR, 2, '0') || lpad((page_id % 33)::VARCHAR, 2, '0') || '181.chn' WHEN 1 THEN 'https://vietstock.vn/2024/' || (page_id % 14) || '/x.htm'
    WHEN 2 THEN 'https://thanhnien.vn/b-18525' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '.htm' WHEN 3 THEN 'https://x.vn/2023/07/' || lpad((page_id % 33)::VARCHAR, 2, '0') || '/z' ELSE 'https://x.vn/n/' || (20240100 + page_id % 40) END AS u
    FROM (SELECT position AS page_id, url, title, snippet FROM v_hits)"""
#: A date from three texts, null unless it is one.
_D = "try_strptime({0} || '-' || {1} || '-' || {2}, '%Y-%m-%d')::DATE"
_G = "nullif(regexp_extract({0}, '{1}', {2}), '')"


def _g(c: str, pattern: str, *order: int, century: bool = False) -> str:
    y, m, d = (_G.format(c, pattern, i) if i else "'1'" for i in order)
    return _D.format(f"'20' || {y}" if century else y, m, d)


_URL_DATE = "coalesce(" + ", ".join((_g("u", r"188(\d{2})(\d{2})(\d{2})", 1, 2, 3, century=True), _g("u", r"/(20\d{2})/(\d{1,2})(?:/|$)", 1, 2, 0), _g("u", r"185(\d{2})(\d{2})(\d{2})", 1, 2, 3, century=True))) + ")"
_TITLE_DATE = _g("{0}", r"\b(\d{{1,2}})[/-](\d{{1,2}})[/-](20\d{{2}})\b", 3, 2, 1)
_FLEX = """coalesce(CASE WHEN regexp_matches(raw, '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN try_strptime(raw, '%Y-%m-%d') END, CASE WHEN regexp_matches(raw, '^\\d{1,2}/\\d{1,2}/\\d{4}$') THEN try_strptime(raw, '%d/%m/%Y') END,
    CASE WHEN regexp_matches(raw, '^\\d{4}/\\d{1,2}/\\d{1,2}$') THEN try_strptime(raw, '%Y/%m/%d') END, CASE WHEN regexp_matches(raw, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') THEN try_cast(raw AS TIMESTAMP) END, """ + _TITLE_DATE.format("raw") + "::TIMESTAMP)"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return register


def pages(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", "url")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Hits with dates in the forms that sites use, in a raw date and in the URL."""
    n, text = F.col("page_id"), lambda c: c.cast("string")
    two = lambda c: F.lpad(text(c), 2, "0")
    raw = (
        F.when(n % 6 == 0, F.concat(F.lit("2024-05-"), two(n % 28 + 1)))
        .when(n % 6 == 1, F.concat(text(n % 28 + 1), F.lit("/3/2024")))
        .when(n % 6 == 2, "2024/2/30")
        .when(n % 6 == 3, F.concat(F.lit("on "), text(n % 31 + 1), F.lit("-4-2025, late")))
        .when(n % 6 == 4, "2024-06-01T10:20:30")
        .otherwise("")
    )
    u = (
        F.when(n % 5 == 0, F.concat(F.lit("https://cafef.vn/a-18824"), two(n % 14), two(n % 33), F.lit("181.chn")))
        .when(n % 5 == 1, F.concat(F.lit("https://vietstock.vn/2024/"), text(n % 14), F.lit("/x.htm")))
        .when(n % 5 == 2, F.concat(F.lit("https://thanhnien.vn/b-18525"), two(n % 12 + 1), two(n % 28 + 1), F.lit(".htm")))
        .when(n % 5 == 3, F.concat(F.lit("https://x.vn/2023/07/"), two(n % 33), F.lit("/z")))
        .otherwise(F.concat(F.lit("https://x.vn/n/"), text(20240100 + n % 40)))
    )
    return views.hits(spark, d).withColumnRenamed("position", "page_id").withColumns({"raw": raw, "u": u})


@query("SELECT page_id, canon FROM v_url")
def canonicalize_url(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", t.canonicalize_url(F.col("url")).alias("canon"))


@query(f"SELECT page_id, {_HOST.format('host')} AS host FROM v_url")
def normalize_host(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", t.normalize_host(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"))


@query("SELECT page_id, sha256(canon) AS url_hash, sha256(html) AS content_hash FROM v_url JOIN pages USING (page_id)")
def url_and_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", t.url_hash(F.col("url")).alias("url_hash"), t.content_hash(F.col("html")).alias("content_hash"))


views.SQL["v_article"] = """SELECT page_id, u, regexp_replace(string_split(substr(u, instr(u, 'cafef.vn') + 8), '?')[1], '/+$', '') AS path FROM (
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://cafef.vn/tag/fpt-' || page_id WHEN 1 THEN 'https://cafef.vn/loi-nhuan-fpt-tang-manh-trong-quy-hai' WHEN 2 THEN 'https://cafef.vn/tin-' || (page_id + 100000) || '.chn'
        WHEN 3 THEN 'https://cafef.vn/ngan' ELSE 'https://other.vn/mot-bai-viet-that-dai-khong-thuoc-trang' END AS u FROM pages)"""


@query(rf"""SELECT page_id, length(u) >= 25 AND contains(u, 'cafef.vn') AND length(path) >= 5 AND NOT regexp_matches(lower(path), '{t.NOT_ARTICLES_INSIDE}') AND NOT regexp_matches(path, '{t.NOT_ARTICLES}')
    AND (regexp_matches(path, '\d{{5,}}') OR (contains(string_split(path, '/')[-1], '-') AND length(string_split(path, '/')[-1]) >= 25)) AS is_article FROM v_article""")
def is_article_url(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    u = (
        F.when(n % 5 == 0, F.concat(F.lit("https://cafef.vn/tag/fpt-"), n.cast("string")))
        .when(n % 5 == 1, "https://cafef.vn/loi-nhuan-fpt-tang-manh-trong-quy-hai")
        .when(n % 5 == 2, F.concat(F.lit("https://cafef.vn/tin-"), (n + 100000).cast("string"), F.lit(".chn")))
        .when(n % 5 == 3, "https://cafef.vn/ngan")
        .otherwise("https://other.vn/mot-bai-viet-that-dai-khong-thuoc-trang")
    )
    return pages(spark, d).select("page_id", t.is_article_url(u, F.lit("www.cafef.vn")).alias("is_article"))


@query(f"SELECT page_id, {_URL_DATE} AS published FROM v_dated")
def url_publish_date(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("page_id", t.url_publish_date(F.col("u")).alias("published"))


@query(f"SELECT page_id, {_TITLE_DATE.format('raw')} AS published FROM v_dated")
def title_publish_date(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("page_id", t.title_publish_date(F.col("raw")).alias("published"))


@query(f"SELECT page_id, {_FLEX} AS published FROM v_dated")
def flexible_date(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("page_id", t.flexible_date(F.col("raw")).alias("published"))


@query(f"SELECT page_id, greatest({_FLEX}, {_URL_DATE}::TIMESTAMP) AS published, coalesce(epoch(greatest({_FLEX}, {_URL_DATE}::TIMESTAMP))::BIGINT, 0) AS recency FROM v_dated")
def resolve_published_at(spark: SparkSession, d: str) -> DataFrame:
    args = F.col("raw"), F.col("u"), F.lit(""), F.lit(None).cast("string")
    return dated(spark, d).select("page_id", t.resolve_published_at(*args).alias("published"), t.recency_timestamp(*args).alias("recency"))


_IN_URL = r"""coalesce(try_strptime(nullif(regexp_extract(u, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)', 1), '') || '-' || regexp_extract(u, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)', 2) || '-' || regexp_extract(u, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)', 3), '%Y-%m-%d')::DATE,
    try_strptime('20' || nullif(regexp_extract(u, '(?:^|\D)(\d{6})(?:\D|$)', 1), ''), '%Y%m%d')::DATE, try_strptime(nullif(regexp_extract(u, '(?:^|\D)(20\d{6})(?:\D|$)', 1), ''), '%Y%m%d')::DATE, """


@query("SELECT page_id, " + _IN_URL + _TITLE_DATE.format("raw") + ", " + _g("raw", r"\b(20\d{2})[/-](\d{1,2})[/-](\d{1,2})\b", 1, 2, 3) + ") AS published FROM v_dated")
def infer_article_datetime(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("page_id", t.infer_article_datetime(F.col("u"), F.col("raw"), F.lit(""), F.lit("")).alias("published"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts - INTERVAL 1 MINUTE * (event_id % 50) WHEN 1 THEN ts - INTERVAL 1 HOUR * (event_id % 50) WHEN 2 THEN ts - INTERVAL 1 DAY * (event_id % 50) ELSE ts END AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""".replace(" AS at", " AS happened"))
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    n, now = F.col("event_id"), F.date_trunc("second", "ts")
    unit = F.when(n % 4 == 0, " minutes ago").when(n % 4 == 1, " hours ago").otherwise(" days ago")
    text = F.when(n % 4 == 3, "Today").otherwise(F.concat((n % 50).cast("string"), unit))
    return views.table(spark, d, "events").select("event_id", t.relative_time(text, now).alias("happened"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN event_type END AS published FROM events")
def best_published_at(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 3
    meta = F.when(n == 1, F.create_map(F.lit("published_at"), F.lit(""), F.lit("date"), F.col("event_type"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return views.table(spark, d, "events").select("event_id", t.best_published_at(F.when(n == 0, "2024-01-01").otherwise(""), meta).alias("published"))


_MATCH = r"trim(regexp_replace(strip_accents(replace(lower({0}), 'đ', 'd')), '\s+', ' ', 'g'))"


@query(f"SELECT position, {_HOST.format('site')} || ':' || substr({_MATCH.format('title')}, 1, 64) || ':' || regexp_extract(url, '/(20\\d{{2}})/', 1) AS key FROM v_hits")
def duplicate_key(spark: SparkSession, d: str) -> DataFrame:
    return views.hits(spark, d).select("position", t.duplicate_key(F.col("title"), F.col("url")).alias("key"))


@query("SELECT doc_id, md5(strip_accents(replace(lower(text), 'đ', 'd'))) AS folded FROM documents")
def norm_free(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", F.md5(t.norm_free(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(lower(strip_accents(replace(replace(replace(text, 'đ', 'd'), 'Đ', 'D'), 'ß', 'ss')))) AS folded, len(regexp_extract_all(lower(strip_accents(replace(text, 'ß', 'ss'))), '[\\p{L}\\p{N}_]+'))::INTEGER AS tokens FROM documents".replace("\\\\", "\\"))
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", F.md5(t.fold_text(F.col("text"))).alias("folded"), F.size(t.tokenize_fold(F.col("text"))).alias("tokens"))


@query(r"SELECT o_orderkey, regexp_replace(trim(regexp_replace(label, '\s+', ' ', 'g')), '^(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z][\.\)])\s+', '') AS label FROM (SELECT o_orderkey, ['1.2  tong tai san', 'iv tien', 'a) no', 'khong so'][o_orderkey % 4 + 1] || ' ' || lower(o_orderpriority) AS label FROM orders)")
def strip_row_prefix(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("1.2  Tổng tài sản", "IV tiền", "a) nợ", "không số"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return views.table(spark, d, "orders").select("o_orderkey", t.strip_row_prefix(F.concat(label, F.lit(" "), F.col("o_orderpriority"))).alias("label"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'NA') AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").select("p_partkey", t.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))) AS cleaned FROM pages""")
def clean_html_text(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", F.md5(t.clean_html_text(F.col("html"))).alias("cleaned"))


@query(r"SELECT question_id, list_distinct_in_order AS dates FROM (SELECT question_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_in_order FROM (SELECT question_id, list_concat(regexp_extract_all(question, '\b\d{2}/\d{2}/\d{4}\b'), regexp_extract_all(question, '\b\d{4}-\d{2}-\d{2}\b')) AS a FROM v_questions))")
def extract_dates(spark: SparkSession, d: str) -> DataFrame:
    return views.questions(spark, d).select("question_id", t.extract_dates(F.col("question")).alias("dates"))


@query(r"SELECT doc_id, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 79)) || '…' ELSE s END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", t.truncate_text(F.col("text"), 80).alias("short"))


@query("SELECT doc_id, md5(text) AS fixed FROM documents WHERE lang IN ('fr', 'es') AND regexp_matches(text, '^[\\x{00}-\\x{ff}]*$')".replace("\\\\", "\\"))
def fix_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """Latin texts spoiled on purpose, then mended."""
    docs = views.table(spark, d, "documents").filter(F.col("lang").isin("fr", "es") & F.rlike("text", F.lit(r"^[\x00-ÿ]*$")))
    spoiled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.md5(t.fix_mojibake(spoiled)).alias("fixed"))


@query("""SELECT doc_id, (w - 1)::INTEGER AS part, md5(array_to_string(words[(w - 1) * 448 + 1 : (w - 1) * 448 + 512], ' ')) AS digest, strip_accents(replace(lower(source), 'đ', 'd')) AS origin FROM (
    SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents), unnest(range(1, 2 + CASE WHEN len(words) <= 512 THEN 0 ELSE ceil((len(words) - 512) / 448.0)::BIGINT END)) t(w) WHERE len(words) > 0""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions from SQL: windows of words by a table function, a folded column by a scalar one."""
    register_functions(spark)
    views.table(spark, d, "documents").createOrReplaceTempView("lakeloom_documents")
    return spark.sql("SELECT doc_id, part, md5(c.text) AS digest, norm_free(source) AS origin FROM lakeloom_documents d, LATERAL chunk_text(d.text, 512, 64) c")

"""News tables: hits, relevance, freshness, ranking, article clean-up and selection, for batches of questions."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as t
from lakeloom.sources.tables import written

# Trusted sites in order, word lists, thresholds.
SITES = ("vietstock.vn", "cafef.vn", "dnse.com.vn", "vnexpress.net", "thanhnien.vn")
FINANCE_SITES = ("cafef.vn", "vietstock.vn", "vnexpress.net", "ndh.vn", "tinnhanhchungkhoan.vn", "fireant.vn", "dnse.com.vn", "vneconomy.vn", "vietnamfinance.vn", "stockbiz.vn", "cophieu68.vn")
STOCK_TERMS = ("co phieu", "chung khoan", "doanh nghiep", "cong ty", "tai chinh", "loi nhuan", "doanh thu", "ket qua kinh doanh", "bao cao tai chinh", "securities", "stock", "shares", "profit", "revenue")
SHOW_TERMS = ("fpt play", "play", "giai tri", "phim", "am nhac", "showbiz", "truyen hinh", "gameshow", "anime", "dien anh")
NEGATIVE_PHRASES = ("tin tieu cuc", "tieu cuc", "tin xau", "rui ro", "bi phat", "kho khan", "sa thai", "tranh chap", "canh bao", "thua lo", "lo rong")
#: Only terms without marks: the marked ones of the source list can never match folded text.
NEGATIVE_TERMS = ("thua lo", "lo rong", "suy giam", "giam", "bi phat", "khoi to", "dieu tra", "tranh chap", "sa thai", "no xau", "downgrade", "canh bao")
STRONG_TERMS = ("lo rong", "bi phat", "khoi to", "dieu tra")
LATEST_TERMS = ("moi nhat", "gan day", "hom nay", "tuan nay", "recent", "latest", "today", "this week")
#: Stop words of the search for hits.
SEARCH_STOP_WORDS = (
    "about", "bao", "bao nhieu", "chung", "chung khoan", "chu", "co", "dang", "day", "financial", "gan", "gia", "gi", "historical", "hom", "indicator", "latest", "market", "moi", "nay", "news",
    "noteworthy", "price", "query", "recent", "report", "technical", "what", "y",
)
#: Stop words of article selection and topics.
STOP_WORDS = ("tin", "news", "gia", "gia ca", "co", "co phieu", "phieu", "gan", "day", "moi", "nhat", "hom", "nay", "la", "gi", "dang", "chu", "y", "noteworthy", "recent", "latest", "current", "price", "what", "about")
#: Capital words that are no tickers, in searches; those of rewritten queries besides.
NON_TICKERS = ("ABOUT", "AFTER", "DATA", "FOR", "FROM", "LATEST", "MARKET", "NEWS", "PRICE", "QUERY", "RANGE", "RECENT", "REPORT", "REPORTS", "TECH", "TODAY", "WHAT", "WHEN", "WHICH", "WITH")
REWRITE_NON_TICKERS = (*NON_TICKERS, "BANK", "STOCK")
RECENT_INTENT = ("hom nay", "moi nhat", "gan day", "gan day nhat", "latest", "recent", "today", "tuan nay", "thang nay", "trong thang", "thong tin moi nhat")
RECENT_MARKERS = ("moi nhat", "gan day", "hom nay", "latest", "recent", "today", "thong tin moi nhat")
NEGATIVE_INTENT = ("negative", "tieu cuc", "xau", "rui ro", "giam", "lo", "kien", "bi phat", "canh bao", "kho khan", "sa thai", "no", "tranh chap")
BUSINESS_INTENT = ("co phieu", "chung khoan", "doanh nghiep", "cong ty", "tai chinh", "ket qua kinh doanh", "stock", "shares", "business", "company")
SEARCH_FILLERS = ("Tin mới nhất", "Tin gần đây", "Tin tức mới nhất", "Tin tức gần đây", "hôm nay", "Hôm nay", "mới nhất", "gần đây", "là gì", "có gì đáng chú ý", "ra sao", "?")
COMPANY_NAMES = {
    "HPG": "Hòa Phát", "ACB": "ACB", "FPT": "FPT", "VCB": "Vietcombank", "VHM": "Vinhomes", "MWG": "Thế Giới Di Động", "SSI": "SSI", "STB": "Sacombank", "CTG": "VietinBank", "BID": "BIDV", "GAS": "PV Gas",
    "PLX": "Petrolimex", "VNM": "Vinamilk",
}
SEARCH_ALIASES = {"HPG": ("hoa phat", "tap doan hoa phat", "cong ty hoa phat"), "ACB": ("ngan hang acb", "asia commercial bank"), "FPT": ("tap doan fpt",), "VNM": ("vinamilk", "cong ty vinamilk")}
LIMIT, TITLE_RATIO, TOPIC_OVERLAP = 5, 0.84, 0.86

# -- hits -------------------------------------------------------------------------------------------------------------


def infer_timelimit(question: Column, default: str = "m") -> Column:
    """d, w, m or y by keyword groups in this order; the default otherwise."""
    q = t.norm_free(question)
    groups = (("d", ("hom nay", "today")), ("w", ("tuan nay", "this week", "gan day", "recent")), ("m", ("moi nhat", "latest", "thang nay", "trong thang", "thong tin moi nhat")), ("y", ("nam nay", "trong nam")))
    return F.coalesce(*(F.when(t.any_of(q, words), F.lit(k)) for k, words in groups), F.lit(default))


def build_hits(items: DataFrame, site: Column) -> DataFrame:
    """Search items (href or url, title, body) of a site to hits: canonical URL, only articles of the site, dates resolved."""
    url = F.coalesce(F.nullif(F.col("href"), F.lit("")), F.col("url"))
    rows = items.withColumns({"hit_url": url, "site": site}).withColumn("normalized_url", t.canonicalize_url(F.col("hit_url")))
    rows = rows.filter(t.is_article_url(F.col("hit_url"), F.col("site")))
    return rows.withColumn("published_at", F.coalesce(t.flexible_date(F.col("date")), t.url_publish_date(F.col("hit_url")).cast("timestamp")))


def source_priority(site: Column, order: tuple[str, ...] = SITES) -> Column:
    """Place of the first trusted site that the host contains; behind all for others."""
    host = F.replace(F.lower(site), F.lit("www."), F.lit(""))
    out = F.lit(len(order))
    for i in reversed(range(len(order))):
        out = F.when(F.contains(host, F.lit(order[i])), i).otherwise(out)
    return out


def freshness(title: Column, snippet: Column, published: Column, timelimit: Column) -> Column:
    text = t.norm_free(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(snippet, F.lit("")), published))
    days = F.regexp_extract(text, r"\b(\d+)\s+days?\s+ago\b", 1).try_cast("int")
    today = t.any_of(text, ("hom nay", "today", "minutes ago", "minute ago", "hours ago", "hour ago"))
    return F.when(today, 4).when(days <= 7, 3).when(days <= 30, 2).when(days.isNotNull(), 1).when(timelimit.isin("d", "w", "m"), 2).otherwise(0)


def _bound(c: Column, f) -> Column:
    """``f`` of a column that is costly and named several times, also within lambdas: it is evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def token_score(tokens: Column, title: Column, snippet: Column, url: Column) -> Column:
    """Sum over tokens: phrases count 6, 4 and 3 where they occur in title, snippet and URL; words 5, 3 and 2 where they
    stand as whole words."""
    return folded_token_score(tokens, *(t.norm_free(c) for c in (title, snippet, url)))


def folded_token_score(tokens: Column, title: Column, snippet: Column, url: Column) -> Column:
    """The same of texts that are folded already."""
    weights = ((6, 5), (4, 3), (3, 2))
    folded = F.array(title, snippet, url)
    spaced = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))

    def of(token: Column, x: Column) -> Column:
        total = F.lit(0)
        for i, (p, w) in enumerate(weights):
            whole = F.contains(x["words"][i], F.concat(F.lit(" "), token, F.lit(" ")))
            total = total + F.when(F.contains(token, F.lit(" ")), F.when(F.contains(x["text"][i], token), p).otherwise(0)).otherwise(F.when(whole, w).otherwise(0))
        return total

    both = _bound(folded, lambda x: F.struct(x.alias("text"), F.transform(x, spaced).alias("words")))
    return _bound(both, lambda x: F.aggregate(F.transform(tokens, lambda token: of(token, x)), F.lit(0), lambda a, b: a + b))


def score_relevance(tokens: Column, title: Column, snippet: Column, url: Column, fresh: Column) -> Column:
    """Token score plus freshness; zero stays zero; freshness alone without tokens."""
    score = token_score(tokens, title, snippet, url)
    return F.when(F.size(tokens) == 0, fresh).when(score <= 0, 0).otherwise(score + fresh)


def rank_in_source(hits: DataFrame, limit: int = 2) -> DataFrame:
    """Place of each hit among those of its question and site, at most ``limit`` of them, after canonical URLs are made unique."""
    first = Window.partitionBy("query_id", "normalized_url").orderBy("position")
    place = Window.partitionBy("query_id", "site").orderBy("position")
    rows = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return rows.withColumn("rank_in_source", F.row_number().over(place)).filter(F.col("rank_in_source") <= limit)


HIT_ORDER = ("source_priority", "rank_in_source", "-recency", "-relevance", "position", "normalized_url")


def topk_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` hits of each question by site, rank, recency, relevance, position and URL."""
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in HIT_ORDER]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= n)


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_hits(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Both lists, the first of each canonical URL; the primary list comes first."""
    both = primary.withColumn("batch", F.lit(0)).unionByName(extra.withColumn("batch", F.lit(1)))
    return first_by_key(both, ["query_id", "normalized_url"], ["batch", "position"])


def filter_fresh(hits: DataFrame, cutoff: Column) -> DataFrame:
    """Relevant hits that are not older than the cut-off, by URL date and by the newest date; without any date only under a
    recent time limit."""
    stale = F.coalesce(F.unix_timestamp(t.url_publish_date(F.col("url")).cast("timestamp")) < cutoff, F.lit(False))
    fresh = F.when(F.col("recency") > 0, F.col("recency") >= cutoff).otherwise(F.coalesce(F.col("timelimit").isin("d", "w", "m"), F.lit(False)))
    return hits.withColumns({"stale_url": stale, "is_fresh": (F.col("relevance") > 0) & ~stale & fresh})


def select_top_hits(hits: DataFrame, cutoff: Column, n: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` fresh hits of each question, and the questions whose candidates are all stale."""
    rows = filter_fresh(first_by_key(hits, ["query_id", "normalized_url"], ["position"]), cutoff)
    stale = rows.groupBy("query_id").agg(F.bool_or("is_fresh").alias("any_fresh"), F.bool_or((F.col("recency") > 0) | F.col("stale_url")).alias("any_dated"))
    return topk_hits(rows.filter("is_fresh"), n), stale.filter("NOT any_fresh AND any_dated").select("query_id")


# -- articles ---------------------------------------------------------------------------------------------------------


def article_status(fetched: Column, text: Column, snippet: Column, min_words: int = 40, cap: int = 5000) -> DataFrame:
    """A struct of status, text and excerpt: failed fetches are partial and keep their text; short texts are partial and
    give way to the cleaned snippet."""
    text = F.substring(t.squeeze(F.coalesce(text, F.lit(""))), 1, cap)
    short = F.size(F.filter(F.split(text, " "), lambda x: x != "")) < max(10, min_words // 4)
    body = F.when(fetched & short, t.squeeze(F.coalesce(snippet, F.lit("")))).otherwise(text)
    status = F.when(~fetched | short, "partial").otherwise("success")
    return F.struct(status.alias("status"), body.alias("text"), F.substring(body, 1, 280).alias("excerpt"))


#: What marks a line as no article text, and what marks the end of an article, both folded.
NOISE_MARKERS = ("kenh thong tin kinh te", "bang gia dien tu", "danh muc dau tu", "moi nhat", "doc nhanh", "tin moi nhan", "chia se bai viet", "binh luan", "tro lai")
TAIL_MARKERS = ("tin lien quan", "xem them", "co the ban quan tam")
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _plain_line(line: Column) -> Column:
    """A markdown line as plain text: images off, links as their text, bare URLs and leading marks off."""
    out = F.regexp_replace(line, r"!\[[^\]]*\]\([^)]+\)", "")
    out = F.regexp_replace(out, r"\[\s*([^\]]*?)\s*\]\([^)]+\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+", " "), r"^[#>*\-\s]+", "")
    return t.unescape(t.squeeze(out))


def _word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(t.squeeze(c), " "), lambda x: x != ""))


def extract_article_text(articles: DataFrame, cap: int = 5000, least: int = 120) -> DataFrame:
    """Article text of markdown, line by line. It starts at the first line that holds enough words of the title, else at
    the first heading, else at the line most like the title; lines of menus, clocks and links are dropped; it ends at a
    tail marker once there are ``least`` characters, or when ``cap`` characters are reached. The snippet stands in for a
    text that is empty, under 20 words, or holds two noise markers."""
    words = F.filter(F.regexp_extract_all(t.match_norm(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) >= 3)
    paper = lambda x: F.array_contains(x, "bao") & F.array_contains(x, "vnexpress")
    words = _bound(words, lambda x: F.slice(F.when(paper(x), F.filter(x, lambda w: ~w.isin("bao", "vnexpress", "cafef"))).otherwise(x), 1, 8))
    lines = F.transform(F.split(F.coalesce("markdown", F.lit("")), _LINE_END), lambda x: F.struct(x.alias("raw"), t.match_norm(x).alias("fold")))
    rows = articles.select("article_id", "snippet", words.alias("words"), F.posexplode(lines).alias("line_no", "x")).select("article_id", "snippet", "words", "line_no", "x.raw", "x.fold")
    line = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    likeness = F.size(F.filter("words", lambda w: F.contains(F.col("fold"), w)))
    rows = rows.withColumns({"line": line, "likeness": likeness, "enough": F.greatest(F.lit(2), F.least(F.lit(4), F.size("words")))}).drop("words")
    per = Window.partitionBy("article_id")
    most = F.max(F.when(F.col("likeness") > 0, F.struct(F.col("likeness"), -F.col("line_no")))).over(per)
    anchor = F.coalesce(
        F.min(F.when(F.col("likeness") >= F.col("enough"), F.col("line_no"))).over(per), F.min(F.when(F.col("line").startswith("#"), F.col("line_no"))).over(per), -most["col2"], F.lit(0)
    )
    rows = rows.withColumn("anchor", anchor).filter(F.col("line_no") >= F.col("anchor"))
    plain = _bound(_plain_line(F.col("line")), lambda x: F.struct(x.alias("clean"), t.match_norm(x).alias("folded"), _word_count(x).alias("words")))
    rows = rows.withColumn("p", F.explode(F.array(plain))).select("*", "p.clean", "p.folded", "p.words").drop("p")
    clean, line, few = F.col("clean"), F.col("line"), F.col("words")
    links = (F.length(line) - F.length(F.replace(line, F.lit("](")))) / 2
    noise = t.any_of(F.col("fold"), NOISE_MARKERS) | t.any_of(F.col("folded"), NOISE_MARKERS) | line.startswith("[](") | line.startswith("![](") | ((links >= 2) & (few < 12)) | clean.isin("*", "-", "#", "") | F.rlike(clean, F.lit(r"^\d{1,2}:\d{2}\s")) | ((few < 10) & F.rlike(clean, F.lit(r"\d{1,2}:\d{2}")))
    tail = line.startswith("[ ![") | line.startswith("#### [") | t.any_of(F.col("fold"), TAIL_MARKERS)
    rows = rows.withColumns({"keep": ~noise, "tail": tail})
    so_far = Window.partitionBy("article_id").orderBy("line_no")
    rows = rows.withColumn("chars", F.coalesce(F.sum(F.when(F.col("keep"), F.length("clean"))).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("over", F.max((F.col("tail") & (F.col("chars") >= least)).cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("keep") & (F.col("over") == 0) & (F.col("chars") < cap), F.struct("line_no", "clean"))
    lines = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["clean"])
    out = rows.groupBy("article_id").agg(F.first("snippet").alias("snippet"), lines.alias("lines")).withColumn("text", t.clean_html_text(F.array_join("lines", "\n")))
    marked = _bound(t.match_norm(F.col("text")), lambda x: sum((F.contains(x, F.lit(w)).cast("int") for w in NOISE_MARKERS), F.lit(0)))
    poor = (F.col("text") == "") | (marked >= 2) | (_word_count(F.col("text")) < 20)
    return out.select("article_id", F.when(poor, t.clean_html_text(F.coalesce("snippet", F.lit("")))).otherwise(F.col("text")).alias("text"))


def strip_publish_noise(c: Column) -> Column:
    """Bylines with dates, company ticker lines, asterisks, clocks and share counts off."""
    out = F.regexp_replace(c, r"(?iu)[^|]{0,40}\*{2,}\s*\|\s*\d{1,2}-\d{1,2}-\d{4}", " ")
    out = F.regexp_replace(out, r"(?iuU)\b[A-Z]{3,5}:\s*Công ty.*?(?=\.|$)", " ")
    for pattern in (r"\*{2,}", r"(?i)\|\s*\d{1,2}:\d{2}\s*(?:AM|PM)?", r"(?iuU)\bChia sẻ\s*\d+\b", r"(?iuU)\bThị trường chứng khoán\b"):
        out = F.regexp_replace(out, pattern, " ")
    return t.squeeze(out)


def polish_summary(summary: Column, title: Column) -> Column:
    """A summary to show: site prefix, publishing noise and a repeated title off, then its excerpt."""
    title = F.coalesce(title, F.lit(""))

    def untitled(x: Column) -> Column:
        named = (title != "") & F.lower(x).startswith(F.lower(title))
        return F.when(named, F.regexp_replace(F.substring(x, F.length(title) + 1, F.length(x)), "^[ :-]+", "")).otherwise(x)

    out = strip_publish_noise(F.regexp_replace(F.trim(summary), r"^\[[^\]]+\]\s*", ""))
    return _bound(_bound(out, untitled), lambda x: excerpt(x, F.substring(x, 1, 280)))


def excerpt(text: Column, fallback: Column, cap: int = 420) -> Column:
    """Lines from the top, without clock lines and short labels, until ``cap`` characters are reached; cut with an
    ellipsis when they exceed it. Without such a line, the whole text; of an empty text, the fallback."""
    text = F.coalesce(text, F.lit(""))
    label = lambda x: (F.size(F.split(x, " ")) < 6) & F.contains(F.substring(x, 1, 8), F.lit(":"))
    lines = F.filter(F.transform(F.split(text, _LINE_END), t.squeeze), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^\d{1,2}:\d{2}\s+")) & ~label(x))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts"))
    taken = F.aggregate(lines, start, lambda a, x: F.when(a["n"] >= cap, a).otherwise(F.struct((a["n"] + F.length(x)).alias("n"), F.concat(a["parts"], F.array(x)).alias("parts"))), lambda a: F.array_join(a["parts"], " "))
    whole = _bound(taken, lambda x: F.when(x != "", x).otherwise(t.squeeze(text)))
    return _bound(whole, lambda x: F.when(x == "", fallback).when(F.length(x) > cap, F.concat(F.rtrim(F.substring(x, 1, cap - 1)), F.lit("…"))).otherwise(x))


# -- intent and scores ------------------------------------------------------------------------------------------------


def _strip(c: Column) -> Column:
    return F.regexp_replace(t.squeeze(c), r"^[ ?.,:]+|[ ?.,:]+$", "")


def _names(folded: Column, stop: tuple[str, ...]) -> Column:
    """Whether any word of a folded phrase is no stop word."""
    return F.exists(F.split(folded, " "), lambda x: (x != "") & ~x.isin(*stop))


def _tickers(text: Column, wrong: tuple[str, ...]) -> Column:
    """Words of 3 to 5 letters in the text put into capitals, in order, without those that are no tickers."""
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b([A-Z]{3,5})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*wrong)))


def entity_phrase(question: Column) -> Column:
    """What a question asks about: the clause after a Vietnamese, else an English preposition, else the question without
    its news words; null if only stop words are left."""

    def clause(pattern: str) -> Column:
        x = F.regexp_extract(question, rf"(?iu)(?:{pattern})\s+([^?]+)", 1)
        x = F.regexp_replace(x, r"(?sU)\b(?:là gì|co gi|có gì|ra sao|noteworthy|latest|recent news|recent|today|current price)\b.*$", "")
        return _strip(F.regexp_replace(x, r"(?iuU)\b(?:news|tin tức|tin)\b", " "))

    rest = F.regexp_replace(question, r"(?iuU)^(?:tin tức|tin tuc|thông tin|thong tin)(?:\s+mới nhất|\s+moi nhat)?\s+", "")
    rest = F.regexp_replace(rest, r"(?iusU)\b(?:gần đây nhất|gan day nhat|gần đây|gan day|mới nhất|moi nhat|hôm nay|hom nay)\b.*$", "")
    rest = _strip(F.regexp_replace(rest, r"(?iuU)\b(?:có gì đáng chú ý|co gi dang chu y|là gì|la gi|ra sao)\b", " "))
    options = [clause("của|cua|về|ve"), clause("about|of|for"), rest]
    return F.coalesce(*(F.when(_names(t.norm_free(x), SEARCH_STOP_WORDS), x) for x in options))


def _folded(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")


def expand_aliases(tokens: Column) -> Column:
    """The tokens, then for each ticker among them its aliases, its company's name and the longer parts of that."""
    more = {}
    for ticker in dict.fromkeys([*SEARCH_ALIASES, *COMPANY_NAMES]):
        name = _folded(COMPANY_NAMES.get(ticker, ""))
        more[ticker.lower()] = list(dict.fromkeys([*SEARCH_ALIASES.get(ticker, ()), *([name] if name else []), *(x for x in name.split() if len(x) >= 3)]))
    known = F.create_map(*(x for k, v in more.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda x: F.coalesce(F.element_at(known, F.lower(x)), none)))))


def entity_tokens(question: Column) -> Column:
    """Tokens by which hits are found: tickers, the entity phrase without question words, its longer parts, aliases."""
    entity = entity_phrase(question)
    phrase = F.regexp_replace(t.norm_free(entity), r"\b(?:hom nay|moi nhat|gan day|recent|latest|news|noteworthy)\b", " ")
    phrase = F.coalesce(t.squeeze(F.regexp_replace(phrase, r"\b(?:co gi dang chu y|co gi|dang chu y|la gi|ra sao)\b", " ")), F.lit(""))
    whole = F.when(_names(phrase, SEARCH_STOP_WORDS), F.array(phrase)).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(phrase, " "), lambda x: (F.length(x) >= 3) & ~x.isin(*SEARCH_STOP_WORDS))
    return expand_aliases(F.array_distinct(F.concat(F.transform(_tickers(F.coalesce(entity, question), NON_TICKERS), F.lower), whole, parts)))


def selection_tokens(question: Column) -> Column:
    """Tokens by which articles are selected: capital words, the clause after a preposition, its longer parts."""
    tickers = F.filter(F.transform(_tickers(question, ()), F.lower), lambda x: ~x.isin(*STOP_WORDS))
    phrase = F.regexp_replace(F.regexp_extract(question, r"(?iu)(?:của|cua|về|ve)\s+([^?.,]+)", 1), r"(?sU)\b(?:la gi|co gi|có gì|ra sao|bao nhieu)\b.*$", "")
    phrase = F.regexp_replace(t.match_norm(phrase), r"^[ ?]+|[ ?]+$", "")
    parts = F.filter(F.split(phrase, " "), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS))
    return F.filter(F.array_distinct(F.concat(tickers, F.array(phrase), parts)), lambda x: x != "")


def detect_news_intent(question: Column) -> Column:
    q = t.norm_free(question)
    tokens = selection_tokens(question)
    return F.struct(t.any_of(q, NEGATIVE_PHRASES).alias("negative"), t.any_of(q, LATEST_TERMS).alias("latest"), (F.size(tokens) > 0).alias("stock"), tokens.alias("tokens"))


def _cleaned_question(question: Column) -> Column:
    for x in SEARCH_FILLERS:
        question = F.replace(question, F.lit(x), F.lit(" "))
    return t.squeeze(question)


def query_candidates(question: Column) -> Column:
    """All search texts for a question in order, distinct: its entity, its tickers, then business, recent and negative
    wordings of its subject, the question itself, and the question without fillers."""
    raw = t.squeeze(question)
    folded, entity = t.norm_free(raw), entity_phrase(raw)
    tickers = _tickers(F.coalesce(entity, raw), NON_TICKERS)
    subject = F.coalesce(entity, F.get(tickers, F.lit(0)))
    none = F.array().cast("array<string>")
    with_each = lambda form: F.flatten(F.transform(tickers, form))
    join = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    of_entity = F.when(entity.isNotNull(), F.array(entity, join("tin tức ", entity), join(entity, " chứng khoán"))).otherwise(none)
    mixed = F.when(
        entity.isNotNull(), F.flatten(F.transform(F.filter(tickers, lambda x: ~F.contains(F.upper(entity), x)), lambda x: F.array(join(entity, " ", x), join(entity, " ", x, " chứng khoán"))))
    ).otherwise(none)
    of_tickers = with_each(lambda x: F.array(x, join("tin tức ", x), join(x, " chứng khoán"), join(x, " tin tức mới nhất")))

    def when(intent: Column, *tails: str) -> Column:
        return F.when(intent & subject.isNotNull(), F.array(*(join(subject, x) for x in tails))).otherwise(none)

    business = when((F.size(tickers) > 0) | t.any_of(folded, BUSINESS_INTENT), " kết quả kinh doanh", " doanh nghiệp")
    recent = when(t.any_of(folded, RECENT_INTENT), " tin tức gần đây", " tin tức mới nhất")
    negative = when(t.any_of(folded, NEGATIVE_INTENT), " tin tiêu cực gần đây", " rủi ro cổ phiếu", " bị phạt", " khó khăn")
    every = F.concat(of_entity, mixed, of_tickers, business, recent, negative, F.array(raw, _cleaned_question(raw)))
    return F.array_distinct(F.filter(F.transform(every, t.squeeze), lambda x: x != ""))


def primary_query(question: Column) -> Column:
    """The first search text: the entity, else the first ticker, with the wish for news of late; else the question."""
    raw = t.squeeze(question)
    entity = entity_phrase(raw)
    ticker, late = F.get(_tickers(F.coalesce(entity, raw), NON_TICKERS), F.lit(0)), t.any_of(t.norm_free(raw), RECENT_INTENT)
    cleaned = _cleaned_question(raw)
    named = lambda x, tail: F.concat(F.lit("tin tức "), x, F.when(late, F.lit(tail)).otherwise(F.lit("")))
    return t.squeeze(F.coalesce(named(entity, " gần đây nhất"), named(ticker, " mới nhất"), F.nullif(cleaned, F.lit("")), raw))


def search_query_variants(questions: DataFrame) -> DataFrame:
    """One row for each search text of a question: the primary one, then the first four candidates (eight for a question
    without entity and ticker), distinct."""
    q = F.col("question")
    raw = t.squeeze(q)
    named = entity_phrase(raw).isNotNull() | (F.size(_tickers(raw, NON_TICKERS)) > 0)
    variants = F.array_distinct(F.concat(F.array(primary_query(q)), F.slice(query_candidates(q), F.lit(1), F.when(named, 4).otherwise(8))))
    return questions.select("question_id", F.posexplode(F.filter(variants, lambda x: x != "")).alias("ordinal", "query"))


def rewritten_query(planned: Column, original: Column, year: Column) -> Column:
    """A planner's query and the user's words as one search text: Vietnamese, with the ticker's company and the year where
    news of late are wanted."""
    planned, original = (t.squeeze(F.coalesce(x, F.lit(""))) for x in (planned, original))
    both = F.concat_ws(" ", F.nullif(planned, F.lit("")), F.nullif(original, F.lit("")))
    scrubbed = F.regexp_replace(F.regexp_replace(both, r"(?iuU)\btin(?:\s+tuc)?\b", " "), r"(?iuU)\bthong tin\b", " ")
    ticker = F.get(_tickers(scrubbed, REWRITE_NON_TICKERS), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in COMPANY_NAMES.items() for x in pair))
    label = F.coalesce(F.element_at(names, ticker), ticker)
    subject = F.when(label != ticker, F.concat(label, F.lit(" "), ticker)).otherwise(ticker)
    late = t.any_of(t.norm_free(F.concat_ws(" ", planned, original)), RECENT_MARKERS)
    marked = lambda x: F.rlike(x, F.lit(r"[^\x00-\x7f]"))
    fresh = F.concat(F.lit("tin tức "), subject, F.lit(" mới nhất "), year.cast("string"))
    plain = t.squeeze(F.regexp_replace(planned, r"(?iuU)\b(?:recent|latest|news about|news|about|stock|shares)\b", " "))
    return (
        F.when(marked(planned) & late & ticker.isNotNull(), fresh).when(marked(planned), planned).when(ticker.isNotNull() & late, fresh).when(ticker.isNotNull(), F.concat(F.lit("tin tức "), subject))
        .when(marked(original), original).when(marked(plain), plain).when(original != "", original).otherwise(planned)
    )


def score_recency(published: Column, now: Column, latest: Column) -> Column:
    age = F.greatest((F.unix_timestamp(now) - F.unix_timestamp(published)) / F.lit(86400.0), F.lit(0.0))
    return (
        F.when(published.isNull(), F.when(latest, -1.2).otherwise(-0.4))
        .when(age <= 1, 3.0).when(age <= 3, 2.4).when(age <= 7, 1.9).when(age <= 30, 1.1)
        .when(age <= 90, F.when(latest, -0.5).otherwise(0.2)).when(age <= 365, F.when(latest, -2.2).otherwise(-0.8)).otherwise(F.when(latest, -3.0).otherwise(-1.2))
    )


#: Every term that is looked for in a folded text, once.
TERMS = tuple(dict.fromkeys((*STOCK_TERMS, *SHOW_TERMS, *NEGATIVE_TERMS, *STRONG_TERMS)))


def found_terms(text: Column) -> Column:
    """Which of all terms a folded text holds. As a column of its own it is worked out once, whatever is made of it."""
    return F.array(*(F.contains(text, F.lit(w)) for w in TERMS))


def _hits(found: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in terms:
        out = out + found[TERMS.index(w)].cast("int")
    return out


def score_negative(found: Column, negative: Column) -> Column:
    """``found`` as ``found_terms`` gives it."""
    base = _hits(found, NEGATIVE_TERMS) * F.lit(0.8) + _hits(found, STRONG_TERMS) * F.lit(0.6)
    return F.when(negative & (base == 0), -1.3).when(negative, base + 0.6).otherwise(F.least(base, F.lit(0.8)))


def score_source_quality(domain: Column, found: Column, stock: Column, negative: Column) -> Column:
    show = _hits(found, SHOW_TERMS)
    own = F.when(domain.isin(*FINANCE_SITES), F.when(stock, 1.6).otherwise(0.6)).otherwise(0.0)
    context = F.when(stock & (_hits(found, STOCK_TERMS) > 0), 0.9).otherwise(0.0)
    noise = F.when(stock & (show > 0), 1.3 + F.least(F.lit(1.1), 0.35 * show) + F.when(negative, 0.7).otherwise(0.0)).otherwise(0.0)
    return own + context - noise


def score_alignment(found: Column, stock: Column, negative: Column) -> Column:
    context, show, bad = _hits(found, STOCK_TERMS), _hits(found, SHOW_TERMS), _hits(found, NEGATIVE_TERMS)
    score = F.when(context > 0, F.least(F.lit(2.0), 0.45 * context)).when(stock, -0.5).otherwise(0.0)
    noise = F.when((show > 0) & stock, 1.2 + F.least(F.lit(1.2), 0.35 * show) + F.when(negative, 0.9).otherwise(0.0)).otherwise(0.0)
    bonus = F.when(negative & (bad > 0), F.least(F.lit(1.8), 0.55 * bad)).when(negative, -0.8).otherwise(0.0)
    return score - noise + bonus


def score_candidates(rows: DataFrame, now: Column) -> DataFrame:
    """All scores of (question, article) rows with title, snippet, summary, cleaned_text, url, published and intent; the
    final score and the rank by it."""
    # each text is folded once, and each term is looked for once: columns of their own that the scores read
    texts = ("title", "snippet", "summary", "cleaned_text")
    rows = rows.withColumns({f"_{c}": t.norm_free(F.coalesce(c, F.lit(""))) for c in texts})
    rows = rows.withColumn("_found", found_terms(F.concat_ws(" ", *(f"_{c}" for c in texts))))
    i, found = F.col("intent"), F.col("_found")
    domain = F.replace(F.lower(F.regexp_extract("url", "https?://([^/]+)", 1)), F.lit("www."), F.lit(""))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(f"_{c}"))
    rows = rows.withColumns(
        {
            "relevance": folded_token_score(i["tokens"], known("title"), known("summary"), t.norm_free(F.col("url"))),
            "recency": score_recency(F.col("published"), now, i["latest"]),
            "negative": score_negative(found, i["negative"]),
            "quality": score_source_quality(domain, found, i["stock"], i["negative"]),
            "alignment": score_alignment(found, i["stock"], i["negative"]),
        }
    ).drop("_found", *(f"_{c}" for c in texts))
    final = 1.7 * F.col("relevance") + 2.2 * F.col("recency") + F.when(i["negative"], 2.4).otherwise(0.5) * F.col("negative") + F.col("quality") + 1.4 * F.col("alignment")
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc_nulls_last("published"), "url")
    return rows.withColumn("final_score", F.round(final, 6)).withColumn("rank", F.row_number().over(order))


def topic_signature(articles: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most frequent words of three letters or more of title, summary and snippet; ties by alphabet."""
    text = t.norm_free(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "summary", "snippet"))))
    words = articles.select("article_id", F.explode(F.regexp_extract_all(text, F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("word")).filter(~F.col("word").isin(*STOP_WORDS))
    counted = words.groupBy("article_id", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("article_id").orderBy(F.desc("n"), "word")
    return counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).groupBy("article_id").agg(F.array_sort(F.collect_set("word")).alias("signature"))


def _frequent_words(text: str, n: int) -> list[str]:
    """The ``n`` most frequent words of a folded text, ties by alphabet, in alphabetical order."""
    counts = Counter(re.findall("[a-z0-9]{3,}", text))
    for word in counts.keys() & set(STOP_WORDS):
        del counts[word]
    if len(counts) > n:
        least = heapq.nlargest(n, counts.values())[-1]
        more = [w for w, c in counts.items() if c > least]
        return sorted(more + sorted(w for w, c in counts.items() if c == least)[: n - len(more)])
    return sorted(counts)


def signature_of(text: Column, n: int = 8) -> Column:
    """What ``topic_signature`` gives for one text, folded and not null, as a column of its row: words are counted where the
    text is, none is shuffled. A text without words has an empty one."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_frequent_words(x, n) for x in texts], dtype=object)

    return F.pandas_udf(of, "array<string>")(text)


def near_duplicate_pairs(rows: DataFrame, overlap: float = TOPIC_OVERLAP) -> DataFrame:
    """Pairs of articles of one question that share enough of their signatures, measured by the smaller one. With words in
    ascending order of frequency, a pair must share one of the first n - ceil(overlap n) + 1 words of its smaller
    signature, so only these words are joined to all words of signatures as large or larger."""
    rows = written(rows.select("query_id", "article_id", "signature"), "signatures")  # read four times
    words = rows.select("query_id", "article_id", "signature", F.size("signature").alias("n"), F.explode("signature").alias("word"))
    often = words.groupBy("query_id", "word").agg(F.count("*").alias("often")).filter("often > 1")
    words = words.join(often, ["query_id", "word"])
    place = F.row_number().over(Window.partitionBy("query_id", "article_id").orderBy(F.desc("often"), F.desc("word")))  # words of one article alone come before these
    prefix = words.withColumn("place", place).filter(F.col("place") >= F.ceil(F.col("n") * F.lit(overlap) - 1e-9))
    a, b = prefix.alias("a"), words.alias("b")
    larger = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.article_id") < F.col("b.article_id")))
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.word") == F.col("b.word")) & larger)
    share = F.size(F.array_intersect("a.signature", "b.signature")) / F.col("a.n")
    out = pairs.select(F.col("a.query_id").alias("query_id"), F.least("a.article_id", "b.article_id").alias("first"), F.greatest("a.article_id", "b.article_id").alias("second"), share.alias("overlap"))
    return out.filter(F.col("overlap") >= overlap).distinct()


#: Titles of a cell at most, and cells at least (of no fewer titles than TITLE_FEW): cells meet pairwise, in a task each.
#: Levels of letter counts that are compared first, and pairs that are looked at in one step after that.
TITLE_CELL, TITLE_CELLS, TITLE_FEW, TITLE_LEVELS, TITLE_PAIRS = 16_384, 24, 256, 192, 8_192


def duplicate_title(title: Column) -> Column:
    """A title as near duplicates are compared: folded letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(t.norm_free(F.coalesce(title, F.lit(""))), "[^a-zA-Z0-9]", " "), " +", " "))


def _titled(articles: DataFrame) -> DataFrame:
    """article_id and the title as compared; articles without a title are left out."""
    return articles.select("article_id", duplicate_title(F.col("title")).alias("_title")).filter(F.length("_title") > 0)


def title_classes(articles: DataFrame) -> DataFrame:
    """article_id and the smallest article_id with the same title; articles without a title are left out."""
    rows = _titled(articles)
    first = rows.groupBy("_title").agg(F.min("article_id").alias("representative"))
    return rows.join(first, "_title").select("article_id", "representative", "_title")


def _letter_counts(titles: list[str]) -> np.ndarray:
    """How often each character occurs in each title."""
    return np.array([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=128) for x in titles], np.int32).reshape(-1, 128)


def _telling_levels(counts: np.ndarray) -> list[tuple[int, int]]:
    """(character, count) of the levels that part the titles most evenly: reached by some, missed by others."""
    found = []
    for c in np.flatnonzero(counts.any(0)).tolist():
        values, n = np.unique(counts[:, c], return_counts=True)
        reached = n[::-1].cumsum()[::-1] / len(counts)
        found += [(abs(share - 0.5), c, v) for v, share in zip(values[1:].tolist(), reached[1:].tolist(), strict=True)]
    return [(c, v) for _, c, v in sorted(found)[:TITLE_LEVELS]]


def _marked(counts: np.ndarray, levels: list[tuple[int, int]]) -> np.ndarray:
    """A bit for each level that a title reaches, in words of 64. Titles differ in no more bits than in letters."""
    bits = np.zeros((len(counts), TITLE_LEVELS), bool)
    for i, (c, v) in enumerate(levels):
        bits[:, i] = counts[:, c] >= v
    return np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


def _common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a whole number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class _Common:
    """Lengths of longest common subsequences of many pairs of titles of two cells."""

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.b, self.sizes = a, b, np.array([len(x) for x in b])
        self.short = np.array([len(x) <= 64 for x in a]), self.sizes <= 64
        self.places = np.zeros((len(a), 129), np.uint64)  # bits of a character's places; the last column is for no character
        self.codes = np.full((len(b), 64), 128, np.int64)
        for i in np.flatnonzero(self.short[0]).tolist():
            for k, c in enumerate(a[i].encode()):
                self.places[i, c] |= np.uint64(1 << k)
        for j in np.flatnonzero(self.short[1]).tolist():
            self.codes[j, : len(b[j])] = np.frombuffer(b[j].encode(), np.uint8)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, short = np.zeros(len(i), np.int64), self.short[0][i] & self.short[1][j]
        for k in np.flatnonzero(~short).tolist():
            out[k] = _common_letters(self.a[i[k]], self.b[j[k]])
        i, j = i[short], j[short]
        if len(i):
            places, row, codes = self.places.ravel(), i * 129, np.ascontiguousarray(self.codes[j].T)
            v = np.full(len(i), ~np.uint64(0))
            for code in codes[: self.sizes[j].max()]:
                u = v & places.take(row + code)
                v = v + u | v - u
            out[short] = np.bitwise_count(~v)
        return out


def _alike_titles(a: pd.DataFrame, b: pd.DataFrame, ratio: float) -> pd.DataFrame:
    """Pairs of titles of two cells (or of one, given twice) that reach the ratio. What difflib matches is a common
    subsequence, so no pair is lost by length, by the letters that both have, or by the longest common subsequence; the
    few pairs left are measured."""
    one = len(a) and len(b) and a["cell"].iloc[0] == b["cell"].iloc[0]
    a, b = (x.iloc[np.argsort(x["_title"].str.len().to_numpy(), kind="stable")] for x in (a, b))
    b = a if one else b
    left, right, left_ids, right_ids = a["_title"].tolist(), b["_title"].tolist(), a["representative"].tolist(), b["representative"].tolist()
    found: list = []
    if not left or not right:
        return pd.DataFrame(found, columns=["first", "second", "ratio"])
    m, n = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    counts = _letter_counts(left), _letter_counts(right)
    levels = _telling_levels(np.concatenate(counts))
    x, y = _marked(counts[0], levels).T.copy(), _marked(counts[1], levels)
    common = _Common(left, right)

    def measure(pairs: list[tuple[int, np.ndarray]]) -> None:
        i, j = np.repeat([i for i, _ in pairs], [len(j) for _, j in pairs]), np.concatenate([j for _, j in pairs])
        near = 2 * common(i, j) >= ratio * (m[i] + n[j]) - 1e-9
        for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
            (first, t), (second, u) = sorted(((left_ids[p], left[p]), (right_ids[q], right[q])))
            if (r := SequenceMatcher(None, u, t).ratio()) >= ratio:
                found.append((first, second, r))

    waiting, held, size = [], 0, -1
    for i, own in enumerate(m.tolist()):
        if own != size:  # titles go by length, so bounds are worked out once for each
            size = own
            lo, hi = np.searchsorted(n, own * ratio / (2 - ratio) - 1e-6), np.searchsorted(n, own * (2 - ratio) / ratio + 1e-6, "right")
            most = np.minimum((1 - ratio) * (n + own) + 1e-6, 255).astype(np.uint8)
        at = max(lo, i + 1) if one else lo
        if at >= hi:
            continue
        apart = np.bitwise_count(y[0, at:hi] ^ x[i, 0])
        for k in range(1, len(y)):
            apart += np.bitwise_count(y[k, at:hi] ^ x[i, k])
        j = np.flatnonzero(apart <= most[at:hi]) + at
        if len(j):
            waiting.append((i, j))
            held += len(j)
        if held >= TITLE_PAIRS:
            measure(waiting)
            waiting, held = [], 0
    if waiting:
        measure(waiting)
    return pd.DataFrame(found, columns=["first", "second", "ratio"])


def near_duplicate_titles(articles: DataFrame, ratio: float = TITLE_RATIO) -> DataFrame:
    """Pairs of different titles in the whole corpus that are alike: first, second (the smallest article_id of each title,
    see ``title_classes``) and ratio, difflib's of the second title against the first.

    No pair is lost: titles are dealt into cells of bounded size, every two of which meet in a task, and pairs are left out
    by bounds alone (see ``_alike_titles``). A title travels to as many tasks as there are cells, which are ``TITLE_CELLS``
    up to ``TITLE_CELLS * TITLE_CELL`` titles. Pairs to be looked at grow with the square of the number of titles."""
    titles = written(_titled(articles).groupBy("_title").agg(F.min("article_id").alias("representative")), "titles")
    n, kind = titles.count(), dict(titles.dtypes)["representative"]
    cells = max(1, -(-n // TITLE_CELL), min(TITLE_CELLS, -(-n // TITLE_FEW)))
    dealt = titles.withColumn("cell", F.pmod(F.xxhash64("_title"), F.lit(cells)).cast("int"))
    left = dealt.select("*", F.col("cell").alias("x"), F.explode(F.sequence("cell", F.lit(cells - 1))).alias("y"))
    again = [F.col(c).alias(c) for c in dealt.columns]  # columns of their own, for the side that meets itself
    right = dealt.select(*again, F.explode(F.sequence(F.lit(0), "cell")).alias("x"), F.col("cell").alias("y"))
    met = left.groupBy("x", "y").cogroup(right.groupBy("x", "y"))
    pairs = met.applyInPandas(lambda a, b: _alike_titles(a, b, ratio), f"`first` {kind}, `second` {kind}, ratio double")
    return pairs.withColumn("ratio", F.round("ratio", 6))


def select_diverse(candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Walk each question's candidates by rank and take those with no reason against them; each choice depends on the
    earlier ones, so a question is one small group (candidates are ranked and few)."""
    columns = ["query_id", "article_id", "rank", "canonical_url", "title", "signature", "relevance", "recency", "negative", "quality", "alignment", "final_score", "latest", "negative_query"]

    def plain(title: str | None) -> str:
        return " ".join("".join(x if x.isalnum() and x.isascii() or x == " " else " " for x in (title or "")).split())

    def alike(a: str, b: str) -> bool:
        """Bounds by length and by letters come first; they are never below the ratio."""
        least = TITLE_RATIO * (len(a) + len(b)) - 1e-9
        if 2 * min(len(a), len(b)) < least or 2 * (Counter(a) & Counter(b)).total() < least:
            return False
        return SequenceMatcher(None, a, b).ratio() >= TITLE_RATIO

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list = []
        reasons = []
        for c in rows.sort_values("rank").itertuples():
            title, words = None, set(c.signature if c.signature is not None else ())
            reason = None
            if len(taken) >= limit:
                reason = "over_top_limit"
            elif c.relevance <= 0:
                reason = "relevance_score<=0"
            elif any(c.canonical_url == x[0] for x in taken):
                reason = "duplicate_canonical_url"
            elif any(alike(title := plain(c.title) if title is None else title, x[1]) for x in taken):
                reason = "near_duplicate_title"
            elif words and any(x[2] and len(words & x[2]) / min(len(words), len(x[2])) >= TOPIC_OVERLAP for x in taken):
                reason = "near_duplicate_topic"
            elif c.latest and c.recency <= -2 and len(taken) < 3:
                reason = "too_old_for_latest_query"
            elif c.negative_query and c.negative <= 0 and (c.alignment < -0.4 or c.quality < -0.8 or (len(taken) >= 2 and c.final_score < 2)):
                reason = "low_negative_signal_for_negative_query"
            if reason is None:
                taken.append((c.canonical_url, plain(c.title) if title is None else title, words))
            reasons.append((c.query_id, c.article_id, c.rank, reason))
        return pd.DataFrame(reasons, columns=["query_id", "article_id", "rank", "reason_rejected"])

    rows = candidates.withColumn("title", t.norm_free(F.coalesce("title", F.lit("")))).select(*columns)
    kinds = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, article_id {kinds['article_id']}, rank int, reason_rejected string")


def recent_articles(articles: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """Articles whose title or URL holds a term, latest activity first."""
    like = F.contains(F.lower("title"), F.lit(term.lower())) | F.contains(F.lower("url"), F.lit(term.lower()))
    return articles.filter(like).orderBy(F.coalesce("crawled_at", "updated_at", "created_at").desc(), "article_id").limit(limit)


def fallback_topn(summaries: DataFrame, n: int = LIMIT) -> DataFrame:
    """The usable summaries of each question by score, a missing one counting zero."""
    score = F.coalesce(F.col("relevance_score").try_cast("double"), F.col("score").try_cast("double"), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("value"), "article_id")
    rows = summaries.filter(F.coalesce(F.trim("summary"), F.lit("")) != "").withColumn("value", score)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


# -- cache and runs ---------------------------------------------------------------------------------------------------


def cache_split(hits: DataFrame, cache: DataFrame, content: DataFrame, now: Column, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Hits whose content is cached, readable and young enough, and all others."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("crawled_at")) / F.lit(3600.0)
    usable = (F.col("status") == "crawled") & F.col("content_key").isNotNull() & (F.col("crawled_at").isNull() | (age <= ttl_hours))
    good = cache.filter(usable).join(content.select("content_key").distinct(), "content_key", "left_semi").select("url_hash", "content_key")
    return hits.join(good, "url_hash"), hits.join(good, "url_hash", "left_anti")


def news_run_stats(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of each run and its status: success, no_data or error."""
    n = lambda c: F.count_if(c)
    s = F.col("outcome")
    counts = outcomes.groupBy("run_id").agg(F.count("*").alias("search_count"), n(s == "crawled").alias("crawled_count"), n(s == "cached").alias("cache_hit_count"), n(s == "failed").alias("failed_count"), n(s.isin("crawled", "cached")).alias("summarized_count"))
    rows = runs.join(counts, "run_id", "left").na.fill(0)
    status = F.when(F.col("summarized_count") > 0, "success").when(F.col("failed_count") > 0, "error").otherwise("no_data")
    return rows.withColumn("run_status", status)


def select_payloads(payloads: DataFrame, selected: DataFrame) -> DataFrame:
    """Payload rows whose id was selected for their question; questions with no selection keep all."""
    chosen = payloads.join(selected, ["query_id", "article_id"], "left_semi")
    return chosen.unionByName(payloads.join(selected.select("query_id").distinct(), "query_id", "left_anti"))


def article_detail(articles: DataFrame, contents: DataFrame) -> DataFrame:
    """Every article with what is stored of its content: artifact keys, cleaned text, an excerpt of it, extracted payload;
    nulls where there is none."""
    kept = contents.select("article_id", *(c for c in ("raw_html_artifact_key", "markdown_artifact_key", "cleaned_text_artifact_key", "extracted_payload_artifact_key", "cleaned_text", "extracted_payload") if c in contents.columns))
    return articles.join(kept, "article_id", "left").withColumn("cleaned_excerpt", F.substring(F.nullif("cleaned_text", F.lit("")), 1, 280))


def cache_upsert_flow(hits: DataFrame, cache: DataFrame, content: DataFrame, crawled: DataFrame, now: Column, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of the article cache: hits (run_id, url_hash, title, url) are recorded, split into usable cache records and
    misses, and the misses' crawl outcomes (url_hash, cleaned_text, markdown, error_message; no row: nothing came back)
    are stored. An outcome with an error is marked failed first and stored like any other, as its text is the snippet.

    Returns the cache after it (one row for each url_hash), the new contents, and counts for each run."""
    from lakeloom.operators.market import last_of_batch

    named = last_of_batch(hits.select("url_hash", "title", "url"), ["url_hash"], ["title", "url"])
    usable, misses = cache_split(hits, cache, content, now, ttl_hours)
    asked = misses.select("url_hash").distinct()
    text = F.concat(F.coalesce("cleaned_text", F.lit("")), F.coalesce("markdown", F.lit("")))
    came = crawled.select("url_hash", "cleaned_text", "markdown", "error_message").join(asked, "url_hash", "left_semi")
    new = came.select("url_hash", F.concat(F.lit("articles/"), "url_hash", F.lit("/content.json")).alias("content_key"), "cleaned_text", "markdown", F.sha2(text, 256).alias("content_hash"), "error_message")
    got = asked.join(new, "url_hash", "left").withColumn("_asked", F.lit(True))
    old = named.join(cache.select("url_hash", *(F.col(c).alias(f"_{c}") for c in ("title", "url", "status", "content_key", "content_hash", "crawled_at"))), "url_hash", "full_outer")
    rows = old.join(got.select("url_hash", "content_key", "content_hash", "_asked"), "url_hash", "left")
    stored, failed = F.col("content_key").isNotNull(), F.coalesce("_asked", F.lit(False))
    after = rows.select(
        "url_hash", F.coalesce(F.nullif("title", F.lit("")), "_title").alias("title"), F.coalesce("url", "_url").alias("url"),
        F.when(stored, "crawled").when(failed, "failed").otherwise(F.coalesce("_status", F.lit("discovered"))).alias("status"), F.coalesce("content_key", "_content_key").alias("content_key"),
        F.coalesce("content_hash", "_content_hash").alias("content_hash"), F.when(stored, now.cast("timestamp")).otherwise(F.col("_crawled_at")).alias("crawled_at"),
        F.when(~stored & failed, F.lit("Crawler returned no article.")).alias("error_message"),
    )
    fate = misses.join(got.select("url_hash", F.col("content_key").alias("_key"), F.col("error_message").alias("_error")), "url_hash", "left")
    outcome = F.when(F.col("_key").isNull(), "lost").when(F.col("_error").isNotNull(), "error").otherwise("crawled")
    every = usable.select("run_id", F.lit("cached").alias("outcome")).unionByName(fate.select("run_id", outcome.alias("outcome")))
    o = F.col("outcome")
    counts = every.groupBy("run_id").agg(
        F.count("*").alias("selected_count"), F.count_if(o == "cached").alias("cache_hits"), F.count_if(o.isin("crawled", "error")).alias("crawled_new"), F.count_if(o.isin("lost", "error")).alias("crawl_failed")
    )
    return after, new.drop("error_message"), counts

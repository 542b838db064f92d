"""Text, URL and date expressions. All are columns; none leaves the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- folding ----------------------------------------------------------------------------------------------------------


@cache
def _maps(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters whose decomposition is one base and marks, by that base; and, for the compatibility form, those that
    become several characters."""
    source, target, longer = [], [], []
    for i in range(128, 0x10000 if form == "NFD" else sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        bare = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if bare == c or not bare:
            continue
        if len(bare) == 1:
            source.append(c)
            target.append(bare)
        elif unicodedata.category(c)[0] == "L" and i < 0x10000 and not 0xAC00 <= i < 0xD7A4 and len(bare) < 4:
            longer.append((c, bare))
    return "".join(source), "".join(target), tuple(longer)


def norm_free(c: Column) -> Column:
    """Lower case, d for the barred d, marks dropped."""
    source, target, _ = _maps("NFD")
    keep = [(a, b) for a, b in zip(source, target, strict=True) if a.lower() == a]
    pairs = "".join(a for a, _ in keep) + "đ", "".join(b for _, b in keep) + "d"
    return F.regexp_replace(F.translate(F.lower(c), *pairs), "\\p{Mn}+", "")


#: Letters of several characters; what a case folding or a decomposition makes of them.
LIGATURES = (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("…", "..."))


@cache
def _folding() -> tuple[str, str]:
    source, target, _ = _maps("NFKD")
    keep = [(a, b) for a, b in zip(source, target, strict=True) if ord(a) < 0x10000]
    return "".join(a for a, _ in keep) + "đĐ", "".join(b for _, b in keep) + "dD"


def fold_text(c: Column) -> Column:
    """Both barred d's, compatibility decomposition, marks dropped, full case folding for the sharp s; null is empty."""
    out = F.translate(F.coalesce(c, F.lit("")), *_folding())
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(F.regexp_replace(out, "\\p{Mn}+", ""))


@cache
def _base(c: str) -> str:
    """What ``_folding`` makes of a character, without a table of all characters."""
    bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return {"đ": "d", "Đ": "D"}.get(c, bare if c > "\x7f" and len(bare) == 1 and ord(c) < 0x10000 else c)


def folded(text: str) -> str:
    """``fold_text`` of a text in Python: the same for all characters that Python and the JVM know alike."""
    out = "".join(map(_base, text))
    for a, b in LIGATURES:
        out = out.replace(a, b)
    return "".join(x for x in out if unicodedata.category(x) != "Mn").lower()


def squeeze(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def match_norm(c: Column) -> Column:
    return squeeze(norm_free(c))


def tokenize_fold(c: Column) -> Column:
    return F.regexp_extract_all(fold_text(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def strip_row_prefix(c: Column) -> Column:
    """Folded label without leading numbering: 1.2, roman numerals, a) or a."""
    return F.regexp_replace(squeeze(fold_text(c)), r"^(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z][\.\)])\s+", "")


def slug(c: Column) -> Column:
    """All but letters, digits, - and _ become _; nothing left is NA."""
    out = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(out, "^_+|_+$", ""), F.lit("")), F.lit("NA"))


#: The character references that pages use most; others by number.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_html_text(c: Column) -> Column:
    """Tags off, references decoded, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


def truncate_text(c: Column, n: int) -> Column:
    out = squeeze(c)
    return F.when(F.length(out) > n, F.concat(F.rtrim(F.substring(out, 1, n - 1)), F.lit("…"))).otherwise(out)


def fix_mojibake(c: Column) -> Column:
    """Text that was UTF-8 read as Latin-1 is read again; it stays when it holds no marker or characters beyond."""
    latin = F.rlike(c, F.lit(r"^[\x00-ÿ]*$"))
    again = F.try_validate_utf8(F.decode(F.encode(F.when(latin, c), "ISO-8859-1"), "UTF-8"))
    broken = F.contains(again, F.lit("�"))
    return F.when(F.rlike(c, F.lit("[ÃÂÄÆ]|á[º»]")) & latin & ~broken, again).otherwise(c)


def any_of(c: Column, words) -> Column:
    """Whether the text contains any of the words; words that the folding could never leave are dropped."""
    import re

    return F.rlike(c, F.lit("|".join(re.escape(w) for w in dict.fromkeys(words))))


# -- URLs -------------------------------------------------------------------------------------------------------------

#: Hosts that stand for another; query keys that only track.
HOST_ALIASES = {"vnxpress": "vnexpress.net", "vnxpress.net": "vnexpress.net", "vnexpress": "vnexpress.net", "e.vnexpress.net": "vnexpress.net"}
TRACKING = r"^(?:utm_.*|ga_.*|fbclid|gclid|dclid|gbraid|wbraid|igshid|msclkid|mc_cid|mc_eid|ref|ref_src|_ga|_gl)$"


def normalize_host(c: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")
    names = F.create_map(*(F.lit(x) for pair in HOST_ALIASES.items() for x in pair))
    return F.coalesce(names[out], out)


def canonicalize_url(c: Column) -> Column:
    """Lower scheme and host, aliases, no fragment, no tracking keys, remaining pairs sorted, no trailing slash."""
    c = F.trim(c)
    part = lambda i: F.regexp_extract(c, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.rlike(F.lower(F.split(p, "=", 2)[0]), F.lit(TRACKING)))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.array_join(F.array_sort(pairs), "&")
    path = F.coalesce(F.nullif(F.regexp_replace(part(3), "/+$", ""), F.lit("")), F.lit("/"))
    out = F.concat(F.lower(part(1)), F.lit("://"), normalize_host(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((part(1) != "") & (part(2) != ""), out).otherwise(c)


def url_hash(c: Column) -> Column:
    return F.sha2(canonicalize_url(c), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


#: Paths that are never articles.
NOT_ARTICLES = r"^(?:/$|/tags?/|/category/|/categories/|/chu-de/|/tin-moi|/tin-tuc-24h|/search|/tim-kiem|/video/|/photo/|/albums/|/infographic/|/login|/user)"
NOT_ARTICLES_INSIDE = r"/statistics|/statistic|/du-lieu/|/tim-kiem|/search|/tag/|/tags/"


def is_article_url(url: Column, site: Column) -> Column:
    """Long enough, of the site, no listing, and with a five-digit id or a long hyphenated slug."""
    u, s = canonicalize_url(url), F.replace(site, F.lit("www."), F.lit(""))
    path = F.regexp_replace(F.split(F.substring(u, F.instr(u, s) + F.length(s), F.length(u)), r"\?")[0], "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    ok = (F.length(u) >= 25) & F.contains(u, s) & ~F.contains(u, F.lit("finance.vietstock")) & (F.length(path) >= 5)
    ok &= ~F.rlike(F.lower(path), F.lit(NOT_ARTICLES_INSIDE)) & ~F.rlike(path, F.lit(NOT_ARTICLES))
    return F.coalesce(ok & (F.rlike(path, F.lit(r"\d{5,}")) | (F.contains(last, F.lit("-")) & (F.length(last) >= 25))), F.lit(False))


# -- dates ------------------------------------------------------------------------------------------------------------


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _groups(c: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for i in range(1, n + 1)]


def url_publish_date(url: Column) -> Column:
    """188yymmdd, else /yyyy/m/ as the first of the month, else 185yymmdd; the first that is a date."""
    u = canonicalize_url(url)
    a, b, c = (_groups(u, p, n) for p, n in ((r"188(\d{2})(\d{2})(\d{2})", 3), (r"/(20\d{2})/(\d{1,2})(?:/|$)", 2), (r"185(\d{2})(\d{2})(\d{2})", 3)))
    century = lambda y: F.concat(F.lit("20"), y)
    return F.coalesce(_date(century(a[0]), a[1], a[2]), _date(b[0], b[1], F.when(b[0].isNotNull(), "1")), _date(century(c[0]), c[1], c[2]))


def title_publish_date(title: Column) -> Column:
    d, m, y = _groups(title, r"\b(\d{1,2})[/-](\d{1,2})[/-](20\d{2})\b", 3)
    return _date(y, m, d)


def flexible_date(raw: Column) -> Column:
    """Four plain formats, then ISO with or without a zone, then a date within the text."""
    t = F.trim(raw)
    plain = [F.try_to_date(F.when(F.rlike(t, F.lit(p)), t), f) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"))]
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), t).try_cast("timestamp")
    return F.coalesce(*(x.cast("timestamp") for x in plain), iso, title_publish_date(t).cast("timestamp"))


def resolve_published_at(published: Column, url: Column, title: Column, snippet: Column) -> Column:
    """The newest of all dates to be found; null when there is none."""
    return F.greatest(flexible_date(published), *(x.cast("timestamp") for x in (url_publish_date(url), title_publish_date(title), title_publish_date(snippet))))


def recency_timestamp(published: Column, url: Column, title: Column, snippet: Column) -> Column:
    return F.coalesce(F.unix_timestamp(resolve_published_at(published, url, title, snippet)), F.lit(0))


def infer_article_datetime(url: Column, title: Column, snippet: Column, text: Column) -> Column:
    """/yyyy/mm/dd/, then six digits yymmdd, then eight in the URL; then d/m/y or y/m/d in title, snippet, text."""
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    six = F.transform(F.regexp_extract_all(url, F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1)), lambda x: F.try_to_date(F.concat(F.lit("20"), x), "yyyyMMdd"))
    eight = F.transform(F.regexp_extract_all(url, F.lit(r"(?<!\d)(20\d{6})(?!\d)"), F.lit(1)), lambda x: F.try_to_date(x, "yyyyMMdd"))
    y, m, d = _groups(url, r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)", 3)

    def of(c: Column) -> Column:
        dmy = F.transform(F.regexp_extract_all(c, F.lit(r"\b\d{1,2}[/-]\d{1,2}[/-]20\d{2}\b"), F.lit(0)), lambda x: F.try_to_date(F.replace(x, F.lit("-"), F.lit("/")), "d/M/yyyy"))
        ymd = F.transform(F.regexp_extract_all(c, F.lit(r"\b20\d{2}[/-]\d{1,2}[/-]\d{1,2}\b"), F.lit(0)), lambda x: F.try_to_date(F.replace(x, F.lit("-"), F.lit("/")), "yyyy/M/d"))
        return F.coalesce(first(dmy), first(ymd))

    return F.coalesce(_date(y, m, d), first(six), first(eight), of(title), of(snippet), of(text))


def relative_time(text: Column, now: Column) -> Column:
    """'N minutes/hours/days ago' and 'today' against a given now."""
    n = F.regexp_extract(F.lower(text), r"\b(\d+)\s+(minute|hour|day)s?\s+ago\b", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(text), r"\b(\d+)\s+(minute|hour|day)s?\s+ago\b", 2)
    seconds = n * F.when(unit == "minute", 60).when(unit == "hour", 3600).otherwise(86400)
    return F.coalesce(F.timestamp_seconds(F.unix_timestamp(now) - seconds), F.when(F.rlike(F.lower(text), F.lit(r"\btoday\b")), now))


def best_published_at(direct: Column, metadata: Column, keys=("published_at", "published_date", "date", "publish_date")) -> Column:
    return F.coalesce(F.nullif(direct, F.lit("")), *(F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in keys))


def duplicate_key(title: Column, url: Column) -> Column:
    """domain:title start:year in the URL."""
    host = normalize_host(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))
    return F.concat_ws(":", host, F.substring(match_norm(F.coalesce(title, F.lit(""))), 1, 64), F.regexp_extract(url, r"/(20\d{2})/", 1))


def extract_dates(question: Column) -> Column:
    """dd/mm/yyyy, then yyyy-mm-dd, each once, in order."""
    return F.array_distinct(F.concat(F.regexp_extract_all(question, F.lit(r"\b\d{2}/\d{2}/\d{4}\b"), F.lit(0)), F.regexp_extract_all(question, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))))

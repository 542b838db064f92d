"""Main text of web pages by a host suffix array (operator 10).

A page is cut into blocks with the role that its markup gives them: main (inside an article or main container), loose
(elsewhere), or marked (menus, headers, footers, sidebars, notices, adverts, forms, comments). Pages of a host meet in
groups of bounded size; the token streams of whole pages, containers included, are concatenated, and a suffix array over
them, sorted as deep as a long run, tells on which pages every run of ``RUN`` tokens stands. Runs that stand on ``SHARE`` of
a host's distinct pages or more are boilerplate.

That share is of the whole host, so groups change nothing: a run that reaches it in the host reaches it in one of the groups
that the host is dealt into at least. Each group names the runs that do; these few (a page has no room for more than
1 / SHARE of its length) are then counted exactly over all pages of the host, and what remains is the host's dictionary.

Unique runs decide: the text of a page is what the dictionary leaves of its containers or, where they hold under half as
many unique tokens as the loose blocks, of the loose blocks. Inside containers, a run goes if its share would be ``FIRM`` even
with one page more that lacks it, so a passage that some articles share stays. Identical pages count once, so a copied page
stays as well.

Tags are read in one pass: a quote that is never closed ends with its tag, a tag that is never closed is text. Inside
containers an element is marked by its tag, its role or a whole class name, not by a part of one.

Defined results: null and empty pages, and pages without text, give an empty text; pages without a host are a host of
their own; repeated rows of a page are one page for the counts and rows of their own in the result; any length is treated
whole; a host of one distinct page has no boilerplate; an empty table gives no rows; extra columns of any name are left out.
Runs and pages are compared by 64-bit hashes.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import written

#: Tokens of a run; of a host's distinct pages, the share from which a run is boilerplate, and that of containers.
RUN, SHARE, FIRM = 8, 0.3, 0.9
#: Pages of a group; groups of a task; pages that are cut into blocks at a time; bytes of dictionaries up to which all tasks
#: get them whole, beyond which pages and dictionaries meet by host and part.
PAGES, TOGETHER, CUT, DICTIONARY = 256, 8, 250, 32_000_000
MAIN, LOOSE, MARKED = 0, 1, 2

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MARKED_TAGS = frozenset("nav footer aside form button select option dialog menu head svg canvas object audio video map fieldset".split())
_MAIN_TAGS = frozenset(("article", "main"))
_MARKED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar aside menu navbar navigation nav breadcrumb breadcrumbs "
    "comment comments disqus respond reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets footer pagination pager toolbar tags hidden".split()
)
_MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN_NAMES = frozenset("article content main post story entry articlebody maincontent".split())
#: Elements of text, which no class name takes out of a container.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody table section figure figcaption".split())


def role_of(tag: str, attributes: list[tuple[str, str]], inside: int) -> int | None:
    """The role that an element gives its content, None to keep the one around it."""
    if tag in _MARKED_TAGS or (tag == "header" and inside != MAIN):
        return MARKED
    main = tag in _MAIN_TAGS
    for name, value in attributes:
        value = value.lower()
        if name in ("class", "id"):
            if inside == MAIN:
                if tag not in _TEXT_TAGS and not _MARKED_NAMES.isdisjoint(value.split()):
                    return MARKED
                continue
            names = [x for x in _SPLIT.split(value) if x]
            if not _MARKED_NAMES.isdisjoint(names) or ("header" in names and not main):
                return MARKED
            main = main or (tag in ("div", "section", "td") and not _MAIN_NAMES.isdisjoint(names) and "wrapper" not in names and "page" not in names)
        elif name == "role":
            if value in _MARKED_ROLES:
                return MARKED
            main = main or value in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return MARKED
    return MAIN if main else None


class _Page:
    """A page read from front to back. What is searched for and not there is not searched for again."""

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def find(self, what: str, at: int) -> int:
        """Where a text comes next, -1 if it doesn't."""
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """Names and values from behind a tag's name on, whether it closes itself, and where the tag ends (-1: never)."""
        out, page = [], self.page
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                end = _GAP.match(page, at).end()
                if page[end : end + 1] == "=":  # a stray sign
                    at = end + 1
                    continue
                return out, page[end - 1 : end] == "/", end + 1 if page[end : end + 1] == ">" else -1
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = _BARE.match(page, at)[0]
                    at += len(value)
            out.append((m[1].lower(), value))

    def after(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; the page's end if there is none."""
        if tag in self.absent:
            return len(self.page)
        m = re.compile(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.absent.add(tag)
            return len(self.page)
        return m.end()


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of the blocks of a page in order; white space within a block is one space. Time is in proportion to the
    page, whatever its markup."""
    read, n = _Page(page), len(page)
    out: list[tuple[int, str]] = []
    #: Open elements: name, role around them, how many elements of blocks are open below; places of each name.
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = {}
    pieces: list[str] = []
    role, at, deep = LOOSE, 0, 0

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((role, text))
            pieces.clear()

    def pop() -> tuple[str, int, int]:
        top = stack.pop()
        places[top[0]].pop()
        return top

    while at < n:
        start = read.find("<", at)
        if start < 0 or read.find(">", start) < 0:
            pieces.append(page[at:])
            break
        if start > at:
            pieces.append(page[at:start])
        if page.startswith(("<!--", "<![CDATA["), start):
            end = read.find("-->" if page.startswith("<!--", start) else "]]>", start)
            at = end + 3 if end >= 0 else n
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = read.find(">", start) + 1
            continue
        m = _NAME.match(page, start + 1)
        attributes, itself, end = read.attributes(m.end()) if m else ([], False, -1)
        if end < 0:
            pieces.append("<")
            at = start + 1
            if m:  # the rest has no end of a tag outside quotes
                pieces.append(page[at:])
                break
            continue
        at, tag = end, m[2].lower()
        if tag not in _INLINE:
            close()
        elif tag == "br":
            pieces.append(" ")
        if m[1]:
            held = places.get(tag)
            if held:
                name, around, below = stack[held[-1]]
                if tag in _INLINE and deep > below:
                    continue  # a stray inline end does not close blocks
                if role != around:
                    close()
                    role = around
                for _ in range(len(stack) - held[-1]):
                    deep = pop()[2]
            continue
        if tag in _VOID or itself:
            continue
        if tag in _RAW:
            at = read.after(tag, at)
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            _, role, deep = pop()
        new = role_of(tag, attributes, role) if role != MARKED else None
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, role, deep))
        deep += tag not in _INLINE
        if new is not None and new != role:
            close()
            role = new
    close()
    return out


def run_classes(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of ``run`` tokens in the token streams: the stream and position of each, and its class (equal runs have
    equal classes). The suffixes of the concatenated streams are sorted by doubling until they are told apart to the depth of
    a run; neighbours whose common prefix has a run's length are one class."""
    sizes = np.array([len(x) for x in streams], np.int64)
    n = int(sizes.sum()) + len(streams)
    ends = np.cumsum(sizes + 1)
    text = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    if inside.any():
        text[inside] = np.concatenate(streams) + len(streams)
    text[~inside] = np.arange(len(streams))  # a separator of its own ends each stream
    levels = [np.unique(text, return_inverse=True)[1]]
    hop = 1
    while hop < run:
        rank = levels[-1]
        key = rank * (n + 1)
        key[:-hop] += rank[hop:] + 1
        levels.append(np.unique(key, return_inverse=True)[1])
        hop *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[ok], b[ok] = a[ok] + (1 << k), b[ok] + (1 << k)
        common[ok] += 1 << k
    kind = np.empty(n, np.int64)
    kind[order] = np.concatenate([[0], np.cumsum(common < run)])
    whole = np.flatnonzero(np.repeat(ends, sizes + 1) - 1 - np.arange(n) >= run)  # suffixes with room for a run
    stream = np.repeat(np.arange(len(streams)), sizes + 1)[whole]
    return stream, whole - (ends - sizes - 1)[stream], kind[whole]


def unique_runs(block: list[tuple[str, bool]], run: int = RUN) -> list[str]:
    """The tokens of a block without its covered runs; a short run at its edge, where a repeat of the next block begins
    by chance a little earlier, stays."""
    out: list[str] = []
    for covered, some in itertools.groupby(block, key=lambda x: x[1]):
        some = [x for x, _ in some]
        if not covered or (len(some) < run and len(some) < len(block)):
            out += some
    return out


_HASHES: dict[str, int] = {}
#: Characters of the tokens whose hashes a worker keeps, about.
_KEPT = [0]
_FACTORS = np.random.default_rng(10).integers(0, 1 << 63, RUN, np.uint64) * np.uint64(2) + np.uint64(1)


def token_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of tokens; a worker keeps those of common tokens."""
    if _KEPT[0] > 40_000_000:
        _HASHES.clear()
        _KEPT[0] = 0
    for x in set(tokens).difference(_HASHES):
        _HASHES[x] = xxhash.xxh3_64_intdigest(x)
        _KEPT[0] += len(x) + 100
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def run_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each run of ``RUN`` tokens."""
    n = len(hashes) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = sum(hashes[i : i + n] * _FACTORS[i] for i in range(RUN))
    return (key ^ key >> np.uint64(29)).view(np.int64)


def cover(size: int, begins: np.ndarray) -> np.ndarray:
    """Which of ``size`` tokens lie in runs that begin at the positions given."""
    edge = np.zeros(size + RUN + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + RUN, -1)
    return np.cumsum(edge)[:size] > 0


def frequent_runs(group: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
    """The keys of the runs that stand on ``SHARE`` of the distinct pages of one group of a host's pages. A page that has
    copies counts by one over their number, wherever they are."""
    weight = dict(zip(copies["uid"].tolist(), (1.0 / copies["n"]).tolist(), strict=True))
    pages = group.drop_duplicates("uid") if not len(copies) else group
    each = np.array([weight.get(x, 1.0) for x in pages["uid"].tolist()])
    hashes = [token_hashes(x.split(" ")) if x else np.zeros(0, np.uint64) for x in pages["stream"]]
    streams = np.split(pd.factorize(np.concatenate(hashes))[0], np.cumsum(list(map(len, hashes)))[:-1])
    stream, place, kind = run_classes(streams)
    if not len(kind):
        return pd.DataFrame([], columns=["host", "key"])
    pairs = np.unique(kind * len(streams) + stream)
    held = np.bincount(pairs // len(streams), each[pairs % len(streams)], int(kind.max()) + 1)
    often = held >= SHARE * each.sum() - 1e-6
    first = np.unique(kind, return_index=True)[1]
    first = first[often[kind[first]]]
    keys = {int(run_keys(hashes[s][p : p + RUN])[0]) for s, p in zip(stream[first].tolist(), place[first].tolist(), strict=True)}
    host = group["host"].iloc[0]
    return pd.DataFrame([(host, x) for x in sorted(keys)], columns=["host", "key"])


def page_text(page: list[tuple[int, str]], known: np.ndarray, firm: np.ndarray) -> tuple[str, int]:
    """The text of a page's blocks and the number of boilerplate tokens; ``known`` are the sorted keys of the host's
    boilerplate, ``firm`` those that hold inside containers too."""
    tokens = [t for _, text in page for t in text.split(" ")]
    gone = np.zeros((2, len(tokens)), bool)
    if len(known):
        keys = run_keys(token_hashes(tokens))
        for row, some in zip(gone, (known, firm), strict=True):
            if len(some):
                row[:] = cover(len(tokens), np.flatnonzero(some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys))
    parts: dict[int, list[list[tuple[str, bool]]]] = {MAIN: [], LOOSE: []}
    at = 0
    for role, text in page:
        some = text.split(" ")
        if role in parts:
            parts[role].append(list(zip(some, gone[int(role == MAIN), at : at + len(some)].tolist(), strict=True)))
        at += len(some)
    own, loose = (sum(not drop for block in parts[role] for _, drop in block) for role in (MAIN, LOOSE))
    chosen = parts[MAIN] if parts[MAIN] and 2 * own >= loose else parts[LOOSE]
    return "\n".join(x for block in chosen if (x := " ".join(unique_runs(block)))), int(gone[0].sum())


def _with_dictionaries(rows: DataFrame, words: DataFrame, run: Callable[[pd.DataFrame, Callable], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over pages with a function from a host to its words, a frame. Dictionaries of proven size go to all tasks; larger ones
    meet the pages by host and part. The result is the same."""
    size = words.agg(F.sum(F.octet_length("host") + F.lit(64))).first()[0] or 0
    if size <= DICTIONARY:
        held = words.toPandas()
        by_host = rows.sparkSession.sparkContext.broadcast({host: some.drop(columns="host") for host, some in held.groupby("host")})

        def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), CUT):
                    yield run(batch.iloc[i : i + CUT], by_host.value.get)

        return rows.mapInPandas(narrow, schema)
    spread = words.join(rows.select("host", "part").distinct(), "host")

    def met(group: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return run(group, lambda _: some.drop(columns=["host", "part"]) if len(some) else None)

    rows, spread = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (rows, spread))  # both come from the same pages
    return rows.groupBy("host", "part").cogroup(spread.groupBy("host", "part")).applyInPandas(met, schema)


def main_texts(pages: DataFrame, group_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars and the number of boilerplate tokens found, one row for each row given.

    A host's pages are dealt by hash into groups of about ``group_pages``, so that no host is one task. The table of
    hosts is written first: Spark then knows its size and broadcasts it only below its threshold."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    rows = rows.withColumn("uid", F.xxhash64("page_id", "url", "html")).withColumn("body", F.xxhash64("html"))
    bodies = written(rows.select("host", "uid", "body").groupBy("host", "body", "uid").agg(F.count("*").alias("n")), "bodies")
    hosts = written(bodies.groupBy("host").agg(F.ceil(F.sum("n") / group_pages).cast("int").alias("groups"), F.count_distinct("body").alias("contents")), "hosts")
    parts = max(1, -(-(hosts.agg(F.sum("groups")).first()[0] or 0) // TOGETHER))  # so that a task has a few groups at any size
    part = F.pmod("uid", F.col("groups"))
    rows = rows.join(hosts, "host").withColumn("part", part)
    several = bodies.groupBy("host", "body").agg(F.sum("n").alias("n")).filter("n > 1")
    copies = bodies.select("host", "body", "uid").join(several, ["host", "body"]).join(hosts, "host").select("host", part.alias("part"), "uid", "n")

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + CUT] for whole in batches for i in range(0, len(whole), CUT)):
            yield pd.DataFrame({c: batch[c].tolist() for c in ("host", "part", "uid")} | {"stream": [" ".join(t for _, t in blocks(x)) for x in batch["html"]]})

    cut = rows.filter("contents > 1").select("host", "part", "uid", "html").mapInPandas(streams, "host string, part long, uid long, stream string")
    left, right = cut.repartition(parts, "host", "part").groupBy("host", "part"), copies.repartition(parts, "host", "part").groupBy("host", "part")
    frequent = left.cogroup(right).applyInPandas(lambda a, b: frequent_runs(a, b) if len(a) else pd.DataFrame([], columns=["host", "key"]), "host string, key long")
    candidates = written(frequent.distinct(), "runs")

    def standing(batch: pd.DataFrame, words_of: Callable) -> pd.DataFrame:
        out = []
        for host, body, page in zip(batch["host"], batch["body"], batch["html"], strict=True):
            words = words_of(host)
            if words is not None:
                keys = np.intersect1d(run_keys(token_hashes([t for _, text in blocks(page) for t in text.split(" ")])), words["key"].to_numpy())
                out += zip([host] * len(keys), [body] * len(keys), keys.tolist(), strict=True)
        return pd.DataFrame(out, columns=["host", "body", "key"])

    some = rows.select("host", "part", "body", "html")
    counts = _with_dictionaries(some, candidates, standing, "host string, body long, key long").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    counts = counts.join(hosts, "host").filter((F.col("n") >= 2) & (F.col("n") >= F.col("contents") * F.lit(SHARE) - 1e-6))
    words = written(counts.select("host", "key", (F.col("n") >= (F.col("contents") + 1) * F.lit(FIRM) - 1e-6).alias("firm")), "boilerplate")

    def texts(batch: pd.DataFrame, words_of: Callable) -> pd.DataFrame:
        none, out, sorted_words = np.zeros(0, np.int64), [], {}
        for host, page in zip(batch["host"], batch["html"], strict=True):
            if host not in sorted_words:
                w = words_of(host)
                sorted_words[host] = (none, none) if w is None else (np.sort(w["key"].to_numpy()), np.sort(w["key"].to_numpy()[w["firm"].to_numpy(bool)]))
            out.append(page_text(blocks(page), *sorted_words[host]))
        return pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"].tolist(), "text": [x for x, _ in out], "n_chars": [len(x) for x, _ in out], "boilerplate_tokens": [x for _, x in out]})

    return _with_dictionaries(rows.select("page_id", "url", "host", "part", "html"), words, texts, "page_id long, url string, text string, n_chars long, boilerplate_tokens long")

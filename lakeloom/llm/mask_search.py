"""Ranked lexical search by presence masks (operator 12).

Documents are read once for a block of items. Each task makes blocks of documents: for every term of the items, the
documents of the block that hold it and how often. Blocks are written; document frequencies, the number of documents and
their length are summed over them. Then every block is searched for every item: the bitmaps of the item's terms are laid
over each other, which gives each document a mask of matched terms; documents of one mask share an upper bound, the sum
of the largest impacts of its terms in the block. Distinct masks are scored exactly, highest bound first, until the next
bound is below the item's k-th best score; terms whose bounds together stay below it need not be looked at to find
candidates. A task keeps its best from block to block; the best of all tasks are ranked at the end.

Items are taken in blocks of bounded size (their terms go to the tasks), all documents are read for each of them.

Defined results: null texts and texts without terms match nothing and do not count in N; items without terms have no rows;
repeated items are items of their own, and so are repeated documents; equal scores go by ascending doc_id, null last; an
item of any number of terms is searched (masks have as many 63-bit words as it needs); empty tables give no rows; extra
columns of any name are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.bpe import groups
from lakeloom.llm.common import told_ids, written

#: Items and characters of items in a block; documents and postings in a block of documents; characters split at a time.
ITEMS, ITEM_CHARS, DOCS, POSTINGS, SLICE = 4096, 1 << 23, 1 << 14, 1 << 22, 1 << 22
#: A term: a run of ASCII letters and digits and of whatever is not ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The same on UTF-8: what is no part of a term becomes a space, A-Z become small.
FOLD = bytes((c | 0x20 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
UPPER = {c: c + 32 for c in range(65, 91)}
WORD_BITS = 63
NO_ID = np.iinfo(np.int64).max
BLOCK = "doc_ids array<long>, lengths binary, ends binary, places binary, tfs binary, terms array<int>, dfs array<int>, n_docs long, n_terms long"


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, in order, repeats included."""
    return TERM.findall((text or "").translate(UPPER))


class Blocks:
    """Gathers documents and yields blocks: postings of the known terms only, by term."""

    def __init__(self, terms: list[str]):
        self.known = pa.array([t.encode() for t in terms], pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.keys, self.tfs = [], [], [], []
        self.n_docs = self.n_terms = self.size = 0

    def add(self, doc_ids: list, some: list[str]) -> None:
        folded = pa.array([x.encode("utf-8", "replace").translate(FOLD) for x in some], pa.large_binary())
        split = pc.ascii_split_whitespace(folded.view(pa.large_string()))
        words = split.flatten()
        code = pc.index_in(words.view(pa.large_binary()), self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        full = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)])
        at = split.offsets.to_numpy()
        n = full[at[1:] - at[0]] - full[at[:-1] - at[0]]
        self.n_docs += int((n > 0).sum())
        self.n_terms += int(n.sum())
        doc = np.repeat(np.arange(len(some)), np.diff(at))[code >= 0]
        key, tf = np.unique(doc << 32 | code[code >= 0], return_counts=True)
        held, place = np.unique(key >> 32, return_inverse=True)
        self.keys.append((key & 0xFFFFFFFF) << 32 | place + len(self.ids))
        self.tfs.append(tf)
        self.ids += [doc_ids[i] for i in held.tolist()]
        self.lengths.append(n[held])
        self.size += len(key)

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.size >= POSTINGS

    def block(self) -> pd.DataFrame:
        key = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        order = np.argsort(key)
        terms, first = np.unique(key[order] >> 32, return_index=True)
        ends = np.append(first[1:], len(key)) if len(key) else first
        tfs = np.concatenate([*self.tfs, np.zeros(0, np.int64)])[order]
        row = {
            "doc_ids": self.ids, "lengths": np.concatenate([*self.lengths, np.zeros(0, np.int64)]).astype("<u4").tobytes(), "ends": ends.astype("<u4").tobytes(),
            "places": (key[order] & 0xFFFFFFFF).astype("<u4").tobytes(), "tfs": tfs.astype("<u4").tobytes(), "terms": terms.astype(np.int32), "dfs": np.diff(np.append([0], ends)).astype(np.int32),
            "n_docs": self.n_docs, "n_terms": self.n_terms,
        }
        self.clear()
        return pd.DataFrame([row])


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Written blocks of documents with their postings of the given terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(terms)
        for batch in batches:
            ids, at = batch["doc_id"].where(~batch["no_id"].astype(bool), NO_ID).tolist(), 0
            for group in groups(batch["text"].tolist(), SLICE):
                blocks.add(ids[at : at + len(group)], group)
                at += len(group)
                if blocks.full():
                    yield blocks.block()
        if blocks.n_docs:
            yield blocks.block()

    return written(told_ids(docs).mapInPandas(run, BLOCK), "postings")


def masks(size: int, places: list[np.ndarray]) -> np.ndarray:
    """For each of ``size`` documents the mask of the terms it holds, in words of 63 bits."""
    out = np.zeros((size, max(1, -(-len(places) // WORD_BITS))), np.int64)
    for i, place in enumerate(places):
        out[place, i // WORD_BITS] |= 1 << i % WORD_BITS
    return out


def has(mask: np.ndarray, n: int) -> np.ndarray:
    """Masks as rows of ``n`` booleans."""
    i = np.arange(n)
    return (mask[:, i // WORD_BITS] >> i % WORD_BITS & 1).astype(bool)


class Best:
    """The k best of an item so far: highest score first, then smaller doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.floor
        score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def search_block(ids: np.ndarray, places: list[np.ndarray], impacts: list[np.ndarray], best: Best) -> int:
    """Search one block for one item, whose terms' postings are given; returns how many documents were scored."""
    bound = np.array([x.max() for x in impacts], np.int64)
    order = np.argsort(bound, kind="stable")
    enough = np.cumsum(bound[order]) >= best.floor  # without a term from here on no document reaches the floor
    if not enough.any():
        return 0
    candidate = np.zeros(-(-len(ids) // 8), np.uint8)
    for i in order[np.argmax(enough) :]:
        bitmap = np.zeros(len(ids), bool)
        bitmap[places[i]] = True
        candidate |= np.packbits(bitmap)
    docs = np.flatnonzero(np.unpackbits(candidate, count=len(ids)))
    mask = masks(len(ids), places)[docs]
    distinct, group = np.unique(mask[:, 0] if mask.shape[1] == 1 else mask, axis=0, return_inverse=True)
    held = has(distinct.reshape(len(distinct), -1), len(places))
    most = held @ bound
    turn = np.argsort(-most, kind="stable")
    size = np.bincount(group, minlength=len(distinct))[turn]
    docs = docs[np.argsort(np.argsort(turn)[group], kind="stable")]  # documents of one mask side by side, masks by bound
    upto, at, step, scored = np.cumsum(size), 0, 32, 0
    while at < len(turn) and most[turn[at]] >= best.floor:
        end = max(at + 1, min(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)), int(np.searchsorted(-most[turn], -best.floor, side="right"))))
        some = np.sort(docs[upto[at] - size[at] : upto[end - 1]])
        score = np.zeros(len(some), np.int64)
        for i in np.flatnonzero(held[turn[at:end]].any(0)):
            j = np.minimum(np.searchsorted(places[i], some), len(places[i]) - 1)
            score += np.where(places[i][j] == some, impacts[i][j], 0)
        best.add(score, ids[some])
        at, step, scored = end, step * 2, scored + len(some)
    return scored


def norms(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + ((90 * n * N) div L) of each length; in Python's integers where the product leaves 64 bits."""
    kind = np.int64 if 90 * int(length.max(initial=0)) * n_docs < 1 << 63 else object
    return (10 + 90 * length.astype(kind) * n_docs // max(n_terms, 1)).astype(np.int64)


def search_items(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """The k best of a bounded block of items (item_id, terms): item, item_id, doc_id, score from each task."""
    items = [(i, t) for i, t in items if t]
    terms = list(dict.fromkeys(t for _, own in items for t in own))
    number = {t: i for i, t in enumerate(terms)}
    own = [np.array([number[t] for t in dict.fromkeys(x)]) for _, x in items]
    blocks = index(docs, terms)
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    weight = np.zeros(len(terms), np.int64)
    for term, df in found.collect():  # one row for each term of the block of items
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.asarray(row.doc_ids, np.int64)
                lengths, ends, places, tf = (np.frombuffer(x, "<u4").astype(np.int64) for x in (row.lengths, row.ends, row.places, row.tfs))
                present = np.full(len(terms), -1)
                present[np.asarray(row.terms, np.int64)] = np.arange(len(ends))
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * norms(lengths, n_docs, n_terms)[places]) * np.repeat(weight[np.asarray(row.terms, np.int64)], np.diff(np.append([0], ends)))
                places, impact = np.split(places, ends[:-1]), np.split(impact, ends[:-1])
                for mine, top in zip(own, best, strict=True):
                    at = present[mine]
                    at = at[at >= 0].tolist()
                    if at:
                        search_block(ids, [places[i] for i in at], [impact[i] for i in at], top)
        for i, top in enumerate(best):
            if len(top.doc):
                yield pd.DataFrame({"item": i, "item_id": pd.array([items[i][0]] * len(top.doc), "Int64"), "doc_id": pd.array([None if x == NO_ID else x for x in top.doc.tolist()], "Int64"), "score": top.score})

    hits = blocks.select("doc_ids", "lengths", "ends", "places", "tfs", "terms").mapInPandas(run, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_block: int = ITEMS) -> DataFrame:
    """The k highest-scoring documents above 0 of each item: item_id, rank, doc_id, score."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // item_block), -(-chars // ITEM_CHARS))
    out = None
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        hits = search_items(docs, [(i, terms_of(text)) for i, text in sorted(own, key=lambda x: (x[0] is None, x[0], x[1]))], k)
        out = hits if out is None else out.unionByName(hits)
    return out

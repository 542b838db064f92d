"""Lexical retrieval packing: windows of a seed and its nearest unused documents (operator 11).

Documents are encoded once and written. Whole windows of long documents are sequences already; what is left of each
document, its fragment, is packed with its neighbours. Terms are token ids, so document frequencies are one row for each
id of the vocabulary; they and the mean length are taken over all fragments.

The index is sharded: fragments are ordered by three min-hashes of their ids, the first before the second (a tree in which
fragments that share most of their ids stand together), dealt into ranges, and each range is cut into shards of ``SHARD``
ids. A shard is an inverted index of BM25 weights. The first unused fragment is a seed; its heaviest ``TERMS`` terms score
the unused ones, which fill the window best first. Where too few are found, the seed's further terms are asked for, twice
as many each time, and once it has no more, unused fragments follow in shard order. The last neighbour is cut where the
window is full, and its rest is the next seed. What is left at a shard's end is cut into powers of two, so there is no
padding at all.

Defined results: null and empty texts are documents of the end id alone; repeated rows and null ids are documents of their
own; a text of any length is cut into whole windows and one fragment; equal scores go in shard order; an empty table has
no pieces; extra columns of any name are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_texts, written
from lakeloom.llm.token_files import word_encoder

#: Ids of a sequence; ids of a shard; terms of a seed asked for first; BM25's two parameters.
WINDOW, SHARD, TERMS, K1, B = 4096, 1 << 21, 32, 1.2, 0.75
HASHES = 3
FRAGMENT = "doc_id long, no_id boolean, start long, doc_tokens long, whole boolean, length int, width int, ids binary, crc long, turn long, " + ", ".join(f"h{i} int" for i in range(HASHES)) + ", df array<long>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, score double"
IDS = ", width int, ids binary"


def orders(size: int) -> np.ndarray:
    """For each min-hash a fixed random order of the ids of a vocabulary."""
    return np.array([np.random.default_rng(i).permutation(size) for i in range(HASHES)], np.int32)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a fragment, ascending, and how often each occurs."""
    some = np.sort(ids)
    first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
    return some[first], np.diff(np.append(first, len(some)))


def checksum(ids: bytes, width: int) -> int:
    """crc32 of ids as little-endian 32-bit integers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4"))


def fragments(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """The whole windows and the rest of each encoded document, written, and a row of each task with ``df``: in how many of
    its rests each id occurs (``whole`` is null there)."""
    names = [c.split()[0] for c in FRAGMENT.split(", ")]

    def run(slices: Iterator[tuple[list, list, list]]) -> Iterator[pd.DataFrame]:
        tool = word_encoder(tokenizer)
        ranks, width = orders(len(tool.ends)), tool.dtype.itemsize
        end, turn = np.asarray([end_id], tool.dtype).tobytes(), TaskContext.get().partitionId() << 32
        df, rows = np.zeros(len(tool.ends), np.int64), []
        for doc_ids, no_ids, some in slices:
            for doc_id, no_id, ids in zip(doc_ids, no_ids, tool.encode(some), strict=True):
                ids += end
                n = len(ids) // width
                for lo in range(0, n, window):
                    own = ids[lo * width : (lo + window) * width]
                    whole = len(own) == window * width
                    crc = checksum(own, width) if whole else 0
                    low, turn = (0,) * HASHES, turn + 1
                    if not whole:
                        terms = counted(np.frombuffer(own, tool.dtype))[0]
                        df[terms] += 1
                        low = ranks[:, terms].min(1).tolist()
                    rows.append((doc_id, no_id, lo, n, whole, len(own) // width, width, own, crc, turn, *low, None))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        rows.append((0, True, 0, 0, None, 0, width, b"", 0, turn + 1, *(0,) * HASHES, df))
        yield pd.DataFrame(rows, columns=names)

    return written(map_texts(docs, run, FRAGMENT), "fragments")


def document_frequencies(table: DataFrame) -> DataFrame:
    """term, df over all rests: what each task has added up, added up."""
    each = table.filter("df IS NOT NULL").select(F.posexplode("df").alias("term", "df")).filter("df > 0")
    return each.groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """An inverted index of BM25 weights over some fragments, and the windows made of them."""

    def __init__(self, fragments: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
        self.window, self.sizes = window, np.array([len(x) for x in fragments])
        found = [counted(x) for x in fragments]
        n = np.array([len(t) for t, _ in found])
        self.ends = np.cumsum(n)
        self.terms = np.concatenate([t for t, _ in found])
        tf, doc = np.concatenate([c for _, c in found]), np.repeat(np.arange(len(n), dtype=np.int32), n)
        norm = K1 * (1 - B + B * self.sizes / mean)
        self.weights = idf[self.terms] * (tf * (K1 + 1) / (tf + norm[doc]))
        order = np.argsort(self.terms, kind="stable")
        self.posted, self.posted_weight = doc[order], self.weights[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=len(idf)))])

    def query(self, seed: int) -> np.ndarray:
        """The seed's terms, heaviest first."""
        lo, hi = self.ends[seed - 1] if seed else 0, self.ends[seed]
        return self.terms[lo:hi][np.argsort(-self.weights[lo:hi], kind="stable")].astype(np.int64)

    def neighbours(self, seed: int, used: np.ndarray, room: int) -> Iterator[tuple[int, float]]:
        """Unused fragments by score, until they fill the room or the seed's terms are asked for."""
        terms, at, step = self.query(seed), 0, TERMS
        score = np.zeros(len(self.sizes))
        while room > 0 and at < len(terms):
            lists = [slice(a, b) for a, b in zip(self.first[terms[at : at + step]].tolist(), self.first[terms[at : at + step] + 1].tolist(), strict=True)]
            score += np.bincount(np.concatenate([self.posted[x] for x in lists]), np.concatenate([self.posted_weight[x] for x in lists]), len(score))
            at, step = at + step, step * 2
            found = np.flatnonzero((score > 0) & ~used)
            if at < len(terms) and self.sizes[found].sum() < room:
                continue
            for i in found[np.argsort(-score[found], kind="stable")].tolist():
                yield i, float(score[i])
                room -= int(self.sizes[i])
                if room <= 0:
                    return

    def windows(self) -> Iterator[list[tuple[int, int, int, float | None]]]:
        """Windows as lists of fragment, its part from and to, score; the last one may not be full."""
        used, after = np.zeros(len(self.sizes), bool), 0
        seed, begin = 0, 0
        while True:
            used[seed] = True
            out, room = [(seed, begin, int(self.sizes[seed]), None)], self.window - int(self.sizes[seed]) + begin
            left = None
            for i, score in self.neighbours(seed, used, room):
                used[i] = True
                size = min(room, int(self.sizes[i]))
                out.append((i, 0, size, score))
                room -= size
                left = (i, size) if size < self.sizes[i] else None
            while room > 0:  # the seed shares no term with what is unused
                while after < len(used) and used[after]:
                    after += 1
                if after == len(used):
                    break
                used[after] = True
                size = min(room, int(self.sizes[after]))
                out.append((after, 0, size, None))
                room -= size
                left = (after, size) if size < self.sizes[after] else None
            yield out
            while after < len(used) and used[after]:
                after += 1
            if left is None and after == len(used):
                return
            seed, begin = left or (after, 0)


def sequences(parts: list[tuple], window: int) -> Iterator[list[tuple]]:
    """A window as it is; one that is not full cut into powers of two, the largest first."""
    left = sum(hi - lo for _, lo, hi, _ in parts)
    if left == window:
        yield parts
        return
    parts = parts[::-1]
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        out = []
        while room:
            i, lo, hi, score = parts.pop()
            cut = min(hi, lo + room)
            if cut < hi:
                parts.append((i, cut, hi, score))
            out.append((i, lo, cut, score))
            room -= cut - lo
        yield out


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shard: int = SHARD, ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, score (of a
    neighbour, against its seed), and with ``ids`` the ids themselves (of ``width`` bytes each, little-endian)."""
    table, kind = fragments(docs, tokenizer, end_id, window), PIECE + IDS * ids
    rests = table.filter("not whole")
    n, tokens = rests.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    counts = document_frequencies(table).toPandas()  # a row for each id of the vocabulary at most
    df = np.zeros(1 + int(counts["term"].max()) if len(counts) else 1)
    df[counts["term"]] = counts["df"]
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), tokens / max(n, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, names = TaskContext.get().partitionId() << 32, [c.split()[0] for c in kind.split(", ")]
        names.insert(1, "no_id")
        rows: list[tuple] = []
        size = 0

        def packed() -> Iterator[pd.DataFrame]:
            nonlocal number
            out = []
            for parts in Shard([np.frombuffer(x[5], f"<u{x[4]}") for x in rows], idf, mean, window).windows():
                for some in sequences(parts, window):
                    offset = 0
                    for i, lo, hi, score in some:
                        doc_id, no_id, start, doc_tokens, width, own = rows[i]
                        own = own[lo * width : hi * width]
                        out.append((doc_id, no_id, start + lo, hi - lo, checksum(own, width), doc_tokens, 2 * number + 1, offset, score, *((width, own) if ids else ())))
                        offset += hi - lo
                    number += 1
            for lo in range(0, len(out), 4000):
                each = pd.DataFrame(out[lo : lo + 4000], columns=names)
                each["doc_id"] = pd.arrays.IntegerArray(each["doc_id"].to_numpy(np.int64), each["no_id"].to_numpy(bool))
                yield each.drop(columns="no_id").astype({"score": float})

        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in ("doc_id", "no_id", "start", "doc_tokens", "width", "ids")), strict=True):
                rows.append(row)
                size += len(row[5]) // row[4]
                if size >= shard:
                    yield from packed()
                    rows, size = [], 0
        if rows:
            yield from packed()

    keys = [*(f"h{i}" for i in range(HASHES)), "turn"]
    ordered = rests.repartitionByRange(max(1, -(-tokens // shard)), *keys).sortWithinPartitions(*keys)
    mixed = ordered.select("doc_id", "no_id", "start", "doc_tokens", "width", "ids").mapInPandas(run, kind)
    whole = table.filter("whole").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("double").alias("score"), *(("width", "ids") if ids else ()),
    )
    return whole.unionByName(mixed)

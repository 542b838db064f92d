"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs (operator 7).

Each piece of the pre-tokenizer is encoded on its own. A segment tree keeps, for every adjacent pair of symbols, the
key ``rank * width + position``; the root is therefore the leftmost pair of lowest rank. A merge changes three leaves,
each a logarithmic update; encoding ends when the root holds no mergeable pair.

Defined results: a null text is an empty one; an empty text has no ids; texts of any length are handled whole; added
special strings inside a text are found before anything else, as the library does by default; repeated rows are rows of
their own with equal results; an empty table gives no rows; extra columns of any name are left out unless asked for.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lakeloom.llm.common import texts

#: Fixed value: the splitting pattern of byte-level BPE files whose pre-tokenizer is ByteLevel with use_regex.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No merge; what stands after the last symbol.
NONE, END = 1 << 60, (1 << 20) - 1
#: Symbols in the arrays of one block of pieces; characters of the texts that are split at a time.
BLOCK, SLICE = 1 << 18, 1 << 21
#: Pieces longer than this of which there are only few together have a tree each.
LONG, FEW = 256, 32
#: Entries of usual size that a worker keeps for pieces and for space-separated chunks before it starts again; bytes of one.
CACHE, ENTRY = 350_000, 220


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, all others take the code points from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in own else next(extra)) for b in range(256)]


def build_trees(keys: np.ndarray) -> list[np.ndarray]:
    """One segment tree for minima in each row: levels from the leaves (a power of two of them) up to the root."""
    levels = [keys]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    return levels


def put(levels: list[np.ndarray], row: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
    """Point update: set one leaf of each given row and renew the minima on its path to the root."""
    levels[0][row, leaf] = key
    for below, level in zip(levels, levels[1:], strict=False):
        leaf = leaf >> 1
        level[row, leaf] = np.minimum(below[row, 2 * leaf], below[row, 2 * leaf + 1])


class Vocabulary:
    """A byte-level BPE file: pair ranks, the ids of bytes, the bytes of ids, and the added strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.bytes_of: list[bytes] = [b""] * (1 + max(max(vocab.values()), *self.added.values(), 0))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        #: The id that the merge of each rank makes; all pairs in order, with their ranks.
        parts = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in parts], np.int64)
        pair = np.array([vocab[a] << 20 | vocab[b] for a, b in parts], np.int64)
        self.pair_rank = np.argsort(pair)
        self.pairs = pair[self.pair_rank]
        self.rank_of: dict[int, int] = {}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where nothing merges them."""
        pair = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token. Pieces of similar length share one array with a row and a tree for each."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width, order = 2, np.argsort(lengths, kind="stable")
        while len(order):
            cut = np.searchsorted(lengths[order], width, side="right")
            step = max(1, BLOCK // width)
            for lo in range(0, cut, step):
                some = order[lo : min(cut, lo + step)]
                if width > LONG and len(some) < FEW:
                    for i in some.tolist():
                        out[i] = self._encode_long(pieces[i])
                    continue
                for i, ids in zip(some.tolist(), self._encode_block([pieces[i] for i in some], lengths[some], width), strict=True):
                    out[i] = ids
            order, width = order[cut:], width * 2
        return out

    def _encode_block(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[np.ndarray]:
        rows = np.arange(len(pieces))
        inside = np.arange(width + 1) < lengths[:, None]
        ids = np.full(inside.shape, END, np.int64)  # a column more than symbols: the end of the longest pieces
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), ids.shape).copy()
        before = after - 2
        key = self.ranks(ids[:, :-1], ids[:, 1:])
        trees = build_trees(np.where(key == NONE, NONE, key * width + np.arange(width)))
        while len(rows := rows[trees[-1][rows, 0] != NONE]):
            rank, i = np.divmod(trees[-1][rows, 0], width)
            j = after[rows, i]
            k = after[rows, j]
            new = self.merged[rank]
            ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = new, -1, k, i
            put(trees, rows, j, np.full(len(rows), NONE))
            key = self.ranks(new, ids[rows, k])
            put(trees, rows, i, np.where(key == NONE, NONE, key * width + i))
            left = before[rows, i] >= 0
            row, h = rows[left], before[rows, i][left]
            key = self.ranks(ids[row, h], new[left])
            put(trees, row, h, np.where(key == NONE, NONE, key * width + h))
        kept = (ids >= 0) & (ids != END)
        return np.split(ids[kept].astype("<u4"), np.cumsum(kept.sum(1))[:-1])

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece, by a tree of its own: an update ends where a node keeps its minimum."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True))
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n, m = len(ids), 1 << (len(piece) - 1).bit_length()
        leaves = np.full(m, NONE)
        rank = self.ranks(ids[:-1], ids[1:])
        leaves[: n - 1] = np.where(rank == NONE, NONE, rank * m + np.arange(n - 1))
        tree = array("q", np.concatenate([[NONE], *(x[0] for x in build_trees(leaves[None])[::-1])]).tobytes())
        ids, after, before = array("q", ids.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank_of, merged = self.rank_of.get, self.merged.tolist()

        def put_leaf(at: int, key: int) -> None:
            at += m
            while at and tree[at] != key:
                tree[at] = key
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                key = a if a < b else b

        while (key := tree[1]) != NONE:
            rank, i = divmod(key, m)
            j = after[i]
            k = after[j]
            new = merged[rank]
            ids[i], ids[j], after[i] = new, -1, k
            put_leaf(j, NONE)
            found = None
            if k < n:
                before[k] = i
                found = rank_of(new << 20 | ids[k])
            put_leaf(i, NONE if found is None else found * m + i)
            h = before[i]
            if h >= 0:
                found = rank_of(ids[h] << 20 | new)
                put_leaf(h, NONE if found is None else found * m + h)
        out = np.frombuffer(ids, np.int64)
        return out[out >= 0].astype("<u4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Whole texts to ids, with caches of bounded size for pieces and for chunks between single spaces.

    Pieces never run from a non-space into a space, so a chunk that neither begins nor ends with white space can be
    encoded by itself with the space before it.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.vocabulary, self.cache = Vocabulary(path), cache
        self.findall = regex.compile(PIECES).findall
        self.pieces: dict[str, bytes] = {}
        #: None for a chunk that does not stand alone.
        self.chunks: dict[str, bytes | None] = {}
        self.pieces_size = self.chunks_size = 0

    def learn_pieces(self, pieces: set[str]) -> None:
        if self.pieces_size > self.cache * ENTRY:  # what is in use stays
            self.pieces = {x: self.pieces[x] for x in pieces if x in self.pieces}
            self.pieces_size = 200 * len(self.pieces) + 2 * sum(map(len, self.pieces))
        new = [x for x in pieces if x not in self.pieces]
        for piece, ids in zip(new, self.vocabulary.encode_pieces([x.encode("utf-8", "surrogatepass") for x in new]), strict=True):
            self.pieces[piece] = ids.tobytes()
        self.pieces_size += 200 * len(new) + 2 * sum(map(len, new))

    def learn_chunks(self, chunks: set[str]) -> None:
        if self.chunks_size > self.cache * ENTRY:
            self.chunks = {x: self.chunks[x] for x in chunks if x in self.chunks}
            self.chunks_size = 200 * len(self.chunks) + 2 * sum(map(len, self.chunks))
        new = [x for x in chunks if x not in self.chunks]
        split = [None if not x or x[0].isspace() or x[-1].isspace() else self.findall(" " + x) for x in new]
        self.learn_pieces({y for x in split if x for y in x})
        for chunk, found in zip(new, split, strict=True):
            self.chunks[chunk] = None if found is None else b"".join(map(self.pieces.__getitem__, found))
        self.chunks_size += 200 * len(new) + 2 * sum(map(len, new))

    def by_pieces(self, text: str) -> bytes:
        found = self.findall(text)
        self.learn_pieces(set(found))
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, some: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        added = self.vocabulary.added
        for group in groups(some, SLICE):
            parts = [[x for x in self.vocabulary.split_added.split(text) if x] if any(x in text for x in added) else [text] for text in group]
            plain = self.by_chunks([part for text in parts for part in text if part not in added])
            for text in parts:
                found = [np.asarray([added[part]], "<u4").tobytes() if part in added else next(plain) for part in text]
                yield np.frombuffer(b"".join(found), "<u4")

    def by_chunks(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part, put together from its chunks column-wise; a part with a chunk that does not stand alone
        goes by its pieces."""
        split = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn_chunks(set(distinct))
        ids = list(map(self.chunks.__getitem__, distinct))
        odd = np.fromiter((x is None for x in ids), bool, len(ids))
        ids = [x or b"" for x in ids]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        code, at = chunks.indices.to_numpy(), split.offsets.to_numpy()
        wide, odd = size[code], odd[code]
        first = at[:-1]
        wide[first] = 0  # the first chunk has no space before it
        odd[first] = False
        apart = np.add.reduceat(odd, first).tolist() if len(first) else []
        ends = np.concatenate([[0], np.cumsum(wide)])
        stream = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[code] - ends[:-1], wide) + np.arange(ends[-1])]
        cut = ends[at].tolist()
        for part, some, a, b in zip(parts, apart, cut, cut[1:], strict=False):
            head = part.split(" ", 1)[0]
            whole = some or not head or head[-1].isspace()
            yield self.by_pieces(part) if whole else self.by_pieces(head) + stream[a:b].tobytes()


def groups(some: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters together."""
    group, size = [], 0
    for text in some:
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder for each worker process, file and size of caches."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids array<int> for each document; one row for each row given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for batch in batches:
            yield batch.assign(ids=[ids.astype(np.int32) for ids in encode(batch["text"].tolist())])

    return texts(docs).mapInPandas(run, "doc_id long, text string, ids array<int>")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = (), cache: int = CACHE) -> DataFrame:
    """Encode each text and decode its ids again: doc_id, n_tokens, digest of the ids, digest of the decoded text,
    whether the decoded text is the text (it is unless the text holds broken surrogates), and the columns to ``keep``."""
    rows = texts(docs, keep)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, cache)
        decimal = [str(i).encode() for i in range(len(tool.vocabulary.bytes_of))].__getitem__
        for batch in batches:
            found = []
            some = batch["text"].tolist()
            for doc_id, text, encoded in zip(batch["doc_id"], some, tool.encode(some), strict=True):
                ids = encoded.tolist()
                back = tool.vocabulary.decode(ids)
                found.append((doc_id, len(ids), hashlib.sha256(b",".join(map(decimal, ids))).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            out = pd.DataFrame(found, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
            yield out.assign(**{c: batch[c] for c in keep})

    return rows.mapInPandas(run, schema)

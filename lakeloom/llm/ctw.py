"""Context-tree weighting over bytes (operator 3).

Every byte is eight binary decisions down a tree of 255 nodes; each node has a context tree over the bytes before, up to
``DEPTH`` of them, with a Krichevsky-Trofimov estimate at every depth. The weighted probability of a context is half its
own estimate and half the product of its children's; a byte's code length mixes the estimates of all depths accordingly.

Texts meet in blocks of bounded size. A block gives its distinct n-grams and words with their training counts; counts are
summed over all blocks; the context trees are weighted in groups that share the two bytes before (at most 2^24
n-grams each), while depths 0 and 1 (at most 256 x 255 nodes) pass through the driver. The code length of each n-gram and
the count of each word then go back to the blocks that hold them, so that nothing that grows is broadcast.

Defined results: null and empty texts are the end mark alone; repeated rows count as often as they stand there; without
training texts every estimate is one half; texts of any length are whole; an empty table gives no rows; extra columns of
any name are left out. Words are keyed by their 64-bit hash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import crc_mod, texts, written

DEPTH = 4
FOLDS, HELD_OUT = 7, 2
#: Bytes of text of a block and of a slice of it, about.
BLOCK, SLICE = 12_000_000, 3_000_000
WORDS, GRAMS, TEXTS = 0, 1, 2
#: The least number of parts in which n-grams are weighted; n-grams of a part.
PARTS, PART = 64, 250_000
#: Cells of the tables by which n-grams are numbered; beyond, they are sorted.
CELLS = 1 << 25


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # of bytes, this is A-Z only


def stream(data: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each after ``depth`` zeros and with a zero as its end; where each one's bytes begin."""
    mark = bytes(depth)
    whole = np.frombuffer(b"".join(x for d in data for x in (mark, d, b"\0")), np.uint8)
    sizes = np.fromiter((len(d) + depth + 1 for d in data), np.int64, len(data))
    return whole, np.cumsum(sizes) - sizes


def numbered(whole: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each position (from n-1 on): their numbers, and the sorted distinct n-grams as integers.

    Numbers grow byte by byte: the distinct (i-1)-grams, times the alphabet, are the cells of a table."""
    used = np.flatnonzero(np.bincount(whole, minlength=256))
    code = np.zeros(256, np.int32)
    code[used] = np.arange(len(used))
    codes = code[whole]
    size = len(whole) - n + 1
    ids, grams = codes[:size], used.astype(np.int64)
    for i in range(1, n):
        cells = len(grams) * len(used)
        if cells > CELLS:
            ids = ids.astype(np.int64) * len(used) + codes[i : i + size]
            kept, ids = np.unique(ids, return_inverse=True)
        else:
            ids = ids * np.int32(len(used)) + codes[i : i + size]
            kept = np.flatnonzero(np.bincount(ids, minlength=cells))
            number = np.zeros(cells, np.int32)
            number[kept] = np.arange(len(kept))
            ids = number[ids]
        grams = grams[kept // len(used)] << 8 | used[kept % len(used)]
        ids = ids.astype(np.int32, copy=False)
    return ids, grams


def slices(data: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` bytes together, so that arrays stay small."""
    out, lo, size = [], 0, 0
    for i, d in enumerate(data):
        size += len(d)
        if size >= SLICE:
            out.append((lo, i + 1))
            lo, size = i + 1, 0
    return out if lo == len(data) else [*out, (lo, len(data))]


def word_key(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def counted(group: pd.DataFrame) -> pd.DataFrame:
    """block, kind, key and training count of the distinct words and n-grams of one block, and its training texts."""
    data = [encoded(x) for x in group["text"]]
    train = ~group["held_out"].to_numpy()
    words: Counter = Counter()
    for d, learn in zip(data, train.tolist(), strict=True):
        if learn:
            words.update(d.split())
    for d, learn in zip(data, train.tolist(), strict=True):
        if not learn:
            for w in d.split():
                if w not in words:
                    words[w] = 0
    found, counts = [], []
    for lo, hi in slices(data):
        whole, begins = stream(data[lo:hi])
        ids, grams = numbered(whole, DEPTH + 1)
        sizes = np.diff(np.append(begins, len(whole)))
        weight = np.repeat(train[lo:hi], sizes)[DEPTH:]  # by the text of the byte that is predicted
        inner = np.ones(len(whole), bool)
        inner[(begins[:, None] + np.arange(DEPTH)).ravel()] = False  # the marks before a text are not predicted
        count = np.bincount(ids[weight & inner[DEPTH:]], minlength=len(grams))
        seen = np.bincount(ids[inner[DEPTH:]], minlength=len(grams)) > 0
        found.append(grams[seen])
        counts.append(count[seen])
    grams, inverse = np.unique(np.concatenate(found), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(counts), len(grams)).astype(np.int64)
    return pd.DataFrame(
        {
            "block": group["block"].iloc[0],
            "kind": np.concatenate([np.full(len(words), WORDS), np.full(len(grams), GRAMS), [TEXTS]]).astype(np.int32),
            "key": np.concatenate([np.fromiter(map(word_key, words), np.int64, len(words)), grams, [0]]),
            "n": np.concatenate([np.fromiter(words.values(), np.int64, len(words)), count, [int(train.sum())]]),
        }
    )


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function at n + 1/2 over that at 1/2, by Stirling's series from 10 on."""
    small = np.cumsum(np.log(np.concatenate([[1.0], np.arange(10) + 0.5])))
    x = np.maximum(n, 10) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * math.log(math.pi)
    return np.where(n < 10, small[np.minimum(n, 10).astype(np.int64)], series)


def log_gamma(n: np.ndarray) -> np.ndarray:
    """Natural logarithm of n factorial."""
    small = np.cumsum(np.log(np.concatenate([[1.0], np.arange(1, 10)])))
    x = np.maximum(n, 9) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 10, small[np.minimum(n, 9).astype(np.int64)], series)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_factorial(zeros) + log_factorial(ones) - log_gamma(zeros + ones)


class Nodes:
    """The binary nodes of all contexts of one depth: sorted keys (context, node), counts, estimate, weighted."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int):
        context = (gram >> 8) & ((1 << 8 * depth) - 1)
        byte = gram & 255
        self.rows, self.bits = [], []
        keys, bits = [], []
        for j in range(8):
            keys.append(context << 8 | (1 << j | byte >> (8 - j)))
            bits.append(byte >> (7 - j) & 1)
        self.key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        self.at = inverse.reshape(8, -1)  # the node of each n-gram at each of its eight decisions
        self.bit = np.stack(bits)
        ones = np.bincount(inverse, (self.bit * count).ravel(), len(self.key))
        both = np.bincount(inverse, np.tile(count, 8), len(self.key))
        self.zeros, self.ones = both - ones, ones
        self.estimate = kt(self.zeros, self.ones)
        self.weighted = self.estimate

    def parents(self, depth: int) -> np.ndarray:
        """The keys of the nodes one byte of context shorter, for nodes of this depth."""
        return (self.key >> 8 & ((1 << 8 * (depth - 1)) - 1)) << 8 | self.key & 255

    def weigh(self, children: np.ndarray) -> np.ndarray:
        """Mix with the logs of the children's products; returns the share of the own estimate."""
        self.weighted = np.logaddexp(self.estimate, children) - math.log(2)
        return np.exp(self.estimate - math.log(2) - self.weighted)

    def chance(self) -> np.ndarray:
        """The estimate of each decision that the n-grams take."""
        zeros, ones = self.zeros[self.at], self.ones[self.at]
        return np.where(self.bit == 1, ones + 0.5, zeros + 0.5) / (zeros + ones + 1)


def deep(gram: np.ndarray, count: np.ndarray, top: int, depth: int = DEPTH) -> tuple[Nodes, np.ndarray]:
    """Weigh the nodes from ``depth`` up to ``top``: the nodes at ``top``, and for each n-gram and decision the mixed
    chance of depths ``top`` and below."""
    below = Nodes(gram, count, depth)
    # a context without training counts holds no data: its estimate is one half, whatever lies below it
    mixed = below.chance()
    for d in range(depth - 1, top - 1, -1):
        nodes = Nodes(gram, count, d)
        share = nodes.weigh(np.bincount(np.searchsorted(nodes.key, below.parents(d + 1)), below.weighted, len(nodes.key)))
        share = share[nodes.at]
        mixed = share * nodes.chance() + (1 - share) * mixed
        below = nodes
    return below, mixed


def summits(group: pd.DataFrame) -> pd.DataFrame:
    """What depth 1 needs of groups with the same two bytes before: counts and weighted probability of its nodes at depth 2."""
    group = group.sort_values("key")
    nodes, _ = deep(group["key"].to_numpy(), group["n"].to_numpy().astype(float), 2)
    return pd.DataFrame({"node": nodes.parents(2), "zeros": nodes.zeros, "ones": nodes.ones, "weighted": nodes.weighted})


def top_shares(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables by context byte and node for depth 1, and by node for depth 0: the share of the own estimate and the
    chance of a one. ``rows`` are the sums over groups: node, zeros, ones, weighted."""
    share, one = np.full(1 << 16, 0.5), np.full(1 << 16, 0.5)
    zeros, ones, children = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
    at = rows["node"].to_numpy()
    zeros[at], ones[at], children[at] = rows["zeros"], rows["ones"], rows["weighted"]
    own = kt(zeros, ones)
    weighted = np.logaddexp(own, children) - math.log(2)
    share, one = np.exp(own - math.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1)
    zeros, ones, children = (x.reshape(256, 256).sum(0) for x in (zeros, ones, weighted))
    own = kt(zeros, ones)
    weighted = np.logaddexp(own, children) - math.log(2)
    return share, one, np.exp(own - math.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1)


def code_lengths(gram: np.ndarray, count: np.ndarray, tops: tuple[np.ndarray, ...]) -> np.ndarray:
    """The log10 probability of the last byte of each n-gram (sorted; whole groups with the same two bytes before it)."""
    nodes, mixed = deep(gram, count, 2)
    byte, last = gram & 255, gram >> 8 & 255
    node = np.stack([1 << j | byte >> (8 - j) for j in range(8)])
    share, one, share_0, one_0 = tops
    for s, p in ((share[last << 8 | node], one[last << 8 | node]), (share_0[node], one_0[node])):
        mixed = s * np.where(nodes.bit == 1, p, 1 - p) + (1 - s) * mixed
    return np.log10(mixed).sum(0)


def score_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, a row for each given."""
    rows = texts(docs).withColumn("held_out", crc_mod("doc_id", FOLDS) == HELD_OUT)
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // block)))).cast("int"))
    stats = written(rows.groupBy("block").applyInPandas(counted, "block int, kind int, key long, n long"), "counts")
    kind = lambda k: stats.filter(F.col("kind") == k)

    grams = kind(GRAMS).groupBy("key").agg(F.sum("n").alias("n")).withColumn("near", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    grams = written(grams, "grams")
    parts = max(PARTS, -(-grams.count() // PART))
    grams = grams.withColumn("near", F.pmod(F.hash("near"), F.lit(parts)))  # several such groups in one call
    tops = grams.groupBy("near").applyInPandas(summits, "node long, zeros double, ones double, weighted double")
    tops = top_shares(tops.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toPandas())

    def lengths(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        return pd.DataFrame({"key": group["key"], "value": code_lengths(group["key"].to_numpy(), group["n"].to_numpy().astype(float), tops)})

    lengths = grams.groupBy("near").applyInPandas(lengths, "key long, value double")
    words = written(kind(WORDS).groupBy("key").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    learned = kind(TEXTS).agg(F.sum("n")).first()[0] or 0
    n, v = (total[0] or 0) + learned, (total[1] or 0) + (learned > 0)

    back = kind(GRAMS).select("block", "kind", "key").join(lengths, "key")
    known = kind(WORDS).select("block", "kind", "key").join(words.select("key", F.log10(F.col("n") + F.lit(1.0)).alias("value")), "key")
    back = back.select("block", "kind", "key", "value").union(known.select("block", "kind", "key", "value"))

    def score(group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({})
        data = [encoded(x) for x in group["text"]]
        is_word = given["kind"].to_numpy() == WORDS
        key, value = given["key"].to_numpy(), given["value"].to_numpy()
        of_key = dict(zip(key[is_word].tolist(), value[is_word].tolist(), strict=True))
        cache: dict[bytes, float] = {}
        out = []
        for d in data:
            words = d.split()
            for w in set(words).difference(cache):
                cache[w] = of_key[word_key(w)]
            logs = np.fromiter(map(cache.__getitem__, words), float, len(words))
            out.append((len(words) + 1, int(np.count_nonzero(logs)) + (learned > 0), float(logs.sum()) + math.log10(learned + 1) - (len(words) + 1) * math.log10(n + v + 1)))
        order = np.argsort(key[~is_word])
        key, value = key[~is_word][order], value[~is_word][order]
        inner = []
        for lo, hi in slices(data):
            whole, begins = stream(data[lo:hi])
            ids, grams = numbered(whole, DEPTH + 1)
            at = np.minimum(np.searchsorted(key, grams), len(key) - 1)
            sums = np.cumsum(np.where(key[at] == grams, value[at], 0.0)[ids])  # 0: n-grams that only end in marks
            sums = np.concatenate([[0.0], sums])
            inner.append(sums[np.append(begins[1:], len(whole)) - DEPTH] - sums[begins])
        inner = np.concatenate(inner)
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"], "held_out": group["held_out"], "n_tokens": [x[0] for x in out], "n_known": [x[1] for x in out], "train_tokens": n, "base_score": [x[2] for x in out],
                "score": inner, "bits_per_byte": -inner * math.log2(10) / np.fromiter((len(d) + 1 for d in data), float, len(data)),
            }
        )

    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")

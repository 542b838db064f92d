"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 4).

Statistics are measured once for every whole text and written to the shared folder. Trees are fitted on a bounded sample
of labelled rows (``SAMPLE``, a parameter: those whose doc_id hashes lowest), with values binned by quantiles, and are
flattened into arrays: a complete binary tree for each round, traversed for all rows of a batch at once by numpy.

Defined results: null and empty texts have all statistics zero and get a score like any other; a document labelled more
than once counts with its lowest label; null labels are ignored; without any label the score is 0.5; repeated
rows are rows of their own with equal scores; of equal hashes, the sample takes the smaller doc_id, then the smaller
statistics; of equal gains, a split takes the first statistic and the lowest cut; an empty table gives no rows; extra columns
of any name are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import crc_mod, texts, written

SAMPLE, ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 20_000, 120, 4, 0.1, 64, 10.0, 1.0
#: Folds by crc32 of the doc_id: this one is never learned from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "distinct_words", "top_word", "top_5_words", "single_words", "lines", "distinct_lines", "top_line", "line_words",
    "upper", "lower", "digits", "blanks", "marks", "symbols", "above_ascii", "marked_words", "upper_words", "repeats", "packed",
)
_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 punctuation, 6 symbol, 7 above ASCII
for _chars, _kind in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), ((32, *range(9, 14)), 4), (map(ord, ".,;:?'\"()-"), 5), (map(ord, "!#$%&*+/<=>@[\\]^_`{|}~"), 6), (range(128, 256), 7)):
    for _c in _chars:
        _KIND[_c] = _kind


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8) / len(data)
    n = len(words)
    count = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    line_count = Counter(lines)
    top = sorted(count.values(), reverse=True)[:5]
    distinct = len(count)
    marked = sum(c for w, c in count.items() if not w[-1].isalnum() and w[-1] not in ".,;:?")
    shouted = sum(c for w, c in count.items() if w.isupper())
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float((lengths > 15).mean()), distinct / n, top[0] / n, sum(top) / n,
        sum(c == 1 for c in count.values()) / n, float(np.log1p(len(lines))), len(line_count) / max(1, len(lines)), max(line_count.values(), default=0) / max(1, len(lines)), n / max(1, len(lines)),
        *kinds[1:8].tolist(), marked / n, shouted / n, again / n, len(zlib.compress(data, 1)) / len(data),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, one row for each row given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(np.array([statistics(x) for x in batch["text"]], float).reshape(len(batch), len(STATISTICS)), columns=STATISTICS)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return texts(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has its children at 2i+1 and 2i+2; leaves hold log-odds."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for log-loss, grown level by level from histograms of gradients."""
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    forest = Forest(float(np.log(mean / (1 - mean))), np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return forest
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: at most cut b
    total = np.full(len(y), forest.base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            at = node - first
            whole_g, whole_h = np.bincount(at, gradient, wide), np.bincount(at, weight, wide)
            for f in range(features):
                key = at * BINS + binned[:, f]
                g = np.bincount(key, gradient, wide * BINS).reshape(wide, BINS).cumsum(1)[:, : len(cuts[f])]
                h = np.bincount(key, weight, wide * BINS).reshape(wide, BINS).cumsum(1)[:, : len(cuts[f])]
                if not g.shape[1]:
                    continue
                n = np.bincount(key, minlength=wide * BINS).reshape(wide, BINS).cumsum(1)[:, : len(cuts[f])]
                rest_g, rest_h = whole_g[:, None] - g, whole_h[:, None] - h
                gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - (whole_g**2 / (whole_h + RIDGE))[:, None]
                gain[(n < LEAST) | (np.bincount(at, minlength=wide)[:, None] - n < LEAST)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(wide), b]
                for k in np.flatnonzero(top > best):
                    best[k], forest.feature[t, first + k], forest.cut[t, first + k] = top[k], f, cuts[f][b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t, node]] > forest.cut[t, node])
        leaf = node - inner
        forest.leaf[t] = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + RIDGE)
        total += forest.leaf[t, leaf]
    return forest


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row given."""
    rows = written(measured(docs), "statistics")
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    learn = rows.join(marks, "doc_id").filter(crc_mod("doc_id", FOLDS) != HELD_OUT)
    # hashes below a share that holds somewhat more than the sample: what reaches the driver stays bounded in all
    share = min(1.0, 1.6 * sample / max(1, marks.count()))
    learn = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else learn
    learn = learn.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id", *STATISTICS).limit(sample).toPandas()
    forest = fit(learn[list(STATISTICS)].to_numpy(float), (learn["quality"].to_numpy() >= 1).astype(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = forest.score(batch[list(STATISTICS)].to_numpy(float))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    scored = rows.mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")

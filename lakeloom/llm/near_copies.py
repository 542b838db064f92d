"""Near copies for the corpus pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Operator 9's rule (three words, two bits) is bound to its query; at a similarity of 0.8 five-word fingerprints lie about
ten of 64 bits apart, and a budget that holds such pairs (17 bits) lets a fixed share of all pairs of texts through.
Candidates therefore come from the SimHash tries at their narrow budget and from minhash bands: two texts of similarity
0.8 share one of 30 bands of five minhashes with probability 1 - 7e-6. In each of three rounds, a bucket's members meet one of
them if no link has put them into its component, which takes a row a member at most; pairs whose minhashes agree far less than 0.8 asks for are left out (a similar pair falls below
``LEAST`` of 150 with probability 1e-7), the rest is checked on its texts, so nothing is linked below 0.8.

After the components of these links, the texts of buckets that still hold several components meet by their prefixes: with
shingles in ascending order of frequency, two similar texts share one of the first fifth of each, at positions that leave
room for the overlap. That join loses no pair, and texts that differ by edits of their own from a common source, which a
bucket holds by the thousand, mostly have no position left in common.

Defined results: null, empty and blank texts are copies of each other; a text of fewer than five words is one shingle;
repeated rows are one text; an empty table gives no rows; extra columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import simhash
from lakeloom.llm.common import dropped, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 30, 5
#: Rounds in which the members of a bucket meet one of them.
STARS = 3
#: Of all minhashes, how many of a candidate pair agree in their low bytes at least.
LEAST = 92
#: Shingles whose minhashes are computed at once.
CUT = 1 << 12

_TURN = np.random.default_rng(simhash.SEED)
_FLIP = _TURN.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_ODD = _TURN.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; one zero for a text without words."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    return distinct(simhash.shingle_hashes(text, SHINGLE))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), CUT):
        np.minimum(low, ((shingles[None, i : i + CUT] ^ _FLIP) * _ODD).min(1), out=low)
    return low


def bands(low: np.ndarray) -> list[int]:
    """A key for each band of minhashes, signed; the band's number is part of it."""
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(low: np.ndarray) -> bytes:
    """The low byte of each minhash."""
    return (low & np.uint64(255)).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def nodes(docs: DataFrame) -> DataFrame:
    """node, the hash of a text, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("node"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """node, fingerprint, number of shingles, band keys and minhash sketch of each distinct text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [simhash.shingle_hashes(x, SHINGLE) for x in batch["text"]]
            prints = np.fromiter((simhash._majority(x) if len(x) else 0 for x in hashes), np.uint64, len(batch)).view(np.int64)
            sets = [distinct(x) for x in hashes]
            low = [minhashes(x) for x in sets]
            yield pd.DataFrame({"node": batch["node"], "fp": prints, "size": [len(x) for x in sets], "keys": [bands(x) for x in low], "sketch": [sketch(x) for x in low]})

    rows = nodes(docs).mapInPandas(run, "node long, fp long, size long, keys array<long>, sketch binary")
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "size", "keys", "sketch")))


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct candidate pairs of x and y, structs of node and size, whose sizes allow the similarity."""
    fits = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(SIMILAR) - 1e-6
    return df.filter((F.col("x.node") != F.col("y.node")) & fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose sketches agree well enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("x", "y"))
            yield batch.loc[(x == y).sum(1) >= LEAST, ["a", "b"]]

    of = lambda end, name: signed.select(F.col("node").alias(end), F.col("sketch").alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _texts(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the nodes named, written: the only time that whole texts are dealt by node."""
    return written(nodes(docs).join(ends, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "near-texts")


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar, by their texts, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"], batch["x"], batch["y"], strict=True):
                if a != last:  # rows of one text mostly come together
                    last, held = a, shingle_set(x)
                keep.append(similar(held, shingle_set(y)))
            yield batch.loc[keep, ["a", "b"]]

    full = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return written(full.select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), "near-links")


def prefix_pairs(rooted: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs a-b of the nodes of ``rooted`` (node, root), of different roots, that may have the similarity by
    what their shingles' order of frequency allows; no similar pair is missing. ``texts`` holds their texts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(x).view(np.int64) for x in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "size": [len(x) for x in sets], "shingles": sets})

    rows = texts.join(rooted.select("node"), "node", "left_semi")
    rows = written(rows.mapInPandas(run, "node long, size long, shingles array<long>"), "near-shingles")
    each = rows.select("node", F.explode("shingles").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    # shingles of one text alone come first in its order; only their number matters
    lists = each.join(shared, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("shared")).join(rows.select("node", "size"), "node")
    alone = F.col("size") - F.size("shared")
    wanted = F.col("size") - F.ceil(F.col("size") * F.lit(SIMILAR) - 1e-9) + 1
    first = lists.select("node", "size", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(wanted - alone, F.lit(0)).cast("int"))).alias("at", "x"))
    first = first.select("node", F.col("x.h").alias("h"), "size", (F.col("size") - F.col("alone") - F.col("at")).alias("room")).join(rooted, "node")
    several = first.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    first = written(first.join(several, "h"), "near-prefixes")
    x, y = (first.select("h", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "size", "room", "root"))) for end in "xy")
    fits = F.least("room_x", "room_y") >= (F.col("size_x") + F.col("size_y")) * F.lit(SIMILAR / (1 + SIMILAR)) - 1e-6
    met = x.join(y, (x["h"] == y["h"]) & (F.col("root_x") < F.col("root_y")) & fits)
    out = written(met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "near-pairs")
    dropped(rows, first)
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """node and root of each text that has a near copy of another text; all others are components of their own."""
    signed = written(signatures(docs), "near-signatures")
    one = F.struct("node", "size")
    heads = signed.groupBy("fp").agg(F.min(one).alias("head"))
    same = signed.join(heads, "fp").select(one.alias("x"), F.col("head").alias("y"))
    tries = simhash.links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    by_print = written(_pairs(same.unionByName(tries)), "near-pairs")

    keyed = signed.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = written(keyed.join(shared, "key"), "near-buckets")
    ends = buckets.select("node").union(by_print.select("a")).union(by_print.select("b")).distinct()
    texts = _texts(ends, docs)
    links = roots = None
    for turn in range(STARS):
        named = buckets.withColumn("root", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        chance = F.xxhash64("node", "key", F.lit(turn)).alias("turn")
        hubs = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(chance, "node", "size", "root")).alias("hub")).filter("low <> high")
        pairs = _pairs(named.join(hubs, "key").filter("root <> hub.root").select(one.alias("x"), F.struct("hub.node", "hub.size").alias("y")))
        first = written(_likely(pairs.union(by_print).distinct() if turn == 0 else pairs, signed), "near-pairs")
        found = _checked(first, texts)
        dropped(first, *([roots] if roots is not None else []))
        links = found if links is None else written(links.unionByName(found), "near-links")
        roots = simhash.components(links)
    named = buckets.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    left = written(named.join(mixed, "key", "left_semi").select("node", "root").distinct(), "near-mixed")
    pairs = prefix_pairs(left, texts)
    more = _checked(pairs, texts)
    dropped(signed, by_print, buckets, left, pairs, texts)
    if more.first():
        dropped(roots)
        roots = simhash.components(links.unionByName(more))
    dropped(links, more)
    return roots

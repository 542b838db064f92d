"""SimHash near-duplicates by a self-join of a binary trie (operator 9).

Fingerprints: 64 bits, each set if it is set in over half the hashes of a text's shingles. The distinct fingerprints are
the leaves of one binary trie, whose most balanced bits come first. Pairs of its nodes go down together, add up the bits in
which they differ, and stop as soon as the budget is exceeded. The upper levels are walked by Spark: every fingerprint goes
to the pairs of nodes that its node forms within the budget, and pairs that very many fingerprints share go down some levels
more. Below, each task walks the rest of its pairs of nodes, many at a time. A task gives a spanning forest of the links
that it finds, not all pairs, so that a group of n near copies costs n rows. Components come from rounds of contraction over
these links, written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows share a component; a
null doc_id never names a component unless it has no other; an empty table gives no rows; texts of any length are whole;
extra columns of any name are left out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import dropped, texts, written

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Fingerprints of a node of the level at which tasks begin, about; of a pair of nodes beyond which it goes down further,
#: and by how many levels.
NODE, CROWD, STEP = 1 << 14, 1 << 17, 4
#: Pairs of leaves below a pair of nodes that are compared at once; pairs of nodes that go down together.
LEAF, TOGETHER = 8, 1 << 17


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order; none of a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, one row for each row given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.fromiter((fingerprint(x, shingle) for x in batch["text"]), np.uint64, len(batch)).view(np.int64)})

    return texts(docs).mapInPandas(run, "doc_id long, fp long")


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of positions: ``label`` holds for each one the smallest that it is linked to, before and after."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def trie_links(x: np.ndarray, y: np.ndarray | None = None, budget: int = BUDGET, depth: int = BITS, differ: int = 0, seen: dict | None = None) -> np.ndarray:
    """Labels that unite the values at most ``budget`` bits apart: of sorted distinct ``x`` among themselves, or between
    ``x`` and ``y`` (then for x followed by y). The values agree above their lowest ``depth`` bits, but for ``differ`` bits
    in which x and y do.

    A node of the trie is a range of the sorted values with a common prefix. ``seen``, if given, counts the pairs of nodes
    that were visited and those that the budget cut off."""
    own = y is None
    y, shift = (x, 0) if own else (y, len(x))
    label = np.arange(len(x) if own else len(x) + len(y))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def found(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        links.append((i, j + shift))
        held += len(i)
        if held > TOGETHER:
            merge(label, *map(np.concatenate, zip(*links, strict=True)))
            links.clear()
            held = 0

    def middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the next bit turns from zero to one within each range."""
        prefix = values[lo] & ~np.uint64(2 * bit - 1) | np.uint64(bit)
        return np.clip(np.searchsorted(values, prefix), lo, hi)

    start = tuple(np.array([v]) for v in (0, len(x), 0, len(y), differ))
    stack = [(depth, start)] if len(x) and len(y) else []
    while stack:
        depth, (a, b, c, d, r) = stack.pop()
        if len(a) > TOGETHER:
            half = len(a) // 2
            stack += [(depth, tuple(v[:half] for v in (a, b, c, d, r))), (depth, tuple(v[half:] for v in (a, b, c, d, r)))]
            continue
        if seen is not None:
            seen["visited"] = seen.get("visited", 0) + len(a)
        wide = d - c
        few = ((b - a) * wide <= LEAF) | (depth == 0)
        if few.any():
            size = ((b - a) * wide)[few]
            at = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a[few][at] + k // wide[few][at], c[few][at] + k % wide[few][at]
            near = np.bitwise_count(x[i] ^ y[j]) <= budget
            if own:
                near &= i < j
            found(i[near], j[near])
            a, b, c, d, r = (v[~few] for v in (a, b, c, d, r))
        if not len(a):
            continue
        bit = 1 << (depth - 1)
        m, n = middle(x, a, b, bit), middle(y, c, d, bit)
        same = (a == c) & own
        children = []
        for lo, hi, left, right, more, some in ((a, m, c, n, 0, True), (m, b, n, d, 0, True), (a, m, n, d, 1, True), (m, b, c, n, 1, ~same)):
            there = (lo < hi) & (left < right) & some
            kept = there & (r + more <= budget)
            if seen is not None:
                seen["cut"] = seen.get("cut", 0) + int(there.sum() - kept.sum())
            children.append(tuple(v[kept] for v in (lo, hi, left, right, r + more)))
        stack.append((depth - 1, tuple(map(np.concatenate, zip(*children, strict=True)))))
    if links:
        merge(label, *map(np.concatenate, zip(*links, strict=True)))
    return label


def reordered(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with their bits in ``order``, the first as the highest."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order[::-1]], axis=1, bitorder="little")).view(np.uint64).ravel()


def _masks(width: int, budget: int) -> list[int]:
    """All differences of at most ``budget`` of ``width`` bits."""
    return [sum(1 << b for b in some) for n in range(budget + 1) for some in itertools.combinations(range(width), n)]


def links(distinct: DataFrame, budget: int = BUDGET, node: int = NODE, crowd: int = CROWD) -> DataFrame:
    """A spanning set of links a-b of the distinct fingerprints ``fp`` that are at most ``budget`` bits apart."""
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))
    shares = distinct.agg(F.count("*").alias("n"), *(F.sum(bit(i)).alias(f"b{i}") for i in range(BITS))).first()
    n = shares["n"]
    order = sorted(range(BITS), key=lambda i: (abs(2 * (shares[f"b{i}"] or 0) - n), i))

    def down(rows: DataFrame, depth: int, step: int) -> DataFrame:
        """Each fingerprint of a pair of nodes a-b goes to the pairs of nodes ``step`` levels below."""
        child = F.lit(0).cast("long")
        for i in order[depth : depth + step]:
            child = F.shiftleft(child, 1).bitwiseOR(bit(i))
        masks = _masks(step, budget)
        spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        mask = F.explode(F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.bit_count(m) + spent <= budget))
        rows = rows.withColumn("child", child).withColumn("other", mask).withColumn("other", F.col("child").bitwiseXOR(F.col("other")))
        own, left = F.col("a") == F.col("b"), F.when(F.col("a") == F.col("b"), F.col("child") <= F.col("other")).otherwise(F.col("side") == 0)
        under = lambda x, to: F.shiftleft(x, step).bitwiseOR(to)
        a, b = (under(F.col(x), F.when(left == (x == "a"), F.col("child")).otherwise(F.col("other"))) for x in "ab")
        return rows.select(a.alias("a"), b.alias("b"), F.when(own, F.when(left, 0).otherwise(1)).otherwise(F.col("side")).alias("side"), "fp")

    depth = max(0, (max(1, n) // node).bit_length())
    rows = down(distinct.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"), "fp"), 0, depth)
    dealt, parts = [], max(8, -(-n * len(_masks(depth, budget)) // (4 * node)))
    while depth < BITS:
        full = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("a", "b")
        full = written(full, "crowded")
        if not full.first():
            dropped(full)
            break
        dealt.append(rows.join(full, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        step = min(STEP, BITS - depth)
        rows, depth = written(down(rows.join(full, ["a", "b"], "left_semi"), depth, step), "crowded-rows"), depth + step
    dealt.append(rows.withColumn("depth", F.lit(depth)))
    rows = functools.reduce(DataFrame.unionByName, dealt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch) == 0:
                continue
            rows = batch if held is None else held if batch is None else pd.concat([held, batch])
            if rows is None:
                return
            keys = rows[["depth", "a", "b"]].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(rows)]]).tolist()
            if batch is not None:  # the last pair of nodes may go on in the next batch
                held = rows.iloc[edges[-2] :]
                edges.pop()
            fp, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
            value = reordered(fp, order)
            for lo, hi in itertools.pairwise(edges):
                depth, a, b = keys[lo].tolist()
                ends = [lo + np.flatnonzero(side[lo:hi] == k) for k in (0, 1)]
                x, y = (e[np.argsort(value[e])] for e in ends)
                label = trie_links(value[x], None if a == b else value[y], budget, BITS - depth, (a ^ b).bit_count())
                linked = np.flatnonzero(label != np.arange(len(label)))
                if len(linked):
                    own = fp[x if a == b else np.concatenate([x, y])].view(np.int64)
                    yield pd.DataFrame({"a": own[linked], "b": own[label[linked]]})

    dealt = rows.repartition(parts, "depth", "a", "b").sortWithinPartitions("depth", "a", "b")
    return dealt.select("depth", "a", "b", "side", "fp").mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of the links, written.

    Rounds of two steps: every node's larger neighbours are linked to its smallest neighbour, then all its smaller
    neighbours and itself to the smallest. Links only get fewer; a round that changes nothing ends it. Each
    round is a written table, so that a lost executor costs no more than a round."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()

    def smallest(e: DataFrame, both: bool) -> DataFrame:
        ends = e.union(e.select("v", "u")) if both else e
        low = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = ends.join(low, "u")
        if both:  # larger neighbours to the smallest
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges, "links")
    before = state(edges)
    while before[0]:
        last, edges = edges, written(smallest(smallest(edges, True), False), "links")
        dropped(last)
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    out = written(roots.unionByName(edges.select(F.col("v").alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node"))), "roots")
    dropped(edges)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row for each row given."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(distinct.select("fp"), budget))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.join(classes.groupBy("root").agg(F.min("first_doc").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

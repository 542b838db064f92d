"""Exact top-k search by multi-resolution segment statistics (operator 6).

Components become integers. A vector is cut into segments, coarse to fine; with the means and deviations of its segments
a lower bound of the squared distance of two vectors is  sum len * ((mean - mean')^2 + (dev - dev')^2),  and as
|q - c|^2 = |q|^2 + |c|^2 - 2 q.c, a lower bound of the distance is an upper bound of the inner product:
sum len * (mean mean' + dev dev'). Pairs whose bound falls below the k-th best known score are dropped level by level;
exact integer products are computed for the survivors only.

A rotation comes first: it turns the directions in which a block of candidates spreads most into the coarsest segment
means, so that blocks with structure are pruned early. Rotations keep inner products; the bounds allow for rounding, and the
scores never use the rotated vectors.

Queries and candidates meet in cells: blocks of queries against blocks of candidates, so that no task holds more than
one block of each and nothing is broadcast. All queries first meet one block: the k-th score there is a floor that every
cell starts from. Each cell gives its k best for each query, and a window picks the best of these.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows without a vec_id, take no
part; a query meets only vectors of its own length; equal scores go to the smaller vec_id; a query leaves out only its own
row, so repeated rows, and rows of its vec_id with other vectors, are candidates, and each row of a query's vec_id is a
query with ranks of its own; scores beyond 64 bits stop at the bounds; an empty table gives no rows; extra columns of any
name are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, TOP, EVERY = 1024, 10, 100
#: Segments of each level; rows of a block of candidates and of queries.
LEVELS, CANDIDATES, QUERIES = (4, 16, 32), 8192, 4096
#: Queries that a cell treats at once.
SLICE = 64


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Root-length-weighted means and deviations of each row's segments."""
    edges = [x.shape[1] * i // count for i in range(count + 1)]
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0) * size)


def steps(n: int) -> np.ndarray:
    """An orthonormal basis of steps for n = 2^k dimensions, coarse to fine: for every power of two s up to n, its first s
    rows span the vectors that are constant on each of s equal segments."""
    rows = [np.full(n, n**-0.5)]
    wide = n
    while wide > 1:
        for at in range(0, n, wide):
            row = np.zeros(n)
            row[at : at + wide // 2], row[at + wide // 2 : at + wide] = wide**-0.5, -(wide**-0.5)
            rows.append(row)
        wide //= 2
    return np.array(rows)


def rotation(c: np.ndarray) -> np.ndarray:
    """A matrix with orthonormal rows by which vectors are multiplied: directions in descending order of what the candidates
    hold of them, on a basis of steps (with zeros up to the next power of two)."""
    spread, ways = np.linalg.eigh(c.T @ c)
    wide = 1 << (c.shape[1] - 1).bit_length()
    return ways[:, np.argsort(-spread, kind="stable")] @ steps(wide)[: c.shape[1]]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``b``, as integers that stop at the bounds of 64 bits."""
    if len(a) == 0:
        return np.zeros(0, np.int64)
    most = int(np.abs(a.astype(np.float64)).max()) * int(np.abs(b.astype(np.float64)).max()) * len(b)
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(row, b, strict=True)))) for row in a], np.int64)


def best(q: np.ndarray, floor: np.ndarray, c: np.ndarray, c_id: np.ndarray, own: list[int | None], top: int = TOP, levels: tuple[int, ...] = LEVELS, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query of one cell, the positions and scores of its ``top`` best candidates, exactly, by score and vec_id.

    ``floor`` holds a score for each query that its ``top`` best reach together (-inf: unknown), ``own`` the position of a
    candidate to leave out. ``seen``, if given, counts pairs, and pairs left after each level."""
    by_id = np.argsort(np.argsort(c_id, kind="stable"), kind="stable")
    turn = rotation(c.astype(np.float64))
    x, y = q.astype(np.float64) @ turn, c.astype(np.float64) @ turn
    levels = tuple(n for n in levels if n < x.shape[1])
    q_levels, c_levels = ([tuple(s.astype(np.float32) for s in segments(v, n)) for n in levels] for v in (x, y))
    # rounding of single precision, generously; norms are those of the vectors
    slack = 4e-6 * np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None].max(initial=0) + 1e-3
    likely = min(len(c), 2 * top)
    for lo in range(0, len(q), SLICE):
        some = slice(lo, lo + SLICE)
        alive = np.ones((len(q[some]), len(c)), bool)
        for k, place in enumerate(own[some]):
            if place is not None:
                alive[k, place] = False
        least = floor[some].copy()
        if seen is not None:
            seen.setdefault("pairs", []).append(int(alive.sum()))
        for n, (qm, qs), (cm, cs) in zip(levels, q_levels, c_levels, strict=True):
            at = np.flatnonzero(alive.any(0))  # candidates that still matter to a query of the slice
            bound = qm[some] @ cm[at].T + qs[some] @ cs[at].T + slack[some].astype(np.float32)
            if n == levels[0] and len(c) > likely:  # what looks best sets a floor of this cell
                for k in range(len(bound)):
                    left = np.flatnonzero(alive[k, at])
                    first = left[np.argpartition(-bound[k][left], min(likely, len(left)) - 1)[:likely]] if len(left) else left
                    if least[k] == -np.inf:  # and some of all
                        first = np.union1d(first, left[::8])
                    if len(first) >= top:
                        least[k] = max(least[k], np.sort(exact_products(c[at[first]], q[lo + k]))[-top])
            alive[:, at] &= bound >= least[:, None]
            if seen is not None:
                seen.setdefault(n, []).append(int(alive.sum()))
        for k in range(len(alive)):
            left = np.flatnonzero(alive[k])
            score = exact_products(c[left], q[lo + k])
            if len(score) > top:
                kept = score >= np.partition(score, len(score) - top)[len(score) - top]
                left, score = left[kept], score[kept]
            pick = np.lexsort((by_id[left], -score))[:top]
            yield left[pick], score[pick]


def _cell(a: pd.DataFrame, b: pd.DataFrame, top: int) -> pd.DataFrame:
    """The best candidates of one cell, with how often each counts."""
    columns = ["query_id", "nth", "vec_id", "score", "n"]
    if not len(a) or not len(b):
        return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in columns})
    q, c = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
    ids, times = b["vec_id"].to_numpy(), b["n"].to_numpy()
    place: dict[int, list[int]] = {}
    for i in np.flatnonzero(ids % EVERY == 0).tolist():
        place.setdefault(int(ids[i]), []).append(i)
    own = [next((i for i in place.get(int(k), ()) if np.array_equal(c[i], v)), None) for k, v in zip(a["vec_id"], q, strict=True)]
    single = [i if i is not None and times[i] == 1 else None for i in own]  # a repeated row meets its copies
    out = []
    for k, nth, i, (at, score) in zip(a["vec_id"], a["nth"], own, best(q, a["floor"].fillna(-np.inf).to_numpy(), c, ids, single, top), strict=True):
        out += zip([k] * len(at), [nth] * len(at), ids[at].tolist(), score.tolist(), (times[at] - (at == (-1 if i is None else i))).tolist(), strict=True)
    return pd.DataFrame(out, columns=columns)


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score for every row whose vec_id divides by ``every``."""
    valid = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.coalesce(valid, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select("vec_id", whole.alias("v"))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    most = max(abs(facts["high"] or 0), abs(facts["low"] or 0) + 1)
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"  # what is shuffled is no wider than it must be
    distinct = rows.withColumn("v", F.col("v").cast(f"array<{kind}>")).groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("dim", F.size("v"))
    c_blocks, q_blocks = max(1, math.ceil(facts["n"] / candidates)), max(1, math.ceil(facts["q"] / queries))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).cast("long")  # among the vectors of a query's vec_id
    asked = distinct.filter(F.col("vec_id") % every == 0).withColumn("nth", nth)
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = distinct.select("vec_id", "v", "n", "dim", block(c_blocks).alias("cb"))
    left = asked.select("vec_id", "nth", "v", "dim", block(q_blocks).alias("qb"), F.lit(None).cast("double").alias("floor"))
    schema = "query_id long, nth long, vec_id long, score long, n long"

    def cells(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (left, right))  # both come from the same rows
        return left.groupBy("qb", "cb", "dim").cogroup(right.groupBy("qb", "cb", "dim")).applyInPandas(lambda a, b: _cell(a, b, top), schema)

    if c_blocks > 1:  # one block gives every query a floor
        first = cells(left.withColumn("cb", F.lit(0)), right.filter("cb = 0").withColumn("qb", every_of(q_blocks)))
        first = first.groupBy(F.col("query_id").alias("vec_id"), "nth").agg(F.sum("n").alias("hits"), F.min("score").cast("double").alias("reached")).filter(F.col("hits") >= top)
        left = left.join(first.select("vec_id", "nth", "reached"), ["vec_id", "nth"], "left").withColumn("floor", F.col("reached")).drop("reached")
    found = cells(left.withColumn("cb", every_of(c_blocks)), right.withColumn("qb", every_of(q_blocks)))
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    found = found.select("query_id", "nth", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least(F.col("n"), F.lit(top)).cast("int"))))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    copies = asked.filter("n > 1").select(F.col("vec_id").alias("query_id"), "nth", "n")
    found = found.join(copies, ["query_id", "nth"], "left").select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)).cast("int"))))
    return found.drop("col")

"""Mixing sources to target weights along a time-varying curriculum (operator 5), by DataFrame functions only.

Sizes are words. Each source gets a share of all words by weight, at most ``most`` times its own words; what exceeds
that is shared anew by weight until no source is above. A source's words are taken in rounds over its documents, in the
order of a hash; its last round may end within a document. Its rate over training time is a schedule, piecewise linear;
the integral of the schedule is inverted to find the training position at which each document is due, and documents are
range-sorted by position.

Defined results: a null text has no words; null sources come last in rank and are one source; documents of no words are
never taken and have no position; rows of one id follow each other by size (in the curriculum by a hash of the row), so
repeated rows are separate documents; an empty table gives no rows; equal positions are ordered by doc_id. Extra columns
of any name are left out by ``mixed`` and carried by ``curriculum``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD, written

#: Production parameters: weights by rank of the source, repeating; the most rounds; the schedule of each weight by
#: training time (0 to 1) as points of relative rate, linear between them: heavy sources early, light ones late.
WEIGHTS = (5, 2, 1)
MOST = 3
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Buckets by hash into which each source is dealt for its running sums.
BUCKETS = 4096


def sized(docs: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, source, size, the source's key (never null, so that joins and windows share one partitioning), the hash
    that orders a source's documents, its bucket, and the columns to ``keep``. A null id is dealt by its text."""
    rows = docs.select(
        *keep,
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")).alias("turn"),
    )
    return rows.withColumn("bucket", F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") % BUCKETS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size, rank, weight and target. Sources are few (their sums pass through one task); the water level is
    found without iteration: in order of size over weight, the first sources are full as long as the level of the rest
    lies above their limit."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last(F.nullif("key", F.lit(""))))) - 1
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(onward)
    full = most * F.col("source_size") < level * F.col("weight")
    per = per.withColumn("level", level).withColumn("full", full)
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank")))).over(every)
    target = F.least(most * F.col("source_size").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return per.select("key", "source_size", "rank", "weight", target.alias("target"))


def cumulated(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float]]:
    """(begin, integral up to it, rate there, slope) of each piece, scaled to an integral of one."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))
    out, total = [], 0.0
    for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False):
        out.append((a, total, u / area, (v - u) / area / (b - a)))
        total += (b - a) * (u + v) / 2 / area
    return out


def due(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The training time at which the integrated schedule reaches ``share`` of a source's words."""
    out = None
    for a, total, rate, slope in cumulated(schedule):
        more = F.greatest(share - total, F.lit(0.0))
        # the root of slope/2 d^2 + rate d = more, in the form that stays exact when the slope is small
        at = a + F.coalesce(F.try_divide(2 * more, rate + F.sqrt(F.greatest(rate * rate + 2 * slope * more, F.lit(0.0)))), F.lit(0.0))
        out = at if out is None else F.when(share >= total, at).otherwise(out)
    return F.least(out, F.lit(1.0))


def assigned(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules=SCHEDULES, demand: DataFrame | None = None, tie: str = "size") -> DataFrame:
    """All columns of ``sizes`` (rows of ``sized``), source_size, target, and ``takes``: an array with a struct of
    position, round and taken for each round in which the mix takes words of the row.

    The cumulated demand of a source before a row is a running sum in two levels: over the buckets of the source, then
    within a bucket; so the rows are shuffled once, by source and bucket, and no source is one task. ``demand`` are the
    same rows without wide columns, for the sums; ``tie`` orders rows of one id."""
    sums = (sizes if demand is None else demand).groupBy("key", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, most)
    ahead = F.sum("size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("key", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")).join(targets, "key")
    within = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("turn", "doc_id", tie).rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("at", F.coalesce(within, F.lit(0))).join(sums, ["key", "bucket"]).withColumn("at", F.col("ahead") + F.col("at")).withColumn("goal", F.round("target").cast("long"))

    def take(n: Column) -> Column:
        start = n * F.col("source_size") + F.col("at")
        taken = F.greatest(F.least(F.col("size"), F.col("goal") - start), F.lit(0)).cast("long")
        share = F.coalesce(F.try_divide(start.cast("double"), F.col("goal")), F.lit(0.0))
        position = None
        for weight, schedule in dict(zip(weights, schedules, strict=True)).items():
            at = due(share, schedule)
            position = at if position is None else F.when(F.col("weight") == weight, at).otherwise(position)
        return F.struct((F.floor(position * 1e9 + 0.5) / 1e9).alias("position"), n.alias("round"), taken.alias("taken"))

    takes = F.filter(F.array(*(take(F.lit(n)) for n in range(most))), lambda x: x["taken"] > 0)
    return placed.withColumn("takes", takes).drop("at", "ahead", "goal", "rank", "weight", "bucket", "turn", "key")


def mixed(docs: DataFrame) -> DataFrame:
    """One row for each document, range-sorted by its first training position (documents not taken last): doc_id, source,
    size, source_size, target, the words that the mix takes of it in all rounds, the number of rounds, and the position."""
    sizes = written(sized(docs), "sizes")  # used twice; the texts are read once
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, x: total + x["taken"])
    rows = assigned(sizes).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.size("takes").alias("rounds"), F.get("takes.position", F.lit(0)).alias("position"))
    return rows.orderBy(F.asc_nulls_last("position"), "doc_id", "size")


def curriculum(docs: DataFrame, **parameters) -> DataFrame:
    """The training order: all columns of ``docs``, then position and round; a row for each round in which a document is
    taken, range-sorted by position. The last round of a source ends with the document in which its target is reached.
    Columns of ``docs`` named position or round give way."""
    own = [c for c in docs.columns if c.lower() not in ("position", "round")]
    row = F.struct(*(docs[c] for c in own)).alias("_row")
    sizes = sized(docs, (row, F.xxhash64(*(x for c in own for x in (docs[c].isNull(), docs[c]))).alias("_tie")))
    takes = assigned(sizes, demand=sized(docs), tie="_tie", **parameters).select("_row", F.explode("takes").alias("_take"))
    rows = takes.select(*(F.col("_row")[c].alias(c) for c in own), "_take.position", "_take.round")
    return rows.orderBy("position", "doc_id", "round", F.xxhash64("text"))

"""Mixing sources to target weights along a curriculum, with DataFrame operations only.

Each source has a weight (its share of all words) and a schedule (how that share is spread over training time 0..1).
A source's documents stand in a fixed pseudo-random order and repeat from the start until its target is reached. The
words before a copy, as a share of the target, are looked up in the inverse of the integrated schedule: that is the
copy's training position. Prefix sums run in 4096 parts per source, so no task holds a source, however hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import written

WEIGHTS = (1, 2, 3)
#: Piecewise linear schedules, as (time, relative weight); the times of each run from 0 to 1. They repeat like the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
#: A source gives each document at most this often.
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, weight there, slope, integral before, whole integral) of each linear piece."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        out.append((t0, w0, (w1 - w0) / (t1 - t0), before))
        before += (w0 + w1) / 2 * (t1 - t0)
    return [(*x, before) for x in out]


def inverse(share: Column, schedule: Column) -> Column:
    """Time at which the integrated schedule (an array of segments) has reached this share of its whole."""
    piece = F.element_at(F.filter(schedule, lambda s: s["before"] <= share * s["whole"]), -1)
    y = share * piece["whole"] - piece["before"]
    root = piece["weight"] + F.sqrt(F.greatest(piece["weight"] * piece["weight"] + 2 * piece["slope"] * y, F.lit(0.0)))
    return piece["start"] + F.when(root > 0, 2 * y / root).otherwise(0.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """sizes (skey, source, source_size) with rank, weight and target words.

    All words are shared by weight; a target stops at MOST_REPEATS times its source's size, and the excess goes to the
    others by weight. Sources are taken in the order of cap over weight: one is capped if an equal share of what is
    left after those before it reaches its cap. One row per source is sorted in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - (F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")),
        "weights": F.sum("weight").over(everything) - (F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")),
    }).withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights"))
    free = before.withColumn("share", F.max(F.when(~F.col("capped"), F.col("left") / F.col("weights"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("weight"))
    return free.withColumn("target", target).select("skey", "rank", "source_size", "target")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
) -> DataFrame:
    """docs with `mix`: struct(size, source_size, target, taken, positions).

    taken: words that the mix takes from the row, repeats counted. A source's whole passes come first and then its
    order up to the target, where the last document is cut, so a source's taken words sum to its rounded target.
    positions: training position of each copy, ascending. A null source is a source of its own, after all others; a
    null text or size counts 0 words and is placed where it stands but takes none. Equal ids are ordered by size;
    equal rows are interchangeable, so reruns agree. A column named mix is replaced; others are kept. An empty table
    gives an empty table.
    """
    size = words(F.col(text_col)) if size_col is None else F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c != "mix"]
    # rows without an id are told apart by their size, so that they too spread over the parts
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), size.cast("string"))))
    sized = docs.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"), order.alias("order"))
    sized = sized.withColumns({"skey": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), "bucket": F.substring("order", 1, 3)})
    parts = written(sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words")), "parts")
    goal = targets(parts.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights)
    curves = [F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("start", "weight", "slope", "before", "whole"), strict=True)]) for x in segments(s)]) for s in schedules]
    curve = curves[0]
    for k, other in enumerate(curves[1:], 1):
        curve = F.when(F.pmod(F.col("rank") - 1, F.lit(len(curves))) == k, other).otherwise(curve)
    whole = F.round("target").cast("long")
    goal = goal.withColumns({"whole": whole, "curve": curve})
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select("skey", "bucket", "base").join(goal, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("inner", F.sum("size").over(within) - F.col("size")).join(base, ["skey", "bucket"])
    at = F.col("base") + F.col("inner")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumns({"at": at, "passes": passes}).withColumn("rest", F.col("whole") - F.col("passes") * F.col("source_size"))
    taken = F.col("passes") * F.col("size") + F.least(F.greatest(F.col("rest") - F.col("at"), F.lit(0)), F.col("size"))
    copies = (F.col("passes") + F.when(F.col("rest") > F.col("at"), 1).otherwise(0)).cast("int")
    share = lambda k: (k * F.col("source_size") + F.col("at")) / F.col("whole")
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), lambda k: inverse(share(k), F.col("curve")))).otherwise(F.array().cast("array<double>"))
    mixed = F.struct("size", "source_size", "target", taken.alias("taken"), positions.alias("positions"))
    return placed.select("row.*", mixed.alias("mix"))


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy with its `position` (which replaces a column of that name), range-sorted by it (ties by id)."""
    return mixed.drop("position").select("*", F.explode("mix.positions").alias("position")).drop("mix").orderBy("position", id_col)


def query(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and what the mix takes, in order of first position."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    mixed = mix(sized, size_col="size")
    first = F.element_at("mix.positions", 1)
    out = mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.when(F.size("mix.positions") > 0, first).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id").drop("position")


#: The same mix in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '#' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3 * source_size AS cap FROM s),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight FROM r),
b AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weights FROM w),
c AS (SELECT *, remaining * weight >= cap * weights AS capped FROM b),
f AS (SELECT *, max(CASE WHEN NOT capped THEN remaining / weights END) OVER () AS share FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE share * weight END AS target FROM f),
g AS (SELECT *, CAST(round(target) AS BIGINT) AS whole FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole,
             CASE WHEN g.source_size > 0 THEN g.whole // g.source_size ELSE 0 END AS passes,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + least(greatest(whole - passes * source_size - pos, 0), size) AS BIGINT) AS taken
FROM p
"""

"""Joins that Spark has no operator for, without pairs that aren't results.

These go beyond codecs; they serve whoever works with streams as tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, width: float | None = None) -> DataFrame:
    """left with right's `value` of the last row at or before each row's `at`, within `by`; null where there is none.

    One exchange: both sides in one ordered pass by key, carrying the last value on.  With `width`, a key's rows are
    cut into stretches of that much of `at`, so that a key with most of the rows is many tasks; each stretch starts
    with the last value of those before it, of which there is one row each.
    """
    a = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("found"))
    b = right.select(by, at, F.lit(0).alias("side"), F.col(value).alias("found"))
    both = a.unionByName(b, allowMissingColumns=True)
    keys = [by]
    if width is not None:
        both, keys = both.withColumn("stretch", F.floor(F.col(at) / width)), [by, "stretch"]
    w = Window.partitionBy(*keys).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn(value, F.last("found", True).over(w)).where("side = 1").drop("side", "found")
    if width is None:
        return out
    ends = right.where(F.col(value).isNotNull()).groupBy(by, F.floor(F.col(at) / width).alias("stretch")).agg(F.max_by(value, at).alias("carried"))
    wanted = out.select(by, "stretch").distinct().withColumn("carried", F.lit(None).cast(right.schema[value].dataType)).withColumn("asked", F.lit(True))
    before = Window.partitionBy(by).orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("asked", F.lit(False)).unionByName(wanted).withColumn("carried", F.last("carried", True).over(before)).where("asked").drop("asked")
    carried = carried.select(F.col(by).alias("c_by"), F.col("stretch").alias("c_stretch"), "carried")
    out = out.join(carried, F.col(by).eqNullSafe(F.col("c_by")) & F.col("stretch").eqNullSafe(F.col("c_stretch")), "left")
    return out.withColumn(value, F.coalesce(value, "carried")).drop("c_by", "c_stretch", "carried", "stretch")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the intervals [start, end) that they fall in, by buckets of `width` and of its doublings.

    An interval stands in the buckets, at most two, that it touches at the level whose buckets are as wide as it is; a
    point in its own bucket of every level that has intervals (as many as lengths have powers of two).  They meet by
    an ordinary equi-join, however long an interval is.
    """
    i = intervals.where(F.col(end) > F.col(start))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)).cast("double") / width))).cast("int")
    size = F.pow(F.lit(2.0), F.col("level")) * width
    first, last = F.floor(F.col(start) / size), F.greatest(F.floor(F.col(start) / size), F.ceil(F.col(end) / size) - 1)
    i = i.withColumn("level", level).withColumn("bucket", F.explode(F.sequence(first, last)))
    levels = sorted(r.level for r in i.select("level").distinct().collect())
    if not levels:
        levels = [0]
    p = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("bucket", F.floor(F.col(at) / size))
    p, i, keys = _dealt(p, i, ["level", "bucket"])
    return p.join(i, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(*keys)


#: Rows of a side from which a full bucket is cut into parts; pairs to compare that a task takes; buckets cut at most by a broadcast.
PART_ROWS, TASK_PAIRS, BROADCAST_ROWS = 2048, 1 << 27, 100_000


def _dealt(p: DataFrame, i: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and intervals, and the keys that they meet by, dealt to as many tasks as there are pairs to compare.

    Where all pairs are few, both are as they were.  Else buckets with many pairs are cut into parts on both sides by
    the rows' hashes, and every part of one side meets every part of the other: a few buckets with most of the rows
    are many tasks.  (Points that are equal in every column stay together.)  Parts are kept small, so each row of one
    side passes few rows of the other.
    """
    counts = p.groupBy(*keys).agg(F.count("*").alias("points")).join(i.groupBy(*keys).agg(F.count("*").alias("intervals")), keys)
    pairs = F.col("points").cast("double") * F.col("intervals")
    full = pairs > PART_ROWS**2
    total, n_full = counts.agg(F.coalesce(F.sum(pairs), F.lit(0.0)), F.count(F.when(full, 1))).first()
    if total <= TASK_PAIRS:
        return p, i, keys
    cut = counts.where(full).select(*keys, *[F.ceil(F.col(c) / PART_ROWS).alias(f"{c}_parts") for c in ("points", "intervals")])
    cut = F.broadcast(cut) if n_full <= BROADCAST_ROWS else cut
    n = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(total / TASK_PAIRS), BROADCAST_ROWS))

    def parted(side: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.xxhash64(*[c for c, kind in side.dtypes if "map<" not in kind and kind != "variant"])
        x = side.join(cut, keys, "left")
        x = x.withColumn(f"{mine}_part", F.pmod(own, F.coalesce(f"{mine}_parts", F.lit(1)))).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_parts", F.lit(1)) - 1)))
        return x.drop("points_parts", "intervals_parts").repartition(n, *keys, "points_part", "intervals_part")

    return parted(p, "points", "intervals"), parted(i, "intervals", "points").hint("merge"), [*keys, "points_part", "intervals_part"]

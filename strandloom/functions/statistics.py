"""Statistics of streams, one row for each chunk: what selectors and cost rules decide on.

All are aggregates with map-side combining.  Rare shapes (distinct values, histograms) are grouped by (chunk, value)
first, so a frequent value is counted where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import bit_length, in_chunk, unsigned, width_for, wrap_sub


def unsigned_range(s: DataFrame, width: int = 64) -> DataFrame:
    """chunk_id, low, high: least and greatest by unsigned order (as signed numbers of 64 bits)."""
    u = unsigned(F.col("v"), width)
    return s.groupBy("chunk_id").agg(F.min_by("v", u).alias("low"), F.max_by("v", u).alias("high"))


def cardinality(s: DataFrame, exact: bool = True, error: float = 0.02) -> DataFrame:
    """chunk_id, cardinality: exact, or estimated by a sketch of fixed size."""
    count = F.countDistinct("v") if exact else F.approx_count_distinct("v", error)
    return s.groupBy("chunk_id").agg(count.alias("cardinality"))


def linear_counting(s: DataFrame, cells: int = 1024) -> DataFrame:
    """chunk_id, estimate: cells * ln(cells / empty cells); null where no cell is empty."""
    taken = s.select("chunk_id", F.pmod(F.xxhash64("v"), F.lit(cells)).alias("cell")).distinct().groupBy("chunk_id").agg(F.count("*").alias("taken"))
    empty = cells - F.col("taken")
    return taken.select("chunk_id", F.when(empty > 0, cells * F.log(cells / empty)).alias("estimate"))


def histogram(s: DataFrame) -> DataFrame:
    """chunk_id, v, n."""
    return s.groupBy("chunk_id", "v").agg(F.count("*").alias("n"))


def _entropy(n: Column, total: Column) -> Column:
    return F.sum(-n / total * F.log2(n / total))


def entropy(s: DataFrame) -> DataFrame:
    """chunk_id, entropy: Shannon entropy of the values in bits; sum(n) and sum(n log n) give it in one aggregate."""
    return histogram(s).groupBy("chunk_id").agg(_entropy_of_counts().alias("entropy"))


def _entropy_of_counts() -> Column:
    """Of a histogram's n."""
    total = F.sum("n")
    return F.greatest(F.lit(0.0), F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total)


def moments(s: DataFrame) -> DataFrame:
    """chunk_id, n, mean, variance, stddev, skewness, kurtosis.

    Variance is unbiased, skewness is of the population, kurtosis in excess of the normal; all 0 for one value.  A
    constant stream has no skewness or kurtosis (null).
    """
    return s.groupBy("chunk_id").agg(*_moments())


def _moments() -> list[Column]:
    v = F.col("v").cast("double")
    zero = lambda c: F.when(F.count("v") <= 1, F.lit(0.0)).otherwise(c)
    return [
        F.count("v").alias("n"), F.avg(v).alias("mean"), zero(F.var_samp(v)).alias("variance"), zero(F.stddev_samp(v)).alias("stddev"),
        zero(F.skewness(v)).alias("skewness"), zero(F.kurtosis(v)).alias("kurtosis"),
    ]


def profile(s: DataFrame, width: int = 64) -> DataFrame:
    """The eleven features with low and high (by unsigned order) and the entropy, by chunk.

    Moments and range are one aggregate that moves a row for each chunk and task; cardinality and entropy come from
    one histogram.  A distinct count beside the moments would move all of them with every value.
    """
    u = unsigned(F.col("v"), width)
    out = s.groupBy("chunk_id").agg(*_moments(), F.min_by("v", u).alias("low"), F.max_by("v", u).alias("high")).withColumn("range_size", wrap_sub(F.col("high"), F.col("low")))
    h = histogram(s).groupBy(F.col("chunk_id").alias("h_chunk")).agg(F.count("v").alias("cardinality"), _entropy_of_counts().alias("entropy"))
    out = out.join(h, F.col("chunk_id").eqNullSafe(F.col("h_chunk")))
    return out.select("chunk_id", "n", F.lit(width // 8).alias("width"), "cardinality", F.col("cardinality").alias("cardinality_low"), F.col("cardinality").alias("cardinality_high"), "range_size", "mean", "variance", "stddev", "skewness", "kurtosis", "low", "high", "entropy")


def feature_vector(s: DataFrame, width: int = 64) -> DataFrame:
    """The eleven features of an integer stream, by chunk.

    n, width, cardinality (with its bounds, equal here because it is exact), range, mean, variance, stddev,
    skewness and kurtosis.
    """
    return profile(s, width).drop("low", "high", "entropy")


def strides(s: DataFrame, furthest: int = 1024) -> DataFrame:
    """chunk_id, stride, share, matches, verdict: whether a stream repeats at a fixed distance.

    Distances to the last equal value are counted; a peak is a distance with more matches than both neighbours
    together, and its share are the matches at its multiples.  The stride is the peak with the largest share, likely
    if that is more than a sixteenth of all matches, else possible; none without a peak.
    """
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("chunk_id", "v").orderBy("pos"))
    hist = s.select("chunk_id", gap.alias("gap")).where(F.col("gap") <= furthest).groupBy("chunk_id", "gap").agg(F.count("*").alias("n"))
    w = Window.partitionBy("chunk_id").orderBy("gap").rangeBetween(-1, 1)
    marked = hist.withColumn("around", F.sum("n").over(w)).withColumn("matches", F.sum("n").over(Window.partitionBy("chunk_id")))
    peaks = marked.where("n > around - n").select("chunk_id", F.col("gap").alias("stride"), "matches")
    # At most `furthest` distances and peaks in a chunk: a join within the chunk on a bounded side.
    share = peaks.join(hist, "chunk_id").where("gap % stride = 0").groupBy("chunk_id", "stride", "matches").agg(F.sum("n").alias("share"))
    best = share.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("share"), "stride"))).where("k = 1")
    found = best.select("chunk_id", "stride", "share", "matches", F.when(F.col("share") > F.col("matches") / 16, "likely").otherwise("possible").alias("verdict"))
    chunks = s.select("chunk_id").distinct()
    return chunks.join(found, "chunk_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def float_width(s: DataFrame, first: int = 32768) -> DataFrame:
    """chunk_id, width: 1, 2, 4 or 8, how many bytes a number seems to have in a stream of bytes.

    The bytes' entropy by lane falls when lanes are numbers' bytes; each doubling must save one percent.
    """
    size = s.groupBy("chunk_id").agg(F.count("*").alias("size"))
    used = F.least("size", F.lit(first)).bitwiseAND(F.lit(-8))
    x = s.join(size, "chunk_id").where(F.col("pos") < used)
    by_lane = x.groupBy("chunk_id", "v", (F.col("pos") % 8).alias("lane")).agg(F.count("*").alias("n"))
    out = size
    for w in (1, 2, 4, 8):
        h = by_lane.groupBy("chunk_id", "v", (F.col("lane") % w).alias("lane")).agg(F.sum("n").alias("n"))
        h = h.groupBy("chunk_id", "lane").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("x"))
        h = h.groupBy("chunk_id").agg(F.sum(F.col("t") * F.log2("t") - F.col("x")).alias(f"bits_{w}"))
        out = out.join(h, "chunk_id", "left").withColumn(f"bits_{w}", F.coalesce(f"bits_{w}", F.lit(0.0)))
    kept = lambda a, b: F.col(f"bits_{a}") * 0.99 <= F.col(f"bits_{b}")
    width = (
        F.when(F.col("size") % 2 != 0, 1).when(kept(1, 2), 1).when(F.col("size") % 4 != 0, 2).when(kept(2, 4), 2)
        .when(F.col("size") % 8 != 0, 4).when(kept(4, 8), 4).otherwise(8)
    )
    return out.select("chunk_id", width.alias("width"))


def byte_statistics(s: DataFrame) -> DataFrame:
    """chunk_id, n, distinct, top, entropy, delta_entropy and the estimated sizes of back ends, for streams of bytes."""
    from ..operators.selectors import bitpacked_size, constant_size, fast_huffman_size, flatpacked_size

    h = histogram(s).groupBy("chunk_id").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.max("v").alias("top"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    h = h.withColumn("entropy", F.greatest(F.lit(0.0), F.log2("n") - F.col("x") / F.col("n"))).drop("x")
    steps = s.withColumn("v", F.pmod(F.col("v") - F.lag("v").over(in_chunk()), F.lit(256))).where("v IS NOT NULL")
    h = h.join(entropy(steps).withColumnRenamed("entropy", "delta_entropy"), "chunk_id", "left").withColumn("delta_entropy", F.coalesce("delta_entropy", F.lit(0.0)))
    n, k, top = F.col("n"), F.col("distinct"), F.col("top")
    return h.select(
        "*", constant_size(n, k).alias("constant_size"), bitpacked_size(n, top).alias("bitpacked_size"), flatpacked_size(n, k).alias("flatpacked_size"),
        fast_huffman_size(n, F.col("entropy")).alias("huffman_size"), fast_huffman_size(n, F.col("delta_entropy")).alias("delta_huffman_size"),
    )


def numeric_summary(s: DataFrame, limit: int) -> DataFrame:
    """chunk_id, total, top, under_limit, smallest_width."""
    return s.groupBy("chunk_id").agg(F.sum("v").alias("total"), F.max("v").alias("top"), F.bool_and(F.col("v") < limit).alias("under_limit"), width_for(bit_length(F.max("v"))).alias("smallest_width"))


def byte_swapped(x: Column, width: int = 64) -> Column:
    """The number whose bytes are those of x the other way round."""
    out = None
    for k in range(width // 8):
        lane = F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)), width - 8 - 8 * k)
        out = lane if out is None else out.bitwiseOR(lane)
    return out


def merged_contexts(counts: DataFrame, header_bits: float = 200.0) -> dict[int, int]:
    """{context: cluster} of a table context, v, n: contexts whose histograms are cheaper coded together.

    Greedy: the pair that saves the most joins, as long as one saves anything; a cluster costs `header_bits`.  Takes
    at most 256 contexts of byte symbols (one histogram each), which is the bound of what comes to the driver.
    """
    import numpy as np

    rows = counts.groupBy("context", "v").agg(F.sum("n").alias("n")).limit(256 * 256 + 1).collect()
    if len(rows) > 256 * 256:
        raise ValueError("at most 256 contexts of byte symbols")
    table: dict[int, np.ndarray] = {}
    for r in rows:
        table.setdefault(r.context, np.zeros(256))[r.v] += r.n

    def cost(h):
        n = h[h > 0]
        return float((n * (np.log2(n.sum()) - np.log2(n))).sum()) + header_bits

    clusters = {c: (h, cost(h), [c]) for c, h in sorted(table.items())}
    while len(clusters) > 1:
        keys = sorted(clusters)
        saved, a, b = max(((clusters[a][1] + clusters[b][1] - cost(clusters[a][0] + clusters[b][0]), -a, -b) for i, a in enumerate(keys) for b in keys[i + 1 :]))
        if saved <= 0:
            break
        a, b = -a, -b
        h = clusters[a][0] + clusters[b][0]
        clusters[a] = h, cost(h), clusters[a][2] + clusters.pop(b)[2]
    return {c: k for k, (_, _, members) in enumerate(clusters[key] for key in sorted(clusters)) for c in members}

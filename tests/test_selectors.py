import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from streams import ints, make, naturals, read

from strandloom import core
from strandloom.functions import statistics as st
from strandloom.operators import selectors as op


def h(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values())


def test_entropy_and_histogram(spark):
    chunks = naturals(50, 1)
    s = make(spark, chunks)
    got = {r.chunk_id: r.entropy for r in st.entropy(s).collect()}
    assert all(abs(got[k] - h(v)) < 1e-9 for k, v in chunks.items())
    assert {(r.chunk_id, r.v): r.n for r in st.histogram(s).collect()} == {(k, x): n for k, v in chunks.items() for x, n in Counter(v).items()}


def test_features(spark):
    r = {x.chunk_id: x for x in st.feature_vector(make(spark, {0: list(range(10)), 1: [5], 2: [3, 3]})).collect()}
    a = r[0]
    assert (a.n, a.cardinality, a.range_size, a["mean"], round(a.skewness, 9)) == (10, 10, 9, 4.5, 0)
    assert abs(a.variance - 9.1666667) < 1e-6 and abs(a.stddev - 3.02765) < 1e-5 and abs(a.kurtosis + 1.224242) < 1e-6
    assert (r[1].variance, r[1].skewness, r[1].kurtosis) == (0, 0, 0) and r[2].skewness is None


def test_a_profile_moves_only_values_and_counts(spark):
    chunks = ints(4)
    s = make(spark, chunks)
    got = {r.chunk_id: r for r in st.profile(s).collect()}
    assert {k: (r.n, r.cardinality, r.low & (1 << 64) - 1, r.high & (1 << 64) - 1) for k, r in got.items()} == {k: (len(v), len(set(v)), min(x & (1 << 64) - 1 for x in v), max(x & (1 << 64) - 1 for x in v)) for k, v in chunks.items()}
    assert all(abs(r.entropy - h(chunks[k])) < 1e-9 for k, r in got.items())
    for d in (st.profile(s), st.feature_vector(s), st.feature_vector(s.withColumn("v", F.when(F.col("pos") > 0, F.col("v"))))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        by_value = [x for x in re.findall(r"HashAggregate\(keys=\[(.*?)\], functions=\[(.*?)\]\)", plan) if " v#" in x[0]]
        assert by_value and all(not re.search("skewness|max_by", functions) for _, functions in by_value)
    assert [tuple(r) for r in st.feature_vector(spark.createDataFrame([(0, 0, 3), (0, 1, None), (0, 2, 5)], "chunk_id long, pos long, v long")).select("n", "cardinality").collect()] == [(2, 2)]


def test_ranges_and_cardinality(spark):
    chunks = ints(5)
    s = make(spark, chunks)
    u = lambda x: x & (1 << 64) - 1
    assert {r.chunk_id: (r.low, r.high) for r in st.unsigned_range(s).collect()} == {k: (min(v, key=u), max(v, key=u)) for k, v in chunks.items()}
    assert {r.chunk_id: r.cardinality for r in st.cardinality(s).collect()} == {k: len(set(v)) for k, v in chunks.items()}
    many = make(spark, {0: list(range(400)), 1: [1] * 50})
    got = {r.chunk_id: r.estimate for r in st.linear_counting(many).collect()}
    assert abs(got[0] - 400) < 40 and abs(got[1] - 1) < 0.01


def test_strides(spark):
    r = random.Random(2)
    table = [x for k in range(80) for x in (7, r.randrange(10**6), k, r.randrange(10**6), 9)]
    got = {x.chunk_id: (x.stride, x.verdict) for x in st.strides(make(spark, {0: table, 1: [r.randrange(10**9) for _ in range(200)], 2: [4]})).collect()}
    assert got[0] == (5, "likely") and got[1] == (None, "none") and got[2] == (None, "none")


def test_float_width(spark):
    r = np.random.default_rng(1)
    streams = {1: r.integers(0, 256, 4096, np.uint8), 2: (1 + r.random(4096) / 8).astype(np.float16).view(np.uint8), 4: (1 + r.random(4096)).astype(np.float32).view(np.uint8), 8: (1 + r.random(4096)).view(np.uint8), 3: r.integers(0, 256, 33, np.uint8)}
    got = {x.chunk_id: x.width for x in st.float_width(make(spark, {k: v.tolist() for k, v in streams.items()})).collect()}
    assert got == {1: 1, 2: 2, 4: 4, 8: 8, 3: 1}


def test_byte_swap_and_summary(spark):
    s = make(spark, {0: [1, 258, -2]})
    assert read(s.withColumn("v", st.byte_swapped(F.col("v"))))[0] == [int.from_bytes(x.to_bytes(8, "little", signed=True), "big", signed=True) for x in (1, 258, -2)]
    r = st.numeric_summary(make(spark, {0: [1, 300]}), 300).first()
    assert (r.total, r.top, r.under_limit, r.smallest_width) == (301, 300, False, 16)


def test_contexts_merge(spark):
    rows = [(c, v, n) for c, dist in {0: {1: 900, 2: 100}, 1: {1: 950, 2: 90}, 2: {7: 500, 8: 500}}.items() for v, n in dist.items()]
    got = st.merged_contexts(spark.createDataFrame(rows, "context int, v int, n long"))
    assert got[0] == got[1] != got[2]


def b(x):
    return math.ceil(math.log2(x)) if x > 1 else 0


def backend(v, mode):
    n, k, top, e = len(v), len(set(v)), max(v), h(v)
    bit, flat = (n * b(top + 1) + 7) // 8, (n * b(k) + 7) // 8 + k
    huff, fse = n if e > 7 else int(max(e, 1) * n / 8), (int(e * n) + 7) // 8
    coder = mode if mode != "any" else "fse" if fse + n // 32 < huff else "huffman"
    base = min((huff if coder == "huffman" else fse) + max(10, k // 4), n)
    if n <= 1:
        return "store"
    if k == 1:
        return "constant"
    if min(bit, flat) < base:
        return "bitpack" if bit <= flat else "flatpack"
    return "store" if n <= base else coder


@pytest.mark.parametrize("mode", ["any", "huffman", "fse"])
def test_byte_backend(spark, mode):
    r = random.Random(4)
    chunks = {0: [3], 1: [4] * 9, 2: list(range(256)) * 4, 3: [r.choice([0, 200]) for _ in range(500)]}
    for k in range(10, 40):
        a = r.randrange(1, 255)
        chunks[k] = [min(255, int(r.expovariate(1 / a))) for _ in range(r.randrange(1, 2000))]
    x = st.byte_statistics(make(spark, chunks))
    got = {q.chunk_id: q.c for q in x.select("chunk_id", op.byte_backend(F.col("n"), F.col("distinct"), F.col("top"), F.col("entropy"), mode).alias("c")).collect()}
    assert got == {k: backend(v, mode) for k, v in chunks.items()}
    assert len(set(got.values())) > 3


def test_two_byte_backend(spark):
    rows = [(1000, 1, 5, 0.0), (1000, 4, 3, 2.0), (1000, 300, 65535, 15.5), (100000, 200, 60000, 3.0), (1000000, 5000, 60000, 9.0)]
    d = spark.createDataFrame(rows, "n long, k long, top long, h double")
    got = [r.c for r in d.select(op.two_byte_backend(F.col("n"), F.col("k"), F.col("top"), F.col("h")).alias("c")).collect()]
    assert got == ["constant", "bitpack", "store", "tokenize", "huffman"]


def test_literal_backend(spark):
    rows = [(50, 1, 9, 9, 9, 9), (100, 5, 10, 10, 10, 10), (1000, 5, 990, 990, 500, 500), (1000, 5, 600, 600, 590, 1), (1000, 5, 600, 600, 300, 1), (1000, 5, 600, 500, 1, 495), (1000, 5, 600, 500, 1, 300)]
    d = spark.createDataFrame(rows, "n long, k long, hu long, dh long, z long, dz long")
    got = [r.c for r in d.select(op.literal_backend(*map(F.col, d.columns)).alias("c")).collect()]
    assert got == ["constant", "store", "store", "huffman", "zstd", "delta_huffman", "delta_zstd"]


def test_brute_force(spark):
    d = spark.createDataFrame([(1, 100, 50, 50), (2, 100, 90, 20), (3, 100, 100, 200)], "chunk_id long, raw long, a long, b long")
    assert [(r.choice, r.size) for r in op.brute_force(d, "raw", ["a", "b"]).orderBy("chunk_id").collect()] == [("a", 50), ("b", 20), ("store", 100)]


def test_pieces_and_routing(spark):
    s = spark.range(100_001).select(F.lit(0).cast("long").alias("chunk_id"), F.col("id").alias("pos"), F.col("id").alias("v"))
    assert {r.piece: r["count"] for r in op.entropy_pieces(s).groupBy("piece").count().collect()} == {0: 32768, 1: 32768, 2: 32768, 3: 1697}
    assert {r.piece for r in op.entropy_pieces(s.where("pos < 99999")).select("piece").distinct().collect()} == {0}
    t = make(spark, {0: ["", "a"]}, "string")
    assert [r.is_empty for r in op.null_aware(t).orderBy("pos").collect()] == [True, False]
    assert op.generic(t) == "separate_string_components" and op.on_empty(t.where("false"), lambda _: 1, lambda _: 2) == 1
    draws = Counter(r.k for r in spark.range(4000).withColumnRenamed("id", "chunk_id").select(op.probabilistic([1, 3], 5).alias("k")).collect())
    assert 800 < draws[0] < 1200 and set(draws) == {0, 1}
    assert [r.k for r in spark.range(4).withColumnRenamed("id", "tag").select(op.directed(None, "tag", 3).alias("k")).collect()] == [0, 1, 2, 2]


def test_boosted_trees(spark):
    leaf = lambda v: {"feature": -1, "value": v}
    stump = lambda f, t, a, b, m: [{"feature": f, "value": t, "left": 1, "right": 2, "missing": m}, leaf(a), leaf(b)]
    d = spark.createDataFrame([(1.0, 5.0), (3.0, float("nan")), (None, 9.0), (2.0, 2.0)], "x double, y double")
    model = {"features": ["x", "y"], "labels": ["a", "b", "c"], "forests": [[stump(0, 2, 1.0, 0.0, 2)], [stump(1, 6, 0.0, 2.0, 1), stump(0, 2, 0.5, 0.25, 1)], [stump(7, 0, 9.0, 0.3, 2)]]}
    assert [r.c for r in d.select(op.BoostedTrees(model).label().alias("c")).collect()] == ["a", "c", "b", "c"]
    one = {"features": ["x"], "labels": ["no", "yes"], "forests": [[stump(0, 2, -1.0, 0.0, 1)]]}
    assert [r.c for r in d.select(op.BoostedTrees(one).label().alias("c")).collect()] == ["no", "yes", "no", "yes"]
    assert d.select(op.BoostedTrees({"features": [], "labels": ["z"], "forests": []}).label().alias("c")).first().c == "z"


def test_pieces_of_a_long_chunk_are_joined_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(core, "STRETCH_BITS", 10)
    s = spark.range(100_101).select(F.when(F.col("id") < 100_001, 0).otherwise(1).cast("long").alias("chunk_id"), F.when(F.col("id") < 100_001, F.col("id")).otherwise(F.col("id") - 100_001).alias("pos"), F.col("id").alias("v"))
    pieces = op.entropy_pieces(s)
    got = pieces.groupBy("chunk_id", "piece").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min(F.col("v") - F.col("pos")).alias("first"))
    assert sorted(map(tuple, got.collect())) == [(0, k, n, 0, n - 1, k * 32768) for k, n in enumerate((32768, 32768, 32768, 1697))] + [(1, 0, 100, 0, 99, 100_001)]
    keys = re.findall(r"Join \[(.*?)\]", pieces._jdf.queryExecution().executedPlan().toString())
    assert keys and all("stretch" in k for k in keys)  # chunk_id alone would put a long chunk into one task


def test_the_query_of_pieces_has_no_window_over_a_chunk(spark):
    from strandloom import catalog

    plan = catalog.QUERIES["entropy_pieces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan

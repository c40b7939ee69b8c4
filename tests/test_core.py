import random

import pytest
from pyspark.sql import functions as F
from streams import make, read

from strandloom import core

R = random.Random(5)
EDGE = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 1 << 32, (1 << 32) - 1, -(1 << 32)]


def wrapped(x, width):
    x &= (1 << width) - 1
    return x - (1 << width) if x >> (width - 1) else x


@pytest.mark.parametrize("width", [8, 16, 32, 64])
def test_arithmetic_wraps(spark, width):
    pairs = [(a, b) for a in EDGE for b in EDGE] + [(R.getrandbits(64) - (1 << 63), R.getrandbits(64) - (1 << 63)) for _ in range(200)]
    d = spark.createDataFrame(pairs, "a long, b long")
    got = d.select("a", "b", core.wrap_sub(F.col("a"), F.col("b"), width).alias("d"), core.wrap_add(F.col("a"), F.col("b"), width).alias("s")).collect()
    assert all((r.d, r.s) == (wrapped(r.a - r.b, width), wrapped(r.a + r.b, width)) for r in got)


def test_running_sums_wrap(spark):
    values = [R.getrandbits(64) - (1 << 63) for _ in range(300)]
    s = make(spark, {0: values})
    got = read(s.withColumn("v", core.wrap_sum(F.col("v"), core.up_to_here())))[0]
    assert got == [wrapped(sum(values[: k + 1]), 64) for k in range(len(values))]


def test_unsigned_order_and_bits(spark):
    d = spark.createDataFrame([(x,) for x in EDGE], "v long")
    got = [r.v for r in d.orderBy(core.unsigned(F.col("v"))).collect()]
    assert got == sorted(EDGE, key=lambda x: x & (1 << 64) - 1)
    assert {r.v: r.n for r in d.select("v", core.bit_length(F.col("v")).alias("n")).collect()} == {x: (x & (1 << 64) - 1).bit_length() for x in EDGE}


@pytest.mark.parametrize("skewed", [False, True])
def test_global_positions(spark, tmp_path, skewed):
    keys = [(7 if skewed and k % 3 else R.randrange(10**6), k) for k in range(2000)]
    d = spark.createDataFrame(keys, "k long, j long").repartition(7)
    rows = core.positions(d, ["k", "j"], f"file://{tmp_path}/p", 300).collect()
    assert [(r.k, r.j) for r in sorted(rows, key=lambda r: r.pos)] == sorted(keys)
    assert sorted(r.pos for r in rows) == list(range(2000)) and all(r.chunk_id == r.pos // 300 for r in rows)
    assert core.positions(d.where("false"), ["k", "j"], f"file://{tmp_path}/e").count() == 0


def test_streams_of_tables(spark):
    d = spark.createDataFrame([(k, k * k) for k in range(25)], "k long, v long").repartition(4)
    got = read(core.stream(d, "v", "k", F.floor(F.col("k") / 10)))
    assert got == {c: [k * k for k in range(10 * c, min(25, 10 * c + 10))] for c in range(3)}


def test_small_chunks_share_batches():
    assert [b.num_rows for b in core.in_batches(((k,) for k in range(25)), ["a"], [core.pa.int64()], 10)] == [10, 10, 5]
    out = list(core.in_arrays([(k, core.np.arange(k)) for k in range(6)], 5))
    assert [b.num_rows for b in out] == [6, 9] and out[0].column(0).to_pylist() == [1, 2, 2, 3, 3, 3]


def test_a_cluster_must_name_its_scratch_folder():
    from types import SimpleNamespace

    from strandloom.core import scratch_dir

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    assert scratch_dir(session("spark://host:7077", "hdfs:///scratch/")) == "hdfs:///scratch"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch_dir(session(master))


@pytest.mark.parametrize("halves", [False, True])
def test_a_long_chunk_is_numbered_by_ranges(spark, halves):
    keys = [(R.randrange(10**6), k) for k in range(2000)]
    d = spark.createDataFrame(keys, "k long, j long").repartition(7)
    s = core.long_stream(d, "j", ["k", "j"], F.col("k") % 2) if halves else core.stream(d, "j", ["k", "j"])
    want = {c: [j for k, j in sorted(keys) if not halves or k % 2 == c] for c in range(1 + halves)}
    assert read(s) == want
    assert "row_number" not in s._jdf.queryExecution().executedPlan().toString()  # no window over a whole chunk
    assert core.stream(d.where("false"), "j", ["k", "j"]).count() == 0

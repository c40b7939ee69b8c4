import random

import pytest
from pyspark.util import PythonEvalType
from streams import STRING_EDGE, make, naturals, read

from strandloom.core import CodecError
from strandloom.operators import backends as op
from strandloom.operators import clustering as cl
from strandloom.operators import segmenters as seg

R = random.Random(8)
BYTES = {0: [b""], 1: [b"abc" * 500], 2: [R.randbytes(1000), b"x"]}


@pytest.mark.parametrize("codec", [op.Store(), op.Zstd(), op.Zstd(19), op.Lz4()])
def test_bytes_round_trip(spark, codec):
    s = make(spark, BYTES, "binary")
    assert read(codec.decode(codec.encode(s))) == BYTES


@pytest.mark.parametrize("codec", [op.Huffman, op.Fse, op.FieldLz])
def test_symbols_round_trip(spark, codec):
    chunks = {k: [x % 256 for x in v] for k, v in naturals(256, 4).items()} | {50: [7], 51: [7] * 300, 52: [1, 2, 3, 4] * 80 + [9] * 40, 53: list(range(100)) * 3, 54: [0] * 5000 + [1]}
    c = codec()
    assert read(c.decode(c.encode(make(spark, chunks)))) == chunks


def test_codes():
    assert op.canonical_codes(op.huffman_lengths({1: 8, 2: 4, 3: 2, 4: 2})) == {1: (0, 1), 2: (0b10, 2), 3: (0b110, 3), 4: (0b111, 3)}
    assert sum(op.scaled_counts({k: 1 + k**3 for k in range(300)}).values()) == op.SLOTS
    assert sum(op.scaled_counts(dict.fromkeys(range(op.SLOTS - 1), 5) | {-1: 10**9}).values()) == op.SLOTS
    with pytest.raises(CodecError):
        op.scaled_counts(dict.fromkeys(range(op.SLOTS + 1), 1))


def test_field_lz_finds_matches(spark):
    e = op.FieldLz().encode(make(spark, {0: [1, 2, 3, 4] * 100}))
    assert read(e["literals"])[0] == [1, 2, 3, 4] and read(e["offsets"])[0] == [4]


def test_segments(spark):
    s = make(spark, {0: list(range(10))})
    assert {(r.segment, r.pos, r.v) for r in seg.segment_numeric(s, 64, 32).collect()} == {(k // 4, k % 4, k) for k in range(10)}
    lines = make(spark, {0: ["aaa", "b", "cccccc", "", "d"], 1: ["x"]}, "string")
    got = {(r.chunk_id, r.pos): r.segment for r in seg.segment_lines(lines, 5).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 2, (0, 4): 2, (1, 0): 0}
    tokens = make(spark, {0: [3, 3, 9, 1, 4, 1]})
    assert [r.segment for r in seg.segment_tokens(tokens, 6).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 2]
    assert [r.segment for r in seg.segment_with(s, lambda v: [4, 6]).orderBy("pos").collect()] == [0] * 4 + [1] * 6


def test_clusters(spark):
    a, b, c, d = (make(spark, {0: [k, k + 1], 1: [k]}) for k in range(4))
    t = make(spark, STRING_EDGE, "string")
    config = cl.ClusteringConfig([cl.Cluster([5, 7], successor="x")], [("string", "text")])
    assert cl.ClusteringConfig.from_json(config.to_json()) == config
    got = cl.cluster({0: a, 1: b, 2: c, 3: d, 4: t}, config, {0: 7, 1: 9, 2: 5, 3: 9, 4: 5})
    assert [(s, m) for s, m, _ in got] == [("x", [0, 2]), ("generic", [1, 3]), ("text", [4])]
    back = cl.uncluster(got)
    assert [read(back[k]) for k in range(4)] == [{0: [k, k + 1], 1: [k]} for k in range(4)] and read(back[4]) == STRING_EDGE
    for bad in ([cl.Cluster([1]), cl.Cluster([1])], [cl.Cluster([1], codec="zip")]):
        with pytest.raises(CodecError):
            cl.ClusteringConfig(bad)
    with pytest.raises(CodecError):
        cl.ClusteringConfig([], [("long", "a"), ("long", "b")])


@pytest.mark.parametrize("codec", [op.Zstd, op.Lz4])
def test_compressors_work_in_arrow(spark, codec):
    values = [b"", None, b"a" * 100_000, *(bytes([k % 7]) * k for k in range(300)), None]
    c, s = codec(), make(spark, {0: values, 1: [None], 2: [b""]}, "binary")
    assert read(c.decode(c.encode(s))) == {0: values, 1: [None], 2: [b""]}
    assert op._over(c.pack).evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF  # a batch never becomes Python objects

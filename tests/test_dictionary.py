import pytest
from pyspark.sql import functions as F
from streams import STRING_EDGE, ints, make, naturals, ok, read

from strandloom.core import CodecError
from strandloom.operators import dictionary as op


@pytest.mark.parametrize("sort", [False, True])
def test_tokenize(spark, sort):
    t = op.Tokenize(sort)
    for chunks, kind in ((ints(8), "long"), (STRING_EDGE, "string")):
        e = t.encode(make(spark, chunks, kind))
        assert read(t.decode(e)) == chunks
    want = [1, 4, 5] if sort else [5, 4, 1]
    e = t.encode(make(spark, {0: [5, 4, 5, 1, 1]}))
    assert read(e["alphabet"])[0] == want and read(e["indices"])[0] == [want.index(x) for x in (5, 4, 5, 1, 1)]


def test_tokenize_order_width_and_nulls(spark):
    assert read(op.Tokenize(True).encode(make(spark, {0: [-1, 0, 5]}))["alphabet"])[0] == [0, 5, -1]  # as unsigned
    own = op.Tokenize(sort_key=lambda v: F.length(v))
    assert read(own.encode(make(spark, {0: ["ccc", "b", "aa"]}, "string"))["alphabet"])[0] == ["b", "aa", "ccc"]
    s = make(spark, {0: list(range(256)), 1: list(range(257)), 2: [1, None, 1, None]})
    assert {r.chunk_id: r.index_width for r in op.Tokenize.index_width(s).collect()} == {0: 8, 1: 16, 2: 8}
    t = op.Tokenize()
    assert read(t.decode(t.encode(s)))[2] == [1, None, 1, None]


def test_constant(spark):
    chunks = {0: [7] * 5, 1: [3], 2: [1, 2], 3: [None, 1], 4: [None, None]}
    s = make(spark, chunks)
    assert ok(op.Constant().check(s)) == {0: True, 1: True, 2: False, 3: False, 4: True}
    c = op.Constant()
    assert read(c.decode(c.encode(s.where("chunk_id IN (0, 1, 4)")))) == {k: chunks[k] for k in (0, 1, 4)}


def test_dedup(spark):
    a, b, c = make(spark, ints(1)), make(spark, ints(1)), make(spark, ints(2))
    d = op.Dedup()
    assert all(read(x) == ints(1) for x in d.decode(d.encode(a, b)))
    with pytest.raises(CodecError):
        d.encode(a, c)
    with pytest.raises(CodecError):
        d.encode(a, b.where("pos < 3"))
    assert len(op.Dedup(trusted=True).decode(op.Dedup(trusted=True).encode(a, c))) == 2


def test_prefix(spark):
    p = op.Prefix()
    e = p.encode(make(spark, STRING_EDGE, "string"))
    assert read(p.decode(e)) == STRING_EDGE
    assert read(e["lengths"])[1] == [0, 1, 2, 2, 0, 0] and read(e["lengths"])[2] == [0, 1, 1, 0, 0, 4]
    long = {0: ["x" * 5000, "x" * 4999 + "y", "x" * 70000]}
    assert read(p.encode(make(spark, long, "string"))["lengths"])[0] == [0, 4999, 4999]


def test_flat_pack(spark):
    chunks = {k: [x % 256 for x in v] for k, v in naturals(256, 3).items()} | {50: [9], 51: list(range(256))}
    f = op.FlatPack()
    assert read(f.decode(f.encode(make(spark, chunks)))) == chunks
    assert {r.chunk_id: r.bytes for r in f.size(make(spark, {0: [1, 2, 3, 1], 1: [7] * 9})).collect()} == {0: 1 + 1 + 3, 1: 2}

import numpy as np
import pytest
from streams import INT_EDGE, STRING_EDGE, ints, make, naturals, ok, read

from strandloom.core import CodecError
from strandloom.operators import numeric as op


@pytest.mark.parametrize("width", [8, 16, 32, 64])
@pytest.mark.parametrize("codec", [op.Delta, op.RangePack])
def test_round_trip_by_width(spark, codec, width):
    chunks = ints(3, width)
    s = make(spark, chunks)
    c = codec(width)
    assert read(c.decode(c.encode(s))) == chunks


def test_delta_values(spark):
    e = op.Delta().encode(make(spark, INT_EDGE))
    got = read(e["deltas"])
    assert got[3] == [1] * 49 and 0 not in got
    assert got[2][0] == -1 and {r.chunk_id: r["first"] for r in e.header.collect()}[5] == 6


def test_range_pack_header(spark):
    e = op.RangePack().encode(make(spark, {0: [5, 260], 1: [5, 261], 2: [-1, 0], 3: [9]}))
    assert {r.chunk_id: (r.low, r.packed_width) for r in e.header.collect()} == {0: (5, 8), 1: (5, 16), 2: (0, 64), 3: (9, 8)}


def test_zigzag(spark):
    chunks = ints(4)
    z = op.ZigZag()
    e = z.encode(make(spark, chunks))
    assert read(z.decode(e)) == chunks
    assert read(z.encode(make(spark, {0: [0, -1, 1, -2, 2]}))["v"])[0] == [0, 1, 2, 3, 4]


def test_divide_by(spark):
    chunks = {0: [6, 12, -18], 1: [0, 0], 2: [7], 3: [5, 5, 5], 4: [0, 9], 5: [-4, -4], 6: [2, 3]}
    d = op.DivideBy()
    e = d.encode(make(spark, chunks))
    assert {r.chunk_id: r.divisor for r in e.header.collect()} == {0: 6, 1: 1, 2: 1, 3: 5, 4: 9, 5: 4, 6: 1}
    assert read(d.decode(e)) == chunks
    assert ok(op.DivideBy(3).check(make(spark, chunks)))[0] and not ok(op.DivideBy(3).check(make(spark, chunks)))[6]
    with pytest.raises(CodecError):
        op.DivideBy(3).require(make(spark, chunks))
    with pytest.raises(CodecError):
        op.DivideBy(0)


@pytest.mark.parametrize("kind", ["float32", "bfloat16", "float16"])
def test_float_deconstruct(spark, kind):
    e, f = op.FloatDeconstruct.LAYOUTS[kind]
    chunks = naturals(1 << (1 + e + f), 5)
    c = op.FloatDeconstruct(kind)
    enc = c.encode(make(spark, chunks))
    assert read(c.decode(enc)) == chunks
    assert max(map(max, read(enc["exponent"]).values())) < 1 << e


def test_floats_keep_their_bits(spark):
    x = np.array([0.0, -0.0, 1.5, -2.25, np.inf, -np.inf, np.nan, 1e-45, 3.4e38], np.float32)
    s = make(spark, {0: x.tolist()}, "float")
    bits = op.FloatDeconstruct.of_floats(s)
    assert read(bits)[0] == x.view(np.uint32).tolist()
    c = op.FloatDeconstruct()
    back = read(op.FloatDeconstruct.to_floats(c.decode(c.encode(bits))))[0]
    assert np.array(back, np.float32).view(np.uint32).tolist() == x.view(np.uint32).tolist()


def test_merge_sorted(spark):
    chunks = {0: [1, 5, 9, 2, 5, 7, 1, 9], 1: [4], 2: list(range(64, 0, -1)), 3: [3, 3, 3]}
    m = op.MergeSorted()
    e = m.encode(make(spark, chunks))
    assert read(m.decode(e)) == chunks
    assert read(e["values"])[0] == [1, 2, 5, 7, 9] and read(e["bits"])[0] == [0b101, 0b10, 0b11, 0b10, 0b101]
    s = make(spark, chunks | {9: list(range(65, 0, -1))})
    assert ok(m.check(s)) == {0: True, 1: True, 2: True, 3: True, 9: False}
    assert {r.chunk_id: r.choice for r in op.merge_sorted_or_backup(s).collect()}[9] == "backup"


@pytest.mark.parametrize("kind, least", [("offsets", 1), ("lengths", 0)])
def test_quantize(spark, kind, least):
    chunks = naturals(1 << 32, 6, least)
    q = op.Quantize(kind)
    assert read(q.decode(q.encode(make(spark, chunks)))) == chunks
    assert ok(q.check(make(spark, {0: [0, 1], 1: [1, 1 << 32], 2: [1]}))) == {0: kind == "lengths", 1: False, 2: True}


def test_quantize_codes(spark):
    assert read(op.Quantize("lengths").encode(make(spark, {0: [0, 15, 16, 31, 32, (1 << 32) - 1]}))["codes"])[0] == [0, 15, 16, 16, 17, 43]
    assert read(op.Quantize("offsets").encode(make(spark, {0: [1, 2, 3, 4, (1 << 32) - 1]}))["codes"])[0] == [0, 1, 1, 2, 31]


def test_bit_packing(spark):
    chunks = ints(7)
    b = op.BitPack()
    s = make(spark, chunks)
    e = b.encode(s)
    assert read(b.decode(e)) == chunks
    sizes = {r.chunk_id: (r.bits, r.bytes) for r in b.size(s).collect()}
    assert sizes == {r.chunk_id: (r.bits, len(r.v)) for r in e["bytes"].join(e.header, "chunk_id").collect()}


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 64])
def test_bit_unpack(spark, bits):
    chunks = {0: [b"\xff\x01\x80"], 1: [bytes(range(64))], 2: [b""], 3: [b"\x07"]}
    b = op.BitUnpack(bits)
    assert read(b.decode(b.encode(make(spark, chunks, "binary")))) == chunks


def test_parse_int(spark):
    s = make(spark, STRING_EDGE, "string")
    p, t = op.ParseInt(), op.TryParseInt()
    assert [k for k, v in ok(p.check(s)).items() if v] == [5]
    assert read(p.decode(p.encode(s.where("chunk_id = 5")))) == {5: STRING_EDGE[5]}
    e = t.encode(s)
    assert read(t.decode(e)) == STRING_EDGE
    assert read(e["exceptions"])[3] == ["-0", "01", "+1", " 1", "1\n", "9223372036854775808", "1.0"]
    assert {r.chunk_id: r.choice for r in t.route(s).collect()} == {0: "strings", 1: "strings", 2: "strings", 3: "mixed", 4: "strings", 5: "numbers"}


def test_floats_as_text(spark):
    values = ["1.5", "0.1", "-0.0", "1.0E10", "1e10", "1.50", "x", "", "NaN", "Infinity", "nan", "123456.789", "0.30000000000000004", " 1.5", "+1.5", ".5", "1"]
    c = op.TryParseFloat()
    e = c.encode(make(spark, {0: values, 1: ["2.5"]}, "string"))
    assert read(c.decode(e)) == {0: values, 1: ["2.5"]}
    assert [v for v in read(e["numbers"])[0] if v == v] == [1.5, 0.1, -0.0, 1e10, float("inf"), 123456.789, 0.30000000000000004]
    assert {r.chunk_id: r.choice for r in c.route(make(spark, {0: values, 1: ["2.5"], 2: ["a"]}, "string")).collect()} == {0: "mixed", 1: "numbers", 2: "strings"}
    assert {r.chunk_id: r.ok for r in op.ParseFloat().check(make(spark, {0: values, 1: ["2.5"]}, "string")).collect()} == {0: False, 1: True}


def test_differences_of_narrow_integers(spark):
    values = [1, -5, 2**31 - 1, -(2**31), 0]
    c = op.Delta()
    assert read(c.decode(c.encode(make(spark, {0: values}, "int")))) == {0: values}

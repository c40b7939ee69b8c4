import random
import struct

import pytest
from streams import make, read

from strandloom.core import CodecError
from strandloom.sources import layout as op

R = random.Random(12)
STARS = b"H" * 28 + b"".join(struct.pack("<dd2shff", k / 7, -k, b"A%d" % (k % 10), k - 5, k * 0.5, 0.25) for k in range(300))
SEGMENTS = b"".join(struct.pack("<IBI", n * w, w, tag) + R.randbytes(n * w) for n, w, tag in [(3, 4, 9), (0, 1, 1), (5, 2, 7), (2, 8, 9)])
CASES = [
    (op.STAR_CATALOGUE, STARS),
    ("Record S() = { size: UInt32LE, width: UInt8, tag: UInt32LE, body: Bytes(size) }\nall: S[]", SEGMENTS),
    ("all: UInt16BE[]", R.randbytes(64)),
    ("Record P() = { x: Int16LE, y: UInt8 }\nn: UInt8\npoints: soa P[n]\nrest: Bytes(scope_remaining())", b"\x03" + bytes(range(9)) + b"tail"),
    ("enum K { A = 1, B = 1 << 1 }\nUnion U(k) = { case 1: UInt8, case 2..4, 9: UInt32LE[2], default: Bytes(3) }\nRecord R() = { k: UInt8, u: U(k) }\nall: R[]", b"\x01a" + b"\x03" + bytes(8) + b"\x07xyz" + b"\x09" + bytes(8)),
    ("Record R(v) = { a: UInt8, when v >= 2 { b: UInt16LE, var c = b + 1, expect c > 1 } } pad_to 5 pad_align 4\nr: R(2)\ns: R(1)[2]", bytes(range(1, 25))),
    ("name: Bytes until 0\nline: Bytes until \"\\r\\n\"\nx: align(8) UInt64BE", b"abc\0" + b"line\r\n" + bytes(6) + b"12345678"),
    ("m: Float32LE[2][3]\nh: BFloat16LE\nw: UInt8 where (w == 7)", R.randbytes(26) + b"\x07"),
    ("n: UInt8\nvar k = switch n { case 1, 2: 10, case 3..5: 20, default: 0 }\nb: Bytes(k)\nexpect parsed_length(b) == k and not (k == 0)", b"\x04" + bytes(20)),
    ("# nothing\n", b""),
]


def test_round_trips(spark):
    for k, (text, data) in enumerate(CASES):
        c = op.BinaryLayout(text)
        assert read(c.decode(c.encode(make(spark, {k: [data]}, "binary")))) == {k: [data]}, text


def test_columns(spark):
    e = op.BinaryLayout(op.STAR_CATALOGUE).encode(make(spark, {0: [STARS], 1: [STARS[:84]]}, "binary"))
    assert read(op.BinaryLayout.column(e, "stars.mag"))[0] == [k - 5 for k in range(300)]
    assert read(op.BinaryLayout.column(e, "stars.ra"))[1] == [0.0, 1 / 7]
    assert read(op.BinaryLayout.column(e, "stars.kind"))[1] == [b"A0", b"A1"]
    e = op.BinaryLayout(CASES[1][0]).encode(make(spark, {0: [SEGMENTS]}, "binary"))
    assert read(op.BinaryLayout.column(e, "all.tag"))[0] == [9, 1, 7, 9]
    with pytest.raises(CodecError):
        op.BinaryLayout.column(e, "all.nothing")


def test_arrays_of_fixed_records_are_one_segment():
    assert len(op.Layout(op.STAR_CATALOGUE).read(STARS)) == 2


@pytest.mark.parametrize("expression, want", [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("7 / -2", -3), ("-7 % 3", -1), ("6 & 3 | 8", 10), ("1 << 4 >> 1", 8), ("1 < 2 and 2 < 1 or 1", 1), ("not 0", 1), ("~0", -1), ("abs(-4)", 4),
    ("min(3, 2)", 2), ("clamp(0, 9, 5)", 5), ("sgn(-9)", -1), ("between(1, 2, 3)", 1), ("ceil_div(7, 2)", 4), ("ceil_div(8, 2)", 4), ("align_up(9, 8)", 16), ("0x10 ^ 0b1", 17), ("2 in K", 1), ("3 in K", 0), ("K.B", 2),
    ("sizeof(T(2))", 7), ("1 == 2 == 0", 1),
])
def test_expressions(expression, want):
    text = f"enum K {{ A = 1, B = 2 }}\nRecord T(n) = {{ a: UInt32LE, b: Bytes(n), c: Byte }}\nexpect ({expression}) == {want}"
    assert op.Layout(text).read(b"") == []


@pytest.mark.parametrize("text, data", [
    ("x: UInt32LE", b"abc"), ("x: UInt8", b"ab"), ("expect 1 == 2", b""), ("x: UInt8 where (x > 1)", b"\x01"), ("x: Bytes until 0", b"abc"), ("expect 1 / 0", b""),
    ("expect 0x7fffffffffffffff + 1", b""), ("x: Nothing", b"a"), ("expect y", b""), ("expect (switch 3 { case 1: 1 })", b""), ("Record R() = { a: UInt8, b: UInt8 } pad_to 1\nr: R()", b"ab"), ("n: Int8\nx: Bytes(1)[n]", b"\xffa"),
])
def test_what_does_not_fit_is_an_error(text, data):
    with pytest.raises(CodecError):
        op.Layout(text).read(data)


@pytest.mark.parametrize("text", ["x UInt8", "x: $", "Record R( = {}", "x: UInt8[", "expect", "x: Bytes("])
def test_what_is_no_layout_is_an_error(text):
    with pytest.raises(CodecError):
        op.BinaryLayout(text)

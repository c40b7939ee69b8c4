import random

import pytest
from streams import make, read

from strandloom.core import CodecError
from strandloom.sources import layout_vm as op

R = random.Random(2)


def tagged(tag, kind, n):
    return f"push.tag {tag}\npush.type.{kind}\npush.i32 {n}\nsegment.create_tagged\n"


MIXED = tagged(1, "u8", 4) + tagged(2, "i32le", 1) + "push.i32 4 # bytes\nsegment.create_unspecified\nhalt"
STRUCT = "push.tag 7\npush.type.u16be\npush.type.i32le\npush.type.u8\npush.i32 3\ntype.fixed_array\npush.i32 3\ntype.structure\npush.remaining\npush.i32 9\nmath.div\nsegment.create_tagged\nhalt"
LENGTH = "push.current_pos\nload.u16le\npush.i32 2\nsegment.create_unspecified\nsegment.create_unspecified\nhalt"


@pytest.mark.parametrize("program, data", [(MIXED, R.randbytes(12)), (STRUCT, R.randbytes(45)), (LENGTH, b"\x03\x00abcrest"), ("halt", b""), ("halt", b"all"), (tagged(5, "u16be", 4) + "halt", R.randbytes(8))])
def test_round_trip(spark, program, data):
    c = op.LayoutProgram(program)
    assert read(c.decode(c.encode(make(spark, {0: [data]}, "binary")))) == {0: [data]}


def test_streams(spark):
    data = bytes([0xAA, 1, 2, 3]) + (42).to_bytes(4, "little") + b"tail"
    e = op.LayoutProgram(MIXED).encode(make(spark, {0: [data]}, "binary"))
    assert read(op.LayoutProgram.numbers(e, 0))[0] == [0xAA, 1, 2, 3] and read(op.LayoutProgram.numbers(e, 1))[0] == [42]
    e = op.LayoutProgram(STRUCT).encode(make(spark, {0: [bytes(range(18))]}, "binary"))
    assert read(op.LayoutProgram.numbers(e, 0))[0] == [0x0001, 0x090A] and read(op.LayoutProgram.numbers(e, 2))[0] == [6, 7, 8, 15, 16, 17]


def test_segments_of_one_tag_join():
    parts = op.Machine(op.assemble(tagged(1, "u8", 2) + tagged(1, "u8", 3) + tagged(2, "u8", 1) + tagged(1, "u8", 1) + "halt"), bytes(9)).run()
    assert [(p.tag, p.end - p.start) for p in parts] == [(1, 5), (2, 1), (1, 1), (None, 2)]


@pytest.mark.parametrize("code, want", [
    ("push.i32 7\npush.i32 -2\nmath.div", -3), ("push.i32 -7\npush.i32 3\nmath.mod", -1), ("push.i32 2\npush.i32 3\nmath.sub", -1), ("push.i32 -4\nmath.abs", 4), ("push.zero\nmath.neg", 0),
    ("push.i32 1\npush.i32 2\ncmp.lt", 1), ("push.i32 6\npush.i32 3\nlogic.xor", 5), ("push.zero\nlogic.not", -1), ("push.i32 1\npush.i32 2\nstack.swap\nmath.sub", 1), ("push.i32 1\npush.i32 2\nstack.over\nmath.add\nmath.add", 4),
    ("push.i32 1\npush.i32 2\npush.i32 3\nstack.rot\nmath.sub\nmath.sub", 0), ("push.i32 5\npush.i32 9\npush.i32 1\nstack.drop_if", 5), ("push.i32 3\nstack.dup\nmath.mul", 9), ("push.stack_depth", 0),
    ("push.type.u16le\npush.i32 5\ntype.fixed_array\ntype.sizeof", 10), ("push.i32 1\nload.i8", -1), ("push.zero\nload.u16be", 511), ("push.remaining", 3),
])
def test_instructions(code, want):
    assert op.Machine(op.assemble(f"{code}\npush.i64 {want}\ncmp.eq\nexpect_true\nhalt"), b"\x01\xff\x00").run()[0].end == 3


@pytest.mark.parametrize("code", [
    "push.i32 9\nsegment.create_unspecified\nhalt", "push.zero\nexpect_true\nhalt", "math.add\nhalt", "push.i32 1\npush.zero\nmath.div\nhalt", "push.i64 9223372036854775807\npush.i32 1\nmath.add\nhalt", "push.i32 3\nload.u8\nhalt",
    tagged(1, "u8", 1) + tagged(1, "i8", 1) + "halt", "push.zero", "push.type.u8\npush.zero\nmath.add\nhalt", "push.zero\n" * 5000 + "halt",
])
def test_errors_when_run(code):
    with pytest.raises(CodecError):
        op.Machine(op.assemble(code), b"abc").run()


@pytest.mark.parametrize("code", ["jump", "push.i32", "push.i32 x", "push.u32 -1", "push.zero 1", "push.type.u128", "load.f32le"])
def test_errors_when_assembled(code):
    with pytest.raises(CodecError):
        op.assemble(code)

"""A stack machine for binary layouts: the low-level form of the layout language.

A program is text, an instruction a line, ``#`` for comments.  It moves over the input by creating segments: bytes
with or without a tag and a type.  Segments that follow one another under one tag are one; a tag keeps one type.
What is left at the end is a last segment without tag.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Codec, CodecError, Encoded

STACK = 4096
SEGMENTS = 512 * 1024
TAGS = 32 * 1024


class VmError(CodecError):
    pass


#: Types: (numpy kind, bytes); None stands for raw bytes.
TYPES: dict[str, tuple[str | None, int]] = {"bytes": (None, 1), "u8": ("u1", 1), "i8": ("i1", 1), "f8": ("u1", 1)}
for _bits in (16, 32, 64):
    for _letter in "uif":
        for _end, _mark in (("le", "<"), ("be", ">")):
            TYPES[f"{_letter}{_bits}{_end}"] = f"{_mark}{_letter}{_bits // 8}", _bits // 8
TYPES |= {"bf16le": ("<u2", 2), "bf16be": (">u2", 2)}

#: Loads: letter, bits and order of bytes.
LOADS = [*("u8", "i8"), *(f"{k}{n}{e}" for n in (16, 32) for e in ("le", "be") for k in "ui"), "i64le", "i64be"]


@dataclass(frozen=True)
class Kind:
    """A type: a list of (name, count) leaves; more than one leaf, or a leaf more than once, is a structure or array."""

    leaves: tuple[tuple[str, int], ...]

    @property
    def size(self) -> int:
        return sum(TYPES[n][1] * k for n, k in self.leaves)


@dataclass(frozen=True)
class Tag:
    number: int


@dataclass
class Part:
    tag: int | None
    kind: Kind | None
    start: int
    end: int


def assemble(text: str) -> list[tuple[str, int | None]]:
    """The instructions of a program; unknown ones and wrong parameters are errors."""
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        words = line.split("#")[0].split()
        if not words:
            continue
        op, args = words[0], words[1:]
        takes = op in ("push.u32", "push.i32", "push.i64", "push.tag", "type.structure")
        if op not in OPS and not (op.startswith("push.type.") and op[10:] in TYPES) and not (op.startswith("load.") and op[5:] in LOADS):
            raise VmError(f"line {number}: no instruction {op}")
        if len(args) not in ((0, 1) if op == "type.structure" else (int(takes),)):
            raise VmError(f"line {number}: {op} takes {int(takes)} parameters")
        try:
            value = int(args[0], 0) if args else None
        except ValueError:
            raise VmError(f"line {number}: {args[0]} is no number") from None
        bounds = {"push.u32": (0, 2**32 - 1), "push.tag": (0, 2**32 - 1), "push.i32": (-(2**31), 2**31 - 1), "push.i64": (-(2**63), 2**63 - 1)}
        if op in bounds and not bounds[op][0] <= value <= bounds[op][1]:
            raise VmError(f"line {number}: {value} is out of range")
        out.append((op, value))
    return out


class Machine:
    def __init__(self, program: list[tuple[str, int | None]], data: bytes):
        self.program, self.data, self.at, self.stack, self.parts = program, data, 0, [], []
        self.kinds: dict[int, Kind] = {}

    def run(self) -> list[Part]:
        for op, value in self.program:
            if op == "halt":
                break
            if op.startswith("push.type."):
                self.push(Kind(((op[10:], 1),)))
            elif op.startswith("load."):
                self.load(op[5:])
            else:
                OPS[op](self, value)
        else:
            raise VmError("the program doesn't halt")
        if self.at < len(self.data):
            self.segment(None, None, len(self.data) - self.at)
        return self.parts

    def push(self, x) -> None:
        if len(self.stack) >= STACK:
            raise VmError("the stack is full")
        self.stack.append(x)

    def pop(self, kind: type = int):
        if not self.stack:
            raise VmError("the stack is empty")
        x = self.stack.pop()
        if not isinstance(x, kind):
            raise VmError(f"{kind.__name__} expected on the stack")
        return x

    def number(self, x: int) -> None:
        if not -(1 << 63) <= x < 1 << 63:
            raise VmError("overflow")
        self.push(x)

    def load(self, name: str) -> None:
        address = self.pop()
        kind, size = TYPES[name]
        if not 0 <= address <= len(self.data) - size:
            raise VmError("a load beyond the input")
        self.push(int(np.frombuffer(self.data, kind, 1, address)[0]))

    def segment(self, tag: int | None, kind: Kind | None, size: int) -> None:
        if size < 0 or self.at + size > len(self.data):
            raise VmError("a segment goes beyond the input")
        if tag is not None:
            if self.kinds.setdefault(tag, kind) != kind:
                raise VmError(f"tag {tag} has another type")
            if len(self.kinds) > TAGS:
                raise VmError("too many tags")
        last = self.parts[-1] if self.parts else None
        if last and last.tag == tag:
            last.end += size
        else:
            if len(self.parts) >= SEGMENTS:
                raise VmError("too many segments")
            self.parts.append(Part(tag, kind, self.at, self.at + size))
        self.at += size


def _two(f):
    def op(m: Machine, _):
        b, a = m.pop(), m.pop()
        m.number(int(f(a, b)))

    return op


def _quotient(a: int, b: int) -> int:
    if b == 0:
        raise VmError("division by zero")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _expect(m: Machine, _):
    if not m.pop():
        raise VmError(f"an expectation fails at byte {m.at}")


def _rot(m: Machine, _):
    c, b, a = m.pop(object), m.pop(object), m.pop(object)
    for x in (b, c, a):
        m.push(x)


def _swap(m: Machine, _):
    b, a = m.pop(object), m.pop(object)
    m.push(b)
    m.push(a)


def _over(m: Machine, _):
    if len(m.stack) < 2:
        raise VmError("the stack is empty")
    m.push(m.stack[-2])


def _dup(m: Machine, _):
    x = m.pop(object)
    m.push(x)
    m.push(x)


def _drop_if(m: Machine, _):
    if m.pop():
        m.pop(object)


def _fixed_array(m: Machine, _):
    n, kind = m.pop(), m.pop(Kind)
    if n <= 0:
        raise VmError("an array has at least one element")
    if len(kind.leaves) == 1:
        m.push(Kind(((kind.leaves[0][0], kind.leaves[0][1] * n),)))
    else:
        m.push(Kind(kind.leaves * n))


def _structure(m: Machine, value):
    n = m.pop() if value is None else value
    if n <= 0:
        raise VmError("a structure has at least one field")
    fields = [m.pop(Kind) for _ in range(n)][::-1]
    m.push(Kind(tuple(leaf for k in fields for leaf in k.leaves)))


def _tagged(m: Machine, _):
    n, kind, tag = m.pop(), m.pop(Kind), m.pop(Tag)
    m.segment(tag.number, kind, n * kind.size)


OPS = {
    "halt": None, "push.zero": lambda m, _: m.push(0), "push.current_pos": lambda m, _: m.push(m.at), "push.remaining": lambda m, _: m.push(len(m.data) - m.at),
    "push.stack_depth": lambda m, _: m.push(len(m.stack)), "push.tag": lambda m, v: m.push(Tag(v)),
    **{f"push.{k}": (lambda m, v: m.push(v)) for k in ("u32", "i32", "i64")},
    "math.add": _two(lambda a, b: a + b), "math.sub": _two(lambda a, b: a - b), "math.mul": _two(lambda a, b: a * b), "math.div": _two(_quotient), "math.mod": _two(lambda a, b: a - b * _quotient(a, b)),
    "math.abs": lambda m, _: m.number(abs(m.pop())), "math.neg": lambda m, _: m.number(-m.pop()),
    "cmp.eq": _two(lambda a, b: a == b), "cmp.ne": _two(lambda a, b: a != b), "cmp.lt": _two(lambda a, b: a < b), "cmp.le": _two(lambda a, b: a <= b), "cmp.gt": _two(lambda a, b: a > b), "cmp.ge": _two(lambda a, b: a >= b),
    "logic.and": _two(lambda a, b: a & b), "logic.or": _two(lambda a, b: a | b), "logic.xor": _two(lambda a, b: a ^ b), "logic.not": lambda m, _: m.push(~m.pop()),
    "expect_true": _expect, "trace.start": lambda m, _: None, "stack.dup": _dup, "stack.over": _over, "stack.drop": lambda m, _: m.pop(object), "stack.swap": _swap, "stack.rot": _rot, "stack.drop_if": _drop_if,
    "type.fixed_array": _fixed_array, "type.structure": _structure, "type.sizeof": lambda m, _: m.push(m.pop(Kind).size),
    "segment.create_unspecified": lambda m, _: m.segment(None, None, m.pop()), "segment.create_tagged": _tagged,
}


class LayoutProgram(Codec):
    """One binary a chunk to streams: a segment's leaves each give one, numbered in order.

    Rows: chunk_id, segment, tag, stream (number in the chunk), kind, pos, v (long, of numbers) or data (of bytes).
    """

    name = "layout_vm"
    SCHEMA = "chunk_id long, segment int, tag long, stream int, kind string, per_record int, data binary"

    def __init__(self, text: str):
        self.program = assemble(text)

    def encode(self, s: DataFrame) -> Encoded:
        program, names = self.program, [c.split()[0] for c in self.SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary()]

        def run(batches):
            for b in batches:
                rows = []
                for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    number = 0
                    for k, p in enumerate(Machine(program, data).run()):
                        raw = data[p.start : p.end]
                        leaves = p.kind.leaves if p.kind else (("bytes", 1),)
                        size = p.kind.size if p.kind else 1
                        table, at = np.frombuffer(raw, np.uint8).reshape(-1, size), 0
                        for name, n in leaves:
                            w = TYPES[name][1] * n
                            rows.append((chunk, k, p.tag, number, name, n, np.ascontiguousarray(table[:, at : at + w]).tobytes()))
                            at, number = at + w, number + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        x = s.select("chunk_id", F.col("v").cast("binary").alias("v")).mapInArrow(run, self.SCHEMA)
        return Encoded({"streams": x}, s.select("chunk_id"))

    @staticmethod
    def numbers(enc: Encoded, number: int) -> DataFrame:
        """A numeric stream's values: chunk_id, pos, v (floats as their bits)."""
        from ..core import in_arrays

        def run(batches):
            rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield from in_arrays((chunk, np.frombuffer(data, (TYPES[kind][0] or "u1").replace("f", "u")).astype(np.int64)) for chunk, kind, data in rows)

        return enc["streams"].where(F.col("stream") == number).select("chunk_id", "kind", "data").mapInArrow(run, "chunk_id long, pos long, v long")

    def decode(self, enc: Encoded) -> DataFrame:
        from ..core import per_chunk

        rows = enc.header.join(enc["streams"], "chunk_id", "left").select("chunk_id", F.coalesce("stream", F.lit(0)).cast("long").alias("pos"), "segment", "kind", "per_record", "data")

        def put_together(t: pa.Table) -> pa.Table:
            parts: dict[int, list[np.ndarray]] = {}
            for segment, kind, n, data in zip(*(t[c].to_pylist() for c in ("segment", "kind", "per_record", "data")), strict=True):
                if data is not None:
                    parts.setdefault(segment, []).append(np.frombuffer(data, np.uint8).reshape(-1, TYPES[kind][1] * n))
            out = b"".join(np.concatenate(parts[k], axis=1).tobytes() for k in sorted(parts))
            return pa.table({"chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([out], pa.binary())})

        return per_chunk(rows, put_together, "chunk_id long, pos long, v binary")

"""A language for binary layouts: what a file's bytes are, field by field.

    Record Star() = { ra: Float64LE, kind: Bytes(2), mag: Int16LE where (mag < 9999) }
    enum Kind { SMALL = 1, LARGE = 2 }
    Union Body(kind) = { case 1: UInt8, case 2..4: UInt32LE[2], default: Bytes(4) }
    header: Bytes(28)
    n: UInt32LE
    when n > 0 { stars: Star[n] }
    rest: soa Star[]

A layout is read from front to back.  Every byte goes to the stream of its field (by dotted path), so the streams
and the list of segments give the file back.  Arrays of records whose sizes don't depend on what was read are taken
whole, as views of numpy; only the rest is walked field by field.  All arithmetic is on signed 64-bit integers, and
overflow, division by zero and failed expectations are errors.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Codec, CodecError, Encoded, per_chunk

PRIMITIVE = {"Int8": "i1", "UInt8": "u1", "Byte": "bytes1"}
for _bits in (16, 32, 64):
    for _end, _mark in (("LE", "<"), ("BE", ">")):
        PRIMITIVE |= {f"Int{_bits}{_end}": f"{_mark}i{_bits // 8}", f"UInt{_bits}{_end}": f"{_mark}u{_bits // 8}", f"Float{_bits}{_end}": f"{_mark}f{_bits // 8}"}
PRIMITIVE |= {"BFloat16LE": "<bf2", "BFloat16BE": ">bf2"}

_TOKEN = re.compile(r"""\s*(?:\#[^\n]*\s*)*(?:(?P<number>0[xX][0-9a-fA-F]+|0[bB][01]+|\d+)|(?P<name>@?[A-Za-z_]\w*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<sign>\.\.|<<|>>|<=|>=|==|!=|[-+*/%&|^~<>=(){}\[\],:.]))""")
_LEVELS = [["or"], ["and"], ["|"], ["^"], ["&"], ["==", "!=", "in"], ["<", "<=", ">", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]


class LayoutError(CodecError):
    """Text that is no layout, or bytes that don't fit it."""


def _int64(x: int) -> int:
    if not -(1 << 63) <= x < 1 << 63:
        raise LayoutError("overflow")
    return x


def _divided(a: int, b: int) -> int:
    if b == 0:
        raise LayoutError("division by zero")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


_OPS = {
    "+": lambda a, b: _int64(a + b), "-": lambda a, b: _int64(a - b), "*": lambda a, b: _int64(a * b), "/": lambda a, b: _int64(_divided(a, b)), "%": lambda a, b: a - b * _divided(a, b),
    "&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b, "<<": lambda a, b: _int64(a << b), ">>": lambda a, b: a >> b,
    "==": lambda a, b: int(a == b), "!=": lambda a, b: int(a != b), "<": lambda a, b: int(a < b), "<=": lambda a, b: int(a <= b), ">": lambda a, b: int(a > b), ">=": lambda a, b: int(a >= b),
    "in": lambda a, b: int(a in b.values()),
}
_CALLS = {
    "abs": lambda x: _int64(abs(x)), "min": min, "max": max, "clamp": lambda lo, x, hi: max(lo, min(x, hi)), "sgn": lambda x: (x > 0) - (x < 0), "between": lambda lo, x, hi: int(lo <= x <= hi),
    "ceil_div": lambda x, d: -_divided(-x, d) if x % d == 0 or x < 0 else _divided(x, d) + 1, "align_up": lambda x, a: x + -x % a,
}


@dataclass
class Type:
    name: str
    args: list
    dims: list = field(default_factory=list)  # None for []
    soa: bool = False
    align: object = None
    until: bytes | None = None
    where: object = None


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text) and text[at:].strip() and not re.fullmatch(r"\s*(#[^\n]*\s*)*", text[at:]):
            m = _TOKEN.match(text, at)
            if not m:
                raise LayoutError(f"unexpected text: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.k = 0

    def peek(self, n: int = 0) -> str:
        return self.tokens[self.k + n][1] if self.k + n < len(self.tokens) else ""

    def next(self) -> tuple[str, str]:
        if self.k >= len(self.tokens):
            raise LayoutError("the layout ends too soon")
        self.k += 1
        return self.tokens[self.k - 1]

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.k += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise LayoutError(f"{sign!r} expected before {self.peek()!r}")

    def name(self) -> str:
        kind, x = self.next()
        if kind != "name":
            raise LayoutError(f"a name expected instead of {x!r}")
        return x

    def many(self, end: str, f) -> list:
        out = []
        while not self.take(end):
            out.append(f())
            self.take(",")
        return out

    def file(self) -> list:
        out = []
        while self.k < len(self.tokens):
            out.append(self.statement())
            self.take(",")
        return [x for x in out if x]

    def statement(self):
        word = self.peek()
        if word[:1] == "@":
            self.next()
            if self.k < len(self.tokens) and self.tokens[self.k][0] in ("string", "number"):
                self.next()
            return None
        if word == "Record":
            self.next()
            name, params = self.name(), self.params()
            self.need("=")
            self.need("{")
            body = [x for x in self.many("}", self.statement) if x]
            pads = {}
            while self.peek() in ("pad_to", "pad_align"):
                key = self.next()[1]
                pads[key] = self.expression()
            return "record", name, params, body, pads
        if word == "Union":
            self.next()
            name, params = self.name(), self.params()
            self.need("=")
            self.need("{")
            return "union", name, params, self.cases(self.type)
        if word == "enum":
            self.next()
            name = self.name()
            self.need("{")
            return "enum", name, self.many("}", lambda: (self.name(), self.need("="), self.expression())[::2])
        if word == "var":
            self.next()
            name = self.name()
            self.need("=")
            return "var", name, self.expression()
        if word == "expect":
            self.next()
            return "expect", self.expression()
        if word == "when":
            self.next()
            condition = self.expression()
            self.need("{")
            return "when", condition, [x for x in self.many("}", self.statement) if x]
        name = self.name()
        self.need(":")
        return "field", name, self.type()

    def params(self) -> list[str]:
        return self.many(")", self.name) if self.take("(") else []

    def cases(self, result) -> list:
        """[(None or list of (low, high)), result] until the closing brace."""

        def one():
            if self.take("default"):
                self.need(":")
                return None, result()
            self.need("case")
            ranges = [self.range()]
            while self.take(","):
                ranges.append(self.range())
            self.need(":")
            return ranges, result()

        return self.many("}", one)

    def range(self):
        low = self.expression()
        return low, self.expression() if self.take("..") else low

    def type(self) -> Type:
        soa, align = False, None
        while self.peek() in ("soa", "align"):
            if self.next()[1] == "soa":
                soa = True
            else:
                self.need("(")
                align = self.expression()
                self.need(")")
        t = Type(self.name(), [], soa=soa, align=align)
        if t.name == "Bytes" and self.take("until"):
            kind, x = self.next()
            t.until = x[1:-1].encode().decode("unicode_escape").encode("latin-1") if kind == "string" else bytes([int(x, 0)])
        elif self.take("("):
            t.args = self.many(")", self.expression)
        while self.take("["):
            t.dims.append(None if self.take("]") else self.expression())
            if t.dims[-1] is not None:
                self.need("]")
        if self.take("where"):
            self.need("(")
            t.where = self.expression()
            self.need(")")
        return t

    def expression(self, level: int = 0):
        if level == len(_LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek() in _LEVELS[level]:
            op = self.next()[1]
            left = ("op", op, left, self.expression(level + 1))
        return left

    def unary(self):
        for sign in ("-", "+", "~", "not"):
            if self.take(sign):
                return "unary", sign, self.unary()
        return self.postfix(self.primary())

    def primary(self):
        kind, x = self.next()
        if kind == "number":
            return "number", int(x, 0)
        if x == "(":
            e = self.expression()
            self.need(")")
            return e
        if x == "switch":
            e = self.expression()
            self.need("{")
            return "switch", e, self.cases(self.expression)
        if kind != "name":
            raise LayoutError(f"an expression expected instead of {x!r}")
        return ("call", x, self.many(")", self.expression)) if self.take("(") else ("name", x)

    def postfix(self, e):
        while True:
            if self.peek() == "." and self.take("."):
                e = ("member", e, self.name())
            elif self.peek() == "[" and self.take("["):
                e = ("index", e, self.expression())
                self.need("]")
            else:
                return e


@dataclass
class Segment:
    """Bytes of `count` records of the given fields [(path, kind, size)], as one buffer."""

    fields: list[tuple[str, str, int]]
    count: int
    data: bytes


PAD = "<pad>"


class Layout:
    def __init__(self, text: str):
        self.types: dict[str, tuple] = {}
        self.enums: dict[str, dict[str, int]] = {}
        self.body = []
        for s in _Parser(text).file():
            if s[0] in ("record", "union"):
                self.types[s[1]] = s
            elif s[0] == "enum":
                self.enums[s[1]] = {n: self._value(e, {}, None) for n, e in s[2]}
            else:
                self.body.append(s)

    def read(self, data: bytes) -> list[Segment]:
        """The segments of a file, in order; all its bytes are in one of them."""
        r = _Reader(self, data)
        r.statements(self.body, {}, "")
        if r.at != len(data):
            raise LayoutError(f"{len(data) - r.at} bytes are left over")
        return r.segments

    def _value(self, e, scope: dict, reader: _Reader | None):
        kind = e[0]
        if kind == "number":
            return e[1]
        if kind == "name":
            for names in (scope, self.enums):
                if e[1] in names:
                    return names[e[1]]
            raise LayoutError(f"nothing is called {e[1]}")
        if kind == "op":
            _, op, a, b = e
            left = self._value(a, scope, reader)
            if op in ("and", "or"):
                return int(bool(left)) if bool(left) == (op == "or") else int(bool(self._value(b, scope, reader)))
            return _OPS[op](left, self._value(b, scope, reader))
        if kind == "unary":
            x = self._value(e[2], scope, reader)
            return {"-": lambda: _int64(-x), "+": lambda: x, "~": lambda: ~x, "not": lambda: int(not x)}[e[1]]()
        if kind == "switch":
            return self._value(self._case(self._value(e[1], scope, reader), e[2], scope, reader), scope, reader)
        if kind == "member":
            return self._value(e[1], scope, reader)[e[2]]
        if kind == "index":
            return self._value(e[1], scope, reader)[self._value(e[2], scope, reader)]
        _, name, args = e
        if name == "sizeof":
            inner = args[0]
            fields = self.static(Type(inner[1], inner[2] if inner[0] == "call" else []), scope, "")
            if fields is None:
                raise LayoutError("sizeof needs a type of fixed size")
            return sum(size for _, _, size in fields)
        if name in ("current_position", "scope_remaining", "parsed_length"):
            if reader is None:
                raise LayoutError(f"{name} needs a parser")
            if name == "parsed_length":
                return scope["#length"][args[0][1]]
            return reader.at if name == "current_position" else len(reader.data) - reader.at
        if name not in _CALLS:
            raise LayoutError(f"no function {name}")
        return _CALLS[name](*(self._value(a, scope, reader) for a in args))

    def _case(self, x, cases, scope, reader):
        other = None
        for ranges, result in cases:
            if ranges is None:
                other = result
            elif any(self._value(lo, scope, reader) <= x <= self._value(hi, scope, reader) for lo, hi in ranges):
                return result
        if other is None:
            raise LayoutError(f"no case for {x}")
        return other

    def static(self, t: Type, scope: dict, path: str) -> list[tuple[str, str, int]] | None:
        """The leaves [(path, kind, size)] of one such type, if they depend on parameters alone."""
        if t.until is not None or t.soa or t.align or t.where or None in t.dims:
            return None
        try:
            times = 1
            for d in t.dims:
                times *= self._value(d, scope, None)
            args = [self._value(a, scope, None) for a in t.args]
            if t.name == "Bytes" or PRIMITIVE.get(t.name) == "bytes1":
                return [(path, "bytes", times * (args[0] if args else 1))]
            if t.name in PRIMITIVE:
                size = np.dtype(PRIMITIVE[t.name].replace("bf", "u")).itemsize
                return [(path, PRIMITIVE[t.name], size)] * times
            if t.name not in self.types:
                raise LayoutError(f"no type {t.name}")
            kind, _, params, body, *rest = self.types[t.name]
            inner = dict(zip(params, args, strict=True))
            if kind == "union":
                one = self.static(self._case(args[0], body, inner, None), inner, path)
            else:
                one = self._static_body(body, inner, path)
                if one is not None:
                    size = sum(n for _, _, n in one)
                    pad = self.padding(size, rest[0], inner)
                    one = one + [(_join(path, PAD), "bytes", pad)] * bool(pad)
            return None if one is None else one * times
        except (LayoutError, KeyError, TypeError):
            return None

    def _static_body(self, body, scope, path):
        out = []
        for s in body:
            if s[0] == "field":
                part = self.static(s[2], scope, _join(path, s[1]))
            elif s[0] == "when":
                part = self._static_body(s[2], scope, path) if self._value(s[1], scope, None) else []
            elif s[0] == "var":
                scope[s[1]] = self._value(s[2], scope, None)
                part = []
            else:
                return None
            if part is None:
                return None
            out += part
        return out

    def padding(self, size: int, pads: dict, scope: dict) -> int:
        full = size
        if "pad_to" in pads:
            full = self._value(pads["pad_to"], scope, None)
            if full < size:
                raise LayoutError("a record is longer than pad_to")
        if "pad_align" in pads:
            full += -full % self._value(pads["pad_align"], scope, None)
        return full - size


def _join(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


class _Reader:
    def __init__(self, layout: Layout, data: bytes):
        self.layout, self.data, self.at, self.segments = layout, data, 0, []

    def take(self, fields, count: int) -> bytes:
        size = sum(n for _, _, n in fields) * count
        if count < 0 or self.at + size > len(self.data):
            raise LayoutError(f"{fields[0][0] if fields else 'a field'} goes beyond the end")
        raw = self.data[self.at : self.at + size]
        self.at += size
        if size:
            last = self.segments[-1] if self.segments else None
            if last and last.fields == fields and len(fields) == 1:
                last.count, last.data = last.count + count, last.data + raw
            else:
                self.segments.append(Segment(fields, count, raw))
        return raw

    def statements(self, body, scope: dict, path: str) -> None:
        value = lambda e: self.layout._value(e, scope, self)
        for s in body:
            if s[0] == "field":
                start = self.at
                scope[s[1]] = self.type(s[2], scope, _join(path, s[1]))
                scope.setdefault("#length", {})[s[1]] = self.at - start
                if s[2].where is not None and not value(s[2].where):
                    raise LayoutError(f"{_join(path, s[1])} isn't as expected")
            elif s[0] == "var":
                scope[s[1]] = value(s[2])
            elif s[0] == "expect":
                if not value(s[1]):
                    raise LayoutError(f"an expectation at byte {self.at} fails")
            elif value(s[1]):
                self.statements(s[2], scope, path)

    def type(self, t: Type, scope: dict, path: str):
        layout = self.layout
        if t.align is not None:
            self.take([(PAD, "bytes", -self.at % layout._value(t.align, scope, self))], 1)
        if t.dims:
            return self.array(t, scope, path)
        if t.until is not None:
            end = self.data.find(t.until, self.at)
            if end < 0:
                raise LayoutError(f"{path}: its end isn't there")
            return self.take([(path, "bytes", end + len(t.until) - self.at)], 1)
        args = [layout._value(a, scope, self) for a in t.args]
        if t.name == "Bytes" or PRIMITIVE.get(t.name) == "bytes1":
            return self.take([(path, "bytes", args[0] if args else 1)], 1)
        if t.name in PRIMITIVE:
            kind = PRIMITIVE[t.name]
            raw = self.take([(path, kind, np.dtype(kind.replace("bf", "u")).itemsize)], 1)
            return _number(raw, kind)
        if t.name not in layout.types:
            raise LayoutError(f"no type {t.name}")
        kind, _, params, body, *rest = layout.types[t.name]
        if len(params) != len(args):
            raise LayoutError(f"{t.name} takes {len(params)} parameters")
        inner, start = dict(zip(params, args, strict=True)), self.at
        if kind == "union":
            return self.type(layout._case(args[0], body, inner, self), inner, path)
        self.statements(body, inner, path)
        pad = layout.padding(self.at - start, rest[0], inner)
        if pad:
            self.take([(_join(path, PAD), "bytes", pad)], 1)
        return inner

    def array(self, t: Type, scope: dict, path: str):
        layout = self.layout
        bound = [a if isinstance(a, tuple) and a[0] == "number" else ("number", layout._value(a, scope, self)) for a in t.args]
        one = Type(t.name, bound, t.dims[1:])
        fields = layout.static(one, scope, path)
        size = sum(n for _, _, n in fields) if fields is not None else None
        if t.dims[0] is None:
            if size == 0:
                raise LayoutError("an array of nothing doesn't end")
            count = None if size is None else (len(self.data) - self.at) // size
        else:
            count = layout._value(t.dims[0], scope, self)
            if count < 0:
                raise LayoutError(f"{path} has a negative size")
        if t.soa:
            if fields is None or count is None:
                raise LayoutError("soa needs a record of fixed size")
            groups: dict[str, list] = {}
            for f in fields:
                groups.setdefault(f[0][len(path) + 1 :].split(".")[0], []).append(f)
            for g in groups.values():
                self.take(_merged(g), count)
            return None
        if fields is not None:
            fields = _merged(fields)
            raw = self.take(fields, count)
            if len(fields) == 1 and fields[0][1] != "bytes":
                kind = fields[0][1]
                n = np.dtype(kind.replace("bf", "u")).itemsize
                return [_number(raw[k : k + n], kind) for k in range(0, len(raw), n)] if len(raw) < 1 << 16 else np.frombuffer(raw, kind.replace("bf", "u"))
            return None
        out, k = [], 0
        while (self.at < len(self.data)) if count is None else k < count:
            out.append(self.type(one, dict(scope), path))
            k += 1
        return out


def _merged(fields):
    """Neighbouring leaves of one path as one leaf."""
    out: list[tuple[str, str, int]] = []
    for path, kind, size in fields:
        if out and out[-1][:2] == (path, kind):
            out[-1] = path, kind, out[-1][2] + size
        else:
            out.append((path, kind, size))
    return out


def _number(raw: bytes, kind: str):
    if "bf" in kind:
        bits = int.from_bytes(raw, "little" if kind[0] == "<" else "big")
        return struct.unpack("<f", (bits << 16).to_bytes(4, "little"))[0]
    x = np.frombuffer(raw, kind)[0]
    return x.item()


class BinaryLayout(Codec):
    """One binary a chunk to its segments: chunk_id, seq, part, path, kind, size, count, data.

    ``column`` is a field's stream: numbers, or binaries for Bytes.
    """

    name = "layout"
    SCHEMA = "chunk_id long, seq long, part int, path string, kind string, size long, count long, data binary"

    def __init__(self, text: str):
        self.text = text
        Layout(text)

    def encode(self, s: DataFrame) -> Encoded:
        text, names = self.text, [c.split()[0] for c in self.SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())

        def run(batches):
            layout = Layout(text)
            for b in batches:
                for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    rows = []
                    for seq, g in enumerate(layout.read(data)):
                        table, at = np.frombuffer(g.data, np.uint8).reshape(g.count, -1), 0
                        for part, (path, kind, size) in enumerate(g.fields):
                            rows.append((chunk, seq, part, path, kind, size, g.count, np.ascontiguousarray(table[:, at : at + size]).tobytes()))
                            at += size
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        x = s.select("chunk_id", F.col("v").cast("binary").alias("v")).mapInArrow(run, self.SCHEMA)
        return Encoded({"segments": x}, s.select("chunk_id"))

    @staticmethod
    def column(enc: Encoded, path: str) -> DataFrame:
        """A field's values over all segments, in order: chunk_id, pos, v (long, double or binary)."""
        rows = enc["segments"].where(F.col("path") == path).select("chunk_id", F.col("seq").alias("pos"), "kind", "size", "data")
        first = rows.select("kind").first()
        if first is None:
            raise LayoutError(f"no field {path}")
        kind = first.kind
        spark = "binary" if kind == "bytes" else "double" if "f" in kind else "long"

        def values(t: pa.Table) -> pa.Table:
            out: list = []
            for size, data in zip(t["size"].to_pylist(), t["data"].to_pylist(), strict=True):
                if kind == "bytes":
                    out += [data[k : k + size] for k in range(0, len(data), size)] if size else []
                elif "bf" in kind:
                    out += (np.frombuffer(data, kind.replace("bf", "u")).astype("<u4") << 16).view("<f4").astype(float).tolist()
                else:
                    x = np.frombuffer(data, kind)
                    out += (x.astype(float) if "f" in kind else x.astype(np.int64)).tolist()
            type_ = {"binary": pa.binary(), "double": pa.float64(), "long": pa.int64()}[spark]
            return pa.table({"chunk_id": pa.array([t["chunk_id"][0].as_py()] * len(out), pa.int64()), "pos": pa.array(np.arange(len(out))), "v": pa.array(out, type_)})

        return per_chunk(rows, values, f"chunk_id long, pos long, v {spark}")

    def decode(self, enc: Encoded) -> DataFrame:
        rows = enc.header.join(enc["segments"], "chunk_id", "left").select("chunk_id", F.coalesce("seq", F.lit(0)).alias("pos"), "part", "size", "count", "data")

        def put_together(t: pa.Table) -> pa.Table:
            parts: dict[int, list] = {}
            for pos, part, size, count, data in zip(*(t[c].to_pylist() for c in ("pos", "part", "size", "count", "data")), strict=True):
                if data is not None:
                    parts.setdefault(pos, []).append((part, np.frombuffer(data, np.uint8).reshape(count, size)))
            out = b"".join(np.concatenate([x for _, x in sorted(parts[k], key=lambda p: p[0])], axis=1).tobytes() for k in sorted(parts))
            return pa.table({"chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([out], pa.binary())})

        return per_chunk(rows, put_together, "chunk_id long, pos long, v binary")


#: The star catalogue: a header, then records.
STAR_CATALOGUE = """
Record Star() = { ra: Float64LE, dec: Float64LE, kind: Bytes(2), mag: Int16LE, ra_motion: Float32LE, dec_motion: Float32LE }
header: Byte[28]
stars: Star[]
"""

"""Messages in the two common wire formats, to streams by kind and back.

Protocol buffers with a schema: twelve streams (field, type, length, int32, int64, uint32, uint64, float, double,
bool, enum, string).  Thrift needs none: the wire, compact or binary, says its types.  A Thrift message's values at
given paths of field numbers can go to streams of their own.  All are lossless for what writers of the formats write
(shortest varints, bools 0 and 1); anything else is an error, not a silent change.

Feature maps, records of compact Thrift that hold maps from feature numbers to values, are cut into stretches by the
kind of map: floats, lists of ids, lists of such lists, lists of floats, ids with scores, and everything else.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Codec, CodecError, Encoded, in_batches, per_chunk


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, next place); the shortest spelling only."""
    x = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CodecError("a number doesn't end")
        b = data[at]
        at += 1
        x |= (b & 127) << shift
        if b < 128:
            if shift and not b or x >> 64:
                raise CodecError("a number isn't in its shortest form")
            return x, at
        shift += 7


def to_varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def signed(x: int, bits: int = 64) -> int:
    return x - (1 << bits) if x >> (bits - 1) & 1 else x


def zigzag(x: int) -> int:
    return x << 1 if x >= 0 else (-x << 1) - 1


def unzigzag(x: int) -> int:
    return x >> 1 ^ -(x & 1)


Streams = dict[str, list]

#: Protocol buffer types: wire type, stream.
PROTO = {
    "int32": (0, "int32"), "int64": (0, "int64"), "uint32": (0, "uint32"), "uint64": (0, "uint64"), "sint32": (0, "int32"), "sint64": (0, "int64"), "bool": (0, "bool"), "enum": (0, "enum"),
    "fixed32": (5, "uint32"), "sfixed32": (5, "int32"), "float": (5, "float"), "fixed64": (1, "uint64"), "sfixed64": (1, "int64"), "double": (1, "double"), "string": (2, "string"), "bytes": (2, "string"),
}
PROTO_STREAMS = ("field", "type", "length", "int32", "int64", "uint32", "uint64", "float", "double", "bool", "enum", "string")


def proto_read(data: bytes, schema: dict[int, str | dict], out: Streams) -> None:
    """Appends a message's parts to streams.  schema: field number -> type name, or a schema of its own for messages."""
    at, n = 0, 0
    mark = len(out["length"])
    out["length"].append(0)
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        kind = schema.get(number)
        if kind is None:
            raise CodecError(f"no field {number}")
        name = "message" if isinstance(kind, dict) else kind
        if wire != (2 if name == "message" else PROTO[name][0]):
            raise CodecError(f"field {number} has another wire type")
        out["field"].append(number)
        out["type"].append(wire)
        n += 1
        if wire == 0:
            x, at = varint(data, at)
            if name in ("sint32", "sint64"):
                x = unzigzag(x)
            elif name in ("int32", "int64", "enum"):
                x = signed(x)
            if name == "bool" and x > 1:
                raise CodecError("a bool is 0 or 1")
            out[PROTO[name][1]].append(x)
        elif wire == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise CodecError("a field goes beyond its message")
            part, at = data[at : at + size], at + size
            if name == "message":
                proto_read(part, kind, out)
            else:
                out["string"].append(part)
        else:
            size = 4 if wire == 5 else 8
            if at + size > len(data):
                raise CodecError("a field goes beyond its message")
            code = {"float": "<I", "double": "<Q", "fixed32": "<I", "sfixed32": "<i", "fixed64": "<Q", "sfixed64": "<q"}[name]
            out[PROTO[name][1]].append(struct.unpack_from(code, data, at)[0])
            at += size
    out["length"][mark] = n


def proto_write(schema: dict[int, str | dict], take: Callable[[str], object]) -> bytes:
    """The message whose parts `take` gives by stream, in order."""
    out = []
    for _ in range(take("length")):
        number, wire = take("field"), take("type")
        kind = schema[number]
        out.append(to_varint(number << 3 | wire))
        if isinstance(kind, dict):
            part = proto_write(kind, take)
            out.append(to_varint(len(part)) + part)
            continue
        x = take(PROTO[kind][1])
        if wire == 0:
            out.append(to_varint((zigzag(x) if kind in ("sint32", "sint64") else x) & (1 << 64) - 1))
        elif wire == 2:
            out.append(to_varint(len(x)) + x)
        else:
            out.append(struct.pack({"float": "<I", "double": "<Q", "fixed32": "<I", "sfixed32": "<i", "fixed64": "<Q", "sfixed64": "<q"}[kind], x))
    return b"".join(out)


class Parts(dict):
    """Streams by name, and the path of field numbers of the value that is read or written.

    `paths` maps a name to a path: values there go to the stream of that name.  Elements of lists and sets have the
    path's ELEMENT, keys and values of maps KEY and VALUE.
    """

    def __init__(self, names, paths: dict[str, tuple[int, ...]] | None = None):
        super().__init__({n: [] for n in (*names, *(paths or {}))})
        self.own = {tuple(p): n for n, p in (paths or {}).items()}
        self.path: list[int] = []

    def at(self, kind: str) -> str:
        """The stream of a value of a kind at the current path."""
        return self.own.get(tuple(self.path), kind) if self.own else kind

    def put(self, kind: str, x) -> None:
        self[self.at(kind)].append(x)


class Taken(Parts):
    """The same streams to be taken from, in order."""

    def __init__(self, names, paths, streams: dict[str, list]):
        super().__init__(names, paths)
        self.left = {n: iter(streams.get(n, ())) for n in self}

    def take(self, kind: str, own: bool = False):
        return next(self.left[self.at(kind) if own else kind])


ELEMENT, KEY, VALUE = -1, -2, -3

THRIFT_STREAMS = ("type", "delta", "id", "length", "bool", "byte", "i16", "i32", "i64", "double", "binary")
#: Compact type codes.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
_INTEGER = {I16: "i16", I32: "i32", I64: "i64"}


def thrift_read(data: bytes, out: Parts) -> None:
    """Appends a compact-protocol struct's parts to streams; the bytes must end with it."""
    if _thrift_struct(data, 0, out) != len(data):
        raise CodecError("bytes are left over")


def _thrift_struct(data: bytes, at: int, out: Parts) -> int:
    field = 0
    while True:
        if at >= len(data):
            raise CodecError("a struct doesn't end")
        head = data[at]
        at += 1
        kind, delta = head & 15, head >> 4
        out["type"].append(kind)
        if kind == 0:
            if delta:
                raise CodecError("a stop has no field")
            return at
        out["delta"].append(delta)
        if not delta:
            x, at = varint(data, at)
            field = unzigzag(x)
            out["id"].append(field)
        else:
            field += delta
        out.path.append(field)
        at = _thrift_value(data, at, kind, out, True)
        out.path.pop()


def _inside(step: int, data: bytes, at: int, kind: int, out: Parts, value) -> int:
    """A value within a list or map, one step further down the path."""
    out.path.append(step)
    at = value(data, at, kind, out, False)
    out.path.pop()
    return at


def _thrift_value(data: bytes, at: int, kind: int, out: Parts, is_field: bool) -> int:
    if kind in (TRUE, FALSE):
        if not is_field:
            if at >= len(data) or data[at] not in (TRUE, FALSE):
                raise CodecError("a bool is 1 or 2")
            out.put("bool", data[at])
            return at + 1
        return at
    if kind == BYTE:
        if at >= len(data):
            raise CodecError("a byte is missing")
        out.put("byte", data[at])
        return at + 1
    if kind in _INTEGER:
        x, at = varint(data, at)
        out.put(_INTEGER[kind], unzigzag(x))
        return at
    if kind == DOUBLE:
        if at + 8 > len(data):
            raise CodecError("a double is missing")
        out.put("double", struct.unpack_from("<Q", data, at)[0])
        return at + 8
    if kind == BINARY:
        n, at = varint(data, at)
        if at + n > len(data):
            raise CodecError("a binary goes beyond the end")
        out.put("binary", data[at : at + n])
        return at + n
    if kind in (LIST, SET):
        if at >= len(data):
            raise CodecError("a list is missing")
        inner, n = data[at] & 15, data[at] >> 4
        at += 1
        if n == 15:
            n, at = varint(data, at)
            if n < 15:
                raise CodecError("a size isn't in its shortest form")
        out["type"].append(inner)
        out["length"].append(n)
        for _ in range(n):
            at = _inside(ELEMENT, data, at, inner, out, _thrift_value)
        return at
    if kind == MAP:
        n, at = varint(data, at)
        out["length"].append(n)
        if not n:
            return at
        if at >= len(data):
            raise CodecError("a map is missing")
        k, v = data[at] >> 4, data[at] & 15
        out["type"] += [k, v]
        at += 1
        for _ in range(n):
            at = _inside(KEY, data, at, k, out, _thrift_value)
            at = _inside(VALUE, data, at, v, out, _thrift_value)
        return at
    if kind == STRUCT:
        return _thrift_struct(data, at, out)
    raise CodecError(f"no type {kind}")


def thrift_write(its: Taken) -> bytes:
    out, field = [], 0
    while kind := its.take("type"):
        delta = its.take("delta")
        out.append(bytes([delta << 4 | kind]))
        if delta:
            field += delta
        else:
            field = its.take("id")
            out.append(to_varint(zigzag(field)))
        its.path.append(field)
        out.append(_thrift_bytes(kind, its, True))
        its.path.pop()
    return b"".join(out) + b"\0"


def _written(step: int, kind: int, its: Taken, value) -> bytes:
    its.path.append(step)
    out = value(kind, its, False)
    its.path.pop()
    return out


def _thrift_bytes(kind: int, its: Taken, is_field: bool) -> bytes:
    if kind in (TRUE, FALSE):
        return b"" if is_field else bytes([its.take("bool", True)])
    if kind == BYTE:
        return bytes([its.take("byte", True)])
    if kind in _INTEGER:
        return to_varint(zigzag(its.take(_INTEGER[kind], True)))
    if kind == DOUBLE:
        return struct.pack("<Q", its.take("double", True) & (1 << 64) - 1)
    if kind == BINARY:
        x = its.take("binary", True)
        return to_varint(len(x)) + x
    if kind in (LIST, SET):
        inner, n = its.take("type"), its.take("length")
        head = bytes([n << 4 | inner]) if n < 15 else bytes([0xF0 | inner]) + to_varint(n)
        return head + b"".join(_written(ELEMENT, inner, its, _thrift_bytes) for _ in range(n))
    if kind == MAP:
        n = its.take("length")
        if not n:
            return b"\0"
        k, v = its.take("type"), its.take("type")
        return to_varint(n) + bytes([k << 4 | v]) + b"".join(_written(step, t, its, _thrift_bytes) for _ in range(n) for step, t in ((KEY, k), (VALUE, v)))
    return thrift_write(its)


#: Type codes of the binary protocol, numbers by (struct format, stream).
_FIXED = {2: (">B", "bool"), 3: (">B", "byte"), 4: (">Q", "double"), 6: (">h", "i16"), 8: (">i", "i32"), 10: (">q", "i64")}
_TEXT, _STRUCT, _MAP, _SET, _LIST = 11, 12, 13, 14, 15
BINARY_STREAMS = ("type", "id", "length", "bool", "byte", "i16", "i32", "i64", "double", "binary")


def _unpacked(form: str, data: bytes, at: int) -> tuple[int, int]:
    end = at + struct.calcsize(form)
    if end > len(data):
        raise CodecError("a number goes beyond the end")
    return struct.unpack_from(form, data, at)[0], end


def binary_read(data: bytes, out: Parts) -> None:
    """Appends a binary-protocol struct's parts to streams; the bytes must end with it."""
    if _binary_value(data, 0, _STRUCT, out, True) != len(data):
        raise CodecError("bytes are left over")


def _sized(data: bytes, at: int, out: Parts) -> tuple[int, int]:
    n, at = _unpacked(">i", data, at)
    if n < 0:
        raise CodecError("a size is negative")
    out["length"].append(n)
    return n, at


def _binary_value(data: bytes, at: int, kind: int, out: Parts, is_field: bool) -> int:
    if kind in _FIXED:
        form, name = _FIXED[kind]
        x, at = _unpacked(form, data, at)
        out.put(name, x)
        return at
    if kind == _TEXT:
        n, at = _unpacked(">i", data, at)
        if n < 0 or at + n > len(data):
            raise CodecError("a binary goes beyond the end")
        out.put("binary", data[at : at + n])
        return at + n
    if kind in (_LIST, _SET):
        inner, at = _unpacked(">B", data, at)
        out["type"].append(inner)
        n, at = _sized(data, at, out)
        for _ in range(n):
            at = _inside(ELEMENT, data, at, inner, out, _binary_value)
        return at
    if kind == _MAP:
        k, at = _unpacked(">B", data, at)
        v, at = _unpacked(">B", data, at)
        out["type"] += [k, v]
        n, at = _sized(data, at, out)
        for _ in range(n):
            at = _inside(KEY, data, at, k, out, _binary_value)
            at = _inside(VALUE, data, at, v, out, _binary_value)
        return at
    if kind != _STRUCT:
        raise CodecError(f"no type {kind}")
    while True:
        inner, at = _unpacked(">B", data, at)
        out["type"].append(inner)
        if not inner:
            return at
        field, at = _unpacked(">h", data, at)
        out["id"].append(field)
        at = _inside(field, data, at, inner, out, _binary_value)


def binary_write(its: Taken) -> bytes:
    return _binary_bytes(_STRUCT, its, True)


def _binary_bytes(kind: int, its: Taken, is_field: bool) -> bytes:
    if kind in _FIXED:
        form, name = _FIXED[kind]
        x = its.take(name, True)
        return struct.pack(form, x & (1 << 64) - 1 if form == ">Q" else x)
    if kind == _TEXT:
        x = its.take("binary", True)
        return struct.pack(">i", len(x)) + x
    if kind in (_LIST, _SET):
        inner, n = its.take("type"), its.take("length")
        return struct.pack(">Bi", inner, n) + b"".join(_written(ELEMENT, inner, its, _binary_bytes) for _ in range(n))
    if kind == _MAP:
        k, v, n = its.take("type"), its.take("type"), its.take("length")
        return struct.pack(">BBi", k, v, n) + b"".join(_written(step, t, its, _binary_bytes) for _ in range(n) for step, t in ((KEY, k), (VALUE, v)))
    out = []
    while inner := its.take("type"):
        field = its.take("id")
        out.append(struct.pack(">Bh", inner, field) + _written(field, inner, its, _binary_bytes))
    return b"".join(out) + b"\0"


class Messages(Codec):
    """One message a row (pos) to streams: chunk_id, stream, pos, number (unsigned values and bits as signed), data."""

    def __init__(self, schema: dict | None = None, protocol: str = "compact", paths: dict[str, tuple[int, ...]] | None = None):
        if protocol not in ("compact", "binary"):
            raise CodecError(f"no protocol {protocol}")
        self.schema, self.name, self.protocol, self.paths = schema, "protobuf" if schema else f"thrift_{protocol}", protocol, paths
        self.names = PROTO_STREAMS if schema else THRIFT_STREAMS if protocol == "compact" else BINARY_STREAMS
        if paths and set(paths) & set(self.names):
            raise CodecError("a path's stream has the name of another")

    def encode(self, s: DataFrame) -> Encoded:
        schema, names, paths, read = self.schema, self.names, self.paths, thrift_read if self.protocol == "compact" else binary_read

        def split(t: pa.Table) -> pa.Table:
            out = Parts(names, paths)
            for data in t["v"].to_pylist():
                if schema:
                    proto_read(data, schema, out)
                else:
                    read(data, out)
            rows = [(n, k, None if isinstance(x, bytes) else signed(x & (1 << 64) - 1), x if isinstance(x, bytes) else None) for n, xs in out.items() for k, x in enumerate(xs)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.table({"chunk_id": pa.array([t["chunk_id"][0].as_py()] * len(rows), pa.int64()), "stream": pa.array(columns[0], pa.string()), "pos": pa.array(columns[1], pa.int64()), "number": pa.array(columns[2], pa.int64()), "data": pa.array(columns[3], pa.binary())})

        x = per_chunk(s.withColumn("v", F.col("v").cast("binary")), split, "chunk_id long, stream string, pos long, number long, data binary")
        return Encoded({"streams": x}, s.groupBy("chunk_id").agg(F.count("*").alias("n")))

    @staticmethod
    def stream(enc: Encoded, name: str, kind: str | None = None) -> DataFrame:
        """A stream by name; of a path's stream, `kind` says whether it has numbers or binary."""
        value = "data" if (kind or name) in ("string", "binary") else "number"
        return enc["streams"].where(F.col("stream") == name).select("chunk_id", "pos", F.col(value).alias("v"))

    def decode(self, enc: Encoded) -> DataFrame:
        schema, wide = self.schema, {"uint64", "double", "uint32", "float"}
        names, paths, write = self.names, self.paths, thrift_write if self.protocol == "compact" else binary_write
        rows = enc.header.join(enc["streams"], "chunk_id", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))

        def put_together(t: pa.Table) -> pa.Table:
            xs: dict[str, list] = {}
            for name, number, data in zip(*(t[c].to_pylist() for c in ("stream", "number", "data")), strict=True):
                xs.setdefault(name, []).append(data if data is not None else number & (1 << 64) - 1 if name in wide else number)
            its = Taken(names, paths, xs)
            chunk, n = t["chunk_id"][0].as_py(), t["n"][0].as_py()
            out = [(chunk, k, proto_write(schema, its.take) if schema else write(its)) for k in range(n)]
            return pa.Table.from_batches(in_batches(out, ["chunk_id", "pos", "v"], [pa.int64(), pa.int64(), pa.binary()]))

        return per_chunk(rows, put_together, "chunk_id long, pos long, v binary")


#: Kinds of feature maps by the types of their keys and values, and the rest.
FEATURE_MAPS = {"map<i32,float>": "float", "map<i32,list<i64>>": "id_list", "map<i32,list<list<i64>>>": "id_list_list", "map<i32,list<float>>": "float_list", "map<i32,map<i64,float>>": "id_score_list"}
OTHER = "other"
FLOAT = 13  # of the compact protocol with floats of 32 bits
_NAMES = {TRUE: "bool", FALSE: "bool", BYTE: "byte", I16: "i16", I32: "i32", I64: "i64", DOUBLE: "double", FLOAT: "float", BINARY: "binary", LIST: "list", SET: "set", MAP: "map", STRUCT: "struct"}
DEEPEST = 32


def _same_type(types: list[str]) -> str | None:
    """The type that all have, where an empty container's is open."""
    longest = max(types, key=len)
    return longest if all(longest.startswith(t.rstrip(">")) for t in types) else None


def _passed(data: bytes, at: int, kind: int, is_field: bool, deep: int, maps: list[tuple[str, int, int]] | None) -> tuple[int, str]:
    """(end, type) of a compact value; maps outside of maps are noted with their type and place."""
    if deep > DEEPEST:
        raise CodecError("values are nested too deep")
    name, end = _NAMES.get(kind), at
    if name is None:
        raise CodecError(f"no type {kind}")
    if name == "struct":
        while True:
            if at >= len(data):
                raise CodecError("a struct doesn't end")
            inner, delta = data[at] & 15, data[at] >> 4
            at += 1
            if not inner:
                return at, name
            if not delta:
                _, at = varint(data, at)
            at, _ = _passed(data, at, inner, True, deep + 1, maps)
    if name in ("bool", "byte"):
        end = at + (name == "byte" or not is_field)
    elif kind in _INTEGER:
        _, end = varint(data, at)
    elif name in ("double", "float"):
        end = at + (8 if name == "double" else 4)
    elif name == "binary":
        n, at = varint(data, at)
        end = at + n
    elif name in ("list", "set"):
        if at >= len(data):
            raise CodecError("a list is missing")
        inner, n = data[at] & 15, data[at] >> 4
        end = at + 1
        if n == 15:
            n, end = varint(data, end)
        types = [_NAMES.get(inner, "?")]
        for _ in range(n):
            end, t = _passed(data, end, inner, False, deep + 1, maps)
            types.append(t)
        name = f"{name}<{_same_type(types) or '?'}>"
    else:
        n, end = varint(data, at)
        if n:
            if end >= len(data):
                raise CodecError("a map is missing")
            k, v = data[end] >> 4, data[end] & 15
            end += 1
            types = [_NAMES.get(v, "?")]
            for _ in range(n):
                end, _t = _passed(data, end, k, False, deep + 1, None)
                end, t = _passed(data, end, v, False, deep + 1, None)
                types.append(t)
            name = f"map<{_NAMES.get(k, '?')},{_same_type(types) or '?'}>"
        if maps is not None:
            maps.append((name, at, end))
    if end > len(data):
        raise CodecError("a value goes beyond the end")
    return end, name


def feature_stretches(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all of some records, each two bytes 80 00 and a struct, with at most a line feed or a zero between."""
    maps: list[tuple[str, int, int]] = []
    at = 0
    while at < len(data):
        if data[at] in (0, 10):
            at += 1
            if at == len(data):
                break
        if data[at : at + 2] != b"\x80\0":
            raise CodecError("a record doesn't begin with 80 00")
        at, _ = _passed(data, at + 2, STRUCT, True, 0, maps)
    out, done = [], 0
    for kind, start, end in maps:
        tag = FEATURE_MAPS.get(kind, OTHER)
        if tag != OTHER:
            out += [(OTHER, done, start)] * (start > done) + [(tag, start, end)]
            done = end
    return out + [(OTHER, done, len(data))] * (len(data) > done)


class FeatureMaps(Codec):
    """Binaries of records with feature maps to stretches by kind: chunk_id, pos, part, kind, v."""

    name = "feature_maps"

    def encode(self, s: DataFrame) -> Encoded:
        def run(batches):
            for b in batches:
                rows = ((c, p, k, kind, v[i:j]) for c, p, v in zip(*(x.to_pylist() for x in b.columns), strict=True) for k, (kind, i, j) in enumerate(feature_stretches(v)))
                yield from in_batches(rows, ["chunk_id", "pos", "part", "kind", "v"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

        parts = s.select("chunk_id", "pos", F.col("v").cast("binary").alias("v")).mapInArrow(run, "chunk_id long, pos long, part long, kind string, v binary")
        return Encoded({"parts": parts}, s.select("chunk_id", "pos"))

    @staticmethod
    def stream(enc: Encoded, kind: str) -> DataFrame:
        """The stretches of one kind in their order."""
        at = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos", "part")) - 1
        return enc["parts"].where(F.col("kind") == kind).select("chunk_id", at.cast("long").alias("pos"), "v")

    def decode(self, enc: Encoded) -> DataFrame:
        whole = enc["parts"].groupBy("chunk_id", "pos").agg(F.sort_array(F.collect_list(F.struct("part", "v"))).alias("x"))
        whole = whole.withColumn("v", F.aggregate("x", F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["v"]))).drop("x")
        return enc.header.join(whole, ["chunk_id", "pos"], "left").withColumn("v", F.coalesce("v", F.lit(b"").cast("binary")))

"""Lossless JSON: text to a structure with one letter for each value, and the values apart.

In the structure a string value is S, a key K, a string in unusual spelling R, a number N, and T, F and Z are the
three literals; those letters and the backslash, where they stand for themselves, have a backslash before them.
Strings whose spelling is the canonical one (short escapes, small hex digits, nothing escaped that needn't be) are
kept unescaped; others as written; what isn't a valid string stays in the structure, so any bytes come back.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Codec, Encoded, in_batches

RESERVED = b"SKRNTFZ\\"
LITERALS = {b"true": b"T", b"false": b"F", b"null": b"Z"}

_TOKEN = re.compile(
    rb'"(?P<string>(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"(?P<key>(?=[ \t\n\r]*:))?'
    rb"|(?P<number>-?(?:0|[1-9][0-9]*|[0-9]+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    rb"|(?P<literal>true|false|null)|(?P<reserved>[SKRNTFZ\\])"
)
_NUMBER_AT_ZERO = re.compile(rb"-?0(?=[0-9])")


def unescaped(raw: bytes) -> bytes | None:
    """The bytes that a string in canonical spelling stands for; None if it is spelled in another way."""
    if b"\\" not in raw:
        return raw
    out = _ESCAPE.sub(lambda m: _SHORT.get(m[0]) or _control(m[0]), raw)
    return out if escaped(out) == raw else None


def _control(escape: bytes) -> bytes:
    """A control character of its escape; any other escape as it is, so that it doesn't pass for canonical."""
    return bytes([int(escape[4:], 16)]) if escape.startswith(b"\\u00") else escape


_ESCAPE = re.compile(rb"\\(?:u[0-9a-fA-F]{4}|.)")
_SHORT = {b'\\"': b'"', b"\\\\": b"\\", b"\\n": b"\n", b"\\r": b"\r", b"\\t": b"\t", b"\\b": b"\b", b"\\f": b"\f"}
_LONG = {v[0]: k for k, v in _SHORT.items()}
_CONTROL = re.compile(rb'["\\\x00-\x1f]')


def escaped(text: bytes) -> bytes:
    return _CONTROL.sub(lambda m: _LONG.get(m[0][0]) or b"\\u%04x" % m[0][0], text)


def lex(data: bytes) -> tuple[bytes, list[bytes], list[bytes], list[bytes], list[bytes]]:
    """(structure, values, keys, numbers, raw strings)."""
    structure, values, keys, numbers, raw = [], [], [], [], []
    at = 0
    while m := _TOKEN.search(data, at):
        structure.append(data[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if kind == "literal":
            structure.append(LITERALS[m[0]])
        elif kind == "reserved":
            structure.append(b"\\" + m[0])
        elif kind == "number":
            text = m[0]
            if zero := _NUMBER_AT_ZERO.match(text):  # a leading zero is a number of its own
                text, at = zero[0], m.start() + len(zero[0])
            numbers.append(text)
            structure.append(b"N")
        else:
            text = unescaped(m["string"])
            if text is None:
                raw.append(m["string"])
                structure.append(b"R")
            elif m["key"] is not None:
                keys.append(text)
                structure.append(b"K")
            else:
                values.append(text)
                structure.append(b"S")
    structure.append(data[at:])
    return b"".join(structure), values, keys, numbers, raw


_NAMES = {v[0]: k for k, v in LITERALS.items()}


def unlex(structure: bytes, values, keys, numbers, raw) -> bytes:
    sources = {ord("S"): (iter(values), True), ord("K"): (iter(keys), True), ord("N"): (iter(numbers), None), ord("R"): (iter(raw), False)}
    out, at = [], 0
    for m in re.finditer(rb"\\(.)|[SKRNTFZ]", structure, re.DOTALL):
        out.append(structure[at : m.start()])
        at = m.end()
        c = m[0][0]
        if m[1] is not None:
            out.append(m[1])
        elif c in _NAMES:
            out.append(_NAMES[c])
        else:
            source, escape = sources[c]
            x = next(source)
            out.append(x if escape is None else b'"' + (escaped(x) if escape else x) + b'"')
    out.append(structure[at:])
    return b"".join(out)


#: Bytes of texts from which a batch of them is given back.
BATCH_BYTES = 16 << 20


class JsonText(Codec):
    """One binary a chunk to its structure and four streams of binaries: values, keys, numbers, raw."""

    name = "json_lex"
    STREAMS = ("values", "keys", "numbers", "raw")

    def encode(self, s: DataFrame) -> Encoded:
        texts = s.select("chunk_id", F.col("v").cast("binary").alias("v"))

        def stream(k: int) -> DataFrame:
            def rows(batches):
                for b in batches:
                    for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        found = lex(data)[k]
                        yield from ((chunk, at, x) for at, x in enumerate(found if k else [found]))

            def run(batches):
                yield from in_batches(rows(batches), ["chunk_id", "pos", "v"], [pa.int64(), pa.int64(), pa.binary()])

            return texts.mapInArrow(run, "chunk_id long, pos long, v binary")

        return Encoded({n: stream(k) for k, n in enumerate(("structure", *self.STREAMS))})

    def decode(self, enc: Encoded) -> DataFrame:
        every = None
        for k, n in enumerate(("structure", *self.STREAMS)):
            part = enc[n].select("chunk_id", F.lit(k).alias("stream"), "pos", "v")
            every = part if every is None else every.unionByName(part)

        def texts(batches):
            """A chunk's rows come one after the other, so that a batch of small texts is one step, not one for each."""
            chunk, xs = None, None
            for b in batches:
                for c, k, v in zip(*(b.column(n).to_pylist() for n in ("chunk_id", "stream", "v")), strict=True):
                    if xs is None or c != chunk:
                        if xs is not None:
                            yield chunk, 0, unlex(xs[0][0], *xs[1:])
                        chunk, xs = c, [[] for _ in range(5)]
                    xs[k].append(v)
            if xs is not None:
                yield chunk, 0, unlex(xs[0][0], *xs[1:])

        def run(batches):
            yield from in_batches(texts(batches), ["chunk_id", "pos", "v"], [pa.int64(), pa.int64(), pa.binary()], most_bytes=BATCH_BYTES)

        return every.repartition("chunk_id").sortWithinPartitions("chunk_id", "stream", "pos").mapInArrow(run, "chunk_id long, pos long, v binary")


#: Classes of the coarser extraction.
CLASSES = {"A": "int", "B": "float", "C": "string", "D": "true", "E": "false", "F": "null"}
EXTRACT_BLOCK = 4096


def extract(data: bytes) -> tuple[bytes, list[bytes], list[bytes], list[bytes]]:
    """The coarser lexer: (structure of classes, ints, floats, strings as written)."""
    structure, values, keys, numbers, raw = lex(data)
    it = {ord("S"): iter(values), ord("K"): iter(keys), ord("R"): iter(raw), ord("N"): iter(numbers)}
    out, ints, floats, strings, at = [], [], [], [], 0
    for m in re.finditer(rb"\\(.)|[SKRNTFZ]|[ABCDE]", structure, re.DOTALL):
        out.append(structure[at : m.start()])
        at = m.end()
        c = m[0][0]
        if m[1] is not None or c in b"ABCDE":
            inner = m[1] if m[1] is not None else m[0]
            out.append(b"\\" + inner if inner in (b"A", b"B", b"C", b"D", b"E", b"F", b"\\") else inner)
        elif c in b"TFZ":
            out.append({84: b"D", 70: b"E", 90: b"F"}[c])
        else:
            x = next(it[c])
            if c == ord("N"):
                whole = re.fullmatch(rb"-?[0-9]+", x) is not None
                (ints if whole else floats).append(x)
                out.append(b"A" if whole else b"B")
            else:
                strings.append(x if c == ord("R") else escaped(x))
                out.append(b"C")
    out.append(structure[at:])
    return b"".join(out), ints, floats, strings


def compact(value) -> bytes:
    """A value in the canonical spelling of this module."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()

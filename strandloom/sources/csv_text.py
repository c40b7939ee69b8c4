"""Lossless CSV: every byte of the input is in some stream, and comes back.

Dialect: one separator byte, rows end with a line feed only, quotes are toggled but never removed, and all rows have
as many columns as the first.  ``null_aware`` takes runs of separators as one token and gives no field for what is
empty between them.  One binary a chunk in; a file is cut into chunks at line feeds by ``segment_lines`` or arrives
as one.  For analytics read files with Spark's own CSV source instead.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Codec, CodecError, Encoded, in_batches

FIELD, SEPARATOR, NEWLINE = "field", "separator", "newline"


def tokens(data: bytes, sep: bytes = b",", null_aware: bool = False) -> list[tuple[str, int, bytes]]:
    """(kind, column, bytes) of each token; raises for uneven rows and quotes that don't end."""
    s = re.escape(sep)
    field = re.compile(rb'(?:[^"\n' + s + rb']+|"[^"]*"|(?P<open>"))*')
    out: list[tuple[str, int, bytes]] = []
    at = row = col = 0
    columns = None
    want_field = not null_aware
    while at < len(data):
        if want_field or not (data[at : at + 1] == sep or data[at] == 10):
            m = field.match(data, at)
            if m["open"] is not None:
                raise CodecError("a quote doesn't end")
            out.append((FIELD, col, m[0]))
            at = m.end()
            if at == len(data):
                break
        if data[at] == 10:
            if columns is None:
                columns = col + 1
            if col + 1 != columns:
                raise CodecError(f"row {row} has {col + 1} columns instead of {columns}")
            out.append((NEWLINE, 0, b"\n"))
            at, row, col = at + 1, row + 1, 0
        else:
            n = 1
            while null_aware and data[at + n : at + n + 1] == sep:
                n += 1
            out.append((SEPARATOR, 0, data[at : at + n]))
            at, col = at + n, col + n
        want_field = not null_aware
    if want_field and out and out[-1][0] == SEPARATOR:
        out.append((FIELD, col, b""))
    return out


class CsvText(Codec):
    """A binary a chunk to tokens: chunk_id, pos, kind, col, row, at (place among the column's fields), v."""

    name = "csv"
    SCHEMA = "chunk_id long, pos long, kind string, col int, row long, at long, v binary"

    def __init__(self, sep: str = ",", null_aware: bool = False):
        if len(sep.encode()) != 1:
            raise CodecError("a separator is one byte")
        self.sep, self.null_aware = sep.encode(), null_aware

    def encode(self, s: DataFrame) -> Encoded:
        sep, null_aware, names = self.sep, self.null_aware, [c.split()[0] for c in self.SCHEMA.split(", ")]

        def rows(batches):
            for b in batches:
                for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    row, seen = 0, {}
                    for pos, (kind, col, v) in enumerate(tokens(data, sep, null_aware)):
                        at = seen.get(col, 0) if kind == FIELD else 0
                        yield chunk, pos, kind, col, row, at, v
                        if kind == FIELD:
                            seen[col] = at + 1
                        row += kind == NEWLINE

        def run(batches):
            yield from in_batches(rows(batches), names, [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])

        x = s.select("chunk_id", F.col("v").cast("binary").alias("v")).mapInArrow(run, self.SCHEMA)
        return Encoded({"tokens": x}, s.select("chunk_id"))

    @staticmethod
    def column(enc: Encoded, col: int) -> DataFrame:
        """One column's fields as a stream of strings."""
        return enc["tokens"].where((F.col("kind") == FIELD) & (F.col("col") == col)).select("chunk_id", F.col("at").alias("pos"), F.decode("v", "UTF-8").alias("v"))

    @staticmethod
    def layout(enc: Encoded) -> DataFrame:
        """What is between fields: the separators and line feeds, as a stream of strings with their places."""
        return enc["tokens"].where(F.col("kind") != FIELD).select("chunk_id", "pos", "kind", F.decode("v", "UTF-8").alias("v"))

    def decode(self, enc: Encoded) -> DataFrame:
        from ..operators.structure import joined_bytes

        return joined_bytes(enc["tokens"].select("chunk_id", "pos", "v"), enc.header)

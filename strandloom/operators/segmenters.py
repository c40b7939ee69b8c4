"""Cutting streams into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import CodecError, per_chunk

NUMERIC_CHUNK_BYTES = 16 << 20
CSV_CHUNK_BYTES = 20_000_000


def segment_numeric(s: DataFrame, width: int = 64, chunk_bytes: int = NUMERIC_CHUNK_BYTES) -> DataFrame:
    """The stream with its chunks cut after chunk_bytes: chunk_id, segment, pos (in the segment), v.  No shuffle."""
    n = max(1, chunk_bytes * 8 // width)
    return s.select("chunk_id", F.floor(F.col("pos") / n).alias("segment"), (F.col("pos") % n).alias("pos"), "v")


def segment_lines(lines: DataFrame, chunk_bytes: int = CSV_CHUNK_BYTES) -> DataFrame:
    """Lines (a stream of strings without their line feeds) with the segment that each belongs to.

    A segment ends with the first line that reaches chunk_bytes since the segment's start, so cuts depend on all
    lines before; a chunk's byte counts are walked in order, the lines themselves stay where they are.
    """
    sizes = lines.select("chunk_id", "pos", (F.octet_length("v") + 1).cast("long").alias("v"))

    def cut(t: pa.Table) -> pa.Table:
        ends = np.cumsum(t["v"].to_numpy())
        starts, at = [0], 0
        while True:
            k = int(np.searchsorted(ends, at + chunk_bytes))
            if k >= len(ends) - 1:
                break
            at = int(ends[k])
            starts.append(k + 1)
        first = t["pos"].to_numpy()[starts]
        return pa.table({"chunk_id": pa.array([t["chunk_id"][0].as_py()] * len(starts), pa.int64()), "segment": pa.array(np.arange(len(starts))), "first": pa.array(first)})

    firsts = per_chunk(sizes, cut, "chunk_id long, segment long, first long")
    marked = lines.join(firsts, (lines["chunk_id"] == firsts["chunk_id"]) & (lines["pos"] == firsts["first"]), "left").select(lines["chunk_id"], "pos", "v", "segment")
    w = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("segment", F.max("segment").over(w))


def segment_tokens(tokens: DataFrame, chunk_bytes: int) -> DataFrame:
    """A stream of sizes, gathered in order until chunk_bytes would be passed; a larger one is its own segment."""

    def cut(t: pa.Table) -> pa.Table:
        out, segment, held = [], -1, chunk_bytes + 1
        for size in t["v"].to_pylist():
            if held + size > chunk_bytes:
                segment, held = segment + 1, 0
            held += size
            out.append(segment)
        return pa.table({"chunk_id": t["chunk_id"], "pos": t["pos"], "v": t["v"], "segment": pa.array(out, pa.int64())})

    return per_chunk(tokens, cut, "chunk_id long, pos long, v long, segment long")


def segment_with(s: DataFrame, boundaries: Callable[[list], Iterable[int]]) -> DataFrame:
    """A function of a chunk's values yields the sizes of its segments, which must cover it."""

    def cut(t: pa.Table) -> pa.Table:
        sizes = list(boundaries(t["v"].to_pylist()))
        if sum(sizes) != t.num_rows:
            raise CodecError("segments must cover the chunk")
        return t.select(["chunk_id", "pos", "v"]).append_column("segment", pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()))

    return per_chunk(s, cut, f"chunk_id long, pos long, v {s.schema['v'].dataType.simpleString()}, segment long")

"""Streams and codecs.

A stream is a DataFrame ``chunk_id, pos, v``: an ordered, homogeneous sequence cut into chunks.  Rows have no order
of their own, so ``pos`` states it; chunks are independent, so every window and every sequential step is partitioned
by ``chunk_id`` and chunks are what runs in parallel.

A codec turns streams into streams and back.  What a decoder must know besides the streams (a minimum, a divisor,
a first value) is the header, a DataFrame with one row for each chunk.  Encoders are lazy: they build plans.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a chunk unless told otherwise.
CHUNK_ROWS = 1 << 20
#: Binary logarithm of the places that one task takes of a chunk where an operator deals chunks out.
STRETCH_BITS = 20
MASK32 = (1 << 32) - 1
MIN64 = -(1 << 63)


class CodecError(ValueError):
    """Input that a codec can't represent."""


@dataclass
class Encoded:
    streams: dict[str, DataFrame]
    header: DataFrame | None = None
    params: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.streams[name]


class Codec:
    """encode(*streams) -> Encoded; decode(Encoded) -> stream (or a tuple of them).

    ``check`` gives chunk_id, ok: whether each chunk can be encoded.  ``require`` turns it into an error, at the cost
    of one aggregate; encoders themselves never fail on the driver.
    """

    name = "codec"

    def encode(self, *streams: DataFrame) -> Encoded:
        raise NotImplementedError

    def decode(self, enc: Encoded):
        raise NotImplementedError

    def check(self, *streams: DataFrame) -> DataFrame:
        return streams[0].groupBy("chunk_id").agg(F.lit(True).alias("ok"))

    def require(self, *streams: DataFrame) -> None:
        bad = self.check(*streams).where("NOT ok").limit(1).collect()
        if bad:
            raise CodecError(f"{self.name} can't encode chunk {bad[0].chunk_id}")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    Only where a session on one machine (master local) names none a temporary folder is made, as the context's
    checkpoint folder, so that it is the same for the session's life.  A cluster that names none is an error: its
    nodes don't share a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def in_chunk() -> Window:
    return Window.partitionBy("chunk_id").orderBy("pos")


def whole_chunk() -> Window:
    return Window.partitionBy("chunk_id")


def up_to_here() -> Window:
    return in_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def stream(df: DataFrame, value: str | Column, order_by: list[str] | str, chunk: Column | None = None) -> DataFrame:
    """A stream of a table's column.

    ``order_by`` must be a unique key.  ``chunk`` gives each row's chunk_id from the row alone (a range of the key,
    say), so only chunks are sorted; without it the table is one chunk, which is a `long_stream`.
    """
    if chunk is None:
        return long_stream(df, value, order_by)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(chunk.cast("long").alias("chunk_id"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))
    order = Window.partitionBy("chunk_id").orderBy(*[f"k{i}" for i in range(len(keys))])
    return rows.select("chunk_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "v")


def long_stream(df: DataFrame, value: str | Column, order_by: list[str] | str, chunk: Column | None = None) -> DataFrame:
    """A stream whose chunks may be of any size, even the table as one.

    Sorted by ranges of (chunk, key) and written once to the scratch folder.  A range's rows of a chunk are a run; a
    place is the row's place in its run plus the chunk's rows in the ranges before, so no task sees more than a range.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select((F.lit(0) if chunk is None else chunk).cast("long").alias("chunk_id"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))
    order = ["chunk_id", *[f"k{i}" for i in range(len(keys))]]
    place, path = F.monotonically_increasing_id(), f"{scratch_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("chunk_id", "v", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed.write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    before = F.sum("n").over(Window.partitionBy("chunk_id").orderBy("part")) - F.col("n")
    runs = rows.groupBy("chunk_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).select(F.col("chunk_id").alias("run_chunk"), F.col("part").alias("run_part"), (before - F.col("first")).alias("shift"))
    runs.write.parquet(f"{path}/runs")  # so that its size is known where it is joined
    runs = df.sparkSession.read.parquet(f"{path}/runs")
    out = rows.join(runs, (F.col("part") == F.col("run_part")) & F.col("chunk_id").eqNullSafe(F.col("run_chunk")))
    return out.select("chunk_id", (F.col("at") + F.col("shift")).alias("pos"), "v")


def stretch() -> Column:
    """Which stretch of its chunk a row's place is in: what deals a chunk of any size to many tasks."""
    return F.shiftright("pos", STRETCH_BITS)


def positions(df: DataFrame, order_by: list[str], path: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """df with a global position ``pos`` and ``chunk_id`` = pos div chunk_rows, for keys of any distribution.

    Sorted by ranges and written once at ``path``; positions are a partition's offset plus the row's place in it, so
    no task sees more than its own range.  The offsets are one row for each partition.
    """
    sorted_ = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    low = (1 << 33) - 1
    place = F.monotonically_increasing_id()
    sorted_.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND(F.lit(low))).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    pos = F.col("before") + F.col("at")
    return rows.join(offsets, "part").withColumn("pos", pos).withColumn("chunk_id", F.floor(pos / chunk_rows)).drop("part", "at", "before")


def per_chunk(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f over each chunk's rows in order of pos, in Arrow: for steps that are sequential by nature."""

    def run(table: pa.Table) -> pa.Table:
        return f(table.sort_by("pos"))

    return df.groupBy("chunk_id").applyInArrow(run, schema)


def in_batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], most: int = 20_000, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches, so that many small chunks don't make many small batches; `most_bytes` bounds the last column's values."""
    held: list[tuple] = []
    size = 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        size += 0 if most_bytes is None else len(row[-1])
        if len(held) >= most or (most_bytes is not None and size >= most_bytes):
            yield made()
            held.clear()
            size = 0
    if held:
        yield made()


def in_arrays(pieces: Iterable[tuple[int, np.ndarray]], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Chunks' numbers (chunk_id, values) gathered into batches chunk_id, pos, v."""
    held: list[tuple[int, np.ndarray]] = []

    def made():
        n = [len(x) for _, x in held]
        places = np.concatenate([np.arange(k) for k in n])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([c for c, _ in held], n).astype(np.int64)), pa.array(places), pa.array(np.concatenate([x for _, x in held]).astype(np.int64))], ["chunk_id", "pos", "v"])

    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[1])
        if size >= most or len(held) >= 4096:
            yield made()
            held.clear()
            size = 0
    if held:
        yield made()


# Arithmetic modulo 2 ** 64 that can't overflow: 32-bit halves, put together by shifts.


def _join_halves(high: Column, low: Column) -> Column:
    carry = F.shiftright(low, 32)
    return F.shiftleft((high + carry).bitwiseAND(F.lit(MASK32)), 32).bitwiseOR(low.bitwiseAND(F.lit(MASK32)))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32))


def wrap_sub(a: Column, b: Column, width: int = 64) -> Column:
    a, b = a.cast("long"), b.cast("long")  # shifts of narrower types wrap
    return narrow(_join_halves(F.shiftright(a, 32) - F.shiftright(b, 32), _low(a) - _low(b)), width)


def wrap_add(a: Column, b: Column, width: int = 64) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return narrow(_join_halves(F.shiftright(a, 32) + F.shiftright(b, 32), _low(a) + _low(b)), width)


def wrap_sum(x: Column, window: Window, width: int = 64) -> Column:
    """A running sum modulo 2 ** width; the halves' sums are exact for chunks under 2 ** 31 rows."""
    x = x.cast("long")
    return narrow(_join_halves(F.sum(F.shiftright(x, 32)).over(window), F.sum(_low(x)).over(window)), width)


def narrow(x: Column, width: int) -> Column:
    """The value that the lowest `width` bits stand for, signed."""
    return x if width == 64 else F.shiftright(F.shiftleft(x, 64 - width), 64 - width)


def unsigned(x: Column, width: int = 64) -> Column:
    """A column that orders like the unsigned value of the lowest `width` bits."""
    return F.bitwise_not(x).bitwiseXOR(F.lit((1 << 63) - 1)) if width == 64 else x.bitwiseAND(F.lit((1 << width) - 1))


def bit_length(x: Column) -> Column:
    """Bits of a number read as unsigned; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def width_for(bits: Column) -> Column:
    """The narrowest of 8, 16, 32 and 64 that holds so many bits."""
    return F.when(bits <= 8, 8).when(bits <= 16, 16).when(bits <= 32, 32).otherwise(64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

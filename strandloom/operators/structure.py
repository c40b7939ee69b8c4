"""Conversions between bytes, records, numbers and strings; splitting, routing and joining of streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import core
from ..core import Codec, CodecError, Encoded, in_arrays, in_chunk, narrow, per_chunk, stretch

MAX_STRING_OUTPUTS = 2048
MAX_INTERLEAVED = 512


def _reversed(x: Column) -> Column:
    """The bytes of a binary, last first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(x), F.lit("(..)"), F.lit(0))), ""))


def bytes_to_number(x: Column, width: int, big: bool = False) -> Column:
    """A record of width / 8 bytes as a number, signed at 64 bits and unsigned below."""
    digits = F.hex(x if big else _reversed(x))
    if width < 64:
        return F.conv(digits, 16, 10).cast("long")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def number_to_bytes(x: Column, width: int, big: bool = False) -> Column:
    """The low `width` bits of a number as a record."""
    out = F.unhex(F.lpad(F.hex(x if width == 64 else x.bitwiseAND(F.lit((1 << width) - 1))), width // 4, "0"))
    return out if big else _reversed(out)


class SerialToRecords(Codec):
    """One binary for each chunk to records of `size` bytes; its length must be a multiple."""

    name = "convert_serial_to_struct"

    def __init__(self, size: int):
        self.size = size

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(F.length("v") % self.size == 0).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        n = F.floor(F.length("v") / self.size).cast("int")
        cut = s.where(n > 0).select("chunk_id", "v", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
        return Encoded({"v": cut.select("chunk_id", F.col("k").cast("long").alias("pos"), F.substring("v", F.col("k") * self.size + 1, F.lit(self.size)).alias("v"))}, s.select("chunk_id"))

    def decode(self, enc: Encoded) -> DataFrame:
        return joined_bytes(enc["v"], enc.header)


def joined_bytes(s: DataFrame, chunks: DataFrame) -> DataFrame:
    """Binaries of each chunk, one after the other; an empty one for chunks without any."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([b"".join(x or b"" for x in t["v"].to_pylist())], pa.binary())})

    whole = chunks.select("chunk_id").join(s, "chunk_id", "left").select("chunk_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("v").cast("binary").alias("v"))
    return per_chunk(whole, run, "chunk_id long, pos long, v binary")


class RecordsToNumbers(Codec):
    """Records of 1, 2, 4 or 8 bytes to numbers, little-endian or big-endian."""

    name = "convert_struct_to_num"

    def __init__(self, width: int = 64, big: bool = False):
        if width not in (8, 16, 32, 64):
            raise CodecError("width is 8, 16, 32 or 64")
        self.width, self.big = width, big

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(F.length("v") == self.width // 8).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": s.withColumn("v", bytes_to_number(F.col("v"), self.width, self.big))})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].withColumn("v", number_to_bytes(F.col("v"), self.width, self.big))


class SerialToNumbers(Codec):
    """One binary for each chunk to numbers (num8, le16 ... be64), by numpy on whole chunks."""

    name = "convert_serial_to_num"

    def __init__(self, width: int = 64, big: bool = False, signed: bool = True):
        self.width, self.kind = width, f"{'>' if big else '<'}{'i' if signed else 'u'}{width // 8}"

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(F.length("v") % (self.width // 8) == 0).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        kind = self.kind

        def run(batches):
            rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield from in_arrays((chunk, np.frombuffer(v, kind).astype(np.int64)) for chunk, v in rows)

        return Encoded({"v": s.select("chunk_id", F.col("v").cast("binary").alias("v")).mapInArrow(run, "chunk_id long, pos long, v long")}, s.select("chunk_id"))

    def decode(self, enc: Encoded) -> DataFrame:
        width, big = self.width, self.kind[0] == ">"
        return joined_bytes(enc["v"].withColumn("v", number_to_bytes(F.col("v"), width, big)), enc.header)


class NumbersToSerial(Codec):
    """A stream of numbers to one binary for each chunk, little-endian."""

    name = "convert_num_to_serial_le"

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": joined_bytes(s.withColumn("v", number_to_bytes(F.col("v"), self.width)), s.select("chunk_id").distinct())})

    def decode(self, enc: Encoded) -> DataFrame:
        return SerialToNumbers(self.width).encode(enc["v"])["v"]


class SetStringLengths(Codec):
    """One content for each chunk and a stream of byte lengths to strings; the lengths must cover the content."""

    name = "convert_serial_string"

    def check(self, content: DataFrame, lengths: DataFrame) -> DataFrame:
        sums = lengths.groupBy("chunk_id").agg(F.sum("v").alias("n"), F.min("v").alias("least"))
        return content.join(sums, "chunk_id", "left").select("chunk_id", ((F.coalesce("n", F.lit(0)) == F.octet_length("v")) & (F.coalesce("least", F.lit(0)) >= 0)).alias("ok"))

    def encode(self, content: DataFrame, lengths: DataFrame) -> Encoded:
        ends = lengths.withColumn("end", F.sum("v").over(in_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        whole = content.select("chunk_id", F.col("v").cast("binary").alias("content"))
        cut = F.substring("content", (F.col("end") - F.col("v") + 1).cast("int"), F.col("v").cast("int"))
        return Encoded({"v": ends.join(whole, "chunk_id").select("chunk_id", "pos", cut.alias("v"))}, content.select("chunk_id"))

    def decode(self, enc: Encoded) -> tuple[DataFrame, DataFrame]:
        return joined_bytes(enc["v"], enc.header), enc["v"].withColumn("v", F.octet_length("v").cast("long"))


class SeparateStrings(Codec):
    """Strings to their joined content and their byte lengths."""

    name = "separate_string_components"

    def encode(self, s: DataFrame) -> Encoded:
        content = joined_bytes(s.withColumn("v", F.col("v").cast("binary")), s.select("chunk_id").distinct())
        return Encoded({"content": content, "lengths": s.withColumn("v", F.octet_length("v").cast("long"))}, params={"type": s.schema["v"].dataType.simpleString()})

    def decode(self, enc: Encoded) -> DataFrame:
        return SetStringLengths().encode(enc["content"], enc["lengths"])["v"].withColumn("v", F.col("v").cast(enc.params["type"]))


def _dealt(part: DataFrame) -> DataFrame:
    """One of several streams that are put together by place: dealt by place before their union.

    Streams cut from one are partitioned alike, and a task of their union would make and sort all of them.
    """
    return part.repartition("chunk_id", "pos")


class TransposeSplit(Codec):
    """Numbers to one stream for each of their bytes, the lowest first."""

    name = "transpose_split"

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, s: DataFrame) -> Encoded:
        lane = lambda k: F.shiftright("v", 8 * k).bitwiseAND(F.lit(255))
        return Encoded({f"byte_{k}": s.withColumn("v", lane(k)) for k in range(self.width // 8)})

    def decode(self, enc: Encoded) -> DataFrame:
        every = None
        for k in range(self.width // 8):
            part = _dealt(enc[f"byte_{k}"].withColumn("v", F.shiftleft("v", 8 * k)))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("chunk_id", "pos").agg(F.bit_or("v").alias("v")).withColumn("v", narrow(F.col("v"), self.width))


class SplitByStruct(Codec):
    """Records of several fields to one stream of records for each field; sizes must add up to the record's."""

    name = "split_by_struct"

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(F.length("v") == sum(self.sizes)).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        out, at = {}, 1
        for k, size in enumerate(self.sizes):
            out[f"field_{k}"] = s.withColumn("v", F.substring("v", at, size))
            at += size
        return Encoded(out)

    def decode(self, enc: Encoded) -> DataFrame:
        every = None
        for k in range(len(self.sizes)):
            part = _dealt(enc[f"field_{k}"].withColumn("k", F.lit(k)))
            every = part if every is None else every.unionByName(part)
        fields = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: F.hex(x["v"]))
        return every.groupBy("chunk_id", "pos").agg(F.unhex(F.array_join(fields, "")).alias("v"))


def _renumbered(s: DataFrame, *by: str) -> DataFrame:
    return s.withColumn("at", (F.row_number().over(Window.partitionBy("chunk_id", *by).orderBy("pos")) - 1).cast("long"))


class SplitN(Codec):
    """A stream to segments of the given sizes; a last size of 0 takes the rest.  Sizes must cover each chunk."""

    name = "splitN"

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        self.open_end = bool(self.sizes) and self.sizes[-1] == 0
        if any(x <= 0 for x in self.sizes[: len(self.sizes) - self.open_end]):
            raise CodecError("only the last size may be 0")

    def check(self, s: DataFrame) -> DataFrame:
        total = sum(self.sizes)
        return s.groupBy("chunk_id").agg((F.count("*") >= total if self.open_end else F.count("*") == total).alias("ok"))

    def segment(self) -> Column:
        """A place's segment number: an expression, not a join."""
        end, out = 0, None
        for k, size in enumerate(self.sizes[:-1]):
            end += size
            out = F.when(F.col("pos") < end, k) if out is None else out.when(F.col("pos") < end, k)
        return F.lit(len(self.sizes) - 1) if out is None else out.otherwise(len(self.sizes) - 1)

    def encode(self, s: DataFrame) -> Encoded:
        out, start = {}, 0
        for k, size in enumerate(self.sizes):
            part = s.where((F.col("pos") >= start) & (F.lit(True) if size == 0 else F.col("pos") < start + size))
            out[f"segment_{k}"] = part.withColumn("pos", F.col("pos") - start)
            start += size
        return Encoded(out, params={"sizes": self.sizes})

    def decode(self, enc: Encoded) -> DataFrame:
        start, every = 0, None
        for k, size in enumerate(self.sizes):
            part = enc[f"segment_{k}"].withColumn("pos", F.col("pos") + start)
            every = part if every is None else every.unionByName(part)
            start += size
        return every


def split_with(parser, s: DataFrame) -> Encoded:
    """Segments whose sizes a function works out from each chunk's values (a list in order): stream with segment numbers."""

    def run(t: pa.Table) -> pa.Table:
        sizes = list(parser(t["v"].to_pylist()))
        if sum(sizes) != t.num_rows:
            raise CodecError("sizes must cover the chunk")
        return t.select(["chunk_id", "pos", "v"]).append_column("segment", pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()))

    kind = s.schema["v"].dataType.simpleString()
    return Encoded({"segments": per_chunk(s, run, f"chunk_id long, pos long, v {kind}, segment long")})


class DispatchByTag(Codec):
    """A stream and a tag for each place to one stream for each tag, with the tags as a stream of their own.

    The general form of routing by tag: segments with a tag are runs of places with it.
    """

    name = "dispatchN_byTag"

    def __init__(self, n_tags: int):
        self.n_tags = n_tags

    def check(self, s: DataFrame, tags: DataFrame) -> DataFrame:
        x = s.select("chunk_id", "pos", F.lit(1).alias("here")).join(tags.withColumnRenamed("v", "tag"), ["chunk_id", "pos"], "full")
        return x.groupBy("chunk_id").agg(F.bool_and(F.coalesce(F.col("here").isNotNull() & F.col("tag").between(0, self.n_tags - 1), F.lit(False))).alias("ok"))

    def routed(self, s: DataFrame, tags: DataFrame) -> DataFrame:
        """chunk_id, pos, v, tag, at: one plan for all outputs, for writing partitioned by tag."""
        return _renumbered(s.join(tags.withColumnRenamed("v", "tag"), ["chunk_id", "pos"]), "tag")

    def encode(self, s: DataFrame, tags: DataFrame) -> Encoded:
        x = self.routed(s, tags)
        out = {f"tag_{k}": x.where(F.col("tag") == k).select("chunk_id", F.col("at").alias("pos"), "v") for k in range(self.n_tags)}
        return Encoded(out | {"tags": tags})

    def decode(self, enc: Encoded) -> DataFrame:
        tags = _renumbered(enc["tags"].withColumnRenamed("v", "tag"), "tag")
        every = None
        for k in range(self.n_tags):
            part = enc[f"tag_{k}"].select("chunk_id", F.col("pos").alias("at"), "v", F.lit(k).alias("tag"))
            every = part if every is None else every.unionByName(part)
        return tags.join(every, ["chunk_id", "at", "tag"]).select("chunk_id", "pos", "v")


class DispatchString(DispatchByTag):
    """Strings to at most 2048 streams by an index for each."""

    name = "dispatch_string"

    def __init__(self, n_outputs: int):
        if not 1 <= n_outputs <= MAX_STRING_OUTPUTS:
            raise CodecError(f"1 to {MAX_STRING_OUTPUTS} outputs")
        super().__init__(n_outputs)


def segments_to_tags(segments: DataFrame) -> DataFrame:
    """A stream of struct(size, tag) to a tag for each place."""
    x = segments.select("chunk_id", "pos", F.col("v.size").alias("size"), F.col("v.tag").alias("tag"))
    end = F.sum("size").over(in_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("end", end).where("size > 0")
    return x.select("chunk_id", F.explode(F.sequence(F.col("end") - F.col("size"), F.col("end") - 1)).alias("pos"), F.col("tag").alias("v"))


class Concat(Codec):
    """Streams of one type, one after the other in each chunk, and how long each was."""

    name = "concat"

    def encode(self, *streams: DataFrame) -> Encoded:
        if len({s.schema["v"].dataType.simpleString() for s in streams}) != 1:
            raise CodecError("streams have different types")
        every = None
        for k, s in enumerate(streams):
            part = s.select("chunk_id", F.lit(k).alias("k"), stretch().alias("stretch"), "pos", "v")
            every = part if every is None else every.unionByName(part)
        counts = every.groupBy("chunk_id", "k", "stretch").agg(F.count("*").alias("n"))
        sizes = counts.groupBy("chunk_id", "k").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("chunk_id").orderBy("k", "stretch")) - F.col("n")
        starts = counts.select(F.col("chunk_id").alias("c0"), F.col("k").alias("k0"), F.col("stretch").alias("s0"), before.alias("before"))
        dealt = every.join(starts, F.col("chunk_id").eqNullSafe(F.col("c0")) & (F.col("k") == F.col("k0")) & (F.col("stretch") == F.col("s0")))
        place = F.row_number().over(Window.partitionBy("chunk_id", "k", "stretch").orderBy("pos")) - 1
        return Encoded({"v": dealt.select("chunk_id", (F.col("before") + place).alias("pos"), "v"), "sizes": sizes.select("chunk_id", F.col("k").cast("long").alias("pos"), F.col("n").alias("v"))}, params={"n": len(streams)})

    def decode(self, enc: Encoded) -> tuple[DataFrame, ...]:
        w = in_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sizes = enc["sizes"].select("chunk_id", F.col("pos").alias("k"), F.sum("v").over(w).alias("hi"), F.col("v").alias("n")).where("n > 0").withColumn("lo", F.col("hi") - F.col("n"))
        stretches = F.sequence(F.shiftright("lo", core.STRETCH_BITS), F.shiftright(F.col("hi") - 1, core.STRETCH_BITS))
        bounds = sizes.select("chunk_id", "k", "lo", "hi", F.explode(stretches).alias("stretch"))
        x = enc["v"].withColumn("stretch", stretch())

        def part(k: int) -> DataFrame:
            found = x.join(bounds.where(F.col("k") == k), ["chunk_id", "stretch"]).where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
            return found.select("chunk_id", (F.col("pos") - F.col("lo")).alias("pos"), "v")

        return tuple(part(k) for k in range(enc.params["n"]))


class Interleave(Codec):
    """Streams of strings of equal length in turn: first of each, second of each, ..."""

    name = "interleave_string"

    def check(self, *streams: DataFrame) -> DataFrame:
        every = None
        for k, s in enumerate(streams):
            part = s.groupBy("chunk_id").agg(F.count("*").alias("n"))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("chunk_id").agg(((F.min("n") == F.max("n")) & (F.count("*") == len(streams))).alias("ok"))

    def encode(self, *streams: DataFrame) -> Encoded:
        k = len(streams)
        if not 1 <= k <= MAX_INTERLEAVED:
            raise CodecError(f"1 to {MAX_INTERLEAVED} streams")
        every = None
        for j, s in enumerate(streams):
            part = s.select("chunk_id", (F.col("pos") * k + j).alias("pos"), "v")
            every = part if every is None else every.unionByName(part)
        return Encoded({"v": every}, params={"n": k})

    def decode(self, enc: Encoded) -> tuple[DataFrame, ...]:
        k = enc.params["n"]
        return tuple(enc["v"].where(F.col("pos") % k == j).withColumn("pos", F.floor(F.col("pos") / k)) for j in range(k))


def n_to_n(streams: Sequence[DataFrame], successors: Sequence[Codec]) -> list[Encoded]:
    """Each stream to the codec in its place."""
    return [c.encode(s) for s, c in zip(streams, successors, strict=True)]


def split_to(enc: Encoded, successors: Sequence[Codec]) -> dict[str, Encoded]:
    """Each output of a split to the codec in its place."""
    return {name: c.encode(s) for (name, s), c in zip(enc.streams.items(), successors, strict=True)}



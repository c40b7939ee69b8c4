"""Dictionaries, constants, duplicates, shared prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Codec, Encoded, in_chunk, per_chunk, unsigned
from .numeric import pack_bits, unpack_bits


class Tokenize(Codec):
    """A stream to its distinct values (the alphabet) and each place's index in it.

    The alphabet is in order of first appearance, or sorted: numbers as unsigned, strings and binaries by bytes, or
    by ``sort_key``, a function of the value's column.  Distinct values are aggregated on the map side, ranked, and
    joined back on (chunk, value), so that no task needs all places of a frequent value: adaptive execution splits it.
    """

    name = "tokenize"

    def __init__(self, sort: bool = False, sort_key=None, width: int = 64):
        self.sort, self.sort_key, self.width = sort, sort_key, width

    def alphabet(self, s: DataFrame) -> DataFrame:
        """chunk_id, v, token."""
        distinct = s.groupBy("chunk_id", "v").agg(F.min("pos").alias("first"))
        if self.sort_key:
            order: list[Column] = [self.sort_key(F.col("v")), F.col("v")]
        elif self.sort:
            numeric = s.schema["v"].dataType.typeName() in ("long", "integer", "short", "byte")
            order = [unsigned(F.col("v").cast("long"), self.width) if numeric else F.col("v")]
        else:
            order = [F.col("first")]
        return distinct.withColumn("token", (F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order)) - 1).cast("long")).drop("first")

    def encode(self, s: DataFrame) -> Encoded:
        a = self.alphabet(s)
        index = s.alias("s").join(a.alias("a"), (F.col("s.chunk_id") == F.col("a.chunk_id")) & F.col("s.v").eqNullSafe(F.col("a.v")))
        index = index.select(F.col("s.chunk_id").alias("chunk_id"), F.col("s.pos").alias("pos"), F.col("a.token").alias("v"))
        return Encoded({"alphabet": a.select("chunk_id", F.col("token").alias("pos"), "v"), "indices": index}, self.index_width(s))

    @staticmethod
    def index_width(s: DataFrame) -> DataFrame:
        """chunk_id, index_width: 8, 16 or 32 bits by the number of distinct values."""
        n = s.groupBy("chunk_id", "v").agg(F.lit(1).alias("one")).groupBy("chunk_id").agg(F.count("*").alias("n"))
        return n.select("chunk_id", F.when(F.col("n") <= 256, 8).when(F.col("n") <= 65536, 16).otherwise(32).alias("index_width"))

    def decode(self, enc: Encoded) -> DataFrame:
        a = enc["alphabet"].select("chunk_id", F.col("pos").alias("token"), "v")
        return enc["indices"].withColumnRenamed("v", "token").join(a, ["chunk_id", "token"]).select("chunk_id", "pos", "v")


class Constant(Codec):
    """A chunk of equal values to one of them and their number."""

    name = "constant"

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg((F.min("v").eqNullSafe(F.max("v")) & F.count("v").isin(0, F.count("*"))).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        one = s.groupBy("chunk_id").agg(F.max("v").alias("v"), F.count("*").alias("n"))
        return Encoded({"v": one.select("chunk_id", F.lit(0).cast("long").alias("pos"), "v")}, one.select("chunk_id", "n"))

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].drop("pos").join(enc.header, "chunk_id").select("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"), "v")


class Dedup(Codec):
    """Several equal streams to one.  ``trusted`` leaves the check to the caller."""

    name = "dedup"

    def __init__(self, trusted: bool = False):
        self.trusted = trusted

    def check(self, *streams: DataFrame) -> DataFrame:
        """Each place must be in every stream with one value."""
        every = streams[0].select("chunk_id", "pos", "v")
        for s in streams[1:]:
            every = every.unionByName(s.select("chunk_id", "pos", "v"))
        same = (F.count("*") == len(streams)) & F.min("v").eqNullSafe(F.max("v")) & F.count("v").isin(0, len(streams))
        return every.groupBy("chunk_id", "pos").agg(same.alias("same")).groupBy("chunk_id").agg(F.bool_and("same").alias("ok"))

    def encode(self, *streams: DataFrame) -> Encoded:
        if not self.trusted:
            self.require(*streams)
        return Encoded({"v": streams[0]}, params={"n": len(streams)})

    def decode(self, enc: Encoded) -> tuple[DataFrame, ...]:
        return (enc["v"],) * enc.params["n"]


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two binaries, in bytes: by halving, 32 bits' worth of steps at most."""
    a, b = F.hex(a), F.hex(b)
    top = F.least(F.length(a), F.length(b)) / 2
    start = F.struct(F.lit(0).alias("lo"), top.cast("int").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid * 2) == F.substring(b, F.lit(1), mid * 2)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(top + 2)).cast("int"))
    return F.coalesce(F.aggregate(steps, start, step, lambda s: s["lo"]), F.lit(0))


class Prefix(Codec):
    """Strings to the length that each shares with the one before, in bytes, and the rest."""

    name = "prefix"

    def encode(self, s: DataFrame) -> Encoded:
        v = F.col("v").cast("binary")
        x = s.withColumn("b", v).withColumn("n", shared_prefix(F.col("b"), F.lag("b").over(in_chunk())))
        rest = F.substring("b", F.col("n") + 1, F.length("b"))
        return Encoded({"lengths": x.select("chunk_id", "pos", F.col("n").cast("long").alias("v")), "suffixes": x.select("chunk_id", "pos", rest.alias("v"))}, params={"type": s.schema["v"].dataType.simpleString()})

    def decode(self, enc: Encoded) -> DataFrame:
        """Each string needs the one before: a chunk is put together in order."""
        x = enc["lengths"].withColumnRenamed("v", "n").join(enc["suffixes"], ["chunk_id", "pos"])

        def join_up(t: pa.Table) -> pa.Table:
            last, out = b"", []
            for n, rest in zip(t["n"].to_pylist(), t["v"].to_pylist(), strict=True):
                last = last[:n] + rest
                out.append(last)
            return pa.table({"chunk_id": t["chunk_id"], "pos": t["pos"], "v": pa.array(out, pa.binary())})

        return per_chunk(x, join_up, "chunk_id long, pos long, v binary").withColumn("v", F.col("v").cast(enc.params["type"]))


class FlatPack(Codec):
    """Bytes (numbers 0 to 255) to the sorted bytes that occur and packed indices into them."""

    name = "flatpack"

    def encode(self, s: DataFrame) -> Encoded:
        def pack(t: pa.Table) -> pa.Table:
            alphabet, at = np.unique(t["v"].to_numpy(), return_inverse=True)
            bits = max(1, int(len(alphabet) - 1).bit_length())
            return pa.table({"chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([pack_bits(at, bits)], pa.binary()), "alphabet": pa.array([alphabet.astype(np.uint8).tobytes()], pa.binary()), "n": pa.array([len(at)])})

        x = per_chunk(s.withColumn("v", F.col("v").cast("long")), pack, "chunk_id long, pos long, v binary, alphabet binary, n long")
        return Encoded({"alphabet": x.select("chunk_id", "pos", F.col("alphabet").alias("v")), "packed": x.select("chunk_id", "pos", "v")}, x.select("chunk_id", "n"))

    def decode(self, enc: Encoded) -> DataFrame:
        x = enc["packed"].join(enc["alphabet"].withColumnRenamed("v", "alphabet"), ["chunk_id", "pos"]).join(enc.header, "chunk_id")

        def unpack(t: pa.Table) -> pa.Table:
            alphabet = np.frombuffer(t["alphabet"][0].as_py(), np.uint8).astype(np.int64)
            n = t["n"][0].as_py()
            at = unpack_bits(t["v"][0].as_py(), max(1, int(len(alphabet) - 1).bit_length()), n)
            return pa.table({"chunk_id": pa.array([t["chunk_id"][0].as_py()] * n, pa.int64()), "pos": pa.array(np.arange(n)), "v": pa.array(alphabet[at])})

        return per_chunk(x, unpack, "chunk_id long, pos long, v long")

    @staticmethod
    def size(s: DataFrame) -> DataFrame:
        """chunk_id, bytes: 1 + floor(bits * n / 8) + distinct bytes."""
        x = s.groupBy("chunk_id").agg(F.countDistinct("v").alias("k"), F.count("*").alias("n"))
        bits = F.when(F.col("k") > 1, F.length(F.bin(F.col("k") - 1))).otherwise(0)
        return x.select("chunk_id", (1 + F.floor(bits * F.col("n") / 8) + F.col("k")).alias("bytes"))



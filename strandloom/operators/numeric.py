"""Reversible transforms of integer and float streams.

Values are longs; ``width`` says how many of the low bits count.  Differences and sums are modulo 2 ** width.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Codec, CodecError, Encoded, bit_length, in_arrays, in_chunk, narrow, per_chunk, unsigned, up_to_here, whole_chunk, width_for, wrap_add, wrap_sub, wrap_sum

MAX_RUNS = 64


class Delta(Codec):
    """Differences of neighbours: n - 1 values, the first one in the header.  An empty chunk stays empty."""

    name = "delta_int"

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, s: DataFrame) -> Encoded:
        before = F.lag("v").over(in_chunk())
        d = s.withColumn("d", wrap_sub(F.col("v"), before, self.width)).where(F.col("pos") > 0)
        header = s.where("pos = 0").select("chunk_id", F.col("v").alias("first"))
        return Encoded({"deltas": d.select("chunk_id", (F.col("pos") - 1).alias("pos"), F.col("d").alias("v"))}, header, {"width": self.width})

    def decode(self, enc: Encoded) -> DataFrame:
        first = enc.header.select("chunk_id", F.lit(0).cast("long").alias("pos"), F.col("first").alias("v"))
        every = first.unionByName(enc["deltas"].select("chunk_id", (F.col("pos") + 1).alias("pos"), "v"))
        return every.select("chunk_id", "pos", wrap_sum(F.col("v"), up_to_here(), self.width).alias("v"))


class ZigZag(Codec):
    """Signed to unsigned with small magnitudes first: 0, -1, 1, -2, ..."""

    name = "zigzag"

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": s.withColumn("v", zigzag(F.col("v")))})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].withColumn("v", unzigzag(F.col("v")))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


class RangePack(Codec):
    """Values less the chunk's unsigned minimum, in the narrowest width that holds their range."""

    name = "range_pack"

    def __init__(self, width: int = 64):
        self.width = width

    def header(self, s: DataFrame) -> DataFrame:
        u = unsigned(F.col("v"), self.width)
        ends = s.groupBy("chunk_id").agg(F.min_by("v", u).alias("low"), F.max_by("v", u).alias("high"))
        return ends.select("chunk_id", "low", width_for(bit_length(_bits(wrap_sub(F.col("high"), F.col("low")), self.width))).alias("packed_width"))

    def encode(self, s: DataFrame) -> Encoded:
        low = F.min_by("v", unsigned(F.col("v"), self.width)).over(whole_chunk())
        v = _bits(wrap_sub(F.col("v"), low), self.width)
        return Encoded({"v": s.withColumn("v", v)}, self.header(s), {"width": self.width})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].join(enc.header, "chunk_id").select("chunk_id", "pos", wrap_add(F.col("v"), F.col("low"), self.width).alias("v"))


def _bits(x: Column, width: int) -> Column:
    return x if width == 64 else x.bitwiseAND(F.lit((1 << width) - 1))


@F.pandas_udf(T.LongType())
def gcd_of(v: pd.Series) -> int:
    """Greatest common divisor; 1 for less than two values and for zeros alone."""
    x = v.to_numpy()
    return int(np.gcd.reduce(np.abs(x)) or 1) if len(x) > 1 else 1


class DivideBy(Codec):
    """Values divided by a divisor, given or the chunk's greatest common divisor."""

    name = "divide_by"

    def __init__(self, divisor: int | None = None):
        if divisor is not None and divisor < 1:
            raise CodecError("a divisor is at least 1")
        self.divisor = divisor

    def header(self, s: DataFrame) -> DataFrame:
        if self.divisor:
            return s.select("chunk_id").distinct().withColumn("divisor", F.lit(self.divisor).cast("long"))
        # Equal values say nothing new, so they meet before the divisor is worked out.
        several = s.groupBy("chunk_id", "v").agg(F.count("*").alias("n"))
        counts = several.groupBy("chunk_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.abs("v")).alias("one"))
        divisors = several.groupBy("chunk_id").agg(gcd_of(F.col("v")).alias("g"))
        divisor = F.when(F.col("n") <= 1, 1).when(F.col("k") > 1, F.col("g")).when(F.col("one") > 0, F.col("one")).otherwise(1)
        return counts.join(divisors, "chunk_id").select("chunk_id", divisor.cast("long").alias("divisor"))

    def check(self, s: DataFrame) -> DataFrame:
        if not self.divisor:
            return super().check(s)
        return s.groupBy("chunk_id").agg(F.bool_and(F.col("v") % self.divisor == 0).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        h = self.header(s)
        return Encoded({"v": s.join(h, "chunk_id").select("chunk_id", "pos", F.expr("v div divisor").alias("v"))}, h)

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].join(enc.header, "chunk_id").select("chunk_id", "pos", (F.col("v") * F.col("divisor")).alias("v"))


@F.pandas_udf(T.IntegerType())
def float32_bits(v: pd.Series) -> pd.Series:
    return _view(v, np.float32, np.int32)


@F.pandas_udf(T.FloatType())
def float32_of(bits: pd.Series) -> pd.Series:
    return _view(bits, np.int32, np.float32)


def _view(v: pd.Series, a: type, b: type) -> pd.Series:
    return pd.Series(np.ascontiguousarray(v.to_numpy(dtype=a)).view(b))


class FloatDeconstruct(Codec):
    """Bit patterns of floats to exponents and sign-with-fraction (the sign as lowest bit).

    Takes bit patterns as numbers; ``of_floats`` makes them of a float32 stream, ``to_floats`` gives floats back.
    """

    name = "float_deconstruct"
    LAYOUTS = {"float32": (8, 23), "bfloat16": (8, 7), "float16": (5, 10)}

    def __init__(self, kind: str = "float32"):
        self.kind = kind
        self.exponent, self.fraction = self.LAYOUTS[kind]

    @staticmethod
    def of_floats(s: DataFrame) -> DataFrame:
        return s.withColumn("v", float32_bits("v").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))

    @staticmethod
    def to_floats(s: DataFrame) -> DataFrame:
        return s.withColumn("v", float32_of(narrow(F.col("v"), 32).cast("int")))

    def encode(self, s: DataFrame) -> Encoded:
        v, f, e = F.col("v"), self.fraction, self.exponent
        exponent = F.shiftright(v, f).bitwiseAND(F.lit((1 << e) - 1))
        fraction = F.shiftleft(v.bitwiseAND(F.lit((1 << f) - 1)), 1).bitwiseOR(F.shiftright(v, f + e).bitwiseAND(F.lit(1)))
        return Encoded({"exponent": s.withColumn("v", exponent), "sign_fraction": s.withColumn("v", fraction)})

    def decode(self, enc: Encoded) -> DataFrame:
        x = enc["exponent"].withColumnRenamed("v", "e").join(enc["sign_fraction"], ["chunk_id", "pos"])
        sign = F.shiftleft(F.col("v").bitwiseAND(F.lit(1)), self.fraction + self.exponent)
        return x.select("chunk_id", "pos", sign.bitwiseOR(F.shiftleft("e", self.fraction)).bitwiseOR(F.shiftright("v", 1)).alias("v"))


class MergeSorted(Codec):
    """Few strictly increasing runs to their distinct values in order, each with a bit for every run that has it."""

    name = "merge_sorted"

    @staticmethod
    def _runs(s: DataFrame) -> DataFrame:
        falls = F.when(F.col("v") <= F.lag("v").over(in_chunk()), 1).otherwise(0)
        return s.withColumn("falls", falls).withColumn("run", F.sum("falls").over(up_to_here()).cast("int")).drop("falls")

    def check(self, s: DataFrame) -> DataFrame:
        return self._runs(s).groupBy("chunk_id").agg((F.max("run") < MAX_RUNS).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        runs = self._runs(s)
        merged = runs.groupBy("chunk_id", "v").agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias("bits"))
        merged = merged.withColumn("pos", (F.row_number().over(whole_chunk().orderBy("v")) - 1).cast("long"))
        header = runs.groupBy("chunk_id", "run").agg(F.count("*").alias("length"))
        return Encoded({"bits": merged.select("chunk_id", "pos", F.col("bits").alias("v")), "values": merged.select("chunk_id", "pos", "v")}, header)

    def decode(self, enc: Encoded) -> DataFrame:
        x = enc["bits"].withColumnRenamed("v", "bits").join(enc["values"], ["chunk_id", "pos"])
        runs = x.select("chunk_id", "v", F.explode(F.sequence(F.lit(0), F.lit(MAX_RUNS - 1))).alias("run"), "bits").where("shiftright(bits, run) & 1 = 1")
        return runs.select("chunk_id", (F.row_number().over(whole_chunk().orderBy("run", "v")) - 1).cast("long").alias("pos"), "v")


def merge_sorted_or_backup(s: DataFrame) -> DataFrame:
    """chunk_id, choice: merge_sorted for chunks of at most 64 runs, else backup."""
    return MergeSorted().check(s).select("chunk_id", F.when(F.col("ok"), "merge_sorted").otherwise("backup").alias("choice"))


class Quantize(Codec):
    """Numbers to a code for their power of two and the bits below it.

    ``offsets`` takes numbers from 1 on, code floor(log2 v).  ``lengths`` takes 0 on: below 16 the number is its own
    code, from there it is floor(log2 v) + 12.
    """

    LITERAL = 16

    def __init__(self, kind: str = "offsets"):
        self.kind, self.name = kind, f"quantize_{kind}"

    def check(self, s: DataFrame) -> DataFrame:
        least = 1 if self.kind == "offsets" else 0
        return s.groupBy("chunk_id").agg(F.bool_and((F.col("v") >= least) & (F.col("v") < 1 << 32)).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        power = bit_length(F.col("v")) - 1
        low = F.col("v") - F.expr("shiftleft(1L, length(bin(v)) - 1)")
        if self.kind == "offsets":
            code, extra, bits = power, low, power
        else:
            own = F.col("v") < self.LITERAL
            code, extra, bits = F.when(own, F.col("v")).otherwise(power + 12), F.when(own, 0).otherwise(low), F.when(own, 0).otherwise(power)
        return Encoded({"codes": s.withColumn("v", code.cast("long")), "extra": s.select("chunk_id", "pos", extra.cast("long").alias("v"), bits.cast("int").alias("bits"))})

    def decode(self, enc: Encoded) -> DataFrame:
        x = enc["codes"].withColumnRenamed("v", "code").join(enc["extra"], ["chunk_id", "pos"])
        whole = F.expr("shiftleft(1L, bits) + v")
        return x.select("chunk_id", "pos", (whole if self.kind == "offsets" else F.when(F.col("code") < self.LITERAL, F.col("code")).otherwise(whole)).alias("v"))


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """The low `bits` bits of each value, lowest first, one after the other."""
    lanes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(lanes, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    lanes = np.zeros((n, 64), np.uint8)
    lanes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8").ravel()


class BitPack(Codec):
    """Numbers, read as unsigned, to one binary for each chunk with as many bits a number as the largest needs."""

    name = "bitpack"

    def encode(self, s: DataFrame) -> Encoded:
        def pack(t: pa.Table) -> pa.Table:
            v = t["v"].to_numpy().astype(np.int64).view(np.uint64)
            bits = max(1, int(v.max()).bit_length())
            return pa.table({"chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([pack_bits(v, bits)], pa.binary()), "bits": pa.array([bits], pa.int32()), "n": pa.array([len(v)])})

        packed = per_chunk(s.withColumn("v", F.col("v").cast("long")), pack, "chunk_id long, pos long, v binary, bits int, n long")
        return Encoded({"bytes": packed.select("chunk_id", "pos", "v")}, packed.select("chunk_id", "bits", "n"))

    def decode(self, enc: Encoded) -> DataFrame:
        return unpacked(enc["bytes"].join(enc.header, "chunk_id"))

    @staticmethod
    def size(s: DataFrame) -> DataFrame:
        """chunk_id, bits, bytes of the packed form."""
        top = bit_length(F.max_by("v", unsigned(F.col("v"))))
        return s.groupBy("chunk_id").agg(F.greatest(F.lit(1), top).alias("bits"), F.count("*").alias("n")).select("chunk_id", "bits", F.ceil(F.col("n") * F.col("bits") / 8).alias("bytes"))


def unpacked(rows: DataFrame) -> DataFrame:
    """Numbers of rows chunk_id, v (binary), bits, n."""

    def run(batches):
        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        yield from in_arrays((chunk, unpack_bits(v, bits, n).view(np.int64)) for chunk, v, bits, n in rows)

    return rows.select("chunk_id", "v", "bits", "n").mapInArrow(run, "chunk_id long, pos long, v long")


class BitUnpack(Codec):
    """Bytes to numbers of `bits` bits each, lowest first.  Bits left over at the end are kept in the header.

    Takes one binary for each chunk.
    """

    name = "bitunpack"

    def __init__(self, bits: int):
        if not 1 <= bits <= 64:
            raise CodecError("1 to 64 bits")
        self.bits = bits

    def encode(self, s: DataFrame) -> Encoded:
        bits = self.bits
        rows = s.withColumn("bits", F.lit(bits)).withColumn("n", F.floor(F.length("v") * 8 / bits))

        @F.pandas_udf(T.LongType())
        def rest(v: pd.Series) -> pd.Series:
            return v.map(lambda b: int.from_bytes(b, "little") >> (len(b) * 8 // bits * bits) if b else 0)

        return Encoded({"v": unpacked(rows)}, s.select("chunk_id", F.length("v").cast("long").alias("n_bytes"), rest("v").alias("rest")), {"bits": bits})

    def decode(self, enc: Encoded) -> DataFrame:
        bits = self.bits
        joined = enc.header.join(enc["v"], "chunk_id", "left").select("chunk_id", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("v", F.lit(0)).alias("v"), "n_bytes", "rest")

        def pack(t: pa.Table) -> pa.Table:
            n, rest, size = t.num_rows, t["rest"][0].as_py(), t["n_bytes"][0].as_py()
            v = t["v"].to_numpy().view(np.uint64) if t["pos"][0].as_py() >= 0 else np.zeros(0, np.uint64)
            n = len(v)
            whole = int.from_bytes(pack_bits(v, bits), "little") if n else 0
            return pa.table({"chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([(whole | rest << n * bits).to_bytes(size, "little")], pa.binary())})

        return per_chunk(joined, pack, "chunk_id long, pos long, v binary")


#: A number as it is written without anything to spare.
CANONICAL = r"^(0|-?[1-9][0-9]*)\z"


def canonical_int(v: Column) -> Column:
    """The number of a canonical decimal string, or null: no plus, no leading zero, no -0, within 64 bits."""
    return F.when(v.rlike(CANONICAL), v.try_cast("long"))


class ParseInt(Codec):
    """Canonical decimal strings to numbers; a chunk with any other string can't be encoded."""

    name = "parse_int"

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(canonical_int(F.col("v")).isNotNull()).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": s.withColumn("v", canonical_int(F.col("v")))})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].withColumn("v", F.col("v").cast("string"))


class TryParseInt(Codec):
    """Strings to numbers where canonical, the others as they are, and which is which."""

    name = "try_parse_int"
    number = staticmethod(canonical_int)

    def encode(self, s: DataFrame) -> Encoded:
        x = s.withColumn("n", self.number(F.col("v"))).withColumn("is_number", F.col("n").isNotNull())
        at = (F.row_number().over(Window.partitionBy("chunk_id", "is_number").orderBy("pos")) - 1).cast("long")
        x = x.withColumn("at", at)
        return Encoded({
            "numbers": x.where("is_number").select("chunk_id", F.col("at").alias("pos"), F.col("n").alias("v")),
            "exceptions": x.where("NOT is_number").select("chunk_id", F.col("at").alias("pos"), "v"),
            "which": x.select("chunk_id", "pos", F.when(F.col("is_number"), 0).otherwise(1).alias("v")),
        })

    def decode(self, enc: Encoded) -> DataFrame:
        at = (F.row_number().over(Window.partitionBy("chunk_id", "v").orderBy("pos")) - 1).cast("long")
        which = enc["which"].withColumn("at", at).withColumnRenamed("v", "kind")
        parts = enc["numbers"].select("chunk_id", F.col("pos").alias("at"), F.col("v").cast("string").alias("v"), F.lit(0).alias("kind"))
        parts = parts.unionByName(enc["exceptions"].select("chunk_id", F.col("pos").alias("at"), "v", F.lit(1).alias("kind")))
        return which.join(parts, ["chunk_id", "at", "kind"]).select("chunk_id", "pos", "v")

    @classmethod
    def route(cls, s: DataFrame) -> DataFrame:
        """chunk_id, choice: numbers, strings or mixed."""
        ok = cls.number(F.col("v")).isNotNull()
        return s.groupBy("chunk_id").agg(F.bool_and(ok).alias("all"), F.bool_or(ok).alias("any")).select("chunk_id", F.when(F.col("all"), "numbers").when(F.col("any"), "mixed").otherwise("strings").alias("choice"))


def canonical_float(v: Column) -> Column:
    """The number of a decimal string that is the shortest spelling of a 64-bit float, or null: it reads back as it was."""
    x = v.try_cast("double")
    return F.when(x.cast("string") == v, x)


class ParseFloat(Codec):
    """Canonical spellings of floats to numbers; a chunk with any other string can't be encoded."""

    name = "parse_float"

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(canonical_float(F.col("v")).isNotNull()).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": s.withColumn("v", canonical_float(F.col("v")))})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].withColumn("v", F.col("v").cast("string"))


class TryParseFloat(TryParseInt):
    """Strings to floats where canonical, the others as they are, and which is which."""

    name = "try_parse_float"
    number = staticmethod(canonical_float)


class YCoCg(Codec):
    """Red, green and blue to luma and two chroma differences, without loss: the lifted form of the transform."""

    name = "ycocg"

    def encode(self, red: DataFrame, green: DataFrame, blue: DataFrame) -> Encoded:
        x = red.withColumnRenamed("v", "r").join(green.withColumnRenamed("v", "g"), ["chunk_id", "pos"]).join(blue.withColumnRenamed("v", "b"), ["chunk_id", "pos"])
        co = F.col("r") - F.col("b")
        t = F.col("b") + F.shiftright(co, 1)
        cg = F.col("g") - t
        parts = {"y": t + F.shiftright(cg, 1), "co": co, "cg": cg}
        return Encoded({name: x.select("chunk_id", "pos", c.alias("v")) for name, c in parts.items()})

    def decode(self, enc: Encoded) -> tuple[DataFrame, DataFrame, DataFrame]:
        x = enc["y"].withColumnRenamed("v", "y")
        for name in ("co", "cg"):
            x = x.join(enc[name].withColumnRenamed("v", name), ["chunk_id", "pos"])
        t = F.col("y") - F.shiftright("cg", 1)
        b = t - F.shiftright("co", 1)
        return tuple(x.select("chunk_id", "pos", c.alias("v")) for c in (b + F.col("co"), F.col("cg") + t, b))

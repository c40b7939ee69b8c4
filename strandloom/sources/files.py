"""Files as chunks, integer arrays, archives, and the profile of model files."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import in_batches
from ..operators.structure import SerialToNumbers


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One chunk for each file: chunk_id (a hash of its path), pos, v, path."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.xxhash64("path").alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.col("content").alias("v"), "path")


def integers(files: DataFrame, kind: str) -> DataFrame:
    """Files of integers (le-u16, be-i32, ...) as a stream of numbers."""
    order, letter_bits = kind.split("-")
    return SerialToNumbers(int(letter_bits[1:]), order == "be", letter_bits[0] == "i").encode(files.select("chunk_id", "pos", "v"))["v"]


def canonical_parquet(df: DataFrame, path: str) -> None:
    """A table as plain, uncompressed Parquet pages."""
    df.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def zip_members(files: DataFrame) -> DataFrame:
    """Members of archives: chunk_id (of the archive), member, name, stored (as it lies in the archive), compressed, v."""

    def rows(batches):
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for k, m in enumerate(z.infolist()):
                        yield chunk, k, m.filename, m.compress_size, m.compress_type != zipfile.ZIP_STORED, z.read(m)

    def run(batches):
        yield from in_batches(rows(batches), ["chunk_id", "member", "name", "stored", "compressed", "v"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()], 64)

    return files.select("chunk_id", "v").mapInArrow(run, "chunk_id long, member long, name string, stored long, compressed boolean, v binary")


def model_members(files: DataFrame) -> DataFrame:
    """zip_members with route: where a model file's member goes.

    Data members by how wide their numbers seem (u8, f16, f32, f64), members that are compressed as they are, the
    rest as metadata.
    """
    from ..functions.statistics import float_width

    members = zip_members(files).withColumn("id", F.xxhash64("chunk_id", "member"))
    data = members.where("name LIKE '%/data/%' AND NOT compressed")

    def unpack(batches):
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int64()), pa.array(np.arange(len(x))), pa.array(x.astype(np.int64))], ["chunk_id", "pos", "v"])

    width = float_width(data.select("id", "v").mapInArrow(unpack, "chunk_id long, pos long, v long")).select(F.col("chunk_id").alias("id"), "width")
    route = F.when(F.col("compressed"), "precompressed").when(F.col("width") == 1, "u8").when(F.col("width").isNotNull(), F.concat(F.lit("f"), (F.col("width") * 8).cast("string"))).otherwise("metadata")
    return members.join(width, "id", "left").withColumn("route", route).drop("id", "width")

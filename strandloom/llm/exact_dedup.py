"""Exact dedup by deterministic block naming.

A text, with A-Z lowered, is cut into blocks of a fixed number of bytes.  Level 0 sorts the distinct blocks and
gives each an integer name; every further level sorts the distinct pairs of neighbouring names and names those,
until a document has one name.  Two documents get the same name if and only if their bytes are the same: names
stand for contents that were compared, not for hashes.

How it runs: each distinct block is put in the order of (128-bit hash, content), so contents are compared wherever
hashes are equal, and only there.  The order is dealt into buckets by the hash and a name is (level, bucket, rank in
the bucket): it depends on the data alone, not on partitions, retries or the cluster's size.  The content of a block
is shuffled once, after copies have met on the map side; what follows carries hashes and names.  Names go back to
the blocks' places by hash, and by content where a hash stands for several.  That join is an ordinary equi-join of
exchanges, so adaptive execution splits the key of a hot block.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, as_bytes, fresh, map_batches, text_rows

#: Bytes of a block.  A text of up to this length is named at level 0.
BLOCK = 8192
#: Buckets of the sort that gives the names; a name keeps 40 bits for the rank in its bucket.
BUCKETS = 1 << 15

_hash = xxhash.xxh3_128_intdigest
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def _blocks(docs: DataFrame, block: int, content: bool) -> DataFrame:
    """A row for each block of each text; an empty text has one empty block."""

    def cut(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "sha", "n", "i", "h1", "h2", "block")}
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            text = text.lower()  # of bytes: A-Z only
            sha, n = hashlib.sha256(text).digest(), max(1, -(-len(text) // block))
            for i in range(n):
                piece = text[i * block : (i + 1) * block]
                h = _hash(piece)
                out["doc_id"].append(doc_id)
                out["sha"].append(sha)
                out["n"].append(n)
                out["i"].append(i)
                out["h1"].append(_signed(h >> 64))
                out["h2"].append(_signed(h & (1 << 64) - 1))
                out["block"].append(piece if content else None)
                held += len(piece) if content else 64
                if held > 8 << 20:
                    yield _batch(out)
                    held = 0
        yield _batch(out)

    return map_batches(docs.select("doc_id", "text"), cut, "doc_id long, sha binary, n int, i int, h1 long, h2 long, block binary")


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "sha": pa.binary(), "n": pa.int32(), "i": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "block": pa.binary()}
    made = pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], list(kinds))
    for x in out.values():
        x.clear()
    return made


def _named(distinct: DataFrame, level: int, order: list[str]) -> DataFrame:
    """Distinct contents with their names: level, bucket and the rank among the bucket's sorted contents."""
    bucket = F.pmod(F.xxhash64(*order[:2]), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)).cast("long")
    return distinct.withColumn("bucket", bucket).withColumn("name", F.lit(level << 56) + F.shiftleft(F.col("bucket").cast("long"), 40) + rank).drop("bucket")


def identities(spark: SparkSession, docs: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, sha, copies, identity): a row for each doc_id and text, the number of such rows, and the text's integer identity."""
    s = scratch or Scratch(spark, "block-names")
    docs = text_rows(docs)
    contents = _blocks(docs, block, True).groupBy("h1", "h2").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    several = F.size("blocks") > 1
    distinct = contents.select("h1", "h2", F.posexplode(F.when(several, F.col("blocks")).otherwise(F.array(F.lit(None).cast("binary")))).alias("k", "block"))
    names = s.write(_named(distinct, 0, ["h1", "h2", "k"]), "names-0")
    plain, shared = names.where("block IS NULL").drop("block", "k"), names.where("block IS NOT NULL").drop("k")
    key = ["doc_id", "sha", "n", "i", "h1", "h2"]
    rows = _blocks(docs, block, False).groupBy(key).agg(F.count("*").alias("copies"))
    place = ["doc_id", "sha", "n", "i", "copies", "name"]
    if shared.isEmpty():
        rows = rows.join(plain, ["h1", "h2"]).select(place)
    else:  # two contents of one hash: their places are named by content
        full = _blocks(docs, block, True).groupBy(*key, "block").agg(F.count("*").alias("copies"))
        rows = rows.join(plain, ["h1", "h2"]).select(place).unionByName(full.join(shared, ["h1", "h2", "block"]).select(place))
    rows = s.write(rows, "places-0")
    done = [rows.where("n = 1")]
    level, rest = 0, rows.where("n > 1")
    while not rest.isEmpty():
        level += 1
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        half = F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("i") / 2).cast("int").alias("i")
        pairs = s.write(rest.groupBy("doc_id", "sha", "copies", *half).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")), f"pairs-{level}")
        names = s.write(_named(pairs.select("a", "b").distinct(), level, ["a", "b"]), f"names-{level}")
        rows = s.write(pairs.join(names, ["a", "b"]).select(place), f"places-{level}")
        done.append(rows.where("n = 1"))
        rest = rows.where("n > 1")
    return reduce(DataFrame.unionByName, done).select("doc_id", "sha", "copies", F.col("name").alias("identity"))


def _grouped(spark: SparkSession, docs: DataFrame, block: int) -> DataFrame:
    s = Scratch(spark, "block-names")
    ids = identities(spark, docs, block, s)
    # Written, so that the join has an exchange on either side and the key of a hot group can be split.
    groups = s.write(ids.groupBy("identity").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    s.keep_only("places-*", "groups")
    return ids.join(groups, "identity").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, identity.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays.
    A null text counts as empty.  A null doc_id is kept as null and loses against any number; a group without
    numbers keeps one row, with keep_id null.  Of repeated rows (one doc_id, one text) one stays.  An empty table
    gives no rows; other columns are not read.
    """
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return _grouped(spark, docs, block).select("*", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "identity"
    )


def keep_first_copies(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one."""
    doc_id, sha, of = fresh(docs, "sl_doc_id"), fresh(docs, "sl_sha"), fresh(docs, "sl_of")
    copies = fresh(docs, "sl_copies")
    found = _grouped(spark, docs, block).where("stays").select(F.col("doc_id").alias(doc_id), F.col("sha").alias(of), F.col("copies").alias(copies))
    found = Scratch(spark, "block-names").write(found, "kept")
    # One doc_id may stand for several texts: a row is told by its id and its text's checksum.
    at = docs.columns.index("text")

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = pa.array([hashlib.sha256(t.lower()).digest() for t in as_bytes(batch.column(at))], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, sums], [*batch.schema.names, sha])

    schema = StructType([*docs.schema.fields, StructField(sha, BinaryType())])
    rows = map_batches(docs, summed, schema).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.col(sha) == F.col(of)))
    one = rows.where(F.col(copies) == 1).select(*docs.columns)
    if found.where(F.col(copies) > 1).isEmpty():
        return one
    return one.unionByName(rows.where(F.col(copies) > 1).dropDuplicates([doc_id, sha]).select(*docs.columns))


QUERY = "op2_exact_dedup"

ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("identity")

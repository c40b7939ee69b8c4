"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item is found in a document if at least 0.8 of its distinct five-word shingles are among the document's.  Words
are runs of letters and digits, lower-cased, so case and punctuation don't hide a passage.

Search: items are partitioned by size, each partition holding those of 2^p to 2^(p+1)-1 shingles.  An item's sketch
is k of its MinHash values, k = u - ceil(0.8 u) + 1 for its partition's largest size u (all of them, if it has
fewer): the lowest among those that the fewest items share, so that a phrase that many items have leads to few pairs.  A document that contains the item lacks at most q - ceil(0.8 q) < k of its q shingles, so it has one of the
sketch whatever the document's own size: no pair is lost, and short items need only a few values.  A document that
hits an item's sketch makes a candidate pair, and only these pairs are verified, shingle by shingle, as strings.

How it runs: the shingles of all documents stream through one join with the sketches, broadcast if their bytes were
summed and are few, else a shuffle join; only hits leave the scan.  The second scan reads candidate documents alone,
and of their shingles only those that items have go on to meet the pairs.  Two tables are written in between, the items
and the pairs, which are read more than once; for each file a task starts processes that share its executor's memory
for a moment, so what is read once is not written and the items are as few files as their rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, fresh

SHINGLE = 5
CONTAINED = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Rows of the items' shingles in a file, about.
FILE_ROWS = 1 << 18


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def _each_shingle(words: str, make) -> Column:
    """make(words of a shingle) for every shingle of the column; fewer words than a shingle's are one shingle."""
    w = F.col(words)
    n = F.size(w)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: make([F.get(w, i + k) for k in range(SHINGLE)]))


def _hashes(words: str) -> Column:
    return _each_shingle(words, lambda ws: F.xxhash64(*ws))


def _strings(words: str) -> Column:
    return F.array_distinct(_each_shingle(words, lambda ws: F.concat_ws(" ", *ws)))


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, n_item, n_shared, containment.

    n_item is the number of the item's distinct shingles, n_shared of those that the document has.  A text of one to
    four words is one shingle of all its words, so such an item is found only in a document of the same words.  Null
    and empty texts have no shingles and are in no pair.  Rows that repeat a document give its pairs once; rows of
    one doc_id with different texts are looked at each on its own and give the larger figures; null ids are ids like
    others.  Items repeated under one id are one set.  Empty tables give no rows; other columns are not read.
    """
    s = Scratch(spark, "decontaminate")
    of = items.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("w")).select("item_id", F.explode(_strings("w")).alias("shingle"), "w").drop("w").distinct()
    sizes = of.groupBy("item_id").agg(F.count("*").alias("n_item"))
    of = of.join(sizes, of["item_id"].eqNullSafe(sizes["item_id"])).drop(sizes["item_id"])
    parts = F.split("shingle", " ")
    of = of.withColumn("w", parts).withColumn("hash", F.xxhash64(*[F.get("w", F.lit(k)) for k in range(SHINGLE)])).drop("w")
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1).cast("long") - 1
    k = upper - F.ceil(upper * F.lit(contained) - 1e-9) + 1
    files = 1 + of.count() // FILE_ROWS
    shared = of.groupBy("hash").agg(F.count("*").alias("holders"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("holders", F.xxhash64("hash"), "shingle"))
    of = s.write(of.withColumn("k", k).join(shared, "hash").withColumn("sketched", rank <= F.col("k")).select("item_id", "n_item", "shingle", "hash", "sketched").coalesce(files), "items")

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), _words(F.col("text")).alias("w"))
    sketch = of.where("sketched").select("hash", "item_id").distinct()
    hits = d.select("doc_id", "content", F.explode(_hashes("w")).alias("hash")).join(broadcast_if_small(sketch), "hash")
    pairs = s.write(hits.select("doc_id", "content", "item_id").distinct(), "pairs")

    key = pairs.select(F.col("doc_id").alias("c_id"), F.col("content").alias("c_content")).distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    whole = whole.join(broadcast_if_small(key), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("content") == F.col("c_content")), "left_semi")
    shingles = whole.select("doc_id", "content", _words(F.col("text")).alias("w")).select("doc_id", "content", F.explode(_strings("w")).alias("shingle"))
    had = shingles.join(broadcast_if_small(of.select("shingle").distinct()), "shingle", "left_semi").distinct()
    had = had.select(F.col("doc_id").alias("h_id"), F.col("content").alias("h_content"), F.col("shingle").alias("h_shingle"))
    asked = of.select(F.col("item_id").alias("i_id"), "n_item", "shingle")
    wanted = pairs.join(broadcast_if_small(asked), F.col("item_id").eqNullSafe(F.col("i_id"))).drop("i_id")
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("content") == F.col("h_content")) & (F.col("shingle") == F.col("h_shingle"))
    found = wanted.join(had, same).groupBy("doc_id", "content", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    found = found.where(F.col("n_shared") >= F.col("n_item") * F.lit(contained) - 1e-9).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_items(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in whose doc_id no item is found; a null doc_id is looked at like any other."""
    name = fresh(docs, "sl_found")
    found = Scratch(spark, "decontaminate").write(contained_items(spark, docs, items).select(F.col("doc_id").alias(name)).distinct(), "found")
    return docs.join(broadcast_if_small(found), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


QUERY = "op7_benchmark_decontamination"


def shingles_sql(table: str, key: str) -> str:
    """Distinct (key, s) for DuckDB."""
    words = rf"list_filter(string_split_regex(lower(coalesce(text, '')), '{NOT_WORD}'), lambda x: x <> '')"
    each = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END"
    return f"SELECT DISTINCT {key}, unnest({each}) AS s FROM (SELECT {key}, {words} AS w FROM {table})"


ORACLE = f"""
WITH d AS ({shingles_sql("documents", "doc_id")}), b AS ({shingles_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= n_item * 0.8 - 1e-9
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

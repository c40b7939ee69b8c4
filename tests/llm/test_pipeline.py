"""run() against its stages' brute-force versions, one after the other, on a small corpus."""

import sys
from pathlib import Path

import pytest
import test_bpe  # noqa: F401  the library's ids are held against the encoder's there
from helpers import clashing, words
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_items
from test_exact_dedup import brute as brute_copies
from test_simhash import brute as brute_groups
from test_simhash import brute_fp
from test_toxicity import corpus
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from strandloom.core import scratch_dir  # noqa: E402
from strandloom.llm import toxicity  # noqa: E402
from strandloom.llm.bpe import vocabulary_path  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus(400)
    items = [(k, words(30, 70 + k, 5000)) for k in range(5)]
    clean = [(1000 + k, words(200, k, 5000)) for k in range(60)]
    near = [(2000 + k, clean[k][1] + " tail") for k in range(20)]
    copies = [(3000 + k, clean[k + 20][1].upper()) for k in range(20)]
    leaks = [(4000 + k, words(100, 300 + k, 5000) + " " + items[k % 5][1]) for k in range(10)]
    hard = [(5000, None), (5001, ""), (5002, " \n"), (5003, "<|endoftext|> é")]
    every = [(i, t, "en", "src0", len(t or "")) for i, t in rows + clean + near + copies + leaks + hard]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_run_against_brute_force(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = toxicity.scores(spark, docs, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 0")
    ok = {r.doc_id for r in clean.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in ok]
    kept = {x[0] for x in brute_copies(rows) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    groups = brute_groups([(i, brute_fp(t)) for i, t in rows])
    kept = {i for i, _, c in groups if i == c}
    rows = [r for r in rows if r[0] in kept]
    gone = {x[0] for x in brute_items(rows, items)}
    rows = [r for r in rows if r[0] not in gone]
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want
    assert len(gone) >= 10 and not any(4000 <= i < 4010 for i, _ in got) and any(1000 <= i < 1060 for i, _ in got)


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema


def test_run_on_hard_rows_with_clashing_columns(spark, tmp_path):
    """Nulls in every column, repeated rows, ties and columns named like the operators' own."""
    rows, labels = corpus(200)
    hard = [(None, None), (None, ""), (7000, None), (7001, "same words here"), (7001, "same words here"), (7002, "Same Words here"), (7003, words(60, 1)), (7003, words(60, 2)), (7004, "x " * 20_000)]
    clashing(spark, rows + hard).withColumn("source", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, None, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert got.count(7002) == 1 and 7001 not in got and got.count(7003) == 2 and got.count(7004) == 1


def test_scratch_of_stages_is_deleted(spark, folder):
    root = Path(scratch_dir(spark).removeprefix("file://")) / "strandloom"
    before = set(root.iterdir()) if root.is_dir() else set()
    corpus_pipeline.run(spark, folder[0]).count()
    left = set(root.iterdir()) - before
    assert len(left) == 1 and [p.name for p in left.pop().iterdir()] == [corpus_pipeline.STAGES[-2][0]]


def test_stages_on_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0

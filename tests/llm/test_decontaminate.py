import random
import re

import pytest
from helpers import HARD, clashing, docs, words

from strandloom.llm import common
from strandloom.llm import decontaminate as op


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute(rows, items):
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(shingles(t))
    best = {}
    for d, t in rows:
        s = shingles(t)
        for i, want in of.items():
            n = len(s & want)
            if want and n >= 0.8 * len(want) - 1e-9:
                best[d, i] = max(best.get((d, i), (0, 0)), (n, len(want)))
    return sorted(((d, i, q, n, n / q) for (d, i), (n, q) in best.items()), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "item_id", "n_item", "n_shared", "containment").collect()), key=repr)


def cases():
    r = random.Random(4)
    items = [(k, words(5 + k * 3 % 50, 1000 + k, 5000)) for k in range(25)] + [(None, "null id item of six words"), (90, None), (91, ""), (92, "two words"), (93, "Ünïcode ßtraße É è ê words"), (92, "two more words")]
    rows = list(HARD) + [(16, "Two... WORDS!"), (17, "two words more"), (18, "ÜNÏCODE ßtraße é È ê, words"), (19, "x null id item of six words y")]
    for k in range(120):
        w = words(300, k, 5000).split()
        i, t = items[r.randrange(25)]
        part = t.split()
        for _ in range(r.randrange(4)):  # near copies around the threshold
            part[r.randrange(len(part))] = "changed"
        at = r.randrange(len(w))
        text = " ".join(w[:at] + part + w[at:])
        rows.append((200 + k, text.upper().replace(" ", "!! ") if k % 5 == 0 else text))
    return rows, items


@pytest.mark.parametrize("broadcast", [1_000_000, 3])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rows, items = cases()
    want = brute(rows, items)
    assert len(want) > 40 and any(x[4] < 1 for x in want)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "1 AS shingle")
    assert found(op.contained_items(spark, clashing(spark, rows), it)) == want


def test_stage_keeps_clean_rows(spark):
    rows, items = cases()
    d = clashing(spark, rows)
    kept = op.without_items(spark, d, spark.createDataFrame(items, "item_id long, text string"))
    gone = {x[0] for x in brute(rows, items)}
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in gone), key=repr)


def test_empty_tables(spark):
    it = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert op.contained_items(spark, docs(spark, []), it).count() == 0
    assert op.contained_items(spark, docs(spark, HARD), it.where("false")).count() == 0
    assert op.without_items(spark, docs(spark, HARD), it.where("false")).count() == len(HARD)


def test_no_python_in_the_plan(spark):
    plan = op.contained_items(spark, docs(spark, HARD), spark.createDataFrame([], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_few_files_are_written(spark, monkeypatch):
    rows, items = cases()
    it = spark.createDataFrame(items, "item_id long, text string")
    written, write = {}, common.Scratch.write

    def noted(self, df, name):
        out = write(self, df, name)
        written[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(common.Scratch, "write", noted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(op.contained_items(spark, docs(spark, rows), it)) == brute(rows, items)
        assert written.keys() == {"items", "pairs"} and written["items"] == 1  # a file costs its task several forks
        written.clear()
        monkeypatch.setattr(op, "FILE_ROWS", 50)  # many rows are many files
        assert found(op.contained_items(spark, docs(spark, rows), it)) == brute(rows, items)
        assert written["items"] > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

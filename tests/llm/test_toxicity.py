import itertools
import math
import random

import numpy as np
import pytest
from helpers import HARD, clashing, docs
from pyspark.sql import functions as F

from strandloom.llm import toxicity as op

BAD = ["idiot", "moron", "worthless", "pathetic", "clown", "scumbag"]
PLAIN = ["river", "window", "morning", "garden", "letter", "worth", "town", "path", "street", "yellow", "basket", "quiet", "ideal", "more", "patient", "clock"]


def corpus(n=900, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = [r.choice(PLAIN) for _ in range(r.randrange(5, 60))]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((k, " ".join(w)))
        if k % 9:
            labels.append((k, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def scorer(spark, tables):
    return op.fit(spark, *tables)


def test_trigrams_against_brute_force(spark):
    rows = [r for r in HARD if len(r[1] or "") < 100] + [(1, "Ünï x1y  Z漢z")]
    want = {}
    for _, t in rows:
        s = [op.sign(c) for c in f" {t or ''} "]
        s = [x for k, x in enumerate(s) if x or not k or s[k - 1]]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            want[(a * 64 + b) * 64 + c] = want.get((a * 64 + b) * 64 + c, 0) + 1
    assert {r.cell: r.n for r in op.trigram_counts(docs(spark, rows)).collect()} == want


def test_viterbi_finds_the_cheapest_reading(scorer):
    """All readings of short lattices, priced one by one."""
    channel, r = scorer.channel, random.Random(2)

    def price(readings):
        total = sum(c for _, c in readings)
        a = b = 0
        for x in map(op.sign, "".join(t for t, _ in readings) + " "):
            if x or b:
                total += channel.cost[(a * 64 + b) * 64 + x]
                a, b = b, x
        return total

    for _ in range(60):
        lattice = channel.lattice("".join(r.choice("id1o0t!.s5") for _ in range(7)))
        best = min(map(price, itertools.product(*lattice)))
        got = channel.decode(lattice)
        ways = [w for w in itertools.product(*lattice) if "".join(t for t, _ in w) == got]
        assert math.isclose(min(map(price, ways)), best)


def test_settling_changes_no_reading(scorer, monkeypatch):
    channel, r = scorer.channel, random.Random(8)
    lattices = [channel.lattice("".join(r.choice("id1o0t!.s5@8 ") for _ in range(r.randrange(1, 300)))) for _ in range(60)]
    want = [channel.decode(x) for x in lattices]
    monkeypatch.setattr(op, "SETTLE", 3)
    assert [channel.decode(x) for x in lattices] == want


def test_long_texts_without_spaces_take_little_memory(scorer):
    import tracemalloc

    r = random.Random(9)
    seen = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60_000))
    tracemalloc.start()
    scorer.channel.words(seen)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20


def test_all_weighty_features_are_kept(spark):
    """Of more than 20,000 features each weighs something: all are in the model."""
    r = random.Random(3)
    names = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(4500)]
    rows = [(k, " ".join(names if k % 2 else PLAIN)) for k in range(120)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    weights = op.fit(spark, docs(spark, rows), labels).weights
    clean = {f for n in op.with_single_letters(PLAIN) for f in op.features(n)}
    assert len(weights) > 20_000 and set(weights) == {f for n in names for f in op.features(n)} - clean


@pytest.mark.parametrize("seen, word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("M0R0N!!", "moron"), ("wooorthless", "worthless"), ("p@thetic", "pathetic"), ("cl0wn***", "clown"), ("river,", "river"), ("street", "street"), ("$cumbag", "scumbag"), ("worthle55", "worthless")])
def test_restored_words(scorer, seen, word):
    assert scorer.channel.words(seen) == [word]


def test_spelled_out_words(scorer):
    assert op.spelled_out("you a m 0 r o n , b c".split()) == [["a", "m", "0", "r", "o", "n", ",", "b", "c"]]
    assert scorer.channel.spaced(list("m0ron")) == ["moron"]
    assert scorer.signals("x y i d i o t q")[0] >= 0


def test_held_out_accuracy_and_columns(spark, tables):
    d, labels = tables
    got = op.scores(spark, d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_obfuscated_documents_are_found(spark, tables):
    d, labels = tables
    hidden = [(5000, "garden 1d10t river m0r0n letter w0rthless"), (5001, "town i.d.i.o.t window cl0000wn path p@thetic"), (5002, "garden river letter window town path")]
    got = {r.doc_id: r.predicted for r in op.scores(spark, d.unionByName(docs(spark, hidden)), labels).where("doc_id >= 5000").collect()}
    assert got == {5000: 1, 5001: 1, 5002: 0}


def test_held_out_labels_are_not_learned_from(spark, tables):
    d, labels = tables
    flipped = labels.withColumn("toxic", F.when(op.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (op.scores(spark, d, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.array_equal(a.score, b.score)


def test_hard_rows_and_empty_tables(spark, tables):
    d, labels = tables
    got = op.scores(spark, clashing(spark, HARD), labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score < 0.5 and not math.isnan(r.score) for r in got)
    assert op.scores(spark, docs(spark, []), labels).count() == 0
    assert op.scores(spark, d, labels.where("false")).where("predicted = 1").count() == 0
    odd = spark.createDataFrame([(None, None, 1), (1, None, None), (2, 1, 7), (4, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert op.scores(spark, d, odd).count() == d.count()


def test_stage_keeps_clean_rows(spark, tables):
    d, labels = tables
    kept = op.without_toxic(spark, d, labels)
    want = op.scores(spark, d, labels).where("predicted = 0")
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())


@pytest.mark.parametrize("seen", ["iidioott", "mmoorroonn", "iddiot", "worrthless", "sccumbag", "ppaatthheettiicc", "wwoorrtthhlleessss"])
def test_doubled_letters(scorer, seen):
    word = next(w for w in BAD if "".join(c for c, _ in itertools.groupby(w)) == "".join(c for c, _ in itertools.groupby(seen)))
    assert scorer.of[seen] and scorer.of[seen][0] == scorer.of[word][0] > 0


@pytest.mark.parametrize("seen, word", [("i d i o t,", "idiot"), ("id io t", "idiot"), ("(mo r on).", "moron"), ("pa th et ic", "pathetic"), ("cl ow n!", "clown"), ("m 0 r o n", "moron"), ("i, d, i, o, t", "idiot"), ("pa th et ic, to", "pathetic")])
def test_fragments(scorer, seen, word):
    text = f"river {seen} garden"
    assert scorer.signals(text)[0] == scorer.of[word][0] > 0, scorer.signals(text)


def test_words_of_look_alikes_only():
    n = np.zeros(op.SIGNS**3, np.int64)
    s = [op.sign(c) for c in " bigot "]
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        n[(a * 64 + b) * 64 + c] = 1000
    channel = op.Channel(np.flatnonzero(n), n[np.flatnonzero(n)])
    assert channel.words("8!60+") == ["bigot"] and channel.words("81607,") == ["bigot"]
    assert channel.words("!!!") == channel.words("--") == channel.words("12") == []


def test_doubled_and_broken_documents_are_found(spark, tables):
    d, labels = tables
    hidden = [(5000, "garden iidioott river mmoorroonn letter worrthless"), (5001, "town id io t, window cl ow n. path m o r o n, street"), (5002, "garden river letter street yellow town path of it in a to be, is so")]
    got = {r.doc_id: r.predicted for r in op.scores(spark, d.unionByName(docs(spark, hidden)), labels).where("doc_id >= 5000").collect()}
    assert got == {5000: 1, 5001: 1, 5002: 0}

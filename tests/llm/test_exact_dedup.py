import hashlib
from collections import defaultdict

import pytest
from helpers import HARD, clashing, docs, words

from strandloom.llm import exact_dedup as op


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(low)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("block", [3, 64, op.BLOCK])
def test_against_brute_force(spark, block):
    rows = [r for r in HARD if block > 3 or len(r[1] or "") < 100] + [(100 + k, words(k % 7 * 10, k % 5)) for k in range(60)]
    assert found(op.exact_dedup(spark, docs(spark, rows), block)) == brute(rows)


def test_names_stand_for_contents_not_hashes(spark, monkeypatch):
    """With a hash that takes few values, names still tell contents apart."""
    monkeypatch.setattr(op, "_hash", lambda piece: len(piece) % 3)
    rows = [(k, words(k % 9, k % 4)) for k in range(40)]
    assert found(op.exact_dedup(spark, docs(spark, rows), 16)) == brute(rows)


def test_clashing_columns_and_empty_table(spark):
    assert found(op.exact_dedup(spark, clashing(spark, HARD))) == brute(HARD)
    assert op.exact_dedup(spark, docs(spark, [])).count() == 0
    assert op.keep_first_copies(spark, docs(spark, [])).count() == 0


def test_rows_that_stay_have_all_their_columns(spark):
    d = clashing(spark, HARD)
    kept = op.keep_first_copies(spark, d)
    assert kept.columns == d.columns
    want = [(i, t) for i, t in HARD]
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted((r[0] for r in brute(want) if r[3]), key=repr)


def test_same_identity_in_any_order_of_rows(spark):
    rows = [(k, words(40, k % 6)) for k in range(30)]
    ids = lambda rows: {r.doc_id: r.identity for r in op.identities(spark, docs(spark, rows), 32).collect()}
    assert ids(rows) == ids(rows[::-1])

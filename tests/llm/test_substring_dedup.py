import hashlib
import random

import numpy as np
import pytest
from helpers import HARD, clashing, docs, words

from strandloom.llm import substring_dedup as op


def brute(rows, size):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                x = tuple(w[k : k + size])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone |= set(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def cases(seed, n=140, passage=70):
    """Documents with shared passages in their own contexts, near copies, copies, repeats within, and tiny vocabularies."""
    r = random.Random(seed)
    shared = [words(r.randrange(20, passage), seed * 100 + k, 60).split() for k in range(8)]
    rows = []
    for k in range(n):
        w = words(r.randrange(200), 1000 * seed + k, 3000).split()
        for _ in range(r.randrange(4)):
            at, p = r.randrange(len(w) + 1), list(r.choice(shared))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "changed"
            w[at:at] = p * r.choice([1, 1, 1, 2])
        rows.append((r.randrange(10 * n), "  ".join(w) if k % 2 else "\n".join(w)))
        if k % 9 == 0:
            rows.append((r.randrange(10 * n), rows[r.randrange(len(rows))][1]))
        if k % 11 == 0:
            rows.append((rows[r.randrange(len(rows))][0], words(90, k, 2)))
    return rows


@pytest.mark.parametrize("size, edge, broadcast", [(50, 12, 1_000_000), (50, 12, 0), (10, 3, 1_000_000), (5, 5, 0), (8, 1, 0)])
def test_against_brute_force(spark, size, edge, broadcast):
    rows = [r for r in HARD if len(r[1] or "") < 1000] + cases(size)
    want = brute(rows, size)
    assert sum(x[2] > 0 for x in want) > 20
    assert found(op.substring_dedup(spark, docs(spark, rows), size, edge, broadcast)) == want


def test_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(op, "AT_A_TIME", 5000)
    rows = HARD + cases(5, 40)
    assert found(op.substring_dedup(spark, clashing(spark, rows))) == brute(rows, 50)


def test_windows_on_the_edge_of_their_length(spark):
    a = words(50, 1, 10**6)
    rows = [(1, a), (2, a), (3, "x " + a), (4, a + " y"), (5, " ".join(a.split()[:49])), (6, " ".join(a.split()[1:]) + " z"), (7, a + " " + a)]
    got = {r.doc_id: r for r in op.substring_dedup(spark, docs(spark, rows)).collect()}
    assert [got[k].n_removed for k in range(1, 8)] == [0, 50, 50, 50, 0, 0, 100]
    assert (got[3].kept_text, got[4].kept_text, got[7].kept_text) == ("x", "y", "")


@pytest.mark.parametrize("bits", [1, 8])
def test_colliding_names_change_nothing(spark, bits):
    """With so few bits most names stand for several texts; verification finds out and the result is the same."""
    rows = cases(3, 60)
    assert found(op.substring_dedup(spark, docs(spark, rows), bits=bits)) == brute(rows, 50)


def test_unitigs_are_long_spans(spark):
    """A passage that documents share as a whole is one claimed span, with the coordinates of its first document."""
    p = words(400, 2, 10**6)
    rows = [(k, f"{words(60, 10 + k, 10**6)} {p} {words(60, 50 + k, 10**6)}") for k in range(4)]
    d = docs(spark, rows).selectExpr("doc_id", "text", "0L AS content")
    got = op._claimed(spark, d, op.Scratch(spark, "t"), 50, 12, 64, 1 << 20).collect()
    whole = [r for r in got if r.end - r.start > 300]
    assert {(r.doc_id, r.src_doc) for r in whole} == {(1, 0), (2, 0), (3, 0)} and len(got) <= 9
    assert all(r.start == r.src_start for r in got)


def test_chain_of_overlapping_sources(spark):
    w = words(200, 9, 10**6).split()
    rows = [(1, " ".join(w[:100])), (2, " ".join(w[60:170])), (3, " ".join(w))]
    assert found(op.substring_dedup(spark, docs(spark, rows))) == brute(rows, 50)


def test_empty_table(spark):
    assert op.substring_dedup(spark, docs(spark, [])).count() == 0


def test_least_places():
    r = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 39):
        v = r.integers(0, 5, 200).astype(np.uint64)
        assert op._least(v, width).tolist() == [k + int(np.argmin(v[k : k + width])) for k in range(200 - width + 1)]

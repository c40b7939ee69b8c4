import random
import zlib

import numpy as np
import pytest
from helpers import HARD, clashing, docs, words
from tokenizers import Tokenizer

from strandloom.llm import token_planes as op
from strandloom.llm.bpe import vocabulary_path


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_file_round_trip(planes, block):
    r = np.random.default_rng(block)
    docs = [(None if k % 5 == 0 else k - 3, r.integers(0, 1 << 32, k * 11 % 40, np.uint32)) for k in range(25)]
    w = op.FileWriter(planes, block)
    for i, ids in docs:
        w.add(i, ids.astype("<u4").tobytes())
    at = 0
    for (i, ids), (j, start, got) in zip(docs, op.read_file(w.close()), strict=True):
        assert (i, at) == (j, start) and got.tolist() == ids.tolist()
        at += len(ids)


@pytest.mark.parametrize("options", [{}, {"planes": 32, "block": 50, "file_ids": 100}])
def test_rows_against_the_library(spark, options):
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    odd = ["<|endoftext|> a<|startoftext|>b", "é Å ﬁ İ ΑΣ Σ", "don't we'll 'S", "a b　c\x85d\x1ce", "12 345 x9"]
    rows = HARD + list(enumerate(odd, 50)) + [(200 + k, words(k, k)) for k in range(60)]
    got = {}
    for r in op.round_trip(spark, clashing(spark, rows), **options).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at = 0
    for i in sorted({i for i, _ in rows}, key=lambda i: (i is not None, i)):
        want = []
        for text in [t for j, t in rows if j == i]:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((len(ids), zlib.crc32(ids.tobytes())))
        mine = sorted(got[i])
        assert sorted(x[1:] for x in mine) == sorted(want)
        for start, n, _ in mine:
            assert start == at
            at += n
    assert sum(map(len, got.values())) == len(rows)


def test_same_ids_as_the_library():
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    mine = op.word_encoder(vocabulary_path("word_bpe_49k.json"))
    r = random.Random(7)
    some = [*"abEÉÈéßÿ×÷ÀÞþµªº\u0301\u0331HhK.,!?'\"()[]{}<>|*&%$#@^_`~+=-/\\:;09 ", "<|endoftext|>", "'s", "'LL", "ſ", "İ", "Ω", "ﬁ"]
    for k in range(20_000):
        text = "".join(r.choice(some) for _ in range(1 + k % 12))
        ids = np.frombuffer(mine.encode(text.encode()), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
    for c in [*range(1, 0xD800), *range(0xE000, 0x3000)]:
        text = f"a{chr(c)} {chr(c)}b {chr(c)}."
        assert np.frombuffer(mine.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_ids_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    op.write_planes(docs(spark, HARD), path, file_ids=1000)
    for r in op.read_planes(spark, path).collect():
        assert len(r.ids) == r.n_tokens and r.ids[-1] == 1 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert op.round_trip(spark, docs(spark, [])).count() == 0

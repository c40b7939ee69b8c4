import hashlib
import random

import pytest
from helpers import HARD, clashing, docs, words
from tokenizers import Tokenizer

from strandloom.llm import bpe as op


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op.vocabulary_path("byte_bpe_50k.json"))


def strings(n, seed):
    r = random.Random(seed)
    some = [*"ab  \n\t'sre<|endoftext|>19.é漢　\x1c\x85!ß💥", "<|endoftext|>", "  ", "ing", " the", "\r\n", "'ll", "aaaaaaaa", "=====", "zqxj"]
    return ["".join(r.choice(some) for _ in range(r.randrange(60))) for _ in range(n)]


def test_same_ids_as_the_library(library):
    e = op.Encoder(op.vocabulary_path("byte_bpe_50k.json"))
    every = ["".join(map(chr, range(a, a + 64))) for a in [*range(0, 0xD800, 64), *range(0xE000, 0x20000, 64)]]
    for text in strings(4000, 1) + every + [words(2000, 5), " ".join(strings(300, 2))]:
        import numpy as np

        ids = np.frombuffer(e.encode(text), "<u4")
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text[:80])
        assert e.vocabulary.decode(ids).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_table_of_chunks_is_bounded_by_bytes():
    kept = op.Kept(lambda x: x * 2, 1 << 16)
    assert [kept[str(k % 1000)] for k in range(4000)] == [str(k % 1000) * 2 for k in range(4000)]
    assert 0 < (len(kept) + len(kept.older)) * op.ENTRY_BYTES < 1 << 16
    assert kept["x" * 1000] == "x" * 2000 and "x" * 1000 not in kept


def test_rows(spark, library):
    rows = HARD + list(enumerate(strings(200, 3), 100))

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    got = [tuple(r) for r in op.encode_decode(clashing(spark, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted((want(*r) for r in rows), key=repr)
    assert op.encode_decode(docs(spark, [])).count() == 0


def test_columns_of_ids_round_trip(spark):
    d = docs(spark, HARD)
    back = op.decode(op.encode(d), column="again")
    assert all(r.again == (r.text or "") for r in back.collect())


def test_tables_of_other_operators_are_let_go():
    from strandloom.llm.common import hold_only

    e = op.encoder(op.vocabulary_path("byte_bpe_50k.json"))
    hold_only("pieces")
    assert op.encoder(op.vocabulary_path("byte_bpe_50k.json")) is e
    hold_only(None)
    assert op.encoder(op.vocabulary_path("byte_bpe_50k.json")) is not e

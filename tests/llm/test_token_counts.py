import pytest
from helpers import HARD, clashing, docs, words
from tokenizers import Tokenizer

from strandloom.llm import token_counts as op
from strandloom.llm.bpe import vocabulary_path


def brute(library, doc, fields, separator, rule):
    """Character by character, from the library's own offsets."""
    values = [(f, doc[f] or "") for f in fields]
    text = "\n".join(v for _, v in values)
    owner, rows = [], []
    for k, (f, v) in enumerate(values):
        pieces = v.split(separator)
        if len(pieces) > 1 and not pieces[-1]:
            pieces.pop()
        at = 0
        for s, _ in enumerate(pieces):
            n = len(v) - at if s == len(pieces) - 1 else len(pieces[s]) + len(separator)
            rows.append([doc["doc_id"], f, s, at, at + n, 0.0])
            owner += [len(rows) - 1] * n
            at += n
        if k < len(values) - 1:
            owner.append(len(rows) - 1)
    e = library.encode(text, add_special_tokens=False)
    for a, b in e.offsets:
        over = [owner[c] for c in range(a, max(b, a + 1))]
        if rule == "start":
            rows[over[0]][5] += 1
        elif rule == "majority":
            rows[max(sorted(set(over)), key=lambda s: (over.count(s), -s))][5] += 1
        else:
            for s in over:
                rows[s][5] += 1 / len(over)
    return [(*r[:5], round(r[5], 6), len(e.ids)) for r in rows]


@pytest.mark.parametrize("rule", op.RULES)
@pytest.mark.parametrize("separator", ["\n", "ab"])
def test_against_brute_force(spark, rule, separator):
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    odd = ["a\n\n\nb\n", "\n", "\n\n", "xababab", "tabab le\n\n  \n\nx", "é\né💥\n💥", "ab"]
    rows = [r for r in HARD if len(r[1] or "") < 1000] + list(enumerate(odd, 60)) + [(100 + k, words(k, k).replace("w7", "\n\n")) for k in range(30)]
    d = clashing(spark, rows)
    fields = ("lang", "text", "source")
    got = [(r.doc_id, r.field, r.section, r.start, r.end, round(r.n_tokens, 6), r.doc_tokens) for r in op.token_counts(d, fields, separator, rule).collect()]
    want = [x for r in d.collect() for x in brute(library, r, fields, separator, rule)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sum_is_the_documents_own_count(spark):
    for r in op.token_counts(docs(spark, HARD)).groupBy("doc_id", "doc_tokens").sum("n_tokens").where("doc_id BETWEEN 9 AND 15").collect():
        assert r["sum(n_tokens)"] == r.doc_tokens


def test_empty_table_and_wrong_rule(spark):
    assert op.token_counts(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        op.token_counts(docs(spark, []), rule="last")

import json
import random

import pytest
from streams import make, read

from strandloom.core import CodecError
from strandloom.sources import csv_text, json_text

CSV = [
    b"", b"a", b"a,b\n1,2\n", b"a,b\n1,2", b",,\n,,\n", b"a,\n,b\n", b'a,"x,\ny",c\n1,"",3\n', b'"q""r",b\nz,"\n"\n', b"\n\n\n", b'n,v\r\n1,2\r\n', b'x"a,b"y,c\n1,2\n',
    b'universe,id,list\nu,1,"[1,2]"\nv,2,"[]"\n', "é,ü\n漢,字\n".encode(),
]


@pytest.mark.parametrize("null_aware", [False, True])
def test_csv_round_trip(spark, null_aware):
    chunks = {k: [v] for k, v in enumerate(CSV)}
    c = csv_text.CsvText(null_aware=null_aware)
    assert read(c.decode(c.encode(make(spark, chunks, "binary")))) == chunks


def test_csv_tokens():
    f, s, n = csv_text.FIELD, csv_text.SEPARATOR, csv_text.NEWLINE
    assert csv_text.tokens(b"a,,b\n") == [(f, 0, b"a"), (s, 0, b","), (f, 1, b""), (s, 0, b","), (f, 2, b"b"), (n, 0, b"\n")]
    assert csv_text.tokens(b"a,,b\n,,c\n", null_aware=True) == [(f, 0, b"a"), (s, 0, b",,"), (f, 2, b"b"), (n, 0, b"\n"), (s, 0, b",,"), (f, 2, b"c"), (n, 0, b"\n")]
    assert csv_text.tokens(b"a|b|\n", b"|")[-2:] == [(f, 2, b""), (n, 0, b"\n")]
    for bad in (b"a,b\n1\n", b'a,"b\n', b'"'):
        with pytest.raises(CodecError):
            csv_text.tokens(bad)
    with pytest.raises(CodecError):
        csv_text.CsvText("||")


def test_csv_columns(spark):
    c = csv_text.CsvText("|")
    e = c.encode(make(spark, {0: [b"1|x|\n2|y|\n3||\n"]}, "binary"))
    assert read(c.column(e, 0))[0] == ["1", "2", "3"] and read(c.column(e, 1))[0] == ["x", "y", ""] and read(c.column(e, 2))[0] == [""] * 3
    assert {r.kind for r in c.layout(e).collect()} == {"separator", "newline"}


def number(r: random.Random) -> str:
    """A number by the grammar's productions: sign, integer, fraction, exponent."""
    whole = "0" if r.random() < 0.2 else str(r.randrange(1, 10 ** r.randrange(1, 19)))
    fraction = "." + "".join(r.choice("0123456789") for _ in range(r.randrange(1, 8))) if r.random() < 0.4 else ""
    exponent = r.choice("eE") + r.choice(["", "+", "-"]) + str(r.randrange(400)) if r.random() < 0.3 else ""
    return r.choice(["", "-"]) + whole + fraction + exponent


def character(r: random.Random) -> str:
    """A character of a string by its production: plain, a short escape, an escape by number (surrogates too)."""
    kind = r.randrange(4)
    if kind == 0:
        return "\\" + r.choice('"\\/bfnrt')
    if kind == 1:
        return "\\u" + "".join(r.choice("0123456789abcdefABCDEF") for _ in range(4))
    return chr(r.choice([*range(0x20, 0x22), *range(0x23, 0x5C), *range(0x5D, 0x100), 0x20AC, 0x4E16, 0x1F600]))


def text_of(r: random.Random, depth: int = 0) -> str:
    """A value by the grammar, with white space between tokens."""

    def space() -> str:
        return "".join(r.choice(" \t\n\r") for _ in range(r.randrange(3))) if r.random() < 0.3 else ""

    def string() -> str:
        return '"' + "".join(character(r) for _ in range(r.randrange(12))) + '"'

    kind = r.randrange(4 if depth > 3 else 6)
    if kind < 2:
        return space() + (number(r), string())[kind] + space()
    if kind < 4:
        return space() + r.choice(["true", "false", "null"]) + space()
    inside = [text_of(r, depth + 1) for _ in range(r.randrange(5))]
    if kind == 4:
        return space() + "[" + ",".join(inside) + "]" + space()
    return space() + "{" + ",".join(f"{space()}{string()}{space()}:{v}" for v in inside) + "}" + space()


def spoilt(r: random.Random, raw: bytes) -> bytes:
    """A text that isn't of the grammar any more: cut off, a byte changed, put in or left out."""
    k = r.randrange(len(raw) + 1)
    kind = r.randrange(4)
    return (raw[:k], raw[:k] + bytes([r.randrange(256)]) + raw[k + 1 :], raw[:k] + bytes([r.randrange(256)]) + raw[k:], raw[:k] + raw[k + 1 :])[kind]


def json_texts() -> list[bytes]:
    """Texts of the grammar, spoilt ones, and noise."""
    r = random.Random(6)
    whole = [text_of(r).encode() for _ in range(300)] + [b'{"long": "' + b"y" * 30_000 + b'"}']
    for t in whole:
        json.loads(t, parse_float=str, parse_int=str)  # is of the grammar
    noise = [bytes(r.randrange(256) for _ in range(r.randrange(40))) for _ in range(100)]
    marks = ["".join(r.choice('{}[],:"\\ tfnu01.eE+-STNKRFZ') for _ in range(r.randrange(40))).encode() for _ in range(200)]
    return [b"", bytes(range(256)), *whole, *(spoilt(r, r.choice(whole)) for _ in range(300)), *noise, *marks]


def test_json_round_trip(spark):
    texts = json_texts()
    chunks = {k: [v] for k, v in enumerate(texts)}
    c = json_text.JsonText()
    assert read(c.decode(c.encode(make(spark, chunks, "binary")))) == chunks


def test_json_streams():
    structure, values, keys, numbers, raw = json_text.lex(rb'{"k": [1, -2.5, "v\n", "\/", true, null], "S" : 01}')
    assert structure == b"{K: [N, N, S, R, T, Z], K : NN}"
    assert (values, keys, numbers, raw) == ([b"v\n"], [b"k", b"S"], [b"1", b"-2.5", b"0", b"1"], [rb"\/"])
    assert json_text.extract(b'{"a": [1, 2.5, "x", true, false, null], B}') == (b"{C: [A, B, C, D, E, F], \\B}", [b"1"], [b"2.5"], [b"a", b"x"])


def test_canonical_spelling_is_the_usual_one():
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(chr(r.choice([*range(0, 0x80), 0xE9, 0x1F680])) for _ in range(r.randrange(8)))
        raw = json.dumps(text, ensure_ascii=False)[1:-1].encode()
        assert json_text.unescaped(raw) == text.encode() and json_text.escaped(text.encode()) == raw


@pytest.mark.parametrize("rows", [3, 10_000])
def test_small_json_texts_are_put_together_in_batches(spark, monkeypatch, rows):
    monkeypatch.setattr(json_text, "BATCH_BYTES", 64)
    texts = {k: [b'{"a": [%d, "S", true], "b\\u0041": null}' % k * (1 + k % 3)] for k in range(200)} | {-1: [b""], -2: [b"[" + b"1," * 500 + b"2]"]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)  # texts lie across batches
    try:
        c = json_text.JsonText()
        back = c.decode(c.encode(make(spark, texts, "binary")))
        assert read(back) == texts
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in back._jdf.queryExecution().executedPlan().toString()  # no Python step for each text

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    """documents from (doc_id, text) pairs, in several partitions."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], schema).repartition(3)


def clashing(spark, rows):
    """The same table with columns named like the operators' own."""
    d = docs(spark, rows)
    for name in ("fp", "sha", "n", "i", "h1", "name", "identity", "keep_id", "u", "v", "copies", "kept", "__id", "word", "start", "item_id", "score", "pos", "shard"):
        d = d.selectExpr("*", f"'x' AS {name}")
    return d


#: Nulls, empty and blank texts, ties, repeated rows, letters outside ASCII, and a very long text.
HARD = [
    (1, None), (2, ""), (3, "   \n"), (4, "Straße ÄÖ K K"), (5, "STRASSE"), (6, "strasse"), (7, "straSSE"), (None, "strasse"), (None, None), (8, "x"), (8, "x"), (8, "y"),
    (9, "a b"), (10, "a b c"), (11, "a\tb\x0bc\x0cd\re"), (12, "tok " * 30000), (13, "TOK " * 30000), (14, "tok " * 30000 + "z"), (-5, "negative id"), (15, "💥 é é \x00 \x1f"),
]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(vocabulary) for _ in range(n))

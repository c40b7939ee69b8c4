"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns give candidate spans; so does `bare`, a long run of key-like characters with upper case, lower case and
digits that no base span touches.  The candidates' values are hashed and counted over the whole corpus by distinct
repositories and distinct owners.  A value that WIDELY owners have, or that stands in MANY repositories whoever owns
them, is an example that was copied around; one of few owners and few repositories that also looks live (long, varied,
no placeholder words) is theirs.  Base spans always stay; bare spans are
added where their value is live and owner-specific.

How it runs: one scan.  Positions come from the text between matches (split) and the matches' own lengths, summed
along the row in blocks, so a text with many matches costs in proportion.  The scan writes one narrow row for each
document; owners and repositories are counted on distinct (value, owner, repository) after map-side aggregation, and joined back by
value in a join whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYWORDS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BARE = "[A-Za-z0-9+/_=-]{20,}"
#: Kinds in their order: (name, pattern, group that is the value, characters of it at least).
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32), ("bare", BARE, 0, 20))
#: A cheap pattern for each kind that every text with a span of it has.
SIEVES = (rf"""({KEYWORDS})["']?\x20*[:=]""", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", "[A-Za-z0-9+/_=-]{20}")
PLACEHOLDER = "(?i)example|changeme|placeholder|dummy|sample|your|xxxx|0000|1234|abcd"
#: Owners, or repositories of all owners, from which on a value counts as widely copied.
WIDELY, MANY = 3, 5
#: Matches summed at a time.
STEP = 128


def _found(text: Column, k: int) -> Column:
    """array<struct<start, end, value>> of the spans of kind k, in code points; needs no shuffle."""
    _, pattern, group, least = KINDS[k]
    regex = F.lit(pattern)
    matches = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("all"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    sizes = F.filter(matches, lambda m: m["all"].isNotNull())
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(STEP)), lambda b: F.slice(sizes, b + 1, STEP))
    span = "struct<start:int,end:int,value:string>"
    nothing = F.array().cast(f"array<{span}>")

    def one(done: Column, m: Column) -> Column:
        start = done["at"] + F.length(m["gap"])
        end = start + F.length(m["all"])
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(done["out"], hit)).otherwise(done["out"]).alias("out"))

    def block(done: Column, ms: Column) -> Column:
        at = F.when(F.size(done) > 0, F.element_at(done, -1)["at"]).otherwise(F.lit(0))
        return F.concat(done, F.array(F.aggregate(ms, F.struct(at.alias("at"), nothing.alias("out")), one)))

    summed = F.aggregate(blocks, F.array().cast(f"array<struct<at:int,out:array<{span}>>>"), block)
    return F.flatten(F.transform(summed, lambda b: b["out"]))


def _live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return (F.length(value) >= 16) & varied & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _candidate(k: int):
    def of(x: Column) -> Column:
        value = x["value"]
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.sha2(value.cast("binary"), 256).alias("hash"), _live(value).alias("live"), _mixed(value).alias("mixed"))

    return of


def secret_scan(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), widely: int = WIDELY, many: int = MANY) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    spans has kind:start:end of all spans (code points, end exclusive), by start and then kind; base_sha256 is of
    the base ones alone.  n_live and n_example count spans whose value is live and owner-specific, or widely copied.
    A null text counts as empty: no spans, and the checksum of an empty string.  A null owner or repository counts as
    one of its own.  Repeated rows each give a row, null doc_ids too; an empty table gives none.  Columns that
    `owner` and `repository` don't name are not read.  All of a text is read, however long.
    """
    s = Scratch(spark, "secrets")
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"),
    )
    spans = []
    for k, sieve in enumerate(SIEVES):
        # The sieve is a column of its own, so that a text without a match isn't cut up.
        found = F.when(F.col("text").rlike(sieve), F.transform(_found(F.col("text"), k), _candidate(k)))
        spans.append(F.coalesce(found, F.array().cast("array<struct<kind:int,start:int,end:int,hash:string,live:boolean,mixed:boolean>>")))
    rows = s.write(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.concat(*spans).alias("found")), "rows")

    each = rows.select("row", "owner", "repository", F.explode("found").alias("x")).select("row", "owner", "repository", "x.*")
    # A bare span that a base span overlaps is no span of its own: base spans seen from the left and from the right.
    along = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 3
    reached = F.max(F.when(base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    each = each.withColumn("free", free).where(base | (F.col("free") & F.col("mixed"))).drop("free", "mixed")
    each = s.write(each, "spans")
    held = each.select("hash", "owner", "repository").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    held = s.write(held.select("hash", ((F.col("owners") >= widely) | (F.col("repositories") >= many)).alias("example")), "ownership")
    s.keep_only("rows", "spans", "ownership")
    known = each.join(held, "hash").select("row", "kind", "start", "end", "example", (~F.col("example") & F.col("live")).alias("live"))
    known = known.where((F.col("kind") < 3) | F.col("live"))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    text = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    listed = lambda x: F.array_join(F.transform(F.sort_array(x), lambda v: v["text"]), ",")
    item = F.struct("start", "kind", text.alias("text"))
    count = lambda c: F.count(F.when(c, 1))
    of = known.groupBy("row").agg(
        *[count(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(3)], count(F.col("live")).alias("n_live"), count(F.col("example")).alias("n_example"),
        F.collect_list(item).alias("every"), F.collect_list(F.when(F.col("kind") < 3, item)).alias("base"),
    )
    of = of.withColumn("spans", listed(F.col("every"))).withColumn("base", listed(F.col("base"))).drop("every")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("row", "doc_id").join(of, "row", "left").select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(empty("base").cast("binary"), 256).alias("base_sha256"), empty("spans").alias("spans"), zero("n_live"), zero("n_example"))


QUERY = "op10_secret_scan"


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        p = quoted(pattern)
        parts.append(f"""
SELECT r, {k} AS kind, '{name}' AS name, hi - length(m) AS s, hi AS e, v FROM (
  SELECT r, m, v, (sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS hi FROM (
    SELECT r, unnest(ms) AS m, unnest(gs[:len(ms)]) AS gap, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT r, string_split_regex(t, {p}) AS gs, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs FROM d WHERE regexp_matches(t, {p}))))
WHERE length(v) >= {least}""")
    listed = "coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, coalesce(lang, '') AS l FROM documents),
c AS ({" UNION ALL ".join(parts)}),
x AS (SELECT c.*, o, l, length(v) >= 16 AND len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{PLACEHOLDER}') AS live
      FROM c JOIN d USING (r) WHERE kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
      AND NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.kind < 3 AND b.s < c.e AND c.s < b.e))),
h AS (SELECT v, count(DISTINCT o) >= {WIDELY} OR count(DISTINCT (o, l)) >= {MANY} AS example FROM x GROUP BY v),
k AS (SELECT x.*, example, NOT example AND live AS own FROM x JOIN h USING (v) WHERE kind < 3 OR (NOT example AND live))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
sha256({listed.format(" FILTER (kind < 3)")}) AS base_sha256, {listed.format(" FILTER (kind IS NOT NULL)")} AS spans,
count(*) FILTER (own) AS n_live, count(*) FILTER (example) AS n_example FROM d LEFT JOIN k USING (r) GROUP BY r
"""


ORACLE = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

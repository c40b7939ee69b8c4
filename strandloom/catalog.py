"""Queries over the sample tables, one for each operator, with the SQL that says the same.

Streams are ordered by unique keys and cut into chunks by ranges of the key, so plans are the ones that large tables
get: scans with the two or three columns they need, one exchange by chunk, windows within chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import scratch_dir, stream, table
from .functions import statistics as st
from .operators import backends, clustering, dictionary, nested, numeric, relational, segmenters, selectors, structure
from .plans import graph, search
from .sources import csv_text, json_text, layout, layout_vm, messages
from .streaming import chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **types: str):
    """Registers a query; `types` are casts of the SQL's columns to the query's types."""

    def add(f):
        QUERIES[name] = f
        if sql and types:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'{c}::{t} AS {c}' for c, t in types.items())}) FROM ({sql})"
        elif sql:
            ORACLES[name] = sql
        return f

    return add


def _div(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n)


def _stream_sql(table_: str, key: str, n: int, value: str) -> str:
    return f"s AS (SELECT {key} // {n} AS chunk_id, row_number() OVER (PARTITION BY {key} // {n} ORDER BY {key}) - 1 AS pos, {value} AS v FROM {table_})"


def orders(spark, d, n: int = 4096, value: Column | str = "o_custkey") -> DataFrame:
    return stream(table(spark, d, "orders"), value, "o_orderkey", _div("o_orderkey", n))


ORDERS = _stream_sql("orders", "o_orderkey", 4096, "o_custkey")
W = "(PARTITION BY chunk_id ORDER BY pos)"
CUSTOMERS = _stream_sql("customer", "c_custkey", 512, "c_name")


def customers(spark, d, n: int = 512, value: Column | str = "c_name") -> DataFrame:
    return stream(table(spark, d, "customer"), value, "c_custkey", _div("c_custkey", n))


# Numeric transforms

DELTAS = f"d AS (SELECT chunk_id, pos - 1 AS pos, v - lag(v) OVER {W} AS v FROM s QUALIFY pos > 0)"


@query("delta_encode", f"WITH {ORDERS}, {DELTAS} SELECT chunk_id, pos, v FROM d")
def _(spark, d):
    return numeric.Delta().encode(orders(spark, d))["deltas"]


@query("delta_header", f"WITH {ORDERS} SELECT chunk_id, v AS first FROM s WHERE pos = 0")
def _(spark, d):
    return numeric.Delta().encode(orders(spark, d)).header


@query("delta_decode", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    c = numeric.Delta()
    return c.decode(c.encode(orders(spark, d)))


@query("zigzag_encode", f"WITH {ORDERS}, {DELTAS} SELECT chunk_id, pos, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS v FROM d")
def _(spark, d):
    return numeric.ZigZag().encode(numeric.Delta().encode(orders(spark, d))["deltas"])["v"]


@query("zigzag_decode", f"WITH {ORDERS}, {DELTAS} SELECT chunk_id, pos, v FROM d")
def _(spark, d):
    z = numeric.ZigZag()
    return z.decode(z.encode(numeric.Delta().encode(orders(spark, d))["deltas"]))


WIDTH = "CASE WHEN {0} < 256 THEN 8 WHEN {0} < 65536 THEN 16 WHEN {0} < 4294967296 THEN 32 ELSE 64 END"


@query("range_pack_encode", f"WITH {ORDERS} SELECT chunk_id, pos, v - min(v) OVER (PARTITION BY chunk_id) AS v FROM s")
def _(spark, d):
    return numeric.RangePack().encode(orders(spark, d))["v"]


@query("range_pack_header", f"WITH {ORDERS} SELECT chunk_id, min(v) AS low, {WIDTH.format('max(v) - min(v)')} AS packed_width FROM s GROUP BY chunk_id")
def _(spark, d):
    return numeric.RangePack().header(orders(spark, d))


@query("range_pack_decode", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    c = numeric.RangePack()
    return c.decode(c.encode(orders(spark, d)))


SIXES = _stream_sql("part", "p_partkey", 256, "p_size * 6")


def _sixes(spark, d):
    return stream(table(spark, d, "part"), F.col("p_size").cast("long") * 6, "p_partkey", _div("p_partkey", 256))


DIVISOR = "SELECT chunk_id, CASE WHEN count(*) <= 1 THEN 1 ELSE list_reduce(list(v), lambda a, b: gcd(a, b)) END AS divisor FROM s GROUP BY chunk_id"


@query("divide_by_header", f"WITH {SIXES} {DIVISOR}")
def _(spark, d):
    return numeric.DivideBy().header(_sixes(spark, d))


@query("divide_by_encode", f"WITH {SIXES}, h AS ({DIVISOR}) SELECT chunk_id, pos, v // divisor AS v FROM s JOIN h USING (chunk_id)")
def _(spark, d):
    return numeric.DivideBy().encode(_sixes(spark, d))["v"]


@query("divide_by_given", f"WITH {SIXES} SELECT chunk_id, pos, v // 3 AS v FROM s", v="BIGINT")
def _(spark, d):
    return numeric.DivideBy(3).encode(_sixes(spark, d))["v"]


def _floats(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.posexplode("embedding").alias("pos", "v"))
    return numeric.FloatDeconstruct.of_floats(x.withColumn("pos", F.col("pos").cast("long")))


FLOATS = "s AS (SELECT vec_id AS chunk_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::FLOAT::BIT::INT::BIGINT & 4294967295 AS v FROM embeddings)"


@query("float32_deconstruct", f"WITH {FLOATS} SELECT chunk_id, pos, (v >> 23) & 255 AS exponent, ((v & 8388607) << 1) | (v >> 31) AS sign_fraction FROM s")
def _(spark, d):
    e = numeric.FloatDeconstruct().encode(_floats(spark, d))
    return e["exponent"].withColumnRenamed("v", "exponent").join(e["sign_fraction"].withColumnRenamed("v", "sign_fraction"), ["chunk_id", "pos"])


@query("float32_round_trip", f"WITH {FLOATS} SELECT * FROM s")
def _(spark, d):
    c = numeric.FloatDeconstruct()
    return c.decode(c.encode(_floats(spark, d)))


for _kind, (_e, _f) in {"bfloat16": (8, 7), "float16": (5, 10)}.items():

    @query(f"{_kind}_deconstruct", f"WITH {ORDERS}, b AS (SELECT chunk_id, pos, v * 7919 % 65536 AS v FROM s) SELECT chunk_id, pos, (v >> {_f}) & {(1 << _e) - 1} AS exponent, ((v & {(1 << _f) - 1}) << 1) | (v >> 15) AS sign_fraction FROM b")
    def _(spark, d, kind=_kind):
        e = numeric.FloatDeconstruct(kind).encode(orders(spark, d, value=F.col("o_custkey") * 7919 % 65536))
        return e["exponent"].withColumnRenamed("v", "exponent").join(e["sign_fraction"].withColumnRenamed("v", "sign_fraction"), ["chunk_id", "pos"])


ORDERS64 = _stream_sql("orders", "o_orderkey", 64, "o_custkey")
RUNS = f"r AS (SELECT *, sum(falls) OVER {W} AS run FROM (SELECT *, CASE WHEN v <= lag(v) OVER {W} THEN 1 ELSE 0 END AS falls FROM s))"


@query("merge_sorted_encode", f"""WITH {ORDERS64}, {RUNS}, m AS (SELECT chunk_id, v, bit_or(CASE WHEN run = 63 THEN -9223372036854775808 ELSE 1::BIGINT << run::INT END) AS bits FROM r GROUP BY chunk_id, v)
SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY v) - 1 AS pos, v, bits FROM m""")
def _(spark, d):
    e = numeric.MergeSorted().encode(orders(spark, d, 64))
    return e["values"].join(e["bits"].withColumnRenamed("v", "bits"), ["chunk_id", "pos"])


@query("merge_sorted_decode", f"WITH {ORDERS64} SELECT * FROM s")
def _(spark, d):
    c = numeric.MergeSorted()
    return c.decode(c.encode(orders(spark, d, 64)))


@query("merge_sorted_choice", f"WITH {_stream_sql('orders', 'o_orderkey', 128, 'o_custkey')}, {RUNS} SELECT chunk_id, CASE WHEN max(run) < 64 THEN 'merge_sorted' ELSE 'backup' END AS choice FROM r GROUP BY chunk_id")
def _(spark, d):
    return numeric.merge_sorted_or_backup(orders(spark, d, 128))


LOG2 = "(length(bin(v)) - 1)"


@query("quantize_offsets", f"WITH {ORDERS}, p AS (SELECT chunk_id, pos, v + 1 AS v FROM s) SELECT chunk_id, pos, {LOG2} AS code, v - (1::BIGINT << {LOG2}) AS extra, {LOG2} AS bits FROM p", bits="INTEGER")
def _(spark, d):
    e = numeric.Quantize("offsets").encode(orders(spark, d, value=F.col("o_custkey") + 1))
    return e["codes"].withColumnRenamed("v", "code").join(e["extra"].withColumnRenamed("v", "extra"), ["chunk_id", "pos"])


@query("quantize_lengths", f"""WITH {ORDERS} SELECT chunk_id, pos, CASE WHEN v < 16 THEN v ELSE {LOG2} + 12 END AS code, CASE WHEN v < 16 THEN 0 ELSE v - (1::BIGINT << {LOG2}) END AS extra,
CASE WHEN v < 16 THEN 0 ELSE {LOG2} END AS bits FROM s""", bits="INTEGER")
def _(spark, d):
    e = numeric.Quantize("lengths").encode(orders(spark, d))
    return e["codes"].withColumnRenamed("v", "code").join(e["extra"].withColumnRenamed("v", "extra"), ["chunk_id", "pos"])


@query("quantize_round_trip", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    c = numeric.Quantize("lengths")
    return c.decode(c.encode(orders(spark, d)))


@query("bitpack_size", f"WITH {ORDERS} SELECT chunk_id, length(bin(max(v))) AS bits, (count(*) * length(bin(max(v))) + 7) // 8 AS bytes FROM s GROUP BY chunk_id", bits="INTEGER")
def _(spark, d):
    return numeric.BitPack.size(orders(spark, d))


@query("bitpack_round_trip", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    c = numeric.BitPack()
    return c.decode(c.encode(orders(spark, d)))


@query("bitunpack", f"WITH {ORDERS}, b AS (SELECT chunk_id, pos, unnest([0, 1]) AS half, v % 256 AS v FROM s) SELECT chunk_id, pos * 2 + half AS pos, CASE WHEN half = 0 THEN v & 15 ELSE v >> 4 END AS v FROM b")
def _(spark, d):
    s = orders(spark, d, value=F.unhex(F.lpad(F.hex(F.col("o_custkey") % 256), 2, "0")))
    return numeric.BitUnpack(4).encode(structure.joined_bytes(s, s.select("chunk_id").distinct()))["v"]


MIXED = _stream_sql("part", "p_partkey", 256, "CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN split_part(p_brand, '#', 2) ELSE '0' || p_size END")
CANONICAL = "regexp_full_match(v, '0|-?[1-9][0-9]*') AND TRY_CAST(v AS BIGINT) IS NOT NULL"


def _mixed(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.col("p_name")).when(k == 1, F.split_part("p_brand", F.lit("#"), F.lit(2))).otherwise(F.concat(F.lit("0"), F.col("p_size").cast("string")))
    return stream(table(spark, d, "part"), text, "p_partkey", _div("p_partkey", 256))


@query("parse_int", f"WITH {MIXED} SELECT chunk_id, pos, v::BIGINT AS v FROM s WHERE {CANONICAL}")
def _(spark, d):
    return numeric.ParseInt().encode(_mixed(spark, d))["v"].where("v IS NOT NULL")


for _name, _which, _n in (("numbers", CANONICAL, "v::BIGINT"), ("exceptions", f"NOT ({CANONICAL})", "v")):

    @query(f"try_parse_int_{_name}", f"WITH {MIXED} SELECT chunk_id, row_number() OVER {W} - 1 AS pos, {_n} AS v FROM s WHERE {_which}")
    def _(spark, d, name=_name):
        return numeric.TryParseInt().encode(_mixed(spark, d))[name]


@query("try_parse_int_route", f"WITH {MIXED} SELECT chunk_id, CASE WHEN bool_and({CANONICAL}) THEN 'numbers' WHEN bool_or({CANONICAL}) THEN 'mixed' ELSE 'strings' END AS choice FROM s GROUP BY chunk_id")
def _(spark, d):
    return numeric.TryParseInt.route(_mixed(spark, d))


@query("try_parse_int_decode", f"WITH {MIXED} SELECT * FROM s")
def _(spark, d):
    c = numeric.TryParseInt()
    return c.decode(c.encode(_mixed(spark, d)))


@query("ycocg", f"""WITH {_stream_sql('part', 'p_partkey', 256, 'p_partkey')}, x AS (SELECT chunk_id, pos, v * 37 % 256 AS r, v * 11 % 256 AS g, v % 256 AS b FROM s),
t AS (SELECT *, r - b AS co, b + ((r - b) >> 1) AS t FROM x) SELECT chunk_id, pos, t + ((g - t) >> 1) AS y, co, g - t AS cg FROM t""")
def _(spark, d):
    key = F.col("p_partkey")
    e = numeric.YCoCg().encode(*(stream(table(spark, d, "part"), v % 256, "p_partkey", _div("p_partkey", 256)) for v in (key * 37, key * 11, key)))
    out = None
    for name, s in e.streams.items():
        part = s.withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["chunk_id", "pos"])
    return out


# Dictionaries, constants, duplicates, prefixes

PRIORITIES = _stream_sql("orders", "o_orderkey", 4096, "o_orderpriority")
FIRST_SEEN = "a AS (SELECT chunk_id, v, row_number() OVER (PARTITION BY chunk_id ORDER BY min(pos)) - 1 AS token FROM s GROUP BY chunk_id, v)"
SORTED = "a AS (SELECT chunk_id, v, row_number() OVER (PARTITION BY chunk_id ORDER BY v) - 1 AS token FROM s GROUP BY chunk_id, v)"

for _name, _rank, _source, _value in (("first_seen", FIRST_SEEN, PRIORITIES, "o_orderpriority"), ("sorted", SORTED, PRIORITIES, "o_orderpriority"), ("numeric_first_seen", FIRST_SEEN, ORDERS, "o_custkey"), ("numeric_sorted", SORTED, ORDERS, "o_custkey")):

    @query(f"tokenize_{_name}_indices", f"WITH {_source}, {_rank} SELECT chunk_id, pos, token AS v FROM s JOIN a USING (chunk_id, v)")
    def _(spark, d, value=_value, sort=_name.endswith("sorted")):
        return dictionary.Tokenize(sort).encode(orders(spark, d, value=value))["indices"]

    @query(f"tokenize_{_name}_alphabet", f"WITH {_source}, {_rank} SELECT chunk_id, token AS pos, v FROM a")
    def _(spark, d, value=_value, sort=_name.endswith("sorted")):
        return dictionary.Tokenize(sort).encode(orders(spark, d, value=value))["alphabet"]


@query("tokenize_custom_order", f"WITH {PRIORITIES} SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY length(v), v) - 1 AS pos, v FROM s GROUP BY chunk_id, v")
def _(spark, d):
    return dictionary.Tokenize(sort_key=F.length).encode(orders(spark, d, value="o_orderpriority"))["alphabet"]


@query("tokenize_index_width", f"WITH {ORDERS} SELECT chunk_id, CASE WHEN count(DISTINCT v) <= 256 THEN 8 WHEN count(DISTINCT v) <= 65536 THEN 16 ELSE 32 END AS index_width FROM s GROUP BY chunk_id")
def _(spark, d):
    return dictionary.Tokenize.index_width(orders(spark, d))


@query("tokenize_decode", f"WITH {PRIORITIES} SELECT * FROM s")
def _(spark, d):
    c = dictionary.Tokenize()
    return c.decode(c.encode(orders(spark, d, value="o_orderpriority")))


@query("constant_check", f"WITH {_stream_sql('customer', 'c_custkey', 4, 'c_nationkey % 3')} SELECT chunk_id, min(v) = max(v) AS ok FROM s GROUP BY chunk_id")
def _(spark, d):
    return dictionary.Constant().check(customers(spark, d, 4, F.col("c_nationkey") % 3))


@query("constant_encode", "SELECT c_custkey // 8 AS chunk_id, max(c_custkey // 8) AS v, count(*) AS n FROM customer GROUP BY c_custkey // 8")
def _(spark, d):
    e = dictionary.Constant().encode(customers(spark, d, 8, _div("c_custkey", 8)))
    return e["v"].drop("pos").join(e.header, "chunk_id")


@query("constant_decode", "SELECT c_custkey // 8 AS chunk_id, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) - 1 AS pos, c_custkey // 8 AS v FROM customer")
def _(spark, d):
    c = dictionary.Constant()
    return c.decode(c.encode(customers(spark, d, 8, _div("c_custkey", 8))))


@query("dedup_check", f"WITH {ORDERS} SELECT chunk_id, bool_and(pos <> 7 OR v % 2 = 0) AS ok FROM s GROUP BY chunk_id")
def _(spark, d):
    s = orders(spark, d)
    other = s.withColumn("v", F.when((F.col("pos") == 7) & (F.col("v") % 2 != 0), F.col("v") + 1).otherwise(F.col("v")))
    return dictionary.Dedup().check(s, other)


LCP = f"l AS (SELECT chunk_id, pos, v, coalesce(len(list_filter(range(1, least(length(v), length(p)) + 1), lambda i: substr(v, 1, i) = substr(p, 1, i))), 0) AS n FROM (SELECT *, lag(v) OVER {W} AS p FROM s))"


@query("prefix_encode", f"WITH {CUSTOMERS}, {LCP} SELECT chunk_id, pos, n AS shared, substr(v, n + 1) AS suffix FROM l")
def _(spark, d):
    e = dictionary.Prefix().encode(customers(spark, d))
    return e["lengths"].withColumnRenamed("v", "shared").join(e["suffixes"].select("chunk_id", "pos", F.col("v").cast("string").alias("suffix")), ["chunk_id", "pos"])


@query("prefix_decode", f"WITH {CUSTOMERS} SELECT * FROM s")
def _(spark, d):
    c = dictionary.Prefix()
    return c.decode(c.encode(customers(spark, d)))


@query("flatpack_size", f"WITH {ORDERS}, x AS (SELECT chunk_id, count(*) AS n, count(DISTINCT v % 37) AS k FROM s GROUP BY chunk_id) SELECT chunk_id, 1 + ((CASE WHEN k > 1 THEN length(bin(k - 1)) ELSE 0 END) * n) // 8 + k AS bytes FROM x")
def _(spark, d):
    return dictionary.FlatPack.size(orders(spark, d, value=F.col("o_custkey") % 37))


@query("flatpack_round_trip", f"WITH {ORDERS} SELECT chunk_id, pos, v % 37 AS v FROM s")
def _(spark, d):
    c = dictionary.FlatPack()
    return c.decode(c.encode(orders(spark, d, value=F.col("o_custkey") % 37)))


# Structure


def _records(spark, d, width: int = 32, big: bool = False) -> DataFrame:
    return orders(spark, d, value=structure.number_to_bytes(F.col("o_custkey"), width, big))


for _width in (8, 16, 32, 64):
    for _big in (False, True):

        @query(f"convert_struct_to_num_{'be' if _big else 'le'}{_width}", f"WITH {ORDERS} SELECT chunk_id, pos, v & {(1 << min(_width, 63)) - 1} AS v FROM s")
        def _(spark, d, width=_width, big=_big):
            return structure.RecordsToNumbers(width, big).encode(_records(spark, d, width, big))["v"]

        @query(f"convert_serial_to_num_{'be' if _big else 'le'}{_width}", f"WITH {ORDERS} SELECT chunk_id, pos, v & {(1 << min(_width, 63)) - 1} AS v FROM s")
        def _(spark, d, width=_width, big=_big):
            r = _records(spark, d, width, big)
            return structure.SerialToNumbers(width, big, width == 64).encode(structure.joined_bytes(r, r.select("chunk_id").distinct()))["v"]


@query("convert_num_to_struct_le", f"WITH {ORDERS} SELECT chunk_id, pos, array_to_string(list_transform([0, 8, 16, 24], lambda k: printf('%02X', (v >> k) & 255)), '') AS v FROM s")
def _(spark, d):
    return _records(spark, d).withColumn("v", F.hex("v"))


@query("convert_serial_to_struct", f"WITH {CUSTOMERS} SELECT chunk_id, pos * 3 + k AS pos, substr(v, k * 6 + 1, 6) AS v FROM s, (SELECT unnest([0, 1, 2]) AS k)")
def _(spark, d):
    s = customers(spark, d, value=F.col("c_name").cast("binary"))
    e = structure.SerialToRecords(6).encode(structure.joined_bytes(s, s.select("chunk_id").distinct()))
    return e["v"].withColumn("v", F.col("v").cast("string"))


TEXTS = _stream_sql("documents", "doc_id", 64, "text")


def _texts(spark, d):
    return stream(table(spark, d, "documents"), "text", "doc_id", _div("doc_id", 64))


@query("separate_string_lengths", f"WITH {TEXTS} SELECT chunk_id, pos, strlen(v) AS v FROM s")
def _(spark, d):
    return structure.SeparateStrings().encode(_texts(spark, d))["lengths"]


@query("separate_string_content", f"WITH {TEXTS} SELECT chunk_id, string_agg(v, '' ORDER BY pos) AS v FROM s GROUP BY chunk_id")
def _(spark, d):
    return structure.SeparateStrings().encode(_texts(spark, d))["content"].select("chunk_id", F.col("v").cast("string").alias("v"))


@query("set_string_lengths", f"WITH {TEXTS} SELECT * FROM s")
def _(spark, d):
    e = structure.SeparateStrings().encode(_texts(spark, d))
    return structure.SetStringLengths().encode(e["content"], e["lengths"])["v"].withColumn("v", F.col("v").cast("string"))


@query("transpose_split", f"WITH {ORDERS} SELECT chunk_id, pos, {', '.join(f'(v >> {8 * k}) & 255 AS byte_{k}' for k in range(4))} FROM s")
def _(spark, d):
    e = structure.TransposeSplit(32).encode(orders(spark, d))
    out = e["byte_0"].withColumnRenamed("v", "byte_0")
    for k in range(1, 4):
        out = out.join(e[f"byte_{k}"].withColumnRenamed("v", f"byte_{k}"), ["chunk_id", "pos"])
    return out


@query("transpose_merge", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    c = structure.TransposeSplit(64)
    return c.decode(c.encode(orders(spark, d)))


@query("split_by_struct", f"WITH {CUSTOMERS} SELECT chunk_id, pos, substr(v, 1, 8) AS field_0, substr(v, 9, 1) AS field_1, substr(v, 10, 9) AS field_2 FROM s")
def _(spark, d):
    e = structure.SplitByStruct([8, 1, 9]).encode(customers(spark, d, value=F.col("c_name").cast("binary")))
    out = None
    for k in range(3):
        part = e[f"field_{k}"].select("chunk_id", "pos", F.col("v").cast("string").alias(f"field_{k}"))
        out = part if out is None else out.join(part, ["chunk_id", "pos"])
    return out


@query("split_segments", f"WITH {ORDERS} SELECT chunk_id, CASE WHEN pos < 100 THEN 0 WHEN pos < 1000 THEN 1 ELSE 2 END AS segment, CASE WHEN pos < 100 THEN pos WHEN pos < 1000 THEN pos - 100 ELSE pos - 1000 END AS pos, v FROM s")
def _(spark, d):
    e = structure.SplitN([100, 900, 0]).encode(orders(spark, d))
    out = None
    for k in range(3):
        part = e[f"segment_{k}"].withColumn("segment", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


EVENTS = _stream_sql("events", "event_id", 2048, "event_type")


def _events(spark, d, value: Column | str = "event_type"):
    return stream(table(spark, d, "events"), value, "event_id", _div("event_id", 2048))


@query("dispatch_by_tag", f"WITH {_stream_sql('events', 'event_id', 2048, 'user_id')} SELECT chunk_id, v % 5 AS tag, row_number() OVER (PARTITION BY chunk_id, v % 5 ORDER BY pos) - 1 AS pos, v FROM s")
def _(spark, d):
    s = _events(spark, d, "user_id")
    x = structure.DispatchByTag(5).routed(s, s.withColumn("v", F.col("v") % 5))
    return x.select("chunk_id", "tag", F.col("at").alias("pos"), "v")


@query("dispatch_string_decode", f"WITH {EVENTS} SELECT * FROM s")
def _(spark, d):
    s = _events(spark, d)
    c = structure.DispatchString(3)
    return c.decode(c.encode(s, s.withColumn("v", F.length("v") % 3)))


CONCAT = """WITH c AS (SELECT 0 AS k, row_number() OVER (ORDER BY c_custkey) AS p, c_name AS v FROM customer UNION ALL SELECT 1, row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier)
SELECT 0 AS chunk_id, row_number() OVER (ORDER BY k, p) - 1 AS pos, v FROM c"""


def _names(spark, d):
    return stream(table(spark, d, "customer"), "c_name", "c_custkey"), stream(table(spark, d, "supplier"), "s_name", "s_suppkey")


@query("concat_streams", CONCAT, chunk_id="BIGINT")
def _(spark, d):
    return structure.Concat().encode(*_names(spark, d))["v"]


@query("concat_sizes", "SELECT 0 AS chunk_id, 0 AS pos, count(*) AS v FROM customer UNION ALL SELECT 0, 1, count(*) FROM supplier", chunk_id="BIGINT", pos="BIGINT")
def _(spark, d):
    return structure.Concat().encode(*_names(spark, d))["sizes"]


@query("interleave_streams", "SELECT 0 AS chunk_id, (row_number() OVER (ORDER BY n_nationkey) - 1) * 2 + j AS pos, CASE WHEN j = 0 THEN n_name ELSE lower(n_name) END AS v FROM nation, (SELECT unnest([0, 1]) AS j) QUALIFY true".replace("row_number() OVER (ORDER BY n_nationkey)", "row_number() OVER (PARTITION BY j ORDER BY n_nationkey)"), chunk_id="BIGINT")
def _(spark, d):
    s = stream(table(spark, d, "nation"), "n_name", "n_nationkey")
    return structure.Interleave().encode(s, s.withColumn("v", F.lower("v")))["v"]


# Statistics

QUANTITIES = "s AS (SELECT l_orderkey // 4096 AS chunk_id, l_quantity::BIGINT AS v FROM lineitem)"


def _quantities(spark, d):
    """A bag is enough for statistics: places aren't looked at."""
    return table(spark, d, "lineitem").select(_div("l_orderkey", 4096).alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.col("l_quantity").cast("long").alias("v"))


@query("histogram", f"WITH {QUANTITIES} SELECT chunk_id, v, count(*) AS n FROM s GROUP BY chunk_id, v")
def _(spark, d):
    return st.histogram(_quantities(spark, d))


H = "SELECT chunk_id, sum(c) AS n, count(*) AS k, max(v) AS top, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT chunk_id, v, count(*) AS c FROM {} GROUP BY chunk_id, v) GROUP BY chunk_id"


@query("entropy", f"WITH {QUANTITIES}, h AS ({H.format('s')}) SELECT chunk_id, round(h, 9) AS entropy FROM h")
def _(spark, d):
    return st.entropy(_quantities(spark, d)).withColumn("entropy", F.round("entropy", 9))


@query("cardinality", f"WITH {ORDERS} SELECT chunk_id, count(DISTINCT v) AS cardinality FROM s GROUP BY chunk_id")
def _(spark, d):
    return st.cardinality(orders(spark, d))


@query("unsigned_range", f"WITH {ORDERS} SELECT chunk_id, min(v) AS low, max(v) AS high FROM s GROUP BY chunk_id")
def _(spark, d):
    return st.unsigned_range(orders(spark, d))


MOMENTS = """SELECT chunk_id, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(var_samp(v), 0), 6) AS variance, round(coalesce(stddev_samp(v), 0), 6) AS stddev,
CASE WHEN count(*) <= 1 THEN 0 WHEN var_pop(v) = 0 THEN NULL ELSE round((avg(v::DOUBLE ** 3) - 3 * avg(v) * avg(v::DOUBLE ** 2) + 2 * avg(v) ** 3) / stddev_pop(v) ** 3, 6) END AS skewness,
CASE WHEN count(*) <= 1 THEN 0 WHEN var_pop(v) = 0 THEN NULL ELSE round((avg(v::DOUBLE ** 4) - 4 * avg(v) * avg(v::DOUBLE ** 3) + 6 * avg(v) ** 2 * avg(v::DOUBLE ** 2) - 3 * avg(v) ** 4) / var_pop(v) ** 2 - 3, 6) END AS kurtosis FROM s GROUP BY chunk_id"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


MOMENT_NAMES = ("mean", "variance", "stddev", "skewness", "kurtosis")


@query("moments", f"WITH {QUANTITIES} {MOMENTS}")
def _(spark, d):
    return _rounded(st.moments(_quantities(spark, d)), *MOMENT_NAMES)


@query("feature_vector", f"""WITH {QUANTITIES}, m AS ({MOMENTS}), c AS (SELECT chunk_id, count(DISTINCT v) AS cardinality, max(v) - min(v) AS range_size FROM s GROUP BY chunk_id)
SELECT chunk_id, n, 8 AS width, cardinality, cardinality AS cardinality_low, cardinality AS cardinality_high, range_size, mean, variance, stddev, skewness, kurtosis FROM m JOIN c USING (chunk_id)""")
def _(spark, d):
    return _rounded(st.feature_vector(_quantities(spark, d)), *MOMENT_NAMES)


@query("numeric_summary", f"WITH {ORDERS} SELECT chunk_id, sum(v) AS total, max(v) AS top, max(v) < 1000 AS under_limit, {WIDTH.format('max(v)')} AS smallest_width FROM s GROUP BY chunk_id", total="BIGINT")
def _(spark, d):
    return st.numeric_summary(orders(spark, d), 1000)


@query("byte_swap", f"WITH {ORDERS} SELECT chunk_id, pos, ((v & 255) << 24) | ((v & 65280) << 8) | ((v >> 8) & 65280) | ((v >> 24) & 255) AS v FROM s")
def _(spark, d):
    return orders(spark, d).withColumn("v", st.byte_swapped(F.col("v"), 32))


GAPS = "g AS (SELECT chunk_id, gap, count(*) AS n FROM (SELECT chunk_id, pos - lag(pos) OVER (PARTITION BY chunk_id, v ORDER BY pos) AS gap FROM s) WHERE gap <= 1024 GROUP BY chunk_id, gap)"


@query("strides", f"""WITH {_stream_sql('orders', 'o_orderkey', 4096, 'o_orderkey % 12 * 1000')}, {GAPS},
p AS (SELECT a.chunk_id, a.gap AS stride FROM g a LEFT JOIN g b ON a.chunk_id = b.chunk_id AND abs(a.gap - b.gap) = 1 GROUP BY a.chunk_id, a.gap, a.n HAVING a.n > coalesce(sum(b.n), 0)),
x AS (SELECT p.chunk_id, stride, sum(n) AS share FROM p JOIN g ON p.chunk_id = g.chunk_id AND gap % stride = 0 GROUP BY p.chunk_id, stride QUALIFY row_number() OVER (PARTITION BY p.chunk_id ORDER BY share DESC, stride) = 1),
m AS (SELECT chunk_id, sum(n) AS matches FROM g GROUP BY chunk_id)
SELECT c.chunk_id, stride, share, CASE WHEN share IS NOT NULL THEN matches END AS matches, CASE WHEN share IS NULL THEN 'none' WHEN share > matches / 16 THEN 'likely' ELSE 'possible' END AS verdict
FROM (SELECT DISTINCT chunk_id FROM s) c LEFT JOIN x USING (chunk_id) LEFT JOIN m USING (chunk_id)""", share="BIGINT", matches="BIGINT")
def _(spark, d):
    return st.strides(orders(spark, d, value=F.col("o_orderkey") % 12 * 1000))


BYTES = _stream_sql("orders", "o_orderkey", 4096, "(o_custkey * o_custkey) % 61")


def _bytes(spark, d):
    return orders(spark, d, value=F.col("o_custkey") * F.col("o_custkey") % 61)


SIZES = """x AS (SELECT *, CASE WHEN k = 1 THEN 1 + greatest(1, (length(bin(n::BIGINT)) + 6) // 7) ELSE 4611686018427387904 END AS constant_size,
(n * (CASE WHEN top = 0 THEN 0 ELSE length(bin(top)) END) + 7) // 8 AS bitpacked_size, (n * (CASE WHEN k <= 1 THEN 0 ELSE length(bin(k - 1)) END) + 7) // 8 + k AS flatpacked_size,
CASE WHEN h > 7 THEN n ELSE floor(greatest(h, 1) * n / 8) END AS huffman_size, (floor(h * n) + 7) // 8 AS fse_size FROM h)"""


@query("size_estimates", f"WITH {BYTES}, h AS ({H.format('s')}), {SIZES} SELECT chunk_id, n::BIGINT AS n, k AS distinct_values, top, constant_size::BIGINT AS constant_size, bitpacked_size::BIGINT AS bitpacked_size, flatpacked_size::BIGINT AS flatpacked_size, huffman_size::BIGINT AS huffman_size FROM x")
def _(spark, d):
    x = st.byte_statistics(_bytes(spark, d))
    return x.select("chunk_id", "n", F.col("distinct").alias("distinct_values"), "top", *[F.col(c).cast("long").alias(c) for c in ("constant_size", "bitpacked_size", "flatpacked_size", "huffman_size")])


@query("entropy_backend_choice", f"""WITH {BYTES}, h AS ({H.format('s')}), {SIZES},
e AS (SELECT *, CASE WHEN fse_size + n // 32 < huffman_size THEN 'fse' ELSE 'huffman' END AS coder FROM x),
b AS (SELECT *, least((CASE WHEN coder = 'fse' THEN fse_size ELSE huffman_size END) + greatest(10, k // 4), n) AS base FROM e)
SELECT chunk_id, CASE WHEN n <= 1 THEN 'store' WHEN k = 1 THEN 'constant' WHEN least(bitpacked_size, flatpacked_size) < base THEN CASE WHEN bitpacked_size <= flatpacked_size THEN 'bitpack' ELSE 'flatpack' END
WHEN n <= base THEN 'store' ELSE coder END AS choice FROM b""")
def _(spark, d):
    x = st.byte_statistics(_bytes(spark, d))
    return x.select("chunk_id", selectors.byte_backend(F.col("n"), F.col("distinct"), F.col("top"), F.col("entropy")).alias("choice"))


@query("two_byte_backend_choice", f"""WITH {ORDERS}, h AS ({H.format('s')}), x AS (SELECT *, (floor(greatest(h, 1) * n) + 7) // 8 + greatest(100, top // 4) AS huff, (n * length(bin(top)) + 7) // 8 AS bit FROM h)
SELECT chunk_id, CASE WHEN k = 1 THEN 'constant' WHEN bit <= huff AND bit < 2 * n THEN 'bitpack' WHEN h > 15 OR huff >= 2 * n THEN 'store' WHEN k < 256 THEN 'tokenize' ELSE 'huffman' END AS choice FROM x""")
def _(spark, d):
    s = orders(spark, d)
    x = st.histogram(s).groupBy("chunk_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("v").alias("top")).join(st.entropy(s), "chunk_id")
    return x.select("chunk_id", selectors.two_byte_backend(F.col("n"), F.col("k"), F.col("top"), F.col("entropy")).alias("choice"))


# Chunks by turns: one value, differences of one, nearly all one value, and many values.
_TURNS = "(o_orderkey // 512) % 4"
LITERALS = _stream_sql("orders", "o_orderkey", 512, f"CASE {_TURNS} WHEN 0 THEN 7 WHEN 1 THEN o_orderkey % 256 WHEN 2 THEN CASE WHEN o_custkey % 50 = 0 THEN o_custkey % 256 ELSE 3 END ELSE (o_custkey * o_custkey) % 61 END")


@query("literal_backend_choice", f"""WITH {LITERALS}, {DELTAS}, h AS ({H.format('s')}), {SIZES},
m AS (SELECT chunk_id, pos, ((v % 256) + 256) % 256 AS v FROM d), dh AS ({H.format('m')}),
y AS (SELECT x.chunk_id, x.n, x.k, huffman_size AS hu, CASE WHEN coalesce(dh.h, 0) > 7 THEN x.n ELSE floor(greatest(coalesce(dh.h, 0), 1) * x.n / 8) END AS du, x.flatpacked_size AS z, x.bitpacked_size AS dz FROM x LEFT JOIN dh USING (chunk_id)),
g AS (SELECT *, du + du * 4 // 100 < hu AS delta FROM y), b AS (SELECT *, CASE WHEN delta THEN du ELSE hu END AS hs, CASE WHEN delta THEN dz ELSE z END AS zs FROM g),
c AS (SELECT *, CASE WHEN hs + hs * 2 // 100 >= n THEN 'store' WHEN zs + zs * 4 // 100 < hs + hs * 2 // 100 THEN 'zstd' ELSE 'huffman' END AS best FROM b)
SELECT chunk_id, CASE WHEN k = 1 AND n > 1 THEN 'constant' WHEN n < 200 THEN 'store' WHEN delta AND best <> 'store' THEN 'delta_' || best ELSE best END AS choice FROM c""")
def _(spark, d):
    """The rule on given sizes: flat packing's and bit packing's stand for those of zstandard."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    turn = F.floor(key / 512) % 4
    value = F.when(turn == 0, 7).when(turn == 1, key % 256).when(turn == 2, F.when(customer % 50 == 0, customer % 256).otherwise(3)).otherwise(customer * customer % 61).cast("long")
    x = st.byte_statistics(orders(spark, d, 512, value))
    sizes = [F.col(c) for c in ("huffman_size", "delta_huffman_size", "flatpacked_size", "bitpacked_size")]
    return x.select("chunk_id", selectors.literal_backend(F.col("n"), F.col("distinct"), *sizes).alias("choice"))


@query("brute_force_choice", f"""WITH {BYTES}, h AS ({H.format('s')}), {SIZES}
SELECT chunk_id, CASE WHEN least(bitpacked_size, flatpacked_size, huffman_size) >= n THEN 'store' WHEN bitpacked_size <= flatpacked_size AND bitpacked_size <= huffman_size THEN 'bitpacked_size'
WHEN flatpacked_size <= huffman_size THEN 'flatpacked_size' ELSE 'huffman_size' END AS choice, least(n, bitpacked_size, flatpacked_size, huffman_size)::BIGINT AS size FROM x""")
def _(spark, d):
    x = selectors.brute_force(st.byte_statistics(_bytes(spark, d)), "n", ["bitpacked_size", "flatpacked_size", "huffman_size"])
    return x.select("chunk_id", "choice", F.col("size").cast("long").alias("size"))


TREES = {
    "features": ["cardinality", "variance"], "labels": ["small", "wide", "flat"],
    "forests": [
        [[{"feature": 0, "value": 40, "left": 1, "right": 2, "missing": 1}, {"feature": -1, "value": 1.0}, {"feature": -1, "value": -1.0}]],
        [[{"feature": 1, "value": 200, "left": 1, "right": 2, "missing": 2}, {"feature": -1, "value": 0.0}, {"feature": -1, "value": 0.75}]],
        [[{"feature": -1, "value": 0.5}]],
    ],
}


@query("boosted_trees_choice", f"""WITH {QUANTITIES}, f AS (SELECT chunk_id, count(DISTINCT v) AS c, coalesce(var_samp(v), 0) AS x FROM s GROUP BY chunk_id),
g AS (SELECT chunk_id, CASE WHEN c < 40 THEN 1.0 ELSE -1.0 END AS a, CASE WHEN x < 200 THEN 0.0 ELSE 0.75 END AS b FROM f)
SELECT chunk_id, CASE WHEN a >= b AND a >= 0.5 THEN 'small' WHEN b >= 0.5 THEN 'wide' ELSE 'flat' END AS choice FROM g""")
def _(spark, d):
    return st.feature_vector(_quantities(spark, d)).select("chunk_id", selectors.BoostedTrees(TREES).label().alias("choice"))


@query("null_aware_dispatch", f"WITH {_stream_sql('part', 'p_partkey', 256, 'CASE WHEN p_size % 4 = 0 THEN chr(0)[2:] ELSE p_type END')} SELECT chunk_id, pos, v, strlen(v) = 0 AS is_empty FROM s".replace("chr(0)[2:]", "''"))
def _(spark, d):
    s = stream(table(spark, d, "part"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")), "p_partkey", _div("p_partkey", 256))
    return selectors.null_aware(s)


@query("directed_choice", "SELECT event_id, least(user_id % 7, 3) AS way FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("tag", F.col("user_id") % 7)
    return e.select("event_id", selectors.directed(e, "tag", 4).alias("way"))


# Segments, clusters


@query("segment_numeric", f"WITH {ORDERS} SELECT chunk_id, pos // 500 AS segment, pos % 500 AS pos, v FROM s")
def _(spark, d):
    return segmenters.segment_numeric(orders(spark, d), 64, 4000)


@query("segment_lines", f"""WITH RECURSIVE {CUSTOMERS}, g AS (
SELECT chunk_id, pos, v, 0 AS segment, strlen(v) + 1 AS held FROM s WHERE pos = 0
UNION ALL SELECT s.chunk_id, s.pos, s.v, CASE WHEN held >= 2000 THEN segment + 1 ELSE segment END, CASE WHEN held >= 2000 THEN 0 ELSE held END + strlen(s.v) + 1 FROM g JOIN s ON s.chunk_id = g.chunk_id AND s.pos = g.pos + 1)
SELECT chunk_id, pos, v, segment FROM g""", pos="BIGINT", segment="BIGINT")
def _(spark, d):
    return segmenters.segment_lines(customers(spark, d), 2000)


@query("cluster_concat", """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, o_custkey AS a, o_orderkey AS b FROM orders)
SELECT 0 AS chunk_id, row_number() OVER (ORDER BY k, p) - 1 AS pos, v FROM (SELECT 0 AS k, p, a AS v FROM o UNION ALL SELECT 1, p, b FROM o)""", chunk_id="BIGINT")
def _(spark, d):
    o = table(spark, d, "orders")
    streams = {k: stream(o, c, "o_orderkey") for k, c in enumerate(("o_custkey", "o_orderkey"))}
    return clustering.cluster(streams, clustering.ClusteringConfig([clustering.Cluster([0, 1])]))[0][2]["v"]


# Back ends: what goes in comes out

for _name, _codec in {"huffman": backends.Huffman, "fse": backends.Fse, "field_lz": backends.FieldLz}.items():

    @query(f"{_name}_round_trip", f"WITH {BYTES} SELECT * FROM s")
    def _(spark, d, codec=_codec):
        return codec().decode(codec().encode(_bytes(spark, d)))


@query("entropy_round_trip", f"WITH {BYTES} SELECT * FROM s")
def _(spark, d):
    c = backends.Entropy()
    return c.decode(c.encode(_bytes(spark, d)))


@query("num_to_serial_round_trip", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    c = structure.NumbersToSerial()
    return c.decode(c.encode(orders(spark, d)))


for _name, _codec in {"zstd": backends.Zstd, "lz4": backends.Lz4, "store": backends.Store}.items():

    @query(f"{_name}_round_trip", f"WITH {TEXTS} SELECT * FROM s")
    def _(spark, d, codec=_codec):
        s = _texts(spark, d).withColumn("v", F.col("v").cast("binary"))
        return codec().decode(codec().encode(s)).withColumn("v", F.col("v").cast("string"))


# Sources


def _csv(spark, d):
    n = table(spark, d, "nation").select(F.lit(0).cast("long").alias("chunk_id"), F.col("n_nationkey").cast("long").alias("pos"), F.concat_ws(",", "n_nationkey", F.concat(F.lit('"'), F.col("n_name"), F.lit(',"')), "n_regionkey").alias("v"))
    return structure.joined_bytes(n.withColumn("v", F.concat("v", F.lit("\n"))), n.select("chunk_id").distinct())


@query("csv_columns", """SELECT 0 AS chunk_id, n_nationkey AS row, 0 AS col, n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT 0, n_nationkey, 1, '"' || n_name || ',"' FROM nation UNION ALL SELECT 0, n_nationkey, 2, n_regionkey::VARCHAR FROM nation""", chunk_id="BIGINT", row="BIGINT")
def _(spark, d):
    t = csv_text.CsvText().encode(_csv(spark, d))["tokens"]
    return t.where("kind = 'field'").select("chunk_id", "row", "col", F.col("v").cast("string").alias("v"))


@query("csv_round_trip", """SELECT 0 AS chunk_id, string_agg(n_nationkey || ',"' || n_name || ',",' || n_regionkey || chr(10), '' ORDER BY n_nationkey) AS v FROM nation""", chunk_id="BIGINT")
def _(spark, d):
    c = csv_text.CsvText()
    return c.decode(c.encode(_csv(spark, d))).select("chunk_id", F.col("v").cast("string").alias("v"))


def _props(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.col("props").alias("v"))
    return json_text.JsonText().encode(e)


@query("json_numbers", "SELECT event_id AS chunk_id, regexp_extract(props, '-?[0-9]+', 0) AS v FROM events")
def _(spark, d):
    return _props(spark, d)["numbers"].select("chunk_id", F.col("v").cast("string").alias("v"))


@query("json_keys", """SELECT event_id AS chunk_id, regexp_extract(props, '"([a-z]+)"', 1) AS v FROM events""")
def _(spark, d):
    return _props(spark, d)["keys"].select("chunk_id", F.col("v").cast("string").alias("v"))


@query("json_round_trip", "SELECT event_id AS chunk_id, props AS v FROM events")
def _(spark, d):
    return json_text.JsonText().decode(_props(spark, d)).select("chunk_id", F.col("v").cast("string").alias("v"))


LAYOUT = "Record Order() = { key: UInt32LE, customer: Int64BE, flag: Byte }\norders: Order[]"


@query("binary_layout", "WITH o AS (SELECT o_orderkey // 4096 AS chunk_id, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key, -o_custkey AS customer FROM orders) SELECT * FROM o")
def _(spark, d):
    raw = F.concat(structure.number_to_bytes(F.col("o_orderkey"), 32), structure.number_to_bytes(-F.col("o_custkey"), 64, True), F.substring(F.col("o_orderstatus").cast("binary"), 1, 1))
    s = orders(spark, d, value=raw)
    e = layout.BinaryLayout(LAYOUT).encode(structure.joined_bytes(s, s.select("chunk_id").distinct()))
    columns = [layout.BinaryLayout.column(e, f"orders.{c}").withColumnRenamed("v", c) for c in ("key", "customer")]
    return columns[0].join(columns[1], ["chunk_id", "pos"])


# Plans and searches


@query("graph_round_trip", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    g = graph.node("range_pack", {"v": graph.node("delta", {"deltas": graph.node("zigzag", {"v": graph.node("tokenize", {"indices": graph.node("bitpack")})})})})
    return graph.encode(g, orders(spark, d)).decode()


@query("graph_choice_round_trip", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    return graph.encode(graph.PROFILES["automatic-integers"], orders(spark, d)).decode()


@query("pareto_front", "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))")
def _(spark, d):
    return search.pareto_front(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("crowding_distance", """WITH p AS (SELECT s_suppkey, s_nationkey AS a, s_acctbal AS b FROM supplier),
x AS (SELECT s_suppkey, lead(a) OVER wa - lag(a) OVER wa AS da, lead(b) OVER wb - lag(b) OVER wb AS db FROM p WINDOW wa AS (ORDER BY a, s_suppkey), wb AS (ORDER BY b, s_suppkey)),
r AS (SELECT max(a) - min(a) AS ra, max(b) - min(b) AS rb FROM p)
SELECT s_suppkey, CASE WHEN da IS NULL OR db IS NULL THEN -1 ELSE round(da / ra + db / rb, 9) END AS distance FROM x, r""")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"), F.col("s_acctbal").alias("b"))
    far = search.crowding_distance(s, ["a", "b"], "s_suppkey")
    return far.withColumn("distance", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.round("distance", 9)))


@query("sample_limit", "SELECT n_nationkey, size FROM (SELECT n_nationkey, length(n_name) AS size, sum(length(n_name)) OVER (ORDER BY n_nationkey) AS total FROM nation) WHERE total <= 100", size="INTEGER")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.length("n_name").alias("size"))
    return search.limited_sample(n, "size", ["n_nationkey"], 100)


def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the integral columns of lineitem (order, part, supplier, line number, quantity) with their features, entropy, sizes and the cheapest back end."""
    t = table(spark, d, "lineitem")
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    wide = t.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("chunk_id"), F.col(c).cast("long").alias("v")) for k, c in enumerate(names)])).alias("x"))
    s = wide.select("x.chunk_id", F.lit(0).cast("long").alias("pos"), "x.v")
    x = _rounded(st.profile(s), *MOMENT_NAMES)
    n, k, top = F.col("n"), F.col("cardinality"), F.col("high")
    sizes = x.withColumn("raw", n * 8).withColumn("bitpack", selectors.bitpacked_size(n, top)).withColumn("constant", selectors.constant_size(n, k))
    sizes = sizes.withColumn("tokenize", F.floor((n * selectors.bits_for(k) + 7) / 8) + k * 8)
    best = selectors.brute_force(sizes, "raw", ["constant", "bitpack", "tokenize"])
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("chunk_id") + 1).cast("int"))
    return best.select(name.alias("column_name"), "n", "cardinality", "range_size", *MOMENT_NAMES, F.round("entropy", 6).alias("entropy"), "raw", "bitpack", "tokenize", "choice", F.col("size").cast("long").alias("size"))


_PROFILE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
query("stream_profile", f"""WITH s AS ({' UNION ALL '.join(f"SELECT '{c}' AS chunk_id, {c}::BIGINT AS v FROM lineitem" for c in _PROFILE_COLUMNS)}), m AS ({MOMENTS}), h AS ({H.format('s')}),
r AS (SELECT chunk_id, max(v) - min(v) AS range_size FROM s GROUP BY chunk_id),
x AS (SELECT m.*, k AS cardinality, range_size, round(h, 6) AS entropy, m.n * 8 AS raw, (m.n * (CASE WHEN top = 0 THEN 0 ELSE length(bin(top)) END) + 7) // 8 AS bitpack,
(m.n * (CASE WHEN k <= 1 THEN 0 ELSE length(bin(k - 1)) END) + 7) // 8 + k * 8 AS tokenize FROM m JOIN h USING (chunk_id) JOIN r USING (chunk_id))
SELECT chunk_id AS column_name, n, cardinality, range_size, mean, variance, stddev, skewness, kurtosis, entropy, raw, bitpack, tokenize,
CASE WHEN cardinality = 1 THEN 'constant' WHEN least(bitpack, tokenize) >= raw THEN 'store' WHEN bitpack <= tokenize THEN 'bitpack' ELSE 'tokenize' END AS choice, least(bitpack, tokenize, raw)::BIGINT AS size FROM x""")(stream_profile)



# Nested columns, streaming, and joins beyond codecs


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(_div("vec_id", 64).alias("chunk_id"), F.col("vec_id").alias("key"), F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("long")).alias("x"))


VECTORS = "s AS (SELECT vec_id // 64 AS chunk_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: round(x::DOUBLE * 100)::BIGINT) AS v FROM embeddings)"


def _vector_stream(spark, d):
    v = _vectors(spark, d)
    return stream(v, "x", "key", F.col("chunk_id"))


@query("nested_lengths", f"WITH {VECTORS} SELECT chunk_id, pos, len(v) AS v FROM s")
def _(spark, d):
    return nested.Nested().encode(_vector_stream(spark, d))["n"]


@query("nested_values", f"WITH {VECTORS}, x AS (SELECT chunk_id, pos AS p, unnest(v) AS v, unnest(range(len(v))) AS k FROM s) SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY p, k) - 1 AS pos, v FROM x")
def _(spark, d):
    return nested.Nested().encode(_vector_stream(spark, d))["v"]


@query("nested_round_trip", f"WITH {VECTORS} SELECT chunk_id, pos, array_to_string(v, ',') AS v FROM s")
def _(spark, d):
    n = nested.Nested()
    back = n.decode(n.encode(_vector_stream(spark, d)))
    return back.withColumn("v", F.array_join(F.transform("v", lambda x: x.cast("string")), ","))


@query("layout_program", f"WITH {ORDERS} SELECT chunk_id, pos, v FROM s")
def _(spark, d):
    s = _records(spark, d)
    program = layout_vm.LayoutProgram("push.tag 1\npush.type.u32le\npush.remaining\npush.i32 4\nmath.div\nsegment.create_tagged\nhalt")
    return program.numbers(program.encode(structure.joined_bytes(s, s.select("chunk_id").distinct())), 0)


PROTO_ORDER = {1: "uint64", 2: "sint64", 3: "string"}


@query("protobuf_fields", f"WITH {_stream_sql('nation', 'n_nationkey', 8, 'n_name')} SELECT chunk_id, pos, v FROM s", chunk_id="BIGINT")
def _(spark, d):
    name = F.col("n_name")
    raw = F.concat(F.unhex(F.lit("08")), F.unhex(F.lpad(F.hex(F.col("n_nationkey")), 2, "0")), F.unhex(F.lit("1A")), F.unhex(F.lpad(F.hex(F.octet_length(name)), 2, "0")), name.cast("binary"))
    m = messages.Messages(PROTO_ORDER)
    s = stream(table(spark, d, "nation"), raw, "n_nationkey", _div("n_nationkey", 8))
    return m.stream(m.encode(s), "string").withColumn("v", F.col("v").cast("string"))


@query("streaming_delta_encode", f"WITH {_stream_sql('events', 'event_id', 2048, 'user_id')}, {DELTAS} SELECT chunk_id, pos, v FROM d")
def _(spark, d):
    """A stream of files, a micro-batch at a time, run until nothing is left."""
    base = f"{scratch_dir(spark)}/streaming-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    encode = lambda b: numeric.Delta().encode(stream(b, "user_id", "event_id", _div("event_id", 2048)))["deltas"]
    chunks.encode_to(source, encode, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("chunk_id", "pos", "v")


def _micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


@query("event_windows", """SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean
FROM events GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "events")
    x = chunks.profile(e, "ts", "value", "6 hours", by="event_type")
    return x.select(_micros("window.start").alias("start_us"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean")])


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, k""")
def _(spark, d):
    return chunks.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours").select("user_id", _micros("start").alias("start_us"), "n")


@query("asof_join", "SELECT o.o_orderkey, o.o_custkey, e.value FROM orders o ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events) e ON o.o_custkey = e.user_id AND o.o_orderkey >= e.event_id")
def _(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"))
    return relational.asof_join(left, table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("o_orderkey", "o_custkey", "value")


@query("asof_join_in_stretches", "SELECT o.o_orderkey, o.o_custkey, e.value FROM orders o ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events) e ON o.o_custkey = e.user_id AND o.o_orderkey >= e.event_id")
def _(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"))
    return relational.asof_join(left, table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 500).select("o_orderkey", "o_custkey", "value")


@query("interval_join_of_long_intervals", "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey * 400 >= s_acctbal AND n_nationkey * 400 < s_acctbal + s_suppkey % 5 * 1000")
def _(spark, d):
    spans = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + F.col("s_suppkey") % 5 * 1000).alias("high"))
    points = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 400).alias("at"))
    return relational.interval_join(points, spans, "at", "low", "high", 50.0).select("n_nationkey", "s_suppkey")


@query("interval_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 25")
def _(spark, d):
    spans = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return relational.interval_join(table(spark, d, "part"), spans, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")


@query("rollup_and_cube", """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""", level="BIGINT")
def _(spark, d):
    x = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return x.select("l_returnflag", "l_linestatus", "level", "n", "quantity")


@query("top_orders_by_priority", "SELECT o_orderpriority, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 10", k="INTEGER")
def _(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 10").select("o_orderpriority", "o_orderkey", "k")


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    """Customers without a large order."""
    large = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("shared_keys", "SELECT c_custkey AS k FROM customer INTERSECT SELECT p_partkey FROM part")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "part").select("p_partkey"))


from . import catalog_more  # noqa: E402,F401  the rest of the queries, which use what is above

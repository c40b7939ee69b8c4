"""Further queries over the sample tables: sources, segmenters, selectors, graphs, profiles, training."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import BYTES, CUSTOMERS, DELTAS, ORDERS, W, _bytes, _csv, _div, _props, _records, _stream_sql, _vectors, customers, orders, query
from .core import in_batches, long_stream, scratch_dir, stream, table
from .operators import clustering, dictionary, numeric, segmenters, selectors, structure
from .plans import graph, profiles, search
from .sources import csv_text, files, json_text, messages

# Floats as text

PRICES = _stream_sql("part", "p_partkey", 256, "CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN printf('%.2f', p_retailprice) ELSE printf('%d.%d', p_size, p_partkey % 9 + 1) END")
SHORTEST = r"regexp_full_match(v, '-?(0|[1-9][0-9]{0,6})\.([0-9]*[1-9]|0)')"


def _prices(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.col("p_name")).when(k == 1, F.format_string("%.2f", F.col("p_retailprice").cast("double"))).otherwise(F.format_string("%d.%d", F.col("p_size").cast("long"), (F.col("p_partkey") % 9 + 1).cast("long")))
    return stream(table(spark, d, "part"), text, "p_partkey", _div("p_partkey", 256))


@query("parse_float", f"WITH {PRICES} SELECT chunk_id, pos, v::DOUBLE AS v FROM s WHERE {SHORTEST}")
def _(spark, d):
    return numeric.ParseFloat().encode(_prices(spark, d))["v"].where("v IS NOT NULL")


for _name, _which, _n in (("numbers", SHORTEST, "v::DOUBLE"), ("exceptions", f"NOT ({SHORTEST})", "v")):

    @query(f"try_parse_float_{_name}", f"WITH {PRICES} SELECT chunk_id, row_number() OVER {W} - 1 AS pos, {_n} AS v FROM s WHERE {_which}")
    def _(spark, d, name=_name):
        return numeric.TryParseFloat().encode(_prices(spark, d))[name]


@query("try_parse_float_decode", f"WITH {PRICES} SELECT * FROM s")
def _(spark, d):
    c = numeric.TryParseFloat()
    return c.decode(c.encode(_prices(spark, d)))


# Messages and files

NATIONS = _stream_sql("nation", "n_nationkey", 8, "n_name")


def _hex(c, digits: int):
    return F.unhex(F.lpad(F.hex(c), digits, "0"))


def _binary_thrift(spark, d) -> DataFrame:
    """{1: i32 key, 2: binary name, 3: list<i64> of the region}."""
    name = F.col("n_name")
    raw = F.concat(
        F.unhex(F.lit("080001")), _hex("n_nationkey", 8), F.unhex(F.lit("0B0002")), _hex(F.octet_length(name), 8), name.cast("binary"), F.unhex(F.lit("0F00030A00000001")), _hex("n_regionkey", 16), F.unhex(F.lit("00"))
    )
    return stream(table(spark, d, "nation"), raw, "n_nationkey", _div("n_nationkey", 8))


@query("thrift_binary_names", f"WITH {NATIONS} SELECT chunk_id, pos, v FROM s", chunk_id="BIGINT")
def _(spark, d):
    m = messages.Messages(protocol="binary")
    return m.stream(m.encode(_binary_thrift(spark, d)), "binary").withColumn("v", F.col("v").cast("string"))


@query("thrift_binary_path", f"WITH {_stream_sql('nation', 'n_nationkey', 8, 'n_regionkey')} SELECT chunk_id, pos, v FROM s", chunk_id="BIGINT", v="BIGINT")
def _(spark, d):
    m = messages.Messages(protocol="binary", paths={"region": (3, messages.ELEMENT)})
    return m.stream(m.encode(_binary_thrift(spark, d)), "region")


@query("thrift_binary_round_trip", f"WITH {NATIONS} SELECT chunk_id, pos, strlen(v) + 31 AS n FROM s", chunk_id="BIGINT", n="INTEGER")
def _(spark, d):
    m = messages.Messages(protocol="binary", paths={"key": (1,)})
    s = _binary_thrift(spark, d)
    back = m.decode(m.encode(s)).withColumnRenamed("v", "back")
    return s.join(back, ["chunk_id", "pos"]).where("v = back").select("chunk_id", "pos", F.octet_length("back").alias("n"))


def _compact_thrift(spark, d) -> DataFrame:
    """{1: i32 key, 2: binary name} in the compact protocol."""
    name = F.col("n_name")
    raw = F.concat(F.unhex(F.lit("15")), _hex(F.col("n_nationkey") * 2, 2), F.unhex(F.lit("18")), _hex(F.octet_length(name), 2), name.cast("binary"), F.unhex(F.lit("00")))
    return stream(table(spark, d, "nation"), raw, "n_nationkey", _div("n_nationkey", 8))


@query("thrift_compact_names", f"WITH {NATIONS} SELECT chunk_id, pos, v FROM s", chunk_id="BIGINT")
def _(spark, d):
    m = messages.Messages()
    return m.stream(m.encode(_compact_thrift(spark, d)), "binary").withColumn("v", F.col("v").cast("string"))


@query("thrift_compact_path", f"WITH {_stream_sql('nation', 'n_nationkey', 8, 'n_nationkey')} SELECT chunk_id, pos, v FROM s", chunk_id="BIGINT", v="BIGINT")
def _(spark, d):
    m = messages.Messages(paths={"key": (1,)})
    return m.stream(m.encode(_compact_thrift(spark, d)), "key")


def _feature_records(spark, d) -> DataFrame:
    """Records {1: map<i32, list<i64>>, 2: i32, 3: map<i32, float>}: one pair each, of key, region and 1.5."""
    key, region = _hex(F.col("n_nationkey") * 2, 2), _hex(F.col("n_regionkey") * 2, 2)
    raw = F.concat(F.unhex(F.lit("80001B0159")), key, F.unhex(F.lit("16")), region, F.unhex(F.lit("15")), key, F.unhex(F.lit("1B015D")), key, F.unhex(F.lit("3FC0000000")))
    return stream(table(spark, d, "nation"), raw, "n_nationkey", _div("n_nationkey", 8))


@query("feature_map_stretches", """WITH s AS (SELECT n_nationkey // 8 AS chunk_id, row_number() OVER (PARTITION BY n_nationkey // 8 ORDER BY n_nationkey) - 1 AS pos, printf('%02X', n_nationkey * 2) AS k, printf('%02X', n_regionkey * 2) AS r FROM nation)
SELECT chunk_id, pos, unnest([0, 1, 2, 3, 4]) AS part, unnest(['other', 'id_list', 'other', 'float', 'other']) AS kind, unnest(['80001B', '0159' || k || '16' || r, '15' || k || '1B', '015D' || k || '3FC00000', '00']) AS v FROM s""", chunk_id="BIGINT", part="BIGINT")
def _(spark, d):
    return messages.FeatureMaps().encode(_feature_records(spark, d))["parts"].withColumn("v", F.hex("v"))


@query("feature_map_lists", """WITH s AS (SELECT n_nationkey // 8 AS chunk_id, row_number() OVER (PARTITION BY n_nationkey // 8 ORDER BY n_nationkey) - 1 AS pos, '0159' || printf('%02X', n_nationkey * 2) || '16' || printf('%02X', n_regionkey * 2) AS v FROM nation) SELECT * FROM s""", chunk_id="BIGINT")
def _(spark, d):
    c = messages.FeatureMaps()
    return c.stream(c.encode(_feature_records(spark, d)), "id_list").withColumn("v", F.hex("v"))


@query("integers_of_files", f"WITH {ORDERS} SELECT chunk_id, pos, v FROM s")
def _(spark, d):
    r = _records(spark, d, 32, True)
    return files.integers(structure.joined_bytes(r, r.select("chunk_id").distinct()), "be-u32")


@query("zip_members", "SELECT 0 AS chunk_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS member, n_name AS name, n_nationkey % 2 = 0 AS compressed, n_name || n_name AS v FROM nation", chunk_id="BIGINT", member="BIGINT")
def _(spark, d):
    n = table(spark, d, "nation").select(F.lit(0).cast("long").alias("chunk_id"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))

    def packed(t: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in t.sort_by("k").to_pylist():
                z.writestr(r["name"], r["name"] * 2, zipfile.ZIP_STORED if r["k"] % 2 else zipfile.ZIP_DEFLATED)
        return pa.table({"chunk_id": t["chunk_id"][:1], "v": pa.array([out.getvalue()])})

    members = files.zip_members(n.groupBy("chunk_id").applyInArrow(packed, "chunk_id long, v binary"))
    return members.select("chunk_id", F.col("member").cast("long").alias("member"), "name", "compressed", F.col("v").cast("string").alias("v"))


@query("canonical_parquet", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(spark, d):
    path = f"{scratch_dir(spark)}/canonical-{uuid.uuid4().hex}"
    files.canonical_parquet(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return spark.read.parquet(path)


@query("json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("v"))


@query("json_extract", """SELECT event_id AS chunk_id, unnest(['ints', 'strings']) AS kind, unnest([regexp_extract(props, '-?[0-9]+', 0), regexp_extract(props, '"([a-z]+)"', 1)]) AS v FROM events""")
def _(spark, d):
    def run(batches):
        for b in batches:
            rows = []
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, ints, floats, strings = json_text.extract(text.encode())
                rows += [(chunk, kind, x.decode()) for kind, xs in (("ints", ints), ("floats", floats), ("strings", strings)) for x in xs]
            yield from in_batches(rows, ["chunk_id", "kind", "v"], [pa.int64(), pa.string(), pa.string()])

    return table(spark, d, "events").select("event_id", "props").mapInArrow(run, "chunk_id long, kind string, v string")


@query("csv_profile_round_trip", """SELECT 0 AS chunk_id, string_agg(n_nationkey || ',"' || n_name || ',",' || n_regionkey || chr(10), '' ORDER BY n_nationkey) AS v FROM nation""", chunk_id="BIGINT")
def _(spark, d):
    return profiles.csv_back(*profiles.csv_frames(_csv(spark, d))).select("chunk_id", F.col("v").cast("string").alias("v"))


@query("csv_profile_columns", "SELECT chunk_id, col, row_number() OVER (PARTITION BY col ORDER BY k) - 1 AS pos, v FROM (SELECT 0 AS chunk_id, 0 AS col, n_nationkey AS k, n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT 0, 2, n_nationkey, n_regionkey::VARCHAR FROM nation)", chunk_id="BIGINT")
def _(spark, d):
    _, frames = profiles.csv_frames(_csv(spark, d))
    return frames[0].decode().withColumn("col", F.lit(0)).unionByName(frames[2].decode().withColumn("col", F.lit(2))).select("chunk_id", "col", "pos", "v")


@query("json_profile_round_trip", "SELECT event_id AS chunk_id, props AS v FROM events WHERE event_id % 50 = 0")
def _(spark, d):
    e = table(spark, d, "events").where("event_id % 50 = 0").select(F.col("event_id").alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.col("props").alias("v"))
    return profiles.json_back(*profiles.json_frames(e)).select("chunk_id", F.col("v").cast("string").alias("v"))


@query("csv_null_aware_tokens", """SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['separator', 'field', 'newline'] ELSE ['field', 'separator', 'field', 'newline'] END) AS kind FROM nation) GROUP BY kind""")
def _(spark, d):
    first = F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lit("x"))
    n = table(spark, d, "nation").select(F.lit(0).cast("long").alias("chunk_id"), F.col("n_nationkey").cast("long").alias("pos"), F.concat(first, F.lit(","), "n_name", F.lit("\n")).alias("v"))
    t = csv_text.CsvText(null_aware=True).encode(structure.joined_bytes(n, n.select("chunk_id").distinct()))["tokens"]
    return t.groupBy("kind").agg(F.count("*").alias("n"))


# Segments and splits

_SIZED = _stream_sql("customer", "c_custkey", 512, "length(c_name) + c_custkey % 7")


@query("segment_tokens", f"""WITH RECURSIVE {_SIZED}, g AS (
SELECT chunk_id, pos, v, 0 AS segment, v AS held FROM s WHERE pos = 0
UNION ALL SELECT s.chunk_id, s.pos, s.v, CASE WHEN held + s.v > 100 THEN segment + 1 ELSE segment END, CASE WHEN held + s.v > 100 THEN s.v ELSE held + s.v END FROM g JOIN s ON s.chunk_id = g.chunk_id AND s.pos = g.pos + 1)
SELECT chunk_id, pos, v, segment FROM g""", segment="BIGINT", v="BIGINT", pos="BIGINT")
def _(spark, d):
    return segmenters.segment_tokens(customers(spark, d, value=(F.length("c_name") + F.col("c_custkey") % 7).cast("long")), 100)


def _hundreds(values: list) -> list[int]:
    return [100] * (len(values) // 100) + ([len(values) % 100] if len(values) % 100 else [])


@query("segment_with_function", f"WITH {ORDERS} SELECT chunk_id, pos, v, pos // 100 AS segment FROM s")
def _(spark, d):
    return segmenters.segment_with(orders(spark, d), _hundreds)


@query("split_with_function", f"WITH {ORDERS} SELECT chunk_id, pos, v, CASE WHEN pos < count(*) OVER (PARTITION BY chunk_id) // 2 THEN 0 ELSE 1 END AS segment FROM s", segment="BIGINT")
def _(spark, d):
    return structure.split_with(lambda values: [len(values) // 2, len(values) - len(values) // 2], orders(spark, d))["segments"]


@query("n_to_n", f"WITH {ORDERS}, {DELTAS}, m AS (SELECT chunk_id, min(v) AS low FROM s GROUP BY chunk_id) SELECT 'delta' AS codec, chunk_id, pos, v FROM d UNION ALL SELECT 'range_pack', chunk_id, pos, v - low FROM s JOIN m USING (chunk_id)")
def _(spark, d):
    s = orders(spark, d)
    a, b = structure.n_to_n([s, s], [numeric.Delta(), numeric.RangePack()])
    return a["deltas"].select(F.lit("delta").alias("codec"), "chunk_id", "pos", "v").unionByName(b["v"].select(F.lit("range_pack").alias("codec"), "chunk_id", "pos", "v"))


@query("split_to_successors", f"WITH {ORDERS}, h AS (SELECT *, CASE WHEN pos < 1000 THEN 0 ELSE 1 END AS part FROM s), m AS (SELECT chunk_id, part, min(v) AS low FROM h GROUP BY chunk_id, part) SELECT chunk_id, part, pos - part * 1000 AS pos, v - low AS v FROM h JOIN m USING (chunk_id, part)", part="INTEGER", pos="BIGINT")
def _(spark, d):
    made = structure.split_to(structure.SplitN([1000, 0]).encode(orders(spark, d)), [numeric.RangePack(), numeric.RangePack()])
    parts = [made[f"segment_{k}"]["v"].select("chunk_id", F.lit(k).alias("part"), "pos", "v") for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("dispatch_string_routes", f"WITH {_stream_sql('events', 'event_id', 2048, 'event_type')} SELECT chunk_id, length(v) % 3 AS route, row_number() OVER (PARTITION BY chunk_id, length(v) % 3 ORDER BY pos) - 1 AS pos, v FROM s", route="INTEGER")
def _(spark, d):
    s = stream(table(spark, d, "events"), "event_type", "event_id", _div("event_id", 2048))
    e = structure.DispatchString(3).encode(s, s.withColumn("v", F.length("v") % 3))
    parts = [x.select("chunk_id", F.lit(k).alias("route"), "pos", "v") for k, x in enumerate(x for name, x in e.streams.items() if name not in ("indices", "tags"))]
    out = parts[0]
    for p in parts[1:3]:
        out = out.unionByName(p)
    return out


@query("interleave_round_trip", f"WITH {CUSTOMERS} SELECT chunk_id, pos, 0 AS k, v FROM s UNION ALL SELECT chunk_id, pos, 1, reverse(v) FROM s", k="INTEGER")
def _(spark, d):
    a, c = customers(spark, d), structure.Interleave()
    x, y = c.decode(c.encode(a, a.withColumn("v", F.reverse("v"))))
    return x.withColumn("k", F.lit(0)).unionByName(y.withColumn("k", F.lit(1))).select("chunk_id", "pos", "k", "v")


@query("cluster_round_trip", """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey AS a, o_orderkey AS b, o_orderpriority AS c FROM orders)
SELECT pos, 0 AS k, a::VARCHAR AS v FROM o UNION ALL SELECT pos, 1, b::VARCHAR FROM o UNION ALL SELECT pos, 2, c FROM o""", k="INTEGER")
def _(spark, d):
    """Two numbers in one configured cluster (its configuration written and read back), a string by default."""
    o = table(spark, d, "orders")
    streams = {k: stream(o, c, "o_orderkey") for k, c in enumerate(("o_custkey", "o_orderkey", "o_orderpriority"))}
    config = clustering.ClusteringConfig.from_json(clustering.ClusteringConfig([clustering.Cluster([0, 1])], [("string", "separate_string_components")]).to_json())
    back = clustering.uncluster(clustering.cluster(streams, config))
    parts = [back[k].select("pos", F.lit(k).alias("k"), F.col("v").cast("string").alias("v")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Selectors


@query("generic_successor", "SELECT unnest(['o_custkey', 'o_orderpriority', 'raw']) AS stream, unnest(['field_lz', 'separate_string_components', 'zstd']) AS successor")
def _(spark, d):
    s = {"o_custkey": orders(spark, d), "o_orderpriority": orders(spark, d, value="o_orderpriority"), "raw": _records(spark, d)}
    return spark.createDataFrame([(n, selectors.generic(x)) for n, x in s.items()], "stream string, successor string")


@query("constant_kind", "SELECT unnest(['byte', 'long']) AS stream, unnest(['constant_serial', 'constant_fixed']) AS successor")
def _(spark, d):
    s = {"byte": orders(spark, d, value=F.lit(1).cast("byte")), "long": orders(spark, d)}
    return spark.createDataFrame([(n, selectors.constant_kind(x)) for n, x in s.items()], "stream string, successor string")


@query("on_empty", f"WITH {ORDERS}, {DELTAS} SELECT 'deltas' AS way, count(*) AS n FROM d UNION ALL SELECT 'empty', count(*) FROM s")
def _(spark, d):
    s = orders(spark, d)
    nothing, other = lambda x: s, lambda x: numeric.Delta().encode(x)["deltas"]
    counted = lambda name, x: x.agg(F.lit(name).alias("way"), F.count("*").alias("n"))
    return counted("deltas", selectors.on_empty(s, nothing, other)).unionByName(counted("empty", selectors.on_empty(s.where("v IS NULL"), nothing, other)))


@query("probabilistic_ways", "SELECT o_orderkey // 64 AS chunk_id, 1 AS way FROM orders GROUP BY 1", way="INTEGER")
def _(spark, d):
    s = orders(spark, d, 64)
    return s.select("chunk_id").distinct().select("chunk_id", selectors.probabilistic([0.0, 1.0, 0.0]).cast("int").alias("way"))


@query("entropy_pieces", """WITH l AS (SELECT half AS chunk_id, unnest(range(1 + 2 * half)) AS k, l_orderkey, l_linenumber FROM lineitem, (SELECT unnest([0, 1]) AS half)),
s AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY l_orderkey, l_linenumber, k) - 1 AS pos FROM l), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN n.n < 100000 THEN 0 ELSE pos // 32768 END AS piece, count(*) AS n, max(pos) AS last FROM s JOIN n USING (chunk_id) GROUP BY ALL""", chunk_id="BIGINT", piece="BIGINT")
def _(spark, d):
    """A stream of lineitem's rows once, and one of them three times."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), 2 * F.col("half"))))
    x = selectors.entropy_pieces(long_stream(t, "l_partkey", ["l_orderkey", "l_linenumber", "k"], F.col("half")))
    return x.groupBy("chunk_id", "piece").agg(F.count("*").alias("n"), F.max(F.col("pos") + F.col("piece") * selectors.ENTROPY_PIECE).alias("last"))


# Graphs

for _name in ("delta_huffman", "delta_flatpack", "delta_zstd", "delta_field_lz", "range_pack_zstd", "tokenize_delta_field_lz", "le-u64", "le-i64", "dictionary", "bytes"):

    @query(f"profile_{_name.replace('-', '_')}", f"WITH {BYTES} SELECT * FROM s")
    def _(spark, d, name=_name):
        return graph.encode(graph.PROFILES[name], _bytes(spark, d)).decode()


@query("graph_when", f"WITH {_stream_sql('customer', 'c_custkey', 4, 'c_nationkey % 3')} SELECT * FROM s", v="BIGINT")
def _(spark, d):
    g = graph.when(graph.node("constant"), graph.node("constant"), graph.node("delta"))
    return graph.encode(g, customers(spark, d, 4, F.col("c_nationkey") % 3)).decode()


@query("graph_when_routes", f"WITH {_stream_sql('customer', 'c_custkey', 4, 'c_nationkey % 3')} SELECT chunk_id, CASE WHEN min(v) = max(v) THEN 0 ELSE 1 END AS way FROM s GROUP BY chunk_id", way="INTEGER")
def _(spark, d):
    g = graph.when(graph.node("constant"), graph.node("constant"), graph.node("delta"))
    return graph.encode(g, customers(spark, d, 4, F.col("c_nationkey") % 3)).headers["/route"]


@query("graph_learned", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    model = {"features": ["cardinality"], "labels": ["few", "many"], "forests": [[[{"feature": 0, "value": 900, "left": 1, "right": 2, "missing": 1}, {"feature": -1, "value": -1.0}, {"feature": -1, "value": 1.0}]]]}
    g = graph.learned(model, {"few": graph.node("tokenize"), "many": graph.node("range_pack")})
    return graph.encode(g, orders(spark, d)).decode()


@query("frame_written_and_read", f"WITH {ORDERS} SELECT * FROM s")
def _(spark, d):
    path = f"{scratch_dir(spark)}/frame-{uuid.uuid4().hex}"
    graph.encode(graph.PROFILES["sorted"], orders(spark, d)).write(path)
    return graph.Frame.read(spark, path).decode()


@query("frame_sizes", f"WITH {ORDERS}, {DELTAS} SELECT unnest(['/deltas/v', '', '/deltas']) AS path, unnest(['stream', 'header', 'header']) AS kind, unnest(['bigint', 'bigint', 'bigint,int']) AS type, unnest([(SELECT count(*) FROM d), c, c]) AS n, unnest([(SELECT count(*) * 8 FROM d), c * 8, c * 12]) AS bytes FROM (SELECT count(DISTINCT chunk_id) AS c FROM s)")
def _(spark, d):
    return graph.encode(graph.PROFILES["sorted"], orders(spark, d)).sizes()


@query("frame_checksums", f"WITH {ORDERS}, {DELTAS} SELECT '/deltas' AS path, count(*) AS n, true AS same FROM d UNION ALL SELECT '#', count(DISTINCT chunk_id), true FROM s")
def _(spark, d):
    """Sums of a frame and of the same stream's from rows in another order."""
    a, b = (graph.encode(graph.node("delta"), x).checksums() for x in (orders(spark, d), orders(spark, d).orderBy(F.desc("v"))))
    return a.join(b.withColumnsRenamed({"n": "n0", "checksum": "c0"}), "path").select("path", "n", ((F.col("checksum") == F.col("c0")) & (F.col("n") == F.col("n0"))).alias("same"))


@query("samples_at_slot", f"WITH {ORDERS}, {DELTAS} SELECT chunk_id, pos, v FROM d")
def _(spark, d):
    g = graph.node("delta", {"deltas": graph.slot("inner")})
    return graph.samples_at(g, orders(spark, d), "inner")[0]


@query("slot_replaced", f"WITH {ORDERS}, {DELTAS} SELECT chunk_id, pos, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS v FROM d")
def _(spark, d):
    g = graph.replace(graph.node("delta", {"deltas": graph.slot("inner")}), "inner", graph.node("zigzag"))
    return graph.encode(g, orders(spark, d)).streams["/deltas/v"]


# Searches and training

_FRONTS = [[((5.0, 1.0), "a"), ((3.0, 2.0), "b")], [((4.0, 1.0), "c"), ((4.0, 1.0), "e"), ((1.0, 4.0), "d")]]
_VALUES = [", ".join(f"({p}::DOUBLE, {q}::DOUBLE, '{x}')" for (p, q), x in front) for front in _FRONTS]


@query("combined_fronts", f"""WITH x(p, q, a) AS (VALUES {_VALUES[0]}), y(p, q, a) AS (VALUES {_VALUES[1]}), e AS (SELECT x.p + y.p AS size, x.q + y.q AS nodes, x.a || y.a AS chosen FROM x, y)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.size <= e.size AND f.nodes <= e.nodes AND (f.size < e.size OR f.nodes < e.nodes))""")
def _(spark, d):
    return spark.createDataFrame([(p, q, "".join(xs)) for (p, q), xs in search.combined_fronts(_FRONTS)], "size double, nodes double, chosen string")


@query("pareto_front_of_three", """SELECT s_suppkey FROM supplier a WHERE s_suppkey % 5 < 5 AND NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal <= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND b.s_suppkey % 11 <= a.s_suppkey % 11
AND (b.s_acctbal < a.s_acctbal OR b.s_nationkey < a.s_nationkey OR b.s_suppkey % 11 < a.s_suppkey % 11))""")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_suppkey") % 11).alias("m"))
    return search.pareto_front(s, ["s_acctbal", "s_nationkey", "m"]).select("s_suppkey")


@query("trained_selector_round_trip", f"WITH {_stream_sql('part', 'p_partkey', 64, 'p_size')} SELECT * FROM s", v="BIGINT")
def _(spark, d):
    """A learned selector of six pipelines, trained on the chunks it then encodes."""
    s = stream(table(spark, d, "part"), F.col("p_size").cast("long"), "p_partkey", _div("p_partkey", 64))
    return graph.encode(search.numeric_selector(s, trees=3), s).decode()


@query("trained_groups_round_trip", "WITH o AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey AS a, n_regionkey AS b FROM nation) SELECT pos, 0 AS k, a AS v FROM o UNION ALL SELECT pos, 1, b FROM o", pos="BIGINT", k="INTEGER", v="BIGINT")
def _(spark, d):
    """Two streams grouped, a graph searched for each group, and back."""
    n = table(spark, d, "nation")
    streams = {k: stream(n, F.col(c).cast("long"), "n_nationkey") for k, c in enumerate(("n_nationkey", "n_regionkey"))}
    made, parts = search.train(streams, generations=1, population=4, selector=False), []
    for members, g in zip(made["groups"], made["graphs"], strict=True):
        c = structure.Concat()
        e = c.encode(*(streams[k] for k in members))
        e.streams["v"] = graph.encode(g, e["v"]).decode()
        back = c.decode(e)
        parts += [x.select("pos", F.lit(k).alias("k"), "v") for k, x in zip(members, back, strict=True)]
    return parts[0].unionByName(parts[1])


@query("vector_cardinality", "SELECT vec_id // 64 AS chunk_id, count(DISTINCT len(embedding)) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    x = _vectors(spark, d).select("chunk_id", F.size("x").alias("v"))
    return dictionary.Tokenize().encode(stream(x.withColumn("key", F.monotonically_increasing_id()), "v", "key", F.col("chunk_id")))["alphabet"].groupBy("chunk_id").agg(F.count("*").alias("n"))


def _events_with_props(spark, d) -> DataFrame:
    return _props(spark, d)["structure"]


@query("json_structure", r"""SELECT event_id AS chunk_id, regexp_replace(regexp_replace(regexp_replace(props, '"[a-z]+"', 'K'), '"[^"]*"', 'S', 'g'), '-?[0-9]+', 'N', 'g') AS v FROM events""")
def _(spark, d):
    return _events_with_props(spark, d).select("chunk_id", F.col("v").cast("string").alias("v"))

"""Searching for good pipelines: Pareto sets, a genetic search over graphs, groupings of streams, learned selectors.

Fitness is size, which is the same every time; candidates are measured as Spark jobs over a sample of chunks.  What
comes to the driver are candidates and their sizes, never streams.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import scratch_dir
from ..functions.statistics import feature_vector
from ..operators.backends import stored_size
from . import graph as g


def dominates(a: Sequence[float], b: Sequence[float]) -> bool:
    """Whether a is nowhere worse (larger) than b and somewhere better."""
    return all(x <= y for x, y in zip(a, b, strict=True)) and any(x < y for x, y in zip(a, b, strict=True))


def _skyline(points: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates.  Sorted by their sum, a row can only be dominated by one before it.

    The front held so far is in a buffer that doubles.
    """
    order = np.lexsort((*points.T, points.sum(axis=1)))
    held, n = np.zeros((1024, points.shape[1])), 0
    out = np.zeros(len(points), bool)
    for k in order:
        p, front = points[k], held[:n]
        if n and ((front <= p).all(axis=1) & (front < p).any(axis=1)).any():
            continue
        out[k] = True
        if n == len(held):
            held = np.concatenate((held, np.zeros_like(held)))
        held[n] = p
        n += 1
    return out


def pareto_front(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Rows that no row dominates, all objectives minimised; equal rows stay together.  Rows with a null don't count.

    Two objectives need no search: in order of the first, a row is in the front if its second is less than that of all
    rows with a smaller first, and the least of those with an equal one.  The least of the second by value of the
    first is a map-side aggregate; what is ordered then is one row a value, by ranges of the first, each range knowing
    the least of those before it.  More objectives: each partition sends only its own front on, in two rounds.
    """
    points = df.dropna(subset=list(objectives))
    if len(objectives) == 2:
        return _staircase(points, *objectives)
    at = [points.columns.index(c) for c in objectives]

    def local(batches):
        held = None
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if held.num_rows:
                x = np.column_stack([held.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at])
                held = held.filter(pa.array(_skyline(x)))
        if held is not None:
            yield held

    # Two rounds of partitions before the last one.
    first = points.mapInArrow(local, points.schema)
    return first.repartition(8).mapInArrow(local, points.schema).coalesce(1).mapInArrow(local, points.schema)


def _staircase(points: DataFrame, x: str, y: str) -> DataFrame:
    """The front of two objectives: a running minimum over ranges of the first."""
    steps = points.groupBy(F.col(x).alias("sx")).agg(F.min(y).alias("sy"))
    path = f"{scratch_dir(points.sparkSession)}/front-{uuid.uuid4().hex}"  # written once: ranges must be the same for both readers
    steps.repartitionByRange("sx").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranges = points.sparkSession.read.parquet(path)
    lows = ranges.groupBy("part").agg(F.min("sy").alias("low"))  # one row a partition
    before = lows.select("part", F.min("low").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    here = F.min("sy").over(Window.partitionBy("part").orderBy("sx").rowsBetween(Window.unboundedPreceding, -1))
    front = ranges.withColumn("here", here).join(F.broadcast(before), "part", "left").where("(here IS NULL OR sy < here) AND (before IS NULL OR sy < before)").select("sx", "sy")
    return points.join(front, (F.col(x) == F.col("sx")) & (F.col(y) == F.col("sy")), "left_semi")


def pareto_ranks(points: Sequence[Sequence[float]]) -> list[int]:
    """The front (from 0) of each point: fronts are peeled off one after the other."""
    x, rank, left, k = np.array(points, float), np.zeros(len(points), int), np.arange(len(points)), 0
    while len(left):
        front = _skyline(x[left])
        rank[left[front]] = k
        left, k = left[~front], k + 1
    return rank.tolist()


def crowding_distance(df: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """key, distance: how far apart a point's neighbours are, summed over the objectives by their range.

    The ends of each objective are infinitely far; one without a range doesn't count.  For a front, which is small:
    the window is over all of it.
    """
    out = df
    total = F.lit(0.0)
    for c in objectives:
        w = Window.partitionBy(F.lit(0)).orderBy(c, key)
        span = F.max(c).over(Window.partitionBy(F.lit(0))) - F.min(c).over(Window.partitionBy(F.lit(0)))
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        part = F.when(span == 0, 0.0).when(before.isNull() | after.isNull(), float("inf")).otherwise((after - before) / span)
        total = total + part
    return out.select(key, total.alias("distance"))


def crowding_distances(points: Sequence[Sequence[float]]) -> list[float]:
    x = np.array(points, float)
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        span = np.ptp(x[:, d])
        if not span:
            continue
        order = np.argsort(x[:, d], kind="stable")
        out[order[[0, -1]]] = np.inf
        out[order[1:-1]] += (x[order[2:], d] - x[order[:-2], d]) / span
    return out.tolist()


def tournament(rank: Sequence[int], distance: Sequence[float], r: random.Random, size: int = 3, best: float = 0.8) -> int:
    """One of `size` drawn points: the lowest rank first, then the largest distance, each taken with a fixed chance."""
    drawn = sorted((r.randrange(len(rank)) for _ in range(size)), key=lambda k: (rank[k], -distance[k], k))
    for k in drawn[:-1]:
        if r.random() < best:
            return k
    return drawn[-1]


#: What a search may put together: names, and the outputs that can be worked on.
BUILDING = {"store": [], "delta": ["deltas"], "zigzag": ["v"], "range_pack": ["v"], "divide_by": ["v"], "tokenize": ["alphabet", "indices"], "transpose_split": []}


def random_graph(r: random.Random, depth: int = 3) -> dict:
    name = r.choice(sorted(BUILDING)) if depth else "store"
    return g.node(name, {o: random_graph(r, depth - 1) for o in BUILDING[name] if r.random() < 0.6})


def _places(graph: dict, path: tuple = ()) -> list[tuple]:
    return [path, *(p for name, inner in graph["outputs"].items() for p in _places(inner, (*path, name)))]


def _at(graph: dict, path: tuple) -> dict:
    for name in path:
        graph = graph["outputs"][name]
    return graph


def _with(graph: dict, path: tuple, new: dict) -> dict:
    if not path:
        return new
    return {**graph, "outputs": {**graph["outputs"], path[0]: _with(graph["outputs"][path[0]], path[1:], new)}}


def mutate(graph: dict, r: random.Random) -> dict:
    """One of four changes: a new part, a part cut short, a node put before one, a node left out."""
    path = r.choice(_places(graph))
    here, kind = _at(graph, path), r.randrange(4)
    if kind == 0:
        new = random_graph(r, 2)
    elif kind == 1:
        new = g.node("store")
    elif kind == 2:
        name = r.choice([n for n in sorted(BUILDING) if BUILDING[n]])
        new = g.node(name, {BUILDING[name][-1]: here})
    else:
        new = next(iter(here["outputs"].values()), g.node("store"))
    return _with(graph, path, new)


def crossover(a: dict, b: dict, r: random.Random) -> dict:
    """a with one of its parts replaced by one of b's."""
    return _with(a, r.choice(_places(a)), _at(b, r.choice(_places(b))))


def nodes_of(graph: dict) -> int:
    return len(_places(graph))


def fitness(graphs: Sequence[dict], sample: DataFrame) -> list[tuple[float, float]]:
    """(bytes over the sample, nodes) of each graph.  One job for all: their plans are joined by a union."""
    every = None
    for k, x in enumerate(graphs):
        size = g.size_of(x, sample).select(F.lit(k).alias("k"), "bytes")
        every = size if every is None else every.unionByName(size)
    found = {r.k: r.bytes for r in every.groupBy("k").agg(F.sum("bytes").alias("bytes")).collect()}
    return [(float(found.get(k, float("inf"))), float(nodes_of(x))) for k, x in enumerate(graphs)]


def genetic_search(sample: DataFrame, population: int = 8, generations: int = 3, seed: int = 1, start: Sequence[dict] = ()) -> list[tuple[tuple[float, float], dict]]:
    """The Pareto front of graphs found, the smallest first; the same for the same seed and sample.

    Non-dominated sorting with crowding: parents by tournament, children by crossover and mutation, the best of both
    live on.  A graph is measured once.
    """
    r, known = random.Random(seed), {}

    def measured(graphs):
        new = [x for k, x in {json.dumps(x, sort_keys=True): x for x in graphs}.items() if k not in known]
        for x, f in zip(new, fitness(new, sample) if new else [], strict=True):
            known[json.dumps(x, sort_keys=True)] = f
        return [known[json.dumps(x, sort_keys=True)] for x in graphs]

    pool = list(start) or [g.node("store"), g.node("delta", {"deltas": g.node("zigzag")}), g.node("tokenize"), g.node("range_pack")]
    pool += [random_graph(r) for _ in range(population - len(pool))]
    for _ in range(generations):
        points = measured(pool)
        rank, far = pareto_ranks(points), crowding_distances(points)
        children = []
        while len(children) < population:
            a, b = pool[tournament(rank, far, r)], pool[tournament(rank, far, r)]
            child = crossover(a, b, r) if r.random() < 0.5 else a
            children.append(mutate(child, r))
        both = list({json.dumps(x, sort_keys=True): x for x in pool + children}.values())
        points = measured(both)
        rank, far = pareto_ranks(points), crowding_distances(points)
        pool = [both[k] for k in sorted(range(len(both)), key=lambda k: (rank[k], -far[k], k))[:population]]
    points = measured(pool)
    front = [(p, x) for p, x, k in zip(points, pool, pareto_ranks(points), strict=True) if k == 0]
    return sorted(front, key=lambda x: (x[0], json.dumps(x[1], sort_keys=True)))


def combined_fronts(fronts: Sequence[Sequence[tuple[tuple[float, float], object]]]) -> list[tuple[tuple[float, float], list]]:
    """Combinations of one candidate from each front, sums of their fitness, pruned to a Pareto set after each step."""
    out: list[tuple[tuple[float, float], list]] = [((0.0, 0.0), [])]
    for front in fronts:
        every = [((p[0] + q[0], p[1] + q[1]), [*xs, x]) for p, xs in out for q, x in front]
        points = [p for p, _ in every]
        every = [e for e, k in zip(every, pareto_ranks(points), strict=True) if k == 0]
        out = sorted(every, key=lambda e: e[0])
    return out


Groups = list[list[int]]


def joined_size(streams: dict[int, DataFrame]) -> Callable[[Sequence[int]], float]:
    """The stored size of some streams joined to one, each group measured once."""
    from ..operators.structure import Concat

    known: dict[tuple[int, ...], float] = {}

    def size(group: Sequence[int]) -> float:
        key = tuple(sorted(group))
        if key not in known:
            known[key] = float(stored_size(Concat().encode(*(streams[k] for k in key))["v"]).agg(F.sum("bytes")).first()[0] or 0)
        return known[key]

    return size


def full_split(names: Sequence[int]) -> Groups:
    return [[k] for k in names]


def bottom_up(names: Sequence[int], size: Callable[[Sequence[int]], float]) -> Groups:
    """Groups joined in pairs, the pair that saves the most first, as long as one saves anything."""
    groups = full_split(names)
    while len(groups) > 1:
        saved, i, j = max(((size(a) + size(b) - size(a + b), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if saved <= 0:
            break
        i, j = -i, -j
        groups = [x for k, x in enumerate(groups) if k not in (i, j)] + [sorted(groups[i] + groups[j])]
    return sorted(groups)


def greedy(names: Sequence[int], size: Callable[[Sequence[int]], float], rounds: int = 8) -> Groups:
    """From one group: single streams leave, pairs leave together, streams move; whatever saves is taken."""
    groups = [sorted(names)]
    cost = lambda gs: sum(size(x) for x in gs if x)
    for _ in range(rounds):
        changed = False
        for k in sorted(names, key=lambda k: -size([k])):
            home = next(x for x in groups if k in x)
            rest = [x for x in groups if x is not home]
            without = [x for x in home if x != k]
            ways = [[*rest, without, [k]]]
            ways += [[*rest, [x for x in without if x != o], sorted([k, o])] for o in without]
            ways += [[*(x for x in rest if x is not to), without, sorted([*to, k])] for to in rest]
            best = min(ways, key=cost)
            if cost(best) < cost(groups):
                groups, changed = [x for x in best if x], True
        if not changed:
            break
    return sorted(groups)


def limited_sample(df: DataFrame, size: str, order_by: Sequence[str], most: int) -> DataFrame:
    """Rows in order while their sizes add up to at most `most`: for catalogues of samples, one row each."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= most).drop("total")


#: The eleven features of an integer stream.
FEATURES = ["n", "width", "cardinality", "cardinality_low", "cardinality_high", "range_size", "mean", "variance", "stddev", "skewness", "kurtosis"]


def labelled_chunks(s: DataFrame, candidates: dict[str, dict]) -> DataFrame:
    """chunk_id, the features and label: the candidate that stores the chunk smallest, the first of equals."""
    every = None
    for k, (name, graph) in enumerate(candidates.items()):
        size = g.size_of(graph, s).select("chunk_id", F.lit(name).alias("label"), F.struct("bytes", F.lit(k).alias("k")).alias("order"))
        every = size if every is None else every.unionByName(size)
    best = every.groupBy("chunk_id").agg(F.min_by("label", "order").alias("label"))
    return feature_vector(s).select("chunk_id", *FEATURES).join(best, "chunk_id")


def train_selector(examples: DataFrame, rows: int = 5000, trees: int = 12, depth: int = 2, rate: float = 0.4) -> dict:
    """A boosted-trees model (see operators.selectors) of at most `rows` labelled chunks, the first by a hash."""
    x = examples.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows).toPandas()
    values = x[FEATURES].to_numpy(float)
    labels = sorted(x["label"].unique())
    forests = []
    for name in labels if len(labels) > 1 else []:
        y, f, forest = (x["label"] == name).to_numpy(float), np.zeros(len(x)), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            nodes: list[dict] = []
            f = f + _grown(values, y - p, np.arange(len(x)), depth, rate, nodes)
            forest.append(nodes)
        forests.append(forest)
    return {"features": FEATURES, "labels": labels, "forests": forests}


def _grown(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, rate: float, nodes: list[dict]) -> np.ndarray:
    """Adds a tree over the rows to nodes; what it gives each row of x (0 for others)."""
    out, here = np.zeros(len(x)), len(nodes)
    nodes.append({})
    best = (1e-9, None, None)
    for f in range(x.shape[1]) if depth else []:
        v = x[rows, f]
        known = ~np.isnan(v)
        if known.sum() < 2:
            continue
        order = np.argsort(v[known], kind="stable")
        vs, rs = v[known][order], residual[rows][known][order]
        sums, n = np.cumsum(rs), np.arange(1, len(rs) + 1)
        cut = np.flatnonzero(vs[1:] > vs[:-1])
        if len(cut):
            gain = sums[cut] ** 2 / n[cut] + (sums[-1] - sums[cut]) ** 2 / (len(rs) - n[cut]) - sums[-1] ** 2 / len(rs)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = float(gain[k]), f, float((vs[cut[k]] + vs[cut[k] + 1]) / 2)
    if best[1] is None:
        value = rate * 4 * float(residual[rows].mean()) if len(rows) else 0.0
        nodes[here] = {"feature": -1, "value": value}
        out[rows] = value
        return out
    _, f, t = best
    less = x[rows, f] < t
    left = len(nodes)
    out += _grown(x, residual, rows[less], depth - 1, rate, nodes)
    right = len(nodes)
    out += _grown(x, residual, rows[~less], depth - 1, rate, nodes)
    nodes[here] = {"feature": f, "value": t, "left": left, "right": right, "missing": right}
    return out


#: The pipelines that a numeric selector chooses from.
NUMERIC_CHOICES = ("field_lz", "range_pack_zstd", "delta_field_lz", "tokenize_delta_field_lz", "delta_zstd", "store")


def numeric_choices() -> dict[str, dict]:
    return {n: g.PROFILES[n] if n in g.PROFILES else g.node(n) for n in NUMERIC_CHOICES}


def numeric_selector(sample: DataFrame, **options) -> dict:
    """A node that sends each chunk of integers one of six ways, learned from a sample's chunks and their features."""
    choices = numeric_choices()
    model = train_selector(labelled_chunks(sample, choices), **options)
    return g.learned(model, {n: choices[n] for n in model["labels"]})


def reservoir(items, most: int, seed: int = 1) -> list:
    """At most `most` of the items, each with the same chance, in one pass."""
    r, held = random.Random(seed), []
    for k, x in enumerate(items):
        if k < most:
            held.append(x)
        elif (at := r.randrange(k + 1)) < most:
            held[at] = x
    return held


def train(streams: dict[int, DataFrame], generations: int = 2, population: int = 6, seed: int = 1, selector: bool = True) -> dict:
    """Groups and graphs for some streams, in the order that each step needs the one before it.

    First streams are grouped (bottom up, by stored size), then a graph is searched for each group, then a selector
    over the graphs found is learned where several are in the front.  {"groups": [...], "graphs": [...], "fronts":
    [[((bytes, nodes), graph), ...], ...]}: a graph for each group, and what combinations of the fronts are worth.
    """
    from ..operators.structure import Concat

    groups = bottom_up(sorted(streams), joined_size(streams))
    graphs, fronts = [], []
    for members in groups:
        s = Concat().encode(*(streams[k] for k in members))["v"]
        front = genetic_search(s, population=population, generations=generations, seed=seed)
        best = front[0][1]
        if selector and len(front) > 1:
            ways = {f"way_{k}": x for k, (_, x) in enumerate(front)}
            model = train_selector(labelled_chunks(s, ways))
            best = g.learned(model, {n: ways[n] for n in model["labels"]})
        graphs.append(best)
        fronts.append(front)
    return {"groups": groups, "graphs": graphs, "fronts": combined_fronts(fronts)}

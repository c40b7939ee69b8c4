import random

import pytest
from streams import make, read

from strandloom.operators.selectors import BoostedTrees
from strandloom.plans import graph as g
from strandloom.plans import search as op

R = random.Random(3)


def brute_front(points):
    return [p for p in points if not any(op.dominates(q, p) for q in points)]


def test_pareto(spark):
    points = [(R.randrange(30), R.randrange(30), R.randrange(5)) for _ in range(300)] + [(0, 0, 9)] * 2
    d = spark.createDataFrame([(*p, "x") for p in points], "a int, b int, c int, t string").repartition(5)
    assert sorted((r.a, r.b, r.c) for r in op.pareto_front(d, ["a", "b", "c"]).collect()) == sorted(brute_front(points))
    left, rank = list(points), op.pareto_ranks(points)
    for k in range(max(rank) + 1):
        front = brute_front(left)
        assert sorted(front) == sorted(p for p, r in zip(points, rank, strict=True) if r == k)
        left = [p for p in left if p not in front]
    assert op.pareto_front(d.where("false"), ["a", "b"]).count() == 0


def test_crowding(spark):
    inf = float("inf")
    points = [(0, 10), (1, 5), (4, 4), (10, 0)]
    want = [inf, 4 / 10 + 6 / 10, 9 / 10 + 5 / 10, inf]
    assert op.crowding_distances(points) == pytest.approx(want)
    d = spark.createDataFrame([(k, *p, 3) for k, p in enumerate(points)], "k int, a int, b int, c int")
    assert [r.distance for r in op.crowding_distance(d, ["a", "b", "c"], "k").orderBy("k").collect()] == pytest.approx(want)


def test_tournament_prefers_rank_then_distance():
    wins = [0] * 4
    for k in range(4000):
        wins[op.tournament([1, 0, 0, 2], [9, 1, 5, 9], random.Random(k))] += 1
    assert wins[2] > wins[1] > wins[0] > wins[3]


def test_search_finds_what_helps(spark):
    s = make(spark, {0: [k * 7 for k in range(3000)]})
    found = op.genetic_search(s, population=5, generations=1, seed=2)
    stored = op.fitness([g.node("store")], s)[0][0]
    assert found[0][0][0] < stored / 5
    assert [x[0] for x in found] == sorted(x[0] for x in found)
    assert read(g.encode(found[0][1], s).decode()) == {0: [k * 7 for k in range(3000)]}


def test_changes_give_graphs():
    r = random.Random(4)
    a = op.random_graph(r)
    for _ in range(300):
        a = op.crossover(op.mutate(a, r), op.random_graph(r), r)
        assert not g.unknown_codecs(a) and op.nodes_of(a) >= 1
        if op.nodes_of(a) > 12:
            a = op.random_graph(r)


def test_combined_fronts():
    a = [((1.0, 9.0), "a1"), ((5.0, 1.0), "a2")]
    b = [((2.0, 2.0), "b1"), ((9.0, 1.0), "b2")]
    assert [x for _, x in op.combined_fronts([a, b])] == [["a1", "b1"], ["a2", "b1"], ["a2", "b2"]]


def test_groupings(spark):
    base = [R.randrange(1 << 40) for _ in range(300)]
    streams = {0: base, 1: [R.randrange(3) for _ in range(300)], 2: base, 3: [R.randrange(1 << 60) for _ in range(300)]}
    size = op.joined_size({k: make(spark, {0: v}) for k, v in streams.items()})
    for groups in (op.bottom_up(list(streams), size), op.greedy(list(streams), size)):
        assert sorted(k for x in groups for k in x) == [0, 1, 2, 3]
        assert any({0, 2} <= set(x) for x in groups)
    assert op.full_split([1, 2]) == [[1], [2]]


def test_learned_selector(spark):
    chunks = {k: [R.randrange(1 << 50) + j for j in range(200)] if k % 2 else [5 + 3 * j for j in range(200 + k)] for k in range(40)}
    s = make(spark, chunks)
    examples = op.labelled_chunks(s, {"store": g.node("store"), "delta": g.node("delta")}).cache()
    model = op.train_selector(examples)
    got = examples.withColumn("got", BoostedTrees(model).label()).collect()
    assert sum(r.got == r.label for r in got) >= 38 and {r.label for r in got} == {"store", "delta"}


def test_sample_limit(spark):
    d = spark.createDataFrame([(k, 10) for k in range(9)], "k int, n int")
    assert op.limited_sample(d, "n", ["k"], 35).count() == 3


def test_fronts_of_two_objectives_against_brute_force(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(60), r.randrange(60)) for k in range(400)] + [(1000, None, 0)]
    df = spark.createDataFrame(rows, "k long, x long, y long")
    want = {k for k, x, y in rows if x is not None and not any(a is not None and a <= x and b <= y and (a < x or b < y) for _, a, b in rows)}
    assert {q.k for q in op.pareto_front(df, ["x", "y"]).collect()} == want


def test_reservoir():
    assert op.reservoir(range(3), 5) == [0, 1, 2]
    times = [0] * 20
    for seed in range(3000):
        for x in op.reservoir(range(20), 5, seed):
            times[x] += 1
    assert all(600 < n < 900 for n in times)


def test_training_in_order(spark):
    streams = {k: make(spark, {0: [k * 1000 + i % 7 for i in range(400)]}) for k in range(3)}
    made = op.train(streams, generations=1, population=4)
    assert sorted(k for g in made["groups"] for k in g) == [0, 1, 2] and len(made["graphs"]) == len(made["groups"])
    assert all(len(xs) == len(made["groups"]) for _, xs in made["fronts"])

"""Communities by modularity against brute force, label propagation and known fixtures."""

import random

import pytest

from basaltiq.operators import communities, graph


def frame(spark, pairs):
    rows = [(a, b, w) for a, b, *rest in pairs for w in (rest or [1])]
    return spark.createDataFrame(rows, "src long, dst long, weight long").repartition(2)


def plain_modularity(pairs, label):
    total = 2 * sum(w for *_, w in pairs)
    inside, degree = {}, {}
    for a, b, w in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                degree[label[x]] = degree.get(label[x], 0) + w
                inside[label[x]] = inside.get(label[x], 0) + w * (label[x] == label[y])
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def best_modularity(pairs):
    """Over all partitions, by restricted growth strings."""
    ids = sorted({x for a, b, _ in pairs for x in (a, b)})
    best = -1.0

    def grow(k, label, most):
        nonlocal best
        if k == len(ids):
            best = max(best, plain_modularity(pairs, label))
            return
        for c in range(most + 2):
            grow(k + 1, label | {ids[k]: c}, max(most, c))

    grow(0, {}, -1)
    return best


def clique(ids):
    ids = list(ids)
    return [(a, b, 1) for k, a in enumerate(ids) for b in ids[k + 1 :]]


FIXTURES = {
    "two cliques and a bridge": clique(range(4)) + clique(range(4, 8)) + [(3, 4, 1)],
    "a ring": [(k, (k + 1) % 8, 1) for k in range(8)],
    "a star": [(0, k, 1) for k in range(1, 8)],
    "weights": [(0, 1, 9), (1, 2, 1), (2, 3, 9), (3, 4, 1), (4, 5, 9), (5, 6, 1), (6, 7, 9), (7, 0, 1)],
}


#: A ring has many partitions that no single move betters; several starts find the best.
STARTS = {"a ring": 5}


@pytest.mark.parametrize("name", FIXTURES)
def test_equals_brute_force(spark, name):
    pairs = FIXTURES[name]
    labels, q = communities.multilevel(frame(spark, pairs), starts=STARTS.get(name, 1))
    label = {r.id: r.label for r in labels.collect()}
    assert q == pytest.approx(plain_modularity(pairs, label)) == pytest.approx(best_modularity(pairs))


def test_random_graph_beats_label_propagation(spark):
    rng = random.Random(7)
    pairs = sorted({(a, b) for _ in range(260) for a, b in [sorted(rng.sample(range(60), 2))] if a // 12 == b // 12 or rng.random() < 0.15})
    pairs = [(a, b, rng.randint(1, 3)) for a, b in pairs]
    edges = frame(spark, pairs)
    labels, q = communities.multilevel(edges)
    label = {r.id: r.label for r in labels.collect()}
    assert q == pytest.approx(plain_modularity(pairs, label))
    plain = {r.id: r.label for r in graph.label_propagation(edges).collect()}
    planted = {v: v // 12 for v in label}
    assert q >= plain_modularity(pairs, plain) and q >= plain_modularity(pairs, planted) - 1e-9


def test_isolates_and_numbers_by_size(spark):
    vertices = spark.createDataFrame([(k,) for k in (1, 2, 3, 10, 11, 50, 60)], "id long")
    edges = frame(spark, [*clique([1, 2, 3]), (10, 11, 1), (60, 60, 4)])
    got = {r.id: (r.community, r.size) for r in communities.communities(vertices, edges).collect()}
    assert got == {1: (0, 3), 2: (0, 3), 3: (0, 3), 10: (1, 2), 11: (1, 2), 50: (2, 1), 60: (3, 1)}


def test_no_edges(spark):
    edges = frame(spark, [(1, 1, 1)]).where("src < 0")
    assert communities.multilevel(edges)[0].count() == 0
    assert communities.communities(spark.createDataFrame([(4,)], "id long"), edges).collect()[0].community == 0

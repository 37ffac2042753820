import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import labels as L
from ruleloom.operators import metrics as M
from ruleloom.operators import pairs as P


def one(df):
    return df.first()[0]


def long(spark, rows):
    return spark.createDataFrame([(i, j) for i, r in enumerate(rows) for j, v in enumerate(r) if v], "id long, cluster int")


def test_overlap_and_coverage(spark):
    a = long(spark, [(1, 0, 1, 0), (0, 1, 0, 0), (1, 1, 1, 1), (0, 0, 0, 0)])
    assert one(M.overlap(a)) == pytest.approx(7 / 3)
    assert one(M.coverage(a, 4)) == 0.75
    assert one(M.coverage(a, 4, percentage=False)) == 3
    assert math.isnan(one(M.overlap(a.limit(0))))


def test_divide_with_zeros(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (3.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(M.divide_with_zeros(F.col("x"), F.col("y"))).collect()] == [1.0, math.inf, 1.5]


def test_center_dists(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0)], "id long, a double, b double")
    centers = [(3, 4), (6, 8), (5, 12), (9, 12)]
    dists = lambda norm: [r["dist"] for r in M.center_dists(p, ["a", "b"], centers, norm).orderBy("cluster").collect()]
    assert dists(2) == [5, 10, 13, 15]
    assert dists(1) == [7, 14, 17, 21]
    with pytest.raises(ValueError):
        M.center_dists(p, ["a"], centers)
    with pytest.raises(ValueError):
        M.center_dists(p, ["a", "b"], centers, norm=3)


def test_ratio_on_a_center_is_infinite(spark):
    p = spark.createDataFrame([(0, 3.0, 4.0)], "id long, a double, b double")
    assert M.distance_ratio(p, ["a", "b"], [(3, 4), (6, 8)]).first()["ratio"] == math.inf


def test_cost_without_cover_is_infinite(spark):
    p = spark.createDataFrame([(0, 3.0)], "id long, a double")
    c = spark.createDataFrame([(0, 1.0)], "cluster int, a double")
    none = spark.createDataFrame([], "id long, cluster int")
    assert one(M.kmeans_cost(p, ["a"], c, none, 1, normalize=True)) == math.inf
    assert one(M.kmeans_cost(p, ["a"], c, none, 1)) == 0


def test_entropy_and_mode(spark):
    df = spark.createDataFrame([(0, int(i < 7)) for i in range(10)], "g int, v int")
    assert M.entropy(df, ["g"], "v").first()["entropy"] == pytest.approx(0.8812908992306927)
    tie = spark.createDataFrame([(0, 2), (0, 1), (0, 2), (0, 1)], "g int, v int")
    assert M.mode(tie, ["g"], "v").first()["mode"] == 1


def test_soft_labels(spark):
    sets = [[1, 3], [2], [1], [], [3], [1, 3, 4], [3]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, labels array<int>")
    back = L.assignment_to_labels(df, L.labels_to_assignment(df))
    assert {r["id"]: r["labels"] for r in back.collect()} == dict(enumerate(sets))
    assert not one(L.can_flatten(df))
    assert {r["label"] for r in L.unique_labels(df, [3]).collect()} == {1, 2, 4}


def test_update_centers_keeps_empty(spark):
    p = spark.createDataFrame([(0, 1.0), (1, 3.0)], "id long, a double")
    c = spark.createDataFrame([(0, 9.0), (1, 8.0)], "cluster int, a double")
    got = L.update_centers(p, ["a"], c, spark.createDataFrame([(0, 0), (1, 0)], "id long, cluster int"))
    assert {r["cluster"]: r["a"] for r in got.collect()} == {0: 2.0, 1: 8.0}


def test_clustering_distance_is_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        a = [sorted(rng.sample(range(4), rng.randint(0, 2))) for _ in range(25)]
        b = [sorted(rng.sample(range(4), rng.randint(0, 2))) for _ in range(25)]
        df = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, labels array<int>")
        want = sum(bool(set(a[i]) & set(a[j])) != bool(set(b[i]) & set(b[j])) for i, j in itertools.combinations(range(25), 2))
        assert one(M.clustering_distance(df(a), df(b), percentage=False)) == want


def test_silhouette_of_two_far_clusters(spark):
    p = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 9.0), (3, 9.0)], "id long, a double")
    dc = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, cluster int")
    assert one(P.silhouette(P.distances(p, ["a"]), dc)) == 1
    alone = dc.filter("id > 0").union(spark.createDataFrame([(0, 2)], "id long, cluster int"))
    assert one(P.silhouette(P.distances(p, ["a"]), alone)) == pytest.approx((0 + 0 + 1 + 1) / 4)


def test_density_distance_is_minimax_path(spark):
    rng = random.Random(5)
    pts = [(i, rng.random(), rng.random()) for i in range(14)]
    p = spark.createDataFrame(pts, "id long, a double, b double")
    d = {(i, j): math.dist(x, y) for i, *x in pts for j, *y in pts}
    core = {i: sorted(d[i, j] for j, *_ in pts)[2] for i, *_ in pts}
    m = {(i, j): max(d[i, j], core[i], core[j]) for i, j in d if i != j}
    for k, i, j in itertools.product(range(14), repeat=3):
        if len({i, j, k}) == 3:
            m[i, j] = min(m[i, j], max(m[i, k], m[k, j]))
    got = {(r["i"], r["j"]): r["d"] for r in P.density_distance(P.distances(p, ["a", "b"]), 3).collect()}
    assert got.keys() == m.keys() and all(abs(got[k] - m[k]) < 1e-12 for k in m)


def test_density_distance_on_a_line(spark):
    # the longest step between two points is the largest gap between neighbours
    x = [0.0, 1.0, 1.5, 4.0, 4.2, 7.0, 7.1, 9.0]
    p = spark.createDataFrame(list(enumerate(x)), "id long, a double")
    got = {(r["i"], r["j"]): r["d"] for r in P.density_distance(P.distances(p, ["a"]), 1).collect()}
    want = {(i, j): max(x[k + 1] - x[k] for k in range(i, j)) for i in range(8) for j in range(i + 1, 8)}
    assert got == pytest.approx(want | {(j, i): d for (i, j), d in want.items()})


def test_wide_distances_are_those_of_the_plan(spark):
    rng = random.Random(9)
    pts = [(i, *(rng.random() for _ in range(20))) for i in range(50)]
    names = [f"x{k}" for k in range(20)]
    p = spark.createDataFrame(pts, "id long, " + ", ".join(f"{x} double" for x in names))
    got = {(r["i"], r["j"]): r["d"] for r in P.distances(p, names).collect()}
    assert len(got) == 50 * 49 and all(abs(got[i, j] - math.dist(x, y)) < 1e-12 for i, *x in pts for j, *y in pts if i != j)


def test_silhouette_leaves_the_point_out(spark):
    """By definition, for clusters that overlap and for infinite distances."""
    import itertools

    from ruleloom.operators import pairs

    def brute(d, members):
        total = []
        for i in sorted({i for m in members.values() for i in m}):
            mine, scores = [c for c in members if i in members[c]], []
            mean = lambda c, i=i: (lambda o: sum(d[i, j] for j in o) / len(o) if o else 0.0)(members[c] - {i})
            for c in mine:
                a, b = mean(c), min(mean(k) for k in members if k != c)
                scores.append(0 if a == b else -1 if a == float("inf") else 1 if b == float("inf") else (b - a) / max(a, b))
            total.append(sum(scores) / len(mine))
        return sum(total) / len(total)

    x = {0: 0.0, 1: 1.0, 2: 2.5, 3: 7.0, 4: 7.0}
    inf = float("inf")
    for members, cut in (({0: {0, 1, 2}, 1: {2, 3}}, None), ({0: {0, 1}, 1: {1, 2}, 2: {1}}, None), ({0: {0, 1}, 1: {2, 3}, 2: {4}}, 5.0), ({0: {0, 3}, 1: {1, 2}}, 5.0), ({0: {0, 3}, 1: {4}}, 5.0)):
        d = {(i, j): (abs(x[i] - x[j]) if cut is None or abs(x[i] - x[j]) < cut else inf) for i, j in itertools.permutations(x, 2)}
        dist = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "i long, j long, d double")
        dc = spark.createDataFrame([(i, c) for c, m in members.items() for i in m], "id long, cluster int")
        assert pairs.silhouette(dist, dc).first()[0] == pytest.approx(brute(d, members), abs=1e-9)


def test_all_measures_of_a_rule_set(spark):
    from ruleloom.model import Condition, Rule, RuleSet
    from ruleloom.plans.experiments import measure

    p = spark.createDataFrame([(0, 0.0, 0), (1, 1.0, 0), (2, 4.0, 1), (3, 9.0, 1)], "id long, x double, label int")
    rules = RuleSet((Rule((Condition.axis("x", 4.0),), 0), Rule((Condition.axis("x", 2.0, 1),), 1)))  # both have point 2
    got = measure(p, rules, 1.0, ["x"], [[0.0], [9.0]], P.distances(p, ["x"]))
    assert got["clustering_cost"] == pytest.approx((0 + 1 + (16 + 25) / 2 + 0) / 4)
    assert got["distance_ratio"] == math.inf and got["coverage"] == 1 and got["overlap"] == 1.25  # 9 / 0 at both ends
    a, b = [2.5, 2.0, 3.5, 5.0], [6.5, 5.5, 5.0, 22 / 3]
    want = [(y - x) / max(x, y) for x, y in zip(a, b, strict=True)]
    want[2] = (want[2] + (3.5 - 5.0) / 5.0) / 2  # point 2 in both of its clusters
    assert got["silhouette"] == pytest.approx(sum(want) / 4)

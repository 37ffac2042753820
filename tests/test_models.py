import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.functions.binning import entropy_cuts
from ruleloom.model import Condition, Rule, RuleSet
from ruleloom.operators import clusters as C
from ruleloom.operators import labels as L
from ruleloom.operators import ranking as R
from ruleloom.operators import splits as S
from ruleloom.operators.boxes import blocks_of
from ruleloom.operators.select import coverage_mistake_select, coverage_objective, kmeans_objective, select_for_lambdas, select_with_grid
from ruleloom.operators.graphs import spanning_tree
from ruleloom.operators.pairs import distances
from ruleloom.plans.experiments import lambda_fits
from ruleloom.plans.mining import ClassAssociationMiner, PointwiseMiner, _Growth
from ruleloom.plans.sets import CBA, IDS, DecisionSet, DSCluster, coordinate_ascent, ids_objective, ids_search, ids_statistics, ids_weights, mean_auc, rule_patterns
from ruleloom.plans.trees import DecisionTree, ExplanationTree, ID3Tree, ImmTree, ObliqueTree
from ruleloom.streaming.scoring import score_stream


def points(spark, rows):
    d = len(rows[0]) - 2
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{k} double" for k in range(d)) + ", label int")


def tables(spark, data_rule, data_cluster):
    dr = spark.createDataFrame([(i, j) for i, r in enumerate(data_rule) for j, v in enumerate(r) if v], "id long, rule_id int")
    dc = spark.createDataFrame([(i, j) for i, r in enumerate(data_cluster) for j, v in enumerate(r) if v], "id long, cluster int")
    return dr, dc


def greedy(data_rule, rule_label, truth, n_rules, lam):
    """The definition, literally."""
    covers = {j: {i for i, r in enumerate(data_rule) if r[j]} for j in rule_label}
    right = {j: {i for i in covers[j] if truth[i] == y} for j, y in rule_label.items()}
    done, chosen = {y: set() for y in set(rule_label.values())}, []
    for i in range(n_rules):
        best, score = None, -math.inf
        for j, y in rule_label.items():
            if j not in chosen:
                s = (1 - 1 / n_rules) ** (n_rules - i - 1) * len(right[j] - done[y]) - lam * len(covers[j] - right[j])
                if s > score:
                    best, score = j, s
        if score > 0:
            chosen.append(best)
            done[rule_label[best]] |= right[best]
    return sorted(chosen)


@pytest.mark.parametrize("lam", [0.0, 0.3, 1.0])
def test_selection_is_the_literal_greedy(spark, lam):
    rng = random.Random(7)
    data_rule = [[rng.random() < 0.4 for _ in range(6)] for _ in range(40)]
    truth = [rng.randrange(3) for _ in range(40)]
    labels = {j: j % 3 for j in range(6)}
    dr, dc = tables(spark, data_rule, [[truth[i] == k for k in range(3)] for i in range(40)])
    rc = spark.createDataFrame(list(labels.items()), "rule_id int, cluster int")
    assert coverage_mistake_select(dc, rc, dr, 4, lam) == greedy(data_rule, labels, truth, 4, lam)


def test_infeasible_grid(spark):
    dr, dc = tables(spark, [[1], [0], [0]], [[1], [1], [1]])
    rc = spark.createDataFrame([(0, 0)], "rule_id int, cluster int")
    assert select_with_grid(dc, rc, dr, 3, 1, 1.0, [0.0, 1.0], lambda _: 0.0) is None
    assert select_with_grid(dc, rc, dr, 3, 1, 0.3, [0.0], lambda _: 0.0) == [0]


def test_gain_is_the_entropy_and_ties_go_low(spark):
    p = points(spark, [(0, 1.0, 2.0, 0), (1, 3.0, 1.0, 0), (2, 5.0, 3.0, 0), (3, 7.0, 4.0, 1)])
    best = S.best_splits(S.candidates(p, S.axes(["f0", "f1"]), [0, 1]), S.information_gain(4)).first()
    assert (best["feature"], best["threshold"]) == (0, 5.0)
    assert best["gain"] == pytest.approx(0.8112781244591328)


def test_center_split_ties(spark):
    p = points(spark, [(0, 3.0, 4.0, 0), (1, 5.0, 12.0, 0), (2, 8.0, 15.0, 1), (3, 7.0, 24.0, 1)])
    gain = S.center_gain({0: (2, 3), 1: (8, 25)}, [0, 1], S.axes(["f0", "f1"]), ["f0", "f1"])
    best = S.best_splits(S.candidates(p, S.axes(["f0", "f1"]), [0, 1]), gain).first()
    assert (best["feature"], best["threshold"], best["gain"]) == (0, 5.0, 0.0)


def test_split_search_is_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(8)), float(rng.randrange(8)), rng.randrange(3)) for i in range(60)]
    h = lambda ys: -sum(ys.count(y) / len(ys) * math.log2(ys.count(y) / len(ys)) for y in set(ys)) if ys else 0
    best = None
    for f in (0, 1):
        for t in sorted({r[1 + f] for r in rows})[:-1]:
            a, b = [r[3] for r in rows if r[1 + f] <= t], [r[3] for r in rows if r[1 + f] > t]
            g = round(h(a + b) - len(a) / 60 * h(a) - len(b) / 60 * h(b), 12)
            if best is None or g > best[0] + 1e-11:
                best = (g, f, t)
    got = S.best_splits(S.candidates(points(spark, rows), S.axes(["f0", "f1"]), [0, 1, 2]), S.information_gain(60)).first()
    assert (got["feature"], got["threshold"]) == best[1:] and got["gain"] == pytest.approx(best[0])


def grid(n=120):
    rng = random.Random(1)
    out = []
    for i in range(n):
        a, b = rng.random(), rng.random()
        out.append((i, a, b, 0 if a <= 0.5 else 1 if b <= 0.4 else 2))
    return out


def accuracy(p, predicted):
    return p.join(predicted, "id").agg(F.avg((F.get("labels", F.lit(0)) == F.col("label")).cast("int"))).first()[0]


def test_trees_part_the_points(spark):
    p = points(spark, grid()).cache()
    for tree in (ID3Tree(["f0", "f1"], max_leaf_nodes=3), DecisionTree(["f0", "f1"], max_leaf_nodes=3, criterion="gini")):
        tree.fit(p)
        assert len(tree.root.leaves()) == 3
        assert accuracy(p, tree.predict(p)) == 1.0
        leaf = tree.predict(p, leaf_labels=True).groupBy(F.get("labels", F.lit(0))).count()
        assert leaf.count() == 3 and leaf.agg(F.sum("count")).first()[0] == 120
    with pytest.raises(ValueError):
        DecisionTree(["f0"], criterion="mse").fit(p)


def test_cart_cuts_midway_also_below_the_highest_value(spark):
    p = points(spark, [(0, 1.0, 0), (1, 1.0, 0), (2, 4.0, 1)])
    assert DecisionTree(["f0"], max_leaf_nodes=2).fit(p).root.condition.threshold == 2.5


def test_pure_nodes_are_not_split(spark):
    assert len(ID3Tree(["f0", "f1"]).fit(points(spark, grid())).root.leaves()) == 3


def test_explanation_tree_removes_straddlers(spark):
    rows = [(i, float(i), 0 if i < 5 or i == 9 else 1) for i in range(10)]
    p = points(spark, rows)
    tree = ExplanationTree(["f0"], num_clusters=2).fit(p)
    assert [r["id"] for r in tree.outliers.collect()] == [9]
    got = {r["id"]: r["labels"] for r in tree.predict(p, remove_outliers=True).collect()}
    assert got[9] == [-1] and got[0] == [0] and got[8] == [1]


def test_imm_has_a_leaf_for_each_center(spark):
    rng = random.Random(4)
    centers = [(0.0, 0.0), (5.0, 0.0), (0.0, 5.0)]
    rows = [(i, c[0] + rng.gauss(0, 0.4), c[1] + rng.gauss(0, 0.4), 0) for i, c in enumerate(centers * 20)]
    tree = ImmTree(["f0", "f1"], centers=centers).fit(points(spark, rows))
    assert sorted(n.label for n in tree.root.leaves()) == [0, 1, 2]


def test_entropy_cuts_find_the_borders(spark):
    cuts = entropy_cuts(points(spark, grid(400)), ["f0", "f1"], "label")
    assert any(abs(c - 0.5) < 0.02 for c in cuts["f0"]) and any(abs(c - 0.4) < 0.03 for c in cuts["f1"])


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def mdl(values, by, a, z):
    total = [sum(c) for c in zip(*by[a:z], strict=True)] if z > a else []
    n = sum(total)
    if z - a < 2 or sum(c > 0 for c in total) < 2:
        return []
    h, left, best, at = entropy(total), [0] * len(total), None, -1
    for k in range(a, z - 1):
        left = [x + y for x, y in zip(left, by[k], strict=True)]
        right = [t - x for t, x in zip(total, left, strict=True)]
        e = (sum(left) * entropy(left) + sum(right) * entropy(right)) / n
        if best is None or e < best[0] - 1e-12:
            best, at = (e, left, right), k
    e, left, right = best
    k, k1, k2 = (sum(c > 0 for c in x) for x in (total, left, right))
    delta = math.log2(3**k - 2) - (k * h - k1 * entropy(left) - k2 * entropy(right))
    if h - e <= (math.log2(n - 1) + delta) / n:
        return []
    cut = (values[at] + values[at + 1]) / 2
    return [*mdl(values, by, a, at + 1), cut, *mdl(values, by, at + 1, z)]


def test_entropy_cuts_are_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        v = rng.randint(0, 300) / 4
        rows.append((i, v, (0 if v < 20 else 1 if v < 45 else 2) if rng.random() < 0.9 else rng.randint(0, 2)))
    values = sorted({v for _, v, _ in rows})
    place = {v: k for k, v in enumerate(values)}
    by = [[0, 0, 0] for _ in values]
    for _, v, y in rows:
        by[place[v]][y] += 1
    want = mdl(values, by, 0, len(values))
    got = entropy_cuts(points(spark, [*rows, (9000, None, 1), (9001, float("nan"), 2)]), ["f0"], "label")["f0"]
    assert got == pytest.approx(sorted(want)) and len(want) >= 2
    assert entropy_cuts(points(spark, [(0, 1.0, 0), (1, 2.0, 0)]), ["f0"], "label") == {"f0": []}


def test_decision_sets(spark):
    p = points(spark, grid()).cache()
    miner = ClassAssociationMiner(["f0", "f1"], min_support=0.05, min_confidence=0.8, cuts={"f0": [0.5], "f1": [0.4]})
    for model in (DSCluster(miner=miner, n_rules=4, lambd=2.0), CBA(miner=miner), IDS(miner=miner)):
        model.fit(p)
        assert 0 < len(model.rules) <= 4
    assert accuracy(p, DSCluster(miner=miner, n_rules=4, lambd=2.0).fit(p).predict(p)) == 1.0
    with pytest.raises(ValueError):
        DecisionSet()
    with pytest.raises(ValueError):
        ClassAssociationMiner(["f0"], min_support=2.0)
    with pytest.raises(ValueError):
        CBA(miner=PointwiseMiner(["f0"]))


def test_pointwise_boxes_hold_one_label(spark):
    p = points(spark, grid(60)).cache()
    rules = PointwiseMiner(["f0", "f1"], samples=1, prob_dim=0.01).fit(p)
    hits = L.data_to_rules(p, rules).join(p.select("id", "label"), "id").join(L.rules_to_clusters(spark, rules), "rule_id")
    assert hits.filter("label <> cluster").count() == 0 and len(rules) > 5
    again = PointwiseMiner(["f0", "f1"], samples=1, prob_dim=0.01).fit(p)
    assert again == rules


def test_pointwise_boxes_are_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randint(0, 25)), float(rng.randint(0, 25)), rng.choice([0, 0, 0, 1])) for i in range(150)]
    p = points(spark, [*rows, (900, None, 1.0, 0)])
    for prob_stop in (1.0, 0.4):
        make = lambda block, prob_stop=prob_stop: PointwiseMiner(["f0", "f1"], samples=2, prob_stop=prob_stop, block=block)
        found = make(4096).table(p).collect()
        assert sorted(map(tuple, found), key=str) == sorted(map(tuple, make(40).table(p).collect()), key=str)  # blocks change nothing
        for r in found:
            hit = [y for _, a, b, y in rows if r["lo"][0] < a <= r["hi"][0] and r["lo"][1] < b <= r["hi"][1]]
            assert r["n"] == len(hit) and r["support"] == pytest.approx(len(hit) / 150)
            assert r["confidence"] == pytest.approx(hit.count(r["label"]) / len(hit))
        sure = sum(r["confidence"] == 1.0 for r in found) / len(found)
        assert sure > 0.5 if prob_stop == 1 else sure < 1


def test_a_box_moves_one_side_at_a_time():
    grow = _Growth(2, 0.01, 1.0, 3)
    rng = np.random.default_rng(5)
    for key in range(200):
        x = rng.integers(0, 40, (60, 2))
        p, last = x[0], [39, 39]
        others = x[1:]
        sides = sorted((t, k, side) for k in map(int, grow.chosen(0, key)) for side in (0, 1) for t in grow.moves(0, key, k, side, 40))
        lo, hi = [-1, -1], [39, 39]
        for k in map(int, grow.chosen(0, key)):
            lo[k], hi[k] = p[k] - 1, p[k]
        had = np.all((others > lo) & (others <= hi), axis=1)
        for _, k, side in sides:
            new_lo, new_hi = list(lo), list(hi)
            if side:
                new_hi[k] = min(39, hi[k] + 1)
            else:
                new_lo[k] = max(-1, lo[k] - 1)
            if (np.all((others > new_lo) & (others <= new_hi), axis=1) & ~had).any():
                break
            lo, hi = new_lo, new_hi
        assert grow.box(0, key, p, grow.stop(0, key, p, others, reach=2), last) == (lo, hi)


def test_tree_counts_points_in_tasks_of_bounded_size(spark, monkeypatch):
    p = points(spark, grid(300)).coalesce(1)
    whole, tasks = ObliqueTree(["f0", "f1"], max_leaf_nodes=4).fit(p).root, []

    class Seen(ObliqueTree):
        def _grow(self, points):
            tasks.append(points.rdd.glom().map(len).collect())
            super()._grow(points)

    monkeypatch.setattr("ruleloom.plans.trees.CELLS", 400)
    assert Seen(["f0", "f1"], max_leaf_nodes=4).fit(p).root == whole
    assert len(tasks[0]) == 6 and sum(tasks[0]) == 300 and max(tasks[0]) < 100


def test_a_box_meets_few_blocks(spark):
    """Points of a seed's block and of those that its box reaches stop it as all points do."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 300, (2000, 2)), rng.integers(0, 3, 2000)
    p = spark.createDataFrame([(at, label) for at, label in zip(x.tolist(), y.tolist(), strict=True)], "p array<long>, label int")
    blocks, rows = blocks_of(p, 2, 50)
    of: dict = {}
    for r in rows.collect():
        of.setdefault((r["kind"], r["kb"]), []).append((*r["p"], r["label"]))
    assert max(len(v) for (kind, _), v in of.items() if kind == 2) < 150 and len(of) > 40
    grow, looked = _Growth(2, 0.01, 1.0, 3), []
    for i in range(100):
        home = blocks.home(2, x[i : i + 1])[0]
        stop = lambda b, i=i: grow.stop(0, i, x[i], np.array([v[:2] for v in of[2, b] if v[2] != y[i]], int).reshape(-1, 2))
        t = stop(home)
        a, z = (np.array([side]) for side in grow.box(0, i, x[i], t, [299, 299]))
        near = [b for b in blocks.names[2][blocks.met(2, a, z)[0][0]].tolist() if b != home]
        assert min([t, *map(stop, near)]) == grow.stop(0, i, x[i], x[y != y[i]])
        looked.append(1 + len(near))
    assert np.mean(looked) < 4


def test_predict_without_cover_and_on_a_stream(spark, tmp_path):
    p = points(spark, grid(20))
    rules = RuleSet((Rule((Condition.axis("f0", 0.5),), 4),))
    got = {tuple(r["labels"]) for r in L.predict(p, rules).collect()}
    assert got == {(4,), (-1,)}
    p.write.parquet(str(tmp_path / "p"))
    stream = score_stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "p")), rules)
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, L.predict(p, rules).collect()))


def test_dbscan_is_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.random() * 4, rng.random() * 4) for i in range(70)]
    near = {i: {j for j, *y in pts if j != i and math.dist(x, y) <= 0.45} for i, *x in pts}
    core = {i for i in near if len(near[i]) + 1 >= 4}
    comp, k = {}, 0
    for i in sorted(core):
        if i not in comp:
            todo = [i]
            while todo:
                v = todo.pop()
                if v not in comp:
                    comp[v] = k
                    todo += near[v] & core
            k += 1
    want = {i: comp[i] if i in comp else min((comp[j] for j in near[i] & core), default=-1) for i in near}
    df = spark.createDataFrame(pts, "id long, a double, b double")
    assert {r["id"]: r["label"] for r in C.dbscan(df, ["a", "b"], 0.45, 4).collect()} == want


def test_single_linkage_is_brute_force_on_a_chain(spark):
    rng = random.Random(9)
    at = [sum(rng.choice([1.0, 1.5, 2.0]) for _ in range(i)) for i in range(24)]
    pts = [(i, x + (50.0 if i >= 16 else 0.0)) for i, x in zip(rng.sample(range(24), 24), sorted(at), strict=True)]
    df = spark.createDataFrame(pts, "id long, a double")
    dist = distances(df, ["a"]).cache()
    edges = sorted(((r["d"], r["i"], r["j"]) for r in dist.filter("i < j").collect()))
    up, want = {i: i for i, _ in pts}, set()
    root = lambda x: x if up[x] == x else root(up[x])
    for d, i, j in edges:
        if root(i) != root(j):
            up[root(i)] = root(j)
            want.add((i, j, d))
    for held in (0, 1000):
        assert {tuple(r) for r in spanning_tree(dist, held).collect()} == want
    kept = sorted(want, key=lambda e: (e[2], e[0], e[1]))[:-2]
    up = {i: i for i, _ in pts}
    for i, j, _ in kept:
        up[root(i)] = root(j)
    least = {}
    for i in sorted(up):
        least.setdefault(root(i), len(least))
    assert {r["id"]: r["label"] for r in C.single_linkage(dist, df, 3).collect()} == {i: least[root(i)] for i in up}


def ids_stats(n, rng):
    rules = [Rule(tuple(Condition.axis("f0", float(k)) for k in range(1 + i % 3)), i % 2) for i in range(n)]
    ok = {i: rng.randint(0, 40) for i in range(n)}
    pairs = {(i, j): rng.randint(0, 15) for i in range(n) for j in range(i + 1, n)}
    return {"n": 60, "rules": rules, "cover": {i: k + rng.randint(0, 15) for i, k in ok.items()}, "ok": ok, "pairs": pairs}


def test_ids_weights_are_averages_over_random_sets():
    rng = random.Random(4)
    s, lambdas = ids_stats(6, rng), (1.0, 0.5, 2.0, 0.3, 7.0, 1.5, 1.1)
    chance = [rng.random() for _ in range(6)]
    for i, w in enumerate(ids_weights(s, chance, lambdas)):
        want = 0.0
        for m in range(64):
            c = {k for k in range(6) if m >> k & 1}
            if i not in c:
                p = math.prod(chance[k] if k in c else 1 - chance[k] for k in range(6) if k != i)
                want += p * (ids_objective(s, c | {i}, lambdas) - ids_objective(s, c, lambdas))
        assert w == pytest.approx(want)


def test_ids_search_is_near_the_best_and_has_no_limit_of_moves():
    rng = random.Random(5)
    for _ in range(20):
        s = ids_stats(8, rng)
        every = [ids_objective(s, {k for k in range(8) if m >> k & 1}, (1.0,) * 7) for m in range(256)]
        assert ids_objective(s, ids_search(s, (1.0,) * 7), (1.0,) * 7) >= 0.4 * max(every)
    s = ids_stats(70, rng)
    s["pairs"], s["ok"], s["cover"] = {}, dict.fromkeys(range(70), 50), dict.fromkeys(range(70), 50)
    assert ids_search(s, (1.0,) * 7) == set(range(70))


def test_objectives_of_the_grid(spark):
    """Nine points of three clusters; all but the first lambda keep rules that cover two thirds or all."""
    x = [(10.0, 0.0)] * 3 + [(0.0, 1.0)] * 3 + [(-10.0, 0.0)] * 3
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "id long, f0 double, f1 double")
    centers = spark.createDataFrame([(0, 5.0, 0.0), (1, 0.0, 0.0), (2, -5.0, 0.0)], "cluster int, f0 double, f1 double")
    rc = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 2, 1)], "rule_id int, cluster int, length int")
    hits = spark.createDataFrame([(i, i // 3) for i in range(9)] + [(0, 1)], "id long, rule_id int")
    cost = kmeans_objective(p, ["f0", "f1"], centers, rc)
    assert cost(hits) == 3 * 25 + 3 * 1 + 3 * 25 + 100
    assert cost(hits.filter("rule_id = 1")) == 3 + 100
    assert kmeans_objective(p, ["f0", "f1"], centers, rc, normalize=True)(hits.limit(0)) == math.inf
    assert coverage_objective(9)(hits.filter("rule_id < 2")) == pytest.approx(-6 / 9)
    truth = spark.createDataFrame([(i, i // 3) for i in range(9)], "id long, cluster int")
    assert select_with_grid(truth, rc, hits, 9, 3, 1.0, [0.0, 0.5], coverage_objective(9)) == [0, 1, 2]


def test_lambdas_in_lock_step_are_separate_fits(spark):
    rng = random.Random(21)
    rows = [(i, rng.random() * 10, rng.random() * 10, rng.randint(0, 2)) for i in range(150)]
    p = points(spark, rows).cache()
    rules = RuleSet(tuple(Rule((Condition.axis("f0", rng.random() * 10, rng.choice([-1, 1])), Condition.axis("f1", rng.random() * 10, rng.choice([-1, 1])))[: rng.randint(1, 2)], rng.randint(0, 2)) for _ in range(12)))
    lams = [0.0, 0.1, 0.3, 0.6, 1.0, 5.0, 1000.0]
    hits, rc = L.data_to_rules(p, rules), L.rules_to_clusters(spark, rules)
    truth = p.select("id", F.col("label").alias("cluster"))
    together = select_for_lambdas(truth, rc, hits, 4, lams)
    covered = {(r["id"], r["rule_id"]) for r in hits.collect()}
    data_rule = [[int((i, j) in covered) for j in range(12)] for i in range(150)]
    labels = {j: r.label for j, r in enumerate(rules)}
    assert together == [sorted(greedy(data_rule, labels, [r[3] for r in rows], 4, lam)) for lam in lams]
    assert len(set(map(tuple, together))) > 3
    got = {(r["metric"], r["x"], r["sample"]): r["value"] for r in lambda_fits(p, lambda sample: rules, lams, 4, 2).collect()}
    assert len(got) == 3 * len(lams) * 2
    for lam, chosen in zip(lams, together, strict=True):
        pairs = [(i, j) for i, j in covered if j in chosen]
        score = len({i for i, _ in pairs}) - lam * sum(rows[i][3] != labels[j] for i, j in pairs)
        assert got["coverage_mistake_score", lam, 1] == pytest.approx(score)
        assert got["max_rule_length", lam, 0] == max((len(list(rules)[j].conditions) for j in chosen), default=0)


# spans and rank selection


def test_sums_by_spans_are_those_of_the_whole(spark):
    """One value holds a third of the rows; spans of every number of edges give the same."""
    rng = random.Random(3)
    rows = [(i, 7.0 if i % 3 == 0 else round(rng.gauss(5, 4), 1), float(rng.randint(0, 3)), rng.randint(0, 2)) for i in range(900)]
    p = points(spark, [*rows, (5000, None, float("nan"), 1)]).cache()
    node = F.when(F.col("f1") > 1, 1).otherwise(0)
    want = {}
    for k in (0, 1):
        for n in (0, 1):
            own = [r for r in rows if (r[2] > 1) == n]
            values = sorted({r[1 + k] for r in own})
            for t, above in zip(values, values[1:], strict=False):
                sides = [[sum(r[3] == y and (r[1 + k] <= t) == low for r in own) for y in range(3)] for low in (True, False)]
                want[n, k, t] = (above, *map(tuple, sides))
    for spans in (None, {0: [], 1: []}, {0: [1.0, 6.9, 7.0, 7.1], 1: [0.0]}, {0: [x / 4 for x in range(-20, 60)]}):
        got = S.candidates(p.filter("f0 IS NOT NULL"), S.axes(["f0", "f1"]), [0, 1, 2], node, spans=spans).collect()
        assert {(r["node"], r["feature"], r["threshold"]): (r["above"], tuple(r["l"]), tuple(r["r"])) for r in got} == want
    plan = S.candidates(p, S.axes(["f0"]), [0, 1, 2], spans={0: [1.0]})._jdf.queryExecution().optimizedPlan().toString()
    assert "_b" in plan


def test_order_statistics_are_exact(spark):
    rng = random.Random(11)
    columns = [[rng.gauss(0, 1) for _ in range(4000)], [3.0] * 2500 + [float(rng.randint(0, 5)) for _ in range(1500)], [10.0 ** rng.randint(-300, 300) for _ in range(4000)], [1.0] * 4000]
    cells = spark.createDataFrame([(f, v) for f, c in enumerate(columns) for v in c] + [(0, None)] * 9, "feature int, value double").repartition(4)
    ranks = [0, 1, 999, 1000, 2000, 2001, 3998, 3999]
    for held in (2, 50, 10**6):
        got = R.order_statistics(cells, {f: ranks for f in range(4)}, held)
        assert got == {f: {r: sorted(c)[r] for r in ranks} for f, c in enumerate(columns)}
    assert R.order_statistics(cells.limit(0), {0: [0]}) == {0: {}}


def test_quantiles_are_those_of_numpy(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([1.5, 2.5, rng.random() * 9]), float(i), 0) for i in range(3001)]
    p = points(spark, [*rows, (9000, None, None, 0)])
    shares = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1]
    got = R.quantiles(p, ["f0", "f1"], shares)
    for k, f in ((1, "f0"), (2, "f1")):
        assert got[f] == pytest.approx(np.quantile([r[k] for r in rows], shares), rel=1e-12)
    assert R.quantiles(p.limit(0), ["f0"], shares) == {"f0": []}


# IDS's weights


def brute_auc(rows, rules, stats, chosen):
    aucs = []
    for y in sorted({r[3] for r in rows} | {r.label for r in rules}):
        conf = {i: stats["ok"].get(i, 0) / stats["cover"][i] for i in chosen if rules[i].label == y and stats["cover"].get(i)}
        fits = lambda r, i: all((r[1] <= c.threshold) if c.direction < 0 else (r[1] > c.threshold) for c in rules[i].conditions)
        score = [max((c for i, c in conf.items() if fits(r, i)), default=0.0) for r in rows]
        pos, neg = [s for s, r in zip(score, rows, strict=True) if r[3] == y], [s for s, r in zip(score, rows, strict=True) if r[3] != y]
        if pos and neg:
            aucs.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    return sum(aucs) / len(aucs)


def test_ids_searches_for_weights(spark):
    rng = random.Random(13)
    rows = [(i, x := rng.random() * 10, 0.0, int(x > 4) if rng.random() < 0.8 else 2) for i in range(120)]
    p = points(spark, rows).cache()
    rules = RuleSet((Rule((Condition.axis("f0", 4.0),), 0), Rule((Condition.axis("f0", 4.0, 1),), 1), Rule((Condition.axis("f0", 9.0),), 1), Rule((Condition.axis("f0", 2.0, 1),), 2), Rule((Condition.axis("f0", 1.0),), 2)))
    stats = ids_statistics(p, rules)
    patterns = rule_patterns(p, rules).cache()
    sets = [frozenset(i for i in range(5) if m >> i & 1) for m in range(32)]
    every = {c: brute_auc(rows, list(rules), stats, c) for c in sets}
    for c in sets[::3]:
        assert mean_auc(patterns, stats, c) == pytest.approx(every[c])
    # all sets that weights from a grid lead to
    reached = {frozenset(ids_search(stats, [rng.choice([0.0, 1.0, 5.0, 20.0]) for _ in range(7)])) for _ in range(3000)}
    model = IDS(given=rules, lambdas=None, ranges=[(0, 20)] * 7, precision=1.0).fit(p)
    assert model.auc == pytest.approx(max(every[c] for c in reached)) and len(reached) > 3
    assert model.rules == rules.subset(sorted(ids_search(stats, model.weights)))
    assert all(0 <= w <= 20 for w in model.weights)
    for bad in ({"lambdas": [1.0]}, {"ranges": [(0, 1)]}, {"precision": 0.0}, {"max_iterations": 0}):
        with pytest.raises(ValueError):
            IDS(given=rules, **({"lambdas": None} | bad))


def test_coordinate_ascent_finds_a_ridge():
    score = lambda w: -abs(w[0] - 3) - abs(w[1] - 7)
    best, s = coordinate_ascent(score, [(0, 10), (0, 10)], 0.01, 50)
    assert best == pytest.approx([3, 7], abs=0.05) and s == score(best)
    assert coordinate_ascent(score, [(2, 2), (5, 5)], 0.01, 1)[0] == [2, 5]


@pytest.mark.parametrize("d, eps, n_core", [(1, 0.11, 4), (2, 1.0, 5), (2, 2.0, 12), (3, 1.5, 6)])
def test_dbscan_by_cells_is_that_by_pairs(spark, monkeypatch, d, eps, n_core):
    from ruleloom.operators import grids

    rng = np.random.default_rng(d + n_core)
    x = np.concatenate([np.round(rng.normal(0, 1, (150, d)), 1), rng.uniform(-9, 9, (60, d)).round(), np.zeros((40, d))]) * (0.2 if d == 1 else 1.0)
    names = [f"f{k}" for k in range(d)]
    p = spark.createDataFrame([(3 * i + 1, *map(float, r)) for i, r in enumerate(x)] + [(2, *[None] * d), (3, *[float("nan")] * d)], "id long, " + ", ".join(f"{f} double" for f in names))
    monkeypatch.setattr(grids, "UNIT", 16)
    pairs = []
    monkeypatch.setattr(C, "neighbours", lambda *a, f=C.neighbours: (pairs.append(1), f(*a))[1])
    got, core = ({r[0]: r[1] for r in f(p, names, eps, n_core).collect()} for f in (C.dbscan, C.core_points))
    assert not pairs  # no row for a pair
    monkeypatch.setattr(grids, "DIMENSIONS", 0)
    assert got == {r[0]: r[1] for r in C.dbscan(p, names, eps, n_core).collect()} and len(set(got.values())) > 1
    assert core == {r[0]: r[1] for r in C.core_points(p, names, eps, n_core).collect()}

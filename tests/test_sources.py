import math
import random

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import binning as B
from ruleloom.operators import ranking
from ruleloom.plans import experiments as X
from ruleloom.plans.modules import AgglomerativeBase, DBSCANBase, DecisionForest, DecisionSetMod, IMMBase, KMeansBase
from ruleloom.plans.sets import DSCluster
from ruleloom.model import Condition, Rule, RuleSet
from ruleloom.sources import datasets as D
from ruleloom.sources import tables as T
from ruleloom.streaming.scoring import cover_by_window


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv_features_drop_scale_and_keep_repeats(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b,c\n1,2,x\n3,4,y\n3,4,y\nbad,1,z\n")
    p, features, scaler = D.csv_features(spark, path, drop=1)
    assert features == ["a", "b"] and p.count() == 3 and p.select("id").distinct().count() == 3
    assert scaler["a"][0] == pytest.approx(7 / 3)
    assert p.agg(F.sum("a")).first()[0] == pytest.approx(0)


def test_scaled_csv_keeps_labels(spark, tmp_path):
    path = str(tmp_path / "images.csv")
    with open(path, "w") as f:
        f.write("p0,p1,class\n0,4,7\n16,4,2\n8,4,7\n8,4,7\n")
    p, features, scaler = D.scaled_csv(spark, path, "class")
    assert features == ["p0", "p1"] and set(scaler) == {"p0", "p1"}
    assert sorted((r["p0"], r["p1"], r["label"]) for r in p.collect()) == [(0.0, 0.0, 7), (0.5, 0.0, 7), (0.5, 0.0, 7), (1.0, 0.0, 2)]
    assert p.select("id").distinct().count() == 4


def test_labelled_csv(spark, tmp_path):
    path = write(tmp_path, "b.csv", "a,k\n1,dog\n2,cat\n,dog\n")
    assert sorted(r["label"] for r in D.labelled_csv(spark, path, ["a"], "k").collect()) == [0, 1]


def test_climate(spark, tmp_path):
    path = write(tmp_path, "c.csv", "ID,Year,jan\n7,1950,2.0\n7,1960,4.0\n7,2015,6.0\n8,1950,1.0\n")
    got = {r["ID"]: r["jan"] for r in D.climate(spark, path).collect()}
    assert got == {"0007": 1.0, "0008": None}


def test_spiral_has_jittered_rows(spark, tmp_path):
    path = write(tmp_path, "s.csv", "i,0,1,labels\n" + "".join(f"{i},{i}.5,{-i}.0,{i % 3 + 1}\n" for i in range(20)))
    p, _ = D.spiral(spark, path, more=30)
    assert p.count() == 50 and p.select("id").distinct().count() == 50


def test_scaling_of_constants(spark):
    p = spark.createDataFrame([(0, 5.0), (1, 5.0)], "id long, a double")
    assert [r["a"] for r in B.scale(p, B.standard_scaler(p, ["a"])).collect()] == [0.0, 0.0]
    assert [r["a"] for r in B.scale(p, B.minmax_scaler(p, ["a"])).collect()] == [0.0, 0.0]


def test_quantile_cuts_drop_repeated_edges(spark):
    p = spark.createDataFrame([(i, 1.0 if i < 8 else float(i)) for i in range(10)], "id long, a double")
    assert B.quantile_cuts(p, ["a"], 4)["a"] == [1.0, 9.0]


def test_uniform_lowest_value_is_inside(spark):
    p = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, a double")
    edges = B.uniform_cuts(p, ["a"], 4)["a"]
    assert edges[0] == pytest.approx(-0.004) and edges[1:] == [1.0, 2.0, 3.0, 4.0]
    assert [r[0] for r in p.select(B.inner_bin(F.col("a"), edges)).collect()] == [0, 0, 1, 2, 3]


def test_exactly_one_and_imputation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {r["k"]: r["v"] for r in T.exactly_one(df, keys, "k", "v").collect()} == {1: "a", 2: None, 3: None}
    p = spark.createDataFrame([(0, 0.0, None), (1, 0.1, 10.0), (2, 0.2, 20.0), (3, 9.0, 90.0)], "id long, a double, b double")
    assert {r["id"]: r["b"] for r in T.knn_impute(p, ["a", "b"], 2).collect()}[0] == 15.0
    assert D.well_filled(p, ["a", "b"], 0).count() == 3


def test_results_are_written_and_summed(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0, "x", 1.0, 2.0), ("m", 1, "x", 1.0, 4.0)], X.RESULT)
    T.write_results(rows, str(tmp_path / "r"))
    back = T.summarise(T.read_csv(spark, str(tmp_path / "r"))).first()
    assert (back["mean"], back["n"]) == (3.0, 2) and back["std"] == pytest.approx(math.sqrt(2))


def test_tie_break_is_fixed_by_the_seed(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, i) for i in range(50)], "g int, s double, p double, k long")
    pick = lambda seed: ranking.best_by(df.repartition(3), ["g"], "s", "p", "k", seed).first()["k"]
    assert pick(1) == pick(1) and len({pick(s) for s in range(8)}) > 3


def test_modules(spark):
    rng = random.Random(1)
    centers = [(0.0, 0.0), (6.0, 0.0)]
    p = spark.createDataFrame([(i, centers[i % 2][0] + rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for i in range(40)], "id long, a double, b double").cache()
    for base in (KMeansBase(["a", "b"], n_clusters=2), DBSCANBase(["a", "b"], eps=1.5, n_core=3), AgglomerativeBase(["a", "b"], n_clusters=2), IMMBase(["a", "b"], centers=centers)):
        sides = base.assign(p).groupBy((F.col("id") % 2).alias("s"), "label").count().collect()
        assert len(sides) == 2 and all(r["count"] == 20 for r in sides)
    labelled = p.withColumn("label", (F.col("id") % 2).cast("int"))
    pool = DecisionForest(["a", "b"], n_trees=2, max_leaf_nodes=2).fit(labelled)
    mod = DecisionSetMod(lambda mined: DSCluster(given=mined, n_rules=2, lambd=1.0), pool)
    mod.fit(labelled)
    assert 0 < mod.n_rules <= 2
    m = X.measure(labelled, mod.rules, 1.0)
    assert m["coverage"] > 0.9 and m["clustering_distance"] < 0.1


def test_cover_by_window_on_a_stream(spark, tmp_path):
    spark.sql("SELECT id, timestamp_seconds(id * 60) AS ts, CAST(id AS DOUBLE) AS a FROM range(30)").write.parquet(str(tmp_path / "e"))
    rules = RuleSet((Rule((Condition.axis("a", 14.0),), 0),))
    stream = spark.readStream.schema("id long, ts timestamp, a double").parquet(str(tmp_path / "e"))
    q = cover_by_window(stream, rules, "ts", "10 minutes", "1 minute").writeStream.format("memory").queryName("covered").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("covered").collect()) == [5, 10]


def test_results_with_three_headers(spark, tmp_path):

    path = str(tmp_path / "wide.csv")
    with open(path, "w") as f:
        f.write(",length,score,length,score,length,score\n")
        f.write(",KMeans,KMeans,Tree,Tree,Tree,Tree\n")
        f.write(",nan,nan,0,0,1.0,1.0\n")
        f.write("2.0,,1797,3,1.5,5,2.5\n4.0,,1797,4,nan,,0.5\n")
    rows = T.read_wide_results(spark, path)
    got = {(r["module"], r["sample"], r["metric"], r["x"]): r["value"] for r in rows.collect()}
    assert got == {
        ("KMeans", None, "length", 2.0): None, ("KMeans", None, "score", 2.0): 1797.0, ("KMeans", None, "length", 4.0): None, ("KMeans", None, "score", 4.0): 1797.0,
        ("Tree", 0, "length", 2.0): 3.0, ("Tree", 0, "score", 2.0): 1.5, ("Tree", 1, "length", 2.0): 5.0, ("Tree", 1, "score", 2.0): 2.5,
        ("Tree", 0, "length", 4.0): 4.0, ("Tree", 0, "score", 4.0): None, ("Tree", 1, "length", 4.0): None, ("Tree", 1, "score", 4.0): 0.5,
    }
    means = {(r["metric"], r["module"], r["x"]): (r["mean"], r["std"]) for r in T.summarise(rows).collect()}
    assert means["length", "Tree", 2.0] == (4.0, math.sqrt(2)) and means["score", "Tree", 4.0][0] == 0.5
    bad = str(tmp_path / "bad.csv")
    with open(bad, "w") as f:
        f.write("a,b\n1,2\n3\n")
    with pytest.raises(ValueError):
        T.read_wide_results(spark, bad)


def test_knn_impute_meets_vectors_not_rows(spark):
    rows = [(i, float(i % 4), None if i % 5 == 0 else float(i % 3), None if i % 11 == 3 else float(i % 2)) for i in range(240)]
    p = spark.createDataFrame(rows, "id long, a double, b double, c double")
    assert T._impute_pairs(p, ["a", "b", "c"], 2).count() <= (4 * 2 + 4 * 3 + 4) * (4 * 4 * 3) * 2  # and not 66 * 240

    def mean(i, f):
        found = []
        for j, *y in rows:
            both = [k for k in range(3) if rows[i][k + 1] is not None and y[k] is not None]
            if j != i and both and y[f] is not None:
                found.append((sum((rows[i][k + 1] - y[k]) ** 2 for k in both) * 3 / len(both), j, y[f]))
        return sum(y for *_, y in sorted(found)[:2]) / 2

    want = {r[0]: tuple(mean(r[0], f) if r[f + 1] is None else r[f + 1] for f in range(3)) for r in rows}
    assert {r["id"]: (r["a"], r["b"], r["c"]) for r in T.knn_impute(p, ["a", "b", "c"], 2).collect()} == want

"""Experiments: sweeps of a parameter, with tidy results (module, sample, metric, x, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RuleSet
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators.select import select_for_lambdas

RESULT = "module string, sample int, metric string, x double, value double"


def measure(points: DataFrame, rules: RuleSet, lam: float, features: Sequence[str] = (), centers: Sequence[Sequence[float]] = (), dist: DataFrame | None = None) -> dict[str, float]:
    """Coverage, overlap, score, distance to the reference and rule length;
    with the reference's centers, numbered as its clusters, the clustering cost
    and the distance ratio too, and with distances (i, j, d) the silhouette."""
    spark = points.sparkSession
    hits = L.data_to_rules(points, rules).persist()
    try:
        rc = L.rules_to_clusters(spark, rules)
        dc = points.filter(F.col("label").isNotNull()).select("id", F.col("label").alias("cluster"))
        n = points.count()
        found = L.data_to_clusters(hits, rc)
        s = M.coverage_mistake(dc, hits, rc, n, lam).first()
        predicted = L.predict(points, rules, uncovered=())
        truth = points.select("id", L.labels_format("label").alias("labels"))
        more = {}
        if centers:
            at = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(centers)], "cluster int, " + ", ".join(f"`{f}` double" for f in features))
            more["clustering_cost"] = M.kmeans_cost(points, features, at, found, n, average=True, normalize=True).first()[0]
            more["distance_ratio"] = M.distance_ratio_score(M.distance_ratio(points, features, centers), found).first()[0]
        if dist is not None:
            more["silhouette"] = P.silhouette(dist, found).first()[0]
        return more | {
            "coverage": s["covered"] / n if n else float("nan"), "coverage_mistake_score": s["coverage_mistake_score"], "overlap": M.overlap(found).first()[0],
            "clustering_distance": M.clustering_distance(truth, predicted).first()[0], "weighted_rule_length": M.rule_length(hits, rc).first()[0], "max_rule_length": float(rules.max_length),
        }
    finally:
        hits.unpersist()


def max_rules(points: DataFrame, modules: dict[str, Callable[[int], RuleSet]], sizes: Sequence[int], lam: float) -> DataFrame:
    """Each module's rules for each number of rules; only those within it count."""
    rows = []
    for name, fit in modules.items():
        for k in sizes:
            rules = fit(k)
            if len(rules) <= k:
                rows += [(name, 0, m, float(k), float(v)) for m, v in measure(points, rules, lam).items() if v is not None]
    return points.sparkSession.createDataFrame(rows, RESULT)


def lambda_scores(data_cluster: DataFrame, data_rule: DataFrame, rule_cluster: DataFrame, lams: Sequence[float]) -> DataFrame:
    """(lam, score) of a fixed rule set: linear in lambda, so one job for all."""
    one = M.coverage_mistake(data_cluster, data_rule, rule_cluster, 0, 0.0).select("covered", "mistakes")
    return one.select(F.explode(F.array(*map(F.lit, map(float, lams)))).alias("lam"), "covered", "mistakes").select("lam", (F.col("covered") - F.col("lam") * F.col("mistakes")).alias("score"))


def lambda_fits(points: DataFrame, mine: Callable[[int], RuleSet], lams: Sequence[float], n_rules: int, n_samples: int = 1, name: str = "dscluster") -> DataFrame:
    """Results (module, sample, metric, x, value) of selections fitted anew for
    each lambda (x) and sample: longest rule, mean length by the points covered,
    and covered points less lambda times mistakes. ``mine(sample)`` gives the
    rules to select from. All lambdas of a sample are selected in lock step and
    measured by one job."""
    spark, rows = points.sparkSession, []
    truth = points.filter(F.col("label").isNotNull()).select("id", F.col("label").alias("cluster"))
    for sample in range(n_samples):
        rules = RuleSet(tuple(r for r in mine(sample) if r.label != -1))
        rc, hits = L.rules_to_clusters(spark, rules), L.data_to_rules(points, rules).persist()
        try:
            chosen = select_for_lambdas(truth, rc, hits, n_rules, lams)
            info = [(k, i, rules.rules[i].label, len(rules.rules[i].conditions)) for k, some in enumerate(chosen) for i in some]
            found = {}
            if info:
                each = hits.join(F.broadcast(spark.createDataFrame(info, "k int, rule_id int, own int, length int")), "rule_id").join(truth, "id", "left")
                wrong = F.count_if(F.coalesce(F.col("own") != F.col("cluster"), F.lit(True)))
                found = {r["k"]: r for r in each.groupBy("k").agg(F.count_distinct("id").alias("c"), wrong.alias("m"), F.avg("length").alias("l")).collect()}
            for k, lam in enumerate(lams):
                r = found.get(k)
                longest = max((len(rules.rules[i].conditions) for i in chosen[k]), default=0)
                values = {"max_rule_length": longest, "weighted_rule_length": r["l"] if r else float("nan"), "coverage_mistake_score": r["c"] - lam * r["m"] if r else 0.0}
                rows += [(name, sample, m, float(lam), float(v)) for m, v in values.items()]
        finally:
            hits.unpersist()
    return spark.createDataFrame(rows, RESULT)


def robustness(points: DataFrame, features: Sequence[str], rules: RuleSet, std: float, n_samples: int, seed: int = 342) -> DataFrame:
    """(sample, clustering_distance) between predictions with and without normal
    noise. Samples are drawn by seeds, one column set each; uncovered points
    are the empty set on both sides."""
    base = L.predict(points, rules, uncovered=())
    out = None
    for s in range(n_samples):
        noisy = points.withColumns({f: F.col(f) + std * F.randn(seed + 1000 * s + k) for k, f in enumerate(features)})
        row = M.clustering_distance(base, L.predict(noisy, rules, uncovered=())).select(F.lit(s).alias("sample"), "clustering_distance")
        out = row if out is None else out.union(row)
    return out


def decision_grid(points: DataFrame, x: str, y: str, rules: RuleSet, steps: int = 100) -> DataFrame:
    """(x, y, labels) over a mesh of the data's range, for plots of boundaries."""
    r = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    spark = points.sparkSession
    mesh = spark.range((steps + 1) ** 2).select("id", (F.lit(r[0]) + (F.lit(r[1]) - F.lit(r[0])) * (F.col("id") % (steps + 1)) / steps).alias(x), (F.lit(r[2]) + (F.lit(r[3]) - F.lit(r[2])) * F.floor(F.col("id") / (steps + 1)) / steps).alias(y))
    return mesh.join(L.predict(mesh, rules), "id").select(x, y, "labels")


def rule_boxes(points: DataFrame, features: Sequence[str], rules: RuleSet) -> DataFrame:
    """(rule_id, label, feature, low, high), clipped to the data's range."""
    r = points.agg(*(x for f in features for x in (F.min(f).alias(f"a_{f}"), F.max(f).alias(f"z_{f}")))).first()
    rows = []
    for i, rule in enumerate(rules):
        box = rule.box()
        for f in features:
            a, z = box.get(f, (float("-inf"), float("inf")))
            rows.append((i, rule.label, f, max(a, float(r[f"a_{f}"])), min(z, float(r[f"z_{f}"]))))
    return points.sparkSession.createDataFrame(rows, "rule_id int, label int, feature string, low double, high double")


def outlier_mask(points: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], share: float) -> DataFrame:
    """Ids of the given share of points with the lowest distance ratios."""
    ratios = M.distance_ratio(points, features, centers)
    n = int(points.count() * share)
    return ratios.orderBy("ratio", "id").limit(n).select("id")

"""Rule selection by distorted greedy maximisation of coverage minus mistakes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import kmeans_cost


def coverage_mistake_select(data_cluster: DataFrame, rule_cluster: DataFrame, data_rule: DataFrame, n_rules: int, lam: float) -> list[int]:
    """Ids of the selected rules.

    In step i a rule scores (1 - 1/N) ** (N - i - 1) * gain - lam * mistakes,
    its gain being the points of its cluster that no chosen rule of that
    cluster covers; the best one is taken if its score is over 0 (the first of
    ties), and steps go on in any case. Points with the same cluster and the
    same rules are alike: they are counted once for all steps, as patterns,
    so that a step is one small aggregation over patterns, not over points.
    """
    return select_for_lambdas(data_cluster, rule_cluster, data_rule, n_rules, [lam])[0]


def select_for_lambdas(data_cluster: DataFrame, rule_cluster: DataFrame, data_rule: DataFrame, n_rules: int, lams: Sequence[float]) -> list[list[int]]:
    """What ``coverage_mistake_select`` selects for each lambda. The selections
    go on in lock step: an aggregation a step over (lambda, pattern), for those
    lambdas whose last step took a rule."""
    hits = data_rule.join(rule_cluster.select("rule_id", "cluster"), "rule_id")
    right = hits.join(data_cluster, ["id", "cluster"], "left_semi")
    totals = {r["rule_id"]: r["n"] for r in hits.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    own = {r["rule_id"]: r["n"] for r in right.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    bad = {i: n - own.get(i, 0) for i, n in totals.items()}
    patterns = right.groupBy("id", "cluster").agg(F.array_sort(F.collect_set("rule_id")).alias("rules")).groupBy("cluster", "rules").agg(F.count("*").alias("n"))
    patterns = patterns.persist()
    chosen: list[list[int]] = [[] for _ in lams]
    gains = [dict(own) for _ in lams]
    try:
        for i in range(n_rules):
            weight, moved = (1 - 1 / n_rules) ** (n_rules - i - 1), []
            for k, lam in enumerate(lams):
                scores = {j: weight * gains[k].get(j, 0) - lam * bad[j] for j in totals if j not in chosen[k]}
                best = min(scores, key=lambda j: (-scores[j], j), default=None)
                if best is not None and scores[best] > 0:
                    chosen[k].append(best)
                    moved.append(k)
            if not moved or i + 1 == n_rules:
                continue
            done = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, chosen[k])).alias("done")) for k in moved)))
            left = patterns.select("rules", "n", done.alias("l")).filter(~F.arrays_overlap("rules", "l.done"))
            for k in moved:
                gains[k] = {}
            for r in left.select("l.k", F.explode("rules").alias("r"), "n").groupBy("k", "r").agg(F.sum("n").alias("n")).collect():
                gains[r["k"]][r["r"]] = r["n"]
    finally:
        patterns.unpersist()
    return [sorted(c) for c in chosen]


def select_with_grid(data_cluster: DataFrame, rule_cluster: DataFrame, data_rule: DataFrame, n_points: int, n_rules: int, frac_cover: float, lams: Sequence[float], objective: Callable[[DataFrame], float]) -> list[int] | None:
    """The selection with the least objective among those lambdas whose rules
    cover ``frac_cover`` of the points; None if none does."""
    best: tuple[float, list[int]] | None = None
    for lam in lams:
        chosen = coverage_mistake_select(data_cluster, rule_cluster, data_rule, n_rules, lam)
        kept = data_rule.filter(F.col("rule_id").isin(chosen)) if chosen else data_rule.limit(0)
        covered = kept.select("id").distinct().count()
        if covered / n_points >= frac_cover - 1e-12:
            value = objective(kept)
            if best is None or value < best[0]:
                best = (value, chosen)
    return None if best is None else best[1]


def kmeans_objective(points: DataFrame, features: Sequence[str], centers: DataFrame, rule_cluster: DataFrame, average: bool = False, normalize: bool = False) -> Callable[[DataFrame], float]:
    """For select_with_grid: the k-means cost of the clusters that the kept
    rules give to points; infinite where nothing is covered and ``normalize``."""
    n = points.count()

    def cost(kept: DataFrame) -> float:
        given = kept.join(rule_cluster.select("rule_id", "cluster"), "rule_id").select("id", "cluster").distinct()
        return float(kmeans_cost(points, features, centers, given, n, average, normalize).first()[0])

    return cost


def coverage_objective(n_points: int) -> Callable[[DataFrame], float]:
    """For select_with_grid: minus the share of points that the kept rules cover."""
    return lambda kept: -kept.select("id").distinct().count() / n_points


#: The same as a function of the long tables.
distorted_greedy = coverage_mistake_select

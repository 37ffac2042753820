"""Measures of assignments. Each returns a small DataFrame, computed by
pre-aggregated sums; n (the number of points) is passed, as sparse tables do
not know points without a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_sums, value_spans

NAN, INF = float("nan"), float("inf")


def divide_with_zeros(x: Column, y: Column) -> Column:
    """x / y with 0/0 = 1 and x/0 = infinity."""
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when(y == 0, F.lit(INF)).otherwise(x / F.when(y != 0, y))


def mode(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value, the smallest of ties."""
    counts = df.groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("count"), F.col(value).alias("v"))).alias("m")).select(*by, F.col("m.v").alias("mode"))


def entropy(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Base-2 entropy of a value's distribution: two aggregations, the second over counts."""
    counts = df.groupBy(*by, value).count()
    total = counts.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    return total.select(*by, (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def coverage(assignment: DataFrame, n: int, percentage: bool = True) -> DataFrame:
    covered = assignment.agg(F.count_distinct("id").alias("c"))
    return covered.select((F.col("c") / F.lit(n) if percentage else F.col("c").cast("double")).alias("coverage"))


def overlap(assignment: DataFrame) -> DataFrame:
    """Mean number of clusters of covered points; NaN if none is covered."""
    return assignment.groupBy("id").count().agg(F.coalesce(F.avg("count"), F.lit(NAN)).alias("overlap"))


def _distance(features: Sequence[str], other: Sequence[str], norm: int, square: bool) -> Column:
    if norm == 1:
        return sum((F.abs(F.col(a) - F.col(b)) for a, b in zip(features, other, strict=True)), F.lit(0.0))
    if norm != 2:
        raise ValueError("norm is 1 or 2")
    total = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(features, other, strict=True)), F.lit(0.0))
    return total if square else F.sqrt(total)


def center_dists(points: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], norm: int = 2, square: bool = False) -> DataFrame:
    """(id, cluster, dist). Centers are model state on the driver (k of them), so
    each point's k distances are expressions of its own row."""
    if any(len(c) != len(features) for c in centers):
        raise ValueError("centers and points differ in dimension")

    def dist(c: Sequence[float]) -> Column:
        gaps = [F.col(f) - F.lit(float(v)) for f, v in zip(features, c, strict=True)]
        if norm == 1:
            return sum(map(F.abs, gaps), F.lit(0.0))
        if norm != 2:
            raise ValueError("norm is 1 or 2")
        total = sum((g * g for g in gaps), F.lit(0.0))
        return total if square else F.sqrt(total)

    return points.select("id", F.posexplode(F.array(*map(dist, centers))).alias("cluster", "dist"))


def kmeans_cost(points: DataFrame, features: Sequence[str], centers: DataFrame, data_cluster: DataFrame, n: int, average: bool = False, normalize: bool = False, norm: int = 2) -> DataFrame:
    """Squared L2 (or L1) cost of each point to its clusters' centers; with
    ``average`` a point's mean over its clusters, with ``normalize`` per covered
    point (infinite if none is covered)."""
    other = [f"_c{i}" for i in range(len(features))]
    c = centers.select("cluster", *(F.col(f).alias(o) for f, o in zip(features, other, strict=True)))
    each = points.join(data_cluster, "id").join(c, "cluster").select("id", _distance(features, other, norm, True).alias("d"))
    per = each.groupBy("id").agg((F.avg("d") if average else F.sum("d")).alias("d"))
    total = per.agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("s"), F.count("*").alias("c"))
    return total.select((F.when(F.col("c") == 0, F.lit(INF)).otherwise(F.col("s") / F.when(F.col("c") > 0, F.col("c"))) if normalize else F.col("s")).alias("cost"))


def distance_ratio(points: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], norm: int = 2) -> DataFrame:
    """(id, ratio) of the second nearest to the nearest center."""
    d = F.array_sort(F.collect_list("dist"))  # k distances of one point
    two = center_dists(points, features, centers, norm).groupBy("id").agg(d.alias("d"))
    return two.select("id", divide_with_zeros(F.get("d", F.lit(1)), F.get("d", F.lit(0))).alias("ratio"))


def mistakes(data_cluster: DataFrame, data_rule: DataFrame, rule_cluster: DataFrame) -> DataFrame:
    """Pairs of a point and a rule whose cluster is not the point's."""
    hits = data_rule.join(rule_cluster, "rule_id").select("id", "cluster", "rule_id")
    return hits.join(data_cluster, ["id", "cluster"], "left_anti").agg(F.count("*").alias("mistakes"))


def coverage_mistake(data_cluster: DataFrame, data_rule: DataFrame, rule_cluster: DataFrame, n: int, lam: float) -> DataFrame:
    """covered, mistakes, covered - lam * mistakes, and uncovered + mistakes."""
    covered = data_rule.agg(F.count_distinct("id").alias("covered"))
    both = covered.join(mistakes(data_cluster, data_rule, rule_cluster))  # one row each
    return both.select("covered", "mistakes", (F.col("covered") - lam * F.col("mistakes")).alias("coverage_mistake_score"), (n - F.col("covered") + F.col("mistakes")).alias("uncovered_mistake_score"))


def label_differences(a: DataFrame, b: DataFrame, percentage: bool = True) -> DataFrame:
    """How many points (or what share) have differing label sets."""
    j = a.select("id", F.array_sort("labels").alias("a")).join(b.select("id", F.array_sort("labels").alias("b")), "id")
    differ = F.count_if(F.col("a") != F.col("b"))
    return j.agg((differ / F.count("*") if percentage else differ.cast("double")).alias("label_differences"))


def rule_length(data_rule: DataFrame, rule_cluster: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Mean length of rules, weighted by the points they cover; NaN if none.
    For a tree's leaves, the weighted mean depth; ``without``: ids left out."""
    rows = data_rule if without is None else data_rule.join(without.select("id"), "id", "left_anti")
    return rows.join(rule_cluster, "rule_id").agg(F.coalesce(F.avg("length"), F.lit(NAN)).alias("weighted_rule_length"))


def distance_ratio_score(ratios: DataFrame, data_cluster: DataFrame) -> DataFrame:
    """Mean ratio of all points over that of points in no or several clusters."""
    counts = data_cluster.groupBy("id").agg(F.count("*").alias("c"))
    j = ratios.join(counts, "id", "left")
    odd = F.avg(F.when(F.coalesce("c", F.lit(0)) != 1, F.col("ratio")))
    return j.agg(F.coalesce(F.avg("ratio") / odd, F.lit(NAN)).alias("distance_ratio"))


def ratio_distribution(ratios: DataFrame, data_cluster: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Histogram of ratios for uniquely covered, overlapping and uncovered points."""
    counts = data_cluster.groupBy("id").agg(F.count("*").alias("c"))
    kind = F.when(F.coalesce("c", F.lit(0)) == 0, "uncovered").when(F.col("c") == 1, "unique").otherwise("overlapping")
    bin_of = sum((F.when(F.col("ratio") > e, F.lit(1)).otherwise(F.lit(0)) for e in edges), F.lit(0))
    return ratios.join(counts, "id", "left").groupBy(kind.alias("kind"), bin_of.alias("bin")).agg(F.count("*").alias("n"))


def accuracy(a: DataFrame, b: DataFrame) -> DataFrame:
    return label_differences(a, b).select((1 - F.col("label_differences")).alias("accuracy"))


def clustering_distance(a: DataFrame, b: DataFrame, percentage: bool = True, ignore: Iterable[int] = ()) -> DataFrame:
    """Pairs of points that share a label in one labelling but not in the other.

    Points with the same two label sets are alike, so that signatures are
    counted and only these are compared: their number does not grow with the
    points'. Two points of a signature differ if just one of its sets is
    empty. ``ignore``: points labelled so in either take no part.
    """
    j = a.select("id", F.array_sort("labels").alias("a")).join(b.select("id", F.array_sort("labels").alias("b")), "id")
    ignore = list(ignore)
    if ignore:
        drop = F.array(*map(F.lit, ignore)).cast("array<int>")
        j = j.filter(~F.arrays_overlap("a", drop) & ~F.arrays_overlap("b", drop))
    s = j.groupBy("a", "b").agg(F.count("*").alias("n"))
    s = s.withColumn("k", F.xxhash64("a", "b"))
    t = s.select(*(F.col(c).alias(f"{c}2") for c in ("a", "b", "n", "k")))
    across = s.join(t, F.col("k") < F.col("k2")).filter(F.arrays_overlap("a", "a2") != F.arrays_overlap("b", "b2")).agg(F.coalesce(F.sum(F.col("n") * F.col("n2")), F.lit(0)).alias("x"))
    within = s.agg(F.coalesce(F.sum(F.when((F.size("a") == 0) != (F.size("b") == 0), F.col("n") * (F.col("n") - 1) / 2)), F.lit(0.0)).alias("w"), F.sum("n").alias("m"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    total = F.col("x") + F.col("w")
    return across.join(within).select((total / F.when(pairs > 0, pairs) if percentage else total.cast("double")).alias("clustering_distance"))


def auc(scored: DataFrame) -> DataFrame:
    """(class, auc) of rows (class, score, positive, n): how likely a positive
    row's score is over a negative one's, ties counting half; null for a class
    without both. By rank sums: distinct scores are counted, and the negatives
    below each are summed by spans of scores, so that no task sorts a class."""
    counts = scored.groupBy(F.col("class").alias("feature"), F.col("score").cast("double").alias("value")).agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("q"))
    summed = prefix_sums(counts, ["feature"], ["p", "q"], value_spans(counts)).join(counts, ["feature", "value"])
    won = F.sum(F.col("p") * (F.get("upto", F.lit(1)) - F.col("q") / 2))
    pairs = (F.sum("p") * F.sum("q")).cast("double")
    return summed.groupBy(F.col("feature").alias("class")).agg((won / F.when(pairs > 0, pairs)).alias("auc"))

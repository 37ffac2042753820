"""Split search for trees: one plan for all kinds of split.

Points become cells (node, feature, value) with a count for each label; sums of
these from the lowest value on tell every candidate threshold the label counts
on both of its sides. Sums are taken in spans of a feature's values and moved
by the spans below, so that no task sorts a whole node. A score is an
expression over these counts, and the best candidate of each node is a maximum,
whatever the number of thresholds. Ties go to the lowest feature, then to the
lowest threshold.

Thresholds are data values. With ``bins``, values are first moved up to the
edges of that many percentiles, so that there are fewer of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_sums, value_spans

#: Slopes of oblique splits of two features; 0 and infinity are the axes themselves.
SLOPES = (0.5, 1.0, 2.0, -2.0, -1.0, -0.5)


@dataclass(frozen=True)
class Projection:
    """A feature to split on: an axis, or -slope * x0 + x1."""

    features: tuple[str, ...]
    weights: tuple[float, ...]

    def column(self) -> Column:
        if self.weights == (1.0,):
            return F.col(self.features[0]).cast("double")
        return sum((F.lit(w) * F.col(f) for f, w in zip(self.features, self.weights, strict=True)), F.lit(0.0))


def axes(features: Sequence[str]) -> list[Projection]:
    return [Projection((f,), (1.0,)) for f in features]


def oblique(features: Sequence[str]) -> list[Projection]:
    """All axes, then for each pair of features a line of each slope."""
    return axes(features) + [Projection((a, b), (-s, 1.0)) for a, b in combinations(features, 2) for s in SLOPES]


def cells(points: DataFrame, projections: Sequence[Projection], *more: Column | str) -> DataFrame:
    """(more..., feature, value) for each point and projection; null and NaN take no part."""
    found = points.select(*more, F.posexplode(F.array(*(p.column() for p in projections))).alias("feature", "value"))
    return found.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def candidates(points: DataFrame, projections: Sequence[Projection], labels: Sequence[int], node: Column | None = None, bins: int | None = None, spans: dict[int, list[float]] | None = None) -> DataFrame:
    """(node, feature, threshold, above: the next value, l: counts of labels at
    most the threshold, r: counts over it), for every value but each node's
    highest. ``spans``: each feature's edges, where they are known already."""
    node = F.lit(0) if node is None else node
    at = cells(points, projections, node.alias("node"), "label").filter(F.col("node").isNotNull())
    if bins:
        edges = at.groupBy("node", "feature").agg(F.percentile_approx("value", [k / bins for k in range(1, bins + 1)], 10_000).alias("e"))
        at = at.join(edges, ["node", "feature"]).withColumn("value", F.array_min(F.filter("e", lambda x: x >= F.col("value")))).drop("e")
    names = [f"c{k}" for k in range(len(labels))]
    counts = at.groupBy("node", "feature", "value").agg(*(F.count_if(F.col("label") == y).alias(c) for c, y in zip(names, labels, strict=True)))
    summed = prefix_sums(counts, ["node", "feature"], names, value_spans(at) if spans is None else spans)
    out = summed.select("node", "feature", F.col("value").alias("threshold"), "above", F.col("upto").alias("l"), F.zip_with("all", "upto", lambda t, a: t - a).alias("r"))
    return out.filter(_sum("r") > 0)


def _sum(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def _plogp(c: str, n: Column) -> Column:
    """n times the entropy of counts; sizes are at least 1 inside the log."""
    each = lambda a, x: a - F.when(x > 0, x * F.log2(x / F.greatest(n, F.lit(1)))).otherwise(0.0)
    return F.aggregate(c, F.lit(0.0), each)


def information_gain(n_all: int) -> Column:
    """n_node / n_all * (entropy - weighted entropy of both sides)."""
    t = F.zip_with("l", "r", lambda a, b: a + b)
    return F.round((_plogp(t, _sum(t)) - _plogp("l", _sum("l")) - _plogp("r", _sum("r"))) / n_all, 12)


def gini_gain(n_all: int) -> Column:
    def impurity(c) -> Column:
        return _sum(c) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.greatest(_sum(c), F.lit(1))

    t = F.zip_with("l", "r", lambda a, b: a + b)
    return F.round((impurity(t) - impurity("l") - impurity("r")) / n_all, 12)


def center_gain(centers: dict[int, Sequence[float]], labels: Sequence[int], projections: Sequence[Projection], names: Sequence[str]) -> Column:
    """Minus the points parted from their own center; null where all of the
    node's centers are on one side. A node's centers are those of its points."""

    def at(k: int) -> Column:
        c = dict(zip(names, centers[labels[k]], strict=True))
        values = [sum(w * c[f] for f, w in zip(p.features, p.weights, strict=True)) for p in projections]
        return F.get(F.array(*map(F.lit, map(float, values))), F.col("feature")) <= F.col("threshold")

    l, r = (lambda k: F.get("l", F.lit(k))), (lambda k: F.get("r", F.lit(k)))  # noqa: E741
    here = [l(k) + r(k) > 0 for k in range(len(labels))]
    parted = sum((F.when(at(k), r(k)).otherwise(l(k)) for k in range(len(labels))), F.lit(0))
    some_left = F.greatest(F.lit(0), *(F.when(h & at(k), 1).otherwise(0) for k, h in enumerate(here)))
    some_right = F.greatest(F.lit(0), *(F.when(h & ~at(k), 1).otherwise(0) for k, h in enumerate(here)))
    return F.when((some_left == 1) & (some_right == 1), -parted.cast("double"))


def outlier_gain() -> Column:
    """Minus the points to remove so that no cluster straddles the split; null
    for one cluster only. Each cluster keeps its larger side. If all would keep
    the same side, the straddling one that loses least is sent to the other."""
    pairs = F.filter(F.arrays_zip(F.col("l").alias("l"), F.col("r").alias("r")), lambda x: x["l"] + x["r"] > 0)
    n = F.size(pairs)
    lefts, rights = F.size(F.filter(pairs, lambda x: x["l"] > x["r"])), F.size(F.filter(pairs, lambda x: x["r"] > x["l"]))
    minor = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.least(x["l"], x["r"]))
    straddling = F.filter(pairs, lambda x: (x["l"] > 0) & (x["r"] > 0))
    # the cost of sending a cluster to its smaller side instead: the larger part goes, the smaller stays
    turn = F.array_min(F.transform(straddling, lambda x: F.struct(F.greatest(x["l"], x["r"]).alias("a"), (F.greatest(x["l"], x["r"]) - F.least(x["l"], x["r"])).alias("b"))))["b"]
    one_sided = (lefts == n) | (rights == n)
    return F.when(n > 1, -F.when(one_sided, minor + turn).otherwise(minor).cast("double"))


def best_splits(found: DataFrame, gain: Column, least: int = 1) -> DataFrame:
    """(node, gain, feature, threshold): each node's best candidate with at
    least ``least`` points on both sides."""
    scored = found.filter((_sum("l") >= least) & (_sum("r") >= least)).select("node", "feature", "threshold", gain.alias("gain")).filter(F.col("gain").isNotNull())
    best = scored.groupBy("node").agg(F.min(F.struct(-F.col("gain"), "feature", "threshold")).alias("b"))
    return best.select("node", (-F.col("b.col1")).alias("gain"), F.col("b.feature").alias("feature"), F.col("b.threshold").alias("threshold"))

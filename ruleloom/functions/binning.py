"""Scaling and binning of feature columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Scaler
from ..operators.ranking import quantiles, value_spans
from ..operators.splits import axes, candidates, cells


def standard_scaler(points: DataFrame, features: Sequence[str]) -> Scaler:
    """Mean and population deviation; a constant feature has scale 1."""
    row = points.agg(*(x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")))).first()
    return {f: (float(row[f"m_{f}"] or 0.0), float(row[f"s_{f}"] or 0.0) or 1.0) for f in features}


def minmax_scaler(points: DataFrame, features: Sequence[str]) -> Scaler:
    row = points.agg(*(x for f in features for x in (F.min(f).alias(f"a_{f}"), F.max(f).alias(f"z_{f}")))).first()
    return {f: (float(row[f"a_{f}"] or 0.0), float((row[f"z_{f}"] or 0.0) - (row[f"a_{f}"] or 0.0)) or 1.0) for f in features}


def scale(points: DataFrame, scaler: Scaler) -> DataFrame:
    return points.withColumns({f: (F.col(f) - F.lit(a)) / F.lit(b) for f, (a, b) in scaler.items()})


def factorize(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes from 0, in the order of the (few) values; null stays null."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(out))  # over distinct values only
    return df.join(F.broadcast(codes) if codes.limit(10_001).count() <= 10_000 else codes, column, "left")


def bin_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of the interval (cut, next cut] that holds a value: how many cuts are below it."""
    return sum((F.when(value > F.lit(float(c)), 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)


def quantile_cuts(points: DataFrame, features: Sequence[str], n_bins: int, exact: bool = True) -> dict[str, list[float]]:
    """Edges at equal shares, repeated ones dropped; the lowest is inclusive.
    Exact ones by rank selection; ``exact`` False: approximate percentiles, by
    mergeable sketches."""
    at = [k / n_bins for k in range(n_bins + 1)]
    if exact:
        found = quantiles(points, features, at)
    else:
        row = points.agg(*(F.percentile_approx(f, at, 100_000).alias(f) for f in features)).first()
        found = {f: row[f] or [] for f in features}
    return {f: sorted(set(map(float, found[f]))) for f in features}


def uniform_cuts(points: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Edges at equal widths; the range is widened by 0.1 % below, as (a, b] would miss the least value."""
    row = points.agg(*(x for f in features for x in (F.min(f).alias(f"a_{f}"), F.max(f).alias(f"z_{f}")))).first()
    out = {}
    for f in features:
        a, z = row[f"a_{f}"], row[f"z_{f}"]
        if a is None:
            out[f] = []
            continue
        a, z = float(a), float(z)
        edges = [a + (z - a) * k / n_bins for k in range(n_bins + 1)]
        edges[0] = a - 0.001 * (z - a)
        out[f] = edges
    return out


def inner_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bin from 0 between outer edges: values up to the second edge are in bin 0."""
    return bin_of(value, edges[1:-1])


def _entropy(counts: Sequence[float]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def entropy_cuts(points: DataFrame, features: Sequence[str], label: str) -> dict[str, list[float]]:
    """Cuts by Fayyad and Irani's minimum description length (1993).

    Each round finds the best cut of every open interval of a feature by one
    plan over all its values; the driver sees that cut and the label counts on
    both sides. Ties go to the lowest cut. Nulls and NaN take no part."""
    return {f: _cuts(points.select(F.col(f).cast("double").alias("v"), F.col(label).alias("label"))) for f in features}


def _cuts(rows: DataFrame) -> list[float]:
    rows = rows.filter(F.col("v").isNotNull() & ~F.isnan("v") & F.col("label").isNotNull()).persist()
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    cuts, intervals, spans = [], [(-math.inf, math.inf)], value_spans(cells(rows, axes(["v"])))
    total = lambda side: F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x)
    while intervals and len(labels) > 1:
        node = F.lit(None).cast("int")
        for k, (low, high) in enumerate(intervals):
            node = F.when((F.col("v") > low) & (F.col("v") <= high), F.lit(k)).otherwise(node)
        left, right = total("l"), total("r")
        inner = lambda c, n: F.aggregate(c, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x / F.greatest(n, F.lit(1)))).otherwise(0.0))
        e = F.round((inner("l", left) + inner("r", right)) / (left + right), 12)
        found = candidates(rows, axes(["v"]), labels, node, spans=spans).groupBy("node").agg(F.min(F.struct(e.alias("e"), "threshold", "above", "l", "r")).alias("b"))
        later = []
        for r in found.select("node", "b.*").collect():  # a row an interval
            if _pays(r["l"], r["r"]):
                cut = (r["threshold"] + r["above"]) / 2
                low, high = intervals[r["node"]]
                cuts.append(cut)
                later += [(low, cut), (cut, high)]
        intervals = later
    rows.unpersist()
    return sorted(cuts)


def _pays(left: Sequence[int], right: Sequence[int]) -> bool:
    """Does a cut with these label counts tell more than it takes to state?"""
    whole = [a + b for a, b in zip(left, right, strict=True)]
    n, h = sum(whole), _entropy(whole)
    k, k1, k2 = (sum(c > 0 for c in x) for x in (whole, left, right))
    e = (sum(left) * _entropy(left) + sum(right) * _entropy(right)) / n
    delta = math.log2(3**k - 2) - (k * h - k1 * _entropy(left) - k2 * _entropy(right))
    return k > 1 and h - e > (math.log2(n - 1) + delta) / n

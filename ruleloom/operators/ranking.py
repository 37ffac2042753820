"""Orders with reproducible ties."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_key(seed: int, *key: str) -> Column:
    """A random-looking but fixed last sort key: a hash of seed and row key."""
    return F.xxhash64(F.lit(seed), *key)


def best_by(df: DataFrame, by: list[str], score: str, proxy: str, key: str, seed: int = 0) -> DataFrame:
    """Each group's row with the least score, then the least proxy, then a
    seeded draw. An aggregation, so that no group is gathered or sorted."""
    rest = [c for c in df.columns if c not in by]
    picked = F.min(F.struct(F.col(score).alias("_s"), F.col(proxy).alias("_p"), tie_key(seed, key).alias("_t"), F.struct(*rest).alias("_r")))
    return df.groupBy(*by).agg(picked.alias("_m")).select(*by, "_m._r.*")


def value_spans(cells: DataFrame, spans: int = 64) -> dict[int, list[float]]:
    """Approximate percentiles of each feature's values, to cut it into spans."""
    at = [k / spans for k in range(1, spans)]
    return {r["feature"]: sorted(set(r["e"])) for r in cells.groupBy("feature").agg(F.percentile_approx("value", at, 1_000).alias("e")).collect()}


def span_of(edges: dict[int, list[float]], feature: str = "feature", value: str = "value") -> Column:
    """The span of a feature that a value lies in: how many edges are below it."""
    out = F.lit(0)
    for f, e in edges.items():
        if e:
            out = F.when(F.col(feature) == f, F.size(F.filter(F.array(*map(F.lit, e)), lambda x: x < F.col(value)))).otherwise(out)
    return out


def prefix_sums(counts: DataFrame, keys: list[str], sums: list[str], edges: dict[int, list[float]]) -> DataFrame:
    """(keys..., value, above, upto, all): for each value of its group, the sums
    of ``sums`` over the values up to it and over the group, as arrays, and the
    next value (null for the highest). ``keys`` has ``feature``; keys and value
    are unique.

    Spans are summed apart and moved by the sums of the spans below, so that no
    task sorts a whole group. A value that very many points have is one row.
    ``edges`` decide on balance only."""
    counts = counts.withColumn("_b", span_of(edges))
    span = Window.partitionBy(*keys, "_b").orderBy("value")
    own = F.array(*(F.sum(c).over(span.rowsBetween(Window.unboundedPreceding, 0)) for c in sums))
    inner = counts.select(*keys, "_b", "value", F.lead("value").over(span).alias("_next"), own.alias("_own"))
    parts = counts.groupBy(*keys, "_b").agg(F.min("value").alias("_first"), *(F.sum(c).alias(c) for c in sums))
    group = Window.partitionBy(*keys)
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select(
        *keys, "_b", F.lead("_first").over(group.orderBy("_b")).alias("_later"),
        F.array(*(F.coalesce(F.sum(c).over(below), F.lit(0)) for c in sums)).alias("_below"), F.array(*(F.sum(c).over(group) for c in sums)).alias("all"),
    )
    return inner.join(moved, [*keys, "_b"]).select(*keys, "value", F.coalesce("_next", "_later").alias("above"), F.zip_with("_below", "_own", lambda a, x: a + x).alias("upto"), "all")


def placed(cells: DataFrame, *order: str) -> DataFrame:
    """(feature, value, ...) with a ``place`` from 0 by the given order, which
    begins with the value. Each feature is cut into spans: rows are numbered in
    their span, and moved by the sizes of the spans below, so that no task
    sorts a whole feature. Where spans are cut decides on balance only."""
    cells = cells.withColumn("_b", span_of(value_spans(cells)))
    sizes = cells.groupBy("feature", "_b").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("feature", "_b", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_s"))  # a row a span
    inner = F.row_number().over(Window.partitionBy("feature", "_b").orderBy(*order))
    return cells.withColumn("_r", inner).join(F.broadcast(starts), ["feature", "_b"]).withColumn("place", F.col("_s") + F.col("_r") - 1).drop("_b", "_r", "_s")


def order_statistics(cells: DataFrame, wanted: dict[int, Iterable[int]], held: int = 1000) -> dict[int, dict[int, float]]:
    """{feature: {rank: value}} of cells (feature, value), for the ranks from 0
    that are wanted of each feature.

    Each rank has a bracket of values that holds it. A round counts, for all
    ranks and features in one job, the values of a bracket that are below,
    between and at some approximate percentiles, and narrows the bracket to
    what holds the rank; so no task holds a feature's values. A bracket of up
    to ``held`` values is gathered. Nulls take no part, NaN is the greatest."""
    cells = cells.select("feature", F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull()).persist()
    out: dict[int, dict[int, float]] = {f: {} for f in wanted}
    try:
        ends = {r["feature"]: r for r in cells.groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()}
        todo = [_Bracket(f, ends[f]["low"], ends[f]["high"], ends[f]["n"], 0, sorted(set(ranks))) for f, ranks in wanted.items() if f in ends]
        while todo:
            todo = _narrowed(cells, todo, out, held)
    finally:
        cells.unpersist()
    return out


@dataclass
class _Bracket:
    """Values from low to high, n of them, with ``below`` under them."""

    feature: int
    low: float
    high: float
    n: int
    below: int
    ranks: list[int]

    def holds(self) -> Column:
        return (F.col("feature") == self.feature) & (F.col("value") >= F.lit(self.low)) & (F.col("value") <= F.lit(self.high))

    def shares(self) -> list[float]:
        """Where to cut: about evenly, and close to the ranks on both sides."""
        near = {(r - self.below + 0.5) / self.n + d for r in self.ranks for d in (-0.0005, 0.0005)}
        return sorted({min(1.0, max(0.0, x)) for x in near | {k / 16 for k in range(1, 16)}})


def _narrowed(cells: DataFrame, brackets: list[_Bracket], out: dict, held: int) -> list[_Bracket]:
    small, large = [], []
    for b in brackets:
        if b.low == b.high or b.low != b.low:
            out[b.feature] |= dict.fromkeys(b.ranks, b.low)
        else:
            (small if b.n <= held else large).append(b)

    def within(some: list[_Bracket]) -> DataFrame:
        which = F.lit(None).cast("int")
        for k, b in enumerate(some):
            which = F.when(b.holds(), k).otherwise(which)
        return cells.withColumn("_k", which).filter(F.col("_k").isNotNull())

    if small:
        for r in within(small).groupBy("_k").agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
            b = small[r["_k"]]
            out[b.feature] |= {rank: r["v"][rank - b.below] for rank in b.ranks}
    if not large:
        return []
    here = within(large)
    shares = sorted({x for b in large for x in b.shares()})
    edges = {r["_k"]: sorted(set(r["e"])) for r in here.groupBy("_k").agg(F.percentile_approx("value", shares, 20_000).alias("e")).collect()}
    # an edge is a slot of its own, so that a value that very many rows have ends the search
    e = F.get(F.array(*(F.array(*map(F.lit, edges[k])) for k in range(len(large)))), F.col("_k"))
    slot = 2 * F.size(F.filter(e, lambda x: x < F.col("value"))) + F.array_contains(e, F.col("value")).cast("int")
    slots: dict[int, list] = {}
    for r in here.groupBy("_k", slot.alias("slot")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
        slots.setdefault(r["_k"], []).append((r["slot"], r["n"], r["low"], r["high"]))
    later = []
    for k, b in enumerate(large):
        below = b.below
        for _, n, low, high in sorted(slots[k]):
            ranks = [r for r in b.ranks if below <= r < below + n]
            if ranks:
                later.append(_Bracket(b.feature, low, high, n, below, ranks))
            below += n
    return later


def quantiles(points: DataFrame, features: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of each feature, between two values in proportion; an
    empty list for a feature without values."""
    cells = points.select(F.posexplode(F.array(*(F.col(f).cast("double") for f in features))).alias("feature", "value"))
    sizes = points.agg(*(F.count(f).alias(f"n{k}") for k, f in enumerate(features))).first()
    at = {k: [x * (sizes[f"n{k}"] - 1) for x in shares] for k in range(len(features)) if sizes[f"n{k}"]}
    found = order_statistics(cells, {k: {r for x in places for r in (math.floor(x), math.ceil(x))} for k, places in at.items()})

    def value(k: int, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        a, z = found[k][low], found[k][high]
        return a if low == high or a == z else (high - x) * a + (x - low) * z

    return {f: [value(k, x) for x in at.get(k, [])] for k, f in enumerate(features)}


def value_ranks(points: DataFrame, features: list[str]) -> DataFrame:
    """(id, feature, value, rank) with ranks from 1 by value, then id."""
    cells = points.select("id", F.posexplode(F.array(*(F.col(f).cast("double") for f in features))).alias("feature", "value"))
    return placed(cells, "value", "id").select("id", "feature", "value", (F.col("place") + 1).cast("int").alias("rank"))

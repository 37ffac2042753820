"""Boxes of places against labelled points in blocks.

Points stand at places, whole numbers for each feature. Blocks are cut where
the places of a block spread most, so that points of a block stand together;
those of one feature alone have blocks of their own, as a box that is bounded
in one feature meets a point for each place and label of it. The driver holds
a short summary of each block: its ends, and its points of each label.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import cut

#: Rows that meet a block at once; rows of a block, and rows at most, by which cuts are chosen.
PACK, SAMPLED, SAMPLE = 4096, 64, 100_000


def _tree(x: np.ndarray, leaves: int):
    """Cuts (feature, place, those up to it, those above) into so many leaves."""
    if leaves < 2 or len(x) < 2:
        return None
    spread = x.max(0) - x.min(0)
    k = int(spread.argmax())
    if not spread[k]:
        return None
    v = np.sort(x[:, k])
    at = int(v[(len(v) - 1) // 2])
    if at == v[-1]:
        at = int(v[v < v[-1]][-1])
    low = x[:, k] <= at
    few = min(leaves - 1, max(1, round(leaves * float(low.mean()))))
    return k, at, _tree(x[low], few), _tree(x[~low], leaves - few)


def _leaves(tree, x: np.ndarray, rows: np.ndarray, first: int, out: np.ndarray) -> int:
    """Numbers the leaves that rows of x are in, from ``first``; the next number."""
    if tree is None:
        out[rows] = first
        return first + 1
    k, at, low, high = tree
    left = x[rows, k] <= at
    return _leaves(high, x, rows[~left], _leaves(low, x, rows[left], first, out), out)


def kind_of(features: Sequence[int], d: int) -> int:
    """Which blocks a box meets that is bounded in these of d features: those of the feature, or (d) of all."""
    return features[0] if len(features) == 1 else d


@dataclass(frozen=True)
class Blocks:
    """Cuts and summaries of blocks, by kind; names of blocks are unique over kinds."""

    d: int
    trees: dict
    first: dict[int, int]
    names: dict[int, np.ndarray]
    lo: dict[int, np.ndarray]
    hi: dict[int, np.ndarray]
    n: dict[int, np.ndarray]
    of: dict[int, dict[int, np.ndarray]]

    def axes(self, kind: int) -> list[int]:
        return list(range(self.d)) if kind == self.d else [kind]

    def home(self, kind: int, x: np.ndarray) -> np.ndarray:
        """The blocks of points x of that kind."""
        out = np.zeros(len(x), np.int64)
        _leaves(self.trees[kind], x, np.arange(len(x)), self.first[kind], out)
        return out

    def labelled(self, kind: int, label: int) -> np.ndarray:
        return self.of[kind].get(label, np.zeros_like(self.n[kind]))

    def met(self, kind: int, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(boxes x blocks): whether a block has places in (a, z], and none outside."""
        lo, hi, axes = self.lo[kind], self.hi[kind], self.axes(kind)
        some = np.ones((len(a), len(lo)), bool)
        every = some.copy()
        for c, k in enumerate(axes):
            below, above = a[:, k, None], z[:, k, None]
            some &= (hi[:, c] > below) & (lo[:, c] <= above)
            every &= (lo[:, c] > below) & (hi[:, c] <= above)
        return some, every


def blocks_of(points: DataFrame, d: int, block: int) -> tuple[Blocks, DataFrame]:
    """The blocks of points (p, label), p an array of d places, and their rows
    (kb, p, label, n), n counting equal ones; in those of one feature p has it alone."""
    same = cut(points.groupBy("p", "label").agg(F.count("*").alias("n")))
    kinds = list(range(d)) + [d] * (d > 1)
    rows = None
    for kind in kinds:
        of = same if kind == d else same.groupBy(F.array(F.get("p", F.lit(kind))).alias("p"), "label").agg(F.sum("n").alias("n"))
        of = of.select(F.lit(kind).alias("kind"), "p", "label", "n")
        rows = of if rows is None else rows.union(of)
    rows = cut(rows)
    sizes = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    trees, first, free = {}, {}, 0
    for kind in kinds:
        leaves = -(-sizes.get(kind, 0) // block)
        some = np.zeros((0, 1), np.int64)
        if leaves > 1:  # what is cut where decides on balance only
            picked = rows.filter(F.col("kind") == kind).orderBy(F.xxhash64("p", "label")).limit(min(SAMPLE, SAMPLED * leaves)).toPandas()
            some = np.stack(picked["p"])
        trees[kind], first[kind] = _tree(some, leaves), free
        free += max(1, leaves)
    cuts = Blocks(d, trees, first, {}, {}, {}, {}, {})

    def placed(batches):
        for b in batches:
            for kind, part in b.groupby("kind"):
                yield pd.DataFrame({"kind": kind, "kb": cuts.home(int(kind), np.stack(part["p"])), "p": part["p"].to_numpy(), "label": part["label"].to_numpy(), "n": part["n"].to_numpy()})

    rows = cut(rows.mapInPandas(placed, "kind int, kb long, p array<long>, label int, n long"))
    ends = [f(F.get("p", F.lit(k))).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(d)]
    summary = rows.groupBy("kind", "kb", "label").agg(F.sum("n").alias("n"), *ends).toPandas()
    out = Blocks(d, trees, first, {}, {}, {}, {}, {})
    for kind in kinds:
        at = summary[summary["kind"] == kind]
        names, place = np.unique(at["kb"].to_numpy(np.int64), return_inverse=True)
        width = len(out.axes(kind))
        lo, hi, n = np.full((len(names), width), np.iinfo(np.int64).max), np.full((len(names), width), -1), np.zeros(len(names), np.int64)
        for c in range(width):
            np.minimum.at(lo[:, c], place, at[f"lo{c}"].to_numpy(np.int64))
            np.maximum.at(hi[:, c], place, at[f"hi{c}"].to_numpy(np.int64))
        np.add.at(n, place, at["n"].to_numpy(np.int64))
        of: dict[int, np.ndarray] = {}
        for label, b, many in zip(at["label"].tolist(), place.tolist(), at["n"].tolist(), strict=True):
            of.setdefault(label, np.zeros(len(names), np.int64))[b] += many
        out.names[kind], out.lo[kind], out.hi[kind], out.n[kind], out.of[kind] = names, lo, hi, n, of
    return out, rows


def meet(left: DataFrame, rows: DataFrame, by: Sequence[str], out: Callable, schema: str) -> DataFrame:
    """out(left rows, rows of a block) for the left rows (kb, ...) of each block,
    a pack of about PACK at once. Packs are dealt by the columns ``by``."""
    spark = left.sparkSession
    packs = [(r["kb"], -(-r["count"] // PACK)) for r in left.groupBy("kb").count().collect()]  # a row a block
    of = F.broadcast(spark.createDataFrame(packs, "kb long, _m long"))
    tasks = max(1, min(sum(m for _, m in packs), 8 * spark.sparkContext.defaultParallelism))
    a = left.join(of, "kb").withColumn("_bi", F.pmod(F.xxhash64(*by), "_m")).drop("_m").repartition(tasks, "kb", "_bi")
    b = rows.join(of, "kb").withColumn("_bi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m").repartition(tasks, "kb", "_bi")
    return a.groupBy("kb", "_bi").cogroup(b.groupBy("kb", "_bi")).applyInPandas(out, schema)


class Sorted:
    """Points in the order of a feature, so that those within reach of a place are a slice."""

    def __init__(self, x: np.ndarray, along: int):
        self.x, self.along = x[np.argsort(x[:, along], kind="stable")], along
        self.v = np.ascontiguousarray(self.x[:, along])
        self.lo, self.hi = (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1], np.int64),) * 2

    def furthest(self, p: np.ndarray, chosen: Sequence[int]) -> np.ndarray:
        """The most steps from each of p in a chosen feature; 0 without points."""
        if not len(self.x):
            return np.zeros(len(p), np.int64)
        return np.maximum(p - self.lo, self.hi - p)[:, chosen].max(axis=1)

    def slices(self, p: np.ndarray, reach: int, chosen: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the rows that may be within reach of each of p."""
        if self.along not in chosen:
            return np.zeros(len(p), np.int64), np.full(len(p), len(self.x))
        at = p[:, self.along]
        return np.searchsorted(self.v, at - reach), np.searchsorted(self.v, at + reach, "right")

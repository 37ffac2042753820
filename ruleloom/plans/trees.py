"""Trees grown best-first. The driver holds the nodes; which node a point is in
is an expression over its features, so that points are never rewritten, and a
round scores its new leaves in one job."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Condition, Node
from ..operators import splits
from ..operators.labels import predict_tree
from ..operators.ranking import value_spans


#: Values of all projections that a task counts, about.
CELLS = 500_000


@dataclass
class Tree:
    """Base: information gain on axes. Points are (id, label, features...)."""

    features: Sequence[str]
    max_leaf_nodes: int | None = None
    max_depth: int | None = None
    min_points_leaf: int = 1
    bins: int | None = None
    midpoints: bool = False
    root: Node | None = field(default=None, init=False)

    def projections(self) -> list[splits.Projection]:
        return splits.axes(self.features)

    def gain(self, labels: list[int], n: int) -> Column:
        return splits.information_gain(n)

    def may_split(self, node: Node) -> bool:
        return node.cost > 0

    def prepare(self, points: DataFrame) -> DataFrame:
        return points.filter(F.col("label").isNotNull())

    def fit(self, points: DataFrame) -> Tree:
        points = self.prepare(points)
        tasks = -(-points.count() * len(self.projections()) // CELLS)
        if tasks > 1:  # a small file may hold very many points
            points = points.repartition(tasks, "id")
        points = points.persist()
        try:
            self._grow(points)
        finally:
            points.unpersist()
        return self

    def _grow(self, points: DataFrame) -> None:
        counts = {r["label"]: r["count"] for r in points.groupBy("label").count().collect()}
        labels, n = sorted(counts), sum(counts.values())
        limit = self.max_leaf_nodes or n
        self._made = 0
        self._spans = value_spans(splits.cells(points, self.projections()))
        self.root = self._node(0, counts)
        self.root.leaf_num = 0
        heap: list = []
        self._score(points, [self.root], labels, n, heap)
        leaves = 1
        while heap and leaves < limit:
            _, _, node, condition, left, right = heapq.heappop(heap)
            node.condition, node.left, node.right = condition, left, right
            left.leaf_num, right.leaf_num, node.leaf_num = node.leaf_num, leaves, None
            leaves += 1
            points = self.after_split(points, node)
            if leaves < limit:
                self._score(points, [left, right], labels, n, heap)

    def after_split(self, points: DataFrame, node: Node) -> DataFrame:
        return points

    def _node(self, depth: int, counts: dict[int, int]) -> Node:
        """A leaf: its label is the most frequent one, the smallest of ties; its
        cost is how many points have another label."""
        self._made += 1
        counts = {y: c for y, c in counts.items() if c}
        label = min(counts, key=lambda y: (-counts[y], y), default=None)
        return Node(self._made - 1, label, depth, size=sum(counts.values()), cost=sum(counts.values()) - max(counts.values(), default=0))

    def _score(self, points: DataFrame, leaves: list[Node], labels: list[int], n: int, heap: list) -> None:
        leaves = [x for x in leaves if self.may_split(x) and (self.max_depth is None or x.depth < self.max_depth)]
        if not leaves:
            return
        by = {x.node_id: x for x in leaves}
        here = points.withColumn("_node", self.root.column(lambda x: x.node_id if x.node_id in by else None)).filter(F.col("_node").isNotNull())
        projections = self.projections()
        found = splits.candidates(here, projections, labels, F.col("_node"), self.bins, self._spans).persist()
        try:
            best = splits.best_splits(found, self.gain(labels, n), self.min_points_leaf)
            chosen = found.join(F.broadcast(best), ["node", "feature", "threshold"])  # a row for each of the round's leaves
            rows = chosen.select("node", "gain", "feature", "threshold", "above", "l", "r").collect()
        finally:
            found.unpersist()
        for r in rows:
            node, p = by[r["node"]], projections[r["feature"]]
            t = (r["threshold"] + r["above"]) / 2 if self.midpoints else r["threshold"]
            condition = Condition(p.features, p.weights, float(t), -1)
            sides = [self._node(node.depth + 1, dict(zip(labels, r[c], strict=True))) for c in ("l", "r")]
            heapq.heappush(heap, (-r["gain"], node.node_id, node, condition, *sides))

    def predict(self, points: DataFrame, leaf_labels: bool = False) -> DataFrame:
        return predict_tree(points, self.root, leaf_labels)

    def weighted_depth(self, points: DataFrame) -> DataFrame:
        """Mean depth of the leaf that a point falls in; NaN without points."""
        return points.select(self.root.column(lambda n: n.depth).alias("d")).agg(F.coalesce(F.avg("d"), F.lit(float("nan"))).alias("weighted_depth"))


@dataclass
class ID3Tree(Tree):
    """Information gain, thresholds at data values."""


@dataclass
class DecisionTree(Tree):
    """CART: entropy or Gini impurity, thresholds midway between values."""

    criterion: str = "entropy"
    midpoints: bool = True

    def gain(self, labels, n):
        if self.criterion not in ("entropy", "gini"):
            raise ValueError("criterion is entropy or gini")
        return splits.gini_gain(n) if self.criterion == "gini" else splits.information_gain(n)


@dataclass
class ObliqueTree(Tree):
    """Information gain on axes and on lines through pairs of features."""

    def projections(self):
        return splits.oblique(self.features)


@dataclass
class ExplanationTree(Tree):
    """At most one leaf for each cluster; each split removes the points that
    keep a cluster on both sides."""

    num_clusters: int = 2
    outliers: DataFrame | None = field(default=None, init=False)

    def __post_init__(self):
        self.max_leaf_nodes = self.num_clusters

    def gain(self, labels, n):
        return splits.outlier_gain()

    def after_split(self, points: DataFrame, node: Node) -> DataFrame:
        """Drops the minority side of each cluster that the node splits."""
        side = F.when(node.condition.turned(-1).column(), 0).when(node.condition.turned(1).column(), 1)
        inside = points.withColumn("_side", F.when(self._inside(node), side))
        counts = {(r["label"], r["_side"]): r["count"] for r in inside.filter(F.col("_side").isNotNull()).groupBy("label", "_side").count().collect()}
        sides = _keep_sides({y: (counts.get((y, 0), 0), counts.get((y, 1), 0)) for y, _ in counts})
        keep = F.lit(None).cast("int")
        for y, s in sides.items():
            keep = F.when(F.col("label") == y, s).otherwise(keep)
        gone = inside.filter(F.col("_side").isNotNull() & (F.col("_side") != keep)).select("id")
        self.outliers = gone if self.outliers is None else self.outliers.union(gone)
        for leaf, s in ((node.left, 0), (node.right, 1)):
            left = {y: counts[y, s] for y, k in sides.items() if k == s}
            leaf.label = min(left, key=lambda y: (-left[y], y), default=None)
            leaf.cost = sum(left.values()) - max(left.values(), default=0)
            leaf.size = sum(left.values())
        return inside.filter(F.col("_side").isNull() | (F.col("_side") == keep)).drop("_side")

    def _inside(self, node: Node) -> Column:
        """Does a row fall in this node?"""

        def find(n: Node) -> Column:
            if n is node:
                return F.lit(True)
            if n.is_leaf:
                return F.lit(False)
            return F.when(n.condition.turned(-1).column(), find(n.left)).when(n.condition.turned(1).column(), find(n.right)).otherwise(F.lit(False))

        return find(self.root)

    def fit(self, points: DataFrame) -> Tree:
        self.outliers = None
        super().fit(points)
        if self.outliers is None:
            self.outliers = points.select("id").limit(0)
        return self

    def predict(self, points: DataFrame, leaf_labels: bool = False, remove_outliers: bool = False) -> DataFrame:
        out = super().predict(points, leaf_labels)
        if not remove_outliers:
            return out
        gone = self.outliers.distinct().withColumn("_gone", F.lit(True))
        return out.join(gone, "id", "left").select("id", F.when(F.col("_gone"), F.array(F.lit(-1))).otherwise(F.col("labels")).alias("labels"))


def _keep_sides(counts: dict[int, tuple[int, int]]) -> dict[int, int]:
    """The side that each cluster stays on: its larger one, ties to fill an
    empty side first and else to the left; if all are on one side, the
    straddling cluster that loses least is turned."""
    sides = {y: 0 if a > b else 1 if b > a else None for y, (a, b) in counts.items()}
    for y in sorted(y for y, s in sides.items() if s is None):
        taken = {s for s in sides.values() if s is not None}
        sides[y] = 1 if taken == {0} else 0
    if len(set(sides.values())) == 1 and len(sides) > 1:
        straddling = [y for y, (a, b) in counts.items() if a and b]
        if straddling:
            y = min(straddling, key=lambda y: (max(counts[y]), max(counts[y]) - min(counts[y]), y))
            sides[y] = 1 - sides[y]
    return sides


@dataclass
class ImmTree(Tree):
    """Iterative mistake minimisation for a k-means clustering (Dasgupta et al.
    2020): splits part centers until each leaf has one. Points are labelled
    with their nearest center first; a point parted from its center is a
    mistake and leaves the search."""

    centers: Sequence[Sequence[float]] = ()
    norm: int = 2

    def prepare(self, points: DataFrame) -> DataFrame:
        return nearest_center(points, self.features, self.centers, self.norm)

    def gain(self, labels, n):
        return splits.center_gain(dict(enumerate(self.centers)), labels, self.projections(), list(self.features))

    def _node(self, depth, counts):
        node = super()._node(depth, counts)
        node.centers = sorted(y for y, c in counts.items() if c)
        return node

    def may_split(self, node: Node) -> bool:
        return len(node.centers) > 1

    def after_split(self, points: DataFrame, node: Node) -> DataFrame:
        """Each side keeps its own centers' points."""
        f = node.condition.features[0]
        at = list(self.features).index(f)
        for leaf, inside in ((node.left, lambda v: v <= node.condition.threshold), (node.right, lambda v: v > node.condition.threshold)):
            leaf.centers = [c for c in node.centers if inside(self.centers[c][at])]
            if leaf.label not in leaf.centers:
                leaf.label = leaf.centers[0] if leaf.centers else None
        keep = self.root.column(lambda n: tuple(n.centers) and ",".join(map(str, n.centers)))
        return points.filter(F.array_contains(F.split(keep, ",").cast("array<int>"), F.col("label")))


@dataclass
class ExkmcTree(ImmTree):
    """IMM up to one leaf a center, then more leaves by the surrogate cost
    (Frost et al. 2020): a side counts as served by its best single center."""

    def fit(self, points: DataFrame) -> Tree:
        wanted = self.max_leaf_nodes
        self.max_leaf_nodes = len(self.centers)
        super().fit(points)
        self.max_leaf_nodes = wanted
        if wanted and wanted > len(self.centers):
            self._expand(self.prepare_all(points), wanted)
        return self

    def prepare_all(self, points: DataFrame) -> DataFrame:
        return points.persist()

    def _expand(self, points: DataFrame, wanted: int) -> None:
        from pyspark.sql import Window

        k = len(self.centers)
        cost = [sum(((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(self.features, c, strict=True)), F.lit(0.0)) for c in self.centers]
        while len(leaves := self.root.leaves()) < wanted:
            here = points.select(self.root.column(lambda n: n.node_id).alias("node"), F.posexplode(F.array(*(F.col(f).cast("double") for f in self.features))).alias("feature", "value"), *(c.alias(f"c{j}") for j, c in enumerate(cost)))
            sums = here.groupBy("node", "feature", "value").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k)))
            whole = Window.partitionBy("node", "feature")
            upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            both = sums.select("node", "feature", "value", F.array(*(F.sum(f"c{j}").over(upto) for j in range(k))).alias("l"), F.array(*(F.sum(f"c{j}").over(whole) for j in range(k))).alias("t"), F.max("value").over(whole).alias("top")).filter("value < top")
            right = F.zip_with("t", "l", lambda t, a: t - a)
            saved = F.round(F.array_min("t") - F.array_min("l") - F.array_min(right), 9)
            r = both.select(saved.alias("s"), "node", "feature", "value", F.array_position("l", F.array_min("l")).alias("a"), F.array_position(right, F.array_min(right)).alias("b")).orderBy(F.desc("s"), "node", "feature", "value").limit(1).collect()
            if not r or r[0]["s"] <= 0:
                return
            node = next(n for n in leaves if n.node_id == r[0]["node"])
            node.condition = Condition.axis(self.features[r[0]["feature"]], r[0]["value"])
            node.left = Node(self._made, int(r[0]["a"]) - 1, node.depth + 1, leaf_num=node.leaf_num)
            node.right = Node(self._made + 1, int(r[0]["b"]) - 1, node.depth + 1, leaf_num=len(leaves))
            node.leaf_num = None
            self._made += 2


@dataclass
class ShallowTree(ImmTree):
    """IMM whose splits also pay for imbalance of depth: depth_factor times the
    number of points on the side with more centers."""

    depth_factor: float = 0.03

    def gain(self, labels, n):
        base = super().gain(labels, n)
        here = lambda c: F.size(F.filter(c, lambda x: x > 0))
        size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        heavy = F.when(here("l") >= here("r"), size("l")).otherwise(size("r"))
        return base - self.depth_factor * heavy


def nearest_center(points: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], norm: int = 2) -> DataFrame:
    """Points with their nearest center as label, the first of ties."""
    dist = [sum((F.abs(F.col(f) - F.lit(float(v))) if norm == 1 else (F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(features, c, strict=True)), F.lit(0.0)) for c in centers]
    near = F.array(*dist)
    return points.withColumn("label", (F.array_position(near, F.array_min(near)) - 1).cast("int"))

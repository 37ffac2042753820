"""Modules of an experiment: a clustering to explain, and models that explain it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RuleSet
from ..operators import clusters as C
from ..operators import labels as L
from .sets import DecisionSet
from .trees import DecisionTree, ExkmcTree, Tree


@dataclass
class Clustering:
    """assign(points) gives (id, label), computed once."""

    features: Sequence[str]
    _labels: DataFrame | None = field(default=None, init=False)

    def assign(self, points: DataFrame) -> DataFrame:
        if self._labels is None:
            self._labels = self._assign(points).persist()
        return self._labels


@dataclass
class KMeansBase(Clustering):
    n_clusters: int = 8
    seed: int = 342
    centers: list[list[float]] | None = field(default=None, init=False)

    def _assign(self, points):
        out, self.centers = C.kmeans(points, self.features, self.n_clusters, self.seed)
        return out


@dataclass
class DBSCANBase(Clustering):
    eps: float = 0.5
    n_core: int = 5

    def _assign(self, points):
        return C.dbscan(points, self.features, self.eps, self.n_core)


@dataclass
class AgglomerativeBase(Clustering):
    """Single linkage."""

    n_clusters: int = 2

    def _assign(self, points):
        return C.agglomerative(points, self.features, self.n_clusters)


@dataclass
class IMMBase(Clustering):
    """A threshold tree over given centers; the centers move to their leaves' means."""

    centers: Sequence[Sequence[float]] = ()
    max_leaf_nodes: int | None = None
    new_centers: DataFrame | None = field(default=None, init=False)

    def _assign(self, points):
        tree = ExkmcTree(self.features, centers=self.centers, max_leaf_nodes=self.max_leaf_nodes).fit(points)
        found = tree.predict(points).select("id", F.get("labels", F.lit(0)).alias("label"))
        old = points.sparkSession.createDataFrame([(k, *map(float, c)) for k, c in enumerate(self.centers)], "cluster int, " + ", ".join(f"{f} double" for f in self.features))
        self.new_centers = L.update_centers(points.select("id", *self.features), self.features, old, found.select("id", F.col("label").alias("cluster")))
        return found


@dataclass
class DecisionTreeMod:
    """Fits a tree and gives its rules, their number and its depth."""

    tree: Tree

    def fit(self, points: DataFrame) -> RuleSet:
        self.tree.fit(points)
        self.rules = self.tree.root.rules()
        self.n_rules, self.max_rule_length = len(self.rules), self.tree.root.depth_below()
        return self.rules

    def predict(self, points: DataFrame) -> DataFrame:
        return self.tree.predict(points)


@dataclass
class DecisionSetMod:
    """Fits a decision set; rules mined once are used again for each setting."""

    make: Callable[[RuleSet], DecisionSet]
    mined: RuleSet

    def fit(self, points: DataFrame) -> RuleSet:
        self.model = self.make(self.mined).fit(points)
        self.rules = self.model.rules
        self.n_rules, self.max_rule_length = len(self.rules), self.rules.max_length
        return self.rules

    def predict(self, points: DataFrame) -> DataFrame:
        return self.model.predict(points)


@dataclass
class DecisionForest:
    """Trees on random shares of the rows and pairs of features: a pool of rules."""

    features: Sequence[str]
    n_trees: int = 5
    share: float = 0.5
    n_features: int = 2
    max_leaf_nodes: int = 8
    seed: int = 0

    def fit(self, points: DataFrame) -> RuleSet:
        import random

        rng = random.Random(self.seed)
        rules: list = []
        for k in range(self.n_trees):
            chosen = rng.sample(list(self.features), min(self.n_features, len(self.features)))
            drawn = points.filter(F.pmod(F.xxhash64("id", F.lit(self.seed + k)), F.lit(1_000_000)) < int(self.share * 1_000_000))
            rules += DecisionTree(chosen, max_leaf_nodes=self.max_leaf_nodes).fit(drawn).root.rules()
        return RuleSet(tuple(dict.fromkeys(rules)))

"""Connected components and spanning forests of links in DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task gathers before it drops those that close a cycle, and edges of a forest that it holds at most.
GATHERED, HELD = 65_536, 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed: plan and lineage end here, in the folder that the session
    names in ``spark.checkpoint.dir``. Only a local master gets a folder of its
    own where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ruleloom-"))
    return df.checkpoint()


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """(c, m): the least name that each linked name reaches, from links
    (ci, cj); least names themselves, and names without a link, have no row.

    At most ``held`` links are joined by one task. With more, each round a
    name's larger neighbours move to its least one, then all its neighbours do
    (Kiveris and others, 2014), so that the rounds are few even where the links
    form long chains."""
    edges = cut(links.select(F.greatest("ci", "cj").alias("u"), F.least("ci", "cj").alias("v")).filter("u > v").distinct())
    before = _sum(edges)
    if before[0] <= held:
        id_type = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInPandas(_least, f"c {id_type}, m {id_type}")
    while True:
        both = edges.union(edges.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("l")).select("a", F.least("a", "l").alias("l"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("l").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("l"))
        small = large.join(lowest, "u").filter("v > l").select(F.col("v").alias("u"), F.col("l").alias("v"))
        edges = cut(small.union(lowest.select("u", F.col("l").alias("v"))).distinct())
        after = _sum(edges)
        if after == before:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("m"))
        before = after


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            a, z = sorted((root(u), root(v)))
            up[z] = a
    rows = [(x, root(x)) for x in up]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["c", "m"])


def _sum(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def merge(comp: DataFrame, links: DataFrame, held: int = HELD) -> DataFrame:
    """comp (v, c) with components joined along links (ci, cj); each takes its least name."""
    return comp.join(components(links, held), "c", "left").select("v", F.coalesce("m", "c").alias("c"))


def spanning_tree(dist: DataFrame, held: int = HELD) -> DataFrame:
    """Edges (i, j, d), i < j, of a minimum spanning tree of the pairs in dist,
    which has both directions. Ties go to the smaller pair of ids.

    Each task first keeps a spanning forest of the pairs that it makes: an
    edge that closes a cycle of shorter ones is in no tree, so that all pairs
    are never written. Forests are joined by fewer tasks as long as that drops
    edges. If at most ``held`` are left, a task ends the work; more take
    Boruvka's rounds, to the same tree: each component takes its least edge,
    components that meet become one."""
    id_type = dist.schema["i"].dataType.simpleString()
    schema = f"i {id_type}, j {id_type}, d double"
    edges = cut(dist.filter("i < j").select("i", "j", "d").mapInPandas(_forests, schema))
    n = edges.count()
    while n > held:
        before, tasks = n, -(-n // HELD)
        edges = cut(edges.repartition(tasks).mapInPandas(_forests, schema))
        n = edges.count()
        if tasks == 1 or n > 0.7 * before:
            break
    if n <= held:
        return cut(edges.coalesce(1).mapInPandas(_forests, schema))
    comp = edges.select(F.explode(F.array("i", "j")).alias("v")).distinct().select("v", F.col("v").alias("c"))
    tree = edges.limit(0)
    while True:
        at = lambda name, out, comp=comp: comp.select(F.col("v").alias(name), F.col("c").alias(out))
        out = edges.join(at("i", "ci"), "i").join(at("j", "cj"), "j").filter("ci != cj")
        both = out.select("i", "j", "d", "ci", "cj", F.explode(F.array("ci", "cj")).alias("c"))
        best = both.groupBy("c").agg(F.min(F.struct("d", "i", "j", "ci", "cj")).alias("e")).select("e.*").distinct()
        best = cut(best)
        if best.isEmpty():
            return tree
        tree = tree.union(best.select("i", "j", "d"))
        comp = cut(merge(comp, best, held))


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest, waiting, n = None, [], 0
    for b in batches:
        waiting.append(b)
        n += len(b)
        if n >= max(GATHERED, 0 if forest is None else 2 * len(forest)):
            forest, waiting, n = _forest(pd.concat([forest, *waiting])), [], 0
            if len(forest) >= HELD:  # a forest for each part of the edges is as good
                yield forest
                forest = None
    if forest is not None or waiting:
        yield _forest(pd.concat([forest, *waiting]))


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """Kruskal's: the edges that close no cycle, from the shortest on."""
    edges = edges.sort_values(["d", "i", "j"], kind="stable")
    codes = pd.factorize(pd.concat([edges["i"], edges["j"]]))[0].tolist()
    n = len(edges)
    up = list(range(max(codes, default=-1) + 1))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept = np.zeros(n, bool)
    for k in range(n):
        a, b = root(codes[k]), root(codes[n + k])
        if a != b:
            up[b] = a
            kept[k] = True
    return edges[kept]

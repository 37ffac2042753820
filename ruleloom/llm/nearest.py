"""Approximate nearest neighbours with a forest of random-projection trees.

All nodes of a level of a tree share a direction, the difference of two random
vectors, and split at the median of a bounded sample's projections: each node
its own down to level TOP, and below it each level by the medians of the node
at TOP. So a tree of any depth has few numbers, and its depth is taken so that
leaves hold about LEAF vectors whatever the size of the table. A query searches
all trees through one priority queue, in which a subtree ranks by the squared
margins on the way to it. How many leaves it takes is measured: some queries'
true neighbours are found by one scan, and as many leaves are taken as lead to
the asked share of them. So recall holds at any size, and work follows from how
well the data can be told apart.

Equal vectors are one candidate with the few smallest ids. What stands in the
leaves is not the vector but a byte for each component, with a proven bound of
its error. Queries meet these in blocks of bounded size, by a matrix product;
what can be among the best by its bound is reranked exactly by the original
vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import below, remove, share_of, written

#: Trees of the forest, vectors that a leaf is meant to hold, and leaves of a tree where the table allows it.
TREES, LEAF, LEAST_LEAVES = 4, 1600, 32
#: Share of the true neighbours that the leaves taken are to hold, and queries that this is measured on.
RECALL, MEASURED = 0.97, 200
#: Levels whose nodes each have their own median.
TOP = 10
#: Vectors and bytes of the sample that the medians are taken of, at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32_000_000
#: Vectors, and queries, of one block of a leaf.
BLOCK, BLOCK_QUERIES = 8_000, 2_000
#: Leaves of several blocks up to which their list is sent to all tasks.
MOST_HEAVY = 100_000


@dataclass
class Forest:
    """directions: (trees, depth, d), unit rows; cuts[tree][level]: a cut for
    each node of the level or, below TOP, for each node of level TOP."""

    directions: np.ndarray
    cuts: list[list[np.ndarray]]
    top: int

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def projections(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, depth)."""
        t, depth, d = self.directions.shape
        return (x @ self.directions.reshape(t * depth, d).T).reshape(len(x), t, depth)

    def leaves_of(self, p: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree, from projections."""
        node = np.zeros(p.shape[:2], np.int64)
        for t, levels in enumerate(self.cuts):
            for k, cut in enumerate(levels):
                at = node[:, t]
                node[:, t] = 2 * at + (p[:, t, k] >= cut[at >> max(0, k - self.top)])
        return self.numbered(node, np.arange(len(self.cuts)))

    @staticmethod
    def numbered(node, tree):
        return node | (tree << 56)

    def search(self, p: np.ndarray, n: int) -> list[list[int]]:
        """The first n leaves that each row's queue gives."""
        return [list(islice(walk, n)) for walk in self.walks(p)]

    def walks(self, p: np.ndarray) -> Iterator[Iterator[int]]:
        """For each row all leaves, in the order of its queue."""
        cuts = [[c.tolist() for c in levels] for levels in self.cuts]
        return (self._walk(row, cuts) for row in p.tolist())

    def _walk(self, row: list, cuts: list) -> Iterator[int]:
        depth, top = self.depth, self.top
        queue = [(0.0, t, 0, 0) for t in range(len(cuts))]
        while queue:
            far, t, k, node = heapq.heappop(queue)
            while k < depth:  # to the leaf on the query's side, leaving the other sides in the queue
                m = row[t][k] - cuts[t][k][node >> max(0, k - top)]
                k, node = k + 1, 2 * node + (m >= 0)
                heapq.heappush(queue, (far + m * m, t, k, node ^ 1))
            yield self.numbered(node, t)


def grow(sample: np.ndarray, n_trees: int, depth: int, top: int = TOP, seed: int = 11) -> Forest:
    """A forest on unit rows."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    directions = np.zeros((n_trees, depth, d))
    for t in range(n_trees):
        for k in range(depth):
            a, b = sample[rng.integers(0, len(sample), 2)]
            normal = a - b if (a != b).any() else rng.normal(size=d)
            directions[t, k] = normal / np.linalg.norm(normal)
    forest = Forest(directions, [[] for _ in range(n_trees)], top)
    p = forest.projections(sample)
    for t, levels in enumerate(forest.cuts):
        node = np.zeros(len(sample), np.int64)
        for k in range(depth):
            own = node >> max(0, k - top)
            levels.append(_medians(own, p[:, t, k], 1 << min(k, top)))
            node = 2 * node + (p[:, t, k] >= levels[k][own])
    return forest


def _medians(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The upper median of each group's values; 0 for a group without any."""
    order = np.lexsort((values, group))
    starts = np.searchsorted(group[order], np.arange(n + 1))
    size = np.diff(starts)
    return np.where(size > 0, values[order][np.minimum(starts[:-1] + size // 2, len(values) - 1)], 0.0)


def _usable(v: Column) -> Column:
    # not true for a null, and NaN is over everything for Spark
    fine = F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    return x / top / np.linalg.norm(x / top, axis=1, keepdims=True)


def _code(batches: Iterator[pa.RecordBatch], forest, n: int) -> Iterator[pa.RecordBatch]:
    """For each vector its bytes, their unit, how far they are from the unit
    vector at most, its leaves and, if it is asked for, the leaves to look into."""
    f: Forest = forest.value
    longs = pa.list_(pa.int64())
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            x = _unit(_matrix(part.column("v")))
            p = f.projections(x)
            unit = np.abs(x).max(1) / 127
            code = np.rint(x / unit[:, None]).astype(np.int8)
            error = np.linalg.norm(x - code * unit[:, None], axis=1) + 1e-6
            asked = part.column("asked").to_numpy(zero_copy_only=False)
            probes: list = [None] * len(x)
            for i, leaves in zip(np.nonzero(asked)[0], f.search(p[asked], n), strict=True):
                probes[i] = leaves
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("g"), part.column("sure"), codes, pa.array(unit), pa.array(error), pa.array(list(f.leaves_of(p)), longs), pa.array(probes, longs)], names=["g", "sure", "code", "unit", "error", "leaves", "probes"])


def _closest(batches: Iterator[pa.RecordBatch], forest, asked, k: int) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors the k closest to each measured query, with their leaves."""
    f, (own, q) = forest.value, asked.value
    g, score, leaves = np.empty((len(q), 0), np.int64), np.empty((len(q), 0)), np.empty((len(q), 0, len(f.cuts)), np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            x, ids = _unit(_matrix(part.column("v"))), part.column("g").to_numpy()
            near = q @ x.T
            near[own[:, None] == ids] = -2.0
            few = np.argpartition(near, -min(k, len(ids)), 1)[:, -k:]
            here = f.leaves_of(f.projections(x))
            g, score, leaves = np.hstack([g, ids[few]]), np.hstack([score, np.take_along_axis(near, few, 1)]), np.concatenate([leaves, here[few]], 1)
            best = np.argsort(-score, 1, kind="stable")[:, :k]
            g, score, leaves = np.take_along_axis(g, best, 1), np.take_along_axis(score, best, 1), np.take_along_axis(leaves, best[:, :, None], 1)
    row, col = np.nonzero(score > -1.5)
    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(g[row, col]), pa.array(score[row, col]), pa.array(list(leaves[row, col]), pa.list_(pa.int64()))], names=["q", "g", "score", "leaves"])


def _ranks(batches: Iterator[pa.RecordBatch], forest, asked) -> Iterator[pa.RecordBatch]:
    """How many leaves a query's queue gives until each true neighbour is met."""
    f, (_, q) = forest.value, asked.value
    for b in batches:
        rows = b.column("q").to_numpy()
        out = []
        for walk, wanted in zip(f.walks(f.projections(q[rows])), b.column("wanted").to_pylist(), strict=True):
            left = [set(leaves) for leaves in wanted]
            for n, leaf in enumerate(walk, 1):
                out += [n] * sum(leaf in w for w in left)
                left = [w for w in left if leaf not in w]
                if not left:
                    break
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["rank"])


def leaves_for(groups: DataFrame, forest, k: int, recall: float, measured: int = MEASURED) -> int:
    """Leaves to take so that ``recall`` of the true k neighbours of some
    queries of ``groups`` (g, h, v, asked), those with the least hashes, is met."""
    some = groups.filter("asked").orderBy(F.xxhash64("h"), "g").select("g", "v").limit(measured).toArrow()
    if not len(some):
        return 1
    spark = groups.sparkSession
    asked = spark.sparkContext.broadcast((some.column("g").to_numpy(), _unit(_matrix(some.column("v").combine_chunks()))))

    def closest(batches):
        return _closest(batches, forest, asked, k)

    def ranks(batches):
        return _ranks(batches, forest, asked)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "g")
    near = groups.select("g", "v").mapInArrow(closest, "q int, g long, score double, leaves array<long>")
    near = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    wanted = near.groupBy("q").agg(F.collect_list("leaves").alias("wanted"))  # k lists
    found = sorted(r["rank"] for r in wanted.mapInArrow(ranks, "rank long").collect())  # k numbers a measured query
    return found[max(0, math.ceil(recall * len(found)) - 1)] if found else 1


def _decoded(codes: pa.ChunkedArray, units: pa.ChunkedArray) -> np.ndarray:
    code = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    return code.astype(np.float32) * units.to_numpy().astype(np.float32)[:, None]


def _best_of_block(k: int):
    """Of a block, the candidates of each query that may be among its k best:
    those whose highest possible cosine is not below the k-th highest of the
    least possible ones. Only ``sure`` candidates, which have an id of their
    own, count for the latter."""

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        n, m = queries.num_rows, vectors.num_rows
        rows, cols, low, high = (np.empty(0, t) for t in (np.int64, np.int64, float, float))
        if n and m:
            near = (_decoded(queries.column("qcode"), queries.column("qunit")) @ _decoded(vectors.column("code"), vectors.column("unit")).T).astype(np.float64)
            a, b = queries.column("qerror").to_numpy()[:, None], vectors.column("error").to_numpy()
            slack = a + b + a * b + 1e-5
            sure = vectors.column("sure").to_numpy()
            cut = np.full(n, -np.inf)
            if sure.sum() > k:  # one of them may be the query itself
                cut = np.partition((near - slack)[:, sure], sure.sum() - k - 1, axis=1)[:, sure.sum() - k - 1]
            rows, cols = np.nonzero(near + slack >= cut[:, None])
            low, high = (near - slack)[rows, cols], (near + slack)[rows, cols]
        g, v = queries.column("qg").take(pa.array(rows)), vectors.take(pa.array(cols))
        return pa.table({"qg": g, "g": v.column("g"), "low": low, "high": high, "sure": v.column("sure")})

    return best


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that row of q (or with the one q). Vectors
    of extreme length are scaled first, so that no square overflows."""

    def tame(v: np.ndarray) -> np.ndarray:
        top = np.abs(v).max(-1, keepdims=True)
        return v / np.where((top > 1e-100) & (top < 1e100), 1.0, top)

    x, q = tame(x), tame(q)
    return (x * q).sum(-1) / (np.sqrt((x * x).sum(-1)) * np.sqrt((q * q).sum(-1)))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            scores = cosines(_matrix(part.column("v")), _matrix(part.column("qv")))
            yield pa.RecordBatch.from_arrays([part.column("qg"), part.column("ids"), pa.array(scores)], names=["qg", "ids", "score"])


def _groups(base: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (g, v, ids: the k + 1 smallest, asked, sure: the
    smallest id stands with no other vector), and the queries (qid, qg). A
    vector is known by 128 bits of two hashes until it has its number g."""
    base = base.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    members = base.groupBy("h", "id").agg(F.bool_or("q").alias("q"))
    order = Window.partitionBy("h").orderBy("id")
    few = members.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    whole = base.groupBy("h").agg(F.first("v").alias("v"), F.bool_or("q").alias("asked"))
    groups = whole.join(few, "h").select(F.monotonically_increasing_id().alias("g"), "h", "v", "ids", "asked")
    several = written(members.groupBy("id").count().filter("count > 1").select(F.col("id").alias("several")), "nearest-several")
    if several.isEmpty():
        groups = groups.withColumn("sure", F.lit(True))
    else:
        groups = groups.join(several, F.get("ids", F.lit(0)) == F.col("several"), "left").withColumn("sure", F.col("several").isNull()).drop("several")
    groups = written(groups, "nearest-groups")
    remove(several)
    queries = members.filter("q").join(groups.filter("asked").select("h", F.col("g").alias("qg")), "h").select(F.col("id").alias("qid"), "qg")
    return groups, queries


def _blocks(coded: DataFrame, block: int, block_queries: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries by leaf and block. Leaves of more than one block are
    counted first; each block of a leaf's vectors meets each of its queries'."""
    vectors = coded.select(F.explode("leaves").alias("leaf"), "g", "sure", "code", "unit", "error")
    queries = coded.filter(F.col("probes").isNotNull()).select(F.explode("probes").alias("leaf"), *(F.col(c).alias("q" + c) for c in ("g", "code", "unit", "error")))
    both = vectors.select("leaf", F.lit(1).alias("v"), F.lit(0).alias("q")).union(queries.select("leaf", F.lit(0), F.lit(1)))
    sizes = both.groupBy("leaf").agg(F.ceil(F.sum("v") / block).cast("int").alias("nv"), F.ceil(F.sum("q") / block_queries).cast("int").alias("nq"))
    heavy = written(sizes.filter("nv > 1 OR nq > 1"), "nearest-heavy")
    n = heavy.limit(MOST_HEAVY + 1).count()
    if not n:
        return (side.withColumns({"bv": F.lit(0), "bq": F.lit(0)}) for side in (vectors, queries))
    heavy = F.broadcast(heavy) if n <= MOST_HEAVY else heavy
    one = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    own = lambda g, c: F.pmod(F.xxhash64(g), one(F.col(c))).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    vectors = vectors.join(heavy, "leaf", "left").withColumn("bv", own("g", "nv")).withColumn("bq", every("nq")).drop("nv", "nq")
    queries = queries.join(heavy, "leaf", "left").withColumn("bq", own("qg", "nq")).withColumn("bv", every("nv")).drop("nv", "nq")
    return vectors, queries


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, trees: int = TREES, leaf: int = LEAF, leaves: int | None = None, recall: float = RECALL, block: int = BLOCK, block_queries: int = BLOCK_QUERIES, top: int = TOP) -> DataFrame:
    """Returns (query_id, rank, vec_id, score): the k nearest found of each row
    where ``is_query`` holds, by cosine in double precision, ties to the
    smaller id; all candidates if there are fewer and the leaves searched hold
    them. ``leaves`` of the forest are looked into; without it as many as are
    measured to hold ``recall`` of the true neighbours. If the forest has no
    more leaves, the result is exact.

    Vectors that are null, empty or zero or hold a null or a non-finite
    component take no part, nor do rows with a null id, nor, where lengths
    differ, vectors of another length than the most frequent one (the longest
    of these). A query's own id is no candidate, repeated rows of it included.
    An id with several vectors counts once, with its best score, as a candidate
    and as a query. Other columns are not read. An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    id_type = vectors.schema[id_col].dataType.simpleString()
    base = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    d = lengths[0]["d"]
    groups, queries = _groups(base.filter(F.size("v") == d), k)
    n = groups.count()
    most = int(min(SAMPLE, max(1000, SAMPLE_BYTES // (8 * d))))
    drawn = groups if n <= most else groups.filter(below(F.xxhash64("h"), share_of(most, n)))
    rows = drawn.orderBy("h").select("v").limit(most).toArrow().column("v").combine_chunks()
    sample = _unit(_matrix(rows)) if len(rows) else np.eye(1, d)
    leaf = min(leaf, max(64, n // LEAST_LEAVES))
    depth = max(0, round(np.log2(max(1, n) / leaf)))
    shared = spark.sparkContext.broadcast(grow(sample, trees, depth, top))
    leaves = leaves or leaves_for(groups, shared, k, recall)

    def code(batches):
        return _code(batches, shared, leaves)

    coded = groups.select("g", "v", "asked", "sure").mapInArrow(code, "g long, sure boolean, code binary, unit double, error double, leaves array<long>, probes array<long>")
    coded = written(coded, "nearest-coded")
    standing, asking = _blocks(coded, block, block_queries)
    keys = ["leaf", "bv", "bq"]
    met = asking.groupBy(*keys).cogroup(standing.groupBy(*keys)).applyInArrow(_best_of_block(k), "qg long, g long, low double, high double, sure boolean")
    met = met.filter("qg != g").groupBy("qg", "g").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("sure").alias("sure"))
    each = Window.partitionBy("qg")
    met = met.withColumn("n", F.row_number().over(each.orderBy(F.desc("sure"), F.desc("low"))))
    met = met.withColumn("cut", F.max(F.when((F.col("n") == k) & F.col("sure"), F.col("low"))).over(each)).filter("cut IS NULL OR high >= cut")
    own = groups.filter("asked").select(F.col("g").alias("qg"), "g")
    pairs = met.select("qg", "g").union(own)  # others may have the query's very vector
    theirs = groups.select("g", "v", "ids")
    asked = groups.filter("asked").select(F.col("g").alias("qg"), F.col("v").alias("qv"))
    scored = pairs.join(theirs, "g").join(asked, "qg").select("qg", "ids", "v", "qv").mapInArrow(_score, f"qg long, ids array<{id_type}>, score double")
    scored = scored.select("qg", F.explode("ids").alias("id"), "score").groupBy("qg", "id").agg(F.max("score").alias("score"))
    best = Window.orderBy(F.desc("score"), "id")
    # one more than k, as one of them may be the query
    scored = scored.withColumn("n", F.row_number().over(best.partitionBy("qg"))).filter(F.col("n") <= k + 1).drop("n")
    out = queries.join(scored, "qg").filter("qid != id").groupBy("qid", "id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(best.partitionBy("qid"))).filter(F.col("rank") <= k)
    return out.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")

"""Density clusters of points in up to three dimensions, without a row for each
pair of neighbours.

Space is cut into cells so narrow that all points of a cell are neighbours, which
is checked by the cell's bounds. A cell of enough points is dense: all of them are
core points of one cluster, and nothing is counted in it. Points of other cells
are counted against the cells around them, and cells are linked by the first
pair of core points that is close enough. Cells are sent in units of bounded
size to those around them, at most 5 to the power of the dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import cut

#: Dimensions at most; points of a unit, about; rows of a distance matrix.
DIMENSIONS, UNIT, ROWS = 3, 2048, 256


def _cells(points: DataFrame, features: Sequence[str], eps: float) -> DataFrame:
    """(id, v, cell) of the points that have all features."""
    width = eps / len(features) ** 0.5 * (1 - 1e-9)
    values = [F.col(f).cast("double") for f in features]
    fine = points.select("id", F.array(*values).alias("v")).filter(F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    return fine.withColumn("cell", F.transform("v", lambda x: F.floor(x / width)))


def _dense(rows: DataFrame, d: int, eps: float, n_core: int) -> DataFrame:
    """(cell, n, dense, node): are there n_core points at least, and all neighbours? node: the least id."""
    ends = [f(F.get("v", F.lit(k))).alias(f"{name}{k}") for k in range(d) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    across = sum(((F.col(f"hi{k}") - F.col(f"lo{k}")) * (F.col(f"hi{k}") - F.col(f"lo{k}")) for k in range(d)), F.lit(0.0))
    found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("node"), *ends)
    return found.select("cell", "n", ((F.col("n") >= n_core) & (across <= eps * eps)).alias("dense"), "node")


def _units(rows: DataFrame, *columns: str) -> DataFrame:
    """(cell, unit, id, v, columns): points with their cell's n, packed; all but cell and unit are arrays, v is flat."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / UNIT)).cast("int")
    packed = rows.groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("id", "v", *columns)).alias("p"))
    return packed.select("cell", F.concat_ws("/", F.concat_ws(",", "cell"), "part").alias("unit"), F.flatten("p.v").alias("v"), *(F.col(f"p.{c}").alias(c) for c in ("id", *columns)))


def _around(left: DataFrame, right: DataFrame, d: int, once: bool = False) -> DataFrame:
    """Each left unit with all right ones around it (columns b_...), or with ``once`` those that come not before it."""
    moves = F.array(*(F.array(*map(F.lit, m)) for m in product((-2, -1, 0, 1, 2), repeat=d)))
    near = left.select("unit", F.explode(F.transform(moves, lambda m: F.zip_with("cell", m, lambda c, x: c + x))).alias("cell"))
    pairs = near.join(right.select("cell", F.col("unit").alias("b_unit")), "cell").select("unit", "b_unit")
    if once:
        pairs = pairs.filter("unit <= b_unit")
    other = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns if c != "cell"))
    return left.drop("cell").join(pairs, "unit").join(other, "b_unit")


def _close(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        e = x[:, k, None] - y[:, k]
        d += e * e
    return d <= most


def _each(rows: DataFrame, d: int, out: Callable, schema: str) -> DataFrame:
    """out(row, x, y) of each pair of units; yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                x, y = (row[c].values.to_numpy(zero_copy_only=False).reshape(-1, d) for c in ("v", "b_v"))
                yield from out(row, x, y)

    return rows.mapInArrow(run, schema)


def _counted(most: float) -> Callable:
    def out(row, x, y):
        n = np.zeros(len(x), np.int64)
        same = row["unit"].as_py() == row["b_unit"].as_py()
        for a in range(0, len(x), ROWS):
            hit = _close(x[a : a + ROWS], y, most)
            if same:  # the same points, maybe in another order
                own = row["b_id"].values.to_pylist()
                at = {v: k for k, v in enumerate(own)}
                ids = row["id"].values.slice(a, ROWS).to_pylist()
                hit[np.arange(len(hit)), [at[i] for i in ids]] = False
            n[a : a + ROWS] = hit.sum(1)
        yield pa.RecordBatch.from_arrays([row["id"].values, pa.array(n)], names=["id", "n"])

    return out


def _nodes(row: dict, c: str) -> tuple[pa.Array, np.ndarray]:
    """The different names of a column, and which of them each row has."""
    coded = row[c].values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _touching(most: float) -> Callable:
    """Names of core points, and so of dense cells, that are close to one another."""

    def out(row, x, y):
        (a, at), (b, bt) = _nodes(row, "node"), _nodes(row, "b_node")
        found = np.zeros((len(a), len(b)), bool)
        for k in range(0, len(x), ROWS):
            hit = _close(x[k : k + ROWS], y, most)
            if len(a) == len(b) == 1:
                if hit.any():
                    found[0, 0] = True
                    break
                continue
            i, j = np.nonzero(hit)
            found[at[k + i], bt[j]] = True
        i, j = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(j))], names=["ci", "cj"])

    return out


def _bordering(most: float) -> Callable:
    def out(row, x, y):
        b, bt = _nodes(row, "b_node")
        i, j = np.nonzero(_close(x, y, most))
        pairs = np.unique(np.stack([i, bt[j]]), axis=1)
        yield pa.RecordBatch.from_arrays([row["id"].values.take(pa.array(pairs[0])), b.take(pa.array(pairs[1]))], names=["id", "node"])

    return out


def cores(points: DataFrame, features: Sequence[str], eps: float, n_core: int) -> tuple[DataFrame, DataFrame]:
    """Core points (id, v, cell, n, node), where node is the least id of a dense
    cell and else the point's own, and the other points (id, v, cell, n)."""
    d, most = len(features), eps * eps
    kind = points.schema["id"].dataType.simpleString()
    rows = _cells(points, features, eps)
    rows = cut(rows.join(_dense(rows, d, eps, n_core), "cell"))
    thin = rows.filter("NOT dense")
    n = _each(_around(cut(_units(thin)), cut(_units(rows)), d), d, _counted(most), f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("_n"))
    judged = cut(thin.join(n, "id", "left").withColumn("core", F.coalesce("_n", F.lit(0)) + 1 >= n_core))
    columns = ["id", "v", "cell", "n"]
    inner = rows.filter("dense").select(*columns, "node").union(judged.filter("core").select(*columns, F.col("id").alias("node")))
    return cut(inner), judged.filter("NOT core").select(columns)


def links(inner: DataFrame, d: int, eps: float) -> DataFrame:
    """(ci, cj): the nodes of core points that are at most eps apart."""
    kind = inner.schema["node"].dataType.simpleString()
    units = cut(_units(inner, "node"))
    return _each(_around(units, units, d, once=True), d, _touching(eps * eps), f"ci {kind}, cj {kind}").filter("ci != cj").distinct()


def borders(inner: DataFrame, outer: DataFrame, d: int, eps: float) -> DataFrame:
    """(id, node): the nodes at most eps from each point that is no core point."""
    kind = inner.schema["node"].dataType.simpleString()
    return _each(_around(cut(_units(outer)), cut(_units(inner, "node")), d), d, _bordering(eps * eps), f"id {kind}, node {kind}")

"""All queries with a SQL twin against DuckDB, the others run."""

import glob
import math
import os

import duckdb
import pytest

from ruleloom.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the fixture tables")


def value(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    rel = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(value(r[c]) for c in columns) for r in rows), key=key)
    want = sorted((tuple(value(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=key)
    assert got == want


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_vectors_are_brute_force(spark):
    import numpy as np
    import pyarrow.dataset as ds

    t = ds.dataset(f"{DIR}/embeddings.parquet").to_table()
    ids, y, x = t["vec_id"].to_pylist(), np.array(t["label"].to_pylist()), np.array(t["embedding"].to_pylist(), float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    ranked = np.sort(d, axis=1)  # the point itself comes first
    assert {r["id"]: r["distance"] for r in QUERIES["knn_curve_whole"](spark, DIR).collect()} == pytest.approx(dict(zip(ids, ranked[:, 3], strict=True)), abs=1e-5)
    assert {r["cluster"]: r["max_intra"] for r in QUERIES["max_intra_distance_whole"](spark, DIR).collect()} == pytest.approx({k: d[np.ix_(y == k, y == k)].max() for k in set(y.tolist())}, abs=1e-5)
    core = ranked[:, 2]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    for k in range(len(ids)):
        m = np.minimum(m, np.maximum(m[:, k, None], m[None, k]))
    got = {(r["i"], r["j"]): r["d"] for r in QUERIES["density_distance"](spark, DIR).collect()}
    assert len(got) == len(ids) * (len(ids) - 1)
    assert max(abs(got[a, b] - m[p, q]) for p, a in enumerate(ids) for q, b in enumerate(ids) if p != q) < 1e-5

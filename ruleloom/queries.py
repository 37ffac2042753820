"""The library's queries over the fixture tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binning as N
from .model import Condition, Node, Rule, RuleSet, interval
from .operators import blocks as B
from .operators import clusters as C
from .operators import knn as K
from .operators import labels as L
from .operators import metrics as M
from .operators import ranking as R
from .operators import splits as S
from .operators.select import coverage_mistake_select
from .plans import experiments as X
from .plans.modules import DecisionForest, DecisionTreeMod, IMMBase
from .plans.mining import ClassAssociationMiner, PointwiseMiner
from .plans.sets import CBA, IDS, DSCluster, class_scores, ids_objective, ids_statistics, rule_patterns
from .plans.trees import DecisionTree, ExkmcTree, ExplanationTree, ID3Tree, ImmTree, ObliqueTree, ShallowTree, nearest_center
from .sources import datasets
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# point views and their SQL

CUST = "(SELECT c_custkey AS id, c_acctbal AS x0, CAST(c_nationkey AS DOUBLE) AS x1, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS label FROM customer)"
LINE = "(SELECT l_orderkey, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3, l_returnflag AS flag FROM lineitem)"
PART = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1, CASE WHEN p_size <= 20 THEN 0 WHEN p_size <= 40 THEN 1 ELSE 2 END AS label FROM part)"


def customers(spark, d) -> DataFrame:
    return T.points(_read(spark, d, "customer"), "c_custkey", {"x0": "c_acctbal", "x1": "c_nationkey"}, "c_mktsegment")


def parts(spark, d) -> DataFrame:
    return T.points(_read(spark, d, "part"), "p_partkey", {"x0": "p_size", "x1": "p_retailprice"}, "CASE WHEN p_size <= 20 THEN 0 WHEN p_size <= 40 THEN 1 ELSE 2 END")


def embedded(spark, d) -> DataFrame:
    return T.points(_read(spark, d, "embeddings"), "vec_id", {f"x{k}": f"embedding[{k}]" for k in range(4)}, "label")


def embedded_whole(spark, d) -> DataFrame:
    """All components, which the SQL twins' views have the first few of."""
    return T.points(_read(spark, d, "embeddings"), "vec_id", {f"x{k}": f"embedding[{k}]" for k in range(64)}, "label")


def _rule(label: int, **bounds: tuple[float | None, float | None]) -> Rule:
    """Bounds (lower, upper] of each feature."""
    out = []
    for f, (a, z) in bounds.items():
        out += [Condition.axis(f, a, 1)] if a is not None else []
        out += [Condition.axis(f, z, -1)] if z is not None else []
    return Rule(tuple(out), label)


RULES = RuleSet((_rule(0, x0=(2000.0, None), x1=(None, 12.0)), _rule(1, x0=(None, 4000.0)), _rule(2, x1=(5.0, 20.0), x0=(0.0, 8000.0)), _rule(3, x0=(9900.0, None), x1=(24.0, None))))
#: data_rule of RULES, in SQL.
HITS = f"(SELECT id, r AS rule_id FROM {CUST} p, (VALUES (0), (1), (2), (3)) v(r) WHERE CASE r " + " ".join(f"WHEN {i} THEN {r.sql()}" for i, r in enumerate(RULES)) + " END)"
CLUSTERS = "(VALUES " + ", ".join(f"({i}, {r.label}, {len(r.conditions)})" for i, r in enumerate(RULES)) + ") rc(rule_id, cluster, length)"
TRUTH = f"(SELECT id, label AS cluster FROM {CUST})"


def _hits(spark, d):
    p = customers(spark, d)
    return p, L.data_to_rules(p, RULES), L.rules_to_clusters(spark, RULES), p.select("id", F.col("label").alias("cluster"))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# conditions and rules


@query("rule_filter", f"SELECT l_orderkey, x0, x1 FROM {LINE} WHERE x0 > 20 AND x0 <= 30 AND x2 <= 0.05")
def rule_filter(spark, d):
    rule = _rule(0, x0=(20.0, 30.0), x2=(None, 0.05))
    p = _read(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("x1"), F.col("l_discount").alias("x2"))
    return p.filter(rule.column()).select("l_orderkey", "x0", "x1")


@query("oblique_filter", f"SELECT l_orderkey, x0, x1 FROM {LINE} WHERE -1000.0 * x0 + 1.0 * x1 > 5000.0")
def oblique_filter(spark, d):
    p = _read(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("x1"))
    return p.filter(Condition(("x0", "x1"), (-1000.0, 1.0), 5000.0, 1).column())


@query("interval_rule", f"SELECT count(*) AS n, sum(x1) AS s FROM {CUST} WHERE x0 > 100.5 AND x0 <= 2000")
def interval_rule(spark, d):
    keep = Rule(tuple(interval("x0", "(100.5, 2000]")), 0)
    return customers(spark, d).filter(keep.column()).agg(F.count("*").alias("n"), F.sum("x1").alias("s"))


@query("trim_rules", f"SELECT id FROM {CUST} WHERE x0 <= 500")
def trim_rules(spark, d):
    rules = RuleSet((_rule(0, x0=(float("-inf"), 500.0)), _rule(1, x0=(float("-inf"), float("inf"))))).trimmed()
    return L.data_to_rules(customers(spark, d), rules).select("id")


# labels and assignments


@query("data_to_rules", f"SELECT id, rule_id FROM {HITS}")
def data_to_rules(spark, d):
    return _hits(spark, d)[1]


@query("predict_labels", f"SELECT p.id, coalesce(s.labels, '-1') AS labels FROM {CUST} p LEFT JOIN (SELECT id, string_agg(DISTINCT cluster::VARCHAR, ',' ORDER BY cluster::VARCHAR) AS labels FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id) s USING (id)")
def predict_labels(spark, d):
    return L.predict(customers(spark, d), RULES).select("id", F.array_join("labels", ",").alias("labels"))


@query("rule_cluster_product", f"SELECT DISTINCT id, cluster FROM {HITS} JOIN {CLUSTERS} USING (rule_id)")
def rule_cluster_product(spark, d):
    _, hits, rc, _ = _hits(spark, d)
    return L.data_to_clusters(hits, rc)


@query("labels_round_trip", f"SELECT p.id, coalesce(s.n, 0) AS n FROM {CUST} p LEFT JOIN (SELECT id, count(DISTINCT cluster) AS n FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id) s USING (id)")
def labels_round_trip(spark, d):
    p, hits, rc, _ = _hits(spark, d)
    sets = L.assignment_to_labels(p, L.data_to_clusters(hits, rc))
    again = L.assignment_to_labels(p, L.labels_to_assignment(sets))
    return again.select("id", F.size("labels").cast("long").alias("n"))


@query("unique_labels", f"SELECT DISTINCT label FROM {CUST} WHERE label <> 1")
def unique_labels(spark, d):
    return L.unique_labels(customers(spark, d).select("id", L.labels_format("label").alias("labels")), ignore=[1])


@query("label_members", f"SELECT cluster, count(*) AS n FROM {TRUTH} GROUP BY 1")
def label_members(spark, d):
    p = customers(spark, d).select("id", F.col("label").alias("cluster"))
    return L.assignment_to_members(p).groupBy("cluster").agg(F.sum(F.bitmap_count("members")).alias("n"))


@query("update_centers", "SELECT label AS cluster, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1 FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings) GROUP BY 1 UNION ALL SELECT 99, 7.0, 8.0")
def update_centers(spark, d):
    p = embedded(spark, d)
    old = p.select(F.col("label").alias("cluster")).distinct().select("cluster", F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1")).union(spark.createDataFrame([(99, 7.0, 8.0)], "cluster int, x0 double, x1 double"))
    return _rounded(L.update_centers(p.select("id", "x0", "x1"), ["x0", "x1"], old, p.select("id", F.col("label").alias("cluster"))), "x0", "x1")


# measures


@query("label_mode", "SELECT c_nationkey, min(c_mktsegment) AS mode FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, max(count(*)) OVER (PARTITION BY c_nationkey) AS m FROM customer GROUP BY 1, 2) WHERE n = m GROUP BY 1")
def label_mode(spark, d):
    return M.mode(_read(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("entropy_by_group", "SELECT c_nationkey, round(entropy(c_mktsegment), 6) AS entropy FROM customer GROUP BY 1")
def entropy_by_group(spark, d):
    return _rounded(M.entropy(_read(spark, d, "customer"), ["c_nationkey"], "c_mktsegment"), "entropy")


@query("coverage", f"SELECT round(count(DISTINCT id) / (SELECT count(*) FROM customer), 6) AS coverage FROM {HITS}")
def coverage(spark, d):
    p, hits, _, _ = _hits(spark, d)
    return _rounded(M.coverage(hits, p.count()), "coverage")


@query("overlap", f"SELECT round(avg(n), 6) AS overlap FROM (SELECT id, count(DISTINCT cluster) AS n FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id)")
def overlap(spark, d):
    _, hits, rc, _ = _hits(spark, d)
    return _rounded(M.overlap(L.data_to_clusters(hits, rc)), "overlap")


@query("mistakes", f"SELECT count(*) AS mistakes FROM {HITS} h JOIN {CLUSTERS} USING (rule_id) JOIN {CUST} p USING (id) WHERE p.label <> rc.cluster")
def mistakes(spark, d):
    _, hits, rc, dc = _hits(spark, d)
    return M.mistakes(dc, hits, rc)


MIST = f"(SELECT (SELECT count(DISTINCT id) FROM {HITS}) AS covered, (SELECT count(*) FROM {HITS} h JOIN {CLUSTERS} USING (rule_id) JOIN {CUST} p USING (id) WHERE p.label <> rc.cluster) AS mistakes, (SELECT count(*) FROM customer) AS n)"


@query("coverage_mistake", f"SELECT covered, mistakes, covered - 0.5::DOUBLE * mistakes AS coverage_mistake_score, n - covered + mistakes AS uncovered_mistake_score FROM {MIST}")
def coverage_mistake(spark, d):
    p, hits, rc, dc = _hits(spark, d)
    return M.coverage_mistake(dc, hits, rc, p.count(), 0.5)


@query("weighted_rule_length", f"SELECT round(avg(length), 6) AS weighted_rule_length FROM {HITS} JOIN {CLUSTERS} USING (rule_id)")
def weighted_rule_length(spark, d):
    _, hits, rc, _ = _hits(spark, d)
    return _rounded(M.rule_length(hits, rc), "weighted_rule_length")


CENTERS = [[0.0, 3.0], [4000.0, 12.0], [8000.0, 20.0]]
DIST = f"(SELECT id, label, c AS cluster, sqrt((x0 - a) ** 2 + (x1 - b) ** 2) AS dist FROM {CUST}, (VALUES (0, 0.0::DOUBLE, 3.0::DOUBLE), (1, 4000.0, 12.0), (2, 8000.0, 20.0)) v(c, a, b))"


@query("center_dists", f"SELECT id, cluster, round(dist, 6) AS dist FROM {DIST}")
def center_dists(spark, d):
    return _rounded(M.center_dists(customers(spark, d), ["x0", "x1"], CENTERS), "dist")


@query("distance_ratio", f"SELECT id, round(list_sort(list(dist))[2] / list_sort(list(dist))[1], 6) AS ratio FROM {DIST} GROUP BY id")
def distance_ratio(spark, d):
    return _rounded(M.distance_ratio(customers(spark, d), ["x0", "x1"], CENTERS), "ratio")


@query("kmeans_cost", f"SELECT round(sum(dist * dist) / count(DISTINCT id), 3) AS cost FROM {DIST} WHERE cluster = label")
def kmeans_cost(spark, d):
    centers = spark.createDataFrame([(k, *c) for k, c in enumerate(CENTERS)], "cluster int, x0 double, x1 double")
    p = customers(spark, d)
    return _rounded(M.kmeans_cost(p, ["x0", "x1"], centers, p.select("id", F.col("label").alias("cluster")), 0, normalize=True), "cost", places=3)


@query("distance_ratio_score", f"SELECT round(avg(r) / avg(r) FILTER (WHERE coalesce(n, 0) <> 1), 6) AS distance_ratio FROM (SELECT id, list_sort(list(dist))[2] / list_sort(list(dist))[1] AS r FROM {DIST} GROUP BY id) LEFT JOIN (SELECT id, count(DISTINCT cluster) AS n FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id) USING (id)")
def distance_ratio_score(spark, d):
    p, hits, rc, _ = _hits(spark, d)
    return _rounded(M.distance_ratio_score(M.distance_ratio(p, ["x0", "x1"], CENTERS), L.data_to_clusters(hits, rc)), "distance_ratio")


@query("label_differences", f"SELECT round(avg((p.label <> coalesce(t.c, -1) OR t.n > 1)::INT), 6) AS label_differences FROM {CUST} p LEFT JOIN (SELECT id, min(cluster) AS c, count(DISTINCT cluster) AS n FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id) t USING (id)")
def label_differences(spark, d):
    p = customers(spark, d)
    truth = p.select("id", L.labels_format("label").alias("labels"))
    return _rounded(M.label_differences(truth, L.predict(p, RULES)), "label_differences")


@query("clustering_distance", f"WITH l AS (SELECT p.id, p.label AS a, coalesce(s.m, 0) AS b FROM {CUST} p LEFT JOIN (SELECT id, bit_or(1 << cluster) AS m FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id) s USING (id)) SELECT round(avg(((x.a = y.a) <> ((x.b & y.b) <> 0))::INT), 6) AS clustering_distance FROM l x JOIN l y ON x.id < y.id")
def clustering_distance(spark, d):
    p = customers(spark, d)
    truth = p.select("id", L.labels_format("label").alias("labels"))
    return _rounded(M.clustering_distance(truth, L.predict(p, RULES, uncovered=())), "clustering_distance")


EMB = "(SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS x3 FROM embeddings)"
EDIST = f"(SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 + (a.x3 - b.x3) ** 2) AS d FROM {EMB} a JOIN {EMB} b ON a.id <> b.id)"
E4 = [f"x{k}" for k in range(4)]


def _eclusters(spark, d):
    p = embedded(spark, d)
    return p, E4, p.select("id", F.col("label").alias("cluster"))


@query("silhouette", f"WITH m AS (SELECT i, li, lj, avg(d) AS d FROM {EDIST} GROUP BY 1, 2, 3), s AS (SELECT i, coalesce(max(d) FILTER (WHERE li = lj), 0) AS a, min(d) FILTER (WHERE li <> lj) AS b FROM m GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s")
def silhouette(spark, d):
    return _rounded(B.silhouette(*_eclusters(spark, d)), "silhouette")


#: Each vector in the cluster of its label, and every third one in the next cluster too.
_OVER = f"(SELECT id, label AS c FROM {EMB} UNION ALL SELECT id, (label + 1) % 10 FROM {EMB} WHERE id % 3 = 0)"


@query("silhouette_overlap", f"WITH o AS {_OVER}, m AS (SELECT i, c, avg(d) AS d FROM {EDIST} JOIN o ON j = o.id GROUP BY 1, 2), s AS (SELECT o.id, o.c, coalesce(max(d) FILTER (WHERE m.c = o.c), 0) AS a, min(d) FILTER (WHERE m.c <> o.c) AS b FROM o JOIN m ON m.i = o.id GROUP BY 1, 2), p AS (SELECT id, sum((b - a) / greatest(a, b)) / count(*) AS s FROM s GROUP BY 1) SELECT round(avg(s), 6) AS silhouette FROM p")
def silhouette_overlap(spark, d):
    p, features, dc = _eclusters(spark, d)
    more = dc.filter("id % 3 = 0").select("id", ((F.col("cluster") + 1) % 10).cast("int").alias("cluster"))
    return _rounded(B.silhouette(p, features, dc.union(more)), "silhouette")


@query("max_intra_distance", f"SELECT li AS cluster, round(max(d), 6) AS max_intra FROM {EDIST} WHERE li = lj GROUP BY 1")
def max_intra(spark, d):
    return _rounded(B.max_intra(*_eclusters(spark, d)), "max_intra")


@query("min_inter_distance", f"SELECT li AS ci, lj AS cj, round(min(d), 6) AS min_inter FROM {EDIST} WHERE li < lj GROUP BY 1, 2")
def min_inter(spark, d):
    return _rounded(B.min_inter(*_eclusters(spark, d)), "min_inter")


@query("mutual_reachability", f"WITH e AS {EDIST}, c AS (SELECT i, d AS c FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM e) WHERE r = 4) SELECT e.i, round(min(greatest(e.d, a.c, b.c)), 6) AS least, round(avg(greatest(e.d, a.c, b.c)), 6) AS mean FROM e JOIN c a ON a.i = e.i JOIN c b ON b.i = e.j GROUP BY 1")
def mutual_reachability(spark, d):
    p = embedded(spark, d)
    return _rounded(B.reachability(p, E4, K.core_distances(p, E4, 5)), "least", "mean")


@query("knn_curve", f"SELECT i AS id, round(d, 6) AS distance FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM {EDIST}) WHERE r = 3")
def knn_curve(spark, d):
    return _rounded(K.core_distances(embedded(spark, d), E4, 4).select(F.col("i").alias("id"), F.col("core").alias("distance")), "distance")


@query("pairs_within", f"SELECT bool_and(d <= 0.5) AS within FROM {EDIST} WHERE li = 1 AND lj = 1")
def pairs_within(spark, d):
    p, features, dc = _eclusters(spark, d)
    return B.within_threshold(p, features, dc.filter("cluster = 1"), 0.5)


@query("density_distance")
def density_distance(spark, d):
    return _rounded(B.density_distance(embedded_whole(spark, d), E64, 3), "d")


# the same over whole vectors

E64 = [f"x{k}" for k in range(64)]


def _eclusters_whole(spark, d):
    p = embedded_whole(spark, d)
    return p, E64, p.select("id", F.col("label").alias("cluster"))


@query("silhouette_whole")
def silhouette_whole(spark, d):
    return _rounded(B.silhouette(*_eclusters_whole(spark, d)), "silhouette")


@query("max_intra_distance_whole")
def max_intra_whole(spark, d):
    return _rounded(B.max_intra(*_eclusters_whole(spark, d)), "max_intra")


@query("min_inter_distance_whole")
def min_inter_whole(spark, d):
    return _rounded(B.min_inter(*_eclusters_whole(spark, d)), "min_inter")


@query("mutual_reachability_whole")
def mutual_reachability_whole(spark, d):
    p = embedded_whole(spark, d)
    return _rounded(B.reachability(p, E64, K.core_distances(p, E64, 5)), "least", "mean")


@query("knn_curve_whole")
def knn_curve_whole(spark, d):
    return _rounded(K.core_distances(embedded_whole(spark, d), E64, 4).select(F.col("i").alias("id"), F.col("core").alias("distance")), "distance")


@query("knn_join", f"SELECT i, r, round(d, 6) AS d FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM (SELECT a.id AS i, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS d FROM {PART} a JOIN {PART} b ON a.id <> b.id)) WHERE r <= 3")
def knn_join(spark, d):
    """The three nearest parts of each part, without a table of all pairs."""
    return _rounded(K.knn_join(parts(spark, d), ["x0", "x1"], 3).select("i", F.col("r").cast("long").alias("r"), "d"), "d")


@query("pairs_within_whole")
def pairs_within_whole(spark, d):
    p, features, dc = _eclusters_whole(spark, d)
    return B.within_threshold(p, features, dc.filter("cluster = 1"), 0.5)


@query("update_centers_whole")
def update_centers_whole(spark, d):
    p = embedded_whole(spark, d)
    old = p.select(F.col("label").alias("cluster")).distinct().select("cluster", *(F.lit(0.0).alias(x) for x in E64))
    return _rounded(L.update_centers(p.select("id", *E64), E64, old, p.select("id", F.col("label").alias("cluster"))), *E64)


# scaling and binning


@query("standard_scale", f"SELECT id, round((x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER (), 6) AS x0, round((x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER (), 6) AS x1 FROM {CUST}")
def standard_scale(spark, d):
    return _rounded(T.standard_scaled(customers(spark, d), ["x0", "x1"])[0].select("id", "x0", "x1"), "x0", "x1")


@query("minmax_scale", f"SELECT id, round((x0 - min(x0) OVER ()) / (max(x0) OVER () - min(x0) OVER ()), 6) AS x0 FROM {CUST}")
def minmax_scale(spark, d):
    return _rounded(T.minmax_scaled(customers(spark, d), ["x0"])[0].select("id", "x0"), "x0")


@query("quantile_bins", f"SELECT bin, count(*) AS n FROM (SELECT (x0 > q[2])::INT + (x0 > q[3])::INT + (x0 > q[4])::INT AS bin FROM {CUST}, (SELECT quantile_cont(x0, [0, 0.25, 0.5, 0.75, 1]) AS q FROM {CUST})) GROUP BY 1")
def quantile_bins(spark, d):
    p = customers(spark, d)
    cuts = N.quantile_cuts(p, ["x0"], 4)["x0"]
    return p.groupBy(N.inner_bin(F.col("x0"), cuts).alias("bin")).agg(F.count("*").alias("n"))


@query("uniform_bins", f"SELECT bin, count(*) AS n FROM (SELECT (x0 > a + (z - a) * 1 / 4)::INT + (x0 > a + (z - a) * 2 / 4)::INT + (x0 > a + (z - a) * 3 / 4)::INT AS bin FROM {CUST}, (SELECT min(x0) AS a, max(x0) AS z FROM {CUST})) GROUP BY 1")
def uniform_bins(spark, d):
    p = customers(spark, d)
    cuts = N.uniform_cuts(p, ["x0"], 4)["x0"]
    return p.groupBy(N.inner_bin(F.col("x0"), cuts).alias("bin")).agg(F.count("*").alias("n"))


@query("entropy_bins")
def entropy_bins(spark, d):
    cuts = N.entropy_cuts(parts(spark, d), ["x0", "x1"], "label")
    return spark.createDataFrame([(f, c) for f, cs in cuts.items() for c in cs], "feature string, cut double")


@query("period_change", "SELECT o_orderpriority, round((avg(o_totalprice) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1998) - avg(o_totalprice) FILTER (WHERE year(o_orderdate) BETWEEN 1992 AND 1995)) / avg(o_totalprice) FILTER (WHERE year(o_orderdate) BETWEEN 1992 AND 1995), 6) AS o_totalprice FROM orders GROUP BY 1")
def period_change(spark, d):
    o = _read(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return _rounded(T.period_change(o, "o_orderpriority", "y", ["o_totalprice"], (1992, 1995), (1996, 1998)), "o_totalprice")


@query("factorize", f"SELECT label, count(*) AS n FROM {CUST} GROUP BY 1")
def factorize(spark, d):
    return customers(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("exactly_one", "SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN max(s_name) END AS s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def exactly_one(spark, d):
    s = _read(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return T.exactly_one(s, _read(spark, d, "nation").select("n_nationkey"), "n_nationkey", "s_name")


# splits and trees

_N = "(SELECT count(*) FROM part)"
#: Candidates of PART with the counts of labels 0, 1, 2 at most (l) and in all (t).
CAND = f"""(SELECT f AS feature, v AS threshold, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c2) OVER w AS l2, sum(c0) OVER a AS t0, sum(c1) OVER a AS t1, sum(c2) OVER a AS t2
 FROM (SELECT f, v, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1, count(*) FILTER (WHERE label = 2) AS c2
       FROM (SELECT label, 0 AS f, x0 AS v FROM {PART} UNION ALL SELECT label, 1, x1 FROM {PART}) GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY f))"""


def _h(*c: str) -> str:
    n = "(" + " + ".join(c) + ")"
    return "(" + " + ".join(f"CASE WHEN {x} > 0 THEN -{x} * log2({x} / greatest({n}, 1)) ELSE 0 END" for x in c) + ")"


@query("best_split_gain", f"SELECT feature, threshold, gain FROM (SELECT feature, threshold, round(({_h('t0', 't1', 't2')} - {_h('l0', 'l1', 'l2')} - {_h('(t0 - l0)', '(t1 - l1)', '(t2 - l2)')}) / {_N}, 9) AS gain FROM {CAND} WHERE l0 + l1 + l2 < t0 + t1 + t2) ORDER BY gain DESC, feature, threshold LIMIT 1")
def best_split_gain(spark, d):
    p = parts(spark, d)
    best = S.best_splits(S.candidates(p, S.axes(["x0", "x1"]), [0, 1, 2]), S.information_gain(p.count()))
    return _rounded(best.select("feature", "threshold", "gain"), "gain", places=9)


@query("best_split_outliers", f"SELECT feature, threshold, (-least(l0, t0 - l0) - least(l1, t1 - l1) - least(l2, t2 - l2))::DOUBLE AS gain FROM {CAND} WHERE l0 + l1 + l2 < t0 + t1 + t2 AND (2 * l0 >= t0)::INT + (2 * l1 >= t1)::INT + (2 * l2 >= t2)::INT BETWEEN 1 AND 2 ORDER BY gain DESC, feature, threshold LIMIT 1")
def best_split_outliers(spark, d):
    best = S.best_splits(S.candidates(parts(spark, d), S.axes(["x0", "x1"]), [0, 1, 2]), S.outlier_gain())
    return best.select("feature", "threshold", "gain")


IMM_CENTERS = [[10.0, 1100.0], [25.0, 1400.0], [40.0, 1700.0]]
_NEAR = "list_position([(x0 - 10) ** 2 + (x1 - 1100) ** 2, (x0 - 25) ** 2 + (x1 - 1400) ** 2, (x0 - 40) ** 2 + (x1 - 1700) ** 2], list_min([(x0 - 10) ** 2 + (x1 - 1100) ** 2, (x0 - 25) ** 2 + (x1 - 1400) ** 2, (x0 - 40) ** 2 + (x1 - 1700) ** 2])) - 1"


@query("nearest_center", f"SELECT id, CAST({_NEAR} AS INT) AS label FROM {PART}")
def nearest(spark, d):
    return nearest_center(parts(spark, d), ["x0", "x1"], IMM_CENTERS).select("id", "label")


def _tree_rows(spark, root: Node) -> DataFrame:
    return spark.createDataFrame([(i, r.label, r.sql()) for i, r in enumerate(root.rules())], "leaf int, label int, rule string")


@query("tree_predict", f"SELECT id, CASE WHEN x0 <= 15 THEN CASE WHEN x1 <= 1200 THEN 0 ELSE 1 END ELSE CASE WHEN x1 <= 1500 THEN 2 ELSE 0 END END AS label FROM {PART}")
def tree_predict(spark, d):
    leaf = lambda i, y: Node(i, y, 2)
    root = Node(0, condition=Condition.axis("x0", 15.0), left=Node(1, condition=Condition.axis("x1", 1200.0), left=leaf(2, 0), right=leaf(3, 1)), right=Node(4, condition=Condition.axis("x1", 1500.0), left=leaf(5, 2), right=leaf(6, 0)))
    return L.predict_tree(parts(spark, d), root).select("id", F.get("labels", F.lit(0)).alias("label"))


@query("id3_tree", f"SELECT id, CASE WHEN x0 <= 20 THEN 0 WHEN x0 <= 40 THEN 1 ELSE 2 END AS label FROM {PART}")
def id3_tree(spark, d):
    p = parts(spark, d)
    return ID3Tree(["x0", "x1"], max_leaf_nodes=3).fit(p).predict(p).select("id", F.get("labels", F.lit(0)).alias("label"))


@query("cart_tree")
def cart_tree(spark, d):
    return _tree_rows(spark, DecisionTree(["x0", "x1"], max_leaf_nodes=6, criterion="gini").fit(customers(spark, d)).root)


@query("oblique_tree")
def oblique_tree(spark, d):
    return _tree_rows(spark, ObliqueTree(["x0", "x1"], max_leaf_nodes=4).fit(customers(spark, d)).root)


@query("explanation_tree", f"SELECT id, CASE WHEN x0 <= 20 THEN 0 WHEN x0 <= 40 THEN 1 ELSE 2 END AS label FROM {PART}")
def explanation_tree(spark, d):
    p = parts(spark, d)
    return ExplanationTree(["x0", "x1"], num_clusters=3).fit(p).predict(p, remove_outliers=True).select("id", F.get("labels", F.lit(0)).alias("label"))


def _pcenters():
    return [[10.0, 950.0], [25.0, 980.0], [40.0, 940.0]]


@query("imm_tree")
def imm_tree(spark, d):
    return _tree_rows(spark, ImmTree(["x0", "x1"], centers=_pcenters()).fit(parts(spark, d)).root)


@query("exkmc_tree")
def exkmc_tree(spark, d):
    return _tree_rows(spark, ExkmcTree(["x0", "x1"], centers=_pcenters(), max_leaf_nodes=6).fit(parts(spark, d)).root)


@query("shallow_tree")
def shallow_tree(spark, d):
    return _tree_rows(spark, ShallowTree(["x0", "x1"], centers=_pcenters()).fit(parts(spark, d)).root)


@query("weighted_depth", f"SELECT round(avg(CASE WHEN x0 <= 20 THEN 1 ELSE 2 END), 6) AS weighted_depth FROM {PART}")
def weighted_depth(spark, d):
    p = parts(spark, d)
    return _rounded(ID3Tree(["x0", "x1"], max_leaf_nodes=3).fit(p).weighted_depth(p), "weighted_depth")


# selection, mining, decision sets

def _greedy_sql(n: int, lam: float) -> str:
    """One stage for each step: the rule with the best score joins those chosen."""
    steps = [f"h AS (SELECT id, rule_id, cluster, cluster = label AS ok FROM {HITS} JOIN {CLUSTERS} USING (rule_id) JOIN {CUST} USING (id)), bad AS (SELECT rule_id, count(*) FILTER (WHERE NOT ok) AS c FROM h GROUP BY 1), s0 AS (SELECT NULL::INT AS rule_id WHERE false)"]
    for i in range(n):
        gain = f"(SELECT rule_id, count(*) AS g FROM h WHERE ok AND NOT EXISTS (SELECT 1 FROM h x JOIN s{i} USING (rule_id) WHERE x.ok AND x.id = h.id AND x.cluster = h.cluster) GROUP BY 1)"
        score = f"power({1 - 1 / n}::DOUBLE, {n - i - 1}) * coalesce(g, 0) - {lam}::DOUBLE * c"
        steps.append(f"s{i + 1} AS (SELECT rule_id FROM s{i} UNION ALL (SELECT rule_id FROM bad LEFT JOIN {gain} USING (rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM s{i}) AND {score} > 0 ORDER BY {score} DESC, rule_id LIMIT 1))")
    return f"WITH {', '.join(steps)} SELECT rule_id::INT AS rule_id FROM s{n}"


@query("greedy_select", _greedy_sql(4, 0.1))
def greedy_select(spark, d):
    _, hits, rc, dc = _hits(spark, d)
    return spark.createDataFrame([(i,) for i in coverage_mistake_select(dc, rc, hits, 4, 0.1)], "rule_id int")


CUTS = {"x0": [15.0, 20.0, 40.0], "x1": [920.0, 960.0]}
_ITEMS = f"(SELECT id, label, unnest([(x0 > 15)::INT + (x0 > 20)::INT + (x0 > 40)::INT, 1000 + (x1 > 920)::INT + (x1 > 960)::INT]) AS item FROM {PART})"
_CAR1 = f"SELECT item::VARCHAR AS items, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY item) AS a FROM {_ITEMS} GROUP BY item, label"
_CAR2 = f"SELECT a.item::VARCHAR || ',' || b.item::VARCHAR AS items, a.label, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.item, b.item) AS a FROM {_ITEMS} a JOIN {_ITEMS} b ON a.id = b.id AND a.item < b.item GROUP BY a.item, b.item, a.label"


@query("car_mining", f"SELECT items, label, round(n / {_N}, 9) AS support, round(n / a, 9) AS confidence FROM ({_CAR1} UNION ALL {_CAR2}) WHERE n / {_N} >= 0.05 AND n / a >= 0.6")
def car_mining(spark, d):
    miner = ClassAssociationMiner(["x0", "x1"], min_support=0.05, min_confidence=0.6, max_length=2)
    found = miner.table(parts(spark, d), CUTS)
    return _rounded(found.select(F.array_join("items", ",").alias("items"), "label", "support", "confidence"), "support", "confidence", places=9)


def _miner() -> ClassAssociationMiner:
    return ClassAssociationMiner(["x0", "x1"], min_support=0.02, min_confidence=0.5, max_length=2, cuts=CUTS)


def _rule_rows(spark, rules: RuleSet) -> DataFrame:
    return spark.createDataFrame([(i, r.label, r.sql()) for i, r in enumerate(rules)], "rule_id int, label int, rule string")


@query("ds_cluster")
def ds_cluster(spark, d):
    return _rule_rows(spark, DSCluster(miner=_miner(), n_rules=5, lambd=0.5).fit(parts(spark, d)).rules)


@query("cba_rules")
def cba_rules(spark, d):
    return _rule_rows(spark, CBA(miner=_miner()).fit(parts(spark, d)).rules)


@query("ids_rules")
def ids_rules(spark, d):
    return _rule_rows(spark, IDS(miner=_miner()).fit(parts(spark, d)).rules)


@query("ids_objective", f"WITH h AS (SELECT * FROM {HITS} JOIN {CLUSTERS} USING (rule_id) JOIN {CUST} USING (id)) SELECT (4 - 3 + 4 * 4 - 7 + 2 * (SELECT count(*) FROM customer) * 16 - (SELECT count(*) FROM h a JOIN h b ON a.id = b.id AND a.rule_id < b.rule_id WHERE b.rule_id < 3) + 3 + (SELECT count(*) FROM customer) * 4 - (SELECT count(*) FROM h WHERE rule_id < 3 AND cluster <> label) + (SELECT count(*) FROM h WHERE rule_id < 3 AND cluster = label))::DOUBLE AS objective")
def ids_terms(spark, d):
    stats = ids_statistics(customers(spark, d), RULES)
    return spark.createDataFrame([(float(ids_objective(stats, {0, 1, 2}, (1.0,) * 7)),)], "objective double")


@query("rule_auc", f"""WITH hit AS (SELECT id, rule_id, cluster, label FROM {HITS} JOIN {CLUSTERS} USING (rule_id) JOIN {CUST} USING (id)),
conf AS (SELECT rule_id, avg((cluster = label)::INT) AS c FROM hit GROUP BY 1),
scored AS (SELECT p.id, k.class, (p.label = k.class) AS pos, coalesce(max(c), 0) AS score FROM {CUST} p CROSS JOIN (SELECT DISTINCT label AS class FROM {CUST}) k LEFT JOIN (hit JOIN conf USING (rule_id)) h ON h.id = p.id AND h.cluster = k.class GROUP BY ALL),
ranked AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS r FROM scored)
SELECT class, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auc FROM ranked GROUP BY 1""")
def rule_auc(spark, d):
    p = customers(spark, d)
    return _rounded(M.auc(class_scores(rule_patterns(p, RULES), ids_statistics(p, RULES), range(len(RULES)))), "auc", places=9)


@query("ids_weights")
def ids_weights_found(spark, d):
    """The weights of IDS that are found by coordinate ascent, and their AUC."""
    model = IDS(given=RULES, lambdas=None, ranges=[(0.0, 10.0)] * 7, precision=4.0, max_iterations=1).fit(customers(spark, d))
    return spark.createDataFrame([(k, float(w), float(model.auc)) for k, w in enumerate(model.weights)], "term int, weight double, auc double")


@query("pointwise_rules")
def pointwise_rules(spark, d):
    return PointwiseMiner(["x0", "x1"]).table(parts(spark, d))


# clusterings


@query("dbscan_core", f"SELECT a.id, count(b.id) >= 5 AS core FROM {EMB} a JOIN {EMB} b ON (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 <= 0.0004 GROUP BY 1")
def dbscan_core(spark, d):
    return C.core_points(embedded(spark, d), ["x0", "x1"], 0.02, 5)


@query("dbscan_core_whole")
def dbscan_core_whole(spark, d):
    return C.core_points(embedded_whole(spark, d), E64, 0.02, 5)


@query("dbscan")
def dbscan(spark, d):
    return C.dbscan(embedded_whole(spark, d), E64, 0.02, 5)


#: Customers with balances in hundreds: lines of points, a nation each.
BANDS = "(SELECT c_custkey AS id, c_acctbal / 100 AS x0, CAST(c_nationkey AS DOUBLE) AS x1 FROM customer)"


def bands(spark, d) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x0"), F.col("c_nationkey").cast("double").alias("x1"))


@query("dbscan_clusters", f"""WITH RECURSIVE near AS (SELECT a.id AS i, b.id AS j FROM {BANDS} a JOIN {BANDS} b ON a.id <> b.id AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.64),
core AS (SELECT i FROM near GROUP BY 1 HAVING count(*) + 1 >= 3), link AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
reach(i, m) AS (SELECT i, i FROM core UNION SELECT link.i, m FROM reach JOIN link ON link.j = reach.i),
comp AS (SELECT i, min(m) AS c FROM reach GROUP BY 1), member AS (SELECT i, dense_rank() OVER (ORDER BY c) - 1 AS label FROM comp),
border AS (SELECT near.i, min(label) AS label FROM near JOIN member ON member.i = near.j GROUP BY 1)
SELECT p.id, coalesce(m.label, b.label, -1)::INT AS label FROM {BANDS} p LEFT JOIN member m ON m.i = p.id LEFT JOIN border b ON b.i = p.id""")
def dbscan_clusters(spark, d):
    """A radius inside the data: clusters, borders and noise."""
    return C.dbscan(bands(spark, d), ["x0", "x1"], 0.8, 3)


@query("average_linkage")
def average_linkage(spark, d):
    return C.agglomerative(embedded_whole(spark, d), E64, 4, "average")


@query("complete_linkage")
def complete_linkage(spark, d):
    return C.agglomerative(embedded_whole(spark, d), E64, 4, "complete")


@query("density_pairs")
def density_pairs(spark, d):
    """The density distance of each vector to the one with the next id, from two rows."""
    p = embedded_whole(spark, d)
    asked = p.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    return _rounded(B.density_distance(p, E64, 3, asked), "d")


@query("single_linkage")
def single_linkage(spark, d):
    p = embedded_whole(spark, d)
    return C.agglomerative(p, E64, 4)


@query("kmeans")
def kmeans(spark, d):
    return C.kmeans(parts(spark, d), ["x0", "x1"], 3)[0]


# experiments


@query("lambda_sweep", f"SELECT lam::DOUBLE AS lam, covered - lam::DOUBLE * mistakes AS score FROM {MIST}, (VALUES (0.0), (0.5), (1.0), (2.0)) v(lam)")
def lambda_sweep(spark, d):
    _, hits, rc, dc = _hits(spark, d)
    return X.lambda_scores(dc, hits, rc, [0.0, 0.5, 1.0, 2.0])


@query("lambda_fits")
def lambda_fits(spark, d):
    """Rules selected anew for each lambda."""
    return X.lambda_fits(customers(spark, d), lambda sample: RULES, [0.0, 0.25, 0.5, 1.0, 2.0], 3)


@query("robustness")
def robustness(spark, d):
    return X.robustness(customers(spark, d), ["x0", "x1"], RULES, 100.0, 2)


@query("rule_boxes", f"SELECT rule_id::INT AS rule_id, label::INT AS label, feature, greatest(low, CASE WHEN feature = 'x0' THEN a0 ELSE a1 END) AS low, least(high, CASE WHEN feature = 'x0' THEN z0 ELSE z1 END) AS high FROM (VALUES (0, 0, 'x0', 2000.0::DOUBLE, 1e300::DOUBLE), (0, 0, 'x1', -1e300, 12), (1, 1, 'x0', -1e300, 4000), (1, 1, 'x1', -1e300, 1e300), (2, 2, 'x0', 0, 8000), (2, 2, 'x1', 5, 20), (3, 3, 'x0', 9900, 1e300), (3, 3, 'x1', 24, 1e300)) v(rule_id, label, feature, low, high), (SELECT min(x0) AS a0, max(x0) AS z0, min(x1) AS a1, max(x1) AS z1 FROM {CUST})")
def rule_boxes(spark, d):
    return X.rule_boxes(customers(spark, d), ["x0", "x1"], RULES)


@query("ratio_distribution", f"SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'uncovered' WHEN n = 1 THEN 'unique' ELSE 'overlapping' END AS kind, (r > 1.5)::INT + (r > 3)::INT + (r > 6)::INT AS bin, count(*) AS n FROM (SELECT id, list_sort(list(dist))[2] / list_sort(list(dist))[1] AS r FROM {DIST} GROUP BY id) LEFT JOIN (SELECT id, count(DISTINCT cluster) AS n FROM {HITS} JOIN {CLUSTERS} USING (rule_id) GROUP BY id) USING (id) GROUP BY 1, 2")
def ratio_distribution(spark, d):
    p, hits, rc, _ = _hits(spark, d)
    return M.ratio_distribution(M.distance_ratio(p, ["x0", "x1"], CENTERS), L.data_to_clusters(hits, rc), [1.5, 3.0, 6.0])


@query("outlier_mask", f"WITH r AS (SELECT id, list_sort(list(dist))[2] / list_sort(list(dist))[1] AS r FROM {DIST} GROUP BY id) SELECT id FROM r ORDER BY r, id LIMIT (SELECT (count(*) * 0.1)::INT FROM customer)")
def outlier_mask(spark, d):
    return X.outlier_mask(customers(spark, d), ["x0", "x1"], CENTERS, 0.1)


@query("tie_break", "SELECT p_size, min(p_partkey) AS p_partkey FROM part JOIN (SELECT p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY 1) USING (p_size, p_retailprice) GROUP BY 1")
def tie_break(spark, d):
    p = _read(spark, d, "part").select("p_size", "p_retailprice", "p_partkey")
    return R.best_by(p, ["p_size"], "p_retailprice", "p_partkey", "p_partkey").select("p_size", "p_partkey")


@query("value_ranks", f"SELECT id, 0 AS feature, x0 AS value, row_number() OVER (ORDER BY x0, id)::INT AS rank FROM {PART} UNION ALL SELECT id, 1, x1, row_number() OVER (ORDER BY x1, id)::INT FROM {PART}")
def value_ranks(spark, d):
    return R.value_ranks(parts(spark, d), ["x0", "x1"])


@query("knn_impute")
def knn_impute(spark, d):
    p = parts(spark, d).withColumn("x1", F.when(F.col("id") % 50 != 0, F.col("x1")))
    return T.knn_impute(p, ["x0", "x1"], 3).select("id", "x0", "x1")


@query("pca")
def pca(spark, d):
    return T.pca(embedded_whole(spark, d), E64, 2)


@query("aniso_points")
def aniso_points(spark, d):
    return datasets.aniso(spark)[0]


@query("imm_clustering")
def imm_clustering(spark, d):
    return IMMBase(["x0", "x1"], centers=_pcenters()).assign(parts(spark, d))


@query("max_rules")
def max_rules(spark, d):
    p = parts(spark, d)
    return X.max_rules(p, {"id3": lambda k: DecisionTreeMod(ID3Tree(["x0", "x1"], max_leaf_nodes=k)).fit(p)}, [2, 3], 1.0)


@query("decision_forest")
def decision_forest(spark, d):
    return _rule_rows(spark, DecisionForest(["x0", "x1"], n_trees=2, max_leaf_nodes=3).fit(parts(spark, d)))


@query("decision_grid")
def decision_grid(spark, d):
    return X.decision_grid(customers(spark, d), "x0", "x1", RULES, 20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over customers, with what each covers, gets right and gets wrong."""
    p, hits, rc, _ = _hits(spark, sf_dir)
    joined = hits.join(p.select("id", "label"), "id").join(F.broadcast(rc), "rule_id")
    return joined.groupBy("rule_id", "cluster").agg(F.count("*").alias("covered"), F.count_if(F.col("label") == F.col("cluster")).alias("correct"), F.count_if(F.col("label") != F.col("cluster")).alias("mistakes"))


query("rule_report", f"SELECT rule_id, cluster, count(*) AS covered, count(*) FILTER (WHERE label = cluster) AS correct, count(*) FILTER (WHERE label <> cluster) AS mistakes FROM {HITS} JOIN {CLUSTERS} USING (rule_id) JOIN {CUST} USING (id) GROUP BY 1, 2")(flagship)

__all__ = ["QUERIES", "SQL", "flagship"]

"""Labels and assignments as tables: points (id, labels ARRAY<INT>), and the
sparse long forms data_cluster (id, cluster), data_rule (id, rule_id) and
rule_cluster (rule_id, cluster). Dense matrices are never made."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Node, RuleSet

INTS = "array<int>"


def empty() -> Column:
    return F.array().cast(INTS)


def labels_format(label: Column | str, ignore: Iterable[int] = ()) -> Column:
    """A flat label as a set; ignored and null ones give the empty set."""
    c = F.col(label) if isinstance(label, str) else label
    ignore = list(ignore)
    out = F.when(c.isNull(), empty())
    return (out.when(c.isin(ignore), empty()) if ignore else out).otherwise(F.array(c.cast("int")))


def can_flatten(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.bool_and(F.size("labels") == 1), F.lit(True)).alias("can_flatten"))


def flatten_labels(points: DataFrame) -> DataFrame:
    return points.select("id", F.explode("labels").alias("label"))


def unique_labels(points: DataFrame, ignore: Iterable[int] = ()) -> DataFrame:
    found = points.select(F.explode("labels").alias("label")).distinct()
    ignore = list(ignore)
    return found.filter(~F.col("label").isin(ignore)) if ignore else found


def labels_to_assignment(points: DataFrame, ignore: Iterable[int] = ()) -> DataFrame:
    """data_cluster, the long form of the boolean matrix."""
    out = points.select("id", F.explode("labels").alias("cluster")).distinct()
    ignore = list(ignore)
    return out.filter(~F.col("cluster").isin(ignore)) if ignore else out


def assignment_to_labels(ids: DataFrame, data_cluster: DataFrame) -> DataFrame:
    """(id, labels) for every id, the empty set included."""
    sets = data_cluster.groupBy("id").agg(F.array_sort(F.collect_set("cluster")).alias("labels"))
    return ids.select("id").join(sets, "id", "left").select("id", F.coalesce("labels", empty()).alias("labels"))


def assignment_to_members(data_cluster: DataFrame) -> DataFrame:
    """How many members each cluster has, and its members as a bitmap by bucket
    of 32,768 ids: lists of all members would not fit a row at scale."""
    return data_cluster.select("cluster", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit")).groupBy("cluster", "bucket").agg(F.bitmap_construct_agg("bit").alias("members"), F.count("*").alias("n"))


def rule_matches(rules: RuleSet) -> Column:
    """Ids of the rules that a row satisfies, in one pass over the row."""
    if not len(rules):
        return empty()
    return F.array_compact(F.array(*(F.when(r.column(), F.lit(i)) for i, r in enumerate(rules))))


def data_to_rules(points: DataFrame, rules: RuleSet) -> DataFrame:
    """data_rule: one scan for all rules, no join."""
    return points.select("id", F.explode(rule_matches(rules)).alias("rule_id"))


def rules_to_clusters(spark: SparkSession, rules: RuleSet) -> DataFrame:
    return spark.createDataFrame([(i, r.label, len(r.conditions)) for i, r in enumerate(rules)], "rule_id int, cluster int, length int")


def data_to_clusters(data_rule: DataFrame, rule_cluster: DataFrame) -> DataFrame:
    """The boolean product of data_rule and rule_cluster."""
    return data_rule.join(rule_cluster, "rule_id").select("id", "cluster").distinct()


def predict(points: DataFrame, rules: RuleSet, uncovered: Sequence[int] = (-1,)) -> DataFrame:
    """(id, labels): labels of all rules that fit; ``uncovered`` where none does."""
    table = F.array(*(F.lit(r.label) for r in rules)) if len(rules) else empty()
    labels = F.array_sort(F.array_distinct(F.transform(rule_matches(rules), lambda i: F.get(table, i))))
    none = F.array(*(F.lit(x) for x in uncovered)).cast(INTS)
    bound = points.select("id", labels.alias("labels"))
    return bound.select("id", F.when(F.size("labels") == 0, none).otherwise(F.col("labels")).alias("labels"))


def predict_tree(points: DataFrame, root: Node, leaf_labels: bool = False) -> DataFrame:
    """(id, labels): the label (or number) of the leaf a point falls in; the
    empty set for a point that falls in none, or in a leaf without label."""
    value = root.column(lambda n: n.leaf_num if leaf_labels else n.label)
    return points.select("id", labels_format(value.cast("int")).alias("labels"))


def update_centers(points: DataFrame, features: Sequence[str], centers: DataFrame, data_cluster: DataFrame) -> DataFrame:
    """Means of the clusters' points; a cluster without points keeps its center."""
    means = points.join(data_cluster, "id").groupBy("cluster").agg(*(F.avg(f).alias(f"_{f}") for f in features))
    return centers.join(means, "cluster", "left").select("cluster", *(F.coalesce(f"_{f}", f).alias(f) for f in features))

"""Rules on streams: a rule set has no state, so that a stream of points is
scored by the same expressions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RuleSet
from ..operators.labels import predict, rule_matches


def score_stream(points: DataFrame, rules: RuleSet) -> DataFrame:
    """(id, labels) for a streaming or a batch table of points."""
    return predict(points, rules)


def cover_by_window(points: DataFrame, rules: RuleSet, time: str, width: str, lateness: str) -> DataFrame:
    """How many points each rule covers in each time window; late points are
    counted until the watermark has passed."""
    timed = points.withWatermark(time, lateness).select(time, F.explode(rule_matches(rules)).alias("rule_id"))
    return timed.groupBy(F.window(time, width).alias("w"), "rule_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rule_id", "n")

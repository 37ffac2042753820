"""The data sets that experiments start from, as (points, scaler or label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import minmax_scaler, scale, standard_scaler
from ..model import Scaler
from . import tables as T


def _identified(df: DataFrame) -> DataFrame:
    """An id by content for tables without a key; equal rows are numbered by how many there are."""
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    each = counted.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return each.select(F.xxhash64(*columns, "_k").alias("id"), *columns)


def aniso(spark: SparkSession, n: int = 1000, seed: int = 170) -> tuple[DataFrame, Scaler]:
    """Eight blobs under a linear map, standard-scaled."""
    centers = [(-8 + 2.3 * k, 7 * ((k * 5) % 8) / 8 - 3) for k in range(8)]
    p = T.blobs(spark, n, centers, 1.0, seed, ((0.6, -0.6), (-0.4, 0.8)))
    scaler = standard_scaler(p, ["x0", "x1"])
    return scale(p, scaler), scaler


def csv_features(spark: SparkSession, path: str, drop: int = 0, scaled: str | None = "standard", columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str], Scaler]:
    """Numeric columns of a CSV (all but the last ``drop``), scaled."""
    raw = T.drop_last(T.read_csv(spark, path), drop)
    features = list(columns or raw.columns)
    p = _identified(T.numeric_rows(raw.select(*features), features))
    scaler = {"standard": standard_scaler, "minmax": minmax_scaler, None: lambda *_: {}}[scaled](p, features)
    return (scale(p, scaler) if scaler else p), features, scaler


def labelled_csv(spark: SparkSession, path: str, features: Sequence[str], label: str) -> DataFrame:
    """(id, features..., label): rows with a value that is no number go, labels are coded from 0."""
    raw = T.numeric_rows(T.read_csv(spark, path), features).select(*features, F.col(label).alias("_l"))
    return T.factorize(_identified(raw), "_l", "label").drop("_l")


def scaled_csv(spark: SparkSession, path: str, label: str, scaled: str | None = "minmax") -> tuple[DataFrame, list[str], Scaler]:
    """(points, features, scaler) of a CSV of numbers with an integer label, as
    tables of images are: all other columns scaled, to 0 and 1 unless asked
    otherwise, and the labels as they stand."""
    raw = T.read_csv(spark, path)
    features = [c for c in raw.columns if c != label]
    p = _identified(T.numeric_rows(raw, features).withColumn(label, F.expr(f"try_cast(`{label}` AS int)")))
    p = p.withColumnRenamed(label, "label") if label != "label" else p
    scaler = {"standard": standard_scaler, "minmax": minmax_scaler, None: lambda *_: {}}[scaled](p, features)
    return (scale(p, scaler) if scaler else p), features, scaler


def climate(spark: SparkSession, path: str, key: str = "ID", year: str = "Year", old: tuple[int, int] = (1900, 1999), new: tuple[int, int] = (2013, 2023)) -> DataFrame:
    """Relative change of each monthly column between two periods, by station."""
    raw = T.read_csv(spark, path)
    values = [c for c in raw.columns if c not in (key, year)]
    return T.period_change(raw.withColumn(key, F.lpad(F.col(key).cast("string"), 4, "0")), key, year, values, old, new)


def spiral(spark: SparkSession, path: str, more: int = 1000, seed: int = 342) -> tuple[DataFrame, Scaler]:
    """The CSV's points and as many jittered ones as asked for, scaled."""
    raw = T.read_csv(spark, path)
    names = raw.columns
    p = raw.select(F.col(names[0]).cast("long").alias("id"), F.col(names[1]).cast("double").alias("x0"), F.col(names[2]).cast("double").alias("x1"), F.col(names[3]).cast("int").alias("label"))
    p = T.jittered(p, ["x0", "x1"], more, 0.5, seed)
    scaler = standard_scaler(p, ["x0", "x1"])
    return scale(p, scaler), scaler


def well_filled(df: DataFrame, columns: Sequence[str], missing: int = 2) -> DataFrame:
    """Rows with at most ``missing`` of the columns null."""
    return df.dropna(thresh=len(columns) - missing, subset=list(columns))

"""Sources: point tables from Parquet and CSV, and generated ones; sinks for results."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import factorize, minmax_scaler, scale, standard_scaler
from ..model import Scaler


def points(df: DataFrame, id_col: str, features: dict[str, str], label: str | None = None) -> DataFrame:
    """(id, f..., label) from any table; features: new name to SQL expression.
    Columns that are not named are not read."""
    cols = [F.col(id_col).alias("id"), *(F.expr(e).cast("double").alias(n) for n, e in features.items())]
    if label is None:
        return df.select(*cols)
    named = df.select(*cols, F.expr(label).alias("_label"))
    if dict(named.dtypes)["_label"] in ("int", "bigint", "smallint", "tinyint"):
        return named.withColumnRenamed("_label", "label").withColumn("label", F.col("label").cast("int"))
    return factorize(named, "_label", "label").drop("_label")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def drop_last(df: DataFrame, n: int) -> DataFrame:
    return df.select(df.columns[:-n] if n else df.columns)


def numeric_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; rows where one is no number go."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns}).dropna("any", subset=list(columns))


def standard_scaled(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, Scaler]:
    scaler = standard_scaler(df, features)
    return scale(df, scaler), scaler


def minmax_scaled(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, Scaler]:
    scaler = minmax_scaler(df, features)
    return scale(df, scaler), scaler


def period_change(df: DataFrame, key: str, year: str, values: Sequence[str], old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """(mean of the new period - mean of the old) / mean of the old, by key, in one pass."""
    y = F.col(year).cast("int")
    means = df.groupBy(key).agg(*(x for v in values for x in (F.avg(F.when(y.between(*old), F.col(v))).alias(f"o_{v}"), F.avg(F.when(y.between(*new), F.col(v))).alias(f"n_{v}"))))
    return means.select(key, *(((F.col(f"n_{v}") - F.col(f"o_{v}")) / F.when(F.col(f"o_{v}") != 0, F.col(f"o_{v}"))).alias(v) for v in values))


def blobs(spark: SparkSession, n: int, centers: Sequence[Sequence[float]], std: float, seed: int = 342, transform: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """(id, x0, x1, label): normal blobs, each row of a label by turns; a linear
    map makes them anisotropic."""
    k = len(centers)
    base = spark.range(n).select("id", (F.col("id") % k).cast("int").alias("label"))
    at = lambda j: F.get(F.array(*(F.lit(float(c[j])) for c in centers)), F.col("label"))
    base = base.select("id", "label", (at(0) + std * F.randn(seed)).alias("a"), (at(1) + std * F.randn(seed + 1)).alias("b"))
    m = transform or ((1.0, 0.0), (0.0, 1.0))
    return base.select("id", (F.col("a") * m[0][0] + F.col("b") * m[1][0]).alias("x0"), (F.col("a") * m[0][1] + F.col("b") * m[1][1]).alias("x1"), "label")


def jittered(df: DataFrame, features: Sequence[str], n: int, std: float = 0.5, seed: int = 342) -> DataFrame:
    """df and n resampled rows, each moved by one normal number in all features."""
    total = df.count()
    numbered = df.withColumn("_r", F.row_number().over(Window.orderBy("id")) - 1)  # for the small tables this is made for
    top = df.agg(F.max("id")).first()[0]
    picks = df.sparkSession.range(n).select(F.col("id").alias("_n"), F.floor(F.rand(seed) * total).alias("_r"), (std * F.randn(seed + 1)).alias("_e"))
    more = picks.join(numbered, "_r").select((F.lit(top) + 1 + F.col("_n")).alias("id"), *((F.col(f) + F.col("_e")).alias(f) for f in features), *(c for c in df.columns if c not in ("id", *features)))
    return df.unionByName(more)


def exactly_one(df: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key's only match; null without, or with several."""
    found = df.groupBy(key).agg(F.count("*").alias("_c"), F.any_value(value).alias("_v"))
    return keys.join(found, key, "left").withColumn(value, F.when(F.col("_c") == 1, F.col("_v"))).drop("_c", "_v")


def _impute_pairs(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(a_f..., f..., _j, _d): each different vector with a null, and the rows
    that share a feature with it; of equal rows those of the k least ids."""
    blocks = 32
    block = F.pmod(F.xxhash64("_j"), F.lit(blocks)).cast("int")
    some_null = F.greatest(*(F.col(f).isNull().cast("int") for f in features), F.lit(0)) == 1
    holes = df.filter(some_null).select(*(F.col(f).alias(f"a_{f}") for f in features)).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    equal = Window.partitionBy(*features).orderBy("_j")
    full = df.select(F.col("id").alias("_j"), *features).withColumn("_c", F.row_number().over(equal)).filter(F.col("_c") <= k).drop("_c").withColumn("_b", block)
    both = [F.col(f).isNotNull() & F.col(f"a_{f}").isNotNull() for f in features]
    shared = sum((x.cast("int") for x in both), F.lit(0))
    d2 = sum((F.when(x, (F.col(f) - F.col(f"a_{f}")) ** 2).otherwise(0.0) for f, x in zip(features, both, strict=True)), F.lit(0.0))
    return holes.join(full, "_b").withColumn("_n", shared).filter("_n > 0").withColumn("_d", d2 * len(features) / F.col("_n")).drop("_b", "_n")


def knn_impute(df: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    """Nulls become the mean of the k nearest rows that have the value, by the
    distance over the features both rows have, scaled to all of them.

    Equal rows with nulls have the same neighbours, and of equal rows only the k
    least ids can be among them, so that different vectors meet instead of rows."""
    pairs, out = _impute_pairs(df, features, k), df
    known = [f"a_{f}" for f in features]
    for f in features:
        near = pairs.filter(F.col(f"a_{f}").isNull() & F.col(f).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*known).orderBy("_d", "_j"))).filter(F.col("_r") <= k)
        means = near.groupBy(*known).agg(F.avg(f).alias(f"_m_{f}"))
        same = F.lit(True)
        for g in features:
            same = same & F.col(g).eqNullSafe(F.col(f"a_{g}"))
        out = out.join(means, same, "left").drop(*known)
    return out.select(*(F.coalesce(c, f"_m_{c}").alias(c) if c in features else c for c in df.columns))


def pca(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(data).transform(data)
    return out.select("id", *(F.get(vector_to_array("_p"), F.lit(i)).alias(f"pc{i}") for i in range(k)))


def write_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    """Tidy results (module, sample, metric, x, value), with a header for CSV."""
    writer = results.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_wide_results(spark: SparkSession, path: str) -> DataFrame:
    """Tidy results (module, sample, metric, x, value) of CSVs whose columns have
    three headers, metric, module and sample, and whose first column is x.

    Headers are read apart; rows become long by one expression. A sample that is
    no number is null, and so are cells that are none; rows without x go."""
    lines = [r[0] for r in spark.read.text(path).head(3)]
    metrics, modules, samples = (next(csv.reader([x])) for x in lines)
    if not len(metrics) == len(modules) == len(samples) > 1:
        raise ValueError("three headers of the same columns are needed")
    names = [f"c{k}" for k in range(len(metrics))]
    body = spark.read.schema(", ".join(f"{c} string" for c in names)).csv(path)
    number = lambda c: F.nanvl(F.expr(f"try_cast({c} AS double)"), F.lit(None).cast("double"))
    rows = body.withColumn("x", number("c0")).filter(F.col("x").isNotNull())

    def sample(text: str):
        try:
            return F.lit(int(float(text)))
        except ValueError:  # "nan" too
            return F.lit(None).cast("int")

    cells = [
        F.struct(F.lit(module).alias("module"), sample(k).alias("sample"), F.lit(metric).alias("metric"), number(c).alias("value"))
        for c, metric, module, k in zip(names[1:], metrics[1:], modules[1:], samples[1:], strict=True)
    ]
    return rows.select("x", F.explode(F.array(*cells)).alias("r")).select("r.module", "r.sample", "r.metric", "x", "r.value")


def summarise(results: DataFrame) -> DataFrame:
    """Mean and deviation of each metric by module and x."""
    return results.groupBy("metric", "module", "x").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))

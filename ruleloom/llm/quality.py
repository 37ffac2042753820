"""Document quality by Bradley-Terry pairwise ranking.

Each preference pair is a document of label 1 and one of label 0. The chance
that the first is preferred is the logistic function of the difference of
their scores, a score being linear in the features, so that the weights are
those of a logistic regression without intercept on feature differences. The
weights are learnt from a bounded sample; the cut between good and bad is a
quantile of the scores of all labelled documents: the share of label 0 among
them. A document's published score is the logistic function
of its distance from the cut, moved so that the cut is at THRESHOLD.

Features describe whole texts: shares of kinds of characters, word lengths,
repetition of words, neighbours and lines, and how well the text compresses.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fold, remove, runs, slices, written

#: Labelled documents of each label that the weights are learnt from, at most.
PER_CLASS = 1500
#: Partners of the other label that each of them is paired with.
PARTNERS = 8
THRESHOLD = 0.7
#: L2 penalty of the weights.
REGULARISATION = 3e-4
#: The quantile's error in rank is at most one in so many rows.
ACCURACY = 100_000

_BYTES = np.arange(256)
#: Kinds of bytes whose share of the text is a feature.
_KINDS = np.stack([
    (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57), _BYTES == 32, _BYTES == 10, _BYTES >= 128,
    np.isin(_BYTES, list(b".,")), np.isin(_BYTES, list(b"!?")), np.isin(_BYTES, list(b"#$%&*+=@^~")), np.isin(_BYTES, list(b"|<>[]{}\\/_")), np.isin(_BYTES, list(b"\"'():;-")),
]).astype(np.float64)
N_FEATURES = len(_KINDS) + 11


def features(text: str | None) -> np.ndarray:
    """The features of one text; zeros for a null text and one without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts: Counter[bytes] = Counter()
    n = repeats = n_lines = 0
    before, lines = None, set()
    for run in runs(data, r"\x20\x09-\x0D"):  # where bytes.split() splits
        lower = run.lower().split()
        counts.update(lower)
        repeats += sum(map(bytes.__eq__, lower[1:], lower)) + (before is not None and before == lower[:1])
        n, before = n + len(lower), lower[-1:] or before
    if not n:
        return np.zeros(N_FEATURES)
    for run in runs(data, "\n"):
        filled = [x for x in run.split(b"\n") if x.strip()]
        lines.update(filled)
        n_lines += len(filled)
    size = len(data)
    shares = _KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / size
    packed = len(zlib.compress(data, 1)) / (size + 20)
    low = 1.0 if n >= 3 else 0.0
    return np.concatenate([
        np.sqrt(shares),
        [np.log1p(n) / 10, size / n / 10, min(1.0, size / n / 40), len(counts) / n, len(counts) / n**0.75 if n > 1 else 1.0, max(counts.values()) / n * low, repeats / n, 1 - len(lines) / n_lines, packed, min(1.0, n_lines / n * 5), 1.0 / n],
    ])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        rows = [features(t) for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("o"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "o", "x"])


class Model:
    def __init__(self, weights: np.ndarray, cut: float = 0.0, known: bool = True):
        self.weights, self.cut, self.known = weights, cut, known

    def raw(self, texts: list[str | None]) -> np.ndarray:
        return np.array([features(t) @ self.weights for t in texts])

    def score(self, raw: Column) -> Column:
        """Both ends stay inside (0, 1); a raw score of exactly the cut gives THRESHOLD."""
        if not self.known:
            return F.lit(0.5)
        above = raw - F.lit(self.cut)
        moved = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), above + float(np.log(THRESHOLD / (1 - THRESHOLD)))))
        out = 1 / (1 + F.exp(-moved))
        return F.when(above >= 0, F.greatest(out, F.lit(THRESHOLD))).otherwise(F.least(out, F.lit(float(np.nextafter(THRESHOLD, 0)))))


def known_labels(labels: DataFrame, id_col: str, label_col: str, learn: Column) -> DataFrame:
    """(_id, _y), an id once; of an id with differing labels none is known."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & learn)
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"), F.max(label_col).alias("_z")).filter("_y = _z").drop("_z")


def _drawn(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """(y, o, x): the features of the ``per_class`` ids of each label with the
    least hashes; of an id with several texts the one with the least hash."""
    order = F.xxhash64("_id", F.lit(7))
    few = [known.filter(F.col("_y") == y).orderBy(order, "_id").limit(per_class) for y in (0, 1)]
    narrow = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t"))
    met = narrow.join(F.broadcast(few[0].union(few[1])), F.col("_d") == F.col("_id"))  # 2 * per_class ids
    text = F.coalesce("_t", F.lit(""))
    met = met.groupBy("_id", F.col("_y").alias("y")).agg(F.min_by(text, F.xxhash64(text)).alias("_text"))
    return written(met.select("y", F.xxhash64("_id", "_text").alias("o"), "_text").mapInArrow(_featurise, "y int, o long, x array<double>"), "quality-features")


def _pairs(rows: DataFrame) -> DataFrame | None:
    """(label, d): differences of features, each pair both ways; each row of
    the more frequent label meets PARTNERS rows of the other. None without
    rows of both labels."""
    ranked = written(rows.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("o")) - 1), "quality-ranked")
    n = {r["y"]: r["count"] for r in ranked.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    many, few = (1, 0) if n[1] >= n[0] else (0, 1)
    left = ranked.filter(F.col("y") == many).select(F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(PARTNERS - 1))).alias("p"), F.col("k").alias("ka"))
    left = left.withColumn("k", F.pmod(F.xxhash64("ka", "p"), F.lit(n[few])))
    right = ranked.filter(F.col("y") == few).select(F.col("x").alias("b"), "k")
    good, bad = ("a", "b") if many == 1 else ("b", "a")
    diff = F.zip_with(good, bad, lambda u, v: u - v)
    both = F.array(F.struct(F.lit(1.0).alias("label"), diff.alias("d")), F.struct(F.lit(0.0).alias("label"), F.transform(diff, lambda u: -u).alias("d")))
    return left.join(right, "k").select(F.explode(both).alias("s")).select("s.label", "s.d")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learns weights from the labels where ``learn`` holds; the cut is 0."""
    known = known_labels(labels, id_col, label_col, F.lit(True) if learn is None else learn)
    pairs = _pairs(_drawn(docs, known, id_col, text_col, per_class))
    if pairs is None:
        return Model(np.zeros(N_FEATURES), known=False)
    train = written(pairs.select("label", array_to_vector("d").alias("features")), "quality-pairs")
    fitted = LogisticRegression(fitIntercept=False, regParam=REGULARISATION, standardization=True, maxIter=60).fit(train)
    remove(train)
    return Model(fitted.coefficients.toArray())


def cut(raw: DataFrame, known: DataFrame) -> float:
    """The cut of raw scores (_id, raw) of all rows with a known label: the
    middle of the gap at the quantile of label 0's share."""
    rows = raw.join(known, "_id").select("raw", "_y")
    level = rows.agg(F.avg(1 - F.col("_y"))).first()[0]
    if level is None:
        return 0.0
    low = rows.agg(F.percentile_approx("raw", level, ACCURACY)).first()[0]
    high = rows.filter(F.col("raw") > low).agg(F.min("raw")).first()[0]
    return float(low) if high is None else (low + high) / 2


def _raw(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(model.raw(b.column("_text").to_pylist()), pa.float64())], names=["_id", "raw"])


def raw_scores(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(_id, raw) of each row, written, so that texts are read once."""

    def run(batches):
        return _raw(batches, model)

    id_type = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {id_type}, raw double"), "quality-raw")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Returns (id_col, held_out, score, predicted), a row for each row of docs.

    Learns only from labels of ids whose crc32(id as text) mod 4 is not 2;
    held_out is whether the remainder is 2 (false for a null id). score is from
    0 to 1, predicted is 1 from 0.7 on. A null or empty text has the features
    0 and is scored like others. Without labels of both kinds to learn from,
    all scores are 0.5. Null labels, and ids with both labels, teach nothing;
    repeated labels count once. Repeated documents are kept; of an id with
    several texts one is learnt from, and all count for the cut. A text of any
    length is used whole, its words counted in runs. Ties of scores are cut
    together. Other columns are not read. An empty table gives an empty result.
    """
    learn = F.coalesce(fold(id_col, 4) != 2, F.lit(False))
    model = fit(docs, labels, id_col, text_col, label_col, learn, per_class)
    raw = raw_scores(docs, model, id_col, text_col)
    if model.known:
        model.cut = cut(raw, known_labels(labels, id_col, label_col, learn))
    score = model.score(F.col("raw"))
    return raw.select(F.col("_id").alias(id_col), F.coalesce(fold("_id", 4) == 2, F.lit(False)).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that are predicted to be good; all rows, if there are no labels
    of both kinds to learn from: a filter that has learnt nothing takes nothing
    away. Rows that may be learnt from are scored twice, for the cut and when
    they are filtered, so that no text is moved."""
    learn = F.coalesce(fold(id_col, 4) != 2, F.lit(False))
    model = fit(docs, labels, id_col, text_col, label_col, learn)
    if not model.known:
        return docs
    known = known_labels(labels, id_col, label_col, learn)
    raw = raw_scores(docs.filter(learn), model, id_col, text_col)
    model.cut = cut(raw, known)
    remove(raw)

    def run(batches):
        for b in slices(batches, text_col):
            yield b.filter(pa.array(model.raw(b.column(b.schema.get_field_index(text_col)).to_pylist()) >= model.cut))

    return docs.mapInArrow(run, docs.schema)

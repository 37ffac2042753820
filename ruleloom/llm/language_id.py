"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the letters of a text (other
characters count as one space), weighted by their share of the text times
their inverse document frequency. Weights are learnt by follow-the-
regularised-leader with an elastic-net penalty, which leaves most of them
zero; a temperature, fitted on rows that the weights have not seen, makes the
scores probabilities.

Document frequencies are counted over all rows to learn from, the weights are
learnt from a bounded sample of them (PER_CLASS a language).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import class_sample, fold, slices

#: Hash buckets of n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Documents a language that the weights are learnt from, at most about.
PER_CLASS = 400
#: Shares are multiplied by this before they are learnt from.
SCALE = 30.0
#: Characters of a text from which on it is counted in runs of so many.
RUN = 200_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _kept(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters count, and which of them are letters: letters, and next
    to a letter the first and the last of other characters, as spaces."""
    letter = _letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    return keep, letter


def _mixed(cp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the n-gram that begins at each character."""
    mixed = np.zeros(len(cp), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(cp) < n:
            break
        mixed = (mixed[: len(cp) - n + 1] * np.uint64(0x100000001B3) + cp[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            yield n, (mixed >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, the text of each, and how many
    letters each text has. Texts are cut nowhere."""
    lower = [(" " + t.lower() + " ") if t else "  " for t in texts]
    cp = _points("".join(lower))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lower])
    keep, letter = _kept(cp)  # texts begin and end with a space, so that none reaches into the next
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    cp, doc, letter = np.where(letter, cp, 32)[keep].astype(np.uint64), doc[keep], letter[keep]
    found, of = [], []
    for n, buckets in _mixed(cp):
        same = doc[: len(cp) - n + 1] == doc[n - 1 :]
        if n == 1:
            same = same & letter
        found.append(buckets[same])
        of.append(doc[: len(cp) - n + 1][same])
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32), n_letters
    return np.concatenate(found), np.concatenate(of), n_letters


def long_grams(text: str, run: int = RUN) -> tuple[np.ndarray, int]:
    """How often each bucket is met in one long text, and its letters: counted
    by runs, each of which sees the two kept characters before it."""
    lower = " " + text.lower() + " "
    counts, n_letters, before = np.zeros(BUCKETS, np.int64), 0, np.empty(0, np.uint64)
    for at in range(0, len(lower), run):
        left = min(at, 1)
        cp = _points(lower[at - left : at + run + 1])
        keep, letter = _kept(cp)
        here = slice(left, left + min(run, len(lower) - at))
        keep, letter, cp = keep[here], letter[here], cp[here]
        n_letters += int(letter.sum())
        own = np.where(letter, cp, 32)[keep].astype(np.uint64)
        joined = np.concatenate([before, own])
        for n, buckets in _mixed(joined):
            fresh = buckets[max(0, len(before) - n + 1) :]  # those that end in this run
            counts += np.bincount(fresh[letter[keep]] if n == 1 else fresh, minlength=BUCKETS)
        before = joined[-(max(ORDERS) - 1) :]
    return counts, n_letters


def counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    short = [None if _is_long(t) else t for t in texts]
    buckets, doc, _ = grams(short)
    order = np.argsort(doc, kind="stable")
    buckets, ends = buckets[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))
    for k, t in enumerate(texts):
        if _is_long(t):
            counts = long_grams(t)[0]
            at = np.nonzero(counts)[0]
            yield at, counts[at]
        else:
            yield np.unique(buckets[ends[k] : ends[k + 1]], return_counts=True)


def _is_long(text: str | None) -> bool:
    return text is not None and len(text) > RUN


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # (BUCKETS,)
    weights: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float

    def table(self) -> np.ndarray:
        return (self.weights * self.idf[:, None] * SCALE).astype(np.float32)

    def logits(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buckets, doc, n_letters = grams([None if _is_long(t) else t for t in texts])
        n = np.bincount(doc, minlength=len(texts))
        sums = np.stack([np.bincount(doc, table[:, k][buckets], minlength=len(texts)) for k in range(len(self.languages))], 1)
        for k, t in enumerate(texts):
            if _is_long(t):
                counts, n_letters[k] = long_grams(t)
                n[k], sums[k] = counts.sum(), counts @ table
        return sums / np.maximum(n, 1)[:, None] + self.bias, n_letters


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> np.ndarray:
    """Weights (BUCKETS + 1, classes) of a multinomial logistic regression; the
    last row is the bias. rows: (buckets, values, class), in the order learnt."""
    z, n = np.zeros((2, BUCKETS + 1, n_classes))

    def lazily(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = lazily(i)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return lazily(np.arange(BUCKETS + 1))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, from 0.05 to 20."""
    tries = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each bucket is; at BUCKETS, how many there are."""
    df = np.zeros(BUCKETS + 1, np.int64)
    for b in slices(batches, "_text", 300_000):
        for seen, _ in counted(b.column("_text").to_pylist()):
            df[seen] += 1
        df[BUCKETS] += b.num_rows
    at = np.nonzero(df)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["bucket", "df"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text", 300_000):
        ids, shares = [], []
        for found, n in counted(b.column("_text").to_pylist()):
            ids.append(found.astype(np.int32))
            shares.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column("_order"), b.column("_lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["o", "lang", "b", "x"])


def fit(docs: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang", key: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learns from the rows where ``learn`` holds and text and label are given."""
    narrow = docs.filter(learn & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    narrow = narrow.select(F.col(text_col).alias("_text"), F.col(label_col).cast("string").alias("_lang"))
    key = F.xxhash64("_text")
    df = narrow.select("_text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    counts = np.zeros(BUCKETS + 1)
    for r in df:
        counts[r["bucket"]] = r["df"]
    idf = np.log((1 + counts[BUCKETS]) / (1 + counts[:BUCKETS])) + 1
    drawn, languages = class_sample(narrow, key, "_lang", per_class)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    drawn = drawn.dropDuplicates(["_text", "_lang"])
    most = 2 * per_class * len(languages)
    got = drawn.select(F.xxhash64("_text", F.lit(1)).alias("_order"), "_lang", "_text").mapInArrow(_rows, "o long, lang string, b array<int>, x array<float>").limit(most + 1).collect()
    if len(got) > most:
        raise RuntimeError(f"over {most} texts were drawn to learn from")
    got.sort(key=lambda r: (r["o"], r["lang"]))
    seen: Counter = Counter()
    got = [r for r in got if seen.update([r["lang"]]) or seen[r["lang"]] <= per_class]
    data = [(np.append(np.array(r["b"], np.int64), BUCKETS), np.append(np.array(r["x"]) * idf[np.array(r["b"], np.int64)] * SCALE, 1.0), languages.index(r["lang"])) for r in got]
    held = data[::5] if len(data) >= 10 else data
    taught = [x for k, x in enumerate(data) if k % 5] if len(data) >= 10 else data
    w = ftrl(taught, len(languages))
    logits = np.array([x @ w[i] for i, x, _ in held])
    return Model(languages, idf, w[:BUCKETS], w[BUCKETS], _temperature(logits, np.array([y for *_, y in held])))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    table = m.table()
    for b in slices(batches, "_text", 300_000):
        texts = b.column("_text").to_pylist()
        if m.languages:
            logits, n_letters = m.logits(texts, table)
            p = softmax(logits / m.temperature)
            best = p.argmax(1)
            names = [m.languages[k] if n else UNKNOWN for k, n in zip(best, n_letters, strict=True)]
            scores = np.where(n_letters > 0, p[np.arange(len(best)), best], 0.0)
        else:
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "_text"), pa.array(names), pa.array(scores, pa.float64())], names=[*(c for c in b.schema.names if c != "_text"), "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, more..., lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        return _predict(batches, shared)

    narrow = docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in (more or {}).items()), F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    return narrow.mapInArrow(run, f"{schema}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """Returns (id_col, held_out, lang_pred, score), a row for each row.

    Learns from rows whose crc32(id as text) mod 3 is not 1 and whose text and
    label are given; held_out is whether the remainder is 1 (false for a null
    id, which is not learnt from either). lang_pred is a learnt label, or
    ``und`` with score 0 where the text is null or has no letter, or where
    there was nothing to learn from. Whole texts of any length are used, very
    long ones in runs.
    Repeated ids and rows are kept. Ties go to the label that sorts first.
    Other columns are not read. An empty table gives an empty result.
    """
    rest = fold(id_col, 3)
    model = fit(docs, F.coalesce(rest != 1, F.lit(False)), text_col, label_col, per_class=per_class)
    return predict(docs, model, id_col, text_col, {"held_out": F.coalesce(rest == 1, F.lit(False))})


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a score of ``least`` at least; all
    rows, if there is no label to learn from: a filter that has learnt nothing
    takes nothing away."""
    rest = fold(id_col, 3)
    model = fit(docs, F.coalesce(rest != 1, F.lit(False)), text_col, label_col)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        m = shared.value
        table = m.table()
        for b in slices(batches, text_col, 300_000):
            logits, n_letters = m.logits(b.column(b.schema.get_field_index(text_col)).to_pylist(), table)
            good = (softmax(logits / m.temperature).max(1) >= least) & (n_letters > 0)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, schema)

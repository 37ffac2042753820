"""Spelling variants: words that differ by one code point, and their forms.

Words are found by a positional q-gram inverted index. Two words of which the
longer has m code points share at least m - 5 of their 3-grams if one edit
makes them equal: the overlap bound. Grams are ordered by how many words have
them, the rarest first; the rarest gram that an edit leaves whole stands among
the first few of either word, so that only these get postings. Lists of the
grams behind are never merged: they are probed when a pair's overlap is counted.
A gram that very many words have is posted together with the next one or ones
that an edit leaves whole, as many as the overlap bound allows.

A word meets the postings of its key that the limits allow: of its own length
or one less, the gram at the same place with an equal left side, or at the same
place from the end with an equal right side, and of the other side an equal
half. These sorted lists are merged by a heap, the overlap of what comes out is
counted, and what reaches the bound is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from heapq import merge
from itertools import combinations, groupby, islice
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, slices, written

#: Code points of a gram, of the shortest word, and buckets of the table of gram frequencies.
Q, SHORTEST, BUCKETS = 3, 7, 1 << 18
#: Words that have a gram from which on it is posted with further ones, and by how much each of these divides a list.
HOT, DIVIDES = 20_000, 30
#: A word's form is that many times as frequent.
TIMES = 10
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that a task counts before it hands the counts on, and runs that it takes from a text at once.
_HELD, _STEP = 200_000, 100_000


# words


def words_of(doc_id, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text, with repeats summed over a part of it. Of each run
    whose crc32 with the id is a multiple of 31 a code point is deleted."""
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = (m[0] for m in _RUN.finditer(text))
    while some := Counter(islice(found, _STEP)):
        for run, n in some.items():
            word = run.lower() if run.isascii() else run.translate(_LOWER)
            h = zlib.crc32(word.encode("utf-8"), salt)
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < SHORTEST:
                    continue
            yield word, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: dict[str, int] = defaultdict(int)
    for b in slices(batches, "_text"):
        for i, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
            for word, n in words_of(i, text or ""):
                counts[word] += n
            if len(counts) > _HELD:
                yield rows()
                counts.clear()
    yield rows()


# the index


def bucket(longer: int, gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8"), longer) % BUCKETS


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        grams = Counter((m, w[i : i + Q]) for w in b.column("word").to_pylist() for m in (len(w), len(w) + 1) for i in range(len(w) - Q + 1))
        for (m, gram), k in grams.items():
            n[bucket(m, gram)] += k
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])


def postings(word: str, longer: int, frequency, hot: int = HOT) -> Iterator[tuple[str, int]]:
    """(key, place of the key's first gram) under which a word is posted among
    pairs whose longer word has ``longer`` code points."""
    bound, n = longer + 1 - 2 * Q, len(word) - Q + 1
    order = sorted((frequency[bucket(longer, g := word[i : i + Q])], g, i) for i in range(n))
    for k in range(n - bound + 1):
        met, gram, at = order[k]
        more = 0 if met <= hot else min(bound - 1, 1 + int(log(met / hot, DIVIDES)))
        # of the grams that are left whole the first is order[k], and the next ones come behind it
        for others in combinations(order[k + 1 : n - bound + 1 + more], more):
            yield gram + "".join(g for _, g, _ in others), at


def _post(batches: Iterator[pa.RecordBatch], frequency, hot: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 10_000):
            some = b.slice(at, 10_000)
            out = [(m, key, place, w, n) for w, n in zip(some.column("word").to_pylist(), some.column("n").to_pylist(), strict=True) for m in (len(w), len(w) + 1) for key, place in postings(w, m, frequency, hot)]
            if out:
                m, key, place, word, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(key), pa.array(place, pa.int32()), pa.array(word), pa.array(n, pa.int64())], names=["longer", "key", "place", "word", "n"])


def grams(word: str) -> list[str]:
    return list(map("".join, zip(*(word[k:] for k in range(Q)), strict=False)))


def overlap(longer: list[str], other: list[str]) -> int:
    """At least as many as the grams of the longer word that stand in the other
    one at a place that one edit allows: the same, or the one before in a
    shorter word."""
    n = sum(map(eq, longer, other))
    return n if len(longer) == len(other) else n + sum(map(eq, longer[1:], other))


def one_edit(longer: str, other: str) -> bool:
    """Does exactly one inserted, deleted or replaced code point part them?"""
    i, n = 0, len(other)
    while i < n and longer[i] == other[i]:
        i += 1
    return longer[i + 1 :] == other[i + (len(longer) == n) :] and longer != other


def sides(word: str, place: int, longer: int) -> Iterator[tuple]:
    """What a word with a key's gram at ``place`` must have in common with one
    that differs by an edit. If the edit is behind the gram, place and left side
    are the same; if it is before, place from the end and right side are. Of
    the other side a half is the same again, its first or its last one."""
    left, right = word[:place], word[place + Q :]
    rest = longer - place - Q
    yield 0, place, left, right[: rest // 2]
    yield 1, place, left, right[max(0, len(right) - rest + rest // 2) :]
    end = len(word) - place
    rest = longer - end
    yield 2, end, left[: rest // 2], right
    yield 3, end, left[max(0, len(left) - rest + rest // 2) :], right


def near_pairs(longer: int, rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of the postings (place, word, n) of one key."""
    n_of = {w: n for _, w, n in rows}
    same: dict[tuple, list[str]] = defaultdict(list)
    shorter: dict[tuple, list[str]] = defaultdict(list)
    probes = []
    for w, place in sorted({(w, place) for place, w, _ in rows}):
        keys = tuple(sides(w, place, longer))
        if len(w) == longer:
            probes.append((w, keys))
        for key in keys:
            (same if len(w) == longer else shorter)[key].append(w)
    grams_of = {w: grams(w) for w in n_of}
    bound, seen = longer + 1 - 2 * Q, set()
    for w, keys in probes:
        met = [some for key in keys if len(some := same[key]) > 1]
        met += [some for key in keys if (some := shorter.get(key))]
        own, before = grams_of[w], w
        for other in merge(*met) if len(met) > 1 else met[0] if met else ():
            if other == before or other == w or other < w and len(other) == longer:
                continue
            before = other
            if overlap(own, grams_of[other]) >= bound and one_edit(w, other) and (w, other) not in seen:
                seen.add((w, other))
                yield w, n_of[w], other, n_of[other]
                yield other, n_of[other], w, n_of[w]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's postings are held at once."""

    def rows():
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("longer", "key", "place", "word", "n")]
            yield from zip(*cols, strict=True)

    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        word, n, near, m = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n, pa.int64()), pa.array(near), pa.array(m, pa.int64())], names=["word", "n", "near", "near_n"])

    for (longer, _), group in groupby(rows(), key=lambda r: r[:2]):
        posted = [r[2:] for r in group]
        if len(posted) > 1:
            for pair in near_pairs(longer, posted):
                out.append(pair)
                if len(out) >= 10_000:
                    yield batch()
    if out:
        yield batch()


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n): each word of ``words`` (word, n; distinct, of 7
    code points at least) with each that differs by one edit, in both directions."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = written(words.select("word", "n").repartition(parts, "word"), "variants-dealt")
    found = words.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS, np.int64)  # of fixed size, however many grams there are
    table[found["bucket"].to_numpy()] = found["n"].to_numpy()
    frequency = spark.sparkContext.broadcast(table)

    def post(batches):
        yield from _post(batches, frequency.value.tolist(), hot)

    posted = words.mapInArrow(post, "longer int, key string, place int, word string, n long")
    pairs = posted.repartition(parts, "longer", "key").sortWithinPartitions("longer", "key").mapInArrow(_near, "word string, n long, near string, near_n long")
    # a pair may share several keys
    near = written(pairs.repartition(parts, "word").dropDuplicates(["word", "near"]), "variants-near")
    remove(words)
    frequency.destroy()
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the steps
    that are followed, and a form is more frequent than its word, so that the
    rounds are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        moved = not new.filter("moved").isEmpty()
        remove(now)
        now = new.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, hot: int = HOT) -> DataFrame:
    """Returns (word, form, root, n, n_near, form_n), a row a word.

    Runs are maximal ones of ``[A-Za-zÀ-ÿ]``, lower-cased in A-Z. Where the
    crc32 of ``id:run`` is a multiple of 31, the code point at crc32 modulo the
    run's length is deleted. Words have 7 code points at least and come twice
    at least. Two are near that differ by one inserted, deleted or replaced
    code point. A word's form is its most frequent near word (ties: the first in
    code-point order), if that is ``times`` as frequent at least, else null; its
    root is what forms lead to, or the word itself.

    A null text has no words; a null id is the empty string in front of the
    colon. Repeated ids and rows count each time. Texts of any length are
    searched in steps; a run of any length is one word. An empty table gives an
    empty result. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    words = narrow.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")
    words = written(words, "variants-words")
    near = near_words(words, hot)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.less") >= times * F.col("n")
    found = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = written(found, "variants-found")
    roots = _roots(found.filter("form IS NOT NULL"))
    for spent in (words, near):
        remove(spent)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

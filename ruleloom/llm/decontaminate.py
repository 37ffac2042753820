"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed in segments: a row of the index holds, for a run of
documents, each test term's postings (document, position) in one sorted list.
Which words are test terms is told by a filter of fixed size; the more terms,
the more others it lets into the index, which does no harm. Segments are written to the shared folder. A phrase query takes its terms from
the rarest to the commonest, by their counts over the whole index, and
intersects their postings after taking off each term's offset in the phrase;
what is left are the places where the whole phrase stands. A proximity query
does the same with a slack around each offset.

Items are searched in blocks of bounded size, so that what a task gets of the
benchmark has a bound; each block runs over all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, runs, slices, written

#: Words of a window.
WINDOW = 10
#: Postings after which a segment is closed.
SEGMENT = 1_000_000
#: Bits of the filter of the test terms' CRC-32s, a power of two: its size does not grow with the benchmark.
FILTER_BITS = 1 << 25
#: Different words after which a segment is closed.
SEGMENT_WORDS = 1_000_000
#: Words of the items of one block of queries.
BLOCK_WORDS = 200_000

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of digits, a-z and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class _Segment:
    def __init__(self, terms: np.ndarray | None, id_type: pa.DataType):
        self.filter, self.id_type = terms, id_type
        self.empty()

    def empty(self):
        self.ids, self.n, self.terms, self.docs, self.positions, self.held = [], [], [], [], [], 0
        self.number: dict[bytes, int] = {}  # of each word; -1 for one that is no test term
        self.names: list[bytes] = []

    def _new(self, word: bytes) -> int:
        at = crc32(word) & (FILTER_BITS - 1)
        if self.filter is not None and not self.filter[at >> 3] >> (at & 7) & 1:
            self.number[word] = -1
        else:
            self.number[word] = len(self.names)
            self.names.append(word)
        return self.number[word]

    def add(self, doc_id, text: str | None) -> None:
        n, get, new = 0, self.number.get, self._new
        for run in runs((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES), " "):
            w = run.split()
            t = np.array([new(x) if k is None else k for x in w for k in (get(x),)], np.int32)
            at = np.nonzero(t >= 0)[0]
            self.terms.append(t[at])
            self.docs.append(np.full(len(at), len(self.ids), np.int32))
            self.positions.append((at + n).astype(np.int32))
            self.held += len(at)
            n += len(w)
        self.ids.append(doc_id)
        self.n.append(n)

    def full(self, most: int) -> bool:
        return self.held >= most or len(self.ids) >= most // 20 or len(self.number) >= SEGMENT_WORDS

    def row(self, seg: str) -> pa.RecordBatch:
        t = np.concatenate(self.terms)
        order = np.argsort(t, kind="stable")
        t, docs, positions = t[order], np.concatenate(self.docs)[order], np.concatenate(self.positions)[order]
        found, starts = np.unique(t, return_index=True)
        names = self.names
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        out = pa.RecordBatch.from_arrays(
            [pa.array([seg]), one(self.ids, self.id_type), one(self.n, pa.int32()), one([names[i] for i in found], pa.binary()), one(np.append(starts, len(t)).astype(np.int32), pa.int32()), one(docs, pa.int32()), one(positions, pa.int32())],
            names=["seg", "ids", "n_words", "terms", "starts", "docs", "positions"],
        )
        self.empty()
        return out


def _index(batches: Iterator[pa.RecordBatch], terms, most: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    segment, k = None, 0
    terms = terms.value if terms is not None else None
    for b in slices(batches, "_text"):
        if segment is None:
            segment = _Segment(terms, b.column("id").type)
        for doc_id, text in zip(b.column("id").to_pylist(), b.column("_text").to_pylist(), strict=True):
            segment.add(doc_id, text)
            if segment.full(most):
                yield segment.row(f"{part}.{k}")
                k += 1
    if segment is not None and segment.ids:
        yield segment.row(f"{part}.{k}")


def build_index(docs: DataFrame, vocabulary: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", most: int = SEGMENT) -> DataFrame:
    """Writes the index: (seg, ids, n_words, terms, starts, docs, positions), a
    row for each segment. ``vocabulary`` (column term, binary) names the terms
    that are looked for; None: all terms."""
    shared = None
    if vocabulary is not None:
        place = F.crc32("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # bitmaps count from 1
        bits = vocabulary.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("b"))
        found = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in bits.collect():  # FILTER_BITS / 32,768 rows of 4 KB at most
            start = 4096 * (r["k"] - 1)
            found[start : start + 4096] = np.frombuffer(bytes(r["b"]), np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(found)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        return _index(batches, shared, most)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    schema = f"seg string, ids array<{id_type}>, n_words array<int>, terms array<binary>, starts array<int>, docs array<int>, positions array<int>"
    return written(narrow.mapInArrow(run, schema), "positional-index")


def test_terms(items: DataFrame, text_col: str = "text") -> DataFrame:
    """Each word of the items: (term)."""

    def run(batches):
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array(list({w for t in b.column("_text").to_pylist() for w in words(t)}), pa.binary())], names=["term"])

    return items.select(F.col(text_col).alias("_text")).mapInArrow(run, "term binary").distinct()


class Searcher:
    """Phrase and proximity queries on one segment."""

    def __init__(self, terms: list[bytes], starts: np.ndarray, docs: np.ndarray, positions: np.ndarray):
        self.at = {t: i for i, t in enumerate(terms)}
        self.starts = starts
        self.keys = docs.astype(np.int64) << 32 | positions

    def postings(self, term: bytes) -> np.ndarray | None:
        i = self.at.get(term)
        return None if i is None else self.keys[self.starts[i] : self.starts[i + 1]]

    def phrase(self, window: tuple[bytes, ...], order: tuple[int, ...], slack: int = 0) -> np.ndarray:
        """Keys (document << 32 | position) where the window begins. With
        ``slack``, each word may stand up to that many words off its place."""
        if any(w not in self.at for w in window):
            return np.empty(0, np.int64)
        k = order[0]
        left = self.postings(window[k]) - k
        left = left[(left & 0xFFFFFFFF) < 1 << 31] if k else left  # before the document's start
        for k in order[1:]:
            if not len(left):
                break
            right = self.postings(window[k])
            at = np.searchsorted(right, left + (k - slack))
            near = right[np.minimum(at, len(right) - 1)]
            # slack never reaches another document: positions are below 2**31
            left = left[(at < len(right)) & (near <= left + (k + slack)) & (near >= left + (k - slack))]
        return left


def _windows(texts: list[str | None], size: int) -> list[dict[tuple[bytes, ...], None]]:
    out = []
    for t in texts:
        w = words(t)
        out.append(dict.fromkeys([tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []))
    return out


def _search(batches: Iterator[pa.RecordBatch], block, id_type: pa.DataType, slack: int) -> Iterator[pa.RecordBatch]:
    queries = block.value  # [(window, order, [item numbers])], [item ids]
    for b in batches:
        for r in range(b.num_rows):
            values = lambda name, r=r, b=b: b.column(name)[r].values
            s = Searcher(values("terms").to_pylist(), values("starts").to_numpy(), values("docs").to_numpy(), values("positions").to_numpy())
            hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for window, order, items in queries[0]:
                for key in s.phrase(window, order, slack).tolist():
                    span = (key & 0xFFFFFFFF, (key & 0xFFFFFFFF) + len(window))
                    for i in items:
                        hits.setdefault((key >> 32, i), []).append(span)
            seg = b.column("seg")[r].as_py()
            spans = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
            rows = [(doc, queries[1][i], _joined(found)) for (doc, i), found in hits.items()]
            yield pa.RecordBatch.from_arrays([pa.array([seg] * len(rows), pa.string()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], id_type), pa.array([x[2] for x in rows], spans)], names=["seg", "ord", "item_id", "spans"])


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [{"a": a, "z": z} for a, z in out]


def _sizes(items: DataFrame) -> DataFrame:
    """(i, t, size: words) of the items that have words."""
    id_type = items.schema["i"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("t"), pa.array([len(words(t)) for t in b.column("t").to_pylist()], pa.int64())], names=["i", "t", "size"])

    return items.mapInArrow(run, f"i {id_type}, t string, size long").filter("size > 0")


def matches(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slack: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(seg, ord, item_id, spans): for each document and item with a match, the
    joined word ranges [a, z) where windows of the item stand. slack 0: exact
    phrases; else each word within ``slack`` words of its place (a range is
    then where the window would stand without slack).

    Items are dealt by a hash to blocks of about ``block_words`` words; one
    block at a time passes the driver. Terms are counted once for all of them.
    """
    spark = index.sparkSession
    import pyspark.sql.pandas.types as types

    kind = items.schema[item_col].dataType
    id_type = types.to_arrow_type(kind)
    schema = f"seg string, ord int, item_id {kind.simpleString()}, spans array<struct<a:int,z:int>>"
    sized = written(_sizes(items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))), "benchmark-items")
    total = sized.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    each = F.explode(F.arrays_zip(F.col("terms").alias("t"), F.expr("transform(slice(starts, 2, size(terms)), (x, i) -> x - starts[i])").alias("c"))).alias("x")
    counts = written(index.select(each).groupBy(F.col("x.t").alias("t")).agg(F.sum("x.c").alias("c")), "benchmark-terms")
    n_blocks = -(-total // block_words)
    found = None
    for k in range(n_blocks):
        held = [(r["i"], r["t"]) for r in sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k).collect()]
        by_window: dict[tuple[bytes, ...], list[int]] = {}
        for i, ws in enumerate(_windows([t for _, t in held], window)):
            for w in ws:
                by_window.setdefault(w, []).append(i)
        terms = sorted({t for w in by_window for t in w})
        wanted = spark.createDataFrame([(bytearray(t),) for t in terms], "t binary")
        n = {bytes(r["t"]): r["c"] for r in counts.join(F.broadcast(wanted), "t", "left_semi").collect()}
        queries = [(w, tuple(sorted(range(len(w)), key=lambda k, w=w: n[w[k]])), at) for w, at in by_window.items() if all(t in n for t in w)]
        block = spark.sparkContext.broadcast((queries, [i for i, _ in held]))

        def run(batches, block=block):
            return _search(batches, block, id_type, slack)

        part = index.select("seg", "terms", "starts", "docs", "positions").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    remove(sized)
    remove(counts)
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, segment: int = SEGMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Returns (id_col, n_words, n_hit, n_items, items_sha256, contaminated), a
    row for each row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter one; a document's word inside an occurrence of a window is hit. A
    null or empty text, of a document or an item, has no words and no windows.
    An item whose id is null hits words, but is not counted or named. Repeated
    item ids count once; repeated documents are kept, each with its result.
    Other columns are not read. An empty benchmark leaves all documents clean;
    no documents give an empty result. Texts of any length are indexed whole.
    """
    index = build_index(docs, test_terms(items, item_text_col), id_col, text_col, segment)
    found = matches(index, items, item_col, item_text_col, window, 0, block_words)
    per = found.groupBy("seg", "ord").agg(F.collect_set("item_id").alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    hit = F.expr("aggregate(s, struct(0 as z, 0L as n), (acc, x) -> struct(greatest(acc.z, x.z) as z, acc.n + greatest(0, x.z - greatest(acc.z, x.a)) as n), acc -> acc.n)")
    per = per.select("seg", "ord", "items", hit.alias("hit"))
    docs_of = index.select("seg", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ord", "d")).select("seg", "ord", F.col("d.ids").alias("id"), F.col("d.n_words").cast("long").alias("n_words"))
    joined = docs_of.join(per, ["seg", "ord"], "left")
    none = F.array().cast("array<string>")
    names = F.array_sort(F.coalesce(F.transform("items", lambda x: x.cast("string")), none))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a window of an item. Documents are told by
    id and a digest of id and text, so that repeated and null ids do no harm;
    only the (few) contaminated ones' keys are joined."""
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(id_col, text_col).alias("h"))
    found = contamination(docs.select(key.alias("k"), F.col(text_col).alias("t")), items, "k", "t", item_text_col=item_text_col)
    bad = written(found.filter("contaminated").select(F.col("k.i").alias("_i"), F.col("k.h").alias("_h")).distinct(), "contaminated")
    keyed = docs.withColumn("_clean_h", F.xxhash64(id_col, text_col))
    return keyed.join(bad, (keyed["_clean_h"] == bad["_h"]) & keyed[id_col].eqNullSafe(bad["_i"]), "left_anti").drop("_clean_h")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, k, p, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.p, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
hits AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT r, p, unnest(range(0, k)) AS o FROM m) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""

"""Filter interaction audit: what each of five filters removes in every order.

A document fails a set of filters, its mask. Per part, three counts of each
mask (documents, good ones, toxic ones) are all that any order needs. The 120
orders are visited by swapping two neighbours at a time; a swap changes what
the two swapped steps do and nothing else, so that only these two are counted
anew, from the cells. Shapley sums build up along the walk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, runs, slices, written

#: The filters in the order of their bits.
LETTERS = "ABCDE"
_CELLS = 1 << len(LETTERS)
_MARK = re.compile(r"[#$%&*|]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(text: str | None) -> int:
    """Bits of the filters A to D that a text fails; a null text is empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = 0, set()
    for run in runs(data, r"\x20\x09-\x0D"):
        words = run.split()  # of bytes: ASCII white space only
        n += len(words)
        distinct.update(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    return (n < 200) + 2 * (100 * len(distinct) < 50 * n) + 4 * (100 * upper > 2 * len(text)) + 8 * bool(_MARK.search(text))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        texts = b.column("_text").to_pylist()
        masks = pa.array(map(fails, texts), pa.int32())
        digests = pa.array([hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), masks, digests], names=["id", "part", "mask", "digest"])


def swaps(n: int) -> Iterator[int]:
    """The n! - 1 swaps of neighbours (i with i + 1) that lead through all
    orders of n things: the largest thing that can move in its direction does,
    and all larger ones turn round."""
    order, ahead = list(range(n)), [-1] * n
    while True:
        for x in reversed(range(n)):
            at = order.index(x)
            to = at + ahead[x]
            if 0 <= to < n and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            ahead[y] = -ahead[y]
        yield min(at, to)


@cache
def _step(bit: int, before: int) -> np.ndarray:
    """Which cells are kept, removed and redundant in the step of the filter
    ``bit`` after those of the mask ``before``."""
    cells = np.arange(_CELLS)
    fail, gone = (cells & bit) > 0, (cells & before) > 0
    return np.array([~fail & ~gone, fail & ~gone, fail & gone], np.int64)


def interactions(cells: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, the measures, shapley) of each order's steps.

    ``cells`` has three rows (documents, good, toxic) of a count a mask.
    """
    n = len(LETTERS)

    def measured(bit: int, before: int) -> tuple:
        kept, removed, redundant = (_step(bit, before) @ cells[0]).tolist()
        lost = _step(bit, before)[1]
        return kept, removed, redundant, int(cells[0][bit]), int(lost @ cells[1]), int(lost @ cells[2])

    order = [1 << i for i in range(n)]
    steps = [measured(bit, (1 << i) - 1) for i, bit in enumerate(order)]
    shapley, seen = dict.fromkeys(order, 0), []

    def visit() -> None:
        for bit, m in zip(order, steps, strict=True):
            shapley[bit] += m[1]
        seen.append((order[:], steps[:]))

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(order[:i])
        steps[i], steps[i + 1] = measured(order[i], before), measured(order[i + 1], before | order[i])
        visit()
    for bits, measures in seen:
        name = "".join(LETTERS[b.bit_length() - 1] for b in bits)
        for k, (b, m) in enumerate(zip(bits, measures, strict=True)):
            yield (name, k + 1, *m, shapley[b])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "filter_order", "step", *_MEASURES, "shapley"]
    for b in batches:
        for part, found in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
            cells = np.zeros((3, _CELLS), np.int64)
            for c in found:
                cells[:, c["mask"]] = c["n"], c["good"], c["toxic"]
            rows = list(zip(*interactions(cells), strict=True))
            cols = [pa.array([part] * len(rows[0])), pa.array(rows[0]), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Returns (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    The filters: A under 200 words; B fewer than half of the words distinct;
    C over 2 % of the code points are A-Z; D one of ``#$%&*|``; E the text of a
    smaller id, anywhere in the table. A null text is empty, a null part the
    empty string. A null id is neither smaller nor greater than another, so
    that it fails E never and makes no other row fail it; rows with equal id and
    text do not fail E for each other. Of repeated labels of an id a 1 counts
    before others; null labels count as none. Texts are taken in runs, whatever
    their length. An empty table gives an empty result. Other columns are not
    read. A part's cells are 32 rows at most, however many documents it has.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = written(narrow.mapInArrow(_run, f"id {id_type}, part string, mask int, digest binary"), "audit-rows")
    # read from a table, so that Spark can split a text that very many rows have
    copies = written(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least"), "audit-copies")
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = written(marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).filter("good or toxic"), "audit-labels")
    full = rows.join(copies, "digest", "left").join(marks, "id", "left")
    full = full.select("part", (F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"), "good", "toxic")
    counts = [F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    cells = full.groupBy("part", "mask").agg(*counts).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    cells = written(cells, "audit-cells")
    for spent in (rows, copies, marks):
        remove(spent)
    return cells.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*_MEASURES, "shapley")))


#: The same in SQL.
SQL = r"""
WITH base AS (
  SELECT doc_id AS id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marked AS (
  SELECT b.id, part,
         (len(words) < 200)::INT
         + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(b.id > min(b.id) OVER (PARTITION BY t), false)::INT AS mask FROM base b
), lab AS (
  SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marked LEFT JOIN lab USING (id) GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND list_unique([a.bit, b.bit, c.bit, d.bit, e.bit]) = 5
), steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(s)
), out AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM out
"""

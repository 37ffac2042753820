"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit
in one of their two halves. Each half is a table; a fingerprint looks up, in
each table, its own half and the 32 values one bit away, and what it meets is
verified on all 64 bits.

Equal fingerprints are one class before anything is compared. Dense crowds of
near copies would still meet in squares, so links of up to two bits are first
closed without pairs: fingerprints that share a point one bit away from both
are within two bits of each other, at most 65 of them share a point, and each
is linked to the least of them. After that only lookups between different
components are left: a lookup first meets a summary of its key, and goes no
further where all that stands there is of its own component.

A key under which very many fingerprints stand is divided: the other half is
within 3 bits, so of its six segments three are equal, and a lookup goes on
under each choice of three. What shares 48 bits is at most 65,536 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import merged, remove, runs, slices, written
from ._graph import components

_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_STEP = 100_000
#: Fingerprints of a key from which on it is divided.
HOT = 100
#: Bits of the six segments of a half, the lowest first, and all choices of three as masks.
SEGMENTS = (5, 5, 5, 5, 6, 6)
MASKS = [sum((1 << SEGMENTS[i]) - 1 << sum(SEGMENTS[:i]) for i in three) for three in combinations(range(6), 3)]


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, as a signed 64-bit integer; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ones, n, before = np.zeros(64, np.int64), 0, []
    for run in runs(data, r"\x20\x09-\x0D"):
        words = before + run.lower().split()  # of bytes: A-Z only, ASCII white space only
        size = max(0, len(words) - 2)
        ones += _set_bits(map(b" ".join, zip(words, words[1:], words[2:], strict=False)), size)
        n += size
        before = words[-2:]
    if not n and before:
        ones, n = _set_bits([b" ".join(before)], 1), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _set_bits(shingles, n: int) -> np.ndarray:
    """How many of the n shingles' hashes have each bit set."""
    ones, hashes = np.zeros(64, np.int64), map(_HASH, shingles)
    for at in range(0, n, _STEP):
        h = np.fromiter(hashes, np.uint64, min(_STEP, n - at))
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return ones


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        prints = [fingerprint(t) for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(prints, pa.int64())], names=["id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) for each row: h is a digest of id and text, fp a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), row_digest(id_col, text_col).alias("h"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(_run, f"id {id_type}, h struct<a:bigint,b:bigint>, fp long")


def row_digest(id_col: str, text_col: str) -> Column:
    """128 bits that tell a row by id and text; never null."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), id_col, text_col).alias("b"))


def _halves(fp: Column) -> list[Column]:
    """Each half, marked with which one it is."""
    low = F.lit(0xFFFFFFFF)
    return [fp.bitwiseAND(low), F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _parts(fp: str, key: str) -> Column:
    """The values, each marked with its choice, of three segments of that half
    of ``fp`` that ``key`` does not stand for."""
    low, high = _halves(F.col(fp))
    other = F.when(F.col(key) >= 1 << 32, low).otherwise(high)
    return F.explode(F.array(*(other.bitwiseAND(F.lit(m)).bitwiseOR(F.lit(i << 33)) for i, m in enumerate(MASKS))))


def roots(prints: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """(node, root) for the distinct fingerprints ``prints`` (column fp); root
    is the least fingerprint that can be reached by links of at most
    ``radius`` = 3 bits."""
    if radius != 3:
        raise ValueError("two halves with one bit each are made for 3 bits")
    fp = F.col("fp")
    ball = prints.select("fp", F.explode(F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("w"))
    near = ball.select("fp", F.min("fp").over(Window.partitionBy("w")).alias("m")).filter("fp != m")
    close = components(near.select(F.col("fp").alias("a"), F.col("m").alias("b")))
    marked = merged(prints, close.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("c"))
    marked = written(marked, "simhash-close")
    remove(close)

    halves = _halves(fp)
    tables = marked.select(fp.alias("tf"), F.col("c").alias("tc"), F.explode(F.array(*halves)).alias("key"))
    keys = F.array(*(h.bitwiseXOR(F.lit(m)) for h in halves for m in [0, *(1 << i for i in range(32))]))
    probes = marked.select(fp.alias("pf"), F.col("c").alias("pc"), F.explode(keys).alias("key"))
    others = ~((F.col("low") == F.col("pc")) & (F.col("high") == F.col("pc")))
    ends = [F.min("tc").alias("low"), F.max("tc").alias("high")]
    found = written(merged(probes, tables.groupBy("key").agg(F.count("*").alias("n"), *ends), "key").filter(others).select("pf", "pc", "key", "n"), "simhash-found")
    linked = (F.col("pf") < F.col("tf")) & (F.col("pc") != F.col("tc")) & (F.bit_count(F.col("pf").bitwiseXOR(F.col("tf"))) <= radius)
    edge = [F.col("pc").alias("a"), F.col("tc").alias("b")]
    met = merged(found.filter(F.col("n") <= hot).select("pf", "pc", "key"), tables, "key").filter(linked).select(*edge)
    divided = merged(tables, found.filter(F.col("n") > hot).select("key").distinct(), "key").select("tf", "tc", "key", _parts("tf", "key").alias("part"))
    asked = found.filter(F.col("n") > hot).select("pf", "pc", "key", _parts("pf", "key").alias("part"))
    asked = merged(asked, divided.groupBy("key", "part").agg(*ends), ["key", "part"]).filter(others).select("pf", "pc", "key", "part")
    met = met.union(merged(asked, divided, ["key", "part"]).filter(linked).select(*edge))
    far = components(met)
    out = written(merged(marked, far.withColumnRenamed("node", "c"), "c", "left").select(fp.alias("node"), F.coalesce("root", "c").alias("root")), "simhash-roots")
    for spent in (marked, found, far):
        remove(spent)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id_col, h, fp, root, component_id), a row for each row.

    Texts are lower-cased in A-Z and split at ASCII white space; the features
    are 3-word shingles with repeats (fewer words: the whole sequence), hashed
    by XXH64 with seed 42. A bit is set if it is in over half of the hashes.
    A null text, an empty one and one of white space only have fingerprint 0
    and link like others. component_id is the smallest id of the component,
    null ids aside (null if it has none else). Repeated ids and rows are kept.
    Texts of any length are whole, hashed in steps of bounded size.
    Ties are none: the smallest id names a component, however many rows have
    it. Other columns are not read. An empty table gives an empty result. h is a
    digest of id and text, root the least fingerprint of the component.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    linked = roots(prints.select("fp"))
    groups = written(merged(prints, linked.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    least = written(groups.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = written(merged(groups, least, "root").select("fp", "root", "component_id"), "simhash-groups")
    for spent in (prints, linked, groups, least):
        remove(spent)
    return merged(rows, named, "fp").select(F.col("id").alias(id_col), "h", "fp", "root", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which no near-duplicate has a smaller id: one
    row of each component. Of equal rows one stays; a null id comes last.
    Whole rows are dealt out once, by the digest of id and text."""
    found = near_duplicates(docs, id_col, text_col)
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("h"))
    stay = found.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.h").alias("_dedup_h"))
    keyed = docs.withColumn("_dedup_h", row_digest(id_col, text_col)).dropDuplicates(["_dedup_h"])
    return merged(keyed, stay, "_dedup_h", "left_semi").select(*docs.columns)

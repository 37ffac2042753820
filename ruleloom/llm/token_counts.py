"""Token counts of whole texts, huge ones in overlapping chunks.

A text up to ``chunk`` characters is counted where it stands. A longer one is
cut into overlapping chunks that are spread over the executors and encoded
there with offsets. Two neighbouring chunks are spliced at a place inside
their overlap where both have a token boundary and where the byte-level pattern
begins a piece whatever stands around: between two of letters, digits, marks
and white space, but for what may stick together (a space and what follows, an
apostrophe and letters). Of these places the middle one is taken. Where an
overlap has none, as in a long run of letters, that overlap alone is made ten
times as wide, and only the two chunks at it are encoded again; once it would
cover a chunk, the chunks around it become one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _ids
from ._common import remove, slices, written

#: Characters of a chunk, and of the overlap that a text is first tried with; how much wider an overlap gets when it fails.
CHUNK, OVERLAP, WIDER = 50_000, 500, 10
#: Characters whose class no version of Unicode disputes: letters, digits, marks.
_L = r"[\p{L}&&[\u0000-՗א-ۓऄ-हぁ-ヾ㐀-䶵一-龥가-힣]]"
_P = r"[[!-¿‐-‧‰-⁞、-〠！-／：-＠]--[\p{L}\p{N}\p{M}\s']]"
_W, _N = f"[{_ids.WHITE}]", "[0-9]"
#: A proven boundary is where one of these matches the empty string.
PROVEN = regex.compile(rf"(?<={_L})(?=(?:{_N}|{_P}|{_W}|'))|(?<={_N})(?=(?:{_L}|{_P}|{_W}|'))|(?<={_P})(?=(?:{_L}|{_N}|{_W}))|(?<=')(?={_W})|(?<=[{_W}--[ ]])(?=(?:{_L}|{_N}|{_P}|'))", regex.V1)
_CHUNK_ROW = "key string, a long, head int, tail int, chunk string"
_RESULT = "key string, a long, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"
_LAYOUT = "starts array<long>, widths array<long>, todo array<boolean>"


def _small(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _ids.load(path)
    for b in slices(batches, "_text", 1_000_000, ("ids", path)):
        n = [sum(map(len, encoder.packed(t))) // encoder.dtype.itemsize if t else 0 for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks to do of each text; a task cuts copies of a text once."""
    seen: set[str] = set()
    for b in slices(batches, "_text", 1_000_000):
        for key, text, starts, widths, todo in zip(*(b.column(c).to_pylist() for c in ("key", "_text", "starts", "widths", "todo")), strict=True):
            if key in seen:
                continue
            seen.add(key)
            for i, a in enumerate(starts):
                if todo[i]:
                    last = i + 1 == len(starts)
                    chunk = text[a:] if last else text[a : starts[i + 1] + widths[i]]
                    row = [key], [a], [widths[i - 1] if i else 0], [0 if last else widths[i]], [chunk]
                    kinds = pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, row, kinds)), names=["key", "a", "head", "tail", "chunk"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """For each chunk: how many tokens it has, and the places in its first
    ``head`` and last ``tail`` characters where a boundary is proven and found,
    with the number of the chunk's tokens before each."""
    encoder = _ids.load(path)
    margin = max([1, *map(len, encoder.specials)])
    for b in slices(batches, "chunk", 1_000_000, ("ids", path)):
        rows = []
        for a, head, tail, text in zip(*(b.column(c).to_pylist() for c in ("a", "head", "tail", "chunk")), strict=True):
            starts = encoder.starts(text)
            before = {s: i for i, s in reversed(list(enumerate(starts)))}

            def edge(low: int, high: int, text=text, before=before, a=a) -> tuple[list[int], list[int]]:
                at = (m.start() for m in PROVEN.finditer(text, max(0, low), high))
                # an added token that stands at the place must be seen whole from both chunks
                found = [(x, before[x]) for x in at if margin <= x <= len(text) - margin and x in before]
                return [a + x for x, _ in found], [n for _, n in found]

            rows.append((len(starts), *edge(0, min(head, len(text))), *edge(len(text) - tail, len(text))))
        cols = list(zip(*rows, strict=True))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("a"), pa.array(cols[0], pa.int64()), *(pa.array(c, longs) for c in cols[1:])], names=["key", "a", "n", "head_at", "head_n", "tail_at", "tail_n"])


def relaid(starts: list[int], widths: list[int], failed: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """Starts, widths and what to encode again after the overlaps ``failed``."""
    starts, widths, todo = starts[:], widths[:], [False] * len(starts)
    joined = set()
    for i in failed:
        widths[i] *= WIDER
        if i + 2 >= len(starts) or widths[i] >= starts[i + 2] - starts[i + 1]:
            joined.add(i + 1)
        todo[i] = todo[i + 1] = True
    out: tuple[list, list, list] = [], [], []
    for i, (a, w, t) in enumerate(zip(starts, widths, todo, strict=True)):
        if i in joined:
            out[1][-1], out[2][-1] = w, True
        else:
            for column, value in zip(out, (a, w, t), strict=True):
                column.append(value)
    return out


def _splice(layout, results):
    """Tokens of one text from its chunks' rows; -1 and a new layout where an
    overlap has no common proven boundary."""
    import pandas as pd

    key, starts, widths = layout["key"].iloc[0], list(map(int, layout["starts"].iloc[0])), list(map(int, layout["widths"].iloc[0]))
    by_start = {r["a"]: r for r in results.sort_values("round").to_dict("records")}
    recs = [by_start[a] for a in starts]
    total, begun, failed = 0, 0, []
    for i, (left, right) in enumerate(zip(recs, recs[1:], strict=False)):
        tail = dict(zip(left["tail_at"], left["tail_n"], strict=True))
        head = dict(zip(right["head_at"], right["head_n"], strict=True))
        common = sorted(set(tail) & set(head))
        if not common:
            failed.append(i)
            continue
        at = common[len(common) // 2]
        total += int(tail[at]) - begun
        begun = int(head[at])
    total += int(recs[-1]["n"]) - begun
    starts, widths, todo = relaid(starts, widths, failed)
    return pd.DataFrame({"key": [key], "n_tokens": [-1 if failed else total], "starts": [starts], "widths": [widths], "todo": [todo]})


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Returns (id_col, n_bytes, n_tokens, over_limit), a row for each row.

    Counts are those of the tokenizers library's encode() on the whole text
    without added special tokens; strings of special tokens in a text count as
    the library takes them by default. A null or empty text has 0 bytes and 0
    tokens. Null and repeated ids and repeated rows are kept. Other columns
    are not read. An empty table gives an empty result. A text of any length
    is counted; those over ``chunk`` characters are spread by chunks. Only what
    is one piece of the pattern, such as letters without anything between them,
    is never cut.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    is_huge = F.coalesce(F.length("_text") > chunk, F.lit(False))

    def small(batches):
        return _small(batches, tokenizer_path)

    out = narrow.filter(~is_huge).mapInArrow(small, f"id {id_type}, n_bytes long, n_tokens long")
    # a huge text is known by its digest throughout, so that equal ones are encoded once and no row can miss its count
    huge = narrow.filter(is_huge).withColumn("key", F.sha2(F.col("_text").cast("binary"), 256))
    counts = _counted(huge, tokenizer_path, chunk, overlap)
    n_tokens = F.coalesce("n_tokens", F.raise_error(F.lit("a huge text has no count")).cast("long")).alias("n_tokens")
    counted = huge.select("_id", "n_bytes", "key").join(counts, "key", "left").select(F.col("_id").alias("id"), "n_bytes", n_tokens)
    out = out.unionByName(counted)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counted(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of the huge texts (key, _text)."""

    def encode(batches):
        return _encode(batches, path)

    parts = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - overlap - 1, F.lit(chunk).cast("long"))
    laid = [starts.alias("starts"), F.transform(starts, lambda x: F.lit(overlap).cast("long")).alias("widths"), F.transform(starts, lambda x: F.lit(True)).alias("todo")]
    sized = huge.withColumn("size", F.length("_text"))
    layout = written(sized.select("key", "size").dropDuplicates(["key"]).select("key", *laid), "token-layout")
    texts, results, counts, spent = sized.select("key", "_text", *laid), None, None, [layout]
    for k in itertools.count():
        chunks = texts.mapInArrow(_cut, _CHUNK_ROW).repartition(parts, "key", "a").dropDuplicates(["key", "a"])
        new = written(chunks.mapInArrow(encode, _RESULT).withColumn("round", F.lit(k)), "token-chunks")
        results = results.join(layout.select("key"), "key", "left_semi").unionByName(new) if k else new
        spliced = layout.groupBy("key").cogroup(results.groupBy("key")).applyInPandas(_splice, f"key string, n_tokens long, {_LAYOUT}")
        spliced = written(spliced, "token-counts")
        spent.append(new)
        done, layout = spliced.filter("n_tokens >= 0").select("key", "n_tokens"), spliced.filter("n_tokens < 0").drop("n_tokens")
        counts = done if counts is None else counts.unionByName(done)
        if layout.isEmpty():
            break
        texts = huge.select("key", "_text").join(layout, "key")
    for table in spent:
        remove(table)
    return counts

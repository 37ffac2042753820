"""Mixture-controlled packing of documents into token sequences.

Each source is a queue of token ids. Deficit round-robin serves the queues: in
a round, which fills a window of ``window`` tokens, a queue's deficit grows by
its quantum, the target share of the window, and as many whole tokens go out;
what is left, a part of a token, is carried to the next window. Quanta are
integers in 65,536ths of a token, so that what a queue has sent after a round
is known without going through the rounds before, and each task goes on where
the others, before it in the queues, leave off: with their deficits. The output
is cut into sequences; the rest behind the last full one is cut into powers of
two, which need no padding.

Ids are written once, with their place in the task's part of the queue. Sums by
(task, queue) give where each part begins in its queue; then every document's
pieces follow from its own row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import slices, written
from ._ids import load

LENGTH = 1024
#: Parts of a token in which quanta are counted, as a power of two.
FINE = 16
#: Most queues of a mixture; sources beyond share queues by hash.
QUEUES = 4096
#: Segments that are worked out at once.
_STEP = 100_000


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of each text and the closing 0, and the tokens of the same queue
    that this task has met before."""
    encoder, task, met = load(path), TaskContext.get().partitionId(), {}
    for b in slices(batches, "_text", 1_000_000, ("ids", path)):
        ids, n, at = [], [], []
        queues = b.column("queue").to_pylist()
        end = bytes(encoder.dtype.itemsize)
        for queue, text in zip(queues, b.column("_text").to_pylist(), strict=True):
            packed = b"".join([*encoder.packed(text or ""), end])
            size = len(packed) // encoder.dtype.itemsize
            ids.append(packed)
            n.append(size)
            at.append(met.get(queue, 0))
            met[queue] = at[-1] + size
        cols = [b.column("id"), b.column("queue"), pa.array([task] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "queue", "task", "at", "n", "ids"])


class Mixture:
    """The rounds of queues of ``totals`` tokens that send ``quanta`` a round
    (int64, in parts of a token); all results are exact."""

    def __init__(self, totals, quanta, length: int = LENGTH):
        self.totals, self.quanta, self.length = np.asarray(totals, np.int64), np.asarray(quanta, np.int64), length
        self.last = -(-(self.totals << FINE) // self.quanta) - 1  # a queue's last round
        total = int(self.totals.sum())
        self.full = total // length
        rest, tail = total % length, [self.full * length]
        for bit in range(length.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        self.tail = np.array(tail, np.int64)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has sent when a round (row) is over."""
        r = rounds[:, None]
        return np.where(r >= self.last, self.totals, (self.quanta * (np.minimum(r, self.last) + 1)) >> FINE)

    def round_of(self, queue: int, at: int) -> int:
        """The round in which the queue sends its token number ``at``."""
        return -((-(at + 1) << FINE) // int(self.quanta[queue])) - 1

    def rounds(self, queue: int, at: int, n: int) -> np.ndarray:
        """The rounds in which the queue sends its tokens [at, at + n)."""
        if self.quanta[queue] >> FINE:
            return np.arange(self.round_of(queue, at), self.round_of(queue, at + n - 1) + 1)
        return -((-(np.arange(at, at + n) + 1) << FINE) // self.quanta[queue]) - 1  # a token a round at most, and none in others

    def segments(self, queue: int, at: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of the queue's tokens [at, at + n) that stay together: where
        each begins in the queue and in the output, and its length."""
        step = max(1, 50 * _STEP // len(self.totals)) * max(1, int(self.quanta[queue]) >> FINE)
        for low in range(at, at + n, step):
            high = min(low + step, at + n)
            rounds = self.rounds(queue, low, high - low)
            now, before = self.sent(rounds), self.sent(rounds - 1)
            begin, end = np.maximum(before[:, queue], low), np.minimum(now[:, queue], high)
            # what the queues ahead of this one have sent in this round, and the others in the rounds before
            out = now[:, :queue].sum(1) + before[:, queue:].sum(1) + begin - before[:, queue]
            fresh = np.hstack([True, out[1:] != (out + end - begin)[:-1]])  # else the others sent nothing in between
            yield begin[fresh], out[fresh], np.add.reduceat(end - begin, np.flatnonzero(fresh))

    def sequence(self, out: np.ndarray) -> np.ndarray:
        """The sequence in which a place of the output lies."""
        return np.where(out < self.full * self.length, out // self.length, self.full - 1 + np.searchsorted(self.tail, out, "right"))

    def begins(self, sequence: np.ndarray) -> np.ndarray:
        """Where a sequence begins in the output."""
        return np.where(sequence <= self.full, sequence * self.length, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])

    def pieces(self, queue: int, at: int, n: int) -> Iterator[np.ndarray]:
        """Rows (start in the document, length, sequence, offset) of a document
        whose n tokens stand from ``at`` on in its queue."""
        for begin, out, size in self.segments(queue, at, n):
            first, last = self.sequence(out), self.sequence(out + size - 1)
            many = last - first + 1
            which = np.repeat(np.arange(len(out)), many)
            seq = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            a, z = np.maximum(out[which], self.begins(seq)), np.minimum((out + size)[which], self.begins(seq + 1))
            yield np.stack([begin[which] - at + (a - out[which]), z - a, seq, a - self.begins(seq)])


def _pack(batches: Iterator[pa.RecordBatch], mixture: Mixture, places: dict[str, int], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "ids"):
        rows, found, checks = [], [], []
        kept = 0
        queues, ats, ns, ids = (b.column(c).to_pylist() for c in ("queue", "at", "n", "ids"))
        for i, (queue, at, n, packed) in enumerate(zip(queues, ats, ns, ids, strict=True)):
            wide = memoryview(np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes())
            for p in mixture.pieces(places[queue], at, n):
                found.append(p)
                rows.append(np.full(p.shape[1], i))
                checks += [zlib.crc32(wide[4 * a : 4 * (a + k)]) for a, k in zip(p[0].tolist(), p[1].tolist(), strict=True)]
                kept += p.shape[1]
                if kept > _STEP:
                    yield _rows(b, rows, found, checks)
                    rows, found, checks, kept = [], [], [], 0
        if kept:
            yield _rows(b, rows, found, checks)


def _rows(b: pa.RecordBatch, rows: list, found: list, checks: list) -> pa.RecordBatch:
    which, p = pa.array(np.concatenate(rows)), np.concatenate(found, 1)
    cols = [b.column("id").take(which), pa.array(p[0]), pa.array(p[1]), pa.array(checks, pa.int64()), b.column("n").take(which), pa.array(p[2]), pa.array(p[3])]
    return pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def quanta(totals: dict[str, int], window: int, targets: dict[str, float] | None) -> list[int]:
    """Each queue's quantum, in parts of a token, for a window: its share of
    all tokens, or of the targets."""
    if targets is None:
        whole = sum(totals.values())
        return [-(-(n * window << FINE) // whole) for n in totals.values()]
    if any(targets.get(q, 0) <= 0 for q in totals):
        raise ValueError("each source needs a target above 0")
    whole = sum(targets[q] for q in totals)
    return [max(1, round(targets[q] / whole * (window << FINE))) for q in totals]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window: int | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    A document is its text's ids (a null text: none) and the id 0. Returns
    (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row
    a piece: ``start`` of its document's ids go before it, it has ``length``,
    and stands at ``offset`` of its sequence; ids_crc32 is that of its ids as
    little-endian unsigned 32-bit integers. Every id is in one piece, and every
    sequence but the last few has ``length`` tokens; these have powers of two.

    A window (a sequence, unless ``window`` says otherwise) holds each source's
    target share to a token: its share of all tokens, or of ``targets`` (source
    to weight, above 0 for each). When a source is through, the others share what
    it leaves. A null source is the queue
    of the empty one. Over 4,096 sources share as many queues by hash. Queues
    are in the order of the table, so that another partitioning of it packs
    otherwise. Null and repeated ids and repeated rows are documents of their
    own. Other columns are not read. An empty table gives an empty result. A
    text of any length is encoded in runs and packed in steps.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if docs.select(queue.alias("q")).distinct().limit(QUEUES + 1).count() > QUEUES:
        if targets is not None:
            raise ValueError(f"targets are for {QUEUES} sources at most")
        queue = F.pmod(F.xxhash64(queue), F.lit(QUEUES)).cast("string")

    def encode(batches):
        return _encode(batches, tokenizer_path)

    narrow = docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).alias("_text"))
    rows = written(narrow.mapInArrow(encode, f"id {id_type}, queue string, task int, at long, n long, ids binary"), "packing-ids", compression="zstd")
    parts = written(rows.groupBy("task", "queue").agg(F.sum("n").alias("n")), "packing-parts")
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(parts.select("task", "queue", F.coalesce(before, F.lit(0)).alias("first")), "packing-starts")
    mixture = Mixture(list(totals.values()), quanta(totals, window or length, targets), length)
    places, width = {q: i for i, q in enumerate(totals)}, load(tokenizer_path).dtype.itemsize

    def run(batches):
        return _pack(batches, mixture, places, width)

    placed = rows.join(starts, ["task", "queue"]).select("id", "queue", (F.col("at") + F.col("first")).alias("at"), "n", "ids")
    out = placed.mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)

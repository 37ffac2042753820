"""Byte-level BPE by backtracking over Aho-Corasick matches.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton over
the vocabulary finds every token at every byte of a piece in one pass. The
encoder walks the piece, takes the longest token that ends at a still open
position and that may follow the token before it, and steps back when none
does. Each byte position is closed at most once, and a search for a token sees
a token's length of the piece, so that a piece of n bytes costs O(n). Two adjacent tokens are compatible if merging their joined
bytes by rank gives just these two tokens; that is memoised. A sequence whose
neighbours are all compatible is the one that the ranked merges give.

Pieces are the matches of the pattern. Where a single space stands between two
characters that are no white space, a piece always begins, whatever stands
around; texts are cut there and the encodings of the cuts are memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held, slices

#: Entries of each generation of a worker's memos.
MEMO = 125_000
#: Characters of a run of a very long text.
RUN = 1_000_000
_BETWEEN = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


class Memo:
    """A dictionary of two generations: entries that are used stay, the others
    go when the younger generation is full."""

    def __init__(self, most: int = MEMO):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ByteBpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks), default=0)
        self.all_bytes = all(bytes([i]) in ranks for i in range(256))  # then a token begins at every byte
        self._shorter: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}  # by left << 32 | right
        self._pieces = Memo()
        self._spans = Memo()

    # one piece

    def merged(self, data: bytes) -> list[int]:
        """The ranked merges themselves, for the short strings of a pair."""
        if len(data) > 1000:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a heap of the pairs that may merge, the first of a rank first."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place, and the part before it
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        gone = bytearray(n + 1)

        def join(i: int) -> None:
            if i >= 0 and end[i] < n:
                to = end[end[i]]
                r = rank(data[i:to])
                if r is not None:
                    heappush(heap, (r, i, to))

        while heap:
            _, i, to = heappop(heap)
            if gone[i] or end[i] >= to or end[i] == n or end[end[i]] != to:
                continue  # one of the two has merged with another since
            gone[end[i]] = 1
            end[i] = to
            if to < n:
                before[to] = i
            join(i)
            join(before[i])
        return [self.ranks[data[i : end[i]]] for i in range(n) if not gone[i]]

    def shorter(self, token: int) -> int:
        """The longest other token that ``token`` begins with, or -1."""
        found = self._shorter.get(token)
        if found is None:
            data = self.bytes_of[token]
            found = next((r for k in range(len(data) - 1, 0, -1) if (r := self.ranks.get(data[:k])) is not None), -1)
            self._shorter[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``? For left = -1: may it stand alone?"""
        if left < 0:
            ok = self.merged(self.bytes_of[right]) == [right]
        else:
            ok = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        if len(self._pairs) >= 2 * MEMO:
            self._pairs.clear()
        self._pairs[left << 32 | right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not self.all_bytes:
            return self.merged(piece)
        n, chars, longest, most = len(piece), piece.decode("latin-1"), self.automaton.iter_long, self.longest
        # a search takes time with the string that it is given: of a long piece it gets a token's length
        short = n <= 4 * most
        known, bytes_of = self._pairs.get, self.bytes_of
        closed = bytearray(n + 1)
        out: list[int] = []
        pos, last, token = 0, -1, next(longest(chars[:most]))[1]
        while True:
            end = pos + len(bytes_of[token])
            if not closed[end]:
                ok = known(last << 32 | token)
                if ok or ok is None and self.fits(last, token):
                    out.append(token)
                    if end == n:
                        return out
                    pos, last, token = end, token, next(longest(chars, end) if short else longest(chars[end : end + most]))[1]
                    continue
            token = self.shorter(token)
            if token < 0:
                if not out:
                    return self.merged(piece)  # a token that no merges lead to
                closed[pos] = 1
                token = out.pop()  # its end is closed now: a shorter one is next
                pos -= len(bytes_of[token])
                last = out[-1] if out else -1

    # texts

    def _span(self, span: str) -> bytes:
        pieces, out = self._pieces, []
        for m in self.pattern.findall(span):
            packed = pieces.get(m)
            if packed is None:
                packed = array("I", self.encode_piece(m.encode("utf-8", "surrogatepass"))).tobytes()
                if len(m) <= 64:
                    pieces.put(m, packed)
            out.append(packed)
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        spans = self._spans
        parts = text.split(" ")
        first = parts[0]
        if len(parts) == 1:
            return self._span(first)
        found = list(map(spans.young.get, parts))
        found[0] = b""
        missing = [i for i, x in enumerate(found) if x is None]
        if not _solid_end(first) or not all(_solid(parts[i]) for i in missing):
            return b"".join(map(self._span, cuts(text)))
        found[0] = self._span(first)
        for i in missing:
            p = parts[i]
            packed = spans.get(p)
            if packed is None:
                packed = self._span(" " + p)
                if len(p) <= 64:
                    spans.put(p, packed)
            found[i] = packed
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _solid_end(s: str) -> bool:
    return bool(s) and not s[-1].isspace()


def _solid(s: str) -> bool:
    return bool(s) and not s[0].isspace() and not s[-1].isspace()


def cuts(text: str) -> Iterator[str]:
    """Cuts a text before each single space that stands between two characters
    that are no white space; a piece of the pattern begins there in any text."""
    held: list[str] = []
    before = ""
    for k, part in enumerate(text.split(" ")):
        if k and before and not before[-1].isspace() and part and not part[0].isspace():
            yield "".join(held)
            held = []
        held.append(" " + part if k else part)
        before = part
    yield "".join(held)


def long_runs(text: str, most: int = RUN) -> Iterator[str]:
    """Cuts a very long text where ``cuts`` does too, but seldom, so that its
    spans and ids are never all held at once."""
    start = 0
    while len(text) - start > most:
        m = _BETWEEN.search(text, start + most)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def load(path: str, pattern: str) -> ByteBpe:
    """Reads a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return ByteBpe(ranks, pattern)


class _Whole:
    """Takes bytes as a digest does, and keeps them."""

    def __init__(self):
        self.parts: list[bytes] = []

    def update(self, part: bytes) -> None:
        self.parts.append(part)

    def whole(self) -> bytes:
        return b"".join(self.parts)


def _run(batches: Iterator[pa.RecordBatch], path: str, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    key = ("byte_bpe", path, pattern)
    bpe = held(key, lambda: load(path, pattern))
    new = hashlib.sha256 if digests else _Whole
    for b in slices(batches, "_text", keep=key):
        ids = b.column("_id")
        n, first, second = [], [], []
        for text in b.column("_text").to_pylist():
            size, packed, decoded = 0, new(), new()
            for run in long_runs(text or ""):
                some = bpe.encode_packed(run)
                size += len(some) // 4
                packed.update(some)
                decoded.update(bpe.decode(array("I", some)))
            n.append(size)
            first.append(packed.hexdigest() if digests else packed.whole())
            second.append(decoded.hexdigest() if digests else decoded.whole())
        kind = pa.string() if digests else pa.binary()
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, kind)], names=["id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes each text, decodes the ids, and returns both.

    Returns (id_col, n_tokens, ids, decoded): ids as little-endian unsigned
    32-bit integers in a binary, decoded as binary; with ``digests`` their
    SHA-256 in lower-case hex instead. One row per row of ``docs``, with no
    shuffle: a lost executor costs its own partitions only.

    A null or empty text has no tokens and decodes to no bytes. Null and
    repeated ids and repeated rows are kept as they are. Other columns of
    ``docs``, whatever their names, are not read. An empty table gives an
    empty result. A text of any length is encoded whole, a very long one in runs
    between words, of which only digests are kept where these are asked for; a
    piece of n bytes takes O(n) steps and memory.
    """
    id_type = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = "string" if digests else "binary"

    def run(batches):
        return _run(batches, ranks_path, pattern, digests)

    out = narrow.mapInArrow(run, f"id {id_type.simpleString()}, n_tokens long, ids {kind}, decoded {kind}")
    return out.withColumnRenamed("id", id_col)

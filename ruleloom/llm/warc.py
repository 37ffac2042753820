"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames. Each frame holds a few
whole records; after the last one stands a seek table, a skippable frame with
the compressed and the decompressed size of every frame. The index maps each
record's identifier to (bundle, frame, offset in the decompressed frame), so
that one record is read by decompressing one frame.

Bundles are written by the tasks to the shared folder, each under a name of the
task attempt's own. The index that is committed tells which bundles count: what
an attempt leaves behind that was lost, or that ran beside another one, is
never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, work_path, written

#: Fixed values of the seekable format: magic of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Decompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME, BUNDLE = 256 * 1024, 64 * 1024 * 1024
#: Frames of a bundle that are read back together.
RUN = 16
#: Only payloads of at least so many bytes are replaced by a reference.
LEAST = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, sha1: str, nth: str = "") -> str:
    """A response is known by page and digest alone, so that a revisit can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {sha1} {nth}')}>"


def record(kind: str, ident: str, page: str, url: str | None, payload: bytes, sha1: str, refers: tuple[str, str] | None = None) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"X-Page: {page}"]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}", f"X-Refers-To-Page: {refers[1]}"]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record at an offset, and where it ends."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    return head, data[start : start + size], start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: sizes of each frame, then the
    number of frames, a descriptor (no checksums) and the magic."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Bundle:
    """Reads one bundle by its seek table."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if descriptor & 0x80 else 8
        table = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for k in range(n):
            c, d = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, c, d))
            at += c

    def frame(self, k: int) -> bytes:
        at, c, d = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(c, at), max_output_size=max(d, 1)) if d else b""

    def record(self, k: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(k), offset)[:2]

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, folder: str, part: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.part, self.k, self.packer = part, 0, zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.out = None

    def _open(self):
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"part-{self.part}-{self.k:04d}.warc.zst"
        self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.frames, self.held, self.size, self.rows, self.written = [], [], 0, [], 0
        self.k += 1

    def add(self, data: bytes, ident: str) -> list[tuple]:
        """Returns index rows once their bundle is closed."""
        if self.out is None:
            self._open()
        self.rows.append((ident, self.name, len(self.frames), self.size))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self._flush()
        return self.close() if self.written >= BUNDLE else []

    def _flush(self):
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self._flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.out = None
        return self.rows


_INDEX = ["record_id", "bundle", "frame", "offset"]


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=_INDEX)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part = f"{task.partitionId():05d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
    writer, nth = _Writer(folder, part), 0
    for b in slices(batches, "html"):
        done = []
        for page, url, html, first, known in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "first", "known")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            sha1, name = digest(payload), "" if page is None else page
            if first is None:
                # of repeated rows of a page one has the name that revisits know
                ident, refers, kind = record_id(name, sha1, "" if known else f"{part}.{nth}"), None, "response"
            else:
                ident, kind = record_id(name, sha1, f"{part}.{nth}"), "revisit"
                refers = (record_id(first, sha1), first)
            nth += 1
            done += writer.add(record(kind, ident, name, url, payload, sha1, refers), ident)
        if done:
            yield _index_rows(done)
    done = writer.close()
    if done:
        yield _index_rows(done)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes bundles below ``folder`` (a URI that pyarrow can write to and all
    executors share) and returns the index (record_id, bundle, frame, offset).

    Of payloads that are equal and of at least ``least`` bytes, the record with
    the smallest id is a response and the others revisit it.
    """
    payload = F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b""))
    # payloads are told by length and two digests: SHA-1 alone can be made to collide
    told = [F.coalesce(F.octet_length(html_col), F.lit(0)).alias("n"), F.sha1(payload).alias("sha"), F.sha2(payload, 256).alias("sha2")]
    key = ["n", "sha", "sha2"]
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), *told)
    per = base.filter(F.col("n") >= least).groupBy(*key, "id").agg(F.count("*").alias("times"))
    least_id = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "times")))
    first = per.groupBy(*key).agg(least_id.alias("m"), F.sum("times").alias("c")).filter("c > 1")
    first = written(first.select(*key, F.col("m.id").alias("first"), F.col("m.times").alias("times"), F.lit(True).alias("again")), "warc-repeated")
    # read from a table, the repeated digests are dealt out anew: Spark can split the one that a third of the rows have
    joined = base.join(first, key, "left")
    other = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    known = F.when(F.col("again"), F.coalesce((F.col("id") == F.col("first")) & (F.col("times") == 1), F.lit(False))).otherwise(F.col("n") >= least)
    twice = F.coalesce((F.col("id") == F.col("first")) & (F.col("times") > 1), F.lit(False))
    columns = [F.col("id").cast("string").alias("page"), "url", "html", other.alias("first"), known.alias("known")]
    rows = joined.filter(~twice).select(*columns) if not first.filter("times > 1").isEmpty() else joined.select(*columns)
    if not first.filter("times > 1").isEmpty():
        rows = rows.unionByName(_one_known(joined.filter(twice).select(*columns, *key), key))

    def run(batches):
        return _write(batches, folder)

    return written(rows.mapInArrow(run, "record_id string, bundle string, frame int, offset long"), "warc-index")


def _one_known(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the repeated rows of a page that others revisit, one is known. Rows
    are numbered as they stand in a written table, which does not change."""
    numbered = written(rows, "warc-twice").withColumn("r", F.monotonically_increasing_id())
    lead = written(numbered.groupBy(*key).agg(F.min("r").alias("lead")), "warc-lead")
    return numbered.join(lead, key).withColumn("known", F.col("r") == F.col("lead")).select("page", "url", "html", "first", "known")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    for b in batches:
        bundles = b.column("bundle").to_pylist()
        frames, offsets = b.column("frames").to_pylist(), b.column("offsets").to_pylist()
        for name, ks, ats in zip(bundles, frames, offsets, strict=True):
            bundle = Bundle(fs, f"{root}/{name}")
            by: dict[int, list[int]] = {}
            for k, at in zip(ks, ats, strict=True):
                by.setdefault(k, []).append(at)
            rows = []
            for k in sorted(by):
                data = bundle.frame(k)
                for at in sorted(by[k]):
                    head, block, _ = parse(data, at)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                    size = int(fields["Content-Length"])
                    sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha1):
                        raise ValueError(f"{name}, frame {k}: a payload differs from its digest")
                    rows.append((head["X-Page"] or None, size, sha1, head["WARC-Type"], head.get("X-Refers-To-Page"), head["WARC-Record-ID"], head.get("WARC-Refers-To")))
            bundle.close()
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers", "record_id", "refers_to_record"])


def read_archives(index: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Reads the records of an index back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to, record_id, refers_to_record). The
    payload of each response is checked against its digest; a revisit's size
    and digest are those that its header keeps of the full payload. What a
    task reads at once are RUN frames of a bundle; runs are dealt out by
    number, as the index is too small to tell how much they hold."""

    def run(batches):
        return _read(batches, folder)

    index = index.withColumn("run", F.floor(F.col("frame") / RUN))
    runs = index.select("bundle", "run").distinct().count()
    parts = max(1, min(4 * runs, max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs // 64)))

    schema = "page string, payload_bytes long, payload_digest string, record_type string, refers string, record_id string, refers_to_record string"
    places = index.repartition(parts, "bundle", "run").groupBy("bundle", "run").agg(F.collect_list(F.struct("frame", "offset")).alias("p")).select("bundle", F.col("p.frame").alias("frames"), F.col("p.offset").alias("offsets"))
    out = places.mapInArrow(run, schema)
    return out.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"), "record_id", "refers_to_record")


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns a row for each
    record: (page_id, payload_bytes, payload_digest, record_type, refers_to,
    record_id, refers_to_record).

    A null html is an empty payload; a null url an empty target. Rows that
    share both payload and the smallest id are all responses (they are the same
    page), each with a record id of its own; revisits name one of them. Texts
    of any length are whole records. A null id comes after every other one and is read back as null; if
    all ids of a payload are null, all its rows are responses. Other columns
    are not read. An empty table gives an empty result.
    """
    folder = folder or work_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, url_col, html_col, least)
    return read_archives(index, folder, pages.schema[id_col].dataType.simpleString())


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((((strpos('0123456789abcdef', substr(x, 1 + (5 * i) // 4, 1)) - 1) * 16
              + (strpos('0123456789abcdef', substr(x, 2 + (5 * i) // 4, 1)) - 1)) >> (3 - (5 * i) % 4)) & 31))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

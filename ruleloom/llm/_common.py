"""What the operators of this subpackage share: shared folders, written
tables, fold arithmetic and slices of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset and
    the master is local (tests), a folder of our own is made; on a cluster an
    unset folder is an error, as a machine's own disk would lose data.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="ruleloom-"))
    return _OWN_DIR[0]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/ruleloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends
    there, and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a table that ``written`` made and that nothing reads any more."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        for f in df_or_path.inputFiles()[:1]:
            _delete(spark, f.rpartition("/")[0])
    else:
        _delete(spark, df_or_path)


def _delete(spark: SparkSession, path: str) -> None:
    if "/ruleloom/" not in path:
        raise ValueError(f"not a table of this library: {path}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are both shuffled, whatever Spark takes their sizes
    to be. An exploded table counts as large as one that is not, and a written
    one as its compressed files, so that one of 66 rows a fingerprint would be
    sent to all executors through the driver."""
    return left.join(right.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What a worker keeps from task to task: one model, the last one used."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4_000_000, keep: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` has about ``most_bytes`` in each cut
    (one row at least): what Python holds at once stays bounded. Workers live
    on after a task, so that what it held is given back at its end, and a
    model that other tasks held, and that is not the one to ``keep``, at its
    beginning."""
    if keep not in _HELD:
        _HELD.clear()
    yield from _slices(batches, column, most_bytes)
    pa.default_memory_pool().release_unused()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(column))
        width = col.nbytes / b.num_rows
        if width * b.num_rows <= most_bytes:
            yield b
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def runs(data: bytes, ends: str, most: int = 1_000_000) -> Iterator[bytes]:
    """Cuts ``data`` behind bytes of the class ``ends`` into runs of about
    ``most`` bytes (longer where no such byte stands), so that the words of a
    very long text are never all held at once."""
    if len(data) <= most:
        yield data
        return
    end = re.compile(b"[" + ends.encode() + b"]")
    start = 0
    while start < len(data):
        m = end.search(data, start + most)
        stop = m.end() if m else len(data)
        yield data[start:stop]
        start = stop


def below(h: Column, share: float | Column) -> Column:
    """Is the 64-bit hash ``h`` among that share of all hashes? Fine enough for
    a share of one in 2 ** 52, and all of them from 1 on."""
    share = F.lit(share) if isinstance(share, float) else share
    return (F.shiftrightunsigned(h, 1).cast("double") < share * F.lit(float(1 << 63))) | (share >= 1)


def class_sample(df: DataFrame, key: Column, label: str, most: int, seed: int = 7) -> tuple[DataFrame, list]:
    """Rows drawn by the hash of ``key`` so that each value of ``label`` keeps
    its rows of about ``most`` to 1.5 ``most`` keys, those with the least hashes
    (all, if it has fewer), and the labels. Keys are counted, not rows, so that
    copies neither crowd others out nor take a label's place. Which rows are
    drawn depends on the rows alone, not on their order or partitions. There
    may be 10,000 labels at most."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.approx_count_distinct(key, 0.02)).limit(10_001).collect()}
    if len(counts) > 10_000:
        raise ValueError(f"{label} has over 10,000 values; it is no class label")
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(share_of(most, n))).otherwise(share)
    return df.filter(below(F.xxhash64(key, F.lit(seed)), share)), sorted(counts)


def share_of(most: int, n: int) -> float:
    """The share to draw of about n, so that ``most`` are reached almost surely."""
    return min(1.0, 1.25 * most / n) if n > 1.1 * most else 1.0

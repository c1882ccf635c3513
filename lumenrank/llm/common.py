"""What the operators of this subpackage share: shared-folder tables, Arrow batches of texts, blocks of vectors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that setting is missing, a
    single-machine session (as in tests) gets a fresh local folder, and a cluster an error."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        here = "file://" + tempfile.mkdtemp(prefix="lumenrank-")
        spark.conf.set("spark.checkpoint.dir", here)
    return here


def stored(df: DataFrame, name: str, by: str | None = None, **options) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder (one folder for each value of the column ``by``) and
    read back: lineage ends here, and a lost executor costs no more than the task that was running on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=by)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, once nothing that is still to run reads them; others are left alone."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until no column of ``df`` has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most ``most`` rows (of a few numbers each);
    beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch's texts, one after the other, and the n + 1 offsets into them; null: empty."""
    col = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text (one longer text stands alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], and so on."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``df`` with columns of these names, in any case, out of the way; what brings back its own columns)."""
    low = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in low]
    moved = dict(zip(clash, unused(df, *[f"{c}_own" for c in clash]), strict=True))
    return df.withColumnsRenamed(moved), lambda out: out.select(*[F.col(moved.get(c, c)).alias(c) for c in df.columns])


def salted_join(many: DataFrame, once: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Inner join of rows that may share a key in any number with rows that have it once: the rows of a key are
    dealt over ``salts`` tasks by all their columns, and the other side is sent to each."""
    salt, = unused(many, "salt")
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*[c for c in many.columns if not many.schema[c].dataType.simpleString().startswith("map")]), F.lit(salts)).cast("int"))
    sent = once.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(sent, [*on, salt]).drop(salt)

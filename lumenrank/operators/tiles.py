"""Vector searches: rows stay in packed blocks, and the queries are sent to them.

Vectors are packed into blocks of equal length. A search deals the blocks of rows to slots, each of a bounded
number of bytes, and sends every block of queries to every slot. A task holds one slot's rows and lets the
queries pass, so what is shuffled are the rows once and the queries once per slot, and a task's memory is
bounded by a slot and one block of queries.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of rows and of queries; bytes of the vectors of one slot; scores of one tile.
ROWS, QUERIES, SLOT_BYTES, AREA = 8192, 1024, 64 << 20, 1 << 22


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _packer(rows: int, scale: int, finite: bool):
    def block(name: str, ids: np.ndarray, m: np.ndarray, extra: pa.Table) -> pa.RecordBatch:
        order = np.lexsort((*m.T[::-1], ids))
        kept = _ipc(extra.take(pa.array(order))) if extra.num_columns else None
        return pa.RecordBatch.from_pydict({
            "block": pa.array([name]), "dim": pa.array([m.shape[1]], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vecs": pa.array([m[order].tobytes()], pa.binary()),
            "norm": pa.array([float(np.sqrt((m * m).sum(axis=1).max(initial=0)))]), "extra": pa.array([kept], pa.binary()),
        })

    def run(batches):
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                mine = b.filter(pa.array(size == dim))
                m = mine.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(mine.num_rows, dim)
                if finite:
                    fine = np.isfinite(m).all(axis=1)
                    mine, m = mine.filter(pa.array(fine)), m[fine]
                ids, extra = mine.column(0).to_numpy(zero_copy_only=False).astype(np.int64), pa.Table.from_batches([mine.select(mine.schema.names[2:])])
                m = np.floor(m * scale) if scale else m
                if dim in held:
                    ids, m, extra = np.concatenate((held[dim][0], ids)), np.concatenate((held[dim][1], m)), pa.concat_tables((held[dim][2], extra))
                while len(ids) >= rows:
                    n += 1
                    yield block(f"{part}-{n}", ids[:rows], m[:rows], extra.slice(0, rows))
                    ids, m, extra = ids[rows:], m[rows:], extra.slice(rows)
                held[dim] = ids, m, extra
        for ids, m, extra in held.values():
            if len(ids):
                n += 1
                yield block(f"{part}-{n}", ids, m, extra)
        del held
        trim()

    return run


def packed(df: DataFrame, id_col: str, vec_col: str, rows: int | None = None, scale: int = 0, finite: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Blocks of up to ``rows`` vectors of equal length ``dim``: block (name), ids (int64, ascending), vecs
    (float64, floor(scale x) if scale), norm (largest), extra (the columns ``keep`` as an Arrow stream). Null
    ids and vectors are left out, and with ``finite`` those with a null or non-finite component."""
    return df.select(F.col(id_col).cast("long"), vec_col, *(keep or [])).mapInArrow(_packer(rows or ROWS, scale, finite), "block string, dim int, ids binary, vecs binary, norm double, extra binary")


def query_blocks(df: DataFrame, id_col: str, vec_col: str, rows: int | None = None, scale: int = 0, finite: bool = True) -> DataFrame:
    """``packed`` queries; of rows that share an id the smallest vector counts."""
    rows = rows or QUERIES
    one = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    return packed(one.repartition(max(1, -(-one.count() // (4 * rows))), "id"), "id", "vec", rows, scale, finite)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts; binary values as buffers."""
    for i in range(batch.num_rows):
        yield {c: (batch.column(c)[i].as_buffer() if pa.types.is_binary(batch.schema.field(c).type) else batch.column(c)[i].as_py()) for c in batch.schema.names}


def matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a block."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vecs"]).reshape(len(ids), row["dim"])


def slots_of(rows: DataFrame, vec_col: str, slot_bytes: int = SLOT_BYTES) -> int:
    """Slots for the vectors of ``rows``: as many as tasks run at once, or more where their bytes ask for it."""
    n, size = rows.agg(F.count(vec_col), F.sum(F.size(vec_col).cast("long") * 8)).first()
    at_once = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-(size or 0) // slot_bytes), min(at_once, 2 * (-(-n // ROWS))))


def search(blocks: DataFrame, queries: DataFrame, slots: int, prepare: Callable[[dict], object], answer: Callable[[list, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Every block of queries beside the rows of every slot: ``answer(held, query)`` gets what ``prepare`` made of
    a slot's blocks, and one block of queries."""
    near = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).withColumn("side", F.lit(0))
    sent = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("side", F.lit(1))
    both = near.unionByName(sent, allowMissingColumns=True).repartitionById(slots, "slot").sortWithinPartitions("slot", "side")

    def run(batches):
        slot, held = None, []
        for b in batches:
            for r in rows_of(b):
                if r["slot"] != slot:
                    slot, held = r["slot"], []
                if r["side"] == 0:
                    held.append(prepare(r))
                elif held:
                    yield from answer(held, r)
        held, r, b = [], None, None
        trim()

    return both.mapInArrow(run, schema)


def best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest values above minus infinity, of equal ones the first columns."""
    last = near.shape[1] - k
    if last > 0:
        least = np.partition(near, last, axis=1)[:, [last]]
        take = near >= least
        for i in np.flatnonzero(take.sum(axis=1) > k):  # ties at the k-th value
            same = np.flatnonzero(near[i] == least[i])
            take[i, same[k - int((near[i] > least[i]).sum()) :]] = False
        take &= near > -np.inf
    else:
        take = near > -np.inf
    return np.nonzero(take)


def mask_own(near: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> None:
    """Minus infinity where a query meets its own id (``ids`` ascend)."""
    lo, hi = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
    for i in np.flatnonzero(hi > lo):
        near[i, lo[i] : hi[i]] = -np.inf


def merged(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best of candidates, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    first = np.flatnonzero(np.concatenate(([True], query[order][1:] != query[order][:-1]))) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
    return order[place < k]

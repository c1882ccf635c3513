"""Exact top-k search by distributed histogram selection.

Components become integers floor(256 x). Every round scores all rows for all queries, block by block, and
adds up per query a histogram of the scores inside the range that still holds the k-th value; the range
shrinks to one of its bins each time until it is a single score. A last pass keeps the rows above that
score, and of those equal to it the smallest ids. Rows stay in their slots of bounded size, queries are sent
to them; a slot gives one histogram per block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tiles
from .common import discard, stored

BINS = 512


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Integer inner products: in double precision where all sums stay below 2^53, else in 64-bit integers."""
    far = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(1, q.shape[1])
    if far < 2.0**53:
        return (q @ m.T).astype(np.int64)
    if far >= 2.0**63:
        raise OverflowError("scores don't fit a long")
    return q.astype(np.int64) @ m.T.astype(np.int64)


def _tiles(held: list, row: dict):
    """(from, to, scores queries x rows, ids, which are candidates) of tiles of bounded area."""
    qids, q = tiles.matrix(row)
    for ids, m in held:
        if m.shape[1] != q.shape[1]:
            continue
        step = max(1, tiles.AREA // len(ids))
        for at in range(0, len(qids), step):
            s = _scores(q[at : at + step], m)
            other = np.ones(s.shape, bool)
            lo, hi = np.searchsorted(ids, qids[at : at + step], "left"), np.searchsorted(ids, qids[at : at + step], "right")
            for i in np.flatnonzero(hi > lo):
                other[i, lo[i] : hi[i]] = False
            yield at, min(at + step, len(qids)), s, ids, other


def _histogram(held: list, row: dict) -> Iterator[pa.RecordBatch]:
    lo, width, span = np.frombuffer(row["lo"], np.int64), row["width"], row["span"]
    h = np.zeros((len(lo), BINS), np.int64)
    for a, b, s, _, other in _tiles(held, row):
        at = s - lo[a:b, None]
        fits = other & (at >= 0) & (at < span)
        bins = np.arange(b - a)[:, None] * BINS + at // width
        h[a:b] += np.bincount(bins[fits], minlength=(b - a) * BINS).reshape(b - a, BINS)
    yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]]), "hist": pa.array([h.tobytes()], pa.binary()), **{c: pa.array([bytes(row[c])], pa.binary()) for c in ("lo", "need")}, "width": pa.array([width], pa.int64()), "span": pa.array([span], pa.int64())})


def _narrow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bin of each query that holds the value still needed, from the sum of its histograms."""
    h = None
    for b in batches:
        for r in tiles.rows_of(b):
            one = np.frombuffer(r["hist"], np.int64).reshape(-1, BINS)
            h = one.copy() if h is None else h + one
            state = r
    lo, need, width = np.frombuffer(state["lo"], np.int64), np.frombuffer(state["need"], np.int64), state["width"]
    above = h[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in this bin or a higher one
    found = above >= need[:, None]
    at = np.where(found.any(axis=1), BINS - 1 - found[:, ::-1].argmax(axis=1), 0)  # too few rows: the lowest bin
    higher = above[np.arange(len(at)), at] - h[np.arange(len(at)), at]
    finer = -(-width // BINS)
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()]), "lo": pa.array([(lo + at * width).tobytes()], pa.binary()), "need": pa.array([(need - higher).tobytes()], pa.binary()), "width": pa.array([finer], pa.int64()), "span": pa.array([width], pa.int64())})


def _keep(held: list, row: dict) -> Iterator[pa.RecordBatch]:
    """Rows above the k-th score, and of those equal to it the first that are needed (ids ascend)."""
    qids, _ = tiles.matrix(row)
    kth, need = np.frombuffer(row["lo"], np.int64), np.frombuffer(row["need"], np.int64)
    for a, b, s, ids, other in _tiles(held, row):
        i, j = np.nonzero((s > kth[a:b, None]) & other)
        x, y = np.nonzero((s == kth[a:b, None]) & other)
        first = np.searchsorted(x, x, "left")
        few = np.arange(len(x)) - first < need[a + x]
        i, j = np.concatenate((i, x[few])), np.concatenate((j, y[few]))
        yield pa.RecordBatch.from_arrays([pa.array(qids[a + i]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k rows of highest integer inner product (all, if fewer), ties to the smaller id:
    query_id, rank from 1, vec_id, score. A query's own id is no candidate.

    Null ids, null and empty vectors, vectors with a null or non-finite component, and empty tables take no
    part; vectors are searched among those of their own length. Rows that share an id are candidates each; of
    queries that share one, the smallest vector counts. Other columns are ignored. Scores that don't fit a
    long raise.
    """
    spark, empty = rows.sparkSession, "query_id long, rank int, vec_id long, score long"
    rows, queries = (d.where(F.size(vec_col) > 0) for d in (rows, queries))
    slots = tiles.slots_of(rows, vec_col)
    blocks = stored(tiles.packed(rows, id_col, vec_col, scale=scale).drop("extra"), "vectors")
    asked = stored(tiles.query_blocks(queries, id_col, vec_col, scale=scale).drop("extra"), "queries")
    reach = blocks.agg(F.max("norm")).first()[0], asked.agg(F.max("norm")).first()[0]
    if None in reach:
        return spark.createDataFrame([], empty)
    far = int(reach[0] * reach[1]) + 1  # no score is further from 0
    width = -(-(2 * far + 1) // BINS)

    def start(batches):
        for b in batches:
            for r in tiles.rows_of(b):
                n = len(r["ids"]) // 8
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]]), "lo": pa.array([np.full(n, -far, np.int64).tobytes()], pa.binary()), "need": pa.array([np.full(n, k, np.int64).tobytes()], pa.binary()), "width": pa.array([width], pa.int64()), "span": pa.array([2 * far + 1], pa.int64())})

    form = "block string, lo binary, need binary, width long, span long"
    state, blocks, asked = asked.select("block", "ids").mapInArrow(start, form), blocks.drop("norm"), asked.drop("norm")
    while True:
        sums = tiles.search(blocks, asked.join(state, "block"), slots, tiles.matrix, _histogram, "block string, hist binary, lo binary, need binary, width long, span long")
        before, state = state, stored(sums.groupBy("block").applyInArrow(_narrow, form), "ranges")
        discard(before)
        if width == 1:
            break
        width = -(-width // BINS)
    found = tiles.search(blocks, asked.join(state, "block"), slots, tiles.matrix, _keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

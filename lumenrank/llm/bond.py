"""Hard-negative mining by a vertical scan of the dimensions (BOND).

Rows lie in slots as columns, one array per dimension, with each dimension's least and largest component. An
anchor reads the columns in falling order of its own components' magnitude and adds up partial scores. What the
dimensions not yet read can add lies between sums of their least and largest contributions, so every row has
bounds of its score, and rows whose bounds rule them out leave the bitmap of candidates; later columns are read
for the others alone. The first scan finds an anchor's positives (rows of its label with the highest scores),
the second resolves, exactly, the window of scores below each positive among the rows of other labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tiles
from .common import discard, stored

#: Columns that are read before the bitmap shrinks again.
STEP = 8
#: Bound of the scores, so that a hundred times one still fits a long.
FAR = 2.0**56


def columns_of(row: dict) -> dict:
    """A block of rows by columns: dim, ids, labels, columns (dimensions x rows), low and high per dimension."""
    ids, m = tiles.matrix(row)
    cols = np.ascontiguousarray(m.T)
    return {"dim": row["dim"], "ids": ids, "labels": _extra(row).column("label").to_numpy(), "columns": cols, "low": cols.min(axis=1), "high": cols.max(axis=1)}


def _extra(row: dict) -> pa.Table:
    with pa.ipc.open_stream(row["extra"]) as reader:
        return reader.read_all()


def exact(q: np.ndarray, block: dict) -> tuple[np.ndarray, dict]:
    """Anchor and block as they are where all sums stay below 2^53, else as 64-bit integers."""
    far = np.abs(q).max(initial=0) * max(np.abs(block["low"]).max(initial=0), np.abs(block["high"]).max(initial=0)) * max(1, len(q))
    if far < 2.0**53:
        return q, block
    if far >= FAR:
        raise OverflowError("scores don't fit a long")
    return q.astype(np.int64), block | {c: block[c].astype(np.int64) for c in ("columns", "low", "high")}


def vertical(q: np.ndarray, block: dict, alive: np.ndarray, prune: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the rows that stay in the bitmap ``alive`` to the end. ``prune(low, high)`` says, from
    bounds of the scores of the rows that are left, which of them stay."""
    q, block = exact(q, block)
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.stack((q * block["low"], q * block["high"]))[:, order]
    left = lambda x: np.concatenate((np.cumsum(x[::-1])[::-1], [0])).astype(q.dtype)
    least, most = left(ends.min(axis=0)), left(ends.max(axis=0))
    at, score = np.flatnonzero(alive), np.zeros(int(alive.sum()), q.dtype)
    for k in range(0, len(q), step):
        if not len(at):
            break
        dims = order[k : k + step]
        read = block["columns"][dims] if len(at) == alive.size else block["columns"][np.ix_(dims, at)]
        score = score + q[dims] @ read
        done = min(k + step, len(q))
        stay = prune(score + least[done], score + most[done])
        at, score = at[stay], score[stay]
    return at, score


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def positives(q: np.ndarray, label: int, own: int, blocks: list[dict], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k rows of the anchor's label with the highest scores, ties to the smaller id."""
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for block in blocks:
        if block["dim"] != len(q):
            continue
        floor = _kth(scores, k)
        at, got = vertical(q, block, (block["labels"] == label) & (block["ids"] != own), lambda low, high, floor=floor: high >= max(floor, _kth(low, k)))
        ids, scores = np.concatenate((ids, block["ids"][at])), np.concatenate((scores, got.astype(np.int64)))
        best = _first(scores, ids, k)
        ids, scores = ids[best], scores[best]
    return ids, scores


def windows(q: np.ndarray, label: int, own: int, goals: list[int], blocks: list[dict], k: int, lower: int, upper: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(positive score, ids, scores) for every positive score in ``goals``: the first k rows of other labels whose
    score s satisfies lower * positive <= 100 * s <= upper * positive."""
    spans = [(g, -(-lower * g // 100), upper * g // 100) for g in goals]
    spans = [s for s in spans if s[1] <= s[2]]
    found = {g: (np.empty(0, np.int64), np.empty(0, np.int64)) for g, _, _ in spans}
    for block in blocks:
        if block["dim"] != len(q) or not spans:
            continue

        def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(low), bool)
            for g, a, b in spans:
                sure = _kth(low[(low >= a) & (high <= b)], k)  # k rows lie in the window for certain, at this score or above
                keep |= (low <= b) & (high >= max(a, sure, _kth(found[g][1], k)))
            return keep

        at, got = vertical(q, block, (block["labels"] != label) & (block["ids"] != own), useful)
        got = got.astype(np.int64)
        for g, a, b in spans:
            fits = (got >= a) & (got <= b)
            ids, scores = np.concatenate((found[g][0], block["ids"][at[fits]])), np.concatenate((found[g][1], got[fits]))
            best = _first(scores, ids, k)
            found[g] = ids[best], scores[best]
    yield from ((g, *v) for g, v in found.items())


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, lower: int = 80, upper: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    Scores are inner products of the components floor(scale x). An anchor's positives are the ``n_positives`` rows
    of its label with the highest scores; of each, the negatives are the first ``n_negatives`` rows of another
    label with lower * positive_score <= 100 * negative_score <= upper * positive_score; ties go to the smaller
    id, fewer rows give all. Rows with a null id or label, a null or empty vector, or a null or non-finite
    component, and empty tables, take no part; vectors meet those of their own length. Rows that share an id are
    candidates each, and no candidates of an anchor of that id; of anchors that share one, the smallest vector
    (then the smallest label) counts. Other columns are ignored. Scores beyond 2^56 raise.
    """
    fine = (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("long").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
    rows, one = plain(rows), plain(anchors).groupBy("id").agg(F.min(F.struct("vec", "label")).alias("a")).select("id", "a.*")
    slots = tiles.slots_of(rows, "vec")
    blocks = stored(tiles.packed(rows, "id", "vec", scale=scale, keep=["label"]).drop("norm"), "vectors")
    one = stored(one, "anchors")
    deal = lambda d: d.repartition(max(1, -(-one.count() // (4 * tiles.QUERIES))), "id")

    def each(found: Callable[[np.ndarray, dict, int], Iterator[dict]]):
        def run(held: list[dict], row: dict) -> Iterator[pa.RecordBatch]:
            ids, m = tiles.matrix(row)
            more = _extra(row).to_pylist()
            out = [x for i in range(len(ids)) for x in found(m[i], {"id": int(ids[i]), **more[i]}, held)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]), pa.int64()) for c in out[0]], names=list(out[0]))

        return run

    def best(q, a, held):
        ids, scores = positives(q, a["label"], a["id"], held, n_positives)
        yield {"anchor_id": np.full(len(ids), a["id"]), "positive_id": ids, "positive_score": scores}

    asked = tiles.packed(deal(one), "id", "vec", tiles.QUERIES, scale, keep=["label"]).drop("norm")
    found = tiles.search(blocks, asked, slots, columns_of, each(best), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(found.withColumn("place", place).where(F.col("place") <= n_positives).drop("place"), "positives")

    def below(q, a, held):
        for g, ids, scores in windows(q, a["label"], a["id"], a["goals"], held, n_negatives, lower, upper):
            yield {"anchor_id": np.full(len(ids), a["id"]), "positive_score": np.full(len(ids), g), "negative_id": ids, "negative_score": scores}

    goals = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set("positive_score")).alias("goals"))
    asked = tiles.packed(deal(one.join(goals, "id")), "id", "vec", tiles.QUERIES, scale, keep=["label", "goals"]).drop("norm")
    found = tiles.search(blocks, asked, slots, columns_of, each(below), "anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    found = stored(found.withColumn("rank", rank).where(F.col("rank") <= n_negatives), "negatives")
    discard(blocks, one)
    return chosen.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Approximate nearest neighbours for inner product: score-aware anisotropic product quantisation.

Two components form a subspace with sixteen centroids, a four-bit code. Codes and centroids minimise a loss
that weighs the residual's part parallel to the vector more than the orthogonal part, since it is the
parallel part that moves large inner products. A search scans the codes of all rows through per-query
tables (two codes share one byte and so one table of 256 sums), keeps the best of every block, and reranks
them by exact inner product in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tiles
from .common import ragged, stored

#: Distinct vectors that the codebooks are fitted on at most (chosen by their hashes), of each length; candidates
#: that each block of rows hands to the exact reranking at least, per query.
FIT_ROWS, RERANK = 16_384, 200
#: Share of the norm from which scores matter; it sets the weight of the parallel residual.
THRESHOLD = 0.2


def weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel residual weighs than the orthogonal one (at least 1)."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def padded(x: np.ndarray) -> np.ndarray:
    """Zero components up to a multiple of four: subspaces are pairs, bytes are pairs of subspaces."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))


def assign(x: np.ndarray, books: np.ndarray, w: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on the anisotropic loss."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, 2)
    norm = (x * x).sum(axis=1)
    codes = np.empty((n, m), np.uint8)
    along = np.empty((n, m))  # <residual, x> of each subspace
    for j in range(m):
        d = parts[:, j, None] - books[j]
        codes[:, j] = (d * d).sum(axis=2).argmin(axis=1)
        along[:, j] = (d[np.arange(n), codes[:, j]] * parts[:, j]).sum(axis=1)
    total = along.sum(axis=1)
    for _ in range(rounds if w > 1 else 0):
        for j in range(m):
            d = parts[:, j, None] - books[j]
            a = (d * parts[:, j, None]).sum(axis=2)
            rest = total - along[:, j]
            loss = (d * d).sum(axis=2) + (w - 1) * (rest[:, None] + a) ** 2 / norm[:, None]
            codes[:, j] = loss.argmin(axis=1)
            along[:, j] = a[np.arange(n), codes[:, j]]
            total = rest + along[:, j]
    return codes


def fit(x: np.ndarray, w: float, rounds: int = 6) -> np.ndarray:
    """Codebooks (subspaces x 16 x 2): k-means from quantiles, then weighted least squares per centroid."""
    n, m = len(x), x.shape[1] // 2
    parts, norm = x.reshape(n, m, 2), (x * x).sum(axis=1)
    books = np.empty((m, 16, 2))
    for j in range(m):  # a start on both axes: 4 x 4 quantiles
        at = (np.arange(4) + 0.5) / 4
        books[j] = np.stack(np.meshgrid(np.quantile(parts[:, j, 0], at), np.quantile(parts[:, j, 1], at)), axis=-1).reshape(16, 2)
    for r in range(rounds):
        codes = assign(x, books, w if r >= rounds // 2 else 1.0)
        rows = np.arange(m)
        approx = books[rows, codes]
        along = ((parts - approx) * parts).sum(axis=2)
        total = along.sum(axis=1)
        for j in range(m):
            p, rest, lam = parts[:, j], total - along[:, j], ((w - 1) / norm if r >= rounds // 2 else np.zeros(n))
            a = np.zeros((16, 2, 2))
            b = np.zeros((16, 2))
            np.add.at(a, codes[:, j], np.eye(2) + lam[:, None, None] * p[:, :, None] * p[:, None, :])
            np.add.at(b, codes[:, j], p + (lam * (rest + (p * p).sum(axis=1)))[:, None] * p)
            used = np.bincount(codes[:, j], minlength=16) > 0
            books[j, used] = np.linalg.solve(a[used] + 1e-12 * np.eye(2), b[used][:, :, None])[:, :, 0]
    return books


def slack(x: np.ndarray, books: np.ndarray, w: float, share: float = 0.95) -> float:
    """The error of scanned scores, per unit of the query's norm, that ``share`` of pairs stay below."""
    r = x - books[np.arange(len(books)), assign(x, books, w)].reshape(x.shape)
    q = x[:: max(1, len(x) // 200)]
    return float(np.quantile(np.abs(q @ r.T) / np.linalg.norm(q, axis=1)[:, None], share))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, count, places sorted by group, where each group begins) of a block's equal vectors."""
    key = np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel()
    _, first, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, count, np.argsort(group, kind="stable"), np.cumsum(count) - count


def search(q: np.ndarray, qids: np.ndarray, block: dict, books: np.ndarray, k: int, rerank: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, exact scores) of each query's k best of one block; ids ascend in the block.

    ``block`` holds the distinct vectors x, their codes (two a byte, one array per byte), and per vector the
    rows that share it (ids, count, members, begin). Equal vectors are scanned and reranked once, so a vector
    that many rows share takes one candidate's place; its rows come in by id. Reranked are the ``rerank`` best
    of the scan and all that come within ``margin`` (times the query's norm) of its k-th score: of a tight
    cluster, whose members the codes can't tell apart, all.
    """
    x, columns, count = block["x"], block["columns"], block["count"]
    n, half = len(x), len(columns)
    wide = padded(q).reshape(len(q), half, 2, 2)
    pairs = books.reshape(half, 2, 16, 2)
    tables = np.einsum("qhsd,hscd->qhsc", wide, pairs)
    tables = (tables[:, :, 1, :, None] + tables[:, :, 0, None, :]).reshape(len(q), half, 256).astype(np.float32)
    norms, place = np.linalg.norm(q, axis=1), np.empty(n, np.float32)
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(len(q)):
        score = tables[i, 0].take(columns[0])
        for h in range(1, half):
            tables[i, h].take(columns[h], out=place, mode="clip")
            score += place
        at = np.arange(n)
        if n > rerank:
            top = np.partition(score, (n - rerank, n - min(k, rerank)))
            edge = min(top[n - rerank], top[n - min(k, rerank)] - margin * norms[i])
            at = np.flatnonzero(score >= edge)
        exact = (x[at] * q[i]).sum(axis=1)
        least = np.partition(exact, len(exact) - min(len(exact), k + 1))[len(exact) - min(len(exact), k + 1)]  # one more than k: a query's own row is no candidate
        at, exact = at[exact >= least], exact[exact >= least]
        few = np.minimum(count[at], k + 1)
        found, exact = block["ids"][block["members"][ragged(block["begin"][at], few)]], np.repeat(exact, few)
        found, exact = found[found != qids[i]], exact[found != qids[i]]
        best = np.lexsort((found, -exact))[:k]
        for o, v in zip(out, (np.full(len(best), qids[i]), found[best], exact[best]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.empty(0) for o in out)


def sample(rows: DataFrame, vec_col: str, most: int) -> DataFrame:
    """``most`` of the distinct vectors, those of the least hashes (all, if they are fewer), as column vec. A share
    of about twice as many is cut by hash first, so that few are sorted; ids, and how often a vector occurs, don't
    matter."""
    h = F.xxhash64(vec_col)
    n = rows.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    few = rows if n <= most else rows.where(F.pmod(h, F.lit(1 << 32)) < (1 << 33) * most // n)
    return few.select(F.col(vec_col).alias("vec"), F.pmod(h, F.lit(1 << 32)).alias("h")).distinct().orderBy("h", "vec").limit(most).select(F.lit(0).alias("id"), "vec")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Each query's k nearest found rows by inner product (all rows, if fewer), ties to the smaller id:
    query_id, rank from 1, vec_id, score. Every row is indexed and scanned; a query's own id is no candidate.

    Null ids, null, empty and zero vectors, vectors with a null or non-finite component, and empty tables take
    no part; vectors are searched among those of their own length, each length with codebooks of its own. Rows
    that share an id are candidates each; of queries that share one, the smallest vector counts. Other columns
    are ignored.
    """
    spark, empty = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    able = F.size(vec_col) > 0
    fine = able & ~F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(F.col(vec_col), lambda x: x != 0)
    rows, queries = (d.where(fine & F.col(id_col).isNotNull()) for d in (rows, queries))
    models = {}
    for r in rows.groupBy(F.size(vec_col).alias("dim")).count().collect():  # the lengths that occur
        mine = sample(rows.where(F.size(vec_col) == r["dim"]), vec_col, fit_rows)
        got = [np.frombuffer(b["vecs"]).reshape(-1, r["dim"]) for b in tiles.packed(mine, "id", "vec").select("vecs").collect()]
        x = np.unique(padded(np.concatenate(got).astype(np.float32).astype(np.float64)), axis=0)  # a vector that many rows share mustn't take the centroids
        books = fit(x, weight(r["dim"]))
        models[r["dim"]] = books, weight(r["dim"]), slack(x, books, weight(r["dim"]))
    if not models:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(models)  # a few KB for each length

    def encode(batches):
        for b in batches:
            for r in tiles.rows_of(b):
                ids, m = tiles.matrix(r)
                books, w, _ = shared.value[r["dim"]]
                first, count, members, begin = distinct(m)
                codes = assign(padded(m[first]), books, w)
                both = codes[:, 0::2] | codes[:, 1::2] << 4
                held = {"block": pa.array([r["block"]]), "dim": pa.array([r["dim"]], pa.int32())}
                for c, v in {"ids": ids, "vecs": m[first], "codes": np.ascontiguousarray(both.T), "count": count.astype(np.int64), "members": members.astype(np.int64), "begin": begin.astype(np.int64)}.items():
                    held[c] = pa.array([v.tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict(held)

    def prepare(r: dict) -> dict:
        count = np.frombuffer(r["count"], np.int64)
        own = {c: np.frombuffer(r[c], np.int64) for c in ("ids", "members", "begin")}
        return own | {"dim": r["dim"], "count": count, "x": np.frombuffer(r["vecs"]).reshape(len(count), -1), "columns": np.frombuffer(r["codes"], np.uint8).reshape(-1, len(count))}

    def scan(held, r):
        qids, q = tiles.matrix(r)
        parts = []
        for block in held:
            if block["dim"] == r["dim"]:
                books, _, margin = shared.value[r["dim"]]
                parts.append(search(q, qids, block, books, k, rerank, margin))
        if parts:
            a, i, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            top = tiles.merged(a, s, i, k)  # of this slot
            yield pa.RecordBatch.from_arrays([pa.array(a[top].astype(np.int64)), pa.array(i[top].astype(np.int64)), pa.array(s[top].astype(np.float64))], names=["query_id", "vec_id", "score"])

    index = stored(tiles.packed(rows, id_col, vec_col).mapInArrow(encode, "block string, dim int, ids binary, vecs binary, codes binary, count binary, members binary, begin binary"), "index")
    asked = stored(tiles.query_blocks(queries, id_col, vec_col).drop("norm", "extra"), "queries")
    found = tiles.search(index, asked, tiles.slots_of(rows, vec_col), prepare, scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Retrieval: cosine similarity, top-K per query, default similarities, request rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate
from . import tiles

#: Stands for the cosine of vectors that have none; below every cosine.
NO_COSINE = -2.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector or different lengths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", vec: str = "embedding", keep: list[str] | None = None, exclude_same_id: bool = False) -> DataFrame:
    """Each query's ``k`` documents of highest cosine, ties to the smaller id: query_id, doc_id, sim, rank,
    and the corpus columns ``keep``. Vectors that have no cosine with the query rank last.

    Rows stay in blocks and queries are sent to them (see ``tiles``); each slot passes on its k best per query.
    Of queries that share an id the smallest vector counts.
    """
    keep = keep or []
    fields = [corpus.schema[c] for c in keep]
    schema = f"query_id long, doc_id long, sim double{''.join(f', {f.name} {f.dataType.simpleString()}' for f in fields)}"
    blocks = tiles.packed(corpus, doc_id, vec, finite=False, keep=keep)
    asked = tiles.query_blocks(queries.where(F.col(vec).isNotNull()), query_id, vec, finite=False).drop("extra")
    found = tiles.search(blocks, asked, tiles.slots_of(corpus, vec), _held, _answer(k, keep, exclude_same_id), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("sim"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "sim", "rank", *keep)


def _held(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table | None]:
    ids, m = tiles.matrix(row)
    return ids, m, np.linalg.norm(m, axis=1), None if row["extra"] is None or not row["extra"].size else pa.ipc.open_stream(row["extra"]).read_all()


def _cosines(q: np.ndarray, m: np.ndarray, size: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines of queries and rows, ``NO_COSINE`` where there is none; one tile of memory, and a few rows of it beside."""
    if m.shape[1] != q.shape[1]:
        return np.full((len(q), len(m)), NO_COSINE)
    near = q @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        for at in range(0, len(q), 32):
            part = near[at : at + 32]
            part /= size[at : at + 32] * norms[None]
            part[~np.isfinite(part)] = NO_COSINE
    return near


def _answer(k: int, keep: list[str], exclude_same_id: bool) -> Callable[[list, dict], Iterator[pa.RecordBatch]]:
    def run(held: list, query: dict) -> Iterator[pa.RecordBatch]:
        all_ids, all_q = tiles.matrix(query)
        step = max(1, tiles.AREA // max(len(h[0]) for h in held))
        for at in range(0, len(all_ids), step):
            qids, q = all_ids[at : at + step], all_q[at : at + step]
            size, parts = np.linalg.norm(q, axis=1)[:, None], []
            for n, (ids, m, norms, _) in enumerate(held):
                near = _cosines(q, m, size, norms)
                if exclude_same_id:
                    tiles.mask_own(near, qids, ids)
                i, j = tiles.best(near, k)
                parts.append((i, near[i, j], ids[j], np.full(len(i), n), j))
            i, sim, ids, block, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            top = tiles.merged(i, sim, ids, k)
            i, sim, ids, block, row = i[top], sim[top], ids[top], block[top], row[top]
            cols = [pa.array(qids[i]), pa.array(ids), pa.array(sim, mask=sim <= NO_COSINE)]
            if keep:  # the rows' own columns, block by block, then in the order of the result
                order = np.argsort(block, kind="stable")
                got = pa.concat_tables([held[n][3].take(pa.array(row[order][block[order] == n])) for n in np.unique(block)]) if len(top) else held[0][3].slice(0, 0)
                got = got.take(pa.array(np.argsort(order)))
                cols += [got.column(c).combine_chunks() for c in keep]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "doc_id", "sim", *keep])

    return run


def requests(queries: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Request rows from nested requests (query_id, query, documents array<struct<text, original_index,
    similarity>>): one row per document with its position request_index from 0."""
    rows = queries.select(id_col, "query", F.posexplode("documents").alias("request_index", "d"))
    return rows.select(id_col, "query", "request_index", F.col("d.original_index").alias("original_index"), F.col("d.text").alias("text"), F.col("d.similarity").cast("double").alias("similarity"))


def wrap_strings(documents: Column) -> Column:
    """Plain strings as documents with positional ids and no similarity."""
    return F.transform(documents, lambda t, i: F.struct(t.alias("text"), i.cast("long").alias("original_index"), F.lit(None).cast("double").alias("similarity")))


def validate(rows: DataFrame, most: int = 1024, id_col: str = "query_id") -> DataFrame:
    """query_id, documents, status: 200, 422 without documents, 413 with more than ``most``. Rows with a null
    text stand for no document."""
    n = F.count("text")
    return rows.groupBy(id_col).agg(n.alias("documents")).withColumn("status", F.when(F.col("documents") == 0, 422).when(F.col("documents") > most, 413).otherwise(200))


def usage(rows: DataFrame, query_chars: int = 256, document_chars: int = 512, id_col: str = "query_id") -> DataFrame:
    """Characters that a request costs after truncation: query, documents, pairs, and their total."""
    q, d = F.length(truncate(F.col("query"), query_chars)), F.length(truncate(F.col("text"), document_chars))
    out = rows.groupBy(id_col).agg(F.max(q).cast("long").alias("query_tokens"), F.sum(d).cast("long").alias("document_tokens"), F.count("*").alias("pairs"))
    return out.withColumn("total_tokens", F.col("query_tokens") + F.col("document_tokens"))


def default_similarity(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Null similarities as 1 - position / (documents - 1). A query's rows are counted, not brought together."""
    sizes = rows.groupBy(F.col(id_col).alias("_q")).agg(F.count("*").alias("_n"))
    placed = F.coalesce("similarity", 1.0 - F.col("request_index") / F.greatest(F.lit(1), F.col("_n") - 1))
    return rows.join(sizes, F.col(id_col).eqNullSafe(F.col("_q"))).withColumn("similarity", placed).drop("_q", "_n")


def last_of(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Of documents that share an original_index within a query the last in request order."""
    last = rows.groupBy(F.col(id_col).alias("_q"), F.col("original_index").alias("_d")).agg(F.max("request_index").alias("_last"))
    same = F.col(id_col).eqNullSafe(F.col("_q")) & F.col("original_index").eqNullSafe(F.col("_d")) & (F.col("request_index") == F.col("_last"))
    return rows.join(last, same, "left_semi")


def missing(expected: DataFrame, returned: DataFrame, on: list[str]) -> DataFrame:
    """Keys that were expected and aren't there."""
    return expected.select(*on).distinct().join(returned.select(*on).distinct(), on, "left_anti")

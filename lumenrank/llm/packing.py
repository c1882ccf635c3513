"""Packing by power-of-two decomposition: a document's ids are cut into pieces of binary lengths.

A document of n ids becomes n // longest pieces of the longest length and one piece for each set bit of the
rest, longest first. Pieces of equal length form one bucket; each piece is a sequence of its own, so no
sequence crosses documents, every sequence is at a power of two, and nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, small, stored, trim
from .encode import encoder

LONGEST = 4096


def decompose(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of n ids: powers of two up to ``longest`` (itself one), in falling order."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n >> k & 1]


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """One row per piece of the documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket (log2 of the length), and with ``with_ids`` the ids themselves.

    Null and empty texts are one end id. Sequences are numbered from 0 without gaps: first by a run of
    doc_ids (equal counts of documents), inside it by doc_id. Rows that share a doc_id are documents of
    their own, told apart by their ids; rows without doc_id are documents, numbered first. Columns other than doc_id
    and text are ignored. An empty table gives no rows.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], "<u2").tobytes()

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    cuts = runs(docs)
    kinds = {"doc_id": pa.int64(), "tokens": pa.int64(), "digest": pa.int64(), "starts": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "crcs": pa.list_(pa.int64()), "ids": pa.list_(pa.binary())}

    def run(batches):
        enc = encoder(tokenizer, kind)
        for b in pieces(batches, rows=2048):
            cols: dict[str, list] = {c: [] for c in kinds}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = enc.encode(text) + end
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                lengths = decompose(len(raw) // 2, longest)
                at, starts, crcs, ids = 0, [], [], []
                for n in lengths:
                    part = wide[4 * at : 4 * (at + n)]
                    starts.append(at)
                    crcs.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
                    at += n
                for c, v in zip(cols.values(), (doc, at, zlib.crc32(wide), starts, lengths, crcs, ids), strict=True):
                    c.append(v)
            arrays = [pa.array(v, t) for v, t in zip(cols.values(), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, run_of(b.column("doc_id"), cuts)], names=[*kinds, "run"])
        trim()

    got = docs.mapInArrow(run, "doc_id long, tokens long, digest long, starts array<long>, lengths array<long>, crcs array<long>, ids array<binary>, run int")
    return _numbered(got, with_ids)


def runs(docs: DataFrame, rows: int = 4096, most: int = 1 << 16) -> np.ndarray:
    """Sorted doc_ids that cut the documents into at most ``most`` runs of about ``rows`` documents or more
    (from the doc_id column alone). A doc_id's run is the number of cuts at or below it."""
    n = docs.count()
    steps = min(most, -(-n // rows))
    if steps < 2:
        return np.empty(0, np.int64)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / steps for i in range(1, steps)], min(20 * steps, 1_000_000))).first()[0]
    return np.unique(np.array(cuts or [], np.int64))


def run_of(ids: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Each doc_id's run; a null goes to the first."""
    low = np.iinfo(np.int64).min
    return pa.array(np.searchsorted(cuts, pc.fill_null(ids, low).to_numpy(zero_copy_only=False), "right").astype(np.int32))


def _numbered(got: DataFrame, with_ids: bool) -> DataFrame:
    """The pieces as rows, their sequences numbered through."""
    kept = stored(got.withColumn("n", F.size("lengths")), "packed")
    total = kept.groupBy("run").agg(F.sum("n").alias("n"))
    first = total.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("run_first"))
    inside = Window.partitionBy("run").orderBy("doc_id", "tokens", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = kept.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(small(first), "run")
    rows = rows.select("doc_id", "tokens", (F.col("run_first") + F.col("before")).alias("seq"), F.posexplode(F.arrays_zip("starts", "lengths", "crcs", "ids")).alias("k", "p"))
    out = rows.select(
        "doc_id", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        (F.col("seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2(F.col("p.lengths").cast("double")).cast("int").alias("bucket"), F.col("p.ids").alias("ids"),
    )
    return out if with_ids else out.drop("ids")

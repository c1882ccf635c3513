"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled texts in numpy, per task, and adds the count vectors up in Spark; the
log-probability matrix (languages x buckets, a size fixed by the parameters) is broadcast, and batches of
texts are scored as sparse rows: gather the matrix at the n-grams' buckets, add up per document.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, trim, unused

#: Buckets of the hashed n-grams, their orders, the most labelled documents that a fit reads, the tasks that
#: count them, the languages whose matrix is broadcast at once, those that a counting task holds, and the most
#: languages that are learned (the most frequent ones).
BITS, ORDERS, FIT_DOCS, FIT_TASKS, BLOCK, HELD, LANGS = 16, (1, 2, 3), 20_000, 16, 256, 64, 512
_CHUNK = 4096
_MULT = {1: (0x9E3779B97F4A7C15,), 2: (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 3: (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)}


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the batch's lower-cased texts, non-letters as 0 and two 0 around each text; where
    each text starts; how many letters each has."""
    low = pc.fill_null(pc.utf8_lower(batch.column("text")), "")
    flat = np.frombuffer(("\n\n" + "\n\n".join(low.to_pylist()) + "\n\n").encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(size + 2)))
    letter = _letters()[flat]
    flat = np.where(letter, flat, 0).astype(np.uint32)
    total = np.concatenate(([0], np.cumsum(letter)))
    return flat, start[:-1], total[start[1:]] - total[start[:-1]]


def _buckets(flat: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position (those of non-letters alone get the last one)."""
    n = len(flat) - order + 1
    h = np.full(n, np.uint64(order))
    for k in range(order):
        h = h + flat[k : k + n].astype(np.uint64) * np.uint64(_MULT[order][k])
    h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    h = h.astype(np.int32)
    empty = flat[:n] == 0
    for k in range(1, order):
        empty &= flat[k : k + n] == 0
    h[empty] = 1 << BITS
    return h


def _count(langs: list[str]):
    """Counts of a task's texts in rows of (language, chunk of buckets), text by language; a vector for each of
    the languages that came, of ``HELD`` at most before they are passed on."""

    def rows(seen: dict[int, int], counts: dict[int, np.ndarray]):
        for i, vector in counts.items():
            for c in range(0, 1 << BITS, _CHUNK):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([i], pa.int32()), "chunk": pa.array([c], pa.int32()), "docs": pa.array([seen[i]], pa.int64()), "counts": pa.array([vector[c : c + _CHUNK].tobytes()], pa.binary())})

    def run(batches):
        number, seen, counts = {x: i for i, x in enumerate(langs)}, {}, {}
        for b in pieces(batches):
            for lang in pc.unique(b.column("lang")).to_pylist():
                i, mine = number[lang], b.filter(pc.equal(b.column("lang"), lang))
                flat, _, _ = _points(mine)
                if i not in counts and len(counts) == HELD:
                    yield from rows(seen, counts)
                    seen, counts = {}, {}
                seen[i] = seen.get(i, 0) + mine.num_rows
                counts.setdefault(i, np.zeros((1 << BITS) + 1, np.int64))
                for order in ORDERS:
                    counts[i] += np.bincount(_buckets(flat, order), minlength=(1 << BITS) + 1)
        yield from rows(seen, counts)
        trim()

    return run


def _total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"lang": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "docs": pa.array([pc.sum(table.column("docs")).as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def share(sizes: list[int], total: int) -> float:
    """The most that each of the sizes may give so that together they give ``total``; smaller ones give all."""
    for k, size in enumerate(sorted(sizes)):
        most = total / (len(sizes) - k)
        if size >= most:
            return most
        total -= size
    return max(sizes)


def sampled(rows: DataFrame, rates: dict[str, float], most: dict[str, int]) -> DataFrame:
    """(lang, text) of distinct rows (doc_id, text, lang) of the languages in ``rates``: a share by a hash of id and text
    together, and of these the ``most`` of least hash. Rows that share an id or have none are rows like others."""
    of = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("lang")]
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    few = rows.where(F.col("lang").isin(list(rates))).withColumn("h", h).where(F.col("h") < of({k: math.ceil((1 << 40) * min(1.0, v)) for k, v in rates.items()}))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return few.withColumn("place", place).where(F.col("place") <= of(most)).select("lang", "text")


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, smoothing: float = 0.5, most_langs: int = LANGS) -> tuple[list[str], np.ndarray]:
    """(languages, float32 matrix languages x buckets of log probabilities; its last column is 0).

    ``labelled`` has doc_id, text and lang; rows with a null text or lang teach nothing. At most about ``fit_docs``
    rows teach and ``most_langs`` languages, the most frequent (documented bounds; all if there are fewer): all rows of
    the rarer languages, and of the others equally many each, chosen by a hash of id and text, rows that are the
    same in both once. Languages whose texts hold no letter are left out. Priors are equal.
    """
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs, n = sorted(sizes), sum(sizes.values())
    if not langs:
        return [], np.zeros((0, (1 << BITS) + 1), np.float32)
    if n > fit_docs:
        most = share(list(sizes.values()), fit_docs)
        rows = sampled(rows, {lang: 1.5 * most / size for lang, size in sizes.items()}, {lang: math.ceil(most) for lang in langs})
    else:
        rows = rows.where(F.col("lang").isin(langs))
    schema = "lang int, chunk int, docs long, counts binary"
    parts = rows.select("text", "lang").repartition(FIT_TASKS).mapInArrow(_count(langs), schema).groupBy("lang", "chunk").applyInArrow(_total, schema)
    counts = np.zeros((len(langs), (1 << BITS) + 1))
    for r in parts.collect():  # languages x 16 rows of 32 KB
        counts[r["lang"], r["chunk"] : r["chunk"] + _CHUNK] = np.frombuffer(r["counts"], np.int64)
    learned = np.flatnonzero(counts[:, :-1].any(axis=1))
    langs, counts = [langs[i] for i in learned], counts[learned]
    logs = np.log(counts + smoothing)
    logs -= np.log((counts[:, :-1] + smoothing).sum(axis=1, keepdims=True))
    logs[:, -1] = 0
    return langs, logs.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, in place of text unless it is kept: the likeliest language and its
    posterior probability under equal priors (ties: the alphabetically first). A null text, a text without a
    letter and a model without languages give ``und`` and 0. Texts are scored whole; repeated rows alike; an
    empty table stays empty. Columns named lang_pred or score are replaced, other columns stay.

    The matrix is broadcast in blocks of 256 languages; more languages take one pass of the texts per block,
    which carries the best language so far and the sum of the posterior.
    """
    langs, logs = model
    keep = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]
    best, top, mass = unused(docs, "best_lang", "best_log", "mass")
    blocks = range(0, max(1, len(langs)), BLOCK)
    for at in blocks:
        first, last = at == 0, at == blocks[-1]
        carried = [] if first else [best, top, mass]
        took = docs.select(*keep, "text", *carried)
        made = took.select(*keep, *(["text"] if keep_text or not last else []))
        none = [F.lit("").alias(best), F.lit(0.0).alias(top), F.lit(0.0).alias(mass)]
        out = made.select("*", *([F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")] if last else none)).schema
        docs = took.mapInArrow(_score(docs, langs[at : at + BLOCK], logs[at : at + BLOCK], made.columns, carried, ["lang_pred", "score"] if last else [best, top, mass]), out)
    return docs


def _score(docs: DataFrame, langs: list[str], logs: np.ndarray, keep: list[str], carried: list[str], gives: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        table = shared.value
        for b in pieces(batches):
            flat, start, letters = _points(b)
            scores = np.zeros((len(langs), b.num_rows))
            for order in ORDERS:
                h = _buckets(flat, order)
                h = np.concatenate((h, np.full(len(flat) - len(h), 1 << BITS, h.dtype)))
                for i in range(len(langs)):
                    scores[i] += np.add.reduceat(table[i][h], start, dtype=np.float64)
            if langs:
                top = scores.max(axis=0)
                names, mass = np.array(langs, object)[scores.argmax(axis=0)], np.exp(scores - top).sum(axis=0)
            else:
                names, top, mass = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.full(b.num_rows, np.inf)
            if carried:  # the languages of the blocks before come first
                was, high, sum_ = (b.column(c) for c in carried)
                high, sum_ = high.to_numpy(zero_copy_only=False), sum_.to_numpy(zero_copy_only=False)
                more = np.maximum(top, high)
                names = np.where(top > high, names, np.array(was.to_pylist(), object))
                top, mass = more, mass * np.exp(top - more) + sum_ * np.exp(high - more)
            if len(gives) == 2:
                known = letters > 0
                end = [pa.array(np.where(known, names, "und").tolist(), pa.string()), pa.array(np.where(known, 1 / mass, 0.0))]
            else:
                end = [pa.array(names.tolist(), pa.string()), pa.array(top), pa.array(mass)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *end], names=[*keep, *gives])
        trim()

    return run

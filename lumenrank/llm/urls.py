"""URL filter: rules first, then the ratio of two character models.

URLs that a rule accepts or rejects teach. Of each class a variable-order Markov model counts which character
follows which context of up to five characters (all URLs of the class that aren't held out; the tables have a
fixed size: contexts of up to two characters by themselves, longer ones hashed). A character's probability is
smoothed from order to order (Witten-Bell): a context that was never seen leaves that of the next shorter one
alone, so the order varies by place. A URL's score is the log-likelihood under the rejected model less that
under the accepted one, in bits a character. Held-out URLs calibrate: at the threshold no more than a given
share of the accepted ones would be blocked, and where the two classes lie apart it is the middle between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, ragged, texts, trim, unused

#: Longest context; context classes of the longer orders (2 to this power each); classes of characters.
ORDER, BITS, SYMBOLS = 5, 13, 64
#: One of so many URLs that a rule judges is held out from counting and calibrates; share of accepted URLs that the
#: threshold may cost; bins of scores, by bit.
FOLDS, MOST_FALSE, BINS, REACH = 5, 0.01, 256, 16
_KNOWN = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:~+,;@!$*()'"
_SIZES = [SYMBOLS**k if k < 3 else 1 << BITS for k in range(ORDER + 1)]
_BEGIN = np.concatenate(([0], np.cumsum(_SIZES)))
CONTEXTS = int(_BEGIN[-1])
_CHUNK = 1 << 17


def _classes() -> np.ndarray:
    """Class of each byte: 0 is kept for the ends of a URL, letters count without case."""
    out = np.full(256, SYMBOLS - 2, np.uint8)
    out[128:] = SYMBOLS - 1
    for i, c in enumerate(_KNOWN):
        out[ord(c)] = out[ord(c.upper())] = i + 1
    return out


_CLASS = _classes()


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to
    ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """struct(rule, verdict) of the longest rule ``host/path`` that fits: its host or a subdomain, and a path that
    starts with its path; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(out)
    return out


def _said(url: Column) -> Column:
    """What the models read: the URL without its scheme."""
    start = F.locate("://", url)
    return F.when(start > 0, F.substr(url, start + 3)).otherwise(F.coalesce(url, F.lit("")))


def cells(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of every order at every character, that character, where each text begins among them). A text's
    end is a character; before a text stand ends."""
    size = np.diff(off)
    wide = size + ORDER + 1
    start = np.cumsum(wide) - wide
    flat = np.zeros(int(wide.sum()), np.uint64)
    flat[ragged(start + ORDER, size)] = _CLASS[data]
    at = ragged(start + ORDER, size + 1)
    code, out = np.zeros(len(at), np.uint64), np.empty((ORDER + 1, len(at)), np.int64)
    for k in range(ORDER + 1):
        if k:
            code = code + flat[at - k] * np.uint64(SYMBOLS ** (k - 1))
        h = code if k < 3 else ((code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        out[k] = h.astype(np.int64) + int(_BEGIN[k])
    return out, flat[at].astype(np.int64), np.cumsum(size + 1) - (size + 1)


def _count(batches):
    counts = {}
    for b in pieces(batches, "said"):
        reject = b.column("reject").to_numpy(zero_copy_only=False)
        for side in np.unique(reject).tolist():
            mine = b.filter(pa.array(reject == side))
            context, symbol, _ = cells(*texts(mine, "said"))
            got = np.bincount((context * SYMBOLS + symbol).ravel(), minlength=CONTEXTS * SYMBOLS)
            counts[side] = counts[side] + got if side in counts else got
    for side, c in counts.items():
        for at in range(0, len(c), _CHUNK):
            full = np.flatnonzero(c[at : at + _CHUNK])
            if len(full):
                yield pa.RecordBatch.from_pydict({"reject": pa.array([side]), "chunk": pa.array([at], pa.int32()), "cells": pa.array([full.astype(np.int32).tobytes()], pa.binary()), "counts": pa.array([c[at + full].tobytes()], pa.binary())})
    trim()


def _total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CHUNK, np.int64)
    for b in batches:
        for cell, n in zip(b.column("cells").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(cell, np.int32)] += np.frombuffer(n, np.int64)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"reject": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([full.astype(np.int32).tobytes()], pa.binary()), "counts": pa.array([total[full].tobytes()], pa.binary())})


def fit(judged: DataFrame) -> np.ndarray:
    """Counts (accepted and rejected x contexts x characters) of URLs (said, reject); they have a fixed size."""
    form = "reject boolean, chunk int, cells binary, counts binary"
    counts = np.zeros((2, CONTEXTS * SYMBOLS))
    for r in judged.mapInArrow(_count, form).groupBy("reject", "chunk").applyInArrow(_total, form).collect():  # tables of a fixed size
        counts[int(r["reject"]), r["chunk"] + np.frombuffer(r["cells"], np.int32)] = np.frombuffer(r["counts"], np.int64)
    return counts.astype(np.float32).reshape(2, CONTEXTS, SYMBOLS)


def bits(model: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Bits of every character under one class's counts, smoothed from order to order."""
    seen, kinds = model.sum(axis=1, dtype=np.float64), (model > 0).sum(axis=1).astype(np.float64)
    p = np.full(len(symbol), 1 / SYMBOLS)
    for c in context:
        n, t = seen[c], kinds[c]
        p = np.where(n > 0, (model[c, symbol] + t * p) / np.maximum(n + t, 1), p)
    return -np.log2(p)


def scored(pages: DataFrame, model: np.ndarray, name: str) -> DataFrame:
    """``pages`` with the score in place of the text ``said``; 0 for a text without characters."""
    keep = [c for c in pages.columns if c != "said"]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        for b in pieces(batches, "said"):
            data, off = texts(b, "said")
            context, symbol, begin = cells(data, off)
            more = bits(shared.value[0], context, symbol) - bits(shared.value[1], context, symbol)
            size = np.diff(off)
            score = np.where(size > 0, np.add.reduceat(more, begin) / (size + 1), 0.0) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score, pa.float64())], names=[*keep, name])
        trim()

    return pages.select(*keep, "said").mapInArrow(run, pages.select(*keep, F.lit(0.0).alias(name)).schema)


def calibrate(held: DataFrame, most_false: float = MOST_FALSE) -> float:
    """The least score (a bin's upper edge) above which at most ``most_false`` of the accepted URLs of ``held`` (reject,
    score) lie, or the middle between it and the largest (a bin's lower edge) below which at most as many of the
    rejected ones lie, if that is more; infinity where either class is missing."""
    at = F.least(F.greatest(F.floor((F.col("score") + REACH) * BINS), F.lit(0)), F.lit(2 * REACH * BINS - 1))
    counts = np.zeros((2, 2 * REACH * BINS), np.int64)
    for r in held.groupBy("reject", at.alias("at")).count().collect():  # two rows a bin at most
        counts[int(r["reject"]), r["at"]] = r["count"]
    if not counts.any(axis=1).all():
        return float("inf")
    above = counts[0].sum() - counts[0].cumsum()
    below = counts[1].cumsum() - counts[1]
    accepted = (np.flatnonzero(above <= most_false * counts[0].sum())[0] + 1) / BINS - REACH
    rejected = np.flatnonzero(below <= most_false * counts[1].sum())[-1] / BINS - REACH
    return float(max(accepted, (accepted + rejected) / 2))


def judge(pages: DataFrame, rules: dict[str, str], url_col: str = "url", most_false: float = MOST_FALSE) -> DataFrame:
    """``pages`` without other columns named so, with host, path, rule (null: none fits), verdict (``allow`` or
    ``block``) and score.

    The longest rule that fits decides; ``rules`` maps ``host/path`` to a verdict and is a bounded list of literals.
    Other URLs are blocked if their score lies above the calibrated threshold. Null and empty URLs, and every URL
    where the rules don't give both accepted and rejected URLs to learn from and to calibrate with, are allowed
    unless a rule says otherwise; URLs are read whole, bytes outside ASCII as one class; repeated rows teach each
    and are judged alike; an empty table stays empty; other columns stay.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    url, (host, path) = F.col(url_col), split_url(F.col(url_col))
    said, ruled = unused(pages, "said", "ruled")
    ready = pages.select(*keep, host.alias("host"), path.alias("path"), _said(url).alias(said)).withColumn(ruled, rule_of(F.col("host"), F.col("path"), rules))
    taught = ready.where(F.col(ruled).isNotNull()).select(F.col(said).alias("said"), (F.col(f"{ruled}.verdict") == "block").alias("reject"))
    aside = F.pmod(F.crc32(F.col("said").cast("binary")), F.lit(FOLDS)) == 0
    model = fit(taught.where(~aside))
    enough = model.any(axis=(1, 2)).all()
    threshold = calibrate(scored(taught.where(aside), model, "score"), most_false) if enough else float("inf")
    # the models go by fixed names, so the columns are handed over under them
    names = [f"c{i}" for i in range(len(ready.columns))]
    renamed = ready.toDF(*names).withColumnRenamed(names[ready.columns.index(said)], "said")
    got = scored(renamed, model, "score")
    back = dict(zip(names, ready.columns, strict=True))
    got = got.select(*[F.col(c).alias(back.get(c, c)) for c in got.columns if c != "score"], F.col("score"))
    verdict = F.coalesce(F.col(f"{ruled}.verdict"), F.when((F.col("score") > threshold) & (F.length(F.coalesce(url, F.lit(""))) > 0), "block").otherwise("allow"))
    return got.select(*keep, "host", "path", F.col(f"{ruled}.rule").alias("rule"), verdict.alias("verdict"), "score")

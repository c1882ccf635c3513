"""Mixing sources to target weights: raking of token weights, and calibrated sampling.

Tokens are added up per cell (source, language, topic). Iterative proportional fitting scales the cells, in
turn for each source, language and topic, until their sums meet every target; since a document can't be taken
more than whole, each scaling solves for the factor with which the cells, none beyond its tokens, add up to
the target. A cell's fitted weight over its tokens is then the probability its documents are sampled with, so
the expected tokens of the sample meet the targets. Sampling compares a digest of doc_id with that
probability, so it is repeatable.

Topics, where the documents bring none, are multinomial mixtures over hashed words, fitted inside each
language on all its documents and numbered by falling size: topics of all languages taken together would be
little else than the languages. The documents' word counts are stored once; each round of the fit is one pass
over them, whose sums are of whole numbers, so they are the same however the rows are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, small, stored, texts, trim, unused
from .jaccard import _powers, hashed_words
from .langid import sampled
from .langid import share as fair_share

DIMS = ("source", "lang", "topic")
#: Topics of a language; hashed-word buckets; rounds of the fit; the languages, by falling number of documents,
#: that have topics of their own, and the name of the topics that the documents of all others share; the steps of
#: a document's share in a topic.
TOPICS, BUCKETS, FIT_ROUNDS, LANGS, OTHERS, STEPS = 4, 1024, 15, 256, "(others)", 1 << 20
#: Relative error of a marginal at which raking is done; rounds after which targets count as contradictory;
#: cells (a few numbers each) up to which the driver rakes; beyond, Spark does.
TOLERANCE, ROUNDS, DRIVER_CELLS = 1e-9, 4000, 1_000_000
#: Budgets tried, as shares of the first, until the targets can be met together.
BUDGETS = [0.97**k for k in range(24)]


# ---- topics


def _bags(languages: list[str]):
    """Rows (language number, bucket counts) of sampled documents."""

    def run(batches):
        for b in pieces(batches):
            doc, words = hashed_words(*texts(b))
            key = doc * BUCKETS + (words >> np.uint64(54)).astype(np.int64)
            bags = np.bincount(key, minlength=b.num_rows * BUCKETS).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "bag": pa.array([x.tobytes() for x in bags.reshape(b.num_rows, BUCKETS)], pa.binary())})

    return run


def mixture(bags: np.ndarray, topics: int = TOPICS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Log probabilities (topics x buckets, the prior in a last column) of a multinomial mixture, by
    expectation-maximisation from documents far from each other; topics in falling order of their words."""
    size = bags.sum(axis=1)
    shares = bags / np.maximum(size, 1)[:, None]
    chosen, far = [int(size.argmax())], np.full(len(bags), np.inf)
    for _ in range(topics - 1):
        far = np.minimum(far, ((shares - shares[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int((far * np.minimum(size, 100)).argmax()))
    p, prior = shares[chosen] + shares.mean(axis=0) + 1e-6, np.full(topics, 1 / topics)
    for _ in range(rounds):
        p /= p.sum(axis=1, keepdims=True)
        like = bags @ np.log(p).T + np.log(prior)
        z = np.exp(like - like.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        prior = (z.sum(axis=0) + 1) / (len(bags) + topics)
        p = z.T @ bags + 0.1
    order = np.argsort(-(z.T @ size), kind="stable")
    return np.hstack((np.log(p / p.sum(axis=1, keepdims=True)), np.log(prior)[:, None]))[order].astype(np.float32)


def _counted(languages: list[str]):
    """A row for each piece of the documents with words: the documents' languages (their places in the list), where each
    one's entries begin, and the entries (bucket, count)."""

    def run(batches):
        place = {x: i for i, x in enumerate(languages)}
        for b in pieces(batches):
            doc, words = hashed_words(*texts(b))
            bags = np.bincount(doc * BUCKETS + (words >> np.uint64(54)).astype(np.int64), minlength=b.num_rows * BUCKETS)
            at = np.flatnonzero(bags)
            size = np.bincount(at // BUCKETS, minlength=b.num_rows)
            full = size > 0
            if full.any():
                lang = np.array([place[x] for x in b.column("lang").to_pylist()], np.int32)[full]
                made = {"langs": lang, "first": np.concatenate(([0], np.cumsum(size[full]))).astype(np.int32), "buckets": (at % BUCKETS).astype(np.uint16), "counts": bags[at].astype(np.uint32)}
                yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in made.items()})
        _powers.cache_clear()
        trim()

    return run


def _entries(batches):
    """(language of each document, document, bucket and count of each entry) of each row of ``_counted``."""
    for b in batches:
        for i in range(b.num_rows):
            langs, first, buckets, counts = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("langs", np.int32), ("first", np.int32), ("buckets", np.uint16), ("counts", np.uint32)))
            yield langs, np.repeat(np.arange(len(langs)), np.diff(first)), buckets.astype(np.int64), counts.astype(np.float64)


_SUMS, _FAR = "lang int, sums binary", "lang int, far double, bag binary"


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
    return pa.table({"lang": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _farthest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    far, bag = min(zip(table.column("far").to_pylist(), table.column("bag").to_pylist()), key=lambda x: (-x[0], x[1]))
    return pa.table({"lang": pa.array([key[0].as_py()], pa.int32()), "far": pa.array([far]), "bag": pa.array([bag], pa.binary())})


def _sums(n_langs: int, rows: int, of):
    """Per language of a task's documents the sums of whole numbers that ``of`` gives a piece: (rows x languages x columns)."""

    def run(batches):
        total = 0
        for piece in _entries(batches):
            total = total + of(*piece).reshape(rows, n_langs, -1).astype(np.int64)
        if not isinstance(total, int):
            seen = np.flatnonzero(total.any(axis=(0, 2)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(seen, pa.int32()), "sums": pa.array([total[:, i].tobytes() for i in seen], pa.binary())})
        trim()

    return run


def _far(shared, n_langs: int):
    """Per language the document that is farthest from all chosen ones (none chosen: the longest), of equal ones that of
    the least bag. Chosen are shares (documents x languages x buckets)."""

    def run(batches):
        chosen, best = shared.value, {}
        for langs, doc, bucket, count in _entries(batches):
            n = len(langs)
            size = np.bincount(doc, count, n)
            score = size
            if len(chosen):
                share, cell, far = count / size[doc], langs[doc] * BUCKETS + bucket, np.full(n, np.inf)
                for c in chosen:
                    there = c.ravel()[cell]
                    far = np.minimum(far, np.bincount(doc, (share - there) ** 2 - there**2, n) + (c**2).sum(axis=1)[langs])
                score = np.maximum(far, 0) * np.minimum(size, 100)
            for i in np.unique(langs).tolist():
                top = score[langs == i].max()
                if i in best and top < best[i][0]:
                    continue
                for d in np.flatnonzero((langs == i) & (score == top)):
                    mine = slice(*np.searchsorted(doc, [d, d + 1]))
                    bag = np.bincount(bucket[mine], count[mine], BUCKETS).astype(np.float32).tobytes()
                    best[i] = min(best.get(i, (top, bag)), (top, bag), key=lambda x: (-x[0], x[1]))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(best), pa.int32()), "far": pa.array([float(x[0]) for x in best.values()], pa.float64()), "bag": pa.array([x[1] for x in best.values()], pa.binary())})
        trim()

    return run


def _mixtures(counted: DataFrame, n_langs: int, topics: int = TOPICS, rounds: int = FIT_ROUNDS) -> dict[int, np.ndarray]:
    """``mixture`` of each language (its place) over all rows of ``_counted``."""
    spark = counted.sparkSession
    cast = spark.sparkContext.broadcast

    def added(of, rows: int) -> np.ndarray:
        """(rows x languages x columns), in Spark summed up per language."""
        got = {r["lang"]: np.frombuffer(r["sums"], np.int64).reshape(rows, -1) for r in counted.mapInArrow(_sums(n_langs, rows, of), _SUMS).groupBy("lang").applyInArrow(_added, _SUMS).collect()}
        none = np.zeros_like(next(iter(got.values()))) if got else np.zeros((rows, 1), np.int64)
        return np.stack([got.get(i, none) for i in range(n_langs)], axis=1)

    def shares(langs, doc, bucket, count):
        share = np.rint(count / np.bincount(doc, count, len(langs))[doc] * STEPS)
        return np.hstack((np.bincount(langs[doc] * BUCKETS + bucket, share, n_langs * BUCKETS).reshape(n_langs, -1), np.bincount(langs, minlength=n_langs)[:, None]))

    first = added(shares, 1)[0]
    docs = first[:, -1].astype(np.float64)
    known = np.flatnonzero(docs)
    if not len(known):
        return {}
    chosen = np.zeros((0, n_langs, BUCKETS))
    for _ in range(topics):
        sent, next_ = cast(chosen), np.zeros((1, n_langs, BUCKETS))
        for r in counted.mapInArrow(_far(sent, n_langs), _FAR).groupBy("lang").applyInArrow(_farthest, _FAR).collect():
            bag = np.frombuffer(r["bag"], np.float32).astype(np.float64)
            next_[0, r["lang"]] = bag / bag.sum()
        sent.unpersist()
        chosen = np.concatenate((chosen, next_))
    p = chosen + first[:, :-1] / STEPS / np.maximum(docs, 1)[:, None] + 1e-6
    prior = np.full((topics, n_langs), 1 / topics)
    for _ in range(rounds):
        sent = cast((np.log(p / p.sum(axis=2, keepdims=True)).reshape(topics, -1), np.log(prior)))

        def halves(langs, doc, bucket, count, sent=sent):
            (logs, priors), cell, n = sent.value, langs[doc] * BUCKETS + bucket, len(langs)
            like = np.stack([np.bincount(doc, count * row[cell], n) + before[langs] for row, before in zip(logs, priors, strict=True)])
            z = np.exp(like - like.max(axis=0))
            z = np.rint(z / z.sum(axis=0) * STEPS)
            words = [np.bincount(cell, count * k[doc], n_langs * BUCKETS).reshape(n_langs, -1) for k in z]
            return np.stack([np.hstack((w, np.bincount(langs, k, n_langs)[:, None])) for w, k in zip(words, z, strict=True)])

        got = added(halves, topics) / STEPS
        sent.unpersist()
        prior = (got[:, :, -1] + 1) / (docs + topics)
        words = got[:, :, :-1]
        p = words + 0.1
    logs, out = np.log(p / p.sum(axis=2, keepdims=True)), {}
    for i in known.tolist():
        order = np.argsort(-words[:, i].sum(axis=1), kind="stable")
        out[i] = np.hstack((logs[:, i], np.log(prior[:, i])[:, None]))[order].astype(np.float32)
    return out


def fit_topics(docs: DataFrame, fit_docs: int | None = None, most_langs: int = LANGS) -> dict[str, np.ndarray]:
    """A mixture for each language (null: ``(none)``) of the documents (doc_id, text, lang), fitted on all that have
    words; repeated rows teach as often as they come, and whole texts count. Beyond ``most_langs`` languages the rarer
    ones share a mixture, ``(others)``. A caller who asks for ``fit_docs`` has it fitted on at most so many documents,
    equally many a language (rarer ones all), chosen by a hash of id and text together."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("lang")).where(F.length("text") > 0)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not sizes:
        return {}
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(list(sizes)), F.col("lang")).otherwise(OTHERS))
    if fit_docs is None:
        langs = sorted({*sizes, OTHERS})
        counted = stored(rows.select("text", "lang").mapInArrow(_counted(langs), "langs binary, first binary, buckets binary, counts binary"), "bags")
        models = _mixtures(counted, len(langs))
        discard(counted)
        return {langs[i]: m for i, m in models.items()}
    if len(sizes) == most_langs:
        rest = rows.where(F.col("lang") == OTHERS).count()
        sizes |= {OTHERS: rest} if rest else {}
    most = fair_share(list(sizes.values()), fit_docs) if sum(sizes.values()) > fit_docs else max(sizes.values())
    few = sampled(rows, {lang: 1.5 * most / n for lang, n in sizes.items()}, {lang: max(1, int(most)) for lang in sizes})
    got: dict[str, list] = {}
    for r in few.mapInArrow(_bags(sorted(sizes)), "lang string, bag binary").collect():
        got.setdefault(r["lang"], []).append(np.frombuffer(r["bag"], np.float32))
    return {lang: mixture(np.stack(sorted(bags, key=lambda x: x.tobytes())).astype(np.float64)) for lang, bags in got.items()}


def features(docs: DataFrame, topic: Column | None = None, fit_docs: int | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...), without text unless it is kept, with topic and tokens (its words). ``topic`` is a
    topic that the documents have; without it topics are fitted. A text without words has no topic. Columns named topic or tokens are replaced."""
    models = {} if topic is not None else fit_topics(docs, fit_docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # languages x topics x buckets
    if topic is not None:
        given, = unused(docs, "given_topic")
        docs = docs.withColumn(given, topic.cast("string"))
    own = [c for c in docs.columns if c.lower() not in ("text", "topic", "tokens") and (topic is None or c != given)]
    lang, = unused(docs, "lang_of")
    own += ["text"] if keep_text else []
    marked = docs.select(*dict.fromkeys([*own, "text"]), F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias(lang), *([F.col(given)] if topic is not None else []))
    out = marked.select(*own, F.lit(None).cast("string").alias("topic"), F.lit(0).cast("long").alias("tokens")).schema
    brought = given if topic is not None else None

    def run(batches):
        for b in pieces(batches):
            doc, words = hashed_words(*texts(b))
            count = np.bincount(doc, minlength=b.num_rows)
            if brought is not None:
                names = b.column(brought)
            else:
                bucket, best = (words >> np.uint64(54)).astype(np.int64), np.full(b.num_rows, -1)
                langs = np.array([x if x in shared.value else OTHERS for x in b.column(lang).to_pylist()], object)
                for name in set(langs):
                    mine = langs == name
                    if name in shared.value:
                        logs, at = shared.value[name], mine[doc]
                        like = np.stack([np.bincount(doc[at], row[bucket[at]], b.num_rows) + row[BUCKETS] for row in logs])
                        best[mine] = like[:, mine].argmax(axis=0)
                names = pa.array([f"t{k}" if k >= 0 and n else None for k, n in zip(best, count)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], names, pa.array(count.astype(np.int64))], names=[*own, "topic", "tokens"])
        _powers.cache_clear()
        trim()

    return marked.mapInArrow(run, out)


# ---- raking


def levels(tokens: np.ndarray, scale: np.ndarray, code: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per value the factor f at which its cells, min(tokens, tokens x scale x f), add up to the target; a
    very large one for a target of all that they hold. Newton steps from below: the sum is concave in f."""
    n = len(target)
    f, whole = np.zeros(n), np.bincount(code, tokens, n)
    for _ in range(200):
        full = scale * f[code] >= 1
        left, slope = target - np.bincount(code, tokens * full, n), np.bincount(code, tokens * scale * ~full, n)
        new = np.divide(left, slope, out=f.copy(), where=slope > 0)
        if not (new > f * (1 + 1e-15)).any():
            break
        f = np.maximum(f, new)
    return np.where(target < whole * (1 - 1e-9), f, 1e12)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(probability of every cell, largest relative error of a marginal): tokens x probability meets each
    dimension's targets (codes: each cell's value there), where they can be met together."""
    scale, error, before = np.ones(len(tokens)), np.inf, np.inf
    for i in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            scale = np.clip(scale * levels(tokens, scale, code, target)[code], 1e-12, 1e12)
        p = np.minimum(1.0, scale)
        error = max(float(np.max(np.abs(np.bincount(c, tokens * p, len(t)) - t) / t, initial=0)) for c, t in zip(codes, targets, strict=True))
        if error < tolerance or (i % 100 == 99 and error > 0.9 * before):  # done, or stuck
            break
        before = error if i % 100 == 99 else before
    return np.minimum(1.0, scale), error


def wanted(held: np.ndarray, power: float, named: np.ndarray, budget: float) -> np.ndarray:
    """Target tokens of a dimension's values, which hold ``held``. ``named`` are shares that are asked for (nan:
    none); the other values get what is left in proportion to held ** power, none more than it holds."""
    out = np.where(np.isnan(named), 0.0, named * budget)
    free = np.isnan(named)
    if free.any():
        w = np.power(held[free].astype(np.float64), power) / held[free]
        w /= w.max()
        out[free] = held[free] * np.minimum(1.0, w * levels(held[free], w, np.zeros(int(free.sum()), int), np.array([max(budget - out.sum(), 1e-9)]))[0])
    return out


@dataclass
class Mix:
    """Raked cells. ``cells``: source, lang, topic (strings, null as ``(none)``), probability. ``marginals``: dimension,
    value, target and achieved (shares of the sample's expected tokens), residual (their difference).
    ``budget``: the sample's expected tokens; ``error``: the largest relative error of a marginal."""

    cells: DataFrame
    marginals: DataFrame
    budget: float
    error: float


def _limits(held: dict[str, dict[str, int]], shares: dict[str, dict[str, float]], budget: float) -> float:
    """The budget, or the most that every share asked for can be met at."""
    for d, asked in shares.items():
        if sum(asked.values()) > 1 + 1e-9 or min(asked.values(), default=0) < 0:
            raise ValueError(f"shares of {d} must be at least 0 and add up to 1 at most")
        for v, s in asked.items():
            if s > 0:
                if not held[d].get(v):
                    raise ValueError(f"{d} {v} has no tokens to give")
                budget = min(budget, held[d][v] / s)
        named = sum(asked.values())
        rest = sum(n for v, n in held[d].items() if v not in asked)
        if named < 1 - 1e-9:
            if not rest:
                raise ValueError(f"shares of {d} add up to less than 1 and no other value is there")
            budget = min(budget, rest / (1 - named))
    return budget


def fit(marked: DataFrame, powers: dict[str, float], share: float, shares: dict[str, dict[str, float]] | None = None, strict: bool = False, driver_cells: int = DRIVER_CELLS) -> Mix:
    """Rakes the cells of ``marked`` (source, lang, topic, tokens); see ``mix`` for the parameters."""
    spark, shares = marked.sparkSession, shares or {}
    named = [F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d) for d in DIMS]
    cells = stored(marked.select(*named, "tokens").groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    held = {d: {r[0]: r[1] for r in cells.groupBy(d).agg(F.sum("tokens")).orderBy(d).collect()} for d in DIMS} if cells.count() <= driver_cells else None
    form, marginal = "source string, lang string, topic string, probability double", "dimension string, value string, target double, achieved double, residual double"
    if held is not None and not held[DIMS[0]]:
        return Mix(spark.createDataFrame([], form), spark.createDataFrame([], marginal), 0.0, 0.0)
    if held is None:
        return _in_spark(cells, powers, share, shares, strict)
    rows = sorted(cells.collect())
    names = {d: sorted(held[d]) for d in DIMS}
    tokens = np.array([r["tokens"] for r in rows], np.float64)
    codes = [np.searchsorted(np.array(names[d], object), np.array([r[d] for r in rows], object)) for d in DIMS]
    sums = [np.array([held[d][v] for v in names[d]], np.float64) for d in DIMS]
    asked = [np.array([shares.get(d, {}).get(v, np.nan) for v in names[d]]) for d in DIMS]
    first = _limits(held, shares, share * tokens.sum())
    best = None
    for part in BUDGETS:
        targets = [np.maximum(wanted(n, powers[d], a, part * first), 1e-9) for d, n, a in zip(DIMS, sums, asked, strict=True)]
        p, error = rake(tokens, codes, targets)
        if best is None or error < best[1]:
            best = p, error, targets, part * first
        if error < 1e-6:
            break
    p, error, targets, budget = best
    if strict and error >= 1e-6:
        raise ValueError(f"the targets can't be met together: largest relative error {error:.3g}")
    out = []
    for d, c, t in zip(DIMS, codes, targets, strict=True):
        got = np.bincount(c, tokens * p, len(t))
        out += [(d, v, float(x / budget), float(y / got.sum()), float(y / got.sum() - x / budget)) for v, x, y in zip(names[d], t, got, strict=True)]
    table = [(r["source"], r["lang"], r["topic"], float(x)) for r, x in zip(rows, p, strict=True)]
    discard(cells)
    return Mix(spark.createDataFrame(table, form), spark.createDataFrame(out, marginal), float(budget), error)


def _in_spark(cells: DataFrame, powers: dict[str, float], share: float, shares: dict[str, dict[str, float]], strict: bool, tolerance: float = 1e-8, rounds: int = 200) -> Mix:
    """The same for cells that are too many for the driver. The values of one dimension may be as many, so
    targets are tables, too; a visit to a dimension makes one step towards the factor that ``levels`` solves
    for, from grouped sums."""
    total = cells.agg(F.sum("tokens")).first()[0]
    budget = share * total
    held = {d: stored(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n")), "held") for d in DIMS}
    if shares:
        few = {d: {r[d]: r["n"] for r in held[d].where(F.col(d).isin(list(asked))).collect()} for d, asked in shares.items()}
        budget = _limits({d: v | {"(others)": total - sum(v.values())} for d, v in few.items()}, shares, budget)
    targets = {}
    for d in DIMS:
        asked = shares.get(d, {})
        fixed = F.coalesce(*[F.when(F.col(d) == v, s) for v, s in asked.items()], F.lit(None).cast("double")) if asked else F.lit(None).cast("double")
        t, left = held[d].withColumn("share", fixed), budget * (1 - sum(asked.values()))
        free, weight = F.col("share").isNull(), F.pow("n", F.lit(float(powers[d])))
        f, rise = 0.0, True
        while rise:  # as in ``levels``
            a, u = t.where(free).agg(F.sum(F.when(weight * f >= F.col("n"), F.col("n"))), F.sum(F.when(weight * f < F.col("n"), weight))).first()
            step = (left - (a or 0.0)) / u if u else f
            f, rise = max(f, step), step > f * (1 + 1e-15)
        targets[d] = stored(t.select(d, F.when(free, F.least("n", weight * f)).otherwise(F.col("share") * budget).alias("t")), "targets")
    now, error = stored(cells.withColumn("scale", F.lit(1.0)), "raked"), np.inf
    for _ in range(rounds):
        for d in DIMS:
            full = F.col("scale") >= 1
            sums = now.groupBy(d).agg(F.sum(F.col("tokens")).alias("all"), F.sum(F.when(full, F.col("tokens"))).alias("a"), F.sum(F.when(~full, F.col("tokens") * F.col("scale"))).alias("u")).na.fill(0.0)
            step = F.when(F.col("t") >= F.col("all") * (1 - 1e-9), 1e12).when(F.col("t") - F.col("a") > 0, F.when(F.col("u") > 0, (F.col("t") - F.col("a")) / F.col("u")).otherwise(1.0)).otherwise(0.5)
            now = now.join(sums.join(targets[d], d).select(d, step.alias("f")), d).select(*DIMS, "tokens", F.least(F.greatest(F.col("scale") * F.col("f"), F.lit(1e-12)), F.lit(1e12)).alias("scale"))
        before, now = now, stored(now, "raked")
        error = max(_error(now, d, targets[d]) for d in DIMS)
        if error < tolerance:
            break
    if strict and error >= 1e-6:
        raise ValueError(f"the targets can't be met together: largest relative error {error:.3g}")
    parts = []
    for d in DIMS:
        got = now.groupBy(d).agg(F.sum(F.col("tokens") * F.least("scale", F.lit(1.0))).alias("x")).join(targets[d], d)
        parts.append(got.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), (F.col("t") / budget).alias("target"), (F.col("x") / budget).alias("achieved"), ((F.col("x") - F.col("t")) / budget).alias("residual")))
    table = now.select(*DIMS, F.least("scale", F.lit(1.0)).alias("probability"))
    return Mix(table, parts[0].unionByName(parts[1]).unionByName(parts[2]), budget, error)


def _error(now: DataFrame, d: str, targets: DataFrame) -> float:
    got = now.groupBy(d).agg(F.sum(F.col("tokens") * F.least("scale", F.lit(1.0))).alias("x")).join(targets, d)
    return got.agg(F.max(F.abs(F.col("x") - F.col("t")) / F.col("t"))).first()[0] or 0.0


def mix(marked: DataFrame, powers: dict[str, float], share: float, seed: str, shares: dict[str, dict[str, float]] | None = None, strict: bool = False, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Documents (doc_id, source, lang, and the topic and tokens of ``features``) with probability and kept.

    ``shares[dimension][value]`` is the share of the sample's tokens that a value is to have; the other values
    get the rest in proportion to their tokens to the power ``powers[dimension]`` (1 keeps the proportions, 0
    makes them equal), none more than it holds. ``share`` of all tokens is the budget; where shares that are
    asked for, or all targets together, can't be met at it, the budget is the largest (in steps of 3 %) at which
    they can. Targets that contradict each other at every budget are met as nearly as the fit gets; ``fit``
    returns target, achieved and residual of every value, and ``strict`` raises.

    A null source, language or topic is a value of its own, called ``(none)``. Documents without tokens carry
    no weight and have probability 1; a null doc_id is sampled like an empty one. Rows that share a doc_id are
    kept or not by the same draw, each against its own cell. A clashing probability or kept column is replaced;
    other columns stay. ``marked`` is read twice: store it first where its features cost more than reading it.
    """
    raked = fit(marked, powers, share, shares, strict, driver_cells).cells
    keys = dict(zip(DIMS, unused(marked, *[f"{d}_cell" for d in DIMS]), strict=True))
    table = small(raked.select(*[F.col(d).alias(k) for d, k in keys.items()], "probability"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = marked.drop("probability", "kept").withColumns({k: F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d, k in keys.items()})
    out = out.join(table, list(keys.values()), "left").drop(*keys.values())
    out = out.withColumn("probability", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(1.0))
    return out.withColumn("kept", draw < F.col("probability"))

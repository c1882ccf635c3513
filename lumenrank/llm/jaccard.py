"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

1. A document's set of word n-grams is hashed to 64 bits, and the sets are shipped as packed vertical slices of
   the hash range, as many as their measured bytes ask for, each with only the documents it holds n-grams of.
2. Inside a slice every n-gram's document frequency is exact, so there the n-grams get their places in the
   global order: frequency octave, then slice, then rank. N-grams of one document can't overlap with anything:
   the slice returns their number per document, and the shared ones by their place in the order, whose leading
   bits are the octave. Added up over the slices this gives each document's size, its count of lone n-grams and
   its core of shared ones; documents with too many lone n-grams can't reach the threshold and are done.
3. Under the global order (lone n-grams first) two documents that link share an n-gram of their prefixes, and
   at the first one that they share their positions can't add up to more than the symmetric difference that the
   threshold allows.
4. Documents of equal sets stand for each other. Candidates are counted twice: first each prefix bucket's
   members against its cleanest member only, which settles groups of near copies with a number of pairs that
   grows with their members; then, between documents that are not yet in one component, all pairs that prefix,
   length, position and a sketch of the sets' parities (a lower bound of their difference) leave. Nothing is
   capped: each link lies inside a component in the end.
5. The global order is cut into contiguous fragments of frequency octaves. A pair's partial overlaps are counted
   in each fragment of the two cores by itself, and summed up per pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, ragged, salted_join, stored, texts, trim
from .components import components

N, THRESHOLD, SKETCH = 4, 85, 1024
#: First octaves of the fragments that the global order is cut into; bytes of a slice or a bucket that one task
#: works on at once; bytes of n-grams, and of shared n-grams, for each byte of text (measured); most tasks of a stage.
CUTS, TASK_BYTES, GRAM_BYTES, CORE_BYTES, MOST_TASKS = (1, 2, 4, 8), 32 << 20, 2.6, 0.6, 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_LETTER = _mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_PLACE = _mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | np.uint64(1)


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(int(out[k - 1]) * base % (1 << 64))
        k += m
    return out


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every word of the texts, in order; A-Z count as a-z."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = ~_SPACE[data]
    first = np.zeros(size + 1, bool)
    first[off] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:-1]
    after = np.concatenate((word[1:], [False])) & ~first[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    span = 1 << (size + 1).bit_length()
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(span, _BASE)[:size], out=sums[1:])
    back = _powers(span, pow(_BASE, -1, 1 << 64))
    words = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return np.searchsorted(off, start, "right") - 1, words


def ngrams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(document number, n-gram hash) of the distinct n-grams of texts, sorted by hash. A text of fewer than
    n words has one, its whole sequence; a text without words none."""
    doc, words = hashed_words(data, off)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    count = np.bincount(doc, minlength=len(off) - 1)
    begin = np.cumsum(count) - count
    full = count >= n
    at = ragged(begin[full], count[full] - n + 1)
    grams = np.zeros(len(at), np.uint64)
    for k in range(n):
        grams += words[at + k] * _PLACE[k]
    owner = [doc[at]]
    hashes = [_mix(grams)]
    for k in range(1, n):  # whole sequences of k words
        few = np.flatnonzero(count == k)
        h = np.full(len(few), np.uint64(k))
        for j in range(k):
            h += words[begin[few] + j] * _PLACE[8 * k + j]
        owner.append(few)
        hashes.append(_mix(h))
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(hashes, kind="stable")  # owners ascend within equal hashes of full texts
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _slices(fragments: int, n: int):
    def run(batches):
        for b in pieces(batches, most=1 << 20, rows=1 << 15):
            doc, h = ngrams(*texts(b), n)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            part = (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(fragments + 1))
            own, doc = np.unique(part * len(ids) + doc, return_inverse=True)  # a slice names its own documents
            begin = np.searchsorted(own, np.arange(fragments + 1) * len(ids))
            names, doc = ids[own % max(1, len(ids))], (doc - begin[part]).astype(np.uint16)
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array([names[begin[f] : begin[f + 1]].tobytes() for f in full], pa.binary()),
                    pa.array([doc[cut[f] : cut[f + 1]].tobytes() for f in full], pa.binary()),
                    pa.array([h[cut[f] : cut[f + 1]].tobytes() for f in full], pa.binary()),
                ],
                names=["frag", "ids", "docs", "grams"],
            )
        _powers.cache_clear()
        trim()

    return run


def _grouped(batches, key: str):
    """(key, its rows as dicts of buffers) of sorted batches, one key at a time."""
    now, rows = None, []
    for b in batches:
        cols = {c: b.column(c) for c in b.schema.names}
        for i, k in enumerate(cols[key].to_pylist()):
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append({c: v[i].as_buffer() if pa.types.is_binary(v.type) else v[i].as_py() for c, v in cols.items() if c != key})
    if rows:
        yield now, rows


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _count_fragment(buckets: int):
    def run(batches):
        for frag, rows in _grouped(batches, "frag"):
            tables = [np.frombuffer(r["ids"], np.int64) for r in rows]
            ids, number = np.unique(np.concatenate(tables), return_inverse=True)
            base, doc = 0, []
            for r, t in zip(rows, tables, strict=True):
                doc.append(number[base + np.frombuffer(r["docs"], np.uint16).astype(np.int64)].astype(np.int32))
                base += len(t)
            doc, h = np.concatenate(doc), np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in rows])
            again = len(ids) < base  # rows that share a doc_id are one document
            del rows, tables, number
            order = np.lexsort((doc, h)) if again else np.argsort(h, kind="stable")
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            if again:
                keep = new.copy()
                keep[1:] |= doc[1:] != doc[:-1]
                doc, new = doc[keep], new[keep]
            del h, order
            at = np.flatnonzero(new)
            df = np.diff(np.concatenate((at, [len(doc)])))
            run_of = np.cumsum(new) - 1
            lone = df[run_of] == 1
            lones = np.bincount(doc[lone], minlength=len(ids))
            rank = np.cumsum(df > 1) - 1
            doc, run_of = doc[~lone], run_of[~lone]
            grade = np.ceil(np.log2(df)).astype(np.uint8)
            shared = np.bincount(doc, minlength=len(ids))
            bucket = _bucket(ids, buckets)
            by = np.argsort(bucket[doc].astype(np.int64) << 32 | doc, kind="stable")
            doc, rank, grade = doc[by], rank[run_of[by]].astype(np.uint32), grade[run_of[by]]
            seen = np.flatnonzero(lones + shared)
            seen = seen[np.argsort(bucket[seen], kind="stable")]
            cut, cut_docs = np.searchsorted(bucket[doc], np.arange(buckets + 1)), np.searchsorted(bucket[seen], np.arange(buckets + 1))
            out: dict[str, list] = {"bucket": [], "frag": [], "ids": [], "lone": [], "shared": [], "rank": [], "grade": []}
            for k in np.flatnonzero(np.diff(cut_docs)):
                s, e = seen[cut_docs[k] : cut_docs[k + 1]], slice(cut[k], cut[k + 1])
                for c, v in zip(out.values(), (int(k), frag, ids[s].tobytes(), lones[s].astype(np.uint32).tobytes(), shared[s].astype(np.uint32).tobytes(), rank[e].tobytes(), grade[e].tobytes()), strict=True):
                    c.append(v)
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
        trim()

    return run


def odd_sketch(doc: np.ndarray, gram: np.ndarray, docs: int) -> np.ndarray:
    """Per document SKETCH bits (as signed 64-bit words), each the parity of the n-grams that hash to it. The
    sketches of two documents differ in at most as many bits as their sets differ in n-grams."""
    bit = (_mix(gram.astype(np.uint64)) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(doc.astype(np.int64) * SKETCH + bit, minlength=docs * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, SKETCH), axis=1).view(np.int64)


def _sets(threshold: int):
    def run(batches):
        for _, rows in _grouped(batches, "bucket"):
            part = lambda c, t: [np.frombuffer(r[c], t) for r in rows]
            own = part("ids", np.int64)
            ids, number = np.unique(np.concatenate(own), return_inverse=True)
            shared = np.concatenate(part("shared", np.uint32)).astype(np.int64)
            lone = np.bincount(number, np.concatenate(part("lone", np.uint32)), len(ids)).astype(np.int64)
            size = lone + np.bincount(number, shared, len(ids)).astype(np.int64)
            frag = np.repeat([r["frag"] for r in rows], [len(r["rank"]) // 4 for r in rows])
            gram = np.concatenate(part("grade", np.uint8)).astype(np.int64) << 56 | frag.astype(np.int64) << 32 | np.concatenate(part("rank", np.uint32)).astype(np.int64)
            doc = np.repeat(number, shared)
            able = 100 * (size - lone) >= threshold * size
            keep = able[doc]
            doc, gram = doc[keep], gram[keep]
            order = np.lexsort((gram, doc))
            doc, gram = doc[order], gram[order]
            cut = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(ids))))).astype(np.int32)
            for a in range(0, len(ids), 4096):
                b = min(a + 4096, len(ids))
                sketch = odd_sketch(doc[cut[a] : cut[b]] - a, gram[cut[a] : cut[b]], b - a)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(sketch.ravel()), mask=pa.array(~able[a:b]))
                core = pa.ListArray.from_arrays(pa.array(cut[a : b + 1] - cut[a]), pa.array(gram[cut[a] : cut[b]]), mask=pa.array(~able[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(size[a:b]), pa.array(lone[a:b]), core, sketch], names=["doc", "n", "lone", "core", "sketch"])
        trim()

    return run


def shingle_sets(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, n, lone, core, sketch) of every document with a word: its set's size, how many of its n-grams no
    other document has, the others in global order, rarest first, and their parities (both null: the
    document can't link)."""
    at_once = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices, buckets = (max(at_once, int(size * much / TASK_BYTES) + 1) for much in (GRAM_BYTES, CORE_BYTES))
    place = lambda df, key, n: df.repartitionById(min(n, MOST_TASKS), F.col(key) % min(n, MOST_TASKS)).sortWithinPartitions(key)
    cut = rows.mapInArrow(_slices(slices, n), "frag int, ids binary, docs binary, grams binary")
    counted = place(cut, "frag", slices).mapInArrow(_count_fragment(buckets), "bucket int, frag int, ids binary, lone binary, shared binary, rank binary, grade binary")
    return place(counted, "bucket", buckets).mapInArrow(_sets(threshold), "doc long, n long, lone long, core array<long>, sketch array<long>")


def _fits(n: Column, m: Column, threshold: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def _near(i: Column, j: Column, n: Column, m: Column, threshold: int) -> Column:
    """Positions i and j of a first shared n-gram leave the symmetric difference within its bound."""
    return (i + j) * (100 + threshold) <= (n + m) * (100 - threshold)


def overlaps(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted per fragment of the global order, and summed."""
    octave = lambda t: F.shiftright(t, 56)
    ends = [*CUTS[1:], 128]
    fragment = lambda lo, hi: F.filter("core", lambda t: (octave(t) >= lo) & (octave(t) < hi))
    cut = sets.select("doc", "n", F.posexplode(F.array(*[fragment(lo, hi) for lo, hi in zip(CUTS, ends, strict=True)])).alias("g", "seg")).where(F.size("seg") > 0)
    a = cut.select(F.col("doc").alias("a"), F.col("n").alias("na"), "g", F.col("seg").alias("sa"))
    b = cut.select(F.col("doc").alias("b"), F.col("n").alias("nb"), "g", F.col("seg").alias("sb"))
    partial = pairs.join(a, "a").join(b, ["b", "g"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("k"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return total.where(F.col("k") * 100 >= (F.col("na") + F.col("nb") - F.col("k")) * threshold).select("a", "b", F.col("k").alias("overlap"))


def near_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text).

    Words are runs of anything but the six ASCII white-space characters, A-Z lowered; a document's set are
    its distinct n-word shingles, the whole sequence if it has fewer words. Two documents link when 100 *
    intersection >= threshold * union; component_id is the least doc_id that links reach. Null, empty and
    blank texts have an empty set, link with nothing and are components of their own. Rows that share a
    doc_id are one document, whose set is the union; rows without doc_id are left out. Other columns are
    ignored. Hashes are 64 bits wide; two n-grams of one pair of documents are taken as equal by mistake
    with a probability of about their number squared over 2^64.
    """
    sets = stored(shingle_sets(docs, n, threshold), "sets")
    able = sets.where("core is not null")
    # equal sets have no lone n-grams and equal cores
    mark = F.struct("n", F.xxhash64("core").alias("x"), F.xxhash64(F.lit(7), "core").alias("y"))
    equal = able.where("lone = 0").select("doc", mark.alias("mark"))
    reps = equal.groupBy("mark").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = stored(salted_join(equal, reps, ["mark"]).select("doc", "rep").where("doc > rep"), "copies")
    single = stored(able.join(copies, "doc", "left_anti"), "singles")
    length = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    prefix = F.slice("core", F.lit(1), F.greatest(length - F.col("lone"), F.lit(0)).cast("int"))
    rows = single.select("doc", "n", "lone", F.posexplode(prefix).alias("k", "gram")).select("doc", "n", (F.col("lone") + F.col("k")).alias("pos"), "gram")
    centre = rows.groupBy("gram").agg(F.count("*").alias("members"), F.min(F.struct("pos", "n", "doc")).alias("c")).where("members > 1").drop("members")
    rows = prefixes = stored(rows.join(centre, "gram"), "prefixes")
    star = rows.where(F.col("doc") != F.col("c.doc")).where(_fits(F.col("n"), F.col("c.n"), threshold) & _near(F.col("pos"), F.col("c.pos"), F.col("n"), F.col("c.n"), threshold))
    star = stored(star.select(F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b")).distinct(), "pairs")
    links = stored(overlaps(star, single, threshold), "overlaps")
    found = components(links)
    discard(links)
    # between different components: whatever prefix, length and position leave
    rows = rows.select("gram", "doc", "n", "pos").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    before, rows = prefixes, stored(rows, "open")
    discard(before)
    lowest = rows.groupBy("gram", "component").agg(F.min("pos").alias("pos"))
    best = lowest.groupBy("gram").agg(F.min(F.struct("pos", "component")).alias("best"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    second = lowest.join(best, "gram").where(F.col("component") != F.col("best.component")).groupBy("gram", "best").agg(F.min("pos").alias("second"))
    other = F.when(F.col("component") == F.col("best.component"), F.col("second")).otherwise(F.col("best.pos"))
    left = rows.join(second, "gram").where((F.col("pos") + other) * threshold <= F.col("n") * (100 - threshold)).select("gram", "doc", "n", "pos", "component")
    left = stored(left.join(single.select("doc", "lone", "sketch"), "doc"), "cross")
    right = left.select("gram", *[F.col(c).alias(f"{c}2") for c in ("doc", "n", "pos", "component", "lone", "sketch")])
    apart = F.col("lone") + F.col("lone2")  # at least so many n-grams differ
    for k in range(SKETCH // 64):
        apart = apart + F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch2")[k]))
    rest = left.join(right, "gram").where((F.col("doc") < F.col("doc2")) & (F.col("component") != F.col("component2")))
    rest = rest.where(_fits(F.col("n"), F.col("n2"), threshold) & _near(F.col("pos"), F.col("pos2"), F.col("n"), F.col("n2"), threshold))
    rest = rest.where(_near(apart, F.lit(0), F.col("n"), F.col("n2"), threshold))
    rest = stored(rest.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "rest")
    discard(rows, left, star)
    more = stored(overlaps(rest, single, threshold).select("a", "b"), "more-links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    label = stored(found, "labels")
    discard(rest, more, single)
    member = copies.join(label, copies["rep"] == label["node"], "left").select("doc", F.coalesce("component", "rep").alias("component_id"))
    member = member.unionByName(label.select(F.col("node").alias("doc"), F.col("component").alias("component_id")))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    sized = every.join(sets.select(F.col("doc").alias("doc_id"), "n"), "doc_id", "left").join(member.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return sized.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

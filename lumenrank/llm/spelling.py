"""Spelling variants: words one edit apart, joined over an index of variable-length grams.

1. The dictionary: grams of two letters and more, counted over the distinct words (an end mark counts as a
   letter); those more frequent than a bound are kept. The bound is a share of all counts, so the dictionary has
   a size that doesn't grow with the words.
2. Decomposition: from each letter on, a word's gram grows while the dictionary has it, to ``LONGEST`` letters at
   most: frequent beginnings are told apart by longer grams, rare ones by short ones. A gram depends on its own
   letters alone, so an edit affects exactly the grams that reach over its place.
3. Merging: for each place of an edit, a word's unaffected grams are those that end before it and those that
   begin after it. A variant that differs there has them all, at the same distance from its beginning or its
   end, so merging the lists of these grams is one key: the letters to the end of the last whole gram before
   the place, and the letters behind it. Words of one key are candidates.
4. Lists longer than ``LIST_MOST`` are split by the letters between that gram and the place, which a variant
   has, too; so no list is met by all its pairs that grew with the vocabulary, and none is cut.
5. Candidates are verified by a bounded edit distance while the lists are joined.

A word has about twice as many lists as letters, each as long as the word. Words of more than ``LONG`` letters are
therefore listed by hashes instead, of the word and of what each deletion leaves, and verified in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Letters of the longest gram; grams that the dictionary holds at most; members of a list whose pairs are verified;
#: letters of a word that the gram index takes.
LONGEST, GRAMS, LIST_MOST, LONG = 5, 4096, 256, 64
#: What a run of letters is made of; shortest and rarest words that count.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "[A-Za-zÀ-ÿ]+", 5, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): the maximal runs of letters of every text, A-Z lower-cased."""
    low = F.translate(F.col("text"), _UPPER, _LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))


def slipped(doc_id: Column, run: Column, every: int = 97) -> Column:
    """The run, without one of its letters where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def frequent_grams(words: DataFrame, most: int = GRAMS, longest: int = LONGEST) -> list[str]:
    """The grams of 2 to ``longest`` - 1 letters of the words and an end mark that occur in more than one of
    ``most`` places, so that they are fewer than ``most``."""
    marked = F.concat("word", F.lit("$"))
    at = F.sequence(F.lit(1), F.length("word"))
    of = lambda k: F.transform(at, lambda p: F.when(p + k <= F.length("word") + 2, F.substr(marked, p, F.lit(k))))
    grams = words.select(F.explode(F.concat(*[of(k) for k in range(2, longest)])).alias("gram")).where("gram is not null").groupBy("gram").count()
    kept = stored(grams, "grams")
    total = kept.agg(F.sum("count")).first()[0] or 0
    out = sorted(r["gram"] for r in kept.where(F.col("count") > total // most).select("gram").collect())
    discard(kept)
    return out


def gram_ends(word: str, grams: frozenset[str], longest: int = LONGEST) -> list[int]:
    """Where the gram that begins at each letter ends; a word's length and one more: it takes in the end mark."""
    marked, out = word + "$", []
    for p in range(len(word)):
        e = p + 2
        while e - p < longest and e <= len(word) and marked[p:e] in grams:
            e += 1
        out.append(e)
    return out


def lists(word: str, grams: frozenset[str], longest: int = LONGEST) -> set[str]:
    """The merged lists that a word is in: for the letter replaced or deleted at each place, and for each gap where
    one may be inserted, what its unaffected grams spell before it and behind it."""
    n = len(word)
    left = [0] * (n + 2)
    for e in gram_ends(word, grams, longest):
        left[e] = e
    for i in range(1, n + 1):
        left[i] = max(left[i], left[i - 1])
    return {f"{word[: left[i]]}|{word[i + 1 :]}" for i in range(n)} | {f"{word[: left[i]]}|{word[i:]}" for i in range(n + 1)}


def _index(grams: list[str], longest: int):
    def run(batches):
        known = frozenset(grams)
        for b in batches:
            words, counts, at, keys = b.column("word").to_pylist(), b.column("n"), [], []
            for i, w in enumerate(words):
                mine = lists(w, known, longest)
                at += [i] * len(mine)
                keys += mine
                if len(keys) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("word").take(pa.array(at)), counts.take(pa.array(at))], names=["key", "word", "n"])
                    at, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column("word").take(pa.array(at, pa.int32())), counts.take(pa.array(at, pa.int32()))], names=["key", "word", "n"])

    return run


def _deletions(batches):
    """Rows (id, left): the hash of a word, and of what is left of it without each of its letters."""
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    for b in batches:
        for name, word in zip(b.column("id").to_pylist(), b.column("word").to_pylist(), strict=True):
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * np.cumprod(np.full(len(letters), base)))))
            left = np.unique(np.concatenate((sums[:-1] + (sums[-1] - sums[1:]) * back, sums[-1:]))).view(np.int64)
            for at in range(0, len(left), 1 << 16):
                part = left[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"id": pa.array([name] * len(part)), "left": pa.array(part)})


def long_pairs(words: DataFrame) -> DataFrame:
    """``near_pairs`` of words of any length, by hashes of what deletions leave."""
    named = words.select(F.sha2("word", 256).alias("id"), "word", "n")
    hashes = named.select("id", "word").mapInArrow(_deletions, "id string, left long")
    a, b = (hashes.select("left", F.col("id").alias(i)) for i in ("ia", "ib"))
    pairs = a.join(b, "left").where(F.col("ia") < F.col("ib")).select("ia", "ib").distinct()
    full = [named.select(F.col("id").alias(f"i{w}"), F.col("word").alias(w), F.col("n").alias(f"n{w}")) for w in ("a", "b")]
    found = pairs.join(full[0], "ia").join(full[1], "ib").where(F.levenshtein("a", "b", 1) == 1)
    first = F.col("a") < F.col("b")
    return found.select(F.least("a", "b").alias("a"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"))


def near_pairs(words: DataFrame, most: int = GRAMS, longest: int = LONGEST, list_most: int = LIST_MOST) -> DataFrame:
    """(a, na, b, nb), a < b: every two of the distinct ``words`` (word, n) that differ by one inserted, deleted or
    replaced code point."""
    far = long_pairs(words.where(F.length("word") > LONG))  # a pair of this length and one letter less is met below
    words = words.where(F.length("word") <= LONG + 1)
    grams = frequent_grams(words, most, longest)
    keys = stored(words.select("word", "n").mapInArrow(_index(grams, longest), "key string, word string, n long"), "lists")
    long_ = keys.groupBy("key").count().where(F.col("count") > list_most).select("key")
    short = keys.join(long_, "key", "left_anti")
    tail = F.substring_index("key", "|", -1)
    before = lambda k: F.substr("word", F.lit(1), F.length("word") - F.length(tail) - k)
    split = F.array_distinct(F.array(*[F.concat(before(k), F.lit("||"), tail) for k in (0, 1)]))
    dealt = short.unionByName(keys.join(long_, "key", "left_semi").select(F.explode(split).alias("key"), "word", "n").distinct())
    a, b = (dealt.select("key", F.col("word").alias(w), F.col("n").alias(f"n{w}")) for w in ("a", "b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(near).select("a", "na", "b", "nb").unionByName(far).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the last that forms lead to. Counts at least double
    from form to form, so the chains are short; each round doubles what it has followed."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now
        now.stored_at = new.stored_at


def variants(docs: DataFrame, every: int = 97, list_most: int = LIST_MOST, grams: int = GRAMS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text).

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one letter deleted from those
    that ``slipped`` picks (``every`` = 0: from none), of at least five code points and three occurrences (n). Near
    are words one inserted, deleted or replaced code point apart. A word's form is its near word of largest n (ties:
    the smallest by code points) if that is at least twice its own, else null; root is where forms lead in the end,
    the word itself without one. Null, empty and letterless texts have no words; rows that share a doc_id count
    each; a null doc_id counts as an empty one; whole texts count; other columns are ignored; without words the
    result is empty.
    """
    said = runs(docs)
    word = slipped(F.col("doc_id"), F.col("run"), every) if every else F.col("run")
    words = said.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    words = stored(words, "words")
    pairs = stored(near_pairs(words, grams, list_most=list_most), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    has = -F.col("best.less") >= 2 * F.col("n")
    table = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    table = stored(table, "variants")
    discard(pairs)
    root = roots(table.where("form is not null"))
    return table.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

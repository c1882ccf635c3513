"""Inputs that a crawl holds: endless repetitions, ids that many rows share or none have, very long lines."""

import re
import time
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lumenrank.llm import ann, langid, license, mixing, pii, queries

DOCS = "doc_id long, text string"
FORM = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize(
    ("head", "again", "end"),
    [
        ("Mr Smith met ", "Smith ", ""), ("x@", "a.", "com"), ("x@", "ab.", "com"), ("", "a.", "@x.org"), ("", "x@", ""), ("", "Mr Smith and ", ""), ("+1 ", "12 ", ""), ("", "1234 ", ""), ("DE89 ", "AB12 ", ""), ("12 ", "Long ", "Street"),
        ("", "1.", ""), ("", "12ab:", "1"), ("token = ", "ab12", ""), ("", "token=", ""), ("born ", "1.1.", ""), ("", "(0", ""), ("", "-", ""), ("Dr ", "A", ""), ("x@", "-", ".com"),
    ],
)
def test_endless_repetitions_are_read_whole(spark, head, again, end):
    size = 1 << 20 if again in ("Smith ", "ab.", "1234 ", "AB12 ") else 1 << 17
    text = head + again * (size // len(again)) + end
    began = time.monotonic()
    got = pii.pseudonymise(spark.createDataFrame([(1, text), (2, "clean")], DOCS), "k").orderBy("doc_id").collect()
    assert time.monotonic() - began < 120 and [r["doc_id"] for r in got] == [1, 2] and got[1]["text"] == "clean" and got[0]["text"]
    if "Smith" in again:
        assert "Smith" not in got[0]["text"] and len(set(re.findall(r"Mr (\w+)", got[0]["text"]))) == 1


def test_addresses_of_many_labels_go_whole(spark):
    domain = "sub." * 300 + "example.com"
    got = pii.pseudonymise(spark.createDataFrame([(1, f"to john@{domain}, john@a.b.co. john@x.c1.net.9 - a.b+c@d-e.org"), (2, f"{'n' * 200}@x.org")], DOCS), "k").orderBy("doc_id").collect()
    assert got[0]["n_replaced"] == 4 and got[1]["n_replaced"] == 1 and not any(x in got[0]["text"] for x in ("john", "example", "d-e")) and "nnnn" not in got[1]["text"]


def test_addresses_of_the_sixth_version_go(spark):
    said = ["2001:db8:0:1:1:1:1:1", "2001:DB8::1", "fe80::a1:2"]
    kept = "at 10:20:30, std::fe and a::b, 12:34, x2001:db8::1y"
    got = pii.pseudonymise(spark.createDataFrame([(1, f"from {said[0]} to {said[1]}, {said[2]}. {kept}")], DOCS), "k").first()
    assert got["n_replaced"] == 3 and not any(x in got["text"] for x in said) and got["text"].endswith(kept)
    assert re.fullmatch(r"from (?:[0-9a-f]+:){7}[0-9a-f]+ to [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f], [0-9a-f]{4}::[0-9a-f]{2}:[0-9a-f]\. .*", got["text"])


def test_a_name_is_known_again_in_another_document(spark):
    texts = ["Mr Smith came", "Dr Smith came", "Mrs Smith came", "Mr Weber came"]
    got = [r["text"].split()[1] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOCS), "k").orderBy("doc_id").collect()]
    stems = [re.sub("(rn|na|s)$", "", w) for w in got]
    assert stems[0] == stems[1] == stems[2] != stems[3] and len(set(got)) == 4


def test_mentions_of_the_corpus_by_another_engine(spark, sf_dir):
    """The same patterns in Python's regex module: as many mentions, and what stands between them unchanged."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    every = regex.compile(pii.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    titled = regex.compile(pii.PATTERNS["name"])
    found = 0
    for r in pii.pseudonymise(docs, "k").join(docs.withColumnRenamed("text", "was"), "doc_id").collect():
        was, mentions = r["was"] or "", list(every.finditer(r["was"] or ""))
        if titled.search(was):
            continue  # its names are found without titles, too
        assert r["n_replaced"] == len(mentions), r["doc_id"]
        at, new = 0, r["text"] or ""
        for a, b in zip([0] + [m.end() for m in mentions], [m.start() for m in mentions] + [len(was)], strict=True):
            at = new.index(was[a:b], at) + b - a
            found += 1
        assert not any(m[0] in new for m in mentions)
    assert found > 1100


# ---- samples


@pytest.mark.parametrize("one_id", [7, None])
def test_topics_of_rows_that_share_an_id(spark, one_id):
    rows = [(one_id, f"word{i % 7} more{i % 3} text{i}", f"l{i % 3}", "s") for i in range(9000)] + [(one_id, "same same", "l0", "s")] * 9000
    docs = spark.createDataFrame(rows, FORM)
    bags = mixing.sampled(docs.select("doc_id", "text", "lang"), dict.fromkeys(["l0", "l1", "l2"], 0.5), dict.fromkeys(["l0", "l1", "l2"], 100)).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in bags} == {"l0": 100, "l1": 100, "l2": 100}
    assert set(mixing.fit_topics(docs, 300)) == {"l0", "l1", "l2"}
    assert mixing.features(docs, fit_docs=300).where("topic is null").count() == 0


def test_languages_beyond_the_most_share_topics(spark):
    rows = [(i, f"a{i % 5} b{i % 3} c", f"l{min(i % 40, 20)}", "s") for i in range(800)]
    docs = spark.createDataFrame(rows, FORM)
    models = mixing.fit_topics(docs, 400, most_langs=5)
    assert len(models) == 6 and mixing.OTHERS in models and "l20" in models
    assert mixing.features(docs, fit_docs=400).where("topic is null").count() == 0


@pytest.mark.parametrize("one_id", [3, None])
def test_languages_of_rows_that_share_an_id(spark, one_id):
    words = {"aa": "alpha anna", "bb": "bobbin bubble", "cc": "zyx zxy"}
    rows = [(one_id, f"{words[k]} {chr(97 + i % 26)}{i}", k) for k in words for i in range(1500)] + [(one_id, "many many", "bb")] * 5000
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled, 600)
    assert model[0] == ["aa", "bb", "cc"]
    got = langid.predict(labelled.dropDuplicates(["text"]), model, keep_text=True).where("lang != lang_pred").count()
    assert got < 50
    assert langid.fit(labelled.withColumn("lang", F.concat("lang", F.length("text") % 2)), 600, most_langs=2)[0] == ["bb0", "bb1"] or len(langid.fit(labelled, 600, most_langs=2)[0]) == 2


@pytest.mark.parametrize("one_id", [1, 2, 3])
def test_neighbours_among_rows_that_share_an_id(spark, one_id):
    rng = np.random.default_rng(one_id)
    v = rng.normal(size=(20_000, 8)).round(3)
    rows = spark.createDataFrame([(one_id, x) for x in v.tolist()] + [(100, v[0].tolist())] * 3000 + [(200, v[1].tolist())], "vec_id long, embedding array<double>")
    few = ann.sample(rows, "embedding", 4096).select("vec").collect()
    assert len(few) == 4096 and len({tuple(r["vec"]) for r in few}) == 4096
    others = spark.range(300, 350).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * 7 + i) for i in range(8)]).alias("embedding"))
    asked = rows.where("vec_id = 200").unionByName(others).cache()
    found = {}
    for r in ann.nearest(rows, asked, 20, fit_rows=4096).collect():
        found.setdefault(r["query_id"], []).append(r["score"])
    hits = 0
    for r in asked.collect():
        q = np.array(r["embedding"])
        near = np.sort(np.concatenate((v @ q, np.full(3000, v[0] @ q))))[::-1][:20]
        hits += sum((Counter(np.round(near, 6)) & Counter(np.round(found[r["vec_id"]], 6))).values())
    assert all(len(f) == 20 for f in found.values()) and hits >= 0.9 * 20 * asked.count()


# ---- licences


def test_a_denial_far_before_a_licence_counts():
    scanner = license.Scanner(license.templates())
    long = "It is not the case that " + "really " * 200
    ok = [r[-1] for r in scanner.rows(f"{long}this is Released under the MIT License.", license.DIFFER)]
    assert ok == [False] and [r[-1] for r in scanner.rows("It is not so. " + "Really " * 200 + ". Released under the MIT License.", license.DIFFER)] == [True]


def test_a_line_of_a_million_words_takes_little_memory():
    import tracemalloc

    template = license.words(license.templates()["MIT"])
    have = ["word"] * 500_000 + template[:40] + ["odd"] + template[40:] + ["word"] * 500_000
    tracemalloc.start()
    first, last, missing, added = license.stretch(template, have)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (first, last, missing, [w for _, w in added]) == (500_000, 500_001 + len(template), [], ["odd"]) and peak < 100 << 20


def test_registered_queries_name_their_production_parameters():
    assert set(queries.URL_RULES.values()) == {"allow", "block"} and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_work_on_a_file_of_many_licences_grows_with_its_length():
    scanner, given = license.Scanner(license.templates()), license.templates()
    seen, plain = [], scanner.sizes
    scanner.sizes = lambda block: seen.append(len(block)) or plain(block)
    work = {}
    for n in (20, 80):
        seen.clear()
        text = "\n\n".join([given["MIT"], given["ISC"], "Released under the BSD License."] * n)
        rows = [r for r in scanner.rows(text, license.DIFFER) if r[-1]]
        assert [r[2] for r in rows] == ["MIT", "ISC", "BSD"] * n
        assert all(not r[5] and not r[6] for r in rows) and all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
        work[n] = sum(seen) / len(text)
    assert work[80] < 1.2 * work[20]


def test_licence_tags():
    scanner = license.Scanner(license.templates())
    told = lambda t: [(r[2], r[-1]) for r in scanner.rows(t, license.DIFFER)]
    assert told("// SPDX-License-Identifier: MIT\nint main() {}") == [("MIT-tag", True)]
    assert told("/* SPDX-License-Identifier: GPL-2.0-or-later */") == [("GPL-2.0-or-later-tag", True)]
    assert [ok for _, ok in told("# SPDX-License-Identifier: Apache-2.0 OR LicenseRef-own")] == [False]
    assert [ok for _, ok in told("# SPDX-License-Identifier: GPL-4.0-only")] == [False]


def test_every_document_teaches_the_topics(spark):
    """The fit over all rows against ``mixture`` of all their bags, and the same however the rows are dealt; a
    sample of 4,096 of them gives another one."""
    rng = np.random.default_rng(5)
    words = [[f"{t}w{i}" for i in range(40)] for t in "abcd"]
    rows = [(i, " ".join(rng.choice(words[min(3, int(rng.integers(7)) // 2)], int(rng.integers(20, 60)))), "xy"[i % 2], "s") for i in range(6000)]
    docs = spark.createDataFrame(rows, FORM)
    got, again = mixing.fit_topics(docs.repartition(3)), mixing.fit_topics(docs.repartition(7, "text"))
    assert got.keys() == {"x", "y"} and all((got[k] == again[k]).all() for k in got)
    bags = {"x": [], "y": []}
    for _, text, lang, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        bags[lang].append(np.bincount((mixing.hashed_words(data, np.array([0, len(data)]))[1] >> np.uint64(54)).astype(np.int64), minlength=mixing.BUCKETS).astype(np.float32))
    for lang, mine in bags.items():
        want = mixing.mixture(np.stack(sorted(mine, key=lambda x: x.tobytes())).astype(np.float64))
        assert got[lang] == pytest.approx(want, abs=1e-3)
    assert got["x"][:, -1] != pytest.approx(mixing.fit_topics(docs, 4096)["x"][:, -1], abs=1e-6)

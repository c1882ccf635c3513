"""The corpus pipeline: language ID, near duplicates, personal data, mix, packing.

``STAGES`` are (name, function); each takes (spark, docs, sf_dir), docs being what the stage before returned,
and all but the last return the columns of documents. ``run`` applies them to the documents, each stage
written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm import jaccard, langid, mixing, packing, pii
from lumenrank.llm.common import aside, discard, small, stored
from lumenrank.llm.queries import MIX, PII_KEY
from lumenrank.session import ship

#: A document is rejected if its language can't be told at all, or is less likely than this.
LEAST_SCORE = 0.5
#: No DuckDB SQL: naive Bayes over hashed n-grams and the tokenizer can't be expressed there; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled documents teach.

    Null and empty texts, texts without a letter, and all texts where no document has a language, are rejected;
    whole texts count, repeated rows go or stay alike, other columns are left as they are.
    """
    ship(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows, back = aside(docs, "lang_pred", "score")
    return back(langid.predict(rows, model, keep_text=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates. The ids that go are few beside the
    documents, so they are what is joined. Rows without a doc_id belong to no group and stay, as do null and
    empty texts and repeated rows of the doc_id that stays; other columns are left as they are."""
    ship(spark)
    groups = jaccard.near_components(docs.select("doc_id", "text"))
    gone = stored(groups.where("doc_id != component_id").select("doc_id"), "near-duplicates")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by surrogates, and n_chars those of the new text. Null and empty
    texts stay; repeated rows are treated alike; other columns are left as they are."""
    ship(spark)
    rows, back = aside(docs, "n_replaced")
    out = back(pii.pseudonymise(rows, PII_KEY))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated mix samples. Null and empty texts carry no weight and stay; repeated rows go
    or stay together; other columns are left as they are."""
    ship(spark)
    rows, back = aside(docs, "topic", "tokens", "probability", "kept")
    marked = stored(mixing.features(rows, keep_text=True), "features")
    return back(mixing.mix(marked, **MIX).where("kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences. A null or empty text is one end id; repeated rows are documents of
    their own; other columns are ignored."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)  # what the stage before wrote
    return STAGES[-1][1](spark, docs, sf_dir)

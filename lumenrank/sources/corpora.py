"""Sources and sinks: corpora, vector indexes, request and response shapes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate

def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a JSON array of strings; the id is the position. Files are single documents, so one
    task reads each; larger corpora come as Parquet (``read_table``)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("doc_id", "text")).select(F.col("doc_id").cast("long"), "text")


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, embedding, ok) of a vector index."""
    return spark.read.parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One JSON object per document."""
    corpus.select("doc_id", "text").write.mode("overwrite").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON files, one object each, with query_id from the file's content."""
    shape = (
        "model string, query string, documents array<struct<text: string, original_index: bigint, similarity: double>>, top_n int, return_documents boolean, "
        "truncate struct<query_tokens: int, document_tokens: int>, options struct<seed: int, num_ctx: int, debug: boolean>, policy_id string"
    )
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.xxhash64("value").alias("query_id"), F.from_json("value", shape).alias("r")).select("query_id", "r.*")


def read_string_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests whose documents are plain strings."""
    from ..operators.retrieve import wrap_strings

    shape = "model string, query string, documents array<string>, top_n int"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.xxhash64("value").alias("query_id"), F.from_json("value", shape).alias("r")).select("query_id", "r.*")
    return rows.withColumn("documents", wrap_strings(F.col("documents")))


Embed = Callable[[list[str]], list[list[float]]]


def embed(docs: DataFrame, make: Callable[[], Embed], dim: int) -> DataFrame:
    """(doc_id, embedding, ok): ``make`` builds a client once per task, which embeds a batch of texts a call.
    A batch that fails is tried text by text; a text that fails gets a zero vector and ok false."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def each(texts: list[str]) -> list[list[float] | None]:
            try:
                return list(client(texts))
            except Exception:
                return [None] if len(texts) == 1 else [v for t in texts for v in each([t])]

        for frame in frames:
            got = each(frame["text"].fillna("").tolist()) if len(frame) else []
            yield pd.DataFrame({"doc_id": frame["doc_id"], "embedding": [v if v is not None else [0.0] * dim for v in got], "ok": [v is not None for v in got]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, embedding array<float>, ok boolean")


def responses(ranked: DataFrame, id_col: str = "query_id", model: str | None = None, return_documents: bool = False, facts: bool = True) -> DataFrame:
    """One row per query: query, results (structs in rank order), warnings, usage (characters as ``retrieve.usage``
    counts them) and their JSON. Documents and facts only where they are asked for."""
    names = [c for c in ("original_index", "score", "pre_rank_score", "rank_score", "rank_score_reason", "fine_score", "fine_score_norm", "tie_breaker_used", "tie_breaker_error", "score_raw", "score_norm", "tier", "decision", "policy_id", "facts", "zero_reason", "mode") if c in ranked.columns and (facts or c != "facts")]
    one = F.struct("rank", *names, *([F.col("text").alias("document")] if return_documents else []))
    warning = F.when(F.col("warning").isNotNull(), F.struct(F.col("original_index").alias("idx"), F.col("warning").alias("error"))) if "warning" in ranked.columns else F.lit(None)
    out = ranked.groupBy(id_col).agg(F.max("query").alias("query"), F.max(F.length(truncate(F.col("query"), 256))).cast("long").alias("query_tokens"), F.sum(F.length(truncate(F.col("text"), 512))).alias("document_tokens"), F.array_sort(F.collect_list(one), lambda a, b: a["rank"] - b["rank"]).alias("results"), F.collect_list(warning.cast("struct<idx:bigint,error:string>")).alias("warnings"), F.sum(F.length("text")).alias("document_chars"), F.count("*").alias("pairs"))
    out = out.withColumns({"model": F.lit(model), "total_tokens": F.col("query_tokens") + F.col("document_tokens")})
    spent = F.struct("query_tokens", "document_tokens", "total_tokens", "document_chars", "pairs").alias("usage")
    return out.withColumn("json", F.to_json(F.struct("model", "query", "results", "warnings", spent), {"ignoreNullFields": "false"}))


def relevance_rows(ranked: DataFrame, id_col: str = "query_id") -> DataFrame:
    """The plain shape: index (position in the result), relevance_score, original_corpus_index."""
    return ranked.select(id_col, (F.col("rank") - 1).alias("index"), F.col("score").alias("relevance_score"), F.col("original_index").alias("original_corpus_index"))

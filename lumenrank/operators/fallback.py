"""The retrieval-only rerank of ambiguous queries: intent-aware similarity with diversified heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as A
from ..functions import signals as S
from ..functions import text as T

HEADS = 3


def diversified(rows: DataFrame, score: str, domain: str, first: list[str], heads: int = HEADS, id_col: str = "query_id") -> DataFrame:
    """rank from 1: each domain's best row, domains in the order of their best, ``heads`` of them at most,
    then all others by score; ties in the order of ``first``."""
    by_score = [F.desc(score), *first]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(*by_score)))
    rows = rows.withColumn("_best", F.row_number().over(Window.partitionBy(id_col, domain).orderBy("_r")) == 1)
    nth = F.sum(F.col("_best").cast("int")).over(Window.partitionBy(id_col).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("is_head", F.col("_best") & (nth <= heads))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("is_head"), "_r"))).drop("_r", "_best")


def blended(similarity: Column, fit: Column, overlap: Column, bonus: Column) -> Column:
    return similarity * fit * 0.7 + overlap * 0.15 + bonus * 0.15


def fallback(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Retrieved rows (query, text, similarity, retrieval_rank) with domain, doc_kind, intent_fit, overlap,
    lexical, score, decision and rank."""
    q, d = F.col("query"), F.col("text")
    rows = rows.withColumns({"query_intent": S.client_intent(q), "doc_kind": S.kind_client(d), "domain": A.client_domain(d), "lexical": S.lexical_bonus(d), "overlap": F.size(F.array_intersect(T.tokens_letters(q), T.tokens_letters(d)))})
    rows = rows.withColumn("intent_fit", S.fit_client(F.col("query_intent"), F.col("doc_kind")))
    rows = rows.withColumn("score", blended(F.coalesce("similarity", F.lit(0.0)), F.col("intent_fit"), F.col("overlap"), F.col("lexical")))
    return diversified(rows, "score", "domain", ["retrieval_rank"], id_col=id_col).withColumn("decision", F.lit("ACCEPT"))


def split_ambiguous(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries for the fallback, with their reason; queries for the reranker)."""
    yes, reason = A.ambiguous_client(F.col("query"))
    return queries.where(yes).withColumn("ambiguous_reason", reason), queries.where(~yes)

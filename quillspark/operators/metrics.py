"""Graded retrieval metrics over qrels(qid, chunk_id, grade) and run(qid, chunk_id, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(qrels: DataFrame, run: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """(qid, precision, recall, ndcg, rr): one row for every query of qrels, zeros where the run has none.

    Precision divides by k, however short the run; gains are linear; the ideal order is over all grades.
    """
    if k <= 0 or depth <= 0:
        raise ValueError("k and depth must be positive")
    judged = qrels.groupBy("qid", "chunk_id").agg(F.max("grade").alias("grade"))
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "chunk_id"))
    gain = lambda rank: F.col("grade") / F.log2(F.col(rank) + 1)
    ideal = judged.withColumn("i", ideal_rank).groupBy("qid").agg(
        F.sum(F.when(F.col("i") <= depth, gain("i"))).alias("idcg"), F.count_if(F.col("grade") >= 1).alias("relevant")
    )
    hits = run.join(judged, ["qid", "chunk_id"]).groupBy("qid").agg(
        F.count_if((F.col("grade") >= 1) & (F.col("rank") <= k)).alias("hits"),
        F.sum(F.when(F.col("rank") <= depth, gain("rank"))).alias("dcg"),
        F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"),
    )
    zero = F.lit(0.0)
    return ideal.join(hits, "qid", "left").select(
        "qid",
        (F.coalesce("hits", F.lit(0)) / k).alias("precision"),
        F.coalesce(F.try_divide("hits", "relevant"), zero).alias("recall"),
        F.coalesce(F.try_divide("dcg", "idcg"), zero).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), zero).alias("rr"),
    )


def macro(rows: DataFrame) -> DataFrame:
    """One row of means; zeros without a judged query."""
    names = {"precision": "precision_at_k", "recall": "recall_at_k", "ndcg": "ndcg_at_10", "rr": "mrr"}
    return rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(a) for c, a in names.items()], F.count(F.lit(1)).alias("queries"))

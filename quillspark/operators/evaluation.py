"""Judgments anchored in texts, runs over modes and chunkers, results as tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import metrics
from quillspark.operators import retrieval as R
from quillspark.operators.chunking import chunk
from quillspark.session import staged

FIGURES = ("precision_at_k", "recall_at_k", "ndcg_at_10", "mrr")


def resolve_judgments(judged: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qrels(qid, chunk_id, grade), missing(qid, doc, anchor)) of judged(qid, doc, anchor, grade) over chunks(chunk_id, text, doc_number, status).

    A judgment holds for the active chunks of its document whose text has the anchor, whatever the case; the best grade
    counts. missing are judgments without a chunk.
    """
    active = chunks.filter(F.lower("status") == "active").select("chunk_id", F.lower("text").alias("low"), F.col("doc_number").alias("doc"))
    hits = judged.join(active, "doc").filter(F.contains("low", F.lower("anchor")))
    qrels = hits.groupBy("qid", "chunk_id").agg(F.max("grade").alias("grade"))
    return qrels, judged.join(hits.select("qid", "doc", "anchor").distinct(), ["qid", "doc", "anchor"], "left_anti").select("qid", "doc", "anchor")


def candidate_number(k: int) -> int:
    return max(R.CANDIDATES, 4 * k)


def per_query(qrels: DataFrame, run: DataFrame, k: int, config: str) -> DataFrame:
    """(config, qid, precision, recall, ndcg, rr) of one run."""
    return metrics.per_query(qrels, run, k).select(F.lit(config).alias("config"), "qid", "precision", "recall", "ndcg", "rr")


def mode_sweep(queries: DataFrame, docs: DataFrame, qrels: DataFrame, k: int = 5, modes: tuple[str, ...] = R.MODES, candidates: int | None = None) -> DataFrame:
    """per_query rows of every mode over docs(chunk_id, text, status); the index is built once."""
    index, out = R.build_index(docs.select("chunk_id", "text")), None
    for mode in modes:
        rows = per_query(qrels, R.search(queries, docs, mode, k, candidates or candidate_number(k), index=index), k, mode)
        out = rows if out is None else out.unionByName(rows)
    return out


def chunking_sweep(versions: DataFrame, queries: DataFrame, judged: DataFrame, k: int = 5, chunkers: tuple[str, ...] = ("fixed", "recursive", "structure_aware"), mode: str = "hybrid_rerank") -> DataFrame:
    """(config, chunks, tokens, figures, queries): all versions(version_id, text, doc_number, status) cut anew by each chunker, judgments
    resolved in the new chunks, all queries run in one mode. Chunks have the status of their version."""
    out = None
    for name in chunkers:
        made = chunk(versions, "version_id", "text", name).join(versions.select("version_id", "doc_number", F.lower("status").alias("status")), "version_id")
        docs = staged(made.select(F.concat_ws("#", "version_id", "ordinal").alias("chunk_id"), F.col("chunk_text").alias("text"), "doc_number", "status", "token_count"), "sweep")
        qrels, _ = resolve_judgments(judged, docs)
        run = R.search(queries, docs.select("chunk_id", "text", "status"), mode, k, candidate_number(k))
        size = docs.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
        row = summary(per_query(staged(qrels, "qrels"), run, k, name)).crossJoin(F.broadcast(size))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """(config, figures, queries): means of per_query rows by config."""
    return rows.groupBy("config").agg(*[F.avg(c).alias(a) for c, a in zip(("precision", "recall", "ndcg", "rr"), FIGURES, strict=True)], F.count(F.lit(1)).alias("queries"))


def beir_subset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, subset: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first subset judged queries (in the order of at), their judged documents, and the first ten times subset documents beside them.

    corpus(at, doc, text), queries(qid, text), qrels(at, qid, doc, grade); subset 0 is everything. at numbers the lines of the files.
    """
    if not subset:
        return corpus, queries, qrels
    first = qrels.groupBy("qid").agg(F.min("at").alias("first")).orderBy("first").limit(subset).select("qid")
    kept = qrels.join(F.broadcast(first), "qid", "left_semi")  # subset rows
    wanted = kept.select("doc").distinct()
    distractors = corpus.orderBy("at").limit(10 * subset).select("doc")
    docs = corpus.join(wanted.unionByName(distractors).distinct(), "doc", "left_semi")
    return docs, queries.join(F.broadcast(first), "qid", "left_semi"), kept


def beir_evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Means of every mode over a benchmark's corpus(doc, text), with 50 candidates each."""
    docs = staged(corpus.select(F.col("doc").alias("chunk_id"), "text", F.lit("active").alias("status")), "corpus")
    return summary(mode_sweep(queries, docs, staged(qrels.select("qid", F.col("doc").alias("chunk_id"), "grade"), "qrels"), k, candidates=50))


def write_results(spark: SparkSession, rows: DataFrame, folder: str, run: str) -> str:
    """Append per_query rows of a run as a table, write their means as JSON and return them as a Markdown table."""
    rows = staged(rows, "results")
    rows.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/per_query")
    means = summary(rows).orderBy("config")
    means.coalesce(1).write.mode("overwrite").json(f"{folder}/{run}")
    return markdown(means)


def markdown(means: DataFrame) -> str:
    """A table of the means, one line a config."""
    lines = ["| config | " + " | ".join(FIGURES) + " | queries |", "|---|" + "---|" * (len(FIGURES) + 1)]
    lines += [f"| {r['config']} | " + " | ".join(f"{r[c]:.3f}" for c in FIGURES) + f" | {r['queries']} |" for r in means.collect()]  # one row a config
    return "\n".join(lines)

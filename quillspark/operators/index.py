"""The inverted index: postings, document and corpus statistics over all chunks, active or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X

K1, B, EPSILON = 1.5, 0.75, 0.25


def snapshot(chunks: DataFrame, versions: DataFrame, circulars: DataFrame) -> DataFrame:
    """Chunks with the fields of their version and document; raw texts of versions are never read."""
    v = versions.select(F.col("id").alias("document_version_id"), "document_id", "version_number", "published_date")
    d = circulars.select(F.col("id").alias("document_id"), "doc_number", "title", "source_url")
    return chunks.join(v, "document_version_id").join(d, "document_id")


def postings(docs: DataFrame, key: str, text: str, tokens=X.bm25_tokens) -> DataFrame:  # noqa: ANN001
    """(key, term, tf)."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, key: str, text: str, tokens=X.bm25_tokens) -> DataFrame:  # noqa: ANN001
    """(key, dl): length of each document; a document without tokens has length 0."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def idf(posts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf): terms in more than half of the documents get a floor, EPSILON of the mean idf."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus.select("n")))  # one row
    raw = df.select("term", "df", raw_idf(F.col("n"), F.col("df")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def index_stats(snap: DataFrame) -> DataFrame:
    return snap.agg(
        F.countDistinct("doc_number").alias("documents"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.lower("status") == "active").alias("active"),
        F.count_if(F.lower("status") == "deprecated").alias("deprecated"),
        F.count_if(F.col("chunk_type") == "table").alias("tables"),
    )

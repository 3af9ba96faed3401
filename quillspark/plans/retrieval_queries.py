"""Retrieval and evaluation: the titles of all circulars as queries against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators import knn, metrics
from quillspark.operators import retrieval as R
from quillspark.plans.corpus_queries import SQL_INDEX
from quillspark.plans.text_queries import SQL_RERANK, sql_list
from quillspark.functions import text as X
from quillspark.session import staged
from quillspark.sources.tables import table

K, CANDIDATES = 8, 40


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "circulars").select(F.col("id").alias("qid"), F.col("title").alias("text"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.col("chunk_text").alias("text"), "status")


def _live(docs: DataFrame) -> DataFrame:
    return docs.filter(F.lower("status") == "active")


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def bm25_audit(spark: SparkSession, d: str) -> DataFrame:
    """Top 8 over all chunks, deprecated ones included."""
    docs = _docs(spark, d)
    return _shown(R.bm25(_queries(spark, d), docs, K))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top 8 over active chunks, with statistics over all."""
    docs = _docs(spark, d)
    return _shown(R.bm25(_queries(spark, d), docs, K, _live(docs)))


def hash_embed_word(spark: SparkSession, d: str) -> DataFrame:
    e = R.hash_embedding(_docs(spark, d), "chunk_id", "text", chars=False)
    return e.select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


def hash_embed_char(spark: SparkSession, d: str) -> DataFrame:
    e = R.hash_embedding(_queries(spark, d), "qid", "text")
    return e.select("qid", "bucket", F.round("weight", 6).alias("weight"))


def hash_embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The whole embedding, words and characters, of every chunk of any status."""
    e = R.hashed_vectors(_docs(spark, d), "chunk_id", "text")
    return e.select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


def hash_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.sparse_dense(_queries(spark, d), _live(_docs(spark, d)), K))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    r = knn.exact_knn(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10, 64)
    return r.select(F.col("query").alias("query_id"), F.col("neighbour").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("cosine", 5).alias("score"))


def dense_label_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of the 10 nearest that have the query's label."""
    e = table(spark, d, "embeddings")
    near = knn.exact_knn(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10, 64)
    a, b = e.select(F.col("vec_id").alias("query"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("lb"))
    return near.join(a, "query").join(b, "neighbour").groupBy(F.col("query").alias("query_id")).agg(F.round(F.count_if(F.col("la") == F.col("lb")) / 10, 6).alias("precision_at_10"))


def _fused(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs, q = _docs(spark, d), _queries(spark, d)
    live = _live(docs)
    return R.rrf({"bm25": R.bm25(q, docs, CANDIDATES, live), "dense": R.sparse_dense(q, live, CANDIDATES)}, k)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    f = _fused(spark, d, K)
    return f.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.coalesce(F.col("bm25_rank").cast("long"), F.lit(0)).alias("bm25_rank"), F.coalesce(F.col("dense_rank").cast("long"), F.lit(0)).alias("dense_rank"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.search(_queries(spark, d), _docs(spark, d), "hybrid", K))


def hybrid_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.search(_queries(spark, d), _docs(spark, d), "hybrid_rerank", K))


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Rerank of the 40 BM25 candidates of each query."""
    docs, q = _docs(spark, d), _queries(spark, d)
    return _shown(R.lexical_rerank(q, R.bm25(q, docs, CANDIDATES, _live(docs)), docs, K))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgments: active chunks of the circular itself, grade 2 where the text bears its number, else 1."""
    s = I.snapshot(table(spark, d, "chunks"), table(spark, d, "document_versions"), table(spark, d, "circulars")).filter(F.lower("status") == "active")
    return s.select(F.col("document_id").alias("qid"), F.col("id").alias("chunk_id"), F.when(F.contains(F.lower("chunk_text"), F.lower("doc_number")), 2).otherwise(1).alias("grade"))


def qrels_anchor(spark: SparkSession, d: str) -> DataFrame:
    return qrels(spark, d).groupBy("qid", "chunk_id").agg(F.max("grade").cast("long").alias("grade"))


def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, nDCG and reciprocal rank of BM25 for every judged query."""
    docs = _docs(spark, d)
    m = metrics.per_query(qrels(spark, d), R.bm25(_queries(spark, d), docs, K, _live(docs)))
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "rr")])


def macro_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Means over all judged queries for each of the four modes."""
    judged, out = staged(qrels(spark, d), "qrels"), None
    for mode, run in R.search_modes(_queries(spark, d), _docs(spark, d), K).items():
        row = metrics.macro(metrics.per_query(judged, run)).select(F.lit(mode).alias("mode"), *[F.round(c, 5).alias(c) for c in ("precision_at_k", "recall_at_k", "ndcg_at_10", "mrr")], "queries")
        out = row if out is None else out.unionByName(row)
    return out


_FUNCTIONS = (bm25_audit, bm25_topk, hash_embed_word, hash_embed_char, hash_embed_chunks, hash_dense_topk, dense_topk, dense_label_precision, rrf_fuse, hybrid_topk, hybrid_rerank_topk, lexical_rerank, qrels_anchor, query_metrics, macro_by_mode)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TOKENS = f"list_filter({SQL_RERANK('text')}, lambda t: NOT list_contains({sql_list(X.BASE_STOP)}, t))"
_BUCKET = "CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 512"
_BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


def _sql_words(src: str, key: str) -> str:
    return f"""SELECT {key}, {_BUCKET} AS bucket, 1.0 AS per FROM (SELECT {key}, unnest(list_concat(ts, {_BIGRAMS.format('ts')})) AS g FROM (SELECT {key}, {_TOKENS} AS ts FROM {src}))"""


def _sql_unit(parts: str, key: str) -> str:
    return f"""SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, bucket, any_value(per) * sqrt(count(*)) AS w FROM ({parts}) GROUP BY 1, 2)"""


def _sql_chars(src: str, key: str) -> str:
    cut = lambda n: f"list_transform(range(1, len(p) - {n - 2}), lambda i: substr(p, i, {n}))"
    grams = f"list_concat(list_concat({cut(3)}, {cut(4)}), {cut(5)})"
    return f"""SELECT {key}, 512 + {_BUCKET} AS bucket, 0.5 AS per FROM (SELECT {key}, unnest({grams}) AS g FROM (SELECT {key}, ' ' || unnest({SQL_RERANK('text')}) || ' ' AS p FROM {src}))"""


def _sql_embedded(src: str, key: str) -> str:
    return _sql_unit(f"{_sql_words(src, key)} UNION ALL {_sql_chars(src, key)}", key)


_TOP = "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) <= {k}"
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id)"
_CTES = f"""WITH queries AS (SELECT id AS qid, title AS text FROM circulars),
docs AS (SELECT id AS chunk_id, chunk_text AS text, status FROM chunks), live AS (SELECT * FROM docs WHERE lower(status) = 'active'),
{SQL_INDEX},
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({SQL_INDEX.split("unnest(")[1].split(") AS term")[0].replace("chunk_text", "text")}) AS term FROM queries) GROUP BY 1, 2),
scored AS (SELECT qid, p.id AS chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM asked a JOIN posts p USING (term) JOIN idfs USING (term) JOIN stats s ON s.id = p.id, corpus GROUP BY 1, 2),
bm25 AS (SELECT qid, chunk_id, score, {_RANK} AS rank FROM scored WHERE score > 0 AND chunk_id IN (SELECT chunk_id FROM live)),
qw AS ({_sql_embedded("queries", "qid")}), dw AS ({_sql_embedded("live", "chunk_id")}),
dense AS (SELECT *, {_RANK} AS rank FROM (SELECT qid, chunk_id, sum(qw.weight * dw.weight) AS score FROM qw JOIN dw USING (bucket) GROUP BY 1, 2) WHERE score > 0),
joint AS (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS score, max(rank) FILTER (f = 'b') AS bm25_rank, max(rank) FILTER (f = 'd') AS dense_rank FROM (
 SELECT qid, chunk_id, rank, 'b' AS f FROM bm25 WHERE rank <= 40 UNION ALL SELECT qid, chunk_id, rank, 'd' FROM dense WHERE rank <= 40) GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, bm25_rank ASC NULLS LAST, dense_rank ASC NULLS LAST, chunk_id) AS rank FROM joint),
qt AS (SELECT qid, list_distinct(ts) AS qs, CASE WHEN len(ts) >= 2 THEN list_distinct({_BIGRAMS.format('ts')}) ELSE [] END AS qb FROM (SELECT qid, {SQL_RERANK('text')} AS ts FROM queries)),
dt AS (SELECT chunk_id, ts, CASE WHEN len(ts) >= 2 THEN list_distinct({_BIGRAMS.format('ts')}) ELSE [] END AS tb FROM (SELECT chunk_id, {SQL_RERANK('text')} AS ts FROM docs))
"""


def _sql_rerank(candidates: str) -> str:
    return f"""c AS (SELECT k.qid, k.chunk_id, k.rank AS was, len(ts) AS n_words, len(qs) AS nq, list_intersect(qs, ts) AS covered, len(list_intersect(qb, tb)) AS nb, greatest(len(qb), 1) AS nqb
 FROM ({candidates}) k JOIN dt USING (chunk_id) JOIN qt USING (qid)),
hits AS (SELECT qid, chunk_id, unnest(covered) AS term FROM c), dfs AS (SELECT qid, term, count(*) AS df FROM hits GROUP BY 1, 2), ns AS (SELECT qid, count(*) AS n FROM c GROUP BY 1),
rare AS (SELECT qid, chunk_id, sum(ln(1 + n / (1 + df))) AS rare FROM hits JOIN dfs USING (qid, term) JOIN ns USING (qid) GROUP BY 1, 2),
reranked AS (SELECT qid, chunk_id, was, CASE WHEN len(covered) > 0 THEN (0.6 * len(covered) / nq + 0.25 * nb / nqb + 0.15 * least(rare / 10, 1.0)) / (1 + ln(1 + n_words / 200)) ELSE 0 END AS score FROM c LEFT JOIN rare USING (qid, chunk_id)),
final AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, was) AS rank, score FROM reranked)"""


_QRELS = """qrels AS (SELECT c.id AS qid, ch.id AS chunk_id, CASE WHEN contains(lower(chunk_text), lower(doc_number)) THEN 2 ELSE 1 END AS grade
 FROM chunks ch JOIN document_versions v ON ch.document_version_id = v.id JOIN circulars c ON v.document_id = c.id WHERE lower(ch.status) = 'active'),
ideal AS (SELECT qid, sum(grade / log2(i + 1)) FILTER (i <= 10) AS idcg, count(*) FILTER (grade >= 1) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, chunk_id) AS i FROM qrels) GROUP BY 1)"""


def _sql_metrics(run: str) -> str:
    return f"""SELECT i.qid, coalesce(hits, 0) / 5 AS precision, coalesce(hits / relevant, 0) AS recall, coalesce(dcg / idcg, 0) AS ndcg, coalesce(1.0 / first, 0) AS rr FROM ideal i LEFT JOIN (
 SELECT qid, count(*) FILTER (grade >= 1 AND rank <= 5) AS hits, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS dcg, min(rank) FILTER (grade >= 1) AS first
 FROM ({run}) r JOIN qrels USING (qid, chunk_id) GROUP BY 1) h USING (qid)"""


_SHOW = "SELECT qid, chunk_id, rank, round(score, 5) AS score FROM "
_COS = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9)"
_NEAR = f"near AS (SELECT a.vec_id AS query_id, a.label AS la, b.vec_id, b.label AS lb, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near WHERE score > 0)"
_MODE_RUNS = {"bm25": "SELECT qid, chunk_id, rank FROM bm25 WHERE rank <= 8", "dense": "SELECT qid, chunk_id, rank FROM dense WHERE rank <= 8", "hybrid": "SELECT qid, chunk_id, rank FROM fused WHERE rank <= 8", "hybrid_rerank": "SELECT qid, chunk_id, rank FROM final WHERE rank <= 8"}
ORACLES = {
    "bm25_audit": f"{_CTES} {_SHOW} (SELECT qid, chunk_id, score, {_RANK} AS rank FROM scored WHERE score > 0) WHERE rank <= 8",
    "bm25_topk": f"{_CTES} {_SHOW} bm25 WHERE rank <= 8",
    "hash_embed_word": f"WITH docs AS (SELECT id AS chunk_id, chunk_text AS text FROM chunks) SELECT chunk_id, bucket, round(weight, 6) AS weight FROM ({_sql_unit(_sql_words('docs', 'chunk_id'), 'chunk_id')})",
    "hash_embed_char": f"WITH queries AS (SELECT id AS qid, title AS text FROM circulars) SELECT qid, bucket, round(weight, 6) AS weight FROM ({_sql_embedded('queries', 'qid')})",
    "hash_embed_chunks": f"WITH docs AS (SELECT id AS chunk_id, chunk_text AS text FROM chunks) SELECT chunk_id, bucket, round(weight, 6) AS weight FROM ({_sql_embedded('docs', 'chunk_id')})",
    "hash_dense_topk": f"{_CTES} {_SHOW} dense WHERE rank <= 8",
    "dense_topk": f"WITH {_NEAR} SELECT query_id, vec_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10",
    "dense_label_precision": f"WITH {_NEAR} SELECT query_id, round(count(*) FILTER (la = lb) / 10, 6) AS precision_at_10 FROM ranked WHERE rank <= 10 GROUP BY 1",
    "rrf_fuse": f"{_CTES} SELECT qid, chunk_id, rank, round(score, 6) AS score, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(dense_rank, 0) AS dense_rank FROM fused WHERE rank <= 8",
    "hybrid_topk": f"{_CTES} {_SHOW} fused WHERE rank <= 8",
    "lexical_rerank": f"{_CTES}, {_sql_rerank('SELECT qid, chunk_id, rank FROM bm25 WHERE rank <= 40')} {_SHOW} final WHERE rank <= 8",
    "hybrid_rerank_topk": f"{_CTES}, {_sql_rerank('SELECT qid, chunk_id, rank FROM fused WHERE rank <= 40')} {_SHOW} final WHERE rank <= 8",
    "qrels_anchor": f"WITH {_QRELS} SELECT qid, chunk_id, CAST(max(grade) AS BIGINT) AS grade FROM qrels GROUP BY 1, 2",
    "query_metrics": f"{_CTES}, {_QRELS} SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr FROM ({_sql_metrics(_MODE_RUNS['bm25'])})",
    "macro_by_mode": f"{_CTES}, {_sql_rerank('SELECT qid, chunk_id, rank FROM fused WHERE rank <= 40')}, {_QRELS} "
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, round(avg(precision), 5) AS precision_at_k, round(avg(recall), 5) AS recall_at_k, round(avg(ndcg), 5) AS ndcg_at_10, round(avg(rr), 5) AS mrr, count(*) AS queries FROM ({_sql_metrics(run)})" for m, run in _MODE_RUNS.items()),
}

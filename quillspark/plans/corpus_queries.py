"""Relational operations over circulars, versions, chunks and ingest results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import index as I
from quillspark.operators import versioning as V
from quillspark.operators.prefix import running_total
from quillspark.plans.text_queries import q
from quillspark.sources.tables import table

def _active() -> F.Column:
    return F.lower("status") == "active"


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "chunks"), table(spark, d, "document_versions"), table(spark, d, "circulars")


def sha_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First writer per content hash, with the number of identical texts; min of a struct combines on the map side."""
    v = table(spark, d, "document_versions").select("id", "created_at", X.content_hash(F.col("raw_text")).alias("sha256"))
    return v.groupBy("sha256").agg(F.min(F.struct("created_at", "id")).alias("first"), F.count(F.lit(1)).alias("copies")).select("sha256", F.col("first.id").alias("id"), "copies")


def stored_hash_exists(spark: SparkSession, d: str) -> DataFrame:
    """Versions whose text's hash is stored with another version (semi-join)."""
    v = table(spark, d, "document_versions")
    mine = v.select("id", X.content_hash(F.col("raw_text")).alias("sha"))
    stored = v.select(F.col("id").alias("other"), F.lower("content_sha256").alias("stored"))
    return mine.join(stored, (F.col("sha") == F.col("stored")) & (F.col("id") != F.col("other")), "left_semi").select("id")


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Latest active version of every document that has one."""
    v = table(spark, d, "document_versions").filter(_active())
    return v.groupBy("document_id").agg(F.max(F.struct("version_number", "id")).alias("m")).select("document_id", F.col("m.id").alias("id"), F.col("m.version_number").cast("long").alias("version_number"))


def version_bump(spark: SparkSession, d: str) -> DataFrame:
    """The number a next version of each document would get: over all versions, whatever their status."""
    v = table(spark, d, "document_versions")
    return v.groupBy("document_id").agg((F.max("version_number") + 1).cast("long").alias("next_number"))


def version_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").groupBy("document_version_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if(_active()).alias("active_chunk_count"))
    v = table(spark, d, "document_versions").select("id")
    return v.join(c, F.col("id") == F.col("document_version_id"), "left").select("id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("active_chunk_count", F.lit(0)).alias("active_chunk_count"))


def document_listing(spark: SparkSession, d: str) -> DataFrame:
    """Every circular with its versions as an ordered list."""
    _, v, c = _tables(spark, d)
    listed = v.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("version_number", F.coalesce(F.lower("status"), F.lit("?")).alias("s")))).alias("vs"))
    shown = F.array_join(F.transform("vs", lambda x: F.concat_ws(":", x["version_number"].cast("string"), x["s"])), " ")
    return c.join(listed, F.col("id") == F.col("document_id"), "left").select("id", "doc_number", F.coalesce(shown, F.lit("")).alias("versions"))


def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    """The 30 newest circulars: a top-k report."""
    return table(spark, d, "circulars").orderBy(F.desc("created_at"), "id").limit(30).select("id", "doc_number")


def snapshot_join(spark: SparkSession, d: str) -> DataFrame:
    s = I.snapshot(*_tables(spark, d))
    return s.select("id", "doc_number", F.col("version_number").cast("long").alias("version_number"), F.col("ordinal").cast("long").alias("ordinal"), "chunk_type", "status")


def chunk_drilldown(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its version and document, also where those are missing."""
    ch, v, c = _tables(spark, d)
    v = v.select(F.col("id").alias("vid"), "document_id", F.col("published_date").cast("string").alias("published_date"))
    c = c.select(F.col("id").alias("did"), "doc_number", "title")
    return ch.join(v, F.col("document_version_id") == F.col("vid"), "left").join(c, F.col("document_id") == F.col("did"), "left").select("id", "section_ref", "published_date", "doc_number", "title")


def unversioned_docs(spark: SparkSession, d: str) -> DataFrame:
    _, v, c = _tables(spark, d)
    return c.join(v.select(F.col("document_id").alias("id")), "id", "left_anti").select("id")


def versions_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    ch, v, _ = _tables(spark, d)
    return v.join(ch.select(F.col("document_version_id").alias("id")), "id", "left_anti").select("id")


def has_active(spark: SparkSession, d: str) -> DataFrame:
    _, v, c = _tables(spark, d)
    return c.join(v.filter(_active()).select(F.col("document_id").alias("id")), "id", "left_semi").select("id")


def remaining_active(spark: SparkSession, d: str) -> DataFrame:
    """The status each version with chunks should have: deprecated once no chunk is active."""
    c = table(spark, d, "chunks").groupBy("document_version_id").agg(F.count_if(_active()).alias("n"))
    return c.select(F.col("document_version_id").alias("id"), F.when(F.col("n") == 0, "deprecated").otherwise("active").alias("status"))


def version_links(spark: SparkSession, d: str) -> DataFrame:
    """Every version with the number and date of the version that supersedes it."""
    v = table(spark, d, "document_versions")
    by = v.select(F.col("id").alias("nid"), F.col("version_number").alias("nn"), "published_date")
    return v.select("id", "superseded_by_id").join(by, F.col("superseded_by_id") == F.col("nid"), "left").select("id", F.coalesce(F.col("nn").cast("long"), F.lit(-1)).alias("next_number"), F.col("published_date").cast("string").alias("next_date"))


def resolve_reference(spark: SparkSession, d: str) -> DataFrame:
    """For every circular's number, and for that number without its last digit: the document it resolves to, if any.

    A document number counts before a reference that the header of a stored version bears, also within a longer one;
    the earliest version wins. The forms a header bears are spelt out, so the match is an equi-join.
    """
    _, v, c = _tables(spark, d)
    asked = c.select(F.explode(F.array(F.col("doc_number"), F.expr("substr(doc_number, 1, length(doc_number) - 1)"))).alias("ref")).distinct()
    exact = c.select(F.lower("doc_number").alias("r"), F.lit(0).alias("prio"), "created_at", F.col("id").alias("document_id"))
    bearing = v.select(F.explode(V.borne(F.col("raw_text"))).alias("r"), F.lit(1).alias("prio"), "created_at", "document_id")
    best = exact.unionByName(bearing).groupBy("r").agg(F.min(F.struct("prio", "created_at", "document_id")).alias("m"))
    return asked.join(best, F.lower("ref") == F.col("r"), "left").select("ref", F.col("m.document_id").alias("document_id"))


def header_containment(spark: SparkSession, d: str) -> DataFrame:
    """Versions whose header bears the number of their document."""
    _, v, c = _tables(spark, d)
    j = v.join(c.select(F.col("id").alias("did"), "doc_number"), F.col("document_id") == F.col("did"))
    return j.filter(F.contains(F.lower(F.left("raw_text", F.lit(3000))), F.lower("doc_number"))).select("id", "doc_number")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.index_stats(I.snapshot(*_tables(spark, d)))


def ingest_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Ingest attempts without rows stored twice, summed by reason and outcome."""
    return table(spark, d, "ingest_results").distinct().groupBy("reason", "skipped").agg(F.count(F.lit(1)).alias("attempts"), F.sum("chunks_created").alias("chunks_created"), F.countDistinct("doc_number").alias("documents"))


def ingest_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt of every document number."""
    r = table(spark, d, "ingest_results")
    return r.groupBy("doc_number").agg(F.max(F.struct("created_at", "version_number", "version_id", "reason")).alias("m")).select("doc_number", F.col("m.version_id").alias("version_id"), F.col("m.reason").alias("reason"))


def status_report(spark: SparkSession, d: str) -> DataFrame:
    ch, v, c = _tables(spark, d)
    s = I.snapshot(ch, v, c)
    return s.groupBy("doc_number").agg(F.countDistinct("document_version_id").alias("versions"), F.count(F.lit(1)).alias("chunks"), F.count_if(_active()).alias("active"))


def chat_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 30 users with the latest events, as sessions with their first event as title."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.min(F.struct("ts", "event_id", "event_type")).alias("f"), F.count(F.lit(1)).alias("messages"))
    return s.orderBy(F.desc("last"), "user_id").limit(30).select("user_id", F.concat_ws(" ", F.lit("session:"), F.col("f.event_type")).alias("title"), "messages")


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as numbered turns, with the keys of their properties out of JSON text. A user may hold a third of all events: turns are numbered over all tasks."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "props")
    turns = running_total(e.withColumn("one", F.lit(1).cast("long")), ["user_id"], ["ts", "event_id"], "one", "turn")
    keys = F.array_join(F.array_sort(F.map_keys(F.from_json("props", "map<string,string>"))), ",")
    return turns.select("event_id", "user_id", "turn", "event_type", F.coalesce(keys, F.lit("")).alias("keys"))


def tables_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that lie in paragraph 2 or 3.1, by their section or their body lines."""
    c = table(spark, d, "chunks")
    return c.filter(X.in_scope(F.col("section_ref"), F.col("chunk_text"), F.array(F.lit("2"), F.lit("3.1")))).select("id")


def postings(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(table(spark, d, "chunks").select("id", "chunk_text"), "id", "chunk_text")


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_stats(table(spark, d, "chunks").select("id", "chunk_text"), "id", "chunk_text")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.corpus_stats(doc_stats(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def idf(spark: SparkSession, d: str) -> DataFrame:
    return I.idf(postings(spark, d), I.corpus_stats(doc_stats(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


_FUNCTIONS = (
    sha_dedupe, stored_hash_exists, latest_version, version_bump, version_counts, document_listing, recent_documents, snapshot_join, chunk_drilldown,
    unversioned_docs, versions_without_chunks, has_active, remaining_active, version_links, resolve_reference, header_containment, index_stats,
    ingest_distinct, ingest_latest, status_report, chat_sessions, chat_history, tables_in_scope, postings, doc_stats, corpus_stats, idf,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

from quillspark.plans.text_queries import SQL_BM25, _sql_ref, sql_normalise  # noqa: E402

_SNAP = "chunks ch JOIN document_versions v ON ch.document_version_id = v.id JOIN circulars c ON v.document_id = c.id"
_HINT = f"list_filter(list_transform(regexp_extract_all({sql_normalise('raw_text')}, {q(X.SUPERSESSION)}), lambda s: {_sql_ref('s')}), lambda r: r IS NOT NULL)[1]"
SQL_INDEX = f"""
posts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({SQL_BM25('chunk_text')}) AS term FROM chunks) GROUP BY 1, 2),
stats AS (SELECT id, len({SQL_BM25('chunk_text')}) AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
raws AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, corpus GROUP BY term),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
ORACLES = {
    "sha_dedupe": "SELECT sha256(raw_text) AS sha256, arg_min(id, (created_at, id)) AS id, count(*) AS copies FROM document_versions GROUP BY 1",
    "stored_hash_exists": "SELECT id FROM document_versions a WHERE EXISTS (SELECT 1 FROM document_versions b WHERE lower(b.content_sha256) = sha256(a.raw_text) AND a.id <> b.id)",
    "latest_version": "SELECT document_id, id, CAST(version_number AS BIGINT) AS version_number FROM document_versions WHERE lower(status) = 'active' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC, id DESC) = 1",
    "version_bump": "SELECT document_id, CAST(max(version_number) + 1 AS BIGINT) AS next_number FROM document_versions GROUP BY 1",
    "version_counts": "SELECT v.id, count(c.id) AS chunk_count, count(c.id) FILTER (lower(c.status) = 'active') AS active_chunk_count FROM document_versions v LEFT JOIN chunks c ON c.document_version_id = v.id GROUP BY 1",
    "document_listing": "SELECT c.id, c.doc_number, coalesce(string_agg(v.version_number || ':' || coalesce(lower(v.status), '?'), ' ' ORDER BY v.version_number, v.status), '') AS versions FROM circulars c LEFT JOIN document_versions v ON v.document_id = c.id GROUP BY 1, 2",
    "recent_documents": "SELECT id, doc_number FROM circulars ORDER BY created_at DESC, id LIMIT 30",
    "snapshot_join": f"SELECT ch.id, doc_number, CAST(version_number AS BIGINT) AS version_number, CAST(ordinal AS BIGINT) AS ordinal, chunk_type, ch.status FROM {_SNAP}",
    "chunk_drilldown": "SELECT ch.id, section_ref, CAST(published_date AS VARCHAR) AS published_date, doc_number, title FROM chunks ch LEFT JOIN document_versions v ON ch.document_version_id = v.id LEFT JOIN circulars c ON v.document_id = c.id",
    "unversioned_docs": "SELECT id FROM circulars WHERE id NOT IN (SELECT document_id FROM document_versions)",
    "versions_without_chunks": "SELECT id FROM document_versions WHERE id NOT IN (SELECT document_version_id FROM chunks)",
    "has_active": "SELECT id FROM circulars WHERE id IN (SELECT document_id FROM document_versions WHERE lower(status) = 'active')",
    "remaining_active": "SELECT document_version_id AS id, CASE WHEN count(*) FILTER (lower(status) = 'active') = 0 THEN 'deprecated' ELSE 'active' END AS status FROM chunks GROUP BY 1",
    "version_links": "SELECT a.id, coalesce(CAST(b.version_number AS BIGINT), -1) AS next_number, CAST(b.published_date AS VARCHAR) AS next_date FROM document_versions a LEFT JOIN document_versions b ON a.superseded_by_id = b.id",
    "resolve_reference": f"""WITH asked AS (SELECT DISTINCT unnest([doc_number, doc_number[:-2]]) AS ref FROM circulars),
exact AS (SELECT lower(doc_number) AS r, arg_min(id, (created_at, id)) AS document_id FROM circulars GROUP BY 1),
holds AS (SELECT ref, arg_min(document_id, (created_at, document_id)) AS document_id FROM asked JOIN document_versions ON contains(lower(left(raw_text, 3000)), lower(ref)) WHERE regexp_full_match(lower(ref), {q("(?:" + V._ANY_CASE_NUMBER.replace("(?i)", "").lower().replace("\\d", "[0-9]") + ")")}) OR regexp_full_match(lower(ref), {q("(?i)(?:" + V._ANY_CASE_REFERENCE.replace("(?i)", "") + ")")}) GROUP BY 1)
SELECT ref, coalesce(e.document_id, h.document_id) AS document_id FROM asked LEFT JOIN exact e ON r = lower(ref) LEFT JOIN holds h USING (ref)""",
    "header_containment": "SELECT v.id, doc_number FROM document_versions v JOIN circulars c ON v.document_id = c.id WHERE contains(lower(left(raw_text, 3000)), lower(doc_number))",
    "index_stats": f"SELECT count(DISTINCT doc_number) AS documents, count(*) AS chunks, count(*) FILTER (lower(ch.status) = 'active') AS active, count(*) FILTER (lower(ch.status) = 'deprecated') AS deprecated, count(*) FILTER (chunk_type = 'table') AS tables FROM {_SNAP}",
    "ingest_distinct": "SELECT reason, skipped, count(*) AS attempts, CAST(sum(chunks_created) AS BIGINT) AS chunks_created, count(DISTINCT doc_number) AS documents FROM (SELECT DISTINCT * FROM ingest_results) GROUP BY 1, 2",
    "ingest_latest": "SELECT doc_number, version_id, reason FROM ingest_results QUALIFY row_number() OVER (PARTITION BY doc_number ORDER BY created_at DESC, version_number DESC, version_id DESC, reason DESC) = 1",
    "status_report": f"SELECT doc_number, count(DISTINCT document_version_id) AS versions, count(*) AS chunks, count(*) FILTER (lower(ch.status) = 'active') AS active FROM {_SNAP} GROUP BY 1",
    "chat_sessions": "SELECT user_id, 'session: ' || arg_min(event_type, (ts, event_id)) AS title, count(*) AS messages FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 30",
    "chat_history": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type, coalesce(array_to_string(list_sort(json_keys(props)), ','), '') AS keys FROM events",
    "tables_in_scope": r"""SELECT id FROM chunks WHERE list_bool_or(list_transform(string_split(coalesce(section_ref, ''), '>'), lambda c: regexp_matches(trim(c), '^2(\.|\s|$|\))') OR regexp_matches(trim(c), '^3\.1(\.|\s|$|\))')))
 OR regexp_matches(chunk_text, '(?m)^2[.)]\s') OR regexp_matches(chunk_text, '(?m)^3\.1[.)]\s')""",
    "postings": f"WITH {SQL_INDEX} SELECT * FROM posts",
    "doc_stats": f"WITH {SQL_INDEX} SELECT * FROM stats",
    "corpus_stats": f"WITH {SQL_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM corpus",
    "idf": f"WITH {SQL_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs",
}

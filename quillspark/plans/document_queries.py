"""Chunking, versioning, answers and streaming over the domain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import answers as A
from quillspark.operators import chunking as C
from quillspark.operators import evaluation as E
from quillspark.operators import index as I
from quillspark.operators import providers as P
from quillspark.operators import retrieval as R
from quillspark.operators import versioning as V
from quillspark.operators.prefix import running_total
from quillspark.plans import retrieval_queries as Q
from quillspark.plans.text_queries import _WORDS, SQL_ANSWER, SQL_CLAIM, SQL_NUMBERS, SQL_SALIENT, _sql_parsed, q, sql_normalise
from quillspark.session import shared_dir, staged
from quillspark.sources.tables import table
from quillspark.streaming import ingest as S


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_versions").select("id", "raw_text")


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    c = C.fixed_chunks(_versions(spark, d), "id", "raw_text")
    return c.select("id", F.col("ordinal").cast("long").alias("ordinal"), F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk(_versions(spark, d), "id", "raw_text", "recursive")


def chunk_structure_aware(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk(_versions(spark, d), "id", "raw_text", "structure_aware")


def rechunk_all(spark: SparkSession, d: str) -> DataFrame:
    return V.rechunk_all(table(spark, d, "document_versions"), "structure_aware")


#: A text and the chunks that the rules make of it, written down by hand: rows of (chunker, ordinal, type, section, text); sizes of 20 and 4 tokens.
CASE_TEXT = (
    "Preamble of it.\n\n1. Head\nbody one\n\n2. Next\nbody | two |\n| three | four\n\nafter one bar | here\nrow [TABLE] mark\n1. a | b\n\nc\n[/TABLE]\n"
    "a b c d e f g h i j k l m n o p q r s t u v w x y z\n\nANNEX ONE\nlast words of it here are more than a few and so they do not join what goes before them"
)
_N, _A = "2. Next", "ANNEX ONE"
CASE_CHUNKS = (
    ("structure_aware", 0, "prose", None, "Preamble of it.\n\n1. Head\nbody one\n\n2. Next"),
    ("structure_aware", 1, "table", _N, f"[Section: {_N}]\nbody | two |\n| three | four"),
    ("structure_aware", 2, "prose", _N, f"[Section: {_N}]\nafter one bar | here"),
    ("structure_aware", 3, "table", _N, f"[Section: {_N}]\n1. a | b\n\nc"),
    ("structure_aware", 4, "prose", _N, f"[Section: {_N}]\na b c d e f g h i j k l m n o p q r s t\n\n[Section: {_N}]\nq r s t u v w x y z\n\n[Section: {_A}]\nANNEX ONE last words of it here are more than a few and so they do not join what goes\n\n[Section: {_A}]\nnot join what goes before them"),
    ("recursive", 0, "prose", None, "Preamble of it.\n\n1. Head\nbody one\n\n2. Next\nbody | two |\n| three | four"),
    ("recursive", 1, "prose", None, "after one bar | here\nrow [TABLE] mark\n1. a | b"),
    ("recursive", 2, "prose", None, "c [/TABLE] a b c d e f g h i j k l m n o p q r"),
    ("recursive", 3, "prose", None, "s t u v w x y z"),
    ("recursive", 4, "prose", None, "ANNEX ONE last words of it here are more than a few and so they do not join what goes"),
    ("recursive", 5, "prose", None, "before them"),
)


def chunk_cases(spark: SparkSession, d: str) -> DataFrame:
    """The greedy chunkers on a text whose chunks are known."""
    docs, out = spark.createDataFrame([(1, CASE_TEXT)], "id long, t string"), None
    for name in ("structure_aware", "recursive"):
        c = C.chunk(docs, "id", "t", name, 20, 4).select(F.lit(name).alias("chunker"), F.col("ordinal").cast("long").alias("ordinal"), "chunk_type", "section_ref", "chunk_text")
        out = c if out is None else out.unionByName(c)
    return out


def reembed_all(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk embedded again: width, signature and length of its vector, 0 for a text without a token."""
    e = P.reembed_all(Q._docs(spark, d), P.embedder())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("chunk_id", F.col("embedding_dim").cast("long").alias("embedding_dim"), "signature", F.round(norm, 3).alias("norm"))


def rechunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every version by windows of words, with the status of their version."""
    c = V.rechunk_all(table(spark, d, "document_versions"), "fixed")
    return c.select("id", F.col("ordinal").cast("long").alias("ordinal"), F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), "status")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Judgments by anchor: chunks of a circular with the first two words of its title are the best, those with the first word good ones."""
    c = table(spark, d, "circulars").select(F.col("id").alias("qid"), F.col("doc_number").alias("doc"), F.trim("title").alias("t"))
    anchors = [F.struct(F.substring_index("t", " ", n).alias("anchor"), F.lit(n).alias("grade")) for n in (2, 1)]
    return c.select("qid", "doc", F.inline(F.array(*anchors))).filter("anchor <> ''")


def _circular_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.snapshot(table(spark, d, "chunks"), table(spark, d, "document_versions"), table(spark, d, "circulars")).select(F.col("id").alias("chunk_id"), F.col("chunk_text").alias("text"), "doc_number", "status")


def judged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Anchored judgments resolved to the active chunks that hold them."""
    return E.resolve_judgments(_judged(spark, d), _circular_chunks(spark, d))[0].select("qid", "chunk_id", F.col("grade").cast("long").alias("grade"))


def judgments_missing(spark: SparkSession, d: str) -> DataFrame:
    """Anchored judgments that no chunk holds."""
    return E.resolve_judgments(_judged(spark, d), _circular_chunks(spark, d))[1].select("qid", "anchor")


def chunker_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the default mode after each chunker has cut all versions anew, judgments resolved in the new chunks."""
    v = table(spark, d, "document_versions").select(F.col("id").alias("version_id"), "document_id", F.col("raw_text").alias("text"), "status")
    v = v.join(table(spark, d, "circulars").select(F.col("id").alias("document_id"), "doc_number"), "document_id")
    swept = E.chunking_sweep(v.select("version_id", "text", "doc_number", "status"), Q._queries(spark, d), _judged(spark, d), 5)
    return swept.select("config", "chunks", "tokens", *[F.round(c, 5).alias(c) for c in E.FIGURES], "queries")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Versions numbered in the order they came: small keys are ordered over all tasks, the texts aren't sorted."""
    v = table(spark, d, "document_versions").select("id", "created_at", F.col("raw_text").alias("raw"))
    keys = v.select("id", "created_at", F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"))
    return v.join(running_total(keys, ["all"], ["created_at", "id"], "one", "seq").select("id", "seq"), "id").select("seq", "raw")


def ingest_results(spark: SparkSession, d: str) -> DataFrame:
    """All version texts ingested in their order into an empty store."""
    return V.ingest(_ordered(spark, d)).results


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each text: its document, its version number, or that it was skipped."""
    return V.ingest(_ordered(spark, d)).results.select("seq", "doc_number", "title", F.coalesce(F.col("version_number").cast("long"), F.lit(0)).alias("version_number"), "skipped", "reason")


def deprecate_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Chunk counts by status after that ingest, with supersession in full and by paragraph."""
    return V.ingest(_ordered(spark, d)).chunks.groupBy("version_id", "status").agg(F.count(F.lit(1)).alias("chunks"))


def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    return V.ingest(_ordered(spark, d)).links.select("by", "target", F.array_join("scope", ",").alias("scope"))


#: Texts whose clauses resolve, which those of the tables never do: rows of (seq, text) in the order of ingest.
INGESTED = (
    (1, "RBI/QQQ/2029-30/18\nXYZ.ABC.DE.No.12/34.56.789/2029-30\nHarbour Fees Directions\n\n1. Scope\n1.1 All harbours."),
    (2, "RBI/2030-31/12\nxyz.fee.rec.5/11.22.333/2030-31 (as amended)\nLighthouse Dues Circular\n\n1. Scope\n1.1 All lights."),
    (3, "RBI/2030-31/1\nPilotage Circular\n\nIn supersession of paragraph 1 of XYZ.ABC.DE.No.12/34.56.789/2029-30, pilots shall act."),
    (4, "RBI/QQQ/2029-30/18\nXYZ.ABC.DE.No.12/34.56.789/2029-30\nHarbour Fees Directions\n\n1. Scope\n1.1 All harbours and docks."),
    (5, "RBI/2031-32/3\nBuoys Circular\n\nThis supersedes clauses 2 and 3.1 of RBI/QQQ/2029-30/18 in part."),
    (6, "RBI/2031-32/4\nWrecks Circular\n\nThis replaces FEE.REC.5/11.22.333/2030-31 and other texts."),
    (7, "RBI/2031-32/5\nDredging Circular\n\nThis replaces RBI/2031-32/9, which comes later."),
    (8, "RBI/2031-32/9\nAnchorage Circular\n\nThis amends the RBI/2031-32/9 of last year, that is, itself."),
    (9, "RBI/2031-32/10\nMoorings Circular\n\nThis replaces RBI/2030-31/1 of old."),
)


def supersede_cases(spark: SparkSession, d: str) -> DataFrame:
    """Links among INGESTED: by number, by a reference in a header, as part of a longer one, to nothing."""
    out = V.ingest(spark.createDataFrame(INGESTED, "seq long, raw string"))
    seqs = out.versions.select("version_id", "seq")
    by, target = seqs.select(F.col("version_id").alias("by"), F.col("seq").alias("by_seq")), seqs.select(F.col("version_id").alias("target"), F.col("seq").alias("target_seq"))
    return out.links.join(by, "by").join(target, "target").select("by_seq", "target_seq", F.array_join("scope", ",").alias("scope"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    s = I.snapshot(table(spark, d, "chunks"), table(spark, d, "document_versions"), table(spark, d, "circulars"))
    return s.select(F.col("id").alias("chunk_id"), F.col("chunk_text").alias("text"), "doc_number", "title")


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, the hits of the default search, passages with their source."""
    queries = Q._queries(spark, d)
    hits = staged(R.search(queries, Q._docs(spark, d), "hybrid_rerank", Q.K).select("qid", "chunk_id", "rank"), "hits")
    return queries, hits, staged(_passages(spark, d).join(hits.select("chunk_id").distinct(), "chunk_id"), "passages")


def extractive_sentences(spark: SparkSession, d: str) -> DataFrame:
    b = A.best_sentences(*_hits(spark, d))
    return b.select("qid", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "sentence", F.round("score", 5).alias("score"))


def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    return A.confidence(*_hits(spark, d)).select("qid", F.round("confidence", 6).alias("confidence"))


def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    return A.answers(*_hits(spark, d)).select("qid", "answer", "refused")


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    queries, hits, docs = _hits(spark, d)
    answered = staged(A.answers(queries, hits, docs), "answers")
    return answered, A.check_answers(answered, hits, docs)[1]


def faithfulness_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)[1]


def faithfulness_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.faithfulness_summary(faithfulness_report(spark, d))


def answer_remarks(spark: SparkSession, d: str) -> DataFrame:
    return A.remarks(*_report(spark, d))


def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What a generator would be given for each query: its numbered passages, as a digest."""
    _, hits, _ = _hits(spark, d)
    s = I.snapshot(table(spark, d, "chunks"), table(spark, d, "document_versions"), table(spark, d, "circulars"))
    docs = s.select(F.col("id").alias("chunk_id"), F.col("chunk_text").alias("text"), "doc_number", "title", "section_ref", "published_date", "status")
    return A.source_blocks(hits, docs).select("qid", F.md5(F.col("sources").cast("binary")).alias("sources_md5"), F.length("sources").cast("long").alias("n_chars"))


def notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices on the hits of all queries, deprecated chunks included."""
    docs, queries = Q._docs(spark, d), Q._queries(spark, d)
    hits = R.bm25(queries, docs, Q.K).select("qid", "chunk_id")
    snap = I.snapshot(table(spark, d, "chunks"), table(spark, d, "document_versions"), table(spark, d, "circulars"))
    return A.notices(hits.join(snap.select(F.col("id").alias("chunk_id"), "status", "doc_number", "published_date"), "chunk_id"))


def lexical_support(spark: SparkSession, d: str) -> DataFrame:
    """Support that each chunk gives to the chunk after it in its version."""
    c = table(spark, d, "chunks").select("id", "document_version_id", "ordinal", "chunk_text")
    after = Window.partitionBy("document_version_id").orderBy("ordinal", "id")
    pairs = c.select("id", "chunk_text", F.lead("chunk_text").over(after).alias("claim")).filter("claim is not null")
    return pairs.select("id", F.round(A.lexical_support(F.col("claim"), F.col("chunk_text")), 6).alias("support"))


def salient_missing(spark: SparkSession, d: str) -> DataFrame:
    """Salient tokens of each title that the versions' texts of the circular lack."""
    c = table(spark, d, "circulars").select(F.col("id").alias("document_id"), "title")
    v = table(spark, d, "document_versions").select("id", "document_id", "raw_text").join(c, "document_id")
    low = F.lower("raw_text")
    return v.select("id", F.array_join(F.array_sort(F.filter(X.salient_tokens(F.col("title")), lambda t: ~F.contains(low, t))), " ").alias("missing"))


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the documents as a stream of files would leave them after dropping repeats.

    The pattern in the path lets a single file count as a stream source as well as a folder.
    """
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{d}/document[s].parquet")
    out = f"{shared_dir(spark)}/stream-out-{uuid.uuid4().hex}"
    return S.run_to_end(S.first_of_hash(stream).select("sha256"), out, uuid.uuid4().hex).distinct()


def stream_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day, read as a stream with a watermark and written when a day is complete or the input ends."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("time", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark)}/stream-out-{uuid.uuid4().hex}"
    kept = S.run_to_end(stream.withWatermark("time", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_type", F.to_date("time").cast("string").alias("day")), out, uuid.uuid4().hex)
    return kept.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("events"))


_FUNCTIONS = (
    chunk_fixed, chunk_recursive, chunk_structure_aware, chunk_cases, reembed_all, rechunk_all, rechunk_fixed, judged_chunks, judgments_missing, chunker_sweep, ingest_results, ingest_outcomes, deprecate_scoped, supersede_chain, supersede_cases, extractive_sentences,
    retrieval_confidence, extractive_answers, faithfulness_report, faithfulness_summary, answer_remarks, source_blocks, notices, lexical_support, salient_missing, stream_dedupe, stream_ingest_counts,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_SENTENCES = f"list_transform(string_split(regexp_replace(replace(regexp_replace(text, {q(X.SECTION_PREFIX)}, ''), chr(10), ' '), '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' -•' || chr(9)))"
_FOUND = f"{Q._CTES}, {Q._sql_rerank('SELECT qid, chunk_id, rank FROM fused WHERE rank <= 40')}, top AS (SELECT qid, chunk_id, rank FROM final WHERE rank <= 8)"
_ALL_WORDS = lambda t: f"list_distinct(regexp_extract_all(lower({t}), {q(X.ANSWER_WORD)}))"
_BEST = f"""kws AS (SELECT qid, {SQL_ANSWER('text')} AS kw FROM queries),
 h AS (SELECT qid, chunk_id, rank, count(*) OVER (PARTITION BY qid) AS many FROM top),
 sen AS (SELECT qid, rank, many, kw, unnest({_SENTENCES}) AS sentence, generate_subscripts({_SENTENCES}, 1) AS nth FROM h JOIN docs USING (chunk_id) JOIN kws USING (qid)),
 sc AS (SELECT *, len(list_intersect(kw, {_ALL_WORDS('sentence')})) / (1 + len({_ALL_WORDS('sentence')}) / 60) + (many - rank) * 0.01 AS score FROM sen
   WHERE len(sentence) BETWEEN 40 AND 600 AND len(list_intersect(kw, {_ALL_WORDS('sentence')})) > 0),
 un AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid, lower(left(sentence, 80)) ORDER BY round(score, 9) DESC, rank, nth) = 1),
 best AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank, nth) AS place, rank AS n, sentence, round(score, 5) AS score FROM un
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank, nth) <= 5),
 got AS (SELECT qid, count(DISTINCT w) AS n FROM (SELECT qid, unnest(list_intersect(kw, {_ALL_WORDS('docs.text')})) AS w FROM top JOIN docs USING (chunk_id) JOIN kws USING (qid) WHERE rank <= 3) GROUP BY 1),
 conf AS (SELECT qid, CASE WHEN len(kw) = 0 THEN 1.0 ELSE coalesce(n, 0) / len(kw) END AS confidence FROM kws LEFT JOIN got USING (qid)),
 bul AS (SELECT qid, string_agg('- ' || regexp_replace(sentence, '\\.+$', '') || '. [' || n || ']', chr(10) ORDER BY place) AS b FROM best GROUP BY 1),
 head AS (SELECT qid, doc_number || coalesce(', ' || regexp_replace(title, '\\.+$', ''), '') AS source FROM top JOIN chunks ch ON ch.id = chunk_id JOIN document_versions v ON v.id = document_version_id JOIN circulars c ON c.id = document_id WHERE rank = 1),
 ans AS (SELECT qid, CASE WHEN confidence < 0.4 OR b IS NULL THEN {q(X.REFUSAL)} || chr(10) || chr(10) || {q(X.DISCLAIMER)} ELSE 'According to ' || source || ': [1]' || chr(10) || chr(10) || b || chr(10) || chr(10) || {q(X.DISCLAIMER)} END AS answer,
   confidence < 0.4 OR b IS NULL AS refused, confidence FROM conf LEFT JOIN bul USING (qid) LEFT JOIN head USING (qid))"""
_CITE = q(X.CITATION)
_CHECKED = f"""lines AS (SELECT qid, unnest(string_split(translate(answer, chr(8239) || chr(160), '  '), chr(10))) AS line FROM ans),
 parts AS (SELECT qid, row_number() OVER () AS id, trim(x, ' -*' || chr(9)) AS s FROM (SELECT qid, unnest(string_split(regexp_replace(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '([\\[【])(\\d)', ' \\1\\2', 'g'), chr(1))) AS x FROM lines)),
 bare AS (SELECT qid, id, trim(regexp_replace(s, {_CITE}, '', 'g')) AS claim, regexp_extract_all(s, {_CITE}, 1) AS cites FROM parts),
 cl AS (SELECT * FROM bare WHERE len({SQL_CLAIM('claim')}) >= 3 AND (len(cites) > 0 OR NOT (starts_with(lower(claim), {q(X.REFUSAL.lower().rstrip('.'))}) OR starts_with(lower(claim), {q(X.DISCLAIMER.lower().rstrip('.'))})
   OR ends_with(claim, ':') OR (starts_with(claim, '**') AND ends_with(claim, '**'))))),
 cn AS (SELECT qid, id, claim, CAST(unnest(cites) AS BIGINT) AS n FROM cl UNION ALL SELECT qid, id, claim, NULL FROM cl WHERE len(cites) = 0),
 cp AS (SELECT cn.qid, cn.id, cn.n, claim, docs.text AS passage FROM cn LEFT JOIN top ON top.qid = cn.qid AND top.rank = cn.n LEFT JOIN docs USING (chunk_id)),
 cf AS (SELECT *, {SQL_CLAIM('claim')} AS cw, {SQL_CLAIM('passage')} AS pw, {SQL_NUMBERS('claim')} AS cnum, {SQL_NUMBERS('passage')} AS pnum, {SQL_SALIENT('claim')} AS sal FROM cp),
 co AS (SELECT *, CASE WHEN len(cw) = 0 THEN 1.0 ELSE len(list_intersect(cw, pw)) / len(cw) END AS ov, len(list_filter(sal, lambda t: NOT contains(lower(passage), t))) AS miss FROM cf),
 cb AS (SELECT *, CASE WHEN len(cnum) > 0 THEN 0.6 * ov + 0.4 * len(list_intersect(cnum, pnum)) / len(cnum) ELSE ov END AS base FROM co),
 cs AS (SELECT qid, id, n, passage, CASE WHEN passage IS NOT NULL THEN CASE WHEN miss > 0 THEN base * greatest(0.15, 1 - 0.6 * miss / len(sal)) ELSE base END END AS score FROM cb),
 claims AS (SELECT qid, id, coalesce(max(score), 0) >= 0.35 AS supported, count(n) = 0 AS uncited FROM cs GROUP BY 1, 2),
 bad AS (SELECT qid, count(DISTINCT n) AS invalid FROM cs WHERE n IS NOT NULL AND passage IS NULL GROUP BY 1),
 report AS (SELECT a.qid, round(coalesce(sum(supported::INT) / nullif(count(id), 0), 1.0), 3) AS rate, count(id) AS checked, CAST(coalesce(sum(supported::INT), 0) AS BIGINT) AS supported,
   CAST(coalesce(sum(uncited::INT), 0) AS BIGINT) AS uncited, coalesce(any_value(invalid), 0) AS invalid FROM ans a LEFT JOIN claims USING (qid) LEFT JOIN bad USING (qid) GROUP BY 1)"""
_SUPPORT = """round(CASE WHEN miss > 0 THEN base * greatest(0.15, 1 - 0.6 * miss / len(sal)) ELSE base END, 6)"""
_JUDGED = """WITH judged AS (SELECT id AS qid, doc_number AS doc, array_to_string(string_split(trim(title), ' ')[1:n], ' ') AS anchor, n AS grade FROM circulars, (VALUES (1), (2)) x(n) WHERE trim(title) <> ''),
 hits AS (SELECT j.qid, j.anchor, j.grade, ch.id AS chunk_id FROM judged j JOIN circulars c ON c.doc_number = j.doc JOIN document_versions v ON v.document_id = c.id JOIN chunks ch ON ch.document_version_id = v.id
  WHERE lower(ch.status) = 'active' AND contains(lower(chunk_text), lower(j.anchor)))"""
_STORED = f"SELECT row_number() OVER (ORDER BY created_at, id) AS seq, {sql_normalise('raw_text')} AS t FROM document_versions"
_GIVEN = "SELECT * FROM (VALUES " + ",".join(f"({n}, {q(t)})" for n, t in INGESTED) + ") x(seq, t)"
_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'document')"
# texts in order, the first of each hash numbered within its document; links to the version before, and to what a clause names:
# the document of that number, else that of the first text whose head holds it, if it came before; its latest version before
_INGEST = f"""WITH src AS ({_STORED}), p AS ({_sql_parsed('seq, t')}),
 titled AS (SELECT *, coalesce(title, 'Untitled document') AS heading FROM p),
 i AS (SELECT seq, t, heading AS title, coalesce(doc_number, 'LOCAL/' || {_SLUG.format('heading')}) AS doc_number, supersedes_hint AS hint, supersedes_scope AS scope, sha256(t) AS sha, row_number() OVER (PARTITION BY sha256(t) ORDER BY seq) AS nth FROM titled),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_number ORDER BY seq) AS version_number FROM i WHERE nth = 1),
 v AS (SELECT *, sha256(doc_number || '|' || version_number || '|' || sha) AS version_id FROM n)"""
_LINKS = """asks AS (SELECT seq, doc_number AS mine, lower(trim(hint)) AS r, scope FROM v WHERE hint IS NOT NULL),
 ex AS (SELECT a.seq, arg_min(v.doc_number, v.seq) AS of FROM asks a JOIN v ON lower(v.doc_number) = r GROUP BY a.seq HAVING min(v.seq) < a.seq),
 be AS (SELECT a.seq, arg_min(v.doc_number, v.seq) AS of FROM asks a JOIN v ON contains(lower(left(v.t, 3000)), r) GROUP BY a.seq HAVING min(v.seq) < a.seq),
 res AS (SELECT a.seq, mine, scope, coalesce(ex.of, be.of) AS of FROM asks a LEFT JOIN ex USING (seq) LEFT JOIN be USING (seq)),
 links AS (SELECT seq AS by_seq, lag(seq) OVER (PARTITION BY doc_number ORDER BY seq) AS target_seq, '' AS scope FROM v QUALIFY target_seq IS NOT NULL
  UNION ALL SELECT r.seq, max(v.seq), any_value(r.scope) FROM res r JOIN v ON v.doc_number = r.of WHERE r.of <> r.mine AND v.seq < r.seq GROUP BY r.seq)"""
ORACLES = {
    "chunk_fixed": f"""WITH w AS (SELECT id, {_WORDS.replace('chunk_text', 'raw_text')} AS ws FROM document_versions),
 s AS (SELECT id, ws, unnest(range(0, len(ws), 290)) AS i FROM w WHERE len(ws) > 0),
 k AS (SELECT id, i // 290 AS ordinal, array_to_string(ws[i + 1 : i + 350], ' ') AS t FROM s WHERE i = 0 OR i - 290 + 350 < len(ws))
 SELECT id, ordinal, md5(t) AS text_md5, len(regexp_extract_all(t, {q(X.BUDGET_TOKEN)})) AS token_count FROM k WHERE ordinal = 0 OR len(regexp_extract_all(t, {q(X.BUDGET_TOKEN)})) >= 15""",
    "chunk_cases": "SELECT * FROM (VALUES " + ",".join(f"({q(a)}, {n}, {q(k)}, {q(r) if r else 'NULL'}, {q(t)})" for a, n, k, r, t in CASE_CHUNKS) + ") x(chunker, ordinal, chunk_type, section_ref, chunk_text)",
    "reembed_all": f"SELECT id AS chunk_id, 1024 AS embedding_dim, 'hashing:1024' AS signature, CASE WHEN len({Q.SQL_RERANK('chunk_text')}) > 0 THEN 1.0 ELSE 0.0 END AS norm FROM chunks",
    "rechunk_fixed": f"""WITH w AS (SELECT id, lower(status) AS status, {_WORDS.replace('chunk_text', 'raw_text')} AS ws FROM document_versions),
 s AS (SELECT id, status, ws, unnest(range(0, len(ws), 290)) AS i FROM w WHERE len(ws) > 0),
 k AS (SELECT id, status, i // 290 AS ordinal, array_to_string(ws[i + 1 : i + 350], ' ') AS t FROM s WHERE i = 0 OR i - 290 + 350 < len(ws))
 SELECT id, ordinal, md5(t) AS text_md5, status FROM k WHERE ordinal = 0 OR len(regexp_extract_all(t, {q(X.BUDGET_TOKEN)})) >= 15""",
    "judged_chunks": f"{_JUDGED} SELECT qid, chunk_id, CAST(max(grade) AS BIGINT) AS grade FROM hits GROUP BY 1, 2",
    "judgments_missing": f"{_JUDGED} SELECT qid, anchor FROM judged j WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = j.qid AND h.anchor = j.anchor)",
    "ingest_outcomes": f"{_INGEST} SELECT i.seq, i.doc_number, i.title, coalesce(v.version_number, 0) AS version_number, i.nth > 1 AS skipped, CASE WHEN i.nth > 1 THEN {q(X.DUPLICATE_REASON)} ELSE '' END AS reason FROM i LEFT JOIN v USING (seq)",
    "supersede_chain": f"{_INGEST}, {_LINKS} SELECT b.version_id AS by, t.version_id AS target, links.scope FROM links JOIN v b ON b.seq = by_seq JOIN v t ON t.seq = target_seq",
    "supersede_cases": f"{_INGEST.replace(_STORED, _GIVEN)}, {_LINKS} SELECT by_seq, target_seq, scope FROM links",
    "extractive_sentences": f"{_FOUND}, {_BEST} SELECT * FROM best",
    "retrieval_confidence": f"{_FOUND}, {_BEST} SELECT qid, round(confidence, 6) AS confidence FROM conf",
    "extractive_answers": f"{_FOUND}, {_BEST} SELECT qid, answer, refused FROM ans",
    "faithfulness_report": f"{_FOUND}, {_BEST}, {_CHECKED} SELECT * FROM report",
    "faithfulness_summary": f"""{_FOUND}, {_BEST}, {_CHECKED} SELECT round(avg(rate), 6) AS mean_rate, count(*) FILTER (rate >= 0.999) AS fully_faithful,
 CAST(sum(uncited) AS BIGINT) AS uncited, CAST(sum(invalid) AS BIGINT) AS invalid, count(*) AS answers FROM report""",
    "answer_remarks": f"""{_FOUND}, {_BEST}, {_CHECKED} SELECT qid, concat_ws(' ', CASE WHEN refused THEN 'The passages cover ' || CAST(round(confidence * 100) AS INT) || ' % of the question''s words.' END,
 CASE WHEN rate < 0.5 AND checked > 0 THEN 'Only ' || CAST(round(rate * 100) AS INT) || ' % of the claims are borne out; check the source.' END) AS remark FROM ans JOIN report USING (qid)""",
    "source_blocks": f"""{_FOUND}, blocks AS (SELECT qid, rank, '[' || rank || '] ' || concat_ws(', ', doc_number, title) || coalesce(' | section ' || section_ref, '') || coalesce(' | of ' || published_date::DATE::VARCHAR, '')
  || CASE WHEN lower(ch.status) <> 'active' THEN ' | superseded' ELSE '' END || chr(10) || trim(chunk_text) AS b
  FROM top JOIN chunks ch ON ch.id = chunk_id JOIN document_versions v ON v.id = document_version_id JOIN circulars c ON c.id = document_id)
 SELECT qid, md5(string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS sources_md5, len(string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS n_chars FROM blocks GROUP BY 1""",
    "lexical_support": f"""WITH p AS (SELECT id, chunk_text AS passage, lead(chunk_text) OVER (PARTITION BY document_version_id ORDER BY ordinal, id) AS claim FROM chunks),
 f AS (SELECT id, passage, {SQL_CLAIM('claim')} AS cw, {SQL_CLAIM('passage')} AS pw, {SQL_NUMBERS('claim')} AS cn, {SQL_NUMBERS('passage')} AS pn, {SQL_SALIENT('claim')} AS sal FROM p WHERE claim IS NOT NULL),
 o AS (SELECT *, CASE WHEN len(cw) = 0 THEN 1.0 ELSE len(list_intersect(cw, pw)) / len(cw) END AS ov, len(list_filter(sal, lambda t: NOT contains(lower(passage), t))) AS miss FROM f),
 b AS (SELECT *, CASE WHEN len(cn) > 0 THEN 0.6 * ov + 0.4 * len(list_intersect(cn, pn)) / len(cn) ELSE ov END AS base FROM o)
 SELECT id, {_SUPPORT} AS support FROM b""",
    "salient_missing": f"""SELECT v.id, array_to_string(list_sort(list_filter({SQL_SALIENT('title')}, lambda t: NOT contains(lower(raw_text), t))), ' ') AS missing FROM document_versions v JOIN circulars c ON v.document_id = c.id""",
    "notices": f"""{Q._CTES}, h AS (SELECT s.qid, v.published_date, c.doc_number, lower(ch.status) AS status FROM (SELECT qid, chunk_id FROM scored WHERE score > 0 QUALIFY {Q._RANK} <= 8) s
   JOIN chunks ch ON ch.id = s.chunk_id JOIN document_versions v ON ch.document_version_id = v.id JOIN circulars c ON v.document_id = c.id),
 g AS (SELECT qid, list_sort(list_distinct(list(doc_number) FILTER (status = 'deprecated'))) AS old, count(DISTINCT published_date) AS dates, min(published_date) AS lo, max(published_date) AS hi FROM h GROUP BY 1)
 SELECT qid, concat_ws(' ', CASE WHEN len(old) > 0 THEN 'Includes deprecated text of ' || array_to_string(old, ', ') || '.' END, CASE WHEN dates > 1 THEN 'Sources are dated from ' || lo::DATE::VARCHAR || ' to ' || hi::DATE::VARCHAR || '.' END) AS notice FROM g""",
    "stream_dedupe": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
    "stream_ingest_counts": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2",
}

"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import lookalike, mixture, neighbours, packing, pieces, quality, retyped, revisions, tokens
from quillspark.session import staged
from quillspark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of versions that are the same circular typed differently."""
    return retyped.retyped_pairs(table(spark, sf_dir, "document_versions").select("id", "raw_text"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct circular text with the number of its copies."""
    return retyped.collapse(table(spark, sf_dir, "document_versions").select("id", "raw_text"), "id", "raw_text")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.version_and_chunk_texts(
        table(spark, sf_dir, "document_versions").select("id", "raw_text"), table(spark, sf_dir, "chunks").select("id", "chunk_text")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of versions, and of chunks, that look the same but are other strings."""
    return lookalike.same_looking_pairs(_texts(spark, sf_dir))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every version and chunk, as its digest, and whether it differs from the text."""
    forms = lookalike.consistent_texts(_texts(spark, sf_dir))
    return forms.select("field", "id", F.md5(F.col("form").cast("binary")).alias("form_md5"), (F.col("form") != F.col("text")).alias("changed"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id, text, print) of all versions and chunks; only versions have a print of their retyped form."""
    printed = F.unhex(F.md5(retyped.canonical_text(F.col("text")).cast("binary")))
    return _texts(spark, sf_dir).withColumn("print", F.when(F.col("field") == "raw_text", printed))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of versions, and of chunks, that are lightly revised forms of each other."""
    return revisions.revised_pairs(_printed(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version and chunk with its class, the texts of the same words, and the number of classes similar to it.

    A null text is a class of its own; it and texts of fewer than three words have no links.
    """
    texts = _printed(spark, sf_dir)
    rows, classes = revisions.classes_of(texts)
    pairs = revisions.similar_classes(classes)
    ends = pairs.select(F.col("a").alias("d")).unionAll(pairs.select(F.col("b").alias("d")))
    links = ends.groupBy("d").agg(F.count(F.lit(1)).alias("links"))
    first = rows.groupBy("field", "digest").agg(F.min("id").alias("class_id"))
    known = rows.join(first, ["field", "digest"]).join(links, F.col("doc") == F.col("d"), "left")
    known = known.select("field", "id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return known.unionByName(texts.filter("text is null").select("field", "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def _neighbours(spark: SparkSession, sf_dir: str, plan: neighbours.Plan = neighbours.Plan()) -> DataFrame:  # noqa: B008
    return neighbours.nearest(table(spark, sf_dir, "chunks").select("id", "embedding"), plan=plan)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks, one among the 5 most similar of the other, with a cosine of at least 0.9."""
    return neighbours.close_pairs(_neighbours(spark, sf_dir, neighbours.Plan(least=0.9)), 0.9)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of every chunk with a usable embedding."""
    return _neighbours(spark, sf_dir).select("id", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the 5 nearest: 1000 vectors against brute force over all."""
    rows = table(spark, sf_dir, "chunks").select("id", "embedding")
    return neighbours.recall(rows, neighbours.nearest(rows))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be cut."""
    chunks = table(spark, sf_dir, "chunks").select("id", "chunk_text")
    cut = pieces.split_rows(chunks, ["id"], "chunk_text", whole=False)
    return cut.filter("piece = 1").select(F.col("id").alias("chunk_id")).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk, and of every oversized text of a version without chunks."""
    chunks = table(spark, sf_dir, "chunks")
    versions = table(spark, sf_dir, "document_versions").select("id", "raw_text")
    bare = versions.join(chunks.select(F.col("document_version_id").alias("id")), "id", "left_anti")
    rows = chunks.select(F.lit("chunk_text").alias("field"), "id", "section_ref", F.col("chunk_text").alias("body")).unionByName(
        bare.select(F.lit("raw_text").alias("field"), "id", F.lit(None).cast("string").alias("section_ref"), F.col("raw_text").alias("body"))
    )
    return pieces.split_rows(rows, ["field", "id", "section_ref"], "body", whole=False)


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every cut text, counted over its pieces without their overlaps, and whether all pieces keep the limit."""
    fresh = F.col("token_count") - F.when(F.col("piece") > 0, pieces.OVERLAP).otherwise(0)
    return p5_pieces(spark, sf_dir).groupBy("field", "id").agg(F.sum(fresh).alias("tokens"), (F.max("token_count") <= pieces.LIMIT).alias("within"))


def p5_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts by where they fall: 3 before a section, 2 a paragraph, 1 a sentence or line, 0 none of these within reach."""
    cuts = p5_pieces(spark, sf_dir).filter("piece > 0")
    return cuts.groupBy("boundary").agg(F.count(F.lit(1)).alias("cuts"), F.round(F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(0))), 4).alias("share"))


def _sizes(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return tokens.token_sizes(table(spark, sf_dir, "documents").select(*keys, "text"), list(keys))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2048 tokens of every document, and of every piece of a larger one."""
    return packing.pack(_sizes(spark, sf_dir, "doc_id"), ["doc_id"])


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p7_containers(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with the copy and the virtual finish time."""
    return mixture.mix(_sizes(spark, sf_dir, "doc_id", "source"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    mixed = staged(p8_mixture(spark, sf_dir), "mixed")
    return mixture.shares(mixed, table(spark, sf_dir, "mix_targets"))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and the decision on natural prose of every document."""
    return quality.text_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "common_words"), lang="lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are not natural prose."""
    found = quality.text_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "common_words"))  # language has no part in it
    return found.filter(~F.col("is_prose")).select("doc_id")


_CANON = r"""
WITH prepared AS (
  SELECT id, string_split(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), chr(10)) AS lines
  FROM document_versions WHERE raw_text IS NOT NULL),
cut AS (
  SELECT id, lines, list_position(list_transform(lines, lambda x: regexp_full_match(x, '[\s\p{Z}\x{85}\x0b\x1c-\x1f]*')), true) AS k
  FROM prepared),
parts AS (
  SELECT id, CASE WHEN k IS NULL OR k = 0 THEN lines ELSE lines[1:k-1] END AS header,
         CASE WHEN k IS NULL OR k = 0 THEN '' ELSE array_to_string(lines[k+1:], chr(10)) END AS body FROM cut),
canon AS (
  SELECT id, array_to_string(list_sort(list_filter(list_transform(header, lambda x:
           trim(regexp_replace(replace(lower(replace(x, 'ß', 'ss')), 'ς', 'σ'), '[\p{P}\s\p{Z}$+<=>^`|~\x{85}\x0b\x1c-\x1f]+', ' ', 'g'))), lambda x: x <> '')), chr(10))
         || chr(10) || chr(10) ||
         trim(regexp_replace(replace(lower(replace(body, 'ß', 'ss')), 'ς', 'σ'), '[\p{P}\s\p{Z}$+<=>^`|~\x{85}\x0b\x1c-\x1f]+', ' ', 'g')) AS c
  FROM parts)
"""

def _sql_forms() -> str:
    """Forms by the mapping as a table: letters that only the confusables data know stay themselves; the given tables have none."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ",".join(f"({quoted(chr(c))},{quoted(''.join(map(chr, new)))})" for c, new in lookalike.mapping_rows())
    return f"""WITH m(c, t) AS (VALUES {rows}),
texts AS (SELECT 'raw_text' AS field, id, raw_text AS text FROM document_versions UNION ALL SELECT 'chunk_text', id, chunk_text FROM chunks),
rich AS (SELECT * FROM texts WHERE regexp_matches(text, '[^\\x00-\\x7f]')),
ch AS (SELECT field, id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM rich),
made AS (SELECT field, id, nfc_normalize(string_agg(coalesce(t, c), '' ORDER BY i)) AS form FROM ch LEFT JOIN m USING (c) GROUP BY 1, 2),
forms AS (SELECT field, id, text, coalesce(form, text) AS form FROM texts LEFT JOIN made USING (field, id))"""


QUERIES = {f.__name__: f for f in (
    p1_found, p1_records, p2_found, p2_forms, p3_found, p3_classes, p4_found, p4_neighbours, p4_recall, p5_found, p5_pieces, p5_totals, p5_boundaries,
    p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_quality,
)}
_FORMS = _sql_forms()
ORACLES = {
    "p2_forms": f"{_FORMS} SELECT field, id, md5(form) AS form_md5, form <> text AS changed FROM forms",
    # every pair that shares a run of three words, counted; rows of copies come back at the end
    "p3_found": _FORMS + ", " + _CANON.strip().removeprefix("WITH ") + r""",
w AS (SELECT field, form, regexp_extract_all(lower(form), '[\p{L}\p{N}]+') AS ws FROM (SELECT DISTINCT field, form FROM forms WHERE form IS NOT NULL)),
s AS (SELECT field, row_number() OVER () AS k, form, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS sh FROM w WHERE len(ws) > 2),
e AS (SELECT field, k, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.k AS ka, b.k AS kb, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.field = b.field AND a.g = b.g AND a.k < b.k GROUP BY 1, 2 HAVING j >= 0.6),
f AS (SELECT k, s.field, id, CASE WHEN s.field = 'raw_text' THEN canon.c END AS print FROM s JOIN forms USING (field, form) LEFT JOIN canon USING (id))
SELECT a.field, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM c JOIN f a ON a.k = ka JOIN f b ON b.k = kb WHERE a.print IS DISTINCT FROM b.print OR a.print IS NULL""",
    "p2_found": f"{_FORMS} SELECT a.field, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.field = b.field AND a.form = b.form AND a.text <> b.text AND a.id < b.id",
    # brute force; p4_found needs no more of the 5 nearest than those with a cosine of 0.9
    "p4_found": """WITH u AS (SELECT id, embedding AS v FROM chunks WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
near AS (SELECT a.id AS q, b.id AS n, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY c DESC) <= 5)
SELECT DISTINCT least(q, n) AS id_a, greatest(q, n) AS id_b FROM near WHERE c >= 0.9""",
    "p1_found": _CANON + "SELECT a.id AS id_a, b.id AS id_b FROM canon a JOIN canon b ON a.c = b.c AND a.id < b.id",
    "p1_records": _CANON + "SELECT min(id) AS keep, count(*) AS copies, false AS collision FROM canon GROUP BY c",
    "p5_totals": r"""
WITH t AS (SELECT 'chunk_text' AS field, id, chunk_text AS body FROM chunks UNION ALL SELECT 'raw_text', id, raw_text FROM document_versions WHERE id NOT IN (SELECT document_version_id FROM chunks WHERE document_version_id IS NOT NULL))
SELECT field, id, len(regexp_extract_all(body, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x0b\x1c-\x1f]')) AS tokens, true AS within FROM t WHERE tokens > 350""",
    # a run of letters, digits and underscores, or another single character that isn't white space
    "p5_found": r"""
SELECT id AS chunk_id FROM chunks
WHERE len(regexp_extract_all(chunk_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x0b\x1c-\x1f]')) > 350""",
}

"""Cited extractive answers and their faithfulness, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X

SENTENCES, GATE_PASSAGES, MIN_CONFIDENCE, SUPPORT, LOW = 5, 3, 0.4, 0.35, 0.5


def best_sentences(queries: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, place, n, sentence, score): up to SENTENCES sentences of each query's hits(qid, chunk_id, rank); n is the hit cited.

    Sentences of 40 to 600 characters that share a keyword with the query, by the number shared, less for
    sentences of many distinct words, a little more for better hits; of sentences with the same first 80
    characters the best stays.
    """
    q = queries.select("qid", X.answer_keywords(F.col("text")).alias("kw"))
    h = hits.join(docs.select("chunk_id", "text"), "chunk_id").join(q, "qid")
    many = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("many"))
    s = h.join(many, "qid").select("qid", "rank", "kw", "many", F.posexplode(X.answer_sentences(F.col("text"))).alias("at", "sentence")).filter(F.length("sentence").between(40, 600))
    words = X.answer_words(F.col("sentence"))
    s = s.withColumn("shared", F.size(F.array_intersect("kw", words))).filter("shared > 0")
    s = s.withColumn("score", F.col("shared") / (1 + F.size(words) / 60) + (F.col("many") - F.col("rank")) * 0.01)
    order = [F.desc(F.round("score", 9)), "rank", "at"]
    first = Window.partitionBy("qid", F.lower(F.left("sentence", F.lit(80)))).orderBy(*order)
    s = s.withColumn("dup", F.row_number().over(first)).filter("dup = 1")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("place") <= SENTENCES).select("qid", "place", F.col("rank").alias("n"), "sentence", "score")


def confidence(queries: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, confidence): share of the query's keywords in its first GATE_PASSAGES hits; 1 without keywords, 0 without hits."""
    q = queries.select("qid", X.answer_keywords(F.col("text")).alias("kw"))
    top = hits.filter(F.col("rank") <= GATE_PASSAGES).join(docs.select("chunk_id", "text"), "chunk_id").join(q, "qid")
    got = top.select("qid", F.explode(F.array_intersect("kw", X.answer_words(F.col("text")))).alias("w")).groupBy("qid").agg(F.countDistinct("w").alias("n"))
    share = F.when(F.size("kw") == 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.size("kw"))
    return q.join(got, "qid", "left").select("qid", share.alias("confidence"))


def answers(queries: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, answer, refused, confidence): bullets of the best sentences with their citation below a line that names and cites
    the first hit, by docs(chunk_id, text, doc_number, title), or the refusal where confidence is below MIN_CONFIDENCE or
    nothing fits; the disclaimer ends both."""
    best = best_sentences(queries, hits, docs)
    bullets = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "n", "sentence"))).alias("b"))
    lines = F.array_join(F.transform("b", lambda x: F.format_string("- %s. [%d]", F.regexp_replace(x["sentence"], r"\.+$", ""), x["n"])), "\n")
    named = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("doc_number", "title")]
    head = hits.filter("rank = 1").join(docs.select("chunk_id", F.concat_ws(", ", named[0], F.regexp_replace(named[1], r"\.+$", "")).alias("source")), "chunk_id").select("qid", "source")
    rows = confidence(queries, hits, docs).join(bullets, "qid", "left").join(head, "qid", "left")
    refused = (F.col("confidence") < MIN_CONFIDENCE) | F.col("b").isNull()
    full = F.concat(F.lit("According to "), F.col("source"), F.lit(": [1]\n\n"), lines, F.lit("\n\n" + X.DISCLAIMER))
    return rows.select("qid", F.when(refused, F.lit(f"{X.REFUSAL}\n\n{X.DISCLAIMER}")).otherwise(full).alias("answer"), refused.alias("refused"), "confidence")


def lexical_support(claim: Column, passage: Column) -> Column:
    """Share of a claim's words and numbers in a passage, lowered where salient tokens are missing."""
    cw, pw = X.claim_words(claim), X.claim_words(passage)
    overlap = F.when(F.size(cw) == 0, 1.0).otherwise(F.size(F.array_intersect(cw, pw)) / F.size(cw))
    cn, pn = X.number_tokens(claim), X.number_tokens(passage)
    base = F.when(F.size(cn) > 0, 0.6 * overlap + 0.4 * F.size(F.array_intersect(cn, pn)) / F.size(cn)).otherwise(overlap)
    salient, low = X.salient_tokens(claim), F.lower(passage)
    missing = F.size(F.filter(salient, lambda t: ~F.contains(low, t)))
    return F.when(missing > 0, base * F.greatest(F.lit(0.15), 1 - 0.6 * missing / F.size(salient))).otherwise(base)


def check_answers(answered: DataFrame, hits: DataFrame, docs: DataFrame, judge: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, report) of answered(qid, answer).

    A claim is a sentence with at least 3 content words; it is supported if a passage it cites reaches
    SUPPORT. A claim without a citation counts as unsupported, unless it is the refusal or the disclaimer or ends
    in a colon (marks of bold type are gone by then). Citations beyond the hits are invalid, each number once an answer. judge(claim,
    passage) may give a boolean instead of the score; where it gives null, the score decides. report has a row for
    every answer; its rate is 1 where nothing was claimed.
    """
    s = answered.select("qid", F.posexplode(X.claim_sentences(F.col("answer"))).alias("at", "sentence"))
    s = s.withColumn("claim", F.trim(F.regexp_replace("sentence", X.CITATION, ""))).filter(F.size(X.claim_words(F.col("claim"))) >= 3)
    s = s.withColumn("cites", F.transform(X.found_all(F.col("sentence"), X.CITATION, 1), lambda x: x.cast("int")))
    fixed = F.lower("claim").startswith(X.REFUSAL.lower().rstrip(".")) | F.lower("claim").startswith(X.DISCLAIMER.lower().rstrip("."))
    s = s.filter((F.size("cites") > 0) | ~(fixed | F.col("claim").endswith(":")))
    cited = s.select("qid", "at", "claim", F.explode_outer("cites").alias("n"))
    passages = hits.join(docs.select("chunk_id", "text"), "chunk_id").select("qid", F.col("rank").alias("n"), F.col("text").alias("passage"))
    scored = cited.join(passages, ["qid", "n"], "left")
    score = lexical_support(F.col("claim"), F.col("passage"))
    if judge is not None:
        verdict = judge(F.col("claim"), F.col("passage"))
        score = F.when(verdict.isNull(), score).otherwise(verdict.cast("double"))
    scored = scored.withColumn("score", F.when(F.col("passage").isNotNull(), score))
    claims = scored.groupBy("qid", "at", "claim").agg(
        F.round(F.coalesce(F.max("score"), F.lit(0.0)), 3).alias("score"),
        F.coalesce(F.max("score"), F.lit(0.0)).__ge__(SUPPORT).alias("supported"),
        (F.count("n") == 0).alias("uncited"),
        F.sort_array(F.collect_set(F.when(F.col("passage").isNull(), F.col("n")))).alias("invalid"),
    )
    summed = claims.groupBy("qid").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("supported").alias("supported"), F.count_if("uncited").alias("uncited"),
        F.size(F.array_distinct(F.flatten(F.collect_list("invalid")))).cast("long").alias("invalid"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rate = F.round(F.coalesce(F.try_divide("supported", "checked"), F.lit(1.0)), 3)
    report = answered.select("qid").join(summed, "qid", "left").select("qid", rate.alias("rate"), zero("checked"), zero("supported"), zero("uncited"), zero("invalid"))
    return claims, report


def remarks(answered: DataFrame, report: DataFrame) -> DataFrame:
    """(qid, remark): why an answer was refused, or that few of its claims are supported."""
    percent = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit(" %"))
    refused = F.when(F.col("refused"), F.concat(F.lit("The passages cover "), percent("confidence"), F.lit(" of the question's words.")))
    low = F.when((F.col("rate") < LOW) & (F.col("checked") > 0), F.concat(F.lit("Only "), percent("rate"), F.lit(" of the claims are borne out; check the source.")))
    return answered.join(report, "qid").select("qid", F.concat_ws(" ", refused, low).alias("remark"))


def source_blocks(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, sources): the passages of each query in order, each under a line with number, document, section, date and state.

    docs(chunk_id, text, doc_number, title, section_ref, published_date, status).
    """
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" | {label} "), F.col(c).cast("string")))
    line = F.concat_ws("", F.format_string("[%d] ", "rank"), F.concat_ws(", ", "doc_number", "title"), part("section", "section_ref"), part("of", "published_date"), F.when(F.lower("status") != "active", " | superseded"))
    rows = hits.select("qid", "chunk_id", "rank").join(docs, "chunk_id").withColumn("block", F.concat(line, F.lit("\n"), F.trim("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return rows.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("sources"))


def faithfulness_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.round(F.coalesce(F.avg("rate"), F.lit(0.0)), 6).alias("mean_rate"), F.count_if(F.col("rate") >= 0.999).alias("fully_faithful"),
        F.coalesce(F.sum("uncited"), F.lit(0)).alias("uncited"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid"), F.count(F.lit(1)).alias("answers"),
    )


def notices(hits: DataFrame) -> DataFrame:
    """(qid, notice) from hits(qid, status, doc_number, published_date): deprecated sources, and sources of several dates."""
    g = hits.groupBy("qid").agg(
        F.sort_array(F.collect_set(F.when(F.lower("status") == "deprecated", F.col("doc_number")))).alias("old"),
        F.countDistinct("published_date").alias("dates"), F.min("published_date").alias("lo"), F.max("published_date").alias("hi"),
    )
    audit = F.when(F.size("old") > 0, F.concat(F.lit("Includes deprecated text of "), F.array_join("old", ", "), F.lit(".")))
    spread = F.when(F.col("dates") > 1, F.concat(F.lit("Sources are dated from "), F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string"), F.lit(".")))
    return g.select("qid", F.concat_ws(" ", audit, spread).alias("notice"))

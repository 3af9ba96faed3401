"""Versions and supersession: batch ingest over ordered documents, scoped deprecation, splitting of chunks.

Tables are immutable; every operation returns new rows. Ids are hashes of what they name. What is stored already
takes part by its numbers, hashes and references; only versions that a new one supersedes are touched again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.chunking import chunk, count_tokens
from quillspark.operators.prefix import running_total
from quillspark.session import staged

_TOP = re.compile(r"^(\d{1,2})[.)]\s+\S")
LEAST_SURVIVOR, HEADER = 80, 3000
_ANY_CASE_NUMBER = r"(?i)RBI/(?:[A-Z]{2,8}/)?\d{4}-\d{2,4}/\d+"
_ANY_CASE_REFERENCE = r"(?i)[A-Z]{2,6}(?:[\.\(][A-Z0-9]{1,12}\)?){1,6}/\d{2}\.\d{2}\.\d{3}/\d{4}-\d{2,4}"


def borne(text: Column) -> Column:
    """All references, in lower case, that lie anywhere in the header, also within longer ones: what a search for a substring finds.

    A reference within a longer one starts later or ends earlier; those forms are spelt out, so looking one up is an equi-join.
    """
    head = F.left(text, F.lit(HEADER))

    def within(match: Column, pattern: str) -> Column:
        low = F.lower(match)
        ends = F.transform(F.sequence(F.lit(0), F.length(F.regexp_extract(low, r"\d+$", 0)) - 1), lambda k: F.left(low, F.length(low) - k))
        starts = F.flatten(F.transform(ends, lambda x: F.transform(F.sequence(F.lit(1), F.instr(x, "/")), lambda i: F.substr(x, i))))
        return F.filter(starts, lambda x: x.rlike(f"^(?:{pattern})$"))

    def spelt(pattern: str) -> Column:
        return F.flatten(F.transform(X.found_all(head, pattern), lambda m: within(m, pattern)))

    return F.coalesce(F.array_distinct(F.concat(spelt(_ANY_CASE_NUMBER), spelt(_ANY_CASE_REFERENCE))), F.array().cast("array<string>"))


def parse(docs: DataFrame, key: str = "seq", text: str = "raw") -> DataFrame:
    """docs with text normalised and number, date, title, hint, scope and borne references extracted; unnumbered ones get a LOCAL number.

    Columns title and target of docs, if there, take precedence over what the text says (null: the text decides). A null text counts as an empty one.
    """
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    t = docs.select(key, X.normalise_text(F.coalesce(F.col(text), F.lit(""))).alias("text"), given("title").alias("named"), given("target").alias("target"))
    title = F.coalesce("named", X.extract_title(F.col("text")), F.lit("Untitled document"))
    return t.select(
        key, "text", title.alias("title"),
        F.coalesce(X.extract_doc_number(F.col("text")), F.concat(F.lit("LOCAL/"), X.slug(title))).alias("doc_number"),
        X.extract_date(F.col("text")).alias("published_date"), F.coalesce("target", X.supersedes_hint(F.col("text"))).alias("hint"),
        X.supersession_scope(F.col("text")).alias("scope"), X.content_hash(F.col("text")).alias("sha256"), borne(F.col("text")).alias("refs"),
    )


def dedupe(parsed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """parsed with reason: null for the first text of a hash that isn't in stored(sha256), else the skip reason."""
    first = parsed.groupBy("sha256").agg(F.min("seq").alias("first"))
    rows = parsed.join(first, "sha256")
    if stored is not None:
        known = stored.select("sha256").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "sha256", "left")
    else:
        rows = rows.withColumn("known", F.lit(False))
    repeated = (F.col("seq") != F.col("first")) | F.coalesce("known", F.lit(False))
    return rows.withColumn("reason", F.when(repeated, X.DUPLICATE_REASON)).drop("first", "known")


def number_versions(fresh: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """fresh with version_id and version_number: after the largest number stored(doc_number, version_number) has, in order of seq.

    Only small columns are ordered, over all tasks, however many versions one document has.
    """
    keys = fresh.select("seq", "doc_number", F.lit(1).cast("long").alias("one"))
    ranked = running_total(keys, ["doc_number"], ["seq"], "one", "n").select("seq", "n")
    rows = fresh.join(ranked, "seq")
    if stored is not None:
        top = stored.groupBy("doc_number").agg(F.max("version_number").alias("top"))
        rows = rows.join(top, "doc_number", "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0))).drop("top")
    rows = rows.withColumn("version_number", F.col("n").cast("int")).drop("n")
    return rows.withColumn("version_id", F.sha2(F.concat_ws("|", "doc_number", F.col("version_number").cast("string"), "sha256"), 256))


def supersessions(versions: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """(by, target, scope): which version supersedes which, with the paragraphs concerned (empty: all of it).

    versions(version_id, doc_number, version_number, seq, refs, hint, scope) are all there are, asking those whose links
    are wanted (all of them by default). A version supersedes the one before it of its document. A hint resolves to
    the document of that number, else to that of the earliest version whose header bears it, among versions with a
    smaller seq; its latest earlier version is the target. A hint that resolves to the version's own document does nothing.
    """
    asking = versions if asking is None else asking
    none = F.array().cast("array<string>")
    numbered = versions.select("doc_number", F.col("version_number").alias("number"), F.col("version_id").alias("target"))
    own = asking.select(F.col("version_id").alias("by"), "doc_number", (F.col("version_number") - 1).alias("number")).join(numbered, ["doc_number", "number"]).select("by", "target", none.alias("scope"))
    # one row a reference: the first version of the document so numbered, and the first version that bears it
    exact = versions.groupBy(F.lower("doc_number").alias("ref")).agg(F.min(F.struct("seq", F.col("doc_number").alias("of"))).alias("exact"))
    bearing = versions.select(F.explode("refs").alias("ref"), F.struct("seq", F.col("doc_number").alias("of")).alias("b")).groupBy("ref").agg(F.min("b").alias("bearing"))
    asks = asking.filter("hint is not null").select(F.col("version_id").alias("by"), F.col("seq").alias("at"), F.col("doc_number").alias("mine"), F.lower(F.trim("hint")).alias("ref"), "scope")
    found = asks.join(exact, "ref", "left").join(bearing, "ref", "left")
    of = F.when(F.col("exact.seq") < F.col("at"), F.col("exact.of")).when(F.col("bearing.seq") < F.col("at"), F.col("bearing.of"))
    resolved = found.select("by", "at", "mine", "scope", of.alias("doc_number")).filter("doc_number is not null and doc_number <> mine")
    # the number of the latest version before each ask: versions and asks of a document in one order
    events = versions.select("doc_number", "seq", F.lit("").alias("by"), F.lit(1).cast("long").alias("one"))
    events = events.unionByName(resolved.select("doc_number", F.col("at").alias("seq"), "by", F.lit(0).cast("long").alias("one")))
    counted = running_total(events, ["doc_number"], ["seq", "by"], "one", "number").filter("by <> ''").select("by", "doc_number", F.col("number").cast("int").alias("number"))
    latest = resolved.select("by", "doc_number", "scope").join(counted, ["by", "doc_number"]).join(numbered, ["doc_number", "number"])
    return own.unionByName(latest.select("by", "target", "scope"))


def split_by_scope(text: str, scope: list[str]) -> tuple[str, str] | None:
    """(text in scope, text out of it) by top-level paragraphs; None if either is empty or too little survives."""
    inside, outside, current, any_heading = [], [], None, False
    for line in text.split("\n"):
        if m := _TOP.match(line):
            current, any_heading = m[1], True
        (inside if current in scope else outside).append(line)
    a, b = "\n".join(inside).strip(), "\n".join(outside).strip()
    return (a, b) if any_heading and a and b and len(b) >= LEAST_SURVIVOR else None


_CHUNK = "chunk_id string, version_id string, ordinal int, chunk_text string, chunk_type string, section_ref string, token_count int, status string"


def deprecate(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """chunks(chunk_id, version_id, ..., status) after links(target, scope): chunks in scope become deprecated.

    A chunk that also holds paragraphs out of scope is split: its part in scope is deprecated, the rest comes back as
    a new active chunk under its own first heading. Several links to one version act together; an empty scope is all of it.
    """
    whole = F.max(F.size("scope") == 0)
    wanted = links.groupBy("target").agg(F.when(whole, F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.collect_list("scope")))).alias("scope"))
    rows = chunks.join(wanted, F.col("version_id") == F.col("target"), "left")
    hit = F.col("target").isNotNull() & (F.col("status") == "active") & X.in_scope(F.col("section_ref"), F.col("chunk_text"), F.col("scope"))
    marked = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    names = [f.split()[0] for f in _CHUNK.split(", ")]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            halves = [split_by_scope(t, list(s)) if len(s) else None for t, s in zip(part["chunk_text"], part["scope"], strict=True)]
            old = part[names].assign(status="deprecated")
            old["chunk_text"] = [h[0] if h else t for h, t in zip(halves, old["chunk_text"], strict=True)]
            at = [i for i, h in enumerate(halves) if h]
            rest = part[names].iloc[at].copy()
            rest["chunk_text"] = [halves[i][1] for i in at]
            rest["chunk_id"] += "-rest"
            rest["section_ref"] = [next((line.strip() for line in t.split("\n") if _TOP.match(line)), ref) for t, ref in zip(rest["chunk_text"], rest["section_ref"], strict=True)]
            both = pd.concat([old, rest])
            both["token_count"] = both["chunk_text"].map(count_tokens)
            yield both

    flipped = marked.filter("hit").select(*names, "scope").mapInPandas(cut, _CHUNK)
    return marked.filter(~F.col("hit")).select(*names).unionByName(flipped)


def version_status(versions: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """versions with status (deprecated once no chunk is active), supersedes and superseded_by, after what they have of these."""
    active = chunks.groupBy("version_id").agg(F.count_if(F.col("status") == "active").alias("live"))
    by = links.groupBy(F.col("target").alias("version_id")).agg(F.max("by").alias("new_by"))
    old = links.groupBy(F.col("by").alias("version_id")).agg(F.min("target").alias("new_old"))
    rows = versions.join(active, "version_id", "left").join(by, "version_id", "left").join(old, "version_id", "left")
    gone = (F.col("live") == 0) | (F.col("live").isNull() & F.col("new_by").isNotNull())
    kept = lambda c: F.col(c) if c in versions.columns else F.lit(None).cast("string")
    return (
        rows.withColumn("status", F.when(gone, "deprecated").otherwise("active"))
        .withColumn("superseded_by", F.coalesce("new_by", kept("superseded_by"))).withColumn("supersedes", F.coalesce(kept("supersedes"), "new_old"))
        .drop("live", "new_by", "new_old")
    )


@dataclass(frozen=True)
class Ingested:
    """results of the new texts, versions and chunks that are new or changed, links(by, target, scope)."""

    results: DataFrame
    versions: DataFrame
    chunks: DataFrame
    links: DataFrame


def ingest(docs: DataFrame, chunker: str = "structure_aware", versions: DataFrame | None = None, chunks: DataFrame | None = None, allow_duplicate: bool = False) -> Ingested:
    """docs(seq, raw[, title, target]) ingested in the order of seq after the stored versions and chunks, if any.

    A text is skipped if an earlier one has its hash, unless allow_duplicate. Later versions supersede earlier ones of
    their document in full; references to other documents act on paragraphs, and never on later documents. seq must
    be above that of everything stored. Parsing and chunking run once; stored texts aren't read again, and chunks
    only of versions that a new one supersedes.
    """
    parsed = parse(docs)
    rows = staged(parsed.withColumn("reason", F.lit(None).cast("string")) if allow_duplicate else dedupe(parsed, versions), "parsed")
    fresh = staged(number_versions(rows.filter("reason is null"), versions), "fresh")
    made = chunk(fresh.select("version_id", "text"), "version_id", "text", chunker)
    new = staged(made.select(F.sha2(F.concat_ws("|", "version_id", F.col("ordinal").cast("string")), 256).alias("chunk_id"), "version_id", "ordinal", "chunk_text", "chunk_type", "section_ref", "token_count", F.lit("active").alias("status")), "made")
    small = ["version_id", "doc_number", "version_number", "seq", "refs", "hint", "scope"]
    known = fresh.select(*small)
    links = staged(supersessions(known if versions is None else known.unionByName(versions.select(*small)), known), "links")
    kept = [f.name for f in fresh.schema if f.name not in ("reason", "text")]
    all_versions, all_chunks = fresh.select(*kept, *[F.lit(None).cast("string").alias(c) for c in ("supersedes", "superseded_by")]), new
    if versions is not None:
        touched = links.select(F.col("target").alias("version_id")).distinct()
        all_versions = all_versions.unionByName(versions.join(touched, "version_id", "left_semi").select(*all_versions.columns))
        all_chunks = all_chunks.unionByName(chunks.join(touched, "version_id", "left_semi").select(*new.columns))
    after = staged(deprecate(all_chunks, links), "after")
    counts = new.groupBy("version_id").agg(F.count(F.lit(1)).alias("chunks_created"))
    old = links.join(after.filter("status = 'deprecated'").groupBy(F.col("version_id").alias("target")).agg(F.count(F.lit(1)).alias("gone")), "target", "left")
    gone = old.groupBy(F.col("by").alias("version_id")).agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("chunks_deprecated"), F.min("target").alias("superseded_version_id"))
    results = rows.select("seq", "doc_number", "title", "reason").join(fresh.select("seq", "version_id", "version_number"), "seq", "left").join(counts, "version_id", "left").join(gone, "version_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    results = results.select("seq", "doc_number", "title", "version_id", "version_number", zero("chunks_created"), zero("chunks_deprecated"), "superseded_version_id", F.col("reason").isNotNull().alias("skipped"), F.coalesce("reason", F.lit("")).alias("reason"))
    return Ingested(results, version_status(all_versions, after, links), after, links)


def rechunk_all(versions: DataFrame, chunker: str) -> DataFrame:
    """Fresh chunks of all versions(id, raw_text, status), with their version's status."""
    made = chunk(versions.select("id", "raw_text"), "id", "raw_text", chunker)
    return made.join(versions.select("id", F.lower("status").alias("status")), "id")

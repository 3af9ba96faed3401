"""Text functions over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.sources.files import html_text
from quillspark.sources.tables import table


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_versions").select("id", "raw_text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "chunk_text")


def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    t = X.normalise_text(F.col("raw_text"))
    return _versions(spark, d).select("id", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Whether the stored hash is that of the text."""
    v = table(spark, d, "document_versions").select("id", "raw_text", "content_sha256")
    h = X.content_hash(F.col("raw_text"))
    return v.select("id", h.alias("sha256"), F.coalesce(F.lower("content_sha256") == h, F.lit(False)).alias("stored_is_right"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "circulars").select("id", "title")
    return c.select("id", X.slug(F.col("title")).alias("doc_slug"), X.file_slug(F.col("title")).alias("file_slug"), X.session_title(F.col("title")).alias("session_title"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", X.one_line(F.col("chunk_text"), 400).alias("snippet"))


def build_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Normalised text with all extracted metadata, in one pass."""
    t = _versions(spark, d).select("id", X.normalise_text(F.col("raw_text")).alias("t"))
    return t.select(
        "id",
        X.extract_doc_number(F.col("t")).alias("doc_number"),
        X.extract_date(F.col("t")).cast("string").alias("published_date"),
        X.extract_title(F.col("t")).alias("title"),
        X.supersedes_hint(F.col("t")).alias("supersedes_hint"),
        F.array_join(X.supersession_scope(F.col("t")), ",").alias("supersedes_scope"),
    )


#: Parser cases that the tables lack: rows of (case, text).
CASES = (
    ("rbi", "RBI/2031-32/7\nRef\nRecords of Harbour Fees Amendment Directions\n18 September 2031\nIn supersession of paragraph 6 of XYZ.ABC.DE.No.12/34.56.789/2029-30, banks shall act."),
    ("dept", "XYZ.FEE.REC.5/11.22.333/2031-32\nSeptember 2, 2022\nAmends the provisions of paragraphs 3, 4.2 and 7 and RBI/2020-21/12"),
    ("iso", "no number here\n2024-02-30 then 2024-02-28\nsupersedes the earlier instructions"),
    ("bad", "31 February 2020 but April 3 2021\nReplaces RBI/QQQ/2030-31/5 and more"),
    ("range", "This supersedes clauses 3 to 5 of the Annex.\nsupersedes para 3"),
    ("none", ""),
)


def parser_cases(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(CASES, "case string, t string")
    return t.select(
        "case", X.extract_doc_number(F.col("t")).alias("doc_number"), X.extract_date(F.col("t")).cast("string").alias("published_date"),
        X.extract_title(F.col("t")).alias("title"), X.supersedes_hint(F.col("t")).alias("supersedes_hint"),
        F.array_join(X.supersession_scope(F.col("t")), ",").alias("supersedes_scope"),
    )


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each chunk next to the stored count."""
    c = table(spark, d, "chunks").select("id", "chunk_text", "token_count")
    n = X.budget_tokens(F.col("chunk_text"))
    return c.select("id", n.cast("long").alias("n_tokens"), F.coalesce(F.col("token_count") == n, F.lit(False)).alias("stored_is_right"))


#: Pages and the text they read as: rows of (case, html, text).
PAGES = (
    ("table", "<h1>Fees</h1><table><tr><th>A</th><th> B\n b</th></tr><tr><td>1</td><td>2</td></tr></table><p>end</p>", "Fees\n\n[TABLE]\nA | B b\n1 | 2\n[/TABLE]\n\nend"),
    ("dropped", "<head><style>p{}</style></head><nav>menu</nav><p>kept &amp; read</p><script>x()</script><footer>f</footer>", "kept & read"),
    ("plain", "no tags at all", "no tags at all"),
    ("empty", "", ""),
)


def html_cases(spark: SparkSession, d: str) -> DataFrame:
    """What pages read as: tables as marked rows, scripts and navigation left out."""
    return spark.createDataFrame([p[:2] for p in PAGES], "case string, html string").select("case", html_text(F.col("html")).alias("text"))


def _token_query(tokens):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _chunks(spark, d).select("id", F.array_join(F.array_sort(tokens(F.col("chunk_text"))), " ").alias("tokens"))

    return run


def space_words(spark: SparkSession, d: str) -> DataFrame:
    w = X.space_words(F.col("chunk_text"))
    return _chunks(spark, d).select("id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ").cast("binary")).alias("words_md5"))


def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", F.array_join(F.slice(X.space_words(F.col("chunk_text")), 1, 40), " ").alias("head"))


def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _chunks(spark, d).select("id", F.posexplode(X.answer_sentences(F.col("chunk_text"))).alias("n", "sentence"))
    return s.filter(F.length("sentence").between(40, 600)).select("id", F.col("n").cast("long").alias("n"), "sentence")


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    lines = _versions(spark, d).select("id", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
    return lines.select("id", F.col("line_no").cast("long").alias("line_no"), X.heading_level(F.col("line")).cast("long").alias("level")).filter("level is not null")


def pipe_table_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines with two pipes or more; blank lines between them don't end a run."""
    lines = F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x) != "")
    piped = F.array_join(F.transform(lines, lambda x: F.when(F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2, "t").otherwise("p")), "")
    runs = _versions(spark, d).select("id", F.posexplode(X.found_all(piped, "t+")).alias("run", "rows"))
    return runs.select("id", F.col("run").cast("long").alias("run"), F.length("rows").cast("long").alias("n_rows"))


bm25_tokens = _token_query(X.bm25_tokens)
rerank_tokens = _token_query(X.rerank_tokens)
answer_keywords = _token_query(X.answer_keywords)
claim_words = _token_query(X.claim_words)
number_tokens = _token_query(X.number_tokens)
salient_tokens = _token_query(X.salient_tokens)

QUERIES = {
    k: f
    for k, f in globals().items()
    if k in {
        "normalise_text", "content_hash", "slugs", "snippets", "build_parsed", "parser_cases", "html_cases", "token_budget", "space_words", "truncate_words",
        "answer_sentences", "heading_levels", "pipe_table_runs", "bm25_tokens", "rerank_tokens", "answer_keywords", "claim_words", "number_tokens", "salient_tokens",
    }
}


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalise(t: str) -> str:
    t = f"translate(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), ' –—‘’“”', ' --''''\"\"')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10)||chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, ' +\\n', chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')"


def sql_tokens(t: str, pattern: str, stop: tuple[str, ...] = (), distinct: bool = False, longer: int = 0) -> str:
    x = f"list_filter(regexp_extract_all({t}, {q(pattern)}), lambda x: NOT list_contains({sql_list(stop)}, x) AND len(x) > {longer})" if stop or longer else f"regexp_extract_all({t}, {q(pattern)})"
    return f"list_distinct({x})" if distinct else x


SQL_BM25 = lambda t: sql_tokens(f"lower({t})", r"[a-z0-9]+(?:\.[a-z0-9]+)*", X.BM25_STOP)
SQL_RERANK = lambda t: sql_tokens(f"lower({t})", "[a-z0-9]+")
SQL_ANSWER = lambda t: sql_tokens(f"lower({t})", X.ANSWER_WORD, X.ANSWER_STOP, True, 2)
SQL_CLAIM = lambda t: sql_tokens(f"lower({t})", X.CLAIM_WORD, X.CLAIM_STOP, True, 2)
SQL_NUMBERS = lambda t: f"list_distinct(list_transform(regexp_extract_all({t}, '\\d[\\d,\\.]*'), lambda x: regexp_replace(replace(x, ',', ''), '\\.+$', '')))"
SQL_SALIENT = lambda t: (
    f"list_distinct(list_concat(list_concat(list_filter(regexp_extract_all(lower({t}), {q(X.CLAIM_WORD)}), lambda x: list_contains({sql_list(X.NUMBER_WORDS)}, x)), "
    f"{SQL_NUMBERS(t)}), list_transform(regexp_extract_all({t}, {q(X.ACRONYM)}), lambda x: lower(x))))"
)


def _sql_date(t: str) -> str:
    h = f"left({t}, {X.HEAD})"
    month = lambda e: f"list_position({sql_list(X.MONTHS)}, lower({e}))::VARCHAR"
    get = lambda p, g: f"regexp_extract({h}, {q(p)}, {g})"
    date = lambda y, m, d: f"try_cast(lpad({y},4,'0')||'-'||lpad({m},2,'0')||'-'||lpad({d},2,'0') AS DATE)"
    return (
        f"coalesce({date(get(X.DAY_FIRST, 3), month(get(X.DAY_FIRST, 2)), get(X.DAY_FIRST, 1))}, "
        f"{date(get(X.MONTH_FIRST, 3), month(get(X.MONTH_FIRST, 1)), get(X.MONTH_FIRST, 2))}, "
        f"{date(get(X.ISO_DATE, 1), get(X.ISO_DATE, 2), get(X.ISO_DATE, 3))})"
    )


def _sql_ref(t: str) -> str:
    return f"coalesce(nullif(regexp_extract({t}, {q(X.DOC_NUMBER)}), ''), nullif(regexp_extract({t}, {q(X.DEPT_REFERENCE)}), ''))"


def _sql_parsed(key: str) -> str:
    starts = " OR ".join(f"starts_with(lower(l), {q(s)})" for s in X.TITLE_STARTS)
    title = (
        "list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ .:-]+|[ .:-]+$', '', 'g')), lambda l: "
        f"len(l) BETWEEN 12 AND 220 AND NOT ({starts}) AND NOT regexp_matches(l, {q(X.DOC_NUMBER)}) AND NOT regexp_matches(l, {q(X.DEPT_REFERENCE)}) "
        "AND len(regexp_replace(l, '[^0-9]', '', 'g')) * 3 <= len(l))[1]"
    )
    hint = f"list_filter(list_transform(regexp_extract_all(t, {q(X.SUPERSESSION)}), lambda s: {_sql_ref('s')}), lambda r: r IS NOT NULL)[1]"
    scope = f"regexp_extract_all(t, {q(X.SCOPE)}, 1)"
    # numbers in order of first mention
    nums = f"flatten(list_transform({scope}, lambda s: regexp_extract_all(s, '\\d+(?:\\.\\d+)*')))"
    first = f"list_filter({nums}, lambda x, i: list_position({nums}, x) = i)"
    return (
        f'SELECT {key}, {_sql_ref(f"left(t, {X.HEAD})")} AS doc_number, CAST({_sql_date("t")} AS VARCHAR) AS published_date, {title} AS title, '
        f"{hint} AS supersedes_hint, array_to_string({first}, ',') AS supersedes_scope FROM src"
    )


def _sql_sorted(expr: str) -> str:
    return f"SELECT id, array_to_string(list_sort({expr}), ' ') AS tokens FROM chunks"


_WORDS = "list_filter(regexp_split_to_array(chunk_text, '[\\s\\p{Z}\\x{85}\\x0b\\x1c-\\x1f]+'), lambda x: x <> '')"
_LEVEL = (
    "CASE WHEN len(s) BETWEEN 1 AND 200 THEN CASE "
    f"WHEN regexp_extract(s, {q(X.NUMBERED_HEADING)}, 1) <> '' THEN len(regexp_replace(regexp_extract(s, {q(X.NUMBERED_HEADING)}, 1), '[^.]', '', 'g')) + 1 "
    f"WHEN regexp_matches(s, {q(X.NAMED_HEADING)}) THEN 1 WHEN regexp_matches(s, {q(X.CAPS_HEADING)}) AND NOT regexp_matches(s, '[.,]$') THEN 1 END END"
)
ORACLES = {
    "normalise_text": f"SELECT id, md5(t) AS text_md5, len(t) AS n_chars FROM (SELECT id, {sql_normalise('raw_text')} AS t FROM document_versions)",
    "content_hash": "SELECT id, sha256(raw_text) AS sha256, coalesce(lower(content_sha256) = sha256(raw_text), false) AS stored_is_right FROM document_versions",
    "slugs": r"""SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'document') AS doc_slug,
 lower(left(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)) AS file_slug,
 CASE WHEN len(l) > 60 THEN left(l, 60) || '…' ELSE l END AS session_title
FROM (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS l FROM circulars)""",
    "snippets": r"SELECT id, left(regexp_replace(chunk_text, '\s+', ' ', 'g'), 400) AS snippet FROM chunks",
    "build_parsed": f"WITH src AS (SELECT id, {sql_normalise('raw_text')} AS t FROM document_versions) {_sql_parsed('id')}",
    "parser_cases": "WITH src(\"case\", t) AS (VALUES " + ",".join(f"({q(a)}, {q(b)})" for a, b in CASES) + ") " + _sql_parsed('"case"'),
    "html_cases": 'SELECT * FROM (VALUES ' + ",".join(f"({q(a)}, {q(t)})" for a, _, t in PAGES) + ') x("case", text)',
    "token_budget": f"SELECT id, n AS n_tokens, coalesce(token_count = n, false) AS stored_is_right FROM (SELECT *, len(regexp_extract_all(chunk_text, {q(X.BUDGET_TOKEN)})) AS n FROM chunks)",
    "bm25_tokens": _sql_sorted(SQL_BM25("chunk_text")),
    "rerank_tokens": _sql_sorted(SQL_RERANK("chunk_text")),
    "answer_keywords": _sql_sorted(SQL_ANSWER("chunk_text")),
    "claim_words": _sql_sorted(SQL_CLAIM("chunk_text")),
    "number_tokens": _sql_sorted(SQL_NUMBERS("chunk_text")),
    "salient_tokens": _sql_sorted(SQL_SALIENT("chunk_text")),
    "space_words": f"SELECT id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT id, {_WORDS} AS w FROM chunks)",
    "truncate_words": f"SELECT id, array_to_string({_WORDS}[1:40], ' ') AS head FROM chunks",
    "answer_sentences": f"""SELECT id, i - 1 AS n, s AS sentence FROM (
 SELECT id, unnest(list_transform(string_split(regexp_replace(replace(regexp_replace(chunk_text, {q(X.SECTION_PREFIX)}, ''), chr(10), ' '), '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' -•' || chr(9)))) AS s,
        generate_subscripts(string_split(regexp_replace(replace(regexp_replace(chunk_text, {q(X.SECTION_PREFIX)}, ''), chr(10), ' '), '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM chunks)
WHERE len(s) BETWEEN 40 AND 600""",
    "heading_levels": f"""SELECT id, i - 1 AS line_no, {_LEVEL} AS level FROM (
 SELECT id, trim(unnest(string_split(raw_text, chr(10))), ' ' || chr(9) || chr(13)) AS s, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM document_versions)
WHERE {_LEVEL} IS NOT NULL""",
    "pipe_table_runs": """SELECT id, i - 1 AS run, len(r) AS n_rows FROM (
 SELECT id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT id, regexp_extract_all(array_to_string(list_transform(
   list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> ''), lambda x: CASE WHEN len(x) - len(replace(x, '|', '')) >= 2 THEN 't' ELSE 'p' END), ''), 't+') AS rs FROM document_versions))""",
}

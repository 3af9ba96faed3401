"""File sources: plain text, HTML, PDF and mixed folders to raw texts; listings; judged query sets; manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import file_slug
from quillspark.operators.prefix import running_total
from quillspark.session import staged

# Dropped tags, scanned suffixes, skipped names, links that lead to documents.
DROPPED = frozenset({"script", "style", "nav", "footer", "header", "noscript"})
PATTERNS = (".txt", ".md", ".pdf", ".html")
SKIPPED = ("readme.md", "manifest.json")
DOC_LINK = r"(?i)(BS_ViewMasCirculardetails\.aspx\?id=\d+|BS_ViewMasDirections\.aspx\?id=\d+|NotificationUser\.aspx\?Id=\d+)"


class _Text(HTMLParser):
    """Collects text lines; tables become marked blocks of rows with cells between bars."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.dropped = self.depth = 0
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropped += 1
        elif tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th"):
            self.cell = []

    def _close_cell(self) -> None:
        if self.cell is not None:
            self.rows = self.rows or [[]]
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in ("td", "th"):
            self._close_cell()
        elif tag == "table" and self.depth:
            self._close_cell()
            self.depth -= 1
            if not self.depth:
                rows = [" | ".join(r) for r in self.rows if any(r)]
                self.lines += ["", "[TABLE]", *rows, "[/TABLE]", ""]
                self.rows = []

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif not self.depth and data.strip():
            self.lines.append(data.strip())


def html_to_text(raw: str) -> str:
    parser = _Text()
    parser.feed(raw)
    parser.close()
    return "\n".join(parser.lines)


def pdf_to_text(data: bytes) -> str:
    """Text of all readable pages; needs the optional package pypdf. An unreadable page is left out."""
    import io

    from pypdf import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001, S112
            continue
    return "\n\n".join(pages)


def bytes_to_text(data: bytes, name: str) -> str:
    """Text of a file by the suffix of its name; undecodable bytes are ignored."""
    suffix = name.lower().rsplit(".", 1)[-1]
    if suffix == "pdf":
        return pdf_to_text(data)
    text = data.decode("utf-8", "ignore")
    return html_to_text(text) if suffix in ("html", "htm") else text


def html_text(column: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(html_to_text, na_action="ignore")

    return convert(column)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, path, raw, error) of all documents below folder: by suffix in the order of PATTERNS, then by path.

    A file that can't be read has a null raw and its error; the others aren't affected. Paths are numbered over all
    tasks before any file is opened, and each file is decoded once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))
    place = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), suffix)
    wanted = (place > 0) & ~name.isin(*SKIPPED)
    paths = files.filter(wanted).select("path", place.alias("kind"), F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"))
    order = running_total(paths, ["all"], ["kind", "path"], "one", "seq").select("path", "seq")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append((path, bytes_to_text(data, path), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "raw", "error"])

    read = files.filter(wanted).select("path", "content").mapInPandas(run, "path string, raw string, error string")
    return read.join(order, "path").select("seq", "path", "raw", "error")


def discover_links(pages: DataFrame, least_title: int = 8) -> DataFrame:
    """(url, title) of links to documents in pages(url, html): first mention of each, short titles dropped afterwards."""

    class Links(HTMLParser):
        def __init__(self, base: str) -> None:
            super().__init__()
            self.base, self.found, self.href = base, [], None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "a":
                self.href = dict(attrs).get("href")
                self.found.append([urljoin(self.base, self.href), ""] if self.href else ["", ""])

        def handle_endtag(self, tag: str) -> None:
            self.href = None if tag == "a" else self.href

        def handle_data(self, data: str) -> None:
            if self.href:
                self.found[-1][1] += data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, html in zip(part["url"], part["html"], strict=True):
                p = Links(url)
                p.feed(html or "")
                rows += [(url, i, u, " ".join(t.split())) for i, (u, t) in enumerate(p.found) if u]
            yield pd.DataFrame(rows, columns=["page", "at", "url", "title"])

    links = pages.select("url", "html").mapInPandas(run, "page string, at int, url string, title string").filter(F.col("url").rlike(DOC_LINK))
    first = links.groupBy("url").agg(F.min(F.struct("page", "at", "title")).alias("f"))
    return first.select("url", F.col("f.title").alias("title")).filter(F.length("title") >= least_title)


def read_judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, doc, anchor, grade) of a JSON file of judged queries."""
    q = spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q"))
    return q.select(F.col("q.id").alias("qid"), F.col("q.text").alias("text"), F.explode("q.judgments").alias("j")).select("qid", "text", "j.doc", "j.anchor", F.col("j.grade").cast("int").alias("grade"))


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus(at, doc, text), queries(qid, text), qrels(at, qid, doc, grade)) of a folder in the BEIR layout; at numbers lines in their order."""
    at = F.monotonically_increasing_id().alias("at")
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    corpus = corpus.select(at, F.col("_id").alias("doc"), F.trim(F.concat_ws("\n", "title", "text")).alias("text"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), "text")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("qid string, doc string, grade int").csv(f"{folder}/qrels/test.tsv").select(at, "qid", "doc", "grade")
    return corpus, queries, qrels


def http_get(url: str) -> bytes:
    """The body behind a url."""
    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=60) as answer:  # noqa: S310
        return answer.read()


def fetch_documents(links: DataFrame, get: Callable[[str], bytes] = http_get, least: int = 200) -> DataFrame:
    """(url, title, file, raw, error) of links(url, title): each page's text and the name of the file it would get.

    A page that can't be fetched or whose text is shorter than least characters has a null raw and its error. get may
    read stored pages instead of the network. Fetches run in Arrow batches, as many at once as there are tasks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, title in zip(part["url"], part["title"], strict=True):
                try:
                    data = get(url)
                    text = bytes_to_text(data, "a.pdf" if data[:5] == b"%PDF-" else "a.html")
                    rows.append((url, title, text, None) if len(text) >= least else (url, title, None, "too short"))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, title, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "title", "raw", "error"])

    read = links.select("url", "title").mapInPandas(run, "url string, title string, raw string, error string")
    return read.select("url", "title", F.concat(file_slug(F.col("title")), F.lit(".txt")).alias("file"), "raw", "error")


def crawl(spark: SparkSession, listings: list[str], stored: DataFrame | None = None, get: Callable[[str], bytes] = http_get) -> tuple[DataFrame, DataFrame]:
    """(fetched, manifest(url, title, file)): the documents that listing pages link to and the manifest lacks, fetched, and the manifest with them."""
    pages = spark.createDataFrame([(u, get(u).decode("utf-8", "ignore")) for u in listings], "url string, html string")  # a handful of listings
    links = discover_links(pages)
    if stored is not None:
        links = links.join(stored.select("url"), "url", "left_anti")
    fetched = staged(fetch_documents(links, get), "fetched")
    good = fetched.filter("raw is not null").select("url", "title", "file")
    return fetched, good if stored is None else merge_manifest(stored, good)


def merge_manifest(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """stored and the rows of fetched whose url it lacks, one row a url."""
    return stored.unionByName(fetched.dropDuplicates(["url"]).join(stored.select("url"), "url", "left_anti"), allowMissingColumns=True)

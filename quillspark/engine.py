"""One object for the whole service: ingest, search, ask, list, rebuild. State is a folder of parts."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import answers as A
from quillspark.operators import providers as P
from quillspark.operators import retrieval as R
from quillspark.operators import versioning as V
from quillspark.operators.chunking import chunk as chunked
from quillspark.session import clear_staged, ship_package
from quillspark.sources import files, snapshots

MAX_K, MAX_CHAT_K, MAX_MESSAGE, LEAST_TEXT, MAX_BYTES = 50, 20, 4000, 200, 25 * 1024 * 1024
SUFFIXES = (".txt", ".md", ".pdf", ".html", ".htm")
MESSAGES = "session_id string, at timestamp, role string, content string, meta_json string"
META = "refused boolean, rate double, provider string, citations array<struct<n: int, chunk_id: string, doc_number: string, snippet: string>>"


class Engine:
    """Batched operations over the store in root. Writers come one at a time; readers see whole parts."""

    def __init__(self, spark: SparkSession, root: str, chunker: str = "structure_aware", embedder: str = "hashing", reranker: str = "lexical", answerer: str = "extractive"):
        self.spark, self.root, self.chunker = spark, root, chunker
        self.embedder, self.reranker, self.answerer = P.embedder(embedder), P.reranker(reranker), P.answerer(answerer)
        ship_package(spark)

    # writing -------------------------------------------------------------------------------------
    def ingest(self, docs: DataFrame, allow_duplicate: bool = False, chunker: str | None = None) -> DataFrame:
        """Ingest docs(seq, raw[, title, target]) after what is stored; returns one result row per document.

        Only the new texts are parsed and chunked; of the stored versions only those are written again, in a new
        revision, that a new one supersedes.
        """
        base, rev = 0, 1
        stored, chunks = None, None
        if not self._empty():
            stored, chunks = self._current("versions"), self._current("chunks")
            t = snapshots.read_parts(self.spark, self.root, "versions", "results")
            rev = t["versions"].agg(F.coalesce(F.max("rev"), F.lit(0)) + 1).first()[0]
            base = t["results"].agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        new = docs.withColumn("seq", (F.col("seq") + base).cast("long"))
        out = V.ingest(new, chunker or self.chunker, stored, chunks, allow_duplicate)
        text = new.select("seq", "raw")
        name = snapshots.write_part(self.spark, self.root, {
            "texts": text, "versions": out.versions.withColumn("rev", F.lit(rev)), "chunks": out.chunks.withColumn("rev", F.lit(rev)), "results": out.results,
        })
        clear_staged(self.spark)
        return self.spark.read.parquet(f"{self.root}/{name}/results").orderBy("seq")

    def ingest_folder(self, folder: str) -> DataFrame:
        """Ingest all documents of a folder; unreadable files are left out."""
        return self.ingest(files.read_folder(self.spark, folder).filter("raw is not null").select("seq", "raw"))

    def ingest_text(self, text: str, title: str | None = None, target: str | None = None) -> DataFrame:
        text = text.strip()
        if len(text) < LEAST_TEXT:
            raise ValueError(f"a pasted text needs {LEAST_TEXT} characters at least")
        return self._one(text, title, target)

    def _one(self, text: str, title: str | None, target: str | None, **how: object) -> DataFrame:
        return self.ingest(self.spark.createDataFrame([(1, text, title, target)], "seq long, raw string, title string, target string"), **how)

    def upload(self, data: bytes, name: str, title: str | None = None, target: str | None = None, chunker: str | None = None, allow_duplicate: bool = False) -> DataFrame:
        """Keep a copy of the file, under a free name, and ingest its text."""
        name = PurePosixPath(name.replace("\\", "/")).name
        if not name.lower().endswith(SUFFIXES):
            raise ValueError(f"only {', '.join(SUFFIXES)} can be read")
        if not data:
            raise ValueError("the file is empty")
        if len(data) > MAX_BYTES:
            raise ValueError(f"a file may have {MAX_BYTES} bytes at most")
        fs, folder = snapshots._fs(self.spark, f"{self.root}-uploads")
        stem, dot, suffix = name.rpartition(".")
        names = (name if not k else f"{stem}-{k}{dot}{suffix}" for k in range(1 << 30))
        path = next(p for p in (snapshots._fs(self.spark, f"{folder}/{n}")[1] for n in names) if not fs.exists(p))
        out = fs.create(path, False)
        out.write(bytearray(data))
        out.close()
        return self._one(files.bytes_to_text(data, name), title, target, chunker=chunker, allow_duplicate=allow_duplicate)

    def rebuild(self, chunker: str | None = None) -> None:
        """Derive the store again from the ingested texts, in their order, with another chunker if one is named: supersession included."""
        self.chunker = chunker or self.chunker
        if self._empty():
            return
        texts = snapshots.read_parts(self.spark, self.root, "texts")["texts"]
        out = V.ingest(texts, self.chunker)
        one = F.lit(1)
        snapshots.write_part(self.spark, self.root, {"texts": texts, "versions": out.versions.withColumn("rev", one), "chunks": out.chunks.withColumn("rev", one), "results": out.results}, replace=True)
        clear_staged(self.spark)

    def compact(self) -> None:
        """Write what counts as a single part."""
        if not self._empty():
            every = snapshots.read_parts(self.spark, self.root, "texts", "results")
            snapshots.write_part(self.spark, self.root, {**every, "versions": self._current("versions"), "chunks": self._current("chunks")}, replace=True)

    def reembed(self) -> DataFrame:
        """(chunk_id, embedding, embedding_dim, signature) of every chunk by the engine's embedder, stored beside the index."""
        out = f"{self.root}-embeddings/{self.embedder.signature.replace(':', '-')}/{self._state()}"
        if not self._exists(f"{out}/_SUCCESS"):
            P.reembed_all(self._docs(), self.embedder).write.mode("overwrite").parquet(out)
        return self.spark.read.parquet(out)

    def reset(self) -> None:
        for tail in ("", "-index", "-embeddings"):
            snapshots.drop_all(self.spark, self.root + tail)

    # reading -------------------------------------------------------------------------------------
    def _exists(self, path: str) -> bool:
        fs, p = snapshots._fs(self.spark, path)
        return fs.exists(p)

    def _empty(self) -> bool:
        return not snapshots.parts(self.spark, self.root)

    def _state(self) -> str:
        return snapshots.parts(self.spark, self.root)[-1]

    def _current(self, table: str) -> DataFrame:
        """Versions, or chunks, in the latest revision of their version."""
        t = snapshots.read_parts(self.spark, self.root, "versions", table)
        latest = t["versions"].groupBy("version_id").agg(F.max("rev").alias("rev"))
        return t[table].join(latest, ["version_id", "rev"])

    def _docs(self) -> DataFrame:
        v = self._current("versions").select("version_id", "doc_number", "title", "version_number", "published_date", F.col("status").alias("version_status"))
        return self._current("chunks").withColumnRenamed("chunk_text", "text").join(v, "version_id")

    def index(self) -> R.Index:
        """The stored index of the current state; built at the first search after a change."""
        folder = f"{self.root}-index/{self._state()}"
        if not self._exists(f"{folder}/DONE"):
            R.build_index(self._docs().select("chunk_id", "text")).write(folder)
            fs, p = snapshots._fs(self.spark, f"{folder}/DONE")
            fs.create(p, True).close()
        return R.Index.read(self.spark, folder)

    def search(self, queries: DataFrame, mode: str = "hybrid_rerank", k: int = R.TOP_K, include_deprecated: bool = False) -> DataFrame:
        """Hits of queries(qid, text) with the fields of their chunk, version and document, and the ranks and scores that led there."""
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must be between 1 and {MAX_K}")
        docs = self._docs()
        hits = R.search(queries, docs, mode, k, include_deprecated=include_deprecated, index=self.index(), reranker=self.reranker)
        return hits.join(docs, "chunk_id").select(
            "qid", "rank", F.round("score", 6).alias("score"), "chunk_id", F.col("text").alias("chunk_text"), "section_ref", "chunk_type", "status", "doc_number", "title", "version_number", "published_date",
            F.create_map(F.lit(mode), F.round("score", 6)).alias("components"),
        )

    def ask(self, queries: DataFrame, mode: str = "hybrid_rerank", k: int = R.TOP_K, include_deprecated: bool = False) -> DataFrame:
        """(qid, answer, refused, rate, checked, supported, uncited, invalid, notice, provider, citations)."""
        if not 1 <= k <= MAX_CHAT_K:
            raise ValueError(f"k must be between 1 and {MAX_CHAT_K}")
        if queries.filter((F.length("text") > MAX_MESSAGE) | F.col("text").isNull() | (F.length("text") == 0)).limit(1).count():
            raise ValueError(f"a question has between 1 and {MAX_MESSAGE} characters")
        found = self.search(queries, mode, k, include_deprecated).persist()
        hits, docs = found.select("qid", "chunk_id", "rank"), found.select("chunk_id", F.col("chunk_text").alias("text"), "doc_number", "title", "section_ref", "published_date", "status").dropDuplicates(["chunk_id"])
        answered = self.answerer(queries, hits, docs).persist()
        report = A.check_answers(answered, hits, docs)[1]
        cited = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("n"), "chunk_id", "doc_number", F.left(F.regexp_replace("chunk_text", r"\s+", " "), F.lit(400)).alias("snippet")))).alias("citations"))
        notes = A.remarks(answered, report).join(A.notices(found), "qid", "left").select("qid", F.concat_ws(" ", F.nullif("notice", F.lit("")), F.nullif("remark", F.lit(""))).alias("notice"))
        return answered.drop("confidence").join(report, "qid").join(notes, "qid", "left").join(cited, "qid", "left")

    def chat(self, session_id: str, message: str, mode: str = "hybrid_rerank", k: int = R.TOP_K) -> dict:
        """Ask one question within a session and keep both turns."""
        q = self.spark.createDataFrame([(session_id, message)], "qid string, text string")
        answer = self.ask(q, mode, k).first().asDict(recursive=True)
        meta = json.dumps({c: answer[c] for c in ("refused", "rate", "provider", "citations")})
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.log(self.spark.createDataFrame([(session_id, now, "user", message, None), (session_id, datetime.now(timezone.utc).replace(tzinfo=None), "assistant", answer["answer"], meta)], MESSAGES))
        return answer

    def documents(self) -> DataFrame:
        """Every document with its versions in order, the newest document first."""
        v = self._current("versions")
        c = self._current("chunks").groupBy("version_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("status") == "active").alias("active"))
        listed = F.array_sort(F.collect_list(F.struct("version_number", "version_id", "status", "published_date", "supersedes", "superseded_by", "chunks", "active")))
        return v.join(c, "version_id", "left").groupBy("doc_number").agg(F.max_by("title", "version_number").alias("title"), F.min("seq").alias("first_seq"), listed.alias("versions")).orderBy(F.desc("first_seq"))

    def document(self, doc_number: str) -> dict:
        """One document with its versions; a KeyError if there is none of that number."""
        row = self.documents().filter(F.col("doc_number") == doc_number).first()
        if row is None:
            raise KeyError(doc_number)
        return row.asDict(recursive=True)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self._docs().filter(F.col("chunk_id") == chunk_id)

    def stats(self) -> DataFrame:
        t = self._docs()
        return t.agg(
            F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "deprecated").alias("deprecated"),
            F.count_if(F.col("chunk_type") == "table").alias("tables"), F.countDistinct("doc_number").alias("documents"), F.lit(self.embedder.signature).alias("embedder"),
        )

    def sweep(self, judged: DataFrame, queries: DataFrame, k: int = 5, chunkers: tuple[str, ...] = ("fixed", "recursive", "structure_aware")) -> DataFrame:
        """Metrics of the default mode over fresh chunks of all versions for each chunker; the store stays as it is."""
        from quillspark.operators import evaluation as E

        t = snapshots.read_parts(self.spark, self.root, "texts")["texts"]
        v = self._current("versions").select("version_id", "seq", "doc_number", "status").join(t, "seq").withColumn("text", V.X.normalise_text(F.col("raw")))
        return E.chunking_sweep(v, queries, judged, k, chunkers)

    # sessions ------------------------------------------------------------------------------------
    def _messages(self) -> DataFrame:
        return self.spark.read.schema(MESSAGES).option("recursiveFileLookup", True).parquet(f"{self.root}-messages") if self._exists(f"{self.root}-messages") else self.spark.createDataFrame([], MESSAGES)

    def log(self, turns: DataFrame) -> None:
        """Append chat messages of the form MESSAGES; each session has a folder of its own."""
        for (sid,) in turns.select("session_id").distinct().collect():  # the sessions of one request
            if not re.fullmatch(r"[\w.-]{1,100}", sid or ""):
                raise ValueError("a session id has letters, digits, dots and dashes")
            turns.filter(F.col("session_id") == sid).write.mode("append").parquet(f"{self.root}-messages/{sid}")

    def sessions(self, limit: int = 30) -> DataFrame:
        """The latest sessions, titled by their first message."""
        title = V.X.session_title(F.min(F.struct("at", "content"))["content"])
        return self._messages().groupBy("session_id").agg(title.alias("title"), F.max("at").alias("last")).orderBy(F.desc("last"), "session_id").limit(limit)

    def history(self, session_id: str) -> DataFrame:
        """Turns of a session in order, with the citations read out of their JSON."""
        m = self._messages().filter(F.col("session_id") == session_id)
        return m.withColumn("meta", F.from_json("meta_json", META)).drop("meta_json").orderBy("at", F.desc("role"))

    def delete_session(self, session_id: str) -> None:
        """Drop a session with its messages; a KeyError if there is none."""
        fs, p = snapshots._fs(self.spark, f"{self.root}-messages/{session_id}")
        if not re.fullmatch(r"[\w.-]{1,100}", session_id) or session_id in (".", "..") or not fs.delete(p, True):
            raise KeyError(session_id)

    @staticmethod
    def new_session() -> str:
        return uuid.uuid4().hex


def rechunk(versions: DataFrame, chunker: str) -> DataFrame:
    """Chunks of versions(version_id, text) by the chunker called chunker."""
    return chunked(versions, "version_id", "text", chunker)

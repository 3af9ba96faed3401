"""Named providers of embeddings, reranking and answers; one that isn't available gives way to the built-in one."""

from __future__ import annotations

import json
import logging
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import answers as A
from quillspark.operators import retrieval as R

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Embedder:
    """encode gives unit vectors (texts, dim) for texts; it runs in Python workers, so it must be picklable."""

    name: str
    dim: int
    encode: Callable[[list[str]], np.ndarray]

    @property
    def signature(self) -> str:
        return f"{self.name}:{self.dim}"


def _hashing() -> Embedder:
    def encode(texts: list[str]) -> np.ndarray:
        return R.unit_vectors([" ".join(R.TOKEN.findall(t.lower())) for t in texts]) if texts else np.zeros((0, 2 * R.BUCKETS))

    return Embedder("hashing", 2 * R.BUCKETS, encode)


def _neural(model: str = os.environ.get("QUILLSPARK_EMBEDDING_MODEL", "")) -> Embedder:
    from sentence_transformers import SentenceTransformer  # optional

    dim = SentenceTransformer(model).get_sentence_embedding_dimension()
    return Embedder(f"sentence-transformers:{model}", dim, lambda texts: SentenceTransformer(model).encode(texts, normalize_embeddings=True))


def _cross_encoder(model: str = os.environ.get("QUILLSPARK_RERANK_MODEL", "")) -> Callable[..., DataFrame]:
    from sentence_transformers import CrossEncoder  # optional

    CrossEncoder(model)
    return cross_rerank(lambda pairs: 1 / (1 + np.exp(-np.asarray(CrossEncoder(model).predict(pairs)))))


def cross_rerank(score: Callable[[list[tuple[str, str]]], np.ndarray]) -> Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]:
    """A reranker like R.lexical_rerank that scores (query, passage) pairs in Arrow batches."""

    def rerank(queries: DataFrame, candidates: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        pairs = candidates.select("qid", "chunk_id", F.col("rank").alias("was")).join(docs.select("chunk_id", F.col("text").alias("passage")), "chunk_id").join(queries.select("qid", F.col("text").alias("query")), "qid")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                scores = score(list(zip(part["query"].fillna(""), part["passage"].fillna(""), strict=True))) if len(part) else []
                yield part[["qid", "chunk_id", "was"]].assign(score=np.asarray(scores, float))

        kinds = dict(pairs.dtypes)
        scored = pairs.select("qid", "chunk_id", "was", "query", "passage").mapInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, was {kinds['was']}, score double")
        return R.top_k(scored.withColumn("tie", F.col("was")), k, key="tie").select("qid", "chunk_id", "score", "rank")

    return rerank


# Prompts, in our own words.
SYSTEM = (
    "You answer questions about circulars. Use nothing but the numbered passages. End every statement with the number of its passage, as in [2]. "
    "Give figures and dates as they are written. Where passages disagree, follow the later one and say so. "
    f"If the passages do not answer the question, write: {X.REFUSAL} Close with: {X.DISCLAIMER}"
)
QUESTION = "Question: {question}\n\nPassages:\n{sources}"
JUDGE = "Does the passage bear out the statement? Write YES or NO.\n\nStatement: {claim}\n\nPassage: {passage}"


@dataclass(frozen=True)
class ChatEndpoint:
    """A generator behind an HTTP endpoint that takes chat messages and returns choices, as many servers do."""

    url: str
    key: str
    model: str
    seconds: float = 90

    def complete(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.seconds) as answer:  # noqa: S310
            return json.load(answer)["choices"][0]["message"].get("content") or ""


def extractive(queries: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    return A.answers(queries, hits, docs).withColumn("provider", F.lit("extractive"))


def generated(complete: Callable[[str, str], str], name: str = "chat") -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """An answerer that lets complete(system, user) write from the passages; refusals, and failures of it, stay extractive."""

    def answer(queries: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
        plain = A.answers(queries, hits, docs)
        rows = plain.join(queries.select("qid", "text"), "qid").join(A.source_blocks(hits, docs), "qid", "left")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                texts, by = [], []
                for own, refused, question, sources in zip(part["answer"], part["refused"], part["text"], part["sources"], strict=True):
                    made = None
                    if not refused:
                        try:
                            made = complete(SYSTEM, QUESTION.format(question=question, sources=sources)).strip()
                        except Exception as e:  # noqa: BLE001
                            log.warning("%s failed, the answer is extractive: %s", name, e)
                    texts.append(own if not made else made if X.DISCLAIMER.lower() in made.lower() else f"{made}\n\n{X.DISCLAIMER}")
                    by.append(name if made else "extractive")
                yield part[["qid", "refused", "confidence"]].assign(answer=texts, provider=by)

        out = rows.select("qid", "answer", "refused", "confidence", "text", "sources").mapInPandas(run, f"qid {dict(rows.dtypes)['qid']}, refused boolean, confidence double, answer string, provider string")
        return out.select("qid", "answer", "refused", "confidence", "provider")

    return answer


def judged_by(complete: Callable[[str, str], str]) -> Callable[..., object]:
    """judge for A.check_answers: true or false by complete, null where it fails."""

    @F.pandas_udf("boolean")
    def judge(claims: pd.Series, passages: pd.Series) -> pd.Series:
        def one(claim: str, passage: str) -> bool | None:
            try:
                return "NO" not in complete("You check statements against passages.", JUDGE.format(claim=claim, passage=passage[:4000])).upper().split() if passage else None
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(c, p) for c, p in zip(claims, passages, strict=True)], dtype=object)

    return judge


def _endpoint() -> Callable[..., DataFrame]:
    url, key, model = (os.environ.get(f"QUILLSPARK_CHAT_{n}", "") for n in ("URL", "KEY", "MODEL"))
    if not url or not key:
        raise RuntimeError("no chat endpoint or key is set")
    return generated(ChatEndpoint(url, key, model).complete)


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing": _hashing, "neural": _neural}
RERANKERS: dict[str, Callable[[], Callable[..., DataFrame]]] = {"lexical": lambda: R.lexical_rerank, "cross-encoder": _cross_encoder}
ANSWERERS: dict[str, Callable[[], Callable[..., DataFrame]]] = {"extractive": lambda: extractive, "chat": _endpoint}


def _pick(table: dict, name: str, default: str):  # noqa: ANN202
    """What name makes; the default, with a warning, for an unknown name or one that can't be made here."""
    try:
        return table[name.lower()]()
    except Exception as e:  # noqa: BLE001
        log.warning("%s isn't available (%s), using %s", name, e, default)
        return table[default]()


def embedder(name: str = "hashing") -> Embedder:
    return _pick(EMBEDDERS, name, "hashing")


def reranker(name: str = "lexical") -> Callable[..., DataFrame]:
    return _pick(RERANKERS, name, "lexical")


def answerer(name: str = "extractive") -> Callable[..., DataFrame]:
    return _pick(ANSWERERS, name, "extractive")


def reembed_all(chunks: DataFrame, by: Embedder) -> DataFrame:
    """(chunk_id, embedding, embedding_dim, signature) of chunks(chunk_id, text), in Arrow batches without a shuffle; a null text counts as empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 1024):
                p = part.iloc[i : i + 1024]
                x = np.asarray(by.encode(p["text"].fillna("").tolist()), np.float32)
                yield pd.DataFrame({"chunk_id": p["chunk_id"], "embedding": list(x), "embedding_dim": by.dim, "signature": by.signature})

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, embedding array<float>, embedding_dim int, signature string")

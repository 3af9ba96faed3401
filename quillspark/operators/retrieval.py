"""Batched retrieval: every operator takes a table of queries and returns ranked rows per query."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import index as I
from quillspark.session import staged

MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")
RRF_K, CANDIDATES, TOP_K = 60, 40, 8
BUCKETS = 512
_STOP = frozenset(X.BASE_STOP)
_BM25_STOP = frozenset(X.BM25_STOP)
TOKEN = re.compile("[a-z0-9]+")
#: As X.bm25_tokens has it, on lower case.
BM25_TOKEN = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")


def top_k(scored: DataFrame, k: int, score: str = "score", query: str = "qid", key: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with their rank; equal scores go by key."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, 6)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _numbered(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """key and columns with no: long numbers in the order of key, so joins and ties need no strings. Written once, read often."""
    # columns are made after the sort, which would make them twice, once for its sample
    return staged(df.orderBy(key).select(key, *columns).withColumn("no", F.monotonically_increasing_id()), "numbered")


#: Rows of a query side that is broadcast at most.
BROADCAST_ROWS = 200_000
#: Terms of queries (three numbers each) that tasks hold at once at most; more queries are scored slice by slice.
ASKED_ROWS = 1_000_000
#: Best documents that a task holds at most, over all queries of a slice.
HELD = 8_000_000


def _tasks(spark: SparkSession) -> int:
    """Parts of the documents that queries are scored against: each part gives k rows a query, so one a core."""
    return max(2, spark.sparkContext.defaultParallelism)


def _alike(q: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(rep, by) and (q, rep) of q(no, by): queries of the same tokens are scored once, as the first of them; those without any have no row."""
    asked = q.filter(F.col(by) != "")
    first = staged(asked.groupBy(by).agg(F.min("no").alias("rep")), "first")
    return first, staged(asked.join(first, by).select(F.col("no").alias("q"), "rep"), "same")


def _named(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, chunk_id, score, rank) of ranked(q, no, score, rank)."""
    return ranked.join(queries.select("qid", F.col("no").alias("q")), "q").join(docs.select("chunk_id", "no"), "no").select("qid", "chunk_id", "score", "rank")


@dataclass(frozen=True)
class Index:
    """docs(chunk_id, no, dl), postings(term, no, dl, tf), weights(term, df, idf), corpus(n, avgdl)."""

    docs: DataFrame
    postings: DataFrame
    weights: DataFrame
    corpus: DataFrame

    def write(self, folder: str) -> None:
        for name in ("docs", "postings", "weights", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Index:
        return Index(*[spark.read.parquet(f"{folder}/{name}") for name in ("docs", "postings", "weights", "corpus")])


def build_index(docs: DataFrame) -> Index:
    """The inverted index of docs(chunk_id, text); statistics cover all of them. A document without tokens has length 0."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [[t for t in BM25_TOKEN.findall(text) if t not in _BM25_STOP] if text else [] for text in part.column("low").to_pylist()]
            tf = [Counter(ts) for ts in found]
            edge = pa.array(np.cumsum([0, *map(len, tf)]), pa.int32())
            terms = pa.ListArray.from_arrays(edge, pa.array(list(chain.from_iterable(tf)), pa.string()))
            times = pa.ListArray.from_arrays(edge, pa.array(list(chain.from_iterable(c.values() for c in tf)), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("chunk_id"), part.column("no"), pa.array(list(map(len, found)), pa.int64()), terms, times], ["chunk_id", "no", "dl", "terms", "times"])

    # a document is one row, so its terms are found and counted where it is, after the sort, which would do it twice
    low = docs.orderBy("chunk_id").select("chunk_id", F.lower("text").alias("low")).withColumn("no", F.monotonically_increasing_id())
    d = staged(low.mapInArrow(count, f"chunk_id {dict(docs.dtypes)['chunk_id']}, no long, dl long, terms array<string>, times array<int>"), "counted")
    corpus = I.corpus_stats(d.select("dl"))
    posts = d.select("no", "dl", F.inline(F.arrays_zip("terms", "times"))).select(F.col("terms").alias("term"), "no", "dl", F.col("times").cast("long").alias("tf"))
    return Index(d.select("chunk_id", "no", "dl"), posts, staged(I.idf(posts, corpus), "weights"), corpus)


def bm25(queries: DataFrame, docs: DataFrame, k: int, allowed: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) from queries(qid, text) and docs(chunk_id, text), or their index.

    Statistics cover all docs, hits only those in allowed(chunk_id). Terms count as often as the query has them; only
    positive scores are kept. Postings of terms that no query has are left out before anything is weighted or shuffled.
    """

    def side() -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
        q = _numbered(queries, "qid", F.array_join(F.array_sort(X.bm25_tokens(F.col("text"))), " ").alias("ts"))
        first, same = _alike(q, "ts")
        asked = staged(first.select(F.col("rep").alias("q"), F.explode(F.split("ts", " ")).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
        return q, same, asked, asked.count(), first.count()

    (q, same, asked, n, different), made = at_once(side, lambda: index or build_index(docs))
    terms = staged(asked.select("term").distinct().join(made.weights.select("term", "idf"), "term").withColumn("t", F.monotonically_increasing_id()), "terms")
    known = made.postings.join(F.broadcast(terms) if min(n, terms.count()) <= BROADCAST_ROWS else terms, "term")
    if allowed is not None:
        known = known.join(made.docs.join(allowed.select("chunk_id"), "chunk_id", "left_semi").select("no"), "no", "left_semi")
    part = F.col("tf") * (I.K1 + 1) / (F.col("tf") + I.K1 * (1 - I.B + I.B * F.col("dl") / F.col("avgdl")))
    known = known.crossJoin(F.broadcast(made.corpus.select("avgdl"))).select("t", "no", (F.col("idf") * part).alias("gain"))  # one row
    # by document, not by term: a term of every second document is spread out, and the sums need no further exchange
    asked = asked.join(terms.select("term", "t"), "term").select("q", "t", "times")
    slices = max(1, -(-n // ASKED_ROWS), -(-different * k // HELD))
    known, scored = staged(known, "known") if slices > 1 else known, None
    for i in range(slices):
        by_document = known.repartition(_tasks(queries.sparkSession), "no").sortWithinPartitions("no")
        one = _summed_in_blocks(by_document, asked.filter(F.pmod(F.xxhash64("q"), F.lit(slices)) == i), k)
        scored = one if scored is None else scored.unionByName(one)
    return _named(top_k(scored, k, query="q", key="no").withColumnRenamed("q", "rep").join(same, "rep"), q, made.docs)


def _placed(r: np.ndarray, place: np.ndarray, no: np.ndarray) -> np.ndarray:
    """The order by r, then the highest place, then no."""
    if place.max(initial=0) >= 1 << 38 or r.max(initial=0) >= 1 << 24:
        return np.lexsort((no, -place, r))
    key = (r.astype(np.int64) << 39) - place.astype(np.int64)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    # only what has equals needs its number
    few = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    order[few] = order[few][np.lexsort((no[order[few]], key[order[few]]))]
    return order


class Best:
    """The k best documents of each query so far: by score to six places, then by number; positive scores only."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.no = k, np.zeros((queries, k)), np.zeros((queries, k), np.int64)
        #: What a score has to exceed to come in.
        self.floor = np.zeros(queries)
        #: (queries, scores, documents) put here and not yet taken, and how many they are.
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0
        #: Documents so far, counted by those who need it.
        self.seen = 0

    def near(self, scores: np.ndarray) -> np.ndarray:
        """Places of those of many scores of one query that may be among its best."""
        place = np.rint(scores * 1e6)
        return np.flatnonzero(place >= np.partition(place, -self.k)[-self.k])

    def take(self, found: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Positive scores and documents of some queries, each query and each document of a query once."""
        for low in range(0, len(found), 16384):
            few = found[low : low + 16384]
            self._merge(np.array([f[0] for f in few]), np.array([len(f[1]) for f in few]), np.concatenate([f[1] for f in few]), np.concatenate([f[2] for f in few]))

    def _merge(self, i: np.ndarray, n: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        """Take scores and documents of different queries i, n of each."""
        r = np.r_[np.repeat(np.arange(len(i)), self.k), np.repeat(np.arange(len(i)), n)]
        s, no = np.r_[self.score[i].ravel(), scores], np.r_[self.no[i].ravel(), docs]
        place = np.where(s > 0, np.rint(s * 1e6), -1.0)
        order = _placed(r, place, no)
        # every query has k rows at least
        order = order[(np.searchsorted(r[order], np.arange(len(i)))[:, None] + np.arange(self.k)).ravel()]
        self.score[i], self.no[i] = s[order].reshape(-1, self.k), no[order].reshape(-1, self.k)
        self.floor[i] = np.maximum(0.0, (place[order[self.k - 1 :: self.k]] - 0.6) * 1e-6)

    def put(self, queries: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        """To be taken by the next settle; a document of a query comes once in all."""
        if len(queries):
            self.held.append((queries, scores, docs))
            self.many += len(queries)
            if self.many > HELD:
                self.settle()

    def settle(self) -> None:
        """Take all that was put."""
        if self.held:
            q, s, no = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.many = [], 0
            order = np.argsort(q, kind="stable")
            q, s, no = q[order], s[order], no[order]
            edge = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True])
            for low in range(0, len(edge) - 1, 16384):
                few = edge[low : low + 16385]
                self._merge(q[few[:-1]], np.diff(few), s[few[0] : few[-1]], no[few[0] : few[-1]])

    def rows(self, queries: np.ndarray) -> Iterator[pd.DataFrame]:
        """(q, no, score) of all queries."""
        self.settle()
        step = max(1, 500_000 // self.k)
        for i in range(0, len(queries), step):
            r, c = np.nonzero(self.score[i : i + step] > 0)
            yield pd.DataFrame({"q": queries[i : i + step][r], "no": self.no[i : i + step][r, c], "score": self.score[i : i + step][r, c]})


#: Scores of queries and documents, and gains of terms and documents, that a block has at most; documents of the first block and of any.
BLOCK_SCORES, FIRST_DOCS, MOST_DOCS = 8_000_000, 512, 16_384
#: Terms that have a row of their own in a block at most.
TERM_ROWS = 2048
#: Share of the documents that a term has on average, from which on all documents are looked at for each query.
TILED = 0.05


def _by_document(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows that come document by document, in runs of whole documents: few at first, so that later ones meet a high floor."""
    held, many, width = [], 0, min(most, FIRST_DOCS)
    for part in parts:
        while len(part):
            docs = part["no"].to_numpy()
            starts = np.flatnonzero(np.r_[len(held) == 0 or held[-1]["no"].iloc[-1] != docs[0], docs[1:] != docs[:-1]])
            if many + len(starts) <= width:
                held.append(part)
                many += len(starts)
                break
            cut = starts[width - many]
            held.append(part.iloc[:cut])
            yield pd.concat(held)
            held, many, part, width = [], 0, part.iloc[cut:], min(most, 2 * width)
    if many:
        yield pd.concat(held)


def _summed_in_blocks(known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, no, score): the k best of each part of the documents of known(t, no, gain), which come document by document.

    asked(q, t, times) is about ASKED_ROWS long at most. A block is a matrix of terms and documents, and a query the sum of
    its rows; of more than TERM_ROWS terms it is a matrix of queries and documents instead, filled term by term.
    """
    rows = asked.orderBy("t", "q").toPandas()
    queries, at = np.unique(rows["q"].to_numpy(np.int64), return_inverse=True)
    t, of = np.unique(rows["t"].to_numpy(np.int64), return_inverse=True)
    by = np.lexsort((of, at))
    shared = known.sparkSession.sparkContext.broadcast((queries, t, np.searchsorted(of, np.arange(len(t) + 1)), at, rows["times"].to_numpy(float), np.searchsorted(at[by], np.arange(len(queries) + 1)), of[by], rows["times"].to_numpy(float)[by]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, terms, edge, at, times, begin, wants, often = shared.value
        best = Best(len(queries), k)
        rows = len(terms) <= TERM_ROWS
        most = max(16, min(MOST_DOCS, BLOCK_SCORES // max(1, len(terms) if rows else min(len(queries), QUERY_BLOCK))))
        by_term = np.argsort(wants, kind="stable")
        plan = begin, wants, often, by_term, np.searchsorted(wants[by_term], np.arange(len(terms) + 1)), _kinds(np.diff(begin), wants, often)
        for part in _by_document(parts, most) if len(queries) else ():
            docs, column = np.unique(part["no"].to_numpy(np.int64), return_inverse=True)
            x, gain = np.searchsorted(terms, part["t"].to_numpy(np.int64)), part["gain"].to_numpy(float)
            some = (x < len(terms)) & (terms[np.minimum(x, len(terms) - 1)] == part["t"].to_numpy(np.int64)) if len(terms) else np.zeros(len(x), bool)
            x, gain, column = x[some], gain[some], column[some]
            if rows:
                _by_rows(best, plan, len(terms), docs, x, gain, column)
                continue
            order = np.argsort(x, kind="stable")
            x, gain, column = x[order], gain[order], column[order]
            cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
            for low in range(0, len(queries), QUERY_BLOCK):
                scores = np.zeros((min(QUERY_BLOCK, len(queries) - low), len(docs)))
                for i, j in pairwise(cuts if len(x) else []):
                    a, b = edge[x[i]], edge[x[i] + 1]
                    a, b = a + np.searchsorted(at[a:b], low), a + np.searchsorted(at[a:b], low + QUERY_BLOCK)
                    if a < b:
                        scores[np.ix_(at[a:b] - low, column[i:j])] += times[a:b, None] * gain[None, i:j]
                _take_all(best, low, scores, docs)
        yield from best.rows(queries)

    return known.mapInPandas(run, "q long, no long, score double")


def _by_rows(best: Best, plan: tuple[np.ndarray, ...], terms: int, docs: np.ndarray, x: np.ndarray, gain: np.ndarray, column: np.ndarray) -> None:
    """Score a block. plan: where each query begins, its terms, how often it has them; rows of these by term, where each term begins; the
    different (term, how often), and of each query which these are.

    Where a term has many of the documents, all sums are made in single precision, and exactly where they may be among the best. Else: a document that comes in makes up, in each term, for what the others can't give at most. So of the term that fewest documents can do this
    in only those are looked at: the first ones by gain.
    """
    begin, wants, often, by_term, edge, tiles = plan
    g = np.zeros((terms, len(docs)))
    g[x, column] = gain
    best.seen += len(docs)
    if best.seen > 32 * best.k + len(docs) and len(x) > TILED * g.size:
        kinds, groups = tiles
        m = g[kinds[0].astype(np.int64)].astype(np.float32)
        m *= kinds[1][:, None].astype(np.float32)
        _put_above(best, _sums_above(m, groups, lambda _low, _high: (best.floor * (1 - SINGLE) - SINGLE).astype(np.float32)), (begin, wants, often), g, docs)
        return
    order = np.lexsort((-gain, x))
    lists, cuts = column[order], np.searchsorted(x[order], np.arange(terms + 1))
    most = g.max(1)[wants] * often
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    whole = np.add.reduceat(most, begin[:-1])
    # a little less than needed, as sums are rounded
    need = (best.floor[of] - (whole[of] - most)) / often - 1e-9
    count = np.empty(len(wants), np.int64)
    for t in range(terms):
        a, b, rows = cuts[t], cuts[t + 1], by_term[edge[t] : edge[t + 1]]
        count[rows] = np.where(need[rows] > 0, np.searchsorted(-gain[order[a:b]], -need[rows], "right"), len(docs))
    least = np.minimum.reduceat(count, begin[:-1])
    first = np.full(len(begin) - 1, len(wants))
    np.minimum.at(first, of, np.where(count == least[of], np.arange(len(wants)), len(wants)))
    go = np.flatnonzero((whole > best.floor - 1e-9) & (least > 0))
    found, sums, hit = [], np.empty(len(docs)), np.empty(len(docs), bool)
    # queries that look at the same term share what is taken out for it
    key = np.where(least[go] < len(docs), wants[first[go]], -1)
    go, key = go[np.lexsort((least[go], key))], np.sort(key)
    for u, v in pairwise(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist() if len(go) else []):
        group, t = go[u:v], int(key[u])
        few = np.arange(len(docs)) if t < 0 else lists[cuts[t] : cuts[t] + least[group[-1]]]
        asked = np.concatenate([wants[begin[i] : begin[i + 1]] for i in group])
        rows, at = np.unique(asked, return_inverse=True)
        part, numbers = np.take(g[rows], few, axis=1), docs[few]
        at, j = at.tolist(), 0
        for i, n, a, b in zip(group.tolist(), least[group].tolist(), begin[group].tolist(), begin[group + 1].tolist(), strict=True):
            out = sums[:n]
            np.multiply(part[at[j], :n], often[a], out=out)
            for x in range(1, b - a):
                row = part[at[j + x], :n]
                np.add(out, row if often[a + x] == 1 else row * often[a + x], out=out)
            j += b - a
            place = np.greater(out, best.floor[i], out=hit[:n]).nonzero()[0]
            if len(place):
                s = out[place]
                if len(place) > 4 * best.k:
                    near = best.near(s)
                    place, s = place[near], s[near]
                found.append((i, s, numbers[place]))
    best.take(found)


def _take_all(best: Best, low: int, scores: np.ndarray, docs: np.ndarray) -> None:
    """Scores of queries from number low on and documents."""
    r, c = np.nonzero(scores > best.floor[low : low + len(scores), None])
    found = []
    for i, j in pairwise(np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]).tolist() if len(r) else []):
        s, at = scores[r[i], c[i:j]], c[i:j]
        if len(s) > 4 * best.k:
            near = best.near(s)
            s, at = s[near], at[near]
        found.append((low + int(r[i]), s, docs[at]))
    best.take(found)


def bucket(token: Column) -> Column:
    """Bucket of a token, the same in any engine that has MD5."""
    return F.conv(F.left(F.md5(token.cast("binary")), F.lit(8)), 16, 10).cast("long") % BUCKETS


def _char_grams(word: Column, n: int) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    # a padded word up to n long stands for itself once, at its smallest n only
    return F.when((F.length(padded) >= n) | F.lit(n == 3), windows).otherwise(F.array().cast("array<string>"))


def hash_embedding(docs: DataFrame, key: str, text: str, chars: bool = True) -> DataFrame:
    """(key, bucket, weight): square roots of hashed counts of 1-2 word grams and, from BUCKETS on, of
    3-5 character grams at half weight, as unit vectors in sparse form. A text without tokens has no row."""
    tokens = F.filter(X.rerank_tokens(F.col(text)), lambda t: ~F.array_contains(X._words(X.BASE_STOP), t))
    t = docs.select(key, tokens.alias("ts"))
    grams = F.when(F.size("ts") >= 2, F.transform(F.sequence(F.lit(0), F.size("ts") - 2), lambda i: F.concat_ws(" ", F.get("ts", i), F.get("ts", i + 1)))).otherwise(F.array().cast("array<string>"))
    words = t.select(key, F.explode(F.concat("ts", grams)).alias("g")).select(key, bucket(F.col("g")).alias("bucket"), F.lit(1.0).alias("by"))
    if chars:
        per_word = docs.select(key, F.explode(X.rerank_tokens(F.col(text))).alias("w"))
        made = per_word.select(key, F.explode(F.concat(*[_char_grams(F.col("w"), n) for n in (3, 4, 5)])).alias("g"))
        words = words.unionByName(made.select(key, (bucket(F.col("g")) + BUCKETS).alias("bucket"), F.lit(0.5).alias("by")))
    counted = words.groupBy(key, "bucket").agg((F.first("by") * F.sqrt(F.count(F.lit(1)))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return counted.select(key, "bucket", (F.col("w") / norm).alias("weight"))


class _Kept(dict):
    """What make gives for a key, kept for those seen lately."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: object) -> object:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _bucket_of(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big") % BUCKETS


@lru_cache(1 << 16)
def _char_buckets(word: str) -> np.ndarray:
    padded = f" {word} "
    return np.array([BUCKETS + _bucket_of(padded[i : i + n]) for n in (3, 4, 5) for i in range(len(padded) - n + 1)])


#: Buckets of a word, its characters' and its own unless it is a stop word; bucket of two words that follow each other.
_of_word = _Kept(lambda w: _char_buckets(w) if w in _STOP else np.r_[_bucket_of(w), _char_buckets(w)], 1 << 16)
_of_pair = _Kept(lambda pair: _bucket_of(" ".join(pair)), 1 << 17)


def unit_vectors(texts: Sequence[str]) -> np.ndarray:
    """(texts, 2 * BUCKETS): hash_embedding with characters, of texts given as tokens with blanks between; zeros without tokens."""
    x = np.zeros((len(texts), 2 * BUCKETS))
    for row, text in enumerate(texts):
        if tokens := text.split():
            pairs = [_of_pair[p] for p in pairwise([t for t in tokens if t not in _STOP])]
            x[row] = np.bincount(np.concatenate([np.array(pairs, np.int64), *[_of_word[t] for t in tokens]]), minlength=2 * BUCKETS)
    np.sqrt(x, out=x)
    x[:, BUCKETS:] *= 0.5
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return x


def hashed_vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """hash_embedding with characters for keys that occur once: (key, bucket, weight), counted in Arrow batches, without a shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 1024):
                p = part.iloc[i : i + 1024]
                x = unit_vectors(p["tokens"].tolist())
                at = [np.flatnonzero(row) for row in x]
                yield pd.DataFrame({key: p[key], "bucket": at, "weight": [row[b] for row, b in zip(x, at, strict=True)]})

    tokens = docs.filter(F.col(text).isNotNull()).select(key, F.array_join(X.rerank_tokens(F.col(text)), " ").alias("tokens"))
    made = tokens.filter("tokens <> ''").mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, bucket array<long>, weight array<double>")
    return made.select(key, F.inline(F.arrays_zip("bucket", "weight")))


#: Queries and documents that are scored at once.
QUERY_BLOCK, DOC_BLOCK = 2048, 2048
#: Queries of a slice at most, of few words each or of any length.
SHORT_QUERIES, LONG_QUERIES = 131_072, 8192
#: Words of a short query on average, and different ones of a slice, at most.
FEW_WORDS, SLICE_WORDS = 12, 4096
#: More than the error of a cosine in single precision.
SINGLE = 2e-5


def _combined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, begin, at, by): the vectors of unit_vectors as few rows each. words are vectors of single words; row i is the sum of by[x] times
    row at[x] of these and, below them, of the unit matrix, for x from begin[i] to begin[i + 1]: its words, then what
    bigrams and buckets that several words share make different."""
    names: dict[str, int] = {}
    for text in texts:
        for t in text.split():
            names.setdefault(t, len(names))
    words = np.zeros((len(names), 2 * BUCKETS))
    for t, x in names.items():
        words[x] = 0.5 * np.sqrt(np.bincount(_char_buckets(t), minlength=2 * BUCKETS))
        if t not in _STOP:
            words[x, _bucket_of(t)] = 1.0
    begin, at, by = [0], [], []
    for text in texts:
        tokens = text.split()
        own = [t for t in tokens if t not in _STOP]
        grams = [_bucket_of(g) for g in (*own, *map(" ".join, pairwise(own)))]
        raw = np.sqrt(np.bincount(np.concatenate([np.array(grams, np.int64), *map(_char_buckets, tokens)]), minlength=2 * BUCKETS))
        raw[BUCKETS:] *= 0.5
        rows = np.array([names[t] for t in dict.fromkeys(tokens)])
        rest = raw - words[rows].sum(0)
        other = np.flatnonzero(np.abs(rest) > 1e-12)
        norm = np.linalg.norm(raw)
        at += [rows, other + len(names)]
        by += [np.full(len(rows), 1 / norm), rest[other] / norm]
        begin.append(begin[-1] + len(rows) + len(other))
    return words, np.array(begin), np.concatenate(at), np.concatenate(by)


#: What a row weighs in a query, before it is made a unit vector, from which on it is added up for all documents.
HEAVY = 0.3
#: Queries and documents whose sums are made at once, numbers of the rows of a block of documents, pairs scored exactly at once, at most.
TILE_QUERIES, TILE_DOCS, BLOCK_ROWS, EXACT_PAIRS = 1024, 256, 10_000_000, 20_000


@dataclass(frozen=True)
class Rows:
    """Queries as sums of rows. words, begin, at, by as _combined gives them. heavy: (row, weight) of the different heavy rows; groups: queries of
    equally many, and which these are; light: (query, bucket, weight) of all other rows; norms: what the sums are divided by."""

    words: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    by: np.ndarray
    norms: np.ndarray
    heavy: tuple[np.ndarray, np.ndarray]
    groups: list[tuple[np.ndarray, np.ndarray]]
    light: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def of(words: np.ndarray, begin: np.ndarray, at: np.ndarray, by: np.ndarray) -> Rows:
        n = np.diff(begin)
        norms = 1 / by[begin[:-1]]  # the first row of a query is that of a word, which weighs 1
        owner, weight = np.repeat(np.arange(len(n)), n), by * np.repeat(norms, n)
        big = (at < len(words)) | (weight > HEAVY)
        kinds, groups = _kinds(np.bincount(owner[big], minlength=len(n)), at[big], weight[big])
        small = ~big
        light = owner[small], at[small] - len(words), weight[small]
        return Rows(words, begin, at, by, norms, (kinds[0].astype(np.int64), kinds[1]), groups, light)


def _kinds(n: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The different pairs of a row and its weight, and _groups of these."""
    kinds, kind = np.unique(np.stack([row.astype(float), np.round(weight, 9)]), axis=1, return_inverse=True)
    return kinds, _groups(n, kind.ravel())


def _groups(n: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(queries, rows of each) for every number of rows that a query has; rows has the n[0] rows of the first query, then those of the next."""
    begin = np.cumsum(n) - n
    return [(q, rows[begin[q][:, None] + np.arange(k)]) for k in np.unique(n).tolist() for q in [np.flatnonzero(n == k)]]


def _sums_above(m: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], needed: Callable[[int, int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, places): where the sum of a query's rows of m is above what is needed from the first to the last place of a tile, which is asked
    for when the tile begins. Tiles are small enough for the caches of a core, and all places of a pair of arrays are in one."""
    for low in range(0, m.shape[1], TILE_DOCS):
        width = min(TILE_DOCS, m.shape[1] - low)
        need = needed(low, low + width)
        tile = np.zeros((len(m), TILE_DOCS), np.float32)
        tile[:, :width] = m[:, low : low + width]
        total, one = np.empty((2, TILE_QUERIES, TILE_DOCS), np.float32)
        hit = np.empty((TILE_QUERIES, TILE_DOCS), bool)
        for queries, rows in groups:
            for i in range(0, len(queries), TILE_QUERIES):
                few, n = rows[i : i + TILE_QUERIES], min(TILE_QUERIES, len(queries) - i)
                s, t, h = total[:n], one[:n], hit[:n]
                np.take(tile, few[:, 0], axis=0, out=s, mode="clip")
                for j in range(1, few.shape[1]):
                    np.take(tile, few[:, j], axis=0, out=t, mode="clip")
                    np.add(s, t, out=s)
                np.greater(s, need[queries[i : i + n], None], out=h)
                some = h.reshape(-1).view(np.uint64).nonzero()[0]  # eight flags at once
                if len(some):
                    where, byte = h.reshape(-1, 8)[some].nonzero()
                    place = some[where] * 8 + byte
                    q, at = queries[i + place // TILE_DOCS], place % TILE_DOCS
                    yield (q, low + at) if width == TILE_DOCS else (q[at < width], low + at[at < width])


def _put_above(best: Best, pairs: Iterator[tuple[np.ndarray, np.ndarray]], queries: tuple[np.ndarray, np.ndarray, np.ndarray], full: np.ndarray, docs: np.ndarray) -> None:
    """Put pairs of a query and a document's place with their exact scores. queries: where each begins, its rows of full, what they weigh."""
    begin, rows, by = queries
    n, low, tile = np.diff(begin), -1, np.empty(0)
    for q, place in pairs:
        if len(q) and place[0] // TILE_DOCS != low:  # numbers of a tile lie together
            low = int(place[0]) // TILE_DOCS
            tile = np.zeros((len(full), TILE_DOCS))
            some = full[:, low * TILE_DOCS : (low + 1) * TILE_DOCS]
            tile[:, : some.shape[1]] = some
            tile = tile.ravel()
        for i in range(0, len(q), EXACT_PAIRS):
            some, at = q[i : i + EXACT_PAIRS], place[i : i + EXACT_PAIRS]
            each = n[some]
            ends = np.cumsum(each)
            x = np.arange(ends[-1]) + np.repeat(begin[some] - ends + each, each)
            score = np.add.reduceat(by[x] * tile.take(rows[x] * TILE_DOCS + np.repeat(at - low * TILE_DOCS, each)), ends - each)
            keep = score > np.maximum(best.floor[some], 1e-12)
            best.put(some[keep], score[keep], docs[at[keep]])
        if best.many > max(200_000, best.k * len(best.floor) // 4):
            best.settle()


def _dense_of_rows(best: Best, made: Rows, vectors: np.ndarray, docs: np.ndarray) -> None:
    """Score a block of documents. Heavy rows are added up in single precision; light rows give at most what their buckets' extremes in the
    block say. What may be among the best by this is scored exactly, and so are all of the first documents."""
    # products of words and documents, below them the vectors of documents
    full = np.concatenate([made.words @ vectors.T, vectors.T])
    if best.seen < 32 * best.k:
        for i, (a, b) in enumerate(pairwise(made.begin.tolist())):
            score = made.by[a:b] @ full[made.at[a:b]]
            few = np.flatnonzero(score > max(best.floor[i], 1e-12))  # what is left of sums that cancel is no score
            if len(few) > 4 * best.k:
                few = few[best.near(score[few])]
            best.put(np.full(len(few), i), score[few], docs[few])
        best.seen += len(docs)
        best.settle()
        return
    row, weight = made.heavy
    m = full[row].astype(np.float32)
    m *= weight[:, None].astype(np.float32)
    of, bucket, light = made.light

    def needed(low: int, high: int) -> np.ndarray:
        part = vectors[low:high]
        most = np.bincount(of, light * np.where(light > 0, part.max(0)[bucket], part.min(0)[bucket]), len(made.norms))
        return ((best.floor - SINGLE) * made.norms - most).astype(np.float32)

    _put_above(best, _sums_above(m, made.groups, needed), (made.begin, made.at, made.by), full, docs)
    best.seen += len(docs)


def sparse_dense(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): cosine of hashed embeddings of words and characters.

    Nearly every pair shares buckets of characters, so every query meets every document. Documents go by blocks past a slice of the
    queries; short queries are sums of few rows of a block (a word's products are shared by all queries that have it), others a matrix
    product. Each part of the documents gives its k best. Memory is that of a slice, a block and the best so far.
    """
    spark = queries.sparkSession
    tokens = lambda: F.array_join(X.rerank_tokens(F.col("text")), " ").alias("text")
    q, d = _numbered(queries, "qid", tokens()), _numbered(docs, "chunk_id", F.col("text"))
    first, same = _alike(q, "text")
    size = first.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0)).alias("words")).first()
    n = size["n"]
    short = size["words"] <= FEW_WORDS * n
    slices = max(1, -(-n // (SHORT_QUERIES if short else LONG_QUERIES)), -(-n * k // HELD))
    parts = d.filter("text is not null").select("no", F.lower("text").alias("low")).repartition(_tasks(spark))
    parts, scored = staged(parts, "parts").repartition(_tasks(spark)) if slices > 1 else parts, None
    for i in range(slices):
        one = _dense_slice(parts, first.filter(F.pmod(F.xxhash64("rep"), F.lit(slices)) == i), k, short)
        scored = one if scored is None else scored.unionByName(one)
    return _named(top_k(scored, k, query="q", key="no").withColumnRenamed("q", "rep").join(same, "rep"), q, d)


def _dense_slice(docs: DataFrame, asked: DataFrame, k: int, short: bool) -> DataFrame:
    """(q, no, score): the k best of each part of docs(no, low) for a slice asked(rep, text) of the queries, which is collected."""
    rows = asked.orderBy("text").toPandas()
    made = _combined(rows["text"].tolist()) if short and len(rows) else None
    made = Rows.of(*made) if made is not None and len(made[0]) <= SLICE_WORDS else None
    shared = docs.sparkSession.sparkContext.broadcast((rows["rep"].to_numpy(np.int64), made, None if made else rows["text"].tolist()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, made, texts = shared.value
        best = Best(len(queries), k)
        width = max(64, min(DOC_BLOCK, BLOCK_ROWS // (len(made.heavy[0]) + len(made.words) + 2 * BUCKETS))) if made else DOC_BLOCK
        for part in _by_document(parts, width) if len(queries) else ():
            ids, x = part["no"].to_numpy(np.int64), np.empty((len(part), 2 * BUCKETS))
            for i in range(0, len(part), 1024):
                # a text without a token gets zeros, which score nothing
                x[i : i + 1024] = unit_vectors([" ".join(TOKEN.findall(low)) for low in part["low"].iloc[i : i + 1024]])
            if made:
                _dense_of_rows(best, made, x, ids)
                continue
            for low in range(0, len(queries), QUERY_BLOCK):
                _take_all(best, low, unit_vectors(texts[low : low + QUERY_BLOCK]) @ x.T, ids)
        yield from best.rows(queries)

    return docs.mapInPandas(run, "q long, no long, score double")


def at_once(*makers: Callable[[], object]) -> list:
    """What the makers give. Their small jobs, and what each plans on the driver, fill the gaps of the others."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(m)) for m in makers]]


def rrf(lists: dict[str, DataFrame], k: int, c: int = RRF_K) -> DataFrame:
    """(qid, chunk_id, score, rank, <name>_rank...): reciprocal ranks of all lists summed; ties by the ranks in the order of lists."""
    parts = None
    for name, df in lists.items():
        one = df.select("qid", "chunk_id", F.lit(name).alias("from"), F.col("rank").alias("r"))
        parts = one if parts is None else parts.unionByName(one)
    ranks = [F.max(F.when(F.col("from") == n, F.col("r"))).alias(f"{n}_rank") for n in lists]
    fused = parts.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (c + F.col("r"))).alias("score"), *ranks)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), *[F.asc_nulls_last(f"{n}_rank") for n in lists], "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_rerank(queries: DataFrame, candidates: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank) of candidates(qid, chunk_id, rank) by coverage, bigrams and rarity among the candidates.

    Candidates that share no term score 0 and stay; ties keep their order.
    """
    q = queries.select("qid", X.rerank_tokens(F.col("text")).alias("q")).select("qid", F.array_distinct("q").alias("qs"), X.bigrams(F.col("q")).alias("qb"))
    # tokens of a document between blanks, in one string: what a query asks for is looked up there, so no lists of documents travel with candidates
    d = docs.select("chunk_id", X.rerank_tokens(F.col("text")).alias("ts")).select("chunk_id", F.size("ts").alias("len"), F.concat(F.lit(" "), F.array_join("ts", " "), F.lit(" ")).alias("said"))
    c = candidates.select("qid", "chunk_id", F.col("rank").alias("was")).join(q, "qid").join(d, "chunk_id")
    within = lambda terms: F.filter(terms, lambda t: F.contains("said", F.concat(F.lit(" "), t, F.lit(" "))))
    c = c.select(
        "qid", "chunk_id", "was", "len", F.size("qs").alias("nq"), within("qs").alias("covered"), F.size(within("qb")).alias("nb"), F.greatest(F.size("qb"), F.lit(1)).alias("nqb"),
    )
    # all that follows is within a query, so its rows move once
    c = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    hits = c.select("*", F.explode_outer("covered").alias("term")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("qid", "term")))
    scored = hits.groupBy("qid", "chunk_id", "was").agg(
        *[F.first(x).alias(x) for x in ("len", "nq", "covered", "nb", "nqb")], F.sum(F.when(F.col("term").isNotNull(), F.log(1 + F.col("n") / (1 + F.col("df"))))).alias("rare"),
    )
    value = (0.6 * F.size("covered") / F.col("nq") + 0.25 * F.col("nb") / F.col("nqb") + 0.15 * F.least(F.col("rare") / 10, F.lit(1.0))) / (
        1 + F.log(1 + F.col("len") / 200)
    )
    scored = scored.withColumn("score", F.when(F.size("covered") > 0, value).otherwise(F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "was")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "chunk_id", "score", "rank")


def search_modes(queries: DataFrame, docs: DataFrame, k: int = TOP_K, candidates: int | None = None, index: Index | None = None) -> dict[str, DataFrame]:
    """What search gives in every one of MODES. Each list is made once: the k best of a list are the first k of the candidates."""
    wide = candidates or max(CANDIDATES, k)
    live = docs.filter(F.lower("status") == "active")
    live_text = live.select("chunk_id", "text")
    lexical, dense = at_once(lambda: staged(bm25(queries, docs, wide, live, index), "lexical"), lambda: staged(sparse_dense(queries, live_text, wide), "dense"))
    fused = staged(rrf({"bm25": lexical, "dense": dense}, wide), "fused")
    first = lambda df: df.filter(F.col("rank") <= k).select("qid", "chunk_id", "score", "rank")
    return {"bm25": first(lexical), "dense": first(dense), "hybrid": first(fused), "hybrid_rerank": lexical_rerank(queries, fused, live_text, k)}


def search(queries: DataFrame, docs: DataFrame, mode: str = "hybrid_rerank", k: int = TOP_K, candidates: int | None = None, include_deprecated: bool = False, index: Index | None = None, reranker: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) of docs(chunk_id, text, status) for all queries(qid, text) at once, with their index if there is one.

    Blank queries and an empty table give no rows; an unknown mode is a ValueError.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    wide = candidates or max(CANDIDATES, k)
    live = docs if include_deprecated else docs.filter(F.lower("status") == "active")
    live_text = live.select("chunk_id", "text")
    if mode == "dense":
        return sparse_dense(queries, live_text, k).select("qid", "chunk_id", "score", "rank")
    lexical = lambda n: bm25(queries, docs.select("chunk_id", "text"), n, live, index)
    if mode == "bm25":
        return lexical(k).select("qid", "chunk_id", "score", "rank")
    found, dense = at_once(lambda: lexical(wide), lambda: sparse_dense(queries, live_text, wide))
    fused = rrf({"bm25": found, "dense": dense}, k if mode == "hybrid" else wide)
    if mode == "hybrid":
        return fused.select("qid", "chunk_id", "score", "rank")
    return (reranker or lexical_rerank)(queries, staged(fused, "fused"), live_text, k)

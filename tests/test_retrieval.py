import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import answers as A
from quillspark.operators import knn, metrics
from quillspark.operators import retrieval as R

DOCS = [
    ("c1", "cooling off period for digital loans is three days. Borrowers may exit a digital loan without penalty in the cooling off period.", "active"),
    ("c2", "credit cards shall not be issued without consent of the customer and a written request.", "active"),
    ("c3", "cyber incidents must be reported within two to six hours to the central office by every bank.", "active"),
    ("c4", "old cooling off period for digital loans was one day under the earlier circular.", "deprecated"),
    ("c5", "", "active"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string, status string")
    queries = spark.createDataFrame([("q1", "cooling off period digital loans"), ("q2", "report cyber incidents hours"), ("q3", ""), ("q4", None)], "qid string, text string")
    return queries, docs


@pytest.mark.parametrize("mode", R.MODES)
def test_search_modes(corpus, mode):
    queries, docs = corpus
    rows = R.search(queries, docs, mode, 3).collect()
    top = {r.qid: r.chunk_id for r in rows if r["rank"] == 1}
    assert top == {"q1": "c1", "q2": "c3"}
    assert "c4" not in {r.chunk_id for r in rows}
    assert "c4" in {r.chunk_id for r in R.search(queries, docs, mode, 5, include_deprecated=True).collect()}


def test_search_rejects_unknown_and_takes_empty(spark, corpus):
    queries, docs = corpus
    with pytest.raises(ValueError, match="unknown mode"):
        R.search(queries, docs, "other")
    assert R.search(queries, docs.limit(0), "hybrid_rerank").count() == 0
    assert R.search(queries.limit(0), docs, "bm25").count() == 0


def test_metrics_hand_values(spark):
    qrels = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q1", "c", 0), ("q2", "a", 1)], "qid string, chunk_id string, grade int")
    run = spark.createDataFrame([("q1", x, i + 1) for i, x in enumerate("axbyz")], "qid string, chunk_id string, rank int")
    m = {r.qid: r for r in metrics.per_query(qrels, run).collect()}
    assert m["q1"].precision == pytest.approx(0.4) and m["q1"].recall == 1 and m["q1"].rr == 1
    assert m["q1"].ndcg == pytest.approx((2 + 1 / math.log2(4)) / (2 + 1 / math.log2(3)))
    assert (m["q2"].precision, m["q2"].recall, m["q2"].ndcg, m["q2"].rr) == (0, 0, 0, 0)
    assert metrics.macro(metrics.per_query(qrels.limit(0), run)).first().mrr == 0


def test_exact_knn(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)] + [(99, None), (98, [1.0])], "k long, v array<float>")
    got = knn.exact_knn(rows.filter("k % 20 = 0"), rows, "k", "v", 3, 8)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    for r in got.collect():
        order = [j for j in np.argsort(-u[r["query"]]) if j != r["query"]]
        assert order[r["rank"] - 1] == r.neighbour


def test_answers_and_faithfulness(spark, corpus):
    queries, docs = corpus
    hits = R.search(queries.filter("qid in ('q1', 'q2')"), docs, "bm25", 3).select("qid", "chunk_id", "rank")
    answered = A.answers(queries, hits, docs)
    rows = {r.qid: r for r in answered.collect()}
    assert "[1]" in rows["q1"].answer and rows["q3"].refused and not rows["q1"].refused
    report = {r.qid: r for r in A.check_answers(answered, hits, docs)[1].collect()}
    assert report["q1"].rate >= 0.5 and report["q3"].rate == 1.0
    made = spark.createDataFrame([("q2", "Cyber incidents must be reported within two to six hours. [1]\nBanks gain unlimited holidays every year. [7]\nCredit is always granted freely everywhere.")], "qid string, answer string")
    r = A.check_answers(made, hits, docs)[1].first()
    assert (r.checked, r.uncited, r.invalid, r.supported) == (3, 1, 1, 1)
    t = spark.createDataFrame([("reported within two to six hours", "reported within ten hours or fifteen", DOCS[2][1])], "good string, bad string, p string")
    good, bad = t.select(A.lexical_support(F.col("good"), F.col("p")), A.lexical_support(F.col("bad"), F.col("p"))).first()
    assert good > 0.6 > bad


def test_dense_takes_words_and_characters(spark, corpus):
    queries, docs = corpus
    inflected = spark.createDataFrame([("q5", "cyberincident reportings"), ("q6", "loan loans, LOAN"), ("q7", "the of"), ("q8", "zz 7")], "qid string, text string")
    asked, text = queries.unionByName(inflected), docs.select("chunk_id", "text")
    sides = [{}, {}]
    for side, df, key in zip(sides, (asked, docs), ("qid", "chunk_id"), strict=True):
        for r in R.hash_embedding(df, key, "text").collect():
            side.setdefault(r[key], {})[r.bucket] = r.weight
    got = {(r.qid, r.chunk_id): r.score for r in R.sparse_dense(asked, text, 9).collect()}
    want = {(a, b): sum(w * y.get(i, 0) for i, w in x.items()) for a, x in sides[0].items() for b, y in sides[1].items()}
    assert got == pytest.approx({pair: s for pair, s in want.items() if s > 0})
    assert max((s, c) for (a, c), s in got.items() if a == "q5")[1] == "c3"


def test_dense_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    monkeypatch.setattr(R, "DOC_BLOCK", 3)
    docs = spark.createDataFrame([(f"c{i:02d}", "same old text" if i % 2 else f"text {i}") for i in range(20)], "chunk_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", "same old text") for i in range(5)], "qid string, text string")
    rows = R.sparse_dense(queries, docs, 4).collect()
    assert {(r.qid, r["rank"], r.chunk_id) for r in rows} == {(f"q{i}", n + 1, f"c{2 * n + 1:02d}") for i in range(5) for n in range(4)}


def test_chunks_are_embedded_whole(spark, corpus, tmp_path):
    from quillspark.plans import retrieval_queries as Q

    docs = corpus[1].unionByName(spark.createDataFrame([("c6", None, "active"), ("c7", "the a 7", "active")], "chunk_id string, text string, status string"))
    docs.selectExpr("chunk_id AS id", "text AS chunk_text", "status").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = {(r.chunk_id, r.bucket): r.weight for r in Q.QUERIES["hash_embed_chunks"](spark, str(tmp_path)).collect()}
    assert rows == pytest.approx({(r.chunk_id, r.bucket): r.weight for r in R.hash_embedding(docs, "chunk_id", "text").collect()}, abs=1e-6)
    assert {k for k, b in rows if b >= R.BUCKETS} == {"c1", "c2", "c3", "c4", "c7"}


def test_uncited_rules_and_invalid_numbers(spark, corpus):
    queries, docs = corpus
    hits = spark.createDataFrame([("q", "c3", 1)], "qid string, chunk_id string, rank int")
    text = "**Cyber incident reporting rules**\nThe following duties apply here:\n- Cyber incidents must be reported\u00a0within two to six hours [1] and [9].\n* Banks gain holidays every year [9].\nToo short [9]."
    made = spark.createDataFrame([("q", text), ("e", None)], "qid string, answer string")
    claims, report = A.check_answers(made, hits, docs)
    got = {r.qid: r for r in report.collect()}
    assert (got["q"].checked, got["q"].supported, got["q"].uncited, got["q"].invalid) == (3, 1, 1, 1) and got["e"].rate == 1.0
    always = A.check_answers(made, hits, docs, judge=lambda c, p: F.lit(False))[1].filter("qid = 'q'").first()
    assert always.supported == 0


def test_providers_fall_back_and_plug_in(spark, corpus):
    from quillspark.operators import providers as P

    queries, docs = corpus
    assert P.embedder("neural").signature == P.embedder("none such").signature == "hashing:1024"
    assert P.reranker("cross-encoder") is R.lexical_rerank and P.answerer("chat") is P.extractive
    rows = P.reembed_all(docs, P.embedder()).collect()
    assert len(rows) == 5 and all(r.embedding_dim == 1024 == len(r.embedding) for r in rows)
    longest = P.cross_rerank(lambda pairs: np.array([len(p) for _, p in pairs]))
    hits = R.search(queries, docs, "hybrid_rerank", 2, include_deprecated=True, reranker=longest).filter("qid = 'q1'").orderBy("rank").collect()
    assert hits[0].chunk_id == "c1"
    full = docs.withColumn("doc_number", F.lit("N")).withColumn("title", F.lit("T")).withColumn("section_ref", F.lit(None).cast("string")).withColumn("published_date", F.lit(None).cast("date"))
    top = R.search(queries, docs, "bm25", 3).select("qid", "chunk_id", "rank")
    said = {r.qid: r for r in P.generated(lambda system, user: "Loans cool off for three days. [1]")(queries, top, full).collect()}
    assert said["q1"].provider == "chat" and said["q1"].answer.startswith("Loans cool") and said["q3"].refused and said["q3"].provider == "extractive"

    def broken(system, user):
        raise OSError

    assert {r.provider for r in P.generated(broken)(queries, top, full).collect()} == {"extractive"}


def test_chat_endpoint_over_http():
    import http.server
    import json
    import threading

    from quillspark.operators import providers as P

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = json.dumps({"choices": [{"message": {"content": body["model"] + ":" + body["messages"][1]["content"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert P.ChatEndpoint(f"http://127.0.0.1:{server.server_port}", "k", "m").complete("s", "u") == "m:u"
    server.shutdown()


def test_judgments_and_benchmark(spark, tmp_path):
    from quillspark.operators import evaluation as E
    from quillspark.sources import files

    chunks = spark.createDataFrame([("c1", "The FEE is due", "D1", "active"), ("c2", "the fee", "D1", "Deprecated"), ("c3", "fee", "D2", "active")], "chunk_id string, text string, doc_number string, status string")
    judged = spark.createDataFrame([("q", "D1", "fee is", 1), ("q", "D1", "fee", 2), ("q", "D2", "toll", 2)], "qid string, doc string, anchor string, grade int")
    qrels, missing = E.resolve_judgments(judged, chunks)
    assert [(r.qid, r.chunk_id, r.grade) for r in qrels.collect()] == [("q", "c1", 2)] and [r.anchor for r in missing.collect()] == ["toll"]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(f'{{"_id": "d{i}", "title": "t{i}", "text": "word{i} common text"}}' for i in range(40)))
    (tmp_path / "queries.jsonl").write_text("\n".join(f'{{"_id": "q{i}", "text": "word{i}"}}' for i in range(4)))
    (tmp_path / "qrels" / "test.tsv").write_text("qid\tdoc\tscore\n" + "\n".join(f"q{i}\td{39 - i}\t1\nq{i}\td{i}\t1" for i in range(4)))
    corpus, queries, rels = E.beir_subset(*files.read_beir(spark, str(tmp_path)), 2)
    assert corpus.count() == 22 and {r.qid for r in queries.collect()} == {"q0", "q1"} and rels.count() == 4
    rows = {r.config: r for r in E.beir_evaluate(corpus, queries, rels, 10).collect()}
    assert set(rows) == set(R.MODES) and rows["bm25"].mrr == 1.0 and rows["bm25"].queries == 2
    table = E.write_results(spark, E.per_query(qrels, spark.createDataFrame([("q", "c1", 1)], "qid string, chunk_id string, rank int"), 5, "one"), str(tmp_path / "out"), "run")
    assert "| one | 0.200 | 1.000 |" in table and spark.read.parquet(str(tmp_path / "out" / "per_query")).count() == 1


def test_stored_index_gives_the_same(spark, corpus, tmp_path):
    queries, docs = corpus
    R.build_index(docs.select("chunk_id", "text")).write(str(tmp_path / "ix"))
    stored = R.Index.read(spark, str(tmp_path / "ix"))
    row = lambda df: sorted((r.qid, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert row(R.search(queries, docs, "bm25", 3, index=stored)) == row(R.search(queries, docs, "bm25", 3))


def test_bm25_in_small_blocks_and_without_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(30)])
    docs = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(200)], "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, 3))) for i in range(9)], "qid string, text string")
    row = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    whole = row(R.bm25(queries, docs, 5))
    monkeypatch.setattr(R, "BLOCK_SCORES", 1)
    blocks = row(R.bm25(queries, docs, 5))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    assert whole == blocks == row(R.bm25(queries, docs, 5)) and len(whole) == 45


def test_queries_beyond_one_slice_and_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(40)])
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(300)]
    docs = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)
    asked = [" ".join(rng.choice(words, n % 5)) for n in range(30)]
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*asked, *[" ".join(reversed(t.split())) for t in asked]])], "qid string, text string")
    row = lambda df: {(r.qid, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in df.collect()}
    plain = row(R.bm25(queries, docs, 6))
    # by hand: the sum over terms of each query, joined
    index = R.build_index(docs)
    n, avg = index.corpus.first()
    idf = {r.term: r.idf for r in index.weights.collect()}
    want = {}
    for i, t in enumerate(asked):
        scores = [(-round(sum(idf[w] * d.split().count(w) * 2.5 / (d.split().count(w) + 1.5 * (0.25 + 0.75 * len(d.split()) / avg)) for w in t.split() if w in idf and w in d.split()), 6), f"c{j:03d}") for j, d in enumerate(texts)]
        for rank, (s, c) in enumerate(sorted(x for x in scores if x[0] < 0)[:6]):
            want |= {(f"q{i + m}", rank + 1): (c, -s) for m in (0, 30)}
    assert {k: c for k, (c, _) in plain.items()} == {k: c for k, (c, _) in want.items()}
    assert n == 300 and {k: s for k, (_, s) in plain.items()} == pytest.approx({k: s for k, (_, s) in want.items()}, abs=2e-6)
    dense = row(R.sparse_dense(queries, docs, 6))
    for name, value in (("ASKED_ROWS", 30), ("FIRST_DOCS", 7), ("MOST_DOCS", 50)):
        monkeypatch.setattr(R, name, value)
    assert row(R.bm25(queries, docs, 6)) == plain
    monkeypatch.setattr(R, "TERM_ROWS", 0)
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    assert row(R.bm25(queries, docs, 6)) == plain
    monkeypatch.setattr(R, "HELD", 60)
    assert row(R.sparse_dense(queries, docs, 6)) == dense
    monkeypatch.setattr(R, "FEW_WORDS", 0)
    assert row(R.sparse_dense(queries, docs, 6)) == dense


def test_modes_at_once(corpus):
    queries, docs = corpus
    row = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    at_once = R.search_modes(queries, docs, 2)
    assert set(at_once) == set(R.MODES)
    for mode in R.MODES:
        assert row(at_once[mode]) == row(R.search(queries, docs, mode, 2))


def test_dense_sums_of_rows_equal_products(monkeypatch):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}{'ab' * (i % 3)}" for i in range(30)] + ["the", "and"]
    made = lambda n, low, high: sorted({" ".join(rng.choices(vocabulary, k=rng.randint(low, high))) for _ in range(n)})
    queries, docs = made(60, 1, 6), made(900, 3, 40)
    vectors, want = R.unit_vectors(docs), R.Best(len(queries), 3)
    R._take_all(want, 0, R.unit_vectors(queries) @ vectors.T, np.arange(len(docs)))
    summed = []
    above = R._sums_above
    monkeypatch.setattr(R, "_sums_above", lambda *a: (summed.append((q, at)) or (q, at) for q, at in above(*a)))
    for queries_at_once, docs_at_once, pairs in ((1024, 256, 20_000), (7, 16, 5)):
        for name, value in (("TILE_QUERIES", queries_at_once), ("TILE_DOCS", docs_at_once), ("EXACT_PAIRS", pairs)):
            monkeypatch.setattr(R, name, value)
        rows, best = R.Rows.of(*R._combined(queries)), R.Best(len(queries), 3)
        for i in range(0, len(docs), 100):
            R._dense_of_rows(best, rows, vectors[i : i + 100], np.arange(i, min(i + 100, len(docs))))
        best.settle()
        assert (best.no == want.no).all() and np.allclose(best.score, want.score)
    # tiles found some pairs, and most were never scored exactly
    assert 0 < sum(len(q) for q, _ in summed) < len(queries) * 800


def test_bm25_sums_in_tiles_equal_lists(monkeypatch):
    rng = np.random.default_rng(8)
    terms, docs, queries = 20, 600, 50
    wants = [np.sort(rng.choice(terms, rng.integers(1, 5), replace=False)) for _ in range(queries)]
    n, want = np.array([len(w) for w in wants]), np.concatenate(wants)
    often = rng.integers(1, 3, len(want)).astype(float)
    by_term = np.argsort(want, kind="stable")
    plan = np.r_[0, np.cumsum(n)], want, often, by_term, np.searchsorted(want[by_term], np.arange(terms + 1)), R._kinds(n, want, often)
    gains = np.where(rng.random((terms, docs)) < 0.4, np.round(rng.random((terms, docs)), 2), 0)  # ties
    used, above = [], R._sums_above
    monkeypatch.setattr(R, "_sums_above", lambda *a: used.append(a) or above(*a))
    found = []
    for share in (0.05, 2.0):
        monkeypatch.setattr(R, "TILED", share)
        best = R.Best(queries, 3)
        for i in range(0, docs, 100):
            x, column = np.nonzero(gains[:, i : i + 100])
            R._by_rows(best, plan, terms, np.arange(i, i + 100), x, gains[x, i + column], column)
        best.settle()
        found.append(best)
    assert len(used) == 5 and (found[0].no == found[1].no).all() and np.allclose(found[0].score, found[1].score)
    every = np.array([often[a:b] @ gains[want[a:b]] for a, b in zip(plan[0][:-1], plan[0][1:], strict=True)])
    for i, s in enumerate(np.rint(every * 1e6)):
        top = np.lexsort((np.arange(docs), -s))[:3]
        assert (found[0].no[i] == top).all()


def test_lists_are_made_at_once(spark, corpus, monkeypatch):
    queries, docs = corpus
    both, seen = threading.Barrier(2, timeout=60), []
    for name in ("bm25", "sparse_dense"):
        def wait(*args, made=getattr(R, name), name=name):
            both.wait()  # breaks where one waits for the other's end
            seen.append(name)
            return made(*args)

        monkeypatch.setattr(R, name, wait)
    got = R.search(queries, docs, "hybrid", 3).collect()
    modes = R.search_modes(queries, docs, 3)
    assert sorted(seen) == ["bm25", "bm25", "sparse_dense", "sparse_dense"] and sorted(got) == sorted(modes["hybrid"].collect())


def test_index_counts_where_texts_are(spark, tmp_path):
    texts = [("c1", "The Rate of 4.5.a, rate; \u212aELVIN may"), ("c2", None), ("c3", "the of"), ("c4", "Dr. Who v1.2. x")]
    docs = spark.createDataFrame(texts, "chunk_id string, text string")
    index = R.build_index(docs)
    want = docs.select("chunk_id", F.coalesce(X.bm25_tokens(F.col("text")), F.array().cast("array<string>")).alias("ts")).collect()
    names = {r.no: (r.chunk_id, r.dl) for r in index.docs.collect()}
    assert sorted(names.values()) == sorted((r.chunk_id, len(r.ts)) for r in want)
    assert sorted((names[r.no][0], r.term, r.tf) for r in index.postings.collect()) == sorted((r.chunk_id, t, r.ts.count(t)) for r in want for t in set(r.ts))


def test_floors_rise_within_a_block():
    rng = np.random.default_rng(5)
    full, best = rng.random((8, 64 * R.TILE_DOCS)), R.Best(200, 4)
    begin, rows = np.arange(0, 402, 2), np.stack([rng.choice(8, 2, replace=False) for _ in range(200)]).ravel()
    queries = begin, rows, np.ones(400)
    floors = []

    def needed(low, high):
        floors.append(best.floor.sum())
        return best.floor.astype(np.float32) - 1e-4

    R._put_above(best, R._sums_above(full.astype(np.float32), R._groups(np.diff(begin), rows), needed), queries, full, np.arange(full.shape[1]))
    best.settle()
    every = full[rows[::2]] + full[rows[1::2]]
    assert floors[-1] > floors[0] == 0 and np.allclose(best.score, -np.sort(-every, axis=1)[:, :4])

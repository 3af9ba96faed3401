import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lookalike, mixture, neighbours, packing, pieces, quality, retyped, revisions, tokens

LONG = "Every bank is advised to keep the ledger. " * 3000


# 1 retyped ---------------------------------------------------------------------------------------
def test_retyped(spark):
    base = "Ref: A-1\nDate: 2 May\n\nDear Sir,\nThe on-site ledger shall be kept."
    rows = [
        ("a", base), ("b", "date  2 May\nREF: a 1\n \nDear sir The ON SITE ledger; shall be kept"), ("c", base.replace("\n", "\r\n")),
        ("d", base.replace("on-site", "onsite")), ("e", base.replace("ledger", "lеdger")), ("f", None), ("g", ""), ("h", "  \n "), ("i", LONG), ("j", LONG.upper()),
        ("k", base.replace("Dear Sir,\nThe", "The\nDear Sir,")), ("z", base), ("z", base),
    ]
    df = spark.createDataFrame(rows, "id string, raw_text string").withColumn("print", F.lit("clash")).withColumn("copies", F.lit(9))
    pairs = {(r.id_a, r.id_b) for r in retyped.retyped_pairs(df).collect()}
    same = ["a", "b", "c", "z"]
    assert pairs == {*itertools.combinations(same, 2), ("g", "h"), ("i", "j")}
    sizes = {r.keep: (r.copies, r.collision) for r in retyped.collapse(df, "id", "raw_text").collect()}
    assert sizes["a"] == (5, False) and sizes["d"] == (1, False) and sum(n for n, _ in sizes.values()) == 12
    assert retyped.retyped_pairs(df.limit(0)).count() == 0


def test_retyped_large_group_is_cut(spark, monkeypatch):
    monkeypatch.setattr(retyped, "PAIR_BLOCK", 7)
    df = spark.createDataFrame([(f"{i:03d}", "Same  text" if i % 2 else "same text!") for i in range(40)], "id string, raw_text string")
    assert retyped.retyped_pairs(df).count() == retyped.retyped_pairs(df).distinct().count() == 780


# 2 look-alikes -----------------------------------------------------------------------------------
SAME = [("é", "é"), ("ｆｕｌｌ", "full"), ("ﬁne", "fine"), ("a​b", "ab"), ("a\xa0b", "a b"), ("сору", "copy"), ("on‑site", "on-site"), ("ệ", "ệ"), ("e‍́", "é"), ("①", "1")]
OTHER = [("A", "a"), ("a b", "a  b"), ("e", "é"), ("a–b", "a-b"), ("“a”", '"a"'), ("a\nb", "a b"), ("1", "l")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert lookalike.consistent(a) == lookalike.consistent(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert lookalike.consistent(a) != lookalike.consistent(b)


def test_exploded_operator_equals_plain_form(spark):
    random.seed(5)
    odd = [x for p in SAME for x in p] + ["한글", "ﬃ", "́", "​", "​́x", "ậ", "Å̧", "\U0001d400", "힣ᆨ", "", "plain", "ﷺ"]
    texts = odd + ["".join(random.choice(odd) + random.choice([" ", "", "\n", "x"]) for _ in range(random.randrange(30))) for _ in range(150)] + [LONG + "ｅ́"]
    rows = [("f", str(i), t) for i, t in enumerate(texts)] + [("f", "null", None), ("g", "0", "é"), ("f", "0", texts[0])]
    df = spark.createDataFrame(rows, "field string, id string, text string").withColumn("stretch", F.lit(1))
    got = lookalike.consistent_texts(df.select("field", "id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.form == (None if r.text is None else lookalike.consistent(r.text, lookalike.translation(spark))), repr(r.text[:50])


def test_same_looking_pairs(spark):
    rows = [("f", "a", "café"), ("f", "b", "café"), ("f", "c", "café"), ("f", "d", "cafe"), ("g", "e", "café"), ("f", "n", None)]
    df = spark.createDataFrame(rows, "field string, id string, text string")
    assert {tuple(r) for r in lookalike.same_looking_pairs(df).collect()} == {("f", "a", "b"), ("f", "b", "c")}
    assert lookalike.same_looking_pairs(df.limit(0)).count() == 0


# 3 revisions -------------------------------------------------------------------------------------
def _brute(rows, size=3):
    def words(t):
        return re.findall(r"[^\W_]+", lookalike.consistent(t).lower())

    sets = [(i, f, lookalike.consistent(t), {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}) for i, f, t in ((i, f, t) for f, i, t in rows if t is not None) for w in [words(t)]]
    out = set()
    for (i, f, x, s), (j, g, y, t) in itertools.combinations(sets, 2):
        if f == g and i != j and x != y and s and t and len(s & t) >= 0.6 * len(s | t):
            out.add((f, *sorted((i, j))))
    return out


def _revision_rows(n, seed):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünit", "é"]
    rows = []
    for k in range(n):
        base = [random.choice(vocab) for _ in range(random.choice([2, 5, 20, 60, 200]))]
        for v in range(random.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(random.randrange(4)):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append(("raw" if k % 3 else "chunk", f"{k:03d}{v}", " ".join(w)))
    return rows + [("raw", "x1", None), ("raw", "x2", ""), ("raw", "x3", "one two"), ("raw", "x4", LONG), ("raw", "x5", LONG + " end of it all")]


@pytest.mark.parametrize(("crowd", "hot_from", "block"), [(256, 4096, 1 << 18), (256, 4096, 8), (2, 4096, 8), (256, 0, 8)])
def test_revised_pairs_against_brute_force(spark, crowd, hot_from, block):
    # a crowd of 2: nearly every route goes through the trees; hot from 0: every shingle does; blocks of 8: many cells
    rows = _revision_rows(60, 1)
    df = spark.createDataFrame([(*r, None) for r in rows], "field string, id string, text string, print binary")
    got = {tuple(r) for r in revisions.revised_pairs(df, crowd=crowd, hot_from=hot_from, block=block).collect()}
    assert got == _brute(rows)


def test_route_pairs_keep_64_bit_numbers():
    big = (1 << 40) + np.arange(4)
    a, b, crowds = revisions.route_pairs(np.array([7, 7, 7, 8], np.uint64), big, np.zeros(4, np.int64), np.full(4, 9), 0.6)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(big[0], big[1]), (big[0], big[2]), (big[1], big[2])} and not crowds


def test_hot_group_of_near_copies_is_tiled(spark):
    rows = [("raw", f"{i:04d}", "every bank shall keep one ledger of all loans and show it to the board each month " + f"note {i}") for i in range(300)]
    df = spark.createDataFrame([(*r, None) for r in rows], "field string, id string, text string, print binary")
    assert revisions.revised_pairs(df, crowd=16, hot_from=100).count() == 300 * 299 // 2


def test_revised_pairs_copies_are_left_out(spark):
    t = "the bank shall keep a ledger of all loans and report it every month to the board"
    rows = [("raw", "a", t, b"1"), ("raw", "b", t + "!", b"1"), ("raw", "c", t.replace("bank", "bаnk"), b"2"), ("raw", "d", t.upper(), b"3"), ("raw", "e", t, b"1")]
    df = spark.createDataFrame(rows, "field string, id string, text string, print binary")
    got = {(r.id_a, r.id_b) for r in revisions.revised_pairs(df).collect()}
    assert got == {("a", "d"), ("b", "d"), ("b", "c"), ("c", "d"), ("d", "e")}
    assert revisions.revised_pairs(df.limit(0)).count() == 0


def test_tree_join_and_bound_lose_nothing():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = rng.choice(pool, rng.integers(20, 300), replace=False)
        sets += [np.unique(s), np.unique(np.r_[s[: int(len(s) * 0.9)], rng.choice(pool, 5)])]
    p = revisions.Points(np.arange(len(sets)), np.array([len(s) for s in sets]), [revisions.point_bytes(s) for s in sets])
    i, j = revisions.tree_join(p, p, 0.6, True)
    found = set(zip(i.tolist(), j.tolist(), strict=True)) | set(zip(j.tolist(), i.tolist(), strict=True))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if both >= 0.6 * (len(sets[a]) + len(sets[b]) - both):
            assert (a, b) in found
    assert len(found) < 0.2 * len(sets) ** 2


# 4 neighbours ------------------------------------------------------------------------------------
def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    x[:300] = x[300:600] + 0.1 * rng.normal(size=(300, 64))
    x[:20] = x[20]  # exact copies
    rows = [(f"{i:05d}", [float(v) for v in x[i]]) for i in range(1500)]
    rows += [("n", None), ("z", [0.0] * 64), ("s", [1.0] * 32), ("q", [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("cell", F.lit(1))
    got = neighbours.nearest(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, {})[r.neighbour] = r.cosine
    assert set(by) == {r[0] for r in rows[:1500]} and all(len(v) == 5 and k not in v for k, v in by.items())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    fifth = -np.partition(-s, 4, axis=1)[:, 4]
    hits = sum(s[int(k), int(n)] >= fifth[int(k)] - 1e-5 for k, v in by.items() for n in v)
    assert hits / (5 * 1500) >= 0.9
    pairs = {tuple(r) for r in neighbours.close_pairs(neighbours.nearest(df, plan=neighbours.Plan(least=0.9, block=256)), 0.9).collect()}
    assert {(f"{i:05d}", f"{i + 300:05d}") for i in range(21, 300)} <= pairs
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.limit(1)).count() == 0


def test_neighbours_of_a_large_group_of_near_copies():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + 0.15 * rng.normal(size=(1000, 64)) * np.linalg.norm(x[0]) / 8
    x[1000:1040] = x[1000]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -2)
    fifth = -np.partition(-s, 4, axis=1)[:, 4]
    for first_cells in (2048, 16):
        plan = neighbours.Plan(first_cells=first_cells)
        index = neighbours.Index.fit(x, 64, plan)
        cell = index.assign(x)
        q, n, cosine = neighbours.search_block(index, plan, x, x, cell, index.code(x, cell), np.full(3000, -9, np.float32), np.arange(3000))
        assert (q != n).all() and cosine == pytest.approx(s[q, n])
        assert (np.bincount(q) == 5).all() and (s[q, n] >= fifth[q] - 1e-9).all()


def test_revisions_drop_what_is_no_longer_read(spark):
    from pathlib import Path

    from quillspark.session import shared_dir

    text = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame([("t", 1, text, None), ("t", 2, f"{text} end", None), ("t", 3, "other words than these", None)], "field string, id long, text string, print string")
    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    before = there()
    got = revisions.revised_pairs(texts)
    left = {name.split("-")[0] for name in there() - before}
    assert {"rows", "chosen", "possible"} <= left and not {"words", "met"} & left
    assert [tuple(r) for r in got.collect()] == [("t", 1, 2)]


def test_neighbours_move_vectors_once(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[1500:] = x[:1500] + 0.02 * rng.normal(size=(1500, 64))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    moved = []
    for block in (1500, 125):
        before = written()
        got = neighbours.nearest(rows, plan=neighbours.Plan(least=0.9, block=block)).select("id", "neighbour", "cosine").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        moved.append(written() - before)
        assert {(r.id, r.neighbour) for r in got} == {(i, (i + 1500) % 3000) for i in range(3000)}
    assert moved[1] < 2 * moved[0]


def test_search_holds_nothing_below_the_least():
    x = np.random.default_rng(3).normal(size=(400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = neighbours.Plan(least=0.3)
    index = neighbours.Index.fit(x, 8, plan)
    cell = index.assign(x)
    q, n, cosine = neighbours.search_block(index, plan, x, x, cell, index.code(x, cell), np.full(400, -9, np.float32), np.arange(400))
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.3}
    assert set(zip(q.tolist(), n.tolist(), strict=True)) == want and cosine.min() >= 0.3


def test_neighbours_of_copies_and_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[:150] = x[0]
    rows = [(f"{i:03d}", [float(v) * (1 + i % 2) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    got = neighbours.nearest(df, plan=neighbours.Plan(block=50, recall=1.0, judged=400))
    assert got.count() == 2000 and got.filter("id < '150' and cosine < 0.99999").count() == 0
    assert neighbours.recall(df, got).collect()[0].recall == 1.0


# 5 pieces ----------------------------------------------------------------------------------------
def test_pieces_round_trip_limits_and_stability(spark):
    random.seed(6)
    text = "\n\n".join(f"{k}. Head {k}\n" + " ".join(f"Bank {random.randrange(999)} shall file form {random.choice('ABCDE')}-{random.randrange(99)}." for _ in range(random.randrange(5, 60))) for k in range(1, 30))
    for t in (text, LONG, "x" * 5000, "- " * 900, "한 " * 800):
        made = pieces.split_text(t)
        assert "".join(t[f:e] for _, _, _, f, e, _ in made) == t
        assert all(len(pieces.WORD_OR_MARK.findall(p)) == n <= 350 and p == t[b:e] for p, n, b, _, e, _ in made)
        assert all(len(pieces.WORD_OR_MARK.findall(t[b:f])) == 60 for _, _, b, f, _, _ in made[1:])
    starts = {text[f:e] for _, _, _, f, e, _ in pieces.split_text(text)}
    edited = {text[:3000] + " One more word. " + text[3000:]}.pop()
    changed = [1 for _, _, _, f, e, _ in pieces.split_text(edited) if edited[f:e] not in starts]
    assert len(changed) <= 4 < len(starts) / 3
    assert all(level > 0 for *_, level in pieces.split_text(text))
    wrapped = "\n\n".join("and more text here that goes on\nfrom line to line, as wrapped prose does.\nit has no heading\n" * 7 for _ in range(12))
    assert {level for *_, level in pieces.split_text(wrapped)[1:]} == {2}
    df = spark.createDataFrame([("a", "s", text), ("b", None, "short"), ("c", None, None), ("d", "", ""), ("a", "s", text)], "id string, section_ref string, t string").withColumn("piece", F.lit(0))
    rows = pieces.split_rows(df, ["id", "section_ref"], "t").collect()
    assert {r.id for r in rows} == {"a", "b"} and all(r.section_ref == "s" for r in rows if r.id == "a")
    assert {r.id for r in pieces.split_rows(df, ["id"], "t", whole=False).collect()} == {"a"}
    with pytest.raises(ValueError):
        pieces.split_rows(df, ["id"], "t", overlap=350)


# 7 packing ---------------------------------------------------------------------------------------
def test_packing(spark):
    random.seed(7)
    rows = [(i, random.choice([0, 1, 3, 100, 100, 100, 683, 1024, 1025, 1500, 2047, 2048, 2049, 7000])) for i in range(2000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, size long").withColumn("rank", F.lit(1))
    got = packing.pack(df, ["doc_id"]).collect()
    room, total = {}, {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.size
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
    assert max(room.values()) <= 2048 and total == {i: s or 0 for i, s in rows}
    assert len({(r.doc_id, r.piece) for r in got}) == len(got)
    cut = {r.doc_id for r in got if r.piece > 0}
    assert cut == {i for i, s in rows if s and s > 2048}
    filled = packing.fill_report(packing.pack(df.filter("size between 1 and 700"), ["doc_id"])).first()
    assert filled.containers <= filled.least_containers * 1.02 + 1
    assert packing.pack(df.limit(0), ["doc_id"]).count() == 0
    left = np.bincount([900, 900, 800, 700, 683, 683])
    assert packing.class_bins(np.r_[left, np.zeros(2048, int)], 2) == [(1, {900: 2}), (1, {800: 1, 700: 1}), (1, {683: 2})] and packing.harmonic_class(683) == 2
    plan = packing.plan_containers({700: 5, 600: 5, 40: 50})
    assert sum(n * c.get(40, 0) for n, c in plan) == 50 and all(sum(s * k for s, k in c.items()) <= 2048 for _, c in plan)


# 8 mixture ---------------------------------------------------------------------------------------
def test_mixture(spark):
    random.seed(8)
    docs = [(i, random.choice(["Big", "big ", "BIG", "small", "other", None]), random.randrange(1, 60)) for i in range(4000)] + [(5000, "tiny", 40), (5001, "big", None), (5002, "big", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").withColumn("finish", F.lit(0))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    big = mixture.mix(df, targets, budget=20000)
    used = big.groupBy("doc_id", "source").count().collect()
    limit = {"big": 1, "small": 2, "tiny": 4}
    assert all(r["count"] <= limit[r.source] for r in used) and big.agg(F.sum("size")).first()[0] <= 20000
    for budget in (1, 700, 20000, 10**9):  # the copies left unmade change nothing
        lazy = {tuple(r) for r in mixture.mix(df, targets, budget=budget).collect()}
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixture, "_last_time", lambda *_: 1e18)
            assert lazy == {tuple(r) for r in mixture.mix(df, targets, budget=budget).collect()}
    exact = mixture.mix(df, targets)
    share = {r.source: r for r in mixture.shares(exact, targets).collect()}
    assert share["tiny"].most_copies == 4 and share["absent"].tokens == 0
    assert abs(share["big"].actual_share - 0.5 / 0.9) < 0.05 and abs(share["small"].actual_share - 0.3 / 0.9) < 0.05
    assert mixture.mix(df.limit(0), targets).count() == 0 and mixture.mix(df, targets.limit(0)).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    assert {r.doc_id: r.size for r in tokens.token_sizes(df, ["doc_id"]).collect()} | {4: 0} == {1: 2, 2: 0, 3: 0, 4: 0}


# 9 quality ---------------------------------------------------------------------------------------
COMMON = {"en": "a all and any are as at be by for from has if in is it may must no not of on or shall that the this to under was which will with".split(), "de": "das dem den der des die ein eine für ist mit nicht sie und von werden zu".split()}
PROSE = ["The board of the bank shall review the policy every year. It may ask for a report on any matter that is not settled.", "1.1 No bank shall withhold a notice.\n1.2 The notice must be sent to the customer in a month.", "die bank ist mit dem kunden und der kasse nicht\nim reinen und die frist ist von der prüfung\nfür eine einlage zu lang."]
JUNK = ["", "...", None, "loading " * 40, "aGVsbG8gd29ybGQhIQ/" * 40, "Home | Help | Contact | Search | Home", "12:01:33 ERR 0x1 a.b:3 rc=0\n12:01:34 ERR 0x2 a.c:9 rc=1", "- loan ledger\n- card register\n- branch voucher\n- agent premium", "Name,Form,Due\nloan,3,12\ncard,4,88\nfee,9,1", "a | b | c\nloan | 3 | 4\ncard | 5 | 6", "red loan, blue card, green fee, deferred ledger, idle branch, audited voucher, open claim", "=====\n-----\n#####"]


def test_quality(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE + JUNK)], "doc_id long, text string").withColumn("profile", F.lit("x"))
    words = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v], "lang string, word string")
    rows = {r.doc_id: r for r in quality.text_quality(docs, words).collect()}
    wrong = [(i, t) for i, t in enumerate(PROSE + JUNK) if rows[i].is_prose != (i < len(PROSE))]
    assert not wrong
    plain = quality.Measure(COMMON)
    assert [quality.measure_batch([t], plain).n_words[0] for t in ("{{ }}", "<div class='x'><p>one two</p></div>")] == [0, 2]
    assert rows[0].n_words == 24 and rows[3].n_words == 0 and rows[3].profile == "empty"
    assert quality.text_quality(docs.limit(0), words).count() == 0
    said = {"en": ["the bank of the town and all that was with it"] * 4, "de": ["die bank ist mit dem kunden und der kasse"] * 4}
    labelled = spark.createDataFrame([(i, t, lang.upper()) for i, (lang, t) in enumerate((k, t) for k, ts in said.items() for t in ts)] + [(90, "die frist der kasse", None), (91, "of the town", "und"), (92, "xyz", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.text_quality(labelled, words, lang="lang").collect()}
    assert [got[i].language for i in (0, 5, 90, 91, 92)] == ["en", "de", "de", "en", None] and got[0].language_divergence < 0.01


def test_every_mapping_is_stable(spark):
    table = lookalike.translation(spark)
    assert len(table) > 7_000
    for cp, new in lookalike.mapping(spark)[::3]:
        once = lookalike.consistent(chr(cp), table)
        assert lookalike.consistent(once, table) == once, hex(cp)
        assert unicodedata.normalize("NFC", "".join(map(chr, new))) == once
    show = lambda t: lookalike.consistent(t, table)
    assert show("ραυ") == "pau" and show("тк") == show("τκ") and show("М٥о") == "Moo"
    assert len({show(c) for c in "1lI|0Oo"}) == 7 and show("ІӀ") == "II" and show("中国 한글 é ñ") == "中国 한글 é ñ"


def test_same_looking_group_is_cut(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PAIR_BLOCK", 3)
    df = spark.createDataFrame([("f", f"{i:02d}", "a" + "\u200b" * i) for i in range(20)], "field string, id string, text string")
    assert lookalike.same_looking_pairs(df).count() == lookalike.same_looking_pairs(df).distinct().count() == 190


def test_language_profiles_count_every_document(spark):
    from quillspark.llm import quality

    # one of 9000 documents has a word that no other has
    docs = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id = 77 THEN 'the rare upon' ELSE 'the cat' END AS text", "CASE WHEN id % 2 = 0 THEN ' EN' ELSE 'en' END AS lang")
    docs = docs.unionByName(spark.createDataFrame([(9001, None, "en"), (9002, "le the upon", "fr"), (9003, "upon", None)], "doc_id long, text string, lang string"))
    got = quality.language_profiles(docs, {"en": ["the", "upon"], "fr": ["le"]}, "text", "lang")
    assert got == {"en": {"the": 9000 / 9001, "upon": 1 / 9001}, "fr": {"le": 1.0}}

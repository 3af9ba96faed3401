import random

from pyspark.sql import functions as F

from quillspark.operators import hierarchy as H
from quillspark.operators.prefix import running_total


def brute(parent):
    out = {}
    for n in parent:
        seen, c = [n], n
        while parent[c] is not None and parent[c] not in seen:
            c = parent[c]
            seen.append(c)
        out[n] = None if parent[c] is not None else seen
    return out


def test_labels_paths_and_descendants(spark):
    random.seed(3)
    parent = {f"n{i:03d}": None if random.random() < 0.1 else f"n{random.randrange(i):03d}" if i else None for i in range(120)}
    parent |= {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(40)}  # a chain
    parent |= {"x1": "x2", "x2": "x3", "x3": "x1", "x4": "x1", "self": "self"}  # cycles and a node below one
    rows = spark.createDataFrame([(k, v) for k, v in parent.items()], "node string, parent string")
    labels = H.heavy_paths(rows).cache()
    want = brute(parent)
    for r in labels.collect():
        way = want[r.node]
        assert (r.root, r.depth) == (("cycle", -1) if way is None else (way[-1], len(way) - 1)), r.node
    paths = {r.node: r.path for r in H.full_paths(labels).collect()}
    assert paths == {n: None if w is None else " > ".join(reversed(w)) for n, w in want.items()}
    got = {(r.node, r.descendant) for r in H.descendants(labels).collect()}
    assert got == {(a, n) for n, w in want.items() if w for a in w[1:]}
    place = {(r.root, r.first): r.node for r in labels.filter("head is not null").collect()}
    for r in labels.filter("head is not null").collect():
        assert {place[r.root, i] for i in range(r.first + 1, r.last + 1)} == {d for a, d in got if a == r.node}


def test_empty_and_null_and_star(spark):
    empty = spark.createDataFrame([], "node string, parent string")
    assert H.heavy_paths(empty).count() == 0
    star = spark.createDataFrame([("r", None)] + [(f"k{i}", "r") for i in range(300)], "node string, parent string")
    assert H.heavy_paths(star).filter("depth = 1 and root = 'r'").count() == 300


def test_parent_links_rules(spark):
    rows = spark.createDataFrame(
        [("A", None, " b "), ("B", "nobody", None), ("c", " A", None), ("D", None, "B"), (None, "A", None), ("e", "", None)],
        "id string, supersedes_id string, superseded_by_id string",
    ).withColumn("parent", F.lit("clash"))
    got = {r.id: r.parent for r in H.parent_links(rows).collect()}
    assert got == {"A": None, "B": "a", "c": "a", "D": None, "e": None}


def test_running_total_hot_key_nulls_and_clashes(spark):
    rows = [("hot", i, 1, "x") for i in range(500)] + [("cold", i, i, "y") for i in range(5)] + [(None, 0, None, "z")]
    df = spark.createDataFrame(rows, "k string, o int, v int, part string")
    got = {(r.k, r.o): r.s for r in running_total(df, ["k"], ["o"], "v", "s", partitions=7).collect()}
    assert all(got["hot", i] == i + 1 for i in range(500))
    assert [got["cold", i] for i in range(5)] == [0, 1, 3, 6, 10] and got[None, 0] == 0
    assert running_total(df.limit(0), ["k"], ["o"], "v", "s").count() == 0


def test_staged_tables_go(spark):
    from quillspark import session

    rows = session.staged(spark.range(5), "gone")
    assert rows.count() == 5
    folder = rows.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    session.clear_staged(spark)
    import os

    assert not os.path.exists(folder)

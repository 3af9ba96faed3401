"""Parent-child links to full hierarchies by heavy-path decomposition.

Cycles are separated first by pointer doubling, which also yields subtree sizes in the same
logarithmic number of rounds. Every inner node then keeps its largest child; those heavy edges form
chains. A path crosses at most log2(n) chains, so a node's path is a short list of chain segments,
and a subtree is one interval of a numbering that visits each chain without a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.prefix import running_total
from quillspark.session import staged

CYCLE = "cycle"


def _count(df: DataFrame, condition: Column) -> int:
    return df.filter(condition).count()


def parent_links(
    rows: DataFrame, node: str = "id", up: str = "supersedes_id", down: str = "superseded_by_id"
) -> DataFrame:
    """(id, node, parent) for each row: the stored node named by up, else the smallest node naming this one in down.

    Names are compared without case and outer blanks; an empty or unknown name counts as null. Rows
    with a null node are dropped; of repeated nodes (same name) the smallest raw id stands for all.
    """
    clean = lambda c: F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    base = (
        rows.select(
            F.col(node).alias("id"), clean(node).alias("node"), clean(up).alias("up"), clean(down).alias("down")
        )
        .filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min(F.struct("id", "up", "down")).alias("r"))
        .select("node", "r.id", "r.up", "r.down")
    )
    base = staged(base, "links")
    names = base.select(F.col("node").alias("name"))
    named = base.join(names, F.col("up") == F.col("name"), "left").select("id", "node", F.col("name").alias("by_up"))
    claimed = base.filter(F.col("down").isNotNull()).groupBy(F.col("down").alias("child")).agg(F.min("node").alias("by_down"))
    return named.join(claimed, F.col("node") == F.col("child"), "left").select(
        "id", "node", F.coalesce("by_up", "by_down").alias("parent")
    )


def _separate(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, size) of the nodes that reach a root; (node, parent) of those that never do."""
    state = staged(
        links.select(
            "node",
            "parent",
            F.coalesce("parent", "node").alias("anc"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
            F.col("parent").isNull().alias("done"),
            F.lit(1).cast("long").alias("size"),
        ),
        "double",
    )
    open_before, step = None, 1
    while True:
        left = _count(state, ~F.col("done"))
        if left == 0 or left == open_before:
            break
        open_before = left
        gain = (
            state.filter(F.col("dist") == step)
            .groupBy(F.col("anc").alias("g"))
            .agg(F.sum("size").alias("gain"))
        )
        # The rows that are done and have no gain left to give or take stay out of the join on anc.
        target = state.select(F.col("node").alias("t"), F.col("anc").alias("t_anc"), F.col("dist").alias("t_dist"), F.col("done").alias("t_done"))
        moved = (
            state.filter(~F.col("done"))
            .join(target, F.col("anc") == F.col("t"))
            .select("node", "parent", F.col("t_anc").alias("anc"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_done").alias("done"), "size")
        )
        state = staged(
            state.filter("done")
            .unionByName(moved)
            .join(gain, F.col("node") == F.col("g"), "left")
            .withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0)))
            .drop("g", "gain"),
            "double",
        )
        step *= 2
    return state.filter("done").select("node", "parent", "size"), state.filter(~F.col("done")).select("node", "parent")


def heavy_paths(links: DataFrame) -> DataFrame:
    """Labels of every node of links(node, parent).

    node, parent, root, depth, size (nodes of its subtree), head and pos (its chain and place on it),
    segments (array of (head, pos) from the root's chain down to its own: the path), first and last
    (its subtree as an interval within its root's numbering). Nodes on a cycle or below one have root
    'cycle', depth -1 and null labels. Siblings are numbered heavy child first, then by name.
    """
    links = staged(links, "edges")
    tree, lost = _separate(links)
    tree = staged(tree, "tree")
    heavy = (
        tree.filter(F.col("parent").isNotNull())
        .groupBy("parent")
        .agg(F.min(F.struct((-F.col("size")).alias("minus"), "node")).alias("h"))
        .select(F.col("h.node").alias("heavy"), (-F.col("h.minus")).alias("heavy_size"), F.col("parent").alias("of"))
    )
    marked = tree.join(heavy.select("heavy"), F.col("node") == F.col("heavy"), "left").withColumn(
        "is_head", F.col("heavy").isNull()
    ).drop("heavy")
    marked = staged(marked, "marked")

    # place on the chain: doubling along heavy edges only
    place = staged(
        marked.select("node", F.when(F.col("is_head"), F.col("node")).otherwise(F.col("parent")).alias("head"), F.when(F.col("is_head"), 0).otherwise(1).cast("long").alias("pos"), F.col("is_head").alias("fixed")),
        "chain",
    )
    while _count(place, ~F.col("fixed")):
        goal = place.select(F.col("node").alias("t"), F.col("head").alias("t_head"), F.col("pos").alias("t_pos"), F.col("fixed").alias("t_fixed"))
        moved = place.filter(~F.col("fixed")).join(goal, F.col("head") == F.col("t")).select(
            "node", F.col("t_head").alias("head"), (F.col("pos") + F.col("t_pos")).alias("pos"), F.col("t_fixed").alias("fixed")
        )
        place = staged(place.filter("fixed").unionByName(moved), "chain")
    place = place.select("node", "head", "pos")

    # light siblings: how many nodes are numbered between the parent and each of them
    light = marked.filter(F.col("is_head") & F.col("parent").isNotNull()).select("node", "parent", "size")
    light = running_total(light, ["parent"], ["node"], "size", "upto")
    light = light.join(heavy.select("of", "heavy_size"), F.col("parent") == F.col("of")).select(
        F.col("node").alias("head"), "parent", (F.col("upto") - F.col("size") + F.col("heavy_size")).alias("skip")
    )
    hung = place.select(F.col("node").alias("p"), F.col("head").alias("over"), F.col("pos").alias("at"))
    pending = staged(light.join(hung, F.col("parent") == F.col("p")).select("head", "over", "at", "skip"), "light")

    # chains hang below chains at most log2(n) deep
    empty = F.expr("cast(array() as array<struct<head:string,pos:bigint>>)")
    level = marked.filter(F.col("parent").isNull()).select(
        F.col("node").alias("head"), F.col("node").alias("root"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("start"), empty.alias("above")
    )
    level = staged(level, "level")
    chains = level
    while True:
        up = level.select(F.col("head").alias("u"), "root", F.col("base").alias("u_base"), F.col("start").alias("u_start"), F.col("above").alias("u_above"))
        level = staged(
            pending.join(up, F.col("over") == F.col("u")).select(
                "head",
                "root",
                (F.col("u_base") + F.col("at") + 1).alias("base"),
                (F.col("u_start") + F.col("at") + 1 + F.col("skip")).alias("start"),
                F.concat("u_above", F.array(F.struct(F.col("over").alias("head"), F.col("at").alias("pos")))).alias("above"),
            ),
            "level",
        )
        if level.isEmpty():
            break
        chains = chains.unionByName(level)

    labelled = (
        tree.join(place, "node")
        .join(chains, "head")
        .select(
            "node", "parent", "root",
            (F.col("base") + F.col("pos")).alias("depth"),
            "size", "head", "pos",
            F.concat("above", F.array(F.struct("head", "pos"))).alias("segments"),
            (F.col("start") + F.col("pos")).alias("first"),
            (F.col("start") + F.col("pos") + F.col("size") - 1).alias("last"),
        )
    )
    return labelled.unionByName(
        lost.select("node", "parent", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth")),
        allowMissingColumns=True,
    )


def full_paths(labels: DataFrame, separator: str = " > ") -> DataFrame:
    """(node, path): names from the root to the node, joined from the segments of its chains.

    A chain's members are gathered once (a list no longer than the deepest path) and each node takes
    the leading part of the chains on its way. Nodes without a root have a null path.
    """
    chains = labels.filter(F.col("head").isNotNull()).groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("members")
    ).select(F.col("head").alias("c"), F.transform("members", lambda m: m["node"]).alias("names"))
    steps = labels.filter(F.col("head").isNotNull()).select("node", F.posexplode("segments").alias("k", "seg"))
    parts = steps.join(chains, F.col("seg.head") == F.col("c")).select(
        "node", "k", F.slice("names", 1, (F.col("seg.pos") + 1).cast("int")).alias("part")
    )
    paths = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("ps")).select(
        "node", F.array_join(F.flatten(F.transform("ps", lambda p: p["part"])), separator).alias("path")
    )
    return labels.select("node").join(paths, "node", "left")


def descendants(labels: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, descendant) for every node, or for those named in of(node); no node is its own descendant.

    A node lies below exactly the leading interval of each chain on its way, up to the place where
    its path leaves the chain: an equi-join on the chain that yields little more than its result.
    """
    members = labels.filter(F.col("head").isNotNull()).select(F.col("head").alias("c"), F.col("pos").alias("at"), "node")
    if of is not None:
        members = members.join(of.select("node").distinct(), "node", "left_semi")
    ways = labels.filter(F.col("head").isNotNull()).select(F.col("node").alias("descendant"), F.explode("segments").alias("seg"))
    return members.join(ways, (F.col("seg.head") == F.col("c")) & (F.col("at") <= F.col("seg.pos"))).filter(
        "node <> descendant"
    ).select("node", "descendant")

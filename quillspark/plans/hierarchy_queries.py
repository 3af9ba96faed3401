"""Queries over the supersession links of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import hierarchy as H
from quillspark.session import staged
from quillspark.sources.tables import table


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    versions = table(spark, sf_dir, "document_versions").select("id", "supersedes_id", "superseded_by_id")
    links = staged(H.parent_links(versions), "parents")
    return links, staged(H.heavy_paths(links.select("node", "parent")), "labels")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per version that has a parent: its root and depth, or 'cycle' and -1."""
    links, labels = _labels(spark, sf_dir)
    stored = links.select(F.col("node").alias("root"), F.col("id").alias("root_id"))
    rows = links.filter(F.col("parent").isNotNull()).select("id", "node").join(labels.select("node", "root", "depth"), "node")
    return rows.join(stored, "root", "left").select(
        F.col("id").alias("version_id"), F.coalesce("root_id", "root").alias("root_id"), F.col("depth").cast("int").alias("depth")
    )


def p6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its parent, root, depth and number of descendants; -1 for both on and below cycles."""
    _, labels = _labels(spark, sf_dir)
    return labels.select("node", "parent", "root", "depth", (F.coalesce("size", F.lit(0)) - 1).alias("n_descendants"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its full path from the root; null where no root is reached."""
    _, labels = _labels(spark, sf_dir)
    return H.full_paths(labels)


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a version and one of its descendants."""
    _, labels = _labels(spark, sf_dir)
    return H.descendants(labels)


def p6_unrooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that never reach a root."""
    _, labels = _labels(spark, sf_dir)
    return labels.filter(F.col("root") == H.CYCLE).select("node", "parent")


QUERIES = {f.__name__: f for f in (p6_found, p6_hierarchy, p6_paths, p6_descendants, p6_unrooted)}

_LINKS = """
WITH RECURSIVE base AS (
  SELECT id, lower(trim(id)) AS node, lower(trim(supersedes_id)) AS up, lower(trim(superseded_by_id)) AS down
  FROM document_versions),
claimed AS (SELECT down AS child, min(node) AS by_down FROM base WHERE down IS NOT NULL GROUP BY 1),
links AS (
  SELECT b.id, b.node, coalesce(n.node, c.by_down) AS parent
  FROM base b LEFT JOIN base n ON b.up = n.node LEFT JOIN claimed c ON b.node = c.child),
walk AS (
  SELECT id, node, node AS cur, parent AS nxt, [node] AS seen, false AS cyc FROM links
  UNION ALL
  SELECT w.id, w.node, l.node, CASE WHEN list_contains(w.seen, l.node) THEN NULL ELSE l.parent END,
         list_append(w.seen, l.node), list_contains(w.seen, l.node)
  FROM walk w JOIN links l ON w.nxt = l.node),
ends AS (SELECT id, node, cur, len(seen) - 1 AS depth, seen, cyc FROM walk WHERE nxt IS NULL),
lost AS (SELECT node FROM ends WHERE cyc),
pairs AS (SELECT DISTINCT w.cur AS node, w.node AS descendant FROM walk w
          WHERE w.cur <> w.node AND w.node NOT IN (SELECT node FROM lost))
"""
ORACLES = {
    "p6_found": _LINKS + """
SELECT e.id AS version_id, CASE WHEN cyc THEN 'cycle' ELSE b.id END AS root_id,
       CAST(CASE WHEN cyc THEN -1 ELSE depth END AS INTEGER) AS depth
FROM ends e JOIN links l ON e.node = l.node LEFT JOIN base b ON b.node = e.cur WHERE l.parent IS NOT NULL""",
    "p6_hierarchy": _LINKS + """
SELECT l.node, l.parent, CASE WHEN cyc THEN 'cycle' ELSE e.cur END AS root,
       CAST(CASE WHEN cyc THEN -1 ELSE depth END AS BIGINT) AS depth,
       CASE WHEN cyc THEN -1 ELSE coalesce(d.n, 0) END AS n_descendants
FROM links l JOIN ends e ON e.node = l.node
LEFT JOIN (SELECT node, count(*) AS n FROM pairs GROUP BY 1) d ON d.node = l.node""",
    "p6_paths": _LINKS + """
SELECT node, CASE WHEN cyc THEN NULL ELSE array_to_string(list_reverse(seen), ' > ') END AS path FROM ends""",
    "p6_descendants": _LINKS + "SELECT node, descendant FROM pairs",
    "p6_unrooted": _LINKS + "SELECT l.node, l.parent FROM links l JOIN lost USING (node)",
}

"""Duplicates hidden by formatting: canonical text, 128-bit hash, counts with map-side combining.

Canonical form of a text: lower case (sharp s as ss, final sigma as sigma), every run of white space
and punctuation one blank, the header lines (those before the first blank line) sorted, then the
body. Letters and digits stay as stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import staged

#: Unicode punctuation, the ASCII symbols that count as punctuation, and white space.
BETWEEN_WORDS = r"[\p{P}$+<=>^`|~\p{IsWhite_Space}\x1c-\x1f]+"
BLANK_LINE = r"(?:^|\n)[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]*(?:\n|$)"
#: Rows of one group that one task pairs with the rest of the group at most.
PAIR_BLOCK, SALTS = 1000, 32


def _words(text: Column) -> Column:
    lowered = F.regexp_replace(F.lower(F.regexp_replace(text, "ß", "ss")), "ς", "σ")
    return F.trim(F.regexp_replace(lowered, BETWEEN_WORDS, " "))


def canonical_text(text: Column) -> Column:
    """The canonical form of text; null stays null, an empty or blank text becomes two line feeds."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), BLANK_LINE, 2)
    lines = F.transform(F.split(F.get(parts, F.lit(0)), "\n"), _words)
    header = F.array_join(F.array_sort(F.filter(lines, lambda x: x != "")), "\n")
    return F.concat(header, F.lit("\n\n"), _words(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(id, print, check, length): 128-bit MD5 of the canonical text, an independent 64-bit hash and the length.

    Rows with a null text are dropped: nothing is known to be the same about them.
    """
    canon = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), canonical_text(F.col(text)).alias("canon"))
    return canon.select(
        "id",
        F.unhex(F.md5(F.col("canon").cast("binary"))).alias("print"),
        F.xxhash64("canon").alias("check"),
        F.length("canon").cast("long").alias("length"),
    )


def collapse(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record: keep (its smallest id), copies (how many rows it has), collision.

    Counting combines on the map side, so a record with a third of all rows costs one row per task.
    collision tells that different canonical texts share the 128-bit hash (check or length differ);
    such groups are split by check and length, so no record is ever lost or merged wrongly.
    """
    parts = fingerprints(rows, key, text).groupBy("print", "check", "length").agg(
        F.min("id").alias("keep"), F.count(F.lit(1)).alias("copies")
    )
    clash = parts.groupBy("print").agg((F.count(F.lit(1)) > 1).alias("collision"))
    return parts.join(clash, "print").select("keep", "copies", "collision")


def retyped_pairs(rows: DataFrame, key: str = "id", text: str = "raw_text") -> DataFrame:
    """(id_a, id_b): every pair of rows with the same record, smaller id first.

    Groups come from the same map-side counts as collapse(); only their rows are joined, and a large
    group is cut into blocks so that no task pairs more than PAIR_BLOCK rows with a group. Repeated
    ids pair only with other ids.
    """
    prints = staged(fingerprints(rows, key, text), "prints")
    same = ["print", "check", "length"]
    groups = prints.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    blocks = F.ceil(F.col("copies") / PAIR_BLOCK).cast("int")
    # the rows of a group are spread over SALTS tasks before they meet its count
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, [*same, "salt"]).withColumn("blocks", blocks)
    left = members.select(*same, F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    right = members.select(*same, F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, [*same, "block"]).filter("id_a < id_b").select("id_a", "id_b")

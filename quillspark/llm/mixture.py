"""Mixing sources to target weights by weighted fair queueing.

Within its source each shuffled document gets a virtual finish time: the tokens of the source up to and
including it, divided by the source's weight. Taking documents in that order serves every source at its
rate; the order is cut off at the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.prefix import running_total
from quillspark.session import staged

SEED = 20
#: Sources with a target at most; only this table, one row per source, is broadcast.
MAX_SOURCES = 100_000


def source_name(c: str) -> F.Column:
    """A source without case and outer blanks."""
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, weight, repeats, stock): weight is the share among the sources that have tokens."""
    want = targets.select(source_name("source").alias("source"), F.col("target_share").alias("share"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).alias("repeats")).filter("source is not null and share > 0")
    want = want.groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats"))
    have = sized.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("stock"), F.max("size").alias("longest"))
    both = want.join(have, F.col("source") == F.col("s"), "left").select("source", "share", "repeats", F.coalesce("stock", F.lit(0)).alias("stock"), F.coalesce("longest", F.lit(0)).alias("longest"))
    present = F.when(F.col("stock") > 0, F.col("share"))
    # One group of at most MAX_SOURCES rows.
    return both.withColumn("weight", present / F.sum(present).over(Window.partitionBy(F.lit(0))))


def _last_time(rates: DataFrame, budget: int) -> float:
    """A time by which documents of at least the budget have finished, if there are so many; all that may be taken finish by then.

    By time t a source has finished weight * t tokens, less one document at most, and all copies of its stock at most.
    """
    rows = [(r["weight"], r["stock"] * r["repeats"], r["longest"]) for r in rates.filter("stock > 0").collect()]  # MAX_SOURCES at most
    done = lambda t: sum(max(0.0, min(w * t - longest, total)) for w, total, longest in rows)
    end = max(((total + longest) / w for w, total, longest in rows), default=0.0)
    if done(end) < budget:
        return end * 1.01 + 1
    lo, hi = 0.0, end
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if done(mid) >= budget else (mid, hi)
    return hi * 1.000001 + 1


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "size", budget: int | None = None, seed: int = SEED) -> DataFrame:
    """(key, source, copy, size, finish): the documents of the mixture in the order of finish.

    docs(key, source, size) are known by key; sources compare without case and outer blanks. Documents of
    no listed source, null sources and null or zero sizes are left out. A document comes back as copy 2, 3,
    ... up to its source's max_repeats, after all documents of the source had their turn. Without a budget
    the mixture is as large as the scarcest source allows at exact shares, all its copies used; with a
    larger one the sources that run dry fall behind. The sum of sizes never exceeds the budget.
    """
    known = docs.select(F.col(key).alias("doc"), source_name("source").alias("source"), F.col(size).cast("long").alias("size"))
    known = known.filter("source is not null and size > 0")
    sized = staged(known, "sized")
    rates = staged(_rates(sized, targets), "rates")
    if rates.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if budget is None:
        row = rates.filter("stock > 0").agg(F.min(F.col("stock") * F.col("repeats") / F.col("weight")).alias("b")).first()
        budget = int(row["b"]) if row["b"] is not None else 0
    wanted = sized.join(F.broadcast(rates.filter("stock > 0")), "source")
    shuffled = wanted.withColumn("turn", F.xxhash64(F.lit(seed), F.col("doc")))
    queued = running_total(shuffled, ["source"], ["turn", "doc"], "size", "upto")
    # copies that finish after the last time that can matter are never made
    last = F.floor((F.lit(_last_time(rates, budget)) * F.col("weight") - F.col("upto")) / F.col("stock")) + 1
    copies = F.least(F.col("repeats").cast("double"), last).cast("int")
    served = (
        queued.withColumn("copies", copies).filter("copies >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .withColumn("finish", ((F.col("copy") - 1) * F.col("stock") + F.col("upto")) / F.col("weight"))
        .select("doc", "source", "copy", "size", "finish")
    )
    total = running_total(served, [], ["finish", "source", "doc", "copy"], "size", "sum")
    return total.filter(F.col("sum") <= budget).select(F.col("doc").alias(key), "source", "copy", "size", "finish")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies): one row per listed source, also those without documents."""
    got = mixed.groupBy(F.col("source").alias("s")).agg(
        F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copy").alias("most_copies")
    )
    want = targets.select(source_name("source").alias("source"), "target_share").filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    rows = want.join(got, F.col("source") == F.col("s"), "left").drop("s").fillna(0, ["tokens", "documents", "most_copies"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select("source", "target_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "documents", F.col("most_copies").cast("int").alias("most_copies"))

"""Filling fixed-capacity containers: harmonic packing over the histogram of sizes.

Sizes between capacity / (k + 1) and capacity / k form class k, whose containers hold k items of the
class each. Only the histogram of sizes, at most capacity entries, is planned on the driver: which ranks of
a class share a bin, and, as a second step, which items of later classes fill what bins have left. Workers
then place their items by their rank within a size, independently of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.prefix import running_total
from quillspark.session import staged

CAPACITY = 2048


def harmonic_class(size: int, capacity: int = CAPACITY) -> int:
    """k for sizes above capacity / (k + 1) and up to capacity / k: as many items of the class as always fit in a container."""
    return capacity // size


def class_bins(left: np.ndarray, k: int, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(containers, {size: items in each}) that hold k items of class k each, in order of size; the last may hold fewer. left loses them."""
    sizes = [s for s in range(capacity // k, capacity // (k + 1), -1) if left[s]]
    bins: list[tuple[int, dict[int, int]]] = []
    mixed: dict[int, int] = {}
    for s in sizes:
        n = int(left[s])
        left[s] = 0
        if mixed:  # a container that larger sizes of the class began
            take = min(n, k - sum(mixed.values()))
            mixed[s] = take
            n -= take
            if sum(mixed.values()) == k:
                bins.append((1, mixed))
                mixed = {}
        if n >= k:
            bins.append((n // k, {s: k}))
        if n % k and n:
            mixed[s] = n % k
    return [*bins, (1, mixed)] if mixed else bins


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, {size: items in each}) for sizes 1..capacity; every item has one place.

    Classes go from 1 on: the bins of a class hold its fixed count of items. What a bin has left is less than any
    item of its class, and takes items of later classes, the largest that fits, again and again; what remains of
    those then forms the bins of their own class.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    below = np.arange(capacity + 1)  # the largest size up to each that may still have items

    def largest(limit: int) -> int:
        s, path = limit, []
        while s > 0 and left[s] == 0:
            path.append(s)
            s = below[s] if below[s] < s else s - 1
        for p in path:
            below[p] = s
        return int(s)

    plan: list[tuple[int, dict[int, int]]] = []
    for k in range(1, capacity + 1):
        todo = [(n, items, capacity - sum(s * m for s, m in items.items())) for n, items in class_bins(left, k, capacity)][::-1]
        while todo:
            n, items, gap = todo.pop()
            s = largest(gap) if gap else 0
            if not s:
                plan.append((n, items))
                continue
            each = max(1, min(gap // s, int(left[s]) // n))
            take = min(n, int(left[s]))
            left[s] -= take * each
            todo.append((take, items | {s: items.get(s, 0) + each}, gap - s * each))
            if take < n:
                todo.append((n - take, items, gap))
    return plan


def pack(items: DataFrame, keys: list[str], size: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """(keys, piece, size, container): every item in a container of at most capacity.

    keys must name an item. An item above the capacity is cut into pieces: full containers of its own and
    a rest that is packed as an item; all others stay whole (piece 0). A null size counts as 0; items of
    size 0 take no room and go to container 0. An empty table gives an empty table. A size that a third of
    all items share is ranked over many tasks.
    """
    known = items.select(*[F.col(k) for k in keys], F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    full = F.floor(F.col("size") / capacity).cast("int")
    whole = F.when((F.col("size") % capacity == 0) & (F.col("size") > 0), full - 1).otherwise(full)
    parts = staged(
        known.withColumn("piece", F.explode(F.sequence(F.lit(0), whole))).withColumn(
            "size", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity)
        ),
        "items",
    )
    histogram = {r["size"]: r["count"] for r in parts.filter("size > 0").groupBy("size").count().collect()}  # at most capacity rows
    plan = plan_containers(histogram, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = dict.fromkeys(histogram, 0)
    base = 0
    for n, contents in plan:
        for s, each in contents.items():
            slots.setdefault(s, []).append((used[s], base, each))
            used[s] += n * each
        base += n
    spark = items.sparkSession
    # at most a few entries per size and container pattern, whatever the number of items
    table = spark.sparkContext.broadcast({s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in slots.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sizes, ranks = part["size"].to_numpy(), part["rank"].to_numpy() - 1
            where = np.zeros(len(part), np.int64)
            for s in np.unique(sizes[sizes > 0]):
                starts, first, each = table.value[int(s)]
                m = sizes == s
                i = np.searchsorted(starts, ranks[m], side="right") - 1
                where[m] = first[i] + (ranks[m] - starts[i]) // each[i]
            out = part.drop(columns=["rank", "one"])
            out["container"] = where
            yield out

    ranked = running_total(parts.withColumn("one", F.lit(1).cast("long")), ["size"], [*keys, "piece"], "one", "rank")
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in parts.columns) + ", container long"
    return ranked.select(*parts.columns, "one", "rank").mapInPandas(place, schema).select(*keys, "piece", "size", "container")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible, the share of room used."""
    total = packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    return total.select(
        "containers", "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).otherwise(F.lit(0.0)).alias("filled"),
    )

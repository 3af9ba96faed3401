"""Running totals that never gather a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import staged


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add out: the sum of value over the rows of the same keys up to and including this one.

    The rows are range-sorted by (keys, order) over all tasks; a key that holds a third of all rows
    spans many ranges. Each range is summed on its own, the sums of the earlier ranges of the key
    are added. order must be a total order within keys; null values count as 0; an empty table
    stays empty. Extra columns are kept.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, before, total = "__part", "__before", "__total"
    ranged = staged(
        df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()), "ranged"
    )
    amount = F.coalesce(F.col(value), F.lit(0))
    sums = ranged.groupBy(*keys, part).agg(F.sum(amount).alias(total))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(part).alias("__p"),
        F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before),
    )
    within = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn(out, F.sum(amount).over(within))
    match = F.col(part) == F.col("__p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = summed.join(offsets, match, "left")
    return joined.select(*df.columns, (F.col(out) + F.coalesce(F.col(before), F.lit(0))).alias(out))

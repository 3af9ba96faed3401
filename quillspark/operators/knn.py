"""Exact nearest vectors of a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def _packed(df: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """One row per block and batch: keys and unit vectors."""
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), block):
                p = part.iloc[i : i + block]
                x = np.stack([np.asarray(v, np.float64) for v in p[vector]])
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"ids": [p[key].tolist()], "x": [x.tobytes()]})

    return df.mapInPandas(run, f"ids array<{kind}>, x binary")


def exact_knn(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, dim: int) -> DataFrame:
    """(query, neighbour, cosine, rank): the k rows with the largest positive cosine for each query, itself excluded.

    Both sides keep only vectors of dim components without nulls. Every block of queries meets every block
    of rows in a task of its own, so memory is that of two blocks; ties go to the smaller key.
    """
    kind = dict(rows.dtypes)[key]
    fine = (F.size(vector) == dim) & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e))
    q = _packed(queries.filter(fine).select(key, vector), key, vector, BLOCK).select(F.col("ids").alias("qids"), F.col("x").alias("qx"))
    r = _packed(rows.filter(fine).select(key, vector), key, vector, BLOCK)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for qids, qx, ids, x in zip(part["qids"], part["qx"], part["ids"], part["x"], strict=True):
                s = np.frombuffer(qx).reshape(-1, dim) @ np.frombuffer(x).reshape(-1, dim).T
                ids, qids = np.asarray(ids), np.asarray(qids)
                s = np.where(qids[:, None] == ids[None, :], -2, np.round(s, 9))
                order = np.argsort(ids, kind="stable")
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                top = np.take_along_axis(s, best, 1)
                m = top > 0
                yield pd.DataFrame({"query": np.repeat(qids, m.sum(1)), "neighbour": ids[best[m]], "cosine": top[m]})

    met = q.join(r.hint("shuffle_replicate_nl")).repartition(F.xxhash64("qids"), F.xxhash64("ids"))
    found = met.mapInPandas(score, f"query {kind}, neighbour {kind}, cosine double")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

"""Exact nearest neighbours of a stated query set: blocks of queries against all rows, as matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of one block of query vectors that goes to all executors (32 MB).
BLOCK = 4_000_000


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, cosine, rank): the ``k`` vectors of largest cosine, the query itself aside; ties, to six digits, by key.

    A batch keeps its own ``k`` best per query, so only those are shuffled. Queries beyond one block make further passes. Null
    vectors and those of another length than the first query's are left out; of a zero vector all cosines are 0."""
    spark = vectors.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    head = q.first()
    kind = vectors.schema[key].dataType.simpleString()
    if head is None:
        return spark.createDataFrame([], f"query {kind}, {key} {kind}, cosine double, rank int")
    dims = len(head.v)
    q = q.where(F.size("v") == dims)
    rows = vectors.where(F.size(vector) == dims).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = max(1, BLOCK // dims)
    blocks = -(-q.count() // size)
    parts = []
    for b in range(blocks):
        own = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()
        if not own:
            continue
        shared = spark.sparkContext.broadcast(([r.q for r in own], _unit(np.array([r.v for r in own])).T.copy()))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            keys = np.array(names)
            for pdf in batches:
                if not len(pdf):
                    continue
                ids = pdf["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                cos = np.round(_unit(np.stack(pdf["v"].to_numpy())) @ matrix, 6)[order] + 0.0  # rows x queries, in order of keys
                ids = ids[order]
                cos[ids[:, None] == keys[None, :]] = -np.inf
                top = np.argsort(-cos, axis=0, kind="stable")[:k]
                at = np.broadcast_to(np.arange(len(keys)), top.shape)
                out = pd.DataFrame({"query": keys[at.ravel()], "id": ids[top.ravel()], "cosine": cos[top, at].ravel()})
                yield out[np.isfinite(out["cosine"])]

        parts.append(rows.mapInPandas(best, f"query {kind}, id {kind}, cosine double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("id").alias(key), "cosine", "rank")

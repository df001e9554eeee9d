"""Embeddings: cosine similarity and exact nearest neighbours of a stated query set."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is all zero, null for different lengths."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` nearest rows of every query, itself left out, ties by key.

    Queries are taken in blocks of at most ``block``; each block visits all rows where they lie, every
    partition keeps its own k best per query, and only those meet in a shuffle.  A vector's neighbours have
    its length; null and empty vectors have none.
    """
    ordered = queries.where(F.col(vector).isNotNull()).select(key, vector)
    kind = rows.schema[key].dataType.simpleString()
    out, last = None, None
    while True:
        part = ordered.where(F.col(key) > last) if last is not None else ordered
        held = part.orderBy(key).limit(block).collect()
        if not held:
            break
        last = held[-1][0]
        groups = {}
        for size in sorted({len(r[1]) for r in held} - {0}):
            own = [r for r in held if len(r[1]) == size]
            matrix = np.array([r[1] for r in own], dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            groups[size] = ([r[0] for r in own], np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0))

        def best(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            heaps: dict[object, list] = {q: [] for own, _ in groups.values() for q in own}
            for batch in batches:
                pairs: dict[int, list] = {size: [] for size in groups}
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if v is not None and len(v) in pairs:
                        pairs[len(v)].append((i, v))
                for size, (own, matrix) in groups.items():
                    for at in range(0, len(pairs[size]), 512):
                        keys = [p[0] for p in pairs[size][at : at + 512]]
                        m = np.array([p[1] for p in pairs[size][at : at + 512]], dtype=np.float64)
                        n = np.linalg.norm(m, axis=1, keepdims=True)
                        sims = matrix @ np.divide(m, n, out=np.zeros_like(m), where=n > 0).T
                        some = min(k + 1, sims.shape[1])
                        floors = np.partition(sims, -some, axis=1)[:, -some]
                        for q, row, floor in zip(own, sims, floors, strict=True):
                            heap = heaps[q]
                            if len(heap) == k and row.max() < heap[0][0]:
                                continue
                            for j in np.flatnonzero(row >= floor - 1e-12):
                                if keys[j] != q:
                                    item = (row[j], -keys[j])
                                    if len(heap) < k:
                                        heapq.heappush(heap, item)
                                    elif item > heap[0]:
                                        heapq.heapreplace(heap, item)
            flat = [(q, -b, a) for q, h in heaps.items() for a, b in h]
            columns = list(zip(*flat, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query", key, "similarity"])

        found = rows.select(F.col(key).cast("long"), vector).mapInArrow(best, f"query long, `{key}` long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(F.col(key).alias("query"), key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).where("false")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(key, F.col(key).cast(kind))

"""Vectors as ARRAY<FLOAT>: centroids, cosine against all of them, outliers, order-dependent and agglomerative clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid (unit length), n: mean of each label's vectors; partial sums before the shuffle."""
    long = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("pos", "x"))
    mean = long.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = mean.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"), F.max("n").alias("n"))
    v = F.transform("v", lambda x: x["m"])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.select(label, F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("centroid"), "n")


#: Centroids are set against the rows in blocks of about so many; one block is in memory at a time.
BLOCK_LABELS = 10_000


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of doubles; NaN for null ones and those of another length."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    if len(column) and (lengths == size).all():
        flat = column.flatten()
        if flat.null_count == 0:
            return np.asarray(flat, dtype=np.float64).reshape(-1, size)
    rows = [np.asarray([np.nan if x is None else x for x in v], float) if v is not None and len(v) == size else np.full(size, np.nan) for v in column.to_pylist()]
    return np.array(rows).reshape(-1, size)


def against_all(df: DataFrame, cents: DataFrame, row_id: str, label: str, vector: str) -> DataFrame:
    """row_id, label, own, other, nearest: cosine with the own centroid, the best other one and the label of the best (the smallest of equals).

    A stated table of centroids set against all rows, in blocks: a block of BLOCK_LABELS goes to every executor as one
    matrix, and rows meet it as matrices too; with several blocks the answers of each row are put together.
    """
    spark = df.sparkSession
    blocks = max(1, -(-cents.count() // BLOCK_LABELS))
    kind = df.schema[label].dataType
    schema = T.StructType([df.schema[row_id], df.schema[label], *[T.StructField(n, T.DoubleType()) for n in ("own", "other", "best")], T.StructField("nearest", kind)])
    names = [f.name for f in schema.fields]

    def block(rows: list) -> DataFrame:
        rows = sorted(rows, key=lambda r: r["l"])
        shared = spark.sparkContext.broadcast(([r["l"] for r in rows], np.array([r["c"] for r in rows], float)))  # about BLOCK_LABELS vectors

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, m = shared.value
            at = {x: i for i, x in enumerate(labels)}
            for b in batches:
                n = b.num_rows
                if not labels or not n:
                    none = pa.nulls(n, pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), none, none, none, pa.nulls(n, b.schema.field(1).type)], names=names)
                    continue
                s = _matrix(b.column(2), m.shape[1]) @ m.T
                mine = np.array([at.get(x, -1) for x in b.column(1).to_pylist()])
                s = np.where(np.isnan(s), -np.inf, s)
                top = s.argmax(axis=1)
                best = s[np.arange(n), top]
                own = np.where(mine >= 0, s[np.arange(n), np.maximum(mine, 0)], -np.inf)
                s[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
                cols = [pa.array(x, pa.float64(), mask=np.isinf(x)) for x in (own, s.max(axis=1), best)]
                near = pa.array([labels[i] if np.isfinite(v) else None for i, v in zip(top, best)], b.schema.field(1).type)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, near], names=names)

        return df.select(row_id, label, vector).mapInArrow(work, schema)

    every = cents.select(F.col(label).alias("l"), F.col("centroid").alias("c"), F.pmod(F.xxhash64(label), F.lit(blocks)).alias("b"))
    parts = [block(every.where(F.col("b") == i).collect()) for i in range(blocks)]
    if blocks == 1:
        return parts[0].select(row_id, label, "own", "other", "nearest")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best")).alias("b"), F.col("nearest").alias("n"))))  # the best, then the smallest label
    return out.groupBy(row_id, label).agg(F.max("own").alias("own"), F.max("other").alias("other"), first["n"].alias("nearest"))


def agglomerate(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clusters by cosine distance: the two nearest are joined until none is nearer than threshold."""
    n = len(vectors)
    label = np.arange(n)
    if n < 2:
        return label
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] >= threshold:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def cluster_groups(df: DataFrame, group: str, row_id: str, vector: str, threshold: float = 0.24, looser: float = 0.34) -> DataFrame:
    """group, row_id, cluster (from 1, by first row): average linkage within each group; groups are one recording each.

    Where that leaves more clusters than a third of the rows (and more than two), it is done again with the looser
    threshold. Distances of a group are all held at once: groups are for recordings, not for corpora.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        vectors = np.array(pdf[vector].tolist(), dtype=np.float64)
        label = agglomerate(vectors, threshold)
        if len(set(label)) > max(2, len(label) // 3):
            label = agglomerate(vectors, looser)
        number = {x: i + 1 for i, x in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({group: pdf[group], row_id: pdf[row_id], "cluster": [number[x] for x in label.tolist()]})

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, row_id, vector).groupBy(group).applyInPandas(one, f"{group} {types[group]}, {row_id} {types[row_id]}, cluster int")


def online_prototypes(vectors: np.ndarray, join: float = 0.52, learn: float = 0.60, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Prototype of each vector in turn: the most similar one from `join` on, else a new one; it learns from `learn` on."""
    proto: list[np.ndarray] = []
    count: list[int] = []
    out = np.zeros(len(vectors), int)
    for i, x in enumerate(vectors):
        x = x / max(np.linalg.norm(x), 1e-12)
        sims = np.array([p @ x for p in proto])
        if len(sims) and sims.max() >= join:
            k = int(sims.argmax())
            if sims[k] >= learn:
                w = min(count[k], most)
                p = proto[k] * w + x
                proto[k] = p / max(np.linalg.norm(p), 1e-12)
                count[k] += 1
        else:
            k = len(proto)
            proto.append(x)
            count.append(1)
        out[i] = k
    return out, np.array(count)

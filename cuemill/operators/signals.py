"""Arithmetic over measured frames: similarity of performances and voices, leakage, crossfades, mixing and fitting.

Signals are arrays of doubles or rows of frames; what needs a model or a transform is measured elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.operators.choices import correlation, weighted_parts
from cuemill.operators.vectors import agglomerate


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.nullif(F.size(a), F.lit(0))


def rms(a: Column) -> Column:
    return F.sqrt(_mean(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def deviation(a: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    m = _mean(a)
    return F.sqrt(_mean(F.transform(a, lambda x: (x - m) * (x - m))))


def contour_similarity(a: Column, b: Column) -> Column:
    """Correlation of two contours of equal length from four values on; where either hardly moves, 1 less the mean difference. From -1 to 1."""
    flat = 1 - _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    moved = (deviation(a) > 0.03) & (deviation(b) > 0.03)
    value = F.when(moved, correlation(a, b)).otherwise(flat)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) >= 4), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def performance_similarity(contour: Column, pause_a: Column, pause_b: Column, pitch_a: Column, pitch_b: Column) -> Column:
    """Weighted mean of what is there: contour .40, pauses .20 (gone at .55 apart), pitch .40 (gone at six semitones)."""
    least_zero = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))  # noqa: E731  (greatest alone passes over nulls)
    off = F.when((pitch_a > 0) & (pitch_b > 0), F.abs(12 * F.log2(pitch_b / pitch_a)))
    return weighted_parts([((contour + 1) / 2, 0.40), (least_zero(1 - F.abs(pause_a - pause_b) / 0.55), 0.20), (least_zero(1 - off / 6), 0.40)])


def voice_similarity(a: Column, b: Column, seconds: Column) -> Column:
    """struct(similarity, reliable): cosine of two vectors, relied on from two seconds of speech on."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.struct((dot / F.nullif(norm(a) * norm(b), F.lit(0.0))).alias("similarity"), (seconds >= 2.0).alias("reliable"))


def leakage(dialogue: Column, background: Column) -> Column:
    """How much of the dialogue is left in the background: the size of their correlation times the ratio of their levels, 1 at most."""
    r = F.coalesce(F.abs(correlation(dialogue, background)), F.lit(0.0))
    return r * F.least(F.lit(1.0), rms(background) / F.greatest(rms(dialogue), F.lit(1e-9)))


def crossfade(a: Column, b: Column) -> Column:
    """The overlap of two pieces of one length: the first goes with cos², the second comes with sin²."""
    n = F.greatest(F.size(a) - 1, F.lit(1))
    part = lambda i: F.lit(math.pi / 2) * i / n
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.transform(pairs, lambda p, i: p["a"].cast("double") * F.pow(F.cos(part(i)), 2) + p["b"].cast("double") * F.pow(F.sin(part(i)), 2))


def mixed(lines: DataFrame, at: str, samples: str, gain: Column | None = None, peak: float = 0.98) -> DataFrame:
    """frame, value: samples of overlapping lines added up on one timeline, gains kept from .5 to 2, the loudest frame brought down to `peak`."""
    g = F.least(F.lit(2.0), F.greatest(F.lit(0.5), gain if gain is not None else F.lit(1.0)))
    each = lines.select(F.col(at).alias("_at"), g.alias("_g"), F.posexplode(samples).alias("_i", "_x")).select((F.col("_at") + F.col("_i")).alias("frame"), (F.col("_x").cast("double") * F.col("_g")).alias("x"))
    total = each.groupBy("frame").agg(F.sum("x").alias("x"))
    top = total.agg(F.max(F.abs("x")).alias("top"))  # one row
    return total.join(F.broadcast(top)).select("frame", (F.col("x") * F.least(F.lit(1.0), peak / F.greatest("top", F.lit(1e-9)))).alias("value"))


def fit(made_s: Column, wanted_s: Column, limit: float = 0.08) -> Column:
    """struct(tempo, padding_ms, truncated_ms, error_s, ok): a take brought to its window within a limit of tempo, the rest padded or cut."""
    tempo = F.least(F.lit(1 + limit), F.greatest(F.lit(1 - limit), made_s / wanted_s))
    after = made_s / tempo
    pad, cut = F.greatest(F.lit(0.0), wanted_s - after) * 1000, F.greatest(F.lit(0.0), after - wanted_s) * 1000
    return F.struct(tempo.alias("tempo"), pad.alias("padding_ms"), cut.alias("truncated_ms"), (after - wanted_s).alias("error_s"), ((pad <= 160) & (cut <= 40)).alias("ok"))


def rounds(df: DataFrame, value: str, due: Callable[[Column], Column], fix: Callable[[Column], Column], most: int = 3) -> DataFrame:
    """df with value after at most so many corrections, and `attempts`: each round touches only what is still due. One plan, no loop over data."""
    out = df.withColumn("attempts", F.lit(0))
    for _ in range(most):
        again = F.coalesce(due(F.col(value)), F.lit(False))
        out = out.withColumn("_again", again).withColumn("attempts", F.col("attempts") + F.col("_again").cast("int")).withColumn(value, F.when(F.col("_again"), fix(F.col(value))).otherwise(F.col(value))).drop("_again")
    return out


def one_identity(nodes: list[tuple[int, str]], vectors: np.ndarray, threshold: float = 0.32) -> list[int]:
    """Cluster of each (chunk, label): average linkage by cosine; a second label of a chunk in a cluster gets one of its own, labels without a vector come last, sorted."""
    norm = np.linalg.norm(vectors, axis=1) if len(vectors) else np.zeros(0)
    real = [i for i in range(len(nodes)) if norm[i] > 1e-6]
    found = agglomerate(vectors[real] / norm[real, None], threshold) if real else np.zeros(0, int)
    out, used, free = [-1] * len(nodes), set(), int(max(found, default=-1)) + 1
    for i, c in zip(real, map(int, found)):
        if (nodes[i][0], c) in used:
            c, free = free, free + 1
        used.add((nodes[i][0], c))
        out[i] = c
    for i in sorted((i for i in range(len(nodes)) if out[i] < 0), key=lambda i: nodes[i]):
        out[i], free = free, free + 1
    return out


def across_chunks(df: DataFrame, group: str, chunk: str, label: str, vector: str, threshold: float = 0.32) -> DataFrame:
    """group, chunk, label, cluster: voices of the chunks of a recording brought together. A recording's voices, one row a chunk and label, are held by one task."""
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, `{chunk}` {df.schema[chunk].dataType.simpleString()}, `{label}` string, cluster bigint"

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([chunk, label], kind="stable")
        size = max((len(v) for v in rows[vector] if v is not None), default=1)
        vectors = np.array([np.zeros(size) if v is None or len(v) != size else np.asarray(v, float) for v in rows[vector]])
        return pd.DataFrame({group: rows[group], chunk: rows[chunk], label: rows[label], "cluster": one_identity(list(zip(rows[chunk], rows[label])), vectors, threshold)})

    return df.select(group, chunk, F.col(label).cast("string").alias(label), vector).where(F.col(label).isNotNull()).groupBy(group).applyInPandas(work, schema)

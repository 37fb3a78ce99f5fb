"""Scores and gates over measured evidence, as Column expressions; and two order-dependent selections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rhythm(pauses: Column, expected: Column) -> Column:
    """1 where a wording has the pauses expected, less by a quarter for each too many or too few."""
    return F.greatest(F.lit(0.0), 1 - F.abs(pauses - expected) / 4)


def voice_distance(p: Column, q: Column, centroid_p: Column, centroid_q: Column, level_p: Column, level_q: Column) -> Column:
    """Semitones apart, plus what brightness and level add; a term that isn't measured adds nothing."""
    ok = lambda a, b: (a > 0) & (b > 0)
    return (
        F.when(ok(p, q), F.abs(12 * F.log2(p / q))).otherwise(0.0)
        + F.when(ok(centroid_p, centroid_q), 2 * F.abs(F.log2(centroid_p / centroid_q))).otherwise(0.0)
        + F.when(ok(level_p, level_q), 0.12 * F.abs(20 * F.log10(level_p / level_q))).otherwise(0.0)
    )


def fold_octave(value: Column, median: Column) -> Column:
    """Of a pitch, its double and its half the one nearest to the median; the pitch itself among equals."""
    off = lambda x: F.abs(F.log2(x / median))
    a, b, c = off(value), off(value * 2), off(value / 2)
    return F.when((a <= b) & (a <= c), value).when(b <= c, value * 2).otherwise(value / 2)


def incoherent(df: DataFrame, group: str, row_id: str, pitch: str, least: int = 3, spread: float = 8.0, off: float = 4.0) -> DataFrame:
    """group, row_id of lines that don't fit their speaker: the speaker's folded pitches spread over more than
    `spread` semitones, and the line is more than `off` from their median. Groups below `least` lines are left alone."""
    good = df.where(f"{pitch} > 0")
    m = good.groupBy(group).agg(F.expr(f"percentile({pitch}, 0.5)").alias("_m"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    folded = good.join(m, group).withColumn("_f", fold_octave(F.col(pitch), F.col("_m")))
    s = folded.groupBy(group).agg((12 * F.log2(F.max("_f") / F.min("_f"))).alias("_spread"), F.expr("percentile(_f, 0.5)").alias("_fm")).where(F.col("_spread") > spread)
    return folded.join(s, group).where(F.abs(12 * F.log2(F.col("_f") / F.col("_fm"))) > off).select(group, row_id)


def assemble_verdict(evidence: Column, contradiction: Column, adequacy: Column, names: Column) -> Column:
    """passed, failed or unsure: enough evidence, nothing against it, and scores, where told, high enough."""
    scores = F.when(adequacy.isNull() | names.isNull(), F.lit(True)).otherwise((adequacy >= 0.78) & (names >= 0.85))
    return F.when(~F.coalesce(evidence, F.lit(False)), "unsure").when(F.coalesce(contradiction, F.lit(True)), "failed").when(scores, "passed").otherwise("failed")


def source_gate(primary: Column, others: list[Column]) -> Column:
    """Whether the main stem lost the line: another one is audible and the main one is far below it."""
    strongest = F.greatest(primary, *others)
    return (strongest >= 2e-4) & (primary < F.greatest(F.lit(2e-4), 0.08 * strongest))


def reference_quality(snr: Column, active: Column, band: Column, confidence: Column, tail: Column, clipped: Column, overlapping: Column) -> Column:
    """How well a line serves as a voice reference."""
    return (0.32 * snr + 0.24 * active + 0.22 * band + 0.22 * confidence) * tail * F.when(clipped, 0.5).otherwise(1.0) * F.when(overlapping, 0.2).otherwise(1.0)


def pick_side(primary: DataFrame, higher: DataFrame, group: list[str], score: str, margin: float = 0.03) -> DataFrame:
    """group, side: which of two tables' rows a group takes as a whole: the higher one's where its mean score is better by margin."""
    p, h = primary.groupBy(*group).agg(F.avg(score).alias("_p")), higher.groupBy(*group).agg(F.avg(score).alias("_h"))
    h = h.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_h")
    both = p.join(h, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], "full_outer")
    side = F.when(F.col("_p").isNull(), "higher").when(F.col("_h").isNull(), "primary").when(F.col("_h") >= F.col("_p") + margin, "higher").otherwise("primary")
    return both.select(*[F.coalesce(F.col(g), F.col(f"_g_{g}")).alias(g) for g in group], side.alias("side"))


def diverse(rows: list[tuple[float, float]], most: int, pitch: float = 6.0, bright: float = 220.0) -> list[int]:
    """Indexes of the first rows (pitch, brightness) that aren't near both to one kept already."""
    kept: list[int] = []
    for i, (p, b) in enumerate(rows):
        if len(kept) == most:
            break
        if not any(abs(p - rows[k][0]) < pitch and abs(b - rows[k][1]) < bright for k in kept):
            kept.append(i)
    return kept


def diverse_references(df: DataFrame, group: str, row_id: str, score: str, pitch: str, bright: str, shortlist: int = 24, most: int = 4) -> DataFrame:
    """group, row_id: up to `most` rows of each group's best `shortlist` that differ in pitch or brightness. A top-k feature: the shortlist bounds a group."""
    w = Window.partitionBy(group).orderBy(F.desc(score), row_id)
    best = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= shortlist).select(group, row_id, "_rn", F.col(pitch).cast("double").alias("_p"), F.col(bright).cast("double").alias("_b"))
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        return pdf.iloc[diverse(list(zip(pdf["_p"], pdf["_b"])), most)][[group, row_id]]

    return best.groupBy(group).applyInPandas(one, f"{group} {types[group]}, {row_id} {types[row_id]}")


def consolidate(vectors: np.ndarray, counts: np.ndarray, alike: float = 0.42, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Identities seen `least` times or more, the most alike pair merged (weighted by count) while it is above `alike`; most seen first."""
    keep = counts >= least
    v, n = [x / max(np.linalg.norm(x), 1e-12) for x in vectors[keep]], list(counts[keep])
    while len(v) > 1:
        s = np.array(v) @ np.array(v).T
        np.fill_diagonal(s, -2)
        i, j = sorted(divmod(int(s.argmax()), len(v)))
        if s[i, j] <= alike:
            break
        x = v[i] * n[i] + v[j] * n[j]
        v[i], n[i] = x / max(np.linalg.norm(x), 1e-12), n[i] + n[j]
        del v[j], n[j]
    order = sorted(range(len(n)), key=lambda k: -n[k])
    return np.array([v[k] for k in order]), np.array([n[k] for k in order])

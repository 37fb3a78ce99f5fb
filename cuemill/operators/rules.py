"""Declarative rules: named conditions in a fixed order; a missing measurement is what the rule says it is.

A rule is (name, condition). A condition that is null counts as not met; where missing evidence must fail, the
condition says so itself (see missing). The result lists the names of the rules met, in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """True where a measurement is null or NaN."""
    return x.isNull() | F.isnan(x.cast("double"))


def or_else(x: Column, default: float) -> Column:
    """A measurement, or this site's own default where it is null or NaN; a true 0 stays 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """ARRAY<STRING>: names of the rules met, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]), lambda x: x.isNotNull())


def inspect_rules(m: dict[str, Column]) -> list[tuple[str, Column]]:
    """Quality rules of a dubbed line over its measurements (keys as used below). Missing evidence is a reason."""
    need = [(f"missing {k}", missing(m[k])) for k in ("transcription", "alignment", "speaker", "duration_s")]
    return [
        *need,
        ("verdict missing", m["verdict"].isNull()),
        ("verdict failed", ~m["verdict"]),
        ("overlapping speech", m["overlapping"]),
        ("heavy stretch", or_else(m["stretch_percent"], 999.0) > 8),
        ("noticeable stretch", (or_else(m["stretch_percent"], 999.0) > 5) & (or_else(m["stretch_percent"], 999.0) <= 8)),
        ("words differ", (or_else(m["word_similarity"], 0.0) < 0.72) | ((or_else(m["wer"], 1.0) > 0.4) & (or_else(m["cer"], 1.0) > 0.35))),
        ("speaker uncertain", or_else(m["speaker"], 0.0) < 0.5),
        ("transcription uncertain", or_else(m["transcription"], 0.0) < 0.55),
        ("alignment uncertain", or_else(m["alignment"], 0.0) < 0.55),
    ]


def delivery_rules(m: dict[str, Column]) -> list[tuple[str, Column]]:
    """Failures of a finished file: loudness, peak, range, length; a measurement that isn't finite fails."""
    off = lambda x: missing(x) | (F.abs(x.cast("double")) == float("inf"))
    return [
        ("loudness not measured", off(m["lufs"])), ("loudness off target", F.abs(m["lufs"] - m["target_lufs"]) > 1.5),
        ("peak not measured", off(m["peak"])), ("peak too high", m["peak"] > m["target_peak"] + 0.2),
        ("range changed", F.abs(m["range"] - m["source_range"]) > 0.75), ("length changed", F.abs(m["duration_ms"] - m["source_duration_ms"]) > 250),
    ]


def accept_retake(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """Whether another take replaces the current one: no worse in words and voice, and better on the whole."""
    score = lambda t: 0.35 * t["performance"] + 0.35 * t["similarity"] + 0.30 * t["words"]
    return (new["words"] >= F.greatest(F.lit(0.72), old["words"] - 0.04)) & (new["similarity"] >= old["similarity"] - 0.03) & (score(new) > score(old) + 0.03)


def accept_fallback(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """Whether a fallback voice replaces the current one."""
    score = lambda t: 0.4 * t["words"] + 0.25 * t["similarity"] + 0.25 * t["performance"] + 0.1 * t["timing"]
    return (score(new) > score(old) + 0.025) & (new["performance"] >= old["performance"] - 0.02)


def candidate_score(c: dict[str, Column], mouth_visible: Column) -> Column:
    """Cost of a wording, less is better: meaning, rhythm, duration, terms and register, and names that are missing."""
    pick = lambda seen, unseen: F.when(mouth_visible, F.lit(seen)).otherwise(F.lit(unseen))
    late = F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.abs(c["ratio"] - 1) - 0.10) * 3)
    return pick(0.53, 0.58) * (1 - c["adequacy"]) + pick(0.15, 0.10) * (1 - c["rhythm"]) + 0.18 * late + 0.10 * (1 - c["terms"]) + 0.04 * (1 - c["register"]) + 1.5 * c["missing_names"]

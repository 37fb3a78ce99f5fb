"""Replies of models as columns: fields of broken JSON, wordings offered, scores, and small conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of wordings in order, words that are no wording, fields of a judgement, codes of languages.
WORDINGS = ["natural", "compact", "fuller", "same_meaning", "rhythmic", "literal"]
NO_WORDING = ["true", "false", "null"]
SCORES = ["adequacy", "names", "register"]
LANGUAGE_CODES = {"japanese": "ja", "chinese": "zh", "spanish": "es", "arabic": "ar", "french": "fr", "german": "de", "korean": "ko", "italian": "it", "portuguese": "pt", "russian": "ru"}
TARGET_CODES = {"English": "EN", "Chinese": "ZH", "Japanese": "JA", "Spanish": "ES", "Arabic": "AR"}


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def scraped_field(text: Column, name: str) -> Column:
    """The text of a field of an object that is no readable JSON, say for quotes inside: it ends at the quote before the next field or the end. Null where it is empty or missing."""
    form = rf'(?s)"{re.escape(name)}"\s*:\s*"(.*?)"\s*(?=,\s*"[^"]*"\s*:|\s*[}}\]]|\s*$)'
    raw = F.regexp_extract(text, form, 1)
    plain = F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(one_line(plain) != "", one_line(plain))


def wordings(fields: dict[str, Column]) -> Column:
    """Wordings in their fixed order, on one line each, each once; blanks and words of JSON are none."""
    every = F.array(*[one_line(fields[n]) if n in fields else F.lit(None).cast("string") for n in WORDINGS])
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin(NO_WORDING)))


def judged_scores(fields: dict[str, Column]) -> Column:
    """struct(adequacy, names, register, reported): scores from 0 to 1 (hundreds are taken down); reported only if all are there and any is above 0."""
    plain = {n: F.when(~F.isnan(c := fields[n].cast("double")), F.when(c > 1, c / 100).otherwise(c)) for n in SCORES}
    known = [plain[n].isNotNull() for n in SCORES]
    above = [F.coalesce(plain[n] > 0, F.lit(False)) for n in SCORES]
    reported = known[0] & known[1] & known[2] & (above[0] | above[1] | above[2])
    return F.struct(*[F.coalesce(plain[n], F.lit(0.0)).alias(n) for n in SCORES], reported.alias("reported"))


def judged_list(faithful: Column, offered: Column) -> Column:
    """The list a judge numbers: the faithful wording and then the others, each once."""
    return F.array_distinct(F.concat(F.array(faithful), offered))


def clock_text(seconds: Column) -> Column:
    """h:mm:ss of seconds rounded half to even."""
    s = F.bround(seconds, 0).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(s, F.lit(60))))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def language_code(name: Column) -> Column:
    """Two letters for a language's English name or its code; null for others."""
    return _lookup(LANGUAGE_CODES | {v: v for v in LANGUAGE_CODES.values()}, F.lower(name))


def target_code(name: Column) -> Column:
    return F.coalesce(_lookup(TARGET_CODES, name), F.lit("EN"))


def bounded(value: Column, low: float, high: float, default: float | None = None) -> Column:
    """A number within bounds; the default where it reads as none."""
    x = value.try_cast("double")
    x = F.when(x.isNull() | F.isnan(x), F.lit(default).cast("double")).otherwise(x)
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    """A value of a list, without regard to case and outer blanks; the default for others and for null."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(allowed), low).otherwise(F.lit(default))


def scene_line(number: Column, speaker: Column, source: Column, second: Column, english: Column) -> Column:
    """A line of a scene as it is shown to a model; where two readings are contested both stand side by side, neither first by right."""
    said = F.when(F.coalesce(second != source, F.lit(False)), F.concat(F.lit("[readings: "), source, F.lit(" / "), second, F.lit("]"))).otherwise(source)
    return F.concat_ws(" ", F.concat(number.cast("string"), F.lit(".")), F.concat(F.coalesce(speaker, F.lit("Unknown")), F.lit(":")), said, F.when(english.isNotNull(), F.concat(F.lit("=> "), english)))

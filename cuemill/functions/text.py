"""Text functions: what Spark has no builtin for is a vectorised UDF, everything else a Column expression."""

from __future__ import annotations

import difflib
import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType


def fold_title(text: str | None) -> str | None:
    """Accents decomposed, what isn't ASCII dropped, lower case, one blank between runs of letters and digits."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii").lower()
    return " ".join(re.findall(r"[0-9a-z]+", plain))


@F.pandas_udf(StringType())
def normalize_title(texts: pd.Series) -> pd.Series:
    return texts.map(fold_title, na_action="ignore")


#: Digits as words (fixed values).
DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
#: Capitalised words that are no names (fixed values).
NO_NAMES = ["The", "A", "An", "In", "On", "At", "To", "From", "He", "She", "It", "We", "They", "I", "You", "This", "That", "What", "How", "Why", "Ready"]
#: Order of the emotions, and the words that speak for them (fixed values).
EMOTIONS = ["happy", "angry", "sad", "afraid", "disgusted", "melancholic", "surprised", "calm"]
EMOTION_WORDS = {
    "happy": ["happy", "wonderful", "love", "great", "glad", "yes!", "thank"],
    "angry": ["angry", "hate", "damn", "idiot", "shut up", "how dare", "!"],
    "sad": ["sorry", "died", "death", "cry", "sad", "lost", "goodbye"],
    "afraid": ["afraid", "scared", "run", "hide", "help", "danger", "please!"],
    "disgusted": ["disgust", "gross", "filthy", "sickening"],
    "melancholic": ["remember", "used to", "miss you", "alone", "regret"],
    "surprised": ["what?", "really?", "impossible", "can't believe", "oh!"],
}
#: Words a second that synthesised speech has (fixed value).
PACE = 3.39


def spoken_words(text: F.Column) -> F.Column:
    """Lower case words, digits spelled out one by one: what is said, without how it is written."""
    out = F.lower(text)
    for digit, word in enumerate(DIGITS):
        out = F.replace(out, F.lit(str(digit)), F.lit(f" {word} "))
    return F.array_join(F.regexp_extract_all(out, F.lit(r"([a-z']+)"), F.lit(1)), " ")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references, named and numbered, as the characters."""
    return texts.map(html.unescape, na_action="ignore")


def clean_card(text: F.Column) -> F.Column:
    """A subtitle card's text without tags and style codes, its entities read, without notes and outer dashes."""
    bare = unescape(F.regexp_replace(text, r"<[^>]+>|\{\\[^}]+\}", ""))
    return F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("♪"), F.lit(" ")), r"(?U)\s+", " "), r"^[-–— ]+|[-–— ]+$", "")


def count_words(text: F.Column) -> F.Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_']+)"), F.lit(1)))


def estimated_seconds(text: F.Column) -> F.Column:
    """Length of speech: words by pace, a breath for a comma, more for a full stop; 350 ms at least."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.greatest(F.lit(0.35), count_words(text) / PACE + 0.06 * count(",") + 0.08 * count("."))


def word_budget(seconds: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """Fewest, usual and most words for so many seconds: 10 % each way."""
    ideal = seconds * PACE
    return F.greatest(F.lit(1), F.floor(ideal * 0.9)).cast("bigint"), F.greatest(F.lit(1), F.floor(ideal + 0.5)).cast("bigint"), F.greatest(F.lit(1), F.ceil(ideal * 1.1)).cast("bigint")


def names_in(text: F.Column) -> F.Column:
    """Distinct capitalised words that are no ordinary sentence openers."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}'-])(\p{Lu}[\p{L}'-]+)"), F.lit(1)), F.array(*map(F.lit, NO_NAMES)))


def emotion(text: F.Column) -> F.Column:
    """The emotion with the most words for it, the first of equals; calm without any."""
    low = F.lower(text)
    hits = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    scores = [F.least(F.lit(1.0), sum((hits(w) for w in EMOTION_WORDS[e]), F.lit(0)) * F.lit(0.45)) for e in EMOTIONS[:-1]]
    best = F.array(*scores)
    return F.when(text.isNull(), None).when(F.array_max(best) == 0, "calm").otherwise(F.element_at(F.array(*map(F.lit, EMOTIONS)), F.array_position(best, F.array_max(best)).cast("int")))


def replace_terms(text: F.Column, terms: dict[str, str]) -> F.Column:
    """Whole words put for others, without regard to case; longer terms first, later ones see what earlier ones made."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(term)}\b", terms[term].replace("\\", r"\\").replace("$", r"\$"))
    return text


def response_tokens(chars: F.Column, factor: float, low: int, high: int) -> F.Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(chars / 3.2 * factor) + 120)).cast("bigint")


def register_shift(source_hz: F.Column, made_hz: F.Column, seconds: F.Column) -> F.Column:
    """Semitones from made to source pitch where a correction pays: lines of a second or more, .6 to 3 semitones off."""
    shift = 12 * F.log2(source_hz / made_hz)
    return F.when((source_hz > 0) & (made_hz > 0) & (seconds >= 1.0) & F.abs(shift).between(0.6, 3.0), shift)


def clock(ms: F.Column, mark: str = ",") -> F.Column:
    """Milliseconds as HH:MM:SS,mmm."""
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(ms / 3_600_000, 2), F.lit(":"), part(F.pmod(F.floor(ms / 60_000), F.lit(60)), 2), F.lit(":"), part(F.pmod(F.floor(ms / 1000), F.lit(60)), 2), F.lit(mark), part(F.pmod(ms, F.lit(1000)), 3))


def clock_ms(text: F.Column) -> F.Column:
    """HH:MM:SS with one to three digits of a fraction behind a comma or a stop, as milliseconds; null for anything else."""
    p = r"^\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*$"
    g = lambda i: F.regexp_extract(text, p, i)
    whole = (g(1).cast("bigint") * 60 + g(2).cast("bigint")) * 60 + g(3).cast("bigint")
    return F.when(text.rlike(p), whole * 1000 + F.rpad(g(4), 3, "0").cast("bigint"))


@F.pandas_udf(StringType())
def comparable(texts: pd.Series) -> pd.Series:
    """Compatibility form, case folded, letters and digits of any script only."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()), na_action="ignore")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks (Ratcliff and Obershelp); null where either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over the words of two texts."""

    def distance(x: list[str], y: list[str]) -> int:
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            corner, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (u != v))
        return row[-1]

    return pd.Series([None if x is None or y is None else distance(x.split(), y.split()) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first JSON object or list that can be read anywhere in a text, in compact form; null for none."""
    reader = json.JSONDecoder()

    def find(text: str) -> str | None:
        for m in re.finditer(r"[\[{]", text):
            try:
                return json.dumps(reader.raw_decode(text, m.start())[0], ensure_ascii=False, separators=(",", ":"), sort_keys=True)
            except ValueError:
                continue
        return None

    return texts.map(find, na_action="ignore")

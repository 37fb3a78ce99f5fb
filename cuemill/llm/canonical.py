"""Mapping of freely typed titles to the entries of a reference list.

Repair works on tokens: each distinct typed token is joined to the reference vocabulary by edit distance. The
join is an equality join on deletion neighbourhoods (two words at most k edits apart share a string that both
reach by at most k deletions; long words, on one of five parts, since two edits leave one whole), then the distance
is verified. Two tokens run together are split where both halves are words of the vocabulary, and a last token may be
the beginning of a word. Typed titles are then compared with the entries that share a content word, or an entry's
rarest word where it has none: a soft TF-IDF cosine over repaired tokens and, since it ignores order, the edit
distance of the whole strings. No entry within reach is an answer too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cuemill.session import materialize

#: A token in at most this share of the entries is a content word; entries are looked up by these.
CONTENT_SHARE = 0.08
#: Least score of an entry that is meant.
ACCEPT = 0.80
#: Words of up to so many letters are joined on deletions (a word has about n²/2 strings in reach), longer ones on parts; both ways are exact.
SHORT = 24
#: Parts of a long word: two edits, two swapped letters each at worst, touch four of them.
PARTS = 5
#: Years between a typed and a true year at most.
YEARS = 2

#: Words about a release behind a title (fixed values).
RELEASE_WORDS = (
    "director s cut|directors cut|extended cut|extended edition|extended|final cut|special edition|uncut|unrated|remastered|theatrical|"
    "eng dub|eng|dub|dubbed|sub|subbed|multi|uhd|hdr|hd|4k|2160p|1080p|720p|480p|web|bluray|bdrip|dvdrip|webrip|x264|x265|hevc|proper|repack|internal|v2|v3"
)
#: Spellings of the number of a sequel (fixed values).
NUMBERS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ARTICLES = ["a", "an", "the"]


def title_parts(key: Column) -> tuple[Column, Column]:
    """A normalised title without release words and sequel number, its article in front; and the number (1: none)."""
    fixed = F.array_join(F.transform(F.split(key, " "), lambda t: F.when(t.rlike("[a-z]") & t.rlike("[0-9]") & ~t.rlike(f"^({RELEASE_WORDS})$"), F.translate(t, "015", "ols")).otherwise(t)), " ")
    bare = F.trim(F.regexp_replace(fixed, rf"( ({RELEASE_WORDS}))+$", ""))
    tail = r"^(.+?)(?: (?:part|pt|chapter|vol|volume|episode))? ([0-9]{1,2}|" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + r")$"
    word = F.regexp_extract(bare, tail, 2)
    number = F.coalesce(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])[word], F.expr("0") + F.when(word.rlike("^[0-9]+$"), word).cast("int"), F.lit(1))
    stem = F.when(word == "", bare).otherwise(F.regexp_extract(bare, tail, 1))
    moved = F.regexp_replace(stem, r"^(.+) (a|an|the)$", "$2 $1")
    return moved, number


def osa(a: str, b: str) -> int:
    """Edit distance in which two letters that changed places count once."""
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, prior = before, [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(prior[j] + 1, row[j - 1] + 1, prior[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        before = prior
    return row[-1]


@F.pandas_udf(IntegerType())
def swaps_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b)], dtype="int32")


def _deletions(token: Column) -> Column:
    """The token and what is left after one deletion, and after two of those of six letters or more."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    first = one(token)
    both = F.flatten(F.transform(F.filter(first, lambda t: F.length(t) >= 1), one))
    return F.array_distinct(F.concat(F.array(token), F.when(F.length(token) >= 3, first).otherwise(F.array()), F.when(F.length(token) >= 6, both).otherwise(F.array())))


def _parts(token: Column, n: Column, shift: Column | int) -> Column:
    """Of a word of n letters its PARTS parts, with their numbers: where they stand in a token that is shifted."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    at = lambda i: F.floor(n * i / PARTS).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.struct(n.cast("int").alias("n"), i.alias("i"), F.substring(token, F.greatest(at(i) + 1 + shift, F.lit(1)), at(i + 1) - at(i)).alias("part")))


def repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, word, sim, kind: all vocabulary words each distinct token may stand for. tokens: token; vocabulary: word."""
    v = vocabulary.where(F.length("word") <= SHORT).select("word", F.explode(_deletions(F.col("word"))).alias("part"))
    t = tokens.where(F.length("token") <= SHORT + 2).select("token", F.explode(_deletions(F.col("token"))).alias("part"))
    lv = vocabulary.where(F.length("word") > SHORT).select("word", F.explode(_parts(F.col("word"), F.length("word"), 0)).alias("p")).select("word", "p.*")
    lt = tokens.where(F.length("token") > SHORT - 2).select("token", F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2)).alias("n")).select("token", "n", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift"))
    lt = lt.select("token", F.explode(_parts(F.col("token"), F.col("n"), F.col("shift"))).alias("p")).select("token", "p.*")
    near = t.join(v, "part").select("token", "word").unionByName(lt.join(lv, ["n", "i", "part"]).select("token", "word")).distinct()
    longest = F.greatest(F.length("token"), F.length("word"))
    allowed = F.when(F.length("word") >= 6, 2).when(F.length("word") >= 3, 1).otherwise(0)
    edited = near.withColumn("e", swaps_distance("token", "word")).where(F.col("e") <= allowed).select("token", "word", (1 - F.col("e") / longest).alias("sim"), F.lit("edit").alias("kind"))
    unknown = tokens.join(vocabulary, F.col("token") == F.col("word"), "left_anti")
    cut = unknown.where("length(token) >= 4").select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    cut = cut.select("token", F.expr("substring(token, 1, i)").alias("a"), F.expr("substring(token, i + 1)").alias("b"))
    halves = cut.join(vocabulary.select(F.col("word").alias("a")), "a").join(vocabulary.select(F.col("word").alias("b")), "b")
    split = halves.select("token", F.explode(F.array("a", "b")).alias("word"), F.lit(0.98).alias("sim"), F.lit("split").alias("kind"))
    begun = vocabulary.where("length(word) >= 4").select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 1)).alias("i")).select("word", F.expr("substring(word, 1, i)").alias("token"))
    prefix = unknown.join(begun, "token").select("token", "word", F.lit(0.95).alias("sim"), F.lit("prefix").alias("kind"))
    return edited.unionByName(split).unionByName(prefix)


def match_titles(typed: DataFrame, entries: DataFrame, accept: float = ACCEPT, content_share: float = CONTENT_SHARE) -> DataFrame:
    """title, year, kind, entry_id, score: for each distinct typed row the entry it means; no row where none is meant.

    typed: title (normalised), year, kind, distinct rows. entries: entry_id, key (normalised title, one row per
    spelling), year, kind, rank (higher is preferred among equals). Years may be null on either side; two known
    years must be within YEARS. Equal scores are decided by year, then kind, then rank, then the smaller id.
    """
    stem, number = title_parts(F.col("title"))
    q = typed.where("title <> ''").select("title").distinct().withColumn("stem", stem).withColumn("number", number).where("stem <> ''")
    estem, enumber = title_parts(F.col("key"))
    e = entries.where("key <> ''").withColumn("stem", estem).withColumn("number", enumber).where("stem <> ''").withColumn("words", F.array_distinct(F.split("stem", " ")))
    e = e.select(F.monotonically_increasing_id().alias("eid"), "entry_id", F.col("key").alias("e_key"), F.col("stem").alias("e_stem"), F.col("number").alias("e_number"), "words", F.col("year").alias("e_year"), F.col("kind").alias("e_kind"), "rank")
    # One row per distinct stem of the reference list, with its weights.
    e = materialize(e, "entries")
    stems = e.groupBy("e_stem").agg(F.first("words").alias("words"))
    n = stems.agg(F.count(F.lit(1)).alias("n"))
    vocab = stems.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))  # n: one row
    vocab = vocab.withColumn("w", F.log1p(F.col("n") / F.col("df"))).withColumn("content", F.col("df") <= F.greatest(F.lit(3.0), F.col("n") * content_share))
    vocab = materialize(vocab, "vocabulary")  # read many times
    weighted = materialize(stems.select("e_stem", F.explode("words").alias("word")).join(vocab, "word"), "weights")
    # An entry of frequent words alone is looked up by the rarest of them.
    only = weighted.groupBy("e_stem").agg(F.min(F.struct("df", "word"))["word"].alias("word"), F.count_if("content").alias("c")).where("c = 0").select("word", "e_stem")
    postings = weighted.where("content").select("word", "e_stem").unionByName(only)
    stem_side = weighted.groupBy("e_stem").agg(F.collect_list(F.struct("word", "w", "content")).alias("e_words"), F.count_if("content").alias("e_content"), F.count(F.lit(1)).alias("e_size"))

    parts = q.select("title", "stem", F.posexplode(F.split("stem", " ")).alias("pos", "token")).withColumn("last", F.col("pos") == F.size(F.split("stem", " ")) - 1)
    fix = materialize(repairs(materialize(parts.select("token").distinct(), "tokens"), vocab.select("word")), "repairs")
    known = fix.join(vocab, "word")
    options = parts.join(known, "token", "left").where("kind is null or kind <> 'prefix' or last")
    unknown_w = F.when(F.length("token") <= 3, F.lit(0.5)).otherwise(F.lit(6.0))
    per_token = options.groupBy("title", "stem", "pos", "token").agg(
        F.coalesce(F.max_by("w", "sim"), unknown_w).alias("qw"), F.filter(F.collect_list(F.struct("word", "sim", "content")), lambda r: r["word"].isNotNull()).alias("opts")
    )
    q_side = per_token.groupBy("title", "stem").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"), F.flatten(F.collect_list("opts")).alias("opts"), F.count(F.lit(1)).alias("q_size"), F.count_if((F.size("opts") == 0) & (F.length("token") >= 4)).alias("q_odd"))
    q_side = materialize(q_side, "typed")
    looked = q_side.select("title", F.explode("opts").alias("o")).select("title", F.col("o.word").alias("word")).distinct()
    pairs = looked.join(postings, "word").groupBy("title", "e_stem").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.join(q_side, "title").join(stem_side, "e_stem").where("shared >= least(e_content, 2) or q_size < e_size or q_odd > 0")
    best = lambda word: F.aggregate(F.filter("opts", lambda o: o["word"] == word), F.lit(0.0), lambda acc, o: F.greatest(acc, o["sim"]))
    hits = F.transform("e_words", lambda v: F.struct(v["w"].alias("w"), best(v["word"]).alias("s")))
    scored = pairs.withColumn("hits", hits)
    dot = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["w"] * h["w"] * h["s"])
    e_norm = F.sqrt(F.aggregate("e_words", F.lit(0.0), lambda acc, v: acc + v["w"] * v["w"]))
    a, b = F.replace("stem", F.lit(" "), F.lit("")), F.replace("e_stem", F.lit(" "), F.lit(""))
    whole = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    front = F.substring(b, F.lit(1), F.length(a))
    cut = F.when((F.length(a) < F.length(b)) & (F.length(a) >= 0.55 * F.length(b)), 0.97 * (1 - F.levenshtein(a, front) / F.length(a))).otherwise(0.0)
    scored = scored.withColumn("cosine", F.least(F.lit(1.0), dot / (e_norm * F.greatest(F.col("q_norm"), F.lit(1e-9))))).withColumn("whole", whole).withColumn("cut", cut)
    # A title that broke off lacks words: then only the common beginning speaks.
    score = F.greatest(0.5 * F.col("cosine") + 0.5 * F.col("whole"), F.col("cut") - 0.05, F.col("whole") - 0.04)
    good = scored.select("title", "e_stem", F.round(score, 4).alias("score")).where(F.col("score") >= accept)
    good = good.join(q.select("title", "number"), "title").join(e, "e_stem").where("number = e_number")

    full = typed.join(good, "title").where(f"year is null or e_year is null or abs(year - e_year) <= {YEARS}")
    order = Window.partitionBy("title", "year", "kind").orderBy(
        F.desc("score"), F.coalesce(F.abs(F.col("year") - F.col("e_year")), F.lit(0)), F.desc(F.coalesce(F.col("kind") == F.col("e_kind"), F.lit(False))), F.desc_nulls_last("rank"), "entry_id"
    )
    return full.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("title", "year", "kind", "entry_id", "score")

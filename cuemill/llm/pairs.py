"""Defective prompt and response pairs, here a spoken line and its translation.

Refusals are found by what they do, not by a list of phrases. Responses open their sentences in some way; the distinct
openings are clustered by verified MinHash, and a cluster that recurs with prompts that have nothing in common is a
template of refusal. A translation recurs too, but beside prompts that have a sentence, a clause or an end of one in
common, within a language; and what stands in its prompt is found with it far more often than chance would have it.
Either lack is enough: of several prompts of one language no half share anything, or hardly anything in any prompt
goes with the opening. The other defects are checked on the pair itself: nothing in it, a copy, the wrong language, or
an end at words behind which the corpus nearly always goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm import garble, langid, neardup, transcripts
from cuemill.session import materialize

#: A response in brackets of so many words is one, and so is an opening that breaks off; others need three words. An opening is so many words of a sentence at most.
UNIT_WORDS = 4
SHORTEST = 3
OPENING = 16
#: A template recurs so often beyond the first time in each language, and at most this share of it beside one source clause;
RECURS = 4
SAME_SOURCE = 0.5
#: or it occurs so often, its prompts' clauses were seen so often in all, and at most this share of them go with it: these
#: stand beside it again, and so many times as often as chance would have it.
OCCURS, CLAUSE_SEEN, CLAUSES = 3, 4, 6
GOES_WITH, LIFT = 0.25, 10.0
#: That is asked of the whole opening and of so many words at its beginning and at its end.
EDGE = 3
#: Behind an end, the corpus ends with at most this chance; it was seen this often.
ENDS = 0.12
SEEN = 5
PIECE = 0.7
#: A response of fewer sentences and so much less text than usual for its language stops early.
SHORT = 0.72

_SENTENCE = re.compile(r"[.!?:;。！？…\n]+")
_CLAUSE = re.compile(r"[,、，]\s*")
_WORD = re.compile(r"[぀-ヿ㐀-鿿々ー]|[^\W_]+(?:['’][^\W_]+)*|[.!?。！？]")
_PLAIN = re.compile(r"[぀-ヿ㐀-鿿々ー]|[^\W_]+(?:'[^\W_]+)*")
_NUMBER = re.compile(r"\d+")
_ENDS = set(".!?。！？")
_LANGUAGE = re.compile(r"\b(?:english|german|french|spanish|italian|portuguese|russian|japanese)\b")
_NOTHING = re.compile(r"(?:n/?a|null|none|nil|tbd|untranslated|not translated|no translation|missing|empty|todo|translation missing|<[^<>]*>|[\W_])*", re.I)
_CLOSED = re.compile(r"(?<![.…])[.!?。！？][\s\"”“»«'’)\]}>*]*$")
END = "."


def words_of(text: str) -> list[str]:
    """Words in lower case, one Japanese character each, and END for every full stop."""
    return [END if t in _ENDS else t for t in _WORD.findall(text.casefold().replace("’", "'"))]


def units(text: str, clauses: bool) -> list[str]:
    """Sentences of a text in normal form; with clauses also their parts, openings and ends, else also what follows a first short phrase."""
    out: dict[str, None] = {}
    for s in _SENTENCE.split(_NUMBER.sub("0", text.casefold().replace("’", "'"))):
        parts = [ws for ws in map(_PLAIN.findall, _CLAUSE.split(s)) if ws]
        if not parts:
            continue
        whole = [w for ws in parts for w in ws]
        out[" ".join(whole)] = None
        if clauses:
            for ws in (whole, *parts) if len(parts) > 1 else parts:
                out[" ".join(ws)] = None
                k = 6 if any("぀" <= w <= "鿿" for w in ws) else 3
                if len(ws) > k:
                    out[" ".join(ws[:k])] = out[" ".join(ws[-k:])] = None
        elif len(parts) > 1 and len(parts[0]) <= 4:
            out[" ".join(w for ws in parts[1:] for w in ws)] = None
    return [_LANGUAGE.sub("<language>", u) for u in out]


def tail(words: list[str]) -> str:
    """The last three words of a text."""
    while words and words[-1] == END:
        words = words[:-1]
    return " ".join(words[-3:])


FEATURES = (
    "spoken boolean, nothing boolean, copied boolean, s_lang string, foreign boolean, e_lang string, e_sure double, s_words array<string>, e_words array<string>, "
    "s_units array<bigint>, e_units array<string>, s_tail string, e_tail string, s_sentences int, e_sentences int, s_length int, e_length int, s_open boolean"
)
_TYPES = [pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]


def key_of(unit: str) -> int:
    """A signed 64-bit key of a unit."""
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass")) - (1 << 63)


def _count(text: str) -> int:
    return sum(1 for x in re.split(r"[.!?。！？…\n]+", text) if re.search(r"\w", x))


def source_features(source: str | None, model: garble.Model, lang: langid.LangModel) -> tuple:
    """spoken, words, words without stops, main language, foreign, keys of units, tail, sentences, length, left open."""
    s = transcripts._NOTE.sub(" ", garble.restore(source, model)[1] or "")
    words = words_of(s)
    only = [w for w in words if w != END]
    spoken = any(c.isalpha() for w in only for c in w)
    found = lang.stretches(s) if spoken else []
    main = max(found, key=lambda x: x[3] - x[2])[0] if found else None
    left_open = bool(re.search(r"(?:[-–—,、]|\.\.\.|…)[\s\"”“»«'’]*$", s))
    return spoken, words, only, main, any(x[0] != "en" for x in found), sorted(set(map(key_of, units(s, True)))), tail(words), _count(s), len(s.strip()), left_open


def response_features(response: str | None, model: garble.Model, lang: langid.LangModel) -> tuple:
    """nothing, words, words without stops, language, its confidence, openings, tail, sentences, length."""
    e = garble.restore(response, model)[1] or ""
    bare = transcripts._NOTE.sub(" ", e)
    if not re.search(r"\w", bare) and len(e.split()) >= UNIT_WORDS and re.search(r"\w", e):
        bare = re.sub(r"[\[\](){}<>*]", " ", e)  # a whole sentence in brackets is a response
    words = words_of(bare)
    only = [w for w in words if w != END]
    nothing = _NOTHING.fullmatch(bare) is not None or not only
    found = [] if nothing else lang.stretches(bare, "en")
    main = max(found, key=lambda x: x[3] - x[2]) if found else (None, 0.0)
    found_units = units(bare, False)
    if not _CLOSED.search(bare):  # what broke off after a few words could begin anything
        cut = set(units(_SENTENCE.split(bare)[-1], False))
        found_units = [u for u in found_units if u not in cut or u.count(" ") >= UNIT_WORDS - 1]
    openings = list(dict.fromkeys(" ".join(u.split(" ", OPENING)[:OPENING]) for u in found_units))
    return nothing, words, only, main[0], main[1], openings, tail(words), _count(bare), len(bare.strip())


def together(s: tuple, e: tuple) -> tuple:
    """FEATURES of a pair from those of its two texts."""
    same = s[2] == e[2] or (len(e[2]) >= 4 and len(s[2]) >= 4 and _overlap(s[2], e[2]) >= 0.9)
    return (s[0], e[0], same, s[3], s[4], e[3], e[4], s[1], e[1], s[5], e[5], s[6], e[6], s[7], e[7], s[8], e[8], s[9])


def pair_features(source: str | None, response: str | None, model: garble.Model, lang: langid.LangModel) -> tuple:
    return together(source_features(source, model, lang), response_features(response, model, lang))


def _overlap(a: list[str], b: list[str]) -> float:
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return 2 * sum((x & y).values()) / (len(a) + len(b))


def features(pairs: DataFrame, keep: list[str], source: str, response: str, trained: tuple, model: langid.LangModel) -> DataFrame:
    """keep columns and what is measured of each pair on its own."""
    sc = pairs.sparkSession.sparkContext
    words, scores = sc.broadcast(trained), sc.broadcast((model.scores, model.bias, model.temperature, model.cut))  # both of bounded size
    key = garble.new_key()
    slim = pairs.select(*keep, F.col(source).alias("_s"), F.col(response).alias("_e"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-2]) + ", " + FEATURES
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lang = garble.model_of(key, words.value), langid.model_of(key, scores.value)
        one = lru_cache(20_000)(lambda s: source_features(s, m, lang))  # texts recur
        other = lru_cache(20_000)(lambda e: response_features(e, m, lang))
        short = lambda x: x is None or len(x) < 400
        for b in batches:
            got = [together(one(s) if short(s) else source_features(s, m, lang), other(e) if short(e) else response_features(e, m, lang)) for s, e in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *[pa.array([g[i] for g in got], t) for i, t in enumerate(_TYPES)]], names=[*b.schema.names[:-2], *names])

    return slim.mapInArrow(work, schema)


def templates(feats: DataFrame) -> DataFrame:
    """unit: openings of responses that recur beside unrelated prompts. feats is read several times: hand over a written table."""
    # What is in another language is told as that.
    real = feats.where("spoken and not nothing and not copied and not s_open and (e_lang is null or e_lang = 'en' or e_sure < 0.5)").select(F.coalesce("s_lang", F.lit("?")).alias("lang"), "s_units", "e_units")
    every = real.select("lang", "s_units", F.explode("e_units").alias("unit")).where(F.size(F.split("unit", " ")) >= SHORTEST)
    cluster = materialize(neardup.clusters(every.select(F.col("unit").alias("text"))).select(F.col("text").alias("unit"), "cluster"), "clusters")
    # An opening unlike any other is known by its own hash: only the others are looked up.
    moved = cluster.where("cluster <> xxhash64(unit)")
    words = F.split("unit", " ")
    begins, ends = F.xxhash64(F.lit("begins"), F.slice(words, 1, EDGE)), F.xxhash64(F.lit("ends"), F.slice(words, F.greatest(F.size(words) - EDGE + 1, F.lit(1)), EDGE))
    keys = F.array(F.coalesce("cluster", F.xxhash64("unit")), begins, ends)
    known = every.join(moved, "unit", "left").select("lang", "s_units", F.explode(keys).alias("k"))
    total = materialize(known.groupBy("k", "lang").agg(F.count(F.lit(1)).alias("n")), "openings")
    often = total.groupBy("k").agg(F.sum("n").alias("n_k")).where(F.col("n_k") >= OCCURS)
    beside = known.join(often, "k").select("k", "n_k", "lang", F.explode("s_units").alias("u")).groupBy("k", "n_k", "lang", "u").agg(F.count(F.lit(1)).alias("c"))
    clauses = real.select(F.explode("s_units").alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("b"))
    pairs = real.count()
    seen = F.col("b") >= CLAUSE_SEEN
    goes = seen & (F.col("c") >= 2) & ((F.col("c") - 1) * pairs >= LIFT * F.col("n_k") * (F.col("b") - 1))
    by_lang = beside.join(clauses, "u").groupBy("k", "lang").agg(F.max("c").alias("top"), F.sum(F.when(seen, F.col("c")).otherwise(0)).alias("seen"), F.sum(F.when(goes, F.col("c")).otherwise(0)).alias("goes"))
    # The first occurrence in a language says nothing; of the others, how many stand beside the same source?
    more, same = F.sum(F.col("n") - 1), F.sum(F.greatest(F.coalesce("top", F.lit(0)) - 1, F.lit(0)))
    by_key = total.join(by_lang, ["k", "lang"], "left").groupBy("k").agg(more.alias("more"), same.alias("same"), F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("goes").alias("goes"))
    apart = F.expr(f"more >= {RECURS - 1} and same < {SAME_SOURCE} * more")
    alone = F.expr(f"seen >= {CLAUSES} and goes < {GOES_WITH} * seen")
    judged = materialize(by_key.where(apart | alone).select("k", apart.alias("apart"), (alone & (F.col("n") >= OCCURS)).alias("alone")), "judged")
    flags = lambda key, name: judged.select(F.col("k").alias(key), F.col("apart").alias(f"{name}_apart"), F.col("alone").alias(f"{name}_alone"))
    every_unit = cluster.select("unit", F.col("cluster").alias("o"), begins.alias("g"), ends.alias("h"))
    flagged = every_unit.join(flags("o", "o"), "o").join(flags("g", "g"), "g", "left").join(flags("h", "h"), "h", "left")
    return flagged.where("o_apart or (o_alone and g_alone and h_alone)").select("unit")


def endings(feats: DataFrame) -> DataFrame:
    """field, gram, n, ends, bare: of runs of three words and of single words (after a tab), how often they occur, end a
    sentence or text, and end a text without a full stop."""
    both = feats.select(F.explode(F.array(F.struct(F.lit("s").alias("field"), F.col("s_words").alias("w")), F.struct(F.lit("e").alias("field"), F.col("e_words").alias("w")))).alias("x")).select("x.*")
    end = lambda i: F.coalesce(F.get("w", i + 1), F.lit(END)) == END
    run = lambda i: F.array_join(F.slice("w", F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3))), " ")
    rows = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.get("w", i).alias("word"), run(i).alias("gram"), end(i).cast("int").alias("end"), F.get("w", i + 1).isNull().cast("int").alias("bare")))
    grams = both.where("size(w) > 0").select("field", F.explode(rows).alias("r")).where(F.col("r.word") != END).select("field", "r.*")
    three = materialize(grams.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends"), F.sum("bare").alias("bare")), "grams")
    # Each run of three ends in one word, so the words' counts are sums of theirs.
    one = three.groupBy("field", F.concat(F.lit("\t"), F.substring_index("gram", " ", -1)).alias("gram")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("bare").alias("bare"))
    return three.unionByName(one)


def defects(feats: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and defect: empty, refusal, copy, wrong_language or truncated, of each pair that has one.

    feats: of features(), written to a table. Prompts without words have no defect; of several defects the first
    in that order is told. Nulls are empty. Repeated rows are each judged. An empty table gives no rows.
    """
    bad = materialize(templates(feats), "templates")
    ids = feats.select(*keep, "spoken", "nothing", "copied", "foreign", "s_lang", "e_lang", "e_sure", "s_tail", "e_tail", "s_sentences", "e_sentences", "s_length", "e_length", "s_open", "e_units").where("spoken")
    refused = ids.where("not nothing and not copied").select(*keep, F.explode("e_units").alias("unit")).join(bad, "unit").select(*keep).distinct().withColumn("refused", F.lit(True))
    refused = refused.select(*[F.col(k).alias(f"r_{k}") for k in keep], "refused")
    marked = ids.join(refused, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keep], "left").withColumn("refused", F.coalesce("refused", F.lit(False)))

    stats = endings(feats)
    # Only the ends that occur are looked up.
    need = feats.select(F.explode(F.array(F.struct(F.lit("s").alias("field"), F.col("s_tail").alias("gram")), F.struct(F.lit("e").alias("field"), F.col("e_tail").alias("gram")), *[F.struct(F.lit(f).alias("field"), F.concat(F.lit("\t"), F.element_at(F.split(f"{f}_tail", " "), -1)).alias("gram")) for f in "se"])).alias("x")).select("x.*").distinct()
    stats = materialize(stats.join(need, ["field", "gram"], "left_semi"), "endings")
    pick = lambda field, name: stats.where(F.col("field") == field).select(F.col("gram").alias(f"g_{name}"), F.col("n").alias(f"n_{name}"), F.col("ends").alias(f"x_{name}"), F.col("bare").alias(f"b_{name}"))
    ends = marked
    for f in "se":
        three, one = pick(f, f"{f}3"), pick(f, f"{f}1")
        ends = ends.join(three, F.col(f"{f}_tail") == F.col(f"g_{f}3"), "left").join(one, F.concat(F.lit("\t"), F.element_at(F.split(f"{f}_tail", " "), -1)) == F.col(f"g_{f}1"), "left")

    def broken(f: str, cut_short: F.Column) -> F.Column:
        # Counts but for the text itself, which ends here.
        n, x = F.col(f"n_{f}3") - 1, F.col(f"x_{f}3") - 1
        # A word that stands almost only at bare ends is a piece of one.
        rare = F.coalesce((F.col(f"n_{f}1") <= 3) | (F.col(f"b_{f}1") >= PIECE * F.col(f"n_{f}1")), F.lit(False))
        return F.coalesce(F.when(n >= SEEN, x < ENDS * n).otherwise(rare | cut_short), F.lit(False))

    usual = feats.where("spoken and not nothing and not copied and s_sentences = e_sentences and s_length > 0").groupBy("s_lang").agg(F.percentile_approx(F.col("e_length") / F.col("s_length"), 0.5).alias("usual")).withColumnRenamed("s_lang", "u_lang")
    ends = ends.join(F.broadcast(usual), F.col("s_lang") == F.col("u_lang"), "left")  # a row a language
    share = F.coalesce(F.col("e_length") / (F.col("usual") * F.greatest("s_length", F.lit(1))), F.lit(1.0))
    short = (F.col("e_sentences") < F.col("s_sentences")) & (share < SHORT)
    source_open = F.col("s_open") | broken("s", F.lit(False))
    foreign_response = F.col("e_lang").isNotNull() & (F.col("e_lang") != "en") & (F.col("e_sure") >= 0.5)
    defect = (
        F.when(F.col("nothing"), "empty").when(F.col("refused"), "refusal").when(F.col("copied") & F.col("foreign"), "copy").when(F.col("copied"), None).when(foreign_response, "wrong_language")
        .when((broken("e", share < 0.6) & ~source_open) | short, "truncated")
    )
    return ends.select(*keep, defect.alias("defect")).where("defect is not null")

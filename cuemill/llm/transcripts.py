"""Raw transcript lines to clean turns of canonical speakers.

1. Each line is read on its own: time stamps, tags and sound annotations go, speaker labels are taken from the
   text or the name column, hesitation sounds are dropped. A line in which two speakers are written gives two parts.
2. Per transcript only the distinct labels with their counts go on. Union-find over them joins variants of one
   name: typos, initials, first or last name alone, titles, reversed order. A cluster speaks for the speaker
   number that its lines name most often.
3. Parts without a number get their label's. Turns are unbroken runs of one speaker by time. Runs are found
   within slices of a transcript's time; one summary row per slice tells which run goes on from before, so no
   task holds a transcript.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_MS = 600_000

#: Hesitation sounds of the languages handled (fixed values), without accents.
FILLERS = set("um umm uhm uh uhh er err erm hm hmm hmmm mm mmm mhm ahm ah ahh ohm oehm aehm eh ehh ehm em emm eu euh euhh heu hum huh".split())
TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "frau", "don", "dona", "sr", "sra"}
UNSURE = {"", "?", "uncertain voice", "unknown", "unknown voice", "voice", "speaker", "n a"}

_STAMP = re.compile(r"[\[(<]?\b(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,3}))?\b[\])>]?(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)?")
_NOTE = re.compile(r"\(\([^()]*\)\)|\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|【[^【】]*】|（[^（）]*）|\*[^*\n]{1,40}\*|[♪♫]")
_WORD = re.compile(r"\w+(?:['’]\w+)*")
_NAME = r"[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*){0,2}"
_VOICED = re.compile(r"<v(?:\.\w+)? ([^<>]+)>\s*")
_BRACKET = re.compile(r"\[([^\[\]]+)\]\s*")
_DASHED = re.compile(rf"({_NAME}|[Vv]oice #?\d+) — ")
_COLON = re.compile(rf"({_NAME}|(?:[Vv]oice|VOICE) #?\d+)(?: \((?:V\.O\.|O\.S\.|off)\))?: ")
_VOICE = re.compile(r"voice #?0*(\d+)")
_CAST = re.compile(r"\((?:v\.?o\.?|o\.?s\.?|off|cont'?d)\)", re.I)


def plain(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def label_key(label: str | None) -> str:
    """A label's normal form: `first last`, `first`, `f last`, `voice 3`; empty where it names nobody."""
    if label is None:
        return ""
    text = _CAST.sub(" ", label.strip())
    if text.count(",") == 1:
        last, first = text.split(",")
        text = f"{first} {last}"
    key = " ".join(w for w in re.sub(r"[^a-z0-9-]+", " ", plain(text)).split() if w not in TITLES).strip("- ")
    if m := _VOICE.fullmatch(key):
        return f"voice {int(m[1])}"
    return "" if key in UNSURE else key


def _capitalised(name: str) -> bool:
    return all(w[:1].isupper() for w in name.split() if w[:1].isalpha())


def _take_label(line: str) -> tuple[str, str]:
    """The speaker label a line begins with ('' for none), and the rest."""
    rest = re.sub(r"^(?:[-–—]\s*|</?[ib]>\s*)+", "", line.strip())
    for _ in range(3):
        if m := _VOICED.match(rest):
            return m[1], rest[m.end() :]
        if m := _BRACKET.match(rest):
            name = m[1].strip()
            if (len(name.split()) >= 2 and _capitalised(name) and not name.isupper()) or _VOICE.fullmatch(plain(name)):
                return name, rest[m.end() :]
        for pattern in (_DASHED, _COLON):
            if (m := pattern.match(rest)) and _capitalised(m[1]):
                return m[1], rest[m.end() :]
        if not (m := _NOTE.match(rest)):
            break
        rest = rest[m.end() :].lstrip(" -–—")
    return "", rest


def clean_speech(text: str) -> tuple[str, bool]:
    """Text without annotations and hesitation sounds, and whether any word is left."""
    bare = _NOTE.sub(" ", text)
    words = [w for w in _WORD.findall(bare) if plain(w) not in FILLERS or not plain(w)]
    if not words:
        return "", False
    out, at = [], 0
    for m in _WORD.finditer(bare):
        if plain(m[0]) in FILLERS and plain(m[0]):
            out.append(bare[at : m.start()])
            at = m.end() + len(re.match(r"(?:\.{2,}|…|[,.])?", bare[m.end() :])[0])
    out.append(bare[at:])
    speech = re.sub(r"\s+([,.;:?!])", r"\1", " ".join(" ".join(out).split()))
    return speech.strip(" -–—"), True


def read_line(source: str | None) -> tuple[int | None, list[tuple[str, str, bool]]]:
    """Milliseconds of the first time stamp (None: none), and the parts of a line: label key, clean text, has words."""
    if not source:
        return None, []
    at = None
    if m := _STAMP.search(source):
        at = ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int((m[4] or "0").ljust(3, "0"))
    parts: list[list] = []
    for line in _STAMP.sub(" ", source).splitlines():
        if not line.strip():
            continue
        label, rest = _take_label(line)
        text, words = clean_speech(rest)
        if parts and not label_key(label):
            parts[-1][1] = f"{parts[-1][1]} {text}".strip()
            parts[-1][2] |= words
        else:
            parts.append([label_key(label), text, words])
    return at, [tuple(p) for p in parts]


def _edits(a: str, b: str) -> int:
    """Edit distance with swaps, as far as 2."""
    from cuemill.llm.canonical import osa

    return 9 if abs(len(a) - len(b)) > 2 else osa(a, b)


def cluster_labels(counts: dict[tuple[str, int | None], int]) -> dict[str, int | None]:
    """Speaker number of each label of one transcript. counts: lines by label and number (None: not told)."""
    labels = sorted({k for k, _ in counts if k and not k.startswith("voice ")})
    weight = Counter()
    votes: dict[str, Counter] = defaultdict(Counter)
    for (k, n), c in counts.items():
        weight[k] += c
        if n:
            votes[k][n] += c
    parent = {k: k for k in labels}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    whole = [k for k in labels if len(k.split()) >= 2 and all(len(w) > 1 for w in k.split())]
    # Full names in buckets of their first two letters or their last name's: typos hit one place.
    near: dict[str, list[str]] = defaultdict(list)
    for k in whole:
        first, last = k.split()[0], k.split()[-1]
        for b in {f"i{first[0]}{last[0]}", f"f{first}", f"l{last}"}:
            near[b].append(k)
    for ks in near.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                if find(a) != find(b) and _edits(a, b) <= 2:
                    parent[find(b)] = find(a)
    groups: dict[str, set[str]] = defaultdict(set)
    for k in whole:
        groups[find(k)].add(k)

    def fits(short: str, full: str) -> bool:
        words, names = short.split(), full.split()
        first, last = names[0], names[-1]
        if len(words) == 1:
            w = words[0]
            return w in (first, last) or (len(w) >= 5 and (_edits(w, first) <= 1 or _edits(w, last) <= 1))
        a, b = words[0], words[-1]
        if len(a) == 1 and len(b) > 1:
            return first[0] == a and _edits(b, last) <= 1
        if len(b) == 1 and len(a) > 1:
            return last[0] == b and _edits(a, first) <= 1
        return False

    told = {}
    for k in labels:
        if k in groups or any(k in g for g in groups.values()):
            continue
        fit = [root for root, ks in groups.items() if any(fits(k, f) for f in ks)]
        if len(fit) == 1:
            parent[k] = fit[0]
        elif fit and not votes[k]:  # it may stand for several; the one that speaks most
            told[k] = max(fit, key=lambda r: (sum(weight[x] for x in groups[r]), r))
    total: dict[str, Counter] = defaultdict(Counter)
    for k in labels:
        total[find(k)].update(votes[k])
    pick = lambda c: min(c, key=lambda n: (-c[n], n)) if c else None
    out = {k: pick(total[find(told.get(k, k))]) for k in labels}
    for k in {k for k, _ in counts if k.startswith("voice ")}:
        out[k] = int(k[6:])
    return out


PARTS = "line_id long, job_id string, start_ms long, part int, shared boolean, speaker_no int, label string, text string, words boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        cols = [c.to_pylist() for c in batch.columns]
        for line_id, job, start, number, name, source in zip(*cols):
            at, parts = read_line(source)
            told = None if start is None or start != start or abs(start) > 1e12 else round(start * 1000)
            ms = at if told is None else told
            shared = len(parts) > 1
            for i, (label, text, words) in enumerate(parts):
                if shared:
                    no, key = None, label
                    if i == 0 and not label:
                        no, key = number if number and number > 0 else None, label_key(name)
                else:
                    no, key = number if number and number > 0 else None, label or label_key(name)
                rows.append((line_id, job, ms, i, shared, no, key, text, words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.bool_()])],
            names=["line_id", "job_id", "start_ms", "part", "shared", "speaker_no", "label", "text", "words"],
        )


def line_parts(lines: DataFrame) -> DataFrame:
    """Parts of each distinct line. lines: line_id, job_id, start_s, speaker_id, speaker_name, source; repeats go first."""
    slim = lines.where("line_id is not null").select(F.col("line_id").cast("long"), F.col("job_id").cast("string"), F.col("start_s").cast("double"), F.col("speaker_id").cast("int"), "speaker_name", "source")
    once = slim.groupBy("line_id").agg(F.min(F.struct(*[c for c in slim.columns if c != "line_id"])).alias("r")).select("line_id", "r.*")
    return once.mapInArrow(_parse, PARTS)


def _cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    counts: Counter = Counter()
    for label, no, n in zip(pdf["label"], pdf["speaker_no"], pdf["n"]):
        counts[label, None if pd.isna(no) else int(no)] += int(n)
    got = cluster_labels(counts)
    return pd.DataFrame({"c_job": [pdf["job_id"].iloc[0]] * len(got), "c_label": list(got), "c_no": pd.array(list(got.values()), dtype="Int32")})


def speakers(parts: DataFrame) -> DataFrame:
    """c_job, c_label, c_no: the speaker number each distinct label of a transcript stands for."""
    counts = parts.where("label <> ''").groupBy("job_id", "label", "speaker_no").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("job_id").applyInPandas(_cluster, "c_job string, c_label string, c_no int")


def turns(parts: DataFrame) -> DataFrame:
    """line_id, job_id, speaker_id, turn_start_ms, part, text of every part with words, speaker and time.

    parts as by line_parts, written to a table before (it's read twice). Order is by time, then line_id, then the
    order written. Lines without words are taken out first. A part whose speaker can't be told ends the turn
    before it and gives no row. Lines without any time give no rows. A null job is a transcript of its own.
    """
    named = speakers(parts)
    spoken = parts.where("words and start_ms is not null")
    known = spoken.join(named, F.col("job_id").eqNullSafe(F.col("c_job")) & (F.col("label") == F.col("c_label")), "left")
    known = known.select("line_id", "job_id", "start_ms", "part", "text", F.coalesce("speaker_no", "c_no", F.lit(0)).cast("bigint").alias("who"), F.floor(F.col("start_ms") / SLICE_MS).alias("slice"))
    order = ["start_ms", "line_id", "part"]
    w = Window.partitionBy("job_id", "slice").orderBy(*order)
    marked = known.withColumn("new", F.coalesce(F.lag("who").over(w) != F.col("who"), F.lit(True)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marked.withColumn("run_start", F.last(F.when(F.col("new"), F.col("start_ms")), ignorenulls=True).over(upto)).withColumn("run_no", F.sum(F.col("new").cast("int")).over(upto))
    place = F.struct(*order)
    summary = runs.groupBy("job_id", "slice").agg(F.min_by("who", place).alias("first_who"), F.max_by("who", place).alias("last_who"), F.min("start_ms").alias("first_ms"), F.max_by("run_start", place).alias("last_ms"), F.max("run_no").alias("n"))
    s = Window.partitionBy("job_id").orderBy("slice")
    chained = summary.withColumn("goes_on", F.coalesce(F.lag("last_who").over(s) == F.col("first_who"), F.lit(False)))
    begin = F.when(F.col("n") > 1, F.col("last_ms")).when(~F.col("goes_on"), F.col("first_ms"))
    chained = chained.withColumn("carry", F.last(begin, ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1)))
    chained = chained.select(F.col("job_id").alias("s_job"), F.col("slice").alias("s_slice"), F.when(F.col("goes_on"), F.col("carry")).alias("carry"))
    joined = runs.join(chained, F.col("job_id").eqNullSafe(F.col("s_job")) & (F.col("slice") == F.col("s_slice")))
    start = F.when((F.col("run_no") == 1) & F.col("carry").isNotNull(), F.col("carry")).otherwise(F.col("run_start"))
    return joined.where("who > 0").select("line_id", "job_id", F.col("who").alias("speaker_id"), start.alias("turn_start_ms"), "start_ms", "part", "text")

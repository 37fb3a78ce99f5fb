"""Languages of texts, and of the stretches of texts that mix several.

The classifier is an average of hashed subword embeddings under a linear softmax, trained by stochastic gradient
descent in numpy on a bounded sample of labelled lines. Wrong labels among them are found by the model itself
half-way and left out. A temperature fitted on held-out lines calibrates it; what stays below a confidence is
rejected. Since a text's score is the mean of its words' scores, each word has a score vector of its own, and the
cheapest path through a text's words (words it explains badly cost, changes of language cost, less so at a full
stop) gives its single-language stretches.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ["en", "de", "fr", "es", "it", "pt", "ru", "ja"]
#: Spellings of languages (fixed values: ISO 639 codes, English and own names).
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano", "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский", "ja": "ja jpn jp japanese 日本語",
}
#: Labels that name no language (fixed values).
NO_LANGUAGE = ["", "und", "unk", "unknown", "none", "null", "n/a", "na", "?", "mul", "mis", "zxx", "auto"]

#: Bound on the labelled lines that the classifier is fitted on.
SAMPLE = 24_000
BUCKETS = 1 << 16
DIM = 16
#: Costs of a change of language: behind a full stop, a comma, and elsewhere.
CHANGE = (4.0, 6.0, 9.0)
#: A stretch must explain its words so much better than the language around it.
STRETCH = 6.0
#: What a label is worth against the evidence of the words, and the confidence below which nothing is said.
PRIOR = 3.0
REJECT = 0.3
WORST = -4.0

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿々ー]{1,3}|[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_STOP = re.compile(r"[.!?;。！？；\n…«»“”„]|\s[-–—]\s")


def label_code(column) -> F.Column:
    """Code of a label in any spelling; 'other' for a language not handled; null where it names none."""
    key = F.lower(F.trim(F.regexp_replace(column, r"[-_].*$", "")))
    pairs = [x for code, names in SPELLINGS.items() for name in names.split() for x in (F.lit(name), F.lit(code))]
    return F.when(column.isNull() | F.lower(F.trim(column)).isin(NO_LANGUAGE), F.lit(None)).otherwise(F.coalesce(F.create_map(*pairs)[key], F.lit("other")))


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its pieces of two to four letters, with its edges marked."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode()) & (BUCKETS - 1) for g in sorted(grams)]


def tokens(text: str) -> list[str]:
    return [t.casefold() for t in _TOKEN.findall(text)]


class LangModel:
    """Scores of buckets by language; a text's logits are the mean of its words', a word's the mean of its buckets'."""

    def __init__(self, scores: np.ndarray, bias: np.ndarray, temperature: float, cut: float = REJECT):
        self.scores, self.bias, self.temperature, self.cut = scores, bias, temperature, cut
        self.bias_list = [float(b) for b in bias]
        self.cache: dict[str, tuple[list, list, float, int, float]] = {}

    def word(self, word: str) -> tuple[list, list, float, int, float]:
        """Logits, clipped log probabilities and weight of a word; its likeliest language and that one's log probability."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            z = self.scores[features(word)].mean(axis=0)
            weight = 0.8 if _CJK.search(word) else 1.0
            e = z - z.max()
            a = np.maximum(e - np.log(np.exp(e).sum()), WORST) * weight
            got = self.cache[word] = (z.tolist(), a.tolist(), weight, int(a.argmax()), float(a.max()))
        return got

    def confidence(self, rows: list[tuple], lang: int) -> float:
        total = sum(r[2] for r in rows)
        scale = self.temperature * min(1.0, 0.5 + 0.1 * total)
        z = [(sum(map(mul, col, [r[2] for r in rows])) / total + b) * scale for col, b in zip(zip(*[r[0] for r in rows]), self.bias_list)]
        top = max(z)
        e = [exp(x - top) for x in z]
        return e[lang] / sum(e)

    def stretches(self, text: str | None, label: str | None = None) -> list[tuple[str, float, int, int]]:
        """(language, confidence, first, end) of each stretch, in code points; none for a text without words or rejected."""
        found = list(_TOKEN.finditer(text or ""))
        if not found:
            return []
        know, learn = self.cache.get, self.word
        rows = [know(w) or learn(w) for w in [m[0].casefold() for m in found]]
        total = list(map(sum, zip(*[r[1] for r in rows])))
        if label in LANGS:
            total[LANGS.index(label)] += PRIOR
        best = max(range(len(LANGS)), key=total.__getitem__)
        if sum(r[4] - r[1][best] for r in rows if r[3] != best) < CHANGE[0]:
            path = [best] * len(rows)  # no other path can be cheaper
        else:
            prior = np.zeros(len(LANGS))
            if label in LANGS:
                prior[LANGS.index(label)] = PRIOR
            path = self._path(text, found, np.array([r[1] for r in rows]), prior)
        runs: list[list[int]] = []
        for i, lang in enumerate(path):
            if runs and runs[-1][0] == lang:
                runs[-1][2] = i + 1
            else:
                runs.append([lang, i, i + 1])
        out = []
        for lang, i, j in runs:
            c = self.confidence(rows[i:j], lang)
            if c >= self.cut or (len(runs) == 1 and label not in LANGS and c >= 0.3):
                out.append((LANGS[lang], round(c, 4), found[i].start(), found[j - 1].end()))
        return out

    def _path(self, text: str, found: list, a: np.ndarray, prior: np.ndarray) -> list[int]:
        n = len(a)
        cost, back = a[0] + prior, np.zeros((n, len(LANGS)), int)
        for i in range(1, n):
            between = text[found[i - 1].end() : found[i].start()]
            change = CHANGE[0] if _STOP.search(between) else CHANGE[1] if "," in between or "、" in between else CHANGE[2]
            top = int(cost.argmax())
            stay = cost >= cost[top] - change
            back[i] = np.where(stay, np.arange(len(LANGS)), top)
            cost = np.where(stay, cost, cost[top] - change) + a[i]
        path = [int(cost.argmax())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        path.reverse()
        # A stretch that its neighbour's language explains nearly as well goes to it.
        for _ in range(4):
            edges = [0, *[i for i in range(1, n) if path[i] != path[i - 1]], n]
            weak = None
            for k in range(len(edges) - 1):
                i, j = edges[k], edges[k + 1]
                for o in ([path[i - 1]] if i else []) + ([path[j]] if j < n else []):
                    gain = a[i:j, path[i]].sum() - a[i:j, o].sum()
                    if gain < STRETCH and (weak is None or gain < weak[0]):
                        weak = (gain, i, j, o)
            if weak is None:
                break
            path[weak[1] : weak[2]] = [weak[3]] * (weak[2] - weak[1])
        return path


def fit(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.5, batch: int = 64, seed: int = 7) -> LangModel:
    """Trains on labelled texts; some labels may be wrong, some texts mixed. A tenth is held out for the temperature.

    First whole texts are learned. Then, `epochs` times, random spans of one to five words of each text, without
    texts and spans whose label the first round finds impossible, so that every word gets a score of its own.
    """
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs, ys = [], []
    for text, label in zip(texts, labels):
        ids = [vocab.setdefault(t, len(vocab)) for t in tokens(text)]
        if ids:
            docs.append(np.array(ids))
            ys.append(LANGS.index(label))
    bias = np.zeros(len(LANGS), np.float32)
    if not docs:
        return LangModel(np.zeros((BUCKETS, len(LANGS)), np.float32), bias, 1.0)
    y = np.array(ys)
    feats = [np.array(features(w)) for w in vocab]
    size = np.array([len(f) for f in feats])
    flat_all, begin = np.concatenate(feats), np.concatenate([[0], np.cumsum(size)[:-1]])
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((len(LANGS), DIM), np.float32)

    def forward(spans: list[np.ndarray]):
        n = np.array([len(d) for d in spans])
        words, inv = np.unique(np.concatenate(spans), return_inverse=True)
        counts = size[words]
        ends = np.cumsum(counts)
        flat = flat_all[np.arange(ends[-1]) + np.repeat(begin[words] - (ends - counts), counts)]
        vec = np.add.reduceat(emb[flat], ends - counts) / counts[:, None]
        text = np.add.reduceat(vec[inv], np.cumsum(n) - n) / n[:, None]
        z = text @ weight.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return words, inv, flat, n, text, z, p / p.sum(axis=1, keepdims=True)

    def chances(spans: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        p = np.concatenate([forward(spans[k : k + 1024])[6] for k in range(0, len(spans), 1024)])
        return p[np.arange(len(spans)), target]

    def descend(spans: list[np.ndarray], target: np.ndarray, high: float, low: float) -> None:
        nonlocal weight
        order = rng.permutation(len(spans))
        for k in range(0, len(order), batch):
            idx = order[k : k + batch]
            words, inv, flat, n, text, _, p = forward([spans[i] for i in idx])
            g = p.astype(np.float32)
            g[np.arange(len(idx)), target[idx]] -= 1
            lr = high + (low - high) * k / len(order)
            by_word = np.zeros((len(words), DIM), np.float32)
            np.add.at(by_word, inv, np.repeat((g @ weight) / n[:, None], n, axis=0).astype(np.float32))
            by_word /= size[words][:, None]
            np.add.at(emb, flat, np.repeat(-lr * by_word, size[words], axis=0).astype(np.float32))
            weight = weight - lr * (g.T @ text).astype(np.float32)

    order = rng.permutation(len(docs))
    held, use = order[: len(docs) // 10], order[len(docs) // 10 :]
    for high, low in ((rate, 0.6 * rate), (0.6 * rate, 0.3 * rate)):
        descend([docs[i] for i in use], y[use], high, low)
    if len(use) > 200:
        use = use[chances([docs[i] for i in use], y[use]) > 0.1]
    for epoch in range(epochs):
        spans, target = [], []
        for i in use:
            d = docs[i]
            for _ in range(2):
                n = int(rng.integers(1, min(5, len(d)) + 1))
                k = int(rng.integers(0, len(d) - n + 1))
                spans.append(d[k : k + n])
                target.append(y[i])
        goal = np.array(target)
        if len(use) > 200:
            ok = np.flatnonzero((chances(spans, goal) > 0.05) | (np.array([len(x) for x in spans]) == 1))
            spans, goal = [spans[i] for i in ok], goal[ok]
        descend(spans, goal, rate * (1 - epoch / epochs), rate * (1 - (epoch + 1) / epochs) + 0.02)
    temperature = 1.0
    if len(held) >= 50:
        z = np.concatenate([forward([docs[i] for i in held[k : k + 1024]])[5] for k in range(0, len(held), 1024)])
        best = np.inf
        for t in np.geomspace(0.1, 3, 30):
            e = z * t - (z * t).max(axis=1, keepdims=True)
            loss = -(e[np.arange(len(held)), y[held]] - np.log(np.exp(e).sum(axis=1))).mean()
            if loss < best:
                best, temperature = loss, float(t)
    return LangModel((emb @ weight.T).astype(np.float32), bias, temperature)


def quotas(counts: dict[str, int], bound: int) -> dict[str, int]:
    """How many lines each language gives: all alike, but for those with fewer, whose share goes to the others."""
    out, left, rest = {}, bound, sorted(counts, key=lambda k: (counts[k], k))
    for i, lang in enumerate(rest):
        out[lang] = min(counts[lang], left // (len(rest) - i))
        left -= out[lang]
    return out


def sample(lines: DataFrame, text: str, label: str, bound: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most `bound` lines with a label of a language handled, of each language those with the smallest hashes of their text."""
    good = lines.where(F.col(label).isin(LANGS) & (F.length(text) > 0)).select(F.col(text).alias("t"), F.col(label).alias("l"))
    counts = {r.l: r.n for r in good.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    want = quotas(counts, bound)
    if not want:
        return [], []
    # A little more than is wanted comes by hash; what is over is cut here.
    part = F.create_map(*[F.lit(x) for k in want for x in (k, min(1.0, (1.2 * want[k] + 200) / counts[k]))])[F.col("l")]
    near = good.withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1 << 31))).where(F.col("h") < part * (1 << 31))
    rows = sorted(near.collect(), key=lambda r: (r.h, r.t, r.l))  # about 1.2 x bound
    out: dict[str, list[str]] = {k: [] for k in want}
    for r in rows:
        if len(out[r.l]) < want[r.l]:
            out[r.l].append(r.t)
    pairs = [(t, k) for k in LANGS if k in out for t in out[k]]
    return [t for t, _ in pairs], [k for _, k in pairs]


_MODELS: dict[str, LangModel] = {}


def model_of(key: str, value: tuple) -> LangModel:
    """One model a worker, which keeps the scores of the words it has seen."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = LangModel(*value)
    return _MODELS[key]


SEGMENTS = "array<struct<lang:string,confidence:double,first:int,end:int>>"
_SEGMENT = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))


def identify(lines: DataFrame, keep: list[str], text: str, label: str, model: LangModel, prepare=None) -> DataFrame:
    """keep columns and segments: the single-language stretches of each text with their confidence.

    label: a column of codes (null: none told); it counts as weak evidence. prepare: a function of a worker that
    makes the text to be judged of the text as it stands (offsets are of the former). A null or empty text, one
    without words, and one whose language can't be told have no segments. Repeated rows are each judged.
    """
    shared = lines.sparkSession.sparkContext.broadcast((model.scores, model.bias, model.temperature, model.cut))  # BUCKETS x 8 numbers, 2 MB
    key = uuid.uuid4().hex  # a worker that lives on must not take another model for this one
    slim = lines.select(*keep, F.col(label).alias("_label"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-2]) + f", segments {SEGMENTS}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, make = model_of(key, shared.value), prepare() if prepare else (lambda t: t)
        told = lambda t, lab: [dict(zip(("lang", "confidence", "first", "end"), s)) for s in m.stretches(make(t), lab)]
        again = lru_cache(50_000)(told)  # lines recur
        for b in batches:
            texts, labels = b.column(b.num_columns - 1).to_pylist(), b.column(b.num_columns - 2).to_pylist()
            got = [again(t, lab) if t is None or len(t) < 400 else told(t, lab) for t, lab in zip(texts, labels)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(got, _SEGMENT)], names=[*b.schema.names[:-2], "segments"])

    return slim.mapInArrow(work, schema)

"""Choices among offers and evidence: the best stream, the first usable text, what is to be done again."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose_audio(streams: DataFrame, group: str, ordinal: str, default: Column, channels: Column, rejected: Column) -> DataFrame:
    """group, ordinal, ambiguous: the stream with the best score (the first of equals); ambiguous where the next is within 1."""
    score = 3 * default.cast("double") + F.least(F.lit(2.0), channels / 3) - 12 * rejected.cast("double")
    w = Window.partitionBy(group).orderBy(F.desc("_score"), ordinal)
    ranked = streams.withColumn("_score", score).withColumn("_next", F.lead("_score").over(w)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return ranked.select(group, ordinal, F.coalesce(F.col("_score") - F.col("_next") < 1.0, F.lit(False)).alias("ambiguous"))


def choose_text(streams: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first stream of each group by a tuple of preferences; false sorts before true."""
    first = streams.groupBy(group).agg(F.min(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])).alias("_o"))
    return first.select(group, F.col(f"_o._{len(order) - 1}").alias("index"))


def first_text(*texts: Column) -> Column:
    """The first that isn't blank; null where none is, so a line is never made empty."""
    return F.coalesce(*[F.when(t.rlike(r"(?U)\S"), t) for t in texts])


def with_default(left: DataFrame, right: DataFrame, keys: list[str], column: str, default: Column) -> DataFrame:
    """left with right's column by keys; the default where right has no row or null."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(column).alias("_v"))
    joined = left.join(r, [F.col(k) == F.col(f"_r_{k}") for k in keys], "left")
    return joined.withColumn(column, F.coalesce("_v", default)).drop("_v", *[f"_r_{k}" for k in keys])


def unambiguous(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id of pairs in which the left has exactly one partner."""
    return pairs.groupBy(left_id).agg(F.countDistinct(right_id).alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").select(left_id, right_id)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; null for constant ones."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def weighted_parts(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are there, by weight; null where none is."""
    value = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.when(weight > 0, value / weight)


class Catalogue:
    """Entries (id, normalised names, year, kind, popularity) and the two best of them for a title, as if all were scored."""

    def __init__(self, entries: list[tuple]):
        self.entries = entries
        names = [(i, n) for i, e in enumerate(entries) for n in e[1] if n]
        self.owner, self.names = np.array([i for i, _ in names], dtype=np.int64), [n for _, n in names]
        self.letters = {c: k for k, c in enumerate(sorted({c for n in self.names for c in n}))}
        self.counts = np.array([[n.count(c) for c in self.letters] for n in self.names], dtype=np.int32).reshape(len(self.names), len(self.letters))
        self.lengths = np.array([len(n) for n in self.names], dtype=np.int64)
        self.words = [set(n.split()) for n in self.names]
        self.of: list[list[int]] = [[] for _ in entries]
        for k, i in enumerate(self.owner):
            self.of[i].append(k)

    def _bonus(self, year, kind) -> np.ndarray:
        out = np.zeros(len(self.entries))
        for i, (_, _, y, k, _) in enumerate(self.entries):
            away = None if year is None or y is None else abs(year - y)
            out[i] = (0.04 if year is None else 0.0 if away is None else 0.19 if away == 0 else 0.07 if away == 1 else -min(0.2, 0.04 * away)) + (0.0 if kind is None else 0.07 if kind == k else -0.11)
        return out

    def best(self, title: str, asked: list[tuple]) -> list[tuple]:
        """id, score and margin (thousandths) for each (year, kind) asked with a title; id None where there is no entry."""
        have, words = Counter(title), set(title.split())
        mine = np.array([have[c] for c in self.letters], dtype=np.int32)
        # The letters in common bound the ratio of matching blocks, so what can't be among the two best isn't matched.
        top = 2.0 * np.minimum(self.counts, mine).sum(axis=1) / np.maximum(1, self.lengths + len(title))
        shared = np.array([len(words & w) / len(words | w) for w in self.words])
        bound = np.zeros(len(self.entries))
        np.maximum.at(bound, self.owner, np.maximum(top, shared) if len(self.names) else np.zeros(0))
        exact: dict[int, float] = {}
        out = []
        for year, kind in asked:
            bonus = self._bonus(year, kind)
            score = lambda s, i: math.floor(max(0.0, min(1.0, 0.72 * s + bonus[i])) * 1000 + 0.5)  # noqa: B023, E731
            seen: list[tuple] = []
            for i in np.argsort(-(0.72 * bound + bonus), kind="stable"):
                if len(seen) == 2 and score(bound[i] + 1e-9, i) < -seen[1][0]:
                    break
                if i not in exact:
                    exact[i] = max([max(difflib.SequenceMatcher(None, title, self.names[k]).ratio(), shared[k]) for k in self.of[i]], default=0.0)
                e = self.entries[i]
                seen = sorted([*seen, (-score(exact[i], i), -e[4] if e[4] is not None else math.inf, e[0])])[:2]
            out.append((seen[0][2], -seen[0][0], seen[1][0] - seen[0][0] if len(seen) > 1 else -seen[0][0]) if seen else (None, 0, 0))
        return out


def best_entries(asked: DataFrame, entries: list[tuple]) -> DataFrame:
    """q, qy, qk (distinct) with catalogue_id, score and margin of the best of all entries; entries are broadcast."""
    sc = asked.sparkSession.sparkContext
    shared = sc.broadcast(entries)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        catalogue = Catalogue(shared.value)
        for b in batches:
            rows = []
            for q, years, kinds in zip(b["q"], b["years"], b["kinds"]):
                ways = [(None if y < 0 else int(y), None if k == "" else k) for y, k in zip(years, kinds)]
                rows += [(q, y, k, *got) for (y, k), got in zip(zip(years, kinds), catalogue.best(q, ways))]
            out = pd.DataFrame(rows, columns=["q", "qy", "qk", "catalogue_id", "score", "margin"])
            yield out.astype({"catalogue_id": "Int64"})

    # A year below 0 and an empty kind stand for none.
    by_title = asked.groupBy("q").agg(F.collect_list(F.struct("qy", "qk")).alias("x")).select("q", F.col("x.qy").alias("years"), F.col("x.qk").alias("kinds"))
    return by_title.repartition(max(2, sc.defaultParallelism), "q").mapInPandas(work, "q string, qy int, qk string, catalogue_id bigint, score bigint, margin bigint")

import random

from pyspark.sql import functions as F

from cuemill.llm import neardup


def _right(texts: list[str]) -> set[frozenset[str]]:
    """Components of all pairs of 0.8 or more."""
    sh = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts for w in [t.split()]}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                parent[find(a)] = find(b)
    return {frozenset(t for t in texts if find(t) == r) for r in map(find, texts)}


def _got(spark, texts):
    rows = neardup.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(rows) == len(texts)
    return {frozenset(r.text for r in rows if r.cluster == c) for c in {r.cluster for r in rows}}


def _chain(name: str, per: int) -> list[str]:
    """Three groups of texts, each like the next, the first unlike the last; and some like none."""
    words = [f"{name}{i}" for i in range(130)]
    return [" ".join([*words[s : s + 103], f"{name}x{s}v{v}"]) for s in (0, 9, 18) for v in range(per)] + [" ".join([*words[s : s + 40], f"{name}y{s}"]) for s in (30, 60)]


def test_chain_in_one_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BANDS", 1)
    monkeypatch.setattr(neardup, "ROWS", 1)
    texts = [t for k in range(6) for t in _chain(f"w{k}", 30)]
    bands, minima = neardup._bands()
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", neardup.shingles(F.split("text", " ")).alias("sh")).select("text", minima.alias("minima")).select("text", F.explode(bands).alias("bucket")).collect()
    buckets = [[r.text for r in rows if r.bucket == b] for b in {r.bucket for r in rows}]
    large = [b for b in buckets if len(b) > 64]
    assert len(large) > 2
    got = _got(spark, texts)
    for bucket in large:
        assert all(any(group <= g for g in got) for group in _right(bucket))


def test_all_buckets_large(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALT", 8)
    rng = random.Random(3)
    texts = set(_chain("w", 12)) | {"one two", "one three"}
    for k in range(8):
        base = [f"{rng.choice('abcdef')}{k}{rng.randrange(30)}" for _ in range(60)]
        texts |= {" ".join(base[s : s + 34]) for s in range(0, 26)}
    texts = sorted(texts)
    assert _got(spark, texts) == _right(texts)

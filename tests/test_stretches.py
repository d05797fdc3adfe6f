"""Pairs that meet on stretches of windows, against brute force; what must not be broadcast or copied."""

import random

import pytest

from oodmill.operators import similarity, stretches
from oodmill.plans import curation


def texts(seed=3, n=60):
    rng = random.Random(seed)
    draw = lambda m, letters: "".join(rng.choice(letters) for _ in range(m))
    out = set()
    for _ in range(n):
        letters = rng.choice(["ACDEFGHIKLMNPQRSTVWY", "AC", "ACD", "ACDEé", "ab*- "])
        base = draw(rng.randint(3, 120), letters)
        out.add(base)
        for _ in range(rng.randint(0, 4)):
            s = list(base)
            for _ in range(rng.randint(0, len(s) // 10 + 1)):
                s[rng.randrange(len(s))] = draw(1, letters)
            t = "".join(s)
            t = t[len(t) // 3 :] + t[: len(t) // 3] if rng.random() < 0.3 else t
            out.add(t + draw(60, letters) if rng.random() < 0.3 else t)
    return sorted(out)


def windows(s, k=5):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def test_window_pairs_match_brute_force(spark):
    w = {i: windows(s) for i, s in enumerate(texts()) if len(s) >= 5}
    want = {(i, j) for i in w for j in w if i < j and len(w[i] & w[j]) / len(w[i] | w[j]) >= 0.5}
    df = spark.createDataFrame(list(enumerate(texts())), "id bigint, s string")
    got = [(r["a"], r["b"]) for r in similarity.window_pairs(df, "id", "s", 5, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("limits", [{}, {"pass_keys": 2000, "bucket_keys": 300}])
def test_candidates_miss_no_pair(spark, limits):
    w = {i: windows(s) for i, s in enumerate(texts()) if len(s) >= 5}
    want = {(i, j) for i in w for j in w if i % 2 == 0 and j % 3 == 0 and len(w[i] & w[j]) >= 0.8 * min(len(w[i]), len(w[j])) - 1e-9}
    df = spark.createDataFrame(list(enumerate(texts())), "id bigint, seq string").cache()
    got = {(r["a"], r["b"]) for r in stretches.candidates(df.where("id % 2 = 0"), df.where("id % 3 = 0"), 5, 0.8, 4, **limits).collect()}
    assert want <= got


@pytest.mark.parametrize("query", [curation.kmer_blocked_dedup, curation.aligned_identity])
def test_sequences_are_not_broadcast(spark, sf, query):
    df = query(spark, sf)
    df.collect()
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()

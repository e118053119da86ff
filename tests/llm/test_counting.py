import itertools
import math
import random
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from weftgram.llm import cooccur, frequent, termcounts, topn


def test_frequent_against_counts(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, 2, 3]) if rng.random() < 0.6 else rng.randint(10, 5000), rng.randint(0, 400), rng.randint(0, 3)) for _ in range(4000)]
    data += data[:500] + [(None, 1, 1), (1, None, 1), (1, 1, None)]
    df = spark.createDataFrame(data, "v bigint, sid bigint, pos int")
    distinct = Counter(v for v, *_ in {d for d in data if None not in d})
    total = sum(distinct.values())
    for share, buckets in ((0.005, 4096), (0.05, 7), (0.9, 64)):
        got = {r["v"]: r["n_refs"] for r in frequent.frequent_values(df, "v", ["sid", "pos"], share, buckets=buckets).collect()}
        assert got == {v: c for v, c in distinct.items() if c >= share * total}


def test_frequent_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "v bigint, sid bigint, pos int, count bigint, b int")
    assert frequent.frequent_values(empty, "v", ["sid", "pos"], 0.1).count() == 0
    ties = spark.createDataFrame([(1, 1, 1, 0, 0), (2, 1, 1, 0, 0)], "v bigint, sid bigint, pos int, count bigint, b int")
    assert frequent.frequent_values(ties, "v", ["sid", "pos"], 0.5).count() == 2


def test_many_heavy_buckets(spark, monkeypatch):
    monkeypatch.setattr(frequent, "LISTED", 2)
    df = spark.createDataFrame([(v, i) for v in range(20) for i in range(5)] + [(100, 1)], "v bigint, sid bigint")
    got = {r["v"]: r["n_refs"] for r in frequent.frequent_values(df, "v", ["sid"], 0.04).collect()}
    assert got == {v: 5 for v in range(20)} and frequent.buckets_for(1e-5) == 1 << 21 and frequent.buckets_for(0.5) == 4096


def brute_top(data, n):
    best = {}
    for g, t, s in data:
        if g is not None and t is not None and s is not None and not math.isnan(s):
            best[g, t] = max(s, best.get((g, t), -math.inf))
    out = set()
    for g in {k[0] for k in best}:
        items = sorted(((t, s) for (h, t), s in best.items() if h == g), key=lambda x: (-x[1], x[0].encode()))
        out |= {(g, t, s, i) for i, (t, s) in enumerate(items[:n], 1)}
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_top_n(spark, parts):
    rng = random.Random(parts)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 30)}", rng.choice("aéz\U0001f642Ā") + str(rng.randint(0, 60)), rng.choice([0.5, 0.25, 1.0, 0.0])) for _ in range(3000)]
    data += data[:300] + [(None, "a", 1.0), ("g1", None, 1.0), ("g1", "a", None), ("g1", "nan", float("nan")), ("only", "one", -1.0), ("", "", 0.0)]
    df = spark.createDataFrame(data, "s string, t string, score double").repartition(parts)
    got = {tuple(r) for r in topn.top_n(df, "s", "t", "score", 3).collect()}
    assert got == brute_top(data, 3)


def test_many_groups_in_bounded_state(monkeypatch):
    """Whatever number of groups a partition has, few rows are held, and the bounds stay true."""
    monkeypatch.setattr(topn, "STATE_ROWS", 1000)
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 5000, 60_000)
    rows = pd.DataFrame({"g": [f"g{g}" for g in groups], "item": [f"t{i}" for i in rng.integers(0, 400, 60_000)], "score": rng.integers(0, 50, 60_000) / 50})
    out = list(topn.local_candidates(3)(rows.iloc[i : i + 3000] for i in range(0, 60_000, 3000)))
    assert max(map(len, out)) <= 2000 and len(out) > 10
    got = pd.concat(out)
    true = topn._best(rows, 3)
    third = true.groupby("g").nth(2).set_index("g").score
    bounds = got[got.bound].groupby("g").score.max()
    assert (bounds <= third.reindex(bounds.index)).all()
    assert set(true.itertuples(index=False, name=None)) <= set(got[["g", "item", "score"]].itertuples(index=False, name=None))


def test_two_million_groups_in_one_partition():
    """One partition of 2,000,000 groups stays under 1 GB, checked in a process of its own."""
    code = """
import resource, pandas as pd, numpy as np
from weftgram.llm import topn
def batches():
    for lo in range(0, 2_000_000, 10_000):
        g = pd.Series(np.arange(lo, lo + 10_000)).astype(str)
        yield pd.DataFrame({"g": g, "item": "item " + g, "score": 0.5})
n = sum(map(len, topn.local_candidates(3)(batches())))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    n, megabytes = map(int, out.stdout.split())
    assert n == 2_000_000 and megabytes < 1000


def test_top_n_empty(spark):
    df = spark.createDataFrame([], "s string, t string, score double, g int, bound int")
    assert topn.top_n(df, "s", "t", "score", 3).count() == 0


def brute_pairs(data, least, lift):
    held = {}
    for i, s in set(data):
        if i is not None and s is not None:
            held.setdefault(s, set()).add(i)
    single = Counter(i for x in held.values() for i in x)
    pairs = Counter(p for x in held.values() for p in itertools.combinations(sorted(x), 2))
    return {(a, b): c for (a, b), c in pairs.items() if c >= least and c * len(held) >= lift * single[a] * single[b]}


def baskets(seed, n=300):
    rng = random.Random(seed)
    data = [(rng.randint(1, 40), s) for s in range(n) for _ in range(rng.randint(1, 6))]
    data += [(i, s) for s in range(0, n, 25) for i in (101, 102)]
    return data + data[:50] + [(None, 1), (5, None)]


@pytest.mark.parametrize("giant", [2000, 8])
def test_pairs(spark, giant, monkeypatch):
    monkeypatch.setattr(cooccur, "GIANT", giant)
    data = baskets(5) + [(i, s) for s in (900, 901, 902) for i in [*range(1, 41), 101, 102]]
    df = spark.createDataFrame(data, "i bigint, s bigint")
    for least, lift in ((10, 0), (10, 15)):
        got = {(r["item_a"], r["item_b"]): r for r in cooccur.cooccurring_pairs(df, "i", "s", least, lift).collect()}
        expected = brute_pairs(data, least, lift)
        assert {k: r["n_ab"] for k, r in got.items()} == expected and expected
        assert all(r["ln_p"] <= 0 and r["ln_q"] <= 0 for r in got.values())
        assert got[101, 102]["ln_q"] < math.log(0.01)
    assert cooccur.cooccurring_pairs(df.limit(0), "i", "s", 10).count() == 0


def test_pooled_null_is_quick_and_near():
    """5,000 item classes by 3,000 basket classes, against the fit on all of them for some."""
    degrees, n = np.arange(1.0, 5001), np.maximum(1, 1e7 / np.arange(1.0, 5001) ** 2)
    sizes = np.arange(1.0, 3001)
    m = np.maximum(1, 1e6 / sizes**1.5)
    m *= (degrees * n).sum() / (sizes * m).sum()
    began = time.time()
    pooled_sizes, copies = cooccur.pooled(sizes, m)
    assert len(copies) <= 256 and copies.sum() == pytest.approx(m.sum()) and (copies * pooled_sizes).sum() == pytest.approx((m * sizes).sum())
    _, y = cooccur.fit_null(*cooccur.pooled(degrees, n), pooled_sizes, copies)
    x = cooccur.fitness(degrees, y, copies)
    assert time.time() - began < 10
    expected = (copies * x[:, None] * y / (1 + x[:, None] * y)).sum(1)
    assert np.allclose(expected, degrees, rtol=1e-6)


def test_surprise_against_exact_tails(spark):
    """Expected counts and tails of pairs against the sum over all baskets of the fitted null."""
    df = spark.createDataFrame(baskets(11), "i bigint, s bigint")
    held = {}
    for i, s in set(baskets(11)):
        if i is not None and s is not None:
            held.setdefault(s, set()).add(i)
    sizes = Counter(len(x) for x in held.values())
    single = Counter(i for x in held.values() for i in x)
    degrees = Counter(single.values())
    d, k = sorted(degrees), sorted(sizes)
    x, y = cooccur.fit_null(np.array(d, float), np.array([degrees[v] for v in d], float), np.array(k, float), np.array([sizes[v] for v in k], float))
    of = dict(zip(d, x, strict=True))
    for r in cooccur.cooccurring_pairs(df, "i", "s", 10).collect()[:20]:
        q = [of[r["n_a"]] * yy / (1 + of[r["n_a"]] * yy) * of[r["n_b"]] * yy / (1 + of[r["n_b"]] * yy) for yy, kk in zip(y, k, strict=True) for _ in range(sizes[kk])]
        assert r["expected"] == pytest.approx(sum(q), rel=1e-3)
        dist = np.array([1.0])
        for p in q:
            dist = np.convolve(dist, [1 - p, p])
        if r["n_ab"] > sum(q):
            exact = math.log(dist[r["n_ab"] :].sum())
            assert r["ln_p"] == pytest.approx(exact, abs=0.06 + 0.02 * abs(exact))


def test_large_baskets_in_blocks(spark, monkeypatch):
    """More large baskets than the least count: the rest is paired in blocks, with the same counts."""
    monkeypatch.setattr(cooccur, "GIANT", 7)
    data = [(i, s) for s in range(14) for i in range(1, 31) if (i * 7 + s) % 5]
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in cooccur.cooccurring_pairs(spark.createDataFrame(data, "i bigint, s bigint"), "i", "s", 8).collect()}
    assert got == brute_pairs(data, 8, 0) and got


def test_null_keeps_degrees():
    degrees, n = np.array([1.0, 3.0, 20.0]), np.array([30.0, 10.0, 2.0])
    sizes, m = np.array([1.0, 4.0]), np.array([20.0, 20.0])
    assert (degrees * n).sum() == (sizes * m).sum()
    x, y = cooccur.fit_null(degrees, n, sizes, m)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * m).sum(1), degrees, rtol=1e-6) and np.allclose((p * n[:, None]).sum(0), sizes, rtol=1e-6)


def test_tail_against_convolution():
    rng = np.random.default_rng(0)
    q, copies = rng.uniform(0.001, 0.3, (1, 4)), np.array([30.0, 10.0, 5.0, 2.0])
    dist = np.array([1.0])
    for k, c in enumerate(copies):
        for _ in range(int(c)):
            dist = np.convolve(dist, [1 - q[0, k], q[0, k]])
    mean = (copies * q).sum()
    for count in range(int(mean) + 2, 35):
        exact = math.log(dist[count:].sum())
        assert cooccur.upper_tail_ln(q, copies, np.array([count]))[0] == pytest.approx(exact, abs=0.06 + 0.01 * abs(exact))
    assert cooccur.upper_tail_ln(q, copies, np.array([0]))[0] == 0
    assert cooccur.upper_tail_ln(q, copies, np.array([48]))[0] == -math.inf


def test_q_values_against_exact(spark):
    rng = random.Random(2)
    lns = [-rng.expovariate(0.2) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lns)], "i int, ln_p double")
    got = {r["i"]: r["ln_q"] for r in cooccur.with_q_values(df, 5000).collect()}
    ranked = sorted(range(400), key=lambda i: lns[i])
    q, low = {}, 0.0
    for rank in range(400, 0, -1):
        i = ranked[rank - 1]
        low = min(low, lns[i] + math.log(5000 / rank))
        q[i] = low
    assert all(q[i] - 1e-9 <= got[i] <= q[i] + 0.021 for i in q)


def test_terms(spark):
    data = [(i, "a  b\tc" if i % 2 else "a a", f" x{i} ") for i in range(1, 61)] + [(1, "a b c", "x1"), (2, None, ""), (None, "z", "z"), (99, "  ", None)]
    df = spark.createDataFrame(data, "pair_id bigint, s string, t string")
    got = {(r["side"], r["term"]): tuple(r)[2:] for r in termcounts.term_counts(df, "pair_id", {"source": "s", "target": "t"}).collect()}
    assert got["source", "a"] == (90, 60, 61, "common") and got["source", "b"] == (30, 30, 61, "common")
    assert got["target", "x7"] == (1, 1, 61, "rare") and ("source", "z") not in got and ("source", "") not in got
    assert len(got) == 3 + 60
    assert termcounts.term_counts(df.limit(0), "pair_id", {"source": "s"}).count() == 0


def test_terms_in_small_blocks(spark, monkeypatch):
    from weftgram.operators import accumulate

    monkeypatch.setattr(accumulate, "WIDTH", 4)
    rng = random.Random(4)
    data = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5))) for i in range(400)]
    df = spark.createDataFrame(data, "pair_id bigint, s string").repartition(5)
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in termcounts.term_counts(df, "pair_id", {"s": "s"}).collect()}
    occ = Counter(w for _, t in data for w in t.split())
    rec = Counter(w for _, t in data for w in set(t.split()))
    assert got == {w: (occ[w], rec[w]) for w in occ}

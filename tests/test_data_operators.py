import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgram.operators import hotkeys, rawrecords, tablediff
from weftgram.operators import accumulate

PHRASES = {
    "a ||| b ||| 0.5": None,
    ' "a ||| x" ||| "b""c" |||  1 0. .5 1e-3 +0 ': None,
    "a|||b|||0.5\r": None,
    "a || b ||| c ||| 1": None,
    'a ||| b ||| "0.5 1"': None,
    "a ||| b": "scores: missing",
    "a": "target: missing",
    "": "target: missing",
    " ||| b ||| 1": "source: empty",
    '"" ||| b ||| 1': "source: empty",
    'a ||| " " ||| 1': "target: empty",
    'a "b ||| c ||| 1': "source: broken quoting",
    '"a"b ||| c ||| 1': "source: broken quoting",
    'a ||| "c ||| 1': "target: broken quoting",
    "a ||| b ||| 1 ||| 2": "too many fields",
    "a ||| b ||| ": "scores: not one to five numbers",
    "a ||| b ||| 1 1 1 1 1 1": "scores: not one to five numbers",
    "a ||| b ||| 0,5": "scores: not one to five numbers",
    "a ||| b ||| nan": "scores: not one to five numbers",
    "a ||| b ||| .": "scores: not one to five numbers",
    "a ||| b ||| ١": "scores: not one to five numbers",
    "a ||| b |||| 1": "scores: not one to five numbers",
    "a ||| b ||| 1.5": "scores: not within 0 and 1",
    "a ||| b ||| -1e-9": "scores: not within 0 and 1",
    "a ||| b ||| 1e999": "scores: not within 0 and 1",
    None: "null line",
}


def test_phrase_lines(spark):
    lines = list(PHRASES)
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_id bigint, line string, source string")
    got = {lines[r["line_id"]]: r for r in rawrecords.parse_phrase_lines(df).collect()}
    assert {k: r["reason"] for k, r in got.items()} == PHRASES
    quoted = got[' "a ||| x" ||| "b""c" |||  1 0. .5 1e-3 +0 ']
    assert (quoted["source"], quoted["target"], quoted["scores"]) == ("a ||| x", 'b"c', [1.0, 0.0, 0.5, 0.001, 0.0])
    assert rawrecords.parse_phrase_lines(df.limit(0)).count() == 0


LM = [
    ("\\data\\", "structure"), ("ngram 1=2", "structure"), ("-1\ta", "failed"), ("\\1-grams: \r", "structure"), ("-1\ta\t-0.5", "entry"), (" -1 \t a \t", "entry"), ("0\t<unk>", "entry"), ("-.5\ta\r", "entry"),
    ("0.1\ta", "failed"), ("-1\ta b", "failed"), ("-1", "failed"), ("-1\t \t-1", "failed"), ("-1\ta\tx", "failed"), ("-1\ta\t1\t1", "failed"), ("-1e999\ta", "failed"), ("-1\ta\t1e999", "failed"), ("", "structure"), ("  ", "structure"),
    ("\\2-grams:", "structure"), ("-1\ta b\t0.3", "entry"), ("-1\ta", "failed"), ("x\ta b", "failed"), ("\\end\\", "structure"), ("-1\ta b", "entry"), (None, "failed"), ("ngram 1 = 2", "failed"),
]


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_lm_lines(spark, block):
    data = [(i, 1, x) for i, (x, _) in enumerate(LM, 1)] + [(1000, 2, "-1\ta b")]
    df = spark.createDataFrame(data, "line_id bigint, file_no int, line string").repartition(5)
    got = {r["line_id"]: r for r in rawrecords.parse_lm_lines(df, block).collect()}
    assert [got[i]["kind"] for i in range(1, len(LM) + 1)] == [k for _, k in LM]
    assert got[1000]["reason"] == "ngram: no section above"
    assert all((r["reason"] is None) == (r["kind"] != "failed") for r in got.values())
    assert got[20]["ngram"] == "a b" and got[20]["k"] == 2 and got[20]["backoff"] == 0.3
    assert got[9]["reason"] == "logprob: above 0" and got[13]["reason"] == "backoff: not a number" and got[10]["reason"] == "ngram: wrong number of words"


def test_long_lines(spark):
    """A line of any length takes one pass: no call stack, no backtracking."""
    word = "w" * 5 + " "
    phrases = ["a ||| b ||| " + " ".join(["1" * 300] * 5) + " x", "a ||| b ||| " + " ".join(["0" * 300] * 5), "a" + " " * 1_000_000 + "b ||| c ||| 1", '"' + '""' * 500_000 + '" ||| b ||| 1', "a ||| b ||| 1" + " " * 1_000_000 + "x"]
    df = spark.createDataFrame(list(enumerate(phrases)), "line_id bigint, line string")
    began = time.time()
    got = {r["line_id"]: r["reason"] for r in rawrecords.parse_phrase_lines(df).select("line_id", "reason").collect()}
    lines = ["\\1-grams:", "-1\t" + word * 1_000_000, "-1\t" + word * 1_000_000 + "\t" + " " * 1_000_000 + "x", "-1" + " " * 1_000_000 + "\ta", "-" + "1" * 1_000_000 + "\ta"]
    lm = spark.createDataFrame([(i, 1, x) for i, x in enumerate(lines)], "line_id bigint, file_no int, line string")
    found = {r["line_id"]: r["reason"] for r in rawrecords.parse_lm_lines(lm).select("line_id", "reason").collect()}
    assert time.time() - began < 30
    bad = "scores: not one to five numbers"
    assert got == {0: bad, 1: None, 2: None, 3: None, 4: bad}
    assert found == {0: None, 1: "ngram: wrong number of words", 2: "backoff: not a number", 3: None, 4: "logprob: not finite"}


def test_key_profile(spark, monkeypatch):
    monkeypatch.setattr(accumulate, "WIDTH", 3)
    rng = random.Random(0)
    data = [(i, rng.choice(["hot", "hot", f"k{rng.randint(0, 50)}"]), f"t{rng.randint(0, 20)}") for i in range(500)]
    noisy = data + [(i, f"  {k}\t", t) for i, k, t in data[:100]] + [(700, None, "x"), (701, "lone", None), (None, "hot", "q"), (702, "", "e")]
    df = spark.createDataFrame(noisy, "rid bigint, key string, bucket string").repartition(6)
    got = {r["key"]: r for r in hotkeys.key_profile(df, "rid", "key", "bucket").collect()}
    for key in {k for _, k, _ in data}:
        extra = {"q"} if key == "hot" else set()
        assert got[key]["n_records"] == len({i for i, k, _ in data if k == key})
        assert got[key]["n_items"] == len({t for _, k, t in data if k == key} | extra)
    assert got["lone"]["n_records"] == 1 and got["lone"]["flat_score"] is None and got[""]["n_items"] == 1
    assert {r["n_all"] for r in got.values()} == {503}
    assert hotkeys.key_profile(df.limit(0), "rid", "key", "bucket").count() == 0


def brute_diff(a, b):
    def same(x, y):
        if x is None or y is None:
            return x is y
        if len(x) != len(y):
            return False
        close = lambda p, q: p is q or (p is not None and q is not None and (p == q or (p != p and q != q) or abs(p - q) <= 1e-9))
        return all(close(p, q) for p, q in zip(x, y, strict=True))

    out = set()
    for k in {*a, *b}:
        if k not in b:
            out.add((*k, "only_a"))
        elif k not in a:
            out.add((*k, "only_b"))
        else:
            (s1, w1, c1), (s2, w2, c2) = a[k], b[k]
            out |= {(*k, f) for f, ok in (("sc", same(s1, s2)), ("wa", w1 == w2), ("cnt", c1 == c2)) if not ok}
    return out


def test_differences(spark):
    rng = random.Random(7)
    nan = float("nan")
    scores = [None, [], [0.25], [nan], [0.5, nan], [1e12, 2.0], [float("inf")], [0.1, None]]
    a = {("hot" if rng.random() < 0.4 else f"s{rng.randint(0, 40)}", f"t{i}"): (rng.choice(scores), rng.choice([None, "", "0-0"]), rng.choice([None, 1, 2])) for i in range(2500)}
    b = dict(a)
    for k in rng.sample(sorted(a), 60):
        del b[k]
    for k in rng.sample(sorted(b), 60):
        s, w, c = b[k]
        b[k] = rng.choice([(rng.choice(scores), w, c), (s, "1-1", c), (s, w, 9), (None if s else [0.3], "x", None)])
    for i in range(40):
        b["hot", f"new{i}"] = ([0.5], None, 1)
    b = {k: ([x + 1e-13 if x is not None and x == x and abs(x) < 10 else x for x in s] if s else s, w, c) for k, (s, w, c) in b.items()}
    schema = "s string, t string, sc array<double>, wa string, cnt bigint, side int, h int"
    frame = lambda d, pad: spark.createDataFrame([(pad + k[0], k[1] + pad, *v, 0, 0) for k, v in d.items()] + [(None, "x", None, None, None, 0, 0)], schema)
    fa, fb = frame(a, ""), frame(b, " \t")
    got = [tuple(r) for r in tablediff.differences(fa.unionByName(fa.limit(200)), fb.repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_diff(a, b)
    only = {tuple(r)[2] for r in tablediff.differences(fa, fb.limit(0)).collect()}
    assert only == {"only_a"}
    assert tablediff.differences(fa.limit(0), fb.limit(0)).count() == 0


def test_chunks_match_between_copies(spark):
    """An inserted row costs the chunks near it, not the rest."""
    base = spark.range(20000).selectExpr("lpad(id, 6, '0') AS s", "'t' AS t", "array(0.5D) AS sc", "'w' AS wa", "id AS cnt")
    extra = spark.createDataFrame([("010000x", "t", [0.5], "w", 1)], "s string, t string, sc array<double>, wa string, cnt bigint")
    assert [tuple(r) for r in tablediff.differences(base, base.unionByName(extra)).collect()] == [("010000x", "t", "only_b")]


def test_few_rows_are_compared(spark):
    """What is looked up in full stays near the rows that differ."""
    base = spark.range(200_000).selectExpr("CAST(id AS STRING) AS s", "'t' AS t", "array(id / 7, 0.5D) AS sc", "'w' AS wa", "id AS cnt")
    other = base.withColumn("cnt", F.when(F.col("cnt") % 500 == 0, -1).otherwise(F.col("cnt"))).filter("cnt % 700 <> 1")
    rows = [tablediff.hashed_rows(x) for x in (base, other)]
    differing = tablediff.differences(base, other).count()
    suspects = tablediff.suspect_keys(*rows).count()
    assert differing == 400 + 286 and differing <= suspects <= 8 * differing  # the small chunk of each, about four rows, and a neighbour's


def test_chunks_at_batch_borders():
    """The same chunks come out however the sorted rows are batched."""
    rng = np.random.default_rng(1)
    kh = np.sort(rng.integers(-(1 << 62), 1 << 62, 9000))
    bucket, h = np.repeat([1, 2, 5], 3000), rng.integers(-(1 << 62), 1 << 62, 9000)
    whole = pa.RecordBatch.from_arrays([pa.array(np.zeros(9000, np.int32)), pa.array(bucket), pa.array(kh), pa.array(h)], names=["side", "bucket", "kh", "h"])
    cut = lambda n: pa.Table.from_batches(list(tablediff.cut_chunks(whole.slice(i, n) for i in range(0, 9000, n)))).to_pylist()
    assert cut(9000) == cut(1000) == cut(7) and [k for r in cut(7) for k in r["keys"]] == kh.tolist()


def test_grid_is_within_tolerance(spark):
    pairs = [(0.1, 0.1 + d) for d in (1e-13, 4e-10, 9e-10, 1.1e-9, 3e-9)] + list(itertools.product([0.0, -0.0], repeat=2))
    df = spark.createDataFrame([([x], [y]) for x, y in pairs], "x array<double>, y array<double>")
    got = df.select(tablediff.canonical_scores(df.x).alias("a"), tablediff.canonical_scores(df.y).alias("b")).collect()
    for (x, y), r in zip(pairs, got, strict=True):
        assert r.a != r.b or abs(x - y) <= 1e-9

"""Pattern expressions on the published cases; classes: 6 be, 7 To, 8 to, 9 or, 10 not, 73477272 blah."""

import pytest
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.functions.gaps import gap_masks, runs

WORDS = {"be": 6, "To": 7, "to": 8, "or": 9, "not": 10, "blah": 73477272}


def encode(text):
    out = []
    for w in text.split():
        out += [0] * int(w[2]) if w.startswith("{*") else [WORDS[w]]
    return out


@pytest.fixture
def one(spark):
    def value(expression, **patterns):
        df = spark.range(1).select(*(F.array(*map(F.lit, encode(t) if isinstance(t, str) else t)).alias(k) for k, t in patterns.items()))
        return df.select(expression.alias("x")).first()["x"]

    return value


def test_gap_configurations():
    assert [len(gap_masks(n, whole=True)) for n in range(1, 10)] == [1, 3, 6, 10, 20, 40, 80, 160, 315]
    by_gaps = [len([m for m in gap_masks(8, whole=True) if len(runs(m)) == g]) for g in (1, 2, 3)]
    assert by_gaps == [26, 100, 34]
    assert (1, 0, 1) not in gap_masks(3)


def test_ngrams(one):
    s = "To be or not to be"
    assert one(P.length("p"), p=s) == 6
    assert len(one(P.subngrams("p"), p=s)) == 20
    assert one(P.subngrams("p"), p="to") == []
    assert len(one(P.splits("p"), p=s)) == 5
    assert [one(P.contains("p", "q"), p=s, q=q) for q in ("or not", "to not", "to be", "or")] == [True, False, True, True]
    assert one(P.piece("p", 1, 2), p=s) == encode("be or")
    assert one(P.windows("p", 7), p=s) == []


def test_skipgrams(one):
    s = "To {*1*} or {*1*} to be"
    assert one(P.parts("p"), p=s) == [encode("To"), encode("or"), encode("to be")]
    full, content = "To be or not to be", "be {*1*} not"
    assert one(P.skip_content("i", "p"), i=full, p=s) == encode(content)
    assert one(P.instantiate("p", "c"), p=s, c=content) == encode(full)
    assert one(P.fillers("i", "p"), i=full, p=s) == [encode("be"), encode("not")]
    t = "be {*1*} not {*2*} be"
    spans = lambda x: [tuple(r) for r in x]
    assert spans(one(P.gap_spans("p"), p=t)) == [(1, 1), (3, 2)]
    assert spans(one(P.part_spans("p"), p=t)) == [(0, 1), (2, 1), (5, 1)]
    assert one(P.mask("p"), p=t) == [True, False, True, False, False, True]
    assert one(P.token("p", 5), p=t) == 6 and one(P.token("p", 1), p=t) == 2 and one(P.token("p", 9), p=t) is None
    assert one(P.piece("p", 2, 4), p=t) == encode("not {*2*} be")
    assert one(P.piece("p", 1, 3), p=t) == encode("{*1*} not {*1*}")
    u = "{*1*} or blah {*2*}"
    assert one(P.length("p"), p=u) == 5 and one(P.gap_count("p"), p=u) == 2
    assert spans(one(P.gap_spans("p"), p=u)) == [(0, 1), (3, 2)] and spans(one(P.part_spans("p"), p=u)) == [(1, 2)]
    assert one(P.mask("p"), p=u) == [False, True, True, False, False]
    assert one(P.token("p", 2), p=u) == WORDS["blah"]
    assert one(P.gap_ratio("p"), p=u) == pytest.approx(0.6)


def test_templates(one):
    relation = lambda a, b: one(P.template_relation("a", "b"), a=a, b=b)
    assert relation("be {*1*} or not", "be {*2*} not") == 1
    assert relation("be {*2*} not", "be {*1*} or not") == -1
    assert relation("be {*1*} not", "be {*1*} not") == 0
    assert relation("be {*1*} not or", "be or {*1*} or") == 0
    assert relation("be or", "be or not") == 0


def test_match_and_context(one):
    assert one(P.matches_at("s", "p", 0), s="To be or not", p="To {*1*} or")
    assert not one(P.matches_at("s", "p", 2), s="To be or not", p="To {*1*} or")
    assert not one(P.matches_at("s", "p", 3), s="To be or not", p="not or")
    c = P.with_context("s", F.lit(0), F.lit(1), 2, 2)
    assert one(c, s="To be") == [3, 3, 7, 6, 4]


def test_text(spark):
    df = spark.createDataFrame([("a {*2*} b {*1*}",)], "t string").select(P.parse_words("t").alias("p"))
    assert df.first()["p"] == ["a", "{*}", "{*}", "b", "{*}"]
    assert df.select(P.render_words("p")).first()[0] == "a {*2*} b {*1*}"


def test_class_bytes(spark):
    df = spark.createDataFrame([(1,), (256,), (258,), (65537,), (73477272,)], "c int")
    got = df.select("c", F.hex(P.class_bytes("c")).alias("h"), P.valid_class("c").alias("v")).collect()
    assert [(r.c, bytes.fromhex(r.h) == r.c.to_bytes(4, "little").rstrip(b"\0"), r.v) for r in got] == [(1, True, True), (256, True, False), (258, True, True), (65537, True, False), (73477272, True, True)]


def test_scores_and_nulls(spark):
    df = spark.createDataFrame([([0.5, 0.25],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in df.select(P.product("s")).collect()] == [0.125, 1.0, None]
    assert [r[0] for r in df.select(P.total("s")).collect()] == [0.75, 0.0, None]
    assert df.select(P.length(F.col("s"))).collect()[2][0] in (None, -1)

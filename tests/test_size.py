"""What the operators move: rows written for shuffles stay near the input where the data are skewed."""

import random

import pytest
from pyspark.sql import functions as F

from weftgram.operators import align, graph, mining, reports
from weftgram.operators.model import PatternModel
from weftgram.operators.numbered import Finder
from weftgram.plans import skipgram_queries


@pytest.fixture
def moved(spark):
    """Result of an action and the rows that its stages wrote for shuffles."""

    def run(action):
        def total():
            spark._jsc.sc().listenerBus().waitUntilEmpty()
            jvm = spark._jvm
            stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
            return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

        before = total()
        out = action()
        return out, total() - before

    return run


def test_joint_sentences_of_a_frequent_pattern(spark, moved):
    """a pattern of every sentence with a hundred partners moves its sentences once, not for each partner."""
    n = 2000
    both = F.array(F.struct(F.lit(0).alias("pos"), F.array(F.lit(6)).alias("pattern")), F.struct(F.lit(1).alias("pos"), F.array(F.lit(7), (F.col("id") % 100 + 8).cast("int")).alias("pattern")))
    raw = spark.range(n).select(F.col("id").alias("sid"), F.explode(both).alias("x")).select("x.pattern", "sid", "x.pos")
    raw = raw.unionByName(raw.filter("sid < 50"))
    posts = graph.clean_postings(raw)
    edges = graph.followed(graph.by_sentence(raw))
    held = lambda df: sorted((tuple(r["src"]), tuple(r["dst"]), r["w"]) for r in df.collect())
    assert held(edges.filter("dst IS NOT NULL")) == held(graph.successors(posts))
    assert {tuple(r["src"]): r["w"] for r in edges.filter("dst IS NULL").collect()} == {tuple(r["pattern"]): r["cnt"] for r in graph.pattern_counts(posts).collect()}
    pairs = spark.createDataFrame([([6], [7, k + 8]) for k in range(100)] + [([7, 9], [6])], "a array<int>, b array<int>")
    got, rows = moved(lambda: graph.shared_sentences(raw, pairs).collect())
    assert len(got) == 101 and {r["joint"] for r in got} == {n // 100}
    assert rows < 10 * n


GAP = "{*}"


@pytest.fixture
def model(spark):
    """A model of skipgrams whose postings may not be asked: the contents say what its relations need."""
    corpus = spark.createDataFrame([(k, f"to {w} {x} it".split()) for k, (w, x) in enumerate([("be", "or"), ("see", "or"), ("be", "and"), ("see", "and")] * 2)], "sid bigint, tokens array<string>")
    mined = mining.mine(corpus, 4, mining.Thresholds(2, 2, 2), skipgrams=True, gap=GAP)

    class Asked:
        def __getattr__(self, name):
            raise AssertionError("occurrences of skipgrams are read")

    return mined, mining.Mined(mined.patterns, mined.postings, Asked(), mined.contents)


def same(monkeypatch, spark, model, name, expected):
    monkeypatch.setattr(skipgram_queries, "model", lambda *_: model)
    got = skipgram_queries.QUERIES[name](spark, "")
    text = [F.array_join(c, " ").alias(c) if t.startswith("array") else c for c, t in expected.dtypes]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*text).collect())) != []


def test_instances_from_contents(spark, model, monkeypatch):
    """F2"""
    mined, shut = model
    same(monkeypatch, spark, shut, "rel_instances", graph.instances(mined.skip_postings, mined.patterns.filter("NOT is_skip")))


def test_siblings_from_contents(spark, model, monkeypatch):
    """F5"""
    mined, shut = model
    edges = graph.instances(mined.skip_postings, mined.patterns.filter("NOT is_skip"))
    same(monkeypatch, spark, shut, "rel_siblings", graph.sibling_templates(edges, GAP))


def test_skip_contents_from_contents(spark, model, monkeypatch):
    """F8"""
    mined, shut = model
    same(monkeypatch, spark, shut, "rel_skipcontent", graph.skip_relations(mined.skip_postings, mined.patterns, GAP))


def test_weights_of_words_with_many_parents(spark, moved):
    """a pair with 200 parents on either side does not meet all pairs of parents."""
    n = 200
    pair = spark.createDataFrame([("a", "x", 0.5), ("a0", "x0", 0.5), ("a1", "x", 0.5)], "src string, tgt string, score double")
    parents = lambda c: spark.range(n).select(F.lit(c).alias("child"), F.concat(F.lit(c), F.col("id").cast("string")).alias("parent"))
    got, rows = moved(lambda: {(r["src"], r["tgt"]): r["w"] for r in align.graph_weights(pair, parents("a"), parents("x")).collect()})
    assert got == {("a", "x"): 1 - n / 2, ("a0", "x0"): 1.0, ("a1", "x"): -n / 2}
    assert rows < 30 * n


def lines(spark, seed, n=300, words="a b c d <e> f&g", rare=5):
    """Sentences of few words, here and there one that is found nowhere else."""
    rng = random.Random(seed)
    text = [[rng.choice(words.split()) if rng.random() > 0.1 else f"r{rng.randrange(n * rare)}" for _ in range(rng.choice((1, 2, 5, 9)))] for _ in range(n)]
    return spark.createDataFrame(list(enumerate(text)), "sid bigint, tokens array<string>")


def by_words(monkeypatch, corpus, *args):
    """A model mined on the words themselves."""
    with monkeypatch.context() as m:
        m.setattr(mining.numbered, "mine", lambda *_: None)
        return mining.mine(corpus, *args, skipgrams=True, gap=GAP)


@pytest.mark.parametrize(("least", "words"), [((5, 2, 2), "a b c d <e> f&g"), ((9, 1, 1), "a b c d"), ((4, 3, 2), "a b {*} c d")])
def test_mining_in_numbers(spark, rows, monkeypatch, least, words):
    """the tables of a model are the same in numbers and in words, also where a word reads as a gap."""
    corpus = lines(spark, 1, words=words)
    got = mining.mine(corpus, 5, mining.Thresholds(*least), skipgrams=True, gap=GAP)
    expected = by_words(monkeypatch, corpus, 5, mining.Thresholds(*least))
    assert got.numbered is not None and expected.numbered is None
    for name in ("patterns", "postings", "skip_postings", "contents"):
        held = getattr(expected, name)
        assert rows(getattr(got, name), *held.columns) == rows(held) != []


def test_marks_where_read(spark, rows, moved, monkeypatch):
    """tokens are marked in their sentence, occurrences are not moved to it."""
    train, test = lines(spark, 1, 400), lines(spark, 2)
    got, old = mining.mine(train, 5, mining.Thresholds(5, 2, 2), skipgrams=True, gap=GAP), by_words(monkeypatch, train, 5, mining.Thresholds(5, 2, 2))
    finder = Finder.of(got.numbered, GAP)
    html, rows_moved = moved(lambda: rows(reports.coverage_html_found(test, finder)))
    found = mining.postings(test, old.patterns.filter("NOT is_skip"), 5), mining.find_skipgrams(test, old.patterns, 5, GAP)
    assert html == rows(reports.coverage_html(test, *found, gap=GAP)) and any("enclosed skipgram" in h for _, h in html)
    assert rows_moved == 0


def test_coverage_where_read(spark, rows, moved, monkeypatch):
    """covered tokens are counted in their sentence, only sums are moved."""
    train, test = lines(spark, 1, 400), lines(spark, 2)
    got, old = mining.mine(train, 5, mining.Thresholds(5, 2, 2), skipgrams=True, gap=GAP), by_words(monkeypatch, train, 5, mining.Thresholds(5, 2, 2))
    finder = Finder.of(got.numbered, GAP)
    sums, rows_moved = moved(lambda: rows(reports.coverage_found(test, finder)))
    found = mining.postings(test, old.patterns.filter("NOT is_skip"), 5), mining.find_skipgrams(test, old.patterns, 5, GAP)
    assert sums == rows(reports.coverage(test, *found, gap=GAP)) and min(sums[0]) > 0
    assert rows_moved < 10
    assert rows(reports.coverage_found(test.filter("sid < 0"), finder)) == [(0, 0, 0, 0, 0)]


@pytest.mark.parametrize("words", ["a b c d <e> f&g", "a b {*} c d"])
def test_model_by_sentence(spark, rows, tmp_path, words):
    """a stored model holds each sentence once and gives the same tables when read again."""
    corpus = lines(spark, 1, words=words)
    made = PatternModel.train(corpus, gap=GAP, max_n=5, thresholds=mining.Thresholds(5, 2, 2), skipgrams=True)
    made.save(str(tmp_path / "m"))
    again = PatternModel.load(spark, str(tmp_path / "m"), gap=GAP)
    for name in ("patterns", "postings", "skip_postings", "contents"):
        held = getattr(made, name)
        assert rows(getattr(again, name), *held.columns) == rows(held) != []
    assert spark.read.parquet(str(tmp_path / "m/sentences")).agg(F.sum("sentences")).first()[0] == corpus.count()
    assert not (tmp_path / "m/skip_postings").exists()
    PatternModel(made.patterns.limit(1), made.postings.limit(1), made.skip_postings.limit(1), gap=GAP).save(str(tmp_path / "m"))
    assert PatternModel.load(spark, str(tmp_path / "m"), gap=GAP).contents.count() == 1

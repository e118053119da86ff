import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.operators import align, classify, decode, lm, wordalign
from weftgram.operators import phrasetables as pt
from weftgram.plans import align_queries, pipeline
from weftgram.sources import tables

S = {1: "a b", 2: "a c", 3: "b"}
T = {1: "x y", 2: "x z", 3: "y"}


@pytest.fixture
def sides(spark):
    make = lambda d: spark.createDataFrame([([w], i) for i, t in d.items() for w in t.split()] + [(None, 1), (["q"], None)], "pattern array<string>, sid bigint")
    return make(S), make(T)


def pairs(df, *cols):
    return {(r["src"][0], r["tgt"][0]): r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols) for r in df.collect()}


def test_jaccard(sides):
    got = pairs(align.cooc_scores(*sides), "score")
    assert got == pytest.approx({("a", "x"): 1, ("a", "y"): 1 / 3, ("a", "z"): 0.5, ("b", "x"): 1 / 3, ("b", "y"): 1, ("c", "x"): 0.5, ("c", "z"): 1})
    assert pairs(align.cooc_scores(*sides, 0.5), "score").keys() == {k for k, v in got.items() if v >= 0.5}
    assert pairs(align.cooc_scores(*sides, measure="dice"), "score")["a", "y"] == pytest.approx(0.5)
    best = align.train_cooc(*sides, bestn=1, normal=False)
    assert pairs(best, "score") == {("a", "x"): 1, ("b", "y"): 1, ("c", "z"): 1}
    shares = defaultdict(float)
    for (s, _), v in pairs(align.train_cooc(*sides), "score").items():
        shares[s] += v
    assert all(v == pytest.approx(1) for v in shares.values())
    assert align.cooc_scores(sides[0].limit(0), sides[1]).count() == 0


@pytest.mark.parametrize(
    ("rounds", "expected"),
    [(1, [0.5, 0.25, 0.25, 0.25, 0.75, 0.5, 0.5]), (2, [0.666667, 0.142857, 0.190476, 0.16, 0.84, 0.428571, 0.571429]), (3, [0.781635, 0.080281, 0.138084, 0.094497, 0.905503, 0.342857, 0.657143])],
)
def test_em(sides, rounds, expected):
    got = pairs(align.train_em(*sides, rounds), "score")
    keys = [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "z")]
    assert [got[k] for k in keys] == pytest.approx(expected, abs=1e-6)


def test_em_options(sides):
    null = align.train_em(*sides, 2, null=True, null_pattern=F.array(F.lit("0")))
    sums = defaultdict(float)
    for (s, _), v in pairs(null, "score").items():
        sums[s] += v
    assert set(sums) == {"a", "b", "c", "0"} and all(v == pytest.approx(1) for v in sums.values())
    assert align.train_em(*sides, 50, epsilon=0.5).count() == 7
    init = align.train_cooc(*sides)
    assert pairs(align.train_em(*sides, 1, init=init), "score")["a", "x"] > 0.5
    assert align.train_em(*sides, 3, bestn=1).count() == 3


def test_intersections(sides):
    f, b = align.train_cooc(*sides), align.train_cooc(sides[1], sides[0])
    both = pairs(align.two_scores(f, b), "p_ts", "p_st")
    one = pairs(align.intersect(f, b), "score")
    assert {k: v[0] * v[1] for k, v in both.items()} == pytest.approx(one)
    assert len(pairs(align.two_scores(f, b, 0.5, 0.5), "p_ts")) < len(both)
    counts = f.select("src", "tgt", F.lit(1.0).alias("c"))
    assert pairs(align.integrate_reverse(counts), "p_ts", "p_st")["a", "x"] == pytest.approx((1 / 3, 1 / 3))
    assert align.alignment_stats(f).first()["pairs"] == 7


def test_graph_weights(spark):
    a = spark.createDataFrame([("s", "t", 0.5), ("S", "T", 0.25), ("u", "t", 0.5), ("S", "t", 0.5)], "src string, tgt string, score double")
    ps = spark.createDataFrame([("s", "S"), ("u", "U")], "child string, parent string")
    ptt = spark.createDataFrame([("t", "T")], "child string, parent string")
    got = {(r["src"], r["tgt"]): (r["w"], r["weighted"]) for r in align.graph_weights(a, ps, ptt).collect()}
    assert got == {("s", "t"): (1.0, 1.0), ("S", "T"): (1.0, 1.0), ("u", "t"): (0.0, 0.5), ("S", "t"): (0.0, 0.5)}
    crossed = a.filter("NOT (src = 'S' AND tgt = 'T')")
    got = {(r["src"], r["tgt"]): r["w"] for r in align.graph_weights(crossed, ps, ptt).collect()}
    assert got == {("s", "t"): -0.5, ("u", "t"): 0.0, ("S", "t"): -0.5}


def test_keywords(spark):
    src = {1: "bank money", 2: "bank money", 3: "bank river", 4: "bank river the", 5: "bank the money"}
    tgt = {1: "x", 2: "x", 3: "y", 4: "y", 5: "x"}
    occ = lambda d: spark.createDataFrame([([w], i) for i, t in d.items() for w in t.split()], "pattern array<string>, sid bigint")
    s, t = occ(src), occ(tgt)
    table = spark.createDataFrame([(["bank"], ["x"]), (["bank"], ["y"])], "src array<string>, tgt array<string>")
    counts = s.groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    got = {(r["tgt"][0], r["kw"][0]): r["p"] for r in align.keywords(table, s, t, counts).collect()}
    assert got == pytest.approx({("x", "money"): 1 / 3, ("y", "river"): 1 / 2})  # "the" is with both targets


def test_skipgram_alignment(spark):
    ints = "array<int>"
    table = spark.createDataFrame([([1, 2], [11, 12]), ([1, 3], [11, 13])], f"src {ints}, tgt {ints}")
    ts = spark.createDataFrame([([1, 2], [1, 0]), ([1, 3], [1, 0])], f"instance {ints}, template {ints}")
    tt = spark.createDataFrame([([11, 12], [11, 0]), ([11, 13], [11, 0])], f"instance {ints}, template {ints}")
    occ = lambda p: spark.createDataFrame([(p, 1), (p, 2)], f"pattern {ints}, sid bigint")
    got = align.skipgram_alignment(table, ts, tt, occ([1, 0]), occ([11, 0])).collect()
    assert [(r["src"], r["tgt"], r["score"]) for r in got] == [([1, 0], [11, 0], 1.0)]


A3 = """# Sentence pair (1) source length 3 target length 3 alignment score : 0.1
das ist gut
NULL ({ }) that ({ 1 }) is ({ 2 }) good ({ 3 })
# Sentence pair (2)
ja
NULL ({ 1 }) well ({ })"""


def test_word_alignment_files(spark, tmp_path):
    (tmp_path / "x.A3").write_text(A3, encoding="utf-8")
    rows = tables.read_word_alignments(spark, str(tmp_path / "x.A3")).collect()
    assert sorted((r["s"], r["t"]) for r in rows if r["sid"] == 1) == [(0, 0), (1, 1), (2, 2)]
    assert {tuple(r["source"]) for r in rows} == {("that", "is", "good"), ("well",)}
    assert [(r["s"], r["t"]) for r in rows if r["sid"] == 2] == [(0, None)]


def points(spark, rows):
    return spark.createDataFrame([(1, s, t) for s, t in rows], "sid bigint, s int, t int")


def test_symmetrise(spark):
    f, b = points(spark, [(0, 0), (1, 1), (2, 2), (2, 2)]), points(spark, [(0, 0), (1, 2), (3, 1)])
    get = lambda how: sorted((r["s"], r["t"]) for r in wordalign.symmetrize(f, b, how).collect())
    assert get("intersection") == [(0, 0)] and len(get("union")) == 5
    assert get("grow-diag") == [(0, 0), (1, 1), (1, 2), (2, 2), (3, 1)]
    assert set(get("grow-diag")) <= set(get("grow-diag-final")) <= set(get("union"))
    assert get("s2t") == [(0, 0), (1, 1), (2, 2)]


def brute_phrases(pts, ns, nt, max_n):
    out = set()
    for sb in range(ns):
        for se in range(sb, min(ns, sb + max_n)):
            for tb in range(nt):
                for te in range(tb, min(nt, tb + max_n)):
                    inside = [(s, t) for s, t in pts if sb <= s <= se and tb <= t <= te]
                    clash = [(s, t) for s, t in pts if (sb <= s <= se) != (tb <= t <= te)]
                    # target edges carry points; source edges may widen over free words
                    if inside and not clash and {tb, te} <= {t for _, t in inside} | {tb, te}:
                        out.add((sb, se - sb + 1, tb, te - tb + 1))
    return out


def test_phrases_against_loops(spark):
    rng = random.Random(5)
    for _ in range(4):
        ns, nt = rng.randint(1, 6), rng.randint(1, 6)
        pts = {(rng.randrange(ns), rng.randrange(nt)) for _ in range(rng.randint(1, 7))}
        source = spark.createDataFrame([(1, [f"s{i}" for i in range(ns)])], "sid bigint, tokens array<string>")
        target = spark.createDataFrame([(1, [f"t{i}" for i in range(nt)])], "sid bigint, tokens array<string>")
        got = {tuple(r)[1:] for r in wordalign.phrase_spans(points(spark, pts), source, target, 4).collect()}
        assert got == brute_phrases(pts, ns, nt, 4)


def test_supported_pairs(spark):
    occ = lambda rows: spark.createDataFrame([(p.split(), len(p.split()), 1, pos) for p, pos in rows], "pattern array<string>, n int, sid bigint, pos int")
    pts = points(spark, [(0, 0), (1, 2)])
    more = points(spark, [(0, 0), (1, 2), (1, 1)])
    s, t = occ([("a", 0), ("b", 1), ("a b", 0)]), occ([("x", 0), ("z", 2), ("x y z", 0), ("y z", 1)])
    got = {(" ".join(r["src"]), " ".join(r["tgt"])): r["score"] for r in wordalign.supported_pairs(pts, more, s, t).collect()}
    assert got == pytest.approx({("a", "x"): 1, ("b", "z"): 1, ("a b", "x y z"): 2 / 3})
    bonus = {(" ".join(r["src"]), " ".join(r["tgt"])): r["score"] for r in wordalign.supported_pairs(pts, more, s, t, union_bonus=True).collect()}
    assert bonus["a b", "x y z"] == pytest.approx(2 / 3 + 1 / 12)
    wide = {(" ".join(r["src"]), " ".join(r["tgt"])): r["score"] for r in wordalign.supported_pairs(pts, more, s, t, best_only=False, expand=1).collect()}
    assert wide["b", "y z"] == pytest.approx(0.25)
    joined = wordalign.recombine(wordalign.supported_pairs(pts, more, occ([("a", 0), ("b", 1)]), occ([("x y", 0), ("x", 0), ("z", 2)]), best_only=False))
    assert joined.count() == 0


TABLE = "a ||| x ||| 0.5 0.25\na ||| y ||| 0.5 1.0\nb ||| x ||| 1.0 0.75\nb ||| x ||| 1.0 0.5\nbroken"


def test_phrase_table_files(spark, tmp_path):
    (tmp_path / "t").write_text(TABLE, encoding="utf-8")
    table = tables.read_phrase_table(spark, str(tmp_path / "t"))
    got = {(r["src"], r["tgt"]): r["scores"] for r in table.collect()}
    assert got == {("a", "x"): [0.5, 0.25], ("a", "y"): [0.5, 1.0], ("b", "x"): [1.0, 0.5]}
    tables.write_phrase_table(table, str(tmp_path / "out"))
    assert tables.read_phrase_table(spark, str(tmp_path / "out")).count() == 3
    logs = tables.load_alignment(table, bestn=1, logs=True, skipgrams=True)
    assert {(r["src"], r["tgt"]) for r in logs.collect()} == {("a", "y"), ("b", "x")}


def test_phrase_table_tools(spark):
    t = spark.createDataFrame([("a ", "x", [0.5, 0.25]), ("a", "y", [1.0, 2.0, 3.0, 4.0, 5.0]), ("b", "\tx", [1.0]), (None, "x", None)], "s string, t string, sc array<double>")
    clean = pt.stripped(t, "s", "t", "sc")
    flat = {(r["s"], r["t"]): (r["p_ts"], r["p_st"]) for r in pt.flatten(clean).collect()}
    assert flat == {("a", "x"): (0.5, 0.5), ("a", "y"): (0.5, 1.0), ("b", "x"): (1.0, 0.5)}
    assert {len(r["sc"]) for r in pt.simplify(clean).collect()} == {1, 2}
    other = clean.filter("s = 'a'")
    assert pt.intersect(clean, other).count() == 2
    report = {r["kind"]: r for r in pt.overlap_report(clean, other).collect()}
    assert (report["pair"]["n_a"], report["pair"]["n_b"], report["pair"]["n_common"]) == (3, 2, 2) and report["source"]["part_a"] == 0.5
    assert pt.overlap_report(clean.limit(0), other).count() == 3
    assert pt.prune_by_lists(clean, spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([("x",)], "t string")).count() == 1


ARPA = "\\data\\\nngram 1=3\nngram 2=1\n\n\\1-grams:\n-1.0\t<unk>\n-0.5\ta\t-0.2\n-0.7\tb\n\n\\2-grams:\n-0.1\ta b\n-0.1\ta zzz\n\n\\end\\\n"


def test_language_model(spark, tmp_path):
    (tmp_path / "lm").write_text(ARPA, encoding="utf-8")
    model = tables.read_language_model(spark, str(tmp_path / "lm"))
    assert model.count() == 4
    asked = spark.createDataFrame([(1, ["a"], "b"), (2, ["a"], "a"), (3, ["b"], "a"), (4, ["a"], "nope"), (5, [], "b")], "i int, history array<string>, word string")
    got = {r["i"]: r["lp"] / math.log(10) for r in lm.score_words(asked, model, 2, ["i"]).collect()}
    assert got == pytest.approx({1: -0.1, 2: -0.7, 3: -0.5, 4: -1.2, 5: -0.7})
    plain = decode.Model(model.collect(), 2)
    assert plain.word(("a",), "nope") == pytest.approx(-1.2 * math.log(10))
    text = spark.createDataFrame([(1, ["a", "b"])], "sid bigint, tokens array<string>")
    assert lm.score_sentences(text, model, 2, bos=None, eos=None).first()["lp"] == pytest.approx(-0.6 * math.log(10))
    (tmp_path / "bad").write_text(ARPA.replace("<unk>", "x"), encoding="utf-8")
    with pytest.raises(ValueError):
        tables.read_language_model(spark, str(tmp_path / "bad"))


def test_decoder(spark, tmp_path):
    (tmp_path / "lm").write_text("\\1-grams:\n-2\t<unk>\n-1\tthe\t0\n-1\thouse\t0\n-1\tred\t0\n-9\t<s>\t0\n-1\t</s>\n\\2-grams:\n-0.1\t<s> the\n-0.1\tthe red\n-0.1\tred house\n-0.1\thouse </s>\n", encoding="utf-8")
    model = tables.read_language_model(spark, str(tmp_path / "lm"))
    corpus = spark.createDataFrame([(1, ["la", "casa", "roja"]), (2, ["xyz"]), (3, [])], "sid bigint, tokens array<string>")
    table = spark.createDataFrame([(["la"], ["the"], [-0.1]), (["casa"], ["house"], [-0.1]), (["roja"], ["red"], [-0.1]), (["casa", "roja"], ["house", "red"], [-0.2])], "src array<string>, tgt array<string>, scores array<double>")
    options = decode.make_options(corpus, table, 3)
    assert options.filter("sid = 1").count() == 4 and options.filter("sid = 2").first()["tgt"] == ["xyz"]
    search = decode.Search(order=2, distortion_weight=0.1, prune=0.0)
    got = {r["sid"]: r["output"] for r in decode.decode(corpus, options, model, search).collect()}
    assert got == {1: "the red house", 2: "xyz", 3: ""}
    stiff = decode.Search(order=2, distortion_limit=0)
    assert {r["sid"]: r["output"] for r in decode.decode(corpus, options, model, stiff).collect()}[1] == "the house red"
    assert {(r["side"], r["n"]): r["uses"] for r in decode.option_stats(options).collect()}["src", 2] == 1


def test_options_of_a_hot_source(spark, tmp_path):
    """Every target of a source is an option, the rarest too."""
    pairs = [(i, "hot", f"t{min(i, 24)}") for i in range(26)] + [(90, "cold", "c")]
    pairs += [(100 + 10 * i + j, "hot", f"t{i}") for i in range(24) for j in range(2)]
    spark.createDataFrame(pairs, "pair_id bigint, source string, target string").write.parquet(f"{tmp_path}/phrasepairs.parquet")
    table = [("hot cold", "x", None, "", None), ("new", "x", None, "", None)]
    spark.createDataFrame(table, "s string, t string, sc array<double>, wa string, cnt array<bigint>").write.parquet(f"{tmp_path}/phrasetable_a.parquet")
    got = sorted(r["n_options"] for r in align_queries.decode_options(spark, str(tmp_path)).collect())
    assert got == [1, 26]  # 25 targets and one, against a word that passes through
    corpus, _, _ = align_queries._sided(spark, str(tmp_path))
    made = decode.make_options(corpus, align_queries._table_align(spark, str(tmp_path)), 4)
    assert sorted(r["count"] for r in made.groupBy("sid").count().collect()) == got


def test_beam_against_all_orders():
    rng = random.Random(2)
    lm_rows = [{"ngram": [w], "lp": -rng.random() * 3, "bo": -rng.random()} for w in ("a", "b", "c", "d", "</s>", "<unk>")]
    lm_rows += [{"ngram": [v, w], "lp": -rng.random(), "bo": 0.0} for v in ("a", "b", "<s>") for w in ("c", "d", "</s>")]
    model = decode.Model(lm_rows, 2)
    options = [(i, 1, 1 << i, (rng.choice("abcd"),), -rng.random()) for i in range(4) for _ in range(2)]
    p = decode.Search(order=2, stack=10**6, prune=0.0, distortion_weight=0.3)
    best = decode.beam_search(4, options, model, p)[0].score

    def best_of(done, end, words, score):
        if done == 15:
            return score
        top = -1e9
        for pos, length, bits, target, s in options:
            if not done & bits:
                value = score + s + model.phrase(("<s>", *words), target) - 0.3 * abs(end - pos)
                if done | bits == 15:
                    value += model.word(("<s>", *words, *target), "</s>")
                top = max(top, best_of(done | bits, pos + length, (*words, *target), value))
        return top

    assert best == pytest.approx(best_of(0, 0, (), 0.0))


def brute_nearest(instances, gains, features, skip=None):
    best, votes = -1.0, Counter()
    for f, label, w in instances:
        if skip == (f, label):
            w -= 1
        if w <= 0:
            continue
        sim = round(sum(gains[i] for i in range(len(f)) if f[i] == features[i]), 9)
        if sim > best + 1e-9:
            best, votes = sim, Counter()
        if abs(sim - best) <= 1e-9:
            votes[label] += w
    total = sum(votes.values())
    return {k: v / total for k, v in votes.items()}


def test_nearest(spark, monkeypatch):
    rng = random.Random(6)
    data = Counter((tuple(rng.choice("abc") for _ in range(3)), rng.choice("xy")) for _ in range(40))
    inst = spark.createDataFrame([("m", list(f), lab, float(n)) for (f, lab), n in data.items()], "model_id string, features array<string>, label string, weight double")
    gains = {r["i"]: r["gain"] for r in classify.information_gain(inst).collect()}
    queries = spark.createDataFrame([(i, "m", [rng.choice("abcz") for _ in range(3)]) for i in range(20)], "qid bigint, model_id string, features array<string>")
    plain = [(f, lab, float(n)) for (f, lab), n in data.items()]
    expected = {r["qid"]: brute_nearest(plain, gains, r["features"]) for r in queries.collect()}
    for limit in (10, 2):
        monkeypatch.setattr(classify, "MASK_FEATURES", limit)
        got = defaultdict(dict)
        for r in classify.nearest(inst, queries).collect():
            got[r["qid"]][r["label"]] = r["p"]
        assert {k: pytest.approx(v) for k, v in expected.items()} == got
    monkeypatch.setattr(classify, "MASK_FEATURES", 10)
    accuracy = classify.leave_one_out(inst).first()
    right = 0
    for f, lab, n in plain:
        votes = brute_nearest(plain, gains, f, (f, lab))
        right += n * (sorted(votes, key=lambda k: (-votes[k], k))[0] == lab)
    assert accuracy["n"] == 40 and accuracy["accuracy"] == pytest.approx(right / 40)


def test_rescoring(spark):
    options = spark.createDataFrame([(1, "x", math.log(0.5)), (1, "y", math.log(0.3)), (1, "z", math.log(0.2)), (2, "x", math.log(1.0))], "qid int, tgt string, lp double")
    dist = spark.createDataFrame([(1, "x", 0.2), (1, "y", 0.8), (1, "other", 0.5)], "qid int, label string, p double")
    get = lambda mode: {(r["qid"], r["tgt"]): (math.exp(r["lp"]), r["extra"]) for r in classify.rescore(options, dist, mode).collect()}
    w = get("weighed")
    assert w[1, "x"][0] + w[1, "y"][0] == pytest.approx(0.8) and w[1, "y"][0] / w[1, "x"][0] == pytest.approx(0.24 / 0.1) and w[1, "z"][0] == pytest.approx(0.2) and w[2, "x"][0] == pytest.approx(1)
    assert (1, "z") not in get("filtered-weighed") and (2, "x") in get("filtered-weighed")
    assert get("replace")[1, "y"][0] == pytest.approx(0.8) and get("replace")[1, "z"][0] == 1
    assert get("append")[1, "x"] == pytest.approx((0.5, math.log(0.2))) and get("ignore")[1, "x"] == pytest.approx((0.5, 0.0))
    with pytest.raises(ValueError):
        classify.rescore(options, dist, "none")


def test_instances(spark):
    corpus = spark.createDataFrame([(1, ["the", "bank", "is"])], "sid bigint, tokens array<string>")
    found = spark.createDataFrame([(1, 1, ["bank"])], "sid bigint, pos int, pattern array<string>")
    table = spark.createDataFrame([(["bank"], ["x"]), (["bank"], ["y"])], "src array<string>, tgt array<string>")
    there = spark.createDataFrame([(1, 0, ["y"])], "sid bigint, pos int, pattern array<string>")
    rows = classify.training_instances(corpus, found, table, there, 1, 2, "{BEGIN}", "{END}").collect()
    assert [(r["features"], r["label"]) for r in rows] == [(["the", "bank", "is", "{END}"], "y")]
    named = classify.with_model(classify.training_instances(corpus, found, table, there, 1, 1, "{BEGIN}", "{END}"), "length")
    assert named.first()["model_id"] == "1" and classify.enough(named, 2).count() == 0


def test_scores_of_outputs(spark):
    rows = spark.createDataFrame([("a b c d", "a b c d"), ("a x c", "a b c d")], "hypothesis string, reference string")
    wer = pipeline.word_error_rate(rows).first()
    assert (wer["errors"], wer["words"]) == (2, 8)
    assert pipeline.bleu(rows.limit(1)).first()["bleu"] == pytest.approx(1.0)
    assert 0 < pipeline.bleu(rows).first()["bleu"] < 1


def test_pipeline(spark, tmp_path):
    make = lambda d: spark.createDataFrame([(i, t.split()) for i, t in d.items()], "sid bigint, tokens array<string>")
    out = str(tmp_path / "p")
    first = pipeline.align_corpora(spark, make(S), make(T), out, 1, 1, 2)
    assert first.count() == 7 and pipeline.exists(spark, out + "/align-em")


def test_pipeline_is_made_again_from_other_input(spark, tmp_path):
    make = lambda d: spark.createDataFrame([(i, t.split()) for i, t in d.items()], "sid bigint, tokens array<string>")
    out = str(tmp_path / "p")
    sizes = [pipeline.align_corpora(spark, make(s), make(T), out, n, 1, 2).count() for s, n in ((S, 1), (S, 2), (S | {3: "b d"}, 2))]
    assert sizes[0] < sizes[1] < sizes[2]
    written = (tmp_path / "p" / "align-em" / "_SUCCESS").stat().st_mtime_ns
    assert pipeline.align_corpora(spark, make(S | {3: "b d"}), make(T), out, 2, 1, 2).count() == sizes[2]
    assert (tmp_path / "p" / "align-em" / "_SUCCESS").stat().st_mtime_ns == written


def test_dot(spark):
    edges = spark.createDataFrame([("child", 'a "b"', "a", 1.0), ("child", "c", "d", 1.0)], "rel string, src string, dst string, w double")
    nodes = spark.createDataFrame([('a "b"', 1), ("a", 2), ("c", 1), ("d", 1)], "pattern string, cnt bigint")
    assert tables.dot_lines(edges, nodes).count() == 6
    focus = [r["line"] for r in tables.dot_lines(edges, nodes, spark.createDataFrame([("a",)], "pattern string")).collect()]
    assert len(focus) == 3 and any('\\"b\\"' in x for x in focus)


def test_matrix(spark):
    source = spark.createDataFrame([(1, ["a", "<b"])], "sid bigint, tokens array<string>")
    target = spark.createDataFrame([(1, ["x"])], "sid bigint, tokens array<string>")
    html = wordalign.matrix_html(points(spark, [(1, 0)]), source, target).first()["html"]
    assert html == "<table><tr><td></td><th>a</th><th>&lt;b</th></tr><tr><th>x</th><td></td><td>x</td></tr></table>"
    assert wordalign.matrix_html(points(spark, [(1, 0)]), source, target, start=2).count() == 0


def test_contexts(spark):
    rows = [("f", "c1", "x", math.log(0.5), math.log(0.2)), ("f", "c2", "x", math.log(0.25), math.log(0.2)), ("f", "c1", "y", math.log(0.25), math.log(0.3)), ("g", "c1", "x", math.log(1.0), math.log(0.4))]
    options = spark.createDataFrame(rows, "focus string, context string, tgt string, lp_ts double, lp_st double")
    got = {(r["focus"], r["tgt"]): (r["p_ts"], r["p_st"]) for r in align.remove_context(options).collect()}
    assert got == {("f", "x"): pytest.approx((0.75, 0.5)), ("f", "y"): pytest.approx((0.25, 1.0)), ("g", "x"): pytest.approx((1.0, 0.5))}
    table = spark.createDataFrame([("a f b", "x", 1.0), ("f", "y", 0.5)], "src string, tgt string, score double")
    asked = spark.createDataFrame([(1, "a f b", "f"), (2, "c f b", "f"), (3, "q", "q")], "qid int, in_context string, focus string")
    assert sorted((r["qid"], r["tgt"]) for r in align.options_with_fallback(asked, table).collect()) == [(1, "x"), (2, "y")]


def test_classifier_training(spark):
    """Models need enough instances and accuracy; options of others keep their score."""
    data = [(["a"], ["l", "a", str(i % 2)], "x" if i % 2 else "y", 1.0) for i in range(8)] + [(["b"], ["l", "b", str(i)], "xy"[i % 2], 1.0) for i in range(6)] + [(["c"], ["l", "c", "0"], "x", 1.0)]
    rows = spark.createDataFrame(data, "focus array<string>, features array<string>, label string, weight double")
    held, passed = classify.train(rows, "pattern", 2, 2, 3, 0.9)
    assert {r["model_id"]: (r["n"], r["accuracy"]) for r in passed.collect()} == {"a": (8.0, 1.0)}
    assert sorted((r["label"], r["weight"]) for r in held.collect()) == [("x", 4.0), ("y", 4.0)]
    options = spark.createDataFrame([(1, "a", "x", -1.0), (1, "a", "y", -1.0), (2, "b", "x", -1.0)], "qid int, model_id string, tgt string, lp double")
    dist = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.1), (2, "x", 0.5)], "qid int, label string, p double")
    got = {(r["qid"], r["tgt"]): (r["lp"], r["extra"]) for r in classify.bypass(options, dist, passed, "append").collect()}
    assert got == {(1, "x"): (-1.0, pytest.approx(math.log(0.9))), (1, "y"): (-1.0, pytest.approx(math.log(0.1))), (2, "x"): (-1.0, 0.0)}


def test_skipgram_of(spark):
    df = spark.createDataFrame([([["a"], ["b", "c"]], [2], False), ([["a"]], [1, 3], True), ([["a"], ["b"]], [], False), ([["a"]], [0], True)], "p array<array<string>>, g array<int>, f boolean")
    got = [r[0] for r in df.select(P.skipgram_of("p", "g", F.col("f"), "{*}")).collect()]
    assert got == [["a", "{*}", "{*}", "b", "c"], ["{*}", "a", "{*}", "{*}", "{*}"], None, None]

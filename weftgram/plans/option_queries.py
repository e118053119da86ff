"""Queries on alignment thresholds, extraction, contexts, classifiers and output scores."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.operators import align, classify, decode, graph, mining, reports, wordalign
from weftgram.plans import pipeline
from weftgram.plans.align_queries import _A, _B, _INST, _J, _R, _SENT, _instances, _points, _sided, _table_align, _wa, records, side, text, wa_union, words
from weftgram.plans.graph_queries import _EDGES, _P, _X, postings
from weftgram.sources import corpus as C
from weftgram.runtime import cut_lineage

GAP = "{*}"


def align_probable(spark: SparkSession, sf: str) -> DataFrame:
    """Targets with a fiftieth of their source's score at least."""
    rows = align.train_cooc(words(spark, sf, "source"), words(spark, sf, "target"), 0.0005, 0, 0.02, False)
    return rows.select(text("src"), text("tgt"), F.round("score", 8).alias("score"))


def align_em_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds in which repeats within a sentence count."""
    rows = align.train_em(words(spark, sf, "source"), words(spark, sf, "target"), 2, weighted=True)
    return rows.select(text("src"), text("tgt"), F.round("score", 6).alias("score"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy(F.col("source").alias("src"), F.col("target").alias("tgt")).agg(F.count(F.lit(1)).alias("c"))


def align_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """Both probabilities of every pair, and their product as the one score."""
    counts = _counts(spark, sf)
    both = align.integrate_reverse(counts).join(align.integrate_reverse(counts, single=True), ["src", "tgt"])
    return both.select("src", "tgt", F.round("p_ts", 9).alias("p_ts"), F.round("p_st", 9).alias("p_st"), F.round("score", 9).alias("score"))


def align_prune(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.integrate_reverse(_counts(spark, sf)).select("src", "tgt", F.array("p_ts", "p_st").alias("scores"))
    return align.prune(rows, 0.25).select("src", "tgt", F.round(F.get("scores", F.lit(0)), 9).alias("p_ts"))


def patterns_by_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """N-grams of the sources that have an alignment with a score product of a twentieth."""
    rows = align.integrate_reverse(_counts(spark, sf)).select(C.split_words(F.col("src")).alias("src"), F.array("p_ts", "p_st").alias("scores"))
    return mining.prune_by_alignment(mining.count_ngrams(side(spark, sf, "source"), 3, 2), rows, 0.05).select(text("pattern", "text"), "cnt")


def model_select(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of one to three tokens, no skipgrams, by count, share of types, and exclusive count and ratio."""
    posts = postings(spark, sf)
    patterns = graph.pattern_counts(posts)
    x = graph.exclusive_counts(posts, graph.subsumption(patterns))
    rows = reports.select_patterns(patterns, 1, 3, 3, 0.001, False, x, 2, 0.25)
    return rows.select(text("pattern", "text"), "n", "cnt")


def model_among(spark: SparkSession, sf: str) -> DataFrame:
    """Source n-grams that are a source of the alignment."""
    patterns = mining.count_ngrams(side(spark, sf, "source"), 3, 2).withColumn("is_skip", F.lit(False))
    rows = reports.select_patterns(patterns, among=_table_align(spark, sf).select(F.col("src").alias("pattern")).distinct())
    return rows.select(text("pattern", "text"), "cnt")


def exclusive_query_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of the patterns with their counts and exclusive counts."""
    posts = postings(spark, sf)
    patterns = graph.pattern_counts(posts)
    tokens = spark.createDataFrame([(100_000,)], "tokens bigint")
    rows = reports.query_mode(posts.select("sid", "pos", "pattern"), patterns, tokens, graph.exclusive_counts(posts, graph.subsumption(patterns)))
    return rows.select("sid", "pos", text("pattern", "text"), "cnt", F.round("coverage", 10).alias("coverage"), "xcount", F.round("xratio", 8).alias("xratio"))


def exclusive_coverage(spark: SparkSession, sf: str) -> DataFrame:
    posts = postings(spark, sf)
    tokens = posts.filter("n = 1").groupBy("sid").agg(F.collect_list("pos").alias("tokens"))
    return reports.exclusive_coverage(tokens, posts, graph.exclusive_counts(posts, graph.subsumption(graph.pattern_counts(posts))), 0.5)


def keywords_best(spark: SparkSession, sf: str) -> DataFrame:
    """The two likeliest keywords of every pair, with a probability of a hundredth at least."""
    s, t = words(spark, sf, "source"), words(spark, sf, "target")
    counts = s.groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    rows = align.keywords(align.train_cooc(s, t, 0.002), s, t, counts, 2, 3, 0.01, 2)
    return rows.select(text("src"), text("tgt"), text("kw"), F.round("p", 8).alias("p"))


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the number of words of the source as context."""
    rows = records(spark, sf).select(F.element_at(F.split("source", " "), -1).alias("focus"), F.get(F.split("source", " "), F.lit(0)).alias("context"), F.element_at(F.split("target", " "), -1).alias("tgt"))
    counts = rows.groupBy("focus", "context", "tgt").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("focus", "context").agg(F.sum("c").alias("n"))
    return counts.join(total, ["focus", "context"]).withColumn("lp", F.log(F.col("c") / F.col("n")))


def context_sum(spark: SparkSession, sf: str) -> DataFrame:
    return align.sum_contexts(_contexts(spark, sf)).select("focus", "tgt", F.round("score", 9).alias("score"))


def context_remove(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.remove_context(_contexts(spark, sf).select("focus", "context", "tgt", F.col("lp").alias("lp_ts"), F.log("c").alias("lp_st")))
    return rows.select("focus", "tgt", F.round("p_ts", 9).alias("p_ts"), F.round("p_st", 9).alias("p_st"))


def option_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Options of the sources of copy a as a whole, else of their last word."""
    corpus, _, _ = _sided(spark, sf)
    asked = corpus.filter("size(tokens) > 0").select(F.col("sid").alias("qid"), text("tokens", "in_context"), F.element_at("tokens", -1).alias("focus"))
    rows = align.options_with_fallback(asked, align.normalize(_counts(spark, sf), "c").withColumnRenamed("c", "score"))
    return rows.select("qid", "key", "tgt", F.round("score", 9).alias("score"))


def _supported(spark: SparkSession, sf: str, occurring: int = 3, max_n: int = 2, **options) -> DataFrame:
    source, target, _ = _sided(spark, sf)
    grams = [mining.postings(c, mining.count_ngrams(c, max_n, occurring), max_n) for c in (source, target)]
    return wordalign.supported_pairs(_points(spark, sf, "a"), wa_union(spark, sf), *grams, least=0.5, **options)


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.select("sid", "s_pos", text("src"), "t_pos", text("tgt"), F.round("score", 8).alias("score"))


def extract_best(spark: SparkSession, sf: str) -> DataFrame:
    """One target for each source occurrence."""
    return _shown(_supported(spark, sf, union_bonus=True))


def extract_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """All targets, those with further points of the union weighted down."""
    return _shown(_supported(spark, sf, best_only=False, union_weight=0.5))


def extract_recombined(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of two words made of two neighbours in one order."""
    return _shown(wordalign.recombine(cut_lineage(_supported(spark, sf, 1, 1, best_only=False, union_bonus=True))))


def extract_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted pairs by the sum of their scores, one at least, with the word before the source."""
    source, _, _ = _sided(spark, sf)
    pairs = _supported(spark, sf, 1, best_only=False, union_bonus=True).join(source, "sid")
    pairs = pairs.withColumn("context", F.coalesce(F.get("tokens", F.col("s_pos") - 1), F.lit("{BEGIN}")))
    return wordalign.pair_counts(pairs, True, 1, ["context"]).select("context", text("src"), text("tgt"), F.round("c", 6).alias("c"))


def _skip_sides(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per side: occurrences of all patterns, and the n-grams with the skipgrams they fill."""
    out = {}
    for name in ("source", "target"):
        corpus = side(spark, sf, name)
        found = mining.mine(corpus, 3, mining.Thresholds(20, 2, 2), skipgrams=True, gap=GAP)
        occurrences = found.postings.select("pattern", "sid").unionByName(found.skip_postings.select("pattern", "sid"))
        out[name] = occurrences, graph.instances(found.skip_postings, found.patterns.filter("NOT is_skip"))
    return out


def align_skipgrams(spark: SparkSession, sf: str) -> DataFrame:
    sides = _skip_sides(spark, sf)
    (so, st), (to, tt) = sides["source"], sides["target"]
    grams = align.train_cooc(so.filter(~F.array_contains("pattern", GAP)), to.filter(~F.array_contains("pattern", GAP)), 0.01)
    rows = align.skipgram_alignment(cut_lineage(grams), st, tt, so, to, 2, GAP)
    return rows.select(text("src"), text("tgt"), F.round("score", 8).alias("score"))


def training_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Source words with their neighbours and every aligned word that is in the target."""
    source = side(spark, sf, "source")
    s = source.select("sid", F.posexplode("tokens").alias("pos", "w")).select("sid", "pos", F.array("w").alias("pattern"))
    t = side(spark, sf, "target").select("sid", F.posexplode("tokens").alias("pos", "w")).select("sid", "pos", F.array("w").alias("pattern"))
    pairs = align.train_cooc(words(spark, sf, "source"), words(spark, sf, "target"), 0.02).select("src", "tgt")
    rows = classify.training_instances(source, s, pairs, t, 1, 1, "{BEGIN}", "{END}")
    return rows.groupBy(text("focus"), text("features"), "label").agg(F.sum("weight").alias("weight"))


def classifier_models(spark: SparkSession, sf: str) -> DataFrame:
    """Instances of the models by first word with three contexts, two labels and five instances at least."""
    rows = _instances(spark, sf).withColumn("focus", F.array(F.get("features", F.lit(0))))
    kept = classify.enough(classify.with_model(rows, "pattern"), 3, 2, 5)
    return kept.groupBy("model_id", text("features"), "label").agg(F.count(F.lit(1)).alias("n"))


def _options(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = records(spark, sf).groupBy("source", "target").agg(F.count(F.lit(1)).alias("c"))
    options = align.normalize(counts.withColumn("p", F.col("c").cast("double")), "p", "source").select(F.col("source").alias("qid"), F.col("target").alias("tgt"), F.log("p").alias("lp"))
    seen = counts.groupBy("target").agg(F.sum("c").alias("n")).filter("n >= 3")
    dist = counts.join(seen, "target").select(F.col("source").alias("qid"), F.col("target").alias("label"), F.col("n").cast("double").alias("p"))
    return options, align.normalize(dist, "p", "qid")


def rescore(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    rows = classify.rescore(*_options(spark, sf), mode)
    return rows.select("qid", "tgt", F.round("lp", 6).alias("lp"), F.round("extra", 6).alias("extra"))


def _keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Options with the sum of the shares of the words they have in common with their source."""
    options = _counts(spark, sf).select(F.col("src").alias("qid"), F.lit("any").alias("src"), "tgt")
    held = options.select("tgt", F.explode(F.array_distinct(F.split("tgt", " "))).alias("kw")).distinct()
    keywords = held.select(F.lit("any").alias("src"), "tgt", "kw", (1 / F.length("kw")).alias("p"))
    # the words of a source as they would be written among the targets: their last letter decides
    present = options.select("qid", F.explode(F.split("qid", " ")).alias("w")).distinct()
    targets = held.select("kw").distinct().withColumn("z", F.substring("kw", -2, 2))
    present = present.withColumn("z", F.substring("w", -2, 2)).join(targets, "z").select("qid", "kw")
    return classify.keyword_score(options, keywords, present)


def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_scores(spark, sf).select("qid", "tgt", F.round("kwscore", 8).alias("kwscore"))


def rescore_kwprob(spark: SparkSession, sf: str) -> DataFrame:
    options, _ = _options(spark, sf)
    rows = classify.rescore_keywords(options, _keyword_scores(spark, sf))
    return rows.select("qid", "tgt", F.round("lp", 6).alias("lp"), F.round("extra", 6).alias("extra"))


def option_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Options of the sources of copy a by the length and kind of either side."""
    corpus, _, _ = _sided(spark, sf)
    return decode.option_stats(decode.make_options(corpus, _table_align(spark, sf), 4))


def test_table(spark: SparkSession, sf: str) -> DataFrame:
    """Options under the places of their words, as an outside decoder takes them."""
    corpus, _, _ = _sided(spark, sf)
    rows = classify.test_table(decode.make_options(corpus, _table_align(spark, sf), 4))
    return rows.select("places", text("tgt"), F.round(F.element_at("scores", 1), 8).alias("first"))


def bleu(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).select(F.col("source").alias("hypothesis"), F.concat_ws(" ", "source", "target").alias("reference"))
    return pipeline.bleu(rows, 2).select(F.round("bleu", 9).alias("bleu"))


def position_free_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).select(F.col("source").alias("hypothesis"), F.col("target").alias("reference"))
    return pipeline.position_independent_error_rate(rows).select("errors", "words", F.round("per", 9).alias("per"))


def averaged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of word counts over the parts of a division, as if each were a run."""
    parts = C.hash_split(side(spark, sf, "source"), {"a": 1, "b": 1, "c": 1}, 1)
    runs = parts.groupBy(F.col("part").alias("run")).agg(F.avg(F.size("tokens")).alias("words"), F.count(F.lit(1)).cast("double").alias("rows"))
    return pipeline.average_runs(runs, ["words", "rows"]).select("metric", F.round("mean", 8).alias("mean"), "runs")


QUERIES = {
    f.__name__: f
    for f in (
        align_probable, align_em_weighted, align_reverse, align_prune, patterns_by_alignment, model_select, model_among, exclusive_query_mode, exclusive_coverage, keywords_best, context_sum, context_remove,
        option_fallback, extract_best, extract_weighted, extract_recombined, extract_counts, align_skipgrams, training_instances, classifier_models, keyword_scores, rescore_kwprob, option_usage, test_table,
        bleu, position_free_errors, averaged_runs,
    )
} | {f"rescore_{m.replace('-', '_')}": partial(rescore, mode=m) for m in ("append", "replace", "ignore", "filtered-weighed")}

_C = f"{_R}, c AS (SELECT source AS src, target AS tgt, count(*) AS c FROM rec GROUP BY ALL), p AS (SELECT src, tgt, c, c / sum(c) OVER (PARTITION BY src) AS a, c / sum(c) OVER (PARTITION BY tgt) AS b FROM c)"
_GRAMS = "sg AS (SELECT unnest(list_concat(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS p FROM sw), m AS (SELECT p AS text, count(*) AS cnt FROM sg GROUP BY p HAVING count(*) >= 2)"
_XC = f"{_EDGES}, {_X}"
_F = f"""{_R}, f AS (SELECT list_extract(string_split(source, ' '), -1) AS focus, string_split(source, ' ')[1] AS context, list_extract(string_split(target, ' '), -1) AS tgt FROM rec), fc AS (SELECT focus, context, tgt, count(*) AS c FROM f GROUP BY ALL),
  fp AS (SELECT *, c / sum(c) OVER (PARTITION BY focus, context) AS q FROM fc)"""


def _sup(score: str, best: bool = False, least: int = 3, max_n: int = 2) -> str:
    rank = ", row_number() OVER (PARTITION BY sid, sp, src ORDER BY round(score, 12) DESC, string_split(tgt, ' '), tp) AS r" if best else ", 1 AS r"
    return f"""{_A}, {_B}, {_wa('a')}, {_wa('b')}, {_SENT}, un AS (SELECT * FROM pa UNION SELECT * FROM pb),
      g1 AS (SELECT sid, unnest(range(0, len(ws))) AS pos, ws, 1 AS n FROM z UNION ALL SELECT sid, unnest(range(0, len(ws) - 1)), ws, 2 FROM z), s0 AS (SELECT sid, pos, n, array_to_string(ws[pos + 1:pos + n], ' ') AS p FROM g1),
      g2 AS (SELECT sid, unnest(range(0, len(wt))) AS pos, wt, 1 AS n FROM z UNION ALL SELECT sid, unnest(range(0, len(wt) - 1)), wt, 2 FROM z), t0 AS (SELECT sid, pos, n, array_to_string(wt[pos + 1:pos + n], ' ') AS p FROM g2),
      fs AS (SELECT * FROM s0 WHERE n <= {max_n} AND p IN (SELECT p FROM s0 GROUP BY p HAVING count(*) >= {least})), ft AS (SELECT * FROM t0 WHERE n <= {max_n} AND p IN (SELECT p FROM t0 GROUP BY p HAVING count(*) >= {least})),
      q AS (SELECT s.sid, s.pos AS sp, s.n AS sn, s.p AS src, t.pos AS tp, t.n AS tn, t.p AS tgt FROM fs s JOIN ft t ON s.sid = t.sid),
      qp AS (SELECT q.*, s, t, s BETWEEN sp AND sp + sn - 1 AS ins, t BETWEEN tp AND tp + tn - 1 AS intt FROM q JOIN pa ON pa.sid = q.sid),
      ok AS (SELECT sid, sp, sn, src, tp, tn, tgt, count(*) FILTER (ins AND intt) AS c FROM qp GROUP BY ALL HAVING count(*) FILTER (ins <> intt) = 0 AND bool_or(ins AND s = sp) AND bool_or(ins AND s = sp + sn - 1) AND bool_or(intt AND t = tp) AND bool_or(intt AND t = tp + tn - 1)),
      w AS (SELECT ok.*, greatest((SELECT count(*) FROM un WHERE un.sid = ok.sid AND un.s BETWEEN sp AND sp + sn - 1 AND un.t BETWEEN tp AND tp + tn - 1) - c, 0) AS extra FROM ok),
      sc AS (SELECT *, {score} AS score FROM w), keep AS (SELECT * FROM (SELECT *{rank} FROM sc WHERE {score} >= 0.5) WHERE r = 1)"""


_BONUS = "least(1.0::DOUBLE, least(1.0::DOUBLE, c / greatest(sn, tn)) + extra / (4 * greatest(sn, tn)))"
_PAIR = "SELECT sid, sp AS s_pos, src, tp AS t_pos, tgt, round(score, 8) AS score FROM keep"
_O = f"""{_R}, c AS (SELECT source, target, count(*) AS c FROM rec GROUP BY ALL), o AS (SELECT source, target, ln(c / sum(c) OVER (PARTITION BY source)) AS lp FROM c), seen AS (SELECT target, sum(c) AS n FROM c GROUP BY target HAVING sum(c) >= 3),
  d AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS p FROM c JOIN seen USING (target)),
  x AS (SELECT source AS qid, target AS tgt, lp, p, bool_or(p IS NOT NULL) OVER (PARTITION BY source) AS known, sum(CASE WHEN p IS NOT NULL THEN exp(lp) END) OVER (PARTITION BY source) AS b, sum(CASE WHEN p IS NOT NULL THEN exp(lp + ln(p)) END) OVER (PARTITION BY source) AS a FROM o LEFT JOIN d USING (source, target))"""
_KW = f"""{_C}, held AS (SELECT DISTINCT tgt, unnest(string_split(tgt, ' ')) AS kw FROM c), pres AS (SELECT DISTINCT qid, kw FROM (SELECT DISTINCT src AS qid, unnest(string_split(src, ' ')) AS w FROM c) x JOIN (SELECT DISTINCT kw FROM held) y ON right(w, 2) = right(kw, 2)),
  hit AS (SELECT c.src AS qid, c.tgt, sum(1 / length(held.kw)) AS s FROM c JOIN held ON held.tgt = c.tgt JOIN pres ON pres.qid = c.src AND pres.kw = held.kw GROUP BY ALL), ks AS (SELECT c.src AS qid, c.tgt, 1e-10::DOUBLE + coalesce(s, 0) AS kwscore FROM c LEFT JOIN hit ON hit.qid = c.src AND hit.tgt = c.tgt)"""
#: Options of the sources of copy a: known sources of up to four words with each target, and words that none covers.
_OPT = f"""{_C}, al AS (SELECT array_to_string(list_filter(string_split(src, ' '), lambda w: w <> ''), ' ') AS src, array_to_string(list_filter(string_split(tgt, ' '), lambda w: w <> ''), ' ') AS tgt, ln(a) AS lp FROM p WHERE trim(src) <> '' AND trim(tgt) <> ''),
  {_A}, se AS (SELECT DISTINCT ('0x' || substr(md5(s || '|' || t), 1, 15))::BIGINT AS sid, list_filter(list_transform(string_split(s, ' '), lambda w: trim(w, E'\\t\\r')), lambda w: w <> '') AS ws FROM a),
  gr AS (SELECT sid, pos, n, array_to_string(ws[pos + 1:pos + n], ' ') AS src FROM (SELECT sid, ws, n, unnest(range(0, len(ws) - n + 1)) AS pos FROM (SELECT sid, ws, unnest(range(1, 5)) AS n FROM se) WHERE n <= len(ws))),
  fo AS (SELECT * FROM gr WHERE src IN (SELECT src FROM al)), co AS (SELECT DISTINCT sid, pos + unnest(range(0, n)) AS pos FROM fo), lone AS (SELECT gr.sid, gr.pos, src FROM gr ANTI JOIN co USING (sid, pos) WHERE n = 1),
  op AS (SELECT sid, pos, n, fo.src, tgt, lp FROM fo JOIN al ON al.src = fo.src UNION ALL SELECT sid, pos, 1, src, src, 0 FROM lone)"""


def _skip_side(tag: str, occurrences: str) -> str:
    """Skipgrams of up to three tokens of one side: ``occ`` of all patterns, ``ed`` of n-grams with the skipgrams they fill."""
    from weftgram.plans.skipgram_queries import TYPES

    t = tag
    return f"""g{t} AS (SELECT sid, 1 AS n, unnest({occurrences}) AS text FROM sw UNION ALL SELECT sid, 2, unnest(list_transform(range(1, len({occurrences})), lambda i: {occurrences}[i] || ' ' || {occurrences}[i + 1])) FROM sw
      UNION ALL SELECT sid, 3, unnest(list_transform(range(1, len({occurrences}) - 1), lambda i: {occurrences}[i] || ' ' || {occurrences}[i + 1] || ' ' || {occurrences}[i + 2])) FROM sw),
      known{t} AS (SELECT text, n FROM g{t} GROUP BY text, n HAVING count(*) >= 20), inst{t} AS (SELECT text AS inst, n, string_split(text, ' ') AS w, count(*) AS c FROM g{t} WHERE n >= 2 GROUP BY text, n),
      fit{t} AS (SELECT * FROM inst{t} WHERE array_to_string(w[1:n - 1], ' ') IN (SELECT text FROM known{t}) AND array_to_string(w[2:n], ' ') IN (SELECT text FROM known{t})),
      k0{t} AS (SELECT array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] = 1 THEN '{{*}}' ELSE w[i] END), ' ') AS text, inst, n, w, b, c FROM fit{t} JOIN (VALUES (2, [0, 1]), (2, [1, 0]), (3, [0, 0, 1]), (3, [0, 1, 0]), (3, [1, 0, 0]), (3, [0, 1, 1]), (3, [1, 1, 0])) sh(n, b) USING (n)),
      k2{t} AS (SELECT * FROM k0{t} WHERE c >= 2 AND text IN (SELECT text FROM k0{t} GROUP BY text HAVING sum(c) FILTER (c >= 2) >= 20 AND count(*) FILTER (c >= 2) >= {TYPES})),
      v{t} AS (SELECT text, i, count(DISTINCT x) AS d FROM (SELECT text, unnest(w) AS x, unnest(b) AS y, generate_subscripts(w, 1) AS i FROM k2{t}) WHERE y = 1 GROUP BY text, i),
      kept{t} AS (SELECT * FROM k2{t} WHERE text IN (SELECT text FROM v{t} GROUP BY text HAVING min(d) >= {TYPES})),
      occ{t} AS MATERIALIZED (SELECT text, sid FROM g{t} WHERE text IN (SELECT text FROM known{t}) UNION ALL SELECT kept{t}.text, sid FROM kept{t} JOIN g{t} ON g{t}.text = kept{t}.inst),
      ed{t} AS (SELECT DISTINCT text AS template, inst FROM kept{t} WHERE inst IN (SELECT text FROM known{t})), ps{t} AS (SELECT text, sid, count(*) AS c FROM occ{t} GROUP BY ALL), to{t} AS (SELECT text, sum(c) AS n FROM ps{t} GROUP BY text)"""


ORACLE = {
    "align_probable": f"WITH {_J}, r AS (SELECT src, tgt, score, score / sum(score) OVER (PARTITION BY src) AS share FROM j) SELECT src, tgt, round(score, 8) AS score FROM r WHERE score >= 0.0005 AND share >= 0.02",
    "align_em_weighted": f"""WITH {_R}, sc AS (SELECT sid, p AS src, count(*) AS cs FROM so GROUP BY ALL), tc AS (SELECT sid, p AS tgt, count(*) AS ct FROM ta GROUP BY ALL), pairs AS (SELECT sid, src, tgt, cs * ct AS w FROM sc JOIN tc USING (sid)),
      w1 AS MATERIALIZED (SELECT sid, src, tgt, w, 1.0::DOUBLE / count(*) OVER (PARTITION BY sid, tgt) AS q FROM pairs), c1 AS (SELECT src, tgt, sum(w * q) AS c FROM w1 GROUP BY ALL), r1 AS MATERIALIZED (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS p FROM c1),
      w2 AS MATERIALIZED (SELECT sid, src, tgt, w, p / sum(p) OVER (PARTITION BY sid, tgt) AS q FROM pairs JOIN r1 USING (src, tgt)), c2 AS (SELECT src, tgt, sum(w * q) AS c FROM w2 GROUP BY ALL) SELECT src, tgt, round(c / sum(c) OVER (PARTITION BY src), 6) AS score FROM c2""",
    "align_reverse": f"WITH {_C} SELECT src, tgt, round(a, 9) AS p_ts, round(b, 9) AS p_st, round(a * b, 9) AS score FROM p",
    "align_prune": f"WITH {_C} SELECT src, tgt, round(a, 9) AS p_ts FROM p WHERE a * b >= 0.25",
    "patterns_by_alignment": f"WITH {_C}, {_GRAMS} SELECT text, cnt FROM m WHERE text IN (SELECT array_to_string(list_filter(string_split(src, ' '), lambda w: w <> ''), ' ') FROM p WHERE a * b >= 0.05)",
    "model_select": f"WITH {_XC} SELECT pat.t AS text, CAST(n AS INT) AS n, pat.cnt FROM pat JOIN x ON x.pattern = pat.t WHERE n BETWEEN 1 AND 3 AND pat.cnt >= 3 AND NOT is_skip AND pat.cnt / (SELECT count(*) FROM pat) >= 0.001 AND xcount >= 2 AND xcount / x.cnt >= 0.25",
    "model_among": f"WITH {_C}, {_GRAMS} SELECT text, cnt FROM m WHERE text IN (SELECT src FROM c)",
    "exclusive_query_mode": f"WITH {_XC} SELECT sid, pos, occ.t AS text, x.cnt, round(x.cnt * occ.n / 100000, 10) AS coverage, xcount, round(xcount / x.cnt, 8) AS xratio FROM occ JOIN x ON x.pattern = occ.t",
    "exclusive_coverage": f"""WITH {_XC}, k AS (SELECT pattern FROM x WHERE xcount / cnt >= 0.5), sp AS (SELECT sid, pos + unnest(range(0, n)) AS tk, unnest(pattern) AS c FROM occ WHERE t IN (SELECT pattern FROM k))
      SELECT (SELECT count(*) FROM occ WHERE n = 1) AS tokens, (SELECT count(DISTINCT (sid, tk)) FROM sp WHERE c <> 0) AS covered, (SELECT count(*) FROM k) AS types""",
    "keywords_best": f"""WITH {_J}, al AS (SELECT src, tgt FROM j WHERE score >= 0.002), n AS (SELECT src, count(*) AS n_targets FROM al GROUP BY src HAVING count(*) > 1), hs AS (SELECT DISTINCT p, sid FROM so), ht AS (SELECT DISTINCT p, sid FROM ta),
      bo AS (SELECT al.src, al.tgt, hs.sid, n_targets FROM al JOIN n USING (src) JOIN hs ON hs.p = al.src JOIN ht ON ht.p = al.tgt AND ht.sid = hs.sid), kw AS (SELECT hs.p AS kw, hs.sid, st.n AS nc FROM hs JOIN st ON st.p = hs.p WHERE st.n >= 3),
      c AS (SELECT src, tgt, kw, count(*) AS n, any_value(nc) AS nc, any_value(n_targets) AS nt FROM bo JOIN kw USING (sid) WHERE src <> kw GROUP BY src, tgt, kw), l AS (SELECT *, sum(n) OVER (PARTITION BY src, kw) AS loc, count(*) OVER (PARTITION BY src, kw) AS wi FROM c),
      q AS (SELECT src, tgt, kw, n / loc / nc AS p FROM l WHERE wi < nt AND loc >= 2 AND n / loc / nc >= 0.01) SELECT src, tgt, kw, round(p, 8) AS p FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY p DESC, kw) AS r FROM q) WHERE r <= 2""",
    "context_sum": f"WITH {_F}, u AS (SELECT focus, tgt, sum(q) AS q FROM fp GROUP BY ALL) SELECT focus, tgt, round(q / sum(q) OVER (PARTITION BY focus), 9) AS score FROM u",
    "context_remove": f"WITH {_F}, u AS (SELECT focus, tgt, sum(q) AS q, sum(c) AS c FROM fp GROUP BY ALL) SELECT focus, tgt, round(q / sum(q) OVER (PARTITION BY focus), 9) AS p_ts, round(c / sum(c) OVER (PARTITION BY tgt), 9) AS p_st FROM u",
    "option_fallback": f"""WITH {_C}, {_A}, se AS (SELECT DISTINCT ('0x' || substr(md5(s || '|' || t), 1, 15))::BIGINT AS sid, list_filter(list_transform(string_split(s, ' '), lambda w: trim(w, E'\\t\\r')), lambda w: w <> '') AS ws FROM a),
      q AS (SELECT sid AS qid, array_to_string(ws, ' ') AS ctx, ws[len(ws)] AS focus FROM se WHERE len(ws) > 0), d AS (SELECT qid, src AS key, tgt, a AS score FROM q JOIN p ON p.src = ctx)
      SELECT qid, key, tgt, round(score, 9) AS score FROM d UNION ALL SELECT qid, src, tgt, round(a, 9) FROM q JOIN p ON p.src = focus WHERE qid NOT IN (SELECT qid FROM d)""",
    "extract_best": f"WITH {_sup(_BONUS, True)} {_PAIR}",
    "extract_weighted": f"WITH {_sup('least(1.0::DOUBLE, c / greatest(sn, tn)) * pow(0.5::DOUBLE, extra)')} {_PAIR}",
    "extract_recombined": f"""WITH {_sup(_BONUS, False, 1, 1)}, mk AS (SELECT a.sid, a.sp AS s_pos, a.src || ' ' || b.src AS src, a.tp AS t_pos, a.tgt || ' ' || b.tgt AS tgt, a.score * b.score AS score FROM keep a JOIN keep b ON a.sid = b.sid AND a.sp + a.sn = b.sp AND a.tp + a.tn = b.tp)
      SELECT sid, s_pos, src, t_pos, tgt, round(score, 8) AS score FROM mk WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE k.sid = mk.sid AND k.sp = s_pos AND k.src = mk.src AND k.tp = t_pos AND k.tgt = mk.tgt)""",
    "extract_counts": f"WITH {_sup(_BONUS, False, 1)}, cx AS (SELECT coalesce(CASE WHEN sp > 0 THEN ws[sp] END, '{{BEGIN}}') AS context, src, tgt, score FROM keep JOIN z USING (sid)) SELECT context, src, tgt, round(sum(score), 6) AS c FROM cx GROUP BY ALL HAVING sum(score) >= 1",
    "align_skipgrams": f"""WITH {_R}, {_skip_side('1', 'ws')}, {_skip_side('2', 'wt')}, cm AS (SELECT a.text AS s, b.text AS t, sum(least(a.c, b.c)) AS i FROM ps1 a JOIN ps2 b USING (sid) GROUP BY ALL),
      jj AS MATERIALIZED (SELECT s, t, i / (x.n + y.n - i) AS j FROM cm JOIN to1 x ON x.text = s JOIN to2 y ON y.text = t), al AS (SELECT s, t FROM jj WHERE j >= 0.01 AND s NOT LIKE '%{{*}}%' AND t NOT LIKE '%{{*}}%'),
      cp AS (SELECT a.template AS s, b.template AS t, count(*) AS c FROM al JOIN ed1 a ON a.inst = al.s JOIN ed2 b ON b.inst = al.t GROUP BY ALL HAVING count(*) >= 2),
      pr AS (SELECT cp.s, cp.t, c, coalesce(j, 0) AS j, string_split(cp.t, ' ') AS w FROM cp LEFT JOIN jj ON jj.s = cp.s AND jj.t = cp.t), gp AS (SELECT *, len(list_filter(w, lambda x: x = '{{*}}')) / len(w) AS g FROM pr),
      hd AS (SELECT a.s, a.t, max(struct_pack(g := b.g, w := b.w)) AS h FROM gp a JOIN gp b ON a.s = b.s AND len(a.w) = len(b.w) AND len(list_filter(range(1, len(a.w) + 1), lambda i: b.w[i] <> '{{*}}' AND a.w[i] <> b.w[i])) = 0 GROUP BY a.s, a.t),
      rk AS (SELECT gp.s, gp.t, c, row_number() OVER (PARTITION BY gp.s, h ORDER BY round(j, 12) DESC, g DESC, w) AS r FROM gp JOIN hd ON hd.s = gp.s AND hd.t = gp.t) SELECT s AS src, t AS tgt, round(c / sum(c) OVER (PARTITION BY s), 8) AS score FROM rk WHERE r = 1""",
    "training_instances": f"""WITH {_J}, al AS (SELECT src, tgt FROM j WHERE score >= 0.02), ps AS (SELECT sid, unnest(range(0, len(ws))) AS i, list_concat(list_concat(['{{BEGIN}}'], ws), ['{{END}}']) AS pad FROM sw),
      f AS (SELECT sid, pad[i + 2] AS focus, pad[i + 1] || ' ' || pad[i + 2] || ' ' || pad[i + 3] AS features FROM ps) SELECT focus, features, al.tgt AS label, CAST(count(*) AS DOUBLE) AS weight FROM f JOIN al ON al.src = focus WHERE (sid, al.tgt) IN (SELECT (sid, p) FROM ta) GROUP BY ALL""",
    "classifier_models": f"""WITH {_INST}, mo AS (SELECT f0, count(DISTINCT (f0, f1, f2)) AS c, count(DISTINCT label) AS t, count(*) AS i FROM inst GROUP BY f0)
      SELECT f0 AS model_id, f0 || ' ' || f1 || ' ' || f2 AS features, label, count(*) AS n FROM inst WHERE f0 IN (SELECT f0 FROM mo WHERE c >= 3 AND t >= 2 AND i >= 5) GROUP BY ALL""",
    "keyword_scores": f"WITH {_KW} SELECT qid, tgt, round(kwscore, 8) AS kwscore FROM ks",
    "rescore_kwprob": f"WITH {_KW} SELECT qid, ks.tgt, round(ln(a), 6) AS lp, round(ln(kwscore), 6) AS extra FROM ks JOIN p ON p.src = qid AND p.tgt = ks.tgt",
    "option_usage": f"WITH {_OPT} SELECT 'src' AS side, CAST(n AS INT) AS n, false AS is_skip, count(*) AS uses FROM op GROUP BY n UNION ALL SELECT 'tgt', CAST(len(string_split(tgt, ' ')) AS INT), false, count(*) FROM op GROUP BY 2",
    "test_table": f"WITH {_OPT} SELECT array_to_string(list_transform(range(pos, pos + n), lambda i: sid || '_' || i), ' ') AS places, tgt, round(lp, 8) AS first FROM op",
    "bleu": f"""WITH {_R}, hr AS (SELECT sid, ws AS h, list_concat(ws, wt) AS r FROM sw), g AS (SELECT sid, 'h' AS k, 1 AS n, unnest(h) AS x FROM hr UNION ALL SELECT sid, 'r', 1, unnest(r) FROM hr UNION ALL SELECT sid, 'h', 2, unnest(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) FROM hr
        UNION ALL SELECT sid, 'r', 2, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) FROM hr),
      c AS (SELECT sid, n, x, count(*) FILTER (k = 'h') AS h, count(*) FILTER (k = 'r') AS r FROM g GROUP BY ALL), pn AS (SELECT n, sum(least(h, r)) / sum(h) AS p FROM c GROUP BY n), l AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM hr)
      SELECT round((SELECT exp(avg(ln(p))) FROM pn) * CASE WHEN hl >= rl THEN 1 ELSE exp(1 - rl / hl) END, 9) AS bleu FROM l""",
    "position_free_errors": f"""WITH {_R}, g AS (SELECT sid, p, count(*) AS h, 0 AS r FROM so GROUP BY ALL UNION ALL SELECT sid, p, 0, count(*) FROM ta GROUP BY ALL), m AS (SELECT sid, p, sum(h) AS h, sum(r) AS r FROM g GROUP BY ALL),
      x AS (SELECT sid, sum(least(h, r)) AS hit, sum(h) AS nh, sum(r) AS nr FROM m GROUP BY sid) SELECT CAST(sum(greatest(nh, nr) - hit) AS BIGINT) AS errors, CAST(sum(nr) AS BIGINT) AS words, round(sum(greatest(nh, nr) - hit) / sum(nr), 9) AS per FROM x""",
    "averaged_runs": f"""WITH {_R}, h AS (SELECT len(ws) AS k, ('0x' || substr(md5('1:' || sid), 1, 15))::BIGINT % 3 AS run FROM sw WHERE len(ws) > 0), m AS (SELECT run, avg(k) AS words, count(*) AS rows FROM h GROUP BY run)
      SELECT 'words' AS metric, round(avg(words), 8) AS mean, count(*) AS runs FROM m UNION ALL SELECT 'rows', round(avg(rows), 8), count(*) FROM m""",
    "rescore_append": f"WITH {_O} SELECT qid, tgt, round(lp, 6) AS lp, round(coalesce(ln(p), 0), 6) AS extra FROM x",
    "rescore_replace": f"WITH {_O} SELECT qid, tgt, round(CASE WHEN NOT known THEN lp ELSE coalesce(ln(p), 0) END, 6) AS lp, 0.0::DOUBLE AS extra FROM x",
    "rescore_ignore": f"WITH {_O} SELECT qid, tgt, round(lp, 6) AS lp, 0.0::DOUBLE AS extra FROM x",
    "rescore_filtered_weighed": f"WITH {_O} SELECT qid, tgt, round(CASE WHEN p IS NOT NULL THEN lp + ln(p) + ln(b / a) ELSE lp END, 6) AS lp, 0.0::DOUBLE AS extra FROM x WHERE p IS NOT NULL OR NOT known",
}
#: The options of each sentence, counted.
DECODE_OPTIONS = f"WITH {_OPT} SELECT sid, count(*) AS n_options FROM op GROUP BY sid"
EDIT_ERRORS = f"""WITH {_R}, l AS (SELECT ws, wt, list_distinct(list_concat(ws, wt)) AS d FROM sw), k AS (SELECT array_to_string(list_transform(ws, lambda w: chr(CAST(33 + list_position(d, w) AS INT))), '') AS a, array_to_string(list_transform(wt, lambda w: chr(CAST(33 + list_position(d, w) AS INT))), '') AS b, len(wt) AS n FROM l)
  SELECT CAST(sum(levenshtein(a, b)) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words, round(sum(levenshtein(a, b)) / sum(n), 8) AS wer FROM k"""
ORACLE |= {"decode_options": DECODE_OPTIONS, "edit_errors": EDIT_ERRORS}

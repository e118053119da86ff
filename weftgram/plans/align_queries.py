"""Queries on phrase tables, alignments, language models, decoding and classifiers.

The parallel corpus is ``phrasepairs``: the words of source and target of each record,
``sid = pair_id``. Word alignments are those of the two phrase table copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.operators import align, classify, decode, graph, lm, mining, wordalign
from weftgram.operators import phrasetables as pt
from weftgram.operators.hotkeys import one_blank
from weftgram.plans import pipeline
from weftgram.runtime import cut_lineage, global_rank, small, spread, table
from weftgram.sources import corpus as C
from weftgram.sources import tables


def text(c: str, out: str | None = None) -> F.Column:
    return F.array_join(c, " ").alias(out or c)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """``sid, source, target`` once per record, blanks made single."""
    rows = table(spark, sf, "phrasepairs").select(F.col("pair_id").alias("sid"), one_blank(F.col("source")).alias("source"), one_blank(F.col("target")).alias("target"))
    return rows.dropna().groupBy("sid").agg(F.max("source").alias("source"), F.max("target").alias("target"))


def side(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """``sid, tokens`` of one side of the records."""
    return records(spark, sf).select("sid", C.split_words(F.col(name)).alias("tokens")).filter(F.size("tokens") > 0)


def words(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """``pattern, sid``: every word of a side as a pattern of one token."""
    return side(spark, sf, name).select(F.explode("tokens").alias("w"), "sid").select(F.array("w").alias("pattern"), "sid")


def align_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.cooc_scores(words(spark, sf, "source"), words(spark, sf, "target"), 0.05)
    return rows.select(text("src"), text("tgt"), "common", F.round("score", 8).alias("score"))


def align_dice(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.cooc_scores(words(spark, sf, "source"), words(spark, sf, "target"), 0.05, "dice")
    return rows.select(text("src"), text("tgt"), "common", F.round("score", 8).alias("score"))


def _cooc(spark: SparkSession, sf: str, a: str, b: str) -> DataFrame:
    return align.train_cooc(words(spark, sf, a), words(spark, sf, b), 0.0005)


def align_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _cooc(spark, sf, "source", "target").select(text("src"), text("tgt"), F.round("score", 8).alias("score"))


def align_bestn(spark: SparkSession, sf: str) -> DataFrame:
    scored = align.cooc_scores(words(spark, sf, "source"), words(spark, sf, "target"))
    rows = align.best_n(scored.withColumn("score", F.round("score", 10)), 2)
    return rows.select(text("src"), text("tgt"), F.round("score", 8).alias("score"))


def align_intersect(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.intersect(_cooc(spark, sf, "source", "target"), _cooc(spark, sf, "target", "source"))
    return rows.select(text("src"), text("tgt"), F.round("score", 8).alias("score"))


def align_two_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.two_scores(_cooc(spark, sf, "source", "target"), _cooc(spark, sf, "target", "source"))
    return rows.select(text("src"), text("tgt"), F.round("p_ts", 8).alias("p_ts"), F.round("p_st", 8).alias("p_st"))


def align_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.alignment_stats(_cooc(spark, sf, "source", "target"))
    return rows.select("sources", "pairs", F.round("average", 8).alias("average"))


def align_em_r3(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.train_em(words(spark, sf, "source"), words(spark, sf, "target"), 3)
    return rows.select(text("src"), text("tgt"), F.round("score", 6).alias("score"))


def align_em_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.train_em(words(spark, sf, "source"), words(spark, sf, "target"), 2, null=True, null_pattern=F.array(F.lit("{NULL}")))
    return rows.select(text("src"), text("tgt"), F.round("score", 6).alias("score"))


def align_graphweight(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments of the whole phrases and their words, weighted by subsumption."""
    numbers, grams, parents = [], [], []
    for name in ("source", "target"):
        corpus = side(spark, sf, name)
        # patterns are numbered, so that the pairs of a sentence are pairs of numbers
        counts = cut_lineage(global_rank(mining.count_ngrams(corpus, 2, 5), F.col("pattern")).withColumn("is_skip", F.lit(False)))
        known = small(counts.select("pattern", "rank"))
        end = lambda c: known.select(F.col("pattern").alias(c), F.col("rank").alias(f"r_{c}"))  # noqa: B023, E731
        numbers.append(known)
        grams.append(mining.postings(corpus, known, 2).select("pattern", "sid").join(known, "pattern").select(F.col("rank").alias("pattern"), "sid"))
        parents.append(graph.subsumption(counts, "{*}").join(end("parent"), "parent").join(end("child"), "child").select(F.col("r_parent").alias("parent"), F.col("r_child").alias("child")))
    # read five times by the weights
    scored = cut_lineage(align.train_cooc(*grams, 0.01))
    rows = align.graph_weights(scored, *parents)
    for c, known in zip(("src", "tgt"), numbers, strict=True):
        rows = rows.join(known.select(F.col("rank").alias(c), text("pattern", f"text_{c}")), c)
    return rows.select(F.col("text_src").alias("src"), F.col("text_tgt").alias("tgt"), F.round("score", 8).alias("score"), "w", F.round(F.log("weighted"), 6).alias("ln_weighted"))


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    s, t = words(spark, sf, "source"), words(spark, sf, "target")
    pairs = align.train_cooc(s, t, 0.002)
    counts = s.groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    rows = align.keywords(pairs, s, t, counts, 2, 3)
    return rows.select(text("src"), text("tgt"), text("kw"), F.round("p", 8).alias("p"))


def _pt(spark: SparkSession, sf: str, x: str) -> DataFrame:
    return pt.stripped(table(spark, sf, f"phrasetable_{x}"), "s", "t", "sc", "wa", "cnt")


def phrasetable_flatten(spark: SparkSession, sf: str) -> DataFrame:
    rows = pt.flatten(pt.stripped(table(spark, sf, "phrasepairs"), "source", "target"))
    return rows.select("s", "t", "rows", F.round("p_ts", 9).alias("p_ts"), F.round("p_st", 9).alias("p_st"))


def phrasetable_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of copy a whose source has several targets in copy b, and whose target is in it."""
    other = pt.distinct_pairs(_pt(spark, sf, "b"))
    several = other.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s")
    return pt.prune_by_lists(_pt(spark, sf, "a").select("s", "t", "cnt"), several, other.select("t").distinct())


def phrasetable_simplify(spark: SparkSession, sf: str) -> DataFrame:
    rows = pt.simplify(pt.distinct_pairs(_pt(spark, sf, "a")))
    return rows.select("s", "t", F.coalesce(F.size("sc"), F.lit(0)).alias("n_scores"), F.round(F.get("sc", F.lit(1)), 9).alias("second"))


def phrasetable_intersect(spark: SparkSession, sf: str) -> DataFrame:
    rows = pt.intersect(_pt(spark, sf, "a"), _pt(spark, sf, "b"))
    return rows.select("s", "t", F.round(F.get("sc", F.lit(0)), 9).alias("first"), F.round(F.get("sc", F.lit(1)), 9).alias("second"))


def phrasetable_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = pt.overlap_report(_pt(spark, sf, "a"), _pt(spark, sf, "b"))
    return rows.select("kind", "n_a", "n_b", "n_all", "n_common", F.round("part_a", 9).alias("part_a"), F.round("part_b", 9).alias("part_b"))


def phrasetable_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the vocabulary the sources of copy a hold."""
    vocab = table(spark, sf, "vocab").select(F.col("word").alias("text"), F.coalesce("freq", F.lit(0)).alias("cnt"))
    return pt.pattern_overlap(_pt(spark, sf, "a"), vocab)


def _sided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct pairs of copy a as sentences, and the pairs themselves (``sid, s, t, wa``)."""
    rows = spread(_pt(spark, sf, "a")).groupBy("s", "t").agg(F.max("wa").alias("wa"))
    rows = rows.withColumn("sid", F.conv(F.substring(F.md5(F.concat_ws("|", "s", "t")), 1, 15), 16, 10).cast("bigint"))
    return rows.select("sid", C.split_words(F.col("s")).alias("tokens")), rows.select("sid", C.split_words(F.col("t")).alias("tokens")), rows


def _points(spark: SparkSession, sf: str, x: str) -> DataFrame:
    rows = _pt(spark, sf, x).groupBy("s", "t").agg(F.max("wa").alias("wa"))
    rows = rows.withColumn("sid", F.conv(F.substring(F.md5(F.concat_ws("|", "s", "t")), 1, 15), 16, 10).cast("bigint"))
    return wordalign.parse_points(rows, "sid", "wa")


def wa_union(spark: SparkSession, sf: str) -> DataFrame:
    return wordalign.union(_points(spark, sf, "a"), _points(spark, sf, "b"))


def wa_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return wordalign.intersection(_points(spark, sf, "a"), _points(spark, sf, "b"))


def wa_grow_diag_final(spark: SparkSession, sf: str) -> DataFrame:
    return wordalign.symmetrize(_points(spark, sf, "a"), _points(spark, sf, "b"))


def lexical_table(spark: SparkSession, sf: str) -> DataFrame:
    source, target, _ = _sided(spark, sf)
    points = _points(spark, sf, "a")
    inside = points.join(source.select("sid", F.size("tokens").alias("ns")), "sid").join(target.select("sid", F.size("tokens").alias("nt")), "sid").filter("s < ns AND t < nt")
    return pt.lexical_table(inside.select("sid", "s", "t"), source, target)


def extract_phrases(spark: SparkSession, sf: str) -> DataFrame:
    source, target, _ = _sided(spark, sf)
    return wordalign.extract_phrases(_points(spark, sf, "a"), source, target, 4).select(text("src"), text("tgt"), "c")


def extract_supported(spark: SparkSession, sf: str) -> DataFrame:
    source, target, _ = _sided(spark, sf)
    grams = [mining.postings(c, mining.count_ngrams(c, 2, 3), 2) for c in (source, target)]
    pairs = wordalign.supported_pairs(_points(spark, sf, "a"), wa_union(spark, sf), *grams, least=0.5, union_bonus=True, best_only=False)
    return pairs.select("sid", "s_pos", text("src"), "t_pos", text("tgt"), F.round("score", 8).alias("score"))


def _lm(spark: SparkSession, sf: str) -> DataFrame:
    return tables.language_model(table(spark, sf, "lm_raw").select("line_id", "file_no", "line"))


def lm_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _lm(spark, sf).select(text("ngram"), "n", F.round("lp", 6).alias("lp"), F.round("bo", 6).alias("bo"))


def lm_backoff_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = lm.score_sentences(side(spark, sf, "source"), _lm(spark, sf), 3)
    return rows.select("sid", "n_words", F.round("lp", 5).alias("lp"))


def _table_align(spark: SparkSession, sf: str) -> DataFrame:
    """Scored phrase pairs of the records as word arrays, p(t|s) in logarithms, every target of a source."""
    counts = records(spark, sf).groupBy("source", "target").agg(F.count(F.lit(1)).alias("c")).select(F.col("source").alias("src"), F.col("target").alias("tgt"), "c")
    both = align.integrate_reverse(counts)
    logs = F.array(F.log("p_ts"), F.log("p_st"))
    return both.select(C.split_words(F.col("src")).alias("src"), C.split_words(F.col("tgt")).alias("tgt"), logs.alias("scores")).filter("size(src) > 0 AND size(tgt) > 0")


def decode_options(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct sources of phrase table copy a with their translation options."""
    corpus, standing = decode.once_each(_sided(spark, sf)[0])
    return decode.for_all(decode.count_options(corpus, _table_align(spark, sf), 4), standing)


def decode_beam(spark: SparkSession, sf: str) -> DataFrame:
    corpus, standing = decode.once_each(_sided(spark, sf)[0])
    options = decode.make_options(corpus, _table_align(spark, sf), 4)
    search = decode.Search(weights=(1.0, 1.0), distortion_limit=3)
    return decode.for_all(decode.decode(corpus, options, _lm(spark, sf), search), standing).select("sid", "rank", "output", F.round("score", 6).alias("score"))


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    """First and last word of a source as features, its target as label."""
    rows = records(spark, sf).withColumn("w", C.split_words(F.col("source"))).filter("size(w) > 0")
    return rows.select("sid", F.lit("all").alias("model_id"), F.array(F.get("w", F.lit(0)), F.get("w", F.size("w") - 1), F.size("w").cast("string")).alias("features"), F.element_at(F.split("target", " "), -1).alias("label"), F.lit(1.0).alias("weight"))


def information_gain(spark: SparkSession, sf: str) -> DataFrame:
    return classify.information_gain(_instances(spark, sf)).select("i", F.round("gain", 6).alias("gain"))


def knn_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest label of each different source of copy a by its nearest records."""
    corpus, _, _ = _sided(spark, sf)
    w = F.col("tokens")
    queries = corpus.filter("size(tokens) > 0").select(F.col("sid").alias("qid"), F.lit("all").alias("model_id"), F.array(F.get(w, F.lit(0)), F.get(w, F.size(w) - 1), F.size(w).cast("string")).alias("features"))
    # equal queries are asked once
    asked = queries.groupBy("model_id", "features").agg(F.min("qid").alias("qid"))
    found = classify.nearest(_instances(spark, sf), asked).select("qid", "label", F.round("p", 9).alias("p"))
    best = found.groupBy("qid").agg(F.max(F.struct("p", "label")).alias("b"))
    return best.select("qid", "b.label", F.round("b.p", 6).alias("p"))


def rescore_weighed(spark: SparkSession, sf: str) -> DataFrame:
    """Options of each source rescored by the share of their last word among all records."""
    counts = records(spark, sf).groupBy("source", "target").agg(F.count(F.lit(1)).alias("c"))
    options = align.normalize(counts.withColumn("p", F.col("c").cast("double")), "p", "source").select(F.col("source").alias("qid"), F.col("target").alias("tgt"), F.log("p").alias("lp"))
    seen = counts.groupBy("target").agg(F.sum("c").alias("n")).filter("n >= 3")
    dist = counts.join(seen, "target").select(F.col("source").alias("qid"), F.col("target").alias("label"), F.col("n").cast("double").alias("p"))
    dist = align.normalize(dist, "p", "qid")
    return classify.rescore(options, dist).select("qid", "tgt", F.round("lp", 6).alias("lp"))


def edit_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Word error rate between the sources and targets of the records."""
    rows = records(spark, sf).select(F.col("source").alias("hypothesis"), F.col("target").alias("reference"))
    return pipeline.word_error_rate(rows).select("errors", "words", F.round("wer", 8).alias("wer"))


QUERIES = {
    f.__name__: f
    for f in (
        align_jaccard, align_dice, align_normalized, align_bestn, align_intersect, align_two_scores, align_stats, align_em_r3, align_em_null, align_graphweight, keywords, phrasetable_flatten,
        phrasetable_prune, phrasetable_simplify, phrasetable_intersect, phrasetable_overlap, phrasetable_patterns, wa_union, wa_intersection, wa_grow_diag_final, lexical_table, extract_phrases,
        extract_supported, lm_entries, lm_backoff_score, decode_options, decode_beam, information_gain, knn_labels, rescore_weighed, edit_errors,
    )
}

_R = r"""raw AS (SELECT pair_id AS sid, trim(regexp_replace(source, '[ \t]+', ' ', 'g'), ' ') AS source, trim(regexp_replace(target, '[ \t]+', ' ', 'g'), ' ') AS target FROM phrasepairs),
  rec AS (SELECT sid, max(source) AS source, max(target) AS target FROM raw WHERE sid IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY sid),
  sw AS (SELECT sid, list_filter(string_split(source, ' '), lambda w: w <> '') AS ws, list_filter(string_split(target, ' '), lambda w: w <> '') AS wt FROM rec),
  so AS (SELECT sid, unnest(ws) AS p FROM sw), ta AS (SELECT sid, unnest(wt) AS p FROM sw)"""
_SIDES = """sc AS (SELECT p, sid, count(*) AS c FROM so GROUP BY p, sid), tc AS (SELECT p, sid, count(*) AS c FROM ta GROUP BY p, sid),
  st AS (SELECT p, sum(c) AS n FROM sc GROUP BY p), tt AS (SELECT p, sum(c) AS n FROM tc GROUP BY p),
  common AS (SELECT a.p AS src, b.p AS tgt, CAST(sum(least(a.c, b.c)) AS BIGINT) AS common FROM sc a JOIN tc b ON a.sid = b.sid GROUP BY a.p, b.p),
  j AS (SELECT src, tgt, common, common / (st.n + tt.n - common) AS score, 2 * common / (st.n + tt.n) AS dice FROM common JOIN st ON st.p = src JOIN tt ON tt.p = tgt)"""
_J = f"{_R}, {_SIDES}"
_COOC = f"""{_J}, k AS (SELECT src, tgt, score FROM j WHERE score >= 0.0005), f AS (SELECT src, tgt, score / sum(score) OVER (PARTITION BY src) AS score FROM k),
  b AS (SELECT src, tgt, score / sum(score) OVER (PARTITION BY tgt) AS back FROM k)"""


def _em(rounds: int, null: bool) -> str:
    extra = " UNION ALL SELECT DISTINCT sid, '{NULL}', p FROM ta" if null else ""
    sql = f"{_R}, pairs AS (SELECT DISTINCT so.sid, so.p AS src, ta.p AS tgt FROM so JOIN ta USING (sid){extra}), r0 AS (SELECT src, tgt, 1.0::DOUBLE / (SELECT count(DISTINCT tgt) FROM pairs) AS p FROM (SELECT DISTINCT src, tgt FROM pairs))"
    for i in range(1, rounds + 1):
        sql += f""", w{i} AS MATERIALIZED (SELECT sid, src, tgt, p / sum(p) OVER (PARTITION BY sid, tgt) AS w FROM pairs JOIN r{i - 1} USING (src, tgt)),
          c{i} AS (SELECT src, tgt, sum(w) AS c FROM w{i} GROUP BY src, tgt), r{i} AS MATERIALIZED (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS p FROM c{i})"""
    return f"WITH {sql} SELECT src, tgt, round(p, 6) AS score FROM r{rounds}"


_X = r"""{x} AS (SELECT trim(s, E' \t') AS s, trim(t, E' \t') AS t, sc, wa, cnt FROM phrasetable_{x} WHERE s IS NOT NULL AND t IS NOT NULL)"""
_A, _B = _X.format(x="a"), _X.format(x="b")
_CLEAN = "c AS (SELECT s, t, max(sc) AS sc FROM a GROUP BY s, t)"
_SID = "('0x' || substr(md5(s || '|' || t), 1, 15))::BIGINT"


def _wa(x: str) -> str:
    return f"""w{x} AS (SELECT {_SID} AS sid, s AS st, t AS tt, max(wa) AS wa FROM {x} GROUP BY s, t),
      p{x} AS (SELECT DISTINCT sid, CAST(split_part(q, '-', 1) AS INT) AS s, CAST(split_part(q, '-', 2) AS INT) AS t FROM (SELECT sid, unnest(regexp_split_to_array(wa, '[ \\t]+')) AS q FROM w{x}) WHERE regexp_full_match(q, '[0-9]{{1,9}}-[0-9]{{1,9}}'))"""


_SENT = """z AS (SELECT sid, list_filter(list_transform(string_split(st, ' '), lambda w: trim(w, E'\\t\\r')), lambda w: w <> '') AS ws, list_filter(list_transform(string_split(tt, ' '), lambda w: trim(w, E'\\t\\r')), lambda w: w <> '') AS wt FROM wa)"""
_LEX = f"""{_A}, {_wa('a')}, {_SENT}, pts AS (SELECT pa.sid, s, t, ws[s + 1] AS x, wt[t + 1] AS y FROM pa JOIN z USING (sid) WHERE s < len(ws) AND t < len(wt)),
  us AS (SELECT sid, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS s FROM z), ut AS (SELECT sid, unnest(wt) AS y, generate_subscripts(wt, 1) - 1 AS t FROM z),
  u AS (SELECT x, y FROM pts UNION ALL SELECT x, 'NULL' FROM us ANTI JOIN pts USING (sid, s) UNION ALL SELECT 'NULL', y FROM ut ANTI JOIN pts USING (sid, t)),
  n AS (SELECT x AS s_word, y AS t_word, count(*) AS n FROM u GROUP BY x, y)"""
_SPANS = f"""{_A}, {_wa('a')}, {_SENT}, pts AS (SELECT pa.sid, s, t FROM pa JOIN z USING (sid) WHERE s < len(ws) AND t < len(wt)),
  ts AS (SELECT sid, ws, wt, tb, unnest(range(tb, least(len(wt), tb + 4))) AS te FROM (SELECT sid, ws, wt, unnest(range(0, len(wt))) AS tb FROM z)),
  box AS (SELECT ts.sid, tb, te, min(s) AS sb, max(s) AS se FROM ts JOIN pts ON pts.sid = ts.sid AND t BETWEEN tb AND te GROUP BY ts.sid, tb, te),
  ok AS (SELECT * FROM box WHERE se - sb < 4 AND NOT EXISTS (SELECT 1 FROM pts WHERE pts.sid = box.sid AND s BETWEEN sb AND se AND t NOT BETWEEN tb AND te)),
  cand AS (SELECT ok.sid, tb, te, sb, se, ws, wt, unnest(range(0, len(ws))) AS b FROM ok JOIN z USING (sid)), cand2 AS (SELECT *, unnest(range(b, least(len(ws), b + 4))) AS e FROM cand WHERE b <= sb),
  fin AS (SELECT * FROM cand2 WHERE e >= se AND NOT EXISTS (SELECT 1 FROM pts WHERE pts.sid = cand2.sid AND (s BETWEEN b AND sb - 1 OR s BETWEEN se + 1 AND e)))"""


def _lm_sql() -> str:
    from weftgram.plans.data_queries import _LM

    return f"""{_LM}, ent AS (SELECT line_id, k AS n, regexp_replace(g, ' +', ' ', 'g') AS g, CAST(p AS DOUBLE) * 2.302585092994046 AS lp, coalesce(TRY_CAST(nullif(b, '') AS DOUBLE), 0.0) * 2.302585092994046 AS bo FROM judged WHERE ok),
      best AS (SELECT g, n, lp, bo FROM (SELECT *, row_number() OVER (PARTITION BY g, n ORDER BY line_id DESC) AS r FROM ent) WHERE r = 1),
      uni AS (SELECT g FROM best WHERE n = 1), lost AS (SELECT DISTINCT g FROM (SELECT g, unnest(string_split(g, ' ')) AS w FROM best WHERE n > 1) WHERE w NOT IN (SELECT g FROM uni)),
      model AS (SELECT * FROM best WHERE g NOT IN (SELECT g FROM lost))"""


_LMS = _lm_sql()
_INST = f"""{_R}, inst AS (SELECT sid, ws[1] AS f0, ws[len(ws)] AS f1, CAST(len(ws) AS VARCHAR) AS f2, list_extract(string_split(target, ' '), -1) AS label FROM sw JOIN rec USING (sid) WHERE len(ws) > 0),
  base AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT count(*) / (SELECT count(*) FROM inst) AS p FROM inst GROUP BY label)),
  long AS (SELECT 0 AS i, f0 AS v, label FROM inst UNION ALL SELECT 1, f1, label FROM inst UNION ALL SELECT 2, f2, label FROM inst),
  vl AS (SELECT i, v, label, count(*) AS w FROM long GROUP BY ALL), pv AS (SELECT i, v, w, sum(w) OVER (PARTITION BY i, v) AS n FROM vl),
  hv AS (SELECT i, v, any_value(n) AS n, -sum(w / n * log2(w / n)) AS h FROM pv GROUP BY i, v)"""

ORACLE = {
    "align_jaccard": f"WITH {_J} SELECT src, tgt, common, round(score, 8) AS score FROM j WHERE score >= 0.05",
    "align_dice": f"WITH {_J} SELECT src, tgt, common, round(dice, 8) AS score FROM j WHERE dice >= 0.05",
    "align_normalized": f"WITH {_COOC} SELECT src, tgt, round(score, 8) AS score FROM f",
    "align_bestn": f"WITH {_J}, r AS (SELECT src, tgt, score, rank() OVER (PARTITION BY src ORDER BY round(score, 10) DESC) AS r FROM j) SELECT src, tgt, round(score, 8) AS score FROM r WHERE r <= 2",
    "align_intersect": f"WITH {_COOC} SELECT src, tgt, round(score * back, 8) AS score FROM f JOIN b USING (src, tgt)",
    "align_two_scores": f"WITH {_COOC} SELECT src, tgt, round(score, 8) AS p_ts, round(back, 8) AS p_st FROM f JOIN b USING (src, tgt)",
    "align_stats": f"WITH {_COOC} SELECT count(DISTINCT src) AS sources, count(*) AS pairs, round(count(*) / count(DISTINCT src), 8) AS average FROM f",
    "align_em_r3": _em(3, False),
    "align_em_null": _em(2, True),
    "align_graphweight": f"""WITH {_R}, sg AS (SELECT sid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS p FROM sw),
      tg AS (SELECT sid, unnest(list_concat(wt, list_transform(range(1, len(wt)), lambda i: wt[i] || ' ' || wt[i + 1]))) AS p FROM sw),
      so2 AS (SELECT * FROM sg WHERE p IN (SELECT p FROM sg GROUP BY p HAVING count(*) >= 5)), ta2 AS (SELECT * FROM tg WHERE p IN (SELECT p FROM tg GROUP BY p HAVING count(*) >= 5)),
      {_SIDES.replace("FROM so ", "FROM so2 ").replace("FROM ta ", "FROM ta2 ")}, k AS (SELECT src, tgt, score FROM j WHERE score >= 0.01), f AS (SELECT src, tgt, score / sum(score) OVER (PARTITION BY src) AS score FROM k),
      us AS (SELECT DISTINCT p FROM so2), ut AS (SELECT DISTINCT p FROM ta2),
      ps AS (SELECT DISTINCT c.p AS child, q.p AS parent FROM us q, us c WHERE q.p LIKE '% %' AND (c.p = split_part(q.p, ' ', 1) OR c.p = split_part(q.p, ' ', 2))),
      pt AS (SELECT DISTINCT c.p AS child, q.p AS parent FROM ut q, ut c WHERE q.p LIKE '% %' AND (c.p = split_part(q.p, ' ', 1) OR c.p = split_part(q.p, ' ', 2))),
      x AS (SELECT f.src AS s, f.tgt AS t, ps.parent AS ps, pt.parent AS pt, b.src IS NOT NULL AS b, o.src IS NOT NULL AS o, w.src IS NOT NULL AS w FROM f JOIN ps ON ps.child = f.src JOIN pt ON pt.child = f.tgt
        LEFT JOIN f b ON b.src = ps.parent AND b.tgt = pt.parent LEFT JOIN f o ON o.src = ps.parent AND o.tgt = f.tgt LEFT JOIN f w ON w.src = f.src AND w.tgt = pt.parent),
      g AS (SELECT s, t, 1.0 AS w FROM x WHERE b UNION ALL SELECT ps, pt, 1.0 FROM x WHERE b UNION ALL SELECT s, t, -0.5 FROM x WHERE NOT b AND o UNION ALL SELECT ps, t, -0.5 FROM x WHERE NOT b AND o
        UNION ALL SELECT s, t, -0.5 FROM x WHERE NOT b AND w UNION ALL SELECT s, pt, -0.5 FROM x WHERE NOT b AND w), gw AS (SELECT s, t, CAST(sum(w) AS DOUBLE) AS w FROM g GROUP BY s, t)
      SELECT src, tgt, round(score, 8) AS score, coalesce(gw.w, 0) AS w, round(CASE WHEN gw.w > 0 THEN 1 - gw.w WHEN gw.w < 0 THEN gw.w + 1 ELSE 1 END * ln(score), 6) AS ln_weighted FROM f LEFT JOIN gw ON gw.s = src AND gw.t = tgt""",
    "keywords": f"""WITH {_J}, al AS (SELECT src, tgt FROM j WHERE score >= 0.002), n AS (SELECT src, count(*) AS n_targets FROM al GROUP BY src HAVING count(*) > 1),
      hs AS (SELECT DISTINCT p, sid FROM so), ht AS (SELECT DISTINCT p, sid FROM ta), bo AS (SELECT al.src, al.tgt, hs.sid, n_targets FROM al JOIN n USING (src) JOIN hs ON hs.p = al.src JOIN ht ON ht.p = al.tgt AND ht.sid = hs.sid),
      kw AS (SELECT hs.p AS kw, hs.sid, st.n AS nc FROM hs JOIN st ON st.p = hs.p WHERE st.n >= 3),
      c AS (SELECT src, tgt, kw, count(*) AS n, any_value(nc) AS nc, any_value(n_targets) AS nt FROM bo JOIN kw USING (sid) WHERE src <> kw GROUP BY src, tgt, kw),
      l AS (SELECT *, sum(n) OVER (PARTITION BY src, kw) AS loc, count(*) OVER (PARTITION BY src, kw) AS wi FROM c)
      SELECT src, tgt, kw, round(n / loc / nc, 8) AS p FROM l WHERE wi < nt AND loc >= 2""",
    "phrasetable_flatten": r"""WITH d AS (SELECT trim(source, E' \t') AS s, trim(target, E' \t') AS t FROM phrasepairs WHERE source IS NOT NULL AND target IS NOT NULL),
      c AS (SELECT s, t, count(*) AS rows FROM d GROUP BY s, t) SELECT s, t, rows, round(1.0::DOUBLE / sum(rows) OVER (PARTITION BY s), 9) AS p_ts, round(1.0::DOUBLE / sum(rows) OVER (PARTITION BY t), 9) AS p_st FROM c""",
    "phrasetable_prune": f"WITH {_A}, {_B} SELECT s, t, cnt FROM a WHERE s IN (SELECT s FROM b GROUP BY s HAVING count(DISTINCT t) > 1) AND t IN (SELECT t FROM b)",
    "phrasetable_simplify": f"""WITH {_A}, {_CLEAN} SELECT s, t, CAST(coalesce(CASE WHEN len(sc) = 5 THEN 2 ELSE len(sc) END, 0) AS INT) AS n_scores, round(CASE WHEN len(sc) = 5 THEN sc[3] ELSE sc[2] END, 9) AS second FROM c""",
    "phrasetable_intersect": f"""WITH {_A}, {_B}, {_CLEAN} SELECT s, t, round(sc[1], 9) AS first, round(CASE WHEN len(sc) = 5 THEN sc[3] ELSE sc[2] END, 9) AS second FROM c WHERE (s, t) IN (SELECT (s, t) FROM b)""",
    "phrasetable_overlap": f"WITH {_A}, {_B} "
    + " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, (SELECT count(DISTINCT {k}) FROM a) AS n_a, (SELECT count(DISTINCT {k}) FROM b) AS n_b, (SELECT count(*) FROM (SELECT {k} FROM a UNION SELECT {k} FROM b)) AS n_all,
          (SELECT count(*) FROM (SELECT {k} FROM a INTERSECT SELECT {k} FROM b)) AS n_common, round((SELECT count(*) FROM (SELECT {k} FROM a INTERSECT SELECT {k} FROM b)) / (SELECT count(DISTINCT {k}) FROM a), 9) AS part_a,
          round((SELECT count(*) FROM (SELECT {k} FROM a INTERSECT SELECT {k} FROM b)) / (SELECT count(DISTINCT {k}) FROM b), 9) AS part_b"""
        for kind, k in (("source", "s"), ("target", "t"), ("pair", "(s, t)"))
    ),
    "phrasetable_patterns": f"""WITH {_A} SELECT count(*) AS types, count(*) FILTER (word IN (SELECT s FROM a)) AS types_held, CAST(sum(coalesce(freq, 0)) AS BIGINT) AS occurrences,
      CAST(coalesce(sum(coalesce(freq, 0)) FILTER (word IN (SELECT s FROM a)), 0) AS BIGINT) AS occurrences_held FROM vocab""",
    "wa_union": f"WITH {_A}, {_B}, {_wa('a')}, {_wa('b')} SELECT * FROM pa UNION SELECT * FROM pb",
    "wa_intersection": f"WITH {_A}, {_B}, {_wa('a')}, {_wa('b')} SELECT * FROM pa INTERSECT SELECT * FROM pb",
    "lexical_table": f"WITH {_LEX} SELECT s_word, t_word, n, round(n / sum(n) OVER (PARTITION BY s_word), 7) AS w_ts, round(n / sum(n) OVER (PARTITION BY t_word), 7) AS w_st FROM n",
    "extract_phrases": f"WITH {_SPANS} SELECT array_to_string(ws[b + 1:e + 1], ' ') AS src, array_to_string(wt[tb + 1:te + 1], ' ') AS tgt, count(*) AS c FROM fin GROUP BY ALL",
    "extract_supported": f"""WITH {_A}, {_B}, {_wa('a')}, {_wa('b')}, {_SENT}, un AS (SELECT * FROM pa UNION SELECT * FROM pb),
      g1 AS (SELECT sid, unnest(range(0, len(ws))) AS pos, ws, 1 AS n FROM z UNION ALL SELECT sid, unnest(range(0, len(ws) - 1)), ws, 2 FROM z), so AS (SELECT sid, pos, n, array_to_string(ws[pos + 1:pos + n], ' ') AS p FROM g1),
      g2 AS (SELECT sid, unnest(range(0, len(wt))) AS pos, wt, 1 AS n FROM z UNION ALL SELECT sid, unnest(range(0, len(wt) - 1)), wt, 2 FROM z), t0 AS (SELECT sid, pos, n, array_to_string(wt[pos + 1:pos + n], ' ') AS p FROM g2),
      fs AS (SELECT * FROM so WHERE p IN (SELECT p FROM so GROUP BY p HAVING count(*) >= 3)), ft AS (SELECT * FROM t0 WHERE p IN (SELECT p FROM t0 GROUP BY p HAVING count(*) >= 3)),
      q AS (SELECT s.sid, s.pos AS sp, s.n AS sn, s.p AS src, t.pos AS tp, t.n AS tn, t.p AS tgt FROM fs s JOIN ft t ON s.sid = t.sid),
      r AS (SELECT q.*, count(*) FILTER (ins AND intt) AS c, count(*) FILTER (ins <> intt) AS bad, bool_or(ins AND s = sp) AS a1, bool_or(ins AND s = sp + sn - 1) AS a2, bool_or(intt AND t = tp) AS b1, bool_or(intt AND t = tp + tn - 1) AS b2
        FROM (SELECT q.*, s, t, s BETWEEN sp AND sp + sn - 1 AS ins, t BETWEEN tp AND tp + tn - 1 AS intt FROM q JOIN pa ON pa.sid = q.sid) q GROUP BY ALL),
      ok AS (SELECT r.sid, sp, sn, src, tp, tn, tgt, sum(c) AS c FROM (SELECT sid, sp, sn, src, tp, tn, tgt, sum(c) AS c, sum(bad) AS bad, bool_or(a1) AS a1, bool_or(a2) AS a2, bool_or(b1) AS b1, bool_or(b2) AS b2 FROM r GROUP BY ALL) r WHERE bad = 0 AND a1 AND a2 AND b1 AND b2 GROUP BY ALL),
      w AS (SELECT ok.*, (SELECT count(*) FROM un WHERE un.sid = ok.sid AND un.s BETWEEN sp AND sp + sn - 1 AND un.t BETWEEN tp AND tp + tn - 1) - c AS extra FROM ok)
      SELECT sid, sp AS s_pos, src, tp AS t_pos, tgt, round(least(1.0::DOUBLE, least(1.0::DOUBLE, c / greatest(sn, tn)) + greatest(extra, 0) / (4 * greatest(sn, tn))), 8) AS score FROM w
      WHERE least(1.0::DOUBLE, least(1.0::DOUBLE, c / greatest(sn, tn)) + greatest(extra, 0) / (4 * greatest(sn, tn))) >= 0.5""",
    "lm_entries": f"WITH {_LMS} SELECT g AS ngram, n, round(lp, 6) AS lp, round(bo, 6) AS bo FROM model",
    "lm_backoff_score": f"""WITH {_R}, {_LMS}, u AS (SELECT sid, list_concat(ws, ['</s>']) AS v FROM sw WHERE len(ws) > 0), pad AS (SELECT sid, list_concat(['<s>'], v) AS h, v, unnest(range(1, len(v) + 1)) AS i FROM u),
      q AS (SELECT sid, i, CASE WHEN v[i] IN (SELECT g FROM uni) THEN v[i] ELSE '<unk>' END AS w, h[i] AS h1, CASE WHEN i >= 2 THEN h[i - 1] END AS h2 FROM pad),
      sc AS (SELECT sid, CASE WHEN h2 IS NULL THEN coalesce(m2.lp, coalesce(b1.bo, 0) + m1.lp) ELSE coalesce(m3.lp, coalesce(b2.bo, 0) + coalesce(m2.lp, coalesce(b1.bo, 0) + m1.lp)) END AS lp
        FROM q LEFT JOIN model m1 ON m1.g = w LEFT JOIN model m2 ON m2.g = h1 || ' ' || w LEFT JOIN model m3 ON m3.g = h2 || ' ' || h1 || ' ' || w
        LEFT JOIN model b1 ON b1.g = h1 LEFT JOIN model b2 ON b2.g = h2 || ' ' || h1)
      SELECT sid, count(*) AS n_words, round(sum(lp), 5) AS lp FROM sc GROUP BY sid""",
    "information_gain": f"WITH {_INST} SELECT CAST(i AS INT) AS i, round((SELECT h FROM base) - sum(h * n) / (SELECT count(*) FROM inst), 6) AS gain FROM hv GROUP BY i",
    "rescore_weighed": f"""WITH {_R}, c AS (SELECT source, target, count(*) AS c FROM rec GROUP BY ALL), o AS (SELECT source, target, ln(c / sum(c) OVER (PARTITION BY source)) AS lp FROM c),
      seen AS (SELECT target, sum(c) AS n FROM c GROUP BY target HAVING sum(c) >= 3), d AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS p FROM c JOIN seen USING (target)),
      x AS (SELECT source, target, lp, p, sum(CASE WHEN p IS NOT NULL THEN exp(lp) END) OVER (PARTITION BY source) AS b, sum(CASE WHEN p IS NOT NULL THEN exp(lp + ln(p)) END) OVER (PARTITION BY source) AS a FROM o LEFT JOIN d USING (source, target))
      SELECT source AS qid, target AS tgt, round(CASE WHEN p IS NOT NULL THEN lp + ln(p) + ln(b / a) ELSE lp END, 6) AS lp FROM x""",
}

"""Alignment of the patterns of two sentence-aligned corpora.

Inputs are occurrence tables ``pattern, sid`` (one row per occurrence) of either side;
sentence ids pair the corpora. Alignments are ``src, tgt`` with scalar scores while they
are computed. Rows with nulls and empty sides give no pairs.

The join on the sentence is many-to-many, so both sides are first reduced to one row per
(pattern, sentence) and, where an operator allows it, to the patterns that can
still pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.runtime import cut_lineage, small


def per_sentence(occurrences: DataFrame) -> DataFrame:
    """``pattern, sid, c`` of the occurrences without nulls."""
    return occurrences.select("pattern", "sid").dropna().groupBy("pattern", "sid").agg(F.count(F.lit(1)).alias("c"))


def totals(sent: DataFrame) -> DataFrame:
    return sent.groupBy("pattern").agg(F.sum("c").alias("total"))


def best_n(pairs: DataFrame, n: int, score: str = "score", by: str = "src") -> DataFrame:
    """The n best per source, ties at the end kept."""
    rank = F.rank().over(Window.partitionBy(by).orderBy(F.desc(score)))
    return pairs.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def normalize(pairs: DataFrame, score: str = "score", by: str = "src", out: str | None = None) -> DataFrame:
    """Scores divided by their sum over the targets of a source.

    Sums are aggregated and joined back, so a hot source is one row of sums and no window.
    """
    total = pairs.groupBy(by).agg(F.sum(score).alias("__total"))
    shared = pairs.join(total, by).withColumn(out or score, F.col(score) / F.col("__total"))
    return shared.select(*pairs.columns, *([out] if out and out not in pairs.columns else []))


def cooc_scores(source: DataFrame, target: DataFrame, least: float = 0.0, measure: str = "jaccard") -> DataFrame:
    """``src, tgt, common, score`` over sentence multisets.

    ``jaccard``: common / (size_s + size_t - common); ``dice``: 2 common / (size_s + size_t).
    A pair cannot score above the ratio of its sizes, so pairs below ``least`` by that
    bound are dropped before they are counted.
    """
    s, t = per_sentence(source), per_sentence(target)
    rows_s = s.join(totals(s), "pattern").select(F.col("pattern").alias("src"), "sid", F.col("c").alias("cs"), F.col("total").alias("ts"))
    rows_t = t.join(totals(t), "pattern").select(F.col("pattern").alias("tgt"), "sid", F.col("c").alias("ct"), F.col("total").alias("tt"))
    pairs = rows_s.join(rows_t, "sid")
    if least > 0 and measure == "jaccard":
        pairs = pairs.filter(F.least("ts", "tt") >= F.greatest("ts", "tt") * F.lit(least))
    common = pairs.groupBy("src", "tgt").agg(F.sum(F.least("cs", "ct")).alias("common"), F.first("ts").alias("ts"), F.first("tt").alias("tt"))
    score = F.col("common") / (F.col("ts") + F.col("tt") - F.col("common")) if measure == "jaccard" else 2 * F.col("common") / (F.col("ts") + F.col("tt"))
    out = common.select("src", "tgt", "common", score.alias("score"))
    return out.filter(F.col("score") >= least) if least > 0 else out


def train_cooc(source: DataFrame, target: DataFrame, least: float = 0.0, bestn: int = 0, least_prob: float = 0.0, normal: bool = True, measure: str = "jaccard") -> DataFrame:
    """``src, tgt, score``: co-occurrence alignment.

    The probability threshold looks at the share of a source's sum over all candidates,
    those below the other thresholds included.
    """
    scored = cooc_scores(source, target, 0.0 if least_prob > 0 else least, measure)
    if least_prob > 0:
        scored = normalize(scored, out="share")
    kept = scored.filter(F.col("score") >= least)
    kept = best_n(kept, bestn) if bestn else kept
    if least_prob > 0:
        kept = kept.filter(F.col("share") >= least_prob)
    kept = kept.select("src", "tgt", "score")
    return normalize(kept) if normal else kept


#: Source of words that stem from none.
NULL_SOURCE = -1


def train_em(
    source: DataFrame, target: DataFrame, rounds: int = 10, epsilon: float | None = None, least: float = 0.0, bestn: int = 0,
    null: bool = False, init: DataFrame | None = None, weighted: bool = False, null_pattern: Column | None = None,
) -> DataFrame:
    """``src, tgt, score``: expectation maximisation of p(tgt | src) over sentence sets.

    Starts uniform over target types, or from ``init`` (``src, tgt, score``). Stops after
    ``rounds``, or when the mean change of a cell moves by at most ``epsilon`` between
    rounds. ``null`` adds a source to every sentence; ``weighted`` counts repeats in a
    sentence. The sentence pairs are written once to the checkpoint folder; each round
    joins them with the current table and cuts its lineage.
    """
    s = per_sentence(source).select(F.col("pattern").alias("src"), "sid", F.col("c").alias("cs"))
    t = per_sentence(target).select(F.col("pattern").alias("tgt"), "sid", F.col("c").alias("ct"))
    if null:
        mark = null_pattern if null_pattern is not None else F.array(F.lit(NULL_SOURCE))
        s = s.unionByName(t.select("sid").distinct().select(mark.alias("src"), "sid", F.lit(1).cast("bigint").alias("cs")))
    weight = (F.col("cs") * F.col("ct")).cast("double") if weighted else F.lit(1.0)
    pairs = cut_lineage(s.join(t, "sid").select("sid", "src", "tgt", weight.alias("w")))
    table = uniform = None
    if init is not None:
        table = cut_lineage(pairs.select("src", "tgt").distinct().join(init.select("src", "tgt", F.col("score").alias("p")), ["src", "tgt"]))
    else:
        uniform = F.lit(1.0 / max(1, pairs.select("tgt").distinct().count()))
        if rounds == 0:
            table = pairs.select("src", "tgt").distinct().withColumn("p", uniform)
    before = 0.0
    for _ in range(rounds):
        # in the first round every pair has the same probability, and nothing is looked up
        joined = pairs.withColumn("p", uniform) if table is None else pairs.join(small(table), ["src", "tgt"])
        # a source explains a target occurrence by its share among the sources of the sentence
        share = joined.withColumn("s", F.sum("p").over(Window.partitionBy("sid", "tgt")))
        counts = share.groupBy("src", "tgt").agg(F.sum(F.col("w") * F.col("p") / F.col("s")).alias("c"), F.first("p").alias("old"))
        updated = cut_lineage(normalize(counts, "c", out="p").select("src", "tgt", "p", "old"))
        table = updated.select("src", "tgt", "p")
        if epsilon is not None:
            moved = updated.agg(F.avg(F.abs(F.col("p") - F.col("old")))).first()[0] or 0.0
            if abs(moved - before) <= epsilon:
                break
            before = moved
    out = table.select("src", "tgt", F.col("p").alias("score")).filter(F.col("score") >= least)
    return best_n(out, bestn) if bestn else out


def intersect(forward: DataFrame, backward: DataFrame, least: float = 0.0, bestn: int = 0) -> DataFrame:
    """Pairs of both directions with the product of their scores."""
    back = backward.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("score").alias("back"))
    both = forward.join(back, ["src", "tgt"]).select("src", "tgt", (F.col("score") * F.col("back")).alias("score"))
    both = both.filter(F.col("score") >= least)
    return best_n(both, bestn) if bestn else both


def two_scores(forward: DataFrame, backward: DataFrame, least_ts: float = 0.0, least_st: float = 0.0, least_product: float = 0.0) -> DataFrame:
    """``src, tgt, p_ts, p_st`` of the pairs of both directions."""
    back = backward.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("score").alias("p_st"))
    both = forward.select("src", "tgt", F.col("score").alias("p_ts")).join(back, ["src", "tgt"])
    return both.filter((F.col("p_ts") >= least_ts) & (F.col("p_st") >= least_st) & (F.col("p_ts") * F.col("p_st") >= least_product))


def integrate_reverse(counts: DataFrame, count: str = "c", single: bool = False) -> DataFrame:
    """Both conditional probabilities of pair counts, or their product as one score."""
    pairs = counts.select("src", "tgt", count)
    out = normalize(normalize(pairs, count, "src", "p_ts"), count, "tgt", "p_st").select("src", "tgt", "p_ts", "p_st")
    return out.select("src", "tgt", (F.col("p_ts") * F.col("p_st")).alias("score")) if single else out


def prune(align: DataFrame, least: float, scores: str = "scores") -> DataFrame:
    """Pairs whose score product reaches ``least``."""
    return align.filter(P.product(scores) >= least)


def graph_weights(align: DataFrame, parents_s: DataFrame, parents_t: DataFrame) -> DataFrame:
    """``src, tgt, score, w, weighted``: alignments reweighted by those of their parents.

    ``parents_*`` are ``child, parent``. For a pair and each two parents of its sides: if
    the parents are aligned, both pairs gain 1; if not, an alignment of one side with
    the other side's parent is crossed, and takes a half off itself and the pair. The
    score becomes p^(1-w) for w > 0 and p^(w+1) for w < 0. For 0 < p < 1 that raises a
    score either way, which is the published formula.
    """
    ps, pt = parents_s.select(F.col("child").alias("s"), F.col("parent").alias("ps")), parents_t.select(F.col("child").alias("t"), F.col("parent").alias("pt"))
    pairs = align.select(F.col("src").alias("s"), F.col("tgt").alias("t"))
    # from the parents down: a pattern has few children, a frequent word as many parents as there are patterns with it
    both = align.select(F.col("src").alias("ps"), F.col("tgt").alias("pt")).join(ps, "ps").join(pt, "pt").join(pairs, ["s", "t"], "left_semi")

    def crossed(rows: DataFrame, parent: str, end: str, others: DataFrame) -> DataFrame:
        """Once for each parent of the other side that is not aligned to this one."""
        n = others.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        aligned = both.groupBy("s", "t", parent).agg(F.count(F.lit(1)).alias("b"))
        rows = rows.join(pairs, ["s", "t"], "left_semi").join(n, end).join(aligned, ["s", "t", parent], "left")
        return rows.select("s", "t", parent, (F.lit(-0.5) * (F.col("n") - F.coalesce("b", F.lit(0)))).alias("w"))

    one = crossed(align.select(F.col("src").alias("ps"), F.col("tgt").alias("t")).join(ps, "ps"), "ps", "t", pt)
    two = crossed(align.select(F.col("src").alias("s"), F.col("tgt").alias("pt")).join(pt, "pt"), "pt", "s", ps)
    share = lambda rows, x, y: rows.select(F.explode(F.array(F.struct(F.col(x).alias("src"), F.col(y).alias("tgt")), F.struct(F.col("s").alias("src"), F.col("t").alias("tgt")))).alias("x"), "w")
    shares = share(both.withColumn("w", F.lit(1.0)), "ps", "pt").unionByName(share(one, "ps", "t")).unionByName(share(two, "s", "pt"))
    weights = shares.groupBy("x.src", "x.tgt").agg(F.sum("w").alias("w"))
    rows = align.join(weights, ["src", "tgt"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    w, p = F.col("w"), F.col("score")
    return rows.select("src", "tgt", "score", "w", F.when(w > 0, F.pow(p, 1 - w)).when(w < 0, F.pow(p, w + 1)).otherwise(p).alias("weighted"))


def skipgram_alignment(align: DataFrame, templates_s: DataFrame, templates_t: DataFrame, source: DataFrame, target: DataFrame, least: int = 2, gap=P.GAP) -> DataFrame:
    """``src, tgt, score``: templates aligned through the n-gram alignments of their instances.

    ``templates_*`` are ``instance, template``. A pair of templates needs ``least`` aligned
    instances. The targets of a source are clustered by the template relation, each
    cluster named by its most general member; of a cluster the target with
    the best Jaccard score stays (then the higher gap ratio, then the least pattern).
    """
    ts = templates_s.select(F.col("instance").alias("src"), F.col("template").alias("s"))
    tt = templates_t.select(F.col("instance").alias("tgt"), F.col("template").alias("t"))
    counts = align.select("src", "tgt").join(ts, "src").join(tt, "tgt").groupBy("s", "t").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    scores = cooc_scores(source, target).select(F.col("src").alias("s"), F.col("tgt").alias("t"), F.col("score").alias("j"))
    pairs = counts.join(scores, ["s", "t"], "left").withColumn("j", F.coalesce("j", F.lit(0.0)))
    a = pairs.select("s", F.col("t").alias("t"))
    b = pairs.select("s", F.col("t").alias("u"))
    general = a.join(b, "s").filter(P.template_relation("t", "u", gap) >= 0).filter((F.col("t") == F.col("u")) | (P.template_relation("t", "u", gap) == 1))
    heads = general.groupBy("s", "t").agg(F.max(F.struct(P.gap_ratio("u", gap).alias("g"), F.col("u").alias("u"))).alias("h")).select("s", "t", F.col("h.u").alias("head"))
    ranked = pairs.join(heads, ["s", "t"]).withColumn(
        "__r", F.row_number().over(Window.partitionBy("s", "head").orderBy(F.desc("j"), F.desc(P.gap_ratio("t", gap)), "t"))
    )
    kept = ranked.filter("__r = 1").select(F.col("s").alias("src"), F.col("t").alias("tgt"), F.col("c").cast("double").alias("score"))
    return normalize(kept)


def sum_contexts(options: DataFrame) -> DataFrame:
    """``focus, tgt, score`` from ``focus, context, tgt, lp``: probabilities summed over contexts and normalised."""
    summed = options.groupBy("focus", "tgt").agg(F.sum(F.exp("lp")).alias("score"))
    return normalize(summed, "score", "focus")


def remove_context(options: DataFrame) -> DataFrame:
    """``focus, tgt, p_ts, p_st`` from ``focus, context, tgt, lp_ts, lp_st``.

    The first score is summed over contexts and normalised per focus; the second is
    summed and divided by its sum over all sources of the target.
    """
    summed = options.groupBy("focus", "tgt").agg(F.sum(F.exp("lp_ts")).alias("p_ts"), F.sum(F.exp("lp_st")).alias("p_st"))
    return normalize(normalize(summed, "p_ts", "focus"), "p_st", "tgt")


def options_with_fallback(asked: DataFrame, align: DataFrame) -> DataFrame:
    """``qid, key, tgt, score``: options of the pattern in its context, else of the pattern alone.

    ``asked`` is ``qid, in_context, focus``; ``align`` is ``src, tgt, score``.
    """
    table = align.select("src", "tgt", "score")
    direct = asked.join(table, asked["in_context"] == table["src"]).select("qid", F.col("src").alias("key"), "tgt", "score")
    rest = asked.join(direct.select("qid").distinct(), "qid", "left_anti")
    return direct.unionByName(rest.join(table, F.col("focus") == F.col("src")).select("qid", F.col("src").alias("key"), "tgt", "score"))


def keywords(align: DataFrame, source: DataFrame, target: DataFrame, corpus_counts: DataFrame, least_source: int = 1, least_keyword: int = 1, least_p: float = 0.0, bestn: int = 0) -> DataFrame:
    """``src, tgt, kw, p``: patterns that tell the targets of a source apart.

    For sources with more than one target: kw co-occurs with (src, tgt) in sentences that
    hold both, is no part of src, and p = (N_kw,tgt / N_kw,src) / count(kw). Keywords
    found with every target of the source say nothing and go. ``corpus_counts`` is
    ``pattern, cnt`` of the source side.
    """
    several = align.groupBy("src").agg(F.count(F.lit(1)).alias("n_targets")).filter("n_targets > 1")
    pairs = align.select("src", "tgt").join(several, "src")
    held_s = source.select("pattern", "sid").dropna().distinct()
    held_t = target.select("pattern", "sid").dropna().distinct()
    both = pairs.join(held_s.select(F.col("pattern").alias("src"), "sid"), "src").join(held_t.select(F.col("pattern").alias("tgt"), "sid"), ["tgt", "sid"])
    # p is at most 1 / count(kw), so a keyword beyond 1 / least_p cannot pass
    useful = (F.col("cnt") >= least_keyword) & (F.col("cnt") * F.lit(float(least_p)) <= 1)
    frequent = corpus_counts.filter(useful).select(F.col("pattern").alias("kw"), F.col("cnt").alias("n_corpus"))
    kws = held_s.select(F.col("pattern").alias("kw"), "sid").join(frequent, "kw")
    counted = both.join(kws, "sid").groupBy("src", "tgt", "kw").agg(F.count(F.lit(1)).alias("n"), F.first("n_corpus").alias("n_corpus"), F.first("n_targets").alias("n_targets"))
    counted = counted.filter((F.col("src") != F.col("kw")) & ~P.contains("src", "kw"))
    over = Window.partitionBy("src", "kw")
    scored = counted.withColumns({"local": F.sum("n").over(over), "with": F.count(F.lit(1)).over(over)})
    scored = scored.filter((F.col("with") < F.col("n_targets")) & (F.col("local") >= least_source))
    out = scored.select("src", "tgt", "kw", (F.col("n") / F.col("local") / F.col("n_corpus")).alias("p")).filter(F.col("p") >= least_p)
    if bestn:
        rank = F.row_number().over(Window.partitionBy("src", "tgt").orderBy(F.desc("p"), "kw"))
        out = out.withColumn("__r", rank).filter(F.col("__r") <= bestn).drop("__r")
    return out


def alignment_stats(align: DataFrame) -> DataFrame:
    """One row: sources, pairs, average targets of a source."""
    return align.agg(F.count_distinct("src").alias("sources"), F.count(F.lit(1)).alias("pairs")).withColumn("average", F.col("pairs") / F.nullif("sources", F.lit(0)))

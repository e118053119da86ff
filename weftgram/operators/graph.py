"""Relations between the patterns of a model, as edge tables.

Patterns are arrays with a gap token; ``postings`` is ``pattern, n, sid, pos`` with a
row per occurrence. Every relation is an equi-join; sentences serve as join key only
after the patterns are reduced by count. Repeated postings and rows with nulls must
be removed first (``clean_postings``). Empty tables give empty edges.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.operators.mining import template_pairs
from weftgram.runtime import cut_lineage, global_rank, small, with_scalars

RELATIONS = ["child", "parent", "successor", "predecessor", "cooc", "skipcontent", "skipusage", "template", "instance"]


def clean_postings(raw: DataFrame) -> DataFrame:
    """Distinct occurrences without nulls, of a table with ``pattern, sid, pos``."""
    rows = raw.select("pattern", "sid", "pos").dropna().distinct()
    return rows.select("pattern", F.size("pattern").alias("n"), "sid", "pos")


def by_sentence(raw: DataFrame) -> DataFrame:
    """The same, moved once: all occurrences of a sentence stand in one partition."""
    return clean_postings(raw.select("pattern", "sid", "pos").dropna().repartition("sid"))


def pattern_counts(postings: DataFrame, gap=P.GAP) -> DataFrame:
    """``pattern, n, is_skip, cnt`` of a posting table."""
    counts = postings.groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("pattern", F.size("pattern").alias("n"), P.is_skipgram("pattern", gap).alias("is_skip"), "cnt")


def sentence_counts(postings: DataFrame) -> DataFrame:
    """``pattern, n_sentences`` by distinct sentence."""
    return postings.select("pattern", "sid").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n_sentences"))


def reverse_index(postings: DataFrame) -> DataFrame:
    """``sid, pattern`` without repeats."""
    return postings.select("sid", "pattern").distinct()


def subsumption(patterns: DataFrame, gap=P.GAP) -> DataFrame:
    """``parent, child``: patterns and their contiguous parts that are in the model.

    A child is an n-gram. Of a skipgram, its parts and their sub-n-grams count.
    """
    pieces = F.transform(P.parts("pattern", gap), lambda part: F.concat(F.array(part), P.subngrams(part)))
    inner = F.when(P.is_skipgram("pattern", gap), F.flatten(pieces)).otherwise(P.subngrams("pattern"))
    edges = patterns.select(F.col("pattern").alias("parent"), F.explode(F.array_distinct(inner)).alias("child"))
    known = patterns.filter(~P.is_skipgram("pattern", gap)).select(F.col("pattern").alias("child"))
    return edges.join(known, "child", "left_semi").select("parent", "child")


def successors(postings: DataFrame) -> DataFrame:
    """``src, dst, w``: dst begins where src ends, w times."""
    a = postings.select(F.col("pattern").alias("src"), "sid", (F.col("pos") + F.col("n")).alias("at"))
    b = postings.select(F.col("pattern").alias("dst"), "sid", F.col("pos").alias("at"))
    return a.join(b, ["sid", "at"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def predecessors(postings: DataFrame) -> DataFrame:
    """``src, dst, w``: dst ends where src begins; the successor edges reversed."""
    return successors(postings).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def cooccurrence(postings: DataFrame, least_sentences: int, least: int = 1, directed: bool = False, gap=P.GAP) -> DataFrame:
    """``src, dst, w``: pairs of positions of two n-grams in one sentence.

    Only n-grams in more than ``least_sentences`` sentences take part, and edges below
    ``least`` are dropped. ``directed`` asks dst not to begin before src. The positions of a
    pattern in a sentence are first gathered, so a pair is one row per sentence.
    """
    grams = postings.filter(~P.is_skipgram("pattern", gap))
    frequent = sentence_counts(grams).filter(F.col("n_sentences") > least_sentences).select("pattern")
    held = grams.join(frequent, "pattern", "left_semi").groupBy("sid", "pattern").agg(F.collect_list("pos").alias("at"))
    a = held.select("sid", F.col("pattern").alias("src"), F.col("at").alias("a"))
    b = held.select("sid", F.col("pattern").alias("dst"), F.col("at").alias("b"))
    # each pair once; its edges of both ways are made from its counts at the end
    pairs = a.join(b, "sid").filter("src < dst")
    ahead = lambda x, y: F.aggregate(x, F.lit(0).cast("bigint"), lambda t, i: t + F.size(F.filter(y, lambda j: j >= i)))
    both = (F.size("a") * F.size("b")).cast("bigint")
    there, back = (ahead("a", "b"), ahead("b", "a")) if directed else (both, both)
    sums = pairs.groupBy("src", "dst").agg(F.sum(there).alias("w"), F.sum(back).alias("v"))
    ways = F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("v").alias("w")))
    return sums.select(F.explode(ways).alias("e")).select("e.src", "e.dst", "e.w").filter((F.col("w") >= least) & (F.col("w") > 0))


def followed(postings: DataFrame) -> DataFrame:
    """``src, dst, w`` as by ``successors``, and the occurrences of every pattern under a null dst.

    ``postings`` stand by sentence; each sentence is gathered and looks up its own successors, so
    occurrences are not moved again.
    """
    held = postings.groupBy("sid").agg(F.collect_list(F.struct("pos", "pattern")).alias("held"))
    each = held.select("held", F.explode("held").alias("o")).select(F.col("o.pattern").alias("src"), "held", (F.col("o.pos") + F.size("o.pattern")).alias("at"))
    own = F.array(F.struct(F.col("at").alias("pos"), F.lit(None).alias("pattern")))
    rows = each.select("src", "at", F.explode(F.concat(own, "held")).alias("o")).filter(F.col("o.pos") == F.col("at")).select("src", F.col("o.pattern").alias("dst"))
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def shared_sentences(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, joint``: sentences common to the two patterns of each given pair.

    The patterns of the pairs are numbered. A sentence names the pairs of its own patterns, so the
    work grows with the sentences, not with the pairs of a frequent pattern times its sentences.
    Repeated postings do no harm.
    """
    pairs = cut_lineage(pairs.select("a", "b"))
    ends = cut_lineage(global_rank(pairs.select(F.explode(F.array("a", "b")).alias("pattern")).distinct(), F.col("pattern")))
    numbers, n = small(ends), F.lit(ends.count())
    x, y = (numbers.select(F.col("pattern").alias(k), F.col("rank").alias(f"r_{k}")) for k in ("a", "b"))
    code = F.least("r_a", "r_b") * n + F.greatest("r_a", "r_b")
    coded = cut_lineage(pairs.join(x, "a").join(y, "b").select("a", "b", code.alias("code")))
    held = postings.select("pattern", "sid").join(numbers, "pattern").groupBy("sid").agg(F.sort_array(F.collect_set("rank")).alias("held"))
    each = held.select("held", F.posexplode("held").alias("i", "x")).select("x", F.explode(F.slice("held", F.col("i") + 1, F.size("held"))).alias("y"))
    asked = each.select((F.col("x") * n + F.col("y")).alias("code")).join(small(coded.select("code").distinct()), "code", "left_semi")
    return coded.join(asked.groupBy("code").agg(F.count(F.lit(1)).alias("joint")), "code").select("a", "b", "joint")


def pmi(joint: Column, count_a: Column, count_b: Column) -> Column:
    """ln(joint / (count_a count_b)), not normalised by the size of the corpus."""
    return F.log(joint / (count_a * count_b))


def npmi(joint: Column, count_a: Column, count_b: Column, occurrences: Column) -> Column:
    return pmi(joint, count_a, count_b) / -F.log(joint / occurrences)


def textbook_pmi(joint: Column, count_a: Column, count_b: Column, n: Column) -> Column:
    return F.log(joint * n / (count_a * count_b))


def ranked_cooccurrence(edges: DataFrame, patterns: DataFrame, style: str = "count") -> DataFrame:
    """``src, dst, w, score`` by count, pmi or npmi; other styles raise."""
    if style not in ("count", "pmi", "npmi"):
        raise ValueError(f"no such ranking: {style}")
    ca, cb = (patterns.select(F.col("pattern").alias(k), F.col("cnt").alias(f"c_{k}")) for k in ("src", "dst"))
    rows = edges.join(ca, "src").join(cb, "dst")
    if style == "npmi":
        rows = with_scalars(rows, patterns.agg(F.sum("cnt").alias("occurrences")))
        score = npmi(F.col("w"), F.col("c_src"), F.col("c_dst"), F.col("occurrences"))
    else:
        score = pmi(F.col("w"), F.col("c_src"), F.col("c_dst")) if style == "pmi" else F.col("w").cast("double")
    return rows.select("src", "dst", "w", score.alias("score"))


def skip_relations(contents: DataFrame, patterns: DataFrame, gap=P.GAP) -> DataFrame:
    """``src, dst, w``: a skipgram and the known patterns among its contents and their parts.

    Each distinct content counts once for itself and for each of its parts. ``contents`` is
    ``pattern, content``, once each or by occurrence; a mined model has the former at hand.
    """
    contents = contents.select("pattern", "content").distinct()
    pieces = F.array_distinct(F.concat(F.array("content"), P.parts("content", gap)))
    rows = contents.select(F.col("pattern").alias("src"), F.explode(pieces).alias("dst"))
    known = patterns.select(F.col("pattern").alias("dst"))
    return rows.join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def instances(contents: DataFrame, patterns: DataFrame) -> DataFrame:
    """``template, instance``: skipgrams and the n-grams of the model that fill them.

    ``contents`` is ``pattern, inst``, once each or by occurrence; a mined model has the former at hand.
    """
    rows = contents.select(F.col("pattern").alias("template"), F.col("inst").alias("instance"))
    return rows.join(patterns.select(F.col("pattern").alias("instance")), "instance", "left_semi").select("template", "instance").distinct()


def sibling_templates(instance_edges: DataFrame, gap=P.GAP) -> DataFrame:
    """``template, instance`` among skipgrams that share an n-gram instance.

    Which skipgrams fill which is an equi-join per gap shape; a pair stays if some n-gram
    is an instance of both.
    """
    skips = instance_edges.select(F.col("template").alias("pattern")).distinct()
    pairs = template_pairs(skips, gap).select("template", F.col("instance").alias("special"))
    both = pairs.join(instance_edges.select(F.col("template").alias("special"), "instance"), "special")
    shared = both.join(instance_edges.select("template", "instance"), ["template", "instance"], "left_semi")
    return shared.select("template", F.col("special").alias("instance")).distinct()


def exclusive_counts(postings: DataFrame, edges: DataFrame) -> DataFrame:
    """``pattern, cnt, xcount, xratio``: occurrences in no occurrence of a parent.

    ``edges`` is ``parent, child``. An occurrence lies in a parent's if it is within its
    span in the same sentence. Parent occurrences propose the places of their
    children, so the join is on (pattern, sentence, position).
    """
    inner = P.positions(F.col("n_parent") - F.col("n_child") + 1)
    spans = postings.select(F.col("pattern").alias("parent"), F.col("n").alias("n_parent"), "sid", F.col("pos").alias("from"))
    proposed = edges.withColumn("n_child", F.size("child")).join(spans, "parent")
    covered = proposed.select(F.col("child").alias("pattern"), "sid", F.explode(F.transform(inner, lambda i: F.col("from") + i)).alias("pos")).distinct()
    hit = postings.join(covered.withColumn("hit", F.lit(1)), ["pattern", "sid", "pos"], "left")
    counts = hit.groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"), (F.count(F.lit(1)) - F.count("hit")).alias("xcount"))
    return counts.withColumn("xratio", F.col("xcount") / F.col("cnt"))


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """``parent, child`` edges without those spanned by two others."""
    a = edges.select(F.col("parent"), F.col("child").alias("mid"))
    b = edges.select(F.col("parent").alias("mid"), "child")
    return edges.join(a.join(b, "mid").select("parent", "child"), ["parent", "child"], "left_anti")


def closure(edges: DataFrame, start: DataFrame, max_steps: int | None = None) -> DataFrame:
    """``start, node``: all nodes reachable from ``start.node`` over ``src, dst`` edges.

    A limit of steps that leaves nodes out raises an error.
    """
    reached = start.select(F.col("node").alias("start"), F.col("node")).distinct()
    front, out = reached, None
    for taken in itertools.count():
        step = front.join(edges.select(F.col("src").alias("node"), F.col("dst")), "node").select("start", F.col("dst").alias("node")).distinct()
        if out is not None:
            step = step.join(out, ["start", "node"], "left_anti")
        front = cut_lineage(step)
        if front.isEmpty():
            break
        if taken == max_steps:
            raise ValueError(f"nodes lie more than {max_steps} steps away")
        out = front if out is None else cut_lineage(out.unionByName(front))
    return out if out is not None else reached.limit(0)


def edge_table(**relations: DataFrame) -> DataFrame:
    """``rel, src, dst, w`` of the given relations, to be written partitioned by ``rel``."""
    out = None
    for rel, edges in relations.items():
        names = edges.columns
        w = F.col("w").cast("double") if "w" in names else F.lit(1.0)
        part = edges.select(F.lit(rel).alias("rel"), F.col(names[0]).alias("src"), F.col(names[1]).alias("dst"), w.alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


def build_graph(postings: DataFrame, skip_postings: DataFrame | None = None, least_sentences: int = 1, least_cooc: int = 1, relations: list[str] | None = None, gap=P.GAP) -> DataFrame:
    """All relations, or the named ones, in one edge table."""
    patterns = pattern_counts(postings, gap)
    wanted = set(relations or RELATIONS)
    made: dict[str, DataFrame] = {}
    if wanted & {"child", "parent"}:
        sub = subsumption(patterns, gap)
        made |= {"child": sub.select("parent", "child"), "parent": sub.select("child", "parent")}
    if "successor" in wanted:
        made["successor"] = successors(postings)
    if "predecessor" in wanted:
        made["predecessor"] = predecessors(postings)
    if "cooc" in wanted:
        made["cooc"] = cooccurrence(postings, least_sentences, least_cooc, gap=gap)
    if wanted & {"template", "instance"}:
        pairs = template_pairs(patterns, gap)
        made |= {"instance": pairs.select("template", "instance"), "template": pairs.select("instance", "template")}
    if skip_postings is not None and wanted & {"skipcontent", "skipusage"}:
        rel = skip_relations(skip_postings, patterns, gap)
        made |= {"skipcontent": rel, "skipusage": rel.select("dst", "src", "w")}
    return edge_table(**{k: v for k, v in made.items() if k in wanted})


def keep_known(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges both ends of which are among the patterns."""
    for end in ("src", "dst"):
        edges = edges.join(patterns.select(F.col("pattern").alias(end)), end, "left_semi")
    return edges.select("rel", "src", "dst", "w")


def relation_stats(edges: DataFrame) -> DataFrame:
    """``rel, n_nodes, n_edges``."""
    return edges.groupBy("rel").agg(F.count_distinct("src").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))


def related(edges: DataFrame, query: DataFrame, incoming: bool = False) -> DataFrame:
    """Edges out of (or into) the patterns of ``query.pattern``."""
    end = "dst" if incoming else "src"
    return edges.join(query.select(F.col("pattern").alias(end)), end, "left_semi")


def graph_listing(edges: DataFrame, xcounts: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Per pattern: counts, exclusive counts, and how many edges of each kind."""
    names = relations or RELATIONS
    per = edges.groupBy(F.col("src").alias("pattern")).agg(*(F.count(F.when(F.col("rel") == r, 1)).alias(f"n_{r}") for r in names))
    return xcounts.join(per, "pattern", "left").select("pattern", "cnt", "xcount", "xratio", *(F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in names))


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The n heaviest edges of each source, ties at the end kept."""
    rank = F.rank().over(Window.partitionBy("src").orderBy(F.desc("w")))
    return edges.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")

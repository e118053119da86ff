"""Queries on the given pattern model: relations, exclusive counts, ranked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.operators import graph
from weftgram.runtime import cut_lineage, table, with_scalars

#: Sentences an n-gram needs to take part in co-occurrence, and common positions of an edge.
LEAST_SENTENCES, LEAST_EDGE = 20, 5


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clean_postings(table(spark, sf, "postings"))


def text(c: str, out: str | None = None) -> F.Column:
    return F.array_join(c, " ").alias(out or c)


def model_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.pattern_counts(postings(spark, sf))
    return rows.select(text("pattern"), "n", "is_skip", "cnt")


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.sentence_counts(postings(spark, sf)).select(text("pattern"), "n_sentences")


def reverse_index_size(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reverse_index(postings(spark, sf)).groupBy("sid").agg(F.count(F.lit(1)).alias("n_patterns"))


def rel_children(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.subsumption(graph.pattern_counts(postings(spark, sf)))
    return edges.select(text("parent"), text("child"))


def rel_successors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.successors(postings(spark, sf)).select(text("src"), text("dst"), "w")


def rel_predecessors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.predecessors(postings(spark, sf)).select(text("src"), text("dst"), "w")


def rel_cooc(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.cooccurrence(postings(spark, sf), LEAST_SENTENCES, LEAST_EDGE)
    return edges.select(text("src"), text("dst"), "w")


def rel_cooc_directed(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.cooccurrence(postings(spark, sf), LEAST_SENTENCES, LEAST_EDGE, directed=True)
    return edges.select(text("src"), text("dst"), "w")


def _ranked(spark: SparkSession, sf: str, style: str) -> DataFrame:
    posts = postings(spark, sf)
    edges = graph.cooccurrence(posts, LEAST_SENTENCES, LEAST_EDGE)
    rows = graph.ranked_cooccurrence(edges, graph.pattern_counts(posts), style)
    return rows.select(text("src"), text("dst"), "w", F.round("score", 8).alias("score"))


def rel_pmi(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, "pmi")


def rel_npmi(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, "npmi")


def pair_pmi(spark: SparkSession, sf: str) -> DataFrame:
    """PMI by common sentences of the patterns that follow one another ten times or more."""
    raw = table(spark, sf, "postings")
    edges = cut_lineage(graph.followed(graph.by_sentence(raw)).filter("dst IS NULL OR w >= 10 AND src <> dst"))
    pairs = edges.filter("dst IS NOT NULL").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    counts = edges.filter("dst IS NULL").select(F.col("src").alias("pattern"), F.col("w").alias("cnt"))
    joint = graph.shared_sentences(raw.select("pattern", "sid", "pos").dropna(), pairs)
    ca, cb = (counts.select(F.col("pattern").alias(k), F.col("cnt").alias(f"c_{k}")) for k in ("a", "b"))
    rows = with_scalars(joint.join(ca, "a").join(cb, "b"), counts.agg(F.sum("cnt").alias("total")))
    pmi = graph.pmi(F.col("joint"), F.col("c_a"), F.col("c_b"))
    npmi = graph.npmi(F.col("joint"), F.col("c_a"), F.col("c_b"), F.col("total"))
    return rows.select(text("a"), text("b"), "joint", F.round(pmi, 8).alias("pmi"), F.round(npmi, 8).alias("npmi"))


def xcount(spark: SparkSession, sf: str) -> DataFrame:
    posts = postings(spark, sf)
    rows = graph.exclusive_counts(posts, graph.subsumption(graph.pattern_counts(posts)))
    return rows.select(text("pattern"), "cnt", "xcount", F.round("xratio", 8).alias("xratio"))


def transitive_reduction(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.subsumption(graph.pattern_counts(postings(spark, sf)))
    return graph.transitive_reduction(edges).select(text("parent"), text("child"))


def relation_stats(spark: SparkSession, sf: str) -> DataFrame:
    posts = cut_lineage(postings(spark, sf))
    edges = graph.build_graph(posts, None, LEAST_SENTENCES, LEAST_EDGE, ["child", "parent", "successor", "predecessor", "cooc"])
    return graph.relation_stats(edges)


def graph_listing(spark: SparkSession, sf: str) -> DataFrame:
    posts = cut_lineage(postings(spark, sf))
    patterns = graph.pattern_counts(posts)
    wanted = ["child", "parent", "successor"]
    edges = graph.build_graph(posts, None, relations=wanted)
    rows = graph.graph_listing(edges, graph.exclusive_counts(posts, graph.subsumption(patterns)), wanted)
    return rows.select(text("pattern"), "cnt", "xcount", *(f"n_{r}" for r in wanted))


def top_successors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_edges(graph.successors(postings(spark, sf)), 3).select(text("src"), text("dst"), "w")


QUERIES = {
    f.__name__: f
    for f in (
        model_counts, sentence_counts, reverse_index_size, rel_children, rel_successors, rel_predecessors, rel_cooc, rel_cooc_directed, rel_pmi, rel_npmi, pair_pmi, xcount,
        transitive_reduction, relation_stats, graph_listing, top_successors,
    )
}

_P = """o AS (SELECT DISTINCT pattern, sid, pos FROM postings WHERE pattern IS NOT NULL AND sid IS NOT NULL AND pos IS NOT NULL),
  occ AS (SELECT pattern, array_to_string(pattern, ' ') AS t, len(pattern) AS n, sid, pos FROM o),
  pat AS (SELECT pattern, t, n, list_contains(pattern, 0) AS is_skip, count(*) AS cnt FROM occ GROUP BY ALL)"""
_EDGES = f"""{_P}, sub AS (SELECT DISTINCT pattern, t AS parent, n, unnest(flatten(list_transform(range(1, n + 1), lambda b: list_transform(range(b, n + 1), lambda e: pattern[b:e])))) AS c FROM pat),
  e AS (SELECT DISTINCT parent, k.t AS child FROM sub JOIN pat k ON k.pattern = sub.c WHERE len(sub.c) < sub.n AND NOT k.is_skip)"""
_SUCC = f"""{_P}, succ AS (SELECT a.t AS src, b.t AS dst, count(*) AS w FROM occ a JOIN occ b ON a.sid = b.sid AND a.pos + a.n = b.pos GROUP BY a.t, b.t)"""
_COOC = f"""{_P}, freq AS (SELECT t FROM occ WHERE NOT list_contains(pattern, 0) GROUP BY t HAVING count(DISTINCT sid) > {LEAST_SENTENCES}),
  f AS (SELECT occ.t, sid, pos FROM occ JOIN freq ON occ.t = freq.t),
  cooc AS (SELECT a.t AS src, b.t AS dst, count(*) AS w FROM f a JOIN f b ON a.sid = b.sid AND a.t <> b.t GROUP BY a.t, b.t HAVING count(*) >= {LEAST_EDGE})"""
_X = """covered AS (SELECT DISTINCT c.t, c.sid, c.pos FROM occ c JOIN e ON e.child = c.t JOIN occ p ON p.t = e.parent AND p.sid = c.sid AND p.pos <= c.pos AND c.pos + c.n <= p.pos + p.n),
  x AS (SELECT pat.t AS pattern, cnt, cnt - coalesce(k, 0) AS xcount FROM pat LEFT JOIN (SELECT t, count(*) AS k FROM covered GROUP BY t) q ON q.t = pat.t)"""

ORACLE = {
    "model_counts": f"WITH {_P} SELECT t AS pattern, CAST(n AS INT) AS n, is_skip, cnt FROM pat",
    "sentence_counts": f"WITH {_P} SELECT t AS pattern, count(DISTINCT sid) AS n_sentences FROM occ GROUP BY t",
    "reverse_index_size": f"WITH {_P} SELECT sid, count(DISTINCT t) AS n_patterns FROM occ GROUP BY sid",
    "rel_children": f"WITH {_EDGES} SELECT parent, child FROM e",
    "rel_successors": f"WITH {_SUCC} SELECT src, dst, w FROM succ",
    "rel_predecessors": f"WITH {_SUCC} SELECT dst AS src, src AS dst, w FROM succ",
    "rel_cooc": f"WITH {_COOC} SELECT src, dst, w FROM cooc",
    "rel_cooc_directed": f"WITH {_COOC.replace('AND a.t <> b.t', 'AND a.t <> b.t AND b.pos >= a.pos')} SELECT src, dst, w FROM cooc",
    "rel_pmi": f"WITH {_COOC} SELECT src, dst, w, round(ln(w / (a.cnt * b.cnt)), 8) AS score FROM cooc JOIN pat a ON a.t = src JOIN pat b ON b.t = dst",
    "rel_npmi": f"WITH {_COOC} SELECT src, dst, w, round(ln(w / (a.cnt * b.cnt)) / -ln(w / (SELECT sum(cnt) FROM pat)), 8) AS score FROM cooc JOIN pat a ON a.t = src JOIN pat b ON b.t = dst",
    "pair_pmi": f"""WITH {_SUCC}, d AS (SELECT DISTINCT t, sid FROM occ), j AS (SELECT src AS a, dst AS b, count(*) AS joint FROM succ JOIN d x ON x.t = src JOIN d y ON y.t = dst AND y.sid = x.sid WHERE w >= 10 AND src <> dst GROUP BY src, dst)
      SELECT j.a, j.b, joint, round(ln(joint / (p.cnt * q.cnt)), 8) AS pmi, round(ln(joint / (p.cnt * q.cnt)) / -ln(joint / (SELECT sum(cnt) FROM pat)), 8) AS npmi
      FROM j JOIN pat p ON p.t = j.a JOIN pat q ON q.t = j.b""",
    "xcount": f"WITH {_EDGES}, {_X} SELECT pattern, cnt, xcount, round(xcount / cnt, 8) AS xratio FROM x",
    "transitive_reduction": f"WITH {_EDGES} SELECT parent, child FROM e EXCEPT SELECT a.parent, b.child FROM e a JOIN e b ON a.child = b.parent",
    "relation_stats": f"""WITH {_EDGES}, {_SUCC[len(_P) + 2:]}, {_COOC[len(_P) + 2:]}, u AS (SELECT 'child' AS rel, parent AS src FROM e UNION ALL SELECT 'parent', child FROM e
      UNION ALL SELECT 'successor', src FROM succ UNION ALL SELECT 'predecessor', dst FROM succ UNION ALL SELECT 'cooc', src FROM cooc)
      SELECT rel, count(DISTINCT src) AS n_nodes, count(*) AS n_edges FROM u GROUP BY rel""",
    "graph_listing": f"""WITH {_EDGES}, {_SUCC[len(_P) + 2:]}, {_X} SELECT pattern, cnt, xcount, (SELECT count(*) FROM e WHERE parent = pattern) AS n_child, (SELECT count(*) FROM e WHERE child = pattern) AS n_parent,
      (SELECT count(*) FROM succ WHERE src = pattern) AS n_successor FROM x""",
    "top_successors": f"WITH {_SUCC}, r AS (SELECT *, rank() OVER (PARTITION BY src ORDER BY w DESC) AS r FROM succ) SELECT src, dst, w FROM r WHERE r <= 3",
}

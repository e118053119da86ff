"""Queries on a skipgram model of the documents: postings, lookup, relations, coverage, lists.

Skipgrams of up to five tokens, so that shapes of several gaps are among them.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.functions.gaps import gap_masks
from weftgram.operators import graph, mining, reports
from weftgram.operators.numbered import Finder
from weftgram.plans.corpus_queries import SENT, _counted, _grams, sentences, text
from weftgram.runtime import cut_lineage

GAP = P.WORD_GAP
MAX_N, LEAST, SKIP_LEAST, TYPES = 5, 20, 2, 2


@lru_cache(8)
def _model(app: str, spark: SparkSession, sf: str, where: str = "true") -> mining.Mined:
    """The mined model, its tables written once for all queries of an application."""
    found = mining.mine(sentences(spark, sf, where), MAX_N, mining.Thresholds(LEAST, SKIP_LEAST, TYPES), skipgrams=True, gap=GAP)
    return replace(found, patterns=cut_lineage(found.patterns))


def model(spark: SparkSession, sf: str, where: str = "true") -> mining.Mined:
    return _model(spark.sparkContext.applicationId, spark, sf, where)


def gap_configurations(spark: SparkSession, sf: str) -> DataFrame:
    """Every gap configuration of up to nine tokens."""
    rows = [(n, "".join(map(str, m))) for n in range(1, 10) for m in gap_masks(n, whole=True)]
    return spark.createDataFrame(rows, "n int, mask string")


def skipgram_counts_n5(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf).patterns.filter("is_skip").select(text().alias("text"), "n", P.gap_count("pattern", GAP).alias("gaps"), "cnt")


def skipgram_fillers(spark: SparkSession, sf: str) -> DataFrame:
    """Skipgrams of three tokens whose contents need more occurrences than a pattern does."""
    found = mining.mine(sentences(spark, sf), 3, mining.Thresholds(10, 15, 2), skipgrams=True, indexed=False, gap=GAP)
    return found.patterns.filter("is_skip").select(text().alias("text"), "cnt")


def skip_postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf).skip_postings
    return rows.select(text().alias("text"), text("content").alias("content"), text("inst").alias("inst"), "sid", "pos")


def skip_instantiate(spark: SparkSession, sf: str) -> DataFrame:
    """Skipgrams filled again with each of their contents."""
    rows = model(spark, sf).contents.select("pattern", P.skip_content("inst", "pattern", GAP).alias("content"), "c")
    return rows.select(text().alias("text"), F.array_join(P.instantiate("pattern", "content", GAP), " ").alias("inst"), "c")


def skip_listing(spark: SparkSession, sf: str) -> DataFrame:
    found = model(spark, sf)
    rows = reports.listing(found.patterns, reports.corpus_tokens(sentences(spark, sf)), mining.skip_entropy(found.contents))
    return rows.select("n", "is_skip", text().alias("text"), "cnt", *(F.round(c, 10).alias(c) for c in ("coverage", "freq_all", "freq_group", "freq_n")), F.coalesce("skip_types", F.lit(0)).alias("skip_types"), F.round(F.coalesce("entropy", F.lit(0.0)), 6).alias("entropy"))


def skip_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.report(model(spark, sf).patterns)
    return rows.select(F.coalesce(F.col("is_skip").cast("int"), F.lit(-1)).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), "types", "occurrences")


def rel_instances(spark: SparkSession, sf: str) -> DataFrame:
    found = model(spark, sf)
    return graph.instances(found.contents, found.patterns.filter("NOT is_skip")).select(text("template").alias("template"), text("instance").alias("instance"))


def rel_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Skipgrams that fill other skipgrams and share an n-gram with them."""
    found = model(spark, sf)
    rows = graph.sibling_templates(graph.instances(found.contents, found.patterns.filter("NOT is_skip")), GAP)
    return rows.select(text("template").alias("template"), text("instance").alias("instance"))


def rel_skipcontent(spark: SparkSession, sf: str) -> DataFrame:
    found = model(spark, sf)
    contents = found.contents.select("pattern", P.skip_content("inst", "pattern", GAP).alias("content"))
    return graph.skip_relations(contents, found.patterns, GAP).select(text("src").alias("src"), text("dst").alias("dst"), "w")


def rel_templates(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.template_pairs(model(spark, sf).patterns, GAP)
    return rows.select(text("template").alias("template"), text("instance").alias("instance"))


def template_relation(spark: SparkSession, sf: str) -> DataFrame:
    """The relation of every skipgram to those that its instances name, and back."""
    rows = graph.template_pairs(model(spark, sf).patterns, GAP)
    way = lambda a, b: P.template_relation(a, b, GAP)
    return rows.select(text("template").alias("template"), text("instance").alias("instance"), way("instance", "template").alias("down"), way("template", "instance").alias("up"), way("template", "template").alias("same"))


def template_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All skipgrams and n-grams below the skipgrams of one token."""
    edges = cut_lineage(graph.template_pairs(model(spark, sf).patterns, GAP).select(F.col("template").alias("src"), F.col("instance").alias("dst")))
    start = edges.filter(F.size(F.filter("src", lambda x: x != GAP)) == 1).select(F.col("src").alias("node"))
    return graph.closure(edges, start).select(text("start").alias("start"), text("node").alias("node"))


def skip_subsumption(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.subsumption(model(spark, sf).patterns, GAP).filter(P.is_skipgram("parent", GAP))
    return rows.select(text("parent").alias("parent"), text("child").alias("child"))


REST = "kind IS DISTINCT FROM 'prose'"


def skip_query_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of the prose as they are found in all other documents, skipgrams where a known n-gram fills them."""
    train = model(spark, sf, "kind = 'prose'")
    found = mining.find_patterns(sentences(spark, sf, REST), train.patterns, 1, MAX_N, GAP, True).select("sid", "pos", "pattern")
    rows = reports.query_mode(found, train.patterns, reports.corpus_tokens(sentences(spark, sf, "kind = 'prose'")))
    return rows.select("sid", "pos", text().alias("text"), "cnt", F.round("coverage", 10).alias("coverage"))


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    test, train = sentences(spark, sf, REST), model(spark, sf, "kind = 'prose'").patterns
    return test, mining.postings(test, train.filter("NOT is_skip"), MAX_N), mining.find_skipgrams(test, train, MAX_N, GAP)


def _finder(spark: SparkSession, sf: str) -> Finder | None:
    made = model(spark, sf, "kind = 'prose'").numbered
    return made and Finder.of(made, GAP)


def constrained_skipgrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = mining.mine_constrained(sentences(spark, sf, REST), model(spark, sf, "kind = 'prose'").patterns, MAX_N, gap=GAP)
    return rows.select(text().alias("text"), "n", "cnt")


def skip_coverage(spark: SparkSession, sf: str) -> DataFrame:
    finder = _finder(spark, sf)
    return reports.coverage_found(sentences(spark, sf, REST), finder) if finder else reports.coverage(*_found(spark, sf), gap=GAP)


def skip_coverage_by_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.coverage_by_length(*_found(spark, sf), gap=GAP)
    return rows.select("is_skip", "n", "types", "occurrences", "covered", "encapsulated", F.round("coverage", 10).alias("coverage"))


def coverage_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as marked text: each token with the number of patterns over it."""
    finder = _finder(spark, sf)
    return reports.coverage_html_found(sentences(spark, sf, REST), finder) if finder else reports.coverage_html(*_found(spark, sf), gap=GAP)


def pattern_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Shown patterns read again as queries, save those with a word that looks like a shown gap."""
    plain = ~F.exists("pattern", lambda x: x.rlike(r"^\{\*[0-9]+\*\}$"))
    shown = model(spark, sf).patterns.filter(plain).select("pattern", P.render_words("pattern").alias("shown"))
    return shown.select("shown", F.array_join(P.parse_words("shown"), " ").alias("text"))


def pattern_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf).patterns.filter("is_skip")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["begin"].cast("string"), s["length"].cast("string"))), " ")
    made = P.skipgram_of(P.parts("pattern", GAP), F.transform(P.gap_spans("pattern", GAP), lambda s: s["length"]), F.get("pattern", F.lit(0)) == GAP, GAP)
    return rows.select(
        text().alias("text"), F.array_join(F.transform(P.parts("pattern", GAP), lambda p: F.array_join(p, " ")), "|").alias("parts"), spans(P.part_spans("pattern", GAP)).alias("part_spans"),
        spans(P.gap_spans("pattern", GAP)).alias("gap_spans"), F.array_join(F.transform(P.mask("pattern", GAP), lambda b: b.cast("int").cast("string")), "").alias("mask"), F.round(P.gap_ratio("pattern", GAP), 9).alias("ratio"),
        P.token("pattern", 1, GAP, "{UNKNOWN}").alias("second"), P.is_skipgram("pattern", GAP).alias("is_skip"), F.array_join(made, " ").alias("made"),
    )


def pattern_match(spark: SparkSession, sf: str) -> DataFrame:
    """Where the skipgrams found in a sentence stand, tested on the sentence itself, and one word further on."""
    test, _, skips = _found(spark, sf)
    rows = skips.join(test, "sid")
    hit = lambda at: P.matches_at("tokens", "pattern", at, GAP)
    return rows.select("sid", "pos", text().alias("text"), hit(F.col("pos")).alias("here"), hit(F.col("pos") + 1).alias("next"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_configurations, skipgram_counts_n5, skipgram_fillers, skip_postings, skip_instantiate, skip_listing, skip_report, rel_instances, rel_siblings, rel_skipcontent, rel_templates, template_relation,
        template_closure, skip_subsumption, skip_query_mode, constrained_skipgrams, skip_coverage, skip_coverage_by_length, coverage_marks, pattern_parse, pattern_parts, pattern_match,
    )
}

#: The rule of the gap configurations: a gap with room for more than two tokens calls for a further one, up to three.
_MASKS = """bits AS (SELECT n, m, list_transform(range(0, n), lambda i: CAST((m >> (n - 1 - i)) & 1 AS INT)) AS b FROM (SELECT n, unnest(range(1, 1 << n)) AS m FROM (SELECT CAST(unnest(range(1, 10)) AS INT) AS n))),
  ends AS (SELECT n, m, b, list_filter(range(1, n + 1), lambda i: b[i] = 1 AND (i = n OR b[i + 1] = 0)) AS e FROM bits),
  shapes AS (SELECT n, m, b FROM ends WHERE len(e) <= 3 AND (len(e) = 3 OR n - e[len(e)] - 1 <= 2) AND len(list_filter(e[1:len(e) - 1], lambda x: n - x - 1 <= 2)) = 0)"""


def _mined(tag: str = "", where: str = "true", max_n: int = MAX_N, least: int = LEAST, skip_least: int = SKIP_LEAST, fillers: bool = False) -> str:
    """SQL tables of a model: ``g`` occurrences, ``k`` n-grams, ``kept`` skipgrams with their instances, ``pat`` both."""
    t = tag
    more = f"AND NOT EXISTS (SELECT 1 FROM fill{t} f LEFT JOIN known{t} q ON q.text = f.piece AND q.cnt >= {skip_least} WHERE f.text = k0{t}.text AND f.inst = k0{t}.inst AND q.text IS NULL)" if fillers else ""
    fill = f"""fill{t} AS (SELECT text, inst, unnest(list_filter(string_split(array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] = 1 THEN w[i] ELSE chr(1) END), ' '), chr(1)), lambda x: trim(x) <> '')) AS p0 FROM k0{t}),
      fill2{t} AS (SELECT text, inst, trim(p0) AS piece FROM fill{t}),""".replace(f"fill{t} AS (SELECT text, inst, unnest", f"fill1{t} AS (SELECT text, inst, unnest").replace(f"FROM fill{t}),", f"FROM fill1{t}),").replace(f"fill2{t}", f"fill{t}") if fillers else ""
    return f"""{_grams(f'g{t}', max_n, where)}, {_counted(f'known{t}', f'g{t}', least)},
  inst{t} AS (SELECT text AS inst, n, string_split(text, ' ') AS w, count(*) AS c FROM g{t} WHERE n >= 2 GROUP BY text, n),
  fit{t} AS (SELECT * FROM inst{t} WHERE array_to_string(w[1:n - 1], ' ') IN (SELECT text FROM known{t}) AND array_to_string(w[2:n], ' ') IN (SELECT text FROM known{t})),
  k0{t} AS MATERIALIZED (SELECT array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] = 1 THEN '{{*}}' ELSE w[i] END), ' ') AS text, inst, n, w, b, c FROM fit{t} JOIN shapes USING (n) WHERE list_sum(b) < n),
  {fill} k1{t} AS MATERIALIZED (SELECT * FROM k0{t} WHERE true {more}),
  k2{t} AS (SELECT * FROM k1{t} WHERE c >= {skip_least} AND text IN (SELECT text FROM k1{t} GROUP BY text HAVING sum(c) >= {least} AND count(*) >= {TYPES} AND sum(c) FILTER (c >= {skip_least}) >= {least} AND count(*) FILTER (c >= {skip_least}) >= {TYPES})),
  v{t} AS (SELECT text, i, count(DISTINCT x) AS d FROM (SELECT text, unnest(w) AS x, unnest(b) AS y, generate_subscripts(w, 1) AS i FROM k2{t}) WHERE y = 1 GROUP BY text, i),
  kept{t} AS MATERIALIZED (SELECT * FROM k2{t} WHERE text IN (SELECT text FROM v{t} GROUP BY text HAVING min(d) >= {TYPES})),
  pat{t} AS (SELECT text, n, false AS is_skip, cnt FROM known{t} UNION ALL SELECT text, n, true, CAST(sum(c) AS BIGINT) FROM kept{t} GROUP BY text, n)"""


_M = f"{SENT}, {_MASKS}, {_mined()}"
_PAIRS = """low AS (SELECT text, n, string_split(text, ' ') AS w FROM pat), tp AS (SELECT a.text AS template, b.text AS instance FROM low a JOIN low b ON a.n = b.n AND a.text <> b.text
  WHERE list_contains(a.w, '{*}') AND len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> '{*}' AND a.w[i] <> b.w[i])) = 0)"""
_CONTENT = """ct AS (SELECT text, inst, c, n, w, b, list_position(b, 1) AS lo, n + 1 - list_position(list_reverse(b), 1) AS hi FROM kept),
  content AS (SELECT text, inst, c, array_to_string(list_transform(range(lo, hi + 1), lambda i: CASE WHEN b[i] = 1 THEN w[i] ELSE '{*}' END), ' ') AS content FROM ct)"""
_TRAIN = "kind = 'prose'"
_T = f"""{SENT}, {_MASKS}, {_mined('', _TRAIN)}, {_grams('t', MAX_N, REST)},
  fg AS MATERIALIZED (SELECT t.sid, t.pos, t.n, t.text FROM t JOIN known ON known.text = t.text),
  sw AS (SELECT DISTINCT text, n, string_split(text, ' ') AS w FROM pat WHERE is_skip), sh AS (SELECT DISTINCT n, list_transform(w, lambda x: CAST(x = '{{*}}' AS INT)) AS b FROM sw),
  tw AS (SELECT sid, pos, n, string_split(text, ' ') AS w FROM t), fs AS MATERIALIZED (SELECT * FROM (SELECT sid, pos, n, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] = 1 THEN '{{*}}' ELSE w[i] END), ' ') AS text
    FROM tw JOIN sh USING (n)) WHERE text IN (SELECT text FROM sw)),
  allf AS (SELECT sid, pos, n, text, false AS is_skip FROM fg UNION ALL SELECT sid, pos, n, text, true FROM fs),
  span AS (SELECT sid, n, text, is_skip, pos + unnest(range(0, n)) AS tk, unnest(string_split(text, ' ')) = '{{*}}' AS gap FROM allf), tt AS (SELECT sum(len(toks)) AS tokens FROM s WHERE {REST}),
  mark AS (SELECT sid, tk, bool_or(NOT gap) AS c, bool_or(gap) AS e, count(*) FILTER (NOT gap) AS v, bool_or(is_skip) AS k FROM span GROUP BY sid, tk)"""

ORACLE = {
    "gap_configurations": f"WITH {_MASKS} SELECT n, array_to_string(b, '') AS mask FROM shapes",
    "skipgram_counts_n5": f"WITH {_M} SELECT text, n, CAST(len(regexp_extract_all(regexp_replace(text, '(\\{{\\*\\}} ?)+', chr(1), 'g'), chr(1))) AS INT) AS gaps, cnt FROM pat WHERE is_skip",
    "skipgram_fillers": f"WITH {SENT}, {_MASKS}, {_mined('', 'true', 3, 10, 15, True)} SELECT text, cnt FROM pat WHERE is_skip",
    "skip_postings": f"WITH {_M}, {_CONTENT} SELECT content.text, content, content.inst, sid, pos FROM content JOIN g ON g.text = content.inst",
    "skip_instantiate": f"WITH {_M} SELECT text, inst, c FROM kept",
    "skip_listing": f"""WITH {_M}, en AS (SELECT text, count(*) AS skip_types, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT text, c / sum(c) OVER (PARTITION BY text) AS p FROM kept) GROUP BY text), tot AS (SELECT sum(len(toks)) AS tokens FROM s)
      SELECT n, is_skip, text, cnt, round(cnt * n / tokens, 10) AS coverage, round(cnt / sum(cnt) OVER (), 10) AS freq_all, round(cnt / sum(cnt) OVER (PARTITION BY is_skip), 10) AS freq_group,
        round(cnt / sum(cnt) OVER (PARTITION BY is_skip, n), 10) AS freq_n, coalesce(skip_types, 0) AS skip_types, coalesce(entropy, 0) AS entropy FROM pat LEFT JOIN en USING (text), tot""",
    "skip_report": f"WITH {_M} SELECT coalesce(CAST(is_skip AS INT), -1) AS kind, coalesce(n, 0) AS n, count(*) AS types, CAST(sum(cnt) AS BIGINT) AS occurrences FROM pat GROUP BY ROLLUP (is_skip, n)",
    "rel_instances": f"WITH {_M} SELECT DISTINCT text AS template, inst AS instance FROM kept WHERE inst IN (SELECT text FROM known)",
    "rel_siblings": f"""WITH {_M}, {_PAIRS}, ed AS (SELECT DISTINCT text, inst FROM kept WHERE inst IN (SELECT text FROM known))
      SELECT DISTINCT template, instance FROM tp JOIN ed a ON a.text = template JOIN ed b ON b.text = instance AND b.inst = a.inst""",
    "rel_skipcontent": f"""WITH {_M}, {_CONTENT}, pc AS (SELECT DISTINCT text, content FROM content), pieces AS (SELECT text AS src, content, content AS dst FROM pc
        UNION SELECT text, content, trim(unnest(string_split(regexp_replace(content, '(\\{{\\*\\}} ?)+', chr(1), 'g'), chr(1)))) FROM pc)
      SELECT src, dst, count(*) AS w FROM pieces WHERE dst IN (SELECT text FROM pat) GROUP BY src, dst""",
    "rel_templates": f"WITH {_M}, {_PAIRS} SELECT template, instance FROM tp",
    "template_relation": f"WITH {_M}, {_PAIRS} SELECT template, instance, 1 AS down, -1 AS up, 0 AS same FROM tp",
    "template_closure": f"""WITH RECURSIVE {_M}, {_PAIRS}, r AS (SELECT template AS start, instance AS node FROM tp WHERE len(list_filter(string_split(template, ' '), lambda x: x <> '{{*}}')) = 1
        UNION SELECT r.start, tp.instance FROM r JOIN tp ON tp.template = r.node) SELECT start, node FROM r""",
    "skip_subsumption": f"""WITH {_M}, part AS (SELECT text, trim(unnest(string_split(regexp_replace(text, '(\\{{\\*\\}} ?)+', chr(1), 'g'), chr(1)))) AS p FROM pat WHERE is_skip),
      pw AS (SELECT DISTINCT text, string_split(p, ' ') AS w FROM part WHERE p <> ''), sub AS (SELECT text, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, len(w) + 1), lambda j: array_to_string(w[i:j], ' '))))) AS child FROM pw)
      SELECT DISTINCT text AS parent, child FROM sub WHERE child IN (SELECT text FROM known)""",
    "skip_query_mode": f"""WITH {_T}, tot AS (SELECT sum(len(toks)) AS tokens FROM s WHERE {_TRAIN}), lw AS (SELECT text, n, string_split(text, ' ') AS w, is_skip FROM pat),
      up AS (SELECT DISTINCT a.text AS template, b.text AS instance FROM lw a JOIN lw b ON a.n = b.n AND a.is_skip AND NOT b.is_skip WHERE len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> '{{*}}' AND a.w[i] <> b.w[i])) = 0),
      q AS (SELECT sid, pos, text FROM fg UNION ALL SELECT sid, pos, template FROM fg JOIN up ON up.instance = fg.text)
      SELECT sid, pos, q.text, cnt, round(cnt * n / tokens, 10) AS coverage FROM q JOIN pat ON pat.text = q.text, tot""",
    "constrained_skipgrams": f"WITH {_T} SELECT text, n, count(*) AS cnt FROM allf GROUP BY text, n",
    "skip_coverage": f"""WITH {_T} SELECT CAST(tokens AS BIGINT) AS tokens, count(*) FILTER (c) AS covered, count(*) FILTER (e) AS encapsulated, CAST(tokens - count(*) FILTER (c) AS BIGINT) AS uncovered, CAST(tokens - count(*) AS BIGINT) AS outside
      FROM mark, tt GROUP BY tokens""",
    "skip_coverage_by_length": f"""WITH {_T}, f AS (SELECT is_skip, n, count(DISTINCT text) AS types, count(*) AS occurrences FROM allf GROUP BY is_skip, n),
      p AS (SELECT is_skip, n, sid, tk, bool_or(NOT gap) AS c, bool_or(gap) AS e FROM span GROUP BY ALL), c AS (SELECT is_skip, n, count(*) FILTER (c) AS covered, count(*) FILTER (e) AS encapsulated FROM p GROUP BY is_skip, n)
      SELECT is_skip, n, types, occurrences, covered, encapsulated, round(covered / tokens, 10) AS coverage FROM f JOIN c USING (is_skip, n), tt""",
    "coverage_marks": f"""WITH {_T}, cell AS (SELECT tok.sid, tok.pos, '<span class="' || CASE WHEN coalesce(v, 0) > 0 THEN 'covered' ELSE 'uncovered' END || CASE WHEN e THEN ' enclosed' ELSE '' END || CASE WHEN k THEN ' skipgram' ELSE '' END
        || '" title="' || coalesce(v, 0) || '">' || replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>' AS h FROM tok LEFT JOIN mark ON mark.sid = tok.sid AND mark.tk = tok.pos WHERE {REST})
      SELECT sid, '<p>' || string_agg(h, ' ' ORDER BY pos) || '</p>' AS html FROM cell GROUP BY sid""",
    "pattern_parse": f"""WITH {_M}, r5 AS (SELECT text, replace(replace(replace(replace(text, '{{*}} {{*}} {{*}} {{*}}', '{{*4*}}'), '{{*}} {{*}} {{*}}', '{{*3*}}'), '{{*}} {{*}}', '{{*2*}}'), '{{*}}', '{{*1*}}') AS shown FROM pat WHERE NOT regexp_matches(text, '\\{{\\*[0-9]+\\*\\}}')) SELECT shown, text FROM r5""",
    "pattern_parts": f"""WITH {_M}, d AS (SELECT DISTINCT text, n, b, string_split(text, ' ') AS w FROM kept),
      e AS (SELECT *, list_filter(range(1, n + 1), lambda i: b[i] = 1 AND (i = 1 OR b[i - 1] = 0)) AS gs, list_filter(range(1, n + 1), lambda i: b[i] = 1 AND (i = n OR b[i + 1] = 0)) AS ge,
        list_filter(range(1, n + 1), lambda i: b[i] = 0 AND (i = 1 OR b[i - 1] = 1)) AS ps, list_filter(range(1, n + 1), lambda i: b[i] = 0 AND (i = n OR b[i + 1] = 1)) AS pe FROM d)
      SELECT text, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(w[ps[i]:pe[i]], ' ')), '|') AS parts, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: (ps[i] - 1) || ':' || (pe[i] - ps[i] + 1)), ' ') AS part_spans,
        array_to_string(list_transform(range(1, len(gs) + 1), lambda i: (gs[i] - 1) || ':' || (ge[i] - gs[i] + 1)), ' ') AS gap_spans, array_to_string(list_transform(b, lambda x: 1 - x), '') AS mask, round(list_sum(b) / n, 9) AS ratio,
        CASE WHEN b[2] = 1 THEN '{{UNKNOWN}}' ELSE w[2] END AS second, true AS is_skip, text AS made FROM e""",
    "pattern_match": f"""WITH {_T} SELECT fs.sid, fs.pos, fs.text, true AS here, coalesce(fs.pos + 1 + fs.n <= len(s.toks) AND len(list_filter(range(1, fs.n + 1), lambda i: string_split(fs.text, ' ')[i] <> '{{*}}' AND string_split(fs.text, ' ')[i] <> s.toks[fs.pos + 1 + i])) = 0, false) AS next
      FROM fs JOIN s ON s.sid = fs.sid""",
}

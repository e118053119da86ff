"""Queries on the text corpus: dictionary, mining, reports. A sentence is a line of a document."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.operators import mining, reports
from weftgram.runtime import spread, table
from weftgram.sources import corpus as C

GAP = P.WORD_GAP


def sentences(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return C.sentences_of_documents(spread(table(spark, sf, "documents").filter(where).select("doc_id", "text")))


def text(p: str = "pattern") -> F.Column:
    return F.array_join(p, " ")


def vocab_freq(spark: SparkSession, sf: str) -> DataFrame:
    return C.build_vocab(C.word_frequencies(sentences(spark, sf)))


def vocab_extend(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "vocab").select("cls", "word", "freq")
    return C.extend_vocab(old, C.word_frequencies(sentences(spark, sf))).select("cls", "word")


def encode_sentences(spark: SparkSession, sf: str) -> DataFrame:
    words = sentences(spark, sf)
    return C.encode(words, C.build_vocab(C.word_frequencies(words))).select("sid", text("tokens").alias("classes"))


def decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    words = sentences(spark, sf)
    vocab = C.build_vocab(C.word_frequencies(words))
    return C.decode(C.encode(words, vocab), vocab, ["sid"], "tokens").select("sid", text("words").alias("text"))


def encode_known(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences encoded by the given vocabulary, unknown words as class 2."""
    return C.encode(sentences(spark, sf), table(spark, sf, "vocab")).select("sid", text("tokens").alias("classes"))


def class_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vocab").select("cls", F.lower(F.hex(P.class_bytes("cls"))).alias("bytes"), P.valid_class("cls").alias("valid"))


def ngram_counts(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return mining.mine_ngrams(sentences(spark, sf), n, 2, n).select(text().alias("text"), "cnt")


def ngram_onepass(spark: SparkSession, sf: str) -> DataFrame:
    return mining.count_ngrams(sentences(spark, sf), 4, 2).select(text().alias("text"), "n", "cnt")


def _model(spark: SparkSession, sf: str, max_n: int = 3, least: int = 2, where: str = "true") -> DataFrame:
    return mining.count_ngrams(sentences(spark, sf, where), max_n, least).withColumn("is_skip", F.lit(False))


def pattern_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.listing(_model(spark, sf), reports.corpus_tokens(sentences(spark, sf)))
    return rows.select("n", text().alias("text"), "cnt", "tokens", *(F.round(c, 10).alias(c) for c in ("coverage", "freq_all", "freq_n")))


def pattern_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.report(_model(spark, sf).select("pattern", "n", "cnt", "is_skip")).filter("is_skip IS NOT NULL")
    return rows.select(F.coalesce("n", F.lit(0)).alias("n"), "types", "occurrences")


def pattern_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.histogram(_model(spark, sf))


def ngram_postings(spark: SparkSession, sf: str) -> DataFrame:
    words = sentences(spark, sf)
    return mining.postings(words, mining.count_ngrams(words, 3, 10), 3).select(text().alias("text"), "n", "sid", "pos")


def query_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of prose as they are found in all other documents."""
    prose, rest = sentences(spark, sf, "kind = 'prose'"), sentences(spark, sf, "kind IS DISTINCT FROM 'prose'")
    model = mining.count_ngrams(prose, 3, 2)
    found = mining.postings(rest, model, 3).select("sid", "pos", "pattern")
    rows = reports.query_mode(found, model, reports.corpus_tokens(prose))
    return rows.select("sid", "pos", text().alias("text"), "cnt", F.round("coverage", 10).alias("coverage"))


def constrained_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in all other documents of the patterns that the prose model has."""
    model = mining.count_ngrams(sentences(spark, sf, "kind = 'prose'"), 3, 2)
    return mining.mine_constrained(sentences(spark, sf, "kind IS DISTINCT FROM 'prose'"), model, 3, gap=GAP).select(text().alias("text"), "n", "cnt")


def joint_listing(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _model(spark, sf, 2, 2, "kind = 'prose'"), _model(spark, sf, 2, 1, "kind IS DISTINCT FROM 'prose'")
    return reports.joint_listing(train, test).select(text().alias("text"), "n", "cnt_train", "cnt_test")


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    rest = sentences(spark, sf, "kind IS DISTINCT FROM 'prose'")
    model = mining.count_ngrams(sentences(spark, sf, "kind = 'prose'"), 3, 2)
    return reports.coverage(rest, mining.postings(rest, model, 3), gap=GAP)


def coverage_by_length(spark: SparkSession, sf: str) -> DataFrame:
    rest = sentences(spark, sf, "kind IS DISTINCT FROM 'prose'")
    model = mining.count_ngrams(sentences(spark, sf, "kind = 'prose'"), 3, 2)
    rows = reports.coverage_by_length(rest, mining.postings(rest, model, 3), gap=GAP)
    return rows.select("n", "types", "occurrences", "covered", F.round("coverage", 10).alias("coverage"), F.round("ttr", 10).alias("ttr"))


def _mined(spark: SparkSession, sf: str) -> mining.Mined:
    return mining.mine(sentences(spark, sf), 3, mining.Thresholds(10, 2, 2), skipgrams=True, indexed=False, gap=GAP)


def skipgram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf).patterns.filter("is_skip").select(text().alias("text"), P.render_words("pattern").alias("shown"), "n", "cnt")


def skipgram_entropy(spark: SparkSession, sf: str) -> DataFrame:
    rows = mining.skip_entropy(_mined(spark, sf).contents)
    return rows.select(text().alias("text"), "cnt", "skip_types", F.round("entropy", 6).alias("entropy"))


def skipgram_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mined(spark, sf).contents.withColumn("content", P.skip_content("inst", "pattern", GAP))
    return rows.select(text().alias("text"), text("content").alias("content"), F.col("c").alias("cnt"))


def context_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every word with its neighbours, padded by begin and end marks."""
    rows = sentences(spark, sf).select("sid", "tokens", F.posexplode("tokens").alias("pos", "word"))
    context = P.with_context("tokens", F.col("pos"), F.lit(1), 2, 2, "{BEGIN}", "{END}")
    return rows.select("sid", "pos", F.array_join(context, " ").alias("context"))


def subngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-n-grams and splits of every frequent trigram."""
    rows = mining.mine_ngrams(sentences(spark, sf), 3, 5, 3)
    return rows.select(text().alias("text"), F.size(P.subngrams("pattern")).alias("n_sub"), F.array_join(F.transform(P.splits("pattern"), lambda s: F.concat(text_of(s["left"]), F.lit(" | "), text_of(s["right"]))), " ; ").alias("splits"))


def text_of(c: F.Column) -> F.Column:
    return F.array_join(c, " ")


QUERIES = {
    f.__name__: f
    for f in (
        vocab_freq, vocab_extend, encode_sentences, decode_roundtrip, encode_known, class_bytes, ngram_onepass, pattern_listing, pattern_report, pattern_histogram, ngram_postings, query_mode,
        constrained_counts, joint_listing, coverage_report, coverage_by_length, skipgram_counts, skipgram_entropy, skipgram_content, context_features, subngram_counts,
    )
} | {f"ngram_counts_n{n}": partial(ngram_counts, n=n) for n in (1, 2, 3, 4)}

SENT = r"""docs AS (SELECT doc_id, kind, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
  lines AS (SELECT doc_id, kind, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM docs),
  words AS (SELECT doc_id * 2147483648 + i - 1 AS sid, kind, list_filter(list_transform(string_split(l, ' '), lambda w: trim(w, E'\t\r')), lambda w: w <> '') AS toks FROM lines),
  s AS (SELECT * FROM words WHERE len(toks) >= 1),
  tok AS (SELECT sid, kind, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM s),
  vf AS (SELECT word, count(*) AS freq FROM tok GROUP BY word),
  voc AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) + 5 AS INT) AS cls, word, freq FROM vf)"""


def _grams(name: str, max_n: int, where: str = "true", min_n: int = 1) -> str:
    per = " UNION ALL ".join(
        f"SELECT sid, {n} AS n, pos, array_to_string(toks[pos + 1:pos + {n}], ' ') AS text FROM (SELECT sid, toks, unnest(range(0, len(toks) - {n - 1})) AS pos FROM s WHERE {where})"
        for n in range(min_n, max_n + 1)
    )
    return f"{name} AS ({per})"


def _counted(name: str, grams: str, least: int) -> str:
    return f"{name} AS (SELECT text, n, count(*) AS cnt FROM {grams} GROUP BY text, n HAVING count(*) >= {least})"


_MODEL = f"{SENT}, {_grams('g', 3)}, {_counted('m', 'g', 2)}, total AS (SELECT sum(len(toks)) AS tokens FROM s)"
_PROSE = f"""{SENT}, {_grams('g', 3, "kind = 'prose'")}, {_counted('m', 'g', 2)}, {_grams('t', 3, "kind IS DISTINCT FROM 'prose'")},
  found AS (SELECT t.sid, t.pos, t.n, t.text, m.cnt FROM t JOIN m ON t.text = m.text AND t.n = m.n),
  span AS (SELECT sid, n, text, unnest(range(pos, pos + n)) AS tk FROM found), tt AS (SELECT sum(len(toks)) AS tokens FROM s WHERE kind IS DISTINCT FROM 'prose')"""

_SKIP = f"""{SENT}, {_grams('g', 2)}, {_counted('known', 'g', 10)},
  w2 AS (SELECT sid, pos, toks[pos + 1:pos + 2] AS inst, 2 AS n FROM (SELECT sid, toks, unnest(range(0, len(toks) - 1)) AS pos FROM s)),
  w3 AS (SELECT sid, pos, toks[pos + 1:pos + 3] AS inst, 3 AS n FROM (SELECT sid, toks, unnest(range(0, len(toks) - 2)) AS pos FROM s)),
  c3 AS (SELECT w3.* FROM w3 WHERE array_to_string(inst[1:2], ' ') IN (SELECT text FROM known WHERE n = 2) AND array_to_string(inst[2:3], ' ') IN (SELECT text FROM known WHERE n = 2)),
  shapes(n, a, b) AS (VALUES (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2), (3, 3, 3), (3, 1, 2), (3, 2, 3)),
  x AS (SELECT sid, pos, inst, n, a, b, array_to_string(inst[a:b], ' ') AS content, CASE WHEN a = 1 THEN NULL ELSE array_to_string(inst[1:a - 1], ' ') END AS p1,
    CASE WHEN b = n THEN NULL ELSE array_to_string(inst[b + 1:n], ' ') END AS p2,
    array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i BETWEEN a AND b THEN '{{*}}' ELSE inst[i] END), ' ') AS text FROM (SELECT * FROM w2 UNION ALL SELECT * FROM c3) JOIN shapes USING (n)),
  y AS (SELECT x.* FROM x WHERE (p1 IS NULL OR p1 IN (SELECT text FROM known)) AND (p2 IS NULL OR p2 IN (SELECT text FROM known)) AND content IN (SELECT text FROM known)),
  k AS (SELECT text, content, n, any_value(a) AS a, any_value(b) AS b, count(*) AS c FROM y GROUP BY text, content, n),
  k1 AS (SELECT k.* FROM k JOIN (SELECT text FROM k GROUP BY text HAVING sum(c) >= 10 AND count(*) >= 2) USING (text) WHERE c >= 2),
  k2 AS (SELECT k1.* FROM k1 JOIN (SELECT text FROM k1 GROUP BY text HAVING sum(c) >= 10 AND count(*) >= 2) USING (text)),
  v AS (SELECT text, i, count(DISTINCT w) AS d FROM (SELECT text, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS i FROM k2) GROUP BY text, i),
  kept AS (SELECT k2.* FROM k2 WHERE text IN (SELECT text FROM v GROUP BY text HAVING min(d) >= 2))"""

ORACLE = {
    "vocab_freq": f"WITH {SENT} SELECT cls, word, freq FROM voc UNION ALL VALUES (2, '{{UNKNOWN}}', 0), (3, '{{BEGIN}}', 0), (4, '{{END}}', 0)",
    "vocab_extend": f"""WITH {SENT} SELECT cls, word FROM vocab UNION ALL SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) + (SELECT max(cls) FROM vocab) AS INT), word
      FROM vf WHERE word NOT IN (SELECT word FROM vocab)""",
    "encode_sentences": f"WITH {SENT} SELECT sid, string_agg(cls, ' ' ORDER BY pos) AS classes FROM tok JOIN voc USING (word) GROUP BY sid",
    "decode_roundtrip": f"WITH {SENT} SELECT sid, array_to_string(toks, ' ') AS text FROM s",
    "encode_known": f"WITH {SENT} SELECT sid, string_agg(coalesce(v.cls, 2), ' ' ORDER BY pos) AS classes FROM tok LEFT JOIN vocab v USING (word) GROUP BY sid",
    "class_bytes": """SELECT cls, CASE WHEN cls < 256 THEN printf('%02x', cls) WHEN cls < 65536 THEN printf('%02x%02x', cls % 256, cls // 256)
      ELSE printf('%02x%02x%02x', cls % 256, cls // 256 % 256, cls // 65536) END AS bytes, cls % 256 <> 0 AND (cls < 65536 OR cls // 256 % 256 <> 0) AS valid FROM vocab""",
    "ngram_onepass": f"WITH {SENT}, {_grams('g', 4)}, {_counted('m', 'g', 2)} SELECT text, n, cnt FROM m",
    "pattern_listing": f"""WITH {_MODEL} SELECT n, text, cnt, cnt * n AS tokens, round(cnt * n / (SELECT tokens FROM total), 10) AS coverage, round(cnt / (SELECT sum(cnt) FROM m), 10) AS freq_all,
      round(cnt / sum(cnt) OVER (PARTITION BY n), 10) AS freq_n FROM m""",
    "pattern_report": f"WITH {_MODEL} SELECT coalesce(n, 0) AS n, count(*) AS types, CAST(sum(cnt) AS BIGINT) AS occurrences FROM m GROUP BY ROLLUP (n)",
    "pattern_histogram": f"WITH {_MODEL} SELECT cnt, count(*) AS types FROM m GROUP BY cnt",
    "ngram_postings": f"WITH {SENT}, {_grams('g', 3)}, {_counted('m', 'g', 10)} SELECT g.text, g.n, sid, pos FROM g JOIN m ON g.text = m.text AND g.n = m.n",
    "query_mode": f"WITH {_PROSE}, p AS (SELECT sum(len(toks)) AS tokens FROM s WHERE kind = 'prose') SELECT sid, pos, text, cnt, round(cnt * n / (SELECT tokens FROM p), 10) AS coverage FROM found",
    "constrained_counts": f"WITH {_PROSE} SELECT text, n, count(*) AS cnt FROM found GROUP BY text, n",
    "joint_listing": f"""WITH {SENT}, {_grams('g', 2, "kind = 'prose'")}, {_counted('m', 'g', 2)}, {_grams('t', 2, "kind IS DISTINCT FROM 'prose'")}, {_counted('o', 't', 1)}
      SELECT m.text, m.n, m.cnt AS cnt_train, coalesce(o.cnt, 0) AS cnt_test FROM m LEFT JOIN o ON m.text = o.text AND m.n = o.n""",
    "coverage_report": f"""WITH {_PROSE}, c AS (SELECT count(DISTINCT (sid, tk)) AS covered FROM span) SELECT CAST(tokens AS BIGINT) AS tokens, covered, CAST(0 AS BIGINT) AS encapsulated,
      CAST(tokens - covered AS BIGINT) AS uncovered, CAST(tokens - covered AS BIGINT) AS outside FROM c, tt""",
    "coverage_by_length": f"""WITH {_PROSE}, f AS (SELECT n, count(DISTINCT text) AS types, count(*) AS occurrences FROM found GROUP BY n), c AS (SELECT n, count(DISTINCT (sid, tk)) AS covered FROM span GROUP BY n)
      SELECT n, types, occurrences, covered, round(covered / tokens, 10) AS coverage, round(types / covered, 10) AS ttr FROM f JOIN c USING (n), tt""",
    "skipgram_counts": f"""WITH {_SKIP} SELECT text, regexp_replace(replace(text, '{{*}} {{*}}', '{{*2*}}'), '\\{{\\*\\}}', '{{*1*}}') AS shown, n, CAST(sum(c) AS BIGINT) AS cnt FROM kept GROUP BY text, n""",
    "skipgram_entropy": f"""WITH {_SKIP}, p AS (SELECT text, c, c / sum(c) OVER (PARTITION BY text) AS p FROM kept)
      SELECT text, CAST(sum(c) AS BIGINT) AS cnt, count(*) AS skip_types, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY text""",
    "skipgram_content": f"WITH {_SKIP} SELECT text, content, CAST(sum(c) AS BIGINT) AS cnt FROM kept GROUP BY text, content",
    "context_features": f"""WITH {SENT}, n AS (SELECT sid, toks, list_concat(list_concat(['{{BEGIN}}', '{{BEGIN}}'], toks), ['{{END}}', '{{END}}']) AS pad FROM s),
      p AS (SELECT sid, pad, unnest(range(0, len(toks))) AS pos FROM n) SELECT sid, pos, array_to_string(pad[pos + 1:pos + 5], ' ') AS context FROM p""",
    "subngram_counts": f"""WITH {SENT}, {_grams('g', 3, min_n=3)}, {_counted('m', 'g', 5)} SELECT text, 5 AS n_sub,
      split_part(text, ' ', 1) || ' | ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || ' ; ' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' | ' || split_part(text, ' ', 3) AS splits FROM m""",
} | {f"ngram_counts_n{n}": f"WITH {SENT}, {_grams('g', n, min_n=n)}, {_counted('m', 'g', 2)} SELECT text, cnt FROM m" for n in (1, 2, 3, 4)}

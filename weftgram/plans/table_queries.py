"""Queries on readers and writers: what is written to the shared folder is read again and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.operators import align, graph, mining, wordalign
from weftgram.operators.model import PatternModel
from weftgram.plans import skipgram_queries as sk
from weftgram.plans.align_queries import _A, _R, _SENT, _pt, _wa, records, side
from weftgram.plans.corpus_queries import SENT, _counted, _grams, sentences, text
from weftgram.plans.data_queries import _PT
from weftgram.plans.graph_queries import _EDGES, _P, _SUCC, postings
from weftgram.runtime import ensure_checkpoint_dir, global_rank, table
from weftgram.sources import corpus as C
from weftgram.sources import tables
from weftgram.streaming import query_stream


def folder(spark: SparkSession) -> str:
    """A new place in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/weftgram-{uuid.uuid4()}"


def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of the documents as text files in order, read as a corpus."""
    path = folder(spark)
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines.orderBy("doc_id", "i").select(F.col("line").alias("value")).write.text(path)
    return C.read_text(spark, path).select("sid", text("tokens").alias("text"))


def corpus_store(spark: SparkSession, sf: str) -> DataFrame:
    """The encoded corpus, written in two steps, as one row per token."""
    path = folder(spark)
    words = sentences(spark, sf)
    vocab = C.build_vocab(C.word_frequencies(words))
    for where, append in (("kind = 'prose'", False), ("kind IS DISTINCT FROM 'prose'", True)):
        C.write_corpus(C.encode(sentences(spark, sf, where), vocab), path, append)
    return C.tokens_of(spark.read.parquet(path)).select("sid", "pos", "cls")


def corpus_range(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the documents 100 to 499, encoded and decoded again."""
    words = sentences(spark, sf)
    vocab = C.build_vocab(C.word_frequencies(words))
    return C.decode_range(C.encode(words, vocab), vocab, 100 * C.LINES, 500 * C.LINES - 1)


def class_file(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    C.write_classes(table(spark, sf, "vocab").select("cls", "word", "freq"), path)
    return C.read_classes(spark, path).select("cls", "word")


def vocab_prune(spark: SparkSession, sf: str) -> DataFrame:
    """The classes below 100, those of the commonest words."""
    return C.prune_classes(C.build_vocab(C.word_frequencies(sentences(spark, sf))), 100).filter("cls > 5").select("cls", "word")


def sample_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = C.hash_split(sentences(spark, sf), {"train": 8, "dev": 1, "test": 1}, 7)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens"))


def scorer_segments(spark: SparkSession, sf: str) -> DataFrame:
    return C.segment_lines(side(spark, sf, "target"), "ref", "pairs", "x", "y").select("line")


def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of two and three tokens of a stored model of four."""
    path = folder(spark)
    words = sentences(spark, sf)
    patterns = mining.count_ngrams(words, 4, 5).withColumn("is_skip", F.lit(False))
    tables.save_model(path, patterns)
    return tables.load_model(spark, path, "patterns", (2, 3)).select(text().alias("text"), F.col("n").cast("int").alias("n"), "cnt")


def model_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of the skipgrams of an indexed model that was stored and read again."""
    path = folder(spark)
    found = sk.model(spark, sf)
    PatternModel(found.patterns, found.postings, found.skip_postings, gap=P.WORD_GAP, contents=found.contents, numbered=found.numbered).save(path)
    return PatternModel.load(spark, path, gap=P.WORD_GAP).contents.select(text().alias("text"), text("inst").alias("inst"), "c")


def model_accessors(spark: SparkSession, sf: str) -> DataFrame:
    """Point lookups of the one-token patterns 6 to 25, present or not."""
    posts = postings(spark, sf)
    model = PatternModel(graph.pattern_counts(posts), posts, tokens=1000)
    rows = []
    for c in range(6, 26):
        rows.append((c, [c] in model, model.occurrence_count([c]), model.coverage_count([c]), model.coverage([c]), model.indices([c]).count(), model.sentences([c]).count()))
    return spark.createDataFrame(rows, "cls int, held boolean, cnt bigint, tokens bigint, coverage double, n_indices bigint, n_sentences bigint")


def posting_rows(spark: SparkSession, sf: str) -> DataFrame:
    return postings(spark, sf).select(text().alias("pattern"), "sid", "pos")


def graph_store(spark: SparkSession, sf: str) -> DataFrame:
    """Successors of a stored graph, both ends with five occurrences at least."""
    path = folder(spark)
    posts = postings(spark, sf)
    patterns = graph.pattern_counts(posts)
    tables.save_model(path, patterns, edges=graph.build_graph(posts, relations=["child", "parent", "successor"]))
    edges = tables.load_model(spark, path, "edges", relations=["successor"])
    rows = graph.keep_known(edges.select("rel", "src", "dst", "w"), patterns.filter("cnt >= 5"))
    return rows.select(text("src").alias("src"), text("dst").alias("dst"), "w")


def relations_of(spark: SparkSession, sf: str) -> DataFrame:
    """Edges out of and into the patterns of one token."""
    posts = postings(spark, sf)
    edges = graph.build_graph(posts, relations=["child", "successor"])
    asked = graph.pattern_counts(posts).filter("n = 1")
    out, into = graph.related(edges, asked), graph.related(edges, asked, incoming=True)
    both = out.withColumn("way", F.lit("out")).unionByName(into.withColumn("way", F.lit("in")))
    return both.select("way", "rel", text("src").alias("src"), text("dst").alias("dst"), "w")


def dot_graph(spark: SparkSession, sf: str) -> DataFrame:
    """DOT lines of the successors of the patterns with 100 occurrences and more."""
    posts = postings(spark, sf)
    counts = graph.pattern_counts(posts).select(text().alias("pattern"), "cnt")
    edges = graph.edge_table(successor=graph.successors(posts)).select("rel", text("src").alias("src"), text("dst").alias("dst"), "w")
    return tables.dot_lines(edges, counts, counts.filter("cnt >= 100"))


def phrase_table_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.phrase_table(table(spark, sf, "phrasetable_raw").select("line_id", "line"))
    return rows.select("src", "tgt", F.size("scores").alias("n_scores"), F.round(F.get("scores", F.lit(0)), 9).alias("first"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy(F.col("source").alias("src"), F.col("target").alias("tgt")).agg(F.count(F.lit(1)).alias("c"))


def alignment_load(spark: SparkSession, sf: str) -> DataFrame:
    """The two best targets of every source by score product, in logarithms, of a stored alignment."""
    path = folder(spark)
    both = align.integrate_reverse(_counts(spark, sf)).select(F.array("src").alias("src"), F.array("tgt").alias("tgt"), F.array("p_ts", "p_st").alias("scores"))
    both.write.parquet(path)
    rows = tables.load_alignment(spark.read.parquet(path), 2, True, False, P.WORD_GAP)
    return rows.select(text("src").alias("src"), text("tgt").alias("tgt"), F.round(F.get("scores", F.lit(0)), 8).alias("lp_ts"), F.round(F.get("scores", F.lit(1)), 8).alias("lp_st"))


def alignment_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs and their counts as lines, with the two longest words of a target as keywords."""
    counts = _counts(spark, sf)
    words = counts.select("src", "tgt", F.explode(F.array_distinct(C.split_words(F.col("tgt")))).alias("kw"))
    keywords = tables.limit_keywords(words.withColumn("p", F.length("kw").cast("double")), 2)
    return tables.alignment_lines(counts.select("src", "tgt", F.array(F.col("c").cast("double")).alias("scores")), False, keywords)


def word_align_records(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments of copy a written as records of three lines and read again."""
    pairs = global_rank(_pt(spark, sf, "a").groupBy("s", "t").agg(F.max("wa").alias("wa")), F.col("s"), F.col("t"))
    ws, wt = C.split_words(F.col("s")), C.split_words(F.col("t"))
    points = wordalign.parse_points(pairs, "rank", "wa").distinct().groupBy("sid").agg(F.collect_list(F.struct("s", "t")).alias("p"))
    rows = pairs.join(points.withColumnRenamed("sid", "rank"), "rank", "left")
    own = lambda i: F.array_join(F.array_sort(F.transform(F.filter("p", lambda q: (q["s"] == i) & (q["t"] < F.size(wt))), lambda q: q["t"] + 1)), " ")
    group = lambda w, i: F.concat(w, F.lit(" ({ "), F.when(F.coalesce(own(i), F.lit("")) != "", F.concat(own(i), F.lit(" "))).otherwise(""), F.lit("})"))
    groups = F.concat(F.lit("NULL ({ }) "), F.array_join(F.transform(ws, group), " "))
    lines = rows.select("rank", F.posexplode(F.array(F.lit("# pair"), F.array_join(wt, " "), groups)).alias("k", "line"))
    found = tables.word_alignments(lines.select(F.lit(1).alias("file_no"), (F.col("rank") * 3 + F.col("k") + 1).alias("line_id"), "line"))
    return found.filter("t IS NOT NULL").select("sid", "s", "t", text("source").alias("source"), text("target").alias("target"))


def align_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """An HTML table of every aligned pair of copy a."""
    pairs = _pt(spark, sf, "a").groupBy("s", "t").agg(F.max("wa").alias("wa"))
    pairs = pairs.withColumn("sid", F.conv(F.substring(F.md5(F.concat_ws("|", "s", "t")), 1, 15), 16, 10).cast("bigint"))
    half = lambda c: pairs.select("sid", C.split_words(F.col(c)).alias("tokens"))
    return wordalign.matrix_html(wordalign.parse_points(pairs, "sid", "wa"), half("s"), half("t"))


def instance_file(spark: SparkSession, sf: str) -> DataFrame:
    """Instances as lines of features, label and weight, read again."""
    path = folder(spark)
    w = C.split_words(F.col("source"))
    rows = records(spark, sf).filter(F.size(w) > 0).select(F.array(F.get(w, F.lit(0)), F.size(w).cast("string")).alias("features"), F.col("target").alias("label"), F.lit(1.5).alias("weight"))
    tables.write_instances(rows, path, {"left": 1, "right": 1})
    read, settings = tables.read_instances(spark, path)
    return read.groupBy(F.get("features", F.lit(0)).alias("first"), F.get("features", F.lit(1)).alias("n"), "label").agg(F.sum("weight").alias("weight")).withColumn("left", F.lit(settings["left"]))


def stream_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of phrase table copy a as lines of a stream, looked up in a model of the records."""
    lines, out = folder(spark), folder(spark)
    _pt(spark, sf, "a").select(F.col("s").alias("value")).distinct().write.text(lines)
    patterns = mining.count_ngrams(side(spark, sf, "source"), 2, 3)
    found = query_stream.find_in_stream(query_stream.line_source(spark, lines), patterns, 2)
    stream = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("value", "pos", text().alias("text"), "n", "cnt")


QUERIES = {
    f.__name__: f
    for f in (
        text_scan, corpus_store, corpus_range, class_file, vocab_prune, sample_split, scorer_segments, model_store, model_reload, model_accessors, posting_rows, graph_store, relations_of, dot_graph,
        phrase_table_last, alignment_load, alignment_dump, word_align_records, align_matrix, instance_file, stream_lookup,
    )
}

_C = f"{_R}, c AS (SELECT source AS src, target AS tgt, count(*) AS c FROM rec GROUP BY ALL)"
_Q = "replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
ORACLE = {
    "text_scan": rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d),
      n AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS sid, list_filter(list_transform(string_split(l, ' '), lambda w: trim(w, E'\t\r')), lambda w: w <> '') AS toks FROM l) SELECT sid, array_to_string(toks, ' ') AS text FROM n WHERE len(toks) > 0""",
    "corpus_store": f"WITH {SENT} SELECT sid, pos, cls FROM tok JOIN voc USING (word)",
    "corpus_range": f"WITH {SENT} SELECT sid, array_to_string(toks, ' ') AS text FROM s WHERE sid >= 100 * 2147483648 AND sid < 500 * 2147483648",
    "class_file": "SELECT cls, word FROM vocab",
    "vocab_prune": f"WITH {SENT} SELECT cls, word FROM voc WHERE cls < 100",
    "sample_split": f"""WITH {SENT}, h AS (SELECT len(toks) AS k, ('0x' || substr(md5('7:' || sid), 1, 15))::BIGINT % 10 AS a FROM s)
      SELECT CASE WHEN a < 8 THEN 'train' WHEN a < 9 THEN 'dev' ELSE 'test' END AS part, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens FROM h GROUP BY part""",
    "scorer_segments": f"""WITH {_R} SELECT '<seg id="' || sid || '">' || replace(replace(array_to_string(wt, ' '), '&', '&amp;'), '<', '&lt;') || '</seg>' AS line FROM sw WHERE len(wt) > 0
      UNION ALL VALUES ('<refset setid="mteval" srclang="x" trglang="y">'), ('<DOC docid="pairs" sysid="pairs">'), ('</DOC>'), ('</refset>')""",
    "model_store": f"WITH {SENT}, {_grams('g', 4)}, {_counted('m', 'g', 5)} SELECT text, n, cnt FROM m WHERE n IN (2, 3)",
    "model_reload": f"WITH {sk._M} SELECT text, inst, c FROM kept",
    "model_accessors": f"""WITH {_P}, k AS (SELECT CAST(unnest(range(6, 26)) AS INT) AS cls), o1 AS (SELECT pattern[1] AS cls, count(*) AS cnt, count(DISTINCT sid) AS ns FROM occ WHERE n = 1 GROUP BY ALL)
      SELECT cls, cnt IS NOT NULL AS held, coalesce(cnt, 0) AS cnt, coalesce(cnt, 0) AS tokens, coalesce(cnt, 0) / 1000.0::DOUBLE AS coverage, coalesce(cnt, 0) AS n_indices, coalesce(ns, 0) AS n_sentences FROM k LEFT JOIN o1 USING (cls)""",
    "posting_rows": f"WITH {_P} SELECT t AS pattern, sid, pos FROM occ",
    "graph_store": f"WITH {_SUCC}, p5 AS (SELECT t FROM pat WHERE cnt >= 5) SELECT src, dst, CAST(w AS DOUBLE) AS w FROM succ WHERE src IN (SELECT t FROM p5) AND dst IN (SELECT t FROM p5)",
    "relations_of": f"""WITH {_EDGES}, {_SUCC[len(_P) + 2:]}, u AS (SELECT 'child' AS rel, parent AS src, child AS dst, 1.0 AS w FROM e UNION ALL SELECT 'successor', src, dst, w FROM succ), one AS (SELECT t FROM pat WHERE n = 1)
      SELECT 'out' AS way, rel, src, dst, CAST(w AS DOUBLE) AS w FROM u WHERE src IN (SELECT t FROM one) UNION ALL SELECT 'in', rel, src, dst, CAST(w AS DOUBLE) FROM u WHERE dst IN (SELECT t FROM one)""",
    "dot_graph": f"""WITH {_SUCC}, f AS (SELECT t FROM pat WHERE cnt >= 100), near AS (SELECT src, dst FROM succ WHERE src IN (SELECT t FROM f) OR dst IN (SELECT t FROM f)), ends AS (SELECT src AS t FROM near UNION SELECT dst FROM near)
      SELECT '"' || t || '" [label="' || t || chr(92) || 'n' || cnt || '"];' AS line FROM pat WHERE t IN (SELECT t FROM ends) UNION ALL SELECT '"' || src || '" -> "' || dst || '" [label="successor"];' FROM near""",
    "phrase_table_last": f"""WITH {_PT}, r AS (SELECT source AS src, target AS tgt, CAST(len(w) AS INT) AS n_scores, round(CAST(w[1] AS DOUBLE), 9) AS first, row_number() OVER (PARTITION BY source, target ORDER BY line_id DESC) AS k FROM judged WHERE ok)
      SELECT src, tgt, n_scores, first FROM r WHERE k = 1""",
    "alignment_load": f"""WITH {_C}, p AS (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS a, c / sum(c) OVER (PARTITION BY tgt) AS b FROM c), r AS (SELECT *, rank() OVER (PARTITION BY src ORDER BY a * b DESC) AS k FROM p)
      SELECT src, tgt, round(ln(a), 8) AS lp_ts, round(ln(b), 8) AS lp_st FROM r WHERE k <= 2""",
    "alignment_dump": f"""WITH {_C}, w AS (SELECT DISTINCT src, tgt, unnest(list_filter(string_split(tgt, ' '), lambda w: w <> '')) AS kw FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY length(kw) DESC, kw) AS k FROM w),
      k AS (SELECT src, tgt, string_agg(kw || ' ' || CAST(length(kw) AS DOUBLE), chr(9) ORDER BY k) AS ks FROM r WHERE k <= 2 GROUP BY src, tgt)
      SELECT c.src, c.tgt, c.src || chr(9) || c.tgt || chr(9) || CAST(c AS DOUBLE) || coalesce(chr(10) || '#KEYWORDS:' || chr(9) || ks, '') AS line FROM c LEFT JOIN k ON k.src = c.src AND k.tgt = c.tgt""",
    "word_align_records": f"""WITH {_A}, {_wa('a')}, {_SENT}, num AS (SELECT sid, row_number() OVER (ORDER BY st, tt) AS k FROM wa)
      SELECT k AS sid, s, t, array_to_string(ws, ' ') AS source, array_to_string(wt, ' ') AS target FROM pa JOIN z USING (sid) JOIN num USING (sid) WHERE s < len(ws) AND t < len(wt)""",
    "align_matrix": f"""WITH {_A}, {_wa('a')}, {_SENT}, p AS (SELECT sid, list(s || '-' || t) AS p FROM pa GROUP BY sid), y AS (SELECT z.sid, list_transform(ws, lambda w: replace(replace(w, '&', '&amp;'), '<', '&lt;')) AS a, list_transform(wt, lambda w: replace(replace(w, '&', '&amp;'), '<', '&lt;')) AS b, coalesce(p, []) AS p FROM z LEFT JOIN p USING (sid))
      SELECT sid, '<table><tr><td></td>' || coalesce(array_to_string(list_transform(a, lambda w: '<th>' || w || '</th>'), ''), '') || '</tr>' || coalesce(array_to_string(list_transform(range(1, len(b) + 1), lambda j: '<tr><th>' || b[j] || '</th>'
        || coalesce(array_to_string(list_transform(range(1, len(a) + 1), lambda i: '<td>' || CASE WHEN list_contains(p, (i - 1) || '-' || (j - 1)) THEN 'x' ELSE '' END || '</td>'), ''), '') || '</tr>'), ''), '') || '</table>' AS html FROM y""",
    "instance_file": f"""WITH {_R} SELECT ws[1] AS first, CAST(len(ws) AS VARCHAR) AS n, target AS label, sum(1.5::DOUBLE) AS weight, 1 AS left FROM sw JOIN rec USING (sid) WHERE len(ws) > 0 GROUP BY ALL""",
    "stream_lookup": f"""WITH {_R}, {_A}, g AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS p FROM sw), m AS (SELECT p, count(*) AS cnt FROM g GROUP BY p HAVING count(*) >= 3),
      l AS (SELECT DISTINCT s AS value FROM a), lw AS (SELECT value, list_filter(list_transform(string_split(value, ' '), lambda w: trim(w, E'\\t\\r')), lambda w: w <> '') AS w FROM l),
      q AS (SELECT value, unnest(range(0, len(w))) AS pos, w, 1 AS n FROM lw UNION ALL SELECT value, unnest(range(0, len(w) - 1)), w, 2 FROM lw)
      SELECT value, CAST(pos AS INT) AS pos, p AS text, n, cnt FROM q JOIN m ON m.p = array_to_string(w[pos + 1:pos + n], ' ')""",
}

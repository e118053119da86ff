"""Corpora: plain text and structured documents in, class-encoded sentences out.

A corpus is ``sid BIGINT, tokens ARRAY``. Lines without tokens keep their number and
contribute nothing. Readers take ``max_tokens``: sentences of more tokens are then left
out as well; by default none is.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgram.functions.patterns import BEGIN, END, FIRST_CLASS, UNKNOWN, WORD_GAP, class_bytes
from weftgram.runtime import global_rank, with_scalars

RESERVED = [(UNKNOWN, "{UNKNOWN}"), (BEGIN, "{BEGIN}"), (END, "{END}")]
#: Room for the lines of a document in sentence numbers: a text has fewer than 2**31 characters.
LINES = 1 << 31
#: Classes looked up in a table sent to every task; as numbers are unique, so many at most.
HEAD_CLASSES = 1 << 17


def split_words(line):
    """Words between spaces, without tabs and carriage returns at their ends."""
    return F.filter(F.transform(F.split(line, " "), lambda w: F.btrim(w, F.lit("\t\r"))), lambda w: w != "")


def held(rows: DataFrame, max_tokens: int | None) -> DataFrame:
    size = F.size("tokens")
    return rows.filter((size >= 1) & (size <= max_tokens) if max_tokens else size >= 1)


def sentences_of_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """One sentence per line; ``sid = doc_id * LINES + line`` (line from 0).

    A document number beyond 2**32 has no room in ``sid`` and raises an overflow.
    """
    lines = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    rows = lines.select((F.col("d") * F.lit(LINES) + F.col("line_no")).alias("sid"), split_words(F.col("line")).alias("tokens"))
    return held(rows, max_tokens)


def numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """``file, line_id, sid, columns`` of rows read from files, with ``file, block, m``.

    Rows of a split come in order, so the number of a row in its file (``line_id``, from 1)
    is the number of rows in the file's earlier splits, a running sum over one row per
    split, plus its place in its own. ``sid`` counts on over the files by path.
    """
    blocks = rows.groupBy("file", "block").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_file = running(Window.partitionBy("file").orderBy("block"))
    # one row per split of the input
    offsets = blocks.select("file", "block", "first", in_file.alias("before"), running(Window.partitionBy(F.lit(0)).orderBy("file", "block")).alias("all_before"))
    place = F.col("m") - F.col("first") + 1
    return rows.join(offsets, ["file", "block"]).select("file", (place + F.col("before")).alias("line_id"), (place + F.col("all_before")).alias("sid"), *columns)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line_id, sid, line`` of text files (also .gz, .bz2), numbered in file order and over all files."""
    rows = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line")
    )
    return numbered(rows, "line")


def read_text(spark: SparkSession, paths: str | list[str], max_tokens: int | None = None) -> DataFrame:
    """``file, sid, tokens`` of plain text, one sentence per line; numbers go on from file to file by path."""
    lines = numbered_lines(spark, paths)
    return held(lines.select("file", "sid", split_words(F.col("line")).alias("tokens")), max_tokens)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def folia_sentences(path: str, content: bytes) -> Iterator[list[str]]:
    """Words of a document; a new sentence where the element around the words changes."""
    raw = gzip.decompress(content) if path.endswith(".gz") else bz2.decompress(content) if path.endswith(".bz2") else content
    around, parent, words = [], None, []
    for event, element in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
        if event == "start":
            around.append(element)
            continue
        around.pop()
        if _local(element.tag) == "w":
            own = [t for t in element if _local(t.tag) == "t" and t.get("class", "current") == "current"]
            word = "".join(own[0].itertext()).strip() if own else ""
            if word:
                if words and around[-1] is not parent:
                    yield words
                    words = []
                parent = around[-1]
                words.append(word)
            element.clear()
    if words:
        yield words


def read_folia(spark: SparkSession, paths: str | list[str], max_tokens: int | None = None) -> DataFrame:
    """``file, sid, tokens`` of FoLiA documents (also .xml.gz, .xml.bz2), one task for each.

    A sentence is what words lie in one element; words outside of ``s`` elements count too.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in files.itertuples(index=False):
                rows = [(path, i, words) for i, words in enumerate(folia_sentences(path, bytes(content)))]
                yield pd.DataFrame(rows, columns=["file", "m", "tokens"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInPandas(parse, "file string, m bigint, tokens array<string>").withColumn("block", F.lit(0))
    return held(numbered(rows, "tokens").select("file", "sid", "tokens"), max_tokens)


def read_corpus(spark: SparkSession, paths: str | list[str], max_tokens: int | None = None) -> DataFrame:
    """By extension: ``.xml``, ``.xml.gz`` and ``.xml.bz2`` as FoLiA, anything else as text.

    Files of both kinds go on in their numbers, texts first.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    folia = [p for p in listed if p.endswith((".xml", ".xml.gz", ".xml.bz2"))]
    texts = [p for p in listed if p not in folia]
    if not folia or not texts:
        return read_folia(spark, folia, max_tokens) if folia else read_text(spark, texts, max_tokens)
    lines = numbered_lines(spark, texts)
    first = held(lines.select("file", "sid", split_words(F.col("line")).alias("tokens")), max_tokens)
    further = with_scalars(read_folia(spark, folia, max_tokens), lines.agg(F.coalesce(F.max("sid"), F.lit(0)).alias("top")))
    return first.unionByName(further.select("file", (F.col("sid") + F.col("top")).alias("sid"), "tokens"))


def read_list(spark: SparkSession, path: str, max_tokens: int | None = None) -> DataFrame:
    """The corpus of the files that a text file lists, one path per line."""
    listed = [r["value"].strip() for r in spark.read.text(path).collect()]  # names of files, not their content
    return read_corpus(spark, [p for p in listed if p], max_tokens)


def word_frequencies(*corpora: DataFrame) -> DataFrame:
    """``word, freq`` over one corpus or several."""
    words = None
    for c in corpora:
        w = c.select(F.explode("tokens").alias("word"))
        words = w if words is None else words.unionByName(w)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _numbered(freq: DataFrame, first: int, compatible: bool) -> DataFrame:
    """Dense class numbers by (freq descending, word), from a range-partitioned sort."""
    ranked = global_rank(freq.select("word", "freq"), F.desc("freq"), F.col("word"))
    dense = F.col("rank") + first
    if compatible:
        # numbers with a zero byte are left out: 255 to each block of 256
        i = dense - 1
        dense = F.floor(i / 255) * 256 + i % 255 + 1
    return ranked.select(dense.cast("int").alias("cls"), "word", "freq")


def build_vocab(freq: DataFrame, compatible: bool = False) -> DataFrame:
    """``cls, word, freq``: frequent words first, ties by word, from class 6 on.

    ``compatible`` skips class numbers of up to two bytes that hold a zero byte.
    """
    spark = freq.sparkSession
    reserved = spark.createDataFrame([(c, w, 0) for c, w in RESERVED], "cls int, word string, freq bigint")
    return reserved.unionByName(_numbered(freq, FIRST_CLASS, compatible))


def extend_vocab(vocab: DataFrame, freq: DataFrame) -> DataFrame:
    """Known words keep their class; new ones follow the highest class in use."""
    new = freq.join(vocab.select("word"), "word", "left_anti")
    numbered = _numbered(new, 0, False)
    top = vocab.agg(F.max("cls").alias("top"))
    added = with_scalars(numbered, top).select((F.col("cls") + F.col("top") + 1).cast("int").alias("cls"), "word", "freq")
    return vocab.select("cls", "word", "freq").unionByName(added)


def prune_classes(vocab: DataFrame, below: int) -> DataFrame:
    """Classes under a number; as frequent words come first, those of rare words go."""
    return vocab.filter(F.col("cls") < below)


def encode(corpus: DataFrame, vocab: DataFrame, unknown: str = "placeholder") -> DataFrame:
    """Words to classes. ``unknown``: ``placeholder`` (class 2), ``drop`` the sentence, or ``gap`` words kept as 0.

    The low classes, which frequent words have, are looked up in a table of at most
    ``HEAD_CLASSES`` rows in every task; only the rarer words are moved to meet theirs.
    """
    rows = corpus.select("sid", F.posexplode("tokens").alias("pos", "word"))
    table = vocab.select("word", F.col("cls").cast("int").alias("cls"))
    head = F.broadcast(table.filter(F.col("cls") < HEAD_CLASSES))
    near = rows.join(head, "word").select("sid", "pos", "word", "cls")
    far = rows.join(head, "word", "left_anti").join(table.filter(F.col("cls") >= HEAD_CLASSES), "word", "left").select("sid", "pos", "word", "cls")
    cls = F.coalesce("cls", F.lit(UNKNOWN))
    if unknown == "gap":
        cls = F.when(F.col("word") == WORD_GAP, F.lit(0)).otherwise(cls)
    joined = near.unionByName(far).select("sid", "pos", cls.alias("cls"), F.col("cls").isNull().alias("new"))
    packed = joined.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "cls"))).alias("t"), F.max("new").alias("new"))
    if unknown == "drop":
        packed = packed.filter(~F.col("new"))
    return packed.select("sid", F.col("t.cls").alias("tokens"))


def decode(patterns: DataFrame, vocab: DataFrame, key: list[str], pattern: str = "pattern", out: str = "words") -> DataFrame:
    """Class arrays to words by a join; gaps become ``{*}``, unknown classes ``{NOTFOUND!}``."""
    rows = patterns.select(*key, F.posexplode(pattern).alias("__i", "__c"))
    word = F.when(F.col("__c") == 0, F.lit(WORD_GAP)).otherwise(F.coalesce("word", F.lit("{NOTFOUND!}")))
    named = rows.join(vocab.select(F.col("cls").alias("__c"), "word"), "__c", "left").select(*key, F.struct("__i", word.alias("w")).alias("x"))
    return named.groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("x")).select(*key, F.col("x.w").alias(out))


def tokens_of(corpus: DataFrame) -> DataFrame:
    """``sid, pos, cls``: the corpus as one row per token."""
    return corpus.select("sid", F.posexplode("tokens").alias("pos", "cls"))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class file: ``class <tab> word``; the reserved classes are added."""
    rows = spark.read.csv(path, sep="\t", schema="cls int, word string", quote="")
    held = rows.filter("cls IS NOT NULL AND word IS NOT NULL").withColumn("freq", F.lit(None).cast("bigint"))
    reserved = spark.createDataFrame([(c, w, 0) for c, w in RESERVED], "cls int, word string, freq bigint")
    return reserved.join(held.select("cls"), "cls", "left_anti").select("cls", "word", "freq").unionByName(held)


def write_classes(vocab: DataFrame, path: str) -> None:
    vocab.filter(F.col("cls") != UNKNOWN).select("cls", "word").write.mode("overwrite").csv(path, sep="\t", quote="")


def write_corpus(corpus: DataFrame, path: str, append: bool = False) -> None:
    corpus.write.mode("append" if append else "overwrite").parquet(path)


def decode_range(corpus: DataFrame, vocab: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """``sid, text`` of the sentences from start to end."""
    rows = corpus
    if start is not None:
        rows = rows.filter(F.col("sid") >= start)
    if end is not None:
        rows = rows.filter(F.col("sid") <= end)
    return decode(rows, vocab, ["sid"], "tokens").select("sid", F.array_join("words", " ").alias("text"))


def hash_split(corpus: DataFrame, shares: dict[str, int], seed: int = 0) -> DataFrame:
    """Add ``part``: the same division into shares (of their sum) on every run."""
    whole = sum(shares.values())
    # a published hash, so that any other system can make the same division
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("sid").cast("string")))
    at = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % whole
    part, up_to = None, 0
    for name, share in shares.items():
        up_to += share
        part = F.when(at < up_to, name) if part is None else part.when(at < up_to, name)
    return corpus.withColumn("part", part)


def segment_lines(corpus: DataFrame, kind: str, name: str, source: str = "", target: str = "") -> DataFrame:
    """``at, line``: the lines, in order of ``at``, of a test set for outside scorers. ``kind``: tst, ref or src."""
    if kind not in ("tst", "ref", "src"):
        raise ValueError(f"no such kind: {kind}")
    spark = corpus.sparkSession
    safe = F.replace(F.replace(F.array_join("tokens", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    segments = corpus.select(F.col("sid").alias("at"), F.concat(F.lit('<seg id="'), F.col("sid").cast("string"), F.lit('">'), safe, F.lit("</seg>")).alias("line"))
    top, most = -(1 << 63), (1 << 63) - 1
    frame = [(top, f'<{kind}set setid="mteval" srclang="{source}" trglang="{target}">'), (top + 1, f'<DOC docid="{name}" sysid="{name}">'), (most - 1, "</DOC>"), (most, f"</{kind}set>")]
    return spark.createDataFrame(frame, "at bigint, line string").unionByName(segments)


def first_sentences(corpus: DataFrame, n: int) -> DataFrame:
    """Sentences numbered up to n, an explicit limit of training data."""
    return corpus.filter(F.col("sid") <= n)


def to_class_bytes(corpus: DataFrame) -> DataFrame:
    """``sid, data``: sentences in the compact form, a zero byte after each class and ``01 00`` at the end."""
    stop = F.unhex(F.lit("00"))
    joined = F.aggregate("tokens", F.unhex(F.lit("")), lambda acc, c: F.concat(acc, class_bytes(c), stop))
    return corpus.select("sid", F.concat(joined, F.unhex(F.lit("0100"))).alias("data"))


def read_class_encoded(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, sid, tokens`` of compact binary corpora; a file is read by one task.

    Empty sentences keep their number and give no row.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in files.itertuples(index=False):
                rows, tokens, sid = [], [], 1
                for part in bytes(content).split(b"\0"):
                    if part == b"\1":
                        if tokens:
                            rows.append((path, sid, tokens))
                        tokens, sid = [], sid + 1
                    elif part:
                        tokens.append(int.from_bytes(part, "little"))
                if tokens:
                    rows.append((path, sid, tokens))
                yield pd.DataFrame(rows, columns=["file", "sid", "tokens"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(parse, "file string, sid bigint, tokens array<int>")

"""Mining of frequent n-grams and skipgrams from a corpus.

``corpus`` is ``sid, tokens`` with tokens of any one type; ``gap`` is its gap token.
Null or empty sentences contribute nothing; equal sentences under several ids
count each time; an empty corpus gives an empty model.

The number of occurrences never rises from a pattern to a longer one, so counting
all windows and keeping the frequent gives what a level-wise search gives. A level
is first reduced to the windows whose two shorter parts are frequent where the set
of these is small enough to broadcast (its bytes are added up first);
beyond that the reduction would move every window twice to save one shuffle, and
the windows are counted directly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.functions.gaps import gap_masks
from weftgram.operators import numbered
from weftgram.runtime import cut_lineage, is_small, small


@dataclass(frozen=True)
class Thresholds:
    """Occurrences of a pattern, of a skip content, and contents of a skipgram."""

    tokens: int = 2
    skip_tokens: int = 2
    skip_types: int = 2


def window_rows(corpus: DataFrame, n: int) -> DataFrame:
    """``pattern, sid, pos`` of every n-gram occurrence."""
    long_enough = corpus.filter(F.size("tokens") >= n)
    return long_enough.select("sid", F.posexplode(P.windows("tokens", n)).alias("pos", "pattern")).select("pattern", "sid", "pos")


def counted(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= least)


def with_frequent_parts(rows: DataFrame, n: int, shorter: DataFrame, broadcast: bool) -> DataFrame:
    """Windows whose first and last n-1 tokens are frequent."""
    out = rows
    for begin in (0, 1):
        key = shorter.select(F.col("pattern").alias("__part"))
        out = out.join(F.broadcast(key) if broadcast else key, P.piece("pattern", begin, n - 1) == F.col("__part"), "left_semi")
    return out


def mine_ngrams(corpus: DataFrame, max_n: int, least: int = 2, min_n: int = 1) -> DataFrame:
    """``pattern, n, cnt`` of the n-grams that occur at least ``least`` times.

    Stops at the first length without any. Levels are checkpointed as patterns, so
    plans stay short and nothing of the size of the corpus is held.
    """
    return union_levels([lv for lv in mine_levels(corpus, max_n, least) if lv[0] >= min_n], corpus)


def mine_levels(corpus: DataFrame, max_n: int, least: int) -> list[tuple[int, DataFrame, bool]]:
    """(n, patterns, whether they can be broadcast) of each length with a frequent one."""
    levels: list[tuple[int, DataFrame, bool]] = []
    for n in range(1, max_n + 1):
        rows = window_rows(corpus, n)
        if n > 1 and levels[-1][2]:
            rows = with_frequent_parts(rows, n, levels[-1][1], True)
        level = cut_lineage(counted(rows, least))
        if level.isEmpty():
            break
        levels.append((n, level, is_small(level.select("pattern"))))
    return levels


def union_levels(levels: list[tuple[int, DataFrame, bool]], corpus: DataFrame) -> DataFrame:
    out = None
    for n, level, _ in levels:
        part = level.select("pattern", F.lit(n).alias("n"), "cnt")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(corpus.dtypes)["tokens"]
        return corpus.sparkSession.createDataFrame([], f"pattern {kind}, n int, cnt bigint")
    return out


def count_ngrams(corpus: DataFrame, max_n: int, least: int = 2, min_n: int = 1) -> DataFrame:
    """The same result in one pass: every length counted together, one shuffle."""
    lengths = F.sequence(F.lit(min_n), F.least(F.lit(max_n), F.size("tokens")))
    every = F.flatten(F.transform(lengths, lambda n: P.windows("tokens", n)))
    rows = corpus.filter(F.size("tokens") >= min_n).select(F.explode(every).alias("pattern"))
    return counted(rows, least).select("pattern", F.size("pattern").alias("n"), "cnt")


def postings(corpus: DataFrame, model: DataFrame, max_n: int, min_n: int = 1) -> DataFrame:
    """``pattern, n, sid, pos`` of every occurrence of the model's n-grams."""
    lengths = F.sequence(F.lit(min_n), F.least(F.lit(max_n), F.size("tokens")))
    every = F.flatten(
        F.transform(lengths, lambda n: F.transform(P.windows("tokens", n), lambda w, i: F.struct(w.alias("pattern"), i.alias("pos"))))
    )
    rows = corpus.filter(F.size("tokens") >= min_n).select("sid", F.explode(every).alias("x")).select("x.pattern", "sid", "x.pos")
    return rows.join(model.select("pattern"), "pattern", "left_semi").select("pattern", F.size("pattern").alias("n"), "sid", "pos")


def _masks(n: int, initial_only: bool, final_only: bool) -> list[tuple[int, ...]]:
    """Masks of length n; a single gap at the start (or the end) alone may be left out."""
    keep = []
    for m in gap_masks(n):
        bits = "".join(map(str, m))
        single_start = bits.startswith("1") and "01" not in bits
        single_end = bits.endswith("1") and "10" not in bits
        if (single_start and not initial_only) or (single_end and not final_only):
            continue
        keep.append(m)
    return keep


def skip_contents(windows: DataFrame, n: int, gap, initial_only: bool = True, final_only: bool = True) -> DataFrame:
    """``pattern, inst, c``: holes punched into the distinct n-grams by every configuration.

    An instance and a skipgram determine the content, so contents are kept as instances.
    """
    masks = _masks(n, initial_only, final_only)
    literal = F.array(*(F.array(*map(F.lit, m)) for m in masks))
    types = windows.groupBy(F.col("pattern").alias("inst")).agg(F.count(F.lit(1)).alias("c"))
    punched = types.select("inst", "c", F.explode(literal).alias("m"))
    return punched.select(P.punch("inst", "m", gap).alias("pattern"), "inst", "c")


def with_known_fillers(contents: DataFrame, known: DataFrame, gap, least: int) -> DataFrame:
    """Contents of whose gap fillers each occurs ``least`` times as a pattern of its own."""
    exploded = contents.select("pattern", "inst", F.explode(F.array_distinct(P.fillers("inst", "pattern", gap))).alias("piece"))
    good = known.filter(F.col("cnt") >= least).select(F.col("pattern").alias("piece"))
    bad = exploded.join(good, "piece", "left_anti").select("pattern", "inst").distinct()
    return contents.join(bad, ["pattern", "inst"], "left_anti")


def prune_skipgrams(contents: DataFrame, t: Thresholds, gap) -> DataFrame:
    """The contents (``pattern, inst, c``) of the skipgrams that stay.

    First skipgrams with too few occurrences or contents go, then contents with too
    few occurrences, then skipgrams again on what is left, each gap position of which
    must show ``skip_types`` different tokens.
    """

    sums = contents.groupBy("pattern").agg(
        F.sum("c").alias("s"), F.count(F.lit(1)).alias("k"),
        F.sum(F.when(F.col("c") >= t.skip_tokens, F.col("c"))).alias("s2"), F.count(F.when(F.col("c") >= t.skip_tokens, 1)).alias("k2"),
    )
    kept = sums.filter((F.col("s") >= t.tokens) & (F.col("k") >= t.skip_types) & (F.col("s2") >= t.tokens) & (F.col("k2") >= t.skip_types)).select("pattern")
    left = contents.filter(F.col("c") >= t.skip_tokens).join(kept, "pattern", "left_semi")
    token = left.select("pattern", F.posexplode(F.arrays_zip(F.col("inst").alias("x"), F.col("pattern").alias("y"))).alias("i", "z"))
    shown = token.filter(F.col("z.y") == F.lit(gap)).groupBy("pattern", "i", "z.x").agg(F.lit(1).alias("one"))
    varied = shown.groupBy("pattern", "i").agg(F.count("one").alias("d")).groupBy("pattern").agg(F.min("d").alias("d"))
    return left.join(varied.filter(F.col("d") >= t.skip_types).select("pattern"), "pattern", "left_semi")


@dataclass(frozen=True)
class Mined:
    """Tables of a mined model; those of skipgrams are None without them.

    ``contents`` is ``pattern, inst, c``: skipgrams with the n-grams that fill them.
    ``numbered`` has the same model in numbers, where its words were numbered.
    """

    patterns: DataFrame
    postings: DataFrame | None
    skip_postings: DataFrame | None
    contents: DataFrame | None
    numbered: numbered.Numbered | None = None


def mine(
    corpus: DataFrame, max_n: int = 4, thresholds: Thresholds | None = None, skipgrams: bool = False, indexed: bool = True,
    initial_only: bool = True, final_only: bool = True, gap=P.GAP,
) -> Mined:
    """Mine a model: ``patterns(pattern, n, is_skip, cnt)`` and, if indexed, its postings.

    Holes are punched into every window whose n-1 parts are frequent, whether or not
    the window is frequent itself; that makes every part and every filler frequent, and
    only a higher threshold for fillers needs a look at them. ``initial_only`` and
    ``final_only`` allow skipgrams whose single gap stands at the start, or at the end.
    With skipgrams the words are numbered first where ``numbered.mine`` can.
    """
    t = thresholds or Thresholds()
    if skipgrams and isinstance(gap, str):
        made = numbered.mine(corpus, max_n, t.tokens, t.skip_tokens, t.skip_types, gap, lambda n: _masks(n, initial_only, final_only))
        if made is not None:
            return of_numbered(corpus, made, max_n, indexed, gap)
    levels = mine_levels(corpus, max_n, t.tokens)
    grams = union_levels(levels, corpus)
    patterns = grams.select("pattern", "n", F.lit(False).alias("is_skip"), "cnt")
    posts = postings(corpus, grams, max_n) if indexed else None
    if not skipgrams:
        return Mined(patterns, posts, None, None)
    contents = skips = None
    for n in range(2, max_n + 1):
        if len(levels) < n - 1:
            break
        _, shorter, broadcast = levels[n - 2]
        rows = with_frequent_parts(window_rows(corpus, n), n, shorter, broadcast)
        found = skip_contents(rows, n, gap, initial_only, final_only)
        if t.skip_tokens > t.tokens:
            found = with_known_fillers(found, union_levels(levels[: n - 1], corpus), gap, t.skip_tokens)
        kept = cut_lineage(prune_skipgrams(cut_lineage(found), t, gap))
        contents = kept if contents is None else contents.unionByName(kept)
        if indexed:
            at = rows.withColumnRenamed("pattern", "inst").join(kept.select("pattern", "inst"), "inst")
            at = at.select("pattern", P.skip_content("inst", "pattern", gap).alias("content"), "inst", "sid", "pos")
            skips = at if skips is None else skips.unionByName(at)
    if contents is None:
        kind = dict(corpus.dtypes)["tokens"]
        contents = corpus.sparkSession.createDataFrame([], f"pattern {kind}, inst {kind}, c bigint")
        if indexed:
            skips = corpus.sparkSession.createDataFrame([], f"pattern {kind}, content {kind}, inst {kind}, sid bigint, pos int")
    counts = contents.groupBy("pattern").agg(F.sum("c").alias("cnt"))
    patterns = patterns.unionByName(counts.select("pattern", F.size("pattern").alias("n"), F.lit(True).alias("is_skip"), "cnt"))
    return Mined(patterns, posts, skips, contents)


def of_numbered(corpus: DataFrame, made: numbered.Numbered, max_n: int, indexed: bool, gap) -> Mined:
    kinds = (made.grams, False), (made.skips.select("pattern", F.size("pattern").alias("n"), "cnt"), True)
    grams, skipgrams = (df.select("pattern", "n", F.lit(is_skip).alias("is_skip"), "cnt") for df, is_skip in kinds)
    posts = skips = None
    if indexed:
        posts = postings(corpus, made.grams, max_n)
        for n in range(2, len(made.windows) + 2):
            # the patterns of a length were added up, as numbers, before they were sent
            rows = with_frequent_parts(window_rows(corpus, n), n, made.grams.filter(F.col("n") == n - 1), True).withColumnRenamed("pattern", "inst")
            at = rows.join(made.contents.filter(F.size("inst") == n).select("pattern", "inst"), "inst")
            at = at.select("pattern", P.skip_content("inst", "pattern", gap).alias("content"), "inst", "sid", "pos")
            skips = at if skips is None else skips.unionByName(at)
    return Mined(grams.unionByName(skipgrams), posts, skips, made.contents, made)


def mine_constrained(corpus: DataFrame, reference: DataFrame, max_n: int, least: int = 1, gap=P.GAP) -> DataFrame:
    """``pattern, n, cnt``: patterns of a reference model as they occur in a corpus."""
    grams = reference.filter(~P.is_skipgram("pattern", gap))
    found = counted(postings(corpus, grams, max_n).select("pattern"), least)
    out = found.select("pattern", F.size("pattern").alias("n"), "cnt")
    skips = find_skipgrams(corpus, reference, max_n, gap)
    if skips is not None:
        out = out.unionByName(counted(skips.select("pattern"), least).select("pattern", F.size("pattern").alias("n"), "cnt"))
    return out


def shape(pattern: str, gap) -> F.Column:
    """1 for a gap, 0 for a token."""
    return F.transform(pattern, lambda x: F.when(x == F.lit(gap), 1).otherwise(0))


def find_skipgrams(corpus: DataFrame, reference: DataFrame, max_n: int, gap=P.GAP) -> DataFrame | None:
    """``pattern, sid, pos`` of the reference's skipgrams in a corpus, whatever fills their gaps.

    Only the gap shapes that the reference has are tried, and of a shape only the windows
    whose first run of tokens begins some skipgram of that shape.
    """
    skips = reference.filter(P.is_skipgram("pattern", gap) & (F.size("pattern") <= max_n)).select("pattern")
    first = F.get(P.parts("pattern", gap), F.lit(0))
    begun = cut_lineage(skips.select(shape("pattern", gap).alias("m"), first.alias("part")).distinct())
    masks: dict[int, list[tuple[int, ...]]] = {}
    for r in begun.select("m").distinct().collect():  # shapes of up to max_n positions: fewer than 2 ** max_n
        masks.setdefault(len(r["m"]), []).append(tuple(r["m"]))
    begun = small(begun)
    out = None
    for n, of_n in sorted(masks.items()):
        runs = [(m, m.index(0), ([*m, 1].index(1, m.index(0)) - m.index(0))) for m in sorted(of_n)]
        literal = F.array(*(F.struct(F.array(*map(F.lit, m)).alias("m"), F.lit(at).alias("at"), F.lit(k).alias("k")) for m, at, k in runs))
        tried = window_rows(corpus, n).select("sid", "pos", F.explode(literal).alias("x"), F.col("pattern").alias("inst"))
        tried = tried.select("sid", "pos", "inst", "x.m", F.slice("inst", F.col("x.at") + 1, F.col("x.k")).alias("part"))
        punched = tried.join(begun, ["m", "part"], "left_semi").select(P.punch("inst", "m", gap).alias("pattern"), "sid", "pos")
        found = punched.join(skips, "pattern", "left_semi")
        out = found if out is None else out.unionByName(found)
    return out


def template_pairs(patterns: DataFrame, gap=P.GAP) -> DataFrame:
    """``template, instance``: skipgrams and the patterns of the model that fill their gaps.

    Candidates are the patterns with the gap shape punched into them, an equi-join per
    shape; skipgrams may fill skipgrams.
    """
    skips = patterns.filter(P.is_skipgram("pattern", gap)).select(F.col("pattern").alias("template"), shape("pattern", gap).alias("m"))
    shapes = skips.select("m", F.size("m").alias("n")).distinct()  # fewer than 2 ** max n
    punched = patterns.select(F.col("pattern").alias("instance"), F.size("pattern").alias("n")).join(F.broadcast(shapes), "n")
    # a shape that leaves a gap of the instance out would only give what a wider one does
    punched = punched.filter(F.forall(F.zip_with("instance", "m", lambda x, m: (x != F.lit(gap)) | (m == 1)), lambda t: t))
    punched = punched.select("instance", P.punch("instance", "m", gap).alias("template"))
    return punched.join(skips.select("template"), "template", "left_semi").filter("template <> instance").select("template", "instance")


def find_patterns(corpus: DataFrame, model: DataFrame, min_n: int = 1, max_n: int = 9, gap=P.GAP, known_fillings: bool = False) -> DataFrame:
    """``sid, pos, pattern, n``: every known pattern in a text, skipgrams included.

    With ``known_fillings`` a skipgram is found only where an n-gram of the model fills it;
    which n-grams do is settled once on the model, and the text's windows only meet its n-grams.
    """
    sized = model.filter(F.size("pattern").between(min_n, max_n)).select("pattern")
    columns = ["sid", "pos", "pattern", "n"]
    found = postings(corpus, sized.filter(~P.is_skipgram("pattern", gap)), max_n, min_n)
    if known_fillings:
        pairs = template_pairs(sized, gap).filter(~P.is_skipgram("instance", gap))
        skips = found.withColumnRenamed("pattern", "instance").join(pairs, "instance").withColumnRenamed("template", "pattern")
        return found.select(*columns).unionByName(skips.select(*columns))
    skips = find_skipgrams(corpus, sized, max_n, gap)
    out = found.select(*columns)
    return out if skips is None else out.unionByName(skips.select("sid", "pos", "pattern", F.size("pattern").alias("n")))


def skip_entropy(contents: DataFrame) -> DataFrame:
    """``pattern, cnt, skip_types, entropy`` (bits) of skipgrams from their contents (``pattern, inst, c``)."""
    sums = contents.groupBy("pattern").agg(F.sum("c").alias("cnt"), F.count(F.lit(1)).alias("skip_types"))
    shares = contents.join(sums.select("pattern", "cnt"), "pattern").withColumn("p", F.col("c") / F.col("cnt"))
    entropy = shares.groupBy("pattern").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return sums.join(entropy, "pattern")


def prune_by_alignment(patterns: DataFrame, align: DataFrame, least: float) -> DataFrame:
    """Patterns with some alignment whose score product reaches ``least``."""
    best = align.groupBy("src").agg(F.max(P.product("scores")).alias("b")).filter(F.col("b") >= least)
    return patterns.join(best.select(F.col("src").alias("pattern")), "pattern", "left_semi")

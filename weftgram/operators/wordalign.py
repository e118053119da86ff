"""Word alignments: symmetrisation and extraction of phrase and pattern pairs.

``points`` is ``sid, s, t``, positions from 0. Sentences of either side are ``sid, tokens``.
Repeated points count once; points with nulls or without their sentence are ignored;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgram.functions import patterns as P

#: Neighbours of a point, straight then diagonal (fixed order of growth).
NEIGHBOURS = [(-1, 0), (0, -1), (1, 0), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def clean(points: DataFrame) -> DataFrame:
    return points.select("sid", "s", "t").dropna().distinct()


def union(forward: DataFrame, backward: DataFrame) -> DataFrame:
    return clean(forward).unionByName(clean(backward)).distinct()


def intersection(forward: DataFrame, backward: DataFrame) -> DataFrame:
    return clean(forward).join(clean(backward), ["sid", "s", "t"], "left_semi")


def parse_points(rows: DataFrame, sid: str, text: str) -> DataFrame:
    """``sid, s, t`` of texts of ``s-t`` pairs between blanks; other words are ignored."""
    word = rows.select(F.col(sid).alias("sid"), F.explode(F.split(text, r"[ \t]+")).alias("w")).filter(F.col("w").rlike(r"^[0-9]{1,9}-[0-9]{1,9}$"))
    return word.select("sid", F.split_part("w", F.lit("-"), F.lit(1)).cast("int").alias("s"), F.split_part("w", F.lit("-"), F.lit(2)).cast("int").alias("t"))


def _grow(forward: set, backward: set, final: bool) -> set:
    both = forward | backward
    points = forward & backward
    used_s, used_t = {s for s, _ in points}, {t for _, t in points}
    grown = True
    while grown:
        grown = False
        for s, t in sorted(points):
            for ds, dt in NEIGHBOURS:
                new = (s + ds, t + dt)
                if new in both and new not in points and (new[0] not in used_s or new[1] not in used_t):
                    points.add(new)
                    used_s.add(new[0])
                    used_t.add(new[1])
                    grown = True
    if final:
        for side in (forward, backward):
            for s, t in sorted(side):
                if s not in used_s or t not in used_t:
                    points.add((s, t))
                    used_s.add(s)
                    used_t.add(t)
    return points


def grow_diag(forward: DataFrame, backward: DataFrame, final: bool = False) -> DataFrame:
    """Grow the intersection by neighbouring points of the union; ``final`` adds lone words.

    A point joins if either of its words has none yet. A group is one sentence, at
    most the square of its length in points.
    """
    tagged = clean(forward).withColumn("side", F.lit(0)).unionByName(clean(backward).withColumn("side", F.lit(1)))
    per = tagged.groupBy("sid").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.struct("s", "t")))).alias("f"), F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.struct("s", "t")))).alias("b")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for sid, f, b in rows.itertuples(index=False):
                sets = [{(p["s"], p["t"]) for p in side} for side in (f, b)]
                out += [(sid, s, t) for s, t in sorted(_grow(*sets, final))]
            yield pd.DataFrame(out, columns=["sid", "s", "t"])

    return per.mapInPandas(run, "sid bigint, s int, t int")


def symmetrize(forward: DataFrame, backward: DataFrame, how: str = "grow-diag-final") -> DataFrame:
    ways = {
        "s2t": lambda: clean(forward), "t2s": lambda: clean(backward), "intersection": lambda: intersection(forward, backward), "union": lambda: union(forward, backward),
        "grow-diag": lambda: grow_diag(forward, backward), "grow-diag-final": lambda: grow_diag(forward, backward, True),
    }
    return ways[how]()


def phrase_spans(points: DataFrame, source: DataFrame, target: DataFrame, max_n: int = 7) -> DataFrame:
    """``sid, s_from, s_n, t_from, t_n`` of the consistent phrase pairs.

    A target span goes with the source span of its points if no point leads out of it;
    the source span also widens over words without points at its ends. Target spans are
    made from the points of a sentence by min and max, so no pair of spans is tried.
    """
    pts = clean(points)
    lengths = target.select("sid", F.size("tokens").alias("nt")).join(source.select("sid", F.size("tokens").alias("ns")), "sid")
    held = pts.join(lengths, "sid").filter("s < ns AND t < nt")
    # spans of target words that begin and end anywhere, proposed by the points inside them
    per = held.groupBy("sid").agg(F.first("nt").alias("nt"), F.first("ns").alias("ns"), F.collect_list(F.struct("s", "t")).alias("p"))
    starts = per.select("*", F.explode(P.positions(F.col("nt"))).alias("tb"))
    spans = starts.select("*", F.explode(F.sequence(F.col("tb"), F.least(F.col("nt") - 1, F.col("tb") + max_n - 1))).alias("te"))
    inside = F.filter("p", lambda q: q["t"].between(F.col("tb"), F.col("te")))
    spans = spans.withColumn("in", inside).filter(F.size("in") > 0)
    spans = spans.withColumns({"sb": F.array_min(F.transform("in", lambda q: q["s"])), "se": F.array_max(F.transform("in", lambda q: q["s"]))})
    leads_out = F.exists("p", lambda q: q["s"].between(F.col("sb"), F.col("se")) & ~q["t"].between(F.col("tb"), F.col("te")))
    spans = spans.filter(~leads_out & (F.col("se") - F.col("sb") < max_n))
    low = F.coalesce(F.array_max(F.filter(F.transform("p", lambda q: q["s"]), lambda s: s < F.col("sb"))) + 1, F.lit(0))
    high = F.coalesce(F.array_min(F.filter(F.transform("p", lambda q: q["s"]), lambda s: s > F.col("se"))) - 1, F.col("ns") - 1)
    spans = spans.select("sid", "tb", "te", "sb", "se", low.alias("lo"), high.alias("hi"))
    wide = spans.select("sid", "tb", "te", "se", "hi", F.explode(F.sequence("lo", "sb")).alias("sb"))
    wide = wide.select("sid", "tb", "te", "sb", F.explode(F.sequence("se", "hi")).alias("se")).filter(F.col("se") - F.col("sb") < max_n)
    return wide.select("sid", F.col("sb").alias("s_from"), (F.col("se") - F.col("sb") + 1).alias("s_n"), F.col("tb").alias("t_from"), (F.col("te") - F.col("tb") + 1).alias("t_n"))


def extract_phrases(points: DataFrame, source: DataFrame, target: DataFrame, max_n: int = 7) -> DataFrame:
    """``src, tgt, c``: counts of the consistent phrase pairs."""
    spans = phrase_spans(points, source, target, max_n)
    rows = spans.join(source.select("sid", F.col("tokens").alias("st")), "sid").join(target.select("sid", F.col("tokens").alias("tt")), "sid")
    pairs = rows.select(P.piece("st", F.col("s_from"), F.col("s_n")).alias("src"), P.piece("tt", F.col("t_from"), F.col("t_n")).alias("tgt"))
    return pairs.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("c"))


def supported_pairs(
    points: DataFrame, all_points: DataFrame, s_occ: DataFrame, t_occ: DataFrame, least: float = 0.0, union_bonus: bool = False,
    best_only: bool = True, expand: int = 0, union_weight: float | None = None,
) -> DataFrame:
    """``sid, s_pos, src, t_pos, tgt, score``: pattern occurrences that the alignment supports.

    ``points`` is the intersection, ``all_points`` the union; ``*_occ`` are ``pattern, n, sid, pos``. A pair
    of occurrences needs a point at each of its four corners and none that leads out on
    one side. The score is aligned points / longer length; ``union_bonus`` adds a quarter of
    the further union points' share (1 at most), ``union_weight`` multiplies by that base to the
    number of them. ``best_only`` keeps one target per source occurrence (by score,
    then pattern, then position). ``expand`` widens targets by so many words without points,
    at a penalty.
    """
    s = s_occ.select("sid", F.col("pattern").alias("src"), F.col("n").alias("ns"), F.col("pos").alias("s_pos"))
    t = t_occ.select("sid", F.col("pattern").alias("tgt"), F.col("n").alias("nt"), F.col("pos").alias("t_pos"))
    per = clean(points).groupBy("sid").agg(F.collect_list(F.struct("s", "t")).alias("p"))
    more = clean(all_points).groupBy("sid").agg(F.collect_list(F.struct("s", "t")).alias("u"))
    in_s = lambda q: q["s"].between(F.col("s_pos"), F.col("s_pos") + F.col("ns") - 1)
    in_t = lambda q: q["t"].between(F.col("t_pos"), F.col("t_pos") + F.col("nt") - 1)
    # points of a source occurrence first: without a corner it has no partner
    left = s.join(per, "sid").join(more, "sid", "left")
    left = left.filter(F.exists("p", lambda q: q["s"] == F.col("s_pos")) & F.exists("p", lambda q: q["s"] == F.col("s_pos") + F.col("ns") - 1))
    low = F.array_min(F.transform(F.filter("p", in_s), lambda q: q["t"]))
    high = F.array_max(F.transform(F.filter("p", in_s), lambda q: q["t"]))
    left = left.withColumns({"t_lo": low, "t_hi": high})
    # with a point at both target corners and none leading out, the target span is given
    exact = (F.col("t_pos") == F.col("t_lo")) & (F.col("t_pos") + F.col("nt") - 1 == F.col("t_hi"))
    if expand:
        free = lambda a, b: ~F.exists("p", lambda q: q["t"].between(a, b))
        end = F.col("t_pos") + F.col("nt") - 1
        near = (F.col("t_pos").between(F.col("t_lo") - expand, F.col("t_lo"))) & end.between(F.col("t_hi"), F.col("t_hi") + expand)
        exact = near & free(F.col("t_pos"), F.col("t_lo") - 1) & free(F.col("t_hi") + 1, end)
    rows = left.join(t, "sid").filter(exact)
    crossing = F.exists("p", lambda q: in_t(q) & ~in_s(q))
    rows = rows.filter(~crossing)
    aligned = F.size(F.filter("p", lambda q: in_s(q) & in_t(q)))
    longer = F.greatest("ns", "nt")
    score = F.least(F.lit(1.0), aligned / longer)
    extra = F.greatest(F.lit(0), F.coalesce(F.size(F.filter("u", lambda q: in_s(q) & in_t(q))), F.lit(0)) - aligned)
    if union_bonus:
        score = F.least(F.lit(1.0), score + extra / (4 * longer))
    if union_weight is not None:
        score = score * F.pow(F.lit(union_weight), extra)
    if expand:
        loose = F.col("nt") - (F.col("t_hi") - F.col("t_lo") + 1)
        score = score * (1 - loose / (F.col("ns") + 1))
    rows = rows.select("sid", "s_pos", "src", "t_pos", "tgt", score.alias("score")).filter(F.col("score") >= least)
    if best_only:
        rank = F.row_number().over(Window.partitionBy("sid", "s_pos", "src").orderBy(F.desc("score"), "tgt", "t_pos"))
        rows = rows.withColumn("__r", rank).filter("__r = 1").drop("__r")
    return rows


def recombine(pairs: DataFrame) -> DataFrame:
    """Pairs joined from two that are neighbours on both sides, in one order."""
    a = pairs.select("sid", "s_pos", F.col("src").alias("src_a"), "t_pos", F.col("tgt").alias("tgt_a"), F.col("score").alias("score_a"), (F.col("s_pos") + F.size("src")).alias("s_end"), (F.col("t_pos") + F.size("tgt")).alias("t_end"))
    b = pairs.select("sid", F.col("s_pos").alias("s_end"), F.col("src").alias("src_b"), F.col("t_pos").alias("t_end"), F.col("tgt").alias("tgt_b"), F.col("score").alias("score_b"))
    both = a.join(b, ["sid", "s_end", "t_end"])
    made = both.select("sid", "s_pos", F.concat("src_a", "src_b").alias("src"), "t_pos", F.concat("tgt_a", "tgt_b").alias("tgt"), (F.col("score_a") * F.col("score_b")).alias("score"))
    return made.join(pairs, ["sid", "s_pos", "src", "t_pos", "tgt"], "left_anti")


def pair_counts(pairs: DataFrame, weighted: bool = False, least: float = 0, context: list[str] | None = None) -> DataFrame:
    """``src, tgt, c`` of extracted pairs, counted or weighted by score, by further ``context`` columns on demand."""
    c = F.sum("score") if weighted else F.count(F.lit(1)).cast("double")
    return pairs.groupBy(*(context or []), "src", "tgt").agg(c.alias("c")).filter(F.col("c") >= least)


def matrix_html(points: DataFrame, source: DataFrame, target: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """``sid, html``: a table per sentence pair, a mark in the cell of every point."""
    pairs = source.select("sid", F.col("tokens").alias("st")).join(target.select("sid", F.col("tokens").alias("tt")), "sid")
    if start is not None:
        pairs = pairs.filter(F.col("sid") >= start)
    if end is not None:
        pairs = pairs.filter(F.col("sid") <= end)
    held = clean(points).groupBy("sid").agg(F.collect_set(F.concat_ws("-", "s", "t")).alias("p"))
    rows = pairs.join(held, "sid", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    safe = lambda w: F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = lambda tag, text: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))
    head = F.concat(F.lit("<tr><td></td>"), F.array_join(F.transform("st", lambda w: cell("th", safe(w))), ""), F.lit("</tr>"))
    mark = lambda s, t: F.when(F.array_contains("p", F.concat_ws("-", s.cast("string"), t.cast("string"))), "x").otherwise("")
    line = lambda w, t: cell("tr", F.concat(cell("th", safe(w)), F.array_join(F.transform("st", lambda _, s: cell("td", mark(s, t))), "")))
    return rows.select("sid", F.concat(F.lit("<table>"), head, F.array_join(F.transform("tt", line), ""), F.lit("</table>")).alias("html"))

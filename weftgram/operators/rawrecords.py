"""Loading delimited raw lines while separating the ones that fail to parse.

A ``Schema`` lists the fields of a row. From it come one anchored expression for
the whole row and, for rows that do not match, a ladder of expressions for ever
longer prefixes of fields; the first rung that fails names the broken field. Rows
that match are then held against the limits of their values. All of it runs as
built-in expressions inside the JVM.

Every loop of the expressions is possessive and no two of its ways match the same
text, so a line of any length takes one pass and no call stack.

Defined results for edge cases: a null line fails with ``null line``; a row with
a null ``line_id`` is passed on and, where sections count, has none above it; an
empty table gives empty frames; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"


@dataclass(frozen=True)
class Field:
    """A field and the expression of its values, without the blanks around them.

    ``value`` None stands for any text that is not blank. An ``optional`` field may be
    blank or, at the end of a row, be missing.
    """

    name: str
    value: str | None = None
    fault: str = "empty"
    optional: bool = False


@dataclass(frozen=True)
class Schema:
    """Fields between separators. ``quoted`` allows a field wholly in quotes, with ``""`` for one inside."""

    fields: tuple[Field, ...]
    separator: str
    blanks: str
    quoted: bool = False

    @property
    def blank(self) -> str:
        return f"[{self.blanks}]"

    def _char(self, without: str = "") -> str:
        """One character that neither opens a separator nor is among ``without``."""
        without = '"' + without if self.quoted else without
        if re.fullmatch(r"\\?.", self.separator):
            return f"[^{without}{self.separator}]"
        return f"(?!{self.separator})" + (f"[^{without}]" if without else r"[\s\S]")

    def any(self) -> str:
        """Whatever may stand in the place of a field."""
        bare = f"(?:{self._char()})*+"
        return rf'(?:{self.blank}*+"(?:[^"]|"")*+"{self.blank}*+|{bare})' if self.quoted else bare

    def valid(self, field: Field) -> str:
        """A valid value with the blanks around it."""
        b = self.blank
        ways = (field.value or f"{self._char(self.blanks)}(?:{self._char()})*+") + f"{b}*+"
        if self.quoted:
            text = field.value or rf'(?:[^"{self.blanks}]|"")(?:[^"]|"")*+'
            ways = rf'(?:{ways}|"{b}*+{text}{b}*+"{b}*+)'
        return rf"{b}*+(?:{ways})?+" if field.optional else rf"{b}*+{ways}"

    def whole(self) -> str:
        """The anchored expression of a valid row."""
        row = ""
        for i, field in enumerate(self.fields):
            part = (self.separator if i else "") + self.valid(field)
            row += rf"(?:{part})?+" if field.optional else part
        return rf"^{row}\z"

    def parts(self) -> str:
        """The anchored expression of a row with a group for each field."""
        return "^" + self.separator.join(f"({self.any()})" for _ in self.fields) + r"\z"

    def ladder(self) -> list[tuple[str, str]]:
        """Prefix expressions in order; the reason is that of the first that does not match.

        Of every field in turn: its quoting, what must follow its place, its value.
        """
        rungs, sep = [], self.separator
        close = rf"(?:{sep}|\z)"
        for i, field in enumerate(self.fields):
            before = "^" + (self.any() + sep) * i
            # where an optional field is absent nothing of it can fail
            absent = rf"|^{sep.join([self.any()] * i)}\z" if field.optional else ""
            if self.quoted:
                rungs.append((f"{before}{self.any()}{close}{absent}", f"{field.name}: broken quoting"))
            if i + 1 == len(self.fields):
                rungs.append((rf"{before}{self.any()}\z{absent}", "too many fields"))
            elif not self.fields[i + 1].optional:
                rungs.append((before + self.any() + sep, f"{self.fields[i + 1].name}: missing"))
            rungs.append((f"{before}{self.valid(field)}{close}{absent}", f"{field.name}: {field.fault}"))
        return rungs

    def fault(self, line: Column) -> Column:
        """Why a row does not match; null if it does."""
        rungs = F.when(line.isNull(), F.lit("null line"))
        for pattern, reason in self.ladder():
            rungs = rungs.when(~line.rlike(pattern), F.lit(reason))
        return F.when(~F.coalesce(line.rlike(self.whole()), F.lit(False)), F.coalesce(rungs, F.lit("whole row does not match")))


PHRASES = Schema(
    (Field("source"), Field("target"), Field("scores", rf"{NUMBER}(?:[ \t\r]++{NUMBER}){{0,4}}+", "not one to five numbers")),
    separator=r"\|\|\|", blanks=r" \t\r", quoted=True,
)
ENTRIES = Schema(
    (Field("logprob", NUMBER, "not a number"), Field("ngram"), Field("backoff", NUMBER, "not a number", optional=True)),
    separator=r"\t", blanks=r" \r",
)


def parse_phrase_lines(raw: DataFrame) -> DataFrame:
    """Parse ``source ||| target ||| scores`` lines.

    Returns ``line_id, source, target, scores, reason``; ``reason`` is null for a
    loaded row, and the three fields are null for a failing one.
    """
    line = F.col("line")
    parsed = raw.select("line_id", "line", PHRASES.fault(line).alias("__fault"))
    whole = F.col("__fault").isNull()
    # without quotes the fields are what lies between the separators
    split, bare = F.split("line", PHRASES.separator), ~F.contains("line", F.lit('"'))
    for i, name in enumerate(("source", "target", "__scores")):
        field = F.when(bare, F.get(split, F.lit(i))).otherwise(F.regexp_extract("line", PHRASES.parts(), i + 1))
        field = F.btrim(F.when(whole, field), F.lit(" \t\r"))
        inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
        parsed = parsed.withColumn(name, F.when(field.startswith('"'), inner).otherwise(field))
    numbers = F.expr(r"transform(filter(split(__scores, '[ \\t\\r]+'), x -> x <> ''), x -> try_cast(x AS double))")
    parsed = parsed.withColumn("scores", numbers)
    in_range = F.forall("scores", lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    out = parsed.withColumn("reason", F.when(~whole, F.col("__fault")).when(~in_range, F.lit("scores: not within 0 and 1")))
    good = F.col("reason").isNull()
    return out.select("line_id", *(F.when(good, F.col(c)).alias(c) for c in ("source", "target", "scores")), "reason")


LM_STRUCTURE = r"^(?:\\data\\|ngram [0-9]++=[0-9]++|\\[0-9]++-grams:|\\end\\)?+[ \t\r]*+\z"
LM_HEADER = r"^\\([0-9]++)-grams:[ \t\r]*+\z"

#: Lines of a file carried in one block when the section order is filled down.
BLOCK_LINES = 1 << 16


def with_section_order(raw: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Add ``k``, the order of the last ``\\k-grams:`` header above in the file.

    A file may hold any share of all rows, so the fill-down works in two levels:
    within blocks of ``block_lines`` line ids, and over one row per block. No
    window ever covers more than a block's lines or a file's block count. Lines
    without a number are dealt out by their text and get no order.
    """
    k = F.expr(r"try_cast(nullif(regexp_extract(line, '%s', 1), '') AS int)" % LM_HEADER.replace("\\", "\\\\"))
    placed = F.col("line_id").isNotNull()
    block = F.coalesce(F.floor(F.col("line_id") / block_lines), -1 - F.pmod(F.xxhash64("line"), F.lit(1 << 20)))
    rows = raw.select("line_id", "file_no", "line", block.alias("__block"), F.when(placed, k).alias("__k"))
    per_block = rows.groupBy("file_no", "__block").agg(
        F.max_by("__k", F.when(F.col("__k").isNotNull(), F.col("line_id"))).alias("__last")
    )
    before = Window.partitionBy("file_no").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        F.col("file_no").alias("__cf"),
        F.col("__block").alias("__cb"),
        F.last("__last", ignorenulls=True).over(before).alias("__carry"),
    )
    within = Window.partitionBy("file_no", "__block").orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__own", F.last("__k", ignorenulls=True).over(within))
    joined = filled.join(carry, F.col("file_no").eqNullSafe(F.col("__cf")) & F.col("__block").eqNullSafe(F.col("__cb")), "left")
    return joined.select("line_id", "file_no", "line", F.when(placed, F.coalesce("__own", "__carry")).alias("k"))


def parse_lm_lines(raw: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Parse language-model lines of the sectioned text format.

    Returns ``line_id, file_no, k, ngram, logprob, backoff, kind, reason``; ``kind``
    is ``structure``, ``entry`` or ``failed``.
    """
    line, k = F.col("line"), F.col("k")
    rows = with_section_order(raw, block_lines)
    structure = F.coalesce(line.rlike(LM_STRUCTURE), F.lit(False))
    rows = rows.withColumn("__structure", structure).withColumn("__fault", F.when(~F.col("__structure"), ENTRIES.fault(line)))
    whole = ~F.col("__structure") & F.col("__fault").isNull()
    field = lambda i: F.btrim(F.get(F.split(line, ENTRIES.separator), F.lit(i)), F.lit(" \r"))
    number = lambda i: F.when(whole, F.nullif(field(i), F.lit("")).try_cast("double"))
    rows = rows.withColumns({"__p": number(0), "__g": F.when(whole, F.split(field(1), " +")), "__b": number(2)})
    infinite = lambda c: F.abs(c) == F.lit(float("inf"))
    limits = (
        F.when(k.isNull(), "ngram: no section above")
        .when(F.size("__g") != k, "ngram: wrong number of words")
        .when(infinite(F.col("__p")), "logprob: not finite")
        .when(F.col("__p") > 0, "logprob: above 0")
        .when(infinite(F.col("__b")), "backoff: not finite")
    )
    rows = rows.withColumn("reason", F.when(~F.col("__structure"), F.coalesce("__fault", limits)))
    kind = F.when(F.col("__structure"), "structure").when(F.col("reason").isNull(), "entry").otherwise("failed")
    rows = rows.withColumn("kind", kind)
    entry = F.col("kind") == "entry"
    return rows.select(
        "line_id", "file_no", F.when(entry, k).alias("k"), F.when(entry, F.array_join("__g", " ")).alias("ngram"),
        F.when(entry, F.col("__p")).alias("logprob"), F.when(entry, F.col("__b")).alias("backoff"), "kind", "reason",
    )


def failing_lines(phrase_raw: DataFrame, lm_raw: DataFrame) -> DataFrame:
    """``raw_table, line_id, reason`` of every line that does not parse."""
    phrases = parse_phrase_lines(phrase_raw).filter("reason IS NOT NULL")
    entries = parse_lm_lines(lm_raw).filter("kind = 'failed'")
    return phrases.select(F.lit("phrasetable_raw").alias("raw_table"), "line_id", "reason").unionByName(
        entries.select(F.lit("lm_raw").alias("raw_table"), "line_id", "reason")
    )

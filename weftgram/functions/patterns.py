"""Column expressions on patterns.

A pattern is an array of tokens: class numbers (gap 0, unknown 2, begin 3, end 4)
or words (gap ``{*}``). Every function takes the gap token, ``GAP`` by default, and
runs as built-in expressions inside the JVM. A null pattern gives null; an empty
one has length 0 and no parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP, UNKNOWN, BEGIN, END = 0, 2, 3, 4
#: The gap token of patterns of words.
WORD_GAP = "{*}"
FIRST_CLASS = 6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positions(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0, where ``sequence`` would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def length(p: Column | str) -> Column:
    return F.size(col(p))


def piece(p: Column | str, begin: Column | int, n: Column | int) -> Column:
    """n tokens from index begin (0-based)."""
    begin = begin if isinstance(begin, Column) else F.lit(begin)
    return F.slice(col(p), begin + 1, n)


def token(p: Column | str, index: Column | int, gap=GAP, unknown=UNKNOWN) -> Column:
    """Token at an index; a gap reads as unknown, outside the pattern as null."""
    index = index if isinstance(index, Column) else F.lit(index)
    t = F.get(col(p), index)
    return F.when(t == F.lit(gap), F.lit(unknown)).otherwise(t)


def windows(tokens: Column | str, n: Column | int) -> Column:
    """Every n-gram of a sentence in order."""
    tokens = col(tokens)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.transform(positions(F.size(tokens) - n + 1), lambda i: F.slice(tokens, i + 1, n))


def subngrams(p: Column | str) -> Column:
    """All proper contiguous sub-n-grams, by length then index, repeats kept."""
    p = col(p)
    return F.flatten(F.transform(positions(F.size(p) - 1), lambda n: windows(p, n + 1)))


def splits(p: Column | str) -> Column:
    """All divisions into a left and a right part."""
    p = col(p)
    return F.transform(positions(F.size(p) - 1), lambda i: F.struct(F.slice(p, F.lit(1), i + 1).alias("left"), F.slice(p, i + 2, F.size(p)).alias("right")))


def contains(p: Column | str, part: Column | str) -> Column:
    """Whether part occurs in p as a run of tokens."""
    p, part = col(p), col(part)
    return F.exists(positions(F.size(p) - F.size(part) + 1), lambda i: F.slice(p, i + 1, F.size(part)) == part)


def matches_at(sentence: Column | str, pattern: Column | str, begin: Column | int, gap=GAP) -> Column:
    """Whether pattern, its gaps free, stands in the sentence at begin."""
    sentence, pattern = col(sentence), col(pattern)
    begin = begin if isinstance(begin, Column) else F.lit(begin)
    there = F.slice(sentence, begin + 1, F.size(pattern))
    fits = F.forall(F.zip_with(there, pattern, lambda a, b: F.coalesce((b == F.lit(gap)) | (a == b), F.lit(False))), lambda x: x)
    return (begin + F.size(pattern) <= F.size(sentence)) & fits


def mask(p: Column | str, gap=GAP) -> Column:
    """True for tokens, false for gap positions."""
    return F.transform(col(p), lambda x: x != F.lit(gap))


def is_skipgram(p: Column | str, gap=GAP) -> Column:
    return F.array_contains(col(p), F.lit(gap))


def gap_ratio(p: Column | str, gap=GAP) -> Column:
    p = col(p)
    return F.when(F.size(p) > 0, F.size(F.filter(p, lambda x: x == F.lit(gap))) / F.size(p))


def _spans(p: Column, gap, of_gaps: bool) -> Column:
    """(begin, length) of the runs of gaps, or of tokens."""
    inside = lambda i: (F.get(p, i) == F.lit(gap)) == F.lit(of_gaps)
    at = positions(F.size(p))
    starts = F.filter(at, lambda i: inside(i) & ((i == 0) | ~F.coalesce(inside(i - 1), F.lit(False))))
    ends = F.filter(at, lambda i: inside(i) & ((i == F.size(p) - 1) | ~F.coalesce(inside(i + 1), F.lit(False))))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("begin"), (e - s + 1).alias("length")))


def gap_spans(p: Column | str, gap=GAP) -> Column:
    return _spans(col(p), gap, True)


def part_spans(p: Column | str, gap=GAP) -> Column:
    return _spans(col(p), gap, False)


def gap_count(p: Column | str, gap=GAP) -> Column:
    return F.size(gap_spans(p, gap))


def parts(p: Column | str, gap=GAP) -> Column:
    """The runs of tokens between gaps."""
    p = col(p)
    return F.transform(part_spans(p, gap), lambda s: F.slice(p, s["begin"] + 1, s["length"]))


def fillers(instance: Column | str, skipgram: Column | str, gap=GAP) -> Column:
    """What an instance has in each gap of a skipgram."""
    instance = col(instance)
    return F.transform(gap_spans(skipgram, gap), lambda s: F.slice(instance, s["begin"] + 1, s["length"]))


def skip_content(instance: Column | str, skipgram: Column | str, gap=GAP) -> Column:
    """Content of the gaps as one pattern: tokens between gaps become gaps, none at the ends."""
    instance, skipgram = col(instance), col(skipgram)
    full = F.zip_with(instance, skipgram, lambda x, y: F.when(y == F.lit(gap), x).otherwise(F.lit(gap)))
    spans = gap_spans(skipgram, gap)
    first, last = F.get(spans, F.lit(0)), F.get(spans, F.size(spans) - 1)
    return F.slice(full, first["begin"] + 1, last["begin"] + last["length"] - first["begin"])


def punch(instance: Column | str, gap_mask: Column | str, gap=GAP) -> Column:
    """Replace the positions whose mask is 1 by gaps."""
    return F.zip_with(col(instance), col(gap_mask), lambda x, m: F.when(m == 1, F.lit(gap)).otherwise(x))


def instantiate(skipgram: Column | str, content: Column | str, gap=GAP) -> Column:
    """Fill the gaps of a skipgram with a content of ``skip_content``."""
    skipgram, content = col(skipgram), col(content)
    first = F.get(gap_spans(skipgram, gap), F.lit(0))["begin"]
    return F.transform(skipgram, lambda x, i: F.when(x == F.lit(gap), F.get(content, i - first)).otherwise(x))


def skipgram_of(parts_: Column | str, gaps: Column | str, begins_with_gap: Column | bool, gap=GAP) -> Column:
    """The skipgram of given parts and gap sizes, one after the other in turn.

    Null where they cannot alternate: there must be as many of both, or one more of what
    comes first, and no part or gap may be empty.
    """
    parts_, gaps = col(parts_), col(gaps)
    first = begins_with_gap if isinstance(begins_with_gap, Column) else F.lit(begins_with_gap)
    blanks = F.transform(gaps, lambda k: F.array_repeat(F.lit(gap), k))
    ahead, behind = F.when(first, blanks).otherwise(parts_), F.when(first, parts_).otherwise(blanks)
    woven = F.flatten(F.transform(ahead, lambda x, i: F.when(i < F.size(behind), F.concat(x, F.get(behind, i))).otherwise(x)))
    fits = (F.size(ahead) - F.size(behind)).between(0, 1) & F.forall(gaps, lambda k: k > 0) & F.forall(parts_, lambda p: F.size(p) > 0)
    return F.when(fits, woven)


def template_relation(a: Column | str, b: Column | str, gap=GAP) -> Column:
    """1 if a is an instance of template b, -1 the other way round, else 0."""
    a, b = col(a), col(b)
    one_side = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: (p == q) | (q == F.lit(gap))), lambda t: t)
    same_size = F.size(a) == F.size(b)
    return F.when(~same_size | (a == b), 0).when(one_side(a, b), 1).when(one_side(b, a), -1).otherwise(0)


def has_unknown(p: Column | str, unknown=UNKNOWN) -> Column:
    return F.array_contains(col(p), F.lit(unknown))


def with_context(tokens: Column | str, begin: Column, n: Column, left: int, right: int, bos=BEGIN, eos=END) -> Column:
    """A pattern of a sentence with its neighbours, padded by begin and end marks."""
    tokens = col(tokens)
    before = F.concat(F.array_repeat(F.lit(bos), left), F.slice(tokens, F.lit(1), begin))
    after = F.concat(F.slice(tokens, begin + n + 1, F.size(tokens)), F.array_repeat(F.lit(eos), right))
    return F.concat(F.slice(before, F.size(before) - left + 1, F.lit(left)), F.slice(tokens, begin + 1, n), F.slice(after, F.lit(1), F.lit(right)))


def product(scores: Column | str) -> Column:
    return F.aggregate(col(scores), F.lit(1.0), lambda a, x: a * x)


def total(scores: Column | str) -> Column:
    return F.aggregate(col(scores), F.lit(0.0), lambda a, x: a + x)


def render_words(p: Column | str) -> Column:
    """Text of a pattern of words; runs of gap tokens become ``{*k*}``."""
    p = col(p)
    marked = F.transform(
        p,
        lambda x, i: F.when(x != WORD_GAP, x).when(
            (i == 0) | (F.get(p, i - 1) != WORD_GAP),
            # the run that starts here ends before the next token
            F.concat(F.lit("{*"), F.coalesce(F.array_min(F.filter(positions(F.size(p)), lambda j: (j > i) & (F.get(p, j) != WORD_GAP))), F.size(p)) - i, F.lit("*}")),
        ),
    )
    return F.array_join(F.filter(marked, lambda x: x.isNotNull()), " ")


def parse_words(text: Column | str) -> Column:
    """Tokens of a query text; ``{*k*}`` becomes k gap tokens."""
    words = F.filter(F.split(col(text), " "), lambda w: w != "")
    gap = lambda w: F.regexp_extract(w, r"^\{\*([0-9]+)\*\}$", 1)
    return F.flatten(F.transform(words, lambda w: F.when(gap(w) != "", F.array_repeat(F.lit(WORD_GAP), gap(F.when(gap(w) != "", w).otherwise("{*1*}")).cast("int"))).otherwise(F.array(w))))


def valid_class(cls: Column | str) -> Column:
    """Whether a class number has no zero byte, as the compact byte form requires."""
    c = col(cls)
    return (c % 256 != 0) & ((c < 65536) | (F.shiftright(c, 8) % 256 != 0)) & ((c < (1 << 24)) | (F.shiftright(c, 16) % 256 != 0))


def class_bytes(cls: Column | str) -> Column:
    """Little-endian bytes of a class number."""
    hexed = F.lpad(F.hex(col(cls).cast("bigint")), 8, "0")
    swapped = F.concat(*(F.substring(hexed, i, 2) for i in (7, 5, 3, 1)))
    return F.unhex(F.regexp_replace(swapped, "(00)+$", ""))

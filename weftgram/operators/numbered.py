"""Mining and finding of n-grams and skipgrams on numbered words, in Arrow batches.

Only frequent words are numbered. A window is the pair of the numbers of its two shorter
parts, so a level is counted by one number a window and its distinct windows alone are
shuffled. Words and frequent patterns of a level travel with the tasks: their bytes are
added up first, and where they are too many ``mine`` gives None and the caller
counts the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgram.functions.gaps import gap_masks
from weftgram.runtime import cut_lineage, is_small, small

#: Codes: nothing (an unknown word, behind the end), a gap, words from FIRST on. Three make a long, two longs a pattern.
BITS, GAP_CODE, FIRST, MAX_N = 21, 1, 2, 6
#: Tokens worked on at once.
CHUNK = 1 << 20
#: Patterns up to which all of them are sent to every task, as four bytes a token.
MOST_PATTERNS = 4 << 20


@dataclass(frozen=True)
class Numbered:
    """Tables of a mined model: ``grams`` (pattern, n, cnt), ``contents`` (pattern, inst, c), ``skips`` (pattern, cnt).

    ``codes`` has all patterns as ``ph, pl``, to be sent to the tasks that look for them; ``words`` what the codes mean.
    """

    grams: DataFrame
    skips: DataFrame
    contents: DataFrame
    codes: DataFrame
    words: Broadcast
    text: DataFrame
    gap: str
    windows: list[DataFrame]
    levels: list[np.ndarray]
    spelling: list[np.ndarray]

    def index(self) -> tuple[DataFrame, DataFrame] | None:
        """Numbered windows of the sentences (see ``occurrences``), and what the numbers are: ``n, id, pattern, c``.

        A row has about CHUNK tokens: the sentence numbers and of each length the number of the window that begins
        at each token, 0 for none, as compressed ints; in ``g1`` -1 ends a sentence. Windows are the n-grams and all that may fill a skipgram. None where they are too many to be sent.
        """
        if any(w.count() > MOST_PATTERNS for w in self.windows):
            return None
        sc = self.text.sparkSession.sparkContext
        keys = [np.sort(w.select("key").toArrow()["key"].to_numpy()) for w in self.windows]
        sent, words, gap, top = sc.broadcast((self.levels, keys)), self.words, self.gap, len(keys) + 1

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, known = sent.value
            for flat, sids in texts(batches, words.value, gap, True):
                ids, out = np.maximum(flat, 0).astype(np.int64), [sids, flat]
                for n in range(2, top + 1):
                    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                    pairs = ids[at] << 32 | ids[at + 1]
                    now, ids = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int64)
                    now[at] = lookup(known[n - 2], pairs) + 1
                    if n - 2 < len(levels):
                        ids[at] = lookup(levels[n - 2], pairs) + 1
                    out.append(now)
                data = [pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array([len(sids)]), pa.array([len(flat)]), *data], names)

        names = ["sentences", "places", "sids", *(f"g{n}" for n in range(1, top + 1))]
        found = self.text.mapInArrow(number, "sentences bigint, places bigint, " + ", ".join(f"{x} binary" for x in names[2:]))
        parts = None
        for k, rows in enumerate(self.windows):
            sizes = sc.broadcast((keys[k], self.spelling[k]))

            def spell(batches: Iterator[pa.RecordBatch], sizes: Broadcast = sizes) -> Iterator[pa.RecordBatch]:
                known, of = sizes.value
                for b in batches:
                    key = column(b, "key")
                    yield pa.RecordBatch.from_arrays([pa.array((lookup(known, key) + 1).astype(np.int32)), *map(pa.array, packed(joined(of, key))), b["c"]], ["id", "ph", "pl", "c"])

            part = spelled(rows.mapInArrow(spell, "id int, ph bigint, pl bigint, c bigint"), words, gap, pattern="p").select(F.lit(k + 2).alias("n"), "id", "pattern", "c")
            parts = part if parts is None else parts.unionByName(part)

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(word_codes(words.value, gap)[1:][pc.index_in(b["word"], value_set=words.value).to_numpy(zero_copy_only=False)]), b["word"], b["c"]], ["id", "word", "c"])

        ones = self.grams.filter("n = 1").select(F.get("pattern", F.lit(0)).alias("word"), F.col("cnt").alias("c")).mapInArrow(single, "id int, word string, c bigint")
        return found, ones.select(F.lit(1).alias("n"), "id", F.array("word").alias("pattern"), "c").unionByName(parts)


def occurrences(sentences: DataFrame) -> DataFrame:
    """``n, id, sid, pos`` of the numbered windows of ``Numbered.index``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                get = lambda name, size, kind: np.frombuffer(pa.decompress(b[name][i].as_buffer(), size * np.dtype(kind).itemsize, "zstd"), kind)  # noqa: B023, E731
                size = b["places"][i].as_py()
                ends = np.flatnonzero(get("g1", size, np.int32) < 0)
                lengths = np.diff(ends, prepend=-1)
                sids = np.repeat(get("sids", b["sentences"][i].as_py(), np.int64), lengths)
                pos = (np.arange(size) - np.repeat(ends - lengths + 1, lengths)).astype(np.int32)
                for name in b.schema.names[3:]:
                    ids = get(name, size, np.int32)
                    at = np.flatnonzero(ids > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), int(name[1:]), np.int32)), *(pa.array(x[at]) for x in (ids, sids, pos))], ["n", "id", "sid", "pos"])

    return sentences.mapInArrow(read, "n int, id int, sid bigint, pos int")


def lists(batches: Iterator[pa.RecordBatch], tokens: str = "tokens") -> Iterator[tuple[pa.Table, pa.Array, np.ndarray]]:
    """Rows of about CHUNK tokens at a time, their tokens in one array and the length of each list."""

    def whole(held: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Array, np.ndarray]:
        table = pa.Table.from_batches(held)
        column = pa.concat_arrays(table[tokens].chunks)
        return table, column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch[tokens].flatten())
        if n >= CHUNK:
            yield whole(held)
            held, n = [], 0
    if n:
        yield whole(held)


def coded(values: pa.Array, lengths: np.ndarray, words: pa.Array, gap: str, end: int) -> np.ndarray:
    """Codes of the tokens, 0 for unknown ones, and ``end`` behind each sentence."""
    out = np.full(len(values) + len(lengths), end, np.int32)
    out[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = word_codes(words, gap)[numbers(values, words) + 1]
    return out


def word_codes(words: pa.Array, gap: str) -> np.ndarray:
    """Codes of an unknown word and of the words."""
    of = np.arange(FIRST - 1, len(words) + FIRST, dtype=np.int32)
    of[0] = 0
    of[1:][pc.equal(words, gap).to_numpy(zero_copy_only=False)] = GAP_CODE
    return of


def numbers(values: pa.Array, words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=words), -1).to_numpy(zero_copy_only=False)


def joined(shorter: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Codes of windows from those of their two parts."""
    return np.hstack([shorter[keys >> 32], shorter[keys & 0xFFFFFFFF][:, -1:]])


def lookup(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in the sorted keys, -1 where absent; repeated questions are asked once."""
    codes, unique = pd.factorize(asked)
    if not len(keys) or not len(unique):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
    return np.where(keys[at] == unique, at, -1)[codes]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    codes, unique = pd.factorize(k)
    return unique, np.bincount(codes, c, len(unique)).astype(np.int64)


def window_keys(flat: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Pairs of the numbers of the shorter parts, of each window both parts of which are frequent."""
    ids = flat.astype(np.int64)
    for known in [*levels, None]:
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        keys = ids[at] << 32 | ids[at + 1]
        if known is not None:
            ids = np.zeros(len(ids), np.int64)
            ids[at] = lookup(known, keys) + 1
    return keys


def packed(codes: np.ndarray) -> list[np.ndarray]:
    """Two longs of a matrix of codes."""
    wide = np.zeros((len(codes), MAX_N), np.int64)
    wide[:, : codes.shape[1]] = codes
    return [wide[:, k] << 2 * BITS | wide[:, k + 1] << BITS | wide[:, k + 2] for k in (0, 3)]


def unpacked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.stack([x >> s & (1 << BITS) - 1 for x in (high, low) for s in (2 * BITS, BITS, 0)], 1)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def spelled(rows: DataFrame, words: Broadcast, gap: str, **names: str) -> DataFrame:
    """Lists of words, named as asked, for packed patterns of the given prefix; other columns stay."""
    inner = [f for f in rows.schema if f.name not in {p + x for p in names.values() for x in "hl"}]
    schema = ", ".join([*(f"{k} array<string>" for k in names), *(f"{f.name} {f.dataType.simpleString()}" for f in inner)])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.concat_arrays([pa.array(["", gap]), words.value])
        for b in batches:
            out = []
            for p in names.values():
                codes = unpacked(column(b, p + "h"), column(b, p + "l"))
                ends = np.concatenate([[0], np.cumsum((codes > 0).sum(1))]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(ends, known.take(pa.array(codes[codes > 0]))))
            yield pa.RecordBatch.from_arrays([*out, *(b[f.name] for f in inner)], [*names, *(f.name for f in inner)])

    return rows.mapInArrow(spell, schema)


def stored(corpus: DataFrame) -> DataFrame:
    """A row for about CHUNK tokens, so that sentences are split into words once: their words and how often each occurs, the place of each token's word, 0 behind a sentence, and sentence numbers."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, values, lengths in lists(batches):
            held = values.dictionary_encode()
            at = np.zeros(len(values) + len(lengths), np.int32)
            at[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = pc.fill_null(held.indices, -2).to_numpy(zero_copy_only=False) + 1
            seen = np.bincount(at[at > 0] - 1, minlength=len(held.dictionary))
            sids = table["sid"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (held.dictionary, pa.array(seen.astype(np.int64)))), *(pa.array([x]) for b in (at, sids) for x in (pa.compress(b.tobytes(), "zstd", asbytes=True), b.nbytes))],
                ["words", "seen", "places", "size", "sids", "sids_size"],
            )

    return corpus.select(F.col("sid").cast("bigint").alias("sid"), "tokens").mapInArrow(store, "words array<string>, seen array<bigint>, places binary, size bigint, sids binary, sids_size bigint")


def texts(batches: Iterator[pa.RecordBatch], words: pa.Array, gap: str, numbered: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Codes of stored text with 0 behind each sentence or, with the sentence numbers, -1."""
    of = word_codes(words, gap)
    for b in batches:
        for i in range(len(b)):
            local = np.concatenate([[-1 if numbered else 0], of[numbers(b["words"][i].values, words) + 1], [0]]).astype(np.int32)
            get = lambda name, size, kind: np.frombuffer(pa.decompress(b[name][i].as_buffer(), b[size][i].as_py(), "zstd"), kind)  # noqa: B023, E731
            yield local[get("places", "size", np.int32)], get("sids", "sids_size", np.int64) if numbered else None


def word_counts(text: DataFrame, least: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["words"].flatten(), b["seen"].flatten()], ["word", "c"])

    rows = text.select("words", "seen").mapInArrow(count, "word string, c bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("cnt")).filter((F.col("cnt") >= least) & F.col("word").isNotNull())


def mine(corpus: DataFrame, max_n: int, least: int, skip_least: int, types: int, gap: str, masks: Callable[[int], list[tuple[int, ...]]] = gap_masks) -> Numbered | None:
    """The model of ``mining.mine`` with skipgrams, or None where it can't be made this way.

    A skipgram that passes by its contents of ``skip_least`` occurrences passes by all its
    contents, so rarer windows give no contents. ``types`` different tokens in a gap, up to
    two, show in the bits that are not the same in all.
    """
    if dict(corpus.dtypes)["tokens"] != "array<string>" or max_n > MAX_N or not 1 <= types <= 2 or not 1 <= skip_least <= least:
        return None
    corpus, sc = corpus.filter(F.size("tokens") >= 1), corpus.sparkSession.sparkContext
    text = cut_lineage(stored(corpus))
    counts = cut_lineage(word_counts(text, least))
    if not is_small(counts) or not 0 < (found := counts.select("word").toArrow()).num_rows < (1 << BITS) - FIRST:
        return None
    words = sc.broadcast(pa.concat_arrays(found["word"].chunks))

    #: Of each length the sorted pairs and, by number, the codes of the frequent patterns.
    levels, spelling, windows = [], [np.arange(found.num_rows + FIRST, dtype=np.int32)[:, None]], []
    for n in range(2, max_n + 1):
        sent = sc.broadcast(levels[:])

        def count(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            keys, seen, held = [], [], 0
            for flat, _ in texts(batches, words.value, gap):
                places, k = pd.factorize(window_keys(flat, sent.value))
                keys.append(k)
                seen.append(np.bincount(places, minlength=len(k)))
                held += len(k)
                if held > 4 * CHUNK:
                    k, c = summed(keys, seen)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "c"])
                    keys, seen, held = [], [], 0
            if held:
                k, c = summed(keys, seen)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "c"])

        rows = text.select("words", "places", "size").mapInArrow(count, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))
        rows = cut_lineage(rows.filter(F.col("c") >= skip_least))
        known = rows.filter(F.col("c") >= least).select("key")
        if not is_small(known):
            return None
        windows.append(rows)
        keys = np.sort(np.concatenate([np.zeros(0, np.int64), *(x.to_numpy() for x in known.toArrow()["key"].chunks)]))
        if not len(keys):
            break
        shorter = spelling[-1]
        levels.append(keys)
        spelling.append(np.concatenate([np.zeros((1, n), np.int32), joined(shorter, keys)]))

    def coded_windows(k: int, skipgrams: bool) -> DataFrame:
        """``ph, pl, c`` of the windows of length k + 2 or, with gaps in every way, ``ph, pl, ih, il, c``."""
        sent, holes = sc.broadcast(spelling[k]), np.array(masks(k + 2), bool)

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, c, of = column(b, "key"), column(b, "c"), sent.value
                inst = joined(of, keys)
                if not skipgrams:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, packed(inst)), pa.array(c)], ["ph", "pl", "c"])
                    continue
                whole = packed(inst)
                for m in holes:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, packed(np.where(m, GAP_CODE, inst))), *map(pa.array, whole), pa.array(c)], ["ph", "pl", "ih", "il", "c"])

        rows = windows[k] if skipgrams else windows[k].filter(F.col("c") >= least)
        return rows.mapInArrow(expand, "ph bigint, pl bigint, ih bigint, il bigint, c bigint" if skipgrams else "ph bigint, pl bigint, c bigint")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if not windows:
        return None
    punched = union([coded_windows(k, True) for k in range(len(windows))])
    both = [F.bit_or(x).bitwiseXOR(F.bit_and(x)).alias(f"{x}_differ") for x in ("ih", "il")]
    sums = punched.groupBy("ph", "pl").agg(F.sum("c").alias("cnt"), F.count(F.lit(1)).alias("k"), *both)
    kept = (F.col("cnt") >= least) & (F.col("k") >= types)
    if types == 2:
        at = lambda c, s: F.shiftright(c, s).bitwiseAND(F.lit((1 << BITS) - 1))
        for p, d in (("ph", "ih_differ"), ("pl", "il_differ")):
            for s in (2 * BITS, BITS, 0):
                kept &= (at(p, s) != GAP_CODE) | (at(d, s) != 0)
    skips = cut_lineage(sums.filter(kept).select("ph", "pl", "cnt"))
    contents = punched.join(small(skips.select("ph", "pl")), ["ph", "pl"], "left_semi")
    longer = union([coded_windows(k, False) for k in range(len(windows))])
    number = F.size("pattern")
    grams = counts.select(F.array("word").alias("pattern"), F.lit(1).alias("n"), "cnt")
    grams = grams.unionByName(spelled(longer, words, gap, pattern="p").select("pattern", number.alias("n"), F.col("c").alias("cnt")))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = coded(b["word"], np.ones(len(b), np.int64), words.value, gap, 0)[::2]
            yield pa.RecordBatch.from_arrays([*map(pa.array, packed(codes[:, None]))], ["ph", "pl"])

    codes = counts.select("word").mapInArrow(single, "ph bigint, pl bigint").unionByName(longer.select("ph", "pl")).unionByName(skips.select("ph", "pl"))
    return Numbered(grams, spelled(skips, words, gap, pattern="p"), spelled(contents, words, gap, pattern="p", inst="i"), codes, words, text, gap, windows, levels, spelling)


@dataclass(frozen=True)
class Trie:
    """Patterns by their codes: of each depth the sorted pairs of state and code, where a gap leads, and which states are patterns."""

    keys: list[np.ndarray]
    gaps: list[np.ndarray]
    ends: list[np.ndarray]

    @classmethod
    def of(cls, codes: np.ndarray) -> Trie:
        keys, gaps, ends, state, before = [], [], [], np.zeros(len(codes), np.int64), 1
        for d in range(MAX_N):
            on = codes[:, d] > 0
            if not on.any():
                break
            codes, state = codes[on], state[on]
            unique, state = np.unique(state << BITS | codes[:, d], return_inverse=True)
            end = np.zeros(len(unique), bool)
            end[state[codes[:, d + 1] == 0] if d + 1 < MAX_N else state] = True
            keys.append(unique)
            gaps.append(lookup(unique, np.arange(before) << BITS | GAP_CODE))
            ends.append(end)
            before = len(unique)
        return cls(keys, gaps, ends)

    def marks(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the number of patterns with it, whether it is in a gap, whether in a skipgram; -1 ends a sentence."""
        flat = np.concatenate([flat, np.full(MAX_N, -1, flat.dtype)])
        count, gap, skip = np.zeros(len(flat), np.int32), np.zeros(len(flat), bool), np.zeros(len(flat), bool)

        def step(at: np.ndarray, state: np.ndarray, mask: tuple[bool, ...]) -> None:
            d = len(mask)
            token = flat[at + d]
            for is_gap in (False, True):
                ok = token >= (0 if is_gap else GAP_CODE)
                to = np.where(ok, self.gaps[d][state], -1) if is_gap else np.full(len(at), -1, np.int64)
                if not is_gap:
                    to[ok] = lookup(self.keys[d], state[ok] << BITS | token[ok])
                here, now, shape = at[to >= 0], to[to >= 0], (*mask, is_gap)
                hit = here[self.ends[d][now]]
                for i, g in enumerate(shape):
                    if g:
                        gap[hit + i] = True
                    else:
                        count[hit + i] += 1
                    if any(shape):
                        skip[hit + i] = True
                if d + 1 < len(self.keys) and len(here):
                    step(here, now, shape)

        if self.keys:
            start = np.flatnonzero(flat >= 0)
            step(start, np.zeros(len(start), np.int64), ())
        return count[:-MAX_N], gap[:-MAX_N], skip[:-MAX_N]


class Finder:
    """The patterns of a model, sent to every task that looks for them; None where they are too many or a word reads as a gap."""

    def __init__(self, codes: Broadcast, words: Broadcast, gap: str):
        self.codes, self.words, self.gap = codes, words, gap

    @classmethod
    def of(cls, model: Numbered, gap: str) -> Finder | None:
        if model.codes.count() > MOST_PATTERNS or pc.any(pc.equal(model.words.value, gap)).as_py():
            return None
        found = model.codes.toArrow()
        codes = unpacked(*(found[x].to_numpy() for x in ("ph", "pl"))).astype(np.int32)
        return cls(model.codes.sparkSession.sparkContext.broadcast(codes), model.words, gap)

    def marked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, their tokens and list lengths, and the marks of each token."""
        trie = None
        for table, values, lengths in lists(batches):
            trie = trie or Trie.of(self.codes.value)
            flat = coded(values, lengths, self.words.value, self.gap, -1)
            yield table, values, lengths, *(x[flat >= 0] for x in trie.marks(flat))

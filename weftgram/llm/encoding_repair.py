"""Finding and undoing text decoded with a wrong character encoding.

Each suspicious word is the start of a best-first search over strings. A step
encodes characters with one code page and decodes the bytes as UTF-8 or with
another code page, or undoes character references; visited strings are hashed, and
the cost of a string, a sum of character implausibilities, says which state is
taken next. The cheapest string reached is the restored word. Words recur, so
each worker keeps a bounded memo of searches.

Text of another script, in a page of its own or one of double bytes, that was read as cp1252 or latin-1 is
settled before that: the pages are weighed by how likely their letters are, over all such
words of the text, and only a page well ahead of the others is used.

A document is a case if some word is restored at a clear gain, if the words of a
line, or its lines together, agree on a change of code page, or if it holds marks of
a lossy decoding (U+FFFD, C1 controls) that no step explains. Lossy stretches stay as they are.

Edge cases: null, empty and plain ASCII texts are no cases and come back
unchanged; repeated documents each get their row; texts are searched whole; an
empty table gives an empty frame; further columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgram.runtime import spread

#: Code pages that UTF-8 bytes are taken to have been read with.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "iso8859-2", "koi8-r", "cp866", "mac_cyrillic", "cp1253", "cp1254", "cp852", "iso8859-5"]
#: Pairs (read as, written in) of single-byte code pages.
SWAPS = [("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("latin-1", "cp1250"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1253", "cp1252"), ("cp1252", "cp1254"), ("latin-1", "iso8859-9")]
#: Gain from which a word counts as restored by steps through UTF-8, and by a swap on its own.
GAIN_UTF8, GAIN_SWAP = 0.4, 2.6
#: Gain from which a doubtful word follows the proven steps of its text.
GAIN_WEAK = 0.2
#: Gain over the different words of a line from which they agree on a swap.
GAIN_LINE = 3.0
#: Evidence for a swap, over all words beyond ASCII of a line or over its lines in a text, from which they are swapped.
GAIN_EVIDENCE = 2.0
#: Gain by which a swap must be ahead of one that gives other words.
CLOSE = 0.3
#: Remembered words of a worker.
MEMO = 1 << 17
#: What a state may cost more than the start: beyond that it leads nowhere.
SLACK = 2.0

_UTF8 = re.compile(
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_WORD = re.compile(r"[^ \t\r\n\x0b\x0c]*[^\x00-\x7f][^ \t\r\n\x0b\x0c]*")
#: Two character references in a row, as a misread UTF-8 sequence gives.
_REFERENCES = re.compile(r"(?:&(?:[A-Za-z]{2,8}[0-9]{0,2}|#[0-9]{2,7}|#x[0-9A-Fa-f]{2,6});){2}")
_REFERRING = re.compile(r"[^ \t\r\n\x0b\x0c]*&[#A-Za-z0-9]{2,9};&[#A-Za-z0-9]{2,9};[^ \t\r\n\x0b\x0c]*")
#: A misread no-break space that became a plain one: between digits, or before a sign set off by one.
_STRAY = re.compile(r"(?<=[0-9])Â (?=[0-9]{3}(?![0-9]))|(?<=[a-zà-ÿ0-9])Â (?=[!?:;»%€])")
_R_AT_END = re.compile(r"[ŕŔ](?!\w)|(?<!\w)[ŕŔ]")
_ADJACENT = re.compile(r"[^\x00-\x7f]{2}")
_LEAD = {page: decode for page, decode in ((p, bytes([0xC3]).decode(p)) for p in ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1254"))}
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_WITHIN = re.compile("(?<=[a-zß-ÿ])Ã(?: (?= )|(?= ))")
_UNMAPPED = "࿿"


def _page(name: str) -> tuple[dict[int, str], dict[int, str]]:
    """Character to byte (as the character of that number), and back.

    Bytes without a character stand for the control of their number, as lenient
    decoders have it.
    """
    decode = {}
    for byte in range(0x80, 0x100):
        try:
            decode[byte] = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            decode[byte] = chr(byte)
    return {ord(c): chr(b) for b, c in reversed(decode.items())}, decode


_PAGES = {name: _page(name) for name in {*READ_AS, *(n for swap in SWAPS for n in swap)}}


class _ToBytes(dict):
    """Translation table of a page to its bytes; what the page has not becomes ``_UNMAPPED``."""

    def __missing__(self, n: int):
        self[n] = found = n if n < 0x80 else _UNMAPPED
        return found


_TO_BYTES = {name: _ToBytes(encode) for name, (encode, _) in _PAGES.items()}
_HELD = {name: frozenset(map(chr, encode)) for name, (encode, _) in _PAGES.items()}
_SWAPPING = {(read_as, written_in): {c: _PAGES[written_in][1][ord(b)] for c, b in _PAGES[read_as][0].items()} for read_as, written_in in SWAPS}

#: Russian letters from frequent to rare (fixed values).
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйёхжшюцщэфъ"
#: Latin letters beyond ASCII in European spelling (fixed values).
_EUROPEAN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœšžąćęłńóśźżčďěňřťůőűăâîșțğış"
#: Combining marks of the same (fixed values).
_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0327\u0328"
_TYPOGRAPHY = "–—‘’“”„…«»¿¡‹›‚•·"


class _Kind:
    LETTER, MARK, QUOTE, SYMBOL, BOX, BAD, OTHER, ASCII, SPACE = range(9)


@lru_cache(1 << 16)
def _char(c: str) -> tuple[int, str, float, bool]:
    """Kind, script, own cost, and whether it is an upper-case letter."""
    n = ord(c)
    if n < 0x80:
        if c.isalpha():
            return _Kind.LETTER, "latin", 0.0, c.isupper()
        return _Kind.ASCII, "", 0.0, False
    low = c.lower()
    category = unicodedata.category(c)
    if n == 0xFFFD:
        return _Kind.BAD, "", 6.0, False
    if n == 0xA0:
        return _Kind.SPACE, "", 0.5, False
    if 0x80 <= n < 0xA0 or category in ("Co", "Cn", "Cs"):
        return _Kind.BAD, "", 5.0, False
    if category == "Mn" or category == "Me":
        return (_Kind.OTHER, "", 0.4, False) if 0xFE00 <= n < 0xFE10 else (_Kind.MARK, "", 0.8 if c in _MARKS else 3.0, False)
    if category == "Cf":
        return _Kind.OTHER, "", 3.0 if n == 0xAD else 0.4, False
    if c == "µ":
        return _Kind.OTHER, "", 1.0, False
    if category[0] == "L" and c not in "ªº":
        upper = c.isupper()
        name = unicodedata.name(c, "").split(" ")[0]
        if name == "LATIN":
            return _Kind.LETTER, "latin", 1.0 if low in _EUROPEAN else 1.3 if 0x1E00 <= n < 0x1F00 or c in "ơưđƠƯĐ" else 2.2, upper
        if name == "CYRILLIC":
            at = _RUSSIAN.find(low)
            return _Kind.LETTER, "cyrillic", 0.3 + 0.04 * at if at >= 0 else 2.0, upper
        if name == "GREEK":
            return _Kind.LETTER, "greek", 0.6, upper
        if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"):
            return _Kind.LETTER, "cjk", 0.6, False
        if name in ("ARABIC", "HEBREW", "DEVANAGARI", "THAI", "GEORGIAN", "ARMENIAN"):
            return _Kind.LETTER, name.lower(), 0.8, False
        return _Kind.LETTER, name.lower(), 2.5, upper
    if c in _TYPOGRAPHY:
        return _Kind.QUOTE, "", 0.8, False
    if 0x2500 <= n < 0x25A0:
        return _Kind.BOX, "", 1.0, False
    if n >= 0x1F000 or 0x2600 <= n < 0x27C0:
        return _Kind.OTHER, "", 1.0, False
    if 0x3000 <= n < 0x3040 or 0xFF00 <= n < 0xFFE0 or 0x2000 <= n < 0x200B:
        return _Kind.OTHER, "", 0.5, False
    return _Kind.SYMBOL, "", 1.3, False


def implausibility(text: str) -> float:
    """Cost of a string; plain text of one script costs little per character."""
    cost = 0.0
    kind0, script0, upper0, accents = _Kind.ASCII, "", True, 0
    letter0 = within = False
    last = ""
    for c in text:
        kind, script, own, upper = _char(c)
        cost += own
        ascii_char = c < "\x80"
        if kind == _Kind.LETTER:
            if letter0:
                if script != script0:
                    cost += 3.0
                elif upper and not upper0:
                    cost += 1.2 if ascii_char else 2.2
            elif kind0 == _Kind.SYMBOL or kind0 == _Kind.BOX:
                cost += 1.5
            elif kind0 == _Kind.BAD or kind0 == _Kind.SPACE:
                cost += 0.5
            elif kind0 == _Kind.QUOTE and within:
                cost += 2.0
            if not ascii_char and script == "latin":
                accents += 1
                cost += 0.0 if accents == 1 else 0.25 if accents == 2 or c == last else 1.0
            else:
                accents = 0
        else:
            accents = 0
            if kind == _Kind.SYMBOL or kind == _Kind.BOX:
                if letter0:
                    cost += 1.5
                if kind0 in (_Kind.SYMBOL, _Kind.BOX, _Kind.QUOTE) and kind != kind0:
                    cost += 1.0
                elif kind == kind0 == _Kind.SYMBOL:
                    cost += 0.5
            elif kind == _Kind.QUOTE:
                if kind0 == _Kind.SYMBOL or kind0 == _Kind.BOX:
                    cost += 1.0
                elif letter0 and script0 != "" and c in "¿¡„‚‘“":
                    cost += 1.2
            elif kind == _Kind.SPACE:
                cost += 1.0 if letter0 or kind0 in (_Kind.SYMBOL, _Kind.BOX) else 0.0
            elif kind == _Kind.MARK and not letter0 and kind0 != _Kind.MARK:
                cost += 1.5
        # a quotation mark or dash inside a word; the apostrophe and the raised dot belong there
        within = kind == _Kind.QUOTE and letter0 and c not in "’·"
        letter0 = kind == _Kind.LETTER or (kind == _Kind.MARK and letter0)
        last = c
        if kind != _Kind.MARK:
            kind0, script0, upper0 = kind, script, upper
    return cost


def _through_utf8(text: str, page: str) -> str:
    """Encode with a code page and decode every complete UTF-8 sequence in the bytes."""
    as_bytes = text.translate(_TO_BYTES[page])
    out, done = [], 0
    for m in _UTF8.finditer(as_bytes):
        out += [text[done : m.start()], m.group().encode("latin-1").decode("utf-8")]
        done = m.end()
    return "".join([*out, text[done:]]) if out else text


def _beyond_ascii(text: str) -> set[str]:
    return {c for c in text if c >= "\x80"}


def _swapped(text: str, read_as: str, written_in: str, beyond: set[str] | None = None) -> str | None:
    """Encode wholly with one code page and decode with another."""
    beyond = _beyond_ascii(text) if beyond is None else beyond
    return text.translate(_SWAPPING[read_as, written_in]) if beyond <= _HELD[read_as] else None


def _may_swap(word: str) -> bool:
    """Whether a change of code page is worth trying.

    It needs three letters beyond ASCII in a row, letters of two scripts, or a capital
    beyond ASCII after a small letter; single signs such as those of units or tables say
    nothing about a code page.
    """
    run, scripts, small, last = 0, set(), False, ""
    for c in word:
        kind, script, _, upper = _char(c)
        if upper and small and c >= "\x80":
            return True
        small = kind == _Kind.LETTER and not upper
        if kind == _Kind.LETTER:
            scripts.add(script)
        # a letter repeated says no more than once
        run = run + (c != last) if kind == _Kind.LETTER and c >= "\x80" else 0
        last = c
        if run == 3 or len(scripts) > 1:
            return True
    return False


def _steps(text: str, swap: bool) -> Iterator[tuple[str, str]]:
    for page in READ_AS:
        after = _through_utf8(text, page)
        if after != text:
            yield f"{page}>utf-8", after
    if swap:
        beyond = _beyond_ascii(text)
        for read_as, written_in in SWAPS:
            after = _swapped(text, read_as, written_in, beyond)
            if after is not None and after != text:
                yield f"{read_as}>{written_in}", after
    if "&" in text and (after := html.unescape(text)) != text:
        yield "unescape", after


def search(word: str) -> tuple[str, float, tuple[str, ...]]:
    """Cheapest string reachable from a word, its gain, and the steps to it."""
    # a misread UTF-8 sequence is at least two characters beyond ASCII in a row
    if not _ADJACENT.search(word) and not _may_swap(word):
        plain = html.unescape(word) if _REFERENCES.search(word) else word
        if plain == word or not _ADJACENT.search(plain):
            return word, 0.0, ()
    start = implausibility(word)
    if _REFERENCES.search(word):
        start = max(start, implausibility(html.unescape(word)))  # references hide what they stand for
    best = (start, word, ())
    queue = [(start, 0, word, ())]
    seen = {word}
    # no count of states or steps: a step through UTF-8 shortens the text, every step costs more than the one
    # before, and what costs more than the start and the slack is not followed
    while queue:
        cost, _, state, path = heapq.heappop(queue)
        if cost < best[0] - 1e-9:
            best = (cost, state, path)
        if path and not path[-1].endswith("utf-8") and path[-1] != "unescape":
            continue  # a swap comes last: it undoes what happened before any UTF-8
        for step, after in _steps(state, _may_swap(state)):
            if after in seen or (step == "unescape" and path):
                continue
            seen.add(after)
            # every further step, and a swap, must earn something
            price = implausibility(after) + 0.05 + 0.25 * len(path) + (0.0 if step.endswith("utf-8") else 0.3)
            price += 0.5 if path and step.endswith("utf-8") and step != path[-1] else 0.0  # the same mistake tends to recur
            # a state far worse than the start leads nowhere
            if price <= start + SLACK:
                heapq.heappush(queue, (price, len(path) + 1, after, (*path, step)))
    return best[1], start - best[0], best[2]


#: Letters of alphabets from frequent to rare (fixed values).
_ALPHABETS = {
    "cyrillic": _RUSSIAN, "greek": "αοιετσνηυρπκμλςωθγδάίέόχήφβύξζώψϊϋΐΰ", "hebrew": "יוהלאתברמשנםעדחכקפגטזסצןםךףץ", "arabic": "اليمونترةبعدفهسكقأحجشطصخىذإضزثئءغظآؤ",
}
#: Pages of alphabets and of double bytes that may have been read as cp1252 or latin-1.
_FOREIGN = {"cp1251": "cyrillic", "koi8-r": "cyrillic", "iso8859-5": "cyrillic", "cp1253": "greek", "iso8859-7": "greek", "cp1255": "hebrew", "iso8859-8": "hebrew", "cp1256": "arabic", "iso8859-6": "arabic", "gb18030": "cjk", "big5": "cjk", "euc_kr": "cjk", "euc_jp": "cjk", "shift_jis": "cjk"}
#: Cost of a byte that a page cannot read, of a sign among letters, and of a letter of another script, in nats.
_UNREAD, _SIGN, _OTHER = 9.0, 6.0, 8.0
#: Nats by which a page must be ahead of the text as it is, and of every page that gives another text.
AHEAD, APART = 6.0, 4.0
_NOT_AFTER_VOWEL = re.compile("(?<![aeiouöüýAEIOUÖÜÝ])[ðÐ]")
_RUN = re.compile("[^\x00-\x7f]{3}")
_FREQUENCY = {
    script: {c: -math.log((1 / (i + 2)) / sum(1 / (j + 2) for j in range(len(letters)))) for i, c in enumerate(letters)} for script, letters in _ALPHABETS.items()
}


def _double(data: bytes, page: str) -> float:
    """Nats of a text in a page of double bytes: of the characters of a class all are as likely."""
    cost, i = 0.0, 0
    while i < len(data):
        b = data[i]
        if b < 0x80:
            cost, i = cost + 3.0, i + 1
            continue
        if page == "shift_jis":
            if 0xA1 <= b <= 0xDF:
                cost, i = cost + 6.5, i + 1
                continue
            t = data[i + 1] if i + 1 < len(data) else 0
            cost += 4.2 if b == 0x82 and t >= 0x9F else 6.2 if b == 0x83 and t <= 0x96 else 5.0 if b == 0x81 else 8.3 if 0x88 <= b <= 0x97 else 12.0
        elif page == "euc_jp":
            cost += 4.2 if b == 0xA4 else 6.2 if b == 0xA5 else 5.0 if b == 0xA1 else 8.3 if 0xB0 <= b <= 0xCF else 12.0
        elif page == "euc_kr":
            cost += 7.2 if 0xB0 <= b <= 0xC8 else 7.0 if b == 0xA1 else 12.5
        elif page == "big5":
            cost += 8.6 if 0xA4 <= b <= 0xC6 else 7.0 if b in (0xA1, 0xA2, 0xA3) else 12.5
        else:
            cost += 8.2 if 0xB0 <= b <= 0xD7 else 7.0 if b in (0xA1, 0xA3) else 12.5
        i += 2
    return cost


def foreign_reading(word: str, page: str) -> tuple[str | None, float]:
    """A word read as cp1252 or latin-1, in another page, and its nats; None where it cannot be."""
    encode = _PAGES["cp1252"][0]
    try:
        data = bytes(ord(c) if ord(c) < 0x80 or 0x80 <= ord(c) < 0xA0 else ord(encode.get(ord(c), _UNMAPPED)) for c in word)
    except ValueError:
        return None, 0.0
    script = _FOREIGN[page]
    try:
        after = data.decode(page)
    except UnicodeDecodeError:
        return None, _UNREAD * sum(b >= 0x80 for b in data)
    if script == "cjk":
        return after, _double(data, page)
    cost, before = 0.0, ""
    likely = _FREQUENCY[script]
    for c in after:
        if c < "\x80":
            cost += _OTHER if c.isalpha() and before else 0.0
            continue
        low = c.lower()
        cost += likely.get(low, _OTHER if c.isalpha() else _SIGN)
        if c.isupper():
            cost += 4.0 if before else 1.0
        before = "" if c.isupper() else c if c.isalpha() else before
    return after, cost + _spelling(after.strip("\"'()[].,;:!?«»-").lower(), script)


def _spelling(word: str, script: str) -> float:
    """Nats against, or for, a word by what the spelling of its script allows."""
    if script == "greek":
        accents = sum(c in "άέήίόύώΐΰ" for c in word)
        return 5.0 * (accents > 1) + (2.0 if accents == 0 and len(word) > 3 else -2.0 * (accents == 1)) + 5.0 * ("ς" in word[:-1]) + 3.0 * word.endswith("σ")
    if script == "hebrew":
        return 5.0 * sum(c in "םןףץך" for c in word[:-1]) + 3.0 * (word[-1:] in tuple("מנפצכ"))
    if script == "cyrillic":
        return 5.0 * (word[:1] in tuple("ьъы"))
    return 0.0


def _as_it_is(word: str) -> float:
    """Nats of a word of Latin letters beyond ASCII."""
    return sum(4.5 if c.isalpha() else _SIGN for c in word if c >= "\x80")


_ORDER = [f"{read_as}>{written_in}" for read_as, written_in in SWAPS]


def _spelled(c: str) -> bool:
    return c.isalnum() if c < "\x80" else _char(c)[0] in (_Kind.LETTER, _Kind.MARK)


def evidence(word: str) -> tuple[tuple[str, str, float, float], ...]:
    """Every listed swap that changes a word: the swap, the word after it, its evidence and its gain.

    Signs at the ends of a word, such as those of units, quotations and notes, can speak
    against a swap but not for it; only among proven swaps does their gain count.
    """
    lo, hi = 0, len(word)
    while lo < hi and not _spelled(word[lo]):
        lo += 1
    while lo < hi and not _spelled(word[hi - 1]):
        hi -= 1
    whole, inner = implausibility(word), implausibility(word[lo:hi])
    inside = _R_AT_END.sub("*", word)
    out, beyond = [], _beyond_ascii(word)
    weighed: dict[str, tuple[float, float]] = {}  # pages that differ little often give the same word
    for read_as, written_in in SWAPS:
        after = _swapped(word, read_as, written_in, beyond)
        if after is None or after == word:
            continue
        if after not in weighed:
            cost = implausibility(after)
            gain = whole - cost
            speaks = gain if hi - lo == len(word) else min(gain, inner - implausibility(after[lo:hi]))
            gained = lost = 0
            for before, there, a in zip(word, inside, after, strict=True):
                if before == a and there == a:
                    continue
                b_letter, a_letter = _spelled(before), _spelled(a)
                if before != a:
                    gained, lost = gained + a_letter, lost + (b_letter and not a_letter)
                # a rarer letter is no sign of a misreading, save the Slovak one outside its place between consonants
                if there != a and _char(there)[1] == _char(a)[1] == "latin":
                    speaks -= max(0.0, _char(there)[2] - _char(a)[2])
            weighed[after] = gain, min(speaks, 0.0) if gained <= lost else speaks  # letters became signs
        gain, speaks = weighed[after]
        if written_in in ("cp1254", "iso8859-9"):
            # Icelandic has the letters that would be read so, and others that Turkish has not
            turned = sum(a != b and a in "ýþðÝÞÐ" for a, b in zip(word, after, strict=True))
            # and no Turkish ğ stands but after a vowel
            never = sum(c in "áíóúéæàãõñěščřžÁÍÓÚÉÆ" for c in word) + len(_NOT_AFTER_VOWEL.findall(word))
            speaks = gain = min(0.7 * turned, 2.1) - 2.0 * never if turned else min(speaks, 0.0)
        out.append((f"{read_as}>{written_in}", after, speaks, gain))
    return tuple(out)


class Repairer:
    """Repairs texts, remembering the searches of words."""

    def __init__(self):
        self.doubtful = False
        self.memo: dict[str, tuple[str, float, tuple[str, ...]]] = {}
        self.swaps: dict[str, tuple[tuple[tuple[str, str, float, float], ...], tuple[tuple[str, float], ...]]] = {}

    def word(self, word: str) -> tuple[str, float, tuple[str, ...]]:
        found = self.memo.get(word)
        if found is None:
            found = search(word)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(word) <= 64:
                self.memo[word] = found
        return found

    def evidence(self, word: str) -> tuple[tuple[tuple[str, str, float, float], ...], tuple[tuple[str, float], ...]]:
        """The evidence of a word for every swap, and that which speaks for one."""
        found = self.swaps.get(word)
        if found is None:
            weighed = evidence(word)
            found = weighed, tuple((swap, speaks) for swap, _, speaks, _ in weighed if speaks > 0)
            if len(self.swaps) >= MEMO // 4:
                self.swaps.clear()
            if len(word) <= 64:
                self.swaps[word] = found
        return found

    def weighed(self, lines: list[list[str]]) -> dict[str, str]:
        """Repairs of lines whose words, save those misread as UTF-8, together speak for a swap.

        Lines that speak for the same swap add up over the text, every different word once;
        lines that speak against it are left, so mixed texts keep their clean lines.
        """
        # the most a swap can gather; few texts have any that reaches the threshold
        most_of: dict[str, float] = {}
        for w in dict.fromkeys(w for line in lines for w in line):
            for swap, speaks in self.evidence(w)[1]:
                most_of[swap] = most_of.get(swap, 0.0) + speaks
        open_swaps = {swap for swap, value in most_of.items() if value >= GAIN_EVIDENCE}
        if not open_swaps:
            return {}
        weights: list[tuple[list[str], dict[str, float], dict[str, float], list[str]]] = []
        over: dict[str, float] = {}
        gained_over: dict[str, float] = {}
        long_enough: set[str] = set()
        against: set[str] = set()
        seen: set[str] = set()
        for line in lines:
            total: dict[str, float] = {}
            gained: dict[str, float] = {}
            fresh: dict[str, float] = {}
            asking: set[str] = set()
            words = [w for w in line if not any(s.endswith("utf-8") for s in self.word(w)[2])]
            for w in words:
                for swap, _, speaks, gain in self.evidence(w)[0]:
                    if swap not in open_swaps:
                        continue
                    total[swap] = total.get(swap, 0.0) + speaks
                    gained[swap] = gained.get(swap, 0.0) + gain
                    if w not in seen:
                        fresh[swap] = fresh.get(swap, 0.0) + speaks
                    if speaks > 0 and len(w) >= 4:
                        asking.add(swap)
            seen.update(words)
            for swap, value in total.items():
                if value > 0:
                    over[swap] = over.get(swap, 0.0) + max(0.0, fresh.get(swap, 0.0))
                    gained_over[swap] = gained_over.get(swap, 0.0) + gained[swap]
                elif value < 0:
                    against.add(swap)
            long_enough |= {swap for swap in asking if total[swap] > 0}
            weights.append((words, total, gained, [swap for swap in asking if total[swap] >= GAIN_EVIDENCE]))
        agreed = [swap for swap in over if over[swap] >= GAIN_EVIDENCE and swap in long_enough]
        most = max(agreed, key=gained_over.__getitem__, default=None)
        repairs: dict[str, str] = {}
        for words, total, gained, proven in weights:
            # the same mistake tends to recur, so what the text says weighs in every line
            able = {*proven, *(swap for swap in agreed if total.get(swap, 0.0) > 0)}
            best = max((s for s in _ORDER if s in able), key=lambda s: gained[s] + gained_over[s], default=None)
            if best is None and most not in against:
                best = most  # a line that says nothing follows if no line of the text speaks against the swap
            if best is not None:
                made = {swap: {w: after for w in words for other, after, _, _ in self.evidence(w)[0] if other == swap} for swap in {best, *able}}
                near = [swap for swap in able if swap != best and gained[swap] + gained_over[swap] > gained.get(best, 0.0) + gained_over[best] - CLOSE]
                if any(made[swap] != made[best] for swap in near):
                    self.doubtful = True  # two pages give different words, and neither is ahead
                else:
                    repairs |= made[best]
        return repairs

    def foreign(self, text: str) -> tuple[str, set[str]]:
        """Restores words of another script that were read as cp1252 or latin-1, and says which these are.

        Pages of all scripts are weighed over the words of the text with three signs beyond
        ASCII in a row. Cyrillic is left to the search by words. Where two pages are close, the
        text is a case but stays as it is.
        """
        if not _RUN.search(text):
            return text, set()
        words = [w for w in dict.fromkeys(_WORD.findall(text)) if _RUN.search(w) and all(c < "\u0100" or ord(c) in _PAGES["cp1252"][0] for c in w)]
        if not words:
            return text, set()
        # undoing UTF-8 leaves half the signs or fewer; elsewhere sequences come about by chance
        signs = lambda w: sum(c >= "\x80" for c in w)
        through = [(w, self.word(w)[0]) for w in words if any(step.endswith("utf-8") for step in self.word(w)[2])]
        if sum(signs(w) - signs(after) for w, after in through) >= 0.45 * sum(map(signs, words)):
            return text, set()
        now = sum(map(_as_it_is, words))
        read = {page: [foreign_reading(w, page) for w in words] for page in _FOREIGN}
        total = {page: sum(cost for _, cost in found) for page, found in read.items()}
        best = min(total, key=total.__getitem__)
        if _FOREIGN[best] == "cyrillic" or total[best] + AHEAD > now or any(after is None for after, _ in read[best]):
            return text, set()
        cyrillic = min(total[p] for p in _FOREIGN if _FOREIGN[p] == "cyrillic")
        if _FOREIGN[best] == "cjk" and cyrillic + AHEAD <= now and cyrillic < total[best] + 3 * APART:
            return text, set()  # a few Cyrillic words may be double bytes by chance
        others = [total[p] for p in _FOREIGN if [a for a, _ in read[p]] != [a for a, _ in read[best]] and _FOREIGN[p] != _FOREIGN[best] or (_FOREIGN[p] == "cjk" and p != best)]
        if min(others) < total[best] + APART:
            return text, set(words)
        script = _FOREIGN[best]

        def restored(m: re.Match) -> str:
            after, _ = foreign_reading(m.group(), best)
            if after is None or (script != "cjk" and any(_char(c)[1] == "latin" for c in after) and any(c >= "\x80" and _char(c)[0] == _Kind.LETTER for c in after)):
                return m.group()
            return after

        lines = text.split("\n")
        held = set(words)
        return "\n".join(_WORD.sub(restored, line) if held & set(_WORD.findall(line)) else line for line in lines), held

    def blanked(self, text: str, pages: set[str]) -> tuple[str, bool]:
        """Restores a misread 'à' whose no-break space became a plain one, and whether there was any.

        Within a word after a small letter it shows by itself, alone only in a text with
        other UTF-8 misread by the page.
        """
        found = 0
        if "Â" in text:
            text, found = _STRAY.subn("\u00a0", text)
        if "Ã" in text:
            text, n = _WITHIN.subn("à", text)
            found += n
        for lead in {_LEAD[p] for p in pages if p in _LEAD}:
            text, n = re.subn(rf"(?<![^\s’']){lead}(?: (?= )|(?= ))", "à", text)
            found += n
        return text, found > 0

    def agreed(self, line: str, path: tuple[str, ...], gains: dict[str, float]) -> dict[str, str]:
        """Repairs of a line if its words together gain enough by a swap that some of them ask for.

        A single swap is weighed over every word of the line, those it makes worse
        included.
        """
        if len(path) > 1:
            return {w: self.word(w)[0] for w in gains} if sum(gains.values()) >= GAIN_LINE else {}
        read_as, written_in = path[0].split(">")
        after = {w: _swapped(w, read_as, written_in) for w in dict.fromkeys(_WORD.findall(line))}
        after = {w: a for w, a in after.items() if a is not None and a != w}
        total = sum(implausibility(w) - implausibility(a) for w, a in after.items())
        return after if total >= GAIN_LINE else {}

    def text(self, text: str | None) -> tuple[str | None, bool]:
        """The text restored, and whether it is a case."""
        if not text or (text.isascii() and not ("&" in text and _REFERENCES.search(text))):
            return text, False
        text, foreign = self.foreign(text)
        repairs: dict[str, str] = {}
        weak: dict[tuple[str, ...], dict[str, float]] = {}  # by path: words whose gain alone is too small
        lines = text.split("\n")
        listed = []
        referring: dict[str, str] = {}
        for line in lines:
            if line.isascii() and "&" not in line:
                continue
            words = [w for w in dict.fromkeys(_WORD.findall(line)) if w not in foreign]
            for w in dict.fromkeys(_REFERRING.findall(line)) if "&" in line else ():
                after, gain, path = self.word(w)
                # references alone are no mistake; what they stand for was misread if a step through UTF-8 follows
                if any(step.endswith("utf-8") for step in path) and gain >= GAIN_UTF8:
                    referring[w] = after
            listed.append(words)
            swaps: dict[tuple[str, ...], dict[str, float]] = {}
            for w in words:
                after, gain, path = self.word(w)
                if not path or path == ("unescape",):
                    continue
                through = all(s.endswith("utf-8") or s == "unescape" for s in path)
                if gain >= (GAIN_UTF8 if through else GAIN_SWAP):
                    repairs[w] = after
                else:
                    weak.setdefault(path, {})[w] = gain
                if not through:
                    swaps.setdefault(path, {})[w] = gain
            for path, gains in swaps.items():
                if max(map(len, gains)) >= 4:
                    repairs |= self.agreed(line, path, gains)
        self.doubtful = False
        repairs |= self.weighed(listed)
        if repairs:
            # what is proven for the text decides its doubtful words too
            proven = {self.word(w)[2] for w in repairs}
            for path, gains in weak.items():
                if path in proven:
                    repairs |= {w: self.word(w)[0] for w, gain in gains.items() if gain >= GAIN_WEAK and w not in repairs}
            text = _WORD.sub(lambda m: repairs.get(m.group(), m.group()), text)
        if referring:
            text = _REFERRING.sub(lambda m: referring.get(m.group(), m.group()), text)
        text, blanks = self.blanked(text, {self.word(w)[2][0].split(">")[0] for w in repairs if any(s.endswith("utf-8") for s in self.word(w)[2][:1])})
        lossy = "\ufffd" in text or bool(_CONTROL.search(text))
        return text, bool(repairs) or self.doubtful or bool(referring) or bool(foreign) or blanks or lossy


_REPAIRERS: list[Repairer] = []


def repair(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, garbled, restored``: whether a text is a case, and the text with stretches restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _REPAIRERS:
            _REPAIRERS.append(Repairer())
        for batch in batches:
            done = [_REPAIRERS[0].text(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([d[1] for d in done], pa.bool_()), pa.array([d[0] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "garbled", "restored"])

    rows = spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, garbled boolean, restored string")

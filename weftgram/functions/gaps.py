"""Gap configurations of skipgrams, as masks made on the driver."""

from __future__ import annotations

from itertools import groupby


def runs(mask: tuple[int, ...]) -> list[tuple[int, int]]:
    """(start, length) of every run of ones."""
    out, at = [], 0
    for bit, group in groupby(mask):
        length = len(list(group))
        if bit:
            out.append((at, length))
        at += length
    return out


def gap_masks(n: int, max_gaps: int = 3, whole: bool = False) -> list[tuple[int, ...]]:
    """Masks (1 = gap) of the configurations tried on n-grams.

    The room behind a gap is what follows the token after it. A gap with room for
    more than two tokens calls for a further one, up to ``max_gaps``; a gap with less
    is the last. The mask without any token is left out unless ``whole``.
    """
    found = []
    for number in range(1, 1 << n):
        mask = tuple(number >> (n - 1 - i) & 1 for i in range(n))
        rooms = [n - (start + length + 1) for start, length in runs(mask)]
        last = len(rooms) == max_gaps or rooms[-1] <= 2
        if len(rooms) <= max_gaps and last and all(r > 2 for r in rooms[:-1]) and (whole or sum(mask) < n):
            found.append(mask)
    return sorted(found, reverse=True)

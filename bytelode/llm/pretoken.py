"""Splitting text into the pieces byte-level BPE works on, for many texts at once.

The pieces are those of the pattern that the public tokenizer file names::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Instead of running a backtracking matcher over every character, the code points of
a whole batch become one numpy array, each is classed by table, and the piece
starts follow from comparisons of neighbouring classes.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point (uint8, 0x110000 entries); surrogates count as other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def _starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of joined texts; `first` marks text starts."""
    kind = classes()[cp]
    n = len(cp)
    same = np.zeros(n, bool)  # continues the run of the code point before
    np.equal(kind[1:], kind[:-1], out=same[1:])
    same &= ~first
    start = ~same
    space = kind == SPACE
    # The last white space of a run, with something of the same text after it.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last
    # A plain blank there belongs to the run that follows.
    blank = last & (cp == 0x20)
    start[1:] &= ~blank[:-1]
    # Contractions: a lone apostrophe that starts a piece, before certain letters.
    at = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~first[1:])
    if len(at):
        second = cp[at + 1]
        ahead = np.minimum(at + 2, n - 1)
        third = np.where((at + 2 < n) & ~first[ahead], cp[ahead], 0)
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e"))) | ((second == ord("l")) & (third == ord("l")))
        for hit, length in ((one, 2), (two, 3)):
            p = at[hit]
            start[p + 1] = False
            q = p + length
            start[q[q < n]] = True
    return np.flatnonzero(start)


def split(texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of all texts in order, and where each text's pieces begin (len + 1 bounds)."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    if not joined:
        return [], np.zeros(len(texts) + 1, np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(cp), bool)
    first[begins[:-1][lengths > 0]] = True
    starts = _starts(cp, first)
    bounds = starts.tolist()
    bounds.append(len(cp))
    pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
    return pieces, np.searchsorted(starts, begins)

"""Cuts texts into the matches of the byte-level pre-token pattern, for whole chunks at once in numpy.

The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+. Its matches cover a text without gaps, so they are runs
of one class of characters, but for three rules: a space before a run that isn't white belongs to that run; of several white
characters before such a run the last one is cut off; an apostrophe that no match before has taken makes a match with the ending after it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from . import textbatch as tb

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: Code points with the property White_Space.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: The endings that an apostrophe takes.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    table[:0x32400] = [first.get(unicodedata.category(chr(p))[0], OTHER) for p in range(0x32400)]
    table[WHITE] = SPACE
    return table


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each pre-token, in bytes; each ends where the next one or its row does."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z
    points, at = tb.code_points(data, offs)
    kind = class_table()[points]
    n = len(points)
    new_row = np.zeros(n + 1, bool)
    new_row[at] = True
    run = new_row[:n].copy()  # a run of one class begins
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    begins = run.copy()
    # the last white character before a run that isn't white
    follows = np.zeros(n, bool)
    follows[1:] = run[1:] & ~white[1:] & white[:-1] & ~new_row[1:n]
    places = np.flatnonzero(follows)
    begins[places - 1] = True
    spaced = places[points[places - 1] == 32]
    begins[spaced] = False
    # apostrophes: a run of the one character, at the begin of a match, before an ending in letters
    single = np.flatnonzero((points == 0x27) & run & begins)
    single = single[(single + 1 < n)]
    single = single[run[single + 1] & (kind[single + 1] == LETTER) & ~new_row[single + 1]]
    if len(single):
        pad = np.append(points, [0, 0])
        same = np.append(new_row, [True, True])
        taken = np.zeros(len(single), np.int64)
        for ending in sorted(ENDINGS, key=len):
            hit = np.ones(len(single), bool)
            for k, char in enumerate(ending):
                hit &= (pad[single + 1 + k] == ord(char)) & ~same[single + 1 + k]
            taken = np.where(hit & (taken == 0), len(ending), taken)
        single, taken = single[taken > 0], taken[taken > 0]
        begins[single + 1] = False
        after = single + 1 + taken
        inside = after < n
        begins[after[inside]] |= kind[after[inside]] == LETTER
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    starts = lead[begins]
    return np.searchsorted(offs, starts, "right") - 1, starts


def pretoken_ends(rows: np.ndarray, starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The end of each pre-token in bytes."""
    ends = offs[rows + 1].copy()
    if len(starts) > 1:
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
    return ends

"""Words and runs of words of many texts at once, as numbers in numpy arrays.

A word is a run of letters and digits, with apostrophes inside it; case, punctuation, characters without width and hyphens at
line ends don't count. A word is its 64-bit polynomial hash, so texts become rows of numbers that are compared, looked up and
aligned without a Python object per word. Null and empty texts have no words; texts of any length are taken whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np

# Characters without width, and words broken at the end of a line.
_UNSEEN = re.compile("[­​-‍⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\n\s*(?=[^\W\d_])")
_BASE, _RUN_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def plain(text: str | None) -> str:
    """A text in lower case, composed, without unseen characters and line-end hyphens."""
    if not text:
        return ""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text).replace("’", "'"))
    if "-\n" in text or "‐\n" in text:
        text = _BROKEN.sub("", text)
    return text.casefold()


@functools.cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(point).isalnum() for point in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    hashes: np.ndarray  # one per word, uint64
    starts: np.ndarray  # the first word of each text, and the end

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.starts[row] : self.starts[row + 1]]


def words(texts: list[str | None]) -> Words:
    said = [plain(t) for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in said), np.int64, len(said))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("\n".join([*said, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_characters()[np.minimum(points, 0x10FFFF)]
    marks = np.flatnonzero(points == 39)
    marks = marks[(marks > 0) & (marks + 1 < len(points))]
    inside[marks[inside[marks - 1] & inside[marks + 1]]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return Words(np.zeros(0, np.uint64), np.zeros(len(said) + 1, np.int64))
    # Only word characters are kept, so that words lie side by side; each is a number to the base, its first digit the highest.
    sizes = last - first
    letters = points[inside].astype(np.uint64) + np.uint64(1)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, _BASE, np.uint64)]))
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    hashes = np.add.reduceat(letters * powers[place], at)
    hashes ^= hashes >> np.uint64(29)
    return Words(hashes * _RUN_BASE, np.searchsorted(first, bounds))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the run of words that begins at each word; the last few reach past the end and are not there."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * _BASE + hashes[k : k + n]
    out ^= out >> np.uint64(33)
    return out * _RUN_BASE

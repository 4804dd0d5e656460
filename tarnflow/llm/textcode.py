"""Texts as numpy arrays of code points, a bounded number of them at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Code points that one slice of a batch may hold; a longer text is a slice of its own.
SLICE = 1 << 19


def slices(texts: Sequence[str], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have at most limit code points."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts and where each text starts, with the end appended."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table

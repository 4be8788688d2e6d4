"""Content-defined regions: where could a window of symbols occur twice?

A window of ``width`` symbols (words or bytes) is named by the smallest hash among
its grams of ``gram`` symbols.  Equal windows have equal names wherever they lie, so
a run of neighbouring windows with one name - a region - can repeat only in regions
of that name.  Names that occur once in the corpus are done with after one count of
a few bytes; the words and bytes themselves move only for the rest.  Nothing is
sampled: every window lies in exactly one region.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


@functools.lru_cache(maxsize=8)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASES[which])
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Rolling:
    """Polynomial hashes of any span of a symbol array, from prefix sums."""

    def __init__(self, symbols: np.ndarray, which: int) -> None:
        n = len(symbols) + 1
        size = 1 << max(12, int(n - 1).bit_length())
        power, inverse = _powers(which, size)
        self.inverse = inverse
        self.sums = np.zeros(n, U64)
        np.cumsum(symbols * power[: n - 1], out=self.sums[1:])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U64))


_BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def byte_symbols(raw: bytes) -> np.ndarray:
    return _BYTE_SYMBOLS[np.frombuffer(raw, np.uint8)]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the words of a UTF-8 text: runs without ASCII white space."""
    white = _WHITE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=1, append=1))
    return edge[0::2], edge[1::2]


def word_symbols(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not raw:
        return np.zeros(0, U64)
    starts, stops = word_spans(raw)
    return Rolling(byte_symbols(raw), 1).spans(starts, stops)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


@dataclass(frozen=True)
class Regions:
    """Runs of windows with one name and one place of its gram; ``start`` and ``windows``
    in symbols."""

    name: np.ndarray
    content: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def regions(symbols: np.ndarray, width: int, gram: int) -> Regions:
    """The regions of one text; none if it is shorter than a window.

    The windows of a region have the first place of its gram in common, so it has at most
    ``width - gram + 1`` windows, no two of them equal, and its first and last window cover
    all its symbols.  ``content`` is a second hash, of all symbols of the region: equal
    (name, content) means equal text, to 128 bits.
    """
    n = len(symbols) - width + 1
    if n <= 0:
        return Regions(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    reach = width - gram + 1
    grams = Rolling(symbols, 0).grams(gram)
    names = sliding_min(grams, reach)
    start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    start = at_places(grams, names, start, np.append(start[1:], n), reach)
    stop = np.append(start[1:], n)
    return Regions(names[start], Rolling(symbols, 1).spans(start, stop + width - 1), start, stop - start)


def at_places(grams: np.ndarray, names: np.ndarray, start: np.ndarray, stop: np.ndarray, reach: int) -> np.ndarray:
    """Starts of the runs of windows [start, stop), cut where the gram of the name has its
    next place: in text that repeats itself a run would go on without end."""
    # a gram is the smallest of some window if the largest name of the windows over it is its own
    edge = np.zeros(reach - 1, U64)
    least = np.flatnonzero(~sliding_min(~np.concatenate([edge, names, edge]), reach) == grams)
    low, high = np.searchsorted(least, start), np.searchsorted(least, stop + reach - 1)
    run = np.repeat(np.arange(len(start)), high - low)
    at = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - high, high - low)
    place = least[at]
    after = place[(grams[place] == names[start][run]) & (place + 1 < stop[run])] + 1  # the first window that starts behind a place
    return np.union1d(start, after)

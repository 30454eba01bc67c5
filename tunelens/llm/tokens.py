"""Words of whole Arrow text columns as flat arrays of places and 64-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000  # text handled at once; a longer single text is a chunk of its own
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20_177)
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(codes: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit codes over all bits."""
    codes = codes ^ (codes >> np.uint64(30))
    codes = codes * np.uint64(0xBF58476D1CE4E5B9)
    codes = codes ^ (codes >> np.uint64(27))
    codes = codes * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of rows with at most ``limit`` bytes of text, or one longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield slice(at, to)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and ends; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """The words of a column of texts: maximal runs of bytes that ``apart`` does not mark."""

    def __init__(self, column: pa.Array, apart: np.ndarray = WHITE, lower: bool = True):
        self.data, self.bounds = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~apart[self.data] if n else np.zeros(0, bool)
        first = np.zeros(n + 1, bool)
        first[self.bounds] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first_word = np.searchsorted(self.starts, self.bounds)  # of each text, and the end
        self.counts = np.diff(self.first_word)
        self._inside = inside

    @property
    def doc(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def codes(self) -> np.ndarray:
        """64-bit code of every word."""
        return span_codes(self.data, self.starts, self.ends, self._inside)

    def text(self, word: int) -> str:
        return bytes(self.data[self.starts[word] : self.ends[word]]).decode("utf-8", "replace")


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """64-bit code of each span; spans lie apart and ``inside`` marks exactly their bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
        values = BYTE_CODES[data[inside]] * powers[place]
        return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))


def shingle_codes(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``size`` words inside a text, and how many each text has.

    A text with fewer words, but some, has one run of them all.
    """
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    heads = np.cumsum(counts) - counts
    width = np.minimum(counts, size)
    of = np.repeat(np.arange(len(counts)), number)
    starts = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + heads[of]
    out = np.zeros(len(of), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            some = width[of] > k if len(of) else np.zeros(0, bool)
            at = np.where(some, starts + k, 0)
            out = np.where(some, mix(out * STEP + codes[at] + np.uint64(k + 1)), out) if len(of) else out
    return out, number

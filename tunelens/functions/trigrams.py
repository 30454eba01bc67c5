"""Repetition of word trigrams, counted in an Arrow kernel over the bytes of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelens.functions.text import SPACES

SLICE_BYTES = 1_000_000  # text handled at once; a longer single text is a slice of its own

_NARROW = np.zeros(256, bool)
_NARROW[[ord(c) for c in SPACES if ord(c) < 0x80]] = True
_WIDE = [c.encode() for c in SPACES if ord(c) >= 0x80]  # two or three bytes each


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    found = _NARROW[data]
    for width in (2, 3):
        codes = [int.from_bytes(c) for c in _WIDE if len(c) == width]
        leads = np.zeros(256, bool)
        leads[[c >> 8 * (width - 1) for c in codes]] = True
        at = np.flatnonzero(leads[data[: len(data) - width + 1]])
        if len(at):
            code = sum(data[at + k].astype(np.int64) << 8 * (width - 1 - k) for k in range(width))
            at = at[np.isin(code, codes)]
            for k in range(width):
                found[at + k] = True
    return found


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An id for every word, equal for equal words, and the number of words of every text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~_spaces(data)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | fresh[1:-1]
    starts = np.flatnonzero(opens)
    # Without the spaces, words lie one after the other.
    place = np.cumsum(inside) - inside
    ends = np.append(place[starts], int(inside.sum())).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside].tobytes())]
    )
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.diff(np.searchsorted(starts, bounds))


def _shares(texts: pa.Array, least: int) -> pa.Array:
    word, counts = _words(texts)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(row[:-2] == row[2:])
    size = int(word.max(initial=0)) + 1
    if size**3 * len(counts) < 2**63:
        found = np.unique(((row[whole] * size + word[whole]) * size + word[whole + 1]) * size + word[whole + 2])
        found //= size**3
    else:  # too many kinds of words for one number: pairs, then triples, get ids first
        triples = word[whole]
        for ahead in (1, 2):
            triples = np.unique(triples * size + word[whole + ahead], return_inverse=True)[1]
        several = int(triples.max(initial=0)) + 1
        found = np.unique(row[whole] * several + triples) // several
    share = np.bincount(found, minlength=len(counts)) / np.maximum(counts - 2, 1)
    return pa.array(share, mask=counts < max(least, 3))


def text_trigram_share(text: Column, least: int = 3) -> Column:
    """Distinct word trigrams over all trigrams of a text; null below ``least`` words, or three.

    Exact: words are told apart by their bytes, trigrams by the ids of their words.
    """

    @F.arrow_udf("double")
    def shares(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slice_of = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(slice_of)) + 1, [len(texts)]])
        parts = [_shares(texts.slice(a, b - a), least) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.concat_arrays(parts)

    return shares(text)

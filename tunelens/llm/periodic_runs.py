"""Periodic runs of words, by grouping suffixes under their Lyndon prefixes.

A run is a stretch of words that repeats itself with some smallest period, at least ``min_repeats``
times and over at least ``min_words`` words, and that no neighbouring word extends. Every run holds
its Lyndon root, the smallest rotation of one period under an order of the words or under the
reverse order, and the root is the longest Lyndon word that starts where it starts. So runs follow
from the longest Lyndon words of all places under both orders, and those are just what the first
phase of Baier's suffix sorter makes: places begin in groups by their word; groups are taken from
the greatest down, and each place of a group hands the group's word sequence to the nearest place
before it that lies in a smaller group, which so moves to a new group right above its old one. When
a group's turn comes, its sequence is the longest Lyndon word of all its places. Equal groups one
period apart are copies of one root in a row; such a row is extended word by word to both sides,
by less than a period, into a run.

Only stretches that can hold a run are grouped: where a run is long enough, each of its grams of a
few words (``gram_size``) occurs again one period further, so words outside all grams that a text
holds twice are in no run. That test is exact in one direction, a collision merely leaves more to do.

Each text is handled whole by the task that reads it; nothing is shuffled, collected or broadcast.
Memory is a few times that of two megabytes of text, or of one longer text.

Defined results: null text has no words, no runs and null ``collapsed``; empty and blank texts have
no runs and an empty ``collapsed``; repeated rows are handled one by one; null ids are carried; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tokens import STEP, Words, chunks, mix

MIN_WORDS = 24
MIN_REPEATS = 3

FOUND = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_groups(letters: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest Lyndon word that starts there, and its group.

    Two places are in one group if and only if those words are equal.
    """
    n = len(letters)
    kinds = max(letters, default=-1) + 1
    # Places count from 1; place 0 is smaller than all others and never handled.
    members: list[list[int]] = [[] for _ in range(kinds)]
    for place, letter in enumerate(letters, 1):
        members[letter].append(place)
    live = [len(m) for m in members]
    size = [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    group = [-1, *letters]
    nearest = list(range(n + 1))  # a place not handled yet, at or before each place
    length = [0] * (n + 1)
    current = kinds - 1
    while current >= 0:
        own = members[current]
        if live[current] < len(own):
            own = [place for place in own if group[place] == current]
        width = size[current]
        for place in own:
            length[place] = width
            nearest[place] = place - 1
        times: dict[int, int] = {}
        for place in own:
            at = place - 1
            while nearest[at] != at:
                nearest[at] = at = nearest[nearest[at]]
            if at:
                times[at] = times.get(at, 0) + 1
        if len(times) == 1:
            moves = {(group[at], k): [at] for at, k in times.items()}
        else:
            moves = {}
            for at, k in times.items():
                moves.setdefault((group[at], k), []).append(at)
        # Of one old group, those that take more copies come to lie higher.
        for old, k in moves if len(moves) == 1 else sorted(moves, key=lambda move: -move[1]):
            moved = moves[old, k]
            if live[old] == len(moved):  # all of what is left of it
                size[old] += k * width
                continue
            live[old] -= len(moved)
            new = len(size)
            size.append(size[old] + k * width)
            members.append(moved)
            live.append(len(moved))
            for at in moved:
                group[at] = new
            over = above[old]
            below[over] = above[old] = new
            below.append(old)
            above.append(over)
        current = below[current]
    return length[1:], group[1:]


def stretch_runs(letters: np.ndarray, min_words: int, min_repeats: float) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run in one stretch of letters 0, 1, 2, ..."""
    found = set()
    n = len(letters)
    for order in (letters, letters.max(initial=0) - letters):
        length, group = (np.array(x, np.int64) for x in lyndon_groups(order.tolist()))
        after = np.arange(n) + length
        again = np.zeros(n, bool)  # the same root stands right behind
        inner = np.flatnonzero(after < n)
        again[inner] = group[after[inner]] == group[inner]
        first = again | (3 * length - 2 >= np.maximum(min_words, min_repeats * length))
        first[after[np.flatnonzero(again)]] = False
        for start in np.flatnonzero(first).tolist():
            period = int(length[start])
            last = start
            while again[last]:
                last += period
            end = last + period
            # The most that less than one period on both sides can add.
            if end - start + 2 * period - 2 < max(min_words, min_repeats * period):
                continue
            ahead = letters[end : end + period] == letters[last : last + period][: n - end]
            stop = end + int(ahead.argmin() if not ahead.all() else len(ahead))
            width = min(start, period)
            back = letters[start - width : start][::-1] == letters[start + period - width : start + period][::-1]
            begin = start - int(back.argmin() if not back.all() else len(back))
            if stop - begin >= max(min_words, min_repeats * period):
                found.add((begin, stop - begin, period))
    return found


def gram_size(min_words: int, min_repeats: float) -> int:
    """Words, a power of two, of grams that occur twice wherever they lie in a run.

    A run of length n and period q has n - k + 1 places for grams of k words. If they are 2 * q or more,
    each gram has another one period away; n >= min_words and q <= n / min_repeats.
    """
    most = int(min_words * (1 - 2 / min_repeats)) + 1
    return 1 << (most.bit_length() - 1)


def stretches(codes: np.ndarray, counts: np.ndarray, min_words: int, min_repeats: float) -> list[tuple[int, int]]:
    """Stretches of the words of all texts, each inside one text, that hold every run."""
    n = len(codes)
    size = gram_size(min_words, min_repeats)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        grams = codes ^ mix(doc.astype(np.uint64) + np.uint64(1))
        reach = 1
        while reach < size:
            grams = mix(grams[:-reach] * STEP + grams[reach:]) if len(grams) > reach else grams[:0]
            reach *= 2
    grams = grams[: max(n - size + 1, 0)]
    if not len(grams):
        return []
    place = np.flatnonzero(doc[: len(grams)] == doc[size - 1 : size - 1 + len(grams)])
    order = place[np.argsort(grams[place], kind="stable")]
    same = grams[order[1:]] == grams[order[:-1]]
    twice = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    inside = np.cumsum(cover[:-1]) > 0
    opens, closes = inside.copy(), inside.copy()
    fresh = np.zeros(n, bool)
    fresh[(ends - counts)[counts > 0]] = True
    opens[1:] &= ~inside[:-1] | fresh[1:]
    closes[:-1] &= ~inside[1:] | fresh[1:]
    begin, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = stop - begin >= min_words
    return list(zip(begin[long].tolist(), stop[long].tolist(), strict=True))


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    doc = words.doc[kept]
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept] + 1
    ends = np.cumsum(sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)
    data = np.append(words.data, np.uint8(0))[at]
    data[ends - 1] = ord(" ")
    final = np.ones(len(doc), bool)
    final[:-1] = doc[1:] != doc[:-1]
    whole = np.ones(len(data), bool)
    whole[ends[final] - 1] = False
    per_text = np.bincount(doc, sizes - final, len(words.counts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    return pa.LargeStringArray.from_buffers(
        len(words.counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[whole].tobytes())
    )


def runs_of(texts: pa.Array, min_words: int, min_repeats: float) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs and what is left without repeats, of every text."""
    words = Words(texts, lower=False)
    codes, counts = words.codes(), words.counts
    n = len(counts)
    heads = words.first_word
    doc, rows = [], []
    kept = np.ones(len(codes), bool)
    for begin, stop in stretches(codes, counts, min_words, min_repeats):
        letters = np.unique(codes[begin:stop], return_inverse=True)[1]
        for start, length, period in sorted(stretch_runs(letters, min_words, min_repeats)):
            at = begin + start
            of = int(np.searchsorted(heads, at, side="right")) - 1
            kept[at + period : at + length] = False
            doc.append(of)
            rows.append((at - int(heads[of]), length, period))
    # Stretches lie one after the other, so rows are in order of text and start already.
    number = np.bincount(np.array(doc, np.int64), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
    table = np.array(rows, np.int64).reshape(-1, 3)
    flat = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(RUN))
    left = pc.if_else(pc.is_valid(texts), joined(words, kept), pa.scalar(None, pa.large_string()))
    return counts, pa.ListArray.from_arrays(offsets, flat), left.cast(pa.string())


def find_runs(documents: DataFrame, min_words: int = MIN_WORDS, min_repeats: float = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of every document.

    ``collapsed`` keeps the words that no run holds after its first period, joined by one space.
    ``min_repeats`` is 2 or more.
    """
    if min_repeats < 2:
        raise ValueError("a run repeats its period at least twice")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1)):
                some = batch.slice(part.start, part.stop - part.start)
                counts, runs, left = runs_of(some.column(1).cast(pa.string()), min_words, min_repeats)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts.astype(np.int64)), runs, left],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, FOUND)

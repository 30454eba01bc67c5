"""Line dedup by winnowing: later repeats of runs of lines with MIN_WORDS words or more go.

A document is its sequence of lines that hold a word. For every line the shortest window from it on
with MIN_WORDS words gives up one fingerprint, its line with the smallest hash; so two equal runs of
that many words share one, wherever they stand. Fingerprints that occur at several places are joined
with their documents, and from these anchors matches are extended both ways: every shortest window
forwards or backwards that holds an anchor is looked up by the hashes of its lines. A window whose
first place is elsewhere is a repeat. Shortest windows in both directions cover a run exactly, so a
line goes if and only if it lies in a run of MIN_WORDS words or more that also stands earlier: in a
document with a smaller id, or further up in its own. Lines are compared as they are.

Scale: the text is read once as line hashes (about 12 bytes a line); counts and first places are
summed up before shuffles, and each hash meets one row per value, so lines and runs that stand in a
third of all documents are dealt out by adaptive joins. No pairs of documents are made. Only texts
that lose lines (and few others, see ``among``) are shuffled.

Defined results: null and empty texts have no lines and stay as they are; lines without words never
count, and go with the line with words before them, except at the end of a text; rows with equal id and text are one document; null ids
come after all others; a document that lost its last line with words keeps an empty rest and has
``kept`` false; an empty table gives no rows; all other input columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tables import cut, cuts
from tunelens.llm.tokens import WHITE, Words, chunks, mix
from tunelens.session import materialise

MIN_WORDS = 50
LINES = "id long, hash long, codes array<long>, words array<int>, at array<int>, marks array<int>"
WINDOWS = "key1 long, key2 long, id long, hash long, first int, last int"
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LAST_ID = 2**63 - 1

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def windows(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Last line of the shortest window from each line on; -1 where its document ends before."""
    total = np.concatenate([[0], np.cumsum(words)])
    last = np.searchsorted(total, total[:-1] + least, side="left") - 1
    inside = last < len(words)
    inside[inside] = doc[last[inside]] == doc[inside]
    return np.where(inside, last, -1)


def smallest(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lines that are the smallest of some window, by code, then the later one."""
    first = np.flatnonzero(last >= 0)
    best, ends = first.copy(), last[first]
    for k in range(1, int((ends - first).max(initial=0)) + 1):
        at = first + k
        some = np.flatnonzero(at <= ends)
        better = some[codes[at[some]] <= codes[best[some]]]
        best[better] = at[better]
    return np.unique(best)


class Lines:
    """The lines with words of a column of texts."""

    def __init__(self, texts: pa.Array):
        lines = Words(texts, NEWLINE, lower=False)
        data, bounds = lines.data, lines.bounds
        starts = Words(texts, WHITE, lower=False).starts
        words = np.searchsorted(starts, lines.ends) - np.searchsorted(starts, lines.starts)
        breaks = np.concatenate([[0], np.cumsum(NEWLINE[data])]) if len(data) else np.zeros(1, np.int64)
        full = words > 0
        self.codes = lines.codes()[full]
        self.words = words[full].astype(np.int32)
        self.doc = lines.doc[full]
        self.at = (breaks[lines.starts] - breaks[bounds[lines.doc]])[full].astype(np.int32)
        self.counts = np.bincount(self.doc, minlength=len(texts))


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _line_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(2)):
                some = batch.slice(part.start, part.stop - part.start)
                lines = Lines(some.column(2))
                heads = np.cumsum(lines.counts) - lines.counts
                marks = smallest(lines.codes, windows(lines.words, lines.doc, least))
                per = np.bincount(lines.doc[marks], minlength=len(heads))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        _lists(lines.counts, lines.codes.astype(np.int64), pa.int64()),
                        _lists(lines.counts, lines.words, pa.int32()),
                        _lists(lines.counts, lines.at, pa.int32()),
                        _lists(per, (marks - heads[lines.doc[marks]]).astype(np.int32), pa.int32()),
                    ],
                    names=["id", "hash", "codes", "words", "at", "marks"],
                )

    return rows


def _run_keys(codes: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each run of lines; ``place`` counts lines inside a document."""
    keys = []
    with np.errstate(over="ignore"):
        for base in BASES:
            top = int(place.max(initial=0)) + 1
            powers = np.cumprod(np.full(top, base, np.uint64))
            back = np.cumprod(np.full(top, pow(base, -1, 2**64), np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[place])])
            length = (last - first + 1).astype(np.uint64)
            keys.append(mix((sums[last + 1] - sums[first]) * back[place[first]] + length).astype(np.int64))
    return keys


def _window_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat = lambda i: batch.column(i).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            codes, words, at = flat(2).astype(np.uint64), flat(3), flat(4)
            doc = np.repeat(np.arange(len(counts)), counts)
            heads = np.cumsum(counts) - counts
            place = np.arange(len(codes)) - heads[doc]
            anchors = batch.column(5)
            marked = np.zeros(len(codes) + 1, np.int64)
            per = anchors.value_lengths().to_numpy(zero_copy_only=False)
            marked[np.repeat(heads, per) + anchors.flatten().to_numpy(zero_copy_only=False) + 1] = 1
            marked = np.cumsum(marked)
            ahead = windows(words, doc, least)
            first = np.flatnonzero(ahead >= 0)
            last = ahead[first]
            # The same from the end backwards.
            behind = windows(words[::-1], -doc[::-1], least)[::-1]
            ends = np.flatnonzero(behind >= 0)
            first, last = np.append(first, len(codes) - 1 - behind[ends]), np.append(last, ends)
            held = marked[last + 1] > marked[first]
            pairs = np.unique(np.stack([first[held], last[held]], 1), axis=0)
            first, last = pairs[:, 0], pairs[:, 1]
            keys = _run_keys(codes, place, first, last)
            until = at.copy()  # up to the next line with words
            until[:-1] = np.where(doc[1:] == doc[:-1], at[1:] - 1, at[:-1])
            of = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                    batch.column(0).take(of),
                    batch.column(1).take(of),
                    pa.array(at[first].astype(np.int32)),
                    pa.array(until[last].astype(np.int32)),
                ],
                names=["key1", "key2", "id", "hash", "first", "last"],
            )

    return rows


def repeated_runs(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(id, hash, gone) for documents that lose lines: the numbers of the lines that go."""
    lines = materialise(
        documents.select("id", "hash", "text").filter(F.col("text").isNotNull()).mapInArrow(_line_rows(least), LINES)
    )
    marks = lines.select("id", "hash", F.explode("marks").alias("mark"), "codes").select(
        "id", "hash", "mark", F.get("codes", F.col("mark")).alias("code")
    )
    # Stored, so the join can split a code, or a run, that stands in a third of all documents.
    several = materialise(marks.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code"))
    anchors = marks.join(several, "code").groupBy("id", "hash").agg(F.collect_set("mark").alias("anchors"))
    # Rows with equal id and text are one document.
    anchored = (
        lines.dropDuplicates(["id", "hash"])
        .join(anchors, ["id", "hash"])
        .select("id", "hash", "codes", "words", "at", "anchors")
    )
    runs = materialise(anchored.mapInArrow(_window_rows(least), WINDOWS))
    places = F.struct("id", "hash", "first")
    firsts = materialise(
        runs.groupBy("key1", "key2")
        .agg(F.min(places).alias("earliest"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("key1", "key2", "earliest")
    )
    later = runs.join(firsts, ["key1", "key2"]).filter(places > F.col("earliest"))
    return (
        later.groupBy("id", "hash", "first")
        .agg(F.max("last").alias("last"))
        .groupBy("id", "hash")
        .agg(F.collect_list(F.sequence("first", "last")).alias("runs"))
        .select("id", "hash", F.array_distinct(F.flatten("runs")).alias("gone"))
    )


def drop_repeats(
    documents: DataFrame, least: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_gone", "kept")
) -> DataFrame:
    """All input columns with the shortened text, and how many lines it had and lost, and kept.

    ``names`` are those of the three added columns; input columns of the same names are replaced.
    """
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in names])
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__hash": F.xxhash64("text")}
    )
    gone = materialise(
        repeated_runs(keyed.select(F.col("__id").alias("id"), F.col("__hash").alias("hash"), "text"), least)
    )
    seen = cuts(gone, "id", "hash")
    split = keyed.withColumn("__cut", cut("__id", "__hash")).join(
        F.broadcast(seen.withColumn("__hit", F.lit(True))), "__cut", "left"
    )
    lines = F.split("text", "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    whole = split.filter(F.col("__hit").isNull()).select(
        *columns,
        n_lines.alias(names[0]),
        F.lit(0).alias(names[1]),
        F.lit(True).alias(names[2]),
    )
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    hit = split.filter(F.col("__hit")).join(
        gone.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("gone").alias("__gone")),
        ["__id", "__hash"],
        "left",
    )
    changed = hit.withColumn("__rest", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest)).select(
        *[F.col("__rest").alias(n) if n == "text" else c for n, c in zip(documents.columns, columns, strict=True)],
        n_lines.alias(names[0]),
        F.coalesce(F.size("__gone"), F.lit(0)).alias(names[1]),
        (F.col("__gone").isNull() | F.col("__rest").rlike("[^\\x20\\x09-\\x0D]")).alias(names[2]),
    )
    return whole.union(changed)

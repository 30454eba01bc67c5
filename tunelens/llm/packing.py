"""Conflict-constrained best-fit packing of documents into training sequences.

Items (documents, or pieces of documents longer than a sequence) are placed by falling length into
the fullest bin that has room and no conflict. Open bins are kept in order of their residual room;
the search starts at the first that is large enough and goes on to its successors until one is
compatible, so the tightest compatible bin is always found, or a new one opened. Each bin carries
bitmaps: one bit for each duplicate cluster, which may occur once, and for each source one bit in
each of SOURCE_PLANES planes, so a source may occur that many times.

Documents are dealt by the hash of their id, text and partition into groups of about GROUP_ROWS, each
packed by one task; a source or cluster that holds a third of all rows is spread over all groups. Groups have at
most one nearly empty bin or, for clusters, as many bins as copies, so splitting costs little. Only
ids, lengths, sources and cluster hashes are shuffled, never texts.

Defined results: null and empty texts take no room and get no bin (null), with ``n_words`` 0; a text
longer than a bin is cut into whole bins and a rest, so no word is lost; null sources and clusters
conflict with nothing; repeated rows are items of their own, and of one cluster if texts are equal;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8_192  # words in a sequence
GROUP_ROWS = 10_000
SOURCE_PLANES = 8

PLACED = "doc_id long, source string, cluster long, piece long, first_word long, n_words long, bin long, offset long"


class Bins:
    """Open bins in order of residual room, with their conflict bitmaps."""

    def __init__(self, capacity: int, planes: int):
        self.capacity = capacity
        self.planes = planes
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def compatible(self, number: int, cluster: int, source: int) -> bool:
        """A source is full when its bit stands in the last plane."""
        return not self.clusters[number] & cluster and not self.sources[number][-1] & source

    def place(self, length: int, cluster: int, source: int) -> tuple[int, int]:
        """Bin of an item and its offset there; ``cluster`` and ``source`` are bits or 0."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order) and not self.compatible(self.order[at][1], cluster, source):
            at += 1
        if at < len(self.order):
            residual, number = self.order.pop(at)
        else:
            residual, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.planes)
        self.clusters[number] |= cluster
        for plane, bits in enumerate(self.sources[number]):
            if source and not bits & source:
                self.sources[number][plane] |= source
                break
        if residual > length:
            insort(self.order, (residual - length, number))
        return number, self.capacity - residual


def pack_group(rows: list[dict], capacity: int, planes: int) -> Iterator[dict]:
    """Placements of one group's documents; full pieces fill bins alone."""
    several = [c for c, n in Counter(r["cluster"] for r in rows if r["cluster"] is not None).items() if n > 1]
    cluster_bit = {c: 1 << i for i, c in enumerate(several)}  # a lone cluster meets no conflict
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(r["source"] for r in rows)) if s is not None}
    bins = Bins(capacity, planes)
    key = lambda r: (-(r["n"] % capacity), r["doc_id"] is None, r["doc_id"] or 0, r["cluster"] or 0)
    for row in sorted(rows, key=key):
        shared = {k: row[k] for k in ("doc_id", "source", "cluster")}
        whole, rest = divmod(row["n"], capacity)
        for piece in range(whole):
            number, offset = bins.place(capacity, 0, 0)
            start = piece * capacity
            yield shared | {"piece": piece, "first_word": start, "n_words": capacity, "bin": number, "offset": offset}
        if rest:
            place = bins.place(rest, cluster_bit.get(row["cluster"], 0), source_bit.get(row["source"], 0))
            yield shared | dict(
                piece=whole, first_word=whole * capacity, n_words=rest, bin=place[0], offset=place[1]
            )
        elif not whole:
            yield shared | {"piece": 0, "first_word": 0, "n_words": 0, "bin": None, "offset": None}


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    planes: int = SOURCE_PLANES,
    cluster: Column | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per document or piece: its words, its bin (unique over groups) and its offset there.

    ``cluster`` names a document's duplicates; by default equal texts are one cluster.
    """
    found = F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text")) if cluster is None else cluster
    groups = max(1, -(-documents.count() // group_rows))
    items = documents.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        cluster.cast("long").alias("cluster"),
        F.greatest(F.coalesce(found, F.lit(0)), F.lit(0)).cast("long").alias("n"),
        # Null and repeated ids, and even equal rows, are spread as well.
        F.pmod(F.xxhash64(F.xxhash64("doc_id"), F.xxhash64("text"), F.spark_partition_id()), F.lit(groups)).alias("group"),
    )
    schema = pa.schema(
        [(c, pa.string() if c == "source" else pa.int64()) for c in (x.split()[0] for x in PLACED.split(", "))]
    )

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = [
            r | {"bin": None if r["bin"] is None else (group << 32) + r["bin"]}
            for r in pack_group(table.to_pylist(), capacity, planes)
        ]
        return pa.Table.from_pylist(rows, schema)

    return items.groupBy("group").applyInArrow(packed, PLACED)

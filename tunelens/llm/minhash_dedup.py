"""MinHash near-duplicates: banded candidates, checked by odd sketches, confirmed on full sets.

A document is the set of its five-word shingles. Its MinHash samples give band keys, and the same
samples are folded into a parity bitmap, the odd sketch: the number of ones in the XOR of two
sketches estimates how many samples differ, most precisely where similarities are high. Pairs that
share a band and whose sketches do not rule the similarity out are compared on their full sets.

Documents with equal sets are one node from the start, whatever their number. In each bucket of a
band every node is first paired with the bucket's smallest one. After the links found so far have
been united, what is left are buckets whose nodes still lie in different components. Their nodes,
dealt into blocks of bounded size, are compared block by block inside tasks: sketches first, then the
full sets, and only links leave the task. So a group of near copies costs about one pair for each
node where its smallest node links it, no list of all pairs is ever made, and no link between
components is lost: a pair at the threshold shares no band with probability (1 - 0.85**4)**32, about
6e-11 (at 0.8 about 5e-8), and is ruled out by its sketches with probability 6e-10 (at 0.8, 2.2e-8).

Scale: texts are read once for signatures; only texts of candidates (about those: whose hashed id is
among at most 2**20 broadcast values) are shuffled for confirmation. Joins on buckets and components
are plain equi-joins that adaptive execution can split.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; texts of
one to four words have one shingle, all their words; rows with the same id are one document in
several rows (linked), each text with its own links; rows with a null id take part in no link and are kept; an empty table gives
no rows; all input columns are carried by none of the steps but can be joined back by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.llm.components import components
from tunelens.llm.tables import among
from tunelens.llm.tokens import Words, chunks, mix, shingle_codes
from tunelens.session import materialise

SHINGLE = 5
BANDS = 32
ROWS = 4
SKETCH_WORDS = 8  # 64-bit words of an odd sketch
THRESHOLD_PERCENT = 85
SKETCH_MARGIN = 0.25  # so far under the threshold, by sketch, a pair is ruled out

BLOCK_NODES = 512  # about so many nodes, or so many shingles if they are more, make a block
BLOCK_SHINGLES = 2_000_000
SLICE = 8_192  # shingles counted at once

SIGNATURES = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sketch array<long>"
SETS = "doc_id long, key long, codes array<long>"

_random = np.random.default_rng(85)
FACTORS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of all texts, sorted in each, and how many each text has."""
    words = Words(texts)
    codes, counts = shingle_codes(words.codes(), words.counts, SHINGLE)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    return codes[fresh], np.bincount(doc[fresh], minlength=len(counts))


def set_keys(codes: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of each set that is not empty."""
    heads = (np.cumsum(counts) - counts)[counts > 0]
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(codes ^ np.uint64(salt)), heads) if len(heads) else codes[:0]


def signatures(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two set keys, band keys and odd sketch of each set that is not empty."""
    heads = (np.cumsum(counts) - counts)[counts > 0]
    n = len(heads)
    with np.errstate(over="ignore"):
        keys = np.stack([set_keys(codes, counts, salt) for salt in (1, 2)], 1)
        minima = np.empty((BANDS * ROWS, n), np.uint64)
        for i, (factor, salt) in enumerate(zip(FACTORS, SALTS, strict=True)):
            minima[i] = np.minimum.reduceat((codes ^ salt) * factor, heads) if n else 0
        bands = np.empty((n, BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(n, b + 1, np.uint64)
            for r in range(ROWS):
                key = mix(key + minima[b * ROWS + r])
            bands[:, b] = key
        bits = mix(minima + np.arange(BANDS * ROWS, dtype=np.uint64)[:, None])
        place = (bits >> np.uint64(50)) % np.uint64(SKETCH_WORDS * 64)
        sketch = np.zeros((n, SKETCH_WORDS), np.uint64)
        for row in place:
            sketch[np.arange(n), row // 64] ^= np.uint64(1) << (row % np.uint64(64))
    return keys, bands, sketch


def _lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """Fixed-width rows as lists; null where not present."""
    width = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(present) * width]).astype(np.int32)
    flat = pa.array(rows.reshape(-1).astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~present, False)), flat)


def _spread(values: np.ndarray, present: np.ndarray) -> pa.Array:
    out = np.zeros(len(present), np.int64)
    out[present] = values.astype(np.int64)
    return pa.array(out, mask=~present)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch.column(1)):
            rows = batch.slice(part.start, part.stop - part.start)
            codes, counts = shingle_sets(rows.column(1))
            keys, bands, sketch = signatures(codes, counts)
            present = counts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(counts.astype(np.int64)),
                    _spread(keys[:, 0], present),
                    _spread(keys[:, 1], present),
                    _lists(bands, present),
                    _lists(sketch, present),
                ],
                names=["doc_id", "n_shingles", "key1", "key2", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch.column(1)):
            rows = batch.slice(part.start, part.stop - part.start)
            codes, counts = shingle_sets(rows.column(1))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int64)))
            key = _spread(set_keys(codes, counts, 1), counts > 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), key, lists], names=["doc_id", "key", "codes"])


def max_ones(percent: int) -> int:
    """Ones in the XOR of two sketches that mean a similarity SKETCH_MARGIN under the threshold."""
    differing = BANDS * ROWS * (1 - percent / 100 + SKETCH_MARGIN)
    return int(SKETCH_WORDS * 32 * (1 - np.exp(-4 * differing / (SKETCH_WORDS * 64))))


def sketch_ones(a: Column, b: Column) -> Column:
    """Ones in the XOR of two odd sketches: the more, the fewer samples agree."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH_WORDS)), F.lit(0))


def _sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets named by (doc_id, key), each once."""
    texts = among(documents.select(F.col("doc_id").cast("long"), "text"), wanted, "doc_id")
    found = texts.mapInArrow(_sets, SETS).join(wanted.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi")
    return found.dropDuplicates(["doc_id", "key"])


def _confirmed(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, a_key, b, b_key) whose full shingle sets are similar enough, by id."""
    ends = [pairs.select(F.col(x).alias("doc_id"), F.col(f"{x}_key").alias("key")) for x in ("a", "b")]
    sets = materialise(_sets_of(documents, ends[0].union(ends[1]).distinct()))
    side = lambda x: sets.select(*[F.col(c).alias(n) for c, n in zip(sets.columns, (x, f"{x}_key", f"codes_{x}"))])
    joined = pairs.join(side("b"), ["b", "b_key"]).join(side("a"), ["a", "a_key"])
    shared = F.size(F.array_intersect("codes_a", "codes_b"))
    union = F.size("codes_a") + F.size("codes_b") - shared
    return joined.filter((shared * 100 >= union * percent) & (F.col("a") != F.col("b"))).select("a", "b").distinct()


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components among the nodes of one pair of blocks.

    Nodes of one block are compared with those of the other, or with each other where both blocks
    are one. Shared shingles are counted as products of 0/1 matrices, SLICE columns at a time.
    """
    rows = rows.drop_duplicates(["node", "key"]).sort_values(["block", "node", "key"], ignore_index=True)
    block = rows["block"].to_numpy()
    node, part = rows["node"].to_numpy(), rows["component"].to_numpy()
    sketch = np.array(rows["sketch"].tolist(), np.int64).view(np.uint64)
    upper = np.arange(len(rows)) if block[0] == block[-1] else np.flatnonzero(block == block[0])
    lower = np.arange(len(rows)) if block[0] == block[-1] else np.flatnonzero(block != block[0])
    ones = np.zeros((len(upper), len(lower)), np.int64)
    for i in range(SKETCH_WORDS):
        ones += np.bitwise_count(sketch[upper, i][:, None] ^ sketch[lower, i][None, :])
    sizes = rows["codes"].map(len).to_numpy()
    open_ = (ones <= max_ones(percent)) & (part[upper][:, None] != part[lower][None, :])
    if block[0] == block[-1]:
        open_ &= upper[:, None] < lower[None, :]
    upper, lower, open_ = upper[open_.any(1)], lower[open_.any(0)], open_[open_.any(1)][:, open_.any(0)]
    if not len(upper):
        return pd.DataFrame({"a": node[:0], "b": node[:0]})
    used = np.union1d(upper, lower)
    codes = np.concatenate(rows["codes"].to_numpy()[used])
    of = np.repeat(used, sizes[used])
    values, column, number = np.unique(codes, return_inverse=True, return_counts=True)
    shared = np.zeros((len(upper), len(lower)), np.float32)
    several = number[column] > 1  # a shingle of one node alone is shared with none
    place = np.cumsum(number > 1)[column] - 1
    spot = np.full(len(rows), -1)
    for start in range(0, int((number > 1).sum()), SLICE):
        here = several & (place >= start) & (place < start + SLICE)
        matrix = np.zeros((len(used), SLICE), np.float32)
        spot[used] = np.arange(len(used))
        matrix[spot[of[here]], place[here] - start] = 1
        shared += matrix[spot[upper]] @ matrix[spot[lower]].T
    union = sizes[upper][:, None] + sizes[lower][None, :] - shared
    i, j = np.nonzero(open_ & (shared * 100.0 >= union * float(percent)))
    return pd.DataFrame({"a": node[upper[i]], "b": node[lower[j]]})


def _rest(members: DataFrame, links: DataFrame, nodes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that share a bucket and that ``links`` leave in different components."""
    united = components(links)
    labelled = members.join(united, members["node"] == united["id"], "left").select(
        "band", F.col("first.node").alias("first"), "node", "key", F.coalesce("component", "node").alias("component")
    )
    split = (
        labelled.groupBy("band")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter((F.col("n") > 2) & (F.col("low") != F.col("high")))
        .select("band")
    )
    left = materialise(labelled.join(split, "band").select("first", "node", "key", "component").distinct())
    # Nodes that buckets connect are one cluster, dealt into blocks by hash.
    cluster = components(left.select(F.col("first").alias("a"), F.col("node").alias("b")))
    named = cluster.select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    found = left.select("node", "key", F.col("component").alias("part")).distinct().join(named, "node")
    known = materialise(found.join(nodes.select("node", "key", "sketch", "n_shingles"), ["node", "key"]))
    blocks = known.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    sets = _sets_of(documents, known.select(F.col("node").alias("doc_id"), "key"))
    dealt = (
        known.join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
        .join(sets.withColumnRenamed("doc_id", "node"), ["node", "key"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cluster",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "node",
            "key",
            F.col("part").alias("component"),
            "sketch",
            "codes",
        )
    )
    return dealt.groupBy("cluster", "low", "high").applyInPandas(
        lambda rows: block_links(rows, percent), "a long, b long"
    )


def near_duplicates(documents: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = materialise(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, SIGNATURES))
    present = signed.filter(F.col("doc_id").isNotNull() & F.col("key1").isNotNull())
    nodes = materialise(
        present.groupBy("key1", "key2").agg(
            F.min("doc_id").alias("node"),
            F.count("*").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles"),
        )
    )
    # One id may have several texts, so a set is named by its smallest id and its own key.
    nodes = nodes.withColumnRenamed("key1", "key")
    placed = nodes.select("node", "key", F.explode("bands").alias("band"))
    name = F.struct("node", "key")
    full = placed.groupBy("band").agg(F.count("*").alias("n"), F.min(name).alias("first")).filter("n > 1")
    members = materialise(
        placed.join(full.select("band", "first"), "band").join(nodes.select("node", "key", "sketch"), ["node", "key"])
    )

    heads = members.filter(name == F.col("first")).select(
        "band", F.col("node").alias("a"), F.col("key").alias("a_key"), F.col("sketch").alias("sketch_a")
    )
    rest = members.filter(name > F.col("first"))
    stars = rest.join(heads, "band").filter(
        sketch_ones(F.col("sketch_a"), F.col("sketch")) <= max_ones(percent)
    )
    pairs = stars.select("a", "a_key", F.col("node").alias("b"), F.col("key").alias("b_key")).filter("a != b")
    pairs = materialise(pairs.distinct())
    links = materialise(_confirmed(pairs, documents, percent))

    every = links.union(_rest(members, links, nodes, documents, percent))

    final = components(materialise(every.union(_same_ids(present))))
    grouped = nodes.join(final, nodes["node"] == final["id"], "left").select(
        F.col("key").alias("key1"), "key2", F.coalesce("component", "node").alias("component"), "n", F.col("id")
    )
    moved = grouped.filter((F.col("n") > 1) | F.col("id").isNotNull()).select("key1", "key2", "component")
    out = signed.join(moved, ["key1", "key2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_ids(present: DataFrame) -> DataFrame:
    """Links between the nodes of rows that share an id."""
    nodes = present.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    twice = present.groupBy("doc_id").agg(F.count_distinct("key1", "key2").alias("k")).filter("k > 1").select("doc_id")
    rows = present.join(twice, "doc_id", "left_semi").join(nodes, ["key1", "key2"])
    firsts = rows.groupBy("doc_id").agg(F.min("node").alias("a"))
    return rows.join(firsts, "doc_id").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))

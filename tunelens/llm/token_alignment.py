"""Alignment of two tokenizers over the bytes of every text, by interval coalescing.

Both tokenizers cut the same bytes (a space and the text), so their tokens are intervals. All tokens
are sorted by where they start; the running maximum of their ends tells how far the tokens so far
reach, and a new group begins where a start has reached it: there tokens of both sides end. Within a
group every token of A is linked with the tokens of B that share bytes with it. How often two ids
are linked in the whole corpus then rates every document's links.

Neither tokenizer joins bytes across certain spaces, so a text is a sequence of units, a run of
spaces and what follows, and tokens, groups and links of a text are those of its units, one after
the other. A block of texts is cut into its distinct units, and those are tokenised, coalesced and
expanded once. A cut is made where a run of spaces follows a byte that is surely no white space, or
is one space before such a byte; any other run stays inside its unit, and so do spaces that end a text.

Shuffles: each block adds up its id pairs, and only these sums and their totals are shuffled, one row
for each pair and block, so a pair that is met everywhere costs one row for each block. Then each
block, packed into one row, meets the totals of its pairs. Pairs are never collected or broadcast:
tasks receive the two vocabularies, and a block needs memory for BLOCK_BYTES of text, or for one
longer text. Blocks are written once to the shared folder, with their numbers.

Defined results: null and empty texts have no tokens, and neither have texts whose tokens' bytes
differ from a space and the text (such as texts that hold the B vocabulary's own space mark); they
count zero throughout and have empty groups. Repeated rows and null ids are rows of their own; equal
counts are all highest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelens.llm.tokens import chunks, span_codes, text_bytes
from tunelens.session import materialise

BYTE_LEVEL_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 12_000_000
UNITS_AT_ONCE = 60_000  # tokenised and linked together, which bounds what a block needs beside its text
TEXT_BYTES = 4_000  # units are handed to a tokenizer in texts of about so many bytes
PAIR = 2**32  # an id pair is a * PAIR + b

BLOCKS = "block long, pairs array<long>, times array<long>, body binary"
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
)

SURE = np.zeros(256, bool)  # bytes that are, or begin, a character that is no white space
SURE[0x21:0x80] = SURE[0xC3:0xE1] = SURE[0xE4:] = True


class Vocabulary:
    """A tokenizer and the bytes of its ids; made from a file's bytes, so it can be sent to tasks."""

    def __init__(self, data: bytes):
        self.data = data

    def __getstate__(self) -> dict:
        return {"data": self.data}

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each begins and how many it has."""
        each = self.id_bytes()
        sizes = np.array([len(b) for b in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes

    def id_bytes(self) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        raise NotImplementedError

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        flat, starts, sizes = self.table
        return flat[spread(starts[ids], sizes[ids])]


class ByteLevel(Vocabulary):
    """Byte-level BPE from a tokenizer file in JSON."""

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        found = Tokenizer.from_str(self.data.decode())
        found.encode_special_tokens = True  # their strings in a text are plain text
        return found

    def id_bytes(self) -> list[bytes]:
        # Printable bytes stand for themselves, the others for characters from 256 on, in order.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        found = self.tokenizer
        names = [found.id_to_token(i) or "" for i in range(found.get_vocab_size())]
        return [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SentencePieces(Vocabulary):
    """Pieces from a model file; the model puts a space before every text itself."""

    @cached_property
    def tokenizer(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    def id_bytes(self) -> list[bytes]:
        model = self.tokenizer
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [
            bytes([int(n[1:-1], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode([t[1:] for t in texts], num_threads=1)


def byte_level(path: str = BYTE_LEVEL_FILE) -> ByteLevel:
    with open(path, "rb") as file:
        return ByteLevel(file.read())


def sentence_pieces(path: str = PIECES_FILE) -> SentencePieces:
    with open(path, "rb") as file:
        return SentencePieces(file.read())


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def cut_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and which of them may stand in any order without changing their tokens.

    ``data`` holds texts that begin with a space, between ``bounds``.
    """
    n = len(data)
    space = data == 0x20
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    first = space & opens[:n]
    first[1:] |= space[1:] & ~space[:-1]
    last = space.copy()
    last[:-1] &= ~space[1:] | opens[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    before = padded[start + 2]
    wide = (padded[start + 1] == 0xC2) | ((padded[start] >= 0xE1) & (padded[start] <= 0xE3))
    solid = (before > 0x20) & ((before < 0x80) | ~wide)
    free = (stop - start == 1) & ~opens[stop] & SURE[padded[stop + 3]]
    cut = opens[start] | (solid & ~opens[stop]) | free
    start, free = start[cut], free[cut]
    stop = np.append(start[1:], n)
    return start, free & ~space[stop - 1]


def tokenise(
    vocabulary: Vocabulary, data: np.ndarray, bounds: np.ndarray, free: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and starts of the tokens of units that lie in a row, and which units' bytes come out right.

    Free units are tokenised many at a time. Where the bytes of such a text differ, its units are
    tokenised one by one; units whose own bytes differ have no tokens.
    """
    alone = np.flatnonzero(~free)
    heads = np.flatnonzero(np.diff(bounds[:-1] // TEXT_BYTES, prepend=-1) != 0)
    heads = np.unique(np.concatenate([heads, alone, alone + 1, [0]]))
    heads = heads[heads < len(free)]
    stops = np.append(heads[1:], len(free))
    raw = data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(bounds[heads].tolist(), bounds[stops].tolist(), strict=True)]
    lists = vocabulary.encode(texts)
    counts = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
    sizes = vocabulary.table[2][ids]
    text = np.repeat(np.arange(len(texts)), counts)
    lengths = bounds[stops] - bounds[heads]
    right = np.bincount(text, sizes, len(texts)).astype(np.int64) == lengths
    if not right.all():
        kept = right[text]
        ids, sizes, text = ids[kept], sizes[kept], text[kept]
    places = spread(bounds[heads][right], lengths[right])
    differs = vocabulary.spelled(ids) != data[places]
    if differs.any():
        owner = np.repeat(np.flatnonzero(right), lengths[right])
        wrong = np.unique(owner[differs])
        right[wrong] = False
        kept = right[text]
        ids, sizes, text = ids[kept], sizes[kept], text[kept]
    total = np.concatenate([[0], np.cumsum(sizes)])
    sum_before = np.concatenate([[0], np.cumsum(lengths[right])])[:-1]
    shift = np.zeros(len(texts), np.int64)
    shift[right] = bounds[heads][right] - sum_before
    starts = total[:-1] + shift[text]
    fine = np.repeat(right, stops - heads)
    again = np.flatnonzero(~np.repeat(right | (stops - heads == 1), stops - heads))
    if len(again):
        size = np.diff(bounds)[again]
        inner = np.concatenate([[0], np.cumsum(size)])
        own = tokenise(vocabulary, data[spread(bounds[again], size)], inner, np.zeros(len(again), bool))
        unit = np.searchsorted(inner, own[1], side="right") - 1
        ids = np.concatenate([ids, own[0]])
        starts = np.concatenate([starts, own[1] - inner[unit] + bounds[again][unit]])
        order = np.argsort(starts, kind="stable")
        ids, starts = ids[order], starts[order]
        fine[again] = own[2]
    return ids, starts, fine


class Units:
    """Tokens, groups and links of distinct units that lie in a row, UNITS_AT_ONCE at a time."""

    def __init__(self, a: Vocabulary, b: Vocabulary, data: np.ndarray, bounds: np.ndarray, free: np.ndarray):
        self.shown: list[bytes] = []
        found: dict[str, list[np.ndarray]] = {}
        for at in range(0, max(len(free), 1), UNITS_AT_ONCE):
            inner = bounds[at : at + UNITS_AT_ONCE + 1]
            part = self._some(a, b, data[inner[0] : inner[-1]], inner - inner[0], free[at : at + UNITS_AT_ONCE])
            for name, value in part.items():
                found.setdefault(name, []).append(value)
        self.fine, self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs = (
            np.concatenate(found[name]) for name in ("fine", "n_a", "n_b", "n_groups", "n_links", "pairs")
        )

    def _some(
        self, a: Vocabulary, b: Vocabulary, data: np.ndarray, bounds: np.ndarray, free: np.ndarray
    ) -> dict[str, np.ndarray]:
        sides = [tokenise(v, data, bounds, free) for v in (a, b)]
        fine = sides[0][2] & sides[1][2]
        ids, starts, ends, unit = [], [], [], []
        for vocabulary, (own, start, _) in zip((a, b), sides, strict=True):
            of = np.searchsorted(bounds, start, side="right") - 1
            kept = fine[of]
            ids.append(own[kept])
            starts.append(start[kept])
            ends.append(start[kept] + vocabulary.table[2][own[kept]])
            unit.append(of[kept])
        n = len(bounds) - 1
        n_a, n_b = (np.bincount(u, minlength=n) for u in unit)
        # Coalesce: a group breaks where a start has reached the furthest end so far.
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        every = [np.concatenate(x) for x in (ids, starts, ends, unit)]
        order = np.lexsort((side, every[1]))
        reach = np.maximum.accumulate(every[2][order]) if len(order) else every[2]
        breaks = np.ones(len(order), bool)
        breaks[1:] = every[1][order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        n_groups = np.bincount(every[3][order][breaks], minlength=n)
        self.shown += self._shown(every[0], group, side, every[3], n)
        # Expand: the tokens of B that share bytes with each token of A.
        low = np.searchsorted(ends[1], starts[0], side="right")
        number = np.searchsorted(starts[1], ends[0], side="left") - low
        pairs = np.repeat(ids[0], number) * PAIR + ids[1][spread(low, number)]
        n_links = np.bincount(unit[0], number, n).astype(np.int64)
        return {"fine": fine, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "pairs": pairs}

    @staticmethod
    def _shown(ids: np.ndarray, group: np.ndarray, side: np.ndarray, unit: np.ndarray, n: int) -> list[bytes]:
        """Groups of each unit as ``a1,a2|b1;a3|b2,b3``."""
        order = np.lexsort((side, group))  # stable, so tokens of one side stay in order
        ids, group, side, unit = ids[order], group[order], side[order], unit[order]
        sign = np.full(len(ids), ord(";"), np.uint8)
        same = group[1:] == group[:-1]
        sign[:-1][same] = np.where(side[1:] == side[:-1], ord(","), ord("|"))[same]
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
        ends = np.cumsum(digits + 1)
        text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        rest, k = ids.copy(), 0
        text[ends - 1] = sign
        left = np.arange(len(ids))
        while len(left):
            text[ends[left] - 2 - k] = ord("0") + rest[left] % 10
            rest[left] //= 10
            k += 1
            left = left[digits[left] > k]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(unit, digits + 1, n).astype(np.int64))])
        raw = text.tobytes()
        return [raw[a : b - 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _block(rows: pa.RecordBatch, a: Vocabulary, b: Vocabulary, show: Callable[[bytes], str]) -> dict:
    """One block: id pairs with their number, and a packed body for the second pass."""
    texts = pc.fill_null(rows.column(1).cast(pa.large_string()), "")
    none, space = (pa.scalar(s, pa.large_string()) for s in ("", " "))
    marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(none, texts, space))
    data, bounds = text_bytes(marked)
    starts, free = cut_units(data, bounds)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    codes = [np.zeros(0, np.uint64)]
    for at in range(0, len(starts), UNITS_AT_ONCE):
        some, last = starts[at : at + UNITS_AT_ONCE], ends[min(at + UNITS_AT_ONCE, len(ends)) - 1]
        part = data[some[0] : last]
        codes.append(span_codes(part, some - some[0], ends[at : at + UNITS_AT_ONCE] - some[0], np.ones(len(part), bool)))
    codes = np.concatenate(codes)
    _, sample, unit = np.unique(codes, return_index=True, return_inverse=True)
    # Units that may stand anywhere come first, so they are tokenised in long texts.
    order = np.argsort(~free[sample], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sample, unit = sample[order], place[unit]
    size = (ends - starts)[sample]
    inner = np.concatenate([[0], np.cumsum(size)])
    units = Units(a, b, data[spread(starts[sample], size)], inner, free[sample])
    first = np.searchsorted(starts, bounds)
    n_units = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n_units)
    fine = np.bincount(doc, ~units.fine[unit], len(texts)) == 0 if len(doc) else np.ones(len(texts), bool)
    used = fine[doc]
    summed = {
        name: np.bincount(doc[used], getattr(units, name)[unit[used]], len(texts)).astype(np.int64)
        for name in ("n_a", "n_b", "n_groups", "n_links")
    }
    groups = []
    for k, (start, stop) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        own = b";".join([units.shown[u] for u in unit[start:stop].tolist()]) if fine[k] else b""
        groups.append(show(own) if own else "")
    pairs, link = np.unique(units.pairs, return_inverse=True)
    owner = np.repeat(np.arange(len(units.n_links)), units.n_links)
    times = np.bincount(link, np.bincount(unit[used], minlength=len(units.n_links))[owner], len(pairs))
    body = {
        "doc_id": rows.column(0).cast(pa.int64()),
        "groups": pa.array(groups),
        "n_units": pa.array(np.where(fine, n_units, 0)),
    } | {name: pa.array(value) for name, value in summed.items()}
    parts = [
        pa.record_batch(body),
        pa.record_batch({"unit": pa.array(unit[used].astype(np.int32))}),
        pa.record_batch({"links": pa.array(units.n_links.astype(np.int32))}),
        pa.record_batch({"link": pa.array(link.astype(np.int32))}),
    ]
    return {"pairs": pairs, "times": times.astype(np.int64), "body": pack(parts)}


def pack(parts: list[pa.RecordBatch]) -> bytes:
    """Record batches as compressed bytes, each behind its length."""
    found = []
    for part in parts:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(part)
        data = sink.getvalue().to_pybytes()
        found += [len(data).to_bytes(8, "little"), data]
    return b"".join(found)


def unpack(body: bytes) -> list[pa.Table]:
    found, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 8], "little")
        found.append(pa.ipc.open_stream(body[at + 8 : at + 8 + size]).read_all())
        at += 8 + size
    return found


def blocks(
    documents: DataFrame, a: Vocabulary, b: Vocabulary, show: Callable[[bytes], str], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each block of texts; to be written once, as numbers name a task's blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch.column(1), block_bytes):
                found = _block(batch.slice(part.start, part.stop - part.start), a, b, show)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([found["pairs"]], pa.list_(pa.int64())),
                        pa.array([found["times"]], pa.list_(pa.int64())),
                        pa.array([found["body"]], pa.binary()),
                    ],
                    names=["block", "pairs", "times", "body"],
                )
                number += 1

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, BLOCKS)


def pair_counts(blocks_: DataFrame) -> DataFrame:
    """(pair, a, b, n, highest): how often two ids are linked, and whether no A id has that B id more often."""
    each = blocks_.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    summed = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")).filter("n > 0")
    named = summed.withColumn("a", F.floor(F.col("pair") / PAIR)).withColumn("b", F.col("pair") % PAIR)
    # A group holds one row for each A id at most.
    return named.withColumn("highest", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            docs, unit, links, link = unpack(batch.column("body")[row].as_py())
            rates = batch.column("rates")[row].values
            width = len(rates) if rates is not None else 0
            count, highest = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
            if width:
                at = rates.field("place").to_numpy(zero_copy_only=False)
                count = np.zeros(int(at.max()) + 2, np.int64)
                highest = np.zeros(int(at.max()) + 2, np.int64)
                count[at] = rates.field("n").to_numpy(zero_copy_only=False)
                highest[at] = rates.field("highest").to_numpy(zero_copy_only=False)
            unit, links, link = (t.column(0).to_numpy() for t in (unit, links, link))
            link = np.minimum(link, len(count) - 1)  # pairs of texts without tokens have no count
            owner = np.repeat(np.arange(len(links)), links)
            sums = [np.bincount(owner, x[link], len(links)).astype(np.int64) for x in (highest, count)]
            doc = np.repeat(np.arange(len(docs)), docs.column("n_units").to_numpy())
            totals = [np.zeros(len(docs), np.int64) for _ in sums]
            for total, each in zip(totals, sums, strict=True):
                np.add.at(total, doc, each[unit])
            names = [c.split()[0] for c in ALIGNED.split(", ")]
            columns = {c: docs.column(c).combine_chunks() for c in names if c in docs.column_names}
            columns |= {"n_best": pa.array(totals[0]), "count_sum": pa.array(totals[1])}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def as_text(groups: bytes) -> str:
    return groups.decode()


def as_digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest()


def align(
    documents: DataFrame,
    a: Vocabulary | None = None,
    b: Vocabulary | None = None,
    show: Callable[[bytes], str] = as_text,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Tokens, groups and links of every document, and how its links rate in the corpus.

    ``groups`` tells the ids of both sides group by group, ``a1,a2|b1;a3|b2,b3``; ``as_digest`` for
    ``show`` keeps only their SHA-256. ``n_best`` counts the links whose id pair is linked most often
    among those of its B id, ``count_sum`` adds up all links' counts.
    """
    found = materialise(blocks(documents, a or byte_level(), b or sentence_pieces(), show, block_bytes))
    counts = pair_counts(found).select("pair", "n", "highest")
    met = found.select("block", F.posexplode("pairs").alias("place", "pair"))
    rates = (
        met.join(counts, "pair")
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "n", "highest")).alias("rates"))  # a block's pairs, bounded
    )
    return found.select("block", "body").join(rates, "block", "left").mapInArrow(_rated, ALIGNED)

"""LM scoring by online logistic context mixing over the bits of word codes.

Text is a sequence of lower-cased words and an end. The commonest training words, the end and one
escape for all other words have Huffman codes, so a token is some ten binary decisions. For each
decision four predictors, the node of the code alone and the node hashed with one word before, with
two words before and with the word before last, tell the log odds counted over the training text.
A logistic mixer adds them up with weights chosen by a gate (depth in the code and how often the
hashed contexts were seen). The weights start from values fitted on all training text and are refined
for each document while it is read: every block of BLOCK tokens is coded with the weights learned from
all blocks of the text before it, however long the text is. An escaped word is then told apart by its
smoothed training count among all other words.

Counts of all words grow with the corpus and stay a Spark table, joined with the rare words of the
scored texts; words that are too common for such a join are the vocabulary. Each hashed predictor
has as many slots as there are training tokens, rounded up to a power of two, up to ``most_slots``:
what tasks receive is bounded, two bytes a slot and VOCABULARY words. Counts are added up in each
task and travel as compressed ranges of slots, which are summed as they arrive; the driver sees the
packed slots only. Slots of LINE_DEPTH levels of the code lie together, so a token touches few lines
of memory. All training documents are counted, whatever their length.

The starting weights are a logistic regression over every decision of every training document, each
seen as if it had not been counted itself. Per gate, decisions are counted by their bit and by the
interval (EDGES) of each predictor's log odds; these counts are added up over all tasks, so the weights
do not depend on how rows are dealt out, and a gate is fitted where its sums are. A text is tokenised
once, after its words are counted; later passes read the token ids.

Defined results: null text is empty, one end token; without training documents every count is 0,
which the smoothing covers; repeated rows are scored one by one; null ids count as empty text for
the split; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tokens import Words, chunks, mix
from tunelens.session import materialise

VOCABULARY = 65_000
LEAST_SLOTS, MOST_SLOTS = 2**16, 2**22  # of each hashed predictor; between them as many as training tokens
RANGE = 2**16  # slots whose counts travel together
CHUNK = 800_000  # bytes of text coded at once: about 1,200,000 decisions
CHUNK_TOKENS = 60_000  # of stored tokens: about 600,000 decisions
PIECE = 8_000  # tokens whose decisions are looked up at once: what is in work stays in a core's cache
BLOCK = 48  # tokens coded with the same weights
RATE = 0.015
SMOOTHING = 0.1  # of word counts
ODDS = 0.4  # added to both counts of a decision
STEP = 0.025  # of stored log odds, which lie within 12.8 of 0
DEPTHS = 24
LINE_DEPTH = 4  # levels of the code whose slots for one context lie together
LEVELS = 4  # how often a hashed context was seen: never, 1-3, 4-15, more
INPUTS = 5  # four predictors and a constant
START = 0.3  # weights of a gate that training text never takes; others are drawn to it as by one decision
EDGES = np.array([-7, -4, -2, -0.8, -0.2, 0.2, 0.8, 2, 4, 7])  # between intervals of log odds
MIDDLES = np.concatenate([[EDGES[0] - 1], (EDGES[1:] + EDGES[:-1]) / 2, [EDGES[-1] + 1]])
INTERVALS = len(MIDDLES)
INTERVAL_OF = np.tile(np.digitize((np.arange(1024) - 512) * STEP, EDGES), LEVELS)  # of packed slots
TAKEN = 1 << 10  # marks facts of a step, which are its depth, its place among the slots of its group and its bit
START_BITS = 18  # of the code of a word, by which it is looked up
CELL_BITS = 14  # INTERVALS ** (INPUTS - 1) cells have numbers below CELLS
CELLS = 2**CELL_BITS

COUNTED = "code long, n long"
TOKENS = (
    "uid long, doc_id long, training boolean, n_tokens long, known long, base double, n_bytes long, ids binary, "
    "rare array<long>"
)
COUNTS = "range int, counts binary"
PACKED = "range int, every binary, cells binary"
SCORED = "uid long, doc_id long, n_tokens long, known long, base double, n_bytes long, bits double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def word_counts(texts: DataFrame) -> DataFrame:
    """(code, n) of all words of a text column, summed up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sums = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for part in chunks(batch.column(0)):
                found = np.unique(Words(batch.column(0).slice(part.start, part.stop - part.start)).codes(),
                                  return_counts=True)
                codes.append(found[0])
                sums.append(found[1])
            keys, place = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(place, np.concatenate(sums), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(total)], names=["code", "n"])

    return texts.mapInArrow(count, COUNTED).groupBy("code").agg(F.sum("n").alias("n"))


class Codes:
    """Huffman codes of token ids: nodes passed and bits taken, one after the other."""

    def __init__(self, counts: np.ndarray):
        parent, bit = self._tree(counts)
        n = len(counts)
        paths = []
        for leaf in range(n):
            path, at = [], leaf
            while parent[at] >= 0:
                path.append((parent[at] - n) * 2 + bit[at])
                at = parent[at]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        steps = np.array([s for p in paths for s in p], np.int64)
        self.node, self.bit = (steps >> 1).astype(np.int32), (steps & 1).astype(np.int8)
        self.nodes = n - 1
        self._group(parent, bit)
        # A code is cut into groups of steps, the last one filled up; one look-up tells the facts of a whole group.
        self.lines = -(-self.length // LINE_DEPTH)
        self.first_line = np.cumsum(self.lines) - self.lines
        of = np.repeat(np.arange(n), self.lines)
        place = LINE_DEPTH * (np.arange(len(of)) - self.first_line[of])[:, None] + np.arange(LINE_DEPTH)
        self.taken = place < self.length[of][:, None]
        self.line_step = np.where(self.taken, self.start[of][:, None] + place, 0).astype(np.int32)
        self.line_salt = self.salt[self.node[self.line_step[:, 0]]]
        self.line_facts = self.by_lines(
            TAKEN | self.depth[self.node] << 5 | self.place[self.node].astype(np.int32) << 1 | self.bit
        )

    def by_lines(self, steps: np.ndarray) -> np.ndarray:
        """16-bit values of all steps, those of a group as one number; 0 where a group is filled up."""
        return np.where(self.taken, steps[self.line_step], 0).astype(np.uint16).view(np.uint64)[:, 0]

    def _group(self, parent: list[int], bit: list[int]) -> None:
        """Depth of each node, a number shared by its group of LINE_DEPTH levels, and its place in there."""
        top = len(parent) - 1
        depth, root, place = ([0] * self.nodes for _ in range(3))
        for k in range(self.nodes - 1, -1, -1):  # parents come later than their children
            node = top + 1 - self.nodes + k
            above = parent[node] - top - 1 + self.nodes
            depth[k] = depth[above] + 1 if node < top else 0
            opens = depth[k] % LINE_DEPTH == 0
            root[k], place[k] = (k, 1) if opens else (root[above], 2 * place[above] + bit[node])
        self.depth = np.minimum(depth, DEPTHS - 1).astype(np.int32)
        self.salt = (mix(np.array(root, np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        self.place = np.array(place, np.uint32)

    @staticmethod
    def _tree(counts: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(counts)
        parent, bit = [-1] * (2 * n - 1), [0] * (2 * n - 1)
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        for new in range(n, 2 * n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left] = parent[right] = new
            bit[right] = 1
            heapq.heappush(heap, (a + b, new))
        return parent, bit


def packed(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of slots, rounded to STEP, and how often each was seen, as 16-bit numbers."""
    odds = np.clip(np.log((ones + ODDS) / (n - ones + ODDS)), -12, 12)
    level = np.digitize(n, [1, 4, 16]).astype(np.uint16)
    return (level << np.uint16(10)) | (np.rint(odds / STEP) + 512).astype(np.uint16)


def odds(found: np.ndarray) -> np.ndarray:
    """The log odds in packed slots."""
    out = (found & np.uint16(1023)).astype(np.float32)
    out -= 512
    out *= np.float32(STEP)
    return out


def shortened(table: np.ndarray) -> bytes:
    """Packed slots as they are sent and stored."""
    return pa.compress(table.tobytes(), "zstd", asbytes=True) if len(table) else b""


def restored(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 2 * n, "zstd") if n else b"", np.uint16)


class Model:
    """Vocabulary, codes, counted log odds and starting weights: all of bounded size."""

    def __init__(
        self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int, most_slots: int = MOST_SLOTS
    ):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        starts = np.arange(2**START_BITS, dtype=np.uint64) << np.uint64(64 - START_BITS)
        self.starts = np.searchsorted(self.words, starts)
        self.most_of_start = int(np.diff(self.starts, append=len(self.words)).max())
        self.bounded = np.append(self.words, np.uint64(2**64 - 1))
        self.total, self.distinct, self.ends = total, distinct, ends
        self.end, self.escape = len(words), len(words) + 1
        # Whatever is not in the vocabulary shares the escape.
        self.rare = total - int(counts.sum()) - ends
        self.rare_words = distinct - len(words) - (ends > 0)
        self.codes = Codes(np.concatenate([self.counts, [max(ends, 1), max(self.rare, 1)]]))
        self.context_slots = int(np.clip(1 << max(total - 1, 0).bit_length(), LEAST_SLOTS, most_slots))
        self.table = np.full(self.slots(), packed(np.zeros(1), np.zeros(1))[0])
        self.weights = np.full((INPUTS, self.gates()), START, np.float32)
        every = np.arange(self.escape + 2, dtype=np.uint64)  # and nothing before
        self.single = [(mix(every + np.uint64(1 << k)) >> np.uint64(32)).astype(np.uint32) for k in (40, 42)]
        self.stored = np.dtype("<u2" if self.escape < 2**16 else "<u4")  # of token ids in tables

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": (len(self.table), shortened(self.table))}  # each worker's copy lies on disk

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"table": restored(*reversed(state["table"]))}

    def slots(self) -> int:
        return self.codes.nodes + 3 * self.context_slots

    @staticmethod
    def gates() -> int:
        return DEPTHS * LEVELS * LEVELS

    def base(self, count: float) -> float:
        return math.log10((count + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))

    def search(self, codes: np.ndarray) -> np.ndarray:
        """How many words of the vocabulary have a smaller code, from how many have a smaller start of it."""
        if self.most_of_start > 8:  # codes are hashes, so few share a start
            return np.searchsorted(self.words, codes)
        at = self.starts.take((codes >> np.uint64(64 - START_BITS)).astype(np.int64))
        for _ in range(self.most_of_start):
            at += self.bounded.take(at) < codes
        return at

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids with an end after each text, their text, and the codes of escaped words."""
        codes = words.codes()
        at = np.minimum(self.search(codes), max(len(self.words) - 1, 0))
        known = self.words[at] == codes if len(self.words) else np.zeros(len(codes), bool)
        ends = words.first_word[1:] + np.arange(len(words.counts))
        ids = np.empty(len(codes) + len(words.counts), np.int64)
        inner = np.ones(len(ids), bool)
        inner[ends] = False
        ids[inner] = np.where(known, at, self.escape)
        ids[ends] = self.end
        return ids, np.repeat(np.arange(len(words.counts)), words.counts + 1), codes[~known]

    def parts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Token ids, their text and the number of texts, some at a time; of texts or of stored token ids."""
        if not pa.types.is_binary(column.type):
            for part in chunks(column, CHUNK):
                words = Words(column.slice(part.start, part.stop - part.start))
                yield *self.tokens(words)[:2], len(words.counts)
            return
        for part in chunks(column, CHUNK_TOKENS * self.stored.itemsize):
            some = column.slice(part.start, part.stop - part.start).cast(pa.large_binary())
            bounds = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            ids = np.frombuffer(some.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(self.stored)
            number = np.diff(bounds) // self.stored.itemsize
            yield ids.astype(np.int64), np.repeat(np.arange(len(some)), number), len(some)

    def contexts(self, ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """Hashes of what stands before each token: one word, two words, the word before last."""
        first = np.ones(len(ids), bool)
        first[1:] = doc[1:] != doc[:-1]
        before = np.full(len(ids), self.escape + 1, np.int64)
        before[1:] = np.where(first[1:], self.escape + 1, ids[:-1])
        earlier = np.full(len(ids), self.escape + 1, np.int64)
        earlier[1:] = np.where(first[1:], self.escape + 1, before[:-1])
        one, last = self.single
        with np.errstate(over="ignore"):
            two = mix(before.astype(np.uint64) * np.uint64(1 << 20) + earlier.astype(np.uint64) + np.uint64(1 << 41))
        return [one[before], (two >> np.uint64(32)).astype(np.uint32), last[earlier]]

    def walk(
        self, ids: np.ndarray, contexts: list[np.ndarray], bits: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """The decisions of some tokens at a time, in the given order of tokens, with groups filled up.

        The groups, the facts of each decision and its slot for each context; with two bits the place of the bit that
        came in a table of (zero, one).
        """
        codes = self.codes
        shift = np.uint32(33 - self.context_slots.bit_length())
        for begin in range(0, len(ids), PIECE):
            some = ids[begin : begin + PIECE]
            lines = codes.lines[some]
            line = np.repeat(codes.first_line[some] - (np.cumsum(lines) - lines), lines)
            line += np.arange(len(line))
            salt, facts = codes.line_salt.take(line), codes.line_facts.take(line).view(np.uint16)
            place = ((facts & 31) if bits == 2 else (facts >> 1 & 15)).astype(np.int64)
            slots = []
            for k, context in enumerate(contexts):
                hashed = np.repeat(context[begin : begin + PIECE], lines)
                hashed ^= salt
                hashed *= np.uint32(0x9E3779B1)
                hashed >>= shift
                group = hashed.astype(np.int64)
                group += k * self.context_slots
                group *= bits
                slot = np.repeat(group, LINE_DEPTH)
                slot ^= place
                slots.append(slot)
            yield line, facts, slots

    def decisions(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every binary decision: its token, bit, depth and the slot of each predictor, token by token."""
        codes, length = self.codes, self.codes.length[ids]
        token = np.repeat(np.arange(len(ids)), length)
        node = codes.node[codes.start[ids[token]] + np.arange(len(token)) - (np.cumsum(length) - length)[token]]
        parts = [(facts, *slots) for _, facts, slots in self.walk(ids, self.contexts(ids, doc), 1)]
        facts, *slots = (np.concatenate(p) for p in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        taken = facts >= TAKEN
        facts, *slots = (x[taken] for x in (facts, *slots))
        return token, (facts & 1).astype(np.int8), facts >> 5 & 31, [node + np.int64(3 * self.context_slots), *slots]

    def nodes(self) -> np.ndarray:
        """What the table tells of each step by its node alone, by groups."""
        return self.codes.by_lines(self.table[3 * self.context_slots :][self.codes.node])

    def cost(self, ids: np.ndarray, doc: np.ndarray, n_docs: int, nodes: np.ndarray | None = None) -> np.ndarray:
        """Bits of the decisions of each text; ``nodes()`` may be given, so they are not looked up again."""
        nodes = self.nodes() if nodes is None else nodes
        starts = np.searchsorted(doc, np.arange(n_docs))
        block = (np.arange(len(ids)) - starts[doc]) // BLOCK
        if len(block) and block.max() < 2**15:
            block = block.astype(np.int16)  # sorted by radix
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(int(block.max(initial=0)) + 2))
        contexts = [c[order] for c in self.contexts(ids, doc)]
        ids, doc = ids[order], doc[order]
        length = self.codes.length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        row = np.repeat(doc * self.gates(), length)
        found = [np.empty(len(row), np.uint16) for _ in range(INPUTS - 1)]
        sign = np.empty(len(row), np.float32)
        at = 0
        for line, facts, slots in self.walk(ids, contexts, 1):
            taken = np.flatnonzero(facts >= TAKEN)
            part = slice(at, at := at + len(taken))
            some = [f[part] for f in found]
            nodes.take(line).view(np.uint16).take(taken, out=some[0], mode="clip")
            looked_up = np.empty(len(facts), np.uint16)
            for f, slot in zip(some[1:], slots, strict=True):
                self.table.take(slot, out=looked_up, mode="clip").take(taken, out=f, mode="clip")
            facts = facts.take(taken)
            # Which weights a decision takes: its depth, and how often its first two contexts were seen.
            gate = facts >> 5 & 31
            for f in some[1:3]:
                gate *= LEVELS
                gate += f >> 10
            row[part] += gate
            sign[part] = facts & 1
        sign *= 2
        sign -= 1
        own = np.empty(self.weights.shape, np.float32)  # np.add.at is slow on a dtype that was pickled
        own[:] = self.weights
        if n_docs * self.gates() <= len(row):
            weights = [np.tile(w, n_docs) for w in own]
        else:  # many short texts: only the weights that are met
            used, row = np.unique(row, return_inverse=True)
            weights = [w[used % self.gates()] for w in own]
        wrong = np.empty(len(sign), np.float32)  # odds against the bit that came
        for start, stop in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True):
            r, s, odd = row[start:stop], sign[start:stop], wrong[start:stop]
            x = [odds(f[start:stop]) for f in found]
            logit = weights[-1].take(r)
            for w, value in zip(weights, x):
                some = w.take(r)
                some *= value
                logit += some
            logit *= s
            np.negative(logit, out=logit)
            np.maximum(logit, -16, out=logit)
            np.minimum(logit, 16, out=logit)
            np.exp(logit, out=odd)
            step = odd / (odd + 1)
            step *= s
            step *= np.float32(RATE)
            for w, value in zip(weights, x):
                value *= step
                np.add.at(w, r, value)
            np.add.at(weights[-1], r, step)
        np.log1p(wrong, out=wrong)
        bits = np.add.reduceat(wrong, ends[:-1], dtype=np.float64) if len(ids) else wrong
        return np.bincount(doc, bits, n_docs) / math.log(2)


def counted(model: Model, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often a zero and a one came at each slot, one after the other."""
    both = np.zeros(2 * model.slots(), np.uint32)
    met = np.zeros(len(model.codes.length), np.int64)
    codes = model.codes
    for batch in batches:
        for ids, doc, _ in model.parts(batch.column(0)):
            met += np.bincount(ids, minlength=len(met))
            for _, facts, slots in model.walk(ids, model.contexts(ids, doc), 2):
                once = (facts >> 10).astype(np.uint32)  # 0 where a group is filled up
                for slot in slots:
                    np.add.at(both, slot, once)
    # The first predictor knows the node alone, so its counts follow from those of the tokens.
    nodes = 2 * (codes.node + np.int64(3 * model.context_slots)) + codes.bit
    np.add.at(both, nodes, np.repeat(met, codes.length).astype(np.uint32))
    return both


def squeezed(counts: np.ndarray) -> bytes:
    """32-bit counts byte by byte, so the many zeros of small counts lie together; bytes that are 0 in all are left out."""
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    planes = counts.astype(np.uint8) if width == 1 else np.ascontiguousarray(
        counts.view(np.uint8).reshape(-1, 4)[:, :width].T
    )
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expanded(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(pa.decompress(data[1:], width * n, "zstd"), np.uint8).reshape(width, n)
    if width == 1:
        return raw[0].astype("<u4")
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u4").reshape(n)


def _token_rows(model: Model):
    base = np.array([model.base(c) for c in [*model.counts.tolist(), model.ends, 0]])
    base[model.escape] = 0.0  # escaped words are added by their own counts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(3), CHUNK):
                some = batch.slice(part.start, part.stop - part.start)
                words = Words(some.column(3))
                n = len(words.counts)
                ids, doc, rare = model.tokens(words)
                escaped = np.bincount(doc[ids == model.escape], minlength=n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(escaped)]).astype(np.int32))
                ended = 1 if model.ends else 0
                data = ids.astype(model.stored).tobytes()
                ends = (np.cumsum(words.counts + 1) * model.stored.itemsize).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *some.columns[:3],
                        pa.array((words.counts + 1).astype(np.int64)),
                        pa.array((words.counts - escaped + ended).astype(np.int64)),
                        pa.array(np.bincount(doc, base[ids], n)),
                        pa.array(np.diff(words.bounds).astype(np.int64)),
                        pa.array([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(rare.astype(np.int64))),
                    ],
                    names=["uid", "doc_id", "training", "n_tokens", "known", "base", "n_bytes", "ids", "rare"],
                )

    return rows


def _count_rows(model: Model):
    """Counts of a task by ranges of slots."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = counted(model, batches)
        for place, start in enumerate(range(0, len(both), 2 * RANGE)):
            some = both[start : start + 2 * RANGE]
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([squeezed(some)], pa.binary())], names=["range", "counts"]
                )

    return rows


def without_one(both: np.ndarray) -> np.ndarray:
    """Packed slots from counts of (zero, one), as they are to a zero and to a one that was not counted itself."""
    found = np.empty(both.shape, np.uint16)
    for bit in range(2):
        others = both.copy()
        others[:, bit] = np.maximum(others[:, bit] - 1, 0)
        found[:, bit] = packed(others.sum(1), others[:, 1])
    return found


def in_cells(model: Model, found: np.ndarray, start: int) -> np.ndarray:
    """What packed slots from ``start`` on add to the number of a cell; on top their level, if gates know it."""
    context = (start + np.arange(len(found))) // model.context_slots  # the node alone comes after the third
    scale = (INTERVALS ** np.array([2, 1, 0, 3]))[np.minimum(context, 3)]
    level = np.where((context < 2)[:, None], found >> np.uint16(10), 0) << CELL_BITS
    return (INTERVAL_OF[found] * scale[:, None] + level).astype(np.uint16)


def _summed(model: Model):
    """Packed slots of each range from all counts, and ``in_cells`` from all others than a decision's own."""
    size = model.slots()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                width = min(RANGE, size - place * RANGE)
                total = sums.setdefault(place, np.zeros((width, 2), np.int64))
                total += expanded(data, 2 * width).reshape(width, 2)
        for place, every in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([place], pa.int32()),
                    pa.array([shortened(packed(every.sum(1), every[:, 1]))], pa.binary()),
                    pa.array([shortened(in_cells(model, without_one(every), place * RANGE))], pa.binary()),
                ],
                names=["range", "every", "cells"],
            )

    return rows


def met(model: Model, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often a zero and a one came at each gate and cell; the model's table is ``in_cells``."""
    both = np.zeros(model.gates() * CELLS * 2, np.uint32)
    codes, table = model.codes, model.table
    nodes = codes.by_lines(table[2 * (codes.node + np.int64(3 * model.context_slots)) + codes.bit])
    for batch in batches:
        for ids, doc, _ in model.parts(batch.column(0)):
            for line, facts, slots in model.walk(ids, model.contexts(ids, doc), 2):
                one, two, last = (table.take(s, out=np.empty(len(s), np.uint16), mode="clip") for s in slots)
                cell = nodes.take(line).view(np.uint16) + two  # and the level of two words before, on top
                cell += last
                cell += one & (CELLS - 1)
                gate = facts >> 5 & 31
                gate *= LEVELS
                gate += one >> CELL_BITS
                at = gate.astype(np.uint32)
                at *= LEVELS * CELLS
                at += cell
                at *= 2
                at += facts & 1
                np.add.at(both, at.astype(np.int64), (facts >> 10).astype(np.uint32))
    return both.reshape(model.gates(), CELLS, 2)


def _met_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gate, both in enumerate(met(model, batches)):
            if both.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gate], pa.int32()), pa.array([squeezed(both.ravel())], pa.binary())],
                    names=["gate", "counts"],
                )

    return rows


def fitted(both: np.ndarray) -> np.ndarray:
    """Weights of a gate by Newton's method, from how often a zero and a one came at each of its cells."""
    cells = np.flatnonzero(both.sum(1))
    n, ones = both[cells].sum(1).astype(float), both[cells, 1].astype(float)
    x = np.ones((len(cells), INPUTS))
    for k in range(INPUTS - 1):
        x[:, k] = MIDDLES[cells // INTERVALS ** (INPUTS - 2 - k) % INTERVALS]

    def loss(weights: np.ndarray) -> float:
        logit = x @ weights
        return float((n * np.logaddexp(0, logit) - ones * logit).sum() + ((weights - START) ** 2).sum() / 2)

    weights = np.full(INPUTS, START)
    least = loss(weights)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-(x @ weights)))
        slope = x.T @ (n * chance - ones) + weights - START
        curve = (x * (n * chance * (1 - chance))[:, None]).T @ x + np.eye(INPUTS)
        step = np.linalg.solve(curve, slope)
        while (now := loss(weights - step)) > least and np.abs(step).max() > 1e-9:
            step /= 2
        if least - now <= 1e-10 * least:
            break
        weights, least = weights - step, now
    return weights


def _fitted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for gate, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            total = sums.setdefault(gate, np.zeros((CELLS, 2), np.int64))
            total += expanded(data, 2 * CELLS).reshape(CELLS, 2)
    for gate, both in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([gate], pa.int32()), pa.array([fitted(both).tolist()], pa.list_(pa.float64()))],
            names=["gate", "weights"],
        )


def begin(training: DataFrame, counts: DataFrame, vocabulary: int, most_slots: int) -> Model:
    """The vocabulary and codes of a training table; ``counts`` are its word counts."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    ends = training.count()
    top = counts.orderBy(F.desc("n"), "code").limit(vocabulary).toArrow()
    model = Model(
        top["code"].to_numpy().astype(np.uint64),
        top["n"].to_numpy().astype(np.int64),
        int(sums["n"] or 0) + ends,
        int(sums["words"]) + (ends > 0),
        ends,
        most_slots,
    )
    model.table = model.table[:0]  # nothing to send yet
    return model


def learn(model: Model, training: DataFrame) -> Model:
    """Count the predictors and fit the starting weights; ``training`` has one column, texts or stored token ids."""
    every = training.mapInArrow(_count_rows(model), COUNTS)
    # Every row of a range meets in one task, which adds them up as they come.
    found = materialise(every.repartition("range").mapInArrow(_summed(model), PACKED))

    def whole(name: str, bits: int) -> np.ndarray:
        table = np.repeat(packed(np.zeros(1), np.zeros(1)), bits * model.slots())
        for batch in found.select("range", name).toArrow().to_batches():
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = table[at * bits * RANGE : (at + 1) * bits * RANGE]
                part[:] = restored(data.as_py(), len(part))
        return table

    model.table = whole("cells", 2)
    cells = training.mapInArrow(_met_rows(model), "gate int, counts binary")
    weights = cells.repartition("gate").mapInArrow(_fitted_rows, "gate int, weights array<double>").collect()
    for row in weights:
        model.weights[:, row.gate] = row.weights
    model.table = whole("every", 1)
    return model


def fit(
    training: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, most_slots: int = MOST_SLOTS
) -> Model:
    """The model of a training table (doc_id, text); ``counts`` are its word counts."""
    model = begin(training, counts, vocabulary, most_slots)
    return learn(model, training.select(F.coalesce("text", F.lit("")).alias("text")))


def _score_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = model.nodes()
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            # Texts of like length go together, so their blocks end together.
            order = np.argsort(pc.binary_length(ids).to_numpy(), kind="stable")
            bits = [model.cost(*part, nodes) for part in model.parts(ids.take(pa.array(order)))]
            found = np.empty(len(order))
            found[order] = np.concatenate([np.zeros(0), *bits])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found)], names=["uid", "doc_id", "n_tokens", "known", "base", "n_bytes", "bits"]
            )

    return rows


def score(documents: DataFrame, vocabulary: int = VOCABULARY, most_slots: int = MOST_SLOTS) -> DataFrame:
    """Token counts, base score, model score and bits per byte of every document.

    Learns from the documents whose split number is not 0.
    """
    split = held_out(F.col("doc_id"))
    training = documents.filter(split != 0).select("doc_id", "text")
    counts = materialise(word_counts(training.select("text")))
    model = begin(training, counts, vocabulary, most_slots)
    texts = documents.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long"),
        (split != 0).alias("training"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Written once, so a row's number is the same wherever it is read.
    tokens = materialise(texts.mapInArrow(_token_rows(model), TOKENS))
    learn(model, tokens.filter("training").select("ids"))
    scored = tokens.select("uid", "doc_id", "n_tokens", "known", "base", "n_bytes", "ids")
    scored = materialise(scored.mapInArrow(_score_rows(model), SCORED))
    smoothed = F.coalesce("n", F.lit(0)) + SMOOTHING
    among_all = model.total + SMOOTHING * (model.distinct + 1)
    among_rare = model.rare + SMOOTHING * (model.rare_words + 1)
    rare = tokens.select("uid", F.explode("rare").alias("code")).join(counts, "code", "left")
    added = rare.groupBy("uid").agg(
        F.count("n").alias("rare_known"),
        F.sum(F.log10(smoothed / F.lit(among_all))).alias("rare_base"),
        F.sum(F.log10(smoothed / F.lit(among_rare))).alias("rare_score"),
    )
    none = F.lit(0)
    whole = scored.join(added, "uid", "left")
    total = F.coalesce("rare_score", none) - F.col("bits") * math.log10(2)
    return whole.select(
        "doc_id",
        (held_out(F.col("doc_id")) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        total.alias("score"),
        F.when(F.col("n_bytes") > 0, -total / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )

"""SentencePiece encoding by suffix-array matching, and decoding.

The words of a batch of texts (each with its space mark) are indexed once: a suffix array of the
concatenated distinct words, sorted by prefix doubling up to the longest piece. Every piece of the
vocabulary is looked up by binary search, which gives the range of its occurrences; all occurrences
together are edges, sorted by the position where they end and relaxed from left to right for all
words at once.

The model merges pairs (BPE), so the edge kept at a position is not the one with the best sum of
scores but the only one that merging leaves: a piece may follow another if merging the two texts
together gives back these two pieces. That test depends on the pair alone and is remembered. A word
for which the edges do not single out one path is merged directly. Characters without a piece become
bytes. Runs of spaces are merged among themselves after the words, as their scores say.

The vocabulary is read from a model file on the driver and sent to the tasks (some 32,000 pieces);
texts are encoded where they are read, and nothing is shuffled.

Defined results: null gives null; empty text gives no pieces; a space mark in a text counts as a
space; repeated rows are encoded alike; other columns are carried along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelens.llm.tokens import chunks, span_codes, text_bytes

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK = np.frombuffer(SPACE.encode(), np.uint8)
APART = 0xFF  # never a byte of UTF-8, so no piece runs over it
CHUNK = 1_000_000
WORDS_CHUNK = 150_000  # bytes of new words indexed at once
MEMORY = 600_000  # words a task remembers before it starts afresh
START, BYTES = -1, -2  # before the first piece; a character told in bytes


class Pieces:
    """A piece vocabulary with its scores, as plain arrays and dictionaries."""

    def __init__(self, path: str = MODEL_FILE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.scores = {self.text[i]: model.get_score(i) for i in plain}
        self.first_byte = next((i for i in ids if model.is_byte(i)), None)
        self.unknown = model.unk_id()
        self.proper = np.zeros(len(self.text), bool)
        for text, i in self.ids.items():
            self.proper[i] = self.merged(text) == [text]
        inner = [i for i in plain if SPACE not in self.text[i][1:] and self.proper[i]]
        encoded = sorted((self.text[i].encode(), i) for i in inner)
        self.keys = [e for e, _ in encoded]
        self.key_ids = np.array([i for _, i in encoded], np.int64)
        self.sizes = np.array([len(t.encode()) for t in self.text], np.int64)
        self.longest = max(map(len, self.keys))
        self.known = {t for t in self.ids if len(t) == 1}
        self._runs: dict[int, list[int]] = {0: []}
        out = [
            bytes([i - self.first_byte]) if model.is_byte(i) else self.text[i].replace(SPACE, " ").encode() for i in ids
        ]
        control = [model.is_control(i) for i in ids]
        out = [b"" if c else o for c, o in zip(control, out, strict=True)]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_sizes = np.array([len(o) for o in out], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self._join_pairs()
        self._histories()

    def _join_pairs(self) -> None:
        """All pairs of pieces that make a piece, with its score, sorted by pair."""
        found = {}
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                if text[:cut] in self.ids and text[cut:] in self.ids:
                    found[self.ids[text[:cut]] * len(self.text) + self.ids[text[cut:]]] = self.scores[text]
        self.joins = np.array(sorted(found), np.int64)
        self.join_scores = np.array([found[k] for k in self.joins.tolist()])

    def _histories(self) -> None:
        """Scores of the merges that make each proper piece, and its outer parts before each of them."""
        made = {}
        for text, i in self.ids.items():
            if self.proper[i]:
                scores, left, right = [], [self.ids[text[0]]], [self.ids[text[-1]]]
                for score, parts in self.merges(text):
                    scores.append(score)
                    left.append(self.ids[parts[0]])
                    right.append(self.ids[parts[-1]])
                made[i] = scores, left, right
        steps = max((len(m[0]) for m in made.values()), default=0) + 1
        self.history = np.full((len(self.text), steps), -np.inf)
        self.outer_left = np.zeros((len(self.text), steps), np.int32)
        self.outer_right = np.zeros((len(self.text), steps), np.int32)
        for i, (scores, left, right) in made.items():
            self.history[i, : len(scores)] = scores
            self.outer_left[i, : len(left)] = left
            self.outer_right[i, : len(right)] = right

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """Score of each merge of a short text and its parts afterwards."""
        parts = list(text)
        while True:
            able = [(self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            score, i = max(able, default=(-np.inf, 0))
            if score == -np.inf:
                return
            parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
            yield score, parts

    def merged(self, text: str) -> list[str]:
        """The text's characters, merged by best score, then leftmost, until no pair is a piece."""
        parts: list[str] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                joined = parts[i] + parts[after[i]]
                if joined in self.scores:
                    heapq.heappush(queue, (-self.scores[joined], i, after[i], len(joined)))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def run(self, n: int) -> list[int]:
        """Pieces of a run of n space marks."""
        if n not in self._runs:
            self._runs[n] = self.plain(SPACE * n)
        return self._runs[n]

    def plain(self, text: str) -> list[int]:
        """Ids of a text by direct merging."""
        ids: list[int] = []
        for part in self.merged(text):
            ids += [self.ids[part]] if part in self.ids else self.spelled(part.encode())
        return ids

    def spelled(self, data: bytes) -> list[int]:
        return [self.unknown] if self.first_byte is None else [self.first_byte + b for b in data]

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right piece may stand after the left one; anything proper after START or BYTES.

        Both pieces' own merges run side by side, the better score first, until a merge across the
        border would come before them, or none is left.
        """
        fits = np.ones(len(left), bool)
        some = np.flatnonzero(left >= 0)
        pairs, place = np.unique(left[some] * len(self.text) + right[some], return_inverse=True)
        a, b = pairs // len(self.text), pairs % len(self.text)
        whole = np.ones(len(pairs), bool)
        i, j = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        open_ = np.arange(len(pairs))
        while len(open_):
            x, y = a[open_], b[open_]
            own, other = self.history[x, i[open_]], self.history[y, j[open_]]
            border = self.outer_right[x, i[open_]].astype(np.int64) * len(self.text) + self.outer_left[y, j[open_]]
            at = np.minimum(np.searchsorted(self.joins, border), len(self.joins) - 1)
            across = np.where(self.joins[at] == border, self.join_scores[at], -np.inf)
            # At equal scores the leftmost merge comes first.
            crossed = (across > own) & (across >= other) & (across > -np.inf)
            whole[open_[crossed]] = False
            going = ~crossed & ((own > -np.inf) | (other > -np.inf))
            first = going & (own >= other)
            i[open_[first]] += 1
            j[open_[going & ~first]] += 1
            open_ = open_[going]
        fits[some] = whole[place]
        return fits


def packed(data: np.ndarray, width: int) -> list[np.ndarray]:
    """For each place the next bytes as big-endian numbers of 8 bytes, ``width`` of them."""
    n = len(data)
    padded = np.concatenate([data, np.full(8 * width, APART, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + 8 * (width - 1), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    return [words[8 * w : 8 * w + n] for w in range(width)]


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if len(keys) else 0
    return rank


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by what follows, at least ``depth`` bytes deep."""
    key = packed(data, 1)[0]
    order = np.argsort(key)
    rank = _ranks(order, key)
    reach = 8
    while reach < depth:
        # Only places that are still tied with a neighbour move.
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(tied):
            break
        places = order[tied]
        ahead = np.where(places + reach < len(data), rank[np.minimum(places + reach, len(data) - 1)] + 1, 0)
        inner = np.lexsort((ahead, sorted_rank[tied]))
        order[tied] = places[inner]
        group, follow = sorted_rank[tied][inner], ahead[inner]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        # A place's rank is the position of the first place it is tied with.
        first = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank = rank.copy()
        position = np.arange(len(order))
        starts = np.ones(len(order), bool)
        starts[1:] = ~same
        rank[order] = np.maximum.accumulate(np.where(starts, position, 0))
        rank[order[tied]] = first
        reach *= 2
    return order


def occurrences(data: np.ndarray, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array and each key's range in it, by binary search for all keys at once."""
    width = -(-max(map(len, keys)) // 8)
    array = suffix_array(data, width * 8)
    suffixes = [w[array] for w in packed(data, width)]
    bounds = []
    for fill in (b"\x00", b"\xff"):
        wanted = np.frombuffer(b"".join(k.ljust(width * 8, fill) for k in keys), ">u8").astype(np.uint64)
        wanted = wanted.reshape(-1, width)
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(data), np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(data) - 1)
            smaller, equal = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for w in range(width):
                at = suffixes[w][middle]
                smaller |= equal & (at < wanted[:, w])
                equal &= at == wanted[:, w]
            # The upper bound lies after suffixes equal to the key with the highest bytes.
            right = (smaller | equal if fill == b"\xff" else smaller) & (low < high)
            left = ~right & (low < high)
            low[right] = middle[right] + 1
            high[left] = middle[left]
        bounds.append(low)
    return array, bounds[0], bounds[1]


def encode_words(
    pieces: Pieces, data: np.ndarray, heads: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, given as spans of ``data`` that begin with one space mark, and each one's number."""
    sizes = ends - heads
    n = len(heads)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.full(int(sizes.sum()) + n, APART, np.uint8)
    source = np.arange(int(sizes.sum())) + np.repeat(heads - (np.cumsum(sizes) - sizes), sizes)
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = data[source]
    array, low, high = occurrences(text, pieces.keys)
    count = high - low
    piece = np.repeat(pieces.key_ids, count)
    begin = array[np.arange(len(piece)) + np.repeat(low - (np.cumsum(count) - count), count)]
    end = begin + pieces.sizes[piece]
    # Characters without a piece of their own are edges told in bytes.
    lead = np.flatnonzero((text & 0xC0) != 0x80)
    width = np.select([text[lead] < 0x80, text[lead] < 0xE0, text[lead] < 0xF0], [1, 2, 3], 4)
    real = text[lead] != APART
    lead, width = lead[real], width[real]
    single = np.zeros(len(text) + 1, bool)
    one = np.array([len(t) == 1 for t in pieces.text])
    single[begin[one[piece]]] = True
    lone = ~single[lead]
    begin = np.concatenate([begin, lead[lone]])
    end = np.concatenate([end, (lead + width)[lone]])
    piece = np.concatenate([piece, np.full(int(lone.sum()), BYTES)])
    # Relax in the order of the place in the word where an edge ends, all words side by side.
    word = np.searchsorted(starts, begin, side="right") - 1
    place = end - starts[word]
    small = place.astype(np.uint16) if int(sizes.max(initial=0)) < 2**16 else place  # sorted by radix
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
    last = np.full(len(text) + 1, np.iinfo(np.int64).min)
    last[starts] = START
    unsure = np.zeros(n, bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        edges = order[a:b]
        edges = edges[last[begin[edges]] >= BYTES]
        follows = np.ones(len(edges), bool)
        inner = piece[edges] >= 0
        follows[inner] = pieces.follows(last[begin[edges[inner]]], piece[edges[inner]])
        edges = edges[follows]
        taken, times = np.unique(end[edges], return_counts=True)
        unsure[np.searchsorted(starts, taken[times > 1] - 1, side="right") - 1] = True
        last[end[edges]] = piece[edges]
    # Walk back from each word's end.
    stop = starts + sizes
    unsure |= last[stop] < BYTES
    found: list[list[int]] = [[] for _ in range(n)]
    active, at = np.flatnonzero(~unsure & (sizes > 0)), stop.copy()
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(active):
        here = last[at[active]]
        back = at[active] - 1
        spelled = np.flatnonzero(here == BYTES)
        while len(spelled):  # to the first byte of the character
            spelled = spelled[(text[back[spelled]] & 0xC0) == 0x80]
            back[spelled] -= 1
        width = np.where(here >= 0, pieces.sizes[np.maximum(here, 0)], at[active] - back)
        trail.append((active, here, at[active] - width))
        at[active] -= width
        active = active[at[active] > starts[active]]
    none = np.zeros(0, np.int64)
    words, ids, places = (np.concatenate([none, *(t[k] for t in trail)]) for k in range(3))
    order = np.argsort(places, kind="stable")  # words lie one after the other
    words, ids, places = words[order], ids[order], places[order]
    odd = np.union1d(words[ids == BYTES], np.flatnonzero(unsure))
    if len(odd):  # words with characters told in bytes, or without a single path
        kept = ~np.isin(words, odd)
        own = {w: [] for w in odd.tolist()}
        for w, t, p in zip(words[~kept].tolist(), ids[~kept].tolist(), places[~kept].tolist(), strict=True):
            if t >= 0:
                own[w].append(t)
            else:
                size = 1 + int(np.argmax((text[p + 1 : p + 5] & 0xC0) != 0x80))
                own[w] += pieces.spelled(text[p : p + size].tobytes())
        for w in np.flatnonzero(unsure).tolist():
            own[w] = pieces.plain(text[starts[w] : stop[w]].tobytes().decode())
        more = [(w, i) for w, found in own.items() for i in found]
        words = np.concatenate([words[kept], [w for w, _ in more]]).astype(np.int64)
        ids = np.concatenate([ids[kept], [i for _, i in more]]).astype(np.int64)
        order = np.argsort(words, kind="stable")
        words, ids = words[order], ids[order]
    return ids.astype(np.int32), np.bincount(words, minlength=n)


class Encoder:
    """Encodes batch after batch and remembers the words it has met."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, np.uint64)  # sorted, with the place of each word's ids
        self.word = np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return at, (self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool))

    def learn(self, codes: np.ndarray, data: np.ndarray, heads: np.ndarray, ends: np.ndarray, run: np.ndarray) -> None:
        """Add new distinct words; ``run`` tells how many space marks each begins with."""
        pieces = self.pieces
        cuts = np.cumsum(ends - heads) // WORDS_CHUNK
        alone = pieces.ids.get(SPACE, -1)
        flats, sizes = [self.flat], [self.size]
        for part in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(cuts)) + 1):
            flat, size = encode_words(pieces, data, heads[part] + 3 * (run[part] - 1), ends[part])
            if (run[part] > 1).any():
                rows = np.split(flat, np.cumsum(size)[:-1])
                for w in np.flatnonzero(run[part] > 1).tolist():
                    k, own = int(run[part[w]]), rows[w].tolist()
                    rows[w] = pieces.run(k) + own[1:] if own[:1] == [alone] else pieces.run(k - 1) + own
                flat = np.concatenate([np.asarray(r, np.int32) for r in rows])
                size = np.array([len(r) for r in rows], np.int64)
            flats.append(flat)
            sizes.append(size)
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        every = np.concatenate([self.codes, codes])
        word = np.concatenate([self.word, np.arange(len(self.word), len(every))])
        order = np.argsort(every, kind="stable")
        self.codes, self.word = every[order], word[order]

    def encode(self, texts: pa.Array) -> pa.Array:
        """List of ids for every text."""
        texts = texts.cast(pa.large_string())
        none, mark_text = (pa.scalar(s, pa.large_string()) for s in ("", SPACE))
        marked = pc.binary_join_element_wise(none, texts, mark_text)
        marked = pc.if_else(pc.equal(texts, ""), texts, pc.replace_substring(marked, " ", SPACE))
        data, bounds = text_bytes(marked)
        n = len(data)
        mark = np.zeros(n + 3, bool)
        if n >= 3:
            mark[: n - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
        marks = np.flatnonzero(mark)
        opens = np.zeros(n + 1, bool)
        opens[bounds] = True
        first = ~mark[np.maximum(marks - 3, 0)] | (marks < 3) | opens[marks]
        heads = marks[first]  # of every word: its run of marks and what follows
        ends = np.append(heads[1:], n)
        codes = span_codes(data, heads, ends, np.ones(n, bool))
        at, found = self.known(codes)
        if not found.all():
            if len(self.codes) > MEMORY:
                self.forget()
                found[:] = False
            new = np.flatnonzero(~found)
            fresh, sample = np.unique(codes[new], return_index=True)
            sample = new[sample]
            run = np.diff(np.append(np.flatnonzero(first), len(marks)))[sample]
            self.learn(fresh, data, heads[sample], ends[sample], run)
            at, _ = self.known(codes)
        word = self.word[at] if len(codes) else np.zeros(0, np.int64)
        start, size = self.start[word], self.size[word]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(int(total[-1])) + np.repeat(start - total[:-1], size)]
        offsets = total[np.searchsorted(heads, bounds)].astype(np.int32)
        missing = pc.is_null(texts).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), pa.array(ids, pa.int32()))


def decode(pieces: Pieces, ids: pa.Array) -> pa.Array:
    """The text of every list of ids; bytes that are no UTF-8 become replacement characters."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pieces.out_sizes[flat]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(ends[-1])) + np.repeat(pieces.out_starts[flat] - ends[:-1], size)
    data = pieces.out_bytes[at]
    bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
    # The space before the first word is not part of a text.
    led = bounds[:-1][(counts > 0) & (bounds[1:] > bounds[:-1])]
    led = led[data[led] == ord(" ")]
    kept = np.ones(len(data), bool)
    kept[led] = False
    bounds = bounds - np.searchsorted(led, bounds)
    data = data[kept]
    missing = pc.is_null(ids)
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
    )
    try:
        texts = whole.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.large_string())
    return pc.if_else(missing, pa.scalar(None, pa.large_string()), texts).cast(pa.string())


def encode_table(documents: DataFrame, pieces: Pieces) -> DataFrame:
    """All input columns but ``text``, with ``ids`` and whether decoding them gave the text back.

    Rows leave a task as soon as some megabyte of text is encoded, so whole batches never pile up.
    """
    kept = [f for f in documents.schema.fields if f.name != "text"]
    inputs = documents.columns
    place = inputs.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            for p in chunks(batch.column(place), CHUNK):
                some = batch.slice(p.start, p.stop - p.start)
                text = some.column(place).cast(pa.string())
                ids = encoder.encode(text)
                same = pc.fill_null(pc.equal(decode(pieces, ids), text), pc.is_null(text))
                columns = [some.column(i) for i, name in enumerate(inputs) if name != "text"]
                names = [name for name in inputs if name != "text"] + ["ids", "same"]
                yield pa.RecordBatch.from_arrays([*columns, ids, same], names=names)

    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])
    return documents.mapInArrow(rows, schema)


def encoded(text: Column, pieces: Pieces) -> Column:
    """Piece ids of a text column."""

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(pieces)
        for column in texts:
            parts = [encoder.encode(column.slice(p.start, p.stop - p.start)) for p in chunks(column, CHUNK)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def decoded(ids: Column, pieces: Pieces) -> Column:
    """Text of a column of piece ids."""

    @F.arrow_udf("string")
    def texts(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lists:
            yield decode(pieces, column)

    return texts(ids)

"""Operators that compare, count or place documents, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import DOCUMENTS, awkward_rows, roots, words
from tunelens.llm import context_mixing, embedding_dedup, line_dedup, minhash_dedup, packing, sharding

CLASH = ("kept", "n_lines", "component_id", "shard", "bin", "place", "node", "hash")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS).withColumns({c: F.lit("x") for c in CLASH}).cache()


def shingles(text):
    own = words(text, lower=True)
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def near_copies(seed):
    """A text, copies with few and with many edits, exact copies and strangers."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, " ".join(f"u{rng.randrange(300)}" for _ in range(rng.randint(1, 30)))) for i in range(30)]
    return rows


def check_near(frame):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    sets = [(i, shingles(t)) for i, t in rows]
    links = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[k + 1 :]
        if a is not None and b is not None and x and y and (a == b or 100 * len(x & y) >= 85 * len(x | y))
    ]
    root = roots(links)
    expected = Counter((i, len(s), root.get(i, i), i is None or root.get(i, i) == i) for i, s in sets)
    found = minhash_dedup.near_duplicates(frame).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == expected


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_near_duplicates_of_ids_with_several_texts(spark, parts):
    """An id links through each of its texts, in whatever order they come."""
    rng = random.Random(6)
    base = {k: [f"{k}{rng.randrange(900)}" for _ in range(80)] for k in "abc"}
    near = lambda k, i: " ".join([*base[k][:i], "new", *base[k][i + 1 :]])
    rows = [(5, " ".join(base["a"])), (5, " ".join(base["b"])), (8, near("a", 0)), (9, near("b", 79)), (7, near("c", 3))]
    rows += [(5, near("c", 0)), (3, " ".join(base["b"])), (11, near("b", 0)), (11, near("a", 79)), (12, near("a", 2))]
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    check_near(spark.createDataFrame(near_copies(seed), "doc_id long, text string").repartition(3))


def test_near_duplicates_edge_cases(awkward):
    check_near(awkward.select("doc_id", "text", "kept", "node"))
    assert minhash_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_blocks_find_every_link(monkeypatch):
    """Blocks far smaller than a group of near copies lose nothing."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(minhash_dedup, "SLICE", 64)
    rows = near_copies(3)
    codes, counts = minhash_dedup.shingle_sets(pa.array([t for _, t in rows]))
    _, _, sketch = minhash_dedup.signatures(codes, counts)
    frame = pd.DataFrame(
        {
            "node": [i for i, _ in rows],
            "component": [i for i, _ in rows],
            "block": [i % 3 for i, _ in rows],
            "sketch": [list(s.astype(np.int64)) for s in sketch],
            "codes": np.split(codes.astype(np.int64), np.cumsum(counts)[:-1]),
        }
    )
    found = set()
    for low in range(3):
        for high in range(low, 3):
            part = frame[frame["block"].isin([low, high])]
            for a, b in minhash_dedup.block_links(part, 85).itertuples(index=False):
                found.add((min(a, b), max(a, b)))
    sets = {i: shingles(t) for i, t in rows}
    assert found == {
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    }


def brute_lines(rows, least):
    lines = {i: [(k, s) for k, s in enumerate((t or "").split("\n")) if words(s)] for i, t in rows}
    runs = {}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            total = 0
            for b in range(a, len(lines[i])):
                total += len(words(lines[i][b][1]))
                if total >= least:
                    yield_key = tuple(s for _, s in lines[i][a : b + 1])
                    runs.setdefault(yield_key, []).append((i, a, b))
    gone = defaultdict(set)
    for places in runs.values():
        for i, a, b in sorted(places)[1:]:
            own = lines[i]
            gone[i] |= set(range(own[a][0], own[b + 1][0] if b + 1 < len(own) else own[b][0] + 1))
    return {
        i: t if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows
    }


@pytest.mark.parametrize("least", [1, 10, 50])
def test_line_dedup(spark, least):
    rng = random.Random(least)
    stock = ["w " * k + c for k in (3, 10, 30, 60) for c in "abc"] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in line_dedup.drop_repeats(frame, least).collect()}
    assert {i: r.text for i, r in found.items()} == brute_lines(rows, least)
    for i, text in rows:
        assert found[i].kept == (text == found[i].text or bool(words(found[i].text)))


def test_line_dedup_edge_cases(spark, awkward):
    out = line_dedup.drop_repeats(awkward, 5, ("__a", "__b", "__c"))
    assert out.columns[:-3] == awkward.columns and out.count() == awkward.count()
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[4] == "The cat sat on the mat."
    assert line_dedup.drop_repeats(awkward.limit(0)).count() == 0


def test_line_dedup_replaces_columns_of_its_names(spark, awkward):
    out = line_dedup.drop_repeats(awkward)
    assert sorted(out.columns) == sorted({*awkward.columns, "n_lines", "n_gone", "kept"})
    assert out.count() == awkward.count() and out.schema["kept"].dataType.typeName() == "boolean"


def test_scores(spark):
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(400)]
    say = lambda: " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randint(0, 60)))
    rows = [(i, say()) for i in range(200)] + [(5, None), (None, "c1 c2"), (6, "C1 \n c1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = context_mixing.score(frame, vocabulary=15).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [*words(t, lower=True), None]) for i, t in rows]
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    expected = Counter((i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(base(t), 6)) for i, t in tokens)
    assert expected == Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    )
    assert all(r.score < 0 for r in found)


def test_scores_are_probabilities():
    """Over all two-token texts of a small vocabulary the chances add up to one."""
    import numpy as np

    model = context_mixing.Model(np.arange(1, 6, dtype=np.uint64), np.array([9, 5, 3, 2, 1]), 30, 8, 5)
    n = len(model.codes.length)
    chance = 0.0
    for a in range(n):
        for b in range(n):
            chance += 2.0 ** -model.cost(np.array([a, b]), np.zeros(2, np.int64), 1)[0]
    assert chance == pytest.approx(1, abs=1e-6)


def test_scores_beat_the_base_on_held_out_text(spark, sf_dir):
    from tunelens.llm.queries import op4_context_mixing

    held = op4_context_mixing(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.97 * held[1]


def test_contexts_are_counted_over_all_training_documents(spark):
    """Also over those that the starting weights are fitted on."""
    import numpy as np
    import pyarrow as pa

    part = lambda i: zlib.crc32(str(i).encode()) % 10
    rows = [(i, f"a b c d{part(i)} e{i % 3}") for i in range(300) if part(i) in (1, 9)]
    training = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = context_mixing.fit(training, context_mixing.word_counts(training.select("text")))
    batch = pa.record_batch([pa.array([t for _, t in rows])], names=["text"])
    zeros, ones = context_mixing.counted(model, [batch]).reshape(-1, 2).astype(int).T
    assert (model.table == context_mixing.packed(zeros + ones, ones)).all() and ones.any()
    assert not np.allclose(model.weights, 0.3)


def test_starting_weights_are_fitted_on_all_training_documents(spark):
    """A logistic regression over every decision of all texts, each without its own count, however rows are dealt."""
    import numpy as np
    import pyarrow as pa

    from tunelens.llm.tokens import Words

    rng = random.Random(11)
    part = lambda i: zlib.crc32(str(i).encode()) % 10
    say = lambda: " ".join(rng.choice("aaabbcdefgh") for _ in range(rng.randint(0, 30)))
    rows = [(i, say()) for i in range(400) if part(i) not in (0, 9)] + [(None, "a b"), (7, None)]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    counts = context_mixing.word_counts(training.select("text"))
    model = context_mixing.fit(training.repartition(5), counts, vocabulary=6)
    again = context_mixing.fit(training.coalesce(1), counts, vocabulary=6)
    assert (model.weights == again.weights).all() and (model.table == again.table).all()

    number = {int(w): i for i, w in enumerate(model.words)}
    code = dict(zip("abcdefgh", Words(pa.array(list("abcdefgh"))).codes().tolist()))
    ids = [[number.get(code[w], model.escape) for w in (t or "").split()] + [model.end] for _, t in rows]
    decisions = []
    for text in ids:
        _, bit, depth, slots = model.decisions(np.array(text), np.zeros(len(text), int))
        decisions += zip(bit.tolist(), depth.tolist(), zip(*(s.tolist() for s in slots)))
    seen = Counter((s, bit) for bit, _, slots in decisions for s in slots)
    slope = np.zeros((384, 5))
    for bit, depth, slots in decisions:
        inputs, level = [], []
        for s in slots:
            zeros, ones = seen[s, 0] - (bit == 0), seen[s, 1] - (bit == 1)
            odds = round(max(-12, min(12, math.log((ones + 0.4) / (zeros + 0.4)))) / 0.025) * 0.025
            inputs.append(context_mixing.MIDDLES[sum(odds >= e for e in context_mixing.EDGES)])
            level.append(sum(zeros + ones >= least for least in (1, 4, 16)))
        gate = (depth * 4 + level[1]) * 4 + level[2]
        x = np.array([*inputs, 1.0])
        slope[gate] += (1 / (1 + math.exp(-model.weights[:, gate].astype(float) @ x)) - bit) * x
    slope += model.weights.T - 0.3
    taken = np.abs(model.weights.T - 0.3).max(1) > 0
    assert taken.sum() > 5 and np.abs(slope).max() < 0.02


def test_stored_token_ids_are_those_of_the_texts():
    import numpy as np
    import pyarrow as pa

    from tunelens.llm.tokens import Words

    texts = pa.array(["a b c a", "", "c zz b", "a"])
    for more in (0, 2**16):
        codes = np.concatenate([np.unique(Words(texts).codes()), np.arange(more, dtype=np.uint64)])
        model = context_mixing.Model(codes, np.ones(len(codes), np.int64), len(codes) + 9, len(codes) + 5, 4)
        whole = next(model.parts(texts))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(whole[1]))]) * model.stored.itemsize
        data = whole[0].astype(model.stored).tobytes()
        stored = pa.array([b"", *(data[a:b] for a, b in zip(bounds[:-1], bounds[1:]))], pa.binary()).slice(1)
        found = next(model.parts(stored))
        assert all(np.array_equal(a, b) for a, b in zip(whole, found)) and model.stored.itemsize == (4 if more else 2)


def little_mixer(rng):
    """A model with counted slots, and texts as token ids."""
    import numpy as np

    model = context_mixing.Model(np.arange(1, 301, dtype=np.uint64), rng.integers(1, 90, 300), 20_000, 400, 9)
    model.table = context_mixing.packed(*(lambda n: (n, rng.binomial(n, 0.4)))(rng.integers(0, 30, model.slots())))
    texts = [rng.integers(0, 302, n) for n in (1, 5, 2000, 0, 70)]
    return model, np.concatenate(texts), np.repeat(np.arange(5), [len(t) for t in texts])


def test_a_group_of_levels_reads_one_line_of_each_table():
    """Lines of 16 slots from the table's start; a token reads one line for each four levels of its code."""
    import numpy as np

    model, ids, doc = little_mixer(np.random.default_rng(8))
    token, _, depth, slots = model.decisions(ids, doc)
    group = token * 100 + (np.arange(len(token)) - np.searchsorted(token, token)) // context_mixing.LINE_DEPTH
    assert (np.diff(token) > 0).any() and depth.max() >= context_mixing.LINE_DEPTH
    for slot in slots[1:]:
        first = slot[np.searchsorted(group, group)]
        assert (slot // 16 == first // 16).all() and slot.max() < 3 * model.context_slots
    nodes = slots[0] - 3 * model.context_slots
    assert nodes.min() >= 0 and nodes.max() < model.codes.nodes


def test_counts_and_scores_do_not_depend_on_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    model, ids, doc = little_mixer(np.random.default_rng(9))
    ends = np.cumsum(np.bincount(doc, minlength=5))
    texts = [ids[a:b].astype(model.stored).tobytes() for a, b in zip([0, *ends[:-1]], ends)]
    batch = pa.record_batch([pa.array(texts, pa.binary())], names=["ids"])
    found = []
    for piece in (1, 64, 10**6):
        monkeypatch.setattr(context_mixing, "PIECE", piece)
        found.append((model.cost(ids, doc, 5), context_mixing.counted(model, [batch])))
    for cost, counts in found:
        assert (cost == found[0][0]).all() and (counts == found[0][1]).all() and cost[3] == 0
    plain = np.zeros(2 * model.slots(), int)
    _, bit, _, slots = model.decisions(ids, doc)
    for slot in slots:
        np.add.at(plain, 2 * slot + bit, 1)
    assert (found[0][1] == plain).all()


def test_bits_stay_with_their_rows(monkeypatch):
    """Texts of like length are coded together, however they lie in a batch."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(context_mixing, "CHUNK_TOKENS", 300)
    rng = np.random.default_rng(12)
    model, _, _ = little_mixer(rng)
    texts = [rng.integers(0, 302, n) for n in (90, 1, 400, 0, 130, 60, 1, 250)]
    ids = pa.array([t.astype(model.stored).tobytes() for t in texts], pa.binary())
    batch = pa.record_batch([pa.array(range(8))] * 6 + [ids], names=[*"abcdef", "ids"])
    (found,) = context_mixing._score_rows(model)(iter([batch]))
    alone = [model.cost(t, np.zeros(len(t), np.int64), 1)[0] for t in texts]
    assert found["uid"].to_pylist() == [*range(8)]
    assert found["bits"].to_pylist() == pytest.approx(alone, rel=1e-9)


def test_cells_of_decisions_are_those_of_their_slots():
    """Met cells against intervals and levels taken decision by decision, each without its own count."""
    import numpy as np
    import pyarrow as pa

    model, ids, doc = little_mixer(np.random.default_rng(10))
    ends = np.cumsum(np.bincount(doc, minlength=5))
    texts = [ids[a:b].astype(model.stored).tobytes() for a, b in zip([0, *ends[:-1]], ends)]
    batch = pa.record_batch([pa.array(texts, pa.binary())], names=["ids"])
    others = context_mixing.without_one(context_mixing.counted(model, [batch]).reshape(-1, 2).astype(int))
    size = context_mixing.RANGE
    parts = [context_mixing.in_cells(model, others[a : a + size], a) for a in range(0, len(others), size)]
    model.table = np.concatenate(parts).reshape(-1)
    expected = Counter()
    _, bit, depth, slots = model.decisions(ids, doc)
    for i, (b, d) in enumerate(zip(bit.tolist(), depth.tolist())):
        seen = [int(others[s[i], b]) for s in slots]
        cell = 0
        for f in seen:
            cell = cell * 11 + sum(((f & 1023) - 512) * context_mixing.STEP >= e for e in context_mixing.EDGES)
        expected[(d * 4 + (seen[1] >> 10)) * 4 + (seen[2] >> 10), cell, b] += 1
    both = context_mixing.met(model, [batch])
    assert expected == Counter({tuple(k): int(both[tuple(k)]) for k in np.argwhere(both).tolist()})


def test_counts_travel_in_few_bytes():
    import numpy as np

    for most, width in ((0, 1), (255, 1), (256, 2), (70_000, 3), (2**32 - 1, 4)):
        counts = np.zeros(5000, np.uint32)
        counts[[0, 17, 4999]] = [most, 1, most // 2]
        data = context_mixing.squeezed(counts)
        assert data[0] == width and (context_mixing.expanded(data, 5000) == counts).all()


def test_context_tables_grow_with_the_training_text():
    import numpy as np

    slots = [context_mixing.Model(np.arange(3, dtype=np.uint64), np.ones(3), n, 3, 1).context_slots for n in (9, 10**5, 10**6, 10**12)]
    assert slots == [2**16, 2**17, 2**20, context_mixing.MOST_SLOTS]


def plain_mixer(model, ids, table):
    """Bits of one text, decision by decision."""
    weights = {}
    codes, total, queue = model.codes, 0.0, []
    for place, token in enumerate(ids):
        if place % context_mixing.BLOCK == 0:
            for gate, step in queue:
                weights.setdefault(gate, list(model.weights[:, gate].astype(float)))
                weights[gate] = [w + s for w, s in zip(weights[gate], step)]
            queue = []
        for depth in range(codes.length[token]):
            at = codes.start[token] + depth
            gate, inputs = table[place, depth]
            own = weights.get(gate) or list(model.weights[:, gate].astype(float))
            logit = sum(w * x for w, x in zip(own, [*inputs, 1.0]))
            bit = int(codes.bit[at])
            chance = 1 / (1 + math.exp(-max(-16, min(16, logit))))
            total -= math.log2(chance if bit else 1 - chance)
            queue.append((gate, [context_mixing.RATE * (bit - chance) * x for x in [*inputs, 1.0]]))
    return total


def test_mixing_against_a_plain_mixer():
    import numpy as np

    rng = np.random.default_rng(3)
    model = context_mixing.Model(np.arange(1, 31, dtype=np.uint64), rng.integers(1, 90, 30), 900, 40, 9)
    model.table = context_mixing.packed(*(lambda n: (n, rng.binomial(n, 0.4)))(rng.integers(0, 30, model.slots())))
    texts = [rng.integers(0, 32, n) for n in (1, 5, 200, 70)]
    ids, doc = np.concatenate(texts), np.repeat(np.arange(4), [len(t) for t in texts])
    found = model.cost(ids, doc, 4)
    for k, text in enumerate(texts):
        token, _, depth, slots = model.decisions(text, np.zeros(len(text), int))
        rows = [model.table[s] for s in slots]
        place = np.arange(len(token)) - np.searchsorted(token, token)
        table = {}
        for i, t in enumerate(token.tolist()):
            level = [int(r[i]) >> 10 for r in rows]
            gate = (int(depth[i]) * context_mixing.LEVELS + level[1]) * context_mixing.LEVELS + level[2]
            table[t, int(place[i])] = gate, [((int(r[i]) & 1023) - 512) * context_mixing.STEP for r in rows]
        assert found[k] == pytest.approx(plain_mixer(model, text.tolist(), table), rel=1e-4)


def test_scores_of_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert context_mixing.score(empty).count() == 0
    one = context_mixing.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one.n_tokens == 3


def check_shards(frame, shards=16):
    found = sharding.shard(frame, shards).collect()
    own = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == own
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r.shard < shards and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return found


def test_shards_keep_copies_together(spark):
    rows = [(i, f"text {i // 3}" if i < 90 else f"free {i}") for i in range(600)]
    found = check_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    text = dict(rows)
    groups = defaultdict(set)
    for r in found:
        groups[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_shards_of_a_group_with_a_third_of_all_rows(spark):
    found = check_shards(spark.createDataFrame([(i, "a" if i % 3 else f"b{i}") for i in range(300)], "doc_id long, text string"))
    per = Counter(r.shard for r in found if r.doc_id % 3)
    assert max(per.values()) == 18  # filled up to the quota


def test_shards_edge_cases(awkward):
    check_shards(awkward)
    assert sharding.shard(awkward.limit(0)).count() == 0


def test_packing(spark, awkward):
    rows = [(i, "w " * (i % 37), f"s{i % 3}") for i in range(400)] + [(1000, "v " * 250, None), (1001, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = packing.pack(frame, capacity=100, planes=2, group_rows=150).collect()
    total, used, clusters, sources = Counter(), defaultdict(list), Counter(), Counter()
    for r in found:
        total[r.doc_id] += r.n_words
        if r.bin is None:
            assert not r.n_words
            continue
        used[r.bin].append((r.offset, r.offset + r.n_words))
        if r.n_words < 100:
            clusters[r.bin, r.cluster] += 1
            sources[r.bin, r.source] += r.source is not None
    assert total == Counter({i: len(words(t)) for i, t, _ in rows})
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert max(clusters.values()) == 1 and max(sources.values()) <= 2
    assert packing.pack(awkward).select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()
    assert packing.pack(awkward.limit(0)).count() == 0


def test_the_tightest_compatible_bin_is_found():
    rng = random.Random(1)
    bins, plain = packing.Bins(50, 2), []
    for _ in range(400):
        length, cluster, source = rng.randint(1, 50), 1 << rng.randrange(6), 1 << rng.randrange(3)
        fits = [
            (b["room"], i)
            for i, b in enumerate(plain)
            if b["room"] >= length and cluster not in b["clusters"] and b["sources"].count(source) < 2
        ]
        want = min(fits)[1] if fits else len(plain)
        if not fits:
            plain.append({"room": 50, "clusters": [], "sources": []})
        plain[want]["room"] -= length
        plain[want]["clusters"].append(cluster)
        plain[want]["sources"].append(source)
        assert bins.place(length, cluster, source)[0] == want


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(150):
        rows.append((100 + i, (base[i % 5] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.uniform(0, 0.35)).tolist()))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [0.0] * 16), (305, [float("nan")] * 16)]
    rows += [(306, [1.0, None] * 8), (307, [float("inf")] * 16), (308, [1.0, 2.0]), (309, [2.0, 4.0]), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(v, np.float32).astype(np.float64)
            usable[i] /= np.linalg.norm(usable[i])
    links = [
        (a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.9
    ]
    degree, root = Counter(x for pair in links for x in pair), roots(links)
    found = embedding_dedup.near_vectors(frame).collect()
    assert len(found) == len(rows)
    wrong = sum((r.n_links, r.component_id) != (degree[r.vec_id], root.get(r.vec_id, r.vec_id)) for r in found)
    assert wrong <= len(found) // 50  # pairs right at the threshold may be missed
    assert all(r.n_links <= degree[r.vec_id] for r in found)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_e8_decoder():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    point = embedding_dedup.nearest_e8(x)
    near = point[:, None, :] + embedding_dedup.NEIGHBOURS[None]
    assert len(embedding_dedup.NEIGHBOURS) == 240
    assert (((x[:, None] - near) ** 2).sum(2).min(1) >= ((x - point) ** 2).sum(1) - 1e-9).all()

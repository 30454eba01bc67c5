"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import DOCUMENTS, awkward_rows, words
from tunelens.llm import periodic_runs, queries


def brute_runs(own, min_words=24, min_repeats=3):
    found, n = set(), len(own)
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and own[end] == own[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(min_words, min_repeats * q):
                part = own[start : start + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.add((start, length, q))
            start = max(end, start + 1)
    return sorted(found)


def collapsed(own, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(own) if i not in gone)


def planted(doc_id, text):
    own = words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(own)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    return own


def digest(doc_id, text):
    own = planted(doc_id, text)
    runs = brute_runs(own)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc_id, len(runs), *best, milli, sha(listed), sha(collapsed(own, runs)), len(own)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 2), min_size=1, max_size=60),
    st.integers(1, 9),
    st.integers(1, 40),
    st.sampled_from([(24, 3), (2, 2), (6, 2.5), (10, 4)]),
)
def test_runs_of_letters(own, period, at, limits):
    own = own + [own[at % len(own) + i % period] for i in range(30) if at % len(own) + i % period < len(own)]
    letters = np.unique(np.array(own), return_inverse=True)[1]
    assert sorted(periodic_runs.stretch_runs(letters, *limits)) == brute_runs(own, *limits)


def test_longest_lyndon_words():
    rng = random.Random(3)
    for _ in range(200):
        own = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
        length, group = periodic_runs.lyndon_groups(own)
        lyndon = lambda w: all(w < w[i:] for i in range(1, len(w)))
        roots = []
        for i in range(len(own)):
            longest = max(k for k in range(1, len(own) - i + 1) if lyndon(own[i : i + k]))
            assert length[i] == longest
            roots.append(tuple(own[i : i + longest]))
        for i in range(len(own)):
            for j in range(i):
                assert (group[i] == group[j]) == (roots[i] == roots[j])


def test_stretches_lose_no_run():
    rng = random.Random(4)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            own = [rng.randrange(6) for _ in range(rng.randint(0, 50))]
            if own and rng.random() < 0.6:
                a = rng.randrange(len(own))
                p = rng.randint(1, 12)
                own += [own[a + i % p] for i in range(rng.randint(3, 60)) if a + i % p < len(own)]
            texts.append(own)
        codes = periodic_runs.mix(np.array([w + 1 for t in texts for w in t], np.uint64))
        counts = np.array([len(t) for t in texts])
        found = set()
        for begin, stop in periodic_runs.stretches(codes, counts, 24, 3):
            letters = np.unique(codes[begin:stop], return_inverse=True)[1]
            found |= {(begin + s, n, q) for s, n, q in periodic_runs.stretch_runs(letters, 24, 3)}
        heads = np.cumsum(counts) - counts
        assert found == {(int(h) + s, n, q) for h, t in zip(heads, texts) for s, n, q in brute_runs(t)}


def cycle(n, *own):
    return " ".join(own[i % len(own)] for i in range(n))


ROWS = awkward_rows() + [
    (100, cycle(24, "a"), "en", "s", 1),
    (101, cycle(23, "a"), "en", "s", 1),
    (102, "x " + cycle(30, "a", "b") + " y " + cycle(27, *"abcdefghi"), "en", "s", 1),
    (103, cycle(26, *"abcdefghi") + " z", "en", "s", 1),
    (104, cycle(20_000, "ja", "Ja", "été"), "de", "s", 1),
    (105, cycle(60, "a") + "\n" + cycle(60, "b", "a"), "en", "s", 1),
    (106, "w" * 100_000, "en", "s", 1),
    (110, cycle(40, *"abcd"), "en", "s", 1),
]


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in ROWS if r[0] != 104]
    frame = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "'x' AS runs", "1 AS n_words")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((digest(r[0], r[1]) for r in rows), key=repr)


def test_long_text_and_nulls(spark):
    found = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(ROWS, DOCUMENTS)).collect()}
    assert [tuple(r) for r in found[104].runs] == [(0, 20_000, 3)]
    assert found[104].collapsed == "ja Ja été"
    assert found[1].collapsed is None and found[1].runs == [] and found[1].n_words == 0
    assert found[2].collapsed == found[3].collapsed == ""
    empty = periodic_runs.find_runs(spark.createDataFrame([], DOCUMENTS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(empty, min_repeats=1.5)


def test_whole_table(spark, sf_dir):
    """Every document of the query against brute force, as far as that is quick."""
    found = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    short = [r for r in rows if len(words(r.text)) <= 250]
    assert len(short) > 0.5 * len(rows)
    assert sum(found[r.doc_id][1] for r in short) > 0
    for r in short:
        assert found[r.doc_id] == digest(r.doc_id, r.text)

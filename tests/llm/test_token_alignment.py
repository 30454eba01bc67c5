"""Token alignment against whole texts through the tokenizer libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.brute import DOCUMENTS, awkward_rows
from tunelens.llm import queries, token_alignment

A, B = token_alignment.byte_level(), token_alignment.sentence_pieces()


@pytest.fixture(scope="module")
def id_bytes():
    return A.id_bytes(), B.id_bytes()


def tokens(text, id_bytes):
    """(ids, ends) of both sides over the whole text, or nothing."""
    if not text:
        return None
    data = (" " + text).encode()
    both = []
    for vocabulary, names in zip((A, B), id_bytes, strict=True):
        ids = vocabulary.encode([" " + text])[0]
        if b"".join(names[i] for i in ids) != data:
            return None
        both.append((ids, np.cumsum([len(names[i]) for i in ids]).tolist()))
    return both


def aligned(both):
    """Groups as text and links, token by token."""
    (a, a_ends), (b, b_ends) = both
    cuts = set(a_ends) & set(b_ends)
    split = []
    for ids, ends in both:
        split.append([[]])
        for i, end in zip(ids, ends):
            split[-1][-1].append(str(i))
            if end in cuts:
                split[-1].append([])
    groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*split) if x]
    links, j = [], 0
    for i, end in enumerate(a_ends):
        start = a_ends[i - 1] if i else 0
        while b_ends[j] <= start:
            j += 1
        k = j
        while k < len(b) and (b_ends[k - 1] if k else 0) < end:
            links.append((a[i], b[k]))
            k += 1
    return ";".join(groups), links


def expected(rows, id_bytes):
    found, counts = [], Counter()
    for doc_id, text in rows:
        both = tokens(text, id_bytes)
        groups, links = aligned(both) if both else ("", [])
        counts.update(links)
        found.append((doc_id, both, groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for doc_id, both, groups, links in found:
        yield (
            doc_id,
            len(both[0][0]) if both else 0,
            len(both[1][0]) if both else 0,
            groups.count("|"),
            len(links),
            sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links),
            groups,
        )


def odd_texts():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "é", "'s", "don't", "12", "3.5", "中文", "カ", "Â", "\x1c", "\x00"]
    parts += ["word", "Übergang", "!!", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\U0001f642", "\r\n", "x" * 30, "​", "ẞ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    return texts + ["a▁b c", "▁", " ", "   ", "\n \n", "a  b", "a  b", "a\n  b", "a \n b", "  a", "é  é", "à à  à"]


def test_units_give_the_tokens_of_whole_texts(id_bytes):
    texts = odd_texts()
    data = [(" " + t).encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    starts, free = token_alignment.cut_units(np.frombuffer(b"".join(data), np.uint8), bounds)
    ends = np.append(starts[1:], bounds[-1])
    raw = b"".join(data)
    for k, text in enumerate(texts):
        own = [raw[a:b].decode() for a, b in zip(starts, ends) if bounds[k] <= a < bounds[k + 1]]
        assert "".join(own) == " " + text
        for vocabulary in (A, B):
            if "▁" not in text:
                assert sum(vocabulary.encode(own), []) == vocabulary.encode([" " + text])[0]
    order = np.random.default_rng(1).permutation(np.flatnonzero(free))
    own = [raw[starts[i] : ends[i]].decode() for i in order]
    for vocabulary in (A, B):
        if not any("▁" in t for t in own):
            assert vocabulary.encode(["".join(own)])[0] == sum(vocabulary.encode(own), [])


def test_no_piece_joins_what_units_part(id_bytes):
    names = [n.decode("utf-8", "replace") for n in id_bytes[1]]
    assert not any(" " in n.lstrip(" ") for n in names)


@pytest.mark.parametrize("block", [300, 12_000_000])
def test_align(spark, id_bytes, block):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    rows += [(5000, "long " * 4_000), (5001, "w" * 20_000), (5002, "ab é " * 2_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'x' AS groups", "*", "1 AS unit")
    found = token_alignment.align(frame.repartition(3), block_bytes=block)
    assert Counter(map(tuple, found.collect())) == Counter(expected(rows, id_bytes))


def test_empty_table(spark):
    found = token_alignment.align(spark.createDataFrame([], DOCUMENTS))
    assert found.count() == 0 and len(found.columns) == 8


def test_whole_table(spark, sf_dir, id_bytes):
    found = Counter(map(tuple, queries.op12_token_alignment(spark, sf_dir).collect()))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    assert found == Counter((*r[:-1], digest(r[-1])) for r in expected(rows, id_bytes))

"""Operators that judge every text alone, and their edge cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import DOCUMENTS, awkward_rows, words
from tunelens.llm import language_id, license_scan, quality_rules, suffix_pieces

CLASH = ["kept", "score", "row", "n_words", "licences", "lang_pred"]


@pytest.fixture(scope="module")
def awkward(spark):
    frame = spark.createDataFrame(awkward_rows(), DOCUMENTS)
    return frame.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (6, 1, None), (8, 0, 0), (None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def base_counts(text):
    found = words(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return (
        len(found),
        sum(map(len, found)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def test_quality_base_counts(spark, awkward, labels):
    texts = ["a b c d e " * 3, "x\nx\n\ny\nx", "p q r s t p q r s t u", "#a $b " * 6, "w " * 40, " a b"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = awkward.select("doc_id", "text").union(more)
    found = quality_rules.score_documents(rows, labels).select("row.text", "*").collect()
    assert len(found) == rows.count()
    for r in found:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == base_counts(r.text), r.text
        assert r.n_words or (r.score is None and not r.kept)


def test_quality_keeps_clashing_columns(awkward, labels):
    out = quality_rules.score_documents(awkward, labels).select("row.*")
    assert out.columns == awkward.columns and out.count() == awkward.count()


def test_quality_score_by_hand(spark, labels):
    import math
    import zlib

    docs = [(4, "good text here"), (8, "junk | junk |"), (5, "good junk")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    buckets = 97

    def grams(text):
        codes = [zlib.crc32(w.encode()) for w in words(text)]
        ends = [zlib.crc32(w[-3:].encode()) for w in words(text)]
        pairs = [(a * 1_000_003 + b) % buckets for a, b in zip(codes, codes[1:], strict=False)]
        return [c % buckets for c in codes] + [(e + 7_919) % buckets for e in ends] + pairs

    every = Counter(g for _, t in docs for g in grams(t))
    good = Counter(g for i, t in docs if i == 4 for g in grams(t))
    weight = [
        round(
            1e6
            * (
                math.log((good[b] + 1) / (sum(good.values()) + buckets))
                - math.log((every[b] + 1) / (sum(every.values()) + buckets))
            )
        )
        for b in range(buckets)
    ]
    for r in quality_rules.score_documents(frame, labels, buckets=buckets).select("row.*", "score").collect():
        assert r.score == pytest.approx(sum(weight[g] for g in grams(r.text)) / 1e6 / len(grams(r.text)), abs=2e-6)


def test_quality_is_native(spark, sf_dir):
    from tunelens.llm.queries import op2_quality_rules

    plan = op2_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))


def test_quality_without_rows_or_labels(spark, awkward, labels):
    assert quality_rules.score_documents(awkward.limit(0), labels).count() == 0
    assert quality_rules.score_documents(awkward, labels.limit(0)).count() == awkward.count()


def test_languages_edge_cases(awkward):
    model = language_id.fit(awkward)
    out = language_id.identify(awkward, model)
    assert set(awkward.columns) <= set(out.columns)
    found = out.collect()
    assert len(found) == awkward.count()
    for r in found:
        lettered = any(map(str.isalpha, r.text or ""))
        assert r.lang_pred in (model.languages if lettered else ["und"])
        assert 0 <= r.score <= 1 and (lettered or r.score == 0)
    assert language_id.fit(awkward.filter("lang is null")).languages == []
    assert {r.lang_pred for r in language_id.identify(awkward, language_id.fit(awkward.limit(0))).collect()} == {"und"}


def test_languages_by_hand(spark):
    docs = [(1, "the the cat", "en"), (2, "der hund der", "de")]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows = [(1, "the"), (2, "DER der"), (3, "hunde"), (4, "catz the")]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in found] == ["en", "de", "de", "en"]
    # "the" is two of three English words and unknown in German.
    en, de = 2 / 3, 10**-language_id.PENALTY
    assert found[0].score == pytest.approx(en / (en + de))


def test_languages_held_out_accuracy(spark, sf_dir):
    from tunelens.llm.queries import op5_language_id

    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = op5_language_id(spark, sf_dir).filter("held_out").join(lang, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def license_words(text):
    import re

    from tests.llm.brute import LOWER

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_licences_against_brute_force(spark, awkward):
    texts = [
        "Licensed under CC BY-NC 4.0. Apache License; mit\nlicense gnu general public license",
        "gnu general gnu general public license apache mit license license",
        "cc cc by by cc",
        "x" * 50_000 + " cc by",
        license_scan.NOTICES[4][1].replace("merge, publish,", "merge or print,"),
    ]
    rows = awkward.select("doc_id", "text").collect() + [(100 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan(frame, "found").select("text", "found.*").collect()
    assert len(found) == len(rows)
    for r in found:
        own = license_words(r.text)
        hits = [
            (i, label)
            for phrase, label in license_scan.BASE_PHRASES.items()
            for i in range(len(own))
            if own[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for i, _ in hits]
        assert (r.n_words, r.n_base) == (len(own), len(hits))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert found[-1].labels == "mit" and found[-1].score > 0.9
    assert license_scan.scan(awkward.limit(0)).count() == 0


def test_licences_are_told_from_their_neighbours():
    import pyarrow as pa

    gnu, bsd = license_scan.GNU_HEADER, license_scan.BSD_CLAUSES
    third = (
        " 3. Neither the name of Some Body nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    )
    disclaimer = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
    texts = {
        gnu.format("program", "General", "2"): "gpl-2.0",
        gnu.format("program", "General", "3"): "gpl-3.0",
        gnu.format("library", "Library General", "2"): "lgpl-2.0",
        gnu.format("library", "Lesser General", "2.1"): "lgpl-2.1",
        gnu.format("program", "Lesser General", "2.1"): "lgpl-2.1",
        gnu.format("program", "Lesser General", "3"): "lgpl-3.0",
        gnu.format("program", "Affero General", "3"): "agpl-3.0",
        bsd + disclaimer: "bsd-2-clause",
        bsd + third + disclaimer: "bsd-3-clause",
        "licensed under the GNU General Public License, version 2": "gpl-2.0",
        "licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0",
        "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
        "Licensed under the BSD 3-Clause License": "bsd-3-clause",
        "Licensed under CC0 1.0": "cc0-1.0",
    }
    for text, row in zip(texts, license_scan.Scanner().scan(pa.array([f"x {t} y" for t in texts])), strict=True):
        assert [s["label"] for s in row["spans"]] == [texts[text]], text
    both = f"{gnu.format('program', 'General', '2')} some words {bsd} All rights reserved"
    (row,) = license_scan.Scanner().scan(pa.array([both]))
    assert {s["label"] for s in row["spans"]} == {"gpl-2.0", "bsd-2-clause", "all-rights-reserved"}


def test_licence_matching_statistics():
    automaton = license_scan.Automaton([[1, 2, 3, 4], [2, 3, 5], [3, 4, 3, 4, 6]])
    sequences = [[1, 2, 3, 4], [2, 3, 5], [3, 4, 3, 4, 6]]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [1, 2, 3, 5, 3, 4, 3, 4, 6, 9, 2, 3, 4, 3]
    for i, (_, length) in enumerate(automaton.stream(text)):
        longest = max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in runs), default=0)
        assert length == longest


def test_pieces_against_the_library(spark, sf_dir):
    import sentencepiece

    pieces = suffix_pieces.Pieces()
    library = sentencepiece.SentencePieceProcessor(model_file=suffix_pieces.MODEL_FILE)
    odd = ["", " ", "  a", "a ", "x" * 300, " " * 31, " " * 14 + "漢", "a\x00b", "\U0001f642 a\U0001f642", "\n\n"]
    rows = [(i, t) for i, t in enumerate([None, *odd])] + [(r[0], r[1]) for r in awkward_rows()]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(200)
    frame = spark.createDataFrame(rows, "doc_id long, text string").union(documents)
    ids = frame.withColumn("ids", suffix_pieces.encoded(F.col("text"), pieces))
    for r in ids.withColumn("back", suffix_pieces.decoded(F.col("ids"), pieces)).collect():
        assert r.ids == (None if r.text is None else library.encode(r.text)), r.text
        assert r.back == r.text
    assert ids.limit(0).count() == 0


def test_pieces_that_are_no_text():
    import pyarrow as pa

    pieces = suffix_pieces.Pieces()
    lists = [[pieces.first_byte + 0xFF], [], None, [pieces.ids["▁a"], pieces.first_byte + 0xC3]]
    assert suffix_pieces.decode(pieces, pa.array(lists, pa.list_(pa.int32()))).to_pylist() == ["�", "", None, "a�"]

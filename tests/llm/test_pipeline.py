"""The pipeline: each stage on what its predecessor kept, its decisions in effect."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import DOCUMENTS, awkward_rows
from tests.llm.test_corpus_operators import brute_lines, roots, shingles
from tests.llm.test_text_operators import base_counts


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and result of every stage."""
    docs, results = corpus_pipeline.table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        results.append((name, docs, after))
        docs = after
    return results


def test_names_and_columns(stages):
    order = ["language_id", "quality_rules", "line_dedup", "minhash_dedup", "best_fit_packing"]
    assert [name for name, _, _ in stages] == order
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_decisions(stages):
    by_name = {name: (before.collect(), after.collect()) for name, before, after in stages}
    before, after = by_name["language_id"]
    assert len(after) >= 0.99 * len(before)
    before, after = by_name["quality_rules"]
    kept = {r.doc_id for r in after}
    assert all(not base_counts(r.text)[-1] for r in after) and len(kept) > 0.8 * len(before)
    before, after = by_name["line_dedup"]
    # Brute force over windows is quadratic in lines, so only over texts of usual length.
    usual = [(r.doc_id, r.text) for r in before if r.text.count("\n") < 200]
    if len(usual) == len(before):
        expected = brute_lines(usual, 50)
        assert {r.doc_id: r.text for r in after} == {i: t for i, t in expected.items() if t.split()}
    before, after = by_name["minhash_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    shared = {}
    for i, s in sets.items():
        for x in s:
            shared.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in shared.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b])
    root = roots([(a, b) for a, b in pairs if near(a, b)])
    assert {r.doc_id for r in after} == {i for i in sets if root.get(i, i) == i}
    before, after = by_name["best_fit_packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_awkward_documents(spark, tmp_path, sf_dir):
    extra = {c: F.lit("x") for c in ("kept", "score", "row", "__x", "n_lines", "bin")}
    frame = spark.createDataFrame(awkward_rows(), DOCUMENTS).withColumns(extra)
    for docs in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
            assert after.columns == docs.columns
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_near_copies_from_eighty_percent(spark, sf_dir):
    base = [f"w{i}" for i in range(104)]
    two, three = list(base), list(base)
    for place, own in ((30, two), (60, two), (20, three), (50, three), (80, three)):
        own[place] = "other"
    texts = {1: base, 2: two, 3: three}
    sets = {i: shingles(" ".join(t)) for i, t in texts.items()}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= share(1, 2) < 0.85 and max(share(1, 3), share(2, 3)) < 0.8
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == {1, 3}

"""Scorecards on small tables."""

import pytest

from tunelens.operators.evaluation import audit_rows, compare_models, scorecard


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("v", 0, 0, "q0"), ("v", 1, 1, "q1"), ("v", 2, 2, "q2"), ("v", 3, 3, "q3"), ("t", 0, 0, "q" * 300)]
    return spark.createDataFrame(rows, "split string, idx long, correct_option int, query string")


@pytest.fixture(scope="module")
def responses(spark):
    rows = [
        ("m", "v", 0, "#### 01"), ("m", "v", 1, "#### 3"), ("m", "v", 2, "nothing"),
        ("m", "t", 0, "z" * 400 + "#### 99999999999999999999999"), ("n", "v", 3, "#### 4"),
    ]
    return spark.createDataFrame(rows, "model string, split string, idx long, response string")


def test_missing_response_counts_in_total_only(samples, responses):
    card = {r.split: r for r in scorecard(samples, responses.filter("model = 'm'"), combined=True).collect()}
    assert [card["v"][c] for c in ("total", "correct", "wrong", "no_answer", "accuracy")] == [4, 1, 1, 1, 25.0]
    assert [card["t"][c] for c in ("total", "correct", "wrong", "no_answer", "accuracy")] == [1, 0, 1, 0, 0.0]
    assert [card["combined"][c] for c in ("total", "correct", "wrong", "no_answer", "pct_passed")] == [5, 1, 2, 1, 20.0]


def test_models_are_scored_over_all_samples(samples, responses):
    card = {(r.model, r.split): r for r in compare_models(samples, responses, ["v", "t", "none"]).collect()}
    assert set(card) == {(m, s) for m in "mn" for s in ("v", "t", "none")}
    assert (card["m", "none"].total, card["m", "none"].accuracy) == (0, 0.0)
    assert (card["n", "v"].total, card["n", "v"].correct) == (4, 1)
    assert (card["n", "t"].total, card["n", "t"].wrong, card["n", "t"].accuracy) == (1, 0, 0.0)


def test_empty_tables(samples, responses):
    assert scorecard(samples.limit(0), responses).collect() == []
    card = {r.split: r for r in scorecard(samples, responses.limit(0)).collect()}
    assert (card["v"].total, card["v"].no_answer, card["v"].accuracy) == (4, 0, 0.0)


def test_audit_shows_first_and_wrong(samples, responses):
    rows = {(r.split, r.idx): r for r in audit_rows(samples, responses.filter("model = 'm'"), first=1).collect()}
    assert set(rows) == {("v", 0), ("v", 1), ("t", 0)}
    assert rows["v", 0].is_correct and rows["v", 0].truth == 1
    assert rows["t", 0].question == "q" * 200
    assert len(rows["t", 0].response_tail) == 300

"""Chat windows against a plain implementation."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import words
from tunelens.llm import chat_windows, queries

ROWS = "conv_id long, turn long, role string, text string"
CONTROLS = ["<<SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>", "<s>", "<</SYS>>"]
OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": "[/INST] "}


def escape(text):
    return re.sub(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")", r"\\\1\2", text)


def said(role, text):
    return (OPEN.get(role) or f"[ROLE] {escape(role)} [/ROLE] ") + escape(text) + " </s>"


def brute(rows, budget, history, bucket_turns=chat_windows.BUCKET_TURNS):
    """(conv_id, bucket, span, n_context, n_turns, n_tokens, formatted, loss) of every window."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = []
    for conv, turns in talks.items():
        turns.sort()
        cost = lambda t: len(words(t[3])) + 2
        buckets = defaultdict(list)
        for place, t in enumerate(turns):
            buckets[t[1] // bucket_turns if t[0] else -(2**60)].append(place)
        system = [0] if turns[0][2] == "system" else []
        room = max(budget - history - sum(cost(turns[i]) for i in system), budget // 4)
        order = sorted(buckets)
        for n, bucket in enumerate(order):
            spans = []
            for place in buckets[bucket]:
                if spans and sum(cost(turns[i]) for i in [*spans[-1], place]) <= room:
                    spans[-1].append(place)
                else:
                    spans.append([place])
            reach = [*(buckets[order[n - 1]] if n else []), *buckets[bucket]]
            for k, span in enumerate(spans):
                before = []
                for place in reversed([i for i in reach if i < span[0] and i not in system]):
                    if sum(cost(turns[i]) for i in [*before, place]) > history:
                        break
                    before.insert(0, place)
                context = [*(system if span[0] else []), *before]
                text, loss = "", []
                for place in [*context, *span]:
                    _, _, role, own = turns[place]
                    block = said(role, own)
                    if place in span and role == "assistant":
                        loss.append((len(text) + len(OPEN[role]), len(escape(own))))
                    text += block
                tokens = sum(cost(turns[i]) for i in [*context, *span])
                found.append((conv, bucket, k, len(context), len(span), tokens, text, tuple(loss)))
    return found


def talk(seed, n, conv):
    rng = random.Random(seed)
    parts = [*CONTROLS, "\\", "\\\\", "hello", "a b c", "\n", " ", "é🙂", " </s", "s>", "[INST", "<", "$1"]
    rows = []
    for turn in range(n):
        role = rng.choice(["user", "assistant", "tool", "a [/ROLE] b", None, "user\n"])
        if turn == 0 and rng.random() < 0.6:
            role = "system"
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        rows.append((conv, turn * rng.choice([1, 1, 1]), role, rng.choice([text] * 9 + [None])))
    return rows


@pytest.fixture(scope="module")
def rows():
    found = [r for i in range(60) for r in talk(i, random.Random(i).randint(1, 12), i)]
    found += talk(100, 400, 100) + talk(101, 300, 101)
    found += [(200, None, "user", "no number"), (200, 0, "system", "not first"), (200, 1, "assistant", "x")]
    found += [(None, 0, "user", "no id"), (None, 1, "assistant", "one"), (None, 1, "assistant", "one")]
    found += [(201, 0, "user", "word " * 3_000), (201, 1, "assistant", "\\" * 5_000 + "</s>"), (201, 2, "user", "")]
    return found + [(202, 5, "assistant", "b"), (202, 5, "assistant", "a"), (202, 5, "assistant", "b")]


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (64, 16), (30, 0)])
def test_windows(spark, rows, budget, history):
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS bucket", "1 AS formatted").repartition(3)
    found = chat_windows.format_conversations(frame, budget=budget, history=history)
    got = [(*tuple(r)[:-1], tuple(map(tuple, r.loss))) for r in found.collect()]
    assert Counter(got) == Counter(brute(rows, budget, history))


def digests(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in talks.items():
        turns.sort()
        targets = "".join(t for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        yield conv, len(turns), sha(whole), len(targets), sha(targets)


def test_texts_come_back(spark, rows):
    windows = chat_windows.format_conversations(spark.createDataFrame(rows, ROWS), budget=64, history=16)
    found = chat_windows.digest(windows).drop("formatted_chars")
    assert Counter(map(tuple, found.collect())) == Counter(digests(rows))


def test_crowded_turn_numbers(spark):
    """Rows that share a turn number are split all the same."""
    rows = [(1, 3, "user", f"text {i}") for i in range(3_000)] + [(1, 3, "assistant", "same")] * 3_000
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "a")]
    windows = chat_windows.format_conversations(spark.createDataFrame(rows, ROWS)).cache()
    assert windows.agg(F.max("n_tokens")).first()[0] <= chat_windows.BUDGET
    assert windows.groupBy("conv_id", "bucket").agg(F.sum("n_turns")).agg(F.max("sum(n_turns)")).first()[0] <= 128
    assert Counter(map(tuple, chat_windows.digest(windows).drop("formatted_chars").collect())) == Counter(digests(rows))


def test_empty_table(spark):
    windows = chat_windows.format_conversations(spark.createDataFrame([], ROWS))
    assert windows.count() == 0 and chat_windows.digest(windows).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = queries.op13_chat_windows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*ROWS.replace(" long", "").replace(" string", "").split(", ")).collect()]
    rows += [(-1, 0, "user", queries.SAID), (-1, 1, "assistant", queries.SAID)]
    chars = Counter()
    for conv, *_, formatted, _ in brute(rows, chat_windows.BUDGET, chat_windows.HISTORY):
        chars[conv] += len(formatted)
    found = {r.conv_id: r for r in queries.op13_chat_windows(spark, sf_dir).collect()}
    assert {c: r.formatted_chars for c, r in found.items()} == chars
    assert sorted(tuple(r)[:-1] for r in found.values()) == sorted(digests(rows))

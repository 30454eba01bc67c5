"""Records, prompts and message lists."""

import pytest
from pyspark.sql import functions as F

from tunelens.functions.messages import ChatTemplate, apply_template, last_content, patch_system, render, with_privilege, with_privilege_text
from tunelens.operators.prompts import (
    correct_text,
    eval_prompt,
    filter_length,
    max_length,
    paired_prompts,
    reward_input,
    training_prompt,
    with_length,
)
from tunelens.operators.records import build_samples, group_records, normalise_records, rejected_samples
from tunelens.plans.dataset_preparation import prepare_splits
from tunelens.sources.lines import read_lines
from tunelens.sources.tables import peek, read_all, read_params, read_split, rewrite, row_count, union_splits, write_splits

RECORD = ["", "b", "All men are mortal.He is a man.", "Which follows?", "A.He is mortal.", "B.He is not", "C.Nothing.", "D.3 men."]
MESSAGES = "i int, messages array<struct<role:string,content:string>>, label string, datasource string"


def chat(spark, *rows):
    return spark.createDataFrame([(i, m, label, source) for i, (m, label, source) in enumerate(rows)], MESSAGES)


def lines(spark, files):
    rows = [(f, i, v) for f, values in files.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file string, line_no long, value string").repartition(5)


def test_partial_tail_is_dropped(spark):
    records = group_records(lines(spark, {"x": RECORD * 2 + RECORD[:7], "y": RECORD[:3]}))
    rows = records.orderBy("file", "record").collect()
    assert [(r.file, r.record) for r in rows] == [("x", 0), ("x", 1)]
    assert all(list(r["lines"]) == RECORD for r in rows)


def test_samples(spark):
    row = build_samples(normalise_records(group_records(lines(spark, {"x": RECORD})))).first()
    assert row.context == "All men are mortal. He is a man."
    assert row.query == "Which follows?"
    assert list(row.options) == ["He is mortal.", "He is not.", "Nothing.", " men."]
    assert (row.correct_option, row.options_len) == (1, 4)


def test_bad_answer_lines(spark):
    bad = RECORD[:1] + ["e"] + RECORD[2:]
    records = normalise_records(group_records(lines(spark, {"x": RECORD + bad})))
    assert [r.record for r in build_samples(records).collect()] == [0]
    assert [(r.record, r.answer_line) for r in rejected_samples(records).collect()] == [(1, "e.")]
    with pytest.raises(Exception, match="bad answer line"):
        build_samples(records, strict=True).collect()


def sample(spark):
    return spark.createDataFrame(
        [("ctx", "qry", ["one", "two", "three", "four"], 2)],
        "context string, query string, options array<string>, correct_option int",
    )


def test_prompt_wordings(spark):
    row = training_prompt(sample(spark), "SYS").first()
    assert [tuple(m) for m in row.prompt] == [
        ("system", "SYS"),
        ("user", "Context: ctx\n\nQuestion: qry\n\nOptions:\nA. one\nB. two\nC. three\nD. four\n"),
    ]
    assert row.answer == "C"
    row = eval_prompt(sample(spark), "SYS").first()
    assert [tuple(m) for m in row.prompt] == [
        ("system", "SYS"), ("user", "Context: ctx\nQuestion: qry\nOptions:\n1. one\n2. two\n3. three\n4. four"),
    ]
    assert correct_text(sample(spark)).first().correct_text == "three"
    assert correct_text(sample(spark).withColumn("correct_option", F.lit(7))).first().correct_text is None


@pytest.mark.parametrize(
    "before, after",
    [
        ([("user", "u")], [("system", "S"), ("user", "u")]),
        ([("system", "x"), ("user", "u")], [("system", "S"), ("user", "u")]),
        ([("user", "u"), ("system", "x"), ("system", "y")], [("user", "u"), ("system", "S"), ("system", "y")]),
        ([], [("system", "S")]),
    ],
)
def test_patch_system(spark, before, after):
    df = chat(spark, (before, "A", None))
    once = df.withColumn("messages", patch_system(F.col("messages"), "S"))
    assert [tuple(m) for m in once.first().messages] == after
    twice = once.withColumn("messages", patch_system(F.col("messages"), "S"))
    assert twice.first().messages == once.first().messages


def test_privilege_and_rendering(spark):
    df = chat(spark, ([("user", "u")], "B", "src"), ([("user", "u")], "", None), ([("user", "u")], None, None))
    rows = df.select("i", with_privilege(F.col("messages"), F.col("label")).alias("m")).orderBy("i").collect()
    assert [len(r.m) for r in rows] == [2, 1, 1]
    assert tuple(rows[0].m[1]) == ("assistant", "The correct answer is B. Now let me reason through this step by step.")
    template = ChatTemplate("[", "]", ";", "<go>")
    pairs = paired_prompts(df, template, keep=("i",)).orderBy("i").collect()
    assert [p.stu_prompt for p in pairs] == ["[user]u;<go>"] * 3
    assert pairs[0].tea_prompt == "[user]u;[assistant]The correct answer is B. Now let me reason through this step by step.;"
    assert [p.tea_prompt for p in pairs[1:]] == ["[user]u;<go>"] * 2
    assert [(p.label, p.datasource) for p in pairs] == [("B", "src"), ("", "default"), ("", "default")]
    assert {p.prompt_len for p in pairs} == {1}
    assert df.select(render(F.col("messages"), template, False)).first()[0] == "[user]u;"
    assert df.select(last_content(F.col("messages"))).first()[0] == "u"
    assert df.select(last_content(F.slice("messages", 1, 0))).first()[0] is None


def test_plain_text_prompts(spark):
    df = spark.createDataFrame([("do it", "A"), ("do it", "")], "messages string, label string")
    rows = paired_prompts(df, template=None, input_template="Q: {}").collect()
    assert [(r.stu_prompt, r.tea_prompt) for r in rows] == [
        ("Q: do it", "Q: do it\nThe correct answer is A."), ("Q: do it", "Q: do it"),
    ]
    assert df.select(apply_template(F.col("messages"), None)).first()[0] == "do it"
    assert df.select(with_privilege_text(F.col("messages"), F.col("label"))).first()[0].endswith("is A.")


def test_reward_input(spark):
    rows = reward_input(chat(spark, ([("user", "u")], " c ", None))).collect()
    assert [(len(r.prompt), r.correct_option) for r in rows] == [(1, 3)]


def test_lengths(spark):
    df = spark.createDataFrame([("x", "a b c"), ("x", "a"), ("y", "a b c d")], "file string, prompt string")
    longest = {r.file: r.max_len for r in max_length(with_length(df)).collect()}
    assert longest == {"x": 3, "y": 4, None: 4}
    assert filter_length(with_length(df), 3).count() == 2
    listed = chat(spark, ([("user", "a b")], "A", None)).withColumnRenamed("messages", "prompt")
    template = ChatTemplate("", " ", " ", "")
    assert with_length(listed, template=template).first().prompt_len == 3
    assert with_length(listed, template=template, extra_system="s t").first().prompt_len == 6
    counter = F.pandas_udf(lambda s: s.str.len(), "int")
    assert with_length(df, counter=counter).filter("file = 'y'").first().prompt_len == 7


def test_read_lines_keeps_order_over_splits(spark, tmp_path):
    """Splits far smaller than the file, blank lines, carriage returns, no final newline."""
    values = [f"line {i}" + ("\r" if i % 7 == 0 else "") if i % 5 else "" for i in range(4000)]
    (tmp_path / "a.txt").write_bytes(("\n".join(values)).encode())
    (tmp_path / "b.txt").write_bytes("x\ny\n".encode())
    keys = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = read_lines(spark, str(tmp_path)).select(F.element_at(F.split("file", "/"), -1).alias("f"), "line_no", "value").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {name: [r.value for r in sorted((r for r in rows if r.f == name), key=lambda r: r.line_no)] for name in ("a.txt", "b.txt")}
    assert got == {"a.txt": values, "b.txt": ["x", "y"]}
    assert sorted(r.line_no for r in rows if r.f == "a.txt") == list(range(4000))


def test_prepare_splits(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}.txt").write_text("\n".join(RECORD * 2) + "\n")
    prepare_splits(spark, {n: str(tmp_path / f"{n}.txt") for n in ("train", "test")}, str(tmp_path / "out"), "SYS")
    test = read_split(spark, str(tmp_path / "out"), "test")
    assert test.count() == 2
    assert test.first().answer == "B"
    assert set(test.columns) == {"prompt", "answer", "split"}


def test_tables(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "x int, y string")
    two = spark.createDataFrame([(2, "b"), (3, "c")], "x int, y string")
    both = union_splits({"train": one, "test": two})
    assert {(r.x, r.split, r.split_ord) for r in both.collect()} == {(1, "train", 0), (2, "test", 1), (3, "test", 1)}
    write_splits(both, str(tmp_path / "s"))
    for name, n in (("01", 3), ("1", 2), ("a/b 1.0", 1), ("1.0", 4)):
        write_splits(spark.range(n).withColumn("split", F.lit(name)), str(tmp_path / "named"), "append")
    for name, n in (("01", 3), ("1", 2), ("a/b 1.0", 1), ("1.0", 4), ("2", 0)):
        found = read_split(spark, str(tmp_path / "named"), name)
        assert (found.count(), {r.split for r in found.collect()}) == (n, {name} if n else set())
    assert row_count(read_split(spark, str(tmp_path / "s"), "test")).first()["rows"] == 2
    files = read_all(spark, str(tmp_path / "s" / "split=test" / "*.parquet"))
    assert files.count() == 2 and files.first().file.endswith(".parquet")
    assert [r.x for r in peek(both, 2, ("x",)).collect()] == [1, 2]
    with pytest.raises(ValueError):
        rewrite(spark, str(tmp_path / "s"), str(tmp_path / "s") + "/", lambda df: df)
    changed = rewrite(spark, str(tmp_path / "s"), str(tmp_path / "s2"), lambda df: df.withColumn("x", F.col("x") * 10))
    assert sorted(r.x for r in changed.collect()) == [10, 20, 30]


def test_read_params_prunes_columns(spark, tmp_path):
    rows = [("base", "t", [1, 2], 0, [1.0, 2.0], "extra")]
    spark.createDataFrame(rows, "model string, tensor string, shape array<int>, row_idx long, values array<float>, note string").write.parquet(str(tmp_path / "p"))
    assert read_params(spark, str(tmp_path / "p")).columns == ["model", "tensor", "shape", "row_idx", "values"]

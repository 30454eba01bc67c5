"""Stored run data: summaries, arguments and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.functions.common import let

# How a large-file pointer starts, and what opens and closes a traceback.
POINTER_START = "version https://git-lfs"
TRACEBACK_LINE = "Traceback (most recent call last):"
EXCEPTION_LINE = r"^[A-Za-z_][\w.]*(\(\w*\))?(:|$)"

# Lines of one log handled together; borders are carried over.
SECTION_LINES = 4_096


def parse_summaries(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``metrics`` (map of the numeric entries) and ``nested`` (all others, as text)."""
    entries = F.from_json(F.col(text), "map<string,variant>")
    # Only JSON numbers are numbers; text that looks like one stays text.
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    is_number = lambda v: F.rlike(kind(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    numeric = F.map_filter(entries, lambda k, v: is_number(v))
    return df.withColumns(
        {
            "metrics": F.transform_values(numeric, lambda k, v: F.try_variant_get(v, "$", "double")),
            "nested": F.transform_values(
                F.map_filter(entries, lambda k, v: ~is_number(v)), lambda k, v: F.try_variant_get(v, "$", "string")
            ),
        }
    )


def args_to_map(args: Column) -> Column:
    """Alternating flags and values as a map; the last value of a repeated flag stays.

    A trailing flag without value maps to null. Flags lose their leading dashes.
    """
    names = F.transform(
        F.filter(args, lambda a, i: i % 2 == 0), lambda a: F.regexp_replace(a, "^-+", "")
    )
    values = F.transform(F.filter(args, lambda a, i: i % 2 == 0), lambda a, i: F.get(args, 2 * i + 1))

    def last_of_each(pairs: Column) -> Column:
        kept = F.array_distinct(pairs["names"])
        place = lambda name: (F.array_position(pairs["names"], name) - 1).cast("int")
        return F.map_from_arrays(kept, F.transform(kept, lambda name: F.get(pairs["values"], place(name))))

    # Backwards, the first value of a name is its last.
    return let(F.struct(F.reverse(names).alias("names"), F.reverse(values).alias("values")), last_of_each)


def is_pointer(content: Column) -> Column:
    """Whether a file only points at content kept elsewhere."""
    return F.startswith(content, F.lit(POINTER_START))


def pointer_runs(lines: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs whose log only points elsewhere, from its first line; logs may be of any size."""
    return lines.filter((F.col("line_no") == 0) & is_pointer(F.col("value"))).select(run)


def failure_reason(lines: DataFrame, run: str = "run_id", section_lines: int = SECTION_LINES) -> DataFrame:
    """The exception that closes the last traceback of each run's log.

    A traceback opens with its own line and goes on over indented lines; the next line that is not
    indented closes it. Where further indented lines follow that one, they tell its cause, which the
    next such line closes. Lines that merely look like an exception elsewhere in a log do not count.

    Logs are numbered from 0 without gaps and may be of any length: each is handled in sections, and
    the last line of a section and whether a traceback is open are carried over its border. Only marks
    of lines are shuffled, and the text of those that could close a traceback.
    """
    value = F.coalesce(F.col("value"), F.lit(""))
    kind = (
        F.when(F.startswith(value, F.lit(TRACEBACK_LINE)), "opens")
        .when(F.rlike(value, F.lit(r"^[ \t]*\r?$")), "blank")
        .when(F.rlike(value, F.lit(r"^[ \t]")), "inner")
        .otherwise("other")
    )
    text = F.when(F.rlike(value, F.lit(EXCEPTION_LINE)), value)
    section = F.floor(F.col("line_no") / section_lines).alias("section")
    marked = lines.select(F.col(run).alias("run"), section, "line_no", kind.alias("kind"), text.alias("text"))

    keys = ["run", "section"]
    inside = Window.partitionBy(*keys).orderBy("line_no")
    sections = Window.partitionBy("run").orderBy("section")
    last = marked.groupBy(*keys).agg(F.max_by("kind", "line_no").alias("last"))
    before = last.select(*keys, F.lag("last").over(sections).alias("carried"))
    known = marked.join(before.filter("carried is not null"), keys, "left").withColumn(
        "prior", F.coalesce(F.lag("kind").over(inside), F.col("carried"))
    )
    # What stands alone begins something else: a traceback, or not.
    continues = F.coalesce(F.col("prior").isin("opens", "inner"), F.lit(False))
    begins = F.when(F.col("kind") == "opens", F.lit(True)).when((F.col("kind") == "other") & ~continues, F.lit(False))
    begun = known.withColumn("begins", begins)
    ends = begun.groupBy(*keys).agg(
        F.max_by("begins", F.when(F.col("begins").isNotNull(), F.col("line_no"))).alias("left_open")
    )
    earlier = sections.rowsBetween(Window.unboundedPreceding, -1)
    open_before = ends.select(*keys, F.last("left_open", ignorenulls=True).over(earlier).alias("open_before"))
    state = F.coalesce(F.last("begins", ignorenulls=True).over(inside), F.col("open_before"))
    found = begun.join(open_before.filter("open_before"), keys, "left").withColumn("open", state)
    closing = (F.col("kind") == "other") & F.col("begins").isNull() & F.col("open") & F.col("text").isNotNull()
    return found.filter(closing).groupBy(F.col("run").alias(run)).agg(F.max_by("text", "line_no").alias("reason"))

"""Chat formatting in budgeted windows of whole turns, with a loss mask.

The turns of a conversation are dealt into windows of at most ``budget`` tokens, and the windows are
formatted for training. Prefix sums of turn tokens choose the spans: a span begins where the sum has
passed what the one before can hold, and no turn is cut. Each window repeats the conversation's
system turn and, from the prefix sums again, as many turns before its span as ``history`` tokens
hold, so every span is read in context. Only assistant turns of a window's own span are targets;
repeated ones are masked, so each assistant text is learned from once.

The template marks turns by control strings. Where a text holds one itself, a backslash is put
before it and before the backslashes that already stand there; taking one away gives the text back.

Everything is a DataFrame expression. Turns are gathered in buckets of BUCKET_TURNS turn numbers, so
a group is bounded however long a conversation is, and text is shuffled once. Spans end with their
bucket; history and the system turn are carried over the border by narrow joins on the few
conversations that have several buckets. Where one bucket holds more than MOST_TURNS rows (turn
numbers that many rows share), its conversation is numbered by place first, by a range sort, which
splits it.

Defined results: null texts and roles are empty, null ids are one conversation, null turns come
first; rows with equal turns are ordered by role and text, and repeated rows are turns of their own;
a turn longer than a window is a window of its own, over the budget; a system turn that leaves less
than a quarter of the budget does not shrink spans further; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.operators.ordering import with_position
from tunelens.session import materialise

BUDGET = 1_024
HISTORY = 256
BUCKET_TURNS = 128
MOST_TURNS = 1_024
MARKS = 2  # tokens that a turn's control strings count for


@dataclass(frozen=True)
class Template:
    """Control strings that open and close turns; none may begin as another one ends."""

    opens: tuple[tuple[str, str], ...] = (("system", "<<SYS>>"), ("user", "[INST]"), ("assistant", "[/INST]"))
    name: str = "[ROLE]"  # before the name of any other role
    name_end: str = "[/ROLE]"
    close: str = "</s>"
    further: tuple[str, ...] = ("<s>", "<</SYS>>")  # not written, but escaped in texts

    def _any(self) -> str:
        controls = [mark for _, mark in self.opens] + [self.name, self.name_end, self.close, *self.further]
        return "|".join(f"\\Q{c}\\E" for c in controls)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"(?<!\\\\)(\\\\*+)({self._any()})", "\\\\$1$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"(?<!\\\\)\\\\(\\\\*+)({self._any()})", "$1$2")

    def opened(self, role: Column) -> Column:
        """What stands before a turn's text."""
        other = F.concat(F.lit(f"{self.name} "), self.escape(role), F.lit(f" {self.name_end} "))
        found = F.when(F.lit(False), other)
        for known, mark in self.opens:
            found = found.when(role == known, F.lit(f"{mark} "))
        return found.otherwise(other)

    def closed(self) -> str:
        return f" {self.close}"

    def turns(self, formatted: Column) -> Column:
        """Role and text of every turn of a formatted window."""
        parts = F.split(formatted, f"\\Q{self.closed()}\\E", -1)
        return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), self._turn)

    def _turn(self, part: Column) -> Column:
        lead, end = f"{self.name} ", f" {self.name_end} "
        # The name ends where its end mark stands first; in the name itself the mark is escaped.
        at = F.instr(part, F.lit(end))
        role, text = F.when(F.lit(False), part), F.when(F.lit(False), part)
        for known, mark in self.opens:
            mine = F.startswith(part, F.lit(f"{mark} "))
            role = role.when(mine, F.lit(known))
            text = text.when(mine, F.substr(part, F.lit(len(mark) + 2)))
        role = role.otherwise(self.unescape(F.substr(part, F.lit(len(lead) + 1), at - len(lead) - 1)))
        text = text.otherwise(F.substr(part, at + len(end)))
        return F.struct(role.alias("role"), self.unescape(text).alias("text"))


def words(text: Column) -> Column:
    """The default count of tokens: words."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def _numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their bucket; crowded conversations are numbered by place."""
    rows = conversations.select(
        F.col("conv_id").isNotNull().alias("named"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS), F.lit(-(2**60))).cast("long")
    counted = rows.select("named", "conv", bucket.alias("bucket")).groupBy("named", "conv", "bucket").count()
    crowded = materialise(counted.filter(F.col("count") > MOST_TURNS).select("named", "conv").distinct())
    if not crowded.isEmpty():
        some = rows.join(crowded, ["named", "conv"], "left_semi")
        placed = with_position(some, ["turn", "role", "text"], "place", ["named", "conv"])
        others = rows.join(crowded, ["named", "conv"], "left_anti")
        rows = others.unionByName(placed.drop("turn").withColumnRenamed("place", "turn"))
    return rows.withColumn("bucket", bucket)


def _tail(turns: Column, history: int) -> Column:
    """The last turns that hold at most ``history`` tokens together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))
    counted = F.aggregate(
        F.reverse(F.transform(turns, lambda t: t["cost"])),
        start,
        lambda acc, cost: F.struct(
            (acc["n"] + F.when(acc["sum"] + cost <= history, 1).otherwise(0)).alias("n"), (acc["sum"] + cost).alias("sum")
        ),
    )["n"]
    return F.when(counted > 0, F.slice(turns, -F.greatest(counted, F.lit(1)), F.greatest(counted, F.lit(1))))


def format_conversations(
    conversations: DataFrame,
    template: Template = Template(),
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Callable[[Column], Column] = words,
) -> DataFrame:
    """One row for each window: its place, the formatted text and the spans that are learned from.

    ``conv_id``, ``bucket`` and ``span`` order a conversation's windows. ``formatted`` begins with
    ``n_context`` repeated turns, and ``n_turns`` of its own follow. ``loss`` has the start (from 0) and
    length of every target in code points; ``n_tokens`` counts the whole window.
    """
    opened = template.opened(F.col("role"))
    rows = _numbered(conversations).select(
        "named", "conv", "bucket", "turn", "role", "text", template.escape(F.col("text")).alias("body"), opened.alias("open")
    )
    turn = F.struct(
        "turn",
        "role",
        "text",
        F.concat("open", "body", F.lit(template.closed())).alias("said"),
        (tokens(F.col("text")) + MARKS).cast("long").alias("cost"),
        F.length("open").alias("body_at"),
        F.length("body").alias("body_length"),
    )
    keys = ["named", "conv", "bucket"]
    gathered = rows.select(*keys, turn.alias("turn")).groupBy(*keys).agg(F.collect_list("turn").alias("turns"))
    # Rows with equal turns come by role, then text; the text itself is not needed any more.
    slim = lambda t: F.struct(*[t[c].alias(c) for c in ("role", "said", "cost", "body_at", "body_length")])
    gathered = gathered.select(*keys, F.transform(F.array_sort("turns"), slim).alias("turns"))

    # Conversations with several buckets: what is carried over the border.
    order = Window.partitionBy("named", "conv").orderBy("bucket")
    every = rows.select(*keys).distinct()
    first = F.min("bucket").over(Window.partitionBy("named", "conv"))
    later = every.select(*keys, F.lag("bucket").over(order).alias("prior"), first.alias("first"))
    later = materialise(later.filter("prior is not null"))
    prior = later.select("named", "conv", F.col("bucket").alias("next"), F.col("prior").alias("bucket"), "first")
    top = F.get("turns", F.lit(0))
    # The system turn is carried apart, so it is no history.
    talk = F.when(
        (F.col("bucket") == F.col("first")) & (top["role"] == "system"), F.slice("turns", F.lit(2), F.size("turns"))
    ).otherwise(F.col("turns"))
    tails = gathered.join(prior, keys).select("named", "conv", F.col("next").alias("bucket"), talk.alias("turns"))
    tails = tails.select(*keys, _tail(F.col("turns"), history).alias("tail"))
    firsts = later.select("named", "conv", F.col("first").alias("bucket")).distinct()
    systems = gathered.join(firsts, keys).select("named", "conv", top.alias("top")).filter("top.role = 'system'")
    carried = later.select(*keys).join(tails, keys, "left").join(systems, ["named", "conv"], "left")
    whole = gathered.join(carried.withColumn("later", F.lit(True)), keys, "left")
    opens = F.coalesce("later", F.lit(False))
    own = F.get("turns", F.lit(0))
    none = F.filter("turns", lambda t: F.lit(False))
    whole = whole.select(
        *keys,
        "turns",
        opens.alias("later"),
        F.when(opens, F.col("top")).when(own["role"] == "system", own).alias("system"),
        F.concat(F.coalesce("tail", none), F.col("turns")).alias("known"),
        F.coalesce(F.size("tail"), F.lit(0)).alias("carried"),
    ).withColumn("carried", F.greatest("carried", F.lit(0)))

    # Prefix sums of tokens over the carried turns and the bucket's own, then the spans they choose.
    summed = whole.withColumn(
        "sums",
        F.aggregate(
            F.transform("known", lambda t: t["cost"]),
            F.array(F.lit(0).cast("long")),
            lambda acc, cost: F.concat(acc, F.array(F.element_at(acc, -1) + cost)),
        ),
    )
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.cost"), F.lit(0)), F.lit(max(budget // 4, 1)))
    spanned = summed.withColumn("room", room).withColumn(
        "starts",
        F.aggregate(
            F.sequence(F.lit(1), F.size("turns")),
            F.array(F.lit(0)),
            lambda acc, i: F.when(
                (F.get("sums", F.col("carried") + i) - F.get("sums", F.col("carried") + F.element_at(acc, -1)) > F.col("room"))
                & (i - 1 > F.element_at(acc, -1)),
                F.concat(acc, F.array(i - 1)),
            ).otherwise(acc),
        ),
    )
    each = spanned.select("*", F.posexplode("starts").alias("span", "a"))
    stop = F.coalesce(F.get("starts", F.col("span") + 1), F.size("turns"))
    here = F.get("sums", F.col("carried") + F.col("a"))
    far = F.size(F.filter("sums", lambda s: here - s > history))
    # The system turn, when it is the bucket's first, stands on its own and is no history.
    lead = F.when(F.col("later") | F.col("system").isNull(), 0).otherwise(1)
    at_top = ~F.col("later") & (F.col("a") == 0)
    windows = each.select(
        *keys,
        "span",
        "a",
        "turns",
        "known",
        "carried",
        "system",
        stop.alias("stop"),
        F.when(at_top, F.col("carried") + F.col("a")).otherwise(F.greatest(far, lead)).alias("from"),
        (F.col("system").isNotNull() & ~at_top).alias("led"),
    )
    windows = windows.withColumn("n_history", F.greatest(F.col("carried") + F.col("a") - F.col("from"), F.lit(0)))
    shown = F.concat(
        F.when(F.col("led"), F.array("system")).otherwise(F.filter("turns", lambda t: F.lit(False))),
        F.slice("known", F.col("from") + 1, F.col("n_history")),
        F.slice("turns", F.col("a") + 1, F.col("stop") - F.col("a")),
    )
    windows = windows.select(
        *keys,
        "span",
        (F.col("led").cast("int") + F.col("n_history")).alias("n_context"),
        (F.col("stop") - F.col("a")).alias("n_turns"),
        shown.alias("shown"),
    )
    begin = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).cast("long").alias("at"),
        F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("loss"),
    )

    def step(acc: Column, t: Column) -> Column:
        target = (acc["i"] >= F.col("n_context")) & (t["role"] == "assistant")
        place = F.struct((acc["at"] + t["body_at"]).alias("start"), t["body_length"].cast("long").alias("length"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["at"] + F.length(t["said"])).alias("at"),
            F.when(target, F.concat(acc["loss"], F.array(place))).otherwise(acc["loss"]).alias("loss"),
        )

    return windows.select(
        F.when(F.col("named"), F.col("conv")).alias("conv_id"),
        "bucket",
        "span",
        "n_context",
        "n_turns",
        F.aggregate("shown", F.lit(0).cast("long"), lambda acc, t: acc + t["cost"]).alias("n_tokens"),
        F.array_join(F.transform("shown", lambda t: t["said"]), "").alias("formatted"),
        F.aggregate("shown", begin, step)["loss"].alias("loss"),
    )


def read_back(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """The windows with what their formatted text says: ``turns`` of their own, and ``targets``."""
    own = F.slice(template.turns(F.col("formatted")), F.col("n_context") + 1, F.col("n_turns"))
    cut = lambda s: template.unescape(
        F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )
    return windows.select("*", own.alias("turns"), F.transform("loss", cut).alias("targets"))


def digest(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation, from its windows read back: number and hash of turns and targets.

    A hash is over a conversation's whole text, so here, and only here, all of it meets in one row.
    """
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = read_back(windows, template).select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("chars"),
        F.struct(
            "bucket", "span", F.array_join(said, "").alias("said"), F.array_join("targets", "").alias("targets")
        ).alias("part"),
    )
    met = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    whole = met.select(
        "*",
        F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("said"),
        F.array_join(F.transform("parts", lambda p: p["targets"]), "").alias("targets"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2(F.col("targets").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Sharding by balanced label propagation: linked documents move together, row counts stay even.

Documents with equal texts are linked. Every document starts in a shard by the hash of its id. In
each round a group of linked documents looks at where its members are, and those in other shards
move towards the shard with most of them, as far as that shard's quota allows; a group that does
not fit goes on with the fullest shard that still has room. Moves are admitted in hash order until
the quota is used up. Rounds end when nothing moves or after MAX_ROUNDS. Documents without links cut
nothing wherever they are, so they fill the shards up at the end, and shard sizes differ by at most
one row (law ``rows``).

Members of a group are alike, so the state of a round is one row per group with its count in each
shard; a group that holds a third of all rows is one row, too. Loads and quotas are one row for each
shard. Places inside groups, among free rows and inside shards come from sorted or hashed buckets,
never from a window over a group or a shard.

Defined results: null text is no text (size 1, CRC 0) and equals empty text; rows with a null id
and repeated rows are rows like others; fewer rows than shards leave shards empty; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.operators.ordering import hash_key, hash_position, with_position
from tunelens.session import materialise

SHARDS = 16
MAX_ROUNDS = 10
GROUP_BUCKETS = 4_096  # buckets for running sums over groups, for each shard


def _at_place(place: Column, room: Column) -> Column:
    """Index of the bin that holds a place, if bins with that much room follow one another."""
    step = lambda acc, n: F.struct(
        (acc["end"] + n).alias("end"),
        F.when(place < acc["end"] + n, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("past"),
        (acc["at"] + F.when(place < acc["end"] + n, F.lit(0)).otherwise(F.lit(1)).cast("int")).alias("at"),
    )
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).alias("past"), F.lit(0).alias("at"))
    return F.aggregate(room, start, step, lambda acc: acc["at"])


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _loads(groups: DataFrame, shards: int) -> list[int]:
    """Linked rows in each shard: one number for each."""
    summed = groups.select(F.posexplode("held").alias("shard", "n")).groupBy("shard").agg(F.sum("n").alias("n"))
    found = {r["shard"]: r["n"] for r in summed.collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(groups: DataFrame, loads: list[int], quota: int) -> DataFrame:
    """One round: ``groups`` (g1, g2, held) after the moves that the quotas admit.

    ``moved`` tells how many rows of each group moved.
    """
    shards = len(loads)
    room = _longs([max(0, quota - n) for n in loads])
    # The fullest shard with room; ties go to the first.
    best = F.array_max(
        F.transform(
            "held",
            lambda n, s: F.when(F.get(room, s) > 0, F.struct(n.alias("n"), (-s).alias("s"))),
        )
    )
    outside = lambda n, s: (n < F.col("top.n")) | ((n == F.col("top.n")) & (s > -F.col("top.s")))
    wish = F.aggregate(
        F.transform("held", lambda n, s: F.when(outside(n, s), n).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda acc, n: acc + n,
    )
    asked = groups.withColumn("top", best).withColumns(
        {
            "to": -F.col("top.s"),
            "wish": F.when(F.col("top").isNotNull() & (F.col("top.n") > 0), wish).otherwise(F.lit(0)),
            "bucket": F.pmod(F.xxhash64("g1", "g2"), F.lit(GROUP_BUCKETS)),
        }
    )
    # Rows wished for before a group's own: those of earlier buckets, then those before it in its bucket.
    per = asked.filter("wish > 0").groupBy("to", "bucket").agg(F.sum("wish").alias("n"))
    earlier = Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("to", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("to", "bucket").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1)
    # The joined side has at most GROUP_BUCKETS rows for each shard.
    queued = asked.join(F.broadcast(starts), ["to", "bucket"], "left").withColumn(
        "before", F.coalesce("start", F.lit(0)) + F.coalesce(F.sum("wish").over(inside), F.lit(0))
    )
    admitted = F.greatest(F.lit(0), F.least("wish", F.get(room, F.col("to")) - F.col("before")))
    counted = queued.withColumn("moved", F.coalesce(F.when(F.col("wish") > 0, admitted), F.lit(0)))
    # Movers leave the shards in their order until as many have gone as were admitted.
    step = lambda acc, x: F.struct(
        (acc["left"] - F.least(acc["left"], x["gone"])).alias("left"),
        F.concat(acc["held"], F.array(x["n"] - F.least(acc["left"], x["gone"]))).alias("held"),
    )
    parts = F.transform(
        "held",
        lambda n, s: F.struct(
            n.alias("n"), F.when(outside(n, s), n).otherwise(F.lit(0).cast("long")).alias("gone")
        ),
    )
    start = F.struct(F.col("moved").cast("long").alias("left"), F.array().cast("array<bigint>").alias("held"))
    left = F.aggregate(parts, start, step, lambda acc: acc["held"])
    held = F.transform(left, lambda n, s: F.when(s == F.col("to"), n + F.col("moved")).otherwise(n))
    return counted.withColumn("held", F.when(F.col("moved") > 0, held).otherwise(F.col("held"))).select(
        "g1", "g2", "held", "moved"
    )


def shard(documents: DataFrame, shards: int = SHARDS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        documents.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2"),
        )
    )
    total = rows.count()
    start = F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).cast("int")
    counts = rows.withColumn("shard", start).groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
    by = F.map_from_entries(F.collect_list(F.struct("shard", "n")))  # at most one entry for each shard
    held = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.coalesce(F.element_at("by", s), F.lit(0).cast("long")),
    )
    groups = materialise(
        counts.groupBy("g1", "g2")
        .agg(F.sum("n").alias("n"), by.alias("by"))
        .filter("n > 1")
        .select("g1", "g2", held.alias("held"))
    )
    quota = total // shards
    loads = _loads(groups, shards)
    for _ in range(max_rounds):
        after = materialise(propagate(groups, loads, quota))
        moved = after.agg(F.sum("moved")).first()[0]
        groups = after.select("g1", "g2", "held")
        if not moved:
            break
        loads = _loads(groups, shards)

    grouped = rows.join(groups, ["g1", "g2"], "left")
    linked = with_position(
        rows.join(groups, ["g1", "g2"], "left_semi").select("g1", "g2", "doc_id", "size", "text_crc32"),
        ["doc_id"],
        name="place",
        within=["g1", "g2"],
    )
    columns = ["doc_id", "size", "text_crc32", "shard"]
    placed = linked.join(groups, ["g1", "g2"]).withColumn("shard", _at_place(F.col("place"), F.col("held")))
    free = grouped.filter(F.col("held").isNull()).select("doc_id", "size", "text_crc32")
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    if any(n > t for n, t in zip(loads, targets, strict=True)):
        # Where nearly all rows are linked, the start itself may overfill a shard: the rest is free, too.
        ranked = with_position(placed.select(*columns), ["doc_id", "text_crc32"], name="rank", within=["shard"])
        fits = F.col("rank") < F.get(_longs(targets), F.col("shard"))
        free = free.union(ranked.filter(~fits).select("doc_id", "size", "text_crc32"))
        placed = ranked.filter(fits)
        loads = [min(n, t) for n, t in zip(loads, targets, strict=True)]
    numbered = hash_position(
        free,
        hash_key(16, F.col("doc_id"), F.col("text_crc32")),
        ["doc_id", "text_crc32"],
        name="place",
    )
    room = _longs([t - n for t, n in zip(targets, loads, strict=True)])
    filled = numbered.withColumn("shard", _at_place(F.col("place"), room))
    every = placed.select(*columns).union(filled.select(*columns))
    slotted = with_position(every, ["doc_id", "text_crc32"], name="slot", within=["shard"])
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

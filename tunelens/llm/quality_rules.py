"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the whole corpus.

Every document's words, word endings and word pairs are hashed into a fixed number of buckets. Two multinomials
over the buckets are counted: one over all documents, one over a bounded set of trusted documents.
A document's score is the mean log ratio of its n-grams, so length does not matter, and one fixed
threshold decides each document. Beside it stand simple base rules on length and repetition.

Only DataFrame and SQL functions are used. The bucket weights are one array of ``buckets`` longs
(a scalar subquery), and the trusted ids are at most ``max_trusted`` longs, so what is sent to
every executor is bounded whatever the input; the text itself is never shuffled.

Defined results: null, empty or blank text has no words, fails the base rules and has a null score;
repeated rows are scored one by one; an empty table gives no rows; without trusted documents both
multinomials are flat against each other in the trusted part, and the threshold still applies;
all input columns are carried in one struct, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000
MAX_TRUSTED = 20_000  # bound of the trusted sample, the first by CRC-32 of the id
THRESHOLD = -0.5  # mean log ratio below which a document reads unlike the trusted ones
WEIGHT_UNIT = 1_000_000  # log ratios are kept as whole millionths, so sums do not depend on order

MIN_WORDS = 10
WINDOW = 5  # words in a window that must not come twice
MAX_REPEAT_PERCENT = 20

SEPARATORS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
PAIR_FACTOR = 1_000_003
ENDING = 3  # characters of a word's ending
END_SHIFT = 7_919  # so that an ending and the same string as a word part ways


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def codes_of(found: Column) -> Column:
    """CRC-32 code of every word and of its last characters, which tell its form."""
    return F.transform(
        found,
        lambda w: F.struct(
            F.crc32(w.cast("binary")).alias("word"), F.crc32(F.right(w, F.lit(ENDING)).cast("binary")).alias("end")
        ),
    )


def ngram_buckets(codes: Column, buckets: int) -> Column:
    """Bucket of every word, of every word's ending and of every pair of neighbours."""
    pairs = F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: ((a["word"] * PAIR_FACTOR + b["word"]) % buckets).cast("int"),
    )
    single = F.transform(codes, lambda c: (c["word"] % buckets).cast("int"))
    endings = F.transform(codes, lambda c: ((c["end"] + END_SHIFT) % buckets).cast("int"))
    return F.concat(single, endings, pairs)


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` ids of documents labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return (
        good.select("doc_id")
        .distinct()
        .orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(max_trusted)
    )


def bucket_weights(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the log ratio of trusted to all text per bucket, in millionths.

    Both counts are taken over whole texts in one scan and summed before the only shuffle, which
    has at most one row per bucket and task. Counts are smoothed by one.
    """
    marked = documents.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("__trusted"))), "doc_id", "left"
    )
    coded = marked.select(
        "__trusted", codes_of(words(F.col("text"))).alias("__codes")
    )
    grams = coded.select("__trusted", F.explode(ngram_buckets(F.col("__codes"), buckets)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count("__trusted").alias("t"))
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(F.broadcast(counted), "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t")
    )
    table = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n", "t"))).alias("rows"),
        F.sum("n").alias("all_n"),
        F.sum("t").alias("all_t"),
    )
    ratio = lambda r: (
        F.log((r["t"] + 1) / (F.col("all_t") + buckets)) - F.log((r["n"] + 1) / (F.col("all_n") + buckets))
    )
    return table.select(F.transform("rows", lambda r: F.round(ratio(r) * WEIGHT_UNIT).cast("long")).alias("weights"))


def repeated_words(codes: Column) -> Column:
    """Words inside windows of five that come twice or more, from 64-bit window hashes.

    The sorted (hash, place) pairs of a text put equal windows side by side; places of windows with
    an equal neighbour, sorted again, are united as intervals.
    """
    n = F.size(codes)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(WINDOW)])
    )
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda p: F.filter(
        F.transform(
            p,
            lambda x, k: F.when(
                (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    united = F.aggregate(
        F.array_sort(F.element_at(F.transform(F.array(pairs), twice), 1)),
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")),
        lambda acc: acc["n"],
    )
    some = F.size(F.array_distinct(windows)) < n - (WINDOW - 1)
    return F.when(n <= WINDOW, F.lit(0)).when(some, united).otherwise(F.lit(0)).cast("long")


def score_documents(
    documents: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    max_trusted: int = MAX_TRUSTED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The input row as the struct ``row``, with base counts, base_failed, score and kept."""
    weights = bucket_weights(documents, trusted_ids(labels, max_trusted), buckets)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        words(F.col("text")).alias("__words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    counted = split.select(
        "row",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        codes_of(F.col("__words")).alias("__codes"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__keys"),
    )
    grams = F.col("n_words") * 3 - 1
    total = F.aggregate(
        ngram_buckets(F.col("__codes"), buckets), F.lit(0).cast("long"), lambda acc, b: acc + F.get("weights", b)
    )
    scored = counted.withColumn("weights", weights.scalar()).select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("__keys")).alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, total / F.lit(float(WEIGHT_UNIT)) / grams).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    )

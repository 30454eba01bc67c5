"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.llm import (
    chat_windows,
    context_mixing,
    embedding_dedup,
    language_id,
    license_scan,
    line_dedup,
    minhash_dedup,
    oracles,
    packing,
    periodic_runs,
    sharding,
    suffix_pieces,
    token_alignment,
)
from tunelens.llm.quality_rules import score_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeats(rows)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return score_documents(rows, table(spark, sf_dir, "labels")).select("row.doc_id", *counts)


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """CRC-32 of the id's text, modulo the number of buckets; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    model = language_id.fit(documents.filter(~held_out))
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.identify(rows, model).drop("text")


def op6_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = suffix_pieces.Pieces()
    rows = suffix_pieces.encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    return rows.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "same")


def op7_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(rows).select("doc_id", "licences.*")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text by hash becomes periodic from one of its words on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    rows = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("n", n).withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    copies = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.expr("cast(ceil((n - a) / p) as int)")))
    changed = F.concat(F.expr("slice(words, 1, a)"), F.slice(copies, 1, F.expr("n - a")))
    text = F.when(F.col("words").isNotNull() & (F.col("n") > 0), F.array_join(changed, " "))
    return rows.select("doc_id", F.coalesce(text, "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted_periods(table(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(rows)
    # Greatest exact length / period first; runs come by start, then period.
    exponent = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]
    order = lambda x, y: F.coalesce(
        *[F.nullif(F.signum(d), F.lit(0.0)) for d in (exponent(x, y), x["start"] - y["start"], x["period"] - y["period"])],
        F.lit(0.0),
    ).cast("int")
    best = F.get(F.array_sort("runs", order), 0)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), "")
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"), show=token_alignment.as_digest)
    return found.withColumnRenamed("groups", "groups_sha256")


SAID = "</s>[INST] ok [/INST]"  # a text that is nothing but control strings, as conversation -1


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), roles).withColumn("text", F.lit(SAID))
    return chat_windows.digest(chat_windows.format_conversations(rows.unionByName(more)))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_context_mixing": op4_context_mixing,
    "op5_language_id": op5_language_id,
    "op6_suffix_pieces": op6_suffix_pieces,
    "op7_label_sharding": op7_label_sharding,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_chat_windows": op13_chat_windows,
}
ORACLES = oracles.ORACLES

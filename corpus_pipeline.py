"""From raw documents to packed training sequences, stage by stage.

All stages but the last return the columns they were given, whatever else is in them. Rows are judged one
by one, so repeated rows share a fate except where stated; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.llm import language_id, line_dedup, minhash_dedup, packing, quality_rules
from tunelens.llm.tables import without
from tunelens.session import materialise

MIN_LANGUAGE_SCORE = 0.35  # a text that fits no language clearly better than chance is rejected
NEAR_PERCENT = 80  # shared part of two documents' five-word shingles from which one is a near copy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    Null, empty and blank texts and texts without a letter have none. Rows with a null id or language are
    judged like others, they only teach nothing; at equal scores the language first by name counts.
    """
    judged = language_id.identify(docs, language_id.fit(docs), "__lang", "__score")
    kept = (F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)
    return judged.filter(kept).drop("__lang", "__score")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike trusted text go.

    Null and empty texts, and texts of fewer than ten words, fail the base rules; a score that just reaches
    the threshold is kept. Null ids cannot be trusted ids and are scored like others.
    """
    scored = quality_rules.score_documents(docs, table(spark, sf_dir, "labels"))
    # Filters are not pushed through a column that is not deterministic; pushed, this one would compute
    # the repetition counts twice.
    settled = scored.withColumn("place", F.monotonically_increasing_id())
    return settled.filter(F.col("kept") & (F.col("place") >= 0)).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; documents that were nothing else go as a whole.

    The place with the smallest id, then furthest up, stays; null ids come last. Rows with equal id and text
    are one document and lose the same lines. Null and empty texts have no lines and stay. ``n_chars``
    follows the text where lines went.
    """
    names = ("__lines", "__gone_lines", "__kept")
    shortened = line_dedup.drop_repeats(docs, names=names).filter("__kept")
    if "n_chars" in docs.columns:
        length = F.when(F.col("__gone_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
        shortened = shortened.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return shortened.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    All rows with that id stay. Null, empty and blank texts and rows with a null id are in no group and stay.
    """
    judged = materialise(minhash_dedup.near_duplicates(docs, NEAR_PERCENT).filter("not kept").select("doc_id"))
    return without(docs, judged, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a training sequence.

    Texts without words, null ones included, have no bin; long texts come in several pieces. Columns other
    than id and source do not go on.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # the language model and hashed bands are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

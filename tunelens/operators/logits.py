"""Divergence of student and teacher over response positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.functions.divergence import (
    JSD_BETA,
    POINTWISE_CLIP,
    TEMPERATURE,
    block_divergence,
    divergence,
    log_total,
)


def response_positions(df: DataFrame) -> DataFrame:
    """Only positions the loss counts, on both sides at once."""
    return df.filter(F.col("loss_mask"))


def position_divergence(
    df: DataFrame,
    loss: str = "jsd",
    beta: float = JSD_BETA,
    clip: float | None = POINTWISE_CLIP,
    temperature: float = TEMPERATURE,
    mask_ids: Sequence[int] = (),
) -> DataFrame:
    """Add ``divergence``, summed over the vocabulary, for each response position."""
    if clip is not None and clip <= 0:
        clip = None
    value = divergence(loss)(
        F.col("student_logits"), F.col("teacher_logits"),
        beta=beta, clip=clip, temperature=temperature, mask_ids=mask_ids,
    )
    return response_positions(df).select(
        *[c for c in df.columns if c not in ("student_logits", "teacher_logits", "loss_mask")],
        value.alias("divergence"),
    )


def split_position_divergence(
    df: DataFrame,
    by: Sequence[str],
    loss: str = "jsd",
    beta: float | None = JSD_BETA,
    clip: float | None = POINTWISE_CLIP,
    temperature: float = TEMPERATURE,
    mask_ids: Sequence[int] = (),
) -> DataFrame:
    """``divergence`` of each response position whose vocabulary lies in several rows.

    Each row is one block of a position's logits, on both sides, and ``start`` its first vocabulary id;
    ``by`` names the position. Every block gives up one log total for each side before the blocks of a
    position meet, the only shuffle of logits; its shares are summed map-side before theirs. No row
    is ever as wide as the vocabulary.
    """
    if clip is not None and clip <= 0:
        clip = None
    whole = Window.partitionBy(*by)
    rows = response_positions(df).withColumns(
        {"__s": log_total(F.col("student_logits"), temperature), "__t": log_total(F.col("teacher_logits"), temperature)}
    )

    def log_sum(name: str) -> Column:
        return F.col(f"{name}_top") + F.log(F.sum(F.exp(F.col(name) - F.col(f"{name}_top"))).over(whole))

    rows = rows.withColumns({f"{n}_top": F.max(n).over(whole) for n in ("__s", "__t")})
    rows = rows.withColumns({f"{n}_all": log_sum(n) for n in ("__s", "__t")})
    share = block_divergence(
        F.col("student_logits"), F.col("teacher_logits"), F.col("__s_all"), F.col("__t_all"), F.col("start"),
        loss=loss, beta=beta, clip=clip, temperature=temperature, mask_ids=mask_ids,
    )
    return rows.select(*by, share.alias("__share")).groupBy(*by).agg(F.sum("__share").alias("divergence"))


def divergence_loss(
    df: DataFrame,
    by: Sequence[str] = (),
    avg_tokens: float | None = None,
    **options,
) -> DataFrame:
    """Summed divergence over the average token count (all counted positions unless given)."""
    summed = position_divergence(df, **options).groupBy(*by).agg(
        F.sum("divergence").alias("__sum"), F.count("*").alias("tokens")
    )
    share = F.col("tokens") if avg_tokens is None else F.lit(float(avg_tokens))
    loss = F.when(share > 0, F.col("__sum") / share).otherwise(0.0)
    return summed.select(*by, "tokens", loss.alias("loss"))

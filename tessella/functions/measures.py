"""Small numeric functions over columns: rates, quantiles, schedules, sizes, losses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number (fixed values).
MISSING = ("", "N/A", "[N/A]", "NOT SUPPORTED")
#: The largest loss whose exponential is a finite double.
MOST_NLL = math.log(1.7976931348623157e308)


def rate(amount: Column, over: Column, digits: int = 6) -> Column:
    """amount / over, null for a zero divisor."""
    return F.round(amount / F.nullif(over, F.lit(0)), digits)


def nearest_rank(x: str, q: float) -> Column:
    """The nearest-rank percentile as an aggregate."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})")


def interpolated(x: str, q: float) -> Column:
    return F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY {x})")


def distribution(x: str, digits: int = 6) -> list[Column]:
    """count, p50, p95, p99 and max as aggregates; null but for the count on no rows."""
    return [F.count(x).alias("count"), *[F.round(nearest_rank(x, q), digits).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.round(F.max(x), digits).alias("max")]


def relative_range(x: str) -> Column:
    return (F.max(x) - F.min(x)) / F.median(x)


def number_or_null(text: Column) -> Column:
    """A number, or null for the usual texts of a missing one."""
    return F.when(F.upper(F.trim(text)).isin(*MISSING), None).otherwise(F.trim(text).try_cast("double"))


def size_in_bytes(text: Column) -> Column:
    """Bytes of a literal such as 1.5GiB (powers of 1024) or 2kB (powers of 1000)."""
    number = F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)\s*([kKMGTP]?)(i?)B\s*$", 1)
    prefix = F.upper(F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)\s*([kKMGTP]?)(i?)B\s*$", 2))
    binary = F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)\s*([kKMGTP]?)(i?)B\s*$", 3) == "i"
    power = F.coalesce(*[F.when(prefix == p, F.lit(k)) for k, p in enumerate(["", "K", "M", "G", "T", "P"])])
    return F.when(number != "", number.try_cast("double") * F.pow(F.when(binary, 1024.0).otherwise(1000.0), power))


def perplexity(loss_sum: Column, targets: Column) -> tuple[Column, Column, Column]:
    """nll, perplexity (null where it would overflow) and the overflow flag."""
    nll = loss_sum / F.nullif(targets, F.lit(0))
    over = nll > MOST_NLL
    return nll, F.when(~over, F.exp(nll)), F.coalesce(over, F.lit(False))


def warmup_cosine(step: Column, warmup: int, decay: int, least: float) -> Column:
    """The learning-rate factor of an update: linear warm-up, then a cosine to ``least``."""
    if warmup and decay == warmup:
        falling = F.lit(least)
    else:
        progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warmup) / F.lit(decay - warmup)))
        falling = F.lit(least) + F.lit(1.0 - least) * 0.5 * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(falling) if warmup else falling


def regression_percent(base: Column, candidate: Column) -> Column:
    return F.lit(100.0) * (base - candidate) / base


def vocabulary_cost(vocab: Column, embed: int, batch_tokens: int) -> dict[str, Column]:
    """Sizes that follow from a vocabulary: parameters of embedding and biased output, training state, logits."""
    head = vocab * (embed + 1)
    both = vocab * embed + head
    return {
        "embedding_parameters": vocab * embed, "head_parameters": head, "vocabulary_parameters": both, "model_bytes": both * 4,
        "training_state_bytes": both * 16, "logit_elements": vocab * batch_tokens, "multiply_accumulates": vocab * embed * batch_tokens,
    }

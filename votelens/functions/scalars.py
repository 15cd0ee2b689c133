"""Column helpers: rounding, hashing, probability transforms and operating-point arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NA_SPELLINGS = ("not_assessable", "na", "")


def half_up(col: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in every engine."""
    scale = float(10 ** digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round4(col: Column, half_even: bool = False) -> Column:
    """Four-decimal rounding of stored values; ``half_even`` is the banker's variant."""
    return F.bround(col, 4) if half_even else half_up(col, 4)


def hash_byte(salt: str, *keys: Column | str) -> Column:
    """First two hex digits of md5(keys|salt) as 0..255."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(salt)))
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")


MASK32 = 4294967295


def _mixed(df: DataFrame, col: str) -> DataFrame:
    """32-bit integer mixer as a chain of projections.

    Each step names its result once, so Catalyst fuses the chain into one generated loop; written as a single
    nested expression the operand would double at every shift."""
    c = F.col(col)
    for _ in range(2):
        df = df.withColumn(col, c.bitwiseXOR(F.shiftright(c, 16)))
        df = df.withColumn(col, (c * F.lit(73244475)).bitwiseAND(F.lit(MASK32)))
    return df.withColumn(col, c.bitwiseXOR(F.shiftright(c, 16)))


def with_draw_index(df: DataFrame, seed: int, rep: Column, draw: str, size: str, out: str = "idx", stratum: Column | None = None) -> DataFrame:
    """Adds a uniform index in [0, size) for (stratum, rep, draw): 53 mixed bits, so pools beyond 2^32 rows stay uniform.

    Two lanes carry the stream. In each the replicate is mixed, joined with 32 of the 64 bits of the stratum's digest and
    mixed again: replicates of one stratum never share a lane's value, and two strata share a stream only if both lanes
    meet."""
    d = F.col(draw).cast("long")
    first = (rep.cast("long") + F.lit(seed * 7919 + 1)).bitwiseAND(F.lit(MASK32))
    df = df.withColumn("_s", F.md5(stratum) if stratum is not None else F.lit("0" * 32))
    half = lambda at: F.conv(F.substring("_s", at, 8), 16, 10).cast("long")
    df = _mixed(df.withColumn("_r", first).withColumn("_q", first.bitwiseXOR(F.lit(2654435769))).withColumn("_l", d.bitwiseAND(F.lit(MASK32))), "_r")
    df = _mixed(df.withColumn("_r", F.col("_r").bitwiseXOR(half(1))), "_r")
    df = _mixed(df, "_q")
    df = _mixed(_mixed(df.withColumn("_q", F.col("_q").bitwiseXOR(half(9))), "_q"), "_l")
    df = df.withColumn("_b", F.col("_r").bitwiseXOR(F.col("_l")).bitwiseXOR(F.shiftright(d, 32)))
    df = _mixed(df, "_b")
    df = _mixed(df.withColumn("_e", F.col("_b").bitwiseXOR(F.col("_q"))), "_e")
    idx = F.pmod(F.col("_b") * F.lit(2097152) + F.col("_e").bitwiseAND(F.lit(2097151)), F.col(size))
    # never NULL: otherwise a join on the index pushes an is-not-null test, with the whole chain inlined, below it
    return df.withColumn(out, F.coalesce(idx, F.lit(0).cast("long"))).drop("_s", "_r", "_q", "_l", "_b", "_e")


def is_not_assessable(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw)), F.lit("")).isin(*NA_SPELLINGS)


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ppv_from_fpr(fpr: Column, recall: float = 0.9, ratio: float = 100.0) -> Column:
    """Precision at a fixed recall with `ratio` negatives per positive."""
    return F.lit(recall) / (F.lit(recall) + F.lit(ratio) * fpr)


def fpr_from_ppv(ppv: Column, recall: float = 0.9, ratio: float = 100.0) -> Column:
    return F.lit(recall / ratio) * (F.lit(1.0) / ppv - F.lit(1.0))


def safe_div(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den, or ``default`` (NULL when None) where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(default).cast("double"))


def units4(col: Column | str) -> Column:
    """A value stored with four decimals as a whole number of 1e-4 units."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(10000.0) + F.lit(0.5))


def mean4(col: Column | str) -> Column:
    """Mean of a four-decimal column. Whole units add up exactly, so neither the shuffle order nor a retried
    task can change the last digit."""
    u = units4(col)
    return F.sum(u) / F.count(u) / F.lit(10000.0)

"""Out-of-fold pooling, checkpoints, convergence and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelens.functions.ordering import attach_groups
from votelens.functions.scalars import ppv_from_fpr
from votelens.operators.curves import score_metrics


def ensemble_mean(scores: DataFrame, keys: list[str], value: str = "score", out: str = "score") -> DataFrame:
    """Mean probability over views, models and folds."""
    return scores.groupBy(*keys).agg((F.sum(value) / F.count(value)).alias(out))


def select_checkpoint(log: DataFrame) -> DataFrame:
    """Best epoch by AUPRC (PPV where it is missing) next to the final epoch, per run."""
    key = F.coalesce("auprc", "ppv90")
    return log.groupBy("run").agg(F.max_by("epoch", F.struct(key, -F.col("epoch"))).alias("best_epoch"), F.max(key).alias("best_value"),
                                  F.max("epoch").alias("final_epoch"), F.max_by(key, "epoch").alias("final_value"))


def early_tail_summary(log: DataFrame) -> DataFrame:
    """Slope of the last three validation losses, final train-validation gap, converged flag, per run."""
    w = Window.partitionBy("run").orderBy(F.col("epoch").desc())  # one row per epoch of a run
    d = log.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    g = d.groupBy("run").agg(F.max("_r").alias("_n"), at(1, "val_loss").alias("_last"),
                             F.max_by("val_loss", "_r").alias("_first"), at(1, "train_loss").alias("_train"))
    slope = (F.col("_last") - F.col("_first")) / F.greatest(F.col("_n") - 1, F.lit(1))
    gap = F.col("_train") - F.col("_last")
    return g.select("run", slope.alias("slope"), gap.alias("gap"), ((F.abs(slope) < 0.01) & (F.abs(gap) < 0.15)).alias("converged"))


def pool_oof(oof: DataFrame, folds: int, by: list[str], target: float = 0.9) -> DataFrame:
    """Metrics of concatenated folds per arm; arms with a missing fold are left out."""
    full = oof.groupBy(*by).agg(F.count_distinct("fold").alias("_f")).filter(F.col("_f") == folds).select(*by)
    m = score_metrics(attach_groups(oof, full, by), by, target)
    return m.select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("n_pos").alias("pos"), "auroc", "auprc",
                    F.col("fpr_incl").alias("fpr90"), ppv_from_fpr(F.col("fpr_incl"), target).alias("implied_ppv"))

"""Loss functions as offline metrics over stored scores and batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.functions.ordering import attach_groups, exact_quantiles
from votelens.functions.scalars import softplus


def masked_bce(cells: DataFrame, by: list[str] = (), certain_floor: float = 1.0, smooth_eps: float = 0.0,
               unc_w: float = 0.0) -> DataFrame:
    """Weighted soft cross-entropy of concept logits. Expects (logit, value, supervise, weight, prior, pos_weight).

    Supervised cells use the smoothed value weighted by their margin, masked cells a small pull to the prior."""
    s, v, x = F.col("supervise").cast("double"), F.col("value"), F.col("logit")
    margin = 2.0 * F.abs(v - 0.5)
    w = F.col("weight") * (s * (certain_floor + (1.0 - certain_floor) * margin) + (1.0 - s) * unc_w)
    target = s * ((1.0 - smooth_eps) * v + smooth_eps * F.col("prior")) + (1.0 - s) * F.col("prior")
    pw = s * F.col("pos_weight") + (1.0 - s)
    bce = pw * target * softplus(-x) + (1.0 - target) * softplus(x)
    return cells.groupBy(*by).agg((F.sum(w * bce) / (F.sum(w) + 1e-6)).alias("loss"), F.count(F.lit(1)).alias("cells"))


def soft_pauc(rows: DataFrame, by: list[str] = (), q: float = 0.2, logit: str = "logit", target: str = "target") -> DataFrame:
    """Mean softplus(negative - t) with t the q-quantile of certain positives (target >= 0.999); NULL unless a
    group has two certain positives and a negative."""
    by = list(by)
    pos = rows.filter(F.col(target) >= 0.999)
    t = exact_quantiles(pos, by, logit, {"_t": q}).join(
        pos.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")), by) if by else exact_quantiles(pos, [], logit, {"_t": q}).crossJoin(
        pos.agg(F.count(F.lit(1)).alias("_k")))
    neg = rows.filter(F.col(target) == 0)
    j = attach_groups(neg, t, by) if by else neg.crossJoin(F.broadcast(t))  # one threshold row
    g = j.groupBy(*by).agg(F.max("_k").alias("_k"), (F.sum(softplus(F.col(logit) - F.col("_t"))) / F.count(F.lit(1))).alias("_v"))
    return g.select(*by, F.when(F.col("_k") >= 2, F.col("_v")).alias("soft_pauc"))


def pos_neg_pairs(scored: DataFrame, k: int, group: str = "center") -> DataFrame:
    """The k hardest negatives of every positive with their margin.

    Hardest means highest-scoring, which is the same k negatives for every positive of a group; so the group
    limit runs before the shuffle and pairs are only the output rows."""
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "name")
    neg = scored.filter(F.col("label") == 0).withColumn("hardness", F.row_number().over(w)).filter(F.col("hardness") <= k)
    neg = neg.select(group, F.col("name").alias("neg_name"), F.col("score").alias("neg_score"), "hardness")
    pos = scored.filter(F.col("label") == 1).select(group, F.col("name").alias("pos_name"), F.col("score").alias("pos_score"))
    return attach_groups(pos, neg, [group]).withColumn("margin", F.col("pos_score") - F.col("neg_score"))


def _batch_rank(pos: Column, neg: Column, margin: float, k: int) -> tuple[Column, Column]:
    """Sum and count of softplus(margin - (p - n)) over one batch's positives and (hardest k) negatives."""
    hard = F.slice(F.sort_array(neg, asc=False), 1, k) if k else neg
    terms = lambda p: F.aggregate(hard, F.lit(0.0), lambda a, n: a + softplus(F.lit(margin) - (p - n)))
    return F.aggregate(pos, F.lit(0.0), lambda a, p: a + terms(p)), F.size(pos) * F.size(hard)


def rank_loss(batches: DataFrame, margin: float = 1.0, k: int = 0, by: list[str] = ("batch",), logit: str = "logit") -> DataFrame:
    """Pairwise rank loss per batch. A batch holds a fixed number of rows by construction, so its two score
    arrays are bounded and the pairs never become rows."""
    g = batches.groupBy(*by).agg(F.collect_list(F.when(F.col("label") > 0, F.col(logit))).alias("_p"),
                                 F.collect_list(F.when(F.col("label") == 0, F.col(logit))).alias("_n"))
    s, n = _batch_rank(F.col("_p"), F.col("_n"), margin, k)
    return g.select(*by, F.when(n > 0, s / n).otherwise(0.0).alias("rank_loss"), n.alias("pairs"))


def tail_objective(batches: DataFrame, terms: tuple[str, ...] = ("bce", "rank", "pauc"), pos_weight: float = 1.0,
                   margin: float = 1.0, k: int = 0, q: float = 0.2, logit: str = "logit") -> DataFrame:
    """bce + 0.5 * rank + 0.5 * partial-AUC per batch, with selectable terms."""
    x, y = F.col(logit), F.col("label").cast("double")
    bce = pos_weight * y * softplus(-x) + (1.0 - y) * softplus(x)
    pos = F.sort_array(F.collect_list(F.when(y >= 0.999, x)))
    out = batches.groupBy("batch").agg((F.sum(bce) / F.count(F.lit(1))).alias("bce"), pos.alias("_p"),
                                       F.collect_list(F.when(y == 0, x)).alias("_n"))
    s, n = _batch_rank(F.col("_p"), F.col("_n"), margin, k)
    h = F.lit(q) * (F.size("_p") - 1)
    at = lambda i: F.get("_p", i.cast("int"))
    thr = at(F.floor(h)) + (at(F.ceil(h)) - at(F.floor(h))) * (h - F.floor(h))
    pauc = F.aggregate("_n", F.lit(0.0), lambda a, v: a + softplus(v - F.col("_t"))) / F.size("_n")
    out = out.withColumn("_t", thr)
    out = out.withColumn("rank", F.when(n > 0, s / n).otherwise(0.0)).withColumn(
        "pauc", F.when((F.size("_p") >= 2) & (F.size("_n") > 0), pauc).otherwise(0.0))
    use = {"bce": F.col("bce"), "rank": 0.5 * F.col("rank"), "pauc": 0.5 * F.col("pauc")}
    total = F.lit(0.0)
    for t in terms:
        total = total + use[t]
    return out.select("batch", "bce", "rank", "pauc", total.alias("total"))

"""Rank and operating-point metrics.

Everything starts from one small table per group: positives and negatives per distinct score with their
prefix sums from the top. Ties favour positives (a resample lists its positives first), which gives a
closed form: K is the smallest count with K/P >= target, the threshold is the K-th largest positive
score, and the false positives are the negatives strictly above it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.functions.ordering import attach, attach_groups, bounded_prefix_sums, exact_quantiles, ordered_index, prefix_sums, \
    tie_average_ranks
from votelens.functions.scalars import safe_div
from votelens.functions.score_ranges import group_quantiles, rank_metrics

POOLED = "POOLED"


def score_groups(scored: DataFrame, by: list[str], score: str = "score", label: str = "label",
                 weight: str | None = None) -> DataFrame:
    """Positives and negatives per (group, distinct score). Hot scores and hot groups shrink map-side."""
    w = F.col(weight) if weight else F.lit(1)
    d = scored.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    keys = [F.coalesce(F.col(b), F.lit("")).alias(b) if dict(scored.dtypes)[b] == "string" else F.col(b) for b in by]
    return d.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).cast("long").alias("neg"))


def pooled_and_each(groups: DataFrame, group: str = "center") -> DataFrame:
    """Repeat the per-score counts under POOLED; runs after the first aggregation, so it doubles distinct
    scores, not rows."""
    d = groups.withColumn(group, F.explode(F.array(F.lit(POOLED), F.col(group))))
    keys = [c for c in groups.columns if c not in ("pos", "neg")]
    return d.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def curve(groups: DataFrame, by: list[str], bounded: bool = False, axis_by: list[str] | None = None) -> DataFrame:
    """Prefix counts from the highest score down: cum_pos, cum_neg, tot_pos, tot_neg per distinct score."""
    if bounded:
        return bounded_prefix_sums(groups, by, "score", ["pos", "neg"])
    return prefix_sums(groups, by, "score", ["pos", "neg"], axis_by=axis_by)


def k_at_recall(total: Column, target: float) -> Column:
    """Smallest k with k/total >= target, decided by the division itself rather than a rounded product."""
    t = F.lit(float(target))
    k0 = F.greatest(F.ceil(t * total) - 1, F.lit(1))
    step = lambda k: F.when(k / total >= t, k).otherwise(k + 1)
    return F.when(total > 0, F.when(k0 / total >= t, k0).otherwise(step(k0 + 1))).cast("long")


def curve_metrics(c: DataFrame, by: list[str], target: float = 0.9) -> DataFrame:
    """All point metrics of a curve in one aggregation: counts, threshold, every PPV/FPR reading, AUROC, AP."""
    c = c.withColumn("_k", k_at_recall(F.col("tot_pos"), target))
    reached = F.col("cum_pos") >= F.col("_k")
    at = lambda x: F.max_by(F.when(reached, x), F.when(reached, F.col("score")))
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = F.col("tot_neg") - F.col("cum_neg")
    a = c.groupBy(*by).agg(
        F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"), F.max("_k").alias("k"),
        F.max(F.when(reached, F.col("score"))).alias("thr"), at(F.col("cum_neg") - F.col("neg")).alias("fp"),
        at(F.col("cum_neg")).alias("fp_incl"), at(F.col("cum_pos")).alias("tp_incl"),
        F.max(F.when(reached, prec)).alias("ppv_oracle"),
        F.max_by(F.when(reached, F.col("score")), F.when(reached, F.struct(prec, F.col("score")))).alias("thr_oracle"),
        F.sum(pos * (below + neg / 2.0)).alias("_u"),
        F.sum(F.when(F.col("pos") > 0, pos * prec).otherwise(0.0)).alias("_ap"))
    P, N = F.col("n_pos"), F.col("n_neg")
    both = (P > 0) & (N > 0)
    return a.select(
        *by, "n_pos", "n_neg", "k", "thr", "fp",
        F.when(P > 0, F.col("k") / (F.col("k") + F.col("fp"))).alias("ppv"),
        F.when(P > 0, F.col("fp_incl") / F.greatest(N, F.lit(1))).alias("fpr_incl"),
        F.when(both, F.col("fp") / N).alias("fpr_strict"),
        F.when(P > 0, F.col("tp_incl") / (F.col("tp_incl") + F.col("fp_incl"))).alias("ppv_incl"),
        F.when(P > 0, F.col("ppv_oracle")).alias("ppv_oracle"), F.when(P > 0, F.col("thr_oracle")).alias("thr_oracle"),
        F.when(both, F.col("_u") / (P.cast("double") * N)).alias("auroc"),
        F.when(both, F.col("_ap") / P).alias("auprc"))


def score_metrics(scored: DataFrame, by: list[str] = (), target: float = 0.9, score: str = "score",
                  label: str = "label", bounded: bool = False) -> DataFrame:
    by = list(by)
    return curve_metrics(curve(score_groups(scored, by, score, label), by, bounded), by, target)


def group_report(scored: DataFrame, group: str = "center", by: list[str] = (), target: float = 0.9,
                 bounded: bool = False) -> DataFrame:
    """The full metric row for the pooled set and for every group, from one pass over the rows."""
    keys = [*by, group]
    g = pooled_and_each(score_groups(scored, keys), group)
    return curve_metrics(curve(g, keys, bounded), keys, target)


def confusion(label: Column, predicted: Column) -> list[Column]:
    n = lambda cond: F.count(F.when(cond, 1))
    return [n(predicted & (label == 1)).alias("tp"), n(predicted & (label == 0)).alias("fp"),
            n(~predicted & (label == 1)).alias("fn"), n(~predicted & (label == 0)).alias("tn")]


def confusion_at(scored: DataFrame, thr: float, by: list[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy at score >= thr; zero where undefined."""
    d = scored.filter(F.col("label").isin(0, 1))
    c = d.groupBy(*by).agg(*confusion(F.col("label"), F.col("score") >= thr))
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    c = c.withColumn("precision", p).withColumn("recall", r)
    f1 = safe_div(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumn("f1", f1).withColumn("accuracy", safe_div(F.col("tp") + F.col("tn"), total, 0.0))


def ppv_fixed(scored: DataFrame, thr: float, by: list[str] = ()) -> DataFrame:
    """Precision and realised recall at a supplied threshold; denominators floor at one."""
    c = scored.groupBy(*by).agg(*confusion(F.col("label"), F.col("score") >= thr))
    return c.select(*by, (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("ppv"),
                    (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"))


def threshold_table(scored: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """Counts at many cut-offs in one pass: every cut-off is a pair of conditional sums, not a copy of the rows."""
    d = scored.filter(F.col("label").isin(0, 1))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")]
    for i, t in enumerate(thresholds):
        aggs += [F.count(F.when(F.col("score") >= t, 1)).alias(f"_n{i}"),
                 F.count(F.when((F.col("score") >= t) & (F.col("label") == 1), 1)).alias(f"_p{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("thr"), F.col(f"_n{i}").alias("flagged"),
                              F.col(f"_p{i}").alias("caught")) for i, t in enumerate(thresholds)])
    g = d.groupBy(*by).agg(*aggs).withColumn("_r", F.explode(rows))
    return g.select(*by, "n", "positives", "_r.*")


def triage_table(scored: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    t = threshold_table(scored, thresholds, by)
    return t.select(*by, "thr", safe_div(F.col("caught"), F.col("positives"), 0.0).alias("recall"),
                    (F.col("flagged") * 100.0 / F.col("n")).alias("escalate_pct"),
                    (F.col("positives") - F.col("caught")).alias("missed"))


def suspicion_precision_table(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    t = threshold_table(scored, thresholds)
    return t.select("thr", F.col("flagged").alias("n_flagged"),
                    safe_div(F.col("caught"), F.col("flagged")).alias("precision"),
                    safe_div(F.col("caught"), F.col("positives")).alias("recall"),
                    (F.col("positives") / F.col("n")).alias("base_rate"))


def threshold_lookup(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold the number of negatives at or above it and strictly above it.

    Thresholds join the score axis as extra zero-count points, so one prefix sum answers any number of them.
    """
    g = score_groups(scored, []).select("score", "neg", F.lit(0).alias("is_thr"))
    t = thresholds.select(F.col("thr").cast("double").alias("score"), F.lit(0).cast("long").alias("neg"),
                          F.lit(1).alias("is_thr"))
    u = g.unionByName(t).groupBy("score").agg(F.sum("neg").alias("neg"), F.max("is_thr").alias("is_thr"))
    c = prefix_sums(u, [], "score", ["neg"])
    return c.filter(F.col("is_thr") == 1).select(F.col("score").alias("thr"), F.col("cum_neg").alias("neg_at_or_above"),
                                                 (F.col("cum_neg") - F.col("neg")).alias("neg_above"))


def threshold_transfer(scored: DataFrame, by: list[str] = (), group: str = "center", target: float = 0.9,
                       bounded: bool = False) -> DataFrame:
    """Threshold fitted on each group, applied to every other group: precision, recall, FPR on the target.

    Foreign thresholds join the target's score axis as zero-count points, so the work is one more prefix sum
    and never rows times thresholds.
    """
    by = list(by)
    step = bounded_prefix_sums if bounded else prefix_sums
    g = score_groups(scored, [*by, group])
    fit = curve_metrics(curve(g, [*by, group], bounded), [*by, group], target)
    src = fit.filter(F.col("thr").isNotNull()).select(
        *[F.col(b).alias(f"_s_{b}") for b in by], F.col(group).alias("source"), "thr")
    tgt = fit.select(*by, F.col(group).alias("target"), F.col("n_pos").alias("_p"), F.col("n_neg").alias("_n"))
    cond = F.col("source") != F.col("target")
    for b in by:
        cond = cond & (F.col(f"_s_{b}") == F.col(b))
    pairs = tgt.join(src, cond).drop(*[f"_s_{b}" for b in by])  # (source, target) pairs: the output rows
    points = pairs.select(*by, F.col("target").alias(group), F.col("thr").alias("score"),
                          F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    axis = g.unionByName(points).groupBy(*by, group, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = step(axis, [*by, group], "score", ["pos", "neg"]).select(
        *by, F.col(group).alias("target"), F.col("score").alias("thr"), F.col("cum_pos").alias("_tp"),
        F.col("cum_neg").alias("_fp"))
    m = attach(pairs, c, [*by, "target", "thr"])
    return m.select(*by, "source", "target", "thr",
                    F.when(F.col("_p") > 0, safe_div(F.col("_tp"), F.col("_tp") + F.col("_fp"))).alias("ppv"),
                    safe_div(F.col("_tp"), F.col("_p")).alias("recall"),
                    safe_div(F.col("_fp"), F.col("_n")).alias("fpr"))


def rank01(scored: DataFrame, by: list[str] = (), score: str = "score", out: str = "rank01") -> DataFrame:
    """Ordinal rank scaled to [0, 1]; equal scores rank by name."""
    by = list(by)
    d = ordered_index(scored, by, [score, "name"], "_i", "_n")
    return d.select(*scored.columns, (F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))).alias(out))


def defloor(scored: DataFrame, q: float = 0.1, group: str = "center", score: str = "score") -> DataFrame:
    """Subtract each group's q-quantile from its scores."""
    floor = exact_quantiles(scored, [group], score, {"_floor": q})
    return attach_groups(scored, floor, [group]).select(
        *[c for c in scored.columns if c != score], (F.col(score) - F.col("_floor")).alias(score))


def robust_z(scored: DataFrame, group: str = "center", score: str = "score") -> DataFrame:
    """(score - median) / inter-quartile range per group; NULL for a constant group."""
    q = exact_quantiles(scored, [group], score, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    d = attach_groups(scored, q, [group])
    return d.select(*scored.columns, safe_div(F.col(score) - F.col("_q2"), F.col("_q3") - F.col("_q1")).alias("z"))


def rank_fuse_sweep(scored: DataFrame, a: str, b: str, weights: list[float], q: float | None = None,
                    group: str = "center", target: float = 0.9) -> DataFrame:
    """w * rank01(a) + (1 - w) * rank01(b) over a weight grid, optionally de-floored per group and weight. ``name`` is unique.

    Both members are numbered in one pass over (member, score, name) and meet again by name. The ranks are kept by the
    session's executors (and computed again where one is lost), because floors and metrics both read them. Scores of the grid are
    never rows of a shuffle, see ``functions/score_ranges.py``."""
    members = F.array(*[F.struct(F.lit(m).alias("_m"), F.col(c).cast("double").alias("_s")) for m, c in (("a", a), ("b", b))])
    long = scored.select("name", "label", group, F.explode(members).alias("_e")).select("name", "label", group, "_e.*")
    ranked = rank01(long, ["_m"], "_s", "_r")
    r = ranked.groupBy("name", "label", group).agg(F.max(F.when(F.col("_m") == "a", F.col("_r"))).alias("_ra"),
                                                   F.max(F.when(F.col("_m") == "b", F.col("_r"))).alias("_rb"))
    r = r.select("label", group, "_ra", "_rb").persist(StorageLevel.DISK_ONLY)
    scores = [F.lit(float(w)) * F.col("_ra") + (1.0 - F.lit(float(w))) * F.col("_rb") for w in weights]
    w_of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") + 1).cast("int"))
    of = lambda rows, scores, floored: rank_metrics(rows, scores, lambda total: k_at_recall(total, target)).select(
        w_of.alias("w"), F.lit(floored).alias("defloored"), "fpr_strict", "auroc")
    out = of(r, scores, False)
    if q is not None:
        e = attach_groups(r, group_quantiles(r, group, scores, q, "_floor"), [group])
        out = out.unionByName(of(e, [s - F.col(f"_floor{i}") for i, s in enumerate(scores)], True))
    return out


def stratified_folds(frames: DataFrame, k: int, strata: list[str] = ("label", "center"),
                     order: str = "path") -> DataFrame:
    """Fold = position within the stratum in path order, modulo k."""
    d = ordered_index(frames, list(strata), [order], "_i")
    return d.select(*frames.columns, F.pmod(F.col("_i"), F.lit(k)).cast("int").alias("fold"))


def spearman(scored: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two members from their joint score counts with tie-averaged ranks."""
    joint = scored.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    ra = tie_average_ranks(joint, [], "_a", "n").withColumnRenamed("avg_rank", "_ra")
    rb = tie_average_ranks(joint, [], "_b", "n").withColumnRenamed("avg_rank", "_rb")
    j = attach(attach(joint, ra, ["_a"]), rb, ["_b"])
    n = F.col("n").cast("double")
    x, y = F.col("_ra"), F.col("_rb")
    s = joint.agg(F.sum("n").alias("_N"))
    # ranks centred on their known mean (n + 1) / 2 keep the sums well conditioned
    mean = (F.col("_N") + 1) / 2.0
    j = j.crossJoin(F.broadcast(s))  # one row
    return j.agg((F.sum(n * (x - mean) * (y - mean)) / F.sqrt(F.sum(n * (x - mean) * (x - mean)) * F.sum(
        n * (y - mean) * (y - mean)))).alias("rho"))


def spearman_matrix(scored: DataFrame, members: list[str]) -> DataFrame:
    """(a, b, rho) for every pair of score columns: all members are ranked once, all pairs are sums over one pass."""
    long = scored.select("name", F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).cast("double").alias("v")) for m in members])).alias("_m")).select("name", "_m.*")
    counts = long.groupBy("member", "v").agg(F.count(F.lit(1)).alias("n"))
    c = prefix_sums(counts, ["member"], "v", ["n"], descending=False)
    # ranks centred on their known mean (n + 1) / 2 keep the sums well conditioned
    ranks = c.select("member", "v", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0 - (F.col("tot_n") + 1) / 2.0).alias("r"))
    wide = attach(long, ranks, ["member", "v"]).groupBy("name").agg(*[F.max(F.when(F.col("member") == m, F.col("r"))).alias(f"r{i}") for i, m in enumerate(members)])
    pairs = [(i, j) for i in range(len(members)) for j in range(i + 1, len(members))]
    sums = wide.agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{i}")).alias(f"q{i}") for i in range(len(members))], *[F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(members[i]).alias("a"), F.lit(members[j]).alias("b"), (F.col(f"p{i}_{j}") / F.sqrt(F.col(f"q{i}") * F.col(f"q{j}"))).alias("rho")) for i, j in pairs])
    return sums.select(F.explode(rows).alias("_r")).select("_r.*")


def ks_two_sample(df: DataFrame, value: str, in_a: Column, by: list[str] = ()) -> DataFrame:
    """Largest distance between the two empirical distributions, per group."""
    by = list(by)
    g = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.when(in_a, 1)).alias("a"),
                                                      F.count(F.when(~in_a, 1)).alias("b"))
    c = prefix_sums(g, by, "_v", ["a", "b"], descending=False)
    gap = F.abs(F.col("cum_a") / F.col("tot_a") - F.col("cum_b") / F.col("tot_b"))
    return c.groupBy(*by).agg(F.max("tot_a").alias("n_a"), F.max("tot_b").alias("n_b"), F.max(gap).alias("ks"))


def score_tail_profile(scored: DataFrame, by: list[str]) -> DataFrame:
    """Negative median and tails, positive 10th percentile, per group."""
    by = list(by)
    neg = exact_quantiles(scored.filter(F.col("label") == 0), by, "score",
                          {"neg_q10": 0.1, "neg_q50": 0.5, "neg_q95": 0.95, "neg_q99": 0.99})
    pos = exact_quantiles(scored.filter(F.col("label") == 1), by, "score", {"pos_q10": 0.1})
    return neg.join(pos, by, "full")


def above_threshold_share(scored: DataFrame, pool: DataFrame, bucket: str, target: float = 0.9) -> DataFrame:
    """Share and median score of each pool bucket relative to the labelled recall threshold."""
    thr = score_metrics(scored, [], target).select("thr")
    med = exact_quantiles(pool, [bucket], "score", {"median_score": 0.5})
    share = pool.crossJoin(F.broadcast(thr)).groupBy(bucket).agg(  # one threshold row
        F.count(F.lit(1)).alias("n"),
        (F.count(F.when(F.col("score") >= F.col("thr"), 1)) * 100.0 / F.count(F.lit(1))).alias("pct_above"))
    return share.join(med, bucket)


def grouped_auroc(df: DataFrame, by: list[str], score: str, label: str = "label", bounded: bool = True,
                  folded: bool = False, weight: str | None = None) -> DataFrame:
    """AUROC per group with the counts that guards need; ``folded`` returns max(a, 1 - a)."""
    m = curve_metrics(curve(score_groups(df, by, score, label, weight), by, bounded), by)
    a = F.greatest(F.col("auroc"), 1.0 - F.col("auroc")) if folded else F.col("auroc")
    return m.select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg",
                    F.when(F.col("auroc").isNotNull(), a).alias("auroc"))

"""Policy sweeps over stored votes. Every policy is a set of conditional sums over one scan of the votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.operators.curves import grouped_auroc
from votelens.operators.trust import cell_trust, core_profile
from votelens.operators.votes import aggregate_by_config, with_vocabulary
from votelens.functions.scalars import round4


def grid(configs: list[tuple[int, int]], order: list[str]) -> dict:
    """Named vote subsets 'ExV': the first E experts, V votes each."""
    return {f"{e}x{v}": F.col("expert").isin(order[:e]) & (F.col("lens") < v) for e, v in configs}


def config_cells(votes: DataFrame, configs: list[tuple[int, int]], order: list[str]) -> DataFrame:
    return aggregate_by_config(votes, grid(configs, order))


def config_suspicion(cells: DataFrame) -> DataFrame:
    """Curated suspicion per (config, path)."""
    d = with_vocabulary(cells, "gate", "core")
    t = F.col("gate") * F.col("m") * F.col("r")
    d = d.select("config", "path", "core", round4(F.col("c")).alias("value"), round4(t).alias("trust"),
                 F.lit(False).alias("cross_read"))
    return core_profile(d, ("config", "path")).select("config", "path", round4(F.col("_su")).alias("suspicion"))


def assessable_auroc(lc: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    a = grouped_auroc(lc.filter(F.col("m") > 0), by, "c", folded=True, weight=weight)
    return a.select(*by, F.when(F.col("n") >= 10, F.col("auroc")).alias("auroc"))


def _group_means(a: DataFrame, by: list[str]) -> DataFrame:
    d = with_vocabulary(a, "core", "role")
    mean = lambda cond: F.sum(F.when(cond, F.col("auroc"))) / F.count(F.when(cond, F.col("auroc")))
    return d.groupBy(*by).agg(mean(F.col("core")).alias("core_auroc"),
                              mean(F.col("role") == "discriminative").alias("disc_auroc"))


def config_sweep(votes: DataFrame, frames: DataFrame, configs: list[tuple[int, int]], order: list[str]) -> DataFrame:
    """Per config: core and discriminative AUROC over assessable cells, core coverage, suspicion AUROC."""
    lab = frames.filter(F.col("label").isin(0, 1)).select("path", "label")
    cells = config_cells(votes.join(lab.select("path"), "path", "left_semi"), configs, order)
    lc = cells.join(lab, "path")
    m = _group_means(assessable_auroc(lc, ["config", "concept"]), ["config"])
    cov = lc.filter(F.col("concept").isin(V.ROBUST_CORE)).groupBy("config").agg((F.sum("m") / F.count("m")).alias("coverage"))
    s = grouped_auroc(config_suspicion(cells).join(lab, "path"), ["config"], "suspicion", folded=True)
    return m.join(cov, "config").join(s.select("config", F.col("auroc").alias("susp_auroc"), "n"), "config")


def vote_sweep(votes: DataFrame, frames: DataFrame, max_votes: int) -> DataFrame:
    """Votes per model 1..max: AUROCs, reliability and the change against the maximum."""
    lab = frames.filter(F.col("label").isin(0, 1)).select("path", "label")
    keep = {str(v): F.col("lens") < v for v in range(1, max_votes + 1)}
    lc = aggregate_by_config(votes.join(lab.select("path"), "path", "left_semi"), keep).join(lab, "path")
    m = _group_means(assessable_auroc(lc, ["config", "concept"]), ["config"])
    rel = lc.filter(F.col("concept").isin(V.DISCRIMINATIVE)).groupBy("config").agg((F.sum("r") / F.count("r")).alias("reliability"))
    j = m.join(rel, "config").select(F.col("config").cast("int").alias("votes_per_model"), "core_auroc", "disc_auroc", "reliability")
    top = F.max_by("disc_auroc", "votes_per_model").over(Window.partitionBy())  # one row per vote count
    return j.withColumn("delta_disc", F.col("disc_auroc") - top)


def escalation_band(votes: DataFrame, frames: DataFrame, order: list[str], lows: list[float], highs: list[float],
                    full: tuple[int, int] = (2, 3), half: tuple[int, int] = (2, 2), target: float = 0.9) -> DataFrame:
    """Keep the one-call suspicion outside [lo, hi], otherwise the escalated one: AUROC, calls, cheapest policy.

    Frames first collapse to distinct score triples with class counts (stored suspicion has four decimals);
    only those triples meet the policies."""
    lab = frames.filter(F.col("label").isin(0, 1)).select("path", "label")
    name = lambda c: f"{c[0]}x{c[1]}"
    s = config_suspicion(config_cells(votes.join(lab.select("path"), "path", "left_semi"), [(1, 1), full, half], order))
    pick = lambda c: F.max(F.when(F.col("config") == c, F.col("suspicion")))
    p = s.groupBy("path").agg(pick("1x1").alias("s1"), pick(name(full)).alias("s_full"), pick(name(half)).alias("s_half"))
    p = p.filter(F.col("s1").isNotNull() & F.col("s_full").isNotNull()).join(lab, "path")
    p = p.groupBy("s1", "s_full", "s_half", "label").agg(F.count(F.lit(1)).alias("w"))
    policies = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(t).alias("esc"),
                                  F.lit(calls).alias("_calls"))
                         for t, calls in (("full", full[0] * full[1]), ("half", half[0] * half[1])) for lo in lows for hi in highs])
    e = p.select("*", F.explode(policies).alias("_p")).select("*", "_p.*").drop("_p")
    esc = (F.col("s1") >= F.col("lo")) & (F.col("s1") <= F.col("hi"))
    target_score = F.when(F.col("esc") == "full", F.col("s_full")).otherwise(F.col("s_half"))
    e = e.withColumn("_e", esc).withColumn("score", F.when(esc, target_score).otherwise(F.col("s1")))
    keys = ["lo", "hi", "esc"]
    n = F.sum("w")
    cost = e.groupBy(*keys).agg((F.sum(F.col("w") * F.when(F.col("_e"), F.col("_calls")).otherwise(1)) / n).alias("avg_calls"),
                                (F.sum(F.when(F.col("_e"), F.col("w")).otherwise(0)) * 100.0 / n).alias("escalate_pct"))
    from votelens.operators.curves import curve, curve_metrics, score_groups
    a = curve_metrics(curve(score_groups(e, keys, weight="w"), keys, bounded=True), keys)
    a = a.select(*keys, F.greatest(F.col("auroc"), 1.0 - F.col("auroc")).alias("auroc"))
    j = a.join(cost, keys).withColumn("speedup", float(full[0] * full[1]) / F.col("avg_calls"))
    ok = F.col("auroc") >= target
    cheapest = F.min(F.when(ok, F.struct("avg_calls", "esc", "lo", "hi"))).over(Window.partitionBy())  # policies only
    return j.withColumn("meets_target", ok).withColumn(
        "cheapest", F.coalesce(F.struct("avg_calls", "esc", "lo", "hi") == cheapest, F.lit(False)))


def ab_compare(cells_a: DataFrame, cells_b: DataFrame, frames: DataFrame) -> DataFrame:
    """Two strategies per concept: AUROC over all and over assessable cells, coverage, and the differences.

    A cell averages a handful of votes, so few triples of value, coverage and reliability occur: their counts per concept and label
    are persisted, and the cells are computed once for each strategy."""
    lab = frames.filter(F.col("label").isin(0, 1)).select("path", "label")
    both = cells_a.withColumn("arm", F.lit("a")).unionByName(cells_b.withColumn("arm", F.lit("b"))).join(lab, "path")
    by = ["arm", "concept"]
    t = both.groupBy(*by, "c", "m", "r", "label").agg(F.count(F.lit(1)).alias("n")).persist()
    a = grouped_auroc(t, by, "c", folded=True, weight="n").select(*by, "auroc")
    s = assessable_auroc(t, by, "n").withColumnRenamed("auroc", "auroc_ass")
    mean = lambda x: F.sum(F.col(x) * F.col("n")) / F.sum(F.when(F.col(x).isNotNull(), F.col("n")))
    m = t.groupBy(*by).agg(mean("m").alias("assess"), mean("r").alias("rel"))
    j = a.join(s, by, "left").join(m, by)
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{c}_{arm}")
    g = j.groupBy("concept").agg(*[pick(arm, c) for arm in "ab" for c in ("auroc", "auroc_ass", "assess", "rel")])
    return g.withColumn("delta_auroc", F.col("auroc_b") - F.col("auroc_a")).withColumn(
        "delta_ass", F.col("auroc_ass_b") - F.col("auroc_ass_a"))


def ab_group_means(ab: DataFrame) -> DataFrame:
    """Mean assessable AUROC of both arms over core, discriminative and all concepts."""
    d = with_vocabulary(ab, "core", "role")
    groups = F.filter(F.array(F.when(F.col("core"), "core"), F.when(F.col("role") == "discriminative", "discriminative"),
                              F.lit("all")), lambda g: g.isNotNull())
    d = d.withColumn("grp", F.explode(groups))
    mean = lambda c: F.sum(c) / F.count(c)
    g = d.groupBy("grp").agg(mean("auroc_ass_a").alias("mean_a"), mean("auroc_ass_b").alias("mean_b"))
    return g.withColumn("delta", F.col("mean_b") - F.col("mean_a"))

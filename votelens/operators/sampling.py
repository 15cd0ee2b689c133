"""Top-k reports, seeded samples, stratified holdouts and batch plans.

Random picks are hash orders: the sample is a function of (id, seed), the same in any engine and after any
retry. A global pick of n rows is a bounded-heap top-k; picks per stratum use dense hash indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.ordering import attach, exact_quantiles, hash_index
from votelens.functions.scalars import half_up
from votelens.operators.votes import with_vocabulary


def hash_order(key: str, salt: str) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.col(key), F.lit(salt))), F.col(key)]


def top_suspicious(pool: DataFrame, n: int, score: str = "suspicion", key: str = "path") -> DataFrame:
    return pool.orderBy(F.col(score).desc(), F.col(key)).limit(n)


def skip_top_band(pool: DataFrame, skip: int, n: int, score: str = "score", key: str = "path") -> DataFrame:
    """Rows skip..skip+n by score: the very top is left alone because it may hold unlabelled positives."""
    return pool.orderBy(F.col(score).desc(), F.col(key)).offset(skip).limit(n)


def uniform_sample(df: DataFrame, n: int, seed: int, key: str = "path") -> DataFrame:
    return df.orderBy(*hash_order(key, f"u{seed}")).limit(n)


def case_control_sample(frames: DataFrame, n_neg: int, seed: int, key: str = "path") -> DataFrame:
    """All positives and n random negatives."""
    return frames.filter(F.col("label") == 1).unionByName(
        uniform_sample(frames.filter(F.col("label") == 0), n_neg, seed, key))


def core_means(cells: DataFrame) -> DataFrame:
    """Per frame: mean reliability, coverage and value over the core, and mean artifact value."""
    d = with_vocabulary(cells, "core")
    mean = lambda c, cond: F.sum(F.when(cond, F.col(c))) / F.count(F.when(cond, 1))
    core = F.col("core")
    return d.groupBy("path").agg(
        mean("r", core).alias("agree"), mean("m", core).alias("assess"), mean("c", core).alias("susp"),
        mean("c", F.col("concept").isin(V.QUALITY_CHECK)).alias("artifact"))


def sureness(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """agreement * coverage * label consistency * image quality for labelled frames.

    Nine decimals, so that the summation order of an aggregation cannot reorder equal frames."""
    j = core_means(cells).join(frames.filter(F.col("label").isin(0, 1)).select("path", "label", "center"), "path")
    cons = F.when(F.col("label") == 1, F.col("susp")).otherwise(1.0 - F.col("susp"))
    sure = F.col("agree") * F.col("assess") * cons * (1.0 - F.col("artifact"))
    return j.select("path", "label", "center", half_up(sure, 9).alias("sureness"), half_up(F.col("susp"), 9).alias("suspicion"))


def select_anchors(cells: DataFrame, frames: DataFrame, n_pos: int = 2, n_neg: int = 3, n_hard: int = 1) -> DataFrame:
    """Surest positives, the most suspicious of the surer-than-median negatives, then the surest negatives.

    The labelled frames' values are persisted, for median and picks read them; a lost executor's blocks are computed again."""
    s = sureness(cells, frames).persist()
    neg = s.filter(F.col("label") == 0)
    med = exact_quantiles(neg, [], "sureness", {"_med": 0.5})
    pos = s.filter(F.col("label") == 1).orderBy(F.col("sureness").desc(), "path").limit(n_pos)
    hard = (neg.crossJoin(F.broadcast(med)).filter(F.col("sureness") > F.col("_med")).drop("_med")  # one-row median
            .orderBy(F.col("suspicion").desc(), "path").limit(n_hard))
    fill = n_pos + n_neg
    easy = neg.join(F.broadcast(hard.select("path")), "path", "left_anti").select(*neg.columns)  # n_hard rows
    easy = easy.orderBy(F.col("sureness").desc(), "path").limit(fill)
    rank = (pos.withColumn("kind", F.lit("neo")).withColumn("hard", F.lit(False)).withColumn("_o", F.lit(0))
            .unionByName(hard.withColumn("kind", F.lit("ndbe")).withColumn("hard", F.lit(True)).withColumn("_o", F.lit(1)))
            .unionByName(easy.withColumn("kind", F.lit("ndbe")).withColumn("hard", F.lit(False)).withColumn("_o", F.lit(2))))
    # at most n_pos + n_hard + fill candidate rows reach this sort
    return rank.orderBy("_o", F.col("sureness").desc(), "path").limit(fill).select("path", "kind", "center", "hard")


def diverse_pick(cands: DataFrame, k: int, diverse: bool = True) -> DataFrame:
    """Surest k per class; ``diverse`` first takes the surest of each (center, modality), then backfills."""
    order = [F.col("sureness").desc(), F.col("path")]
    if diverse:
        inner = Window.partitionBy("label", "center", "modality").orderBy(*order)
        d = cands.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= k)
        order = [(F.col("_r") > 1).cast("int"), *order]
    else:
        d = cands
    w = Window.partitionBy("label").orderBy(*order)
    return d.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k).drop("_r")


def risk_stratify(cells: DataFrame, frames: DataFrame, core: list[str], n: int, baseline_frac: float = 0.4,
                  seed: int = 0) -> DataFrame:
    """n frames to audit: the riskiest by unreliability, boundary values and look-alike score, plus a random
    baseline from the rest."""
    on = F.col("concept").isin(core)
    edge = F.when((F.col("c") >= 0.35) & (F.col("c") <= 0.65), 1.0).otherwise(0.0)
    k = F.count(F.lit(1))
    g = cells.filter(on).groupBy("path").agg((F.sum(1.0 - F.col("r")) / k).alias("unrel"),
                                             (F.sum(edge) / k).alias("boundary"), (F.sum("c") / k).alias("susp"))
    j = g.join(frames.select("path", "label"), "path")
    look = F.when(F.col("label") == 0, F.col("susp")).otherwise(0.0)
    risk = 0.4 * F.col("unrel") + 0.3 * F.col("boundary") + 0.3 * look
    s = j.select("path", "label", half_up(risk, 9).alias("risk"))
    n_risk = int(round(n * (1.0 - baseline_frac)))
    top = s.orderBy(F.col("risk").desc(), "path").limit(n_risk)
    rest = s.join(F.broadcast(top.select("path")), "path", "left_anti").select(*s.columns)  # n_risk rows
    base = rest.orderBy(*hash_order("path", f"b{seed}")).limit(n - n_risk)
    return top.withColumn("stratum", F.lit("risk")).unionByName(base.withColumn("stratum", F.lit("baseline")))


def core_max(trusted: DataFrame, concepts: list[str]) -> DataFrame:
    return trusted.filter(F.col("concept").isin(concepts)).groupBy("path").agg(F.max("value").alias("core_max"))


def stratified_holdout(frames: DataFrame, core: DataFrame, frac: float = 0.15, seed: int = 0) -> DataFrame:
    """Hold out max(1, floor(n * frac)) frames of every (center, positive-like) stratum."""
    d = frames.join(core, "path").select("path", "center", (F.col("core_max") > 0.4).cast("int").alias("pos_like"))
    i = hash_index(d, ["center", "pos_like"], "path", f"h{seed}", "_i", "_n")
    take = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(frac)))
    return i.select("path", "center", "pos_like", (F.col("_i") < take).alias("holdout"))


def stratified_subset(frames: DataFrame, core: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n unlabelled frames: at most half positive-like, the rest taken round-robin over folders."""
    d = frames.filter(F.col("label") < 0).join(core, "path").select("path", "dir", (F.col("core_max") > 0.4).alias("pos_like"))
    pos = d.filter("pos_like").orderBy(*hash_order("path", f"s{seed}")).limit(n // 2)
    i = hash_index(d.filter(~F.col("pos_like")), ["dir"], "path", f"s{seed}", "_i")
    rest = i.orderBy("_i", "dir").limit(n).select("path", "dir", "pos_like", "_i")
    taken = pos.agg(F.count(F.lit(1)).alias("_taken"))
    # the top-n rest is already bounded by n; keep as many as the positive-like half left free
    w = Window.orderBy("_i", "dir")
    rest = rest.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(taken)).filter(
        F.col("_r") <= n - F.col("_taken")).select("path", "dir", "pos_like")
    return pos.unionByName(rest)


def balanced_batches(rows: DataFrame, pos_per_batch: int, batch_size: int, seed: int = 0,
                     key: str = "name", drop_last: bool = False) -> DataFrame:
    """Batch plan (batch, slot, name, label): no negative twice in an epoch, no positive twice in a batch.

    A batch holds ``pos_per_batch`` positives, or all there are if that is fewer, and its other slots are negatives. The positives' hash
    order is turned by a hash of the batch and cut into as many stretches as there are slots; each slot takes one row of its stretch
    by hash, so slots never meet and every positive is as likely. The last batch holds the negatives that are left; ``drop_last`` plans
    full batches only."""
    size = rows.agg(F.count(F.when(F.col("label") > 0, 1)).alias("_size")).withColumn(
        "_p", F.least(F.lit(pos_per_batch), F.greatest(F.col("_size"), F.lit(1))).cast("long"))
    size = size.withColumn("_q", F.greatest(F.lit(1), F.lit(batch_size) - F.col("_p")))
    neg = hash_index(rows.filter(F.col("label") == 0), [], key, f"n{seed}", "_i", "_n").crossJoin(F.broadcast(size))  # one row of sizes
    neg = neg.withColumn("batch", F.floor(F.col("_i") / F.col("_q")))
    if drop_last:
        neg = neg.filter(F.col("batch") < F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_q"))))
    pos = hash_index(rows.filter(F.col("label") > 0), [], key, f"p{seed}", "_i").select("_i", key, "label")
    batches = neg.select("batch", "_size", "_p").distinct().filter("_size > 0")
    slots = batches.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)))
    draw = lambda *k: F.conv(F.substring(F.md5(F.concat_ws("|", *k, F.lit(f"d{seed}"))), 1, 12), 16, 10).cast("long")
    start, end = F.floor(F.col("slot") * F.col("_size") / F.col("_p")), F.floor((F.col("slot") + 1) * F.col("_size") / F.col("_p"))
    pick = F.pmod(draw(F.col("batch")) + start + F.pmod(draw(F.col("batch"), F.col("slot")), end - start), F.col("_size"))
    drawn = attach(slots.withColumn("_i", pick), pos, ["_i"]).select("batch", F.col("slot").cast("int").alias("slot"), key, "label")
    return drawn.unionByName(neg.select("batch", (F.col("_i") % F.col("_q") + F.col("_p")).cast("int").alias("slot"), key, "label"))


def pool_sample(pool: DataFrame, listing: DataFrame, n: int, seed: int, buckets: list[str] | None = None,
                lo: float = 0.3, use_decision: bool = True) -> DataFrame:
    """n random pool rows whose file exists; the confident-negative mask travels along."""
    p = pool.filter(F.col("decision").isin(buckets)) if buckets else pool
    s = p.join(listing.select("path"), "path", "left_semi").orderBy(*hash_order("path", f"q{seed}")).limit(n)
    return s.select("path", "decision", "suspicion", confident_negative(lo, use_decision).alias("conf_neg"))


def confident_negative(lo: float = 0.3, use_decision: bool = True) -> Column:
    low = F.col("suspicion") < lo
    return low & (F.col("decision") == "CONFIDENT_NEGATIVE") if use_decision else low

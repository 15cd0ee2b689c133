"""Mining unlabelled pools: manifests, buckets, concept scores, guarded negatives and gated pseudo-positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.ordering import exact_quantiles
from votelens.functions.scalars import half_up
from votelens.operators.sampling import skip_top_band, top_suspicious, uniform_sample
from votelens.operators.trust import curate_frames


def unlabeled_manifest(curated: DataFrame) -> DataFrame:
    """Unlabelled frames with folder, path, bucket and scores, plus the two suspicion cuts."""
    return curated.filter(F.col("label") < 0).select(
        "name", "dir", "path", "suspicion", "decision", "frame_trust",
        (F.col("suspicion") > 0.7).alias("gt07"), (F.col("suspicion") > 0.85).alias("gt085"))


def exclude_dirs(pool: DataFrame, dirs: list[str]) -> DataFrame:
    return pool.filter(~F.col("dir").isin(dirs)) if dirs else pool


def holdout_filter(rows: DataFrame, holdout: str) -> DataFrame:
    """Leak guard: drop one center, or ('labeled') every labelled row, or ('none') nothing. Unlabelled rows carry
    no usable center, so holding out a center drops them too."""
    if holdout == "none":
        return rows
    if holdout == "labeled":
        return rows.filter(F.col("label") < 0)
    return rows.filter((F.col("label") >= 0) & (F.col("center") != holdout))


def bucket_lists(manifest: DataFrame, conf_sample: int, top: int, seed: int = 0) -> DataFrame:
    """Three path lists in one frame: every hard-negative candidate, sampled easy negatives, most suspicious."""
    hard = manifest.filter(F.col("decision") == "HARD_NEG_CANDIDATE").select(F.lit("hardneg").alias("list"), "path")
    easy = uniform_sample(manifest.filter(F.col("decision") == "CONFIDENT_NEGATIVE"), conf_sample, seed)
    susp = top_suspicious(manifest, top)
    return hard.unionByName(easy.select(F.lit("confneg").alias("list"), "path")).unionByName(
        susp.select(F.lit("suspicious").alias("list"), "path"))


def concept_score_columns(**groups: list[str]) -> list[Column]:
    """Trust-weighted mean value of each named concept group; nine decimals keep orderings reproducible."""
    out = []
    for name, members in groups.items():
        on = F.col("concept").isin(members)
        w = F.sum(F.when(on, F.col("trust")).otherwise(0.0))
        s = F.sum(F.when(on, F.col("value") * F.col("trust")).otherwise(0.0))
        out.append(half_up(s / F.greatest(w, F.lit(1e-6)), 9).alias(name))
    return out


def concept_score(trusted: DataFrame, **groups: list[str]) -> DataFrame:
    return trusted.groupBy("path").agg(*concept_score_columns(**groups))


def frame_profile(frames: DataFrame, trusted: DataFrame, **groups: list[str]) -> DataFrame:
    """The curated columns and the score of each named concept group (default: ``surface`` and ``decisive``) per frame,
    all from one aggregation of the cells.

    The mining operators read a profile twice, for a threshold over labelled positives and for the unlabelled rows, so a
    caller with more than one of them, or with costly cells, persists it."""
    return curate_frames(frames, trusted, False, *concept_score_columns(**(groups or {"surface": V.CONFOUNDERS, "decisive": V.DECISIVE})))


def positive_quantile(profile: DataFrame, q: float, name: str) -> DataFrame:
    """One row: the q-quantile of ``decisive`` over labelled positives."""
    return exact_quantiles(profile.filter(F.col("label") == 1), [], "decisive", {name: q})


def confounded_tail_mine(profile: DataFrame, skip: int, n: int) -> DataFrame:
    """Unlabelled frames high on surface look-alike concepts but below the labelled-positive median on the
    decisive ones."""
    med = positive_quantile(profile, 0.5, "_med")
    kept = profile.filter(F.col("label") < 0).crossJoin(F.broadcast(med)).filter(  # one-row median
        F.col("decisive") < F.coalesce(F.col("_med"), F.lit(1.0)))
    return skip_top_band(kept.select("path", "surface", "decisive"), skip, n, "surface")


def model_fp_mine(manifest: DataFrame, scores: DataFrame, skip: int, n: int, exclude: list[str] = (),
                  buckets: tuple[str, ...] = ("CONFIDENT_NEGATIVE",)) -> DataFrame:
    """Highest model scores inside very-likely-negative buckets, after skipping the top."""
    pool = exclude_dirs(manifest.filter(F.col("decision").isin(*buckets)), list(exclude))
    return skip_top_band(pool.join(scores.select("path", "score"), "path").select("path", "dir", "score"), skip, n)


def _gated(profile: DataFrame, scores: DataFrame | None, pos_pct: float, buckets: tuple[str, ...], susp_min: float,
           model_min: float) -> DataFrame:
    thr = positive_quantile(profile, pos_pct / 100.0, "_thr")
    j = profile.filter(F.col("label") < 0).select("path", "decisive", "decision", "suspicion").crossJoin(F.broadcast(thr))  # one-row threshold
    j = j.join(scores.select("path", "score"), "path", "left") if scores is not None else j.withColumn("score", F.lit(None).cast("double"))
    model = (F.coalesce("score", F.lit(0.0)) >= model_min) if scores is not None else F.lit(True)
    return j.select("path", "decisive", "score", F.coalesce(F.col("decisive") >= F.col("_thr"), F.lit(False)).alias("gate_a"),
                    F.coalesce("decision", F.lit("?")).isin(*buckets).alias("gate_c"),
                    (F.coalesce("suspicion", F.lit(0.0)) >= susp_min).alias("gate_d"), model.alias("gate_b"))


MINE_BUCKETS = ("HARD_NEG_CANDIDATE", "ABSTAIN")


def pseudo_positive_mine(profile: DataFrame, scores: DataFrame | None, n: int, pos_pct: float = 50.0,
                         susp_min: float = 0.9, model_min: float = 0.5, buckets: tuple[str, ...] = MINE_BUCKETS,
                         listing: DataFrame | None = None) -> DataFrame:
    """Frames of a :func:`frame_profile` that pass the concept, bucket, suspicion and model gates, best model score first."""
    g = _gated(profile, scores, pos_pct, buckets, susp_min, model_min)
    cand = g.filter(F.col("gate_a") & F.col("gate_c") & F.col("gate_d"))
    if listing is not None:
        cand = cand.join(listing.select("path").distinct(), "path", "left_semi")
    kept = cand.filter("gate_b")
    rank = [F.col("score").desc()] if scores is not None else [F.col("decisive").desc()]
    return kept.orderBy(*rank, "path").limit(n).select("path", "decisive", "score")


def gate_survivors(profile: DataFrame, scores: DataFrame, **kw) -> DataFrame:
    """Survivors after each gate in order A, A+C, A+C+D, A+C+D+B."""
    args = dict(pos_pct=50.0, buckets=MINE_BUCKETS, susp_min=0.9, model_min=0.5) | kw
    g = _gated(profile, scores, **args)
    a, b, c, d = (F.col(f"gate_{x}") for x in "abcd")
    n = lambda cond: F.count(F.when(cond, 1))
    return g.agg(F.count(F.lit(1)).alias("unlabeled"), n(a).alias("after_a"), n(a & c).alias("after_ac"),
                 n(a & c & d).alias("after_acd"), n(a & c & d & b).alias("after_acdb"))


def gate_redundancy(profile: DataFrame, scores: DataFrame, **kw) -> DataFrame:
    """For each gate: frames passing all the others, frames passing all, and the share this gate alone removes."""
    args = dict(pos_pct=50.0, buckets=MINE_BUCKETS, susp_min=0.9, model_min=0.5) | kw
    g = _gated(profile, scores, **args)
    gates = ["gate_a", "gate_c", "gate_d", "gate_b"]
    aggs, every = [], F.lit(True)
    for x in gates:
        every = every & F.col(x)
    for x in gates:
        rest = F.lit(True)
        for y in gates:
            if y != x:
                rest = rest & F.col(y)
        aggs.append(F.count(F.when(rest, 1)).alias(f"_{x}"))
    t = g.agg(F.count(F.when(every, 1)).alias("passing_all"), *aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("gate"), F.col(f"_{x}").alias("passing_others")) for x in gates])
    t = t.select("passing_all", F.explode(rows).alias("_r")).select("_r.*", "passing_all")
    return t.withColumn("removed_share", F.when(F.col("passing_others") > 0,
                                                1.0 - F.col("passing_all") / F.col("passing_others")))


def ambiguous_pool(trusted: DataFrame, curated: DataFrame, main: list[str],
                   buckets: tuple[str, ...] = MINE_BUCKETS) -> DataFrame:
    """Ambiguous unlabelled frames with value and supervise arrays of the MAIN concepts."""
    p = curated.filter((F.col("label") < 0) & F.col("decision").isin(*buckets)).select("path", "decision")
    pick = lambda c, n: F.max(F.when(F.col("concept") == n, F.col(c).cast("double")))
    t = trusted.filter(F.col("concept").isin(main)).groupBy("path").agg(
        F.array(*[F.coalesce(pick("value", n), F.lit(0.0)) for n in main]).alias("value"),
        F.array(*[F.coalesce(pick("supervise", n), F.lit(0.0)) for n in main]).alias("supervise"))
    return p.join(t, "path")


def append_pools(labeled: DataFrame, negatives: DataFrame, pseudo: DataFrame, soft: float = 0.85,
                 holdout: bool = False) -> DataFrame:
    """Training rows: labelled targets, mined negatives as 0, pseudo-positives as a soft target. With a held-out
    group the unlabelled pools are left out, because they may contain it."""
    base = labeled.select("path", F.col("label").cast("double").alias("target"), "center", F.lit("labeled").alias("origin"))
    if holdout:
        return base
    neg = negatives.select("path", F.lit(0.0).alias("target"), F.lit("").alias("center"), F.lit("negative").alias("origin"))
    pos = pseudo.select("path", F.lit(float(soft)).alias("target"), F.lit("").alias("center"), F.lit("pseudo").alias("origin"))
    return base.unionByName(neg).unionByName(pos)


def positive_repetition(batches: DataFrame) -> DataFrame:
    """How often an average positive is replayed in one epoch of a batch plan."""
    pos = F.col("label") > 0
    g = batches.agg(F.count_distinct("batch").alias("batches"), F.count(F.when(pos, 1)).alias("draws"),
                    F.count_distinct(F.when(pos, F.col("name"))).alias("distinct_positives"))
    return g.withColumn("replay", F.col("draws") / F.col("distinct_positives"))

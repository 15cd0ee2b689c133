"""Cells to trust to curated frames: gates, cross-reading agreement, decisions and label records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import mean4, round4, units4
from votelens.operators.votes import with_vocabulary


def cell_trust(cells: DataFrame, cross: DataFrame | None = None, legacy_gate: bool = False,
               half_even: bool = False) -> DataFrame:
    """trust = gate * coverage * reliability * agreement. ``cross`` (path, concept, c_alt) supplies a second
    reading; cells without one keep the unverified factor. Value and trust are stored with four decimals,
    the supervise flag uses the unrounded trust."""
    gate = "legacy_gate" if legacy_gate else "gate"
    d = with_vocabulary(cells, gate, "core").filter(F.col(gate) > 0)
    if cross is None:
        factor = F.lit(V.UNVERIFIED_PENALTY)
        seen = F.lit(False)
    else:
        d = d.join(cross.select("path", "concept", "c_alt"), ["path", "concept"], "left")
        seen = F.col("c_alt").isNotNull()
        factor = F.when(seen, 1.0 - F.abs(F.col("c") - F.col("c_alt"))).otherwise(V.UNVERIFIED_PENALTY)
    t = F.col(gate) * F.col("m") * F.col("r") * factor
    d = d.withColumn("_t", t).withColumn("_seen", seen)
    return d.select("path", "concept", "core", round4(F.col("c"), half_even).alias("value"),
                    round4(F.col("_t"), half_even).alias("trust"),
                    (F.col("_t") >= V.TRUST_SUPERVISE).alias("supervise"), F.col("_seen").alias("cross_read"))


def decide(label: Column, frame_trust: Column, suspicion: Column) -> Column:
    return (F.when(frame_trust < V.FRAME_TRUST_MIN, "ABSTAIN")
            .when(label == 1, "POSITIVE").when(label == 0, "TRUE_NEGATIVE")
            .when(suspicion >= V.SUSPICION_HI, "HARD_NEG_CANDIDATE").otherwise("CONFIDENT_NEGATIVE"))


def core_profile(trusted: DataFrame, by: tuple[str, ...] = ("path",), *more: Column) -> DataFrame:
    """Unrounded frame trust (mean core trust) and suspicion (trust-weighted core value, 0 without trust), and any
    further aggregates ``more`` of the same cells.

    Stored values and trusts are multiples of 1e-4; summing them as whole units is exact, so a decision at a
    rounding tie does not depend on the order in which a shuffle delivers the cells."""
    core = F.col("core")
    st = F.sum(F.when(core, units4("trust")))
    sv = F.sum(F.when(core, units4("value") * units4("trust")))
    g = trusted.groupBy(*by).agg(F.count(F.when(core, 1)).alias("_k"), st.alias("_st"), sv.alias("_sv"),
                                 F.max("cross_read").alias("verified"), *more)
    rest = [c for c in g.columns if c not in (*by, "_k", "_st", "_sv", "verified")]
    return g.select(*by, F.when(F.col("_k") > 0, F.col("_st") / F.col("_k") / 10000.0).otherwise(0.0).alias("_ft"),
                    F.when(F.col("_st") > 0, F.col("_sv") / F.col("_st") / 10000.0).otherwise(0.0).alias("_su"), "verified", *rest)


def curate_frames(frames: DataFrame, trusted: DataFrame, half_even: bool = False, *more: Column) -> DataFrame:
    """One decision per frame that has cells, followed by any further aggregates ``more`` of its cells."""
    p = core_profile(trusted, ("path",), *more)
    rest = [c for c in p.columns if c not in ("path", "_ft", "_su", "verified")]
    j = frames.join(p, "path")
    return j.select("path", "name", "dir", "label", "center", "split",
                    decide(F.col("label"), F.col("_ft"), F.col("_su")).alias("decision"),
                    round4(F.col("_ft"), half_even).alias("frame_trust"),
                    round4(F.col("_su"), half_even).alias("suspicion"), "verified", *rest)


def _concept_map() -> Column:
    return F.map_from_entries(F.collect_list(F.struct("concept", F.struct("value", "trust", "supervise")))).alias("concepts")


def label_records(curated: DataFrame, trusted: DataFrame) -> DataFrame:
    """The nested label record: a map of at most 35 concept structs per frame."""
    return _record_columns(curated.join(trusted.groupBy("path").agg(_concept_map()), "path"))


def curated_records(frames: DataFrame, trusted: DataFrame) -> DataFrame:
    """:func:`label_records` of the frames' own decisions: both come from one aggregation, so the cells are computed once."""
    return _record_columns(curate_frames(frames, trusted, False, _concept_map()))


def _record_columns(d: DataFrame) -> DataFrame:
    return d.select(
        F.concat(F.lit("images/"), F.col("name"), F.lit(".jpg")).alias("image"), "name", "split", "label", "center",
        "decision", "frame_trust", "suspicion", "verified", "concepts", "path", "dir")


def decision_counts(curated: DataFrame, trusted: DataFrame) -> DataFrame:
    """Frames, mean trust and supervised cells per decision."""
    sup = trusted.groupBy("path").agg(F.count(F.when(F.col("supervise"), 1)).alias("cells"))
    return curated.join(sup, "path", "left").groupBy("decision").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.coalesce("cells", F.lit(0))).alias("supervised_cells"),
        mean4("frame_trust").alias("mean_trust"))


def gate_weights(cells: DataFrame) -> DataFrame:
    """Gate per concept present in the cells: role-weighted and legacy mode, with the cells each gate admits."""
    return with_vocabulary(cells, "role", "gate", "legacy_gate").groupBy("concept", "role", "gate", "legacy_gate").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("legacy_gate") > 0, 1)).alias("legacy_cells"))


def concept_arrays(records: DataFrame) -> DataFrame:
    """Value, trust and supervise arrays in vocabulary order; zeros where a concept is absent."""
    order = F.array(*[F.lit(n) for n in V.NAMES])
    cell = lambda n, f: F.element_at("concepts", n)[f]
    pick = lambda f: F.transform(order, lambda n: F.coalesce(cell(n, f).cast("double"), F.lit(0.0)))
    keep = [c for c in records.columns if c != "concepts"]
    return records.select(*keep, pick("value").alias("value"), pick("trust").alias("trust"),
                          F.transform(order, lambda n: F.coalesce(cell(n, "supervise").cast("int").cast("double"),
                                                                  F.lit(0.0))).alias("supervise"))


def trust_band(trust: Column) -> Column:
    return F.when(trust >= 0.75, "high").when(trust >= 0.5, "medium").otherwise("low")

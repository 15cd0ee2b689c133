"""Plans that read their cells once, and joins on groups that hold most rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.functions.ordering import attach_groups
from votelens.operators import audit as A
from votelens.operators import curves as C
from votelens.operators import mining as M


def table_scans(plan: str) -> int:
    """Scans of given tables in a logical plan; persisted parts are no scans."""
    return len(re.findall(r"(?<!InMemory)Relation ?\[", plan))


@pytest.mark.parametrize("name", ["concept_audit", "concept_ppv"])
def test_audits_read_each_table_twice_at_most(spark, sf_dir, name):
    import __spark_entry__ as e
    plan = e.queries()[name](spark, sf_dir)._jdf.queryExecution()
    assert 0 < table_scans(plan.optimizedPlan().toString()) <= 4  # documents and labels, for the frames and for their votes


@pytest.mark.parametrize("name", ["confounded_tail_mine", "pseudo_positive_mine", "gate_survivors", "gate_redundancy"])
def test_mining_reads_nothing_but_the_profile(spark, sf_dir, name):
    import __spark_entry__ as e
    plan = e.queries()[name](spark, sf_dir)._jdf.queryExecution()
    assert "InMemoryRelation" in plan.withCachedData().toString() and table_scans(plan.withCachedData().toString()) == 0


def cells(spark, seed=0):
    """Cells of 300 frames: one concept with both classes everywhere, one without positives in a center, one with nulls."""
    rng = np.random.default_rng(seed)
    frames, rows = [], []
    for i in range(300):
        label, center = int(rng.random() < 0.3), ["center_1", "center_2", None][i % 3]
        frames.append((f"p{i}", label if i % 10 else -1, center))
        for concept in ("blur", "glare", "size"):
            one = 0 if concept == "glare" and center == "center_2" else label
            value = None if concept == "size" and i % 7 == 0 else round(float(np.clip(rng.normal(0.4 + 0.2 * one, 0.2), 0, 1)), 1)
            rows.append((f"p{i}", concept, value, round(float(rng.random()), 4), bool(rng.random() < 0.5)))
    return (spark.createDataFrame(frames, "path string, label int, center string"),
            spark.createDataFrame(rows, "path string, concept string, value double, trust double, supervise boolean"), frames, rows)


def auroc(pos, neg):
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_audits_equal_brute_force(spark):
    frames, trusted, known, rows = cells(spark)
    at = {p: (label, center) for p, label, center in known}
    audit = {r.concept: r for r in A.concept_audit(trusted, frames).collect()}
    ppv = {r.concept: r for r in A.concept_ppv(trusted, frames).collect()}
    for concept in ("blur", "glare", "size"):
        here = [(v, t, s, *at[p]) for p, c, v, t, s in rows if c == concept and v is not None and at[p][0] in (0, 1)]
        split = lambda on: ([v for v, _, _, label, c in here if label == 1 and on(c)], [v for v, _, _, label, c in here if label == 0 and on(c)])
        whole, one, two = split(lambda c: True), split(lambda c: c == "center_1"), split(lambda c: c == "center_2")
        leak = auroc([x[0] for x in here if x[4] == "center_2"], [x[0] for x in here if x[4] != "center_2"])
        a = audit[concept]
        assert [a.auc_all, a.auc_c1, a.auc_c2, a.auc_center] == [pytest.approx(x) if x is not None else None for x in (auroc(*whole), auroc(*one), auroc(*two), leak)]
        assert a.mean_trust == pytest.approx(np.mean([x[1] for x in here])) and a.pct_supervised == pytest.approx(100 * np.mean([x[2] for x in here]))
        assert a.mean_pos == pytest.approx(np.mean(whole[0])) and a.mean_neg == pytest.approx(np.mean(whole[1]))

        def threshold(pos):
            k = next((k for k in range(1, len(pos) + 1) if k / len(pos) >= 0.9), None)
            return sorted(pos, reverse=True)[k - 1] if k else None

        def precision(on, thr):
            if thr is None or not on[0]:
                return None
            hits, alarms = sum(v >= thr for v in on[0]), sum(v >= thr for v in on[1])
            return hits / (hits + alarms) if hits + alarms else None

        want = [precision(whole, threshold(whole[0])), precision(one, threshold(one[0])), precision(two, threshold(two[0])),
                precision(two, threshold(one[0])), precision(one, threshold(two[0]))]
        p = ppv[concept]
        assert [p.ppv_all, p.ppv_c1, p.ppv_c2, p.c1_to_c2, p.c2_to_c1] == [pytest.approx(x) if x is not None else None for x in want]


def test_audits_of_no_cells(spark):
    frames, trusted, _, _ = cells(spark)
    assert A.concept_audit(trusted.limit(0), frames).count() == 0 and A.concept_ppv(trusted, frames.limit(0)).count() == 0


def test_profile_equals_its_parts(spark, sf_dir):
    from votelens.plans.registry import Inputs
    i = Inputs(spark, sf_dir)
    p = M.frame_profile(i.frames, i.trusted)
    parts = i.curated.join(M.concept_score(i.trusted, surface=["blur"], decisive=["blur"]).select("path"), "path")
    assert p.select(*parts.columns).exceptAll(parts).count() == 0 and p.count() == parts.count()


@pytest.fixture()
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_group_is_shared_by_many_tasks(no_broadcast):
    spark = no_broadcast
    rows = spark.range(0, 20_000, 1, 32).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = attach_groups(rows, sizes, ["g"])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    per_task = [r["count"] for r in got.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()]
    assert max(per_task) < 0.35 * 20_000 and sum(per_task) == 20_000  # all of it would be 0.9
    assert got.columns == ["id", "g", "n"] and got.filter((F.col("g") == "hot") & (F.col("n") == 18_000)).count() == 18_000
    few = sizes.filter(F.col("g") != "hot").select("g")
    assert attach_groups(rows, few, ["g"]).count() == 2_000 and attach_groups(rows, sizes.limit(0), ["g"]).count() == 0
    left = attach_groups(rows, few.withColumn("seen", F.lit(True)), ["g"], "left")
    assert left.count() == 20_000 and left.filter("seen is null").count() == 18_000


def test_defloor_and_robust_z_with_one_hot_center(no_broadcast):
    rng = np.random.default_rng(1)
    rows = [(str(i), float(x), "hot" if i % 20 else "cold") for i, x in enumerate(rng.normal(size=2000).round(3))]
    d = no_broadcast.createDataFrame(rows, "name string, score double, center string").repartition(16)
    by = {c: np.array([x for _, x, g in rows if g == c]) for c in ("hot", "cold")}
    for r in C.defloor(d).collect():
        assert r.score == pytest.approx(rows[int(r.name)][1] - np.quantile(by[r.center], 0.1), abs=1e-12)
    for r in C.robust_z(d).collect():
        q1, q2, q3 = np.quantile(by[r.center], [0.25, 0.5, 0.75])
        assert r.z == pytest.approx((r.score - q2) / (q3 - q1), abs=1e-9)

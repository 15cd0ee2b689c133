"""Packed bootstrap counts against draws taken one by one, with small cells, chunks and buckets too."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.operators import curves as C
from votelens.operators import resample as R

SIZES = [{}, {"REP_BLOCK": 3, "CELL": 16, "CHUNK": 50, "BUCKET_ROWS": 20}, {"REP_BLOCK": 4, "CELL": 32, "DENSE": 8, "CHUNK": 64, "BUCKET_ROWS": 9, "BUCKETS": 5}]


def made(n=260, seed=3):
    rng = random.Random(seed)
    return [(f"n{i}", rng.choice([.5, round(rng.random(), 2), rng.random()]), int(rng.random() < .2), f"c{rng.choice([1, 1, 1, 2])}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, score double, label int, center string")


def places(names, salt):
    return sorted(names, key=lambda x: (hashlib.md5(f"{x}|{salt}".encode()).hexdigest(), x))


def brute_iid(rows, reps, seed):
    """Scores and labels of every replicate, one draw after the other."""
    by, order = {r[0]: r for r in rows}, places([r[0] for r in rows], f"iid{seed}")
    return [[by[order[i]][1:3] for i in R.draw_indexes((0, 0), rep, 0, len(rows), len(rows), seed).tolist()] for rep in range(reps)]


@pytest.mark.parametrize("sizes", SIZES)
def test_iid_metrics_equal_those_of_single_draws(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(R, k, v)
    rows, reps = made(), 7
    got = {r["rep"]: r for r in R.replicate_metrics(R.iid_counts(frame(spark, rows), reps, 11), reps).collect()}
    drawn = [(rep, float(s), y) for rep, d in enumerate(brute_iid(rows, reps, 11)) for s, y in d]
    want = {r["rep"]: r for r in C.score_metrics(spark.createDataFrame(drawn, "rep int, score double, label int"), ["rep"]).collect()}
    assert set(got) == set(want) == set(range(reps))
    for rep in got:
        for c in ("n_pos", "n_neg", "k", "thr", "fp", "ppv", "fpr_incl", "fpr_strict", "ppv_oracle", "auroc", "auprc"):
            assert got[rep][c] == pytest.approx(want[rep][c]), c


@pytest.mark.parametrize("sizes", SIZES)
def test_counts_add_up_to_the_draws(spark, monkeypatch, sizes):
    """Every replicate draws as many rows of each stratum as planned."""
    for k, v in sizes.items():
        monkeypatch.setattr(R, k, v)
    rows, reps = made(), 5
    counts = R.stratified_counts(frame(spark, rows), reps, 4, prevalence=.1).collect()
    total = np.zeros((2, reps), np.int64)
    for r in counts:
        slots = R._slots(r["rb"], reps)
        total[r["label"], r["rb"] * R.REP_BLOCK:][:slots] += R._unpacked(bytes(r["w"]), slots)
    pos = sum(r[2] for r in rows)
    assert (total[1] == pos).all() and (abs(total[0] - round(pos * 9)) <= 2).all()


def test_large_counts(spark):
    """A place that is hit more than 255 times in a replicate."""
    rows = [("p", .9, 1, "a"), ("q", .1, 0, "a")] + [(f"x{i}", .5, 1, "a") for i in range(9)]
    counts = R.stratified_counts(frame(spark, rows), 3, 1, prevalence=.01).filter("label = 0").collect()
    assert [R._unpacked(bytes(r["w"]), 3).tolist() for r in counts] == [[990] * 3]


def test_indexes_do_not_depend_on_the_chunk():
    whole = R.draw_indexes((12345, 678), 9, 0, 1000, 77, 5)
    parts = np.concatenate([R.draw_indexes((12345, 678), 9, a, 250, 77, 5) for a in range(0, 1000, 250)])
    assert (whole == parts).all() and whole.min() >= 0 and whole.max() < 77
    far = R.draw_indexes((1, 2), 0, 1 << 33, 1000, 1 << 40, 5)
    assert len(set(far.tolist())) > 990 and far.max() > 1 << 38


def test_groups_and_single_class(spark):
    """Groups are drawn by themselves; a group without positives has no metric."""
    d = frame(spark, made(120)).unionByName(frame(spark, [(f"z{i}", .1 * i, 0, "c9") for i in range(9)]))
    got = {r["center"]: r for r in R.auroc_ci(d, 20, 3, ["center"]).collect()}
    assert got["c9"]["reps"] == 0 and got["c9"]["auroc_mean"] is None
    one = R.auroc_ci(d.filter("center = 'c1'"), 20, 3).first()
    assert got["c1"]["auroc_mean"] == pytest.approx(one["auroc_mean"]) and got["c1"]["reps"] == 20


def test_no_draw_is_a_row(spark):
    """A replicate of 300 draws is counted within a task: no exploded draws, no join with the pool."""
    plan = R.auroc_ci(frame(spark, made(300)), 200, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 2 * plan.count("FlatMapCoGroupsInArrow") and "sequence(0, (size" not in plan


def test_empty(spark):
    d = frame(spark, [])
    assert R.auroc_ci(d, 10).first()["reps"] == 0 and R.bootstrap(d, 10).first()["reps"] == 0
    none = frame(spark, [("a", .1, 0, "c")])
    assert R.bootstrap_challenge(none, 10).first()["reps"] == 0 and R.bootstrap(none, 10, fixed_thr=.5).first()["curve_median"] is None


def test_paired_by_the_same_draws(spark):
    """A score against itself, on another axis: no difference in any replicate."""
    d = frame(spark, made()).withColumn("twin", F.col("score") * 2 + 1)
    for mode in ("curve", "auroc", "auprc"):
        r = R.paired_bootstrap(d, "score", "twin", 12, 5, mode).first()
        assert (r["reps"], r["lo"], r["hi"], r["p_gt0"]) == (12, 0.0, 0.0, 0.0)

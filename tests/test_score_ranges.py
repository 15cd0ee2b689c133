"""F2 (rank_fuse_sweep): quantiles and metrics of several score columns without a row for each score of each row."""

import random

import pytest
from pyspark.sql import functions as F

from votelens.functions import score_ranges as SR
from votelens.functions.ordering import exact_quantiles
from votelens.operators import curves as C


@pytest.fixture(scope="module")
def rows(spark):
    """Ties within and across labels, negative scores, a crowded range, nulls of each column, a group of one row, a score without positives."""
    rng, out = random.Random(3), []
    for i in range(900):
        label = rng.choice([0, 0, 0, 1, None, -1])
        out.append((label, rng.choice(["a", "b", None]), round(rng.uniform(-1, 1), 2), .5 + rng.random() / 1e5, rng.random() if rng.random() < .9 else None,
                    None if label == 1 else rng.random()))
    return spark.createDataFrame([*out, (1, "lone", .25, .5, None, None)], "label int, g string, x double, y double, z double, w double")


NAMES = ["x", "y", "z", "w"]  # columns of rows


@pytest.mark.parametrize("chunk", [50, SR.CHUNK])
def test_metrics_equal_those_of_the_whole_curve(rows, monkeypatch, chunk):
    monkeypatch.setattr(SR, "CHUNK", chunk)
    got = {r["at"]: (r["fpr_strict"], r["auroc"]) for r in SR.rank_metrics(rows, [F.col(c) for c in NAMES], lambda n: C.k_at_recall(n, .9)).collect()}
    for i, c in enumerate(NAMES):
        want = C.score_metrics(rows, [], .9, score=c).first()
        assert got[i] == (pytest.approx(want["fpr_strict"]), pytest.approx(want["auroc"]))


@pytest.mark.parametrize("q", [.1, 1.0])
def test_quantiles_equal_those_of_the_counts(rows, q):
    got = {r["g"]: r for r in SR.group_quantiles(rows, "g", [F.col(c) for c in NAMES], q, "_q").collect()}
    assert None not in got
    for i, c in enumerate(NAMES):
        want = {r["g"]: r["v"] for r in exact_quantiles(rows, ["g"], c, {"v": q}).collect() if r["g"]}
        assert {g: r[f"_q{i}"] for g, r in got.items() if r[f"_q{i}"] is not None} == pytest.approx(want)


def test_no_row_of_a_shuffle_for_each_weight(spark):
    """Before, each of 7 weights made a row of each name, and each was shuffled some ten times."""
    d = spark.range(2000).select(F.col("id").cast("string").alias("name"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.concat(F.lit("c"), F.col("id") % 2).alias("center"),
                                 (F.col("id") * 7919 % 2003).cast("double").alias("a"), (F.col("id") * 104729 % 2011).cast("double").alias("b"))
    plan = C.rank_fuse_sweep(d, "a", "b", [1.0, .5, 0.0], q=.1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(w" not in plan and "hashpartitioning(score" not in plan

"""Fitted heads on analytic cases, streaming over late votes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from votelens.operators import models as M
from votelens.operators import trust as TR
from votelens.operators import votes as VO
from votelens.streaming import monitor as MO


def test_logistic_penalty_mapping(spark):
    """The fitted head is a stationary point of C * sum(w * loss) + |w|^2 / 2 with balanced weights."""
    rng = np.random.default_rng(1)
    y = (rng.random(200) < .2).astype(float)
    x = rng.normal(size=(200, 3)) + y[:, None]
    d = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double").select(array_to_vector("x").alias("features"), "y")
    m = M.balanced_logistic(d, 0.3, max_iter=300)
    w, b = m.coefficients.toArray(), m.intercept
    cw = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    g = cw * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(0.3 * x.T @ g + w).max() < 1e-2 and abs(0.3 * g.sum()) < 1e-2


def test_ridge_mapping(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    t = x @ [1.0, -2.0] + .5 + rng.normal(size=80) * .1
    d = spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(x, t)], "x array<double>, t double").select(array_to_vector("x").alias("features"), "t")
    w, b = M.ridge(d, 10.0, "t")
    xc, tc = x - x.mean(0), t - t.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ tc)
    assert w == pytest.approx(want, abs=1e-6) and b == pytest.approx(t.mean() - x.mean(0) @ want, abs=1e-6)


def test_debias_hides_center(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        v = rng.normal(size=8)
        v[0] += 3 if i % 2 else -3
        rows.append((str(i), v.tolist(), i % 3 == 0, f"center_{i % 2 + 1}"))
    e = spark.createDataFrame(rows, "name string, feats array<double>, label boolean, center string").withColumn("label", F.col("label").cast("int"))
    plain = M.center_auroc(M.fit_pipe(e).transform(e), 3).first()["center_auroc"]
    clean = M.center_auroc(M.fit_pipe(e, debias_k=3).transform(e), 3).first()["center_auroc"]
    assert plain > .95 and clean < plain - .2


def test_whitened_features_are_uncorrelated(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 2)) @ rng.normal(size=(2, 8)) + rng.normal(size=(150, 8)) * .3
    e = spark.createDataFrame([(str(i), v.tolist(), 0, "center_1") for i, v in enumerate(base)], "name string, feats array<double>, label int, center string")
    z = np.array([r["x"] for r in M.fit_pipe(e, whiten_dim=3).transform(e).collect()])
    assert np.cov(z.T) == pytest.approx(np.eye(3), abs=1e-6)


def test_stream_uses_votes_that_arrive_late(spark, tmp_path):
    frames = spark.createDataFrame([("p", "p", "d", -1, "c", "u")], "path string, name string, dir string, label int, center string, split string")
    first = [("p", "e", 0, "nodularity", "yes")]
    late = [("p", "e", 1, "nodularity", "no"), ("p", "e", 2, "demarcation", "4")]
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "path string, expert string, lens int, concept string, raw string"
    for part in (first, late):
        spark.createDataFrame(part, schema).write.mode("append").json(src)
        MO.stream_curate(spark, src, frames, out, ck).awaitTermination()
    want = TR.curate_frames(frames, TR.cell_trust(VO.aggregate_votes(spark.createDataFrame(first + late, schema)))).first()
    got = MO.latest_curated(spark, out).first()
    assert (got["suspicion"], got["frame_trust"], got["decision"]) == (want["suspicion"], want["frame_trust"], want["decision"])

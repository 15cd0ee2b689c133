"""Batched Newton fits: single fits, stationarity, passes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from votelens.operators import models as M


def made(n=240, d=5, seed=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < .25).astype(float)
    return rng.normal(size=(n, d)) + .8 * y[:, None] * rng.normal(size=d), y


def frame(spark, x, y, **more):
    rows = [(v.tolist(), float(t), *(m[i] for m in more.values())) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "x array<double>, y double" + "".join(f", {c} long" for c in more)).repartition(5)


def gradient(x, y, w, b, c, balanced, use=None):
    use = np.ones(len(y), bool) if use is None else use
    x, y = x[use], y[use]
    cw = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else 1.0
    r = c * cw * (1 / (1 + np.exp(-(x @ w + b))) - y)
    return np.r_[x.T @ r + w, r.sum()]


def test_all_fits_are_stationary_and_share_their_passes(spark):
    x, y = made()
    fold = np.arange(len(y)) % 4
    d = frame(spark, x, y, use=[int(15 ^ (1 << f)) for f in fold])
    grid = [.01, .3, 30.0]
    fits = [M.Fit(c, f, b) for c in grid for f in range(4) for b in (True, False)]
    got = M.newton_logistic(d, fits)
    for f, w, b in zip(fits, got.coefficients, got.intercepts):
        assert np.abs(gradient(x, y, w, b, f.c, f.balanced, fold != f.group)).max() < 1e-6
    assert got.passes <= 12
    one = M.newton_logistic(d.filter("use != 11").drop("use"), [M.Fit(.3)])
    assert one.coefficients[0] == pytest.approx(got.coefficients[fits.index(M.Fit(.3, 2, True))], abs=1e-6)


def test_fits_take_turns(spark, monkeypatch):
    """Few Hessians at once, added up on the cluster: the same coefficients."""
    x, y = made()
    d, fits = frame(spark, x, y), [M.Fit(c) for c in (.1, 1.0, 3.0)]
    want = M.newton_logistic(d, fits)
    monkeypatch.setattr(M, "HESSIANS", 1)
    monkeypatch.setattr(M, "DRIVER_SUMS", 0)
    got = M.newton_logistic(d, fits)
    assert np.array(got.coefficients) == pytest.approx(np.array(want.coefficients), abs=1e-9)


def test_separable_rows_and_one_class(spark):
    x = np.r_[np.full((20, 1), -3.0), np.full((20, 1), 3.0)]
    y = np.r_[np.zeros(20), np.ones(20)]
    got = M.newton_logistic(frame(spark, x, y), [M.Fit(1e4)])
    assert np.abs(gradient(x, y, got.coefficients[0], got.intercepts[0], 1e4, True)).max() < 1e-3
    none = M.newton_logistic(frame(spark, x, np.zeros(40)), [M.Fit(1.0, balanced=False)], max_passes=8)
    assert abs(none.coefficients[0][0]) < 1e-3 and none.intercepts[0] < -3


def test_each_debias_direction_is_stationary(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        v = rng.normal(size=8)
        v[:3] += 2 if i % 2 else -1
        rows.append((str(i), v.tolist(), i % 3 == 0, f"center_{i % 2 + 1}"))
    e = spark.createDataFrame(rows, "name string, feats array<double>, label boolean, center string").withColumn("label", F.col("label").cast("int"))
    pipe, plain = M.fit_pipe(e, debias_k=4), M.fit_pipe(e)
    got = plain.transform(e).select("x", (F.col("center") == "center_1").cast("double").alias("y")).collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    for d in pipe.directions:
        fit = M.newton_logistic(frame(spark, x, y), [M.Fit(1.0, balanced=False)])
        w, b = fit.coefficients[0], fit.intercepts[0]
        assert np.abs(gradient(x, y, w, b, 1.0, False)).max() < 1e-6 and fit.passes <= 10
        assert abs(w @ d) / np.linalg.norm(w) == pytest.approx(1.0, abs=1e-6), "the direction is that of the projected rows' own fit"
        x = x - np.outer(x @ d, d)
    assert np.abs(np.array(pipe.directions) @ np.array(pipe.directions).T - np.eye(4)).max() < 1e-6


def test_out_of_fold_scores_of_several_c(spark):
    x, y = made(150)
    d = spark.createDataFrame([(f"n{i}", f"center_{i % 2}", int(t), v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))],
                              "name string, center string, label int, x array<double>, y double").withColumn("features", array_to_vector("x")).drop("x")
    many = {r["name"]: r for r in M.oof_many(d, [.1, 2.0], 3).collect()}
    one = {r["name"]: r for r in M.oof_scores(d, 2.0, 3).collect()}
    assert len(many) == len(one) == 150 and all(many[n]["scores"][1] == pytest.approx(one[n]["score"], abs=1e-7) and many[n]["fold"] == one[n]["fold"] for n in one)
    rows = {f"n{i}": (v, t) for i, (v, t) in enumerate(zip(x, y))}
    train = [rows[n] for n in one if one[n]["fold"] != 0]
    tx, ty = np.array([v for v, _ in train]), np.array([t for _, t in train])
    fit = M.newton_logistic(frame(spark, tx, ty), [M.Fit(2.0)])
    for n in one:
        if one[n]["fold"] == 0:
            assert one[n]["score"] == pytest.approx(1 / (1 + np.exp(-(rows[n][0] @ fit.coefficients[0] + fit.intercepts[0]))), abs=1e-7)

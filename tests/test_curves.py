"""Curve metrics, order statistics and resampling against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.functions.ordering import exact_quantiles, hash_index, ordered_index, prefix_sums
from votelens.operators import curves as C
from votelens.operators import losses as LO
from votelens.operators import resample as R
from votelens.operators import sampling as SA


def scored(spark, rows):
    return spark.createDataFrame([(str(i), float(s), int(y), c) for i, (s, y, c) in enumerate(rows)],
                                 "name string, score double, label int, center string")


def brute(rows, target=0.9):
    """Row-by-row curve with positives first among equal scores."""
    rows = sorted(rows, key=lambda r: (-r[0], -r[1]))
    P, N = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    tp = fp = 0
    hit = None
    for s, y in rows:
        tp, fp = tp + y, fp + 1 - y
        if hit is None and tp / P >= target:
            hit = (s, tp, fp)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (P * N)
    ap, prev = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        a, b = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap, prev = ap + (a - prev) / P * a / (a + b), a
    return {"thr": hit[0], "ppv": hit[1] / (hit[1] + hit[2]), "fpr_incl": sum(n >= hit[0] for n in neg) / N, "fpr_strict": hit[2] / N,
            "auroc": auc, "auprc": ap}


@pytest.mark.parametrize("levels", [3, 40, 100000])
def test_metrics_match_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randrange(levels) / levels, int(rng.random() < .2), rng.choice("ab")) for _ in range(700)]
    got = {r["center"]: r for r in C.group_report(scored(spark, rows)).collect()}
    for g, want in {"POOLED": brute([r[:2] for r in rows]), "a": brute([r[:2] for r in rows if r[2] == "a"])}.items():
        for k, v in want.items():
            assert got[g][k] == pytest.approx(v), (g, k)


def test_ties_and_empty(spark):
    r = C.score_metrics(scored(spark, [(.9, 1, "a"), (.5, 1, "a"), (.5, 1, "a"), (.5, 0, "a"), (.1, 0, "a")])).first()
    assert (r["k"], r["thr"], r["ppv"], r["fpr_incl"]) == (3, .5, 1.0, .5)
    r = C.score_metrics(scored(spark, [(.9, 0, "a"), (.5, 0, "a")])).first()
    assert r["ppv"] is None and r["auroc"] is None


def test_monotone_transform_keeps_metrics(spark):
    rng = random.Random(5)
    d = scored(spark, [(rng.random(), int(rng.random() < .1), "a") for _ in range(400)])
    a = C.score_metrics(d).first()
    b = C.score_metrics(d.withColumn("score", F.exp(3 * F.col("score")))).first()
    for k in ("ppv", "auroc", "auprc", "fpr_incl"):
        assert a[k] == pytest.approx(b[k])


def test_hot_score_and_hot_group(spark):
    """A third of all rows on one score and half on one group stay exact."""
    rng = random.Random(9)
    rows = [(.5 if i % 3 == 0 else rng.random(), int(rng.random() < .3), "hot" if i % 2 else f"c{i % 40}") for i in range(3000)]
    got = C.score_metrics(scored(spark, rows)).first()
    want = brute([r[:2] for r in rows])
    assert got["auroc"] == pytest.approx(want["auroc"]) and got["ppv"] == pytest.approx(want["ppv"])


def test_k_at_recall(spark):
    d = spark.range(1, 2000)
    bad = d.select("id", C.k_at_recall(F.col("id"), 0.9).alias("k")).collect()
    for r in bad:
        k = next(k for k in range(max(1, int(.9 * r["id"]) - 1), r["id"] + 1) if k / r["id"] >= 0.9)
        assert r["k"] == k


def test_prefix_sums_and_indexes(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(500)) for _ in range(2000)]
    d = spark.createDataFrame(rows, "g string, v int")
    p = prefix_sums(d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], "v", ["n"]).collect()
    for r in p:
        assert r["cum_n"] == sum(1 for g, v in rows if g == r["g"] and v >= r["v"]) and r["tot_n"] == sum(g == r["g"] for g, _ in rows)
    named = spark.createDataFrame([(g, v, str(i)) for i, (g, v) in enumerate(rows)], "g string, v int, name string")
    o = ordered_index(named, ["g"], ["v", "name"], "i", "n").collect()
    for g in "abc":
        mine = sorted((r for r in o if r["g"] == g), key=lambda r: r["i"])
        assert [(r["v"], r["name"]) for r in mine] == sorted((v, str(i)) for i, (x, v) in enumerate(rows) if x == g)
        assert [r["i"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
    h = hash_index(named, ["g"], "name", "s", "i").collect()
    assert all(sorted(r["i"] for r in h if r["g"] == g) == list(range(sum(r["g"] == g for r in h))) for g in "abc")


def test_ordered_index_plans_lazily_and_repeats(spark, monkeypatch):
    """Null groups and keys, a hot key and a sample smaller than the axis; no job before the action, equal rows however dealt."""
    from votelens.functions import ordering
    monkeypatch.setattr(ordering, "SAMPLE", 40)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", None]), rng.choice([None, 7.0, 7.0, round(rng.random(), 2)]), f"n{i:05d}") for i in range(3000)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "ordered_index")
    outs = [ordered_index(spark.createDataFrame(rows, "g string, v double, name string").repartition(p), ["g"], ["v", "name"], "i", "n") for p in (1, 7)]
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    got = [{r["name"]: (r["g"], r["i"], r["n"]) for r in o.collect()} for o in outs]
    assert got[0] == got[1] and len(got[0]) == 3000
    for g in ("a", None):
        mine = sorted(((v is not None, v or 0, name) for x, v, name in rows if x == g))
        assert [got[0][name] for _, _, name in mine] == [(g, i, len(mine)) for i in range(len(mine))]
    assert ordered_index(spark.createDataFrame([], "g string, v double"), [], ["v"]).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.975, 1.0])
def test_exact_quantiles(spark, q):
    rng = random.Random(3)
    v = [rng.choice([.25, rng.random()]) for _ in range(501)]
    got = exact_quantiles(spark.createDataFrame([(x,) for x in v], "v double"), [], "v", {"q": q}).first()["q"]
    assert got == pytest.approx(np.quantile(v, q))


def test_rank01_folds_defloor(spark):
    d = spark.createDataFrame([("a", 1.), ("b", 1.), ("c", 2.)], "name string, score double")
    assert {r["name"]: r["rank01"] for r in C.rank01(d).collect()} == {"a": 0, "b": .5, "c": 1}
    f = spark.createDataFrame([(f"p{i}", 0, "c") for i in range(7)], "path string, label int, center string")
    assert [r["fold"] for r in C.stratified_folds(f, 3).orderBy("path").collect()] == [0, 1, 2, 0, 1, 2, 0]
    rng = random.Random(2)
    s = scored(spark, [(rng.random(), int(rng.random() < .3), "one") for _ in range(200)])
    a, b = C.score_metrics(s).first(), C.score_metrics(C.defloor(s)).first()
    assert a["auroc"] == pytest.approx(b["auroc"]) and a["ppv"] == pytest.approx(b["ppv"])


def test_bootstrap_close_to_numpy_and_repeatable(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(600) < .1).astype(int)
    s = rng.normal(size=600) + 2 * y
    d = scored(spark, list(zip(s, y, ["a"] * 600)))
    one = R.bootstrap(d, 60, 7).first()
    assert one["curve_median"] == R.bootstrap(d.repartition(5), 60, 7).first()["curve_median"]
    pos, neg, vals = s[y == 1], s[y == 0], []
    for _ in range(300):
        p, n = rng.choice(pos, len(pos)), rng.choice(neg, 99 * len(pos))
        k = next(k for k in range(1, len(p) + 1) if k / len(p) >= .9)
        vals.append(k / (k + (n > np.sort(p)[::-1][k - 1]).sum()))
    assert abs(one["curve_median"] - np.median(vals)) < 3 * np.std(vals) / np.sqrt(60) + .02


@pytest.mark.parametrize("n_neg,want", [(588, 1.0), (2937, 27 / 29)])
def test_effective_recall(spark, n_neg, want):
    rng = random.Random(n_neg)
    rows = [(rng.random(), 0, "a") for _ in range(n_neg)] + [(rng.random(), 1, "a") for _ in range(30)]
    assert R.bootstrap_challenge(scored(spark, rows), 5, 1).first()["effective_recall"] == pytest.approx(want)


def test_rank_loss_brute_force(spark):
    rng = random.Random(4)
    rows = [(b, float(rng.gauss(0, 1)), int(i < 3)) for b in range(4) for i in range(12)]
    got = {r["batch"]: r["rank_loss"] for r in LO.rank_loss(spark.createDataFrame(rows, "batch int, logit double, label int"), k=2).collect()}
    for b in range(4):
        pos = [x for k, x, y in rows if k == b and y]
        neg = sorted((x for k, x, y in rows if k == b and not y), reverse=True)[:2]
        assert got[b] == pytest.approx(np.mean([np.log1p(np.exp(1 - (p - n))) for p in pos for n in neg]))


def test_batches_never_repeat_a_negative(spark):
    rows = [(str(i), int(i % 10 == 0)) for i in range(500)]
    b = SA.balanced_batches(spark.createDataFrame(rows, "name string, label int"), 4, 20).collect()
    neg = [r["name"] for r in b if r["label"] == 0]
    batches = -(-450 // 16)  # the last one holds what is left
    assert len(neg) == len(set(neg)) == 450 and len({r["batch"] for r in b}) == batches
    assert all(sum(r["batch"] == k and r["label"] == 1 for r in b) == 4 for k in range(batches))

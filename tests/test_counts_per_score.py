"""Paired bootstraps (F11, F13) and the fixed threshold (F12): a reader of one score, or of conditions only, gets no row for each pair of scores."""

import pytest

from votelens.operators import resample as R

REPS = 3


@pytest.fixture(scope="module")
def tied(spark):
    """One score shared by all rows beside one that differs in each; some of both are null."""
    rows = [(f"n{i}", .5, i / 1000, int(i % 20 == 0), f"c{i % 2}") for i in range(1000)] + [("x", None, .5, 0, "c0"), ("y", .5, None, 1, "c1")]
    return spark.createDataFrame(rows, "name string, score double, score_b double, label int, center string").coalesce(2)


def seen(monkeypatch, name):
    """What ``name`` of the module is given, by call."""
    frames, real = [], getattr(R, name)

    def spy(counts, *a, **kw):
        frames.append(counts)
        return real(counts, *a, **kw)
    monkeypatch.setattr(R, name, spy)
    return frames


def test_a_tied_score_is_one_row_a_cell_whatever_the_other_score(tied, monkeypatch):
    frames = seen(monkeypatch, "replicate_metrics")
    got = {r["rep"]: r["delta"] for r in R.paired_replicates(tied, "score", "score_b", REPS, 4, "auroc", prevalence=.1).collect()}
    assert [f.count() for f in frames][0] == 3  # positives, negatives of two centers; a row for each drawn pair before
    assert "score_b" not in frames[0].columns and "score" not in frames[1].columns
    both = R.stratified_counts(tied, REPS, 4, .1, ["score", "score_b"])
    a = {r["rep"]: r["auroc"] for r in R.replicate_metrics(both, REPS).collect()}
    b = {r["rep"]: r["auroc"] for r in R.replicate_metrics(both, REPS, score="score_b", bucket="bucket_score_b").collect()}
    assert got == {r: pytest.approx(a[r] - b[r]) for r in range(REPS)}


def test_fixed_thresholds_need_a_row_for_each_combination_only(tied, monkeypatch):
    frames = seen(monkeypatch, "replicate_ppv")
    got = {r["rep"]: r["delta"] for r in R.paired_replicates(tied, "score", "score_b", REPS, 4, "fixed", prevalence=.1, thr_a=.5, thr_b=.7).collect()}
    assert frames[0].count() <= 6  # two combinations in each of three strata
    both = R.stratified_counts(tied, REPS, 4, .1, ["score", "score_b"])
    want = R.replicate_ppv(both, REPS, {"a": both["score"] >= .5, "b": both["score_b"] >= .7}).collect()
    assert got == {r["rep"]: pytest.approx(r["a"] - r["b"]) for r in want}


def test_the_fixed_threshold_of_a_bootstrap(tied, monkeypatch):
    frames = seen(monkeypatch, "replicate_ppv")
    got = R.bootstrap(tied.drop("score").withColumnRenamed("score_b", "score"), REPS, 4, prevalence=.1, fixed_thr=.7).first()
    assert frames[0].count() <= 6
    both = R.stratified_counts(tied, REPS, 4, .1, ["score_b"])
    want = sorted(r["a"] for r in R.replicate_ppv(both, REPS, {"a": both["score_b"] >= .7}).collect())
    assert got["fixed_median"] == pytest.approx(want[1])

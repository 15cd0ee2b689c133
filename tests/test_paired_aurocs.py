"""F3 (gate): AUROC on shared draws without counts in a shuffle, against the curves of packed counts."""

import random

import pytest

from votelens.operators import resample as R


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(5), []
    for i in range(400):
        label = int(i % 9 == 0)
        out.append((f"n{i}", round(rng.random() + .2 * label, 2), None if i % 50 == 7 else rng.random(), label, f"c{i % 3}"))
    out += [("x", .5, .5, 0, None), ("y", .5, .5, None, "c0"), ("z", .5, .5, -1, "c1"), ("n1", .9, .1, 0, "c1"), ("n9", .1, .9, 1, "c0")]
    return spark.createDataFrame(out, "name string, score double, score_b double, label int, center string")


@pytest.mark.parametrize("windows", [None, (32, 16, 4, 16)])
def test_equal_to_the_curves(rows, monkeypatch, windows):
    """Ties, null scores, labels and centers, names that come twice; also with windows that cut strata, positives and replicates."""
    for name, v in zip(("NEGATIVES", "POSITIVES", "AUROC_REPS", "CELL"), windows or ()):
        monkeypatch.setattr(R, name, v)
    got = {r["rep"]: r["auroc0"] - r["auroc1"] for r in R.paired_aurocs(rows, ["score", "score_b"], 6, 3, .05).collect()}
    want = {r["rep"]: r["delta"] for r in R.paired_replicates(rows, "score", "score_b", 6, 3, "auroc", prevalence=.05).collect()}
    assert len(want) == 6 and got == pytest.approx(want)


def test_the_gate_shuffles_no_counts(rows, monkeypatch):
    monkeypatch.setattr(R, "_hits", lambda *a: pytest.fail("counts of draws are shuffled"))
    got = R.gate(R.paired_bootstrap(rows, "score", "score_b", 5, 3, "auroc")).first()
    assert got["reps"] == 5 and got["verdict"] in ("PASS", "FAIL", "INCONCLUSIVE")


def test_one_class(spark):
    d = spark.createDataFrame([(f"n{i}", i / 9, i / 7, 1, "c") for i in range(9)], "name string, score double, score_b double, label int, center string")
    assert [r for r in R.paired_aurocs(d, ["score", "score_b"], 3, 1).collect() if r["auroc0"] is not None] == []

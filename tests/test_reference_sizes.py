"""Registered queries do the reference's whole job: its replicates, folds, grid and directions."""

import inspect

import pytest

from votelens import vocabulary as V
from votelens.operators import models as M
from votelens.operators import resample as R
from votelens.plans import models_q

REPS = {"bootstrap": 1000, "bootstrap_challenge": 1000, "paired_bootstrap_curve": 1000, "paired_bootstrap_auroc": 1000, "paired_bootstrap_auprc": 1000,
        "paired_bootstrap_fixed": 1000, "gate": 2000, "mde": 2000, "auroc_ci": 2000, "boot_ppv": 1000, "report_full": 2000, "full_report": 1000, "confirm_gates": 2000}


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__ as e
    return e.queries(), e.oracle_sql()


@pytest.mark.parametrize("name", REPS)
def test_replicates(spark, sf_dir, entry, monkeypatch, name):
    class Seen(Exception):
        pass

    for f in ("bootstrap", "bootstrap_challenge", "paired_bootstrap", "mde", "auroc_ci", "boot_ppv", "report_full", "full_report"):
        def stop(*a, _sig=inspect.signature(getattr(R, f)), **k):
            raise Seen(_sig.bind(*a, **k).arguments["reps"])
        monkeypatch.setattr(R, f, stop)
    with pytest.raises(Seen) as got:
        entry[0][name](spark, sf_dir)
    assert got.value.args == (REPS[name],) and f"range({REPS[name]})" in entry[1][name]


def test_intervals_come_from_all_replicates(spark, sf_dir, entry):
    assert entry[0]["bootstrap_challenge"](spark, sf_dir).first()["reps"] == 1000


class Stop(Exception):
    pass


def _stop(f):
    def stop(*a, **k):
        b = inspect.signature(f).bind(*a, **k)
        b.apply_defaults()
        raise Stop(b.arguments)
    return stop


@pytest.mark.parametrize("name, at, want", [
    ("select_C", "select_c", {"grid": [0.01, 0.03, 0.1, 0.3, 1.0], "reps": 500, "k": 5}), ("center_debias", "fit_pipe", {"debias_k": 32}),
    ("center_debias", "center_auroc", {"k": 5}), ("feature_pipe", "fit_pipe", {"whiten_dim": 256, "debias_k": 32}), ("encoder_gate", "encoder_gate", {"reps": 1000})])
def test_fits(spark, sf_dir, entry, monkeypatch, name, at, want):
    fit = M.fit_pipe
    monkeypatch.setattr(M, "fit_pipe", lambda e, *a, **k: fit(e))
    monkeypatch.setattr(M, at, _stop(fit if at == "fit_pipe" else getattr(M, at)))
    with pytest.raises(Stop) as got:
        entry[0][name](spark, sf_dir)
    assert {k: got.value.args[0][k] for k in want} == want


def test_feature_pipe_returns_the_vector(spark, sf_dir, entry, monkeypatch):
    fit = M.fit_pipe
    monkeypatch.setattr(M, "fit_pipe", lambda e, *a, **k: fit(e))
    row = entry[0]["feature_pipe"](spark, sf_dir).first()
    assert len(row["x"]) == row["dims"] == 64


def test_residualize_reads_every_nuisance(spark, sf_dir, entry, monkeypatch):
    monkeypatch.setattr(models_q, "cut_lineage", lambda d: d)
    monkeypatch.setattr(M, "residualize", _stop(M.residualize))
    with pytest.raises(Stop) as got:
        entry[0]["residualize"](spark, sf_dir)
    assert got.value.args[0]["nuisance"] == V.NUISANCE and got.value.args[0]["held_out"] is not None


def test_every_concept_and_model(spark, sf_dir, entry):
    q = entry[0]
    assert len(q["cell_matrix"](spark, sf_dir).columns) == 3 + 3 * len(V.NAMES)
    assert q["generalization_gap"](spark, sf_dir).count() == 3 * len(V.NAMES)
    assert "flash35_vs_flash3" in q["feature_reeval"](spark, sf_dir).columns

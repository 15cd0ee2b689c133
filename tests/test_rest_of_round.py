"""Stores, fitted heads in a used session, batches, folds, streams and random streams."""

import json

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.functions.scalars import with_draw_index
from votelens.operators import curves as C
from votelens.operators import labels as L
from votelens.operators import models as M
from votelens.operators import sampling as SA
from votelens.operators import trust as TR
from votelens.operators import votes as VO
from votelens.session import scratch_path
from votelens.sources import readers as RD
from votelens.sources import writers as WR
from votelens.streaming import monitor as MO


def embeddings(spark, n=120):
    rows = [(f"f{i}", [float((i * 7 + j * 3) % 11) + (4.0 if i % 3 == 0 and j < 2 else 0.0) for j in range(8)], int(i % 3 == 0), f"center_{1 + i % 2}", f"s{i // 4}") for i in range(n)]
    return spark.createDataFrame(rows, "name string, feats array<double>, label int, center string, source string")


def test_heads_score_after_a_manifest(spark, sf_dir):
    """Scores are fetched, not counted, after the session has written a manifest."""
    import __spark_entry__ as e
    q = e.queries()
    assert q["write_run_manifest"](spark, sf_dir).count() == 1
    for name in ("balanced_logistic", "oof_scores", "loco_leg", "ship_ensemble"):
        rows = q[name](spark, sf_dir).collect()
        assert rows and all(0 <= r["score"] <= 1 for r in rows), name


def test_label_store_keeps_split(spark):
    cells = T.MapType(T.StringType(), T._parse_datatype_string("value double, trust double, supervise boolean"))
    schema = T.StructType([*T._parse_datatype_string("image string, name string, split string, label int, center string, decision string, frame_trust double, suspicion double, verified boolean").fields, T.StructField("concepts", cells)])
    path = scratch_path(spark, "store")
    WR.write_labels(spark.createDataFrame([("i", "a", "train", 1, "c", "ABSTAIN", 0.5, None, True, {"blur": (0.1, 0.2, True)}), ("i", "b", "val", 0, "c", "ABSTAIN", 0.5, None, True, {})], schema), path)
    assert sorted((r.name, r.split) for r in RD.read_labels(spark, path).select("name", "split").collect()) == [("a", "train"), ("b", "val")]


def test_vote_store_keeps_expert(spark):
    path = scratch_path(spark, "votes")
    schema = "path string, expert string, anchor_sig string, strategy string, votes array<map<string,string>>"
    new = spark.createDataFrame([("p", "e1", "x", "s", [{"blur": "yes"}]), ("q", "e2", "x", "s", [{"blur": "no"}])], schema)
    WR.append_votes(new, spark.createDataFrame([], schema), path)
    assert sorted((r.path, r.expert, r.raw) for r in RD.read_votes(spark, path).collect()) == [("p", "e1", "yes"), ("q", "e2", "no")]


def test_batches_keep_the_last_negatives(spark):
    rows = spark.createDataFrame([(f"n{i}", 0) for i in range(53)] + [(f"p{i}", 1) for i in range(9)], "name string, label int")
    kept = {r.name for r in SA.balanced_batches(rows, 4, 20).collect() if r.label == 0}
    full = {r.name for r in SA.balanced_batches(rows, 4, 20, drop_last=True).collect() if r.label == 0}
    assert len(kept) == 53 and len(full) == 48


def test_folds_hold_sources_together(spark):
    d = embeddings(spark).select("name", "source", F.col("label").alias("y"))
    folds = M.with_folds(d, 5, group="source").groupBy("source").agg(F.count_distinct("fold").alias("n"), F.max("fold").alias("f")).collect()
    assert len(folds) == 30 and all(r.n == 1 for r in folds) and len({r.f for r in folds}) == 5


def test_saved_ensemble_scores_alike(spark):
    e = embeddings(spark)
    pools = ["cls", "reg_mean", "patch_mean", "patch_max"]
    ens = M.ship_ensemble(e, [(M.V.POOLS, 1.0)], k=2)
    path = scratch_path(spark, "ensemble")
    ens.save(spark, path)
    one, two = ({r.name: r.score for r in x.score(e).collect()} for x in (ens, M.Ensemble.load(spark, path)))
    assert len(one) == 120 and all(abs(one[n] - two[n]) < 1e-12 for n in one) and pools


def test_logistic_fit_is_stationary(spark):
    """The gradient of the penalised loss vanishes at the fitted coefficients."""
    import numpy as np
    e = embeddings(spark)
    xy = e.select("name", "label", "center", array_to_vector("feats").alias("features"), F.col("label").cast("double").alias("y"))
    m = M.balanced_logistic(xy, 1.0)
    x, y = np.array([r.feats for r in e.collect()]), np.array([r.label for r in e.collect()])
    w, b = m.coefficients.toArray(), m.intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = x.T @ (weight * (p - y)) / weight.sum() + w / weight.sum()
    assert np.abs(slope).max() < 1e-4
    got = {r.name: r.score for r in M.positive_probability(m, xy).collect()}
    assert all(abs(got[r.name] - v) < 1e-9 for r, v in zip(e.collect(), p))


def test_strata_with_one_short_code_draw_apart(spark):
    """Strata whose digests agree in the bits that once were all that counted."""
    import hashlib
    seen, pair = {}, None
    for i in range(200_000):
        c = int(hashlib.md5(f"0|c{i}".encode()).hexdigest()[:7], 16) % 1000003 % 524288
        if c in seen:
            pair = (f"c{seen[c]}", f"c{i}")
            break
        seen[c] = i
    rows = [(s, r, d, 1 << 30) for s in pair for r in (0, 5000) for d in range(200)]
    d = spark.createDataFrame(rows, "stratum string, rep int, draw long, size long")
    got = with_draw_index(d, 1, F.col("rep"), "draw", "size", stratum=F.concat_ws("|", F.lit(0), "stratum")).collect()
    streams = {}
    for r in got:
        streams.setdefault((r.stratum, r.rep), set()).add(r.idx)
    assert len(streams) == 4 and len(set.union(*streams.values())) == 800


def test_spearman_matrix(spark):
    import itertools
    rows = [(f"n{i}", float(i % 7), float((i * 5) % 11), float(i % 3)) for i in range(100)]
    d = spark.createDataFrame(rows, "name string, x double, y double, z double")
    got = {(r.a, r.b): r.rho for r in C.spearman_matrix(d, ["x", "y", "z"]).collect()}
    for a, b in itertools.combinations("xyz", 2):
        assert got[a, b] == pytest.approx(C.spearman(d, a, b).first().rho, abs=1e-12)


def test_folder_with_an_invalid_label_fails(spark):
    names = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a")], "dir string, name string")
    bad = spark.createDataFrame([("d1", "b"), ("d1", "b")], "dir string, name string")
    got = {r.dir: (r.ok, r.invalid_labels) for r in L.missing_and_orphan(names, names, invalid=bad).collect()}
    assert got == {"d1": (False, 1), "d2": (True, 0)}


FRAME = "path string, name string, dir string, label int, center string, split string"


def test_stream_state_replaces_stored_votes(spark, tmp_path):
    """Fifty batches, each on every frame: no batch finds earlier votes on disk (their files are gone), a repeated vote
    counts once, and the last rows equal those of one batch run over all votes."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    frames = spark.createDataFrame([(f"p{i}", f"p{i}", "d", -1, "c", "train") for i in range(4)] + [("none", "none", "d", -1, "c", "train")], FRAME)
    concepts = [("nodularity", ["yes", "no", "not assessable"]), ("demarcation", ["0", "1", "3", "4", "x"]), ("unknown", ["1"])]
    votes = []
    for batch in range(50):
        rows = [(f"p{i}", f"e{batch}", batch % 3, c, raw[(batch + i) % len(raw)]) for i in range(4) for c, raw in concepts]
        if batch > 0:
            rows.append(votes[0])  # arrives again in every batch
        (src / f"{batch:03d}.json").write_text("".join(json.dumps(dict(zip(("path", "expert", "lens", "concept", "raw"), r))) + "\n" for r in rows))
        votes += rows if batch == 0 else rows[:-1]
        if batch in (0, 1, 49):
            MO.stream_curate(spark, str(src), frames, out, state, files_per_trigger=8).awaitTermination()
            for old in src.glob("*.json"):
                old.write_text("")  # nothing is left to be read again
    assert not (tmp_path / "out" / "votes").exists()
    want = TR.curate_frames(frames, TR.cell_trust(VO.aggregate_votes(spark.createDataFrame(votes, MO.VOTE_ROWS))))
    got = MO.latest_curated(spark, out).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4


def test_stream_of_odd_votes(spark, tmp_path):
    """Votes without a path are left out, missing experts and lenses are values of their own, an empty stream writes none."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.json").write_text("")
    frames = spark.createDataFrame([("p", "p", "d", 1, "c", "train")], FRAME)
    MO.stream_curate(spark, str(src), frames, out, state).awaitTermination()
    rows = [{"path": None, "expert": "e", "lens": 0, "concept": "nodularity", "raw": "yes"}, {"path": "p", "concept": "nodularity", "raw": "yes"},
            {"path": "p", "expert": "e", "concept": "nodularity"}, {"path": "p", "concept": "nodularity", "raw": "no"}]
    (src / "b.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    MO.stream_curate(spark, str(src), frames, out, state).awaitTermination()
    kept = spark.createDataFrame([("p", None, None, "nodularity", "yes"), ("p", "e", None, "nodularity", None)], MO.VOTE_ROWS)
    want = TR.curate_frames(frames, TR.cell_trust(VO.aggregate_votes(kept)))
    assert [tuple(r) for r in MO.latest_curated(spark, out).select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("positives, wide", [(37, 4), (8, 4), (4, 4), (3, 4), (1, 4), (0, 4)])
def test_no_positive_repeats_in_a_batch(spark, positives, wide):
    """And with fewer positives than slots a batch holds them all once and more negatives."""
    from votelens.operators import sampling as SA
    rows = spark.createDataFrame([(f"p{i}", 1) for i in range(positives)] + [(f"n{i}", 0) for i in range(400)], "name string, label int")
    plan = SA.balanced_batches(rows, wide, 20).collect()
    held = {}
    for r in plan:
        held.setdefault(r.batch, []).append(r)
    p = min(wide, max(1, positives))
    for batch, mine in held.items():
        names = [r.name for r in mine if r.label > 0]
        assert len(names) == len(set(names)) == min(p, positives) and len({r.slot for r in mine}) == len(mine)
        assert sum(r.label == 0 for r in mine) <= 20 - p
    negatives = [r.name for r in plan if r.label == 0]
    assert len(negatives) == len(set(negatives)) == 400 and len(held) == -(-400 // (20 - p))
    if positives == 37:
        assert len({r.name for r in plan if r.label > 0}) > 30

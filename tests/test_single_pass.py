"""Operators with several consumers of the cells compute them once; what a stream keeps of a frame."""

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.operators import sampling as SA
from votelens.operators import sweeps as SW
from votelens.operators import trust as TR
from votelens.plans import curves_q, resample_q
from votelens.streaming import monitor as MO

CONCEPTS = sorted({*V.ROBUST_CORE, *V.QUALITY_CHECK, *V.DISCRIMINATIVE})
FRAMES = "path string, name string, dir string, label int, center string, split string"


def counted(spark, df):
    """``df`` and an accumulator of the rows that tasks have computed of it."""
    acc = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b
    return df.coalesce(1).mapInArrow(run, df.schema), acc


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(f"p{i}", f"{i}", "d", i % 3 - 1, f"center_{i % 2 + 1}", "val" if i % 4 == 0 else "train") for i in range(36)], FRAMES)


def cells(spark, salt=0):
    rows = [(f"p{i}", c, ((i * 7 + j * 3 + salt) % 5) / 4.0, 1.0 - (i + j) % 3 / 4.0, (i + j + salt) % 4 / 3.0, 4) for i in range(36) for j, c in enumerate(CONCEPTS)]
    return spark.createDataFrame(rows, "path string, concept string, c double, r double, m double, n_votes long")


def test_anchors_read_cells_once(spark, frames):
    plain = cells(spark)
    once, acc = counted(spark, plain)
    got = SA.select_anchors(once, frames).collect()
    assert acc.value == 36 * len(CONCEPTS)
    s = {r.path: r for r in SA.sureness(plain, frames).collect()}
    top = sorted((r for r in s.values() if r.label == 1), key=lambda r: (-r.sureness, r.path))[:2]
    assert [r.path for r in got if r.kind == "neo"] == [r.path for r in top] and len(got) == 5


def test_ab_compare_reads_each_strategy_once(spark, frames):
    (a, na), (b, nb) = counted(spark, cells(spark)), counted(spark, cells(spark, 1))
    got = {r.concept: r for r in SW.ab_compare(a, b, frames).collect()}
    assert na.value == nb.value == 36 * len(CONCEPTS) and len(got) == len(CONCEPTS)
    label = {r.path: r.label for r in frames.collect()}
    for arm, df in (("a", cells(spark)), ("b", cells(spark, 1))):
        rows = [r for r in df.collect() if r.concept == CONCEPTS[0] and label[r.path] >= 0]
        for name, kept in (("auroc", rows), ("auroc_ass", [r for r in rows if r.m > 0])):
            pos, neg = ([r.c for r in kept if label[r.path] == v] for v in (1, 0))
            u = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
            assert got[CONCEPTS[0]][f"{name}_{arm}"] == pytest.approx(max(u, 1 - u))
        assert got[CONCEPTS[0]][f"assess_{arm}"] == pytest.approx(sum(r.m for r in rows) / len(rows))
        assert got[CONCEPTS[0]][f"rel_{arm}"] == pytest.approx(sum(r.r for r in rows) / len(rows))


def test_records_read_cells_once(spark, frames):
    plain = TR.cell_trust(cells(spark))
    once, acc = counted(spark, plain)
    key = lambda r: (r.path, r.decision, r.frame_trust, r.suspicion, tuple(sorted((k, tuple(v)) for k, v in r.concepts.items())))
    got = sorted(map(key, TR.curated_records(frames, once).collect()))
    assert acc.value == plain.count()
    assert got == sorted(map(key, TR.label_records(TR.curate_frames(frames, plain), plain).collect()))


def test_threshold_share_reads_curated_once(spark, frames):
    curated, acc = counted(spark, TR.curate_frames(frames, TR.cell_trust(cells(spark))))
    got = curves_q.above_threshold_share(SimpleNamespace(curated=curated)).collect()
    assert acc.value == 36 and sum(r.n for r in got) == 12


def test_confirm_inputs_compute_cells_once(spark, frames):
    lc, acc = counted(spark, cells(spark).join(frames.filter("label >= 0").select("path", "label", "center", "split"), "path"))
    train, val = resample_q.confirm_inputs(SimpleNamespace(lcells=lc))
    n = train.count() + val.count() + train.filter("label = 1").count() * 0
    assert n == 24 * len(V.DISCRIMINATIVE) and acc.value == 24 * len(CONCEPTS)


def test_stream_keeps_bits_of_voters():
    class State:
        exists, kept = False, None

        def update(self, kept):
            self.exists, self.kept = True, kept

        @property
        def get(self):
            return self.kept

    def batch(*votes):
        return [pd.DataFrame([(v, 1 << b, f"c{b}", x, 1) for v, b, x in votes], columns=["voter", "bit", "concept", "value", "mask"])]

    state = State()
    list(MO.add_votes(("p",), batch(*[(f"v{i % 4}", i // 4, 0.25) for i in range(140)], ("v0", 0, 1.0)), state))
    assert len(state.kept[0]) == len(state.kept[1]) == 4 and all(x == (1 << 35) - 1 for x in state.kept[1])
    out, = MO.add_votes(("p",), batch(("v0", 34, 1.0), ("v9", 34, 0.5)), state)
    last = out[out["concept"] == "c34"].iloc[0]
    assert (last["n"], last["k"], last["s"]) == (5, 5, 1.5) and len(out) == 35

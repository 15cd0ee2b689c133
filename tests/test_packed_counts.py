"""Counts of draws that travel with two bits each, counted in windows of the places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.operators import resample as R


@pytest.mark.parametrize("slots", [1, 4, 7, 128])
@pytest.mark.parametrize("top", [2, 9, 700])
def test_pack_and_back(slots, top):
    rng = np.random.default_rng(slots * top)
    counts = rng.integers(0, top, (30, slots)) * rng.integers(0, 2, (30, slots))
    held, offsets = R._pack(counts)
    assert (R._unpack(held, offsets, 30, slots) == counts).all()
    assert [R._unpacked(bytes(x), slots).tolist() for x in R._packed_rows(counts).to_pylist()] == counts.tolist()
    for payload in (p for _, p in R._hit_cells(counts)):
        assert (R._dense(payload, 30, slots) == counts).all()


def plan(spark, draws, size):
    return spark.createDataFrame([("s", "0" * 16, size, draws)], "skey string, digest string, size long, draws long")


def test_hits_take_less_than_half_a_byte_a_draw(spark):
    """Each place of a draw took two bytes before, which filled the disk at a gigabyte of rows."""
    size, reps = 80_000, 6
    h = R._hits(plan(spark, size, size), reps, 1).agg(F.sum(F.length("hits")), F.max(F.length("hits"))).first()
    assert h[0] < size * reps / 2 and h[1] < R.CELL * reps / 2


def test_a_row_of_work_holds_a_bounded_number_of_counters(spark, monkeypatch):
    """Windows and few replicates at a time give the counts of single draws."""
    for k, v in {"CELL": 16, "WINDOW": 64, "DENSE": 40, "CHUNK": 50, "REP_BLOCK": 4}.items():
        monkeypatch.setattr(R, k, v)
    size, reps = 150, 6
    got = np.zeros((reps, size), np.int64)
    for r in R._hits(plan(spark, 333, size), reps, 5).collect():
        assert r["n"] * min(size, 64) <= 64
        got[r["rep"]:r["rep"] + r["n"], r["cell"] * 16:r["cell"] * 16 + r["width"]] += R._dense(bytes(r["hits"]), r["n"], r["width"])
    want = [np.bincount(R.draw_indexes((0, 0), rep, 0, 333, size, 5), minlength=size) for rep in range(reps)]
    assert (got == np.stack(want)).all()

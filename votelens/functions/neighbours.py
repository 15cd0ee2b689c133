"""Neighbours on an axis, without a window over a group: the axis is cut into ranges of rows, and ranges lend each other border rows.

Every step reads kept rows once. A task holds one range of one group, and of the group's other ranges only their ends, their counts
and the border rows of each label."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# functions that run in Python workers travel with their code and constants, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIST, LISTS = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
SPAN = pa.schema([("concept", pa.string()), ("part", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("low", LIST), ("high", LIST)])
LOOK = pa.schema([("concept", pa.string()), ("part", pa.int64()), *[(c, LIST) for c in ("parts", "firsts", "lasts", "before", "skips", "labels", "sizes")],
                  ("left", LISTS), ("right", LISTS)])
CELL = pa.schema([("concept", pa.string()), ("cells", pa.int64()), ("term", pa.float64()), *[(c, pa.int64()) for c in ("part", "at", "sign", "home", "row", "known")]])

RANK = pa.schema([("concept", pa.string()), ("term", pa.float64()), *[(c, pa.int64()) for c in ("home", "row", "known", "rank")]])


def _sql(shape: pa.Schema) -> str:
    name = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", LIST: "array<long>", LISTS: "array<array<long>>"}
    return ", ".join(f"{f.name} {name[f.type]}" for f in shape)


def digamma(x):
    """Of whole numbers >= 1, a column or an array: six steps of the recurrence, then the asymptotic series (error below 1e-10)."""
    x, log = (x.cast("double"), F.log) if isinstance(x, Column) else (np.asarray(x, np.float64), np.log)
    y = x + 6.0
    z = 1.0 / (y * y)
    series = log(y) - 0.5 / y - z * (1 / 12.0 - z * (1 / 120.0 - z * (1 / 252.0 - z / 240.0)))
    for i in range(6):
        series = series - 1.0 / (x + float(i))
    return series


def _spans(k: int):
    """Of each (range, concept, label) its rows, and the k first and last positions."""
    def run(batches):
        held: dict[tuple, tuple] = {}
        none = np.zeros(0, np.int64)
        for batch in batches:
            names = batch.column("concept").dictionary_encode()
            keys = np.stack([batch.column("part").to_numpy(), names.indices.to_numpy().astype(np.int64), batch.column("label").to_numpy()])
            pos, order = batch.column("pos").to_numpy(), np.lexsort(keys)
            cuts = np.flatnonzero((np.diff(keys[:, order], axis=1) != 0).any(axis=0)) + 1
            for mine in np.split(order, cuts) if len(order) else ():
                part, name, label = keys[:, mine[0]].tolist()
                key, x = (names.dictionary[name].as_py(), part, label), np.sort(pos[mine])
                n, low, high = held.get(key, (0, none, none))
                held[key] = n + len(x), np.sort(np.r_[low, x[:k]])[:k], np.sort(np.r_[high, x[-k:]])[-k:]
        rows = [(*key, n, low.tolist(), high.tolist()) for key, (n, low, high) in held.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(SPAN.names, r)) for r in rows], SPAN)
    return run


def _looks(k: int):
    """Of each range of a concept what it must know of the others; a row for each range."""
    def run(spans: pa.Table) -> pa.Table:
        rows = sorted(spans.to_pylist(), key=lambda r: (r["part"], r["label"]))
        parts, labels = sorted({r["part"] for r in rows}), sorted({r["label"] for r in rows})
        at = {(r["part"], r["label"]): r for r in rows}
        of = [[at[p, v] for v in labels if (p, v) in at] for p in parts]
        sizes = [sum(r["n"] for r in rows if r["label"] == v) for v in labels]
        shared = {"concept": rows[0]["concept"], "parts": parts, "firsts": [min(r["low"][0] for r in x) for x in of], "lasts": [max(r["high"][-1] for r in x) for x in of],
                  "before": [0, *np.cumsum([sum(r["n"] for r in x) for x in of]).tolist()], "labels": labels, "sizes": sizes,
                  "skips": sorted(r["low"][0] for r in rows if sizes[labels.index(r["label"])] == 1)}
        left, right = ({v: [] for v in labels} for _ in "ab")
        lefts, rights = [], []
        for p in parts:
            lefts.append([left[v] for v in labels])
            left = {v: (left[v] + (at[p, v]["high"] if (p, v) in at else []))[-k:] for v in labels}
        for p in reversed(parts):
            rights.append([right[v] for v in labels])
            right = {v: ((at[p, v]["low"] if (p, v) in at else []) + right[v])[:k] for v in labels}
        return pa.Table.from_pylist([shared | {"part": p, "left": a, "right": b} for p, a, b in zip(parts, lefts, reversed(rights))], LOOK)
    return run


def _radius(axis: np.ndarray, first: int, stop: int, k: int) -> np.ndarray:
    """Distance of the places first..stop-1 of a sorted axis to their k-th nearest neighbours."""
    here, x = np.arange(first, stop), axis[first:stop]
    out = np.full(len(x), np.iinfo(np.int64).max)
    for j in range(k + 1):
        a, b = here - j, here + k - j
        far = np.maximum(x - axis[np.maximum(a, 0)], axis[np.minimum(b, len(axis) - 1)] - x)
        out = np.where((a >= 0) & (b < len(axis)), np.minimum(out, far), out)
    return out


def _cells(k: int, block: int):
    """One row for the cells of a range whose counts need no other range, and one for each end of an interval that another range must rank."""
    def run(rows: pa.Table, look: pa.Table) -> pa.Table:
        if not len(rows) or not len(look):
            return CELL.empty_table()
        look = look.to_pylist()[0]
        firsts, lasts, before, skips = (np.array(look[c], np.int64) for c in ("firsts", "lasts", "before", "skips"))
        home = look["parts"].index(look["part"])
        pos, label = rows.column("pos").to_numpy(), rows.column("label").to_numpy()
        order = np.argsort(pos, kind="stable")
        pos, label = pos[order], label[order]
        cells, total, row, out = 0, 0.0, 0, []
        for v, n, left, right in zip(look["labels"], look["sizes"], look["left"], look["right"]):
            mine = pos[label == v]
            if n < 2 or not len(mine):
                continue
            axis, near = np.concatenate([np.array(left, np.int64), mine, np.array(right, np.int64)]), min(k, n - 1)
            for start in range(0, len(mine), block):
                stop = min(start + block, len(mine))
                x, r = mine[start:stop], np.maximum(_radius(axis, len(left) + start, len(left) + stop, near), 1) - 1
                known, away = np.zeros(len(x), np.int64), []
                for sign, end in ((1, x + r), (-1, x - r - 1)):
                    t = np.searchsorted(firsts, end, "right") - 1
                    inside = (t >= 0) & (end < lasts[np.maximum(t, 0)])
                    rank = np.where(inside, before[np.maximum(t, 0)], before[t + 1])
                    rank += np.where(inside & (t == home), np.searchsorted(pos, end, "right"), 0)
                    known += sign * (rank - np.searchsorted(skips, end, "right"))
                    away.append((sign, end, t, inside & (t != home)))
                term, open_ = float(digamma([near])[0] - digamma([n])[0]), away[0][3] | away[1][3]
                done = known[~open_]
                cells, total = cells + len(done), total + float((term - digamma(done)).sum())
                for sign, end, t, far in away:
                    i = np.flatnonzero(far)
                    same = lambda value, i=i: pa.array(np.full(len(i), value))
                    out.append(pa.table([pa.array([look["concept"]] * len(i), pa.string()), same(1), same(term), pa.array(np.array(look["parts"], np.int64)[t[i]]), pa.array(end[i]),
                                         same(sign), same(look["part"]), pa.array(row + i), pa.array(known[i])], schema=CELL))
                row += len(x)
        out.append(pa.Table.from_pylist([{"concept": look["concept"], "cells": cells, "term": total}], CELL))
        return pa.concat_tables(out)
    return run


def _ranks(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """The ends with their signed ranks among the rows of the range they lie in."""
    if not len(ends):
        return RANK.empty_table()
    rank = np.searchsorted(np.sort(rows.column("pos").to_numpy()), ends.column("at").to_numpy(), "right") * ends.column("sign").to_numpy()
    return ends.select(RANK.names[:-1]).append_column("rank", pa.array(rank, pa.int64()))


def nearest_terms(points: DataFrame, k: int, block: int) -> DataFrame:
    """concept, cells, term: the cells whose label has another cell, and the sum of psi(neighbours) - psi(cells of the label) - psi(m) over
    them, see ``audit.nearest_mutual_information``. ``points``: concept, label, pos.

    The points are kept on the executors' disks, because their ranges are cut by a sample of them, and once more in these ranges. A
    range keeps its number when it is computed again. Only ends of intervals that leave their cell's range are ranked in a second step."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = points.select("concept", F.col("label").cast("long").alias("label"), "pos").persist(StorageLevel.DISK_ONLY)
    p = p.repartitionByRange(n, "concept", "pos").withColumn("part", F.spark_partition_id().cast("long")).persist(StorageLevel.DISK_ONLY)
    look = p.mapInArrow(_spans(k), _sql(SPAN)).groupBy("concept").applyInArrow(_looks(k), _sql(LOOK))
    keys = ["concept", "part"]
    cells = p.groupBy(*keys).cogroup(look.groupBy(*keys)).applyInArrow(_cells(k, block), _sql(CELL)).persist(StorageLevel.DISK_ONLY)
    away = p.groupBy(*keys).cogroup(cells.filter(F.col("part").isNotNull()).groupBy(*keys)).applyInArrow(
        _ranks, _sql(RANK))
    met = away.groupBy("concept", "home", "row").agg(F.max("term").alias("term"), (F.max("known") + F.sum("rank")).alias("m"))
    met = met.select("concept", F.lit(1).cast("long").alias("cells"), (F.col("term") - digamma(F.col("m"))).alias("term"))
    out = cells.filter(F.col("part").isNull()).select("concept", "cells", "term").unionByName(met)
    return out.groupBy("concept").agg(F.sum("cells").alias("cells"), F.sum("term").alias("term")).filter(F.col("cells") > 0)

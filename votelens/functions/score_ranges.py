"""Quantiles and operating points of several score columns of one table, without a row for each score of each row.

A score's range is its floor in steps of 1 / RANGES. Counts by range say in which range an order statistic lies, and only rows of
that range are looked at again. Pairs of a positive and a negative are counted within a range from packed scores: a task sorts a chunk
of rows for each column and hands on one row for each range of it. Meant for scores of bounded density, such as weighted ranks; where
many unequal scores crowd in one range, its task holds eight bytes for each of them."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.functions.ordering import attach, attach_groups

# functions that run in Python workers travel with their code and constants, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGES = 1 << 10
#: Rows that a task sorts at once.
CHUNK = 1 << 18
PACKED = pa.schema([("at", pa.int64()), ("range", pa.int64()), *[(c, pa.binary()) for c in ("pos", "pos_times", "neg", "neg_times")]])
COUNTED = pa.schema([("at", pa.int64()), ("range", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("u", pa.float64())])


def _range(score: Column) -> Column:
    return F.floor(score * float(RANGES)).cast("long")


def _long(rows: DataFrame, scores: list[Column], *keep: str) -> DataFrame:
    """keep, at (the number of the score), score, range; null scores take no part."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("at"), s.cast("double").alias("score")) for i, s in enumerate(scores)])
    long = rows.select(*keep, F.explode(each).alias("_e")).select(*keep, "_e.*")
    return long.filter(F.col("score").isNotNull()).withColumn("range", _range(F.col("score")))


def group_quantiles(rows: DataFrame, group: str, scores: list[Column], q: float, prefix: str) -> DataFrame:
    """group and for each score ``prefix``i: its exact interpolated q-quantile, as ``ordering.exact_quantiles`` has it. A null group has none."""
    keys = [group, "at"]
    long = _long(rows.filter(F.col(group).isNotNull()), scores, group)
    counts = long.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    counts = counts.withColumn("_to", F.sum("_n").over(run)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    h = F.lit(float(q)) * (F.col("_all") - 1)
    first, last = F.col("_to") > F.floor(h), F.col("_to") > F.ceil(h)
    met = counts.groupBy(*keys).agg(F.max("_all").alias("_all"), F.min(F.when(first, F.col("range"))).alias("_lo"), F.min(F.when(last, F.col("range"))).alias("_hi"),
                                    F.min(F.when(first, F.col("_to") - F.col("_n"))).alias("_below"))
    # no row lies between the two ranges, so what is below the first one is below both; read twice, a row for each group and score
    met = met.persist()
    n = len(scores)
    pick = lambda i, c: F.max(F.when(F.col("at") == i, F.col(c)))
    wanted = met.groupBy(group).agg(*[pick(i, c).alias(f"{c}{i}") for i in range(n) for c in ("_lo", "_hi")])
    near = [F.when(_range(s).isin(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.struct(F.lit(i).cast("long").alias("at"), s.cast("double").alias("score"))) for i, s in enumerate(scores)]
    found = attach_groups(rows, wanted, [group]).select(group, F.explode(F.filter(F.array(*near), lambda e: e.isNotNull())).alias("_e"))
    found = found.select(group, "_e.*").groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n"))
    found = attach(found, met.select(*keys, "_all", "_below"), keys)
    c = found.withColumn("_to", F.col("_below") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)))
    v = c.groupBy(*keys).agg(F.max("_all").alias("_all"), F.min(F.when(first, F.col("score"))).alias("_lo"), F.min(F.when(last, F.col("score"))).alias("_hi"))
    v = v.withColumn("_v", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (h - F.floor(h)))
    return v.groupBy(group).agg(*[pick(i, "_v").alias(f"{prefix}{i}") for i in range(n)]).persist()  # callers attach it to more than one pass


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers byte by byte: their leading bytes repeat, so a shuffle compresses them."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.uint8).reshape(8, -1).T.copy().view(np.float64).ravel()


def _packed(names: list[str]):
    def pack(label: np.ndarray, columns: list[np.ndarray]):
        for at, score in enumerate(columns):
            held = {}
            for name, v in (("pos", 1), ("neg", 0)):
                x = np.sort(score[(label == v) & ~np.isnan(score)]) + 0.0  # no negative zero
                if len(x):
                    cell = np.floor(x * float(RANGES)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(cell)) + 1
                    for part, r in zip(np.split(x, cuts), cell[np.r_[0, cuts]].tolist()):
                        values, times = np.unique(part, return_counts=True)
                        few = 2 * len(values) < len(part)
                        held.setdefault(r, {})[name] = (_planes(values if few else part), times.astype(np.int64).tobytes() if few else b"")
            rows = [{"at": at, "range": r, **{c + end: x for c, pair in d.items() for end, x in zip(("", "_times"), pair)}} for r, d in held.items()]
            yield pa.RecordBatch.from_pylist(rows, PACKED)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK:
                yield from chunk(held)
                held, size = [], 0
        if size:
            yield from chunk(held)

    def chunk(held):
        t = pa.Table.from_batches(held)
        yield from pack(t.column("label").to_numpy(), [t.column(c).to_numpy() for c in names])
    return run


def _counted(rows: pa.Table) -> pa.Table:
    """Positives, negatives, and pairs of both in which the positive is higher (half where equal), of one range."""
    axes = []
    for c in ("pos", "neg"):
        parts = [(x, t) for x, t in zip(rows.column(c).to_pylist(), rows.column(c + "_times").to_pylist()) if x]
        x = np.concatenate([np.zeros(0), *[_from_planes(x) for x, _ in parts]])
        times = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(t, np.int64) if t else np.ones(len(x) // 8, np.int64) for x, t in parts]])
        order = np.argsort(x, kind="stable")
        axes.append((x[order], times[order]))
    (pos, p), (neg, n) = axes
    below = np.r_[0, np.cumsum(n)]
    u = (p * (below[np.searchsorted(neg, pos, "left")] + below[np.searchsorted(neg, pos, "right")]) / 2.0).sum()
    return pa.Table.from_pylist([{"at": rows.column("at")[0].as_py(), "range": rows.column("range")[0].as_py(), "p": int(p.sum()), "n": int(n.sum()), "u": float(u)}], COUNTED)


def rank_metrics(rows: DataFrame, scores: list[Column], k_of: Callable[[Column], Column], label: str = "label") -> DataFrame:
    """at (the number of the score), fpr_strict and auroc, as ``curves.curve_metrics`` has them; ``k_of`` makes k at recall of the positives."""
    d = rows.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("long").alias("label"), *[s.cast("double").alias(f"_s{i}") for i, s in enumerate(scores)])
    names = [f"_s{i}" for i in range(len(scores))]
    packed = d.mapInArrow(_packed(names), "at long, range long, pos binary, pos_times binary, neg binary, neg_times binary")
    # a row for each range of a score, kept for totals and threshold: nothing is packed twice
    c = packed.groupBy("at", "range").applyInArrow(_counted, "at long, range long, p long, n long, u double").persist()
    above, whole = Window.partitionBy("at").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("at")  # a row for each range
    c = c.select("*", *[F.sum(x).over(w).alias(n) for x, w, n in (("p", above, "_cp"), ("n", above, "_cn"), ("p", whole, "_P"), ("n", whole, "_N"))])
    k = k_of(F.col("_P"))
    here = (F.col("_cp") >= k) & (F.col("_cp") - F.col("p") < k)
    t = c.groupBy("at").agg(F.max("_P").alias("_P"), F.max("_N").alias("_N"), F.sum(F.col("u") + F.col("p").cast("double") * (F.col("_N") - F.col("_cn"))).alias("_u"),
                            *[F.max(F.when(here, x)).alias(n) for x, n in ((F.col("range"), "_r"), (F.col("_cp") - F.col("p"), "_above_p"), (F.col("_cn") - F.col("n"), "_above_n"))])
    # the rows of the threshold's range once more; a row for each score says which
    look = F.broadcast(t.select(F.col("at").alias("_at"), "_r", "_above_p", "_above_n", k.alias("_k")))
    near = _long(d, [F.col(n) for n in names], "label").join(look, (F.col("at") == F.col("_at")) & (F.col("range") == F.col("_r")))
    near = near.groupBy("at", "score").agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"),
                                           *[F.max(x).alias(x) for x in ("_above_p", "_above_n", "_k")])
    down = Window.partitionBy("at").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_cp", F.col("_above_p") + F.sum("p").over(down)).withColumn("_cn", F.col("_above_n") + F.sum("n").over(down))
    fp = near.filter(F.col("_cp") >= F.col("_k")).groupBy("at").agg(F.min(F.col("_cn") - F.col("n")).alias("_fp"))  # least at the highest score
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    return t.join(fp, "at", "left").select("at", F.when(both, F.col("_fp") / F.col("_N")).alias("fpr_strict"), F.when(both, F.col("_u") / (F.col("_P").cast("double") * F.col("_N"))).alias("auroc"))

"""Bootstrap statistics from counts: no draw is a row, and no replicate reads the pool again.

Draws are integer hashes of (stratum, replicate, draw), so they are reproducible and independent of partitioning. A task takes a few
replicates of one stratum and a window of its places, counts in numpy how often each place is hit by all draws, and hands on those counts
by cell (``CELL`` neighbouring places). A cell meets its pool rows once and turns them into packed counts: one row for each distinct
(label, scores) and block of replicates, whose binary column holds one number per replicate. Counts travel with two bits each, those
of three and more with a byte on top: a bootstrap's counts hold about that much information, where a draw's place takes 16 bits.

Metrics need the curve of every replicate. The score axis is cut into buckets of about ``BUCKET_ROWS`` pool rows by exact prefix sums;
each bucket adds up its counts, a scan over at most ``BUCKETS`` bucket totals gives every bucket what lies above it, and a second look at
the bucket yields its share of each replicate's metrics. All arrays are bounded by these constants, whatever the pool's size.

AUROC alone needs no curve: it is a sum over pairs of a window of negatives and a window of positives. :func:`paired_aurocs` sends the
scores of such windows to the tasks that draw, and a task hands on one number for each replicate, so no counts are shuffled.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.functions.ordering import attach, hash_index, prefix_sums
from votelens.functions.scalars import MASK32, ppv_from_fpr
from votelens.operators.curves import group_report, score_groups, score_metrics

# functions that run in Python workers travel with their code and constants, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Replicates whose counts share a row.
REP_BLOCK = 128
#: Places of the pool that one cell holds, and pools up to this size are counted chunk by chunk into a whole array.
CELL, DENSE = 1 << 15, 1 << 16
#: Draws of one replicate that are hashed at once; more would leave the processor's cache.
CHUNK = 1 << 16
#: Counters a task holds at once: replicates times places. A larger pool is counted window by window, its draws hashed for each.
WINDOW = 1 << 24
#: Places of negatives whose scores a task of paired_aurocs holds, places of positives that it meets with them, and replicates it draws.
NEGATIVES, POSITIVES, AUROC_REPS = 1 << 23, 1 << 22, 1 << 8
#: Pool rows of a bucket of the score axis at least, and buckets at most.
BUCKET_ROWS, BUCKETS = 1 << 13, 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit integer mixer on 64-bit lanes."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & MASK32
    return x ^ (x >> 16)


def draw_indexes(lanes: tuple[int, int], rep: int, first: int, count: int, size: int, seed: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """Uniform places in [0, size) of draws first..first+count-1: 53 mixed bits. ``lanes`` are two 32-bit parts of the stratum's digest;
    ``mixed`` may hold the mixed draw numbers, which all replicates share."""
    d = np.arange(first, first + count, dtype=np.int64)
    low = _mix(d & MASK32) if mixed is None else mixed
    start = np.int64((rep + seed * 7919 + 1) & MASK32)
    r = _mix(_mix(start) ^ np.int64(lanes[0]))
    q = _mix(_mix(start ^ np.int64(2654435769)) ^ np.int64(lanes[1]))
    b = _mix(r ^ low ^ (d >> 32) if first + count > MASK32 else r ^ low)
    return (b * 2097152 + (_mix(b ^ q) & 2097151)) % size


def _counted(lanes: tuple[int, int], reps: range, draws: int, size: int, seed: int, start: int, stop: int) -> np.ndarray:
    """(replicate, place) counts of all draws that hit the places start..stop-1."""
    counts = np.zeros((len(reps), stop - start), np.int32)
    for first in range(0, draws, CHUNK):
        d = np.arange(first, min(first + CHUNK, draws), dtype=np.int64)
        mixed = _mix(d & MASK32)
        for row, r in zip(counts, reps):
            at = draw_indexes(lanes, r, first, len(d), size, seed, mixed)
            if stop - start < size:
                at = at[(at >= start) & (at < stop)] - start
            if len(row) <= DENSE:
                row += np.bincount(at, minlength=len(row)).astype(np.int32)
            else:
                np.add.at(row, at, np.int32(1))
    return counts


def _hit_cells(counts: np.ndarray):
    """(cell, counts) of each cell that is hit, packed: as hit places where they are few, else by :func:`_pack`."""
    reps = len(counts)
    for c in range(-(-counts.shape[1] // CELL)):
        part = counts[:, c * CELL:(c + 1) * CELL]
        sizes = part.sum(axis=1, dtype=np.int64)
        if not (total := int(sizes.sum())):
            continue
        if 8 * total + 16 * reps < part.size:
            r, places = np.nonzero(part)
            yield c, b"s" + sizes.astype(np.int32).tobytes() + np.repeat(places, part[r, places]).astype(np.uint16).tobytes()
        else:
            yield c, (b"d" if part.max() < 256 else b"D") + _pack(part)[0].tobytes()


def _dense(payload: bytes, reps: int, width: int) -> np.ndarray:
    """What ``_hit_cells`` packed, as counts by (replicate, place)."""
    if payload[:1] != b"s":
        held, offsets, fixed = np.frombuffer(payload, np.uint8, -1, 1), np.zeros(reps + 1, np.int64), -(-width // 4)
        for i in range(reps):
            more = np.count_nonzero(_QUADS[held[offsets[i]:offsets[i] + fixed]] == 3)
            offsets[i + 1] = offsets[i] + fixed + more * (1 if payload[:1] == b"d" else 4)
        return _unpack(held, offsets, reps, width)
    sizes = np.frombuffer(payload, np.int32, reps, 1)
    places = np.frombuffer(payload, np.uint16, -1, 1 + 4 * reps).astype(np.int64)
    return np.bincount(np.repeat(np.arange(reps), sizes) * width + places, minlength=reps * width).reshape(reps, width)


#: The four counts of a byte.
_QUADS = np.stack([np.arange(256) >> s & 3 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def _pack(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of counts as bytes, and the offsets of the rows. A row holds two bits for each count, where 3 stands for three and more;
    then those counts, a byte each, or four bytes each if one of the rows has a count above 255."""
    n, slots = counts.shape
    low = np.zeros((n, -(-slots // 4) * 4), np.uint8)
    low[:, :slots] = np.minimum(counts, 3)
    fixed = low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6
    more = low[:, :slots] == 3
    extra = counts[more]
    extra = extra.astype(np.uint8 if extra.max(initial=0) < 256 else np.int32)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(fixed.shape[1] + extra.itemsize * more.sum(axis=1), out=offsets[1:])
    out, here = np.empty(offsets[-1], np.uint8), _fixed_places(offsets, fixed.shape[1])
    rest = np.ones(len(out), bool)
    rest[here] = False
    out[here] = fixed
    out[rest] = extra.view(np.uint8)
    return out, offsets


def _fixed_places(offsets: np.ndarray, width: int) -> np.ndarray:
    return offsets[:-1, None].astype(np.int64) + np.arange(width)


def _unpack(held: np.ndarray, offsets: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Counts by (row, slot) of what :func:`_pack` made."""
    width = -(-slots // 4)
    here = _fixed_places(offsets, width)
    low = _QUADS[held[here]].reshape(n, width * 4)[:, :slots]
    rest = np.ones(len(held), bool)
    rest[here] = False
    extra, more = held[rest], low == 3
    if len(extra) == np.count_nonzero(more):
        low = np.ascontiguousarray(low)
    else:
        extra, low = extra.view(np.int32), low.astype(np.int64)
    low[more] = extra
    return low


def _packed_rows(counts: np.ndarray) -> pa.Array:
    """One binary value for each row of counts, see :func:`_pack`; rows with counts above 255 are packed by themselves."""
    big = counts.max(axis=1, initial=0) > 255
    if big.any():
        return pa.array([_pack(row[None])[0].tobytes() for row in counts], pa.binary())
    held, offsets = _pack(counts)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])


def _unpacked(held: bytes, slots: int) -> np.ndarray:
    return _unpack(np.frombuffer(held, np.uint8), np.array([0, len(held)]), 1, slots)[0].astype(np.int64)


def _hits(plan: DataFrame, reps: int, seed: int) -> DataFrame:
    """skey, cell, width, rb, rep, n, hits: for every stratum (skey, digest, size, draws) the packed counts of each cell and of the
    replicates rep..rep+n-1, which are of one block. The rows of a task hold at most WINDOW counters."""
    spark = plan.sparkSession
    long = lambda x: F.lit(x).cast("long")
    work = plan.filter((F.col("draws") > 0) & (F.col("size") > 0)).withColumn("rb", F.explode(F.sequence(long(0), long((reps - 1) // REP_BLOCK))))
    span = F.least(long(REP_BLOCK), F.greatest(long(1), F.floor(F.lit(WINDOW) / F.col("size"))))
    last = F.least(long(reps), (F.col("rb") + 1) * REP_BLOCK)
    work = work.withColumn("span", span).withColumn("rep", F.explode(F.sequence(F.col("rb") * REP_BLOCK, last - 1, F.col("span"))))
    work = work.withColumn("n", F.least(F.col("span"), last - F.col("rep"))).withColumn("part", F.explode(F.sequence(long(0), F.floor((F.col("size") - 1) / F.lit(WINDOW)))))
    # rows are few and each is much work: an explicit count keeps them apart
    work = work.select("skey", "digest", "size", "draws", "rb", "rep", "n", "part").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "skey", "rep", "part")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lanes = (int(row["digest"][:8], 16), int(row["digest"][8:16], 16))
                start = row["part"] * WINDOW
                mine = range(row["rep"], row["rep"] + row["n"])
                out, held = [], 0
                for cell, hits in _hit_cells(_counted(lanes, mine, row["draws"], row["size"], seed, start, min(row["size"], start + WINDOW))):
                    cell += start // CELL
                    out.append({"skey": row["skey"], "cell": cell, "width": min(CELL, row["size"] - cell * CELL), "rb": row["rb"], "rep": row["rep"], "n": row["n"], "hits": hits})
                    held += len(hits)
                    if held > 1 << 21:
                        yield pa.RecordBatch.from_pylist(out, shape)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, shape)

    shape = pa.schema([("skey", pa.string()), *[(c, pa.int64()) for c in ("cell", "width", "rb", "rep", "n")], ("hits", pa.binary())])
    return work.mapInArrow(run, "skey string, cell long, width long, rb long, rep long, n long, hits binary")


def draw_counts(pool: DataFrame, plan: DataFrame, reps: int, seed: int) -> DataFrame:
    """Packed counts of every replicate for the distinct rows of a pool.

    ``pool``: skey (the stratum), idx (dense places in it) and the columns to keep. ``plan``: skey, digest (16 hex digits of the
    stream), size and draws. Result: the kept columns, rb (block of replicates), w (one count per replicate of the block)."""
    return _counted_rows(pool, _hits(plan, reps, seed), reps)


def _counted_rows(pool: DataFrame, hits: DataFrame, reps: int) -> DataFrame:
    """:func:`draw_counts` from the draws of :func:`_hits`; several selections of a pool's columns may share them. Rows of a cell with
    equal kept columns are one, so a selection should keep no column that its reader does not need."""
    keep = [c for c in pool.columns if c not in ("skey", "idx")]
    schema = ", ".join([f"{c} {pool.schema[c].dataType.simpleString()}" for c in keep] + ["rb long", "w binary"])

    def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
        kept, out = rows.select(keep), []
        if len(rows) and len(hits):
            groups = kept.append_column("_n", pa.array(np.arange(len(rows)))).group_by(keep).aggregate([("_n", "list")])
            places = rows.column("idx").to_numpy() % CELL
            lists = groups.column("_n_list").combine_chunks()
            order, starts = places[lists.flatten().to_numpy()], lists.offsets.to_numpy()[:-1]
            blocks, width = hits.column("rb").to_numpy(), hits.column("width")[0].as_py()
            for rb in np.unique(blocks).tolist():  # one block of replicates is held at a time
                counts = np.zeros((_slots(rb, reps), width), np.int32)
                for i in np.flatnonzero(blocks == rb).tolist():
                    at, n = hits.column("rep")[i].as_py() - rb * REP_BLOCK, hits.column("n")[i].as_py()
                    counts[at:at + n] += _dense(hits.column("hits")[i].as_py(), n, width).astype(np.int32)
                w = np.add.reduceat(counts[:, order], starts, axis=1).T
                some = np.flatnonzero(w.any(axis=1))
                part = groups.select(keep).take(pa.array(some))
                out.append(part.append_column("rb", pa.array(np.full(len(some), rb))).append_column("w", _packed_rows(w[some])))
        blank = pa.table({**{c: rows.column(c).slice(0, 0) for c in keep}, "rb": pa.array([], pa.int64()), "w": pa.array([], pa.binary())})
        return pa.concat_tables(out) if out else blank

    cells = pool.withColumn("cell", F.floor(F.col("idx") / CELL))
    return cells.groupBy("skey", "cell").cogroup(hits.groupBy("skey", "cell")).applyInArrow(run, schema)


def _slots(rb: int, reps: int) -> int:
    return min(REP_BLOCK, reps - rb * REP_BLOCK)


def _matrix(rows: pa.Table, slots: int) -> np.ndarray:
    """(row, replicate) counts: what was drawn, or the same ``base`` in every replicate where there is no w."""
    w = rows.column("w").combine_chunks()
    drawn = w.drop_null()
    offsets = np.frombuffer(drawn.buffers()[1], np.int32)[drawn.offset:drawn.offset + len(drawn) + 1] if len(drawn) else np.zeros(1, np.int32)
    held = np.frombuffer(drawn.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(drawn) else np.zeros(0, np.uint8)
    try:
        counts = _unpack(held, offsets - offsets[0], len(drawn), slots)
    except ValueError:  # rows with counts of one byte beside rows with counts of four
        counts = np.stack([_unpacked(x, slots) for x in drawn.to_pylist()])
    if not w.null_count:
        return counts
    out = np.empty((len(w), slots), np.int64)
    none = w.is_null().to_numpy(zero_copy_only=False)
    out[none] = rows.column("base").to_numpy()[none, None]
    out[~none] = counts
    return out


def k_of(total: np.ndarray, target: float) -> np.ndarray:
    """Smallest k with k/total >= target, decided by the division; 0 without positives."""
    safe = np.maximum(total, 1)
    k = np.maximum(np.ceil(target * safe) - 1, 1)
    for _ in range(2):
        k = np.where(k / safe >= target, k, k + 1)
    return np.where(total > 0, k, 0).astype(np.int64)


def replicate_metrics(counts: DataFrame, reps: int, by: list[str] = (), target: float = 0.9, score: str = "score", bucket: str = "bucket") -> DataFrame:
    """by, rep and the curve's metrics of each replicate, from packed counts with columns label, ``score`` and ``bucket``.

    ``bucket`` falls as the score rises. Rows without w count ``base`` in all replicates."""
    by = list(by)
    cols = [*by, "rb", F.col(bucket).alias("bucket"), "label", F.col(score).cast("double").alias("score"), "w", *(["base"] if "base" in counts.columns else [])]
    counts = counts.select(*cols)
    keys = [*by, "rb", "bucket"]
    kinds = {c: counts.schema[c].dataType.simpleString() for c in keys}
    head = ", ".join(f"{c} {kinds[c]}" for c in keys)

    def key_of(rows: pa.Table, n: int = 1) -> dict:
        return {c: pa.array([rows.column(c)[0].as_py()] * n, rows.schema.field(c).type) for c in keys}

    def totals(rows: pa.Table) -> pa.Table:
        slots = _slots(rows.column("rb")[0].as_py(), reps)
        w, label = _matrix(rows, slots), rows.column("label").to_numpy()
        return pa.table(key_of(rows) | {"p": pa.array([w[label == 1].sum(axis=0, dtype=np.int64).tobytes()], pa.binary()), "n": pa.array([w[label == 0].sum(axis=0, dtype=np.int64).tobytes()], pa.binary())})

    def above(rows: pa.Table) -> pa.Table:
        """Of each bucket what lies above it, and the replicate's totals; a row for each of at most BUCKETS buckets."""
        rows = rows.sort_by("bucket")
        out = {c: rows.column(c) for c in keys}
        for c in ("p", "n"):
            held = np.stack([np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()])
            before = np.cumsum(held, axis=0) - held
            out["above_" + c] = pa.array([x.tobytes() for x in before], pa.binary())
            out["all_" + c] = pa.array([held.sum(axis=0).tobytes()] * len(rows), pa.binary())
        return pa.table(out)

    fields = "rep long, n_pos long, n_neg long, k long, thr double, fp long, fp_incl long, tp_incl long, best double, u double, ap double"

    def curve(rows: pa.Table, around: pa.Table) -> pa.Table:
        rb = rows.column("rb")[0].as_py()
        slots = _slots(rb, reps)
        look = {c: np.frombuffer(around.column(c)[0].as_py(), np.int64) for c in ("above_p", "above_n", "all_p", "all_n")}
        axis, at = np.unique(-rows.column("score").to_numpy(), return_inverse=True)
        w, label = _matrix(rows, slots), rows.column("label").to_numpy()
        pos, neg = np.zeros((len(axis), slots), np.int64), np.zeros((len(axis), slots), np.int64)
        for c, v in ((pos, 1), (neg, 0)):
            order = np.flatnonzero(label == v)
            order = order[np.argsort(at[order], kind="stable")]
            if len(order):
                starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
                c[at[order][starts]] = np.add.reduceat(w[order], starts, axis=0, dtype=np.int64)
        cp, cn = np.cumsum(pos, axis=0) + look["above_p"], np.cumsum(neg, axis=0) + look["above_n"]
        k = k_of(look["all_p"], target)
        reached = (cp >= k) & (k > 0)
        here = reached[-1] & (look["above_p"] < k)
        first, r = reached.argmax(axis=0), np.arange(slots)
        with np.errstate(invalid="ignore", divide="ignore"):
            prec = np.where(cp + cn > 0, cp / (cp + cn), 0.0)
        best = np.where(reached, prec, -1.0).max(axis=0)
        u = (pos * (look["all_n"] - cn + neg / 2.0)).sum(axis=0)
        pick = lambda x: pa.array(x[first, r], mask=~here)
        return pa.table({c: v for c, v in key_of(rows, slots).items() if c in by} | {
            "rep": pa.array(rb * REP_BLOCK + r), "n_pos": pa.array(look["all_p"]), "n_neg": pa.array(look["all_n"]), "k": pa.array(k),
            "thr": pa.array(-axis[first], mask=~here), "fp": pick(cn - neg), "fp_incl": pick(cn), "tp_incl": pick(cp),
            "best": pa.array(best, mask=best < 0), "u": pa.array(u), "ap": pa.array((pos * prec).sum(axis=0))})

    bys = "".join(f"{c} {kinds[c]}, " for c in by)
    sums = counts.groupBy(*keys).applyInArrow(totals, f"{head}, p binary, n binary")
    around = sums.groupBy(*by, "rb").applyInArrow(above, f"{head}, above_p binary, all_p binary, above_n binary, all_n binary")
    parts = counts.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInArrow(curve, bys + fields)
    a = parts.groupBy(*by, "rep").agg(*[F.max(c).alias(c) for c in ("n_pos", "n_neg", "k", "thr", "fp", "fp_incl", "tp_incl")], F.max("best").alias("_best"),
                                      F.sum("u").alias("_u"), F.sum("ap").alias("_ap"))
    P, N = F.col("n_pos"), F.col("n_neg")
    both = (P > 0) & (N > 0)
    return a.select(*by, "rep", "n_pos", "n_neg", "k", "thr", "fp",
                    F.when(P > 0, F.col("k") / (F.col("k") + F.col("fp"))).alias("ppv"), F.when(P > 0, F.col("fp_incl") / F.greatest(N, F.lit(1))).alias("fpr_incl"),
                    F.when(both, F.col("fp") / N).alias("fpr_strict"), F.when(P > 0, F.col("_best")).alias("ppv_oracle"),
                    F.when(both, F.col("_u") / (P.cast("double") * N)).alias("auroc"), F.when(both, F.col("_ap") / P).alias("auprc"))


def replicate_ppv(counts: DataFrame, reps: int, at: dict[str, Column]) -> DataFrame:
    """rep and for each name the precision among drawn rows that meet its condition (0 where none is drawn)."""
    names = list(at)
    flagged = counts.select("label", "rb", "w", *[c.alias(n) for n, c in at.items()])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, label = batch.column("rb").to_numpy(), batch.column("label").to_numpy()
            for rb in np.unique(blocks).tolist():
                mine = np.flatnonzero(blocks == rb)
                w = _matrix(pa.Table.from_batches([batch.take(pa.array(mine))]), slots := _slots(rb, reps))
                sums = held.setdefault(rb, np.zeros((2 * len(names), slots), np.int64))
                for i, n in enumerate(names):
                    hit = batch.column(n).to_numpy(zero_copy_only=False)[mine].astype(bool)
                    sums[2 * i] += w[hit & (label[mine] == 1)].sum(axis=0, dtype=np.int64)
                    sums[2 * i + 1] += w[hit].sum(axis=0, dtype=np.int64)
        for rb, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(rb * REP_BLOCK + np.arange(sums.shape[1])), *[pa.array(s) for s in sums]], names=["rep", *[f"{n}_{x}" for n in names for x in ("tp", "all")]])

    fields = ", ".join(f"{n}_tp long, {n}_all long" for n in names)
    sums = flagged.mapInArrow(run, f"rep long, {fields}").groupBy("rep").agg(*[F.sum(f"{n}_{x}").alias(f"{n}_{x}") for n in names for x in ("tp", "all")])
    return sums.select("rep", *[(F.col(f"{n}_tp") / F.greatest(F.col(f"{n}_all"), F.lit(1))).alias(n) for n in names])


def _fixed_ppv(pool: DataFrame, hits: DataFrame, reps: int, at: dict[str, Column]) -> DataFrame:
    """:func:`replicate_ppv` of a pool: a cell keeps a row for each label and combination of the conditions, not for each score."""
    flags = pool.select("skey", "idx", "label", *[c.alias(n) for n, c in at.items()])
    return replicate_ppv(_counted_rows(flags, hits, reps), reps, {n: F.col(n) for n in at})


def bucketed(rows: DataFrame, source: DataFrame, by: list[str], score: str, out: str = "bucket") -> DataFrame:
    """Adds to ``rows`` the bucket of each score, cut by the rows of ``source``: equal scores share one, and every bucket but those of
    hot scores holds about as many rows."""
    c = prefix_sums(source.groupBy(*by, F.col(score).alias("_score")).agg(F.count(F.lit(1)).alias("n")), by, "_score", ["n"])
    wide = F.greatest(F.lit(BUCKET_ROWS), F.ceil(F.col("tot_n") / BUCKETS))
    axis = c.select(*by, "_score", F.floor((F.col("cum_n") - F.col("n")) / wide).alias(out))
    return attach(rows, axis.withColumnRenamed("_score", score), [*by, score])


def _stream(*parts) -> Column:
    """16 hex digits that tell a stratum's stream."""
    d = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.substring(d, 1, 8), F.substring(d, 9, 8))


def _stratum() -> Column:
    return F.when(F.col("label") == 1, F.lit("*")).otherwise(F.col("center"))


def _mix_plan(scored: DataFrame, prevalence: float, by: list[str]) -> DataFrame:
    """by, label, stratum, size, draws: all positives' worth of positives, negatives to the prevalence split by center mix."""
    c = scored.groupBy(*by, "label", "center").agg(F.count(F.lit(1)).alias("size"))
    sums = [F.sum(F.when(F.col("label") == v, F.col("size")).otherwise(0)).alias(n) for v, n in ((1, "_P"), (0, "_N"))]
    t = c.groupBy(*by).agg(*sums) if by else c.agg(*sums)
    neg = c.filter(F.col("label") == 0)
    neg = attach(neg, t, by) if by else neg.crossJoin(F.broadcast(t))  # one row of totals
    want = F.bround(F.col("_P") * ((1.0 - prevalence) / prevalence), 0)
    neg = neg.select(*by, F.lit(0).alias("label"), F.col("center").alias("stratum"), "size", F.bround(want * (F.col("size") / F.col("_N")), 0).cast("long").alias("draws"))
    return neg.unionByName(t.select(*by, F.lit(1).alias("label"), F.lit("*").alias("stratum"), F.col("_P").alias("size"), F.col("_P").cast("long").alias("draws")))


def _stratified(scored: DataFrame, seed: int, prevalence: float, values: list[str], by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Pool (skey, idx, by, label, values) and plan of draws at a prevalence, as :func:`draw_counts` takes them."""
    by = list(by)
    rows = scored.select(*by, "name", F.col("label").cast("int").alias("label"), "center", *[F.col(v).cast("double").alias(v) for v in values])
    plan = _mix_plan(rows, prevalence, by)
    stream = _stream(*by, "stratum", "label") if by else _stream("label", "stratum")
    skey = F.to_json(F.struct(*by, "label", "stratum"))
    pool = hash_index(rows.withColumn("stratum", _stratum()), [*by, "label", "stratum"], "name", f"pool{seed}")
    pool = pool.withColumn("skey", skey).drop("name", "center", "stratum")
    for v in values:  # a place without a score counts in the draws only
        pool = pool.filter(F.col(v).isNotNull())
    return pool, plan.select(skey.alias("skey"), stream.alias("digest"), "size", "draws")


def _with_bucket(pool: DataFrame, scored: DataFrame, by: list[str], value: str, out: str = "bucket") -> DataFrame:
    """A pool of :func:`_stratified` with the bucket of one of its scores."""
    return bucketed(pool, scored.select(*by, F.col(value).cast("double").alias(value)), by, value, out)


def stratified_counts(scored: DataFrame, reps: int, seed: int, prevalence: float = 0.01, values: list[str] = ("score",), by: list[str] = ()) -> DataFrame:
    """Counts of draws at a prevalence: positives pooled, negatives stratified by center. Buckets: bucket, bucket_<value> from the second on."""
    values, by = list(values), list(by)
    pool, plan = _stratified(scored, seed, prevalence, values, by)
    for i, v in enumerate(values):
        pool = _with_bucket(pool, scored, by, v, f"bucket_{v}" if i else "bucket")
    return draw_counts(pool, plan, reps, seed)


def iid_counts(scored: DataFrame, reps: int, seed: int, by: list[str] = ()) -> DataFrame:
    """Counts of a plain bootstrap of whole rows."""
    by = list(by)
    rows = scored.select(*by, "name", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"))
    skey = F.to_json(F.struct(*by)) if by else F.lit("all")
    pool = bucketed(hash_index(rows, by, "name", f"iid{seed}"), rows, by, "score").withColumn("skey", skey).drop("name")
    plan = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("size"))
    return draw_counts(pool, plan.select(skey.alias("skey"), F.lit("0" * 16).alias("digest"), "size", F.col("size").alias("draws")), reps, seed)


def summary(col: str, prefix: str) -> list[Column]:
    """Median, 95 % interval and mean over replicates (one row per replicate, NULLs skipped)."""
    return [F.percentile(col, 0.5).alias(f"{prefix}_median"), F.percentile(col, 0.025).alias(f"{prefix}_lo"),
            F.percentile(col, 0.975).alias(f"{prefix}_hi"), (F.sum(col) / F.count(col)).alias(f"{prefix}_mean")]


def bootstrap(scored: DataFrame, reps: int = 1000, seed: int = 12345, target: float = 0.9, prevalence: float = 0.01,
              fixed_thr: float | None = None) -> DataFrame:
    """Precision at recall under prevalence resampling: curve, oracle, optional fixed threshold, median FPR."""
    pool, plan = _stratified(scored, seed, prevalence, ["score"])
    hits = _hits(plan, reps, seed)
    m = replicate_metrics(_counted_rows(_with_bucket(pool, scored, [], "score"), hits, reps), reps, target=target)
    if fixed_thr is None:
        m = m.withColumn("fixed", F.lit(None).cast("double"))
    else:
        fixed = _fixed_ppv(pool, hits, reps, {"fixed": F.col("score") >= fixed_thr})
        m = m.join(fixed, "rep", "left").withColumn("fixed", F.coalesce("fixed", F.lit(0.0)))
    return m.agg(F.count(F.lit(1)).alias("reps"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
                 F.percentile("fpr_incl", 0.5).alias("fpr_median"), *summary("ppv", "curve"),
                 *summary("ppv_oracle", "oracle"), *summary("fixed", "fixed"))


def challenge_replicates(scored: DataFrame, reps: int, seed: int, target: float = 0.9, ratio: int = 100) -> DataFrame:
    """Per replicate precision with all negatives kept and positives drawn to negatives/ratio.

    Negatives never move: each distinct score of theirs is one row that counts the same in every replicate."""
    plain = scored.select("name", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"))
    rows = bucketed(plain, plain, [], "score")
    sizes = scored.agg(F.count(F.when(F.col("label") == 1, 1)).alias("size"), F.count(F.when(F.col("label") == 0, 1)).alias("_n"))
    plan = sizes.select(F.lit("all").alias("skey"), F.lit("0" * 16).alias("digest"), "size",
                        F.greatest(F.lit(1), F.bround(F.col("_n") / float(ratio), 0)).cast("long").alias("draws"))
    pool = hash_index(rows.filter(F.col("label") == 1), [], "name", f"gc{seed}").withColumn("skey", F.lit("all")).drop("name")
    drawn = draw_counts(pool, plan, reps, seed).withColumn("base", F.lit(0).cast("long"))
    still = rows.filter(F.col("label") == 0).groupBy("label", "score", "bucket").agg(F.count(F.lit(1)).alias("base"))
    still = still.select("label", "score", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((reps - 1) // REP_BLOCK).cast("long"))).alias("rb"),
                         F.lit(None).cast("binary").alias("w"), "base")
    m = replicate_metrics(drawn.unionByName(still), reps, target=target).filter(F.col("n_pos") > 0)
    return m.select("rep", F.col("n_pos").alias("n_draw"), "k", "fp", "ppv")


def bootstrap_challenge(scored: DataFrame, reps: int = 1000, seed: int = 12345, target: float = 0.9,
                        ratio: int = 100) -> DataFrame:
    """Median and interval of :func:`challenge_replicates`, with the effective recall of so few draws."""
    r = challenge_replicates(scored, reps, seed, target, ratio)
    return r.agg(F.count("ppv").alias("reps"), F.max("n_draw").alias("n_draw"),
                 (F.max("k") / F.max("n_draw")).alias("effective_recall"),
                 F.percentile("ppv", 0.5).alias("ppv_median"), F.percentile("ppv", 0.025).alias("ppv_lo"),
                 F.percentile("ppv", 0.975).alias("ppv_hi"))


METRIC_COLUMN = {"curve": "ppv", "auroc": "auroc", "auprc": "auprc"}


def paired_replicates(scored: DataFrame, a: str, b: str, reps: int, seed: int, mode: str, target: float = 0.9,
                      prevalence: float = 0.01, thr_a: float | None = None, thr_b: float | None = None) -> DataFrame:
    """metric(a) - metric(b) per replicate on shared draws."""
    pool, plan = _stratified(scored, seed, prevalence, [a, b])
    hits = _hits(plan, reps, seed)
    if mode == "fixed":
        m = _fixed_ppv(pool, hits, reps, {"_a": F.col(a) >= thr_a, "_b": F.col(b) >= thr_b})
        return m.select("rep", (F.col("_a") - F.col("_b")).alias("delta"))
    v = METRIC_COLUMN[mode]
    ma, mb = (replicate_metrics(_counted_rows(_with_bucket(pool.select("skey", "idx", "label", c), scored, [], c), hits, reps), reps, target=target, score=c) for c in (a, b))
    ma, mb = ma.select("rep", F.col(v).alias("_a")), mb.select(F.col("rep").alias("_rep"), F.col(v).alias("_b"))
    return ma.join(mb, F.col("rep") == F.col("_rep")).select("rep", (F.col("_a") - F.col("_b")).alias("delta"))


def _score_cells(pool: DataFrame, values: list[str]) -> DataFrame:
    """skey, label, cell, scores: the scores of each value by place of the cell, NaN at places without."""
    shape = pa.schema([("skey", pa.string()), ("label", pa.int32()), ("cell", pa.int64()), ("scores", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("idx").to_numpy() % CELL
        held = np.full((len(values), int(at.max()) + 1), np.nan)
        for x, v in zip(held, values):
            x[at] = rows.column(v).to_numpy()
        return pa.Table.from_pylist([{c: rows.column(c)[0].as_py() for c in ("skey", "label", "cell")} | {"scores": held.tobytes()}], shape)

    cells = pool.select("skey", "label", F.floor(F.col("idx") / CELL).cast("long").alias("cell"), "idx", *values)
    return cells.groupBy("skey", "label", "cell").applyInArrow(run, "skey string, label int, cell long, scores binary")


def _scores(cells: pa.Table, i: int, n: int, start: int, stop: int) -> np.ndarray:
    """The scores of places start..stop-1 in the i-th of n values, from rows of :func:`_score_cells`."""
    out = np.full(stop - start, np.nan)
    for cell, held in zip(cells.column("cell").to_pylist(), cells.column("scores")):
        part, at = np.frombuffer(held.as_buffer(), np.float64).reshape(n, -1)[i], cell * CELL - start
        out[at:at + len(part)] = part
    return out


def paired_aurocs(scored: DataFrame, values: list[str], reps: int, seed: int, prevalence: float = 0.01) -> DataFrame:
    """rep and ``auroc``i of each score on shared draws, equal to those of :func:`replicate_metrics`; null without both classes.

    A task holds the scores of NEGATIVES places of one stratum and of POSITIVES places of the positives, and draws AUROC_REPS replicates of
    both. Its negatives know their place among the positives' distinct scores, so a replicate costs its draws and one look-up for each
    place. Scores are sent once for each group of replicates, eight bytes for each value and row."""
    n = len(values)
    pool, plan = _stratified(scored, seed, prevalence, values)
    cells = _score_cells(pool.filter(F.col("label").isin(0, 1)), values).persist(StorageLevel.DISK_ONLY)  # negatives and positives read them
    positive = F.get_json_object("skey", "$.label") == "1"
    one = plan.filter(positive).agg(F.max("digest").alias("pdigest"), F.max("size").alias("psize"), F.max("draws").alias("pdraws"))  # one row
    keys = ["skey", "window", "part", "group"]
    long = lambda x: F.lit(x).cast("long")
    upto = lambda last: F.explode(F.sequence(long(0), last.cast("long")))
    parts, groups = upto(F.floor(F.greatest(F.col("psize") - 1, long(0)) / POSITIVES)), upto(long((reps - 1) // AUROC_REPS))
    tasks = plan.filter(~positive & (F.col("draws") > 0) & (F.col("size") > 0)).crossJoin(F.broadcast(one))
    tasks = tasks.withColumn("window", upto(F.floor((F.col("size") - 1) / NEGATIVES))).withColumn("part", parts).withColumn("group", groups)
    known = ["digest", "size", "draws", "pdigest", "psize", "pdraws"]
    tasks = tasks.select(*keys, *known)
    met = cells.filter(F.col("label") == 1).select(F.floor(F.col("cell") * CELL / POSITIVES).alias("part"), "cell", "scores")
    met = attach(met, tasks.select(*keys), ["part"])
    right = tasks.unionByName(met.select(*keys, "cell", "scores"), allowMissingColumns=True)
    left = cells.filter(F.col("label") == 0).crossJoin(F.broadcast(one.select("psize")))
    left = left.select("skey", F.floor(F.col("cell") * CELL / NEGATIVES).alias("window"), "psize", "cell", "scores").withColumn("part", parts).withColumn("group", groups)
    shape = pa.schema([*[(c, pa.int64()) for c in ("rep", "part", "p", "n")], *[(f"u{i}", pa.int64()) for i in range(n)]])

    def run(negatives: pa.Table, rest: pa.Table) -> pa.Table:
        task = [r for r in rest.select([*keys, *known]).to_pylist() if r["digest"] is not None]
        if not len(negatives) or not task:
            return shape.empty_table()
        task = task[0]
        start, first = task["window"] * NEGATIVES, task["part"] * POSITIVES
        stop, last = min(task["size"], start + NEGATIVES), min(task["psize"], first + POSITIVES)
        met = rest.filter(pc.is_valid(rest.column("scores")))
        place, axis_of, slots = [], [], []
        for i in range(n):
            held, above = _scores(negatives, i, n, start, stop), _scores(met, i, n, first, last)
            some, drawable = ~np.isnan(held), ~np.isnan(above)  # the same places for every value
            axis, at = np.unique(above[drawable], return_inverse=True)
            # even: between two distinct scores of the positives, odd: equal to one; the last one is for places without a score
            code = np.full(len(held), 2 * len(axis) + 1, np.int32)
            for j in range(0, len(held), CHUNK):
                here, x = some[j:j + CHUNK], held[j:j + CHUNK]
                code[j:j + CHUNK][here] = np.searchsorted(axis, x[here], "left") + np.searchsorted(axis, x[here], "right")
            place.append(code)
            axis_of.append(at)
            slots.append(len(axis))
        del held, above
        lanes, plane = ((int(task[d][:8], 16), int(task[d][8:16], 16)) for d in ("digest", "pdigest"))
        mine, out = range(task["group"] * AUROC_REPS, min(reps, (task["group"] + 1) * AUROC_REPS)), []
        span = max(1, min(len(mine), WINDOW // max(stop - start, last - first, 1)))
        for r in range(mine.start, mine.stop, span):
            some_reps = range(r, min(r + span, mine.stop))
            drawn = _counted(plane, some_reps, task["pdraws"], task["psize"], seed, first, last)[:, drawable]
            counts = _counted(lanes, some_reps, task["draws"], task["size"], seed, start, stop)
            for rep, p, c in zip(some_reps, drawn, counts):
                row = {"rep": rep, "part": task["part"], "p": int(p.sum(dtype=np.int64)), "n": int(c.sum(where=some, dtype=np.int64))}
                for i in range(n):
                    cum = np.r_[0, np.cumsum(np.bincount(axis_of[i], p, slots[i]).astype(np.int64))]
                    twice = np.r_[2 * cum[-1] - cum[np.arange(2 * slots[i] + 1) // 2] - cum[(np.arange(2 * slots[i] + 1) + 1) // 2], 0]  # positives above, ties count one half
                    row[f"u{i}"] = sum(int(np.dot(twice[place[i][j:j + CHUNK]], c[j:j + CHUNK])) for j in range(0, len(c), CHUNK))
                out.append(row)
        return pa.Table.from_pylist(out, shape)

    # groups are few and each is much work: an explicit count keeps them apart
    many = 4 * int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [d.select(*keys, *cols).repartition(many, *keys) for d, cols in ((left, ("cell", "scores")), (right, (*known, "cell", "scores")))]
    u = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(run, ", ".join(f"{c} long" for c in shape.names))
    us = [f"u{i}" for i in range(n)]
    # every task of a window of positives counts them, and the negatives are counted with each such window
    u = u.groupBy("rep", "part").agg(F.max("p").alias("p"), *[F.sum(c).alias(c) for c in ("n", *us)]).groupBy("rep").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("p", *us)])
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return u.select("rep", *[F.when(both, F.col(c) / 2.0 / (F.col("p").cast("double") * F.col("n"))).alias(f"auroc{i}") for i, c in enumerate(us)])


def paired_bootstrap(scored: DataFrame, a: str, b: str, reps: int = 1000, seed: int = 12345, mode: str = "curve",
                     **kw) -> DataFrame:
    if mode == "auroc":  # equal to paired_replicates
        m = paired_aurocs(scored, [a, b], reps, seed, kw.get("prevalence", 0.01))
        d = m.select("rep", (F.col("auroc0") - F.col("auroc1")).alias("delta"))
    else:
        d = paired_replicates(scored, a, b, reps, seed, mode, **kw)
    return d.agg(F.count("delta").alias("reps"),
                 (F.count(F.when(F.col("delta") > 0, 1)) / F.count("delta")).alias("p_gt0"),
                 F.percentile("delta", 0.5).alias("median_delta"), (F.sum("delta") / F.count("delta")).alias("mean_delta"),
                 F.percentile("delta", 0.025).alias("lo"), F.percentile("delta", 0.975).alias("hi"))


def gate(paired: DataFrame) -> DataFrame:
    """PASS when the interval clears zero from above, FAIL from below, else INCONCLUSIVE."""
    return paired.withColumn("verdict", F.when(F.col("lo") > 0, "PASS").when(F.col("hi") < 0, "FAIL")
                             .otherwise("INCONCLUSIVE"))


def mde(scored: DataFrame, metric: str = "curve", reps: int = 1000, seed: int = 12345, target: float = 0.9,
        prevalence: float = 0.01) -> DataFrame:
    """Noise floor: population SD of the metric over replicates, minimum detectable effect = 2 SD."""
    m = replicate_metrics(stratified_counts(scored, reps, seed, prevalence), reps, target=target)
    v = F.col(METRIC_COLUMN[metric])
    return m.agg(F.count(v).alias("reps"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("sd"),
                 (2.0 * F.stddev_pop(v)).alias("mde"))


def seed_summary(scored: DataFrame, seed_col: str = "seed", metric: str = "auroc", target: float = 0.9) -> DataFrame:
    m = score_metrics(scored, [seed_col], target)
    v = F.col(METRIC_COLUMN[metric])
    return m.agg(F.count(v).alias("n_seeds"), (F.sum(v) / F.count(v)).alias("mean"), F.stddev_pop(v).alias("sd"))


def auroc_ci(scored: DataFrame, reps: int = 2000, seed: int = 0, by: list[str] = ()) -> DataFrame:
    """Plain bootstrap AUROC: mean and 95 % interval; single-class replicates are NULL and drop out."""
    by = list(by)
    m = replicate_metrics(iid_counts(scored, reps, seed, by), reps, by)
    return m.groupBy(*by).agg(F.count("auroc").alias("reps"), (F.sum("auroc") / F.count("auroc")).alias("auroc_mean"),
                              F.percentile("auroc", 0.025).alias("ci_lo"), F.percentile("auroc", 0.975).alias("ci_hi"))


def boot_ppv(scored: DataFrame, reps: int = 1000, seed: int = 0, target: float = 0.9) -> DataFrame:
    """Plain bootstrap of the precision implied by the strict FPR; replicates without both classes drop out."""
    m = replicate_metrics(iid_counts(scored, reps, seed), reps, target=target)
    m = m.withColumn("v", ppv_from_fpr(F.col("fpr_strict"), target))
    return m.agg(F.count("v").alias("reps"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.025).alias("lo"),
                 F.percentile("v", 0.975).alias("hi"))


def report_full(scored: DataFrame, reps: int = 2000, seed: int = 12345, target: float = 0.9,
                prevalence: float = 0.01, challenge_reps: int | None = None) -> DataFrame:
    """The trusted numbers of one score table in one row; ``challenge_reps`` defaults to ``reps``."""
    b = bootstrap(scored, reps, seed, target, prevalence).select(
        F.col("curve_median").alias("ppv90"), F.col("curve_lo").alias("ci_lo"), F.col("curve_hi").alias("ci_hi"))
    g = bootstrap_challenge(scored, reps if challenge_reps is None else challenge_reps, seed, target).select(
        F.col("ppv_median").alias("ppv90_gc"), F.col("ppv_lo").alias("gc_lo"), F.col("ppv_hi").alias("gc_hi"))
    m = score_metrics(scored, [], target).select(F.col("fpr_incl").alias("fpr90"), "auroc", "auprc",
                                                 (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("n_pos").alias("pos"))
    return b.crossJoin(g).crossJoin(m)  # three one-row results


def full_report(scored: DataFrame, dedup: str | None = "orig", reps: int = 1000, seed: int = 12345,
                target: float = 0.9, prevalence: float = 0.01) -> DataFrame:
    """Point metrics and bootstrap median for the pooled set and every center, after optional source dedup."""
    from votelens.operators.labels import dedup_by_source
    d = scored
    if dedup:
        d = dedup_by_source(scored, dedup).withColumnRenamed("source", "name")
    d = d.select("name", "score", "label", "center")
    point = group_report(d, "center", target=target).select("center", "n_pos", "n_neg", "ppv", "ppv_oracle", "fpr_incl")
    each = d.withColumn("group", F.explode(F.array(F.lit("POOLED"), F.col("center"))))
    boots = grouped_bootstrap(each, "group", reps, seed, target, prevalence)
    return point.withColumnRenamed("center", "group").join(boots, "group", "left")


def grouped_bootstrap(scored: DataFrame, group: str, reps: int, seed: int, target: float, prevalence: float) -> DataFrame:
    """Bootstrap medians of several groups in one plan: the group is one more key of draws and pools."""
    m = replicate_metrics(stratified_counts(scored, reps, seed, prevalence, by=[group]), reps, [group], target)
    return m.groupBy(group).agg(*summary("ppv", "boot"))

"""Approximate nearest neighbours by largest inner product: p-stable hashing with multiprobe.

A row x becomes (x, sqrt(M^2 - |x|^2)) / M and a query q becomes (q, 0) / |q|, M the greatest norm, so the largest inner product is the
least Euclidean distance. Each of ``TABLES`` tables hashes with several functions floor((a.x + b) / WIDTH), a normal; a bucket is one
value of all of them. A query visits, in each table, the buckets that differ by one step in some functions, in the order of their
estimated success: the sum of the squared distances to the borders crossed, least first. The number of functions follows from the
number of rows, the number of buckets visited from ``FIT_QUERIES`` queries whose exact neighbours a scan finds: as many as reach
``RECALL`` of them, and fewer functions where ``PROBES`` buckets don't reach it.

Buckets are dealt to cells of about ``CELL_ROWS`` rows; a cell multiplies each bucket's rows with the queries that visit it and
hands on the k best per query. The first buckets are visited first, and what they give is the least score that later ones must reach.
A bucket with more rows than a cell is split into pieces, all of which are visited. Queries that have found fewer than k rows
after that are compared with all rows, in cells of the same size.

Equal vectors are one query and at most k + 1 candidates (the least ids), so copies never meet each other in a bucket.

Rows: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part; a shorter vector has
zeros at its end; repeated rows count once; a vec_id with several vectors is found once, by its best one, and asks once for each; a
query never finds its own id; ties go to the smaller id; an empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelens.llm.common import drop, share, written

K = 20
TABLES, WIDTH, SEED = 8, 2.5, 13
#: Rows that a bucket would hold if all were alike, and buckets visited at most.
BUCKET_ROWS, PROBES = 8, 512
FIT_QUERIES, RECALL = 96, 0.95
#: Share of the buckets that is visited first.
FIRST = 1 / 16
CELL_ROWS = 8192
#: Split buckets are this many at most, so that all tasks may know them.
SPLIT_BUCKETS = 100_000
#: Queries of one vector are split into so many groups when the result is handed to them.
COPY_GROUPS = 16
FOUND = "array<struct<score: double, id: long>>"


def matrix(column, width: int = 0) -> np.ndarray:
    """Rows of doubles, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = lists.flatten().to_numpy().astype(np.float64), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def rows_of(vectors: DataFrame) -> DataFrame:
    """(id, vec) of the rows that take part, each once."""
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(F.col("vec").isNotNull() & sound, F.lit(False))).distinct()


class Hashes:
    """The functions of all tables; ``scale`` is the greatest norm of a row."""

    def __init__(self, dims: int, functions: int, scale: float, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dims, self.functions, self.scale, self.tables, self.width = dims, functions, scale, tables, width
        self.lines = rng.normal(size=(dims + 1, tables * functions))
        self.shift = rng.random(tables * functions) * width
        self.mix = rng.integers(1, 1 << 62, functions, dtype=np.int64) * 2 + 1

    def _slots(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (points @ self.lines + self.shift) / self.width
        slot = np.floor(at)
        return slot.astype(np.int64).reshape(len(at), self.tables, self.functions), ((at - slot) * self.width).reshape(len(at), self.tables, self.functions)

    def _keys(self, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (slots * self.mix).sum(axis=-1)
            h = (h ^ (h >> 31)) * np.int64(0x5851F42D4C957F2D)
        return h ^ (h >> 29)

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        points = np.zeros((len(rows), self.dims + 1))
        points[:, :rows.shape[1]] = rows / self.scale
        points[:, -1] = np.sqrt(np.maximum(0, 1 - np.square(points[:, :-1]).sum(axis=1)))
        return self._keys(self._slots(points)[0])

    def probes(self, queries: np.ndarray, most: int) -> np.ndarray:
        """(query, table, place): buckets in the order of their estimated success."""
        points = np.zeros((len(queries), self.dims + 1))
        big = np.abs(queries).max(axis=1, keepdims=True, initial=0)
        points[:, :queries.shape[1]] = queries / big / np.linalg.norm(queries / big, axis=1, keepdims=True)
        slot, up = self._slots(points)
        n = len(queries) * self.tables
        slot, up = slot.reshape(n, -1), up.reshape(n, -1)
        cost, steps = np.zeros((n, 1)), np.zeros((n, 1, self.functions), np.int8)
        for i in range(self.functions):  # the best sets of the first functions hold those that the best of all begin with
            cost = np.concatenate([cost, cost + up[:, i:i + 1] ** 2, cost + (self.width - up[:, i:i + 1]) ** 2], axis=1)
            below, above = steps.copy(), steps.copy()
            below[:, :, i], above[:, :, i] = -1, 1
            steps = np.concatenate([steps, below, above], axis=1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :most]
            cost, steps = np.take_along_axis(cost, best, 1), np.take_along_axis(steps, best[:, :, None], 1)
        return self._keys(slot[:, None, :] + steps).reshape(len(queries), self.tables, -1)


def _extent(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, greatest number of components, greatest norm."""
    def run(batches):
        n, dims, norm = 0, 0, 0.0
        for batch in batches:
            points = matrix(batch.column("vec"))
            big = np.abs(points).max(axis=1, keepdims=True, initial=0)  # a norm overflows only where it is too great itself
            n, dims, norm = n + len(points), max(dims, points.shape[1]), max(norm, (big[:, 0] * np.linalg.norm(points / big, axis=1)).max(initial=0))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([dims]), pa.array([norm])], names=["n", "dims", "norm"])

    one = rows.select("vec").mapInArrow(run, "n long, dims long, norm double").agg(F.sum("n").alias("n"), F.max("dims").alias("dims"), F.max("norm").alias("norm")).first()
    return one["n"] or 0, one["dims"] or 1, one["norm"] or 1.0


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, an id once: by query, falling score, id."""
    order = np.lexsort((-score, ids, query))
    once = order[np.r_[True, (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
    order = once[np.lexsort((ids[once], -score[once], query[once]))]
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _visit(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """Rows (bucket, id, vec) of a cell and queries (key, vec, floor, buckets): the k best rows of each query in its buckets."""
        q = matrix(asked.column("vec"))
        points = matrix(rows.column("vec"), q.shape[1])
        q = np.pad(q, ((0, 0), (0, points.shape[1] - q.shape[1])))
        order = np.argsort(rows.column("bucket").to_numpy(), kind="stable")
        points, ids, bucket = points[order], rows.column("id").to_numpy()[order], rows.column("bucket").to_numpy()[order]
        buckets = asked.column("buckets").combine_chunks()
        who, where = np.repeat(np.arange(len(q)), np.diff(buckets.offsets.to_numpy())), buckets.flatten().to_numpy()
        floor = asked.column("floor").to_numpy()
        begin, end = np.searchsorted(bucket, where, "left"), np.searchsorted(bucket, where, "right")
        hit = np.flatnonzero(end > begin)
        hit = hit[np.argsort(begin[hit], kind="stable")]
        who, begin, end = who[hit], begin[hit], end[hit]
        held: list[np.ndarray] = [np.zeros((3, 0))]
        pairs = 0

        def pruned() -> np.ndarray:
            a = np.concatenate(held, axis=1)
            return a[:, _best(a[0].astype(np.int64), ids[a[1].astype(np.int64)], a[2], k)]

        cuts = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]]) if len(begin) else []
        for x, y in zip(cuts, np.r_[cuts[1:], len(begin)].astype(np.int64)):
            for z in range(x, y, 1024):
                mine, a, b = who[z:min(y, z + 1024)], begin[x], end[x]
                score = q[mine] @ points[a:b].T
                i, j = np.nonzero(score >= (floor[mine] - 1e-9 * np.abs(floor[mine]))[:, None])
                held.append(np.stack([mine[i], j + a, score[i, j]]))
                pairs += len(i)
                if pairs > 1 << 20:
                    held, pairs = [pruned()], 0
        found = pruned()
        who, at = found[0].astype(np.int64), found[1].astype(np.int64)
        score = np.einsum("ij,ij->i", q[who], points[at])  # the same sum whatever bucket the row was met in
        order = _best(who, ids[at], score, k)
        who, at, score = who[order], at[order], score[order]
        some, first = np.unique(who, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(who)], pa.int32()), pa.StructArray.from_arrays([pa.array(score), pa.array(ids[at])], names=["score", "id"]))
        return pa.table({"key": asked.column("key").combine_chunks().take(pa.array(some)), "found": lists})

    def safe(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({"key": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))})
        return run(rows, asked)

    return safe


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """key, found: the k best of all lists of a query, an id that several tables found once. A list has at most k rows, and a
    query at most as many lists as it visits cells."""
    def run(batches):
        for batch in batches:
            lists = batch.column("found")
            sizes, rows = np.diff(lists.offsets.to_numpy()), lists.flatten()
            score, ids = rows.field("score").to_numpy(), rows.field("id").to_numpy()
            who = np.repeat(np.arange(batch.num_rows), sizes)
            order = _best(who, ids, score, k)
            ends = np.searchsorted(who[order], np.arange(batch.num_rows + 1))
            best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(score[order]), pa.array(ids[order])], names=["score", "id"]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), best], names=["key", "found"])

    return parts.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found")).mapInArrow(run, f"key long, found {FOUND}")


class Index:
    """Rows dealt to cells, and the cells that a query's buckets lie in."""

    def __init__(self, rows: DataFrame, hashes: Hashes, n: int):
        self.hashes, self.cells = hashes, max(1, -(-n // CELL_ROWS))
        most = max(CELL_ROWS, -(-n * hashes.tables // SPLIT_BUCKETS))
        shared = share(rows.sparkSession, hashes)

        def buckets(batches):
            held = shared()
            for batch in batches:
                keys = held.of_rows(matrix(batch.column("vec"), held.dims)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(held.tables), batch.num_rows)), pa.array(keys)], names=["table", "bucket"])

        big = (rows.select("vec").mapInArrow(buckets, "table long, bucket long").groupBy("table", "bucket").agg(F.count("*").alias("n"))
               .filter(F.col("n") > most).orderBy("table", "bucket").collect())  # at most SPLIT_BUCKETS, since each holds more than n * tables / SPLIT_BUCKETS
        self.pieces = {(r["table"], r["bucket"]): -(-r["n"] // most) for r in big}
        self.first_piece, at = {}, hashes.tables * self.cells
        for b, n_pieces in self.pieces.items():
            self.first_piece[b] = at
            at += n_pieces

    def cell_of(self, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return table * self.cells + ((bucket >> 7) % self.cells)

    def rows(self, rows: DataFrame) -> DataFrame:
        """cell, bucket, id, vec: each row once for each table."""
        shared = share(rows.sparkSession, self)

        def run(batches):
            held = shared()
            for batch in batches:
                keys = held.hashes.of_rows(matrix(batch.column("vec"), held.hashes.dims))
                for t in range(held.hashes.tables):
                    cell, ids = held.cell_of(t, keys[:, t]), batch.column("id").to_numpy()
                    if held.pieces:
                        for i, b in enumerate(keys[:, t].tolist()):
                            if (t, b) in held.pieces:
                                cell[i] = held.first_piece[t, b] + (int(ids[i]) * 0x9E3779B97F4A7C15 >> 17) % held.pieces[t, b]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(keys[:, t]), batch.column("id"), batch.column("vec")], names=["cell", "bucket", "id", "vec"])

        return rows.mapInArrow(run, f"cell long, bucket long, id long, vec {rows.schema['vec'].dataType.simpleString()}")

    def asked(self, queries: DataFrame, begin: int, end: int) -> DataFrame:
        """cell, key, vec, floor, buckets: each query once for each cell that its buckets from place ``begin`` up to ``end`` lie in."""
        shared = share(queries.sparkSession, self)
        names = ["cell", "key", "vec", "floor", "buckets"]

        def run(batches):
            held = shared()
            h = held.hashes
            for whole in batches:
                for a in range(0, whole.num_rows, step := max(1, (1 << 21) // (3 * end * h.functions * h.tables))):
                    batch = whole.slice(a, step)
                    keys = h.probes(matrix(batch.column("vec"), h.dims), end)[:, :, begin:]
                    n, tables, places = keys.shape
                    who, table, key = np.repeat(np.arange(n), tables * places), np.tile(np.repeat(np.arange(tables), places), n), keys.ravel()
                    cell = held.cell_of(table, key)
                    if held.pieces:
                        more = [(i, p) for i, b in enumerate(zip(table.tolist(), key.tolist())) if b in held.pieces for p in range(held.pieces[b])]
                        if more:
                            i, p = np.array(more).T
                            first = np.array([held.first_piece[table[x], key[x]] for x in i.tolist()])
                            rest = np.ones(len(key), bool)
                            rest[i] = False
                            who, cell, key = np.r_[who[rest], who[i]], np.r_[cell[rest], first + p], np.r_[key[rest], key[i]]
                    order = np.lexsort((cell, who))
                    who, cell, key = who[order], cell[order], key[order]
                    starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])]) if len(who) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)], pa.int32()), pa.array(key))
                    at = pa.array(who[starts])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), *(batch.column(c).take(at) for c in ("key", "vec", "floor")), lists], names=names)

        return queries.select("key", "vec", "floor").mapInArrow(run, f"cell long, key long, vec {queries.schema['vec'].dataType.simpleString()}, floor double, buckets array<long>")


def _fit(rows: DataFrame, queries: DataFrame, n: int, dims: int, scale: float, k: int) -> tuple[Hashes, int]:
    """Functions, and buckets to visit: fitted to the exact neighbours of FIT_QUERIES queries, the first in hash order."""
    sample = queries.orderBy(F.xxhash64("key"), "key").limit(FIT_QUERIES).select("own", "vec").toArrow()
    asked = matrix(sample.column("vec"), dims)
    shared = share(rows.sparkSession, (asked, sample.column("own").to_numpy()))

    def nearest(batches):
        q, own = shared()
        best, vecs = np.zeros((3, 0)), np.zeros((0, q.shape[1]))
        for batch in batches:
            points, ids = matrix(batch.column("vec"), q.shape[1]), batch.column("id").to_numpy()
            score = np.where(ids[None, :] == own[:, None], -np.inf, q @ points.T)
            kk = min(k, len(ids))
            j = np.argpartition(-score, kk - 1, axis=1)[:, :kk] if kk else np.zeros((len(q), 0), np.int64)
            i = np.repeat(np.arange(len(q)), kk)
            all_ = np.concatenate([best, np.stack([i, j.ravel() + best.shape[1], score[i, j.ravel()]])], axis=1)
            pool = np.concatenate([vecs, points[j.ravel()]])
            at = np.lexsort((-all_[2], all_[0]))
            at = at[(np.arange(len(at)) - np.searchsorted(all_[0][at], all_[0][at]) < k) & np.isfinite(all_[2][at])]
            best, vecs = all_[:, at], pool[at]
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int64)), pa.array(best[2]), pa.array(list(vecs), pa.list_(pa.float64()))], names=["q", "score", "vec"])

    best = rows.mapInArrow(nearest, "q long, score double, vec array<double>")
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("_r") <= k)
    near = best.select("q", "vec").toArrow()  # FIT_QUERIES * k rows at most
    q, vec = near.column("q").to_numpy(), matrix(near.column("vec"), dims)
    functions = max(1, min(24, round(math.log2(max(2, n / BUCKET_ROWS)))))
    while True:
        hashes = Hashes(dims, functions, scale)
        place = np.full(len(q), PROBES)
        if len(q):
            own, seen = hashes.of_rows(vec), hashes.probes(asked, PROBES)
            same = seen[q] == own[:, :, None]
            place = np.where(same.any(axis=2), same.argmax(axis=2), PROBES).min(axis=1)
        reached = np.sort(place)[math.ceil(RECALL * len(q)) - 1] if len(q) else 0
        if reached < PROBES or functions == 1:
            return hashes, int(min(reached + 1, 3 ** functions, PROBES))
        functions -= 1


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query's rows (id, vec)."""
    spark, paths = rows.sparkSession, []

    def kept(df: DataFrame, label: str) -> DataFrame:
        df, path = written(df, f"pstable-{label}")
        paths.append(path)
        return df

    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("_r") <= k + 1).drop("_r")
    few = kept(few, "rows")
    # each vector that is asked for, once, under its least id; a vec_id with several vectors needs keys of its own
    asked = kept(queries.groupBy("vec").agg(F.min("id").alias("own"), F.count("*").alias("copies")).withColumn("key", F.xxhash64("vec", "own")), "queries")
    n, dims, norm = _extent(few)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashes, probes = _fit(few, asked, n, dims, norm, k)
    index = Index(few, hashes, n)
    cells, out, first = index.rows(few), None, max(1, int(probes * FIRST))
    floor = asked.withColumn("floor", F.lit(float("-inf")))
    for begin, end in ((0, first), (first, probes)):
        if begin == end:
            continue
        parts = cells.groupBy("cell").cogroup(index.asked(floor, begin, end).groupBy("cell")).applyInArrow(_visit(k + 1), f"key long, found {FOUND}")
        out = kept(_merged(parts if out is None else parts.unionByName(out), k + 1), "found")
        least = out.select("key", F.when(F.size("found") > k, F.element_at("found", -1)["score"]).otherwise(float("-inf")).alias("floor"))
        floor = asked.join(least, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    got = asked.join(out, "key", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {FOUND})")))
    rest = got.filter(F.size("found") < F.least(F.lit(k + 1), F.lit(n)))
    if rest.limit(1).count():
        everywhere = rest.select("key", "vec", F.lit(float("-inf")).alias("floor"), F.array(F.lit(0).cast("long")).alias("buckets"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.cells - 1).cast("long"))).alias("cell"))
        all_rows = few.select(F.pmod(F.xxhash64("id"), F.lit(index.cells)).alias("cell"), F.lit(0).cast("long").alias("bucket"), "id", "vec")
        parts = all_rows.groupBy("cell").cogroup(everywhere.groupBy("cell")).applyInArrow(_visit(k + 1), f"key long, found {FOUND}")
        whole = _merged(parts, k + 1).withColumnRenamed("found", "whole")
        got = got.join(whole, "key", "left").withColumn("found", F.coalesce("whole", "found")).drop("whole")
    singles = got.filter(F.col("copies") == 1).select(F.col("own").alias("query_id"), "found", F.col("key").alias("q"))
    group = F.pmod(F.xxhash64("id"), F.lit(COPY_GROUPS)).cast("int")
    shared = got.filter(F.col("copies") > 1).select("vec", "found", "key", F.explode(F.sequence(F.lit(0), F.lit(COPY_GROUPS - 1))).alias("group"))
    several = queries.withColumn("group", group).join(shared, ["vec", "group"]).select(F.col("id").alias("query_id"), "found", F.col("key").alias("q"))
    rank = F.filter("found", lambda x: x["id"] != F.col("query_id"))
    rows_out = singles.unionByName(several).select("query_id", F.posexplode(F.slice(rank, 1, k)).alias("rank", "x"))
    result, _ = written(rows_out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")), "pstable-out")
    for path in paths:
        drop(spark, path)
    return result


def op13_search(vectors: DataFrame) -> DataFrame:
    rows = rows_of(vectors)
    return nearest(rows, rows.filter(F.col("id") % 20 == 0))

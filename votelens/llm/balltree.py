"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors are dealt to shards of about ``SHARD_ROWS`` and queries to blocks of about ``QUERY_ROWS``; each pair of a shard and a
block is one task. It builds the shard's ball tree and visits, for each query, the nodes in the order of their upper bound
q.c + |q| r, until no bound reaches the current k-th score. That score does not start from nothing: a fixed number of vectors
is scored for every query beforehand, and the k-th best of them is a bound that all shards share. The shards' best rows are
merged by a window over k rows of each shard and query.

Rows: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a shorter vector has
zeros at its end; repeated candidates are candidates each, of which k equal ones are kept, for no query can return more; rows
with one id and many vectors are spread over the shards; repeated queries (id and vector equal) are one; a query never finds
rows with its own id; ties go to the smaller id."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.llm.common import share

K = 5
SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Vectors in hash order that give every query its first bound.
SEED_ROWS = 1024
LEAF_ROWS = 128


class BallTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.centers, self.radii, self.least, self.children, self.members = [], [], [], [], []
        self._build(np.arange(len(ids)))
        self.centers, self.radii = np.stack(self.centers), np.asarray(self.radii)

    def _build(self, at: np.ndarray) -> int:
        """Nodes of the rows ``at``; an inner node splits along the line through two far rows, at the median."""
        node, points = len(self.radii), self.rows[at]
        center = points.mean(axis=0)
        far = np.square(points - center).sum(axis=1)
        self.centers.append(center)
        self.radii.append(float(np.sqrt(far.max())))
        self.least.append(int(self.ids[at].min()))
        self.children.append(())
        self.members.append(at)
        if len(at) > LEAF_ROWS and far.max() > 0:
            a = points[far.argmax()]
            b = points[np.square(points - a).sum(axis=1).argmax()]
            order = np.argsort(points @ (b - a), kind="stable")
            half = len(at) // 2
            self.members[node] = None
            self.children[node] = (self._build(at[order[:half]]), self._build(at[order[half:]]))
        return node

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, -id) that reach ``floor``, best first. Scores are whole numbers."""
        best: list[tuple[int, int]] = []  # heap: the worst of the best on top
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            bound = np.floor(-bound)
            if bound < floor or len(best) == k and (bound, -self.least[node]) < best[0]:
                if bound < floor or bound < best[0][0]:
                    break  # all that is left is no better
                continue
            for child in self.children[node]:
                heapq.heappush(queue, (-bounds[child], child))
            if self.children[node]:
                continue
            at = self.members[node]
            scores = self.rows[at] @ query
            good = (scores >= max(floor, best[0][0] if len(best) == k else floor)) & (self.ids[at] != own)
            for s, i in zip(scores[good].tolist(), self.ids[at[good]].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (int(s), -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (int(s), -i))
        return sorted(best, reverse=True)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(int(sizes.max(initial=1)), width or 1)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def usable(vectors: DataFrame, value: Column) -> DataFrame:
    """(id, vec) of the rows that take part; ``value`` is an array of doubles."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), value.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(whole, F.lit(False)))


def _floors(queries: DataFrame, seeds: pa.Table, k: int) -> DataFrame:
    """Adds floor: the k-th best score among the seeds, a score that the result reaches in any case."""
    shared = share(queries.sparkSession, (seeds.column("id").to_numpy(), _matrix(seeds.column("vec"))) if len(seeds) else None)

    def run(batches):
        held = shared()
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            if held is not None and batch.num_rows:
                ids, rows = held
                own, q = batch.column("id").to_numpy(), _matrix(batch.column("vec"), rows.shape[1])
                rows = np.pad(rows, ((0, 0), (0, q.shape[1] - rows.shape[1])))
                scores = np.where(ids[None, :] == own[:, None], -np.inf, q @ rows.T)
                if len(ids) >= k:
                    floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=["id", "vec", "floor"])

    return queries.mapInArrow(run, "id long, vec array<double>, floor double")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for queries and candidates (id, vec) with whole-numbered components."""
    queries = queries.distinct()
    # of equal rows no more than k can be among a query's k best, and rows that share an id go to different shards
    equal = candidates.groupBy("id", "vec").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    candidates = equal.select("id", "vec", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
    shards, blocks = max(1, -(-candidates.count() // shard_rows)), max(1, -(-queries.count() // query_rows))
    seeds = candidates.orderBy(F.xxhash64("id", "vec"), "id", "vec").limit(seed_rows).toArrow()
    asked = _floors(queries, seeds, k).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("cell", F.col("shard") * blocks + F.col("block"))
    held = (candidates.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select("id", "vec", (F.col("shard") * blocks + F.col("block")).alias("cell")))

    def search(rows: pa.Table, asked_here: pa.Table) -> pa.Table:
        query, key, found, score = [], [], [], []
        if len(rows) and len(asked_here):
            q = _matrix(asked_here.column("vec"))
            points = _matrix(rows.column("vec"), q.shape[1])
            q = np.pad(q, ((0, 0), (0, points.shape[1] - q.shape[1])))
            tree = BallTree(rows.column("id").to_numpy(), points)
            bounds = q @ tree.centers.T + np.sqrt(np.square(q).sum(axis=1))[:, None] * tree.radii[None, :]
            bounds += 1e-9 * (1 + np.abs(bounds))  # rounding never hides a row
            floors = asked_here.column("floor").to_numpy()
            for n, own in enumerate(asked_here.column("id").to_numpy().tolist()):
                for s, i in tree.search(own, q[n], bounds[n], k, floors[n]):
                    query.append(own)
                    key.append(n)
                    found.append(-i)
                    score.append(s)
        keys = asked_here.column("key").to_numpy()[np.asarray(key, np.int64)] if key else []
        return pa.table({"query_id": pa.array(query, pa.int64()), "key": pa.array(keys, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    asked = asked.select("id", "vec", "floor", F.xxhash64("vec").alias("key"), "cell")
    best = held.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(search, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_search(vectors: DataFrame) -> DataFrame:
    # floor() turns what is not finite into a number, so those rows are told by the original components
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = usable(vectors.filter(F.coalesce(sound, F.lit(False))), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")))
    return top_k(whole, whole.filter(F.col("id") % 50 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

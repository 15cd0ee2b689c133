"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct 3-, 4- and 5-grams of its lower-cased characters, hashed into buckets. Feature j counts
r_j if present, r_j being the log ratio of the bucket's share among toxic and other texts; the vector has length one, so long
texts are not louder than short ones. A logistic head over these features is fitted to a sample whose size is a parameter.

Rows: null or empty texts get the score of a text without n-grams; repeated rows get equal scores; a doc_id on several rows
is one example, its greatest text, and counts as toxic if one of its labels says so; null labels and labels without a text
are left out. Without examples of both classes every score is the share of toxic examples, 0 if there are none. Inputs of a score: the text alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import id_and_text, id_crc, map_rows, share, slices

#: Lengths of the character n-grams.
ORDERS = (3, 4, 5)
#: Hash buckets (a power of two); models, counts and messages to the driver hold at most one number for each.
BUCKET_BITS = 20
#: Labelled rows of each class, in hash order of their ids, from which the log-count ratios are counted.
RATIO_ROWS = 20_000
#: Of these, rows of each class to which the head is fitted.
FIT_ROWS = 2_000
SMOOTHING = 1.0
PENALTY = 1e-6
STEPS = 150
RATE = 20.0
#: Buckets whose log-count ratio is nearer to zero tell the classes apart too little to count as features.
WEAK = 0.5
THRESHOLD = 0.3


@dataclass
class Model:
    bias: float
    ratio: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # head's weight of each bucket, times the ratio

    def score(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        size = np.sqrt(np.bincount(owner, np.square(self.ratio[bucket], dtype=np.float64), n))
        z = self.bias + np.bincount(owner, self.weight[bucket], n) / np.maximum(size, 1e-9)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs; a space at both ends lets short words have n-grams."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(padded), dtype=np.uint64), [len(t) for t in padded])
    keys, rolled = [], points * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + points[n - 1:]
        if n in ORDERS:
            mixed = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0x94D049BB133111EB + 2 * n)
            inside = owner[:len(mixed)] == owner[n - 1:]
            keys.append((owner[:len(mixed)][inside] << np.uint64(BUCKET_BITS)) | (mixed[inside] >> np.uint64(64 - BUCKET_BITS)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.sort(np.concatenate(keys))
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    return (pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _marked(labels: DataFrame, allowed: Column) -> DataFrame:
    """(doc_id, toxic, h) of the labels that may be used; h is a hash order."""
    return (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.max("toxic").cast("int").alias("toxic")).filter(allowed).withColumn("h", F.xxhash64(F.lit(7), "doc_id")))


def _examples(docs: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of up to ``rows`` labelled ids of each class, the first in hash order. Only ids are ordered; texts stay
    where they are but for the examples'. An id on many rows is one example, which every task reduces to one row first."""
    picked = None
    for toxic in (0, 1):
        one = marked.filter(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(rows)
        picked = one if picked is None else picked.unionByName(one)
    # at most 2 x rows ids: small enough for every executor
    return (id_and_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id")
            .agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold each bucket; bucket -1 counts the texts."""
    held = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    rows = [0, 0]
    for batch in batches:
        for part in slices(batch, limit=1 << 18):
            toxic = part.column("toxic").to_numpy().astype(np.int64)
            owner, bucket = grams(part.column("text").to_pylist())
            for c in (0, 1):
                held[c] += np.bincount(bucket[toxic[owner] == c], minlength=1 << BUCKET_BITS).astype(np.int32)
                rows[c] += int((toxic == c).sum())
    some = np.flatnonzero(held.any(axis=0))
    for a in range(0, len(some), 100_000):
        at = some[a:a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[0, at], pa.int64()), pa.array(held[1, at], pa.int64())], names=["bucket", "clean", "toxic"])
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, *rows)], names=["bucket", "clean", "toxic"])


def _features(strong):
    """The buckets of each text that are features; ``strong`` gives a flag for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = strong()
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                owner, bucket = grams(part.column("text").to_pylist())
                owner, bucket = owner[flags[bucket]], bucket[flags[bucket]]
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], names=["toxic", "buckets"])

    return run


def _head(ends: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, ratio: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Logistic loss with both classes weighing the same, by accelerated descent; the bias then takes the true share.

    Text i has the buckets [ends[i], ends[i + 1]). Texts are passed over in groups, so that nothing but their buckets is held."""
    weigh = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]), 1 << 20)), len(toxic)])
    w = seen = np.zeros(len(ratio))
    bias = bias_seen = 0.0
    for step in range(STEPS):
        slope_bias, slope = 0.0, PENALTY * seen
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = bucket[ends[a]:ends[b]]
            owner = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
            value = ratio[at].astype(np.float64)
            value /= np.maximum(np.sqrt(np.bincount(owner, value * value, b - a)), 1e-9)[owner]
            z = bias_seen + np.bincount(owner, seen[at] * value, b - a)
            error = weigh[a:b] * (1 / (1 + np.exp(-z)) - toxic[a:b])
            slope += np.bincount(at, error[owner] * value, len(ratio))
            slope_bias += error.sum()
        new, new_bias = seen - RATE * slope, bias_seen - RATE * slope_bias
        push = step / (step + 3)
        seen, bias_seen = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias = new, new_bias
    return bias + float(np.log(share / (1 - share))), w


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, ratio_rows: int = RATIO_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Trains on labelled texts whose doc_id meets ``allowed``."""
    marked = _marked(labels, F.lit(True) if allowed is None else allowed)
    counts = (_examples(docs, marked, ratio_rows).mapInArrow(_counts, "bucket long, clean long, toxic long")
              .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow())
    size, empty = 1 << BUCKET_BITS, np.zeros(1 << BUCKET_BITS, np.float32)
    bucket, clean, toxic = (counts.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    n_clean, n_toxic = (int(x[bucket == -1].sum()) for x in (clean, toxic))
    if not n_clean or not n_toxic:
        p = n_toxic / max(1, n_clean + n_toxic)
        return Model(60.0 if p == 1 else -60.0, empty, empty)
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    some = bucket >= 0
    p[bucket[some]] += toxic[some]
    q[bucket[some]] += clean[some]
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
    ratio[((p + q) == 2 * SMOOTHING) | (np.abs(ratio) < WEAK)] = 0  # never seen, or too weak: says nothing
    few = _examples(docs, marked, min(fit_rows, ratio_rows))
    strong = share(docs.sparkSession, ratio != 0)
    rows = few.mapInArrow(_features(strong), "toxic int, buckets array<int>").toArrow().combine_chunks()
    lists = rows.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    toxic_share = marked.agg(F.avg("toxic")).first()[0]
    bias, w = _head(lists.offsets.to_numpy(), lists.values.to_numpy(), rows.column("toxic").to_numpy(), ratio, min(max(toxic_share, 1e-3), 0.999))
    return Model(bias, ratio, (w * ratio).astype(np.float32))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of ``docs``) and score."""
    shared = share(docs.sparkSession, model)  # two numbers for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared()
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                owner, bucket = grams(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(head.score(owner, bucket, part.num_rows))], names=["row", "score"])

    return map_rows(docs, run, "score double")


def trainable() -> Column:
    """Rows from which labels may be learnt."""
    return id_crc() % 4 != 2


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, trainable())
    return (scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
            .select("doc_id", (~trainable()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))

"""SimHash near-dedup with deletion variants.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four bits, some segment differs in at
most one, so both have an equal variant of that segment with one bit deleted. All 64 variants of each distinct fingerprint are
indexed, fingerprints with an equal variant meet, and their distance is verified. A bucket of equal variants returns a
spanning forest of its links, not its pairs: at most one link fewer than it has members, whatever the group of copies. Buckets
of more than ``BLOCK`` members are dealt to pairs of blocks, so no task holds more than two blocks. Links are contracted to
components over written tables.

Fingerprints: A-Z lower-cased; words ``[^\\x20\\x09-\\x0D]+``; ``WORDS``-word shingles with repeats, joined by a space; a shorter
text is one shingle, a text without words has fingerprint zero. A bit is 1 if set in over half of the shingles' XXH64 (seed 42).

Rows: null and empty texts have fingerprint zero and are linked like others; repeated rows share a fingerprint; a null doc_id
takes part but names a component only if no other id does (the component's id is then null)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelens.llm.common import drop, id_and_text, map_rows, ranges, slices, written

WORDS, SEED, DISTANCE = 4, 42, 4
#: First bit of each segment, and the end.
CUTS = (0, 21, 42, 64)
#: Members of a bucket that a task compares with each other.
BLOCK = 4096
#: Buckets up to this size return their links themselves.
SMALL = 8


def fingerprint_values(texts: list[str]) -> np.ndarray:
    """Unsigned fingerprints of texts."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        joined, n = b" ".join(words), len(words)
        if n < WORDS:
            sizes.append(min(n, 1))
            if n:
                hashes.append(digest(joined, SEED))
            continue
        ends = list(accumulate([len(w) + 1 for w in words]))
        hashes += [digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[WORDS - 1:])]
        sizes.append(n - WORDS + 1)
    sizes, out = np.asarray(sizes, np.int64), np.zeros(len(texts), np.uint64)
    some = sizes > 0
    if some.any():
        bits = np.unpackbits(np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprint_values(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(variant, fp): each fingerprint with each bit of its three segments deleted."""
    segments = []
    for low, end in zip(CUTS, CUTS[1:]):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (end - low)) - 1))
        for bit in range(end - low):
            segments.append(value.bitwiseAND(F.lit(((1 << (end - low)) - 1) & ~(1 << bit))) + F.lit((low + bit) << 32))
    return distinct.select(F.explode(F.array(*segments)).alias("variant"), "fp")


def _forest(fps: np.ndarray) -> np.ndarray:
    """For each member the first one that links reach within the bucket."""
    root, left = np.full(len(fps), -1, np.int64), np.arange(len(fps))
    while len(left):
        first, todo = left[0], [left[0]]
        root[first], left = first, left[1:]
        while todo and len(left):
            near = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                root[found] = first
                todo += found.tolist()
    return root


def _links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
    """Links within buckets [start, end): all of a small bucket's, a spanning forest's of a larger one."""
    out, sizes = [], ends - starts
    for d in range(1, SMALL):
        some = (sizes > d) & (sizes <= SMALL)
        at = ranges(starts[some], sizes[some] - d)
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= DISTANCE]
        out.append(np.stack([fps[near], fps[near + d]], axis=1))
    for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        root = _forest(fps[s:e])
        tied = root != np.arange(e - s)
        out.append(np.stack([fps[s:e][root[tied]], fps[s:e][tied]], axis=1))
    pairs = np.sort(np.concatenate(out).view(np.int64), axis=1)
    if not len(pairs):
        return None
    pairs = np.unique(pairs, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "block"])


def _bucket_links(block: int):
    """Over rows (bucket, fp) sorted by bucket: links (a, b, null). A bucket with more than ``block`` rows is handed on as
    (bucket, fp, number of its block), to be linked block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, passed = None, [], 0  # the last bucket seen, its rows not yet dealt with, how many have been handed on

        def hand_on(key: int, fps: np.ndarray, before: int) -> pa.RecordBatch:
            number = (before + np.arange(len(fps))) // block
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), key)), pa.array(fps), pa.array(number)], names=["a", "b", "block"])

        def close() -> pa.RecordBatch | None:
            fps = np.concatenate(held) if held else np.zeros(0, np.int64)
            if not len(fps):
                return None
            if passed:
                return hand_on(bucket, fps, passed)
            return _links(fps.view(np.uint64), np.zeros(1, np.int64), np.array([len(fps)]))

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            if bucket != keys[0]:
                if (out := close()) is not None:
                    yield out
                bucket, held, passed = keys[0], [], 0
            held.append(fps[:ends[0]])
            if len(starts) > 1:
                if (out := close()) is not None:
                    yield out
                whole = slice(1, len(starts) - 1)
                fits = ends[whole] - starts[whole] <= block
                if fits.any() and (out := _links(fps.view(np.uint64), starts[whole][fits], ends[whole][fits])) is not None:
                    yield out
                for s, e in zip(starts[whole][~fits], ends[whole][~fits]):
                    yield hand_on(keys[s], fps[s:e], 0)
                bucket, held, passed = keys[starts[-1]], [fps[starts[-1]:]], 0
            if sum(map(len, held)) > block:
                rows = np.concatenate(held)
                yield hand_on(bucket, rows, passed)
                held, passed = [], passed + len(rows)
        if (out := close()) is not None:
            yield out

    return run


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs within the distance. Written."""
    spark = distinct.sparkSession
    found, path = written(variants(distinct).repartition("variant").sortWithinPartitions("variant", "fp")
                          .mapInArrow(_bucket_links(block), "a long, b long, block long"), "simhash-links")
    pairs = found.filter("block IS NULL").select("a", "b")
    large = found.filter("block IS NOT NULL")
    if not large.isEmpty():
        blocks = large.groupBy("a").agg((F.max("block") + 1).alias("n"))
        dealt = (large.join(blocks, "a").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
                 .select(F.xxhash64("a", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), F.col("b").alias("fp")))
        more = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_bucket_links(4 * block), "a long, b long, block long")
        pairs = pairs.unionByName(more.select("a", "b"))
    out, _ = written(pairs.distinct(), "simhash-pairs")
    drop(spark, path)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``pairs``: each round hooks every node to its least neighbour's least neighbour and
    contracts, until no link is left. One written table a round; a hub's links are split by adaptive execution."""
    spark = pairs.sparkSession
    edges, labels, edge_path, label_path = pairs, None, None, None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hook, hook_path = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "component-hooks")
        onward = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump, jump_path = written(hook.join(onward, "p").select(F.col("u").alias("node"), F.col("pp").alias("root")), "component-jumps")
        drop(spark, hook_path)
        if labels is None:
            new = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            new = moved
        new, new_path = written(new, "component-labels")
        to_a, to_b = (jump.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        rest = edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest, rest_path = written(rest, "component-edges")
        for old in (jump_path, label_path, edge_path):
            if old:
                drop(spark, old)
        edges, edge_path, labels, label_path = rest, rest_path, new, new_path
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")


def classes(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, component_id, head_fp) for each distinct fingerprint of ``prints`` (doc_id, fp): the least doc_id that links
    reach, and the least fingerprint that this document has in the component."""
    reps, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    rooted = (reps.join(components(links(reps.select("fp"), block)).withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    head = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp"))
    heads = rooted.groupBy("root").agg(head.alias("h")).select("root", F.col("h.low").alias("component_id"), F.col("h.fp").alias("head_fp"))
    return rooted.join(heads, "root").select("fp", "component_id", "head_fp")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id, head_fp: one row for each row of ``docs``."""
    prints, _ = written(fingerprints(docs), "simhash-prints")
    return prints.join(classes(prints, block), "fp")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one that gives the component its id."""
    key = F.xxhash64(F.col("id").isNull(), "id", "fp")  # one column, so that join and window share one exchange
    heads = (near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("head_fp")))
             .select(F.col("doc_id").alias("id"), "fp").distinct().select(key.alias("key"), F.col("id").alias("_id"), F.col("fp").alias("_fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprint_values(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fp.view(np.int64))], names=["row", "fp"])

    rows = map_rows(docs, run, "fp long").withColumn("id", F.col("row.doc_id").cast("long")).withColumn("key", key)
    kept = rows.join(heads.hint("shuffle_hash"), (rows["key"] == heads["key"]) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")
    one = Window.partitionBy("key", "id", "fp").orderBy(F.xxhash64("row.text"))
    return kept.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")


def op4_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

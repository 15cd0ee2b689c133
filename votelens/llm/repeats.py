"""Repeated byte strings by enhanced suffix arrays over sampled suffixes.

Sampling: of the ``GRAM``-byte grams inside every ``min_bytes``-byte window the one with the least hash (the last of equals) is
the window's anchor. Two equal windows have their anchors at the same offset, so a window is repeated only if it is repeated
around an equal anchor, and only suffixes at anchors need sorting: about two for each ``min_bytes - GRAM`` bytes.

Buckets: the occurrences of one anchor gram. The hull of an occurrence is all the text that its windows cover on both sides.
Occurrences with equal hulls repeat each other whole; of these one stands for all, so exact copies leave the bucket at once.
The hulls that are left, of occurrences that differ from all others somewhere, are sorted by what follows the anchor; a scan of
the common prefix lengths with a stack yields the interval tree of the suffixes that share a prefix. In each interval the
left contexts are compared in their own sorted order: where they diverge ends the repeat on the left, as the interval's depth
ends it on the right. Each run that stays together for at least ``min_bytes`` in all is a maximal repeat, and all its members
are returned as occurrences.

A bucket of more than ``BUCKET_BYTES`` of distinct hulls is not held: its windows are hashed one by one and counted, which
finds the same positions with any number of tasks.

Rows: null and empty texts hold nothing; texts shorter than ``min_bytes`` have no repeats; repeated rows repeat each other; rows
are told apart by doc_id and text, a null doc_id being an id of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.llm.common import id_and_text, slices, text_key, utf8, written

MIN_BYTES, GRAM = 400, 128
BUCKET_BYTES = 32 << 20
#: Spans in a row at most.
SPANS = 4096
_PLACE_BITS = 28  # a text may hold 256 MB
_ODD = 0x9E3779B97F4A7C15
_SPAN = ["doc_id", "text_key", "start", "end"]
_OCCURRENCE = ["anchor", "hull", "doc_id", "text_key", "at", "low", "high"]


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


class Roller:
    """Hashes of all ``GRAM``-byte grams of an array: a windowed sum of bytes times inverse powers, times a power."""

    def __init__(self):
        self.values, self.up, self.down = _byte_values(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            n = len(data)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _ODD, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_ODD, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.down[:len(data)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * self.up[:len(data) - GRAM + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, at: np.ndarray, min_bytes: int, roller: Roller) -> tuple[np.ndarray, ...]:
    """Anchor places, first and last window start of each, hash of each; for texts [at[i], at[i + 1]) of ``data``."""
    span = min_bytes - GRAM + 1  # grams in a window
    if len(data) < min_bytes:
        return (np.zeros(0, np.int64),) * 4
    h = roller.grams(data)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    best = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    covered = 1
    while covered < span:
        step = min(covered, span - covered)
        best = np.minimum(best[:-step], best[step:])
        covered += step
    place = (mask - (best & mask)).astype(np.int64)  # of each window
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(owner[:len(place)] == owner[min_bytes - 1:])
    place = place[start]
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[start[1:]] != owner[start[:-1]])])
    return place[new], start[new], start[np.r_[new[1:], len(start)] - 1], h[place[new]].view(np.int64)


def occurrences(docs: DataFrame, min_bytes: int) -> DataFrame:
    """A row for each hull and slice of texts: its anchor gram's hash, its hash, how often it occurs in the slice, and for the
    first time its place and first and last window start (in the text). A hull that occurs again in the slice brings the
    spans of all its occurrences, overlapping ones merged, so a line that a text repeats a thousand times is one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, digest = Roller(), xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch):
                data, at = utf8(part.column("text"))
                place, low, high, gram = anchors(data, at, min_bytes, roller)
                row = np.searchsorted(at, place, "right") - 1
                begin = np.maximum(place - (min_bytes - GRAM), at[row])
                end = np.minimum(place + min_bytes, at[row + 1])
                whole, groups = data.tobytes(), {}
                for i, (b, e, p) in enumerate(zip(begin.tolist(), end.tolist(), place.tolist())):
                    groups.setdefault(digest(whole[b:e], p - b), []).append(i)
                base, first, hulls, counts, ends, spans = at[row], [], [], [], [0], []
                for hull, group in groups.items():
                    merged: list[list[int]] = []
                    for i in group if len(group) > 1 else ():
                        start, stop = int(low[i] - base[i]), int(high[i] - base[i]) + min_bytes
                        if merged and merged[-1][0] == row[i] and start <= merged[-1][2]:
                            merged[-1][2] = stop
                        else:
                            merged.append([int(row[i]), start, stop])
                    for a in range(0, max(1, len(merged)), SPANS):
                        first.append(group[0])
                        hulls.append(hull)
                        counts.append(0 if a else len(group))
                        spans += merged[a:a + SPANS]
                        ends.append(len(spans))
                first = np.asarray(first, np.int64)
                held = np.asarray(spans, np.int64).reshape(-1, 3)
                ids, keys = part.column("doc_id"), part.column("text_key")
                of = pa.array(held[:, 0])
                fields = pa.StructArray.from_arrays([ids.take(of), keys.take(of), pa.array(held[:, 1]), pa.array(held[:, 2])], names=_SPAN)
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[first]), pa.array(hulls, pa.binary()), ids.take(take), keys.take(take),
                     *[pa.array((x - base)[first]) for x in (place, low, high)], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)],
                    names=[*_OCCURRENCE, "times", "spans"])

    keyed = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    return keyed.mapInArrow(run, "anchor long, hull binary, doc_id long, text_key long, at long, low long, high long, times long, "
                                 "spans array<struct<doc_id: long, text_key: long, start: long, end: long>>")


def _padded(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width), np.array([len(r) for r in rows], np.int64))


def _sorted_prefixes(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix length of each with the next in order."""
    order = np.array(sorted(range(len(rows)), key=rows.__getitem__), np.int64)
    held, sizes = _padded(rows, width)
    held, sizes = held[order], sizes[order]
    differ = held[1:] != held[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of all nodes of the common-prefix interval tree, by a scan with a stack."""
    stack: list[tuple[int, int]] = []  # depth, first
    for i, depth in enumerate([*common.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def bucket_repeats(left: list[bytes], right: list[bytes], min_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeats through an anchor: members, how far each goes to the left with another member, how far all go right.

    ``left`` holds reversed contexts before the anchor, ``right`` what begins at it."""
    order, common = _sorted_prefixes(right, min_bytes)
    left_order, left_common = _sorted_prefixes(left, min_bytes - GRAM)
    rank = np.empty(len(left), np.int64)
    rank[left_order] = np.arange(len(left))
    for depth, first, last in intervals(common):
        ranks = np.sort(rank[order[first:last + 1]])
        shared = np.minimum.reduceat(left_common[:ranks[-1]], ranks[:-1])
        reach = np.maximum(np.r_[0, shared], np.r_[shared, 0])
        far = reach + depth >= min_bytes
        if far.any():
            yield left_order[ranks[far]], reach[far], depth


def _fetch(docs: DataFrame, heads: DataFrame, min_bytes: int) -> DataFrame:
    """Adds to each occurrence the bytes of its hull; every text is asked once for all its occurrences."""
    asked = (heads.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "at", "low", "high", "lone")).alias("asked"))
             .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "asked"))
    texts = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    joined = texts.join(asked.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "asked")
    names = ["anchor", "doc_id", "text_key", "at", "low", "high", "lone", "before", "hull"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, starts = utf8(part.column("text"))
                asked = part.column("asked")
                row = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                got = asked.flatten()
                at = got.field("at").to_numpy()
                begin, end = np.maximum(at - (min_bytes - GRAM), 0), np.minimum(at + min_bytes, np.diff(starts)[row])
                whole, base = data.tobytes(), starts[:-1][row]
                hulls = [whole[b:e] for b, e in zip((base + begin).tolist(), (base + end).tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [got.field("anchor"), part.column("doc_id").take(take), part.column("text_key").take(take), *[got.field(c) for c in ("at", "low", "high", "lone")],
                     pa.array(at - begin), pa.array(hulls, pa.binary())], names=names)

    return joined.mapInArrow(run, "anchor long, doc_id long, text_key long, at long, low long, high long, lone boolean, before long, hull binary")


def _bucket_spans(min_bytes: int, bucket_bytes: int):
    """Over hulls sorted by anchor: spans (window null), or for an outsized bucket its windows, each with its hash."""
    names, kinds = ["repeat", "doc_id", "text_key", "start", "end", "window"], [pa.int64()] * 5 + [pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, short_digest = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        held: list[tuple] = []
        size, over = 0, False  # of the bucket at hand: bytes held, whether some of it has gone out as windows
        out: list[tuple] = []

        def close() -> None:
            if over:
                windows()
            elif len(held) > 1:
                left = [h[8][:h[7]][::-1] for h in held]
                right = [h[8][h[7]:] for h in held]
                for members, reach, depth in bucket_repeats(left, right, min_bytes):
                    for m, r in zip(members.tolist(), reach.tolist()):
                        _, doc, key, at, _, _, _, before, hull = held[m]
                        name = short_digest(hull[before - r:before + depth]) - (1 << 63)
                        out.append((name, doc, key, at - r, at + depth, None))

        def windows() -> None:
            for _, doc, key, at, low, high, _, before, hull in held:
                for start in range(low, high + 1):
                    b = before - (at - start)
                    out.append((None, doc, key, start, start + min_bytes, digest(hull[b:b + min_bytes])))

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema=schema)
            out.clear()
            return got

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if held and row[0] != held[-1][0]:
                    close()
                    held, size, over = [], 0, False
                held.append(row)
                size += len(row[8])
                if size > bucket_bytes:
                    windows()
                    held, size, over = [row[:8] + (b"",)], 0, True
                    held[0] = (row[0], row[1], row[2], row[3], 0, -1, row[6], row[7], b"")  # keeps the bucket's anchor, without windows
                if len(out) > 20_000:
                    yield flush()
        if held:
            close()
        if out:
            yield flush()

    return run


def _judged(docs: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of :func:`occurrences` whose hull or anchor occurs again: repeat, equal (occurrences with this hull) and head
    (whether this row stands for its hull in a bucket of several hulls)."""
    by_anchor, by_hull = Window.partitionBy("anchor"), Window.partitionBy("anchor", "hull")
    return (occurrences(docs, min_bytes).repartition("anchor")
            .withColumn("n", F.row_number().over(by_hull.orderBy(F.col("times") == 0, "doc_id", "text_key", "at"))).withColumn("equal", F.sum("times").over(by_hull))
            .withColumn("several", F.min("hull").over(by_anchor) != F.max("hull").over(by_anchor))
            .filter("equal > 1 OR several")
            .select(F.xxhash64("anchor", "hull").alias("repeat"), *[c for c in _OCCURRENCE if c != "hull"], "spans", "equal", (F.col("several") & (F.col("n") == 1)).alias("head")))


def repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(repeat, doc_id, text_key, start, end): occurrences of repeated strings, in bytes; rows with one ``repeat`` are one group;
    occurrences of it that overlap in a text may come as one row, from the first start to the last end.
    The union of all rows covers every byte of every string of ``min_bytes`` bytes that starts in more than one place."""
    judged, _ = written(_judged(docs, min_bytes), "repeat-anchors")
    alone = F.array(F.struct("doc_id", "text_key", F.col("low").alias("start"), (F.col("high") + min_bytes).alias("end")))
    whole = judged.filter("equal > 1").select("repeat", F.explode(F.when(F.size("spans") > 0, F.col("spans")).otherwise(alone)).alias("s")).select("repeat", "s.*")
    heads = judged.filter("head").withColumn("lone", F.col("equal") == 1)
    fetched = _fetch(docs, heads, min_bytes).repartition("anchor").sortWithinPartitions("anchor")
    spans, _ = written(fetched.mapInArrow(_bucket_spans(min_bytes, bucket_bytes), "repeat long, doc_id long, text_key long, start long, end long, window binary"), "repeat-spans")
    every = whole.unionByName(spans.filter("window IS NULL").drop("window"))
    counted = spans.filter("window IS NOT NULL")
    if not counted.isEmpty():
        often = counted.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
        every = every.unionByName(counted.join(often, "window").select(F.xxhash64("window").alias("repeat"), "doc_id", "text_key", "start", "end"))
    return every


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """row (the columns of ``docs`` but text), n_bytes, n_removed, n_spans, kept (the bytes left)."""
    spans = (repeat_groups(docs, min_bytes).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
             .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key"))
    joined = rows.join(spans.hint("shuffle_hash"), same, "left").select("row", "text", "spans")
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, removed, counts, kept = [], [], [], []
                data, at = utf8(part.column("text"))
                whole, lists = data.tobytes(), part.column("spans")
                for i in range(part.num_rows):
                    text, runs = whole[at[i]:at[i + 1]], []
                    if lists[i].is_valid:
                        found = lists[i].values
                        pairs = np.stack([found.field("start").to_numpy(), found.field("end").to_numpy()], axis=1)
                        for s, e in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                            if runs and s <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], e)
                            else:
                                runs.append([s, e])
                    sizes.append(len(text))
                    removed.append(sum(e - s for s, e in runs))
                    counts.append(len(runs))
                    edges = [0, *[x for run in runs for x in run], len(text)]
                    kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(x, pa.int64()) for x in (sizes, removed, counts)], pa.array(kept, pa.binary())], names=names)

    return joined.mapInArrow(run, T.StructType([rows.schema["row"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary").fields]))


def op3_repeats(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Line dedup: hashes of line keys are range-partitioned and sorted by document and position; the stream of each partition
keeps the first document of every key and returns, for each document that loses lines, a compressed bitmap of what it keeps.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points found
in at least ``min_docs`` documents lose all their lines except those in the largest doc_id holding the key, which comes first
in the stream. The ranges cut through documents and positions too, so one key may fill many partitions. A partition cannot
judge the keys at its two ends, nor keys with more rows than ``BUFFER``; it hands their rows on, and those few keys are judged
by an aggregate over their rows.

Rows: a null or empty text is one empty line; rows with one doc_id are one document (repeated rows lose the same lines); a
null doc_id is a document below all others."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.llm.common import drop, id_and_text, slices, text_key, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Rows of one key that a partition holds back before it hands the key on.
BUFFER = 100_000
#: Keys judged late that are sent to all tasks; more are joined by an exchange.
BROADCAST_ROWS = 100_000
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, line): one row for each line whose key is long enough; 128-bit hashes of keys."""
    names = ["h1", "h2", "doc_id", "text_key", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch):
                hashes, rows, places = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    for place, line in enumerate(text.split("\n")):
                        if len(line) >= min_chars and len(key := line.strip(BLANKS)) >= min_chars:
                            hashes.append(digest(key.encode("utf-8", "surrogatepass").lower()))
                            rows.append(row)
                            places.append(place)
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), part.column("doc_id").take(at), part.column("text_key").take(at), pa.array(places, pa.int32())], names=names)

    keyed = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    return keyed.mapInArrow(run, "h1 long, h2 long, doc_id long, text_key long, line int")


def _stream(min_docs: int):
    """Judges the keys of a sorted partition; rows of keys that may go on elsewhere come out as open."""
    names = ["h1", "h2", "doc_id", "text_key", "line", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows_held, first_key, last_open = 0, None, None

        def judged(rows: np.ndarray, ended: bool) -> pa.RecordBatch | None:
            """rows: whole keys, but for the first key of the partition, the last one (unless ``ended``) and overlong ones."""
            nonlocal first_key, last_open
            if not len(rows):
                return None
            new = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            doc = new | np.r_[True, rows[1:, 2] != rows[:-1, 2]]
            docs = np.add.reduceat(doc.astype(np.int64), starts)
            is_open = np.zeros(len(starts), bool)
            keys = rows[starts, :2]
            if first_key is None:
                first_key = tuple(keys[0])
            is_open[0] = tuple(keys[0]) in (first_key, last_open)
            if not ended:
                is_open[-1] = True
                last_open = tuple(keys[-1])
            lost = (docs[group] >= min_docs) & (rows[:, 2] != rows[starts, 2][group]) & ~is_open[group]
            out = rows[lost | is_open[group]]
            flag = is_open[group][lost | is_open[group]]
            return pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(4)] + [pa.array(out[:, 4].astype(np.int32)), pa.array(flag)], names=names)

        for batch in batches:
            cols = [batch.column("h1"), batch.column("h2"), batch.column("doc_id").fill_null(NO_ID), batch.column("text_key"), batch.column("line")]
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols], axis=1)
            if not len(rows):
                continue
            change = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))
            if held and (rows[0, 0], rows[0, 1]) != (held[-1][-1, 0], held[-1][-1, 1]):
                cut = 0
            else:
                cut = int(change[0]) + 1 if len(change) else len(rows)
            # what is held is one key; it ends at cut if that lies inside this batch
            held.append(rows[:cut])
            rows_held += cut
            if cut == len(rows):
                if rows_held > BUFFER:
                    if (out := judged(np.concatenate(held), False)) is not None:
                        yield out
                    held, rows_held = [], 0
                continue
            last = int(change[-1]) + 1 if len(change) and change[-1] + 1 > cut else cut
            whole = np.concatenate([*held, rows[cut:last]])
            if (out := judged(whole, True)) is not None:
                yield out
            held, rows_held = [rows[last:]], len(rows) - last
        if held and (out := judged(np.concatenate(held), False)) is not None:
            yield out

    return run


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, line) of the lines to drop. Runs two jobs; their tables are small against the texts."""
    spark = docs.sparkSession
    hashed, path = written(line_hashes(docs, min_chars), "line-hashes")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "text_key", "line"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    judged, _ = written(hashed.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .mapInArrow(_stream(min_docs), "h1 long, h2 long, doc_id long, text_key long, line int, open boolean"), "line-verdicts")
    drop(spark, path)
    still = judged.filter("open")
    verdict = (still.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
               .agg(F.count("one").alias("docs"), F.max("doc_id").alias("top")).filter(F.col("docs") >= min_docs))
    verdict, _ = written(verdict, "line-open-keys")
    # keys cut by a partition's end, two at most for each, and overlong ones: as a rule few enough to send to all tasks
    verdict = F.broadcast(verdict) if verdict.count() <= BROADCAST_ROWS else verdict
    late = still.join(verdict, ["h1", "h2"]).filter(F.col("doc_id") != F.col("top"))
    both = judged.filter("NOT open").select("doc_id", "text_key", "line").unionByName(late.select("doc_id", "text_key", "line"))
    return both.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, kept): for each document that loses lines, a deflated bitmap with a 1 for each line kept, up to
    the last line lost; text_key (xxhash64 of the text) tells rows of one doc_id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lost in batch.column("lost"):
                at = lost.values.to_numpy()
                keep = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)  # whole bytes: lines past the last one lost stay
                keep[at] = 0
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "kept"])

    lost = lost_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_key").agg(F.collect_list("line").alias("lost"))
    return lost.mapInArrow(run, "doc_id long, text_key long, kept binary")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """row (the columns of ``docs`` but text), kept_text, n_lines and n_dropped, after applying the bitmaps."""
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key"))
    joined = rows.join(maps.hint("shuffle_hash"), same, "left").select("row", "text", "kept")
    names = ["row", "kept_text", "n_lines", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, lines, dropped = [], [], []
                for text, kept in zip(part.column("text").to_pylist(), part.column("kept").to_pylist()):
                    lines.append(text.count("\n") + 1)
                    if kept is not None:
                        every = text.split("\n")
                        keep = np.unpackbits(np.frombuffer(zlib.decompress(kept), np.uint8), bitorder="little")
                        stay = [x for x, k in zip(every, keep) if k] + every[len(keep):]
                        text = "\n".join(stay)
                    dropped.append(0 if kept is None else len(every) - len(stay))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    return joined.mapInArrow(run, T.StructType([rows.schema["row"], *T._parse_datatype_string("kept_text string, n_lines long, n_dropped long").fields]))


def op7_lines(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))

"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; a benchmark window is ``WINDOW`` consecutive
words of an item, or the whole item if it is shorter. Of every ``WINDOW - GRAM + 1`` neighbouring word ``GRAM``-grams the one
with the least hash (the last of equals) is a fingerprint, so two texts that share a window share a fingerprint in it.
Fingerprints of documents are joined with those of the benchmark; a hit is extended to the windows around it, each compared
word by word, and overlapping windows merge into spans of contaminated words. Items with fewer words than a window have no
such guarantee; documents are searched for all their runs of those few lengths.

The benchmark goes to every executor in parts of at most ``PART_BYTES`` of text, one pass over the documents for each part, so
a benchmark of any size is handled; documents are never shuffled while it fits in one part.

Rows: null or empty texts have no words and no hits; repeated documents get equal results; items with equal texts are all
named; repeated item_ids count once; an item with a null id makes words contaminated but is not named."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import batch_of, map_rows, ranges, share, slices, utf8

WINDOW, GRAM = 13, 5
PART_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * _MIX


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the row of each."""
    data, at = utf8(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    inside = _IS_WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    opens[first] = inside[first]  # words end where a text ends
    held = data[inside].astype(np.uint64)
    starts = np.flatnonzero(opens[inside])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(held)])
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()) - 1, 0x100000001B3, np.uint64)], dtype=np.uint64)
    place = np.arange(len(held)) - np.repeat(starts, lengths)
    hashes = _mixed(np.add.reduceat((held + np.uint64(1)) * powers[place], starts))
    return hashes, np.searchsorted(at, np.flatnonzero(opens), "right") - 1


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B1) + words[i:len(words) - n + 1 + i]
    return _mixed(h)


def fingerprints(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed grams: their first words' places and their hashes."""
    grams = run_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = grams, np.arange(len(grams))
    covered = 1
    while covered < WINDOW - GRAM + 1:
        step = min(covered, WINDOW - GRAM + 1 - covered)
        later = best[step:] <= best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        covered += step
    at = np.unique(at[:n][row[:n] == row[WINDOW - 1:]])
    return at, grams[at]


@dataclass
class Windows:
    """The distinct windows of one length: hashes in order, where each one's words are, and the items that hold it."""
    n: int
    hashes: np.ndarray
    words_at: np.ndarray
    item_from: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(words: np.ndarray, starts: np.ndarray, item: np.ndarray, n: int) -> Windows:
        h = run_hashes(words, n)[starts]
        order = np.lexsort((item, h))
        h, starts, item = h[order], starts[order], item[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        return Windows(n, h[new], starts[new], np.r_[np.flatnonzero(new), len(h)], item)

    def match(self, words: np.ndarray, own: np.ndarray, starts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``starts`` those at which a window occurs, and which one; compared word by word."""
        starts = starts[starts + self.n <= len(own)]
        starts = starts[row[starts] == row[starts + self.n - 1]]
        if not len(starts) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(len(starts), np.uint64)
        for i in range(self.n):
            h = h * np.uint64(0x9E3779B1) + own[starts + i]
        h = _mixed(h)
        which = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[which] == h
        starts, which = starts[same], which[same]
        for i in range(self.n):
            same = own[starts + i] == words[self.words_at[which] + i]
            starts, which = starts[same], which[same]
        return starts, which


@dataclass
class Index:
    """One part of the benchmark."""
    words: np.ndarray
    ids: list[str | None]
    prints: np.ndarray
    full: Windows
    short: list[Windows]

    @staticmethod
    def of(rows: list[tuple[str | None, str]]) -> Index:
        words, item = word_hashes(pa.array([t for _, t in rows], pa.string()))
        sizes = np.bincount(item, minlength=len(rows))
        begins = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        at = np.arange(max(0, len(words) - WINDOW + 1))
        at = at[item[at] == item[at + WINDOW - 1]] if len(at) else at
        short = []
        for n in range(1, WINDOW):
            some = np.flatnonzero(sizes == n)
            if len(some):
                short.append(Windows.of(words, begins[some], some, n))
        return Index(words, [i for i, _ in rows], np.unique(fingerprints(words, item)[1]), Windows.of(words, at, item[at] if len(at) else at, WINDOW), short)

    def hits(self, own: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, list[set[str]]]:
        """For each word whether a window covers it; for each text the items whose windows occur."""
        cover = np.zeros(len(own) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(rows)]

        def take(windows: Windows, starts: np.ndarray) -> None:
            starts, which = windows.match(self.words, own, starts, row)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + windows.n, -1)
            pairs = np.unique(np.stack([row[starts], which]), axis=1)
            begin, end = windows.item_from[pairs[1]], windows.item_from[pairs[1] + 1]
            for r, i in zip(np.repeat(pairs[0], end - begin), windows.items[ranges(begin, end - begin)]):
                if self.ids[i] is not None:
                    found[r].add(self.ids[i])

        at, prints = fingerprints(own, row)
        at = at[np.isin(prints, self.prints)]
        around = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
        take(self.full, around[around >= 0])
        for windows in self.short:
            h = run_hashes(own, windows.n)
            take(windows, np.flatnonzero(np.isin(h, windows.hashes)))
        return np.cumsum(cover[:-1]) > 0, found


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's rows, dealt so that each part holds about PART_BYTES at most (one longer item stands alone)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = -(-2 * (size[0] or 0) // PART_BYTES) if (size[0] or 0) > PART_BYTES else 1
    for i in range(n):
        mine = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r.id, r.text) for r in mine.collect()]


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), n_words, n_hit, items (ids as strings, sorted), hit_words (a packed bit for each word)."""
    spark = docs.sparkSession
    schema = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_words", pa.binary())])

    def one_pass(frame: DataFrame, index: Index, first: bool) -> DataFrame:
        shared = share(spark, index)  # at most PART_BYTES of text or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part_of = shared()
            for batch in batches:
                for part in slices(batch):
                    own, row = word_hashes(part.column("text"))
                    hit, found = part_of.hits(own, row, part.num_rows)
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                    if not first:  # join what the passes before have found
                        before = [pc.struct_field(part.column("row"), c).to_pylist() for c in ("hit_words", "items")]
                        for r, (bits, items) in enumerate(zip(*before)):
                            a, b = ends[r], ends[r + 1]
                            hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                            found[r].update(items)
                    packed = [np.packbits(hit[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                    got = batch_of(schema, np.diff(ends), np.bincount(row, hit, part.num_rows).astype(np.int64), [sorted(f) for f in found], packed)
                    yield pa.RecordBatch.from_arrays([part.column("row"), *got.columns], names=["row", *schema.names])

        if first:
            return map_rows(frame, run, fields)
        nested = frame.select("row", "hit_words", "items", F.col("row.text").alias("text"))
        return map_rows(nested, run, fields).select(F.col("row.row").alias("row"), *schema.names)

    fields, out = "n_words long, n_hit long, items array<string>, hit_words binary", docs
    for i, rows in enumerate(_parts(benchmark)):
        out = one_pass(out, Index.of(rows), i == 0)
    return out


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return marked(docs.select("doc_id", "text"), benchmark).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))

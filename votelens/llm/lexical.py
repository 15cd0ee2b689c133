"""Ranked lexical search by scanning the documents with an automaton of the items' terms.

An Aho-Corasick automaton holds every distinct term of the items between two guards (the byte that stands for whatever separates
terms), so one run over a text counts each term's whole occurrences; there is no index of documents. The first run over the texts
gives the statistics (documents and lengths, and how many documents hold each term of the items), the second scores: what a term
adds to a document goes to the items that its automaton output maps to, with the term's repeats in the item. A task keeps the K
best documents of each item; a window over groups of tasks, then one over those groups, makes the final ranks.

Items go to the tasks in parts of at most ``PART_BYTES`` of text (one longer item stands alone), each part with its own automaton
and its own two runs, so any number of items is served. Scores are whole numbers, summed as 64-bit integers.

Rows: a null text has no terms; a document row is ranked by itself, repeated or not; a null doc_id comes after all others among equal
scores; equal items (id and text) count once, other items of one id each have ranks of their own; an item without terms, or whose
terms no document holds, has no rows; no documents or no items give no rows. Other columns are not read."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.llm.common import ranges, share, slices, utf8

K = 20
PART_BYTES = 4 << 20
#: (document, item) sums held at once, and groups of tasks whose best rows meet first.
PAIRS, TASK_GROUPS = 1 << 20, 64

_GUARD = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _GUARD[_a:_b] = np.arange(_a, _b)
_GUARD[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_GUARD.tobytes()).split()


class Automaton:
    """The terms of some items, what maps them to the items, and a scan that counts them in texts."""

    def __init__(self, items: list[list[bytes]]):
        self.items = len(items)
        numbers: dict[bytes, int] = {}
        rows = sorted((numbers.setdefault(t, len(numbers)), i, n) for i, words in enumerate(items) for t, n in Counter(words).items())
        term, self.item, self.repeats = np.array(rows, np.int64).reshape(-1, 3).T
        self.terms = len(numbers)
        self.item_from = np.searchsorted(term, np.arange(self.terms + 1))
        self.tree = ahocorasick.Automaton()
        for t, i in numbers.items():
            self.tree.add_word(f" {t.decode('latin-1')} ", i)
        if numbers:
            self.tree.make_automaton()

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its number of terms; and (text, term of the items, occurrences)."""
        data, at = utf8(texts)
        data = _GUARD[data]
        inside = data != 0x20
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        opens[first] = inside[first]
        sums = np.r_[0, np.cumsum(opens)]
        lengths = sums[at[1:]] - sums[at[:-1]]
        if not self.terms:
            return lengths, *(np.zeros(0, np.int64) for _ in range(3))
        text, hits, payload = data.tobytes().decode("latin-1"), [], itemgetter(1)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            hits.append(np.fromiter(map(payload, self.tree.iter(f" {text[a:b]} ")), np.int64))
        doc = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        found, tf = np.unique(doc * self.terms + (np.concatenate(hits) if hits else doc), return_counts=True)
        return lengths, found // self.terms, found % self.terms, tf


def _parts(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    rows = items.select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if size <= PART_BYTES else -(-2 * size // PART_BYTES)
    for i in range(n):
        mine = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r.id, r.text) for r in mine.collect()]


def statistics(docs: DataFrame, automaton: Automaton) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and for each term of the items the documents that hold it."""
    shared = share(docs.sparkSession, automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared()
        df, n, total = np.zeros(held.terms, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch):
                lengths, _, term, _ = held.scan(part.column("text"))
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
                df += np.bincount(term, minlength=held.terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[n, total, df[some]])], names=["term", "n"])

    df = np.zeros(automaton.terms + 2, np.int64)  # as many rows as a part of the items has terms, and two
    for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term + 2] = r.n
    return int(df[0]), int(df[1]), df[2:]


class Best:
    """The k best (score, document) of each item so far: highest score, then lowest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, is the id null, id

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([item, score, null, doc])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        starts = np.searchsorted(rows[0], np.arange(len(self.floor)))
        place = np.arange(rows.shape[1]) - starts[rows[0]]
        self.rows = rows[:, place < self.k]
        full = rows[:, place == self.k - 1]
        self.floor[full[0]] = full[1]


def _scored(docs: DataFrame, automaton: Automaton, n_docs: int, total: int, df: np.ndarray, k: int) -> DataFrame:
    """item (its place in the part), doc_id, score, group: the best of each task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = share(docs.sparkSession, (automaton, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w = shared()
        best = Best(held.items, k)
        sizes = np.diff(held.item_from)
        for batch in batches:
            for part in slices(batch):
                lengths, doc, term, tf = held.scan(part.column("text"))
                ids = part.column("doc_id")
                null, own = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
                m = 75 + 25 * lengths[doc] * n_docs // max(total, 1)
                adds = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                step = max(1, PAIRS // max(1, held.items))
                for a in range(0, part.num_rows, step):
                    x, y = np.searchsorted(doc, [a, a + step])
                    score = np.zeros(step * held.items, np.int64)
                    for x0 in range(x, y, 1 << 18):  # a long posting list is never repeated for all documents at once
                        at = slice(x0, min(y, x0 + (1 << 18)))
                        many = np.cumsum(sizes[term[at]])
                        cuts = np.searchsorted(many, np.arange(PAIRS, int(many[-1]) + PAIRS, PAIRS), "left") + 1
                        for lo, hi in zip(np.r_[0, cuts[:-1]], cuts):
                            if lo >= min(hi, len(many)):
                                continue
                            t, d, c = term[at][lo:hi], doc[at][lo:hi], adds[at][lo:hi]
                            to = ranges(held.item_from[t], sizes[t])
                            np.add.at(score, np.repeat((d - a) * held.items, sizes[t]) + held.item[to], np.repeat(c, sizes[t]) * held.repeats[to])
                    good = np.flatnonzero(score.reshape(step, held.items) >= best.floor[None, :])
                    if len(good):
                        d = good // held.items + a
                        best.add(good % held.items, score[good], null[d], own[d])
        item, score, null, doc = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, "item long, doc_id long, score long").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS)))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark, out = docs.sparkSession, None
    kind = items.schema["item_id"].dataType
    for number, rows in enumerate(_parts(items)):
        automaton = Automaton([terms_of(t) for _, t in rows])
        n_docs, total, df = statistics(docs, automaton)
        ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        best = _scored(docs, automaton, n_docs, total, df, k).join(F.broadcast(ids), "item").withColumn("part", F.lit(number))  # a part's ids
        out = best if out is None else out.unionByName(best)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    near = out.withColumn("_r", F.row_number().over(Window.partitionBy("part", "item", "group").orderBy(*order))).filter(F.col("_r") <= k)
    far = near.withColumn("rank", F.row_number().over(Window.partitionBy("part", "item").orderBy(*order))).filter(F.col("rank") <= k)
    return far.select("item_id", "rank", "doc_id", "score")


def op12_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


SQL = """
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
     s AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS nd, CAST(sum(len(terms)) AS BIGINT) AS l FROM low),
     i AS (SELECT DISTINCT item_id, text FROM benchmark),
     it AS (SELECT item_id, text, term, count(*) AS reps FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM i) GROUP BY ALL),
     o AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM low),
     tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM it) GROUP BY ALL),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
     c AS (SELECT tf.r, tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * s.nd) // s.l))) AS adds FROM tf JOIN w ON tf.term = w.term, s),
     x AS (SELECT it.item_id, it.text, c.r, c.doc_id, CAST(sum(it.reps * c.adds) AS BIGINT) AS score FROM it JOIN c ON it.term = c.term GROUP BY ALL),
     k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

"""Language-model scoring by prediction by partial matching over bytes.

A text is its UTF-8 bytes and an end symbol (0xFF, which UTF-8 never uses; before the text the context holds the same value).
The trie holds, for every context of 0 to ``ORDER`` bytes, how often each symbol followed in the training texts. A symbol is
coded in the longest context seen; where it has not followed there, an escape is coded (method C: as likely as the number of
distinct symbols seen) and the next shorter context tried, without the symbols already excluded by the longer one; after order
0 the symbols left share what is left. Since a context's symbols also follow each of its suffixes, what is excluded at an order
are just the symbols of the next longer context, so totals without them come from sums over the trie's edges.

The trie is a table of distinct (ORDER + 1)-grams, partitioned by the three bytes before the symbol. Orders 3 and up are summed
inside a partition; lower orders form a head of at most 256^3 edges that every task gets. The score of a symbol depends on its
gram alone, so each distinct gram is scored once. The most frequent grams, ``FREQUENT_GRAMS`` of them at most whatever the
corpus, are broadcast with their scores; the others, and words alike, are joined, and as each of them has less than one part in
FREQUENT_GRAMS of all occurrences, no key of these joins is hot.

Rows: a null text is empty (one end symbol); repeated rows count as often as they occur in training and get equal scores; a row
with a null doc_id is scored like any other, and is trained on (its id counts as the empty text)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.llm.common import drop, id_crc, share, slices, utf8, written

ORDER = 5
FREQUENT_GRAMS = 1 << 20
FREQUENT_WORDS = 1 << 19
#: Distinct keys that a counting task holds before it hands them on.
HELD = 3_000_000
SLICE = 2 << 20
_GRAM = "gram long, trained long, seen long"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text (its end included) a key, and the text's number. From the top byte of 48 bits: the byte
    before the symbol, the one before that, and so on, then the symbol; so contexts that share a suffix are neighbours."""
    data, at = utf8(texts)
    rows = len(at) - 1
    padded = np.full(len(data) + rows * (ORDER + 1), 0xFF, np.uint8)
    lengths = np.diff(at)
    padded[np.arange(len(data)) + np.repeat(np.arange(rows) * (ORDER + 1) + ORDER, lengths)] = data
    key = padded.astype(np.int64)
    for back in range(1, ORDER + 1):
        key[back:] |= padded[:-back].astype(np.int64) << (8 * (ORDER + 1 - back))
    symbol = np.ones(len(padded), bool)
    starts = at[:-1] + np.arange(rows) * (ORDER + 1)
    for i in range(ORDER):
        symbol[starts + i] = False
    return key[symbol], np.repeat(np.arange(rows), lengths + 1)


def _edge(key: np.ndarray, order: int) -> np.ndarray:
    """The edge of a shorter context: its ``order`` bytes, then the symbol."""
    return (key >> (8 * (ORDER + 1 - order)) << 8) | (key & 0xFF)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values))


def _lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0)


@dataclass
class Level:
    """Edges of one order with their counts; contexts with total, number of symbols, and what they exclude one order below."""
    edges: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    symbols: np.ndarray
    below: np.ndarray

    @staticmethod
    def of(edges: np.ndarray, counts: np.ndarray, order: int, lower: Level | None) -> Level:
        shorter = (edges >> 16 << 8) | (edges & 0xFF) if order else edges
        covered = _lookup(shorter, lower.edges, lower.counts) if lower else np.zeros(len(edges), np.int64)
        contexts, totals, symbols, below = _summed(edges >> 8, counts, np.ones(len(edges), np.int64), covered)
        return Level(edges, counts, contexts, totals, symbols, below)


def head_levels(edges: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders 0 to 2 from the edges of order 2."""
    levels: list[Level] = []
    for order in range(3):
        drop_bytes = 8 * (2 - order)
        keys, n = _summed((edges >> (8 + drop_bytes) << 8) | (edges & 0xFF), counts)
        levels.append(Level.of(keys, n, order, levels[-1] if levels else None))
    return levels


def log_scores(key: np.ndarray, trained: np.ndarray, head: list[Level]) -> np.ndarray:
    """log10 probabilities of grams; ``key`` holds all grams of the three-byte contexts that occur in it."""
    known = trained > 0
    levels = list(head)
    for order in range(3, ORDER + 1):
        edges, counts = _summed(_edge(key[known], order), trained[known])
        levels.append(Level.of(edges, counts, order, levels[-1]))
    score, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    gone, gone_symbols = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)  # excluded at this order
    for order in range(ORDER, -1, -1):
        level, edge = levels[order], _edge(key, order)
        context = edge >> 8
        symbols = _lookup(context, level.contexts, level.symbols)
        fresh = symbols - gone_symbols
        whole = _lookup(context, level.contexts, level.totals) - gone + fresh
        n = _lookup(edge, level.edges, level.counts)
        found, escaped = open_ & (n > 0), open_ & (n == 0) & (fresh > 0)
        score[found] += np.log10(n[found] / whole[found])
        score[escaped] += np.log10(fresh[escaped] / whole[escaped])
        open_ &= ~found
        gone, gone_symbols = _lookup(context, level.contexts, level.below), symbols
    score[open_] -= np.log10(256 - gone_symbols[open_])
    return score


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, trained, seen): occurrences of each gram in the training texts and in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 500_000):
                k, n = keys[a:a + 500_000], counts[a:a + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(np.where(k & 1, n, 0)), pa.array(n)], names=["gram", "trained", "seen"])

        for batch in batches:
            for part in slices(batch, limit=SLICE):
                key, row = grams(part.column("text"))
                learnt = part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
                key = np.sort((key << 1) | learnt[row])
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                held.append((key[starts], np.diff(np.r_[starts, len(key)])))
                size += len(starts)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    return docs.select("text", "learn").mapInArrow(run, _GRAM).groupBy("gram").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def score_grams(counted: DataFrame) -> DataFrame:
    """(gram, seen, score): the log10 probability of each gram's symbol after its context. ``counted`` is written."""
    spark = counted.sparkSession
    # contexts of two bytes and a symbol: at most 256^3 rows
    rows = (counted.filter("trained > 0").groupBy(F.shiftleft(F.shiftright("gram", 32), 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255))).alias("edge"))
            .agg(F.sum("trained").alias("n")).toArrow())
    head = share(spark, head_levels(rows.column("edge").to_numpy(), rows.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = head()

        def out(key, trained, seen):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(seen), pa.array(log_scores(key, trained, levels))], names=["gram", "seen", "score"])

        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(3)])], axis=1)
            if held.shape[1] > 200_000:  # a three-byte context has at most 256^(ORDER - 2) grams, so this is bounded
                part = held[0] >> 24
                last = int(np.searchsorted(part, part[-1]))
                if last:
                    yield out(*held[:, :last])
                    held = held[:, last:]
        if held.shape[1]:
            yield out(*held)

    return (counted.select("gram", "trained", "seen").repartition(F.shiftright("gram", 24)).sortWithinPartitions("gram")
            .mapInArrow(run, "gram long, seen long, score double"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): tokens of the training texts; the empty word is the end of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    counts.update(text.encode("utf-8", "surrogatepass").lower().split())
                counts[b""] += part.num_rows
                if len(counts) > HELD // 10:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.filter("learn").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Slots:
    """Values by key in one open table: most keys sit in their own slot, the few that do not are searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        order = np.argsort(weight, kind="stable")  # a slot goes to its most frequent key
        at = self._slot(keys[order])
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        self.key[at], self.value[at] = keys[order], values[order]
        rest = np.sort(keys[self.key[self._slot(keys)] != keys])
        by = np.argsort(keys)
        self.rest, self.rest_value = rest, values[by][np.searchsorted(keys[by], rest)]

    @staticmethod
    def restored(state: dict) -> Slots:
        """From the plain attributes, which are what is broadcast: no second copy stays beside them."""
        out = Slots.__new__(Slots)
        out.__dict__.update(state)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        at = self._slot(keys)
        there, value = self.key[at] == keys, self.value[at]
        missing = np.flatnonzero(~there)
        if len(missing) and len(self.rest):
            k = keys[missing]
            i = np.minimum(np.searchsorted(self.rest, k), len(self.rest) - 1)
            hit = self.rest[i] == k
            value[missing[hit]], there[missing[hit]] = self.rest_value[i[hit]], True
        return value, there


def _floor(counts: DataFrame, column: str, most: int) -> int:
    """The least count that at most ``most`` rows reach; rows below it each hold less than one part in ``most`` of the sum."""
    width = counts.select(F.col(column).alias("c"), F.greatest(F.length(F.bin(column)) - 11, F.lit(0)).alias("w"))
    # counts rounded down to eleven bits: a few ten thousand different ones at most, and none is rounded past another
    steps = width.groupBy(F.expr("shiftleft(shiftright(c, w), w)").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    reached, floor = 0, 1 << 62
    for row in steps:
        reached += row.n
        if reached > most:
            break
        floor = row.c
    return floor


def _partials(docs: DataFrame, frequent_grams, frequent_words) -> DataFrame:
    """Over (row, doc_id, learn, text). kind 0: a row of each text, with sums over frequent words and grams; kinds 1 and 2:
    its other words and grams with their counts."""
    names = ["kind", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "gram", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, words = Slots.restored(frequent_grams.value), frequent_words.value

        def out(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64()]
        schema = pa.schema(list(zip(names, types)))
        for batch in batches:
            for part in slices(batch):
                n, row = part.num_rows, part.column("row")
                tokens, known, base, rare_row, rare_word, rare_n = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())
                    tokens.append(counts.total() + 1)
                    counts[b""] = 1
                    hits, total = 0, 0.0
                    for word, c in counts.items():
                        v = words.get(word)
                        if v is None:
                            rare_row.append(i)
                            rare_word.append(word)
                            rare_n.append(c)
                        else:
                            hits += c
                            total += c * v
                    known.append(hits)
                    base.append(total)
                key, owner = grams(part.column("text"))
                value, there = slots.get(key)
                score = np.bincount(owner[there], value[there], n)
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                yield out(n, kind=pa.array(np.zeros(n, np.int32)), row=row, doc_id=part.column("doc_id"), held_out=pa.array(~learn), n_tokens=pa.array(tokens, pa.int64()),
                          n_known=pa.array(known, pa.int64()), base=pa.array(base, pa.float64()), score=pa.array(score))
                if rare_row:
                    yield out(len(rare_row), kind=pa.array(np.ones(len(rare_row), np.int32)), row=row.take(pa.array(rare_row, pa.int64())), word=pa.array(rare_word, pa.binary()), n=pa.array(rare_n, pa.int64()))
                if not there.all():
                    pairs, n_pairs = np.unique(np.stack([owner[~there], key[~there]]), axis=1, return_counts=True)
                    yield out(len(n_pairs), kind=pa.array(np.full(len(n_pairs), 2, np.int32)), row=row.take(pa.array(pairs[0])), gram=pa.array(pairs[1]), n=pa.array(n_pairs))

    return docs.mapInArrow(run, "kind int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, gram long, n long")


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out (not learnt from), n_tokens, n_known, train_tokens, base_score, score. Tables between the passes are
    written to the shared folder; the row number is made in the pass whose result is written, so it is the same everywhere."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    counted, counted_path = written(count_grams(texts), "ppm-grams")
    scores, _ = written(score_grams(counted), "ppm-scores")
    drop(spark, counted_path)
    often = F.col("seen") >= _floor(scores, "seen", FREQUENT_GRAMS)
    top = scores.filter(often).toArrow()
    slots = spark.sparkContext.broadcast(vars(Slots(*(top.column(c).to_numpy() for c in ("gram", "score", "seen")))))

    vocabulary, _ = written(count_words(texts), "ppm-words")
    size, total = vocabulary.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = F.col("n") >= _floor(vocabulary, "n", FREQUENT_WORDS)
    top = vocabulary.filter(common).toArrow()
    words = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), np.log10(top.column("n").to_numpy() + 1.0).tolist())))

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "learn", "text")
    parts, _ = written(_partials(numbered, slots, words), "ppm-partials")
    zero = F.lit(0).cast("long")
    none = F.lit(0.0)
    whole = parts.filter("kind = 0").select("row", "doc_id", F.col("held_out").cast("int").alias("held_out"), "n_tokens", "n_known", "base", "score")
    rare_words = (parts.filter("kind = 1").select("row", "word", "n").join(vocabulary.filter(~common).withColumnRenamed("n", "c"), "word", "left")
                  .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(zero)).alias("n_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", zero) + 1.0)).alias("base")))
    rare_grams = (parts.filter("kind = 2").select("row", "gram", "n").join(scores.filter(~often).select("gram", F.col("score").alias("s")), "gram")
                  .groupBy("row").agg(F.sum(F.col("n") * F.col("s")).alias("score")))
    null_long, null_int = F.lit(None).cast("long"), F.lit(None).cast("int")
    every = (whole.unionByName(rare_words.select("row", null_long.alias("doc_id"), null_int.alias("held_out"), zero.alias("n_tokens"), "n_known", "base", none.alias("score")))
             .unionByName(rare_grams.select("row", null_long.alias("doc_id"), null_int.alias("held_out"), zero.alias("n_tokens"), zero.alias("n_known"), none.alias("base"), "score")))
    summed = every.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out")], *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return summed.select(
        "doc_id", (F.col("held_out") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + size + 1)))).alias("base_score"), "score")


def op1_ppm(docs: DataFrame) -> DataFrame:
    return score_texts(docs, id_crc() % 7 != 2)

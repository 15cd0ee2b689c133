"""Source divergence audit with late string materialization.

Terms are counted under fixed-width digests: (lang, source, digest) rows with two counts are all that the large shuffle moves.
For the few digests that enough documents hold, a second pass brings the least and the greatest string behind each; where the two
differ, the digest stands for several terms, and a third pass counts just those by their strings (split). Text is joined back for
the rows that are returned, and for nothing else.

Every (lang, source) gives each of its language's V kept terms p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and so does the
language. ``pair``: for two sources of a language, the sum over all kept terms of f = floor((p - q)^2 / (p + q)). Terms that neither
holds share one value, so a cell only sums what differs from it: cells are (language, two blocks of sources, a bucket of terms) of
bounded size, and every pair of sources meets in the cells of its blocks. ``term``: the terms that a source uses more than its
language, by f, to rank ``TERMS``; ties at that rank are all kept until their strings are known.

Rows: null text, lang and source are empty strings; each row is a document, repeated or not; a language without kept terms has
pairs of value 0; a language with one source has no pairs; an empty table gives no rows. Columns other than these three are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.llm.common import byte_words, drop, share, slices, utf8, written

MIN_DOCS, TERMS = 10, 10
DIGEST_BITS = 64
#: Texts counted together; rows of counts that a task holds back to combine them; strings that it remembers.
SLICE_BYTES, HELD_ROWS, SEEN_TERMS = 4 << 20, 1_000_000, 400_000
#: Up to so many digests are sent to all tasks as a filter; beyond, what is not wanted is only removed by the join that follows.
FILTER_ROWS = 1_000_000
#: Sources of a block, and rows that a cell of two blocks holds on average at most.
BLOCK_SOURCES, CELL_ROWS = 256, 200_000

_TERM = np.zeros(256, np.uint8)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each term of the texts its row and its place among the distinct terms, and those."""
    held, offsets, row = byte_words(texts, _TERM)
    terms = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)).dictionary_encode()
    return row, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def _digests(terms: pa.Array, bits: int) -> np.ndarray:
    """64-bit polynomial hashes of the terms' bytes, mixed, cut to ``bits``."""
    data, at = utf8(terms)
    lengths = np.diff(at)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), 0x100000001B3, np.uint64))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(at[:-1], lengths)], at[:-1])
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15), (32, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(64 - bits)).view(np.int64)


def counted(docs: DataFrame, bits: int, only=None, strings: bool = False) -> DataFrame:
    """lang, source, digest, (term,) n, docs: counts of some texts; ``only`` yields the digests wanted, in order."""
    names = ["lang", "source", "digest", *(["term"] if strings else []), "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only() if only else None
        numbers: dict[tuple[str, str], int] = {}
        held: list[np.ndarray] = []

        def emitted(group: np.ndarray, rest: list) -> pa.RecordBatch:
            lang, source = (pa.array([g[i] for g in numbers], pa.string()).take(pa.array(group)) for i in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, *rest], names=names)

        def combined() -> pa.RecordBatch:
            group, digest, n, in_docs = np.concatenate(held, axis=1)
            held.clear()
            order = np.lexsort((group, digest))
            group, digest = group[order], digest[order]
            first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])])
            return emitted(group[first], [pa.array(digest[first]), pa.array(np.add.reduceat(n[order], first)), pa.array(np.add.reduceat(in_docs[order], first))])

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                row, which, terms = _distinct_terms(part.column("text"))
                if not len(row):
                    continue
                digest = _digests(terms, bits)
                if wanted is not None:
                    use = np.isin(digest, wanted)[which]
                    row, which = row[use], which[use]
                    if not len(row):
                        continue
                group = np.array([numbers.setdefault(g, len(numbers)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())])
                local, own = np.unique(group, return_inverse=True)
                # one sort by group, term and row: a slice's numbers of these fit into 64 bits
                key = np.sort((own[row] * len(terms) + which) * part.num_rows + row)
                cell = key // part.num_rows
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                in_docs = np.add.reduceat(np.r_[1, (key[1:] != key[:-1]).astype(np.int64)], first)
                n, cell = np.diff(np.r_[first, len(key)]), cell[first]
                in_group, term = local[cell // len(terms)], cell % len(terms)
                if strings:
                    yield emitted(in_group, [pa.array(digest[term]), terms.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(in_docs)])
                    continue
                held.append(np.stack([in_group, digest[term], n, in_docs]))
                if sum(h.shape[1] for h in held) > HELD_ROWS:
                    yield combined()
        if held:
            yield combined()

    return docs.mapInArrow(run, f"lang string, source string, digest long, {'term string, ' if strings else ''}n long, docs long")


def strings(docs: DataFrame, bits: int, only) -> DataFrame:
    """lang, digest, term: the strings behind digests, each once for most of a task's texts."""
    names = ["lang", "digest", "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only() if only else None
        seen: dict[str, set[bytes]] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                row, which, terms = _distinct_terms(part.column("text"))
                if not len(row):
                    continue
                digest = _digests(terms, bits)
                if wanted is not None and not (use := np.isin(digest, wanted)).all():
                    row, which = row[use[which]], which[use[which]]
                numbers: dict[str, int] = {}
                lang = np.array([numbers.setdefault(x, len(numbers)) for x in part.column("lang").to_pylist()])
                occurs = np.zeros((len(numbers), len(terms)), bool)
                occurs[lang[row], which] = True
                text = terms.cast(pa.large_binary()).to_pylist()
                for name, number in numbers.items():
                    known = seen.setdefault(name, set())
                    new = [i for i in np.flatnonzero(occurs[number]).tolist() if text[i] not in known]
                    known.update(text[i] for i in new)
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(new), pa.string()), pa.array(digest[new]), terms.take(pa.array(new)).cast(pa.string())], names=names)
                if sum(map(len, seen.values())) > SEEN_TERMS:
                    seen.clear()  # a term that comes twice does no harm

    return docs.mapInArrow(run, "lang string, digest long, term string")


def _filter(wanted: DataFrame):
    """The digests of ``wanted`` for the tasks that count, if they are few enough."""
    if wanted.count() > FILTER_ROWS:
        return None
    digests = np.unique(wanted.select("digest").toArrow().column("digest").to_numpy())
    return share(wanted.sparkSession, digests)


def p_of(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)) in three exact steps of whole numbers; 1 where there is no term at all."""
    d = F.greatest(total + 2 * v, F.lit(1))
    rest, out = F.when(v > 0, n + 2).otherwise(0), F.lit(0).cast("long")
    for _ in range(3):
        up = rest * 1000
        out, rest = out * 1000 + F.call_function("div", up, d), up % d
    return out + 1


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pairs_of_cell(cell: pa.Table) -> pa.Table:
    """Rows without a digest name the sources; v of the cell is their column v. Sums of f less what a term held by neither adds."""
    source, block, p = cell.column("source").to_pylist(), cell.column("block").to_numpy(), cell.column("p").to_numpy()
    marks = cell.column("digest").is_null().to_numpy()
    at = np.flatnonzero(marks)
    number = {source[i]: k for k, i in enumerate(at.tolist())}
    base, blocks, v = p[at], block[at], int(cell.column("v").to_numpy()[at[0]])
    rows = np.flatnonzero(~marks)
    place = np.array([number[source[i]] for i in rows.tolist()], np.int64)
    keys = list(zip(cell.column("digest").filter(pa.array(~marks)).to_pylist(), cell.column("split").filter(pa.array(~marks)).to_pylist()))
    numbers: dict[tuple, int] = {}
    term = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
    order = np.argsort(term, kind="stable")
    rows, place, term = rows[order], place[order], term[order]
    one, two = cell.column("one")[0].as_py(), cell.column("two")[0].as_py()
    left, right = np.flatnonzero(blocks == one), np.flatnonzero(blocks == two)
    total = v * _f(base[left][:, None], base[right][None, :])
    step = max(1, (1 << 20) // len(base))
    for a in range(0, len(numbers), step):
        x, y = np.searchsorted(term, [a, a + step])
        held = np.tile(base, (min(step, len(numbers) - a), 1))
        held[term[x:y] - a, place[x:y]] = p[rows[x:y]]
        for k, i in enumerate(left):
            total[k] += (_f(held[:, i, None], held[:, right]) - _f(base[i], base[right])[None, :]).sum(axis=0)
    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    use = (i < j) | (one != two)
    i, j, value = i[use], j[use], total.ravel()[use]
    names = pa.array([source[k] for k in at.tolist()], pa.string())
    a, b = names.take(pa.array(i)), names.take(pa.array(j))
    lang = pa.array([cell.column("lang")[0].as_py()] * (2 * len(i)), pa.string())
    return pa.table({"lang": lang, "source": pa.concat_arrays([a, b]), "item": pa.concat_arrays([b, a]), "value": pa.array(np.r_[value, value], pa.int64())})


def pairs(counts: DataFrame, groups: DataFrame, langs: DataFrame, block_sources: int = BLOCK_SOURCES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language. ``counts``: lang, source, digest, split, p of what
    occurs; ``groups``: lang, source, base (p of an absent term); ``langs``: lang, v, rows (of counts), sources."""
    blocks = F.ceil(F.col("sources") / block_sources).cast("long")
    sized = langs.select("lang", "v", blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / blocks / cell_rows)).cast("long").alias("buckets"))

    def in_cells(df: DataFrame) -> DataFrame:
        df = df.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return df.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))

    cols = ["lang", "one", "two", "bucket", "source", "block", "digest", "split", "p", "v"]
    marks = in_cells(groups.join(sized, "lang")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    marks = marks.select("lang", "one", "two", "bucket", "source", "block", F.lit(None).cast("long").alias("digest"), F.lit("").alias("split"), F.col("base").alias("p"), F.when(F.col("bucket") == 0, F.col("v")).otherwise(0).alias("v"))
    rows = in_cells(counts.join(sized, "lang")).withColumn("bucket", F.pmod(F.xxhash64("digest", "split"), F.col("buckets"))).select(*cols)
    parts = marks.select(*cols).unionByName(rows).groupBy("lang", "one", "two", "bucket").applyInArrow(_pairs_of_cell, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS, bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    docs, spark = read(docs), docs.sparkSession
    counts, counts_at = written(counted(docs, bits).groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    held = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= min_docs).drop("docs")
    held, held_at = written(held, "divergence-held")
    names, names_at = written(strings(docs, bits, _filter(held)).join(held.select("lang", "digest"), ["lang", "digest"], "left_semi")
                              .groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "divergence-names")
    kept = counts.join(held.join(names.filter(F.col("low") == F.col("high")).select("lang", "digest"), ["lang", "digest"], "left_semi"), ["lang", "digest"])
    kept = kept.select("lang", "source", "digest", F.lit("").alias("split"), "n", "n_lang")
    several = names.filter(F.col("low") != F.col("high")).select("lang", "digest")
    if several.limit(1).count():
        split = counted(docs, bits, _filter(several), True).join(several, ["lang", "digest"], "left_semi").withColumnRenamed("term", "split")
        split, split_at = written(split.groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-split")
        some = split.groupBy("lang", "digest", "split").agg(F.sum("docs").alias("_d"), F.sum("n").alias("n_lang")).filter(F.col("_d") >= min_docs).drop("_d")
        kept = kept.unionByName(split.drop("docs").join(some, ["lang", "digest", "split"]))
    kept, kept_at = written(kept, "divergence-kept")
    # one row for each kept term of a language, and what the groups and languages sum up to
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "rows"])
    sums = kept.groupBy("lang", "digest", "split").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.sum("rows").alias("rows"), F.count("*").alias("sources")).join(sums, "lang", "left").fillna(0, ["v"])
    langs, langs_at = written(langs, "divergence-langs")
    groups = groups.select("lang", "source", "total").join(langs.select("lang", "v", "total_lang"), "lang")
    groups, groups_at = written(groups.withColumn("base", p_of(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "divergence-groups")
    rows = kept.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "digest", "split", p_of(F.col("n"), F.col("total"), F.col("v")).alias("p"), p_of(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    by_pair = pairs(rows.drop("q"), groups.select("lang", "source", "base"), langs.select("lang", "v", "rows", "sources"))
    group = Window.partitionBy("lang", "source")
    top = rows.filter(F.col("p") > F.col("q")).withColumn("value", f_of(F.col("p"), F.col("q")))
    top = top.withColumn("_r", F.rank().over(group.orderBy(F.desc("value")))).filter(F.col("_r") <= terms)
    top = top.join(names.select("lang", "digest", "low"), ["lang", "digest"])
    top = top.withColumn("item", F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")))
    order = group.orderBy(F.desc("value"), "item")
    by_term = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms)
    by_pair = by_pair.withColumn("rank", F.row_number().over(order))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    out, _ = written(by_pair.withColumn("part", F.lit("pair")).select(*cols).unionByName(by_term.withColumn("part", F.lit("term")).select(*cols)), "divergence-out")
    for path in [counts_at, held_at, names_at, kept_at, langs_at, groups_at]:
        drop(spark, path)
    return out


def op11_divergence(docs: DataFrame) -> DataFrame:
    return audit(docs)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
     o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
     k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM o GROUP BY ALL HAVING count(*) >= 10),
     l AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k ON g.lang = k.lang GROUP BY ALL),
     s AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT o.lang, o.source, o.term, sum(o.n)::BIGINT AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
     t AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM s LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL),
     p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
           FROM t JOIN l ON t.lang = l.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
     x AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
     z AS (SELECT lang, source, 'pair' AS part, item, value FROM y
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM z)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

"""Source divergence, lexical search and p-stable hashing against plain versions, on given and on odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest

from votelens.llm import divergence, lexical, pstable

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOC = "doc_id long, text string, lang string, source string, n_chars long, term string, digest int, n int, p string, item string, value int, rank int, part string, low int, group int"


def docs_of(spark, rows, parts=3):
    """doc_id, text, lang, source and columns named like the operators' own."""
    return spark.createDataFrame([(d, t, lang, s, 1, "x", 1, 1, "x", "x", 1, 1, "x", 1, 1) for d, t, lang, s in rows], DOC).repartition(parts)


def plain_divergence(rows, min_docs=10, terms=10):
    rows = [(TERM.findall((t or "").translate(LOWER)), lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, n = collections.Counter(), collections.defaultdict(collections.Counter)
        for t, own, s in rows:
            if own == lang:
                df.update(set(t))
                n[s].update(t)
        kept = sorted(t for t in df if df[t] >= min_docs)
        all_ = sum(n.values(), collections.Counter())

        def p(c):
            d = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // d for t in kept}

        q, by = p(all_), {s: p(c) for s, c in n.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = sorted((-sum(f(by[s][t], by[o][t]) for t in kept), o.encode(), o) for o in n if o != s)
            some = sorted((-f(by[s][t], q[t]), t.encode(), t) for t in kept if n[s][t] and by[s][t] > q[t])[:terms]
            for part, found in (("pair", pairs), ("term", some)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return out


def made_docs(n=160, sources=5):
    rng = random.Random(4)
    words = [a + b for a in ("ab", "Cd", "é", "日本", "zz", "QQ", "st", "uv") for b in ("", "x", "ñ", "B", "k9k", "-m")]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "de", None]), rng.choice([None, "s9", *[f"s{j}" for j in range(sources)]])) for i in range(n)]


@pytest.mark.parametrize("bits, few, block, cell", [(64, None, 256, 200_000), (3, None, 256, 200_000), (5, 1, 2, 10), (64, 1, 1, 7)])
def test_divergence(spark, rows_of, in_order, odd, monkeypatch, bits, few, block, cell):
    """Narrow digests make terms collide; few: no filter is sent to the tasks; small blocks and cells cut the pairs."""
    if few:
        monkeypatch.setattr(divergence, "FILTER_ROWS", few)
        monkeypatch.setattr(divergence, "HELD_ROWS", few)
        monkeypatch.setattr(divergence, "SEEN_TERMS", few)
    monkeypatch.setattr(divergence.pairs, "__defaults__", (block, cell))
    rows = made_docs() + [(d, t, "en", "odd") for d, t in odd] + [(1, None, "xx", "alone"), (1, "\x00\n", "yy", "a"), (2, "", "yy", "b"), (3, "q", "yy", "c")]
    got = rows_of(divergence.audit(docs_of(spark, rows), bits=bits))
    assert got == in_order(plain_divergence(rows))


def test_divergence_ties_at_the_last_rank(spark, rows_of, in_order):
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "éxyz"]
    rows = [(i, " ".join(words) if i < 12 else "other things", "en", f"s{i >= 12}") for i in range(24)]
    assert rows_of(divergence.op11_divergence(docs_of(spark, rows))) == in_order(plain_divergence(rows))


def test_divergence_empty(spark):
    assert divergence.op11_divergence(docs_of(spark, [], 1)).collect() == []


def test_exact_share(spark):
    """Beyond what 10^9 times a count holds in 64 bits."""
    from pyspark.sql import functions as F
    n, total, v = 4_000_000_000_000_123, 9_000_000_000_000_777, 1_000_003
    assert spark.range(1).select(divergence.p_of(F.lit(n), F.lit(total), F.lit(v))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)


def plain_search(rows, items, k=20):
    docs = [(d, collections.Counter(w), len(w)) for d, w in ((d, WORD.findall((t or "").translate(LOWER))) for d, t, *_ in rows)]
    n_docs, total = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in docs:
            m = 75 + 25 * n * n_docs // total if total else 0
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in collections.Counter(WORD.findall((text or "").translate(LOWER))).items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc_id string, rank int")


@pytest.mark.parametrize("part, pairs", [(lexical.PART_BYTES, lexical.PAIRS), (150, 16)])
def test_search(spark, sf_dir, odd, rows_of, in_order, documents, monkeypatch, part, pairs):
    """Small parts need several automata; small pairs cut documents and posting lists."""
    monkeypatch.setattr(lexical, "PART_BYTES", part)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    rows = [r[:2] for r in made_docs(120)] + documents[:60] + odd + [(9, "tie tie"), (8, "tie tie"), (None, "Tie\x00TIE"), (9, "tie tie")]
    items = [(1, "ab cdx éñ zz zz"), (2, "tie 日本 tie unknown"), (2, "same word"), (2, "same word"), (3, None), (4, ""), (None, "word x9 ab"), (5, documents[0][1][:300]), (6, "nowhere atall")]
    got = rows_of(lexical.search(docs_of(spark, [(d, t, "en", "s") for d, t in rows]), items_of(spark, items)))
    assert got == in_order(plain_search(rows, items))


def test_search_many_documents_for_an_item(spark, rows_of, in_order):
    rows = [(i, "common " * (1 + i % 3) + "filler " * (i % 7)) for i in range(200)] + [(i, "filler rest") for i in range(500, 800)]
    got = rows_of(lexical.op12_lexical(docs_of(spark, [(d, t, "en", "s") for d, t in rows]), items_of(spark, [(1, "common rest")])))
    assert got == in_order(plain_search(rows, [(1, "common rest")]))


def test_search_empty(spark):
    assert lexical.op12_lexical(docs_of(spark, [], 1), items_of(spark, [(1, "a")])).collect() == []
    assert lexical.op12_lexical(docs_of(spark, [(1, "a", "en", "s")]), items_of(spark, [])).collect() == []


def vectors_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, key string, score double").repartition(parts)


def exact(rows, k=20, every=20):
    """Each query's k nearest: {(query, its vector): [(vec_id, score)]}; a vec_id once, by its best vector."""
    rows = sorted({(i, tuple(np.float32(v).astype(float).tolist())) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    width = max((len(v) for _, v in rows), default=0)
    ids, points = [i for i, _ in rows], np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows]).reshape(len(rows), width)
    out = {}
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            best = {}
            for j, s in zip(ids, points @ points[n]):
                if j != i:
                    best[j] = max(s, best.get(j, -math.inf))
            out[i, v] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found_of(frame):
    out = collections.defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    hits = []
    for (q, _), best in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(best) + 1)), "a query returns as many rows as there are"
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q]) and q not in [i for _, i, _ in got[q]]
        if best:
            hits.append(sum(s >= best[-1][1] - 1e-12 for _, _, s in got[q]) / len(best))
    return np.mean(hits)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_pstable_recall_on_given_vectors(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in frame.collect()])
    assert recall(found_of(pstable.op13_search(frame)), want) >= 0.9


def unlike(n=900, dims=16, seed=5):
    """Vectors of unlike norms, a third of them copies of one, and a close heap."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dims) * rng.choice([0.01, 1, 1, 30])).tolist()) for i in range(n)]
    heap = rng.normal(size=dims)
    rows += [(2000 + i, (heap + 0.001 * rng.normal(size=dims)).tolist()) for i in range(n // 3)]
    return rows + [(5000 + i, rows[7][1]) for i in range(n // 2)]


def test_pstable_norms_copies_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(pstable, "CELL_ROWS", 100)
    monkeypatch.setattr(pstable, "SPLIT_BUCKETS", 100)
    rows = unlike()
    pieces, made = [], pstable.Index.__init__
    monkeypatch.setattr(pstable.Index, "__init__", lambda self, *a: (made(self, *a), pieces.append(self.pieces))[0])
    want = exact(rows)
    assert recall(found_of(pstable.op13_search(vectors_of(spark, rows))), want) >= 0.9
    assert pieces[0], "some bucket is larger than a cell"


def test_pstable_scores_are_exact(spark):
    rows = unlike(300)
    vec = {i: np.float32(v).astype(float) for i, v in rows}
    for q, found in found_of(pstable.op13_search(vectors_of(spark, rows))).items():
        assert all(abs(s - vec[q] @ vec[i]) <= 1e-12 * (1 + abs(s)) for _, i, s in found)


def test_pstable_odd_rows(spark):
    ok = [0.5, -0.25, 1.0]
    rows = [(0, ok), (0, ok), (20, ok), (40, None), (60, [0.0, -0.0, 0.0]), (None, ok), (80, [1.0, None, 0.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 0.0, 0.0]), (1, [1.0]), (2, []), (3, [0.1, 0.1]), (4, ok), (140, [1.0, 1.0, 1.0]), (140, [-1.0, -1.0, -1.0]), (5, [1e30, 0.0, 0.0])]
    frame = vectors_of(spark, rows)
    got, want = pstable.op13_search(frame).collect(), exact(rows)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted((q, n + 1, i, pytest.approx(s, rel=1e-12)) for (q, _), best in want.items() for n, (i, s) in enumerate(best))
    assert pstable.op13_search(vectors_of(spark, [], 1)).collect() == []
    assert pstable.op13_search(vectors_of(spark, [(20, ok)], 1)).collect() == []


def test_pstable_many_vectors_of_one_id(spark):
    """An id that a third of all rows repeat takes one place in the result of others, and none in its own."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)] + [(40, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist()) for _ in range(60)]
    want, got = exact(rows), found_of(pstable.op13_search(vectors_of(spark, rows)))
    assert all(len({i for _, i, _ in got[q]}) == 20 for q in (0, 20, 60, 80))
    assert recall(got, {x: best for x, best in want.items() if x[0] != 40}) >= 0.8


def test_pstable_probes_are_in_order_of_cost():
    """The buckets visited are the cheapest of all sets of steps."""
    import itertools
    h = pstable.Hashes(6, 4, 1.0)
    q = np.random.default_rng(2).normal(size=(3, 6))
    got = h.probes(q, 30)
    points = np.pad(q / np.linalg.norm(q, axis=1, keepdims=True), ((0, 0), (0, 1)))
    slot, up = h._slots(points)
    for i in range(3):
        for t in range(h.tables):
            every = sorted(itertools.product((0, -1, 1), repeat=4), key=lambda s: sum(0 if x == 0 else (u if x < 0 else h.width - u) ** 2 for x, u in zip(s, up[i, t])))
            assert got[i, t].tolist() == [int(h._keys(slot[i, t] + np.array(s))) for s in every[:30]]

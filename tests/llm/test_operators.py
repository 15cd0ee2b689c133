"""Each operator against its plain version, on the given documents and on odd rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from votelens.llm import balltree, bpe, decontaminate, lines, load, pii, ppm, repeats, secrets, simhash, toxicity


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def close(a, b):
    return all(x == y if not isinstance(x, float) else abs(x - y) <= 1e-9 + 1e-9 * abs(y) for x, y in zip(a, b)) and len(a) == len(b)


@pytest.mark.parametrize("frequent", [None, 64])
def test_ppm(docs_frame, documents, odd, rows_of, in_order, monkeypatch, frequent):
    if frequent:
        monkeypatch.setattr(ppm, "FREQUENT_GRAMS", 5000)
        monkeypatch.setattr(ppm, "FREQUENT_WORDS", frequent)
        monkeypatch.setattr(ppm, "HELD", 5000)
    rows = documents[:40] + [r for r in odd if len(r[1] or "") < 1000]
    got, want = rows_of(ppm.op1_ppm(docs_frame(rows))), in_order(brute.op1(rows))
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))


def test_ppm_sums_to_one():
    """Over all symbols that may follow a context."""
    import numpy as np
    train = [b"abracadabra", b"abba", b"cadabra"]
    padded = [b"\xff" * ppm.ORDER + t + b"\xff" for t in train]
    seen = {}
    for t in padded:
        for i in range(ppm.ORDER, len(t)):
            k = sum(t[i - j] << (8 * (ppm.ORDER + 1 - j)) for j in range(1, ppm.ORDER + 1)) | t[i]
            seen[k] = seen.get(k, 0) + 1
    edges = {}
    for k, n in seen.items():
        e = (k >> 32 << 8) | (k & 255)
        edges[e] = edges.get(e, 0) + n
    head = ppm.head_levels(np.array(sorted(edges), np.int64), np.array([edges[e] for e in sorted(edges)], np.int64))
    keys = np.array(sorted(seen), np.int64)
    counts = np.array([seen[k] for k in keys.tolist()], np.int64)
    for context in {k >> 8 for k in seen}:
        asked = (context << 8) | np.arange(256, dtype=np.int64)
        every = np.union1d(keys, asked)
        trained = np.zeros(len(every), np.int64)
        trained[np.searchsorted(every, keys)] = counts
        scores = dict(zip(every.tolist(), ppm.log_scores(every, trained, head).tolist()))
        assert abs(sum(10 ** scores[a] for a in asked.tolist()) - 1) < 1e-9


def test_ppm_empty(docs_frame):
    assert ppm.op1_ppm(docs_frame([], 1)).collect() == []


def made_secrets(n):
    rng, abc = random.Random(3), "ABCXYZabcdefxyz0123456789+/_="
    pick = lambda: rng.choice(["é日𝄞 ", "AKIA", "token", "=", " : ", '"', "api_key", "PassWord=", " ", "AAAA", "plainwordsplainwordsplain",
                               "".join(rng.choices("0123456789abcdef", k=rng.choice([5, 31, 32, 40]))), "".join(rng.choices(abc, k=rng.choice([3, 8, 19, 20, 21, 60, 300])))])
    return [(1000 + i, "".join(pick() for _ in range(rng.choice([1, 5, 30])))) for i in range(n)] + [(999, "".join(rng.choices(abc, k=9000)))]


def test_secrets(docs_frame, documents, odd, rows_of, in_order):
    rows = documents + odd + made_secrets(120)
    got = rows_of(secrets.op2_secrets(docs_frame(rows)))
    assert [r[:5] for r in got] == [r[:5] for r in in_order([r + (x,) for r, x in zip(brute.op2(rows), [""] * len(rows))])]
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        spans = [tuple(map(int, s.split(":")[1:])) for s in r[5].split(",") if s.startswith("entropy")]
        assert spans in [brute.entropy(t) for t in texts[r[0]]]


def test_secrets_allow_list(docs_frame):
    rows = [(1, "id 123e4567-e89b-42d3-a456-426614174000 here"), (2, "7Gq2xLz9PqR4tVb8KmN1 found"), (3, "src/main/resources/application")]
    assert [bool(r.spans) for r in secrets.find_secrets(docs_frame(rows)).orderBy("doc_id").collect()] == [False, True, False]


def test_secrets_after_names_and_folders(docs_frame):
    """Neither what stands before = or / nor the class of letters hides a random string."""
    rng = random.Random(8)
    hexes, lower, mixed, b64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJabcdefghij0123456789+/"
    made = [(head, "".join(rng.choices(abc, k=n))) for abc, n in ((hexes, 20), (hexes, 31), (lower, 32), (mixed, 20), (mixed, 32), (b64, 40))
            for head in ("", "key=", "digest=", "EXAMPLE_KEY=", "/examples/some/folder/") for _ in range(20)]
    rows = [(i, f"see {head}{x} here") for i, (head, x) in enumerate(made)]
    got = {r.doc_id for r in secrets.find_secrets(docs_frame(rows)).collect() if any(s.kind == "entropy" for s in r.spans)}
    for head in ("", "key=", "digest=", "EXAMPLE_KEY=", "/examples/some/folder/"):
        at = [i for i, (h, _) in enumerate(made) if h == head]
        assert sum(i in got for i in at) >= 0.9 * len(at), head


def test_secrets_long_path(docs_frame):
    rows = [(1, "a/" * 40_000), (2, "/" * 40_000), (3, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), (4, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ4vT8Lw2N")]
    assert [bool(r.spans) for r in secrets.find_secrets(docs_frame(rows)).orderBy("doc_id").collect()] == [False, False, False, True]


def test_secrets_are_native(docs_frame):
    plan = secrets.op2_secrets(docs_frame([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def made_repeats():
    rng = random.Random(5)
    text = lambda n, abc="abcdefgh \n": "".join(rng.choice(abc) for _ in range(n))
    parts, out = [text(n) for n in (399, 400, 401, 500, 900, 1500, 3000)], []
    for i in range(80):
        s = ""
        for _ in range(rng.choice([1, 2, 4])):
            q = rng.choice(parts)
            if rng.random() < 0.5:
                a = rng.randrange(len(q))
                q = q[a:a + rng.choice([380, 400, 420, 600, 1200])]
            if rng.random() < 0.3:
                a = rng.randrange(max(1, len(q)))
                q = q[:a] + rng.choice("XYé") + q[a + 1:]
            s += text(rng.choice([0, 1, 5, 200])) + q
        out.append((i, s))
    return out + [(200, "a" * 3000), (201, "ab" * 1000 + "c" + "ab" * 500), (None, parts[4]), (5, out[5][1]), (204, "é" * 700)]


@pytest.mark.parametrize("bucket, most", [(repeats.BUCKET_BYTES, repeats.SPANS), (3000, 2)])
def test_repeats(docs_frame, odd, rows_of, in_order, monkeypatch, bucket, most):
    monkeypatch.setattr(repeats, "SPANS", most)
    monkeypatch.setattr(repeats.repeat_groups, "__defaults__", (400, bucket))
    rows = made_repeats() + [r for r in odd if r[0] != 7]
    assert rows_of(repeats.op3_repeats(docs_frame(rows))) == in_order(brute.op3(rows))


def test_repeat_groups_hold_equal_strings(docs_frame):
    rows = [(d, t) for d, t in made_repeats() if d is not None]
    texts, groups = {}, {}
    for d, t in rows:
        texts.setdefault(d, []).append(t.encode())
    for r in repeats.repeat_groups(docs_frame(rows)).collect():
        groups.setdefault(r.repeat, []).append({t[r.start:r.end] for t in texts[r.doc_id]})
    # occurrences that overlap in a text are one span, which begins with the string
    least = {k: min((s for g in v for s in g), key=len) for k, v in groups.items()}
    assert len(groups) > 20 and all(any(s.startswith(least[k]) for s in g) for k, v in groups.items() for g in v)


def test_repeats_given(docs_frame, documents, rows_of, in_order):
    assert rows_of(repeats.op3_repeats(docs_frame(documents))) == in_order(brute.op3(documents))


def test_simhash(docs_frame, documents, odd, rows_of, in_order):
    rows = documents + odd
    assert rows_of(simhash.op4_simhash(docs_frame(rows))) == in_order(brute.op4(rows))


@pytest.mark.parametrize("block", [4096, 16])
def test_simhash_components(spark, block):
    """Clouds around centers and chains of close fingerprints, in one block and in many."""
    rng, values = random.Random(2), set()
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(150):
            x = center
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    x = rng.getrandbits(64)
    for _ in range(120):
        for k in rng.sample(range(64), 4):
            x ^= 1 << k
        values.add(x)
    values, parent = sorted(values), {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(find(v), i)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "doc_id long, fp long")
    assert {r.fp: r.component_id for r in simhash.classes(prints, block).collect()} == {signed(v): least[find(v)] for v in values}


def test_simhash_keeps_one_of_each(docs_frame, documents, odd):
    rows = documents + odd
    out = simhash.first_of_each(docs_frame(rows))
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(map(repr, brute.op4(rows, heads=True))) and "score" in out.columns


def made_vectors(spark, n=400):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(n)]
    rows += [(n + i, [0.5] * 8, 0) for i in range(150)]
    rows += [(50, None, 0), (None, [0.1] * 8, 0), (100, [None] * 8, 1), (5000, [float("nan")] * 8, 1), (5050, [float("inf")] * 8, 1), (5100, [0.1, 0.2], 1), (150, rows[150][1], 0)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "query_rows": 3, "seed_rows": 2}, {"seed_rows": 0}])
def test_ball_tree(spark, monkeypatch, sizes):
    import math
    rows = made_vectors(spark)
    monkeypatch.setattr(balltree, "LEAF_ROWS", 8)
    monkeypatch.setattr(balltree.top_k, "__defaults__", tuple({"k": 5, "shard_rows": 8192, "query_rows": 1024, "seed_rows": 1024, **sizes}.values()))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, v in good:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in balltree.op5_search(frame).collect()]
    assert set(got) == want and len(got) == len(want)


def test_ball_tree_hot_id(spark):
    """A third of the rows share an id, with a few vectors each repeated often and with many vectors."""
    rng = np.random.default_rng(4)
    whole = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(400)]
    whole += [(7, [float(i % 3), 1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(150)] + [(7, rng.integers(-9, 9, 6).astype(float).tolist()) for _ in range(150)]
    d = spark.createDataFrame(whole, "id long, vec array<double>").repartition(8)
    got = balltree.top_k(d, d.filter("id % 50 = 0"), 5, 40, 1000, 4)
    assert not any(r.query_id == r.vec_id for r in got.collect())
    for q, v in whole[:400:50]:
        best = sorted((-float(np.dot(v, w)), i) for i, w in whole if i != q)[:5]
        assert [(r.vec_id, r.score) for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == [(i, -s) for s, i in best]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(id" in plan and "least(" in plan


def test_ball_tree_small(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert balltree.op5_search(spark.createDataFrame([], schema)).collect() == []
    assert balltree.op5_search(spark.createDataFrame([(0, [1.0], 0)], schema)).collect() == []
    assert [tuple(r) for r in balltree.op5_search(spark.createDataFrame([(0, [1.0], 0), (1, [-2.0], 0)], schema)).collect()] == [(0, 1, 1, -256 * 512)]


def made_pii(n):
    rng = random.Random(4)
    pick = lambda: rng.choice(["1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", ".", "+", "+1 (377) 555-0271", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "a@b.c", "@", "a.b%c+d@x-y.zz.", "é", "日",
                               str(rng.randrange(10 ** 14)), "+49-30.", "()", "0", "\n", "12345"])
    return [(1000 + i, "".join(pick() for _ in range(rng.choice([1, 4, 30])))) for i in range(n)]


def test_pii(docs_frame, documents, odd, rows_of, in_order):
    rows = documents + odd + made_pii(200)
    got = rows_of(pii.op6_pii(docs_frame(rows)))
    assert sorted(map(repr, [r[:6] for r in got])) == sorted(map(repr, brute.op6(rows)))


def test_pii_field():
    """Forms the patterns miss, held out of the labelled table; plain text stays clean."""
    field = pii.train(pii.read_labelled(pii.LABELLED))
    found = lambda s: [(pii.KINDS[p - 4], s[a:b]) for a, p, b in pii.field_spans(field, [s])[0]]
    assert found("Call 555-0199 now") == [("phone", "555-0199")]
    assert found("My phone is (212) 555-0188 ok") == [("phone", "(212) 555-0188")]
    assert found("SSN 123-45-6789 here") == [("ssn", "123-45-6789")]
    assert found("On 2021-03-04 at 12:30 we met") == [] and found("") == []


def test_pii_cut_lines_decode_alike():
    """Leaving out what cannot gain changes no path."""
    import numpy as np
    field = pii.train(pii.read_labelled(pii.LABELLED))
    text = "\n".join(t for _, t in made_pii(150)) + "\n" + "\n".join(t for t, _ in pii.read_labelled(pii.LABELLED))
    t = pii.tokens(np.frombuffer(text.encode("utf-32-le"), np.int32))
    labels, e = field.decode(t), field.emissions(t)
    for line in np.unique(t.line):
        at = np.flatnonzero(t.line == line)
        best, back = field.begins + e[at[0]], []
        for i in at[1:]:
            step = best[:, None] + field.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + e[i]
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert path[::-1] == labels[at].tolist()


def made_lines():
    rng = random.Random(6)
    pool = [f"this is line number {i} of a pool that many documents share, more or less" for i in range(12)]
    out = []
    for i in range(60):
        ls = [rng.choice(pool) for _ in range(rng.choice([1, 3, 8]))] + ["short", f"a line of document {i} alone, and it is long enough to count"]
        rng.shuffle(ls)
        out.append((i, "\n".join(x if rng.random() < 0.6 else rng.choice([f" \t{x}\r", x.upper(), x + "\x0b"]) for x in ls)))
    return out + [(None, pool[0] + "\n" + pool[1]), (3, out[3][1]), (61, ("\n".join([pool[2]] * 500)))]


@pytest.mark.parametrize("buffer", [lines.BUFFER, 5])
def test_lines(docs_frame, documents, odd, rows_of, in_order, monkeypatch, buffer):
    monkeypatch.setattr(lines, "BUFFER", buffer)
    rows = documents + odd + made_lines()
    assert rows_of(lines.op7_lines(docs_frame(rows, 5))) == in_order(brute.op7(rows))


@pytest.mark.parametrize("part", [decontaminate.PART_BYTES, 600])
def test_decontamination(spark, docs_frame, documents, odd, items, rows_of, in_order, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    rng, rows, more = random.Random(9), documents[:60] + odd, items[:12]
    more += [(900, "one two three"), (901, "one two three"), (902, None), (None, "four five six seven"), (903, ""), (904, "a " * 40), (10, items[1][1]), (905, " ".join(f"w{i % 5}" for i in range(30)))]
    for i in range(60):
        w = rng.choice(more)[1] or ""
        w = w.split()
        a = rng.randrange(len(w) + 1)
        rows.append((2000 + i, "x Y z, " * rng.randrange(4) + " ".join(w[a:a + rng.choice([3, 12, 13, 14, 40])]).upper() + rng.choice([" one Two, three", " a a a", "", " four five six"])))
    bench = spark.createDataFrame(more, "item_id long, text string")
    assert rows_of(decontaminate.op8_decontaminate(docs_frame(rows), bench)) == in_order(brute.op8(rows, more))


def test_decontamination_without_benchmark(spark, docs_frame):
    out = decontaminate.op8_decontaminate(docs_frame([(1, "a b"), (None, None)]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in out) == [(0, 0, False), (2, 0, False)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe(docs_frame, documents, odd, ranks, rows_of, in_order):
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in documents + odd:
        ids = code.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha((t or "").encode())))
    assert rows_of(bpe.op9_bpe(docs_frame(documents + odd), ranks, public_tokenizers.PATTERN)) == in_order(want)


def test_bpe_tree(ranks):
    """Long pieces without a boundary, through leaves and joins."""
    code, tree, rng = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Tree(ranks), random.Random(1)
    for n in (1, 63, 64, 65, 129, 700, 5000):
        for abc in ("ab", "aaa", "abcdefghijtion", "éüñßçê", "日本語のab", "0123456789"):
            piece = "".join(rng.choice(abc) for _ in range(n))
            if len(set(map(str.isdigit, piece))) == 1:
                assert tree.encode(piece.encode()) == code.encode_ordinary(piece)


def test_bpe_pieces_meet_in_the_tree(documents, ranks):
    """Most pieces that are no token by themselves are joined from leaves; decoding goes up its own tree."""
    import regex
    tree = bpe.Tree(ranks)
    find = regex.compile(bpe.split_pattern(public_tokenizers.PATTERN)).findall
    several = joined = 0
    for text in {t for _, t in documents if t}:
        for raw in {p.encode() for p in find(text)} - ranks.keys():
            before = tree.joins
            assert tree.decode(tree.encode(raw)) == raw
            several, joined = several + 1, joined + (tree.joins > before)
    assert several and joined > several / 2
    tokens = [bytes([i % 251]) * (i % 5) for i in range(1000)]
    for n in (0, 1, 63, 64, 65, 200, 1000):
        assert bpe.concatenated(tokens[:n]) == b"".join(tokens[:n])


def test_bpe_every_character(ranks):
    import regex
    code, tree = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Tree(ranks)
    find, pieces = regex.compile(bpe.split_pattern(public_tokenizers.PATTERN)).findall, bpe.Pieces(tree)
    for a in [*range(0, 0xD800, 7), *range(0x80, 0x250), *range(0x2000, 0x2070), *range(0x1680, 0x1690), 0x3000, 0xFEFF, *range(0xE000, 0x20000, 61)]:
        s = f"a{chr(a)}b {chr(a)}{chr(a)} 1{chr(a)}.{chr(a)} ."
        assert b"".join(pieces[p] for p in find(s)) == b"".join(i.to_bytes(4, "little") for i in code.encode_ordinary(s)), hex(a)


def made_labels(n=240):
    rng = random.Random(11)
    words = ["the", "tion", "ander", "of", "heat", "ing", "er", "and", "lyea", "on"]
    bad, rows, labels = ["nasty", "vile", "rotten"], [], []
    for i in range(n):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.choice(words + bad * toxic) if rng.random() < 0.9 else "x" for _ in range(rng.choice([20, 60, 200])))))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, docs_frame):
    rows, labels = made_labels()
    out = toxicity.op10_toxicity(docs_frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: t for d, _, t in labels}
    held = [r for r in out if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 30 and right >= 0.95 * len(held) and not any(r.predicted and not truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_one_example_for_an_id(spark, docs_frame):
    """A labelled id that many rows repeat, with equal and with lesser texts, weighs as one."""
    rows, labels = made_labels(100)
    often = next(r for r in rows if r[0] % 5 == 0 and zlib.crc32(str(r[0]).encode()) % 4 != 2)
    more = rows + [often] * 150 + [(often[0], None)] * 20 + [(often[0], "")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = ({(r.doc_id, round(r.score, 9)) for r in toxicity.op10_toxicity(docs_frame(x), frame).collect()} for x in (rows, more))
    assert one <= two and {d for d, _ in two - one} <= {often[0]}
    assert toxicity._examples(docs_frame(more), toxicity._marked(frame, F.lit(True)), 500).count() == 100


def test_toxicity_ignores_held_out_labels(spark, docs_frame):
    rows, labels = made_labels(100)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    one, two = ({r.doc_id: r.score for r in toxicity.op10_toxicity(docs_frame(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
    assert all(abs(one[d] - two[d]) < 1e-9 for d in one)


def test_toxicity_odd(spark, docs_frame, odd):
    schema = "doc_id long, quality int, toxic int"
    rows, labels = made_labels(60)
    some = labels + [(None, 1, 1), (2, 0, None), (777, 1, 1), (5, 1, 0), (5, 1, 1)]
    out = toxicity.op10_toxicity(docs_frame(rows + odd), spark.createDataFrame(some, schema)).collect()
    assert len(out) == len(rows) + len(odd) and all(r.score is not None for r in out)
    none = toxicity.op10_toxicity(docs_frame(odd), spark.createDataFrame([], schema)).collect()
    assert len(none) == len(odd) and not any(r.predicted for r in none)
    assert toxicity.op10_toxicity(docs_frame([], 1), spark.createDataFrame(labels, schema)).collect() == []


def test_empty_tables(spark, docs_frame, ranks):
    nothing = docs_frame([], 1)
    for df in (secrets.op2_secrets(nothing), repeats.op3_repeats(nothing), simhash.op4_simhash(nothing), pii.op6_pii(nothing), lines.op7_lines(nothing),
               decontaminate.op8_decontaminate(nothing, spark.createDataFrame([(1, "a b")], "item_id long, text string")), bpe.op9_bpe(nothing, ranks, public_tokenizers.PATTERN)):
        assert df.collect() == []


def test_registered():
    assert sorted(n.split("_")[0] for n in load()[0]) == sorted(f"op{i}" for i in range(1, 14))


def test_pipeline(spark, sf_dir, documents, items, ranks, rows_of, in_order):
    """Against the plain versions in a row; toxicity by its own query."""
    import corpus_pipeline
    rejected = {r.doc_id for r in load()[0]["op10_toxicity"](spark, sf_dir).collect() if r.predicted}
    rows = [(d, t) for d, t in documents if d not in rejected]
    kept = {}
    for (d, t), (_, _, _, digest) in zip(rows, brute.op7(rows)):
        kept[d] = digest
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    staged = corpus_pipeline.STAGES[1][1](spark, docs.filter(~docs.doc_id.isin(list(rejected))), sf_dir)
    assert staged.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in staged.collect()]
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows} == kept
    heads = {c for _, _, c in brute.op4(rows)}
    rows = [(d, t) for d, t in rows if d in heads]
    bad = {r[0] for r in brute.op8(rows, items) if r[5]}
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        if d not in bad:
            ids = code.encode_ordinary(t)
            want.append((d, len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha(t.encode())))
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == in_order(want)


def test_pipeline_odd(spark, sf_dir, docs_frame, odd):
    """Nulls, ties, repeated rows and clashing names go through every stage."""
    import corpus_pipeline
    docs = docs_frame(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() > 0

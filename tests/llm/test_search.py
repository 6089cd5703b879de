"""SimHash, embedding and top-k search against brute force, and their edge rows."""

import math
import random
import re

import numpy as np

from churnlens.llm import components, pq, simhash, topk

DOCS = "component_id string, doc_id bigint, text string, fp string, least int"
VECS = "score string, vec_id bigint, embedding array<float>, node string, label int, list int"


def _print(text):
    import xxhash

    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in ([w] if len(w) < 3 else zip(w, w[1:], w[2:]))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(n, linked, ids):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    best = {}
    for i in range(n):
        r = root(i)
        best[r] = min((x for x in (best.get(r), ids[i]) if x is not None), default=None)
    return [best[root(i)] for i in range(n)]


def _near_copies(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(150, 400))
        for _ in range(rng.randint(1, 7)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(("c", n, rng.choice([" ", "\n", "\t "]).join(text), "f", 0))
            n += 1
    rows += [("c", 900, None, "f", 0), ("c", 901, "", "f", 0), ("c", 902, " \n", "f", 0), ("c", 903, "A b", "f", 0), ("c", 904, "a B", "f", 0),
             ("c", None, "no id at all", "f", 0), ("c", 3, rows[3][2], "f", 0), ("c", 905, " ".join(rng.choices(words, k=40_000)), "f", 0)]
    return rows


def _check_simhash(spark, rows):
    got = simhash.query(spark.createDataFrame(rows, DOCS)).collect()
    prints = [_print(r[2]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    want = sorted(((r[1], f"{p:016x}", c) for r, p, c in zip(rows, prints, _classes(len(rows), near, [r[1] for r in rows]))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    return want


def test_simhash_equals_brute_force(spark):
    want = _check_simhash(spark, _near_copies())
    assert any(d != c for d, _, c in want)


def test_simhash_hot_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    _check_simhash(spark, _near_copies(8))


def test_simhash_empty_and_keep_one(spark):
    rows = _near_copies()
    docs = spark.createDataFrame(rows, DOCS)
    assert simhash.query(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    labels = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({c if c is not None else d for d, c in labels}, key=str)


def test_bit_planes():
    rng = np.random.default_rng(0)
    for n, m, radius in [(5, 5, 2), (70, 130, 2), (64, 64, 3), (33, 200, 0), (33, 200, 5)]:
        base = rng.integers(0, 2**63, 6, dtype=np.uint64)
        make = lambda k: base[rng.integers(0, 6, k)] ^ (np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) \
            ^ (np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64))
        a, b = make(n), make(m)
        far = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
        assert np.array_equal(np.stack(simhash.close_pairs(a, b, radius)), np.stack(np.nonzero(far)))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 1500), (1500, 2000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)} | {1500: 1500, 2000: 1500}
    assert {k: v for k, v in got.items()} == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    n = 50
    order = np.random.default_rng(1).permutation(n)
    assert len(set(components.label_components(n, order[:-1], order[1:]))) == 1


def _vectors():
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for _ in range(60):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 9)):
            rows.append(("s", n, (base + rng.normal(size=32) * rng.choice([0.0, 0.15, 0.33, 0.5])).astype(np.float32).tolist(), "n", 0, 0))
            n += 1
    for v in [None, [], [0.0] * 32, [1.0] * 31 + [None], [1.0] * 31 + [math.nan], [1.0] * 31 + [math.inf], [1.0, 2.0], [2.0, 4.0], rows[0][2], rows[0][2]]:
        rows.append(("s", n, v, "n", 0, 0))
        n += 1
    return rows + [("s", None, rows[0][2], "n", 0, 0)]


def test_embedding_links_equal_brute_force(spark):
    rows = _vectors()
    got = {r.vec_id: r for r in pq.near_duplicates(spark.createDataFrame(rows, VECS), margin=math.sqrt(0.2)).collect()}
    ok = [r[1] is not None and bool(r[2]) and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    near = []
    for i, r in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and len(r[2]) == len(rows[j][2]):
                x, y = np.array(r[2], float), np.array(rows[j][2], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                    near.append((i, j))
    links = np.bincount(np.array(near).ravel(), minlength=len(rows))
    classes = _classes(len(rows), near, [r[1] for r in rows])
    assert len(near) > 50
    for r, n, c in zip(rows, links, classes):
        assert (got[r[1]].n_links, got[r[1]].component_id, got[r[1]].kept) == (n, c, r[1] == c)


def test_embedding_default_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(pq, "MEMBERS", 16)
    monkeypatch.setattr(pq, "QUERIES", 32)
    rows = [r for r in _vectors() if r[1] is not None and r[2] and len(r[2]) == 32 and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])]
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pq.query(spark.createDataFrame(rows, VECS)).collect()}
    found = np.array([got[r[1]] for r in rows])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert pq.query(spark.createDataFrame([], VECS)).count() == 0


def test_different_vectors_of_one_id(spark):
    """A vec_id held by two vectors: each has its own links, the component's name is the smallest id in it."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (0, [0.02, 1.0]), (4, [-1.0, 0.0]), (4, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.near_duplicates(frame, margin=math.sqrt(0.2)).collect())
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (2, 1, 1, False), (3, 2, 0, False), (4, 0, 4, True), (4, 0, 4, True)]


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [("s", i, (rng.integers(-3, 4, 6) / 64).tolist(), "n", 0, 0) for i in range(300)]  # many ties
    rows += [("s", 400, None, "n", 0, 0), ("s", 420, [math.nan] * 6, "n", 0, 0), ("s", 440, [1.0] * 5, "n", 0, 0), ("s", 460, [None] * 6, "n", 0, 0),
             ("s", 480, [], "n", 0, 0), ("s", None, [1.0] * 6, "n", 0, 0), ("s", 501, [2.0] * 5, "n", 0, 0), ("s", 7, rows[7][2], "n", 0, 0)]
    got = sorted(tuple(r) for r in topk.query(spark.createDataFrame(rows, VECS)).collect())
    good = [(r[1], [math.floor(64 * float(np.float32(x))) for x in r[2]]) for r in rows
            if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    want = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q and len(w) == len(v))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.query(spark.createDataFrame([], VECS)).count() == 0


def test_topk_of_values_beyond_double_precision(spark):
    rows = [("s", i, [x, 1.0], "n", 0, 0) for i, x in [(0, 1e7), (1, 1e7), (2, 3e30), (3, -3e30), (4, 1.0)]]
    got = [(r.rank, r.vec_id, r.score) for r in topk.query(spark.createDataFrame(rows, VECS)).orderBy("rank").collect()]
    x = int(np.float32(1e7)) * 64
    assert got == [(1, 2, 2**63 - 1), (2, 1, x * x + 4096), (3, 4, x * 64 + 4096), (4, 3, -2**63)]

"""Ranked lexical search: NRA against scores of all documents, stopping, and edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import nra

DOCS = "rank string, doc_id bigint, text string, score string, item_id string, n int"
ITEMS = "score string, item_id bigint, text string, doc_id string, item int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, rows):
    return spark.createDataFrame([("x", i, t, "y", "z", 1) for i, t in rows], DOCS)


def _items(spark, rows):
    return spark.createDataFrame([("x", i, t, "y", 1) for i, t in rows], ITEMS)


def _brute(docs, items, k=nra.K):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    count, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    text = "Don't STOP: Ünïcode—dash, über-a1 x\x7fy z İ"
    assert [t.decode() for t in nra.terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("step, held", [(1, 300), (32, nra.SHARD_TERMS)])
def test_search_equals_brute_force(spark, monkeypatch, step, held):
    monkeypatch.setattr(nra, "FIRST_READ", step)
    monkeypatch.setattr(nra, "SHARD_TERMS", held)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["Über", "the", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 400])))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "--- !"), (None, "the the"), (None, "the the"), (903, "the the"), (904, "the the"),
             (7, docs[7][1]), (905, "rare " * 50 + "the " * 20_000)]
    docs += [(2000 + i, "same copy of it the w1") for i in range(80)]  # more ties than ranks
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, "unknownterm"), (53, "THE über the RARE"), (53, "THE über the RARE"), (None, "same copy"), (54, "same w1")]
    want = _brute(docs, items)
    assert _got(nra.search(_docs(spark, docs).repartition(5), _items(spark, items))) == want
    monkeypatch.setattr(nra, "BLOCK_BYTES", 200)  # several blocks of items
    assert _got(nra.search(_docs(spark, docs).repartition(3), _items(spark, items))) == want


def test_empty_tables(spark):
    docs, items = _docs(spark, [(1, "a b"), (2, None)]), _items(spark, [(1, "a")])
    assert nra.search(docs.limit(0), items).count() == 0 and nra.search(docs, items.limit(0)).count() == 0
    assert nra.search(docs.where("doc_id = 2"), items).count() == 0
    assert _got(nra.search(docs, items)) == _brute([(1, "a b"), (2, None)], [(1, "a")])
    assert nra.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_early():
    """The intervals settle before long lists are read to their ends."""
    n = 50_000
    lists = nra.Lists.__new__(nra.Lists)
    lists.size = n
    lists.doc = np.concatenate([np.arange(n), np.arange(n)])
    lists.value = np.concatenate([np.r_[np.arange(10**6, 10**6 - 40, -1), np.full(n - 40, 10)]] * 2)
    lists.terms, lists.bounds = np.array([0, 1]), np.array([0, n, 2 * n])
    seen = []
    old = lists.of
    lists.of = lambda t: tuple(x.view(_Watched) for x in old(t))
    _Watched.log = seen
    place, score = nra.best(lists, {0: 3, 1: 5}, 20)
    assert sorted(place.tolist()) == list(range(20)) and score.max() == 8 * 10**6
    assert max(seen) < 1000


class _Watched(np.ndarray):
    log: list = []

    def __getitem__(self, key):
        self.log.append(key.start if isinstance(key, slice) else key)
        return super().__getitem__(key).view(np.ndarray) if isinstance(key, slice) else super().__getitem__(key)

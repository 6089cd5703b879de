"""Repeated lines: brute force, hot lines, and edge rows."""

import hashlib
import random

import numpy as np
import pytest

from churnlens.llm import lines

DOCS = "score string, doc_id bigint, text string, mark string, keep int, n string"


def _frame(spark, rows):
    """(doc_id, text) rows and columns that clash with working names."""
    return spark.createDataFrame([("x", i, t, "m", 1, "n") for i, t in rows], DOCS)


def _brute(rows, least=lines.LEAST):
    """(doc_id, n_lines, n_dropped, digest) per row; a null doc_id is one document after all others."""
    last = float("inf")
    first = {}
    cut = [(last if i is None else i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: lines.line_key(x.encode()).decode()
    for i, text in cut:
        for x in text:
            first[key(x)] = min(first.get(key(x), last), i)
    out = []
    for i, text in cut:
        kept = [x for x in text if len(key(x)) < least or first[key(x)] == i]
        out.append((None if i == last else i, len(text), len(text) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


EDGE = [
    (3, "A boilerplate line\n\tA BOILERPLATE line \r\nshort\nshort\nown line of three"), (1, "short\nÀ boilerplate line\na boilerplate LINE"),
    (2, None), (4, ""), (5, "\n\n\n"), (None, "a boilerplate line\nonly where no id is"), (None, "only where no id is\n\nx"),
    (6, "one text of six, twice"), (6, "one text of six, twice"), (6, "one text of six, twice\nother text of six"), (7, "other text of six\none text of six, TWICE"),
    (8, "ÀÀÀÀÀÀÀÀÀ\nÀÀÀÀÀÀÀÀÀÀ\nàààààààààà"), (9, "ÀÀÀÀÀÀÀÀÀ\nÀÀÀÀÀÀÀÀÀÀ\nàààààààààà"), (10, "\x1c1234567890\x0b\n1234567890\x85"), (11, "1234567890\n 1234567890\x85"),
]


def test_edges_equal_brute_force(spark):
    docs = _frame(spark, EDGE)
    assert _got(lines.query(docs)) == _brute(EDGE)
    assert lines.query(docs.limit(0)).count() == 0 and lines.keep_bitmaps(docs.limit(0)).count() == 0
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    assert {r.doc_id: r.text for r in kept.where("doc_id in (1, 2, 3)").collect()} == {
        1: EDGE[1][1], 2: None, 3: "short\nshort\nown line of three"}


@pytest.mark.parametrize("parts", ["3", "40"])
def test_hot_lines_equal_brute_force(spark, parts):
    """A line in most documents, copies of whole rows and one very long text, over few and many tasks."""
    rng = random.Random(5)
    pool = [f"line number {k} of the pool" for k in range(60)]
    rows = [(rng.choice([i, i, None]), "\n".join(rng.choices(pool, k=rng.randint(1, 12)) + ["the same footer everywhere"] * rng.randint(0, 3))) for i in range(400)]
    rows += [rows[7]] * 150 + [(1000, "\n".join(rng.choice(pool) if i % 3 else f"own {i} of the long one" for i in range(30_000)))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = _frame(spark, rows).repartition(int(parts))
        assert _got(lines.query(docs)) == _brute(rows)
        maps = {(r.doc_id, r.n_lines): r for r in lines.keep_bitmaps(docs).where("doc_id = 1000").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (found,) = maps.values()
    bits = lines.unpack_keep(found.keep, found.n_lines)
    assert len(bits) == 30_000 and (~bits).sum() == found.n_dropped and len(found.keep) < 30_000 / 8 + 100


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    for n in [1, 7, 8, 9, 1000]:
        gone = np.flatnonzero(rng.random(n) < 0.3)
        bits = lines.unpack_keep(lines.pack_keep(n, gone), n)
        assert len(bits) == n and (np.flatnonzero(~bits) == gone).all()

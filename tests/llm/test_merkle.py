"""Merkle manifest: brute force over whole trees, ranks in bitmaps, tampering and edge rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import merkle

DOCS = "place string, doc_id bigint, text string, lang string, source string, n_chars bigint, grp int, leaf string, root string"


def _frame(spark, rows):
    """(doc_id, text, lang, source, n_chars) rows and columns that clash with working names."""
    return spark.createDataFrame([("x", *r, 1, "y", "z") for r in rows], DOCS)


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(_field(doc_id), _field(source), _field(lang), _field(n_chars), _field(text))


def _tree(nodes):
    """Root, and the siblings of every node from the lowest level up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(nodes):
                paths[k].append(nodes[p ^ 1])
        nodes = [_h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], paths


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        trees.append((own, *_tree([_leaf(*r) for r in own])))
    root, upper = _tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for r, path in zip(own, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            out.append((r[0], _leaf(*r), subroot, root, _h(*path, *above), not changed))
    return sorted(out, key=str)


def _got(df):
    rows = df.collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows), key=str)


EDGE = [(5, "five", "en", "a", 4), (2, None, "en", None, None), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (None, "", "en", "", 0),
        (-7, "negative", "en", "a", 8), (2**62, "large", "en", "a", 5), (-2**63, "least", "en", "a", 5), (2**63 - 1, "most", "en", "a", 4),
        (9, "twice", "fr", "b", 5), (9, "twice", "fr", "b", 5), (9, "another text", "fr", "b", 5), (8, "alone", None, "c", 5), (8, "alone", "", "c", 5),
        (8, "ünï", "ñ", "é", 3), (8, "emoji", "\U0001F600", "c", 5), (8, "private", "", "c", 7), (10, "x" * 300_000, "fr", "b", 300_000)]


def test_edges_equal_brute_force(spark):
    docs = _frame(spark, EDGE)
    assert _got(merkle.query(docs)) == _brute(EDGE)
    assert _got(merkle.query(_frame(spark, EDGE[:1]))) == _brute(EDGE[:1])  # a lone leaf is subroot and root
    empty = merkle.query(docs.limit(0))
    assert empty.count() == 0 and empty.columns == merkle.query(docs).columns


@pytest.mark.parametrize("small", [True, False])
def test_many_blocks_equal_brute_force(spark, monkeypatch, small):
    """Dense, sparse and repeated ids, a hot id, more groups than a block, several levels of blocks."""
    if small:
        monkeypatch.setattr(merkle, "BLOCK", 2)
    rng = random.Random(6)
    rows = [(i, f"text {i}", rng.choice(["en", "en", "de", None]), "s", i) for i in range(1500)]
    rows += [(rng.randrange(-2**63, 2**63), "sparse", "en", None, rng.choice([None, 3])) for _ in range(400)]
    rows += [(77, rng.choice(["same", "copy"]), "en", "s", 4) for _ in range(700)] + [(None, "none", "de", "s", 4)] * 300
    rows += [(1, "one of a group", f"lang {k}", "s", 14) for k in range(30 if small else 1100)]
    rng.shuffle(rows)
    assert _got(merkle.query(_frame(spark, rows).repartition(6))) == _brute(rows)


def test_places_are_ranks(spark):
    ids = random.Random(8).sample(range(-40_000, 90_000), 20_000)
    rows = spark.createDataFrame([("g", i, bytes(32), None) for i in ids], "grp string, id bigint, leaf binary, tag binary")
    got = merkle.placed(rows.repartition(9)).select("id", "place", "total").toPandas()
    want = {i: k for k, i in enumerate(sorted(ids))}
    assert (got.place == got.id.map(want)).all() and (got.total == len(ids)).all()
    maps = merkle.bitmaps(rows.withColumn("chunk", F.shiftright("id", merkle.CHUNK)).withColumn("low", F.col("id").bitwiseAND(merkle.SIDE - 1).cast("int")))
    sizes = maps.select("chunk", F.octet_length("bitmap").alias("bytes"), "n").toPandas()
    assert sizes.chunk.is_unique and (sizes.bytes <= np.minimum(2 * sizes.n, merkle.SIDE // 8)).all()


def test_fold_follows_any_leaf():
    for n in [1, 2, 3, 5, 8, 13]:
        nodes = [_h(str(i)) for i in range(n)]
        root, paths = _tree(nodes)
        assert all(merkle.fold(x, p, (i, n)) == root for i, (x, p) in enumerate(zip(nodes, paths)))
        if n > 1:
            assert merkle.fold(_h("other"), paths[0], (0, n)) != root

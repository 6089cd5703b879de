"""Chat formatting, token rollups, token-id files and packing: round trips and edge rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import bpe, chat, counts, idfile, pack, queries

SF = "/root/testdata/sf0.001"
CONV = "formatted string, conv_id bigint, turn int, role string, text string, turns string"
DOCS = "start string, doc_id bigint, text string, ids binary, length int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ["documents", "conversations", "embeddings", "benchmark"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda f: sorted(map(tuple, f[cols].astype(str).values))
    assert key(got) == key(want)


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    parts = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|", "<", "|", "<||", "\n", "user", "ok", "\\", "\\n", "\\s", "é", "👍", ""]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "sys\ntem", "a\\n<|", None])
            rows.append(("x", conv, turn, role, rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 8)))]), "y"))
    rows += [("x", 100, 1, "user", "tie b", "y"), ("x", 100, 1, "user", "tie a", "y"), ("x", 100, 1, "user", "tie a", "y"),
             ("x", None, 0, "assistant", "no conversation", "y"), ("x", 101, None, "user", "null first", "y"), ("x", 101, 0, "user", "b", "y")]
    got = {r.conv_id: r for r in chat.digest(chat.read_chat(chat.format_chat(spark.createDataFrame(rows, CONV)))).collect()}
    by = {}
    for _, conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
    assert got[100].n_messages == 1


def test_chat_empty_and_plan(spark):
    empty = spark.createDataFrame([], CONV)
    assert chat.format_chat(empty).count() == 0
    plan = chat.query(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", "one two three", 9), ("a", "en", "one", 9), (None, None, None, 9)],
                                 "source string, lang string, text string, n_tokens int")
    r = counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    for _ in range(2):
        r.commit("1", counts.changes(docs, "words-1"))
    total = lambda: {(x.source, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert total() == {("a", "words-1"): (2, 4), (None, "words-1"): (1, 0)}
    one = docs.where("text = 'one'")
    for _ in range(2):
        r.commit("2", counts.revisions(one, F.col("text"), F.lit("x y z w"), "words-1"))
    assert total()[("a", "words-1")] == (2, 7)
    r.commit("3", counts.changes(docs.where("text = 'one two three'"), "words-1", -1))
    assert total()[("a", "words-1")] == (1, 4)
    r.commit("4", counts.changes(docs.limit(0), "words-2"))
    # a batch without its marker does not count
    r.commit("5", counts.changes(docs, "words-1"))
    (tmp_path / "r" / "5" / "_SUCCESS").unlink()
    assert total()[("a", "words-1")] == (1, 4) and r.committed() == ["1", "2", "3", "4"]


def test_repeated_commit_that_dies_leaves_totals(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", "en", "one two"), ("b", "en", "x")], "source string, lang string, text string")
    r = counts.Rollup(spark, str(tmp_path / "r"))
    total = lambda: sorted((x.source, x.n_docs, x.n_tokens) for x in r.totals().collect())
    r.commit("1", counts.changes(docs, "words-1"))
    r.commit("2", counts.changes(docs.where("source = 'a'"), "words-1"))
    want = [("a", 2, 4), ("b", 1, 1)]
    assert total() == want
    with monkeypatch.context() as m:  # after the attempt is written, before the marker names it
        m.setattr(counts.Rollup, "_switch", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            r.commit("1", counts.changes(docs.limit(0), "words-1"))
    assert total() == want and len(list((tmp_path / "r" / "1").glob("attempt-*"))) == 2
    r.commit("1", counts.changes(docs, "words-1"))
    assert total() == want and len(list((tmp_path / "r" / "1").glob("attempt-*"))) == 1
    # folding keeps totals, also when it dies before the folded folders are gone
    r.compact()
    assert total() == want and r.committed() == ["1", "2"] and not (tmp_path / "r" / "1").exists()
    with pytest.raises(ValueError):
        r.commit("2", counts.changes(docs, "words-1"))
    r.commit("3", counts.changes(docs.where("source = 'b'"), "words-1", -1))
    assert total() == [("a", 2, 4), ("b", 0, 0)]
    r.compact()
    assert total() == [("a", 2, 4), ("b", 0, 0)] and r.committed() == ["1", "2", "3"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    rng = random.Random(1)
    enc = bpe.Encoder(bpe.default_path(name))
    texts = ["", " ", "a  b   c", "a\n b\n\n c \n", "don't we'll I'VE", "<|endoftext|> a<|endoftext|>b", "é ́x J̌",
             "\x1c \x1d a", "x  y", "İI ıi", "日本語 テキスト", "a ​b", "word,word.", "x" * 5000]
    alphabet = list(" \n\t ab'sZé  ́<|>1,.\x1d日")
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(400)]
    for _ in range(2):
        ids, n = enc.encode([t.encode() for t in texts])
        want = [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_elias_fano_select():
    rng = np.random.default_rng(2)
    for n, top in [(0, 1), (1, 0), (1, 10**12), (1000, 5), (5000, 10**6), (300, 2**62)]:
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        ef = idfile.EliasFano.load(idfile.EliasFano.of(v).dump())
        assert (ef.select(np.arange(n)) == v).all()
        if n:
            pick = rng.integers(0, n, 50)
            assert (ef.select(pick) == v[pick]).all()
    v = np.cumsum(rng.integers(1, 1000, 100_000))
    assert len(idfile.EliasFano.of(v).dump()) < len(v) * 12 / 8  # against 64 bits each


def _docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [("s", 7 * i - 50, " ".join(rng.choices(words, k=rng.randint(0, 80))), b"", 1) for i in range(120)]
    rows += [("s", 9001, None, b"", 1), ("s", 9002, "", b"", 1), ("s", None, "no id", b"", 1), ("s", 6, "twice", b"", 1), ("s", 6, "twice", b"", 1),
             ("s", 9003, " ".join(rng.choices(words, k=30_000)), b"", 1)]
    return spark.createDataFrame(rows, DOCS), rows


def test_id_files_round_trip(spark, tmp_path):
    docs, rows = _docs(spark)
    path = bpe.default_path("byte_bpe_50k.json")
    files = idfile.write_ids(docs, str(tmp_path / "ids"), path, max_ids=2000)
    assert len(files) > 8 and all(not f.name.startswith("_") for f in (tmp_path / "ids").iterdir())
    got = sorted(idfile.read_ids(spark, str(tmp_path / "ids"), files).collect(), key=lambda r: r.start)
    lib = bpe.Encoder(path).lib
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
    want = [lib.encode(r[2] or "", add_special_tokens=False).ids + [0] for r in order]
    assert [r.doc_id for r in got] == [r[1] for r in order]
    assert [r.n_tokens for r in got] == [len(w) for w in want]
    assert [r.start for r in got] == (np.cumsum([len(w) for w in want]) - [len(w) for w in want]).tolist()
    assert [zlib.crc32(bytes(r.ids)) for r in got] == [idfile.crc32_of(w) for w in want]
    assert idfile.query(docs.limit(0)).count() == 0


def test_packing_places_every_id_once(spark):
    docs, rows = _docs(spark)
    path = bpe.default_path("word_bpe_49k.json")
    got = pack.pack(docs, path, end_id=2, capacity=256, group_tokens=5000).toPandas()
    lib = bpe.Encoder(path).lib
    want = {}
    for r in rows:
        want.setdefault(r[1], []).append(lib.encode(r[2] or "", add_special_tokens=False).ids + [2])
    for doc_id, part in got.groupby("doc_id", dropna=False):
        key = None if doc_id != doc_id else int(doc_id)
        assert part.length.sum() == sum(map(len, want[key]))
        if len(want[key]) == 1:
            assert b"".join(part.sort_values("start").ids) == np.array(want[key][0], "<u4").tobytes()
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        total = int(part.length.sum())
        assert total <= 256 and total & (total - 1) == 0  # full, or a power of two
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist()
    assert pack.query(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack.pack(docs, path, 2, capacity=100)


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 900).tolist()
    pieces = pack.assign(sizes, 1024, 1.0, 0.01)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + 0.01 * n * n
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 1024]
    assert max(full) < 1.6 * np.median(full) and len(pieces) < 1.3 * len(sizes)


def test_encoding_holds_little_beside_the_texts():
    """4 MB of texts are encoded in steps, in less than 64 MB, with the same ids as one by one."""
    import tracemalloc

    rng = np.random.default_rng(5)
    words = [b"w%d" % k for k in range(20_000)]
    texts = [b" ".join(words[k] for k in rng.integers(0, len(words), 300)) for _ in range(2_300)]
    enc = bpe.Encoder(bpe.default_path("word_bpe_49k.json"))
    tracemalloc.start()
    ids, n = enc.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = [enc.encode([t])[0] for t in texts[:40]]
    assert sum(map(len, texts)) > 4_000_000 and n.sum() == len(ids) and len(n) == len(texts)
    assert np.array_equal(np.concatenate(alone), ids[:n[:40].sum()])
    assert peak < 64 << 20
    assert [len(x) for x in enc.encode([])] == [0, 0]

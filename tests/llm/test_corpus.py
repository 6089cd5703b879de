"""Mixing, toxicity, passages and the pipeline: brute force, held-out accuracy and edge rows."""

import random
import zlib

import numpy as np
import pytest

from churnlens.llm import mix, passages, queries, toxicity
from churnlens.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "score string, doc_id bigint, text string, lang string, source string, n_chars bigint, target string, rules int"


def _frame(spark, rows):
    """(doc_id, text, source) rows with the columns of documents and some that clash with working names."""
    return spark.createDataFrame([("x", i, t, "en", s, len(t or ""), "y", 1) for i, t, s in rows], DOCS)


# ---- mixing

def test_targets_share_and_cap():
    got = mix.targets({"a": 100, "b": 1000, "c": 10, "d": 890, None: 0})
    assert sum(got.values()) == pytest.approx(2000)
    assert all(got[s] <= 3 * n + 1e-9 for s, n in {"a": 100, "b": 1000, "c": 10, "d": 890, None: 0}.items())
    assert got["a"] == 300 and got["c"] == 30 and got[None] == 0
    # what is left is shared by weight: b has 2, d (fourth) has 5
    assert got["d"] / got["b"] == pytest.approx(2.5)
    assert mix.targets({}) == {} and mix.targets({None: 5}) == {None: 5.0}


def test_mix_meets_targets(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 50, 200])), rng.choice(["a", "b", "b", "b", "c", "ü", None])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "b"), (None, "no id", "c"), (7, rows[7][1], rows[7][2]), (5002, None, "none")]
    docs = _frame(spark, rows)
    got = mix.query(docs).toPandas()
    assert sorted(got.columns) == ["doc_id", "size", "source_size", "taken", "target"] and len(got) == len(rows)
    assert got["size"].tolist().count(0) == 3 and (got.taken <= 3 * got["size"]).all()
    full = mix.mix(docs).toPandas()
    sizes = full.groupby("source", dropna=False)["size"].sum()
    want = mix.targets({None if k != k else k: int(v) for k, v in sizes.items()})
    for source, part in full.groupby("source", dropna=False):
        goal = want[None if source != source else source]
        assert part.target.iloc[0] == pytest.approx(goal) and part.source_size.iloc[0] == part["size"].sum()
        assert (part["size"] * part.copies).sum() == pytest.approx(goal, rel=0.01, abs=1)
        # rates meet the constraint before rounding and are tilted by size alone
        assert (part["size"] * part.rate).sum() == pytest.approx(goal, rel=1e-5, abs=1e-6)
        assert part[part["size"] > 0].groupby("size").rate.nunique().max() in (1, np.nan) or goal == 0
    monkeypatch.setattr(mix, "MOST_SOURCES", 0)  # the joins without a broadcast, over salted shares
    again = mix.query(docs.repartition(7)).toPandas()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).values))
    assert key(again) == key(got)
    copies = mix.copies(docs)
    assert copies.columns == docs.columns and copies.count() == int(full.copies.sum())
    assert mix.query(docs.limit(0)).count() == 0 and mix.copies(docs.limit(0)).count() == 0


# ---- toxicity

@pytest.fixture(scope="module")
def chars():
    words = "you are an idiot moron worthless stupid loser clown trash scum the house this boat little letter sitting".split()
    counts = {}
    for w in words:
        s = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(s) - 2):
            counts[s[i:i + 3]] = counts.get(s[i:i + 3], 0) + 1
    return toxicity.CharModel(counts)


@pytest.mark.parametrize("noisy, plain", [
    ("You 1d10t m0r0n", "you idiot moron"), ("i d i o t", "idiot"), ("s.c.u.m!", "scum!"), ("stuuuupid", "stupid"),
    ("w0rthle$s l0s3r", "worthless loser"), ("tr4sh, cl0wn", "trash, clown"), ("the little letter", "the little letter"),
    ("reed*** of%%% 12.5 2024", "reed*** of%%% 12.5 2024"), ("", "")])
def test_restore(chars, noisy, plain):
    assert toxicity.restore(noisy, chars) == plain


def test_decode_is_the_best_path(chars):
    """Viterbi against all readings of a short string."""
    def cost(word):
        s = toxicity.EDGE * 2 + word + toxicity.EDGE
        return sum(chars.logp(s[i:i + 2], s[i + 2]) for i in range(len(s) - 2))

    for noisy in ["m0r0n", "1d10t", "b0at", "5cum", "l1ttl3"]:
        readings = [("", 0.0)]
        for c in noisy:
            options = [(c, 0.0 if c.isalpha() else toxicity.KEEP)] + [(x, toxicity.LOOK) for x in toxicity.SHAPES.get(c, "")]
            readings = [(w + x, p + q) for w, p in readings for x, q in options]
        best = max(readings, key=lambda r: r[1] + cost(r[0]))[0]
        assert toxicity.decode(noisy, chars) == best


def test_heavily_hidden_words_are_restored():
    words = "asshole dumbass shit idiot moron scum as the and word plain hole class pass grass shirt ship ass hello well said ass dumbass".split()
    counts = {}
    for w in words:
        s = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(s) - 2):
            counts[s[i:i + 3]] = counts.get(s[i:i + 3], 0) + 20
    chars = toxicity.CharModel(counts)
    hidden = {"dumba$$": "dumbass", "a$$": "ass", "sh!+": "shit", "@$$h0l3": "asshole", "4$$h0l3": "asshole", "5h17": "shit",
              "id" + "i" * 5000 + "ot": "idiot", "$ h i t": "shit", "i.d.!.o.t": "idiot", "word!": "word", "(word": "word",
              "1234": "1234", "$5.00": "$5.00", "50$": "50$", "2024-01-02": "2024-01-02", "***": "***"}
    assert {x: toxicity.restore(x, chars) for x in hidden} == hidden


def _labelled(spark, n=600):
    rng = random.Random(9)
    plain = ["".join(rng.choices("abdehlnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    bad, hidden = ["idiot", "moron", "scum"], {"idiot": "1d10t", "moron": "m o r o n", "scum": "$cum"}
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=40), int(rng.random() < 0.3)
        if toxic:
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), hidden[w] if i % 2 else w)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0, toxic))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_and_edge_rows(spark):
    rows, labels = _labelled(spark)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    edge = [(9001, None, "s"), (9002, "", "s"), (None, "idiot", "s"), (9003, "word " * 60_000 + "idiot", None), (3, rows[3][1], "s")]
    docs = _frame(spark, rows + edge)
    model = toxicity.fit(docs, labels.unionAll(spark.createDataFrame([(None, 1, 1), (5, None, None), (10**9, 0, 1)], labels.schema)))
    got = toxicity.score(docs, model).select("doc_id", "score").collect()
    held = [(r.score, known[r.doc_id]) for r in got if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[9001] == by[9002] and max(by[9001]) < 0.5 and min(by[9003]) >= 0.5 and len(by[3]) == 1
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = _labelled(spark, 30)
    docs = _frame(spark, rows)
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert {round(r.score, 6) for r in none.collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_query_columns(spark):
    got = queries.QUERIES["op9_toxicity"](spark, SF).toPandas()
    docs = table(spark, SF, "documents").select("doc_id").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()


# ---- passages

def _words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(n)]


def _passage_rows(copies=40):
    rng = random.Random(12)
    common, fuzzy, short, rows, planted = _words(rng, 60), _words(rng, 80), _words(rng, 30), [], {}
    for i in range(0, 200):
        words = _words(rng, rng.randint(20, 200))
        if i % 200 < copies:
            at = rng.randrange(len(words))
            words[at:at] = common
            planted[i] = common
        elif i < 60:
            p = list(fuzzy)
            for k in range(5, 80, 16):  # an edit in about 16 words
                p[k] = rng.choice(["zz", "yy zz", ""])
            p = " ".join(p).split()
            at = rng.randrange(len(words))
            words[at:at] = p
            planted[i] = p
        elif i < 100:
            words[3:3] = short
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (None, " ".join(common), "s"), (502, " ".join(_words(rng, 30_000) + common), "s"),
             (503, " ".join(common), "s"), (1, rows[1][1], "s"), (504, " ".join(common * 3), "s")]
    planted |= {502: common, 503: common, 504: common}
    return rows, planted, (0, copies)


@pytest.mark.parametrize("hot", [False, True])
def test_passages_found_and_clean_documents_left(spark, monkeypatch, hot):
    rows, planted, firsts = _passage_rows()
    docs = _frame(spark, rows)
    if hot:  # all seeds split over salted groups
        every = [r.h for r in passages.seeds(docs.selectExpr("doc_id as doc", "text").where("doc is not null and text is not null"))
                 .select("h").distinct().collect()]
        monkeypatch.setattr(passages, "frequent", lambda *_: every)
        monkeypatch.setattr(passages, "SALTS", 5)
    got = passages.query(docs).toPandas()
    text = {i: t for i, t, _ in rows}
    assert set(got.doc_id) == set(planted) - set(firsts)
    for r in got.itertuples():
        assert r.source_id < r.doc_id and r.similarity >= 0.8
        span = text[r.doc_id].encode()[r.start:r.stop].decode().split()
        assert len(span) == r.n_words and abs(len(span) - len(planted[r.doc_id])) < 12 or r.doc_id == 504
    left = passages.without(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id: r for r in left.collect()}
    assert 503 not in kept and kept[0].text == text[0] and kept[500].text is None
    probe = " ".join(planted[502][20:40])
    for i in planted:
        if i < firsts[1] and i != 0:
            assert probe not in " ".join(kept[i].text.split()) and kept[i].n_chars == len(kept[i].text)
    for i in range(60, 200):
        assert kept[i].text == text[i]


def test_stars_across_batches(spark):
    """Links do not depend on how rows are cut into batches, and follow the i-th occurrence."""
    rng = random.Random(6)
    rows = sorted({(rng.randint(0, 6), rng.randint(0, 9), rng.randint(0, 400)) for _ in range(500)})
    by = {}
    for h, doc, pos in rows:
        by.setdefault(h, {}).setdefault(doc, []).append(pos)
    want = []
    for docs in by.values():
        first = min(docs)
        want += [(d, p, first, docs[first][i % len(docs[first])]) for d, places in docs.items() if d != first for i, p in enumerate(places)]
    frame = spark.createDataFrame(rows, "h bigint, doc bigint, pos int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set(key, size)
            got = [tuple(r) for r in passages.links(frame.repartition(1), []).collect()]
            assert sorted(got) == sorted(want)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("previous", [False, True])
def test_split_seeds_have_the_same_partners(spark, monkeypatch, previous):
    rng = random.Random(7)
    rows = sorted({(rng.randint(0, 4), rng.randint(0, 60), rng.randint(0, 300)) for _ in range(900)})
    by = {}
    for h, doc, pos in rows:
        by.setdefault(h, {}).setdefault(doc, []).append(pos)
    want = []
    for docs in by.values():
        order = sorted(docs)
        for k, d in enumerate(order[1:], 1):
            for src in {order[0], order[k - 1] if previous else order[0]}:
                want += [(d, p, src, docs[src][i % len(docs[src])]) for i, p in enumerate(docs[d])]
    frame = spark.createDataFrame(rows, "h bigint, doc bigint, pos int")
    monkeypatch.setattr(passages, "SALTS", 6)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("1", "10000"):
            spark.conf.set(key, size)
            for hot in ([], [1, 3], list(by)):
                assert sorted(tuple(r) for r in passages.links(frame, hot, previous).collect()) == sorted(want)
    finally:
        spark.conf.set(key, before)


def test_runs_of_one_word_are_passages_too(spark):
    rng = random.Random(2)
    texts = [" ".join(_words(rng, 30) + ["and"] * n + _words(rng, 30)) for n in (90, 70, 200)]
    got = passages.query(_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).toPandas()
    assert got[got.doc_id == 1].n_words.max() >= 65 and got[got.doc_id == 2].n_words.sum() >= 150


def test_runs_whose_pieces_are_in_earlier_documents(spark):
    rng = random.Random(31)
    rows, runs = [], {}
    for k in range(0, 60, 6):
        run = _words(rng, 62)
        lone = lambda n: _words(rng, n)
        lines = [run[i:i + 10] for i in range(0, 60, 10)]
        texts = [lone(20) + run[:35] + lone(20), lone(20) + run[30:] + lone(20), sum([x + lone(3) for x in lines[::-1]], []),
                 lone(9) + run[5:53] + lone(30), lone(30) + run + lone(20), lone(10) + run + lone(40)]
        rows += [(k + i, " ".join(x), "s") for i, x in enumerate(texts)]
        runs[k + 5] = " ".join(run)
    text = {i: t.encode() for i, t, _ in rows}
    got = {(r.doc_id, r.source_id): text[r.doc_id][r.start:r.stop].decode() for r in passages.query(_frame(spark, rows)).collect()}
    for i, run in runs.items():
        assert run in got.get((i, i - 1), "")


def test_long_links_are_all_shared_runs(spark):
    """Every run of 12 words against a look at all of them, whatever is hot."""
    rng = random.Random(33)
    pool = [rng.choices("abc", k=30) for _ in range(6)]
    texts = [sum((rng.choice(pool)[rng.randrange(20):] for _ in range(4)), []) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc bigint, text string")
    first = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 11):
            first.setdefault(tuple(t[j:j + 12]), i)
    want = {(i, first[tuple(t[j:j + 12])]) for i, t in enumerate(texts) for j in range(len(t) - 11)}
    got = {(r.doc, r.src) for r in passages.long_links(docs, 12, 2).collect()}
    assert got == {(i, s) for i, s in want if i != s}


def test_fuzzy_passages_equal_brute_force(spark):
    """A substitution every n words (similarity 0.833 to 0.9): all that an alignment from any shared shingle finds."""
    rng = random.Random(41)
    rows, pairs = [], {}
    for k in range(120):
        n, shared = (6, 7, 8, 10)[k % 4], _words(rng, 62)
        other = [w if i % n != n - 1 else "zz" + w for i, w in enumerate(shared)]
        x, y = (" ".join(_words(rng, 30) + z + _words(rng, 30)) for z in (shared, other))
        rows += [(2 * k, x, "s"), (2 * k + 1, y, "s")]
        pairs[2 * k + 1] = (x.encode(), y.encode())
    want = set()
    for i, (x, y) in pairs.items():
        (_, hx, px), (_, hy, py) = (passages.seeds_of([z], 5, 1, 50) for z in (x, y))
        at = {h: p & passages.BYTE for h, p in zip(hx.tolist(), px.tolist())}
        if any(passages.align((x, 0, False, False), (y, 0, False, False), [at[h]], [p & passages.BYTE], 50, 0.8)
               for h, p in zip(hy.tolist(), py.tolist()) if h in at):
            want.add(i)
    got = {r.doc_id for r in passages.query(_frame(spark, rows)).collect() if r.source_id == r.doc_id - 1}
    assert len(want) > 100 and want <= got


def test_fuzzy_passages_quoted_in_pieces(spark):
    """70 words with 7 substitutions (similarity 0.9), all of whose 5-word shingles stand in quotations of 14 words in documents
    before the first of the pair and between the two: nine in ten are found from their pairs of seeds."""
    rng = random.Random(43)
    rows, pairs = [], []
    for k in range(40):
        at, shared = k * 20, _words(rng, 70)
        other = list(shared)
        for i in range(7):
            other[10 * i + rng.randrange(10)] = f"zz{k}x{i}"
        lone = lambda n: _words(rng, n)
        quotes = lambda: [lone(25) + shared[i:i + 14] + lone(25) for i in range(0, 60, 10)]
        texts = [*quotes(), lone(30) + shared + lone(30), *quotes(), lone(30) + other + lone(30)]
        rows += [(at + i, " ".join(x), "s") for i, x in enumerate(texts)]
        pairs.append((at + 13, at + 6))
    got = {(r.doc_id, r.source_id) for r in passages.query(_frame(spark, rows)).collect()}
    assert got <= set(pairs) and len(got) >= 36, len(got)


def test_pairs_of_seeds_are_linked_past_other_partners():
    """Rows of one hash and few second seeds: the links against a look at all rows."""
    rng = random.Random(44)
    for _ in range(200):
        rows = sorted({(rng.randint(0, 1), rng.randint(0, 9), rng.randint(0, 300)) for _ in range(rng.randint(1, 40))})
        second = [rng.randint(0, 3) for _ in rows]
        got = set(zip(*[x.tolist() for x in passages.pair_links(*[np.array(x) for x in (*zip(*rows), second)])]))
        want = set()
        for (h, doc, pos), s in zip(rows, second):
            known = set()
            for same in ([r for r in rows if r[0] == h], [r for r, z in zip(rows, second) if r[0] == h and s and z == s]):
                before = sorted({d for _, d, _ in same if d < doc})
                for src in {*before[:1], *before[-1:]} - known:
                    places = [p for _, d, p in same if d == src]
                    rank = [p for _, d, p in same if d == doc].index(pos) if same else 0
                    want.add((doc, pos, src, places[rank % len(places)]))
                known |= {*before[:1], *before[-1:]}
        assert got == want


def test_passages_of_long_words(spark):
    """Words of 80 to 200 bytes without white space; more than a first cut on both sides of a short run."""
    rng = random.Random(21)
    long = lambda n, size: ["".join(rng.choices("abcdefghij", k=size)) for _ in range(n)]
    rows, want = [], {}
    for k, (size, n) in enumerate([(80, 60), (130, 60), (200, 60), (130, 200), (200, 200)]):
        shared = long(n, size)
        rows += [(2 * k, " ".join(long(20, size) + shared + long(20, size)), "s"), (2 * k + 1, " ".join(long(5, size) + shared + long(30, size)), "s")]
        want[2 * k + 1] = n
    got = {r.doc_id: r.n_words for r in passages.query(_frame(spark, rows)).collect()}
    assert got == want


def test_alignment_asks_for_more_text():
    rng = random.Random(22)
    shared = " ".join(_words(rng, 300)).encode()
    at = shared.index(b" ", 700) + 1
    whole = passages.align((shared, 0, False, False), (shared, 0, False, False), [at], [at], 50, 0.8)
    assert whole == [(0, len(shared), 300, 0, len(shared), 1.0)]
    part = passages._trimmed(shared[at - 400:at + 400], at - 400, len(shared))
    assert passages.align(part, part, [at], [at], 50, 0.8) is None


def test_alignment_takes_only_the_words_near_its_anchors(monkeypatch):
    """400 lone shingles in common, each in other words: what is looked at does not grow with the texts at every anchor."""
    rng = random.Random(23)
    x, y = ([f"{side}{i}" for i in range(40_000)] for side in "xy")
    a, b = [], []
    for k in range(100, 40_000, 100):
        x[k:k + 5] = y[k:k + 5] = _words(rng, 5)
    for z, at in ((x, a), (y, b)):
        ends = np.cumsum([0] + [len(w) + 1 for w in z])
        at += [int(ends[k]) for k in range(100, 40_000, 100)]
    seen, extend = [], passages._extend
    monkeypatch.setattr(passages, "_extend", lambda u, v, *more: (seen.append(len(u) + len(v)), extend(u, v, *more))[1])
    x, y = (" ".join(z).encode() for z in (x, y))
    assert passages.align((x, 0, False, False), (y, 0, False, False), a, b, 50, 0.8) == []
    assert sum(seen) < 400 * 2 * 400


def test_next_step_is_the_cheapest():
    rng = random.Random(24)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnop"])
        x, y = (["x" if k else "y", *rng.choices(letters, k=rng.randint(0, 25))] for k in (0, 1))
        ends = lambda z: [tuple(z[i:i + 2]) for i in range(len(z) if len(z) <= 25 else 25)]
        steps = [(max(p, q), abs(p - q), p < q, p, q) for p, u in enumerate(ends(x)) for q, v in enumerate(ends(y)) if u == v and p + q]
        assert passages._next_step(x, y, 24) == (min(steps)[3:] if steps else None)


def test_near_step_is_the_next_step():
    rng = random.Random(25)
    for _ in range(5000):
        x, y = ([rng.randrange(rng.choice([2, 4, 8])) for _ in range(rng.randint(0, 14))] for _ in "xy")
        near, step = passages._near_step(x[:5], y[:5]), passages._next_step(x, y, 24)
        assert near == step if near else step is None or max(step) > 3 or min(len(x), len(y)) < 5


def _edited(rng, words, rate, pool):
    out = []
    for w in words:
        kind = rng.random()
        out += [w] if kind > rate else rng.choices(pool, k=rng.randint(1, 4)) if kind > rate / 2 else []
    return out


@pytest.mark.parametrize("margin", [400, 1000])
def test_many_chains_at_a_time_are_told_as_one_by_one(margin):
    """Chance phrases, edited copies, repetitions, words of over 256 bytes, cuts within words: no chain is told otherwise."""
    rng, chains = random.Random(26), []
    for k in range(600):
        pool = [*_words(rng, rng.choice([3, 40, 2000])), "Long" * 90] if k % 7 else ["z" * 300 + c for c in "abc"]
        common = rng.choices(pool, k=rng.choice([5, 6, 12, 40, 60, 90]))
        x, y = (rng.choices(pool, k=rng.randint(0, 120)) + _edited(rng, common, rate, pool) + rng.choices(pool, k=rng.randint(0, 120))
                for rate in (0, rng.choice([0, 0.05, 0.2])))
        x, y = (rng.choice(["", " "]) + rng.choice([" ", "\n ", "\t"]).join(z) for z in (x, y))
        (_, hx, px), (_, hy, py) = (passages.seeds_of([z.encode()], 5, 1, 5) for z in (x, y))
        at = {h: p & passages.BYTE for h, p in zip(hx.tolist(), px.tolist())}
        both = sorted((p & passages.BYTE, at[h]) for h, p in zip(hy.tolist(), py.tolist()) if h in at)
        line = [z for n, z in enumerate(both) if all(u < z[1] for _, u in both[:n])][:rng.choice([1, 2, 5])]
        if line:
            cuts = [(z.encode()[max(0, q[0] - margin):q[-1] + margin], max(0, q[0] - margin), len(z))
                    for z, q in ((x, [u for _, u in line]), (y, [q for q, _ in line]))]
            chains.append((*cuts, [u for _, u in line], [q for q, _ in line]))
    src, doc = ([list(c) if k == 0 else np.array(c) for k, c in enumerate(zip(*z))] for z in list(zip(*chains))[:2])
    a, b = ((np.cumsum([0] + [len(c) for c in z]), np.concatenate(z)) for z in list(zip(*chains))[2:])
    said = passages.settle(src, doc, a, b, 50, 0.8)
    want = [passages.align(passages._trimmed(*x), passages._trimmed(*y), p, q, 50, 0.8) for x, y, p, q in chains]
    assert all(got is None for got, say in zip(want, said) if say == 1)
    assert all(got == [] for got, say in zip(want, said) if say == 0)
    assert (said == 0).sum() > 20 and (said > 0).sum() > 20


def test_chains_of_a_few_words_are_told_at_a_time():
    rng = random.Random(27)
    text = [_words(rng, 400) for _ in range(41)]
    for z in text[1:]:
        z[200:206] = text[0][200:206]
    said = passages.settle(*[([" ".join(z).encode() for z in side], np.zeros(40, int), np.array([len(" ".join(z)) for z in side]))
                             for side in (text[:1] * 40, text[1:])],
                           *[(np.arange(41), np.array([len(" ".join(z[:200])) + 1 for z in side])) for side in (text[:1] * 40, text[1:])], 50, 0.8)
    assert said.tolist() == [0] * 40


def test_frequent_hashes_are_not_joined(spark):
    frame = spark.createDataFrame([(h, d, 3) for h in (1, 2) for d in range(9)], "h bigint, doc bigint, pos bigint")
    plan = passages.links(frame, [1])._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    assert sorted(r.h for r in passages._of_hashes(frame, [2, 5], True).collect()) == [2] * 9
    assert sorted(r.h for r in passages._of_hashes(frame, [2, 5], False).collect()) == [1] * 9


@pytest.mark.parametrize("share", [1, 2])
def test_long_links_of_frequent_shingles_are_the_same(spark, monkeypatch, share):
    """All shingles, or every second one, are kept apart as frequent: the documents linked are those of none."""
    rng = random.Random(34)
    pool = [rng.choices("abc", k=30) for _ in range(6)]
    texts = [sum((rng.choice(pool)[rng.randrange(20):] for _ in range(4)), []) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc bigint, text string")
    want = {(r.doc, r.src) for r in passages.long_links(docs, 12, 2).collect()}
    monkeypatch.setattr(passages, "_sample", lambda docs: docs)
    monkeypatch.setattr(passages, "_often", lambda rows, parts: sorted(r.h for r in rows.select("h").distinct().collect())[::share])
    assert want and {(r.doc, r.src) for r in passages.long_links(docs, 12, 2).collect()} == want


def test_passages_of_nothing(spark):
    docs = _frame(spark, [])
    assert passages.query(docs).count() == 0 and passages.without(docs).count() == 0
    lone = _frame(spark, [(1, "a b c", "s"), (2, None, "s")])
    assert passages.query(lone).count() == 0 and passages.without(lone).count() == 2


def test_chain_equals_quadratic_dynamic_programme():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        b = np.sort(rng.integers(0, 400, n))
        a = rng.integers(0, 400, n)
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        best = np.full(n, passages.WEIGHT)
        for i in range(n):
            for j in range(n):
                if b[j] < b[i] and a[j] < a[i]:
                    best[i] = max(best[i], passages.WEIGHT + best[j] - passages.GAP * (a[i] + b[i] - a[j] - b[j]))
        first = passages.chain(a, b)[0]
        score = passages.WEIGHT * len(first) - passages.GAP * (a[first[-1]] + b[first[-1]] - a[first[0]] - b[first[0]])
        assert score == pytest.approx(best.max())
        assert sorted(k for c in passages.chain(a, b) for k in c) == list(range(n))


def test_every_shared_window_has_a_shared_seed():
    rng = random.Random(3)
    shared = _words(rng, passages.WINDOW + passages.SHINGLE - 1)
    for _ in range(50):
        x, y = (" ".join(_words(rng, 40) + shared + _words(rng, 40)).encode() for _ in range(2))
        _, hx, _ = passages.seeds_of([x], 5, 8, 50)
        _, hy, _ = passages.seeds_of([y], 5, 8, 50)
        assert set(hx.tolist()) & set(hy.tolist())


# ---- pipeline

def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    from churnlens.llm.common import written

    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and (name == "mix" or len(after) == len(set(after)))
        before = set(after)
    packed = pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == before and packed.groupby("sequence_id").length.sum().max() <= 4096
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_plain_words_keep_their_letters():
    words = "good keep soon all little three success business committee from free the god kep son al".split()
    counts = {}
    for w in words[:12]:
        s = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(s) - 2):
            counts[s[i:i + 3]] = counts.get(s[i:i + 3], 0) + 5
    chars = toxicity.CharModel(counts)
    for w in words[:12]:
        for marked in (w + "!", w + "!!", "(" + w, w + "***", "#" + w + "+", w + "$$$"):
            assert toxicity.features_of(marked, chars) == toxicity.features_of(w, chars), marked
            assert w in toxicity.restore(marked, chars)
    assert toxicity.restore("good! keep! soon! a$$$", chars) == "good keep soon a$$$"


@pytest.mark.parametrize("long", ["+" * 100_000 + "a", "*" * 100_000 + "a b", "-" * 100_000 + "a", "q" + "-" * 100_000 + "q", "q" + "+" * 100_000 + "q",
                                  "* " * 50_000 + "ab", "1" * 100_000 + "x", "$" * 100_000 + "x"])
def test_long_rows_of_marks_take_linear_time(chars, long):
    import time

    began = time.process_time()
    toxicity.restore(long, chars)
    toxicity.Reader(chars).read(long)
    assert time.process_time() - began < 1


def test_edges_of_histograms_equal_a_plain_walk(spark):
    """``_below`` against a walk over the rows in order: the cut up to which words fit, in bins of two rounds."""
    rng = np.random.default_rng(3)
    rows = [(int(k), int(rng.integers(1, 60)), float(np.round(rng.uniform(-1, 1), 7))) for k in rng.integers(0, 4, 1500)]
    need = {0: 300.0, 1: 0.0, 2: 1e9, 3: 4321.5, 4: 10.0}
    left = dict(need)
    got = mix._below(spark.createDataFrame(rows, "key int, size bigint, at double"), left)
    for k in need:
        below = sorted((a, n) for key, n, a in rows if key == k and a < got[k] - 1e-9)
        words = sum(n for _, n in below)
        assert words <= need[k] and left[k] == pytest.approx(need[k] - words, abs=61)
        rest = [n for key, n, a in rows if key == k and got[k] <= a < got[k] + 2 / mix.BINS**2 + 1e-9]
        assert not rest or words + sum(rest) > need[k]

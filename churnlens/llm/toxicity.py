"""Operator 9: toxicity scores after noisy-channel deobfuscation.

Restoring: a writer meant plain words, and a noisy channel replaced letters by
look-alikes (``SHAPES``), put separators between letters, or repeated letters.
A token that may have passed the channel (any look-alike in what is no number,
a letter three times in a row, or single characters in a row between separators) gives a
character lattice: keep a letter, read a look-alike as one of its letters, drop
a separator or keep it as a word break, drop a repetition (cheap in a run of
three or more, dear for a double letter). Viterbi finds the path with the highest
sum of channel costs and a character trigram model's log-probabilities.

The plain reading of a token, its letters between ordinary punctuation or a row
of one mark, is a path of its own without channel costs. Where the character
model has met all its trigrams it is taken at once, else it competes with the
lattice. All other tokens are taken as they are. Patterns are linear in a text.

Character model: trigrams over the distinct words of the whole corpus that
occur at least twice, so that copies and boilerplate weigh no more than other
text; counted by Spark from all documents, the vocabulary growing with them.
Punctuation around a word is taken off. Trigrams are over Latin, Greek and Cyrillic
letters (to U+052F), so what the driver gathers of them is bounded by the alphabets.

Scoring: logistic regression over the presence of restored words and word
beginnings. Features are chosen by their association with the label, then
fitted on at most ``FIT_ROWS`` labelled rows, taken by hash of doc_id among
rows whose crc32(doc_id as text) mod 5 is not 0. Only the text enters a score.

Labels are reduced to that bounded sample before they meet the documents, so no
text is shuffled; scoring is a map over all documents.

Defined cases: a null or empty text has no features and gets the score of such
texts; a null doc_id is not held out and has no label; a document with several
labels is toxic if any is; without labels of both kinds every score is the
share of toxic labels (0 without labels); repeated rows are scored alike; an
empty table gives no rows; texts are taken whole; further input columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, written

FIT_ROWS = 40_000
FEATURES = 2_000
MIN_DOCS, MIN_Z = 4, 5.0
PREFIXES = (4, 5, 6)
HELD = 60_000  # entries of a task's tables, in units; more are passed on or read again

#: Letters that a character may stand for.
SHAPES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
          "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "#": "h",
          "*": "aeiou"}
SEPARATORS = " .-_*,/~\t\n"
LOOK, ANY, DROP, BREAK, REPEAT, DOUBLE, KEEP = -0.7, -2.0, -0.4, -1.0, -0.3, -5.0, -9.0
EDGE = "\x02"
OUTER = "!(*#+|¡"  # look-alikes that may be punctuation before or after a word
DECORATION, ROW = 3, 9  # so many of one mark around a word, or of a mark or digit inside a token, are no letters
_MARKS = re.escape("".join(c for c in SHAPES if not c.isalnum()))
_LEAD = re.compile(rf"^[^\w{_MARKS}]+|(?<=[\w{_MARKS}])[^\w{_MARKS}]+$")
_SHAPED = re.compile("[" + re.escape("".join(SHAPES)) + "]")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(rf"(?<!\S)[\w{_MARKS}](?:[ .\-_,/~][\w{_MARKS}]|\*[^\W*]){{2,}}(?=[^\w\s]{{0,8}}(?:\s|$))")
_PLAINLY = re.compile(r"[$€£+\-#(*]*+[\d.,:/%+\-]*+[$€£%+*!]*+|([\W_])\1*+")  # numbers, amounts, rows of marks
_DECORATED = re.compile(rf"^([{_MARKS}])\1{{{DECORATION - 1},}}+|(?<!^)(?<![{_MARKS}])([{_MARKS}])\2{{{DECORATION - 1},}}+$")
_ROW = re.compile(rf"([{_MARKS}\d])\1{{{ROW - 1}}}")
_MARKED = re.compile(rf"([{_MARKS}])\1*+(?=\w)|(?<=\w)([{_MARKS}])\2*+$")  # a row of one mark before or after a word
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[a-zß-ԯ]+")
_ROUND = ".,;:!?\"'()[]{}<>…«»„“”‘’-–—"  # punctuation around words


class CharModel:
    """Character trigrams with back-off to shorter contexts."""

    def __init__(self, counts: dict[str, int]):
        three, two, one = Counter(), Counter(), Counter()
        for t, n in counts.items():
            three[t] += n
            two[t[1:]] += n
            one[t[2]] += n
        total, kinds = sum(one.values()) + 1.0, len(one) + 1
        self.one = {c: math.log((n + 0.5) / (total + 0.5 * kinds)) for c, n in one.items()}
        self.none = math.log(0.5 / (total + 0.5 * kinds))
        left2, left3 = Counter(), Counter()
        for t, n in two.items():
            left2[t[0]] += n
        for t, n in three.items():
            left3[t[:2]] += n
        weight = 8.0
        self.two = {t: math.log((n + weight * math.exp(self.one[t[1]])) / (left2[t[0]] + weight)) for t, n in two.items()}
        self.three = {t: math.log((n + weight * math.exp(self.two[t[1:]])) / (left3[t[:2]] + weight)) for t, n in three.items()}
        self.back2 = {c: math.log(weight / (n + weight)) for c, n in left2.items()}
        self.back3 = {c: math.log(weight / (n + weight)) for c, n in left3.items()}

    def knows(self, word: str) -> bool:
        """All trigrams of the word were met in other words."""
        s = EDGE + EDGE + word + EDGE
        return all(s[i:i + 3] in self.three for i in range(len(word) + 1))

    def price(self, word: str) -> float:
        """log P of the word and its end."""
        s = EDGE + EDGE + word + EDGE
        return sum(self.logp(s[i:i + 2], s[i + 2]) for i in range(len(word) + 1))

    def logp(self, context: str, c: str) -> float:
        """log P(c | the two characters before it)."""
        got = self.three.get(context + c)
        if got is not None:
            return got
        out = self.back3.get(context, 0.0)
        got = self.two.get(context[1] + c)
        if got is not None:
            return out + got
        return out + self.back2.get(context[1], 0.0) + self.one.get(c, self.none)


def decode(noisy: str, model: CharModel, spaced: bool = False) -> str:
    """Best path through the lattice of a lower-cased string. A state is the last two characters
    of the current word; ``spaced`` allows separators to be dropped or to break words."""
    return _viterbi(noisy, model, spaced)[0]


def _viterbi(noisy: str, model: CharModel, spaced: bool) -> tuple[str, float]:
    states: dict = {(EDGE + EDGE, ""): (0.0, None)}  # best cost and path, a chain of (path before, character)
    lead, trail = len(noisy) - len(noisy.lstrip(OUTER)), len(noisy.rstrip(OUTER))
    run = [len(r) for _, g in itertools.groupby(noisy) for r in [list(g)] for _ in r]  # of one character, around each place
    for at, c in enumerate(noisy):
        again = REPEAT if run[at] >= 3 else DOUBLE
        moves: list[tuple[str, float]] = []  # emitted character ("": none) and channel cost
        if c.isalpha():
            moves.append((c, 0.0))
        moves += [(x, ANY if c == "*" else LOOK) for x in SHAPES.get(c, "")]
        if spaced and c in SEPARATORS:
            moves += [("", DROP), (" ", BREAK)]
        elif not c.isalpha():
            moves.append((c, KEEP))
            if at < lead or at >= trail:
                moves.append(("", DROP))
        after: dict = {}
        for (context, last), (cost, out) in states.items():
            if last == c and c.isalpha():  # a repetition of what was just written
                key, got = (context, c), (cost + again, out)
                if key not in after or after[key][0] < got[0]:
                    after[key] = got
            for x, price in moves:
                if x == "":
                    key, got = (context, last), (cost + price, out)
                elif x == " ":
                    key = (EDGE + EDGE, "")
                    got = (cost + price + model.logp(context, EDGE), (out, " "))
                else:
                    key = (context[1] + x, c)
                    got = (cost + price + model.logp(context, x), (out, x))
                if key not in after or after[key][0] < got[0]:
                    after[key] = got
        states = after
    score, path = max(((cost + model.logp(context, EDGE), out) for (context, _), (cost, out) in states.items()), key=lambda x: x[0])
    read = []
    while path is not None:
        path, c = path
        read.append(c)
    return "".join(reversed(read)), score


def noisy_core(token: str) -> str | None:
    """The part of a lower-cased token that may have passed the channel; None for plain tokens."""
    core = _DECORATED.sub("", _LEAD.sub("", token))
    if len(core) < 3 or core.isalpha() and not _THRICE.search(core):
        return None
    if _PLAINLY.fullmatch(core) or _ROW.search(core) or not (_SHAPED.search(core) or _THRICE.search(core)):
        return None
    return core


def _spaced(text: str):
    """Single characters in a row between separators; without a letter they are rules or numbers."""
    return (m for m in _SPACED.finditer(text) if _LETTERS.search(m.group()))


def bare(core: str) -> str | None:
    """The letters of a token whose marks are punctuation or decoration around them; None for others."""
    at, to = 0, len(core)
    for m in _MARKED.finditer(core):
        if m.group()[0] in OUTER:
            at, to = (m.end(), to) if m.start() == 0 else (at, m.start()) if m.end() == len(core) else (at, to)
    word = core[at:to]
    return word if word.isalpha() and not _THRICE.search(word) else None


def reading(core: str, model: CharModel) -> str | None:
    """What a core means; None: just what stands there, with marks around it that belong to no known word."""
    word = bare(core)
    if word is None:
        return decode(core, model)
    if model.knows(word):
        return word
    other, score = _viterbi(core, model, False)
    return None if model.price(word) >= score else other


def restore(text: str, model: CharModel) -> str:
    """The text as its writer may have meant it, lower-cased."""
    def one(m):
        core = noisy_core(m.group())
        got = None if core is None else reading(core, model)
        return m.group() if got is None else m.group().replace(core, got)

    text, out, at = text.lower(), [], 0
    for m in _spaced(text):  # what comes out of these is not read again
        out += [re.sub(r"\S+", one, text[at:m.start()]), decode(m.group().replace("\n", " "), model, True)]
        at = m.end()
    return "".join([*out, re.sub(r"\S+", one, text[at:])])


def features_of(token: str, model: CharModel) -> tuple:
    """Words and word beginnings of a lower-cased token after restoring."""
    core = noisy_core(token)
    got = None if core is None else reading(core, model)
    out = []
    for w in _LETTERS.findall(token if got is None else got):
        if len(w) >= 3:
            out.append("=" + w)
            out += ["^" + w[:n] for n in PREFIXES if len(w) >= n]
    return tuple(out)


class Reader:
    """Features of texts, with what is known of tokens kept up to a bound."""

    def __init__(self, model: CharModel, index: dict[str, int] | None = None):
        self.model, self.index, self.known = model, index, {}
        self.keep = HELD if index is None else 4 * HELD  # without an index an entry holds its features' texts

    def _token(self, token: str) -> tuple:
        got = self.known.get(token)
        if got is None:
            got = features_of(token, self.model)
            if self.index is not None:
                got = tuple(self.index[f] for f in got if f in self.index)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[token] = got
        return got

    def read(self, text: str) -> set:
        text = text.lower()
        found = set()
        for m in _spaced(text):
            for w in decode(m.group().replace("\n", " "), self.model, True).split(" "):
                found.update(self._token(w))
        token = self._token
        for t in set(text.split()):
            got = token(t)
            if got:
                found.update(got)
        return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-case words of all documents, without punctuation around them."""
    def run(stream):
        import pyarrow as pa

        def rows(seen):
            good: Counter = Counter()
            for w, n in seen.items():
                w = w.strip(_ROUND)
                if _PLAIN.fullmatch(w):
                    good[w] += n
            good = list(good.items())
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in good], pa.string()), pa.array([n for _, n in good], pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in stream:
            for text in batch.column("text"):
                seen.update((text.as_py() or "").lower().split())
                if len(seen) > 3 * HELD:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, least: int = 2) -> CharModel:
    """Trigram model over the distinct words that all documents hold at least ``least`` times."""
    def run(stream):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in stream:
            for w in batch.column("word").to_pylist():
                s = EDGE + EDGE + w + EDGE
                seen.update(s[i:i + 3] for i in range(len(s) - 2))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["t", "n"])

    counts = vocabulary(docs).where(F.col("n") >= least).select("word").mapInArrow(run, "t string, n bigint") \
        .groupBy("t").agg(F.sum("n").alias("n")).collect()
    return CharModel({r["t"]: r["n"] for r in counts})


def _fit(rows: list[tuple[list[int], int]], n: int) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by Newton-like steps with bounded diagonal curvature."""
    label = np.array([y for _, y in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(f) + 1 for f, _ in rows])
    col = np.array([c for f, _ in rows for c in (*f, n)], np.int64)
    w = np.zeros(n + 1)
    ridge = np.append(np.full(n, 0.05), 1e-6)
    for _ in range(400):
        z = np.bincount(at, w[col], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(col, (p - label)[at], n + 1) + ridge * w
        # diagonal-bounded curvature keeps the step a descent without an n x n matrix
        size = np.bincount(at, minlength=len(rows))
        h = np.bincount(col, (p * (1 - p) * size)[at], n + 1) + ridge + 1e-3
        w -= g / h
    return w


class Model:
    """What scoring needs: the character model, the features and their weights."""

    def __init__(self, chars: CharModel, index: dict[str, int], weights: np.ndarray):
        self.chars, self.index, self.weights = chars, index, weights


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from all documents (characters) and at most ``fit_rows`` labelled ones (weights)."""
    docs = pick(docs, doc_id="doc_id bigint", text="text string")
    chars = char_model(docs)
    marks = pick(labels, doc_id="doc_id bigint", toxic="toxic int").where(
        F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)) \
        .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows rows of two numbers: the one broadcast
    sample = written(docs.join(F.broadcast(written(some, "label-sample")), "doc_id").select("text", "toxic"), "labelled")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        share = pos / max(1, pos + neg)
        return Model(chars, {}, np.array([30.0 if share == 1 else -30.0]))

    def count(stream):
        import pyarrow as pa

        reader, seen = Reader(chars), {}
        for batch in stream:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for f in reader.read(text or ""):
                    seen.setdefault(f, [0, 0])[toxic] += 1
                if len(seen) > 3 * HELD:
                    yield rows(pa, seen)
                    seen = {}
        yield rows(pa, seen)

    def rows(pa, seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                                           pa.array([v[0] for v in seen.values()], pa.int64())], ["f", "p", "q"])

    counts = sample.mapInArrow(count, "f string, p bigint, q bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = (F.col("p") + F.col("q")) / F.lit(float(pos + neg))
    z = (F.col("p") / F.lit(float(pos)) - F.col("q") / F.lit(float(neg))) / F.sqrt(
        both * (1 - both) * F.lit(1 / pos + 1 / neg) + F.lit(1e-12))
    chosen = counts.where(F.col("p") + F.col("q") >= MIN_DOCS).withColumn("z", z).where(F.abs("z") >= MIN_Z) \
        .orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).collect()
    index = {r["f"]: i for i, r in enumerate(chosen)}

    def vectors(stream):
        import pyarrow as pa

        reader = Reader(chars, index)
        for batch in stream:
            found = [sorted(reader.read(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], ["f", "toxic"])

    got = sample.mapInArrow(vectors, "f array<int>, toxic int").collect()
    return Model(chars, index, _fit(sorted(((r["f"], r["toxic"]) for r in got)), len(index)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with their score in a further column ``name``."""
    # bounded by the alphabet and FEATURES; only the text crosses to Python
    state = docs.sparkSession.sparkContext.broadcast((vars(model.chars), model.index, model.weights))

    def run(texts):
        import pandas as pd

        chars_state, index, w = state.value
        model = CharModel.__new__(CharModel)
        model.__dict__.update(chars_state)
        reader = Reader(model, index)
        for part in texts:
            z = [w[-1] + sum(w[i] for i in reader.read(t)) if isinstance(t, str) else w[-1] for t in part]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("`text`").cast("string")))


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents with scores below ``limit``; columns as in ``docs``."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), name).where(F.col(name) < limit).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(pick(docs, doc_id="doc_id bigint", text="text string"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

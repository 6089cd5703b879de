"""Operator 13: ranked lexical search by NRA, without random access.

1. One pass over the texts gives, per document, its number of terms and the
   terms that any item asks for with their counts. Totals (documents with a
   term, terms, documents per term asked for) are aggregates of it.
2. The documents of one task of that table are a shard. Its postings become one
   list per term, sorted by impact, where the impact of a posting is the part of
   the score that the document settles: (1000000000 * tf) div (1000 * tf + 12 * m).
3. NRA runs for every item on the lists of its terms. They are read in step from
   the top, in rounds of doubling length. ``lower`` of a document adds the parts
   read; ``upper`` adds, for each list it was not met in, the part that list
   offers next. A document stays a candidate while its upper score reaches the
   k-th largest lower score; ties stay, so that doc_id can decide. Lists are read
   on until every candidate's interval is one point. Then membership, ties and
   scores are settled. Lists in which every candidate was met are not read on.
4. The k best of each shard are merged by a limited window; no document can be
   among the k best of all without being so in its shard.

Documents never move: the forward table has only the terms asked for, and each
task returns k rows per item at most. Items are taken in blocks of bounded text
(``BLOCK_BYTES``), so what is broadcast, terms and weights of one block, is bounded
however many items there are.

Defined cases: a null text has no terms; a document without terms is not counted
and never found; every row of ``items`` is an item of its own, so repeated rows
repeat their results; a null item_id is kept; equal scores go by doc_id, null
last; repeated documents each take a rank; an item without terms, or whose terms
no document holds, has no rows; empty tables give no rows; texts are taken whole;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, table, written

K = 20
BLOCK_BYTES = 8 << 20   # of item texts at a time
FIRST_READ = 32         # postings of a list in the first round
SHARD_TERMS = 2 << 20   # postings of a shard that a task holds at a time
#: Bytes that end a term become blanks, A-Z lower case; all other bytes, those of other scripts included, are parts of terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _forward(docs: DataFrame, asked) -> DataFrame:
    """doc_id, n (terms of the text), terms (places in the list of terms asked for), tf."""
    def run(stream):
        from collections import Counter

        import pyarrow as pa

        place = asked.value
        for batch in stream:
            n, ids, tf, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                terms = terms_of(text or b"")
                found = Counter([t for t in terms if t in place])
                n.append(len(terms))
                ids += [place[t] for t in found]
                tf += found.values()
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>").where("n > 0")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Lists:
    """Impact-sorted postings of one shard."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, count: int, total: int):
        doc = np.repeat(np.arange(len(n)), sizes)
        # Python integers where 64 bits might not hold the product
        m = 75 + (25 * n * count) // total if int(n.max(initial=0)) * count < 1 << 57 else \
            np.array([75 + 25 * int(x) * count // total for x in n], np.int64)
        self.size = len(n)
        value = impact(tf, m[doc])
        order = np.lexsort((doc, -value, terms))
        self.doc, self.value, terms = doc[order], value[order], terms[order]
        self.terms, starts = np.unique(terms, return_index=True)
        self.bounds = np.append(starts, len(terms))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return None
        return self.doc[self.bounds[i]:self.bounds[i + 1]], self.value[self.bounds[i]:self.bounds[i + 1]]


def best(lists: Lists, weights: dict[int, int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard) that may be among the k best for an item, and their scores:
    every document whose score reaches the k-th largest. ``weights`` has the item's terms."""
    runs = [(got, w) for t, w in weights.items() if w > 0 and (got := lists.of(t)) is not None]
    if not runs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lower = np.zeros(lists.size, np.int64)
    met = np.zeros((len(runs), lists.size), bool)
    alive = np.arange(lists.size)           # candidates, by their place
    column = np.arange(lists.size)          # a candidate's column of lower and met, -1 for others
    at, step = 0, FIRST_READ
    while True:
        heads = np.zeros(len(runs), np.int64)
        for i, ((doc, value), w) in enumerate(runs):
            if at >= len(doc):
                continue
            if not met[i].all():  # where every candidate was met, nothing is left to read
                col = column[doc[at:at + step]]
                some = col >= 0
                lower[col[some]] += w * value[at:at + step][some]
                met[i, col[some]] = True
            if at + step < len(doc):
                heads[i] = w * value[at + step]
        at, step = at + step, 2 * step
        upper = lower + heads @ ~met
        # a document that no list offers scores nothing
        least = max(1, int(np.partition(lower, len(lower) - k)[len(lower) - k])) if len(lower) >= k else 1
        stay = upper >= least
        if not stay.all():
            alive, lower, met, upper = alive[stay], lower[stay], met[:, stay], upper[stay]
            column = np.full(lists.size, -1)
            column[alive] = np.arange(len(alive))
        if (upper == lower).all():
            return alive, lower


def _shards(forward: DataFrame, block, count: int, total: int, k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the k best of every shard."""
    def run(stream):
        import pyarrow as pa

        items = block.value
        ids: list = []
        n: list = []
        sizes: list = []
        terms: list = []
        tf: list = []

        def found():
            doc_id = pa.chunked_array(ids).combine_chunks()
            named = np.asarray(doc_id.is_valid())
            number = np.asarray(doc_id.fill_null(0))
            lists = Lists(np.concatenate(n), np.concatenate(sizes), np.concatenate(terms), np.concatenate(tf), count, total)
            rows: tuple = ([], [], [])
            for item, weights in items.items():
                place, score = best(lists, weights, k)
                order = np.lexsort((number[place], ~named[place], -score))[:k]
                rows[0].append(np.full(len(order), item))
                rows[1].append(place[order])
                rows[2].append(score[order])
            item, place, score = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in rows)
            for x in (ids, n, sizes, terms, tf):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(item), doc_id.take(pa.array(place)), pa.array(score)], ["item", "doc_id", "score"])

        held = 0
        for batch in stream:
            if not batch.num_rows:
                continue
            ids.append(batch.column("doc_id"))
            n.append(np.asarray(batch.column("n")))
            sizes.append(np.diff(np.asarray(batch.column("terms").offsets)))
            terms.append(np.asarray(batch.column("terms").flatten()))
            tf.append(np.asarray(batch.column("tf").flatten()))
            held += len(terms[-1]) + batch.num_rows
            if held >= SHARD_TERMS:
                yield found()
                held = 0
        if ids:
            yield found()

    return forward.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="doc_id bigint", text="text string")
    items = written(pick(items, item_id="item_id bigint", text="text string").withColumn("item", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    results = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        texts = {r["item"]: terms_of(r["text"].encode()) for r in own.where("text is not null").collect()}
        place = {t: i for i, t in enumerate(sorted({t for x in texts.values() for t in x}))}
        forward = written(_forward(docs, spark.sparkContext.broadcast(place)), "forward")
        count, total = forward.agg(F.count("*"), F.sum("n")).first()
        if not count:
            continue
        df = {r["t"]: r["df"] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        w = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
        weights = {}
        for item, terms in texts.items():
            weights[item] = {}
            for t in terms:
                if place[t] in w:  # a repeated term adds its weight again
                    weights[item][place[t]] = weights[item].get(place[t], 0) + w[place[t]]
        found = _shards(forward, spark.sparkContext.broadcast(weights), count, total, k)
        results = found if results is None else results.unionAll(found)
    if results is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # at most k rows an item on one side; merged by item
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals GROUP BY term),
norms AS (SELECT doc_id, 75 + (25 * n * docs) // len AS m FROM lengths, totals),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN norms USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

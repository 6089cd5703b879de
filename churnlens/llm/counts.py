"""Operator 2: token counts as delta-maintained rollups.

A change feed holds signed rows (source, lang, tokenizer_version, n_tokens,
sign): an insert is +1, a delete -1, a revised count a -1 row with the old
count and a +1 row with the new one. ``commit`` reduces one batch of the feed
to its additive totals per (source, lang, tokenizer_version) and writes them
under the batch's own folder; ``totals`` adds up all committed batches. The
feed is read once per batch, earlier batches are never read again, and the
state is a few rows per batch. ``compact`` folds committed batches into one.

Commits are idempotent: a batch id names one folder. Every attempt at it writes a
folder of its own inside; then the batch's ``_SUCCESS`` marker, which names the
attempt that counts, is replaced by an atomic rename, and older attempts are
deleted. A job that dies at any point, in a repeated commit too, leaves totals as
they were and can be run again. A folded batch cannot be committed again.

A hot source costs one row per task: Spark adds up before the shuffle.

Defined cases: a null source, lang or version is a group of its own; a null
text has 0 tokens; a null sign counts as +1, a null count as 0; repeated
documents count each time; an empty feed commits no rows, and no committed
batch gives empty totals; groups whose documents have all been deleted stay
with zeros; further input columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

KEYS = ["source", "lang", "tokenizer_version"]
FEED = "source string, lang string, tokenizer_version string, n_tokens bigint, sign bigint"
BASE = "_folded"
ROLLUP = "batch_id string, source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"

#: Token rules by version: the second counts punctuation marks apart from words.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[^\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}


def n_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a version's rule."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("bigint")


def changes(docs: DataFrame, version: str, sign: int = 1) -> DataFrame:
    """Feed rows that insert (+1) or delete (-1) documents under one tokenizer version."""
    d = pick(docs, source="source string", lang="lang string", text="text string")
    return d.select("source", "lang", F.lit(version).alias("tokenizer_version"),
                    n_tokens(F.col("text"), version).alias("n_tokens"), F.lit(sign).cast("bigint").alias("sign"))


def revisions(docs: DataFrame, old: Column, new: Column, version: str) -> DataFrame:
    """Feed rows that replace the count of ``old`` by that of ``new``: two signed rows per document."""
    d = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                    F.explode(F.array(
                        F.struct(n_tokens(old, version).alias("n_tokens"), F.lit(-1).cast("bigint").alias("sign")),
                        F.struct(n_tokens(new, version).alias("n_tokens"), F.lit(1).cast("bigint").alias("sign")))).alias("c"))
    return d.select("source", "lang", F.lit(version).alias("tokenizer_version"), "c.n_tokens", "c.sign")


class Rollup:
    """The committed totals under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marker(self, batch: str) -> list[str]:
        """What the marker of a batch says: its attempt, and the batches folded into it; nothing without a marker."""
        hadoop, fs = self._fs()
        path = hadoop.Path(f"{self.path}/{batch}/_SUCCESS")
        if not fs.exists(path):
            return []
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode().splitlines()
        finally:
            stream.close()

    def _switch(self, batch: str, lines: list[str]) -> None:
        """Replace a batch's marker at once, then delete its other attempts."""
        hadoop, fs = self._fs()
        marker = hadoop.Path(f"{self.path}/{batch}/_SUCCESS")
        fresh = hadoop.Path(f"{self.path}/{batch}/_new-{lines[0]}")
        stream = fs.create(fresh, True)
        stream.write("\n".join(lines).encode())
        stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        full = fs.makeQualified(marker)
        hadoop.FileContext.getFileContext(full.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), full, options)
        for s in fs.listStatus(marker.getParent()):
            if s.isDirectory() and s.getPath().getName() != lines[0]:
                fs.delete(s.getPath(), True)

    def _write(self, batch: str, rows: DataFrame, more: list[str] = ()) -> None:
        attempt = f"attempt-{uuid.uuid4().hex[:12]}"
        rows.select(F.lit(batch).alias("batch_id"), *KEYS, "n_docs", "n_tokens").write.parquet(f"{self.path}/{batch}/{attempt}")
        self._switch(batch, [attempt, *more])

    def commit(self, batch_id: str, feed: DataFrame) -> None:
        """Write the batch's totals; the same batch id again replaces them."""
        if batch_id in self._marker(BASE)[1:]:
            raise ValueError(f"batch {batch_id} is folded and cannot be committed again")
        f = pick(feed, source="source string", lang="lang string", tokenizer_version="tokenizer_version string",
                 n_tokens="n_tokens bigint", sign="sign bigint").fillna({"sign": 1, "n_tokens": 0})
        self._write(batch_id, f.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")))

    def _live(self) -> dict[str, str]:
        """Folder of every batch that is not folded, and of the folded ones together."""
        hadoop, fs = self._fs()
        root = hadoop.Path(self.path)
        if not fs.exists(root):
            return {}
        base = self._marker(BASE)
        found = {s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()} - {BASE} - set(base[1:])
        live = {b: m[0] for b in found if (m := self._marker(b))}
        return {b: f"{self.path}/{b}/{a}" for b, a in (live | ({BASE: base[0]} if base else {})).items()}

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return sorted({*self._live(), *self._marker(BASE)[1:]} - {BASE})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches."""
        paths = list(self._live().values())
        rows = self.spark.read.schema(ROLLUP).parquet(*paths) if paths else self.spark.createDataFrame([], ROLLUP)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Fold all committed batches into one folder; totals stay, and readers never see a batch twice or not at all."""
        batches = self.committed()
        if batches:
            self._write(BASE, self.totals(), batches)
            hadoop, fs = self._fs()
            for b in batches:  # they no longer count
                fs.delete(hadoop.Path(f"{self.path}/{b}"), True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table through four batches, one of them committed twice:
    all documents under words-1; the text without its ``***``, ``###``, ``&&&``, ``%%%``, ``$$$``
    marks where it has any (revised counts); all under words-2; deletes of documents without letters."""
    from churnlens.session import scratch_path

    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, scratch_path(spark, "token-rollup"))
    marks = r"[*#&%$]{3}"
    text = F.col("text").cast("string")
    marked = docs.where(text.rlike(marks))
    rollup.commit("0001-insert", changes(docs, "words-1"))
    revised = revisions(marked, text, F.regexp_replace(text, marks, " "), "words-1")
    rollup.commit("0002-revise", revised)
    rollup.commit("0003-version", changes(docs, "words-2"))
    rollup.commit("0002-revise", revised)
    bare = docs.where(~F.coalesce(text, F.lit("")).rlike("[A-Za-z]"))
    rollup.commit("0004-delete", changes(bare, "words-2", -1))
    return rollup.totals()


ORACLE = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS text FROM documents),
feed AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, 1 AS sign,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL SELECT source, lang, 'words-1', -1, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM d WHERE regexp_matches(text, '[*#&%$]{3}')
  UNION ALL SELECT source, lang, 'words-1', 1,
    len(regexp_extract_all(regexp_replace(text, '[*#&%$]{3}', ' ', 'g'), '[^\x20\x09-\x0D]+'))
  FROM d WHERE regexp_matches(text, '[*#&%$]{3}')
  UNION ALL SELECT source, lang, 'words-2', 1, len(regexp_extract_all(text,
    '[^\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) FROM d
  UNION ALL SELECT source, lang, 'words-2', -1, len(regexp_extract_all(text,
    '[^\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]'))
  FROM d WHERE NOT regexp_matches(text, '[A-Za-z]'))
SELECT source, lang, tokenizer_version, sum(sign)::BIGINT AS n_docs, sum(sign * n)::BIGINT AS n_tokens
FROM feed GROUP BY source, lang, tokenizer_version
"""

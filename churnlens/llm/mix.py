"""Operator 7: mixing sources to target weights by entropy balancing.

Every document i of source s gets a rate r_i in [0, cap]: the bounded-entropy
tilt of the uniform rate 1 under the token constraint of its source,

    sum_i size_i r_i = target_s,    r_i = cap e^z / (cap - 1 + e^z),  z = lambda_s size_i / mean_s

(for small z this is e^z, and it never exceeds the cap). lambda_s solves the
convex dual: Newton rounds, in which one aggregation over all documents gives
each source's gradient and curvature, with steps halved where the gradient
grew. Sources whose target is their capped size, or 0, need no tilt.

Rates become copies: floor(r_i), and one more for the documents of a source
with the smallest u_i - (r_i - floor(r_i)), u_i a hash of the document. The cut
is found from histograms of that key (two rounds of ``BINS`` bins a source) and
stays below the target; what is left, if over ``NEAR`` of it, is filled the
same way by one copy more of documents no larger than that, in ``FILLS`` rounds
at most, within the cap. Reruns agree.

Targets: sources by code point, null last, weigh ``weights`` in turn and share
the whole size; none exceeds cap times its own size, and the excess is shared
again by weight until none does.

What the driver holds is one row per source. Documents are joined to it by
source; all else are sums per source, so a hot source is one row per task.

Defined cases: a null text has size 0; a null source is a source of its own;
documents of size 0 and sources without words are taken 0 times; a null doc_id
is hashed like any value; repeated rows are taken alike and each counted; an
empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
BINS, ROUNDS = 4096, 60
FILLS, NEAR = 8, 0.001
MOST_SOURCES, SALTS = 100_000, 64
RULES = "array<struct<most:double,below:double>>"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, out = set(order), {}
    while free:
        left = sum(sizes.values()) - math.fsum(out.values())
        total = math.fsum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return out


def _rate(lam: Column, x: Column, cap: float) -> Column:
    e = F.exp(F.least(F.greatest(lam * x, F.lit(-700.0)), F.lit(700.0)))
    return F.lit(float(cap)) * e / (F.lit(cap - 1.0) + e)


def _by_source(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Documents joined to a driver-side row per source (``key`` as in ``docs``): broadcast up to ``MOST_SOURCES`` of
    them, beyond that joined over ``SALTS`` shares of each source, so that a hot one is many tasks."""
    small = docs.sparkSession.createDataFrame(rows, "key int, " + schema)
    if len(rows) <= MOST_SOURCES:
        return docs.join(F.broadcast(small), "key")
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", (F.rand(1) * SALTS).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _solve(docs: DataFrame, stats: dict[int, dict], cap: float) -> dict[int, float]:
    """lambda of each tilted source, by Newton rounds over all documents."""
    lam = {k: 0.0 for k, s in stats.items() if s["tilt"]}
    step, seen, best = dict(lam), {k: math.inf for k in lam}, dict(lam)
    todo = set(lam)
    for _ in range(ROUNDS):
        if not todo:
            break
        part = _by_source(docs, [(k, lam[k], stats[k]["mean"]) for k in sorted(todo)], "lam double, mean double")
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, cap)
        sums = part.groupBy("key").agg(F.sum(F.col("size") * r).alias("g"),
                                       F.sum(F.col("size") * x * r * (1 - r / F.lit(float(cap)))).alias("h")).collect()
        for row in sums:
            k, gap = row["key"], row["g"] - stats[row["key"]]["target"]
            if abs(gap) >= seen[k]:  # too far: back half the way
                step[k] /= 2
            else:
                seen[k], best[k] = abs(gap), lam[k]
                step[k] = max(-8.0, min(8.0, -gap / max(row["h"], 1e-9 * stats[k]["size"])))
            if seen[k] <= 1e-7 * max(1.0, stats[k]["target"]) or abs(step[k]) < 1e-12:
                todo.discard(k)
            lam[k] = best[k] + step[k]
    return best


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of every document."""
    rows = pick(docs, doc_id="doc_id bigint", source="source string", text="text string")
    sized = written(rows.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["size"] for r in sources}
    goal = targets(sizes, weights, cap)
    stats = {}
    for k, r in enumerate(sorted(sources, key=lambda r: (r["source"] is None, r["source"] or ""))):
        t = goal[r["source"]]
        stats[k] = {"source": r["source"], "size": r["size"], "target": t, "mean": max(r["size"] / r["n"], 1e-9),
                    "tilt": 0 < t < cap * r["size"]}
    spark = docs.sparkSession
    names = spark.createDataFrame([(k, s["source"], s["size"], s["target"]) for k, s in stats.items()],
                                  "key int, s string, source_size bigint, target double")
    if len(stats) <= MOST_SOURCES:
        names = F.broadcast(names)
    keyed = sized.join(names, sized["source"].eqNullSafe(names["s"])).drop("s") if stats else \
        sized.select("*", F.lit(0).alias("key"), F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"))
    keyed = written(keyed, "sizes-keyed")
    words = keyed.where("size > 0")
    lam = _solve(words.select("key", "size"), stats, cap)
    fixed = [(k, lam.get(k, 0.0), s["mean"], 1.0 if k in lam else 0.0, 0.0 if s["target"] <= 0 else float(cap)) for k, s in stats.items()]
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilted") > 0, _rate(F.col("lam"), F.col("size") / F.col("mean"), cap)) \
        .otherwise(F.col("flat"))
    rated = _by_source(keyed, fixed, "lam double, mean double, tilted double, flat double") \
        .withColumn("rate", F.least(rate, F.lit(float(cap)))) \
        .select("doc_id", "source", "size", "source_size", "target", "key", "rate", F.floor("rate").alias("base"),
                (u - (F.col("rate") - F.floor("rate"))).alias("at"), (F.col("rate") > F.floor("rate")).alias("open"),
                F.when(F.col("size") > 0, F.pmod(F.xxhash64("doc_id", F.lit("fill")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
                .otherwise(1.0).alias("fill"), F.when(F.col("rate") > 0, cap).otherwise(0).alias("cap"))
    rated = written(rated, "rates")
    cut = _cuts(rated, stats)
    done = _by_source(rated, [(k, *v) for k, v in cut.items()], f"cut double, rules {RULES}")
    return done.select("doc_id", "source", "size", "source_size", "target", "rate",
                       (F.col("base") + _extra() + (_room() & _filled()).cast("int")).cast("bigint").alias("copies"))


def _below(rows: DataFrame, need: dict[int, float]) -> dict[int, float]:
    """Per source, the key up to which its rows (key, size, at in [-1, 1)) have no more words than needed, by two
    rounds of histograms; ``need`` is lowered by those words."""
    low, width = {k: -1.0 for k in need}, 2.0
    bins = Window.partitionBy("key").orderBy("bin")  # at most BINS rows a source
    for _ in range(2):
        hist = _by_source(rows, list(low.items()), "low double") \
            .withColumn("bin", F.floor((F.col("at") - F.col("low")) * F.lit(BINS / width)).cast("int")) \
            .where(F.col("bin").between(0, BINS - 1)).groupBy("key", "bin").agg(F.sum("size").alias("w"))
        # the edge is found where the bins are: one row a source comes back
        summed = _by_source(hist.withColumn("sum", F.sum("w").over(bins)), list(need.items()), "need double")
        fits = F.col("sum") <= F.col("need")
        edges = summed.groupBy("key").agg(F.min(F.when(~fits, F.col("bin"))).alias("edge"), F.max(F.when(fits, F.col("sum"))).alias("taken")).collect()
        found = {r["key"]: r for r in edges}
        width /= BINS
        for k in need:
            r = found.get(k)
            need[k] -= (r["taken"] or 0) if r else 0
            low[k] += (BINS if r is None or r["edge"] is None else r["edge"]) * width
    return low


def _cuts(rated: DataFrame, stats: dict[int, dict]) -> dict[int, tuple[float, list[tuple[float, float]]]]:
    """Per source, the cut and fill rules (largest size, fill key): a document with a broken rate gets one copy more
    below the cut, and one more if a rule's size and key exceed its own and the cap allows it."""
    taken = {r["key"]: r["w"] for r in rated.groupBy("key").agg(F.sum(F.col("size") * F.col("base")).alias("w")).collect()}
    need = {k: max(0.0, s["target"] - taken.get(k, 0)) for k, s in stats.items()}
    cut = _below(rated.where("open").select("key", "size", "at"), need)
    rules: dict[int, list[tuple[float, float]]] = {k: [] for k in stats}
    for _ in range(FILLS):
        todo = {k: need[k] for k in stats if need[k] > NEAR * stats[k]["target"] and need[k] >= 1}
        if not todo:
            break
        rest = _by_source(rated, [(k, cut[k], n, rules[k]) for k, n in todo.items()], f"cut double, most double, rules {RULES}") \
            .where((F.col("size") <= F.col("most")) & _room() & ~_filled())
        limit = dict(todo)
        below = _below(rest.select("key", "size", F.col("fill").alias("at")), todo)
        for k, n in todo.items():
            need[k] = n
            rules[k].append((limit[k], below[k]))
    return {k: (cut[k], rules[k]) for k in stats}


def _extra() -> Column:
    return (F.col("open") & (F.col("at") < F.col("cut"))).cast("int")


def _room() -> Column:
    return F.col("base") + _extra() < F.col("cap")


def _filled() -> Column:
    return F.exists("rules", lambda r: (F.col("size") <= r["most"]) & (F.col("fill") < r["below"]))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed table: the input's columns, each document as often as it is taken.

    Copies are looked up by the rows' (doc_id, source, size), which decide them, so equal rows get equal numbers."""
    chosen = mix(docs, weights, cap).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"),
                                            F.col("copies").alias("_c")).distinct()
    n = size_of(F.col("`text`").cast("string"))
    own = F.col("`doc_id`").cast("bigint").eqNullSafe(F.col("_d")) & F.col("`source`").cast("string").eqNullSafe(F.col("_s")) & (n == F.col("_n"))
    return docs.join(chosen.where("_c > 0").hint("merge"), own).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_c")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

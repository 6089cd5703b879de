"""Exact order statistics without a single-task sort.

``exact_kth`` finds the values at given ranks of a numeric column by bracketing:
each pass is one global aggregate (partial on every partition, a few scalars to
the driver). A pass narrows the interval holding the ranks with approximate
quantiles until the interval has few *distinct* values; only then the
(value, count) pairs of that interval are brought to the driver. A value held
by a third of all rows is one (value, count) pair, so hot values do not grow
what the driver sees.

``hash_cut`` does the same for a uniform 32-bit hash split by groups: equal-width
buckets of the hash, 12 bits per pass, one small histogram per pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DISTINCT_TO_DRIVER = 50_000
N_PROBES = 63


def _walk(pairs, below: int, ranks: list[int]) -> dict[int, float]:
    out, acc = {}, below
    it = iter(ranks)
    r = next(it, None)
    for row in pairs:
        acc += row["count"]
        while r is not None and r < acc:
            out[r] = row["v"]
            r = next(it, None)
    return out


def exact_kth(df: DataFrame, col: str | Column, rank_fn) -> tuple[dict[int, float], int]:
    """Values at 0-based ranks of the ascending non-null values of ``col``.

    ``rank_fn(n)`` gives the wanted ranks once the count n is known. Returns
    ({rank: value}, n). Two passes when the column has few distinct values
    (count + sketch, then the (value, count) pairs); otherwise each further
    round narrows the open interval (lo, hi) by about 64x. A rank that falls on
    a probe's own rows is answered by the probe, so a value that fills most of
    the column is never collected with its neighbours; at most about
    ``MAX_DISTINCT_TO_DRIVER`` pairs reach the driver.
    """
    v = (F.col(col) if isinstance(col, str) else col).cast("double").alias("v")
    vals = df.select(v).where(F.col("v").isNotNull() & ~F.isnan("v"))
    probs = [(i + 1) / (N_PROBES + 1) for i in range(N_PROBES)]
    found: dict = {}
    n_total = None
    todo = [(None, None, None, 0)]          # ranks (None: all), lo, hi, rows <= lo
    while todo:
        ranks, lo, hi, below = todo.pop()
        sub = vals
        if lo is not None:
            sub = sub.where(F.col("v") > F.lit(lo))
        if hi is not None:
            sub = sub.where(F.col("v") < F.lit(hi))
        stats = sub.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("nd"),
                        F.percentile_approx("v", probs, 10000).alias("qs")).first()
        if n_total is None:
            n_total = stats["n"]
            ranks = sorted(set(rank_fn(n_total))) if n_total else []
        if not ranks or not stats["n"]:
            continue
        if stats["nd"] <= MAX_DISTINCT_TO_DRIVER:
            found |= _walk(sub.groupBy("v").count().orderBy("v").collect(), below, ranks)
            continue
        edges = sorted(set(stats["qs"]))
        counts = sub.agg(*[x for i, e in enumerate(edges) for x in (F.count_if(F.col("v") < F.lit(e)).alias(f"l{i}"),
                                                                    F.count_if(F.col("v") <= F.lit(e)).alias(f"c{i}"))]).first()
        probes = [(e, below + counts[f"l{i}"], below + counts[f"c{i}"]) for i, e in enumerate(edges)]
        left = []
        for r in ranks:
            hit = next((e for e, less, upto in probes if less <= r < upto), None)
            if hit is None:
                left.append(r)
            else:
                found[r] = hit
        # ranks between the same two probes go on together, in an interval that excludes both
        groups: dict = {}
        for r in left:
            at = sum(upto <= r for _, _, upto in probes)
            groups.setdefault(at, []).append(r)
        for at, rs in groups.items():
            todo.append((rs, probes[at - 1][0] if at else lo, probes[at][0] if at < len(probes) else hi,
                         probes[at - 1][2] if at else below))
    return found, n_total or 0


def exact_median(df: DataFrame, col: str | Column) -> float | None:
    """Median with the two middle values averaged (as pandas / DuckDB ``median``)."""
    got, n = exact_kth(df, col, lambda n: [(n - 1) // 2, n // 2])
    if n == 0:
        return None
    return (got[(n - 1) // 2] + got[n // 2]) / 2.0


def hash_cut(df: DataFrame, h_col: str, id_col: str, group_col: str, k_by_group,
             max_rows_to_driver: int = 100_000) -> dict:
    """Per group, the (h, id) of the k-th smallest row ordered by (h, id).

    ``h`` must be an integer in [0, 2^32). ``k_by_group`` is a dict, or a
    function of the row count per group returning one. Each pass is a histogram
    of the next 12 hash bits inside the bucket found so far (at most groups x
    4096 rows to the driver); once the bucket holding the k-th row is small, its
    (h, id) pairs are read and the cut is exact. Returns {group: (h, id)}.
    """
    result: dict = {}
    todo = None                      # group -> (k left, prefix, bits fixed)
    fixed = 0
    while True:
        bits = min(12, 32 - fixed)
        if todo is None:
            cond = F.lit(True)
        else:
            cond = F.lit(False)
            for g, (_, prefix, fx) in todo.items():
                cond = cond | ((F.col(group_col) == F.lit(g)) & (F.shiftright(F.col(h_col), 32 - fx) == F.lit(prefix)))
        bucket = F.shiftright(F.col(h_col), 32 - fixed - bits) % F.lit(1 << bits)
        hist = df.where(cond).groupBy(F.col(group_col).alias("g"), bucket.alias("b")).count().collect()
        by_group: dict = {}
        for row in hist:
            by_group.setdefault(row["g"], []).append((row["b"], row["count"]))
        if todo is None:
            totals = {g: sum(c for _, c in lst) for g, lst in by_group.items()}
            ks = k_by_group(totals) if callable(k_by_group) else k_by_group
            todo = {g: (k, 0, 0) for g, k in ks.items() if k and k > 0}
        new_todo, small = {}, {}
        for g, (k, prefix, fx) in todo.items():
            acc = 0
            for b, c in sorted(by_group.get(g, [])):
                if acc + c >= k:
                    nxt = (k - acc, (prefix << bits) | b, fx + bits)
                    if c <= max_rows_to_driver or fx + bits >= 32:
                        small[g] = nxt
                    else:
                        new_todo[g] = nxt
                    break
                acc += c
        if small:
            cond = F.lit(False)
            for g, (_, prefix, fx) in small.items():
                cond = cond | ((F.col(group_col) == F.lit(g)) & (F.shiftright(F.col(h_col), 32 - fx) == F.lit(prefix)))
            rows = df.where(cond).select(F.col(group_col).alias("g"), F.col(h_col).alias("h"),
                                         F.col(id_col).alias("id")).collect()   # bounded: small buckets only
            per: dict = {}
            for r in rows:
                per.setdefault(r["g"], []).append((r["h"], r["id"]))
            for g, (k, prefix, fx) in small.items():
                mine = sorted(x for x in per.get(g, []) if (x[0] >> (32 - fx)) == prefix)
                result[g] = mine[k - 1]
        todo = new_todo
        fixed += bits
        if not todo:
            return result

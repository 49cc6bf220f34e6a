"""Verification scores as one algebraic aggregation, and agreement of labelings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def core_scores(o: Column, p: Column) -> dict[str, Column]:
    """n, me, mae, rmse, nse, kge, ccc and r over pairs; null for fewer than two pairs."""
    ok = o.isNotNull() & p.isNotNull()
    o, p = F.when(ok, o), F.when(ok, p)
    n = F.count(o)
    two = lambda c: F.when(n >= 2, c)
    sse = F.sum((p - o) * (p - o))
    mo, mp, so, sp, r = F.avg(o), F.avg(p), F.stddev_pop(o), F.stddev_pop(p), pearson(o, p)
    kge = 1 - F.sqrt(F.pow(r - 1, 2.0) + F.pow(F.try_divide(sp, so) - 1, 2.0) + F.pow(F.try_divide(mp, mo) - 1, 2.0))
    return {
        "n": n, "me": two(F.avg(p - o)), "mae": two(F.avg(F.abs(p - o))), "rmse": two(F.sqrt(F.try_divide(sse, n))),
        "nse": two(F.when(so > 0, 1 - F.try_divide(sse, n * so * so))), "kge": two(F.when((so > 0) & (sp > 0) & (mo != 0), kge)),
        "ccc": two(F.when((so > 0) | (sp > 0), F.try_divide(2 * F.covar_pop(o, p), so * so + sp * sp + (mo - mp) * (mo - mp)))), "r": two(F.when((so > 0) & (sp > 0), r))}


def wet_scores(o: Column, p: Column, trace: float) -> dict[str, Column]:
    """Contingency scores of values at or above a trace amount."""
    hit = F.count(F.when((o >= trace) & (p >= trace), 1))
    miss = F.count(F.when((o >= trace) & (p < trace), 1))
    false = F.count(F.when((o < trace) & (p >= trace), 1))
    n = F.count(F.when(o.isNotNull() & p.isNotNull(), 1))
    chance = F.try_divide((hit + miss) * (hit + false), n)
    some = lambda a, b: F.try_divide(a, b)
    return {
        "pod": some(hit, hit + miss), "far": some(false, hit + false), "freq_bias": some(hit + false, hit + miss),
        "ets": F.try_divide(hit - chance, hit + miss + false - chance),
        "rmse_wet": F.sqrt(F.avg(F.when(o >= trace, (p - o) * (p - o))))}


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information from contingency sums."""
    c = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("rb"))
    c2 = lambda x: x * (x - 1) / 2
    total = c.agg(F.sum("n").alias("t"))
    full = c.join(rows, a).join(cols, b).join(total)
    n, ra, rb, t = (F.col(x) for x in ("n", "ra", "rb", "t"))
    pair = full.agg(F.sum(c2(n)).alias("ij"), F.sum(n / t * F.log(n * t / (ra * rb))).alias("mi"), F.first("t").alias("t"))
    ea = rows.join(total).agg(F.sum(c2(ra)).alias("i"), F.sum(-(ra / t) * F.log(ra / t)).alias("ha"))
    eb = cols.join(total).agg(F.sum(c2(rb)).alias("j"), F.sum(-(rb / t) * F.log(rb / t)).alias("hb"))
    x = pair.join(ea).join(eb)
    expected = F.col("i") * F.col("j") / c2(t)
    top = (F.col("i") + F.col("j")) / 2
    return x.select(F.when(top != expected, (F.col("ij") - expected) / (top - expected)).otherwise(1.0).alias("ari"),
                    F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))

"""Regular time grids: spines, regridding, gap filling, calendar aggregation.

Times are integers (seconds, slots or days since 1970, UTC), so windows and
joins stay free of time zones.  Every operator works on all series at once,
partitioned by ``keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Every step from a series' first to its last."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(at))


def full_reindex(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All steps of the spine; steps without a row have nulls."""
    return spine(df, keys, at).join(df, [*keys, at], "left")


def exact_regrid(df: DataFrame, keys: list[str], sec: str, step: int, slack: int = 0, tie: str = "value") -> DataFrame:
    """Only rows within ``slack`` seconds after a grid stamp, as rows of that stamp; the earliest wins, of those of one second that of the smallest ``tie``."""
    on = df.filter(F.pmod(F.col(sec), F.lit(step)) <= slack).withColumn("slot", F.expr(f"{sec} div {step}"))
    return on.groupBy(*keys, "slot").agg(F.min_by("value", F.struct(sec, tie)).alias("value"))


def bracket(df: DataFrame, keys: list[str], at: str, value: str = "value") -> DataFrame:
    """The last valid point at or before each row (at0, v0) and the next at or after it (at1, v1)."""
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(at), F.desc(at)))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    return (
        df.withColumn("_p", F.last(here, True).over(back)).withColumn("_n", F.last(here, True).over(ahead))  # a frame up to the last row would be quadratic
        .select("*", F.col("_p.t").alias("at0"), F.col("_p.v").alias("v0"), F.col("_n.t").alias("at1"), F.col("_n.v").alias("v1")).drop("_p", "_n"))


def between(at: str = "slot") -> Column:
    """Linear value between the bracketing points."""
    t = F.col(at)
    return F.when(F.col("at1") == F.col("at0"), F.col("v0")).otherwise(
        F.col("v0") + (F.col("v1") - F.col("v0")) * (t - F.col("at0")) / (F.col("at1") - F.col("at0")))


def linear_fill(df: DataFrame, keys: list[str], at: str, limit: int = 1) -> DataFrame:
    """Fill the first ``limit`` missing steps of every gap; at the tail repeat the last value as often."""
    b = bracket(full_reindex(df, keys, at), keys, at)
    near = F.col(at) - F.col("at0") <= limit
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(near & F.col("v1").isNotNull(), between(at)).when(near, F.col("v0"))
    return b.select(*keys, at, filled.alias("value"))


def micro_gaps(df: DataFrame, keys: list[str], at: str, most: int = 3) -> DataFrame:
    """Insert linear values between consecutive valid points with 1 to ``most`` missing steps."""
    valid = df.filter(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy(at)
    nxt = valid.withColumn("_t", F.lead(at).over(w)).withColumn("_v", F.lead("value").over(w))
    gap = F.col("_t") - F.col(at)
    k = F.explode(F.when((gap > 1) & (gap <= most + 1), F.sequence(F.lit(0), (gap - 1).cast("int"))).otherwise(F.array(F.lit(0)))).alias("_k")
    wide = nxt.select(*keys, at, "value", "_t", "_v", k)
    filled = F.when(F.col("_k") == 0, F.col("value")).otherwise(F.col("value") + (F.col("_v") - F.col("value")) * F.col("_k") / (F.col("_t") - F.col(at)))
    return wide.select(*keys, (F.col(at) + F.col("_k")).alias(at), filled.alias("value"), (F.col("_k") > 0).alias("inserted"))


def interpolate_short(df: DataFrame, keys: list[str], at: str, most: int) -> DataFrame:
    """Linear values in gaps of up to ``most`` steps between valid points; longer gaps start a new segment."""
    b = bracket(full_reindex(df, keys, at), keys, at)
    inside = F.col("v0").isNotNull() & F.col("v1").isNotNull() & (F.col("at1") - F.col("at0") <= most)
    filled = b.select(*keys, at, F.when(F.col("value").isNotNull(), F.col("value")).when(inside, between(at)).alias("value"))
    w = Window.partitionBy(*keys).orderBy(at)
    starts = F.col("value").isNotNull() & F.lag("value").over(w).isNull()
    return filled.withColumn("_s", starts.cast("int")).withColumn("segment", F.when(F.col("value").isNotNull(), F.sum("_s").over(w))).drop("_s")


def sum_right(df: DataFrame, keys: list[str], sec: str, step: int) -> DataFrame:
    """Sums of bins labelled by their right end; all values missing: missing."""
    return df.groupBy(*keys, (F.expr(f"{sec} div {step}") + 1).alias("slot")).agg(F.sum("value").alias("value"))


def nearest_then_forward(df: DataFrame, keys: list[str], sec: str, step: int, slack: int, tie: str = "value") -> DataFrame:
    """Each grid stamp takes the nearest valid row within ``slack`` seconds (earlier on ties, of one second that of the smallest ``tie``), then values run forward."""
    valid = df.filter(F.col("value").isNotNull()).select(*keys, F.col(sec).alias("_s"), F.col(tie).alias("_o"), "value")
    stamp = F.floor((F.col("_s") + step / 2) / step).cast("long")
    near = valid.withColumn("slot", stamp).withColumn("_d", F.abs(F.col("_s") - F.col("slot") * step)).filter(F.col("_d") <= slack)
    hit = near.groupBy(*keys, "slot").agg(F.min(F.struct("_d", "_s", "_o", "value")).alias("m")).select(*keys, "slot", F.col("m.value").alias("value"))
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return full_reindex(hit, keys, "slot").withColumn("value", F.last("value", True).over(w))


def aggregate_panel(df: DataFrame, keys: list[str], period: str, specs: dict[str, str], coverage: float | None = 0.8, value: str = "value") -> DataFrame:
    """Period aggregates on a spine of all periods between a series' first and last.

    specs: output name -> sum, avg, min or max.  A result is null if the share of
    non-null values among the rows present is under ``coverage``, or if the
    period has no rows.
    """
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    enough = F.lit(True) if coverage is None else F.count(value) / F.count("*") >= coverage
    aggs = [F.when(enough, fns[f](value)).alias(name) for name, f in specs.items()]
    found = df.groupBy(*keys, period).agg(*aggs, F.count("*").alias("n_rows"))
    return spine(found, keys, period).join(found, [*keys, period], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def sunday_of(date: Column) -> Column:
    return F.date_add(date, ((6 - F.weekday(date)) % 7).cast("int"))


def week_number(date: Column) -> Column:
    """%W: weeks that begin on Monday, days before the first Monday are week 0."""
    return F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7)


def week_label(date: Column, own: bool = False) -> Column:
    """YYYY-Www of the Sunday that ends the week, or of the date itself."""
    d = date if own else sunday_of(date)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week_number(d).cast("string"), 2, "0"))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").otherwise("Autumn")


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def split_of_year(year: Column, train_until: int, tune: int) -> Column:
    """Locked protocol: train up to a year, tune in the next, test after."""
    return F.when(year <= train_until, "train").when(year == tune, "tune").otherwise("test")


def to_utc_or_null(local: Column, zone: str) -> Column:
    """UTC of a local time; null in the gap or the overlap of a clock change."""
    u = F.to_utc_timestamp(local, zone)
    gap = F.from_utc_timestamp(u, zone) != local
    twice = (F.from_utc_timestamp(u + F.expr("interval 1 hour"), zone) == local) | (F.from_utc_timestamp(u - F.expr("interval 1 hour"), zone) == local)
    return F.when(~gap & ~twice, u)

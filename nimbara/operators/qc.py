"""Quality-control predicates: ranges, spikes, runs, neighbours, flagged periods.

Comparisons with missing values are false, so a missing value ends a run and
breaks a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """The value, or null outside the closed range."""
    ok = F.lit(True)
    if low is not None:
        ok &= value >= low
    if high is not None:
        ok &= value <= high
    return F.when(ok, value)


def band_of(elevation: Column, edges: list[float], default: int) -> Column:
    """Index of the band [edge i, edge i+1) of an elevation; null takes ``default``, beyond the last edge the last band."""
    out = F.lit(len(edges) - 2)
    for i in range(len(edges) - 2, 0, -1):
        out = F.when(elevation < edges[i], i - 1).otherwise(out)
    return F.coalesce(F.when(elevation.isNotNull(), out), F.lit(default))


def order(keys: list[str], by: list[str]):
    return Window.partitionBy(*keys).orderBy(*by)


def step_spike(df: DataFrame, keys: list[str], by: list[str], most: float) -> DataFrame:
    """spike: the change from the adjacent row exceeds ``most``."""
    d = F.abs(F.col("value") - F.lag("value").over(order(keys, by)))
    return df.withColumn("spike", F.coalesce(d > most, F.lit(False)))


def runs(df: DataFrame, keys: list[str], by: list[str], inside: Column) -> DataFrame:
    """Islands of rows where ``inside`` holds: run (number within the series) and run_length; both null outside."""
    w = order(keys, by)
    flagged = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    flagged = flagged.withColumn("_new", F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0))
    flagged = flagged.withColumn("run", F.when(F.col("_in"), F.sum("_new").over(w)))
    n = F.count("*").over(Window.partitionBy(*keys, "run"))
    return flagged.withColumn("run_length", F.when(F.col("_in"), n)).drop("_in", "_new")


def stuck(df: DataFrame, keys: list[str], by: list[str], tolerance: float, least: int) -> DataFrame:
    """Runs of changes under ``tolerance`` of ``least`` rows or more; the first row of a plateau is not part of it."""
    d = F.abs(F.col("value") - F.lag("value").over(order(keys, by)))
    r = runs(df.withColumn("_small", d < tolerance), keys, by, F.col("_small"))
    return r.drop("_small").withColumn("stuck", F.coalesce(F.col("run_length") >= least, F.lit(False)))


def flatline(df: DataFrame, keys: list[str], by: list[str], least: int) -> DataFrame:
    """Rows without runs of equal values of more than ``least`` rows above 2."""
    w = order(keys, by)
    same = F.coalesce(F.col("value") == F.lag("value").over(w), F.lit(False))
    g = df.withColumn("_g", F.sum(F.when(same, 0).otherwise(1)).over(w))
    n = F.count("*").over(Window.partitionBy(*keys, "_g"))
    return g.withColumn("_n", n).filter(~F.coalesce((F.col("_n") > least) & (F.col("value") > 2), F.lit(False))).drop("_g", "_n")


def icing(df: DataFrame, keys: list[str], by: list[str], high: Column) -> DataFrame:
    w16, w12 = order(keys, by).rowsBetween(-15, 0), order(keys, by).rowsBetween(-11, 0)
    sd = F.when(F.count("value").over(w16) >= 8, F.stddev_samp("value").over(w16))
    mean = F.when(F.count("value").over(w12) >= 6, F.avg("value").over(w12))
    return df.withColumn("sd", sd).withColumn("mean", mean).withColumn("iced", F.coalesce(high & (F.col("sd") < 40) & (F.col("mean") < 25), F.lit(False)))


def tukey(df: DataFrame, keys: list[str], by: list[str], half: int, factor: float, least: int) -> DataFrame:
    """outlier: further from the centred rolling median than ``factor`` rolling deviations."""
    w = order(keys, by).rowsBetween(-half, half)
    ok = F.count("value").over(w) >= least
    far = F.abs(F.col("value") - F.percentile("value", 0.5).over(w)) > factor * F.stddev_samp("value").over(w)
    return df.withColumn("outlier", F.coalesce(ok & far, F.lit(False)))


def mad_spikes(df: DataFrame, keys: list[str], by: list[str], sec: str, size: int = 12, factor: float = 4.0, most: float = 25.0, least: int = 3) -> DataFrame:
    """med (centred rolling median) and spike: more than ``factor`` rolling median deviations off, or a change of more than ``most`` an hour.

    A window of even ``size`` reaches one row further back than ahead and needs
    ``least`` values.
    """
    w, o = order(keys, by).rowsBetween(-(size // 2), (size - 1) // 2), order(keys, by)
    rolled = lambda c: F.when(F.count(c).over(w) >= least, F.percentile(c, 0.5).over(w))
    out = df.withColumn("med", rolled("value")).withColumn("_dev", F.abs(F.col("value") - F.col("med")))
    out = out.withColumn("_mad", rolled("_dev"))
    step, hours = F.abs(F.col("value") - F.lag("value").over(o)), (F.col(sec) - F.lag(sec).over(o)) / 3600.0
    off = F.coalesce(F.col("_dev") > factor * F.col("_mad"), F.lit(False))
    return out.withColumn("spike", off | F.coalesce(step > most * hours, F.lit(False))).drop("_dev", "_mad")


def long_runs(df: DataFrame, keys: list[str], by: list[str], sec: str, flag: str, hours: float) -> DataFrame:
    """``flag`` only where its run of consecutive rows spans ``hours`` or more."""
    w = order(keys, by)
    turn = F.when(F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True)), 1).otherwise(0)
    own = Window.partitionBy(*keys, "_run")
    span = (F.max(sec).over(own) - F.min(sec).over(own)) / 3600.0
    out = df.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w))
    return out.withColumn(flag, F.col(flag) & (span >= hours)).drop("_turn", "_run")


def behavioural(df: DataFrame, keys: list[str], by: list[str], sec: str) -> DataFrame:
    """clean: spikes become the rolling median; long plateaus, long noise and isolated steps of a thin pack become 0.

    Plateau: deviation of 36 rows under 1.2 between 2 and 25, for 18 hours.
    Noise: deviation of 24 rows above 4 under 15, for 8 hours.  Step: a change
    above 8 under 15.  Negative values become 0.
    """
    w = order(keys, by)

    def spread(rows: int) -> Column:
        back = w.rowsBetween(-rows + 1, 0)
        return F.when(F.count("clean").over(back) >= rows, F.stddev_samp("clean").over(back))

    zero = lambda d, hit: d.withColumn("clean", F.when(hit, 0.0).otherwise(F.col("clean")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = mad_spikes(df, keys, by, sec, least=12).withColumn("clean", F.when(F.col("spike"), F.col("med")).otherwise(F.col("value")))
    out = out.withColumn("_f", flag((spread(36) < 1.2) & (F.col("clean") > 2) & (F.col("clean") < 25)))
    out = zero(long_runs(out, keys, by, sec, "_f", 18.0), F.col("_f"))
    out = out.withColumn("_f", flag((spread(24) > 4.0) & (F.col("clean") < 15)))
    out = zero(long_runs(out, keys, by, sec, "_f", 8.0), F.col("_f"))
    step = flag((F.abs(F.col("clean") - F.lag("clean").over(w)) > 8) & (F.col("clean") < 15))
    out = zero(out.withColumn("_f", step), F.col("_f")).drop("_f", "med")
    return out.withColumn("clean", F.when(F.col("clean") < 0, 0.0).otherwise(F.col("clean")))


def snow_days(df: DataFrame, key: str, low: float = 20.0) -> DataFrame:
    """snow_day of daily rows (key, date, value, ta, judged): whether snow may lie.

    Of a judged series, each year with 20 days before November and a peak in
    January to March has a season end: the first day under ``low`` after the
    peak, moved on by the days that the fall from the peak needs for 18 more;
    20 July without such a fall; 31 October at the latest.  From there (from 1
    April) to 31 October no snow lies; in September and October it does if the
    air is below zero and the depth above that of three rows before.
    """
    day, year, month = F.col("date"), F.year("date"), F.month("date")
    on = lambda m, d: F.make_date(F.col("_y"), F.lit(m), F.lit(d))
    rows = df.withColumn("_y", year).withColumn("_before", F.lag("value", 3).over(Window.partitionBy(key).orderBy("date")))
    early = month <= 10
    peaks = rows.filter(early & F.col("judged")).groupBy(key, "_y").agg(F.count("*").alias("n"), F.min_by("date", F.when((month <= 3) & F.col("value").isNotNull(), F.struct(-F.col("value"), day))).alias("peak"), F.max(F.when(month <= 3, F.col("value"))).alias("top"))
    peaks = peaks.filter((F.col("n") >= 20) & F.col("top").isNotNull())
    after = rows.filter(early & (F.col("value") < low)).select(key, "_y", "date", "value").join(peaks, [key, "_y"]).filter(day >= F.col("peak"))
    first = after.groupBy(key, "_y").agg(F.min("date").alias("at"), F.min_by("value", "date").alias("then"))
    ends = peaks.join(first, [key, "_y"], "left")
    days = F.date_diff("at", "peak")
    more = F.floor(F.abs(18.0 / ((F.col("then") - F.col("top")) / days))).cast("int")
    fall = F.coalesce((days > 3) & (F.col("top") > F.col("then")), F.lit(False))
    end = F.least(F.when(fall, F.date_add("at", more)).otherwise(on(7, 20)), on(10, 31))
    out = rows.join(ends.withColumn("end", end).select(key, "_y", "end"), [key, "_y"], "left")
    bare = (day >= F.greatest("end", on(4, 1))) & (day <= on(10, 31))
    autumn = month.isin(9, 10) & F.col("end").isNotNull()
    fresh = F.coalesce((F.col("ta") < 0) & (F.col("value") > F.col("_before")), F.lit(False))
    return out.withColumn("snow_day", F.when(autumn, fresh).otherwise(~F.coalesce(bare, F.lit(False)))).drop("_y", "_before", "end")


def periods(df: DataFrame, keys: list[str], sec: str, gap: int) -> DataFrame:
    """Sessions of rows; a new one begins after more than ``gap`` seconds."""
    w = order(keys, [sec, "event_id"])
    fresh = F.when(F.coalesce(F.col(sec) - F.lag(sec).over(w) > gap, F.lit(True)), 1).otherwise(0)
    s = df.withColumn("_n", fresh).withColumn("period", F.sum("_n").over(w))
    return s.groupBy(*keys, "period").agg(F.min(sec).alias("start"), F.max(sec).alias("end"), F.count("*").alias("n"))


def collapse(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per key; keys whose rows disagree in a measure (null counts as a value) go."""
    agg = [(F.count_distinct(F.coalesce(F.col(m).cast("string"), F.lit("\0")))).alias(f"_{m}") for m in measures]
    firsts = [F.max(m).alias(m) for m in measures]
    g = df.groupBy(*keys).agg(*agg, *firsts)
    same = F.lit(True)
    for m in measures:
        same &= F.col(f"_{m}") == 1
    return g.filter(same).select(*keys, *measures)


#: Share of the other stations that are asked first whether they agree with a run.
FIRST = 64


def agreeing(rows: DataFrame, values: DataFrame, stations: DataFrame, km: float, most: float) -> DataFrame:
    """station, run of the runs with which another station within ``km`` agrees: the median of the absolute differences of their rows of equal bin is at most ``most``.

    rows: station, run, bin, value; values: station, bin, value; stations:
    station, lat, lon.  One agreeing station is enough, so one in FIRST of the
    others is asked about every run, and all others about the runs that are
    still open.  Near stations are found by places.  A median follows from
    counts and the two values next to ``most``, so no differences are collected.
    """
    from nimbara.operators.joins import within_km

    at = stations.select("station", F.struct("lat", "lon").alias("place"))
    places = at.select("place").distinct().select(F.col("place").alias("station"), "place.lat", "place.lon")
    near = within_km(places, places, km).select(F.col("station").alias("place"), F.col("other").alias("there"))
    valid = F.col("value").isNotNull()
    mine = rows.filter(valid).join(at, "station").select("station", "place", "run", "bin", "value")
    theirs = values.filter(valid).join(at, "station").select(F.col("station").alias("other"), F.col("place").alias("there"), "bin", F.col("value").alias("_u"))
    first = F.pmod(F.xxhash64("other"), F.lit(FIRST)) == 0
    d = F.abs(F.col("value") - F.col("_u"))
    low, high = F.when(d <= most, d), F.when(d > most, d)

    def agreed(k: DataFrame, o: DataFrame) -> DataFrame:
        met = k.join(near, "place").join(o, ["there", "bin"]).filter(F.col("station") != F.col("other"))
        m = met.groupBy("station", "run", "other").agg(F.count(low).alias("a"), F.count(high).alias("b"), F.max(low).alias("x"), F.min(high).alias("y"))
        ok = (F.col("a") > F.col("b")) | (F.col("a") == F.col("b")) & (F.col("x") * 0.5 + F.col("y") * 0.5 <= most)
        return m.filter(ok).select("station", "run").distinct()

    early = agreed(mine, theirs.filter(first))
    late = agreed(mine.join(early, ["station", "run"], "left_anti"), theirs.filter(~first))
    return early.unionByName(late)

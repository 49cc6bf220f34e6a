"""Queries on time grids, calendars and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nimbara.operators import timegrid as T
from nimbara.plans.base import DAILY, OBS, SLOTS, daily, day_string, obs, r, read, slots
from nimbara.plans.registry import query

DAY = "strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d')"
ORDERS_SQL = "o AS (SELECT o_custkey % 40 AS station, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS value FROM orders)"


def _orders(spark, sf):
    o = read(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 40).alias("station"), F.col("o_orderdate").cast("date").alias("d"),
                    F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("value"))


@query(f"""WITH {OBS}, g AS (SELECT station, sec // 86400 AS day, count(value) * 1.0 / count(*) >= 0.8 AS ok, sum(value) AS s, avg(value) AS a,
min(value) AS lo, max(value) AS hi, count(*) AS n FROM obs GROUP BY ALL),
sp AS (SELECT station, unnest(range(min(day), max(day) + 1)) AS day FROM g GROUP BY station)
SELECT station, {DAY} AS date, round(CASE WHEN ok THEN s END, 4) + 0.0 AS value_sum, round(CASE WHEN ok THEN a END, 4) + 0.0 AS value_mean,
CASE WHEN ok THEN lo END AS value_min, CASE WHEN ok THEN hi END AS value_max, coalesce(n, 0) AS n_rows FROM sp LEFT JOIN g USING (station, day)""")
def daily_coverage(spark, sf):
    """Daily aggregates of each station under the coverage rule."""
    o = obs(spark, sf).withColumn("day", F.expr("sec div 86400"))
    p = T.aggregate_panel(o, ["station"], "day", {"s": "sum", "a": "avg", "value_min": "min", "value_max": "max"})
    return p.select("station", day_string("day").alias("date"), r("s").alias("value_sum"), r("a").alias("value_mean"), "value_min", "value_max", "n_rows")


@query(f"""WITH {ORDERS_SQL}, x AS (SELECT *, d + CAST((6 - (isodow(d) - 1)) % 7 AS INTEGER) AS sun FROM o)
SELECT station, strftime(sun, '%Y-W%W') AS year_week, count(*) AS n,
round(CASE WHEN count(value) * 1.0 / count(*) >= 0.8 THEN avg(value) END, 4) + 0.0 AS value_mean FROM x GROUP BY ALL""")
def weekly_panel(spark, sf):
    """Weeks Monday to Sunday, labelled by their Sunday."""
    o = _orders(spark, sf).withColumn("year_week", T.week_label(F.col("d")))
    return o.groupBy("station", "year_week").agg(F.count("*").alias("n"), r(F.when(F.count("value") / F.count("*") >= 0.8, F.avg("value"))).alias("value_mean"))


@query(f"""WITH {ORDERS_SQL} SELECT station, strftime(d, '%Y-W%W') AS year_week, round(avg(value), 4) + 0.0 AS value_mean FROM o GROUP BY ALL""")
def weekly_own_date(spark, sf):
    """Weekly mean keyed by each date's own week."""
    return _orders(spark, sf).groupBy("station", T.week_label(F.col("d"), own=True).alias("year_week")).agg(r(F.avg("value")).alias("value_mean"))


@query(f"""WITH {ORDERS_SQL}, g AS (SELECT station, year(d) * 12 + month(d) - 1 AS ym, count(value) * 1.0 / count(*) >= 0.8 AS ok, sum(value) AS s, count(*) AS n FROM o GROUP BY ALL),
sp AS (SELECT station, unnest(range(min(ym), max(ym) + 1)) AS ym FROM g GROUP BY station)
SELECT station, (ym // 12)::VARCHAR || '-' || lpad((ym % 12 + 1)::VARCHAR, 2, '0') AS year_month, round(CASE WHEN ok THEN s END, 2) + 0.0 AS value_sum, coalesce(n, 0) AS n_rows
FROM sp LEFT JOIN g USING (station, ym)""")
def monthly_panel(spark, sf):
    """Months, with empty months inside a station's span."""
    o = _orders(spark, sf).withColumn("ym", (F.year("d") * 12 + F.month("d") - 1).cast("long"))
    p = T.aggregate_panel(o, ["station"], "ym", {"s": "sum"})
    label = F.concat(F.expr("ym div 12").cast("string"), F.lit("-"), F.lpad((F.col("ym") % 12 + 1).cast("string"), 2, "0"))
    return p.select("station", label.alias("year_month"), r("s", 2).alias("value_sum"), "n_rows")


SEASON = "CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) IN (3, 4, 5) THEN 'Spring' WHEN month(d) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"


@query(f"WITH {ORDERS_SQL} SELECT station, {SEASON} AS season, round(avg(value), 4) + 0.0 AS value_mean, count(*) AS n FROM o GROUP BY ALL")
def seasonal_across(spark, sf):
    """Seasons over all years."""
    return _orders(spark, sf).groupBy("station", T.season(F.month("d")).alias("season")).agg(r(F.avg("value")).alias("value_mean"), F.count("*").alias("n"))


@query(f"WITH {ORDERS_SQL} SELECT station, year(d)::VARCHAR || '-' || {SEASON} AS season, round(avg(value), 4) + 0.0 AS value_mean, count(*) AS n FROM o GROUP BY ALL")
def seasonal_per_year(spark, sf):
    """Seasons of each calendar year; December is not moved."""
    o = _orders(spark, sf).withColumn("season", F.concat(F.year("d").cast("string"), F.lit("-"), T.season(F.month("d"))))
    return o.groupBy("station", "season").agg(r(F.avg("value")).alias("value_mean"), F.count("*").alias("n"))


@query(f"""WITH {ORDERS_SQL} SELECT CASE WHEN year(d) <= 1998 THEN 'train' WHEN year(d) = 1999 THEN 'tune' ELSE 'test' END AS split,
year(d)::VARCHAR || '-Q' || quarter(d)::VARCHAR AS quarter, count(*) AS n, count(DISTINCT station) AS stations FROM o GROUP BY ALL""")
def quarter_splits(spark, sf):
    """Quarters under the locked train, tune and test years."""
    o = _orders(spark, sf)
    return o.groupBy(T.split_of_year(F.year("d"), 1998, 1999).alias("split"), T.quarter_label(F.col("d")).alias("quarter")).agg(
        F.count("*").alias("n"), F.countDistinct("station").alias("stations"))


@query(f"WITH {OBS} SELECT station, variable, sec // 1800 + 1 AS slot, round(sum(value), 4) + 0.0 AS value FROM obs GROUP BY ALL")
def right_label_sum(spark, sf):
    """30-minute sums stamped by their right end."""
    return T.sum_right(obs(spark, sf), ["station", "variable"], "sec", 1800).withColumn("value", r("value"))


@query(f"WITH {OBS} SELECT station, sec // 1800 AS slot, arg_min(value, sec) AS value FROM obs WHERE sec % 1800 <= 60 AND value IS NOT NULL GROUP BY ALL")
def exact_regrid(spark, sf):
    """Rows on a grid stamp only (a minute of slack here); of one second the first event, as the SQL meets them."""
    return T.exact_regrid(obs(spark, sf).filter(F.col("value").isNotNull()), ["station"], "sec", 1800, 60, "event_id")


_BRACKET = """b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER w AS t0, last_value(value IGNORE NULLS) OVER w AS v0,
first_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER x AS t1, first_value(value IGNORE NULLS) OVER x AS v1 FROM f
WINDOW w AS (PARTITION BY station ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY station ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_FULL = SLOTS + ", sp AS (SELECT station, unnest(range(min(slot), max(slot) + 1)) AS slot FROM slots GROUP BY station), f AS (SELECT sp.station, sp.slot, value FROM sp LEFT JOIN slots USING (station, slot))"


@query(f"""WITH {_FULL}, {_BRACKET} SELECT station, count(*) AS n, count(value) AS n_valid, count(out) AS n_filled, round(sum(out), 3) + 0.0 AS total FROM (
SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN slot - t0 <= 1 AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (slot - t0) / (t1 - t0) WHEN slot - t0 <= 1 THEN v0 END AS out FROM b) GROUP BY station""")
def linear_fill1(spark, sf):
    """The first missing slot of every gap, and one repeat at the tail."""
    s = slots(spark, sf)
    n = T.full_reindex(s, ["station"], "slot").groupBy("station").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"))
    f = T.linear_fill(s, ["station"], "slot").groupBy("station").agg(F.count("value").alias("n_filled"), r(F.sum("value"), 3).alias("total"))
    return n.join(f, "station")


@query(f"""WITH {SLOTS}, v AS (SELECT *, lead(slot) OVER w AS t, lead(value) OVER w AS u FROM slots WHERE value IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY slot)),
e AS (SELECT *, unnest(CASE WHEN t - slot > 1 AND t - slot <= 4 THEN range(0, t - slot) ELSE [0] END) AS k FROM v)
SELECT station, slot + k AS slot, round(CASE WHEN k = 0 THEN value ELSE value + (u - value) * k / (t - slot) END, 4) + 0.0 AS value, k > 0 AS inserted FROM e""")
def microgap_fill(spark, sf):
    """Gaps of one to three slots between valid points."""
    return T.micro_gaps(slots(spark, sf), ["station"], "slot").withColumn("value", r("value"))


@query(f"WITH {_FULL} SELECT station, slot, round(value, 4) + 0.0 AS value FROM f WHERE station % 10 < 10")
def full_reindex(spark, sf):
    """Closed 30-minute grid with holes as nulls."""
    return T.full_reindex(slots(spark, sf), ["station"], "slot").select("station", "slot", r("value").alias("value"))


@query(f"""WITH {OBS}, n AS (SELECT station, CAST(floor((sec + 900) / 1800) AS BIGINT) AS slot, sec, value FROM obs WHERE value IS NOT NULL),
h AS (SELECT station, slot, arg_min(value, abs(sec - slot * 1800) * 10000000000 + sec) AS value FROM n WHERE abs(sec - slot * 1800) <= 840 GROUP BY ALL),
sp AS (SELECT station, unnest(range(min(slot), max(slot) + 1)) AS slot FROM h GROUP BY station), f AS (SELECT sp.station, sp.slot, value FROM sp LEFT JOIN h USING (station, slot))
SELECT station, slot, last_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY slot) AS value FROM f""")
def nearest_forward_fill(spark, sf):
    """Nearest row within 14 minutes of a stamp (of one second the first event, as the SQL meets them), then forward."""
    return T.nearest_then_forward(obs(spark, sf), ["station"], "sec", 1800, 840, "event_id")


@query(f"WITH {OBS} SELECT station, (sec // 86400) * 86400 + 21600 AS stamp, round(avg(value), 4) + 0.0 AS value FROM obs WHERE variable = 'view' GROUP BY ALL")
def daily_mean_0600(spark, sf):
    """Daily means stamped 06:00."""
    o = obs(spark, sf).filter(F.col("variable") == "view")
    return o.groupBy("station", (F.expr("sec div 86400") * 86400 + 21600).alias("stamp")).agg(r(F.avg("value")).alias("value"))


@query(f"""WITH {DAILY}, slots AS (SELECT station, day AS slot, value FROM daily WHERE variable = 'click'),
sp AS (SELECT station, unnest(range(min(slot), max(slot) + 1)) AS slot FROM slots GROUP BY station), f AS (SELECT sp.station, sp.slot, value FROM sp LEFT JOIN slots USING (station, slot)), {_BRACKET},
g AS (SELECT station, slot, CASE WHEN value IS NOT NULL THEN value WHEN t1 - t0 <= 3 THEN v0 + (v1 - v0) * (slot - t0) / (t1 - t0) END AS value FROM b),
h AS (SELECT *, CASE WHEN value IS NOT NULL AND lag(value) OVER (PARTITION BY station ORDER BY slot) IS NULL THEN 1 ELSE 0 END AS s FROM g)
SELECT station, slot AS day, round(value, 4) + 0.0 AS value, CASE WHEN value IS NOT NULL THEN sum(s) OVER (PARTITION BY station ORDER BY slot)::BIGINT END AS segment FROM h""")
def gap_interpolation(spark, sf):
    """Short gaps are interpolated, longer ones split the series."""
    d = daily(spark, sf).filter(F.col("variable") == "click").select("station", F.col("day").alias("slot"), "value")
    return T.interpolate_short(d, ["station"], "slot", 3).select("station", F.col("slot").alias("day"), r("value").alias("value"), F.col("segment"))


@query(f"""WITH {OBS}, d AS (SELECT station, sec // 86400 AS day, count(*) AS n FROM obs GROUP BY ALL), m AS (SELECT station, quantile_cont(n, 0.5) <= 2 AS rare FROM d GROUP BY station)
SELECT station, CASE WHEN rare THEN (sec // 86400) * 48 + 12 ELSE sec // 1800 END AS slot, round(avg(value), 4) + 0.0 AS value FROM obs JOIN m USING (station) GROUP BY ALL""")
def adaptive_resample(spark, sf):
    """Daily means at 06:00 for stations with two rows a day or fewer, else 30-minute means."""
    o = obs(spark, sf)
    rare = o.groupBy("station", F.expr("sec div 86400").alias("day")).count().groupBy("station").agg((F.percentile("count", 0.5) <= 2).alias("rare"))
    slot = F.when(F.col("rare"), F.expr("sec div 86400") * 48 + 12).otherwise(F.expr("sec div 1800"))
    return o.join(rare, "station").groupBy("station", slot.alias("slot")).agg(r(F.avg("value")).alias("value"))


@query(f"""WITH {OBS}, a AS (SELECT station, sec // 1800 AS slot, sum(value) AS v FROM obs WHERE variable = 'view' GROUP BY ALL), b AS (SELECT station, sec // 1800 AS slot, sum(value) AS v FROM obs WHERE variable = 'click' GROUP BY ALL)
SELECT station, slot, round(v, 4) + 0.0 AS value, 'native' AS origin FROM a UNION ALL SELECT station, slot, round(v, 4) + 0.0, 'summed' FROM b ANTI JOIN a USING (station, slot)""")
def prefer_native(spark, sf):
    """Native 30-minute sums, else the sum of a finer series."""
    def part(v, origin):
        o = obs(spark, sf).filter(F.col("variable") == v).groupBy("station", F.expr("sec div 1800").alias("slot")).agg(r(F.sum("value")).alias("value"))
        return o.withColumn("origin", F.lit(origin))
    a, b = part("view", "native"), part("click", "summed")
    return a.unionByName(b.join(a, ["station", "slot"], "left_anti"))


@query(f"""WITH {OBS}, d AS (SELECT *, sec - lag(sec) OVER (PARTITION BY station ORDER BY sec, event_id) AS dt FROM obs WHERE variable = 'purchase'), m AS (SELECT station, quantile_cont(dt, 0.5) AS m FROM d GROUP BY station)
SELECT event_id, round(value * least(coalesce(dt, m), 3600) / 3600.0, 4) + 0.0 AS amount FROM d JOIN m USING (station)""")
def rate_to_amount(spark, sf):
    """Rate times elapsed time; the first interval is the median; at most an hour."""
    w = Window.partitionBy("station").orderBy("sec", "event_id")
    d = obs(spark, sf).filter(F.col("variable") == "purchase").withColumn("dt", F.col("sec") - F.lag("sec").over(w))
    m = d.groupBy("station").agg(F.percentile("dt", 0.5).alias("m"))
    return d.join(m, "station").select("event_id", r(F.col("value") * F.least(F.coalesce("dt", "m"), F.lit(3600.0)) / 3600.0).alias("amount"))


@query(f"""WITH {OBS} SELECT station, sec // 1800 AS slot, round(avg(value), 4) + 0.0 AS mean_value, round(coalesce(sum(value), 0), 4) + 0.0 AS sum_value FROM obs GROUP BY ALL""")
def irregular_to_grid(spark, sf):
    """Irregular rows to 30 minutes; an all-missing bin sums to 0."""
    return obs(spark, sf).groupBy("station", F.expr("sec div 1800").alias("slot")).agg(r(F.avg("value")).alias("mean_value"), r(F.coalesce(F.sum("value"), F.lit(0.0))).alias("sum_value"))


@query(f"""WITH {OBS}, v AS (SELECT station, sec, event_id, value FROM obs WHERE value IS NOT NULL) SELECT event_id, lag(value, 1) OVER w AS lag1, lag(value, 3) OVER w AS lag3, lag(value, 12) OVER w AS lag12, lead(value, 1) OVER w AS target,
CASE WHEN count(*) OVER p = 6 THEN round(avg(value) OVER p, 4) + 0.0 END AS mean6, CASE WHEN count(*) OVER p = 6 THEN round(stddev_samp(value) OVER p, 4) + 0.0 END AS std6 FROM v
WINDOW w AS (PARTITION BY station ORDER BY sec, event_id), p AS (PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def lag_features(spark, sf):
    """Lags, lead target and shifted full-window rolling statistics."""
    v = obs(spark, sf).filter(F.col("value").isNotNull())
    w = Window.partitionBy("station").orderBy("sec", "event_id")
    p = w.rowsBetween(-6, -1)
    full = F.count("*").over(p) == 6
    return v.select("event_id", *[F.lag("value", k).over(w).alias(f"lag{k}") for k in (1, 3, 12)], F.lead("value", 1).over(w).alias("target"),
                    F.when(full, r(F.avg("value").over(p))).alias("mean6"), F.when(full, r(F.stddev_samp("value").over(p))).alias("std6"))


@query(f"""WITH {OBS} SELECT event_id, count(*) OVER w AS n, round(CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w - min(value) OVER w END, 4) + 0.0 AS spread, round(sum(value) OVER w, 4) + 0.0 AS total FROM obs
WINDOW w AS (PARTITION BY station ORDER BY sec RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW)""")
def rolling_time_range(spark, sf):
    """Six-hour windows open on the left."""
    w = Window.partitionBy("station").orderBy("sec").rangeBetween(-21599, 0)
    return obs(spark, sf).select("event_id", F.count("*").over(w).alias("n"), r(F.when(F.count("value").over(w) >= 3, F.max("value").over(w) - F.min("value").over(w))).alias("spread"), r(F.sum("value").over(w)).alias("total"))


@query(f"""WITH {OBS} SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(quantile_cont(value, 0.5) OVER w, 4) + 0.0 END AS med, CASE WHEN count(value) OVER w >= 5 THEN round(stddev_samp(value) OVER w, 4) + 0.0 END AS sd FROM obs
WINDOW w AS (PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def centered_rolling(spark, sf):
    """Centred rolling median and deviation with a least count."""
    w = Window.partitionBy("station").orderBy("sec", "event_id").rowsBetween(-5, 5)
    ok = F.count("value").over(w) >= 5
    return obs(spark, sf).select("event_id", F.when(ok, r(F.percentile("value", 0.5).over(w))).alias("med"), F.when(ok, r(F.stddev_samp("value").over(w))).alias("sd"))


@query(f"""WITH {OBS} SELECT event_id, round(value - lag(value) OVER w, 4) + 0.0 AS diff, sec - lag(sec) OVER w AS seconds, count(*) OVER (PARTITION BY station) AS group_size, first_value(value) OVER w AS first_value FROM obs WHERE value IS NOT NULL
WINDOW w AS (PARTITION BY station ORDER BY sec, event_id)""")
def differences(spark, sf):
    """Differences in value and time, group size and first value."""
    w = Window.partitionBy("station").orderBy("sec", "event_id")
    return obs(spark, sf).filter(F.col("value").isNotNull()).select(
        "event_id", r(F.col("value") - F.lag("value").over(w)).alias("diff"), (F.col("sec") - F.lag("sec").over(w)).alias("seconds"),
        F.count("*").over(Window.partitionBy("station")).alias("group_size"), F.first("value").over(w).alias("first_value"))


@query(f"""WITH {OBS}, v AS (SELECT * FROM obs WHERE value IS NOT NULL), e AS (SELECT variable, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM v GROUP BY variable)
SELECT event_id, row_number() OVER (PARTITION BY variable ORDER BY value, event_id) AS rank_first, rank() OVER (PARTITION BY variable ORDER BY value) AS rank_min, CASE WHEN value <= a THEN 0 WHEN value <= b THEN 1 WHEN value <= c THEN 2 ELSE 3 END AS bin FROM v JOIN e USING (variable)""")
def ranks_and_bins(spark, sf):
    """Ranks and quantile bins by exact edges."""
    v = obs(spark, sf).filter(F.col("value").isNotNull())
    e = v.groupBy("variable").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    b = F.when(F.col("value") <= F.col("q")[0], 0).when(F.col("value") <= F.col("q")[1], 1).when(F.col("value") <= F.col("q")[2], 2).otherwise(3)
    return v.join(e, "variable").select(
        "event_id", F.row_number().over(Window.partitionBy("variable").orderBy("value", "event_id")).alias("rank_first"),
        F.rank().over(Window.partitionBy("variable").orderBy("value")).alias("rank_min"), b.alias("bin"))


@query(f"""WITH {OBS}, v AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY value DESC, event_id) AS k FROM obs WHERE value IS NOT NULL) SELECT station, k AS place, event_id, value FROM v WHERE k <= 5""")
def top_values(spark, sf):
    """Five largest values of each station."""
    w = Window.partitionBy("station").orderBy(F.desc("value"), "event_id")
    v = obs(spark, sf).filter(F.col("value").isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 5)
    return v.select("station", "place", "event_id", "value")


@query(f"""WITH {OBS} SELECT station, sec // 86400 AS day, arg_max(sec, value * 1000000 - event_id / 1e9) AS at_max FROM obs WHERE value IS NOT NULL GROUP BY ALL""")
def daily_argmax(spark, sf):
    """Second of the largest value of each day."""
    v = obs(spark, sf).filter(F.col("value").isNotNull())
    return v.groupBy("station", F.expr("sec div 86400").alias("day")).agg(F.max_by("sec", F.col("value") * 1000000 - F.col("event_id") / F.lit(1e9)).alias("at_max"))


@query(f"""WITH {SLOTS}, f AS (SELECT slot, list(station ORDER BY station) AS members, count(*) AS n FROM slots WHERE value IS NOT NULL GROUP BY slot), p AS (SELECT *, lag(slot) OVER (ORDER BY slot) AS ps, lag(members) OVER (ORDER BY slot) AS pm FROM f)
SELECT slot, n, CASE WHEN slot - ps <= 2 THEN len(list_intersect(members, pm)) END AS shared FROM p""")
def previous_field(spark, sf):
    """Stations shared with the field before, if that is within an hour."""
    s = slots(spark, sf).filter(F.col("value").isNotNull()).select("station", "slot")
    fields = s.groupBy("slot").agg(F.count("*").alias("n"))
    # Fields are one row a slot: the lag runs on days, with the last slots of the day before.
    w = Window.partitionBy("_p").orderBy("slot")
    spread = fields.withColumn("_p", F.explode(F.array(F.expr("slot div 48"), F.expr("(slot + 2) div 48")))).distinct()
    prev = spread.withColumn("ps", F.lag("slot").over(w)).filter(F.col("_p") == F.expr("slot div 48")).select("slot", "n", "ps")
    both = s.join(prev.select("slot", "ps"), "slot").join(s.select("station", F.col("slot").alias("ps")), ["station", "ps"]).groupBy("slot").agg(F.count("*").alias("shared"))
    near = F.col("slot") - F.col("ps") <= 2
    return prev.join(both, "slot", "left").select("slot", "n", F.when(near, F.coalesce("shared", F.lit(0))).alias("shared"))


@query(f"""WITH {OBS} SELECT event_id, round(sin(2 * pi() * (sec % 86400) / 86400.0), 6) + 0.0 AS day_sin, round(cos(2 * pi() * (sec % 86400) / 86400.0), 6) + 0.0 AS day_cos, CASE WHEN (sec % 86400) // 3600 BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS part,
(sec % 86400) // 3600 IN (0, 6, 12, 18) AS kept_hour FROM obs""")
def cyclic_and_hours(spark, sf):
    """Cyclic encoding, day or night and the hour cut."""
    s = F.col("sec") % 86400
    angle = 2 * F.pi() * s / F.lit(86400.0)
    hour = F.expr("(sec % 86400) div 3600")
    return obs(spark, sf).select("event_id", r(F.sin(angle), 6).alias("day_sin"), r(F.cos(angle), 6).alias("day_cos"), F.when(hour.between(6, 17), "day").otherwise("night").alias("part"), hour.isin(0, 6, 12, 18).alias("kept_hour"))


@query(f"WITH {ORDERS_SQL} SELECT station, d::VARCHAR AS date, value FROM o WHERE month(d) IN (2, 5, 8, 11) AND year(d) BETWEEN 1996 AND 1999 AND value IS NOT NULL")
def seasonal4_subset(spark, sf):
    """The months of the four-season subset in a range of years."""
    o = _orders(spark, sf)
    return o.filter(F.month("d").isin(2, 5, 8, 11) & F.year("d").between(1996, 1999) & F.col("value").isNotNull()).select("station", F.col("d").cast("string").alias("date"), "value")


@query(f"""WITH {ORDERS_SQL}, k AS (SELECT DISTINCT strftime(d, '%Y') AS y, strftime(d, '%W') AS w, station % 2 AS clamp FROM o)
SELECT y || '-W' || w AS label, clamp = 1 AS clamped, ((y || '-01-01')::DATE + CAST((8 - isodow((y || '-01-01')::DATE)) % 7 AS INTEGER) + (greatest(w::INTEGER, CASE WHEN clamp = 1 THEN 1 ELSE 0 END) - 1) * 7)::VARCHAR AS monday FROM k""")
def time_key_parse(spark, sf):
    """a week label back to its Monday; the clamped form takes W00 as W01."""
    o = _orders(spark, sf)
    k = o.select(T.week_label(F.col("d"), own=True).alias("label"), (F.col("station") % 2 == 1).alias("clamped")).distinct()
    jan = F.make_date(F.substring("label", 1, 4).cast("int"), F.lit(1), F.lit(1))
    first = F.date_add(jan, ((7 - F.weekday(jan)) % 7).cast("int"))
    n = F.greatest(F.substring("label", 7, 2).cast("int"), F.col("clamped").cast("int"))
    return k.select("label", "clamped", F.date_add(first, (n - 1) * 7).cast("string").alias("monday"))


@query(f"""WITH {OBS}, d AS (SELECT variable, sec - lag(sec) OVER (PARTITION BY station, variable ORDER BY sec, event_id) AS dt FROM obs)
SELECT variable, round(quantile_cont(dt, 0.5), 2) + 0.0 AS median_s, CASE WHEN quantile_cont(dt, 0.5) <= 5400 THEN 'half_hourly' WHEN quantile_cont(dt, 0.5) <= 172800 THEN 'daily' WHEN quantile_cont(dt, 0.5) <= 864000 THEN 'weekly' ELSE 'monthly' END AS resolution FROM d GROUP BY variable""")
def infer_resolution(spark, sf):
    """resolution from the median spacing."""
    w = Window.partitionBy("station", "variable").orderBy("sec", "event_id")
    d = obs(spark, sf).withColumn("dt", F.col("sec") - F.lag("sec").over(w)).groupBy("variable").agg(F.percentile("dt", 0.5).alias("m"))
    name = F.when(F.col("m") <= 5400, "half_hourly").when(F.col("m") <= 172800, "daily").when(F.col("m") <= 864000, "weekly").otherwise("monthly")
    return d.select("variable", r("m", 2).alias("median_s"), name.alias("resolution"))


@query("""WITH l AS (SELECT i, TIMESTAMP '2021-01-01' + INTERVAL (i * 30) MINUTE AS local FROM range(0, 17520) t(i)), g AS (SELECT *, local >= TIMESTAMP '2021-03-28 02:00' AND local < TIMESTAMP '2021-03-28 03:00' AS gap, local >= TIMESTAMP '2021-10-31 02:00' AND local < TIMESTAMP '2021-10-31 03:00' AS dup FROM l)
SELECT i, CASE WHEN gap OR dup THEN NULL ELSE strftime(local - CASE WHEN local >= TIMESTAMP '2021-03-28 03:00' AND local < TIMESTAMP '2021-10-31 02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') END AS utc FROM g""")
def ensure_utc(spark, sf):
    """Local times to UTC; null in the gap and the overlap of clock changes."""
    read(spark, sf, "region")
    n = spark.range(0, 17520)
    local = F.timestamp_seconds(F.lit(1609459200) + F.col("id") * 1800)
    return n.select(F.col("id").alias("i"), F.date_format(T.to_utc_or_null(local, "Europe/Vienna"), "yyyy-MM-dd HH:mm:ss").alias("utc"))

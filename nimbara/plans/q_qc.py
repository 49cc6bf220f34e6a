"""Queries on cleaning and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimbara.operators import qc as Q
from nimbara.plans.base import DAILY, OBS, SLOTS, STATIONS, daily, obs, r, read, slots, stations
from nimbara.plans.registry import query

W = "(PARTITION BY station ORDER BY sec, event_id)"
BY = ["sec", "event_id"]


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM documents""")
def safe_name(spark, sf):
    """Folded names of letters, digits and single underscores."""
    t = F.lower("text")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "_+", "_")
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace(s, "^_+|_+$", "").alias("name"))


@query("""WITH k AS (SELECT doc_id, source, md5(text) AS h FROM documents) SELECT source AS name, h AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM k GROUP BY ALL""")
def hash_dedupe(spark, sf):
    """One row per name and digest of the whole content."""
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.md5("text").alias("digest"))
    return d.groupBy("name", "digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number, TRY_CAST(p_type AS DOUBLE) AS not_a_number FROM part""")
def numeric_coercion(spark, sf):
    """Invalid numbers are null."""
    p = read(spark, sf, "part")
    return p.select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("double").alias("brand_number"), F.col("p_type").try_cast("double").alias("not_a_number"))


@query(f"""WITH {STATIONS}, s AS (SELECT station, CASE WHEN station % 7 = 0 THEN lon ELSE lat END AS a, CASE WHEN station % 7 = 0 THEN lat ELSE lon END AS b FROM stations)
SELECT station, CASE WHEN b > a THEN b ELSE a END AS lat, CASE WHEN b > a THEN a ELSE b END AS lon, b > a AS swapped FROM s""")
def coordinate_swap(spark, sf):
    """Swapped coordinates are put right (here latitudes exceed longitudes)."""
    s = stations(spark, sf)
    odd = F.col("station") % 7 == 0
    s = s.select("station", F.when(odd, F.col("lon")).otherwise(F.col("lat")).alias("a"), F.when(odd, F.col("lat")).otherwise(F.col("lon")).alias("b"))
    return s.select("station", F.greatest("a", "b").alias("lat"), F.least("a", "b").alias("lon"), (F.col("b") > F.col("a")).alias("swapped"))


@query(f"""WITH {OBS} SELECT event_id, CASE variable WHEN 'view' THEN CASE WHEN value BETWEEN -40 AND 50 THEN value END WHEN 'click' THEN CASE WHEN value BETWEEN 0 AND 80 THEN value END
WHEN 'error' THEN CASE WHEN value BETWEEN 1 AND 100 THEN value END WHEN 'signup' THEN CASE WHEN value BETWEEN 0 AND 300 THEN value END ELSE CASE WHEN value >= 0 THEN value END END AS value FROM obs""")
def light_range(spark, sf):
    """Limits by variable."""
    limits = {"view": (-40, 50), "click": (0, 80), "error": (1, 100), "signup": (0, 300)}
    v = F.col("value")
    out = Q.in_range(v, 0, None)
    for k, (lo, hi) in limits.items():
        out = F.when(F.col("variable") == k, Q.in_range(v, lo, hi)).otherwise(out)
    return obs(spark, sf).select("event_id", out.alias("value"))


@query(f"""WITH {SLOTS}, c AS (SELECT station, 100.0 * count(value) / (max(slot) - min(slot) + 1) AS pct FROM slots GROUP BY station) SELECT station, round(pct, 4) + 0.0 AS pct, pct >= 4.5 AS accepted FROM c""")
def coverage_gate(spark, sf):
    """Share of the full grid that has values."""
    c = slots(spark, sf).groupBy("station").agg((100.0 * F.count("value") / (F.max("slot") - F.min("slot") + 1)).alias("p"))
    return c.select("station", r("p").alias("pct"), (F.col("p") >= 4.5).alias("accepted"))


@query(f"""WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY station, sec // 3600 ORDER BY sec, event_id) AS a, row_number() OVER (PARTITION BY station, sec // 3600 ORDER BY sec DESC, event_id DESC) AS b FROM obs)
SELECT station, sec // 3600 AS hour, max(CASE WHEN a = 1 THEN event_id END) AS first_id, max(CASE WHEN b = 1 THEN event_id END) AS last_id FROM k GROUP BY ALL""")
def keep_first_last(spark, sf):
    """First and last row of each key."""
    k = F.struct("sec", "event_id")
    return obs(spark, sf).groupBy("station", F.expr("sec div 3600").alias("hour")).agg(F.min_by("event_id", k).alias("first_id"), F.max_by("event_id", k).alias("last_id"))


@query(f"""WITH {STATIONS} SELECT round(lat, 1) + 0.0 AS lat_key, round(lon, 1) + 0.0 AS lon_key, min(station) AS station, count(*) AS merged FROM stations GROUP BY ALL""")
def dedupe_coordinates(spark, sf):
    """First station of each rounded place."""
    return stations(spark, sf).groupBy(r("lat", 1).alias("lat_key"), r("lon", 1).alias("lon_key")).agg(F.min("station").alias("station"), F.count("*").alias("merged"))


@query(f"""WITH {OBS}, v AS (SELECT station, string_agg(DISTINCT variable, ', ' ORDER BY variable) AS variables FROM obs WHERE station % 3 = 0 OR variable <> 'view' GROUP BY station)
SELECT station, variables, list_contains(string_split(variables, ', '), 'view') AS has_view FROM v""")
def list_membership(spark, sf):
    """Membership in a comma list."""
    o = obs(spark, sf).filter((F.col("station") % 3 == 0) | (F.col("variable") != "view"))
    v = o.groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("variable")), ", ").alias("variables"))
    return v.withColumn("has_view", F.array_contains(F.split("variables", ", "), "view"))


@query(f"""WITH {OBS} SELECT event_id, CASE variable WHEN 'error' THEN least(greatest(value, 0), 100) WHEN 'view' THEN least(greatest(value, 2), 60) WHEN 'signup' THEN least(greatest(value, 50), 550) ELSE greatest(value, 0) END AS value FROM obs WHERE value IS NOT NULL""")
def clip_variable(spark, sf):
    """Physical limits by variable."""
    v, k = F.col("value"), F.col("variable")
    clip = lambda lo, hi: F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))
    out = F.when(k == "error", clip(0, 100)).when(k == "view", clip(2, 60)).when(k == "signup", clip(50, 550)).otherwise(F.greatest(v, F.lit(0.0)))
    return obs(spark, sf).filter(v.isNotNull()).select("event_id", out.alias("value"))


@query(f"""WITH {STATIONS}, {OBS}, n AS (SELECT station, count(DISTINCT variable) AS n_vars, count(*) AS n_rows FROM obs GROUP BY station)
SELECT station, provider, n_vars, n_rows FROM stations JOIN n USING (station) WHERE lat BETWEEN 46.3 AND 47.7 AND lon BETWEEN 9.2 AND 11.5 AND elev BETWEEN 300 AND 2500 AND n_vars >= 3 AND provider IN ('alpha', 'gamma')""")
def dashboard_filters(spark, sf):
    """Box, elevation band, variable count and provider selection."""
    s = stations(spark, sf).filter(F.col("lat").between(46.3, 47.7) & F.col("lon").between(9.2, 11.5) & F.col("elev").between(300, 2500) & F.col("provider").isin("alpha", "gamma"))
    n = obs(spark, sf).groupBy("station").agg(F.count_distinct("variable").alias("n_vars"), F.count("*").alias("n_rows"))
    return n.join(s, "station").filter(F.col("n_vars") >= 3).select("station", "provider", "n_vars", "n_rows")


@query(f"""WITH {OBS}, q AS (SELECT station, quantile_cont(value, 0.99) AS p FROM obs GROUP BY station) SELECT event_id, value FROM obs JOIN q USING (station) WHERE value <= p""")
def p99_trim(spark, sf):
    """Rows up to their station's 99th percentile."""
    o = obs(spark, sf)
    q = o.groupBy("station").agg(F.percentile("value", 0.99).alias("p"))
    return o.join(q, "station").filter(F.col("value") <= F.col("p")).select("event_id", "value")


@query(f"""WITH {DAILY}, a AS (SELECT station, variable, sum(n) AS k, avg(value) AS v FROM daily WHERE day % 2 = 0 GROUP BY ALL), b AS (SELECT station, variable, sum(n) AS k, avg(value) AS v FROM daily WHERE day % 2 = 1 GROUP BY ALL)
SELECT station, variable, a.k = b.k AS same_count, round(CASE WHEN abs(a.v) + abs(b.v) > 0 THEN abs(a.v - b.v) / ((abs(a.v) + abs(b.v)) / 2) END, 4) + 0.0 AS rel_diff FROM a JOIN b USING (station, variable)""")
def compare_parameters(spark, sf):
    """Two parameter sets side by side with symmetric relative differences."""
    d = daily(spark, sf)
    part = lambda i: d.filter(F.col("day") % 2 == i).groupBy("station", "variable").agg(F.sum("n").alias(f"k{i}"), F.avg("value").alias(f"v{i}"))
    scale = F.abs("v0") + F.abs("v1")
    return part(0).join(part(1), ["station", "variable"]).select("station", "variable", (F.col("k0") == F.col("k1")).alias("same_count"), r(F.when(scale > 0, F.abs(F.col("v0") - F.col("v1")) / (scale / 2))).alias("rel_diff"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'even' ELSE 'Unknown' END AS label FROM events""")
def json_fields(spark, sf):
    """A field of a JSON cell and a label with a fallback."""
    e = read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    labels = F.create_map(F.lit(0), F.lit("even"))
    return e.withColumn("label", F.coalesce(F.try_element_at(labels, (F.col("k") % 2).cast("int")), F.lit("Unknown")))


@query(f"""WITH {STATIONS}, {OBS}, b AS (SELECT *, CASE WHEN station % 13 = 0 THEN 2 WHEN elev < 500 THEN 0 WHEN elev < 1000 THEN 1 WHEN elev < 1500 THEN 2 WHEN elev < 2000 THEN 3 ELSE 4 END AS band FROM stations)
SELECT event_id, band, value NOT BETWEEN 0 AND 300 AS hard, value > [250, 200, 150, 120, 100][band + 1] AS soft FROM obs JOIN b USING (station) WHERE value IS NOT NULL""")
def range_band_flags(spark, sf):
    """Q01, Q02: hard limits and limits by elevation band; a missing elevation takes band 2."""
    e = F.when(F.col("station") % 13 != 0, F.col("elev"))
    b = stations(spark, sf).select("station", Q.band_of(e, [0, 500, 1000, 1500, 2000, 4000], 2).alias("band"))
    soft = F.element_at(F.array(*[F.lit(float(x)) for x in (250, 200, 150, 120, 100)]), F.col("band") + 1)
    o = obs(spark, sf).filter(F.col("value").isNotNull()).join(b, "station")
    return o.select("event_id", "band", (~F.col("value").between(0, 300)).alias("hard"), (F.col("value") > soft).alias("soft"))


@query(f"""WITH {OBS} SELECT event_id, coalesce(abs(value - lag(value) OVER {W}) > 60, false) AS spike, coalesce(value > 150, false) AS high FROM obs""")
def spike_flags(spark, sf):
    """Q03, Q04: step spikes between adjacent rows, and absolute ones."""
    return Q.step_spike(obs(spark, sf), ["station"], BY, 60).select("event_id", "spike", F.coalesce(F.col("value") > 150, F.lit(False)).alias("high"))


_RUN = """i AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY station ORDER BY sec, event_id), false) THEN 1 ELSE 0 END AS fresh FROM s),
j AS (SELECT *, CASE WHEN inside THEN sum(fresh) OVER (PARTITION BY station ORDER BY sec, event_id) END AS run FROM i),
k AS (SELECT *, CASE WHEN inside THEN count(*) OVER (PARTITION BY station, run) END AS run_length FROM j)"""


@query(f"""WITH {OBS}, s AS (SELECT *, coalesce(abs(value - lag(value) OVER {W}) < 30, false) AS inside FROM obs), {_RUN}
SELECT event_id, run::BIGINT AS run, run_length, coalesce(run_length >= 4, false) AS stuck FROM k""")
def stuck_runs(spark, sf):
    """Plateaus; their first row is not part of them."""
    return Q.stuck(obs(spark, sf), ["station"], BY, 30, 4).select("event_id", "run", "run_length", "stuck")


@query(f"""WITH {OBS}, s AS (SELECT *, coalesce(value <= 40, false) AS inside FROM obs), {_RUN} SELECT event_id, coalesce(run_length >= 5, false) AS dry_run FROM k""")
def saturation_runs(spark, sf):
    """Q07: long runs beyond a level."""
    return Q.runs(obs(spark, sf), ["station"], BY, F.col("value") <= 40).select("event_id", F.coalesce(F.col("run_length") >= 5, F.lit(False)).alias("dry_run"))


@query(f"""WITH {STATIONS}, {OBS}, s AS (SELECT o.*, coalesce(abs(value - lag(value) OVER {W}) < 30, false) AS inside FROM obs o), {_RUN},
runs AS (SELECT station, run, min(sec) AS a, max(sec) AS b, count(*) AS n FROM k WHERE inside GROUP BY ALL HAVING count(*) >= 4),
near AS (SELECT x.station, y.station AS other FROM stations x JOIN stations y ON x.station <> y.station AND 6371 * 2 * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))) <= 25),
m AS (SELECT k.station, k.run, near.other, quantile_cont(abs(k.value - o.value), 0.5) AS med FROM k JOIN runs USING (station, run) JOIN near ON near.station = k.station JOIN obs o ON o.station = near.other AND o.sec // 21600 = k.sec // 21600 GROUP BY ALL)
SELECT station, run::BIGINT AS run, n, count(CASE WHEN med <= 25 THEN 1 END) > 0 AS kept FROM runs LEFT JOIN m USING (station, run) GROUP BY ALL""")
def neighbour_rescue(spark, sf):
    """Q06: a stuck run stays if a station within 25 km agrees with it."""
    k = Q.stuck(obs(spark, sf), ["station"], BY, 30, 4).filter("stuck").withColumn("bin", F.expr("sec div 21600"))
    runs = k.groupBy("station", "run").agg(F.count("*").alias("n"))
    ok = Q.agreeing(k, obs(spark, sf).select("station", F.expr("sec div 21600").alias("bin"), "value"), stations(spark, sf), 25.0, 25.0)
    return runs.join(ok.withColumn("kept", F.lit(True)), ["station", "run"], "left").select("station", "run", "n", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(f"""WITH {STATIONS}, {OBS}, w AS (SELECT event_id, elev, CASE WHEN count(value) OVER a >= 8 THEN stddev_samp(value) OVER a END AS sd, CASE WHEN count(value) OVER b >= 6 THEN avg(value) OVER b END AS mean FROM obs JOIN stations USING (station)
WINDOW a AS (PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), b AS (PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(elev > 1000 AND sd < 40 AND mean < 25, false) AS iced FROM w""")
def icing_flags(spark, sf):
    """Q08: low deviation and mean at high stations."""
    o = obs(spark, sf).join(stations(spark, sf).select("station", "elev"), "station")
    return Q.icing(o, ["station"], BY, F.col("elev") > 1000).select("event_id", "iced")


@query(f"""WITH {OBS}, {STATIONS}, m AS (SELECT station, sec // 604800 AS period, sum(CASE WHEN variable = 'click' AND value > 100 THEN value ELSE 0 END) AS total FROM obs GROUP BY ALL),
n AS (SELECT x.station, y.station AS other, row_number() OVER (PARTITION BY x.station ORDER BY round(pow(x.lat - y.lat, 2) + pow(x.lon - y.lon, 2), 6), y.station) AS k FROM stations x JOIN stations y ON x.station <> y.station)
SELECT m.station, m.period, count(CASE WHEN o.total > 0 THEN 1 END) > 0 AS suspicious FROM m JOIN n ON n.station = m.station AND k <= 2 LEFT JOIN m o ON o.station = n.other AND o.period = m.period WHERE m.total = 0 GROUP BY ALL""")
def zero_period_neighbours(spark, sf):
    """Q09: dry periods although one of the two nearest stations is wet."""
    from nimbara.operators.joins import nearest_k

    total = F.sum(F.when((F.col("variable") == "click") & (F.col("value") > 100), F.col("value")).otherwise(0.0))
    m = obs(spark, sf).groupBy("station", F.expr("sec div 604800").alias("period")).agg(total.alias("total"))
    n = nearest_k(stations(spark, sf), 2).select("station", "other")
    o = m.select(F.col("station").alias("other"), "period", F.col("total").alias("ot"))
    zero = m.filter(F.col("total") == 0).join(n, "station").join(o, ["other", "period"], "left")
    return zero.groupBy("station", "period").agg((F.count(F.when(F.col("ot") > 0, 1)) > 0).alias("suspicious"))


@query(f"""WITH {OBS}, f AS (SELECT station, sec, event_id, round(value / 40) * 20 AS value FROM obs), g AS (SELECT *, sum(CASE WHEN coalesce(value = p, false) THEN 0 ELSE 1 END) OVER {W} AS g FROM (SELECT *, lag(value) OVER {W} AS p FROM f)),
n AS (SELECT *, count(*) OVER (PARTITION BY station, g) AS n FROM g) SELECT event_id, value FROM n WHERE NOT coalesce(n > 2 AND value > 2, false)""")
def flatline_drop(spark, sf):
    """Q10: rows of long runs of equal values go."""
    f = obs(spark, sf).select("station", "sec", "event_id", (F.round(F.col("value") / 40) * 20).alias("value"))
    return Q.flatline(f, ["station"], BY, 2).select("event_id", "value")


@query(f"""WITH {OBS} SELECT event_id, coalesce(count(value) OVER w >= 5 AND abs(value - quantile_cont(value, 0.5) OVER w) > 1.8 * stddev_samp(value) OVER w, false) AS outlier FROM obs
WINDOW w AS (PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def tukey_despike(spark, sf):
    """Q12: centred median and deviation."""
    return Q.tukey(obs(spark, sf), ["station"], BY, 5, 1.8, 5).select("event_id", "outlier")


def _spikes(rows: str, least: int) -> str:
    """Chain of SQL views from ``rows`` to ``spikes`` (med, spike)."""
    c = "PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING"
    o = "PARTITION BY station ORDER BY sec, event_id"
    return f"""m1 AS (SELECT *, CASE WHEN count(value) OVER ({c}) >= {least} THEN quantile_cont(value, 0.5) OVER ({c}) END AS med FROM {rows}),
m2 AS (SELECT *, abs(value - med) AS dev FROM m1),
m3 AS (SELECT *, CASE WHEN count(dev) OVER ({c}) >= {least} THEN quantile_cont(dev, 0.5) OVER ({c}) END AS mad,
  abs(value - lag(value) OVER ({o})) > 25.0 * ((sec - lag(sec) OVER ({o})) / 3600.0) AS fast FROM m2),
spikes AS (SELECT * EXCLUDE (dev, mad, fast), coalesce(dev > 4 * mad, false) OR coalesce(fast, false) AS spike FROM m3)"""


@query(f"""WITH {OBS}, {_spikes("obs", 3)}
SELECT event_id, spike, round(CASE WHEN spike THEN med ELSE value END, 4) + 0.0 AS clean FROM spikes""")
def mad_spikes(spark, sf):
    """Q16: spikes by median deviation or rate, replaced by the centred median."""
    s = Q.mad_spikes(obs(spark, sf), ["station"], BY, "sec")
    return s.select("event_id", "spike", r(F.when(F.col("spike"), F.col("med")).otherwise(F.col("value"))).alias("clean"))


@query(f"""WITH {OBS} SELECT station, round(100.0 * count(CASE WHEN value < 20 THEN 1 END) / count(value), 4) + 0.0 AS pct_low, 100.0 * count(CASE WHEN value < 20 THEN 1 END) / count(value) < 25 AS problematic FROM obs WHERE (sec // 86400) % 30 BETWEEN 5 AND 20 GROUP BY station""")
def season_zero_share(spark, sf):
    """Q13: share of near-zero values inside a season window."""
    o = obs(spark, sf).filter((F.expr("sec div 86400") % 30).between(5, 20))
    pct = 100.0 * F.count(F.when(F.col("value") < 20, 1)) / F.count("value")
    return o.groupBy("station").agg(r(pct).alias("pct_low"), (pct < 25).alias("problematic"))


#: The supplied month spread over a year: every day stands for twelve.
_SEASON = f"""{DAILY}, {STATIONS}, d AS (SELECT station, DATE '2024-01-01' + CAST(12 * (day - 19723) AS INTEGER) AS date, max(CASE WHEN variable = 'view' THEN value END) AS value,
  max(CASE WHEN variable = 'click' THEN value END) / 10 - 4 AS ta FROM daily GROUP BY ALL),
s0 AS (SELECT d.*, station % 3 <> 0 AND elev <= 2400 AS judged, year(date) AS y, month(date) AS m, lag(value, 3) OVER (PARTITION BY station ORDER BY date) AS before FROM d JOIN stations USING (station)),
pk AS (SELECT station, y, max(CASE WHEN m <= 3 THEN value END) AS top, arg_max(date, CASE WHEN m <= 3 THEN value END) AS any_peak FROM s0 WHERE m <= 10 AND judged GROUP BY ALL HAVING count(*) >= 20),
p AS (SELECT pk.station, pk.y, top, min(date) AS peak FROM pk JOIN s0 ON s0.station = pk.station AND s0.y = pk.y AND m <= 3 AND value = top GROUP BY ALL),
f AS (SELECT p.station, p.y, top, peak, min(date) AS low_day, arg_min(value, date) AS later FROM p LEFT JOIN s0 ON s0.station = p.station AND s0.y = p.y AND m <= 10 AND value < 20 AND date >= peak GROUP BY ALL),
e AS (SELECT station, y, least(CASE WHEN low_day - peak > 3 AND top > later THEN low_day + CAST(floor(abs(18.0 / ((later - top) / (low_day - peak)))) AS INTEGER) ELSE make_date(y, 7, 20) END, make_date(y, 10, 31)) AS season_end FROM f)"""


@query(f"""WITH {_SEASON} SELECT station, strftime(date, '%Y-%m-%d') AS date, round(value, 4) + 0.0 AS value, CASE WHEN m IN (9, 10) AND season_end IS NOT NULL THEN coalesce(ta < 0 AND value > before, false)
ELSE NOT coalesce(date >= greatest(season_end, make_date(y, 4, 1)) AND date <= make_date(y, 10, 31), false) END AS snow_day FROM s0 LEFT JOIN e USING (station, y)""")
def season_end(spark, sf):
    """Q14: days on which snow may lie, by the peak, the fall after it and the autumn's temperature."""
    d = daily(spark, sf).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (12 * (F.col("day") - 19723)).cast("int")))
    d = d.groupBy("station", "date").agg(F.max(F.when(F.col("variable") == "view", F.col("value"))).alias("value"), (F.max(F.when(F.col("variable") == "click", F.col("value"))) / 10 - 4).alias("ta"))
    s = stations(spark, sf).select("station", ((F.col("station") % 3 != 0) & (F.col("elev") <= 2400)).alias("judged"))
    out = Q.snow_days(d.join(s, "station"), "station")
    return out.select("station", F.date_format("date", "yyyy-MM-dd").alias("date"), r("value").alias("value"), "snow_day")


@query(f"""WITH {STATIONS}, p AS (SELECT x.station, y.station AS other, round(sqrt(pow((x.lat - y.lat) * 111, 2) + pow((x.lon - y.lon) * 111, 2)), 6) AS km FROM stations x JOIN stations y ON x.station <> y.station AND abs(x.elev - y.elev) <= 400),
q AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY km, other) AS k FROM p WHERE km <= 30) SELECT station, other, km + 0.0 AS km FROM q WHERE k = 1""")
def companion_station(spark, sf):
    """Q15: nearest station within a distance and an elevation difference."""
    from nimbara.operators.joins import companions

    return companions(stations(spark, sf), 30.0, 400.0)


def _long(rows: str, name: str, flag: str, hours: int) -> str:
    """SQL view ``name``: ``rows`` with ``clean`` set to 0 in runs of ``flag`` that span so many hours."""
    return f"""{name}a AS (SELECT *, coalesce({flag}, false) AS flag FROM {rows}),
{name}b AS (SELECT *, CASE WHEN coalesce(flag <> lag(flag) OVER {W}, true) THEN 1 ELSE 0 END AS turn FROM {name}a),
{name}c AS (SELECT *, sum(turn) OVER {W} AS run FROM {name}b),
{name} AS (SELECT * EXCLUDE (flag, turn, run, clean), CASE WHEN flag AND (max(sec) OVER (PARTITION BY station, run) - min(sec) OVER (PARTITION BY station, run)) / 3600.0 >= {hours} THEN 0 ELSE clean END AS clean FROM {name}c)"""


def _sd(rows: int) -> str:
    back = f"(PARTITION BY station ORDER BY sec, event_id ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(clean) OVER {back} >= {rows} THEN stddev_samp(clean) OVER {back} END"


#: Thin packs: a third of the stations hardly vary.
_THIN = "thin AS (SELECT station, sec, event_id, CASE WHEN station % 3 = 0 THEN 5 + value / 200 ELSE value / 8 - 0.5 END AS value FROM obs)"


@query(f"""WITH {OBS}, {_THIN}, {_spikes("thin", 12)}, h0 AS (SELECT *, CASE WHEN spike THEN med ELSE value END AS clean FROM spikes),
h1 AS (SELECT *, {_sd(36)} AS sd FROM h0), {_long("h1", "h2", "sd < 1.2 AND clean > 2 AND clean < 25", 18)},
h3 AS (SELECT * EXCLUDE (sd), {_sd(24)} AS sd FROM h2), {_long("h3", "h4", "sd > 4.0 AND clean < 15", 8)},
h5 AS (SELECT *, CASE WHEN coalesce(abs(clean - lag(clean) OVER {W}) > 8 AND clean < 15, false) THEN 0 ELSE clean END AS done FROM h4)
SELECT event_id, spike, round(CASE WHEN done < 0 THEN 0 ELSE done END, 4) + 0.0 AS clean FROM h5""")
def hybrid_cleaning(spark, sf):
    """Q17: spikes, long plateaus, long noise and isolated steps, step by step."""
    third = F.col("station") % 3 == 0
    o = obs(spark, sf).withColumn("value", F.when(third, 5 + F.col("value") / 200).otherwise(F.col("value") / 8 - 0.5))
    return Q.behavioural(o.select("station", "sec", "event_id", "value"), ["station"], BY, "sec").select("event_id", "spike", r("clean").alias("clean"))


@query(f"""WITH {OBS}, f AS (SELECT * FROM obs WHERE value > 80), g AS (SELECT *, CASE WHEN coalesce(sec - lag(sec) OVER {W} > 43200, true) THEN 1 ELSE 0 END AS fresh FROM f), h AS (SELECT *, sum(fresh) OVER {W} AS period FROM g)
SELECT station, period::BIGINT AS period, min(sec) AS start_s, max(sec) AS end_s, round((max(sec) - min(sec)) / 3600.0, 4) + 0.0 AS hours, count(*) AS n FROM h GROUP BY ALL""")
def flagged_periods(spark, sf):
    """Q18: sessions of flagged rows."""
    p = Q.periods(obs(spark, sf).filter(F.col("value") > 80), ["station"], "sec", 43200)
    return p.select("station", "period", F.col("start").alias("start_s"), F.col("end").alias("end_s"), r((F.col("end") - F.col("start")) / 3600.0).alias("hours"), "n")


@query(f"""WITH {OBS} SELECT station, variable, count(*) AS n, count(value) AS n_before, count(CASE WHEN value <= 150 THEN 1 END) AS n_after, count(value) - count(CASE WHEN value <= 150 THEN 1 END) AS removed FROM obs GROUP BY ALL""")
def removal_counts(spark, sf):
    """Q19: values before and after a check."""
    after = F.count(F.when(F.col("value") <= 150, 1))
    return obs(spark, sf).groupBy("station", "variable").agg(F.count("*").alias("n"), F.count("value").alias("n_before"), after.alias("n_after"), (F.count("value") - after).alias("removed"))


@query(f"""WITH {OBS}, c AS (SELECT station FROM obs GROUP BY station ORDER BY md5(station::VARCHAR || ':42') LIMIT 6), e AS (SELECT station, min(sec) AS t FROM obs JOIN c USING (station) WHERE value > 120 GROUP BY station)
SELECT o.station, o.event_id FROM obs o JOIN e ON o.station = e.station AND o.sec BETWEEN e.t - 302400 AND e.t + 302400""")
def example_windows(spark, sf):
    """Q20: seven-day windows around the first event of a seeded station sample."""
    o = obs(spark, sf)
    c = o.select("station").distinct().orderBy(F.md5(F.concat(F.col("station").cast("string"), F.lit(":42")))).limit(6)
    e = o.join(c, "station").filter(F.col("value") > 120).groupBy("station").agg(F.min("sec").alias("t"))
    return o.join(e, "station").filter(F.col("sec").between(F.col("t") - 302400, F.col("t") + 302400)).select("station", "event_id")


@query(f"""WITH {OBS}, g AS (SELECT station, sec // 21600 AS t, max(value) AS value, max(variable) AS variable, count(DISTINCT coalesce(value::VARCHAR, '#')) AS a, count(DISTINCT variable) AS b FROM obs GROUP BY ALL) SELECT station, t, value, variable FROM g WHERE a = 1 AND b = 1""")
def collapse_station_time(spark, sf):
    """Q22: keys with conflicting rows go, the others become one row."""
    o = obs(spark, sf).withColumn("t", F.expr("sec div 21600"))
    return Q.collapse(o, ["station", "t"], ["value", "variable"])

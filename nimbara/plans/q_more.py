"""Further scalar functions, fields and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nimbara.plans.base import DAILY, OBS, STATIONS, daily, obs, r, read, stations
from nimbara.plans.q_models import FIELD, field
from nimbara.plans.registry import query
from nimbara.sources.providers import first_field


@query("""SELECT event_id, TRY_CAST(regexp_extract('{"meta": {"site": {"breite": ' || (event_id % 90) || '.5}}, "props": ' || props || '}', '"(?:lat|breite|latitude)"\\s*:\\s*"?(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS lat FROM events""")
def metadata_field(spark, sf):
    """The first of several keys at any depth of a record."""
    doc = F.concat(F.lit('{"meta": {"site": {"breite": '), (F.col("event_id") % 90).cast("string"), F.lit('.5}}, "props": '), "props", F.lit("}"))
    return read(spark, sf, "events").select("event_id", first_field(doc, ["lat", "breite", "latitude"]).alias("lat"))


@query(f"WITH {STATIONS} SELECT station, floor(lat)::BIGINT || ' ' || lpad((station % 60)::VARCHAR, 2, '0') || ' ' || lpad((station * 7 % 60)::VARCHAR, 2, '0') AS dms, round(floor(lat) + (station % 60) / 60.0 + (station * 7 % 60) / 3600.0, 6) + 0.0 AS degrees FROM stations")
def dms_degrees(spark, sf):
    """degrees, minutes and seconds as decimal degrees."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = stations(spark, sf).select("station", F.concat_ws(" ", F.floor("lat").cast("string"), two(F.col("station") % 60), two(F.col("station") * 7 % 60)).alias("dms"))
    p = F.split("dms", " ")
    return s.select("station", "dms", r(p[0].cast("double") + p[1].cast("double") / 60 + p[2].cast("double") / 3600, 6).alias("degrees"))


_COV = """CASE kind WHEN 'spherical' THEN CASE WHEN x < 1 THEN 1 - 1.5 * x + 0.5 * pow(x, 3) ELSE 0 END WHEN 'gaussian' THEN exp(-x * x) WHEN 'matern15' THEN (1 + sqrt(3.0) * x) * exp(-sqrt(3.0) * x) ELSE exp(-x) END"""


@query(f"""WITH {STATIONS}, k(kind) AS (VALUES ('spherical'), ('exponential'), ('gaussian'), ('matern15')), d AS (SELECT station, sqrt(pow((lon - 9) * 76, 2) + pow((lat - 46) * 111, 2)) / 80.0 AS x FROM stations) SELECT station, kind, round({_COV}, 6) + 0.0 AS covariance FROM d, k""")
def covariance_families(spark, sf):
    """covariance families at each station's distance from the origin."""
    x = F.sqrt(F.pow((F.col("lon") - 9) * 76, 2.0) + F.pow((F.col("lat") - 46) * 111, 2.0)) / 80.0
    d = stations(spark, sf).select("station", x.alias("x"), F.explode(F.array(*[F.lit(k) for k in ("spherical", "exponential", "gaussian", "matern15")])).alias("kind"))
    x, k, root = F.col("x"), F.col("kind"), 3.0**0.5
    c = F.when(k == "spherical", F.when(x < 1, 1 - 1.5 * x + 0.5 * F.pow(x, F.lit(3.0))).otherwise(0.0)).when(k == "gaussian", F.exp(-x * x)).when(k == "matern15", (1 + root * x) * F.exp(-root * x)).otherwise(F.exp(-x))
    return d.select("station", "kind", r(c, 6).alias("covariance"))


@query(f"""WITH {FIELD}, c AS (SELECT day, CAST(floor(x / 20) AS BIGINT) AS ix, CAST(floor(y / 20) AS BIGINT) AS iy, value, exp(-abs(z - 1000) / 300) AS w FROM f) SELECT day, ix, iy, count(*) AS n, round(sum(w * value) / sum(w), 4) + 0.0 AS value, round(max(w), 5) + 0.0 AS weight, round(sin(2 * pi() * (day % 365) / 365.25), 6) + 0.0 AS season_sin FROM c GROUP BY ALL""")
def raster_packing(spark, sf):
    """Station values packed into cells with elevation weights, and the season's phase."""
    c = field(spark, sf).select("day", F.floor(F.col("x") / 20).alias("ix"), F.floor(F.col("y") / 20).alias("iy"), "value", F.exp(-F.abs(F.col("z") - 1000) / 300).alias("w"))
    g = c.groupBy("day", "ix", "iy").agg(F.count("*").alias("n"), r(F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), r(F.max("w"), 5).alias("weight"))
    return g.withColumn("season_sin", r(F.sin(2 * F.pi() * (F.col("day") % 365) / 365.25), 6))


@query(f"WITH {OBS}, p AS (SELECT station, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.9) AS c FROM obs GROUP BY station) SELECT station, round(a, 4) + 0.0 AS p10, round(b, 4) + 0.0 AS p50, round(c, 4) + 0.0 AS p90 FROM p")
def exact_quantiles(spark, sf):
    """exact quantiles with linear interpolation."""
    q = obs(spark, sf).groupBy("station").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("station", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query(f"WITH {DAILY}, k AS (SELECT station, variable, day, value, row_number() OVER (PARTITION BY station, variable ORDER BY day) AS k FROM daily) SELECT station, variable, day, round(value, 4) + 0.0 AS value FROM k WHERE k % 5 = 1")
def every_nth(spark, sf):
    """Every fifth step of each ordered series."""
    k = F.row_number().over(Window.partitionBy("station", "variable").orderBy("day"))
    return daily(spark, sf).withColumn("k", k).filter(F.col("k") % 5 == 1).select("station", "variable", "day", r("value").alias("value"))


@query(f"WITH {OBS} SELECT variable, count(DISTINCT station) AS stations FROM obs GROUP BY variable")
def distinct_stations(spark, sf):
    """Exact distinct counts; an approximate one must stay within a tenth."""
    g = obs(spark, sf).groupBy("variable").agg(F.count_distinct("station").alias("stations"), F.approx_count_distinct("station", 0.02).alias("about"))
    return g.select("variable", F.when(F.abs(F.col("about") - F.col("stations")) <= 0.1 * F.col("stations"), F.col("stations")).alias("stations"))


@query(f"WITH {OBS}, h AS (SELECT sec // 86400 AS day, count(*) AS n FROM obs GROUP BY 1) SELECT day, n, n <= 400 AS kept FROM h WHERE day IN (SELECT day FROM h ORDER BY md5(day::VARCHAR || ':22'), day LIMIT 10)")
def capped_days(spark, sf):
    """Whole days sampled by a seeded hash."""
    h = obs(spark, sf).groupBy(F.expr("sec div 86400").alias("day")).agg(F.count("*").alias("n"))
    c = h.orderBy(F.md5(F.concat(F.col("day").cast("string"), F.lit(":22"))), "day").limit(10)
    return c.select("day", "n", (F.col("n") <= 400).alias("kept"))

"""Queries on aggregation, scores, sampling and protocol."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nimbara.operators import scores as S
from nimbara.operators.joins import nearest_k
from nimbara.plans.base import DAILY, OBS, STATIONS, daily, obs, r, read, stations
from nimbara.plans.q_joins import _GRID, NEAR, grid
from nimbara.plans.registry import query

BAND = "CASE WHEN elev < 500 THEN 'low' WHEN elev < 1500 THEN 'mid' ELSE 'high' END"


def band():
    return F.when(F.col("elev") < 500, "low").when(F.col("elev") < 1500, "mid").otherwise("high")


#: Daily view values against the mean of the two nearest stations that day.
PRED = f"""{DAILY}, {STATIONS}, {NEAR}, v AS (SELECT station, day, value FROM daily WHERE variable = 'view' AND value IS NOT NULL),
pred AS (SELECT v.station, v.day, v.value AS o, avg(u.value) AS p FROM v JOIN n ON n.station = v.station AND k <= 6 JOIN v u ON u.station = n.other AND u.day = v.day GROUP BY ALL)"""


def predictions(spark, sf):
    d = daily(spark, sf).filter((F.col("variable") == "view") & F.col("value").isNotNull()).select("station", "day", "value")
    n = nearest_k(stations(spark, sf), 6).select("station", "other")
    u = d.select(F.col("station").alias("other"), "day", F.col("value").alias("u"))
    return d.join(n, "station").join(u, ["other", "day"]).groupBy("station", "day", F.col("value").alias("o")).agg(F.avg("u").alias("p"))


@query(f"WITH {OBS}, q AS (SELECT sec // 86400 AS day, value / 10 AS r FROM obs WHERE variable = 'purchase' AND value BETWEEN 20 AND 600) SELECT day, round(avg(r), 4) + 0.0 AS slr, count(*) AS n FROM q GROUP BY day")
def daily_ratio_mean(spark, sf):
    """Mean of the valid events of each day."""
    o = obs(spark, sf).filter((F.col("variable") == "purchase") & F.col("value").between(20, 600))
    return o.groupBy(F.expr("sec div 86400").alias("day")).agg(r(F.avg(F.col("value") / 10)).alias("slr"), F.count("*").alias("n"))


@query(f"WITH {DAILY}, t AS (SELECT variable, day, count(DISTINCT station) AS n, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS wet FROM daily WHERE value IS NOT NULL GROUP BY ALL) SELECT variable, count(*) AS n_times, round(quantile_cont(n, 0.5), 4) + 0.0 AS median_n, round(quantile_cont(n, 0.1), 4) + 0.0 AS p10_n, round(avg(CASE WHEN n < 50 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS frac_below, round(avg(wet), 4) + 0.0 AS wet_frac FROM t GROUP BY variable")
def completeness(spark, sf):
    """Stations per time and their spread."""
    t = daily(spark, sf).filter(F.col("value").isNotNull()).groupBy("variable", "day").agg(F.count_distinct("station").alias("n"), F.avg(F.when(F.col("value") > 40, 1.0).otherwise(0.0)).alias("wet"))
    return t.groupBy("variable").agg(F.count("*").alias("n_times"), r(F.percentile("n", 0.5)).alias("median_n"), r(F.percentile("n", 0.1)).alias("p10_n"), r(F.avg(F.when(F.col("n") < 50, 1.0).otherwise(0.0))).alias("frac_below"), r(F.avg("wet")).alias("wet_frac"))


@query(f"""WITH {OBS}, s AS (SELECT variable, unnest(['all', CASE WHEN station % 5 = 0 THEN 'dev' ELSE 'train' END]) AS subset, station, sec, value FROM obs WHERE value IS NOT NULL),
m AS (SELECT variable, subset, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY ALL)
SELECT variable, subset, count(*) AS n, round(any_value(mu), 4) + 0.0 AS mean_value, round(any_value(sd), 4) + 0.0 AS std, round(avg(pow(value - mu, 3)) / pow(any_value(sd), 3), 4) + 0.0 AS skew, round(quantile_cont(value, 0.5), 4) + 0.0 AS p50, round(quantile_cont(value, 0.9), 4) + 0.0 AS p90,
round(any_value(sd) / any_value(mu), 4) + 0.0 AS cv, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS wet_frac, count(DISTINCT station) AS stations, count(DISTINCT sec) AS times FROM s JOIN m USING (variable, subset) GROUP BY ALL""")
def profile_moments(spark, sf):
    """A10: moments and quantiles by subset."""
    o = obs(spark, sf).filter(F.col("value").isNotNull())
    s = o.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("station") % 5 == 0, "dev").otherwise("train"))))
    return s.groupBy("variable", "subset").agg(
        F.count("*").alias("n"), r(F.avg("value")).alias("mean_value"), r(F.stddev_pop("value")).alias("std"), r(F.skewness("value")).alias("skew"), r(F.percentile("value", 0.5)).alias("p50"), r(F.percentile("value", 0.9)).alias("p90"),
        r(F.stddev_pop("value") / F.avg("value")).alias("cv"), r(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0))).alias("wet_frac"), F.count_distinct("station").alias("stations"), F.count_distinct("sec").alias("times"))


@query(f"WITH {OBS}, {STATIONS} SELECT variable, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN corr(value, elev) END, 5) + 0.0 AS r FROM obs JOIN stations USING (station) WHERE value IS NOT NULL GROUP BY variable")
def correlation_elevation(spark, sf):
    """Pearson correlation with a least count."""
    o = obs(spark, sf).filter(F.col("value").isNotNull()).join(stations(spark, sf), "station")
    return o.groupBy("variable").agg(F.count("*").alias("n"), r(F.when(F.count("*") >= 8, S.pearson(F.col("value"), F.col("elev").cast("double"))), 5).alias("r"))


@query(f"""WITH {OBS}, {STATIONS}, x AS (SELECT variable, value, provider FROM obs JOIN stations USING (station) WHERE value IS NOT NULL), c AS (SELECT DISTINCT provider FROM stations),
q AS (SELECT variable, c.provider, corr(value, CASE WHEN x.provider = c.provider THEN 1.0 ELSE 0.0 END) AS r FROM x, c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY round(abs(r), 8) DESC, provider) AS k FROM q) SELECT variable, provider, round(r, 5) + 0.0 AS r FROM k WHERE k = 1""")
def point_biserial(spark, sf):
    """The class most correlated with each variable."""
    o = obs(spark, sf).filter(F.col("value").isNotNull()).join(stations(spark, sf), "station")
    names = ("alpha", "beta", "gamma", "delta")
    wide = o.groupBy("variable").agg(*[S.pearson(F.col("value"), F.when(F.col("provider") == p, 1.0).otherwise(0.0)).alias(p) for p in names])
    long = wide.unpivot("variable", list(names), "provider", "r")
    w = Window.partitionBy("variable").orderBy(F.desc(F.round(F.abs("r"), 8)), "provider")
    return long.withColumn("k", F.row_number().over(w)).filter("k = 1").select("variable", "provider", r("r", 5).alias("r"))


@query(f"""WITH {OBS}, x AS (SELECT variable, value, CASE WHEN station % 5 = 0 THEN 1 ELSE 0 END AS g FROM obs WHERE value IS NOT NULL), g AS (SELECT variable, value, sum(g) AS a, count(*) - sum(g) AS b FROM x GROUP BY ALL),
c AS (SELECT variable, sum(a) OVER w * 1.0 / sum(a) OVER v AS fa, sum(b) OVER w * 1.0 / sum(b) OVER v AS fb FROM g WINDOW w AS (PARTITION BY variable ORDER BY value), v AS (PARTITION BY variable)) SELECT variable, round(max(abs(fa - fb)), 6) + 0.0 AS ks FROM c GROUP BY variable""")
def ks_distance(spark, sf):
    """Largest distance of two empirical distributions."""
    x = obs(spark, sf).filter(F.col("value").isNotNull()).withColumn("g", (F.col("station") % 5 == 0).cast("int"))
    g = x.groupBy("variable", "value").agg(F.sum("g").alias("a"), (F.count("*") - F.sum("g")).alias("b"))
    # Running sums inside ranges of values, from the sums of all ranges before: no task sees a whole variable.
    g = g.withColumn("range", F.floor("value"))
    w = Window.partitionBy("variable").orderBy("range")
    before, all_ = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("variable")
    t = g.groupBy("variable", "range").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    t = t.select("variable", "range", *[F.coalesce(F.sum(f"s{c}").over(before), F.lit(0)).alias(f"p{c}") for c in "ab"], *[F.sum(f"s{c}").over(all_).alias(f"t{c}") for c in "ab"])
    own = Window.partitionBy("variable", "range").orderBy("value")
    share = lambda c: (F.col(f"p{c}") + F.sum(c).over(own)) / F.col(f"t{c}")
    c = g.join(t, ["variable", "range"]).select("variable", F.abs(share("a") - share("b")).alias("d"))
    return c.groupBy("variable").agg(r(F.max("d"), 6).alias("ks"))


#: Daily variables of the correlation matrix; the last one is a sum that is 0 on empty days.
DAILY_VARIABLES = ("view", "error", "signup", "purchase", "click")
DAILY_PAIRS = [(x, y) for i, x in enumerate(DAILY_VARIABLES) for y in DAILY_VARIABLES[i + 1 :]]


@query(f"WITH {DAILY}, w AS (SELECT station, day, "
       + ", ".join(f"max(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in DAILY_VARIABLES[:-1])
       + ", coalesce(max(CASE WHEN variable = 'click' THEN total END), 0) AS click FROM daily GROUP BY ALL) SELECT "
       + ", ".join(f"round(corr({x}, {y}), 5) + 0.0 AS {x}_{y}" for x, y in DAILY_PAIRS) + " FROM w")
def correlation_matrix(spark, sf):
    """All pairwise correlations of five daily variables."""
    case = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c)))
    w = daily(spark, sf).groupBy("station", "day").agg(*[case(v, "value").alias(v) for v in DAILY_VARIABLES[:-1]], F.coalesce(case("click", "total"), F.lit(0.0)).alias("click"))
    return w.agg(*[r(S.pearson(F.col(x), F.col(y)), 5).alias(f"{x}_{y}") for x, y in DAILY_PAIRS])


@query(f"""WITH {DAILY}, {STATIONS} SELECT station, provider, lat + 0.0 AS lat, lon + 0.0 AS lon, elev, variable, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS time,
round(value, 4) + 0.0 AS value, n, n >= 2 AS covered FROM daily JOIN stations USING (station) WHERE value IS NOT NULL AND lat BETWEEN 46.4 AND 47.6 AND lon BETWEEN 9.5 AND 11.5""")
def domain_aggregation(spark, sf):
    """Daily values of the stations inside the domain, in one fixed schema."""
    inside = F.col("lat").between(46.4, 47.6) & F.col("lon").between(9.5, 11.5)
    s = stations(spark, sf).withColumn("inside_domain", inside.cast("int")).filter("inside_domain = 1")
    d = daily(spark, sf).filter(F.col("value").isNotNull()).join(s, "station")
    time = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")), "yyyy-MM-dd")
    return d.select("station", "provider", "lat", "lon", "elev", "variable", time.alias("time"), r("value").alias("value"), "n", (F.col("n") >= 2).alias("covered"))


@query(f"WITH {OBS}, {STATIONS}, x AS (SELECT round(lat, 1) AS la, round(lon, 1) AS lo, provider, variable, elev FROM obs JOIN stations USING (station)) SELECT la + 0.0 AS lat_key, lo + 0.0 AS lon_key, count(DISTINCT variable) AS n_vars, string_agg(DISTINCT provider, ', ' ORDER BY provider) AS providers, round(avg(elev), 3) + 0.0 AS mean_elev FROM x GROUP BY la, lo")
def station_overlap(spark, sf):
    """Variables and providers at rounded places."""
    x = obs(spark, sf).join(stations(spark, sf), "station")
    return x.groupBy(r("lat", 1).alias("lat_key"), r("lon", 1).alias("lon_key")).agg(F.count_distinct("variable").alias("n_vars"), F.array_join(F.array_sort(F.collect_set("provider")), ", ").alias("providers"), r(F.avg("elev"), 3).alias("mean_elev"))


@query(f"WITH {OBS}, {STATIONS} SELECT coalesce(variable, 'all') AS variable, coalesce(provider, 'all') AS provider, count(DISTINCT station) AS n FROM obs JOIN stations USING (station) GROUP BY GROUPING SETS ((), (variable), (provider))")
def station_counts(spark, sf):
    """Stations in total, by variable and by provider."""
    x = obs(spark, sf).select("station", "variable").distinct().join(stations(spark, sf).select("station", "provider"), "station")
    g = x.groupingSets([[], ["variable"], ["provider"]], "variable", "provider").agg(F.count_distinct("station").alias("n"))
    return g.select(F.coalesce("variable", F.lit("all")).alias("variable"), F.coalesce("provider", F.lit("all")).alias("provider"), "n")


@query(f"WITH {DAILY}, {STATIONS}, d AS (SELECT station, day, count(DISTINCT variable) AS k FROM daily GROUP BY ALL), c AS (SELECT provider, k, count(*) AS n FROM d JOIN stations USING (station) GROUP BY ALL) SELECT provider, k AS n_vars, round(100.0 * n / sum(n) OVER (PARTITION BY provider), 4) + 0.0 AS pct FROM c")
def crosstab_rows(spark, sf):
    """Shares of each row."""
    d = daily(spark, sf).groupBy("station", "day").agg(F.count_distinct("variable").alias("n_vars")).join(stations(spark, sf), "station")
    c = d.groupBy("provider", "n_vars").count()
    return c.select("provider", "n_vars", r(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("provider"))).alias("pct"))


@query(f"""WITH {PRED}, x AS (SELECT *, CASE WHEN day % 3 = 0 THEN 'test' ELSE 'train' END AS split, {BAND} AS band FROM pred JOIN stations USING (station))
SELECT coalesce(split, 'all') AS split, coalesce(band, 'all') AS band, count(*) AS n, round(sqrt(avg(pow(p - o, 2))), 4) + 0.0 AS rmse, round(avg(p - o), 4) + 0.0 AS me FROM x GROUP BY GROUPING SETS ((split), (band), (split, band))""")
def metrics_grouping_sets(spark, sf):
    """Several groupings of the same scores in one pass."""
    x = predictions(spark, sf).join(stations(spark, sf), "station").withColumn("split", F.when(F.col("day") % 3 == 0, "test").otherwise("train")).withColumn("band", band())
    s = S.core_scores(F.col("o"), F.col("p"))
    g = x.groupingSets([["split"], ["band"], ["split", "band"]], "split", "band").agg(s["n"].alias("n"), r(s["rmse"]).alias("rmse"), r(s["me"]).alias("me"))
    return g.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("band", F.lit("all")).alias("band"), "n", "rmse", "me")


@query(f"""WITH {PRED} SELECT station, count(*) AS n, round(avg(p - o), 4) + 0.0 AS me, round(avg(abs(p - o)), 4) + 0.0 AS mae, round(sqrt(avg(pow(p - o, 2))), 4) + 0.0 AS rmse, round(sqrt(avg(pow(p - o, 2))) / 40.0, 4) + 0.0 AS rmse_std,
round(CASE WHEN stddev_pop(o) > 0 THEN 1 - sum(pow(p - o, 2)) / (count(*) * var_pop(o)) END, 4) + 0.0 AS nse, round(1 - sqrt(pow(corr(o, p) - 1, 2) + pow(stddev_pop(p) / stddev_pop(o) - 1, 2) + pow(avg(p) / avg(o) - 1, 2)), 4) + 0.0 AS kge,
round(2 * covar_pop(o, p) / (var_pop(o) + var_pop(p) + pow(avg(o) - avg(p), 2)), 4) + 0.0 AS ccc, round(corr(o, p), 4) + 0.0 AS r FROM pred GROUP BY station HAVING count(*) >= 3""")
def scores_core(spark, sf):
    """Verification scores, with the error over a reference deviation."""
    s = S.core_scores(F.col("o"), F.col("p"))
    g = predictions(spark, sf).groupBy("station").agg(s["n"].alias("n"), *[r(s[k]).alias(k) for k in ("me", "mae", "rmse", "nse", "kge", "ccc", "r")], r(s["rmse"] / 40.0).alias("rmse_std"))
    return g.filter("n >= 3")


@query(f"""WITH {PRED}, c AS (SELECT station % 10 AS grp, count(CASE WHEN o >= 50 AND p >= 50 THEN 1 END) * 1.0 AS h, count(CASE WHEN o >= 50 AND p < 50 THEN 1 END) AS m, count(CASE WHEN o < 50 AND p >= 50 THEN 1 END) AS f, count(*) AS n, sqrt(avg(CASE WHEN o >= 50 THEN pow(p - o, 2) END)) AS w FROM pred GROUP BY ALL)
SELECT grp, round(CASE WHEN h + m > 0 THEN h / (h + m) END, 4) + 0.0 AS pod, round(CASE WHEN h + f > 0 THEN f / (h + f) END, 4) + 0.0 AS far, round(CASE WHEN h + m > 0 THEN (h + f) / (h + m) END, 4) + 0.0 AS freq_bias, round(CASE WHEN h + m + f - (h + m) * (h + f) / n <> 0 THEN (h - (h + m) * (h + f) / n) / (h + m + f - (h + m) * (h + f) / n) END, 4) + 0.0 AS ets, round(w, 4) + 0.0 AS rmse_wet FROM c""")
def scores_wet(spark, sf):
    """Contingency scores at or above a trace."""
    s = S.wet_scores(F.col("o"), F.col("p"), 50.0)
    return predictions(spark, sf).groupBy((F.col("station") % 10).alias("grp")).agg(*[r(c).alias(k) for k, c in s.items()])


@query(f"""WITH {PRED}, e AS (SELECT station % 10 AS grp, unnest(['neighbour', 'climate', 'zero']) AS method, unnest([pow(p - o, 2), pow(o - 45, 2), pow(o, 2)]) AS se FROM pred), g AS (SELECT grp, method, round(sqrt(avg(se)), 6) AS rmse FROM e GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY rmse) AS rank FROM g)
SELECT grp, method, rmse + 0.0 AS rmse, rank, first_value(method) OVER (PARTITION BY grp ORDER BY rmse, method) AS best FROM k""")
def method_ranking(spark, sf):
    """Rank of methods and the best of each group."""
    e = predictions(spark, sf).select((F.col("station") % 10).alias("grp"), F.pow(F.col("p") - F.col("o"), 2.0).alias("neighbour"), F.pow(F.col("o") - 45, 2.0).alias("climate"), F.pow("o", F.lit(2.0)).alias("zero"))
    g = e.unpivot("grp", ["neighbour", "climate", "zero"], "method", "se").groupBy("grp", "method").agg(F.round(F.sqrt(F.avg("se")), 6).alias("rmse"))
    w = Window.partitionBy("grp").orderBy("rmse")
    return g.select("grp", "method", (F.col("rmse") + 0.0).alias("rmse"), F.rank().over(w).alias("rank"), F.first("method").over(Window.partitionBy("grp").orderBy("rmse", "method")).alias("best"))


@query(f"WITH {PRED} SELECT CASE WHEN elev >= 1500 THEN 'mountain' ELSE 'valley' END AS terrain, {BAND} AS band, day // 7 AS week, round(avg(p - o), 4) + 0.0 AS residual, round(stddev_samp(p - o), 4) + 0.0 AS spread, count(*) AS n FROM pred JOIN stations USING (station) GROUP BY ALL")
def error_groups(spark, sf):
    """Residuals by terrain, band and period."""
    x = predictions(spark, sf).join(stations(spark, sf), "station").withColumn("e", F.col("p") - F.col("o"))
    return x.groupBy(F.when(F.col("elev") >= 1500, "mountain").otherwise("valley").alias("terrain"), band().alias("band"), F.expr("day div 7").alias("week")).agg(r(F.avg("e")).alias("residual"), r(F.stddev_samp("e")).alias("spread"), F.count("*").alias("n"))


@query(f"WITH {PRED} SELECT provider, round(stddev_pop(o), 4) + 0.0 AS std_o, round(stddev_pop(p), 4) + 0.0 AS std_p, round(corr(o, p), 4) + 0.0 AS r FROM pred JOIN stations USING (station) GROUP BY provider")
def taylor_stats(spark, sf):
    """Deviations and correlation."""
    x = predictions(spark, sf).join(stations(spark, sf), "station")
    return x.groupBy("provider").agg(r(F.stddev_pop("o")).alias("std_o"), r(F.stddev_pop("p")).alias("std_p"), r(S.pearson(F.col("o"), F.col("p"))).alias("r"))


@query("""WITH s AS (SELECT p_size % 5 AS a, p_partkey % 3 AS b, p_retailprice AS rmse FROM part), u AS (SELECT 'a' AS parameter, a AS level, rmse FROM s UNION ALL SELECT 'b', b, rmse FROM s), g AS (SELECT parameter, level, min(rmse) AS lo, avg(rmse) AS mean_value, max(rmse) AS hi, count(*) AS n, stddev_samp(rmse) AS sd FROM u GROUP BY ALL)
SELECT parameter, level, lo, round(mean_value, 4) + 0.0 AS mean_value, hi, n, round(sd, 4) + 0.0 AS sd, round(100 * (lo - min(lo) OVER ()) / min(lo) OVER (), 4) + 0.0 AS gap_pct FROM g""")
def parameter_sensitivity(spark, sf):
    """Spread of scores at each level of each parameter."""
    s = read(spark, sf, "part").select((F.col("p_size") % 5).cast("long").alias("a"), (F.col("p_partkey") % 3).alias("b"), F.col("p_retailprice").alias("rmse"))
    u = s.unpivot("rmse", ["a", "b"], "parameter", "level")
    g = u.groupBy("parameter", "level").agg(F.min("rmse").alias("lo"), r(F.avg("rmse")).alias("mean_value"), F.max("rmse").alias("hi"), F.count("*").alias("n"), r(F.stddev_samp("rmse")).alias("sd"))
    best = g.agg(F.min("lo").alias("best"))
    return g.join(best).select("parameter", "level", "lo", "mean_value", "hi", "n", "sd", r(100 * (F.col("lo") - F.col("best")) / F.col("best")).alias("gap_pct"))


@query("SELECT p_brand, p_type, round(quantile_cont(p_retailprice, 0.5), 4) + 0.0 AS median_score, count(*) AS n FROM part GROUP BY ALL")
def search_summary(spark, sf):
    """Median score of each combination."""
    return read(spark, sf, "part").groupBy("p_brand", "p_type").agg(r(F.percentile("p_retailprice", 0.5)).alias("median_score"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_brand, avg(p_retailprice) AS x FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_brand, avg(p_retailprice) AS y FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL), d AS (SELECT abs(x - y) / ((abs(x) + abs(y)) / 2) AS d FROM a JOIN b USING (p_brand))
SELECT count(*) AS n, count(CASE WHEN d > 0.02 THEN 1 END) AS n_differ, round(avg(CASE WHEN d > 0.02 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS frac, round(max(d), 6) + 0.0 AS max_rel, round(avg(d), 6) + 0.0 AS mean_rel FROM d""")
def difference_summary(spark, sf):
    """How far two parameter sets differ."""
    p = read(spark, sf, "part")
    half = lambda i, c: p.filter(F.col("p_partkey") % 2 == i).groupBy("p_brand").agg(F.avg("p_retailprice").alias(c))
    d = F.abs(F.col("x") - F.col("y")) / ((F.abs("x") + F.abs("y")) / 2)
    x = half(0, "x").join(half(1, "y"), "p_brand").select(d.alias("d"))
    far = F.col("d") > 0.02
    return x.agg(F.count("*").alias("n"), F.count(F.when(far, 1)).alias("n_differ"), r(F.avg(F.when(far, 1.0).otherwise(0.0))).alias("frac"), r(F.max("d"), 6).alias("max_rel"), r(F.avg("d"), 6).alias("mean_rel"))


REG = f"{OBS}, reg AS (SELECT sec // 3600 AS h, CAST(least(3, floor(avg(value) / 20)) AS BIGINT) AS c FROM obs WHERE value IS NOT NULL GROUP BY ALL)"


def regimes(spark, sf):
    return obs(spark, sf).filter(F.col("value").isNotNull()).groupBy(F.expr("sec div 3600").alias("h")).agg(F.least(F.lit(3), F.floor(F.avg("value") / 20)).cast("long").alias("c"))


@query(f"WITH {REG}, g AS (SELECT h % 24 AS hour, c, count(*) AS n FROM reg GROUP BY ALL) SELECT hour, c AS regime, n, round(n * 1.0 / sum(n) OVER (PARTITION BY hour), 4) + 0.0 AS share FROM g")
def regime_occupancy(spark, sf):
    """Share of each regime by hour."""
    g = regimes(spark, sf).groupBy((F.col("h") % 24).alias("hour"), F.col("c").alias("regime")).agg(F.count("*").alias("n"))
    return g.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("hour"))))


@query(f"WITH {REG} SELECT a.c AS before, b.c AS after, count(*) AS n FROM reg a JOIN reg b ON b.h = a.h + 1 GROUP BY ALL")
def transition_matrix(spark, sf):
    """Transitions between consecutive hours."""
    g = regimes(spark, sf)
    return g.select(F.col("c").alias("before"), (F.col("h") + 1).alias("h")).join(g.select("h", F.col("c").alias("after")), "h").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"WITH {REG}, i AS (SELECT h, c, h - row_number() OVER (PARTITION BY c ORDER BY h) AS island FROM reg), l AS (SELECT c, island, count(*) AS len FROM i GROUP BY ALL) SELECT c AS regime, len AS run_length, count(*) AS n FROM l GROUP BY ALL")
def run_lengths(spark, sf):
    """Lengths of stays in a regime."""
    i = regimes(spark, sf).withColumn("island", F.col("h") - F.row_number().over(Window.partitionBy("c").orderBy("h")))
    return i.groupBy("c", "island").agg(F.count("*").alias("run_length")).groupBy(F.col("c").alias("regime"), "run_length").agg(F.count("*").alias("n"))


@query(f"""WITH {DAILY}, x AS (SELECT station, CAST(floor(avg(CASE WHEN variable = 'view' THEN value END) / 10) AS BIGINT) AS a, CAST(floor(avg(CASE WHEN variable = 'click' THEN value END) / 10) AS BIGINT) AS b FROM daily GROUP BY station),
y AS (SELECT a, b FROM x WHERE a IS NOT NULL AND b IS NOT NULL), c AS (SELECT a, b, count(*) * 1.0 AS n FROM y GROUP BY ALL), ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM ra) AS i, (SELECT sum(n * (n - 1) / 2) FROM rb) AS j, (SELECT t FROM t) AS t, (SELECT sum(c.n / t.t * ln(c.n * t.t / (ra.n * rb.n))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT sum(-n / t.t * ln(n / t.t)) FROM ra, t) AS ha, (SELECT sum(-n / t.t * ln(n / t.t)) FROM rb, t) AS hb)
SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) + 0.0 AS ari, round(2 * mi / (ha + hb), 6) + 0.0 AS nmi FROM s""")
def rand_and_information(spark, sf):
    """Adjusted Rand index and normalised mutual information."""
    case = lambda v: F.floor(F.avg(F.when(F.col("variable") == v, F.col("value"))) / 10)
    x = daily(spark, sf).groupBy("station").agg(case("view").alias("a"), case("click").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return S.agreement(x, "a", "b").select(r("ari", 6).alias("ari"), r("nmi", 6).alias("nmi"))


TOP = f"{DAILY}, tm AS (SELECT variable, station, round(avg(value), 6) AS m FROM daily WHERE value IS NOT NULL GROUP BY ALL), tk AS (SELECT variable, station, row_number() OVER (PARTITION BY variable ORDER BY m DESC, station) AS k FROM tm), tops AS (SELECT variable, list(station) AS s FROM tk WHERE k <= 30 GROUP BY variable)"


def tops(spark, sf):
    g = daily(spark, sf).filter(F.col("value").isNotNull()).groupBy("variable", "station").agg(F.round(F.avg("value"), 6).alias("m"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("m"), "station"))).filter("k <= 30")


@query(f"WITH {TOP} SELECT x.variable AS a, y.variable AS b, round(len(list_intersect(x.s, y.s)) * 1.0 / len(list_distinct(list_concat(x.s, y.s))), 6) + 0.0 AS jaccard FROM tops x JOIN tops y ON x.variable < y.variable")
def topk_stability(spark, sf):
    """Jaccard of the top sets of two variables."""
    t = tops(spark, sf).groupBy("variable").agg(F.collect_set("station").alias("s"))
    x, y = t.select(F.col("variable").alias("a"), F.col("s").alias("sa")), t.select(F.col("variable").alias("b"), F.col("s").alias("sb"))
    j = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", r(j, 6).alias("jaccard"))


@query(f"WITH {TOP} SELECT station, count(*) AS times FROM tk WHERE k <= 30 GROUP BY station")
def station_importance(spark, sf):
    """How often a station is in the top set."""
    return tops(spark, sf).groupBy("station").agg(F.count("*").alias("times"))


@query(f"WITH {OBS} SELECT variable, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE value IS NOT NULL GROUP BY ALL")
def histogram(spark, sf):
    """Fixed-width histogram."""
    return obs(spark, sf).filter(F.col("value").isNotNull()).groupBy("variable", F.floor(F.col("value") / 25).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, {STATIONS}, m AS (SELECT variable, station, any_value(elev) AS elev, avg(value) AS m, count(value) AS n FROM obs JOIN stations USING (station) GROUP BY ALL HAVING count(value) >= 3) SELECT variable, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN regr_slope(m, elev) END, 7) + 0.0 AS slope, round(CASE WHEN count(*) >= 5 THEN regr_intercept(m, elev) END, 4) + 0.0 AS intercept FROM m GROUP BY variable")
def elevation_trend(spark, sf):
    """Linear trend of station means with elevation."""
    m = obs(spark, sf).join(stations(spark, sf), "station").groupBy("variable", "station", "elev").agg(F.avg("value").alias("m"), F.count("value").alias("n")).filter("n >= 3")
    x = F.col("elev").cast("double")
    enough = F.count("*") >= 5
    return m.groupBy("variable").agg(F.count("*").alias("n"), r(F.when(enough, F.regr_slope("m", x)), 7).alias("slope"), r(F.when(enough, F.regr_intercept("m", x))).alias("intercept"))


@query(f"WITH {OBS}, {STATIONS} SELECT (sec // 604800) AS period, {BAND} AS band, round(avg(value), 4) + 0.0 AS mean_value FROM obs JOIN stations USING (station) GROUP BY ALL")
def band_means(spark, sf):
    """Period means by elevation band."""
    return obs(spark, sf).join(stations(spark, sf), "station").groupBy(F.expr("sec div 604800").alias("period"), band().alias("band")).agg(r(F.avg("value")).alias("mean_value"))


@query(f"WITH {OBS} SELECT station, sec // 86400 AS day, round(sum(value), 4) + 0.0 AS total FROM obs WHERE variable = 'click' GROUP BY ALL")
def daily_sums(spark, sf):
    """Daily totals."""
    return obs(spark, sf).filter(F.col("variable") == "click").groupBy("station", F.expr("sec div 86400").alias("day")).agg(r(F.sum("value")).alias("total"))


@query(f"WITH {STATIONS}, {NEAR} SELECT count(*) AS n, round(quantile_cont(sqrt(d2), 0.5), 6) + 0.0 AS p50, round(quantile_cont(sqrt(d2), 0.9), 6) + 0.0 AS p90 FROM n WHERE k = 1")
def neighbour_distances(spark, sf):
    """Distribution of nearest-neighbour distances."""
    return nearest_k(stations(spark, sf), 1).agg(F.count("*").alias("n"), r(F.percentile(F.sqrt("d2"), 0.5), 6).alias("p50"), r(F.percentile(F.sqrt("d2"), 0.9), 6).alias("p90"))


@query(f"""WITH {OBS}, x AS (SELECT (sec - 25200) // 86400 AS d, ((sec - 25200) % 86400) // 14400 AS offs, avg(value) AS v FROM obs WHERE value IS NOT NULL GROUP BY ALL), f AS (SELECT d FROM x GROUP BY d HAVING count(*) = 6), b AS (SELECT d, v AS base FROM x WHERE offs = 0)
SELECT offs AS offset_h4, round(avg(v - base), 4) + 0.0 AS rel, count(*) AS n FROM x JOIN f USING (d) JOIN b USING (d) GROUP BY ALL""")
def diurnal_cycle(spark, sf):
    """Values relative to 07 UTC over complete windows."""
    s = F.col("sec") - 25200
    x = obs(spark, sf).filter(F.col("value").isNotNull()).withColumn("s", s).groupBy(F.expr("s div 86400").alias("d"), F.expr("(s % 86400) div 14400").alias("offset_h4")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("d")
    y = x.withColumn("k", F.count("*").over(w)).withColumn("base", F.max(F.when(F.col("offset_h4") == 0, F.col("v"))).over(w)).filter("k = 6")
    return y.groupBy("offset_h4").agg(r(F.avg(F.col("v") - F.col("base"))).alias("rel"), F.count("*").alias("n"))


@query(f"WITH {_GRID}, x AS (SELECT ix // 4 AS b_x, iy // 4 AS b_y, CAST(elev / 100 AS BIGINT) AS cls, count(*) AS n FROM grid GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY b_x, b_y ORDER BY n DESC, cls) AS k FROM x) SELECT b_x, b_y, cls, n FROM k WHERE k = 1".replace("CAST(elev / 100 AS BIGINT)", "CAST(floor(elev / 100) AS BIGINT)"))
def majority_resample(spark, sf):
    """Most frequent class of each block (the smaller on ties)."""
    read(spark, sf, "region")
    x = grid(spark).groupBy(F.expr("ix div 4").alias("b_x"), F.expr("iy div 4").alias("b_y"), F.floor(F.col("elev") / 100).alias("cls")).agg(F.count("*").alias("n"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("b_x", "b_y").orderBy(F.desc("n"), "cls"))).filter("k = 1").select("b_x", "b_y", "cls", "n")


HASH = "md5(station::VARCHAR || ':' || '42')"


@query(f"WITH {STATIONS}, h AS (SELECT station, {HASH} AS h FROM stations) SELECT station, row_number() OVER (ORDER BY h, station) <= ceil(0.15 * (SELECT count(*) FROM h)) AS held_out FROM h")
def holdout_stations(spark, sf):
    """A seeded share of stations is held out; the order is a hash's."""
    s = stations(spark, sf).select("station", F.md5(F.concat(F.col("station").cast("string"), F.lit(":42"))).alias("h"))
    total = s.count()  # stations are a dimension
    held = s.orderBy("h", "station").limit(-(-15 * total // 100)).select("station").withColumn("held", F.lit(True))
    return s.join(held, "station", "left").select("station", F.coalesce("held", F.lit(False)).alias("held_out"))


@query(f"WITH {STATIONS}, h AS (SELECT station, CAST(floor(lat / 0.5) AS BIGINT) AS a, CAST(floor(lon / 0.75) AS BIGINT) AS b, elev // 1000 AS e, {HASH} AS h FROM stations), k AS (SELECT *, row_number() OVER (PARTITION BY a, b, e ORDER BY h, station) AS k, count(*) OVER (PARTITION BY a, b, e) AS n FROM h) SELECT station, a, b, e FROM k WHERE k <= floor(n * 0.3)")
def stratified_sample(spark, sf):
    """Proportional allocation by place and elevation."""
    h = stations(spark, sf).select("station", F.floor(F.col("lat") / 0.5).alias("a"), F.floor(F.col("lon") / 0.75).alias("b"), F.expr("elev div 1000").alias("e"), F.md5(F.concat(F.col("station").cast("string"), F.lit(":42"))).alias("h"))
    k = h.withColumn("k", F.row_number().over(Window.partitionBy("a", "b", "e").orderBy("h", "station"))).withColumn("n", F.count("*").over(Window.partitionBy("a", "b", "e")))
    return k.filter(F.col("k") <= F.floor(F.col("n") * 0.3)).select("station", "a", "b", "e")


@query(f"WITH {STATIONS} SELECT station, (row_number() OVER (PARTITION BY provider ORDER BY {HASH}, station) - 1) % 5 AS fold FROM stations")
def station_folds(spark, sf):
    """Round-robin folds in hashed order within each provider."""
    h = F.md5(F.concat(F.col("station").cast("string"), F.lit(":42")))
    return stations(spark, sf).select("station", ((F.row_number().over(Window.partitionBy("provider").orderBy(h, "station")) - 1) % 5).alias("fold"))


@query(f"WITH {OBS}, d AS (SELECT DISTINCT sec // 86400 AS day FROM obs), k AS (SELECT day, row_number() OVER (ORDER BY md5(day::VARCHAR || ':7'), day) AS k FROM d) SELECT day, k <= 6 AS in_prefix FROM k WHERE k <= 16")
def early_stop_times(spark, sf):
    """A seeded set of days and a prefix of it."""
    d = obs(spark, sf).select(F.expr("sec div 86400").alias("day")).distinct()
    h = d.withColumn("h", F.md5(F.concat(F.col("day").cast("string"), F.lit(":7")))).orderBy("h", "day").limit(16)
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", "day"))  # sixteen rows
    return h.select("day", (k <= 6).alias("in_prefix"))


@query(f"WITH {OBS}, a AS (SELECT DISTINCT station FROM obs WHERE variable = 'view' AND value > 200), b AS (SELECT DISTINCT station FROM obs WHERE variable = 'click' AND value > 200) SELECT 'union' AS op, station FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', station FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', station FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(spark, sf):
    """Union, intersection and difference."""
    o = obs(spark, sf).filter(F.col("value") > 200)
    a, b = (o.filter(F.col("variable") == v).select("station").distinct() for v in ("view", "click"))
    tag = lambda n, d: d.select(F.lit(n).alias("op"), "station")
    return tag("union", a.union(b).distinct()).unionByName(tag("intersect", a.intersect(b))).unionByName(tag("except", a.exceptAll(b)))


@query(f"""WITH {DAILY}, {STATIONS}, t AS (SELECT d.station, d.day, d.value, s.station % 7 = 0 AS is_heldout, s.station % 7 = 1 AS is_tune_target, CASE WHEN day < 19739 THEN 'train' WHEN day < 19745 THEN 'tune' ELSE 'test' END AS split FROM daily d JOIN stations s USING (station) WHERE variable = 'view')
SELECT split, is_heldout, is_tune_target, count(*) AS n, count(CASE WHEN NOT is_heldout THEN 1 END) AS donors, count(CASE WHEN NOT is_heldout AND NOT is_tune_target THEN 1 END) AS tune_donors, count(CASE WHEN is_heldout AND split = 'test' THEN 1 END) AS scored, count(CASE WHEN NOT is_heldout AND split <> 'test' THEN 1 END) AS panel FROM t GROUP BY ALL""")
def protocol_tag(spark, sf):
    """Tags and masks of the locked protocol."""
    d = daily(spark, sf).filter(F.col("variable") == "view").join(stations(spark, sf).select("station"), "station")
    t = d.withColumn("is_heldout", F.col("station") % 7 == 0).withColumn("is_tune_target", F.col("station") % 7 == 1).withColumn("split", F.when(F.col("day") < 19739, "train").when(F.col("day") < 19745, "tune").otherwise("test"))
    n = lambda c: F.count(F.when(c, 1))
    held, tune, split = F.col("is_heldout"), F.col("is_tune_target"), F.col("split")
    return t.groupBy("split", "is_heldout", "is_tune_target").agg(F.count("*").alias("n"), n(~held).alias("donors"), n(~held & ~tune).alias("tune_donors"), n(held & (split == "test")).alias("scored"), n(~held & (split != "test")).alias("panel"))


@query(f"WITH {STATIONS} SELECT provider, sha256(string_agg(station::VARCHAR, ',' ORDER BY station)) AS stamp, count(*) AS n FROM stations GROUP BY provider")
def run_stamp(spark, sf):
    """A digest of each split's sorted members."""
    g = stations(spark, sf).groupBy("provider").agg(F.array_sort(F.collect_list("station")).alias("s"), F.count("*").alias("n"))
    return g.select("provider", F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256).alias("stamp"), "n")


@query(f"""WITH {PRED} SELECT 'neighbour' AS method, station, day, round(o, 4) + 0.0 AS observed, round(p, 4) + 0.0 AS predicted FROM pred
UNION ALL SELECT 'climate', station, day, round(o, 4) + 0.0 AS observed, round(avg(o) OVER (PARTITION BY station), 4) + 0.0 AS predicted FROM pred""")
def collect_predictions(spark, sf):
    """Predictions of several methods in one table, columns aligned by name."""
    p = predictions(spark, sf)
    a = p.select(F.lit("neighbour").alias("method"), "station", "day", r("o").alias("observed"), r("p").alias("predicted"))
    b = p.withColumn("mean", F.avg("o").over(Window.partitionBy("station"))).select("station", "day", r("mean").alias("predicted"), r("o").alias("observed"), F.lit("climate").alias("method"))
    return a.unionByName(b)


@query(f"WITH {OBS} SELECT variable, round(avg((value - m) / s), 6) + 0.0 AS z_mean, round(max((value - lo) / (hi - lo)), 6) + 0.0 AS scaled_max, round(sum(ln(1 + value) / ln(1 + hi)), 3) + 0.0 AS log_sum, round(max(1 / (1 + exp(-value / 100))), 6) + 0.0 AS sigmoid_max FROM (SELECT variable, value, avg(value) OVER v AS m, stddev_samp(value) OVER v AS s, min(value) OVER v AS lo, max(value) OVER v AS hi FROM obs WHERE value IS NOT NULL WINDOW v AS (PARTITION BY variable)) GROUP BY variable")
def scalers(spark, sf):
    """standard, range and logarithmic scaling from group statistics."""
    o = obs(spark, sf).filter(F.col("value").isNotNull())
    st = o.groupBy("variable").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = o.join(st, "variable")
    v = F.col("value")
    return x.groupBy("variable").agg(r(F.avg((v - F.col("m")) / F.col("s")), 6).alias("z_mean"), r(F.max((v - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("scaled_max"), r(F.sum(F.log1p(v) / F.log1p("hi")), 3).alias("log_sum"), r(F.max(1 / (1 + F.exp(-v / 100))), 6).alias("sigmoid_max"))


@query(f"WITH {STATIONS} SELECT station, {BAND} AS band, elev // 250 AS bin250, CASE WHEN station % 44 >= 11 THEN (station % 44) // 10 * 10 END AS level2, round(sin(radians(elev % 360)), 6) + 0.0 AS sin_aspect, round(cos(radians(elev % 360)), 6) + 0.0 AS cos_aspect FROM stations")
def station_classes(spark, sf):
    """elevation classes, two-digit land-cover codes and aspect components."""
    a = F.radians((F.col("elev") % 360).cast("double"))
    k = F.col("station") % 44
    return stations(spark, sf).select("station", band().alias("band"), F.expr("elev div 250").alias("bin250"), F.when(k >= 11, F.expr("(station % 44) div 10 * 10")).alias("level2"), r(F.sin(a), 6).alias("sin_aspect"), r(F.cos(a), 6).alias("cos_aspect"))

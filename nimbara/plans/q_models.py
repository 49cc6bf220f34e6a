"""Queries on interpolation, terrain, clustering and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from nimbara.operators import kernels as K
from nimbara.operators.scores import pearson
from nimbara.plans.base import DAILY, OBS, SLOTS, STATIONS, daily, obs, r, read, slots, stations
from nimbara.plans.q_aggregates import PRED, predictions
from nimbara.plans.q_joins import _GRID, grid
from nimbara.plans.registry import query

#: Daily view values with coordinates in kilometres.
FIELD = f"""{DAILY}, {STATIONS}, f AS (SELECT d.station, d.day, d.value, (s.lon - 9) * 76 AS x, (s.lat - 46) * 111 AS y, s.elev::DOUBLE AS z FROM daily d JOIN stations s USING (station) WHERE variable = 'view' AND value IS NOT NULL)"""


def field(spark, sf):
    s = stations(spark, sf).select("station", ((F.col("lon") - 9) * 76).alias("x"), ((F.col("lat") - 46) * 111).alias("y"), F.col("elev").cast("double").alias("z"))
    d = daily(spark, sf).filter((F.col("variable") == "view") & F.col("value").isNotNull()).select("station", "day", "value")
    return d.join(s, "station")


def neighbours(f, k: int):
    """k nearest other stations of the same day: station, day, value, z, other, u (its value), dxy, dz, rank."""
    return K.neighbours_by_time(f, "day", k)


_N = """n AS (SELECT a.station, a.day, a.value, a.z, b.station AS other, b.value AS u, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dxy, abs(a.z - b.z) / 1000 AS dz, row_number() OVER (PARTITION BY a.day, a.station ORDER BY round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6), b.station) AS rank FROM f a JOIN f b ON a.day = b.day AND a.station <> b.station)"""


def idw_weight(fz: float, p: float):
    """Horizontal and vertical inverse-distance weights; a zero vertical distance has weight 0."""
    return (1 - fz) * F.pow(F.greatest("dxy", F.lit(1e-6)), -p) + fz * F.when(F.col("dz") > 0, F.pow("dz", F.lit(-p))).otherwise(0.0)


def _w(fz: float, p: float) -> str:
    return f"({1 - fz} * pow(greatest(dxy, 1e-6), {-p}) + {fz} * CASE WHEN dz > 0 THEN pow(dz, {-p}) ELSE 0 END)"


@query(f"WITH {FIELD}, {_N} SELECT station, day, round(any_value(value), 4) + 0.0 AS observed, round(sum({_w(0.2, 2.0)} * u) / sum({_w(0.2, 2.0)}), 4) + 0.0 AS predicted FROM n WHERE rank <= 8 GROUP BY ALL")
def idw_loo(spark, sf):
    """Leave-one-out inverse-distance weighting in place and elevation."""
    n = neighbours(field(spark, sf), 8).withColumn("w", idw_weight(0.2, 2.0))
    return n.groupBy("station", "day").agg(r(F.max("value")).alias("observed"), r(F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("predicted"))


@query(f"""WITH {FIELD}, {_N}, g AS (SELECT station, day, sum({_w(0.2, 2.0)} * CASE WHEN u > 20 THEN 1.0 ELSE 0.0 END) / sum({_w(0.2, 2.0)}) AS p_wet, sum(CASE WHEN u > 20 THEN {_w(0.2, 2.0)} * u END) / sum(CASE WHEN u > 20 THEN {_w(0.2, 2.0)} END) AS amount FROM n WHERE rank <= 8 GROUP BY ALL)
SELECT station, day, round(p_wet, 4) + 0.0 AS p_wet, round(CASE WHEN p_wet >= 0.5 THEN amount ELSE 0 END, 4) + 0.0 AS predicted FROM g""")
def idw_two_step(spark, sf):
    """Occurrence gate, then the amount from wet neighbours only."""
    n = neighbours(field(spark, sf), 8).withColumn("w", idw_weight(0.2, 2.0)).withColumn("wet", F.col("u") > 20)
    wet = F.when(F.col("wet"), F.col("w"))
    g = n.groupBy("station", "day").agg((F.sum(F.col("w") * F.col("wet").cast("double")) / F.sum("w")).alias("p"), (F.sum(wet * F.col("u")) / F.sum(wet)).alias("a"))
    return g.select("station", "day", r("p").alias("p_wet"), r(F.when(F.col("p") >= 0.5, F.col("a")).otherwise(0.0)).alias("predicted"))


def combination_scores(spark, sf):
    """day, power, fz, k, rmse (leave-one-out) of every combination: sums of all of them in one aggregation of the neighbours."""
    n = neighbours(field(spark, sf), 8)
    sums = []
    for i, (p, fz, k) in enumerate(COMBOS):
        w = F.when(F.col("rank") <= k, idw_weight(fz, p))
        sums += [(F.sum(w * F.col("u")) / F.sum(w)).alias(f"_{i}")]
    e = n.groupBy("day", "station").agg(F.max("value").alias("o"), *sums)
    scores = e.groupBy("day").agg(*[F.round(F.sqrt(F.avg(F.pow(F.col(f"_{i}") - F.col("o"), 2.0))), 6).alias(f"_{i}") for i in range(len(COMBOS))])
    each = [F.struct(F.lit(p).alias("power"), F.lit(fz).alias("fz"), F.lit(k).cast("long").alias("k"), F.col(f"_{i}").alias("rmse")) for i, (p, fz, k) in enumerate(COMBOS)]
    return scores.select("day", F.explode(F.array(*each)).alias("c")).select("day", "c.*")


COMBOS = [(p, fz, k) for p in (1.0, 2.0, 3.0) for fz in (0.0, 0.3) for k in (4, 8)]
_COMBOS = ", ".join(f"({p}::DOUBLE, {fz}::DOUBLE, {k})" for p, fz, k in COMBOS)


@query(f"""WITH {FIELD}, {_N}, c(p, fz, k) AS (VALUES {_COMBOS}), e AS (SELECT day, p, fz, k, station, any_value(value) AS o, sum(((1 - fz) * pow(greatest(dxy, 1e-6), -p) + fz * CASE WHEN dz > 0 THEN pow(dz, -p) ELSE 0 END) * u) / sum((1 - fz) * pow(greatest(dxy, 1e-6), -p) + fz * CASE WHEN dz > 0 THEN pow(dz, -p) ELSE 0 END) AS pr FROM n JOIN c ON rank <= k GROUP BY ALL),
s AS (SELECT day, p, fz, k, round(sqrt(avg(pow(pr - o, 2))), 6) AS rmse FROM e GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rmse, p, fz, k) AS place FROM s) SELECT day, p AS power, fz, k::BIGINT AS k, rmse + 0.0 AS rmse FROM b WHERE place = 1""")
def idw_search(spark, sf):
    """Every parameter combination on every time, and the best of each time."""
    place = F.row_number().over(Window.partitionBy("day").orderBy("rmse", "power", "fz", "k"))
    s = combination_scores(spark, sf).withColumn("place", place).filter("place = 1")
    return s.select("day", "power", "fz", "k", (F.col("rmse") + 0.0).alias("rmse"))


#: Of the search: days of the prefix, how much worse than the best a combination may be there, and days of one mode that end it.
PREFIX, WORSE, STABLE = 5, 1.2, 4


@query(f"""WITH {FIELD}, {_N}, c(p, fz, k) AS (VALUES {_COMBOS}),
e AS (SELECT day, p, fz, k, station, any_value(value) AS o, sum(((1 - fz) * pow(greatest(dxy, 1e-6), -p) + fz * CASE WHEN dz > 0 THEN pow(dz, -p) ELSE 0 END) * u) / sum((1 - fz) * pow(greatest(dxy, 1e-6), -p) + fz * CASE WHEN dz > 0 THEN pow(dz, -p) ELSE 0 END) AS pr FROM n JOIN c ON rank <= k GROUP BY ALL),
s AS (SELECT day, p, fz, k, round(sqrt(avg(pow(pr - o, 2))), 6) AS rmse FROM e GROUP BY ALL),
t AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM s)),
x AS (SELECT p, fz, k, round(avg(rmse), 6) AS m FROM s JOIN t USING (day) WHERE i <= {PREFIX} GROUP BY ALL),
g AS (SELECT * FROM x WHERE m <= {WORSE} * (SELECT min(m) FROM x)),
b AS (SELECT i, s.p, s.fz, s.k, row_number() OVER (PARTITION BY i ORDER BY rmse, s.p, s.fz, s.k) AS place FROM s JOIN g USING (p, fz, k) JOIN t USING (day)),
w AS (SELECT i, p, fz, k FROM b WHERE place = 1),
r AS (SELECT t.i, w.p, w.fz, w.k, count(*) AS wins FROM t JOIN w ON w.i <= t.i GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY wins DESC, p, fz, k) AS place FROM r) WHERE place = 1),
q AS (SELECT a.i FROM m a JOIN m b ON b.i > a.i - {STABLE} AND b.i <= a.i AND b.p = a.p AND b.fz = a.fz AND b.k = a.k GROUP BY a.i HAVING count(*) = {STABLE}),
z AS (SELECT coalesce((SELECT min(i) FROM q), (SELECT max(i) FROM t)) AS last)
SELECT any_value(last) AS times, (SELECT count(*) FROM g) AS combinations, quantile_cont(p, 0.5) AS power, quantile_cont(fz, 0.5) AS fz, quantile_cont(k, 0.5)::DOUBLE AS k FROM w, z WHERE i <= last""")
def idw_protocol(spark, sf):
    """The whole search: prefix filter, per-time winners until their mode is stable, median of the winners."""
    return K.search_protocol(combination_scores(spark, sf), "day", ["power", "fz", "k"], PREFIX, WORSE, STABLE)


@query(f"WITH {FIELD}, {_N} SELECT station, day, round(sum((0.7 * pow(greatest(dxy, 1e-3), -2.0) + 0.3 * pow(greatest(dz, 1e-3), -2.0)) * u) / sum(0.7 * pow(greatest(dxy, 1e-3), -2.0) + 0.3 * pow(greatest(dz, 1e-3), -2.0)), 4) + 0.0 AS predicted FROM n WHERE rank <= 8 GROUP BY ALL")
def idw_squared(spark, sf):
    """Squared weights with a floored vertical distance."""
    w = 0.7 * F.pow(F.greatest("dxy", F.lit(1e-3)), -2.0) + 0.3 * F.pow(F.greatest("dz", F.lit(1e-3)), -2.0)
    return neighbours(field(spark, sf), 8).withColumn("w", w).groupBy("station", "day").agg(r(F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("predicted"))


@query(f"WITH {FIELD}, {_N}, m AS (SELECT day, avg(value) AS m FROM f GROUP BY day) SELECT station, n.day, round(sum(pow(greatest(dxy, 0.001), -2.0) * u) / sum(pow(greatest(dxy, 0.001), -2.0)), 4) + 0.0 AS plain, round(any_value(m), 4) + 0.0 AS mean_baseline FROM n JOIN m USING (day) WHERE rank <= 12 GROUP BY ALL")
def baselines(spark, sf):
    """Plain weighting of twelve neighbours, and the mean."""
    f = field(spark, sf)
    m = f.groupBy("day").agg(F.avg("value").alias("m"))
    n = neighbours(f, 12).withColumn("w", F.pow(F.greatest("dxy", F.lit(0.001)), -2.0)).join(m, "day")
    return n.groupBy("station", "day").agg(r(F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("plain"), r(F.max("m")).alias("mean_baseline"))


@query(f"WITH {FIELD}, p AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, 0.5 * pow(a.value - b.value, 2) AS g FROM f a JOIN f b ON a.day = b.day AND a.station < b.station), q AS (SELECT quantile_cont(d, 0.75) AS top FROM p) SELECT CAST(floor(d / (top / 12)) AS BIGINT) AS bin, count(*) AS n, round(avg(d), 4) + 0.0 AS lag, round(avg(g), 4) + 0.0 AS semivariance FROM p, q WHERE d < top GROUP BY 1 HAVING count(*) >= 5")
def empirical_variogram(spark, sf):
    """Binned semivariances up to the third quartile of distances.

    Stations of one place have the same distances: their pairs follow from
    counts, sums and squares of each place and day, and quantile and bins work
    on pairs of places with their number of pairs of stations.
    """
    f = field(spark, sf)
    v = F.col("value") - F.col("mean")  # only differences count; small numbers keep their digits
    f = f.join(f.groupBy("day").agg(F.avg("value").alias("mean")), "day").groupBy("day", "x", "y").agg(F.count("*").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    g = f.select("day", *[F.col(c).alias(f"{c}2") for c in ("x", "y", "k", "s", "q")])
    p = f.join(g, "day").filter((F.col("x") < F.col("x2")) | (F.col("x") == F.col("x2")) & (F.col("y") <= F.col("y2")))
    same = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    pairs = F.when(same, F.expr("k * (k - 1) div 2")).otherwise(F.col("k") * F.col("k2"))
    half = F.when(same, F.col("k") * F.col("q") - F.col("s") * F.col("s")).otherwise(F.col("k2") * F.col("q") + F.col("k") * F.col("q2") - 2 * F.col("s") * F.col("s2")) / 2
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2.0) + F.pow(F.col("y") - F.col("y2"), 2.0))
    p = p.select(d.alias("d"), pairs.alias("pairs"), half.alias("g")).filter("pairs > 0").groupBy("d").agg(F.sum("pairs").alias("pairs"), F.sum("g").alias("g"))
    q = p.agg(F.percentile("d", 0.75, F.col("pairs")).alias("top"))
    b = p.join(q).filter(F.col("d") < F.col("top")).groupBy(F.floor(F.col("d") / (F.col("top") / 12)).alias("bin"))
    n = F.sum("pairs")
    return b.agg(n.alias("n"), r(F.sum(F.col("d") * F.col("pairs")) / n).alias("lag"), r(F.sum("g") / n).alias("semivariance")).filter("n >= 5")


@query(f"""WITH {FIELD}, {_N}, i AS (SELECT station, day, any_value(value) AS o, avg(u) AS m, any_value(value) - sum({_w(0.0, 2.0)} * u) / sum({_w(0.0, 2.0)}) AS e FROM n WHERE rank <= 8 GROUP BY ALL),
j AS (SELECT n.station, n.day, avg(i.e) AS em FROM n JOIN i ON i.station = n.other AND i.day = n.day WHERE rank <= 8 GROUP BY ALL)
SELECT i.day, count(*) AS n, round(corr(o, m), 5) + 0.0 AS autocorrelation, round(corr(e, em), 5) + 0.0 AS residual_autocorrelation FROM i LEFT JOIN j ON j.station = i.station AND j.day = i.day GROUP BY i.day""")
def spatial_autocorrelation(spark, sf):
    """Values, and residuals of inverse-distance weighting, against the mean of eight neighbours."""
    n = neighbours(field(spark, sf), 8).withColumn("w", idw_weight(0.0, 2.0))
    i = n.groupBy("station", "day").agg(F.max("value").alias("o"), F.avg("u").alias("m"), (F.max("value") - F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("e"))
    j = n.select("station", "day", "other").join(i.select(F.col("station").alias("other"), "day", "e"), ["other", "day"]).groupBy("station", "day").agg(F.avg("e").alias("em"))
    x = i.join(j, ["station", "day"], "left")
    return x.groupBy("day").agg(F.count("*").alias("n"), r(pearson(F.col("o"), F.col("m")), 5).alias("autocorrelation"), r(pearson(F.col("e"), F.col("em")), 5).alias("residual_autocorrelation"))


#: Trend of the kriging: place, elevation, their products, and land cover against the first class.
TREND = ["x", "y", "z", "xz", "yz", "cover1", "cover2"]


def _trend(f):
    z = F.col("z") / 1000
    cover = [(F.col("station") % 3 == i).cast("double").alias(f"cover{i}") for i in (1, 2)]
    return f.select("*", (F.col("x") * z).alias("xz"), (F.col("y") * z).alias("yz"), *cover)


@query()
def kriging_loo(spark, sf):
    """Leave-one-out regression kriging of each day."""
    return K.regression_kriging(_trend(field(spark, sf)), "day", "value", TREND).withColumn("predicted", r("predicted"))


@query()
def kriging_two_step(spark, sf):
    """Occurrence and amount kriged apart in each of two regions; amounts only where occurrence is likely."""
    f = _trend(field(spark, sf)).withColumn("wet", (F.col("value") > 20).cast("double")).withColumn("amount", F.log1p(F.greatest("value", F.lit(0.0))))
    f = f.withColumn("part", F.col("day") * 2 + (F.col("x") > 114).cast("long"))
    trend = ["x", "y", "z"]
    p = K.regression_kriging(f, "part", "wet", trend).select("part", "station", F.col("predicted").alias("p"))
    a = K.regression_kriging(f, "part", "amount", trend).select("part", "station", "observed", F.col("predicted").alias("a"))
    x = p.join(a, ["part", "station"])
    gated = F.when(F.col("p") >= 0.5, F.greatest(F.expm1("a"), F.lit(0.0))).when(F.col("p").isNotNull(), 0.0)
    return x.select(F.expr("part div 2").alias("day"), "station", r(F.expm1("observed")).alias("observed"), r("p").alias("p_wet"), r(gated).alias("predicted"))


def _surface(spark, sf, elevation: bool):
    def fit(g):
        extra = g[["z"]].to_numpy() / 1000 if elevation else None
        return K.surface(g["x"].to_numpy(), g["y"].to_numpy(), g["value"].to_numpy(), extra)[0]

    return K.per_time(field(spark, sf), "day", fit).withColumn("fitted", r("fitted"))


@query()
def bilinear_surface(spark, sf):
    """Penalised bilinear surfaces with a linear elevation term."""
    return _surface(spark, sf, True)


@query()
def bilinear_plain(spark, sf):
    """Penalised bilinear surfaces of place alone."""
    return _surface(spark, sf, False)


@query()
def profile_and_residuals(spark, sf):
    """Robust piecewise elevation profiles of regions, shrunk to that of all, plus weighted residuals of other stations."""
    def fit(g):
        z, v = g["z"].to_numpy(), g["value"].to_numpy()
        base = K.shrunk_profile(z, v, np.digitize(g["x"].to_numpy(), [76.0, 152.0]))
        return base + K.others_mean(g[["x", "y"]].to_numpy(), v - base, 20.0)

    return K.per_time(field(spark, sf), "day", fit).withColumn("fitted", r("fitted"))


@query()
def additive_splines(spark, sf):
    """Penalised additive splines of place and elevation."""
    def fit(g):
        return K.additive([g[c].to_numpy() for c in ("x", "y", "z")], g["value"].to_numpy())

    return K.per_time(field(spark, sf), "day", fit).withColumn("fitted", r("fitted"))


@query()
def additive_two_step(spark, sf):
    """Logistic additive gate, additive amounts with a cap and simpler models where wet stations are few."""
    def fit(g):
        return K.gated_amounts([g[c].to_numpy() for c in ("x", "y", "z")], g["value"].to_numpy(), 20.0)

    return K.per_time(field(spark, sf), "day", fit).withColumn("fitted", r("fitted"))


def neighbour_features(spark, sf, k: int = 5):
    """label, neighbours' values and distances, their squared-distance mean, and place, elevation, season and wet share."""
    n = neighbours(field(spark, sf), k).withColumn("w", F.pow(F.greatest("dxy", F.lit(0.001)), -2.0))
    g = n.groupBy("station", "day").agg(
        F.max("value").alias("label"), F.max("z").alias("z"), (F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("idw2"),
        F.avg((F.col("u") > 20).cast("double")).alias("wet"), *[F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, k + 1) for c in ("u", "dxy")])
    s = stations(spark, sf).select("station", "lat", "lon")
    turn = 2 * np.pi * F.col("day") / 365.25
    return g.join(s, "station").withColumn("sin", F.sin(turn)).withColumn("cos", F.cos(turn)).na.drop()


def _left_out(g, labels: str, model, folds: int = 3):
    """Predictions of every station by a model of the other folds' stations."""
    from pyspark.ml.feature import VectorAssembler

    cols = [c for c in g.columns if c not in ("station", "day", "label", "occurs")]
    v = VectorAssembler(inputCols=cols, outputCol="features").transform(g)
    fold = F.pmod(F.xxhash64("station"), F.lit(folds))
    out = None
    for i in range(folds):
        m = model(labelCol=labels).fit(v.filter(fold != i))
        p = m.transform(v.filter(fold == i)).select("station", "day", "label", F.col("prediction").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


@query()
def forest_neighbours(spark, sf):
    """Random forest on neighbours and covariates; every station is predicted by a model that has not seen it."""
    from functools import partial

    from pyspark.ml.regression import RandomForestRegressor

    p = _left_out(neighbour_features(spark, sf), "label", partial(RandomForestRegressor, numTrees=20, maxDepth=6, seed=42))
    return p.select("station", "day", r("label").alias("observed"), r("p").alias("predicted"))


@query()
def forest_two_step(spark, sf):
    """Occurrence by one forest, the amount of wet times by another."""
    from functools import partial

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    g = neighbour_features(spark, sf).withColumn("occurs", (F.col("label") > 20).cast("double"))
    wet = _left_out(g, "occurs", partial(RandomForestClassifier, numTrees=15, maxDepth=5, seed=42))
    dry_free = g.withColumn("label", F.log1p(F.greatest("label", F.lit(0.0))))
    amount = _left_out(dry_free, "label", partial(RandomForestRegressor, numTrees=15, maxDepth=5, seed=42)).select("station", "day", F.expm1("p").alias("a"))
    x = wet.join(amount, ["station", "day"])
    return x.select("station", "day", r("label").alias("observed"), r(F.when(F.col("p") > 0, F.col("a")).otherwise(0.0)).alias("predicted"))


@query()
def graph_messages(spark, sf):
    """Two rounds of mean messages over the neighbour graph, and a linear read-out of the residual."""
    f = field(spark, sf)
    edges = neighbours(f, 6).select("station", "day", "other", F.exp(-F.col("dxy") / 20).alias("w"))
    base = neighbours(f, 8).withColumn("w", idw_weight(0.2, 2.0)).groupBy("station", "day").agg(F.max("value").alias("value"), (F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("base"))
    h = base.withColumn("h0", F.col("value") - F.col("base"))
    for i in (0, 1):
        sent = h.select(F.col("station").alias("other"), "day", F.col(f"h{i}").alias("m"))
        got = edges.join(sent, ["other", "day"]).groupBy("station", "day").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias(f"h{i + 1}"))
        h = h.join(got, ["station", "day"], "left")
    fit = h.filter(F.col("station") % 7 != 0).agg(F.regr_slope("h0", "h2").alias("a"), F.regr_intercept("h0", "h2").alias("b"))
    p = h.join(fit)
    return p.select("station", "day", r("value").alias("observed"), r(F.col("base") + F.coalesce(F.col("a") * F.col("h2") + F.col("b"), F.lit(0.0))).alias("predicted"))


@query()
def snow_water_equivalent(spark, sf):
    """Water equivalent of daily depths by a layer model."""
    d = daily(spark, sf).filter(F.col("variable") == "view").select("station", "day", (F.col("value") / 100).alias("depth"))
    return K.swe_series(d, "station", "day").select("station", "day", r("depth").alias("depth"), r("swe").alias("swe"), r("density").alias("density"))


@query(f"""WITH {SLOTS}, p AS (SELECT station, slot, value, sum(value) OVER (PARTITION BY station ORDER BY slot RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS p6 FROM slots), e AS (SELECT b.station, b.slot, b.value - a.value AS hn, b.p6 FROM p a JOIN p b ON a.station = b.station AND b.slot = a.slot + 12)
SELECT station, slot, round(least(60, greatest(2, 10 * hn / p6)), 4) + 0.0 AS slr FROM e WHERE hn >= 2 AND p6 >= 1""")
def slr_events(spark, sf):
    """Ratio of six-hour rise and six-hour sum, clipped."""
    w = Window.partitionBy("station").orderBy("slot").rangeBetween(-11, 0)
    p = slots(spark, sf).withColumn("p6", F.sum("value").over(w))
    a = p.select("station", (F.col("slot") + 12).alias("slot"), F.col("value").alias("before"))
    e = p.join(a, ["station", "slot"]).withColumn("hn", F.col("value") - F.col("before")).filter("hn >= 2 AND p6 >= 1")
    return e.select("station", "slot", r(F.least(F.lit(60.0), F.greatest(F.lit(2.0), 10 * F.col("hn") / F.col("p6")))).alias("slr"))


@query(f"""WITH {FIELD}, {_N}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY z, station) AS up, row_number() OVER (PARTITION BY day ORDER BY z DESC, station DESC) AS down, count(*) OVER (PARTITION BY day) AS n FROM f),
m AS (SELECT station, day, any_value(value) AS o, avg(u) AS m FROM n WHERE rank <= 5 GROUP BY ALL), a AS (SELECT day, corr(o, m) AS autocorr FROM m GROUP BY day)
SELECT k.day, count(*) AS n_stations, round(avg(value), 4) + 0.0 AS mean_value, round(stddev_pop(value), 4) + 0.0 AS std, round(corr(value, z), 5) + 0.0 AS elev_corr,
round(corr(value, cos(radians((station * 41) % 360))), 5) + 0.0 AS aspect_corr, round(any_value(autocorr), 5) + 0.0 AS autocorr,
round(avg(CASE WHEN down <= n // 5 THEN value END) - avg(CASE WHEN up <= n // 5 THEN value END), 4) + 0.0 AS elev_gradient,
round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS wet_fraction, round(stddev_pop(value) / avg(value), 4) + 0.0 AS cv FROM k JOIN a ON a.day = k.day GROUP BY k.day""")
def regime_features(spark, sf):
    """Features of each time's field; north-facing is the cosine of the aspect, autocorrelation uses five neighbours."""
    w = Window.partitionBy("day")
    f = field(spark, sf)
    k = f.withColumn("up", F.row_number().over(w.orderBy("z", "station"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("z"), F.desc("station")))).withColumn("n", F.count("*").over(w))
    fifth, north = F.expr("n div 5"), F.cos(F.radians(F.col("station") * 41 % 360))
    out = k.groupBy("day").agg(
        F.count("*").alias("n_stations"), r(F.avg("value")).alias("mean_value"), r(F.stddev_pop("value")).alias("std"),
        r(pearson(F.col("value"), F.col("z")), 5).alias("elev_corr"), r(pearson(F.col("value"), north), 5).alias("aspect_corr"),
        r(F.avg(F.when(F.col("down") <= fifth, F.col("value"))) - F.avg(F.when(F.col("up") <= fifth, F.col("value")))).alias("elev_gradient"),
        r(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0))).alias("wet_fraction"), r(F.stddev_pop("value") / F.avg("value")).alias("cv"))
    near = neighbours(f, 5).groupBy("day", "station").agg(F.max("value").alias("o"), F.avg("u").alias("m"))
    return out.join(near.groupBy("day").agg(r(pearson(F.col("o"), F.col("m")), 5).alias("autocorr")), "day")


#: Weight of the cyclic features against the others, and share of variance that the components keep.
CYCLIC, VARIANCE = 0.4, 0.95


def regime_model(f, k: int = 4):
    """A model fitted on features of times: impute, drop constants, standardise, project to VARIANCE, cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, ElementwiseProduct, Imputer, StandardScaler, VectorAssembler

    cols = ["mean_value", "std", "elev_corr", "aspect_corr", "autocorr", "elev_gradient", "wet_fraction", "cv", "sin", "cos"]
    spread = f.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    cols = [c for c in cols if spread[c] is None or spread[c] > 1e-9]
    weight = [CYCLIC if c in ("sin", "cos") else 1.0 for c in cols]
    stages = [
        Imputer(inputCols=cols, outputCols=[f"{c}_i" for c in cols], strategy="median"), VectorAssembler(inputCols=[f"{c}_i" for c in cols], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="even", withMean=True), ElementwiseProduct(scalingVec=weight, inputCol="even", outputCol="scaled")]
    ready = Pipeline(stages=stages).fit(f)
    share = np.cumsum(PCA(k=len(cols), inputCol="scaled", outputCol="all").fit(ready.transform(f)).explainedVariance.toArray())
    keep = min(len(cols), int(np.searchsorted(share, VARIANCE)) + 1)
    return Pipeline(stages=[*stages, PCA(k=keep, inputCol="scaled", outputCol="features"), KMeans(k=k, seed=42, predictionCol="cluster_id")]).fit(f)


def timed_features(spark, sf):
    turn = 2 * np.pi * F.col("day") / 365.25
    return regime_features(spark, sf).withColumn("sin", F.sin(turn)).withColumn("cos", F.cos(turn))


@query()
def kmeans_regimes(spark, sf):
    """Regimes of times; a model fitted on some applies to all."""
    f = timed_features(spark, sf)
    return regime_model(f.filter(F.col("day") % 4 != 0)).transform(f).select("day", "cluster_id")


@query()
def mixture_regimes(spark, sf):
    """The mixture of least BIC."""
    import math

    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    f = regime_features(spark, sf).na.fill(0.0)
    pre = Pipeline(stages=[VectorAssembler(inputCols=["mean_value", "std"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    v = pre.fit(f).transform(f).select("day", "features")
    n = v.count()  # times are a dimension
    fits = [(m := GaussianMixture(k=k, seed=42, maxIter=40).fit(v), (k * 6 - 1) * math.log(n) - 2 * m.summary.logLikelihood) for k in (2, 3)]
    best = min(fits, key=lambda x: x[1])[0]
    return best.transform(v).select("day", F.col("prediction").alias("cluster_id"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), d AS (SELECT e.vec_id, e.label, sqrt(sum(pow(v - m, 2))) AS d FROM e JOIN c USING (label, i) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 6), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM d)
SELECT label, vec_id, round(d, 5) + 0.0 AS dist, n AS cluster_size FROM k WHERE k <= 3""")
def medoids(spark, sf):
    """Three members nearest to each cluster's mean."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("v").alias("m"))
    d = e.join(c, ["label", "i"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("m"), 2.0))).alias("d"))
    k = d.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.round("d", 6), "vec_id"))).withColumn("cluster_size", F.count("*").over(Window.partitionBy("label")))
    return k.filter("k <= 3").select("label", "vec_id", r("d", 5).alias("dist"), "cluster_size")


@query()
def performance_clusters(spark, sf):
    """Stations clustered by score; the number of clusters by the elbow."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    s = predictions(spark, sf).groupBy("station").agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("o"), 2.0))).alias("rmse"), F.avg(F.col("p") - F.col("o")).alias("me"))
    v = VectorAssembler(inputCols=["rmse", "me"], outputCol="features").transform(s)
    fits = [KMeans(k=k, seed=42).fit(v) for k in range(2, 6)]
    cost = [m.summary.trainingCost for m in fits]
    drop = [b - a for a, b in zip(cost, cost[1:])]
    best = fits[min(len(fits) - 1, drop.index(min(drop)) + 1)]
    return best.transform(v).select("station", F.col("prediction").alias("cluster_id"))


def forecast_rows(spark, sf):
    d = daily(spark, sf).groupBy("station", "day").agg(F.avg("value").alias("value")).filter("value IS NOT NULL")
    w = Window.partitionBy("station").orderBy("day")
    return d.select("station", "day", "value", *[F.lag("value", k).over(w).alias(f"lag{k}") for k in (1, 2, 3)], F.avg("value").over(w.rowsBetween(-3, -1)).alias("mean3"), F.lead("value").over(w).alias("label")).na.drop()


#: Columns the forecasts see.
LAGS = ["value", "lag1", "lag2", "lag3", "mean3"]


@query()
def boosted_forecast(spark, sf):
    """One boosted model a station; each of three folds is predicted from the rows before it."""
    return K.station_forecasts(forecast_rows(spark, sf), "day", LAGS, "label", 3).withColumn("predicted", r("predicted")).withColumn("observed", r("observed"))


@query()
def forest_forecast(spark, sf):
    """Random forest on lags; the last fifth of the days is predicted."""
    m, later = _forest(spark, sf)
    return m.transform(later).select("station", "day", r("label").alias("observed"), r("prediction").alias("predicted"))


@query()
def forest_importance(spark, sf):
    """Share of every lag in the forest's splits."""
    m, _ = _forest(spark, sf)
    return spark.createDataFrame([(c, float(x)) for c, x in zip(LAGS, m.featureImportances.toArray())], "feature string, importance double")


def _forest(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    v = VectorAssembler(inputCols=LAGS, outputCol="features").transform(forecast_rows(spark, sf))
    first, last = v.agg(F.min("day"), F.max("day")).first()
    cut = first + (last - first) * 4 // 5
    return RandomForestRegressor(numTrees=15, maxDepth=5, seed=42).fit(v.filter(F.col("day") < cut)), v.filter(F.col("day") >= cut)


#: Neighbours of a grid cell within a square window, by an equi-join on shifted keys.
def window_cells(g, half: int):
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-half, half + 1) for b in range(-half, half + 1)])).alias("s")
    near = g.select("ix", "iy", shift).select("ix", "iy", F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"), (F.col("ix") + F.col("s.dx")).alias("jx"), (F.col("iy") + F.col("s.dy")).alias("jy"))
    return near.join(g.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("elev").alias("e")), ["jx", "jy"])


@query(f"""WITH {_GRID} SELECT a.ix, a.iy, round(any_value(a.elev) - avg(b.elev), 4) + 0.0 AS tpi, round(min(b.elev), 4) + 0.0 AS valley_floor, round(sqrt(avg(pow(b.elev - a.elev, 2))), 4) + 0.0 AS tri,
CASE WHEN any_value(a.elev) - avg(b.elev) > 150 THEN 'ridge' WHEN any_value(a.elev) - avg(b.elev) < -150 THEN 'valley' ELSE 'slope' END AS landform FROM grid a JOIN grid b ON b.ix BETWEEN a.ix - 2 AND a.ix + 2 AND b.iy BETWEEN a.iy - 2 AND a.iy + 2 GROUP BY a.ix, a.iy""")
def terrain_windows(spark, sf):
    """Window mean, position index, ruggedness and landform."""
    read(spark, sf, "region")
    g = grid(spark)
    w = window_cells(g, 2).join(g, ["ix", "iy"]).groupBy("ix", "iy").agg(F.max("elev").alias("z"), F.avg("e").alias("m"), F.min("e").alias("floor"), F.sqrt(F.avg(F.pow(F.col("e") - F.col("elev"), 2.0))).alias("tri"))
    tpi = F.col("z") - F.col("m")
    return w.select("ix", "iy", r(tpi).alias("tpi"), r("floor").alias("valley_floor"), r("tri").alias("tri"), F.when(tpi > 150, "ridge").when(tpi < -150, "valley").otherwise("slope").alias("landform"))


@query(f"""WITH {_GRID}, d AS (SELECT *, lag(elev) OVER x AS w, lead(elev) OVER x AS e, lag(elev) OVER y AS s, lead(elev) OVER y AS n FROM grid WINDOW x AS (PARTITION BY iy ORDER BY ix), y AS (PARTITION BY ix ORDER BY iy))
SELECT ix, iy, round(degrees(atan(sqrt(pow((e - w) / 2000, 2) + pow((n - s) / 2000, 2)))), 5) + 0.0 AS slope, round((degrees(atan2(e - w, n - s)) + 360) % 360, 4) + 0.0 AS aspect, round(-2 * ((w + e) / 2 - elev + (n + s) / 2 - elev) / 1000000 * 100, 6) + 0.0 AS curvature FROM d WHERE w IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND n IS NOT NULL""")
def slope_aspect(spark, sf):
    """Slope, aspect and curvature from neighbouring rows and columns."""
    read(spark, sf, "region")
    x, y = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    d = grid(spark).select("*", F.lag("elev").over(x).alias("w"), F.lead("elev").over(x).alias("e"), F.lag("elev").over(y).alias("s"), F.lead("elev").over(y).alias("n")).na.drop()
    gx, gy = (F.col("e") - F.col("w")), (F.col("n") - F.col("s"))
    slope = F.degrees(F.atan(F.sqrt(F.pow(gx / 2000, 2.0) + F.pow(gy / 2000, 2.0))))
    curve = -2 * ((F.col("w") + F.col("e")) / 2 - F.col("elev") + (F.col("n") + F.col("s")) / 2 - F.col("elev")) / 1000000 * 100
    return d.select("ix", "iy", r(slope, 5).alias("slope"), r((F.degrees(F.atan2(gx, gy)) + 360) % 360).alias("aspect"), r(curve, 6).alias("curvature"))


#: Segments x1, y1, x2, y2 of a coast and of a ridge, in cells.
COAST = [(-1.0, -4.0, 12.0, -2.0), (12.0, -2.0, 31.0, -5.0)]
RIDGE = [(0.0, 8.0, 10.0, 12.0), (10.0, 12.0, 22.0, 9.0), (22.0, 9.0, 30.0, 14.0)]
_LINES = ", ".join(f"('{n}', {i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, lines in (("coast", COAST), ("ridge", RIDGE)) for i, (a, b, c, d) in enumerate(lines))


@query(f"""WITH {_GRID}, l(line, i, x1, y1, x2, y2) AS (VALUES {_LINES}),
t AS (SELECT ix, iy, line, i, x1, y1, x2, y2, greatest(0.0, least(1.0, ((ix - x1) * (x2 - x1) + (iy - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM grid, l),
d AS (SELECT ix, iy, line, i, round(sqrt(pow(ix - (x1 + t * (x2 - x1)), 2) + pow(iy - (y1 + t * (y2 - y1)), 2)), 6) AS d, sign((x2 - x1) * (iy - y1) - (y2 - y1) * (ix - x1)) AS side FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy, line ORDER BY d, i) AS k FROM d)
SELECT ix, iy, max(CASE WHEN line = 'coast' THEN d END) + 0.0 AS coast, max(CASE WHEN line = 'ridge' THEN d END) + 0.0 AS ridge, max(CASE WHEN line = 'ridge' THEN side END)::DOUBLE AS ridge_side FROM k WHERE k = 1 GROUP BY ix, iy""")
def line_distances(spark, sf):
    """Distances to coast and ridge, and on which side of the ridge a cell lies."""
    from nimbara.operators.joins import segment_distance

    read(spark, sf, "region")
    x, y = F.col("ix").cast("double"), F.col("iy").cast("double")

    def nearest(lines):
        each = []
        for i, (x1, y1, x2, y2) in enumerate(lines):
            side = F.signum(F.lit(x2 - x1) * (y - y1) - F.lit(y2 - y1) * (x - x1))
            each.append(F.struct(F.round(segment_distance(x, y, *map(F.lit, (x1, y1, x2, y2))), 6).alias("d"), F.lit(i).alias("i"), side.alias("side")))
        return F.array_min(F.array(*each))

    g = grid(spark).select("ix", "iy", nearest(COAST).alias("c"), nearest(RIDGE).alias("r"))
    return g.select("ix", "iy", (F.col("c.d") + 0.0).alias("coast"), (F.col("r.d") + 0.0).alias("ridge"), F.col("r.side").alias("ridge_side"))


@query()
def drainage_basins(spark, sf):
    """Sinks filled, cells labelled by their outlet, and cells to the nearest divide; one tile a task."""
    import pandas as pd

    read(spark, sf, "region")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        z = g.pivot(index="iy", columns="ix", values="elev").to_numpy()
        f = K.fill_sinks(z)
        b = K.basins(f)
        iy, ix = np.meshgrid(np.sort(g["iy"].unique()), np.sort(g["ix"].unique()), indexing="ij")
        return pd.DataFrame({"ix": ix.ravel(), "iy": iy.ravel(), "filled": f.ravel(), "basin": b.ravel(), "divide": K.divide_distance(b).ravel()})

    return grid(spark).withColumn("tile", F.lit(0)).groupBy("tile").applyInPandas(run, "ix long, iy long, filled double, basin long, divide long")


@query()
def ward_groups(spark, sf):
    """Ward clusters of the class centroids."""
    import pandas as pd

    c = field(spark, sf).groupBy((F.col("station") % 30).alias("grp")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("grp")
        return pd.DataFrame({"grp": g["grp"].to_numpy(), "cluster_id": K.ward(g[["x", "y"]].to_numpy(), 5)})

    return c.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "grp long, cluster_id long")


@query()
def synthetic_recovery(spark, sf):
    """A seeded panel; held-out stations predicted from the others, and the leak count."""
    read(spark, sf, "region")
    p = spark.createDataFrame(K.synthetic_panel())
    a = p.filter("is_heldout AND split = 'test'").select("station", "t", "x", "y", "temp")
    b = p.filter("NOT is_heldout").select(F.col("station").alias("other"), "t", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("temp").alias("u"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2.0) + F.pow(F.col("y") - F.col("y2"), 2.0))
    n = a.join(b, "t").withColumn("d", d).withColumn("k", F.row_number().over(Window.partitionBy("t", "station").orderBy("d"))).filter("k <= 8")
    w = 1 / F.pow(F.greatest("d", F.lit(1.0)), 2.0)
    pred = n.groupBy("station", "t").agg(F.max("temp").alias("o"), (F.sum(w * F.col("u")) / F.sum(w)).alias("p"), F.sum((F.col("station") == F.col("other")).cast("int")).alias("leak"))
    return pred.agg(F.count("*").alias("n"), r(F.sqrt(F.avg(F.pow(F.col("p") - F.col("o"), 2.0)))).alias("rmse"), F.sum("leak").alias("leaks"))


@query(f"WITH {PRED} SELECT station % 7 = 0 AS held, count(*) AS n, count(CASE WHEN o > 50 THEN 1 END) AS wet_observed, count(CASE WHEN p > 50 THEN 1 END) AS wet_predicted, round(corr(o, p), 5) + 0.0 AS r FROM pred GROUP BY ALL")
def gate_diagnostic(spark, sf):
    """Occurrence counts of predictions against observations."""
    n = lambda c: F.count(F.when(F.col(c) > 50, 1))
    return predictions(spark, sf).groupBy((F.col("station") % 7 == 0).alias("held")).agg(F.count("*").alias("n"), n("o").alias("wet_observed"), n("p").alias("wet_predicted"), r(pearson(F.col("o"), F.col("p")), 5).alias("r"))


@query(f"""WITH RECURSIVE {OBS}, o AS (SELECT station, sec, event_id, value, row_number() OVER (PARTITION BY station ORDER BY sec, event_id) AS i FROM obs WHERE value IS NOT NULL),
s AS (SELECT station, i, event_id, sec, value, sec AS t0, value AS v0, true AS ok FROM o WHERE i = 1
UNION ALL SELECT o.station, o.i, o.event_id, o.sec, o.value,
  CASE WHEN o.sec = t0 OR abs(o.value - v0) / (o.sec - t0) <= 0.01 THEN o.sec ELSE t0 END, CASE WHEN o.sec = t0 OR abs(o.value - v0) / (o.sec - t0) <= 0.01 THEN o.value ELSE v0 END,
  o.sec = t0 OR abs(o.value - v0) / (o.sec - t0) <= 0.01 FROM s JOIN o ON o.station = s.station AND o.i = s.i + 1)
SELECT station, sec, event_id, value FROM s WHERE ok""")
def rate_filtered(spark, sf):
    """Q11: rows reachable at a bounded rate from the last accepted row."""
    o = obs(spark, sf).select("station", "sec", "event_id", "value")
    return K.rate_filter(o, "station", "sec", 0.01)


@query(f"""WITH RECURSIVE {STATIONS}, a AS (SELECT station, CAST(floor(lat) AS BIGINT) AS region, lat, lon FROM stations), m AS (SELECT region, 111320.0 * cos(radians(avg(lat))) AS scale FROM a GROUP BY region),
o AS (SELECT station, region, lon * scale AS x, lat * 111320.0 AS y, row_number() OVER (PARTITION BY region ORDER BY station) AS i FROM a JOIN m USING (region)),
s AS (SELECT region, i, station, station AS seed, [{{'s': station, 'x': x, 'y': y}}] AS seeds FROM o WHERE i = 1
UNION ALL SELECT region, i, station, coalesce(found.s, station), CASE WHEN found IS NULL THEN list_append(seeds, {{'s': station, 'x': x, 'y': y}}) ELSE seeds END
FROM (SELECT o.region, o.i, o.station, o.x, o.y, seeds, list_filter(seeds, lambda q: sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)) <= 6000.0)[1] AS found FROM s JOIN o ON o.region = s.region AND o.i = s.i + 1))
SELECT station, seed, region FROM s""")
def greedy_stations(spark, sf):
    """Stations merged into the first seed within a radius, by region."""
    s = stations(spark, sf).select("station", "lat", "lon", F.floor("lat").cast("long").alias("region"))
    return K.greedy_clusters(s, "region", 6000.0)


@query()
def silhouette_regimes(spark, sf):
    """The number of regimes by silhouette."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    f = timed_features(spark, sf)
    fits = [regime_model(f, k).transform(f) for k in (2, 3, 4, 5)]
    score = ClusteringEvaluator(predictionCol="cluster_id", featuresCol="features")
    return max(fits, key=score.evaluate).select("day", "cluster_id")


@query()
def map_regimes(spark, sf):
    """Regimes on a self-organising map of the times (a small table)."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day")
        x = g[["mean_value", "std", "wet_fraction"]].fillna(0).to_numpy(float)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
        return pd.DataFrame({"day": g["day"].to_numpy(), "cluster_id": K.self_organising_map(x)})

    f = regime_features(spark, sf).select("day", "mean_value", "std", "wet_fraction").withColumn("one", F.lit(0))
    return f.groupBy("one").applyInPandas(run, "day long, cluster_id long")


@query()
def forecast_cross_validation(spark, sf):
    """Expanding-window validation; each fold trains on the days before it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=LAGS, outputCol="features").transform(forecast_rows(spark, sf))
    first, last = v.agg(F.min("day"), F.max("day")).first()
    edges = [first + (last + 1 - first) * i // 6 for i in range(3, 7)]
    folds = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        m = LinearRegression(regParam=0.1).fit(v.filter(F.col("day") < a))
        p = m.transform(v.filter((F.col("day") >= a) & (F.col("day") < b))).select(F.lit(i).alias("fold"), F.pow(F.col("prediction") - F.col("label"), 2.0).alias("se"))
        folds = p if folds is None else folds.unionByName(p)
    return folds.groupBy("fold").agg(F.count("*").alias("n"), r(F.sqrt(F.avg("se"))).alias("rmse"))


@query(f"""WITH {DAILY}, {STATIONS}, w AS (SELECT station, day, round(value, 6) AS value, lag(day) OVER x AS pd, lag(round(value, 6)) OVER x AS pv FROM daily WHERE variable = 'view' AND value IS NOT NULL WINDOW x AS (PARTITION BY station ORDER BY day)),
p AS (SELECT day, corr(value, pv) AS persistence, count(*) AS n FROM w WHERE day - pd = 1 GROUP BY day HAVING count(*) >= 5), c AS (SELECT a.day, corr(a.value, b.value) AS companion FROM daily a JOIN daily b ON a.station = b.station AND a.day = b.day AND b.variable = 'error' WHERE a.variable = 'view' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.day HAVING count(*) >= 5)
SELECT day, n, round(persistence, 5) + 0.0 AS persistence, round(companion, 5) + 0.0 AS companion FROM p LEFT JOIN c USING (day)""")
def regime_persistence(spark, sf):
    """Correlation with the day before and with a companion variable."""
    d = daily(spark, sf).filter(F.col("value").isNotNull())
    v = d.filter(F.col("variable") == "view").select("station", "day", "value")
    w = Window.partitionBy("station").orderBy("day")
    lagged = v.select("day", F.round("value", 6).alias("value"), F.lag("day").over(w).alias("pd"), F.lag(F.round("value", 6)).over(w).alias("pv"))
    p = lagged.filter(F.col("day") - F.col("pd") == 1).groupBy("day").agg(pearson(F.col("value"), F.col("pv")).alias("persistence"), F.count("*").alias("n")).filter("n >= 5")
    e = d.filter(F.col("variable") == "error").select("station", "day", F.col("value").alias("e"))
    c = v.join(e, ["station", "day"]).groupBy("day").agg(pearson(F.col("value"), F.col("e")).alias("companion"), F.count("*").alias("k")).filter("k >= 5")
    return p.join(c, "day", "left").select("day", "n", r("persistence", 5).alias("persistence"), r("companion", 5).alias("companion"))

"""Spatial, temporal and similarity joins.

Radius, as-of and nearest-neighbour joins use bucket keys, so Spark plans
equi-joins; every result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return EARTH_KM * 2 * F.asin(F.sqrt(a))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, mid: Column) -> Column:
    """Metres on a local plane at latitude ``mid``."""
    x, y = (lon2 - lon1) * 111320.0 * F.cos(F.radians(mid)), (lat2 - lat1) * 111320.0
    return F.sqrt(x * x + y * y)


def _cells(df: DataFrame, size: float, wide: float, spread: bool) -> DataFrame:
    row, col = F.floor(F.col("lat") / size), F.floor(F.col("lon") / wide)
    if not spread:
        return df.withColumn("_r", row).withColumn("_c", col)
    near = lambda c: F.explode(F.array(c - 1, c, c + 1))
    return df.withColumn("_r", near(row)).withColumn("_c", near(col))


def within_km(left: DataFrame, right: DataFrame, km: float, top: float | None = None) -> DataFrame:
    """Pairs of stations at most ``km`` apart: station, other, km.  top: largest absolute latitude of the tables (None: looked up)."""
    if top is None:
        top = left.select("lat").unionByName(right.select("lat")).agg(F.max(F.abs("lat"))).first()[0] or 0.0
    size = km / KM_PER_DEGREE * 1.01
    wide = size / max(math.cos(math.radians(top)), 1e-3)
    a = _cells(left.select("station", "lat", "lon"), size, wide, False)
    b = _cells(right.select(F.col("station").alias("other"), "lat", "lon"), size, wide, True).withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    d = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["_r", "_c"]).withColumn("km", d).filter(F.col("km") <= km).select("station", "other", "km")


#: Finest cell of the nearest-neighbour grid, and the number of doublings above it.
CELL, DOUBLINGS = 0.01, 16


def nearest_k(stations: DataFrame, k: int, x: str = "lat", y: str = "lon", scale: float = 1.0, extra: str | None = None) -> DataFrame:
    """The ``k`` nearest other stations in a plane (optionally with ``extra`` times ``scale`` as a third axis): station, other, d2, rank.

    Cells double in size from level to level.  A station looks at the finest
    level whose own cell holds more than ``k`` stations: its ``k`` nearest then
    lie within that cell's diagonal, so within two cells on each side.  The last
    level is one cell for all.  Candidates come from an equi-join on cells.
    """
    axes = [F.col(x), F.col(y)] + ([F.col(extra) * scale] if extra else [])
    n = len(axes)
    point = stations.select("station", *[a.cast("double").alias(f"_a{i}") for i, a in enumerate(axes)])
    level = F.explode(F.sequence(F.lit(0), F.lit(DOUBLINGS))).alias("_l")
    cell = lambda i: F.when(F.col("_l") < DOUBLINGS, F.floor(F.col(f"_a{i}") / (CELL * F.pow(F.lit(2.0), F.col("_l"))))).otherwise(0).cast("long")
    cells = point.select("*", level).select("*", *[cell(i).alias(f"_c{i}") for i in range(n)])
    keys = ["_l", *[f"_c{i}" for i in range(n)]]
    full = cells.groupBy(*keys).agg(F.count("*").alias("_n")).filter((F.col("_n") > k) | (F.col("_l") == DOUBLINGS)).drop("_n")
    own = cells.join(full, keys).groupBy("station").agg(F.min_by(F.struct(*keys, *[f"_a{i}" for i in range(n)]), "_l").alias("o"))
    near = own.select("station", *[F.col(f"o._a{i}").alias(f"_b{i}") for i in range(n)], F.col("o._l").alias("_l"), *[F.col(f"o._c{i}").alias(f"_c{i}") for i in range(n)])
    for i in range(n):
        near = near.withColumn(f"_c{i}", F.explode(F.sequence(F.col(f"_c{i}") - 2, F.col(f"_c{i}") + 2)))
    d = F.pow(F.col("_a0") - F.col("_b0"), 2.0)
    for i in range(1, n):
        d = d + F.pow(F.col(f"_a{i}") - F.col(f"_b{i}"), 2.0)
    met = near.join(cells.withColumnRenamed("station", "other"), keys).filter(F.col("station") != F.col("other"))
    w = Window.partitionBy("station").orderBy("d2", "other")
    ranked = met.withColumn("d2", F.round(d, 6)).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("station", "other", "d2", "rank")


def nearest_name(places: DataFrame, targets: DataFrame, mid: float) -> DataFrame:
    """lat, lon, m and name of the nearest target (lat2, lon2, name; the smallest name of equally far ones) of every place, on the plane of latitude ``mid``.

    m: metres to three digits.  As in ``nearest_k``, a place looks at the finest
    level whose own cell holds a target, two cells on each side.
    """
    size = 100.0  # metres of the finest cell
    wide = math.cos(math.radians(mid))
    level = F.explode(F.sequence(F.lit(0), F.lit(DOUBLINGS))).alias("_l")
    cell = lambda c: F.when(F.col("_l") < DOUBLINGS, F.floor(c * 111320.0 / (size * F.pow(F.lit(2.0), F.col("_l"))))).otherwise(0).cast("long")
    axes = lambda lat, lon: [cell(F.col(lat)).alias("_r"), cell(F.col(lon) * wide).alias("_c")]
    a = places.select("*", level).select("*", *axes("lat", "lon"))
    b = targets.select("*", level).select("*", *axes("lat2", "lon2"))
    keys = ["_l", "_r", "_c"]
    own = a.join(b.select(*keys).distinct(), keys).groupBy("lat", "lon").agg(F.min(F.struct(*keys)).alias("o")).select("lat", "lon", "o.*")
    for c in ("_r", "_c"):
        own = own.withColumn(c, F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
    m = F.round(equirectangular_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), F.lit(mid)), 3)
    return own.join(b, keys).groupBy("lat", "lon").agg(F.min(F.struct(m.alias("m"), "name")).alias("o")).select("lat", "lon", "o.*")


def companions(stations: DataFrame, km: float, elevation: float) -> DataFrame:
    """Nearest other station within ``km`` (111 km a degree) and ``elevation`` metres."""
    size = km / 111.0
    a = _cells(stations, size, size, False)
    b = _cells(stations.select(F.col("station").alias("other"), "lat", "lon", F.col("elev").alias("elev2")), size, size, True).withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    d = F.round(F.sqrt(F.pow((F.col("lat") - F.col("lat2")) * 111, 2.0) + F.pow((F.col("lon") - F.col("lon2")) * 111, 2.0)), 6)
    p = a.join(b, ["_r", "_c"]).withColumn("km", d).filter((F.col("station") != F.col("other")) & (F.abs(F.col("elev") - F.col("elev2")) <= elevation) & (F.col("km") <= km))
    w = Window.partitionBy("station").orderBy("km", "other")
    return p.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("station", "other", (F.col("km") + 0.0).alias("km"))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, sec: str, tolerance: int) -> DataFrame:
    """Each left row with the nearest right row of the same key within ``tolerance`` seconds (the earlier on ties).

    Equal left rows are matched once and come back as often as they were.
    """
    b = right.select(key, F.col(sec).alias("_rs"), F.col("value").alias("right_value"), F.explode(F.array(*[F.floor(F.col(sec) / tolerance) + i for i in (-1, 0, 1)])).alias("_b"))
    a = left.groupBy(*left.columns).agg(F.count("*").alias("_copies")).withColumn("_b", F.floor(F.col(sec) / tolerance))
    near = F.abs(F.col("_rs") - F.col(sec))
    joined = a.join(b, [key, "_b"], "left").withColumn("_d", F.when(near <= tolerance, near))
    best = F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "_rs", "right_value")))
    out = joined.groupBy(*left.columns, "_copies").agg(best.alias("_m")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select(*left.columns, F.col("_m._rs").alias("right_sec"), F.col("_m.right_value").alias("right_value"))


def ray_cast(points: DataFrame, edges: DataFrame, x: str, y: str) -> DataFrame:
    """Points with ``inside``: the number of polygon edges crossed by a ray to the right is odd.  edges: x1, y1, x2, y2 (a small table)."""
    cross = ((F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))) & (
        F.col(x) < (F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    n = points.join(edges, cross, "left").groupBy(*points.columns).agg(F.count("x1").alias("_n"))
    return n.select(*points.columns, (F.col("_n") % 2 == 1).alias("inside"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / len2))).otherwise(0.0)
    return F.sqrt(F.pow(px - (x1 + t * dx), 2.0) + F.pow(py - (y1 + t * dy), 2.0))

"""The supplied tables seen as station data, for Spark and as SQL.

events: station = user_id, variable = event_type; one value in eleven is missing.
Station attributes are integer arithmetic on the station number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = 1800  #: seconds of a grid slot


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("station"), sec.alias("sec"), F.col("event_type").alias("variable"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), "event_id")


OBS = """obs AS (SELECT user_id AS station, epoch_us(ts) // 1000000 AS sec, event_type AS variable,
CASE WHEN event_id % 11 <> 0 THEN value END AS value, event_id FROM events)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each station and 30-minute slot; the slot is missing if all its values are."""
    return obs(spark, sf_dir).groupBy("station", F.expr(f"sec div {SLOT}").alias("slot")).agg(F.avg("value").alias("value"))


SLOTS = OBS + f""", slots AS (SELECT station, sec // {SLOT} AS slot, avg(value) AS value FROM obs GROUP BY ALL)"""


def station_columns(s: Column) -> list[Column]:
    return [
        (46.0 + (s * 37 % 100) / 50.0).alias("lat"), (9.0 + (s * 53 % 150) / 50.0).alias("lon"), (s * 97 % 3000).alias("elev"),
        F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta")]), (s % 4 + 1).cast("int")).alias("provider")]


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").select(F.col("user_id").alias("station")).distinct()
    return s.select("station", *station_columns(F.col("station")))


STATIONS = """stations AS (SELECT DISTINCT user_id AS station, CAST(46.0 + ((user_id * 37) % 100) / 50.0 AS DOUBLE) AS lat,
CAST(9.0 + ((user_id * 53) % 150) / 50.0 AS DOUBLE) AS lon, (user_id * 97) % 3000 AS elev,
['alpha', 'beta', 'gamma', 'delta'][(user_id % 4) + 1] AS provider FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean and sum of each station and variable; day is days since 1970."""
    return obs(spark, sf_dir).groupBy("station", "variable", F.expr("sec div 86400").alias("day")).agg(
        F.avg("value").alias("value"), F.sum("value").alias("total"), F.count("*").alias("n"))


DAILY = OBS + """, daily AS (SELECT station, variable, sec // 86400 AS day, avg(value) AS value, sum(value) AS total, count(*) AS n FROM obs GROUP BY ALL)"""


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded, halves upwards despite noise in the last bits, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 10.0 ** -(digits + 3), digits) + F.lit(0.0)


def day_string(day: str | Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col(day) if isinstance(day, str) else day).cast("int")), "yyyy-MM-dd")

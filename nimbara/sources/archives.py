"""Zipped product files, fixed station lists, and rows of irregular times."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbara.sources.providers import number

#: Lines of a batch that leaves a Python worker.
LINES = 50_000


def zipped_lines(files: DataFrame, pattern: str = "produkt_*.txt", encoding: str = "latin-1") -> DataFrame:
    """file, n, line of the members of zip archives (path, content) that match ``pattern``; members are read line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(name: str, n: list[int], text: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(n, pa.int32()), pa.array(text, pa.string())], names=["file", "n", "line"])

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not fnmatch.fnmatch(member.rpartition("/")[2], pattern):
                            continue
                        n, text = [], []
                        with z.open(member) as f:
                            for i, line in enumerate(io.TextIOWrapper(f, encoding)):
                                n.append(i)
                                text.append(line.rstrip("\r\n"))
                                if len(n) == LINES:
                                    yield full(f"{path}:{member}", n, text)
                                    n, text = [], []
                        if n:
                            yield full(f"{path}:{member}", n, text)

    return files.select("path", "content").mapInArrow(run, "file string, n int, line string")


def product_rows(lines: DataFrame, column: str, fmt: str, first: str, last: str, time: str = "MESS_DATUM") -> DataFrame:
    """station (five digits), local_time and value of semicolon files (file, n, line) within [first, last]; the first row of a station's time stays."""
    head = lines.filter("n = 0").select("file", F.transform(F.split("line", ";"), lambda x: F.trim(x)).alias("h"))
    rows = lines.filter("n > 0").join(head, "file").withColumn("c", F.transform(F.split("line", ";"), lambda x: F.trim(x)))
    cell = lambda name: F.get("c", F.nullif(F.array_position("h", name), F.lit(0)).cast("int") - 1)
    out = rows.select("file", "n", F.lpad(cell("STATIONS_ID"), 5, "0").alias("station"), F.try_to_timestamp(cell(time), F.lit(fmt)).alias("local_time"), number(cell(column)).alias("value"))
    out = out.filter(F.col("local_time").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
    return out.groupBy("station", "local_time").agg(F.min_by("value", F.struct("file", "n")).alias("value"))


def station_list(lines: DataFrame) -> DataFrame:
    """station, first_day, last_day, height, lat, lon, name, region of a list whose columns are set with blanks; headers and rules go."""
    x = F.regexp_replace(F.trim("line"), r"\s+", " ")
    part = lambda i: F.regexp_extract(x, r"^(\d+) (\d{8}) (\d{8}) (-?[\d.]+) (-?[\d.]+) (-?[\d.]+) (.+) (\S+)$", i)
    out = lines.filter(part(1) != "").select(
        F.lpad(part(1), 5, "0").alias("station"), F.to_date(part(2), "yyyyMMdd").alias("first_day"), F.to_date(part(3), "yyyyMMdd").alias("last_day"),
        part(4).cast("double").alias("height"), part(5).cast("double").alias("lat"), part(6).cast("double").alias("lon"), part(7).alias("name"), part(8).alias("region"))
    return out.filter((F.col("lat") > 20) & (F.col("lat") < 90))


def utc_seconds(local: Column, zone: Column) -> Column:
    """Seconds of a wall-clock time (string) in a zone; null where the clock skips or repeats it."""
    wall = local.cast("timestamp_ntz")
    at = F.convert_timezone(zone, F.lit("UTC"), wall)
    back = F.convert_timezone(F.lit("UTC"), zone, at) == wall
    once = lambda hours: F.convert_timezone(F.lit("UTC"), zone, at + F.expr(f"INTERVAL '{hours}' HOUR")) != wall
    seconds = F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp"))
    return F.when(back & once(1) & once(-1), seconds)


def half_hours(rows: DataFrame, means: list[str], rate: str) -> DataFrame:
    """station, slot (of 30 minutes), means of ``means`` and ``amount`` of irregular rows (station, sec, ...).

    An amount is the rate an hour times the hours since the row before, one at
    most; a station's first row takes its median interval, or five minutes.
    """
    w = Window.partitionBy("station").orderBy("sec")
    gap = (F.col("sec") - F.lag("sec").over(w)) / 3600.0
    timed = rows.filter(F.col("sec").isNotNull()).withColumn("_gap", gap)
    usual = timed.groupBy("station").agg(F.percentile("_gap", 0.5).alias("_m")).withColumn("_m", F.when(F.col("_m") > 0, F.col("_m")).otherwise(5 / 60))
    hours = F.least(F.coalesce("_gap", "_m"), F.lit(1.0))
    slots = timed.join(usual, "station").withColumn("_a", F.col(rate) * hours).groupBy("station", F.floor(F.col("sec") / 1800).alias("slot"))
    return slots.agg(*[F.avg(c).alias(c) for c in means], F.sum("_a").alias("amount"))


def native_json(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """station, variable, time, value of arrays of records (station, payload): the first key present, the first row of a time."""
    rows = df.select("station", F.posexplode(F.from_json("payload", "array<map<string,string>>")).alias("n", "r"))
    get = lambda names: F.coalesce(*[number(F.try_element_at("r", F.lit(n))) for n in names])
    time = F.coalesce(*[F.nullif(F.try_element_at("r", F.lit(c)), F.lit("")) for c in ("observation_time_utc", "observation_time_local")])
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), get(names).alias("value")) for v, names in fields.items()])
    flat = rows.select("station", "n", time.alias("time"), F.explode(cells).alias("c")).select("station", "n", "time", "c.*").filter("time IS NOT NULL AND value IS NOT NULL")
    return flat.groupBy("station", "variable", "time").agg(F.min_by("value", "n").alias("value"))

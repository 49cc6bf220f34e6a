"""Readers of the station networks' record layouts.

Every parser takes a DataFrame with a string column ``payload`` (one document a
row) and gives station, name, lat, lon, height, local_time, value.  ``PARSERS``
maps a network folder to its parser; ``parse`` dispatches a mixed table.
Unreadable numbers and times are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = ["station", "name", "lat", "lon", "height", "local_time", "value"]


def number(c: Column) -> Column:
    """A number with a decimal comma or point; markers for missing values are null; NaN is null."""
    v = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(v), v)


def _time(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def _rows(df: DataFrame, schema: str, items: str) -> DataFrame:
    return df.withColumn("j", F.from_json("payload", schema)).withColumn("d", F.explode_outer(f"j.{items}"))


def _out(df: DataFrame, name: str, lat: str, lon: str, height: str, time: Column, value: Column) -> DataFrame:
    n = F.col(name).cast("string")
    return df.select(n.alias("station"), n.alias("name"), number(F.col(lat)).alias("lat"), number(F.col(lon)).alias("lon"), number(F.col(height)).alias("height"), time.alias("local_time"), value.alias("value"))


def dwd(df: DataFrame) -> DataFrame:
    """metadata and datapoints; the value is the first field that is not the time."""
    d = _rows(df, "metadata struct<name:string,hoehe:string,breite:string,laenge:string>, datapoints array<map<string,string>>", "datapoints")
    key = F.filter(F.map_keys("d"), lambda k: k != "timestamp")[0]
    return _out(d, "j.metadata.name", "j.metadata.breite", "j.metadata.laenge", "j.metadata.hoehe", _time(F.col("d")["timestamp"], "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"), number(F.try_element_at("d", key)))


KEYS = ("tl", "ff", "hs", "rf", "rr", "sh")


def zamg(df: DataFrame) -> DataFrame:
    """Parallel arrays; the first parameter that is present."""
    p = ",".join(f"{k}:struct<data:array<string>>" for k in KEYS)
    schema = f"timestamps array<string>, features array<struct<properties:struct<parameters:struct<{p}>>,geometry:struct<coordinates:array<double>>>>, station_metadata struct<name:string,altitude:string>"
    j = df.withColumn("j", F.from_json("payload", schema)).withColumn("f", F.col("j.features")[0])
    data = F.coalesce(*[F.col(f"f.properties.parameters.{k}.data") for k in KEYS])
    d = j.withColumn("d", F.explode_outer(F.arrays_zip(F.col("j.timestamps").alias("t"), data.alias("v")))).withColumn("lon", F.col("f.geometry.coordinates")[0]).withColumn("lat", F.col("f.geometry.coordinates")[1])
    return _out(d, "j.station_metadata.name", "lat", "lon", "j.station_metadata.altitude", _time(F.substring(F.col("d.t"), 1, 16), "yyyy-MM-dd'T'HH:mm"), number(F.col("d.v")))


def meteoswiss(df: DataFrame) -> DataFrame:
    d = _rows(df, "name string, hoehe string, lat string, lon string, data array<struct<time:string,value:string>>", "data")
    return _out(d, "j.name", "j.lat", "j.lon", "j.hoehe", _time(F.col("d.time"), "dd.MM.yyyy HH:mm"), number(F.col("d.value")))


def slf(df: DataFrame) -> DataFrame:
    d = _rows(df, "name string, code string, hoehe string, lat string, lon string, data array<struct<timestamp:string,value:string>>", "data")
    return _out(d, "j.name", "j.lat", "j.lon", "j.hoehe", _time(F.substring(F.col("d.timestamp"), 1, 19), "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"), number(F.col("d.value")))


def flat(df: DataFrame) -> DataFrame:
    """Name, longitude, latitude, height and timestamp/value rows, shared by several networks."""
    d = _rows(df, "name string, code string, hoehe string, longitude string, latitude string, data array<struct<timestamp:string,value:string>>", "data")
    return _out(d, "j.name", "j.latitude", "j.longitude", "j.hoehe", _time(F.col("d.timestamp"), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm"), number(F.col("d.value")))


def hydro(df: DataFrame) -> DataFrame:
    """Times under ``timestamp`` or ``time``, with or without seconds."""
    d = _rows(df, "name string, hoehe string, lat string, lon string, data array<struct<timestamp:string,time:string,value:string>>", "data")
    return _out(d, "j.name", "j.lat", "j.lon", "j.hoehe", _time(F.coalesce("d.timestamp", "d.time"), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm:ss"), number(F.col("d.value")))


def suedtirol(df: DataFrame) -> DataFrame:
    """Times with a trailing zone name."""
    d = _rows(df, "name string, hoehe string, latitude string, longitude string, data array<struct<DATE:string,VALUE:string>>", "data")
    return _out(d, "j.name", "j.latitude", "j.longitude", "j.hoehe", _time(F.regexp_replace("d.DATE", r"(CES?T)$", ""), "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"), number(F.col("d.VALUE")))


def meteofrance(df: DataFrame) -> DataFrame:
    d = _rows(df, "station_metadata struct<name:string,altitude:string,lat:string,lon:string>, data array<struct<time:string,value:string>>", "data")
    return _out(d, "j.station_metadata.name", "j.station_metadata.lat", "j.station_metadata.lon", "j.station_metadata.altitude", _time(F.col("d.time"), "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMddHH", "yyyyMMdd"), number(F.col("d.value")))


PARSERS = {"dwd": dwd, "zamg": zamg, "meteoswiss": meteoswiss, "slf": slf, "lwd": flat, "arso": flat, "meteohub": flat, "meteonetwork": flat, "hydro": hydro, "suedtirol": suedtirol, "meteofrance": meteofrance}


def parse(df: DataFrame) -> DataFrame:
    """Dispatch rows (network, payload) to their parsers; unknown networks give no rows."""
    return reduce(DataFrame.unionByName, [f(df.filter(F.col("network") == k)).withColumn("network", F.lit(k)) for k, f in PARSERS.items()])


def read_folder(spark, path: str) -> DataFrame:
    """network (folder name) and payload of every JSON file below ``path``/<network>/, deduplicated by name and digest."""
    files = spark.read.text(f"{path}/*/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    return dedupe_files(files.withColumn("network", F.element_at(F.split("file", "/"), -2)))


def dedupe_files(files: DataFrame) -> DataFrame:
    """One row per network and digest of the first 20,000 characters; the smallest path stays."""
    key = F.md5(F.substring("payload", 1, 20000))
    return files.groupBy("network", key.alias("digest")).agg(F.min_by("payload", "file").alias("payload"), F.min("file").alias("file"))


def repair_js(c: Column) -> Column:
    """A JavaScript object literal as JSON: bare keys are quoted, bare NaN becomes null."""
    return F.regexp_replace(F.regexp_replace(c, r"([{,]\s*)([A-Za-z_][\w]*|\d+)\s*:", r'$1"$2":'), r"\bNaN\b", "null")


def arso(df: DataFrame) -> DataFrame:
    """points -> station -> minutes since 1800-01-01 -> p0, p1, ...: station, local_time, parameter, value."""
    j = df.select(F.from_json(repair_js(F.col("payload")), "points map<string,map<string,map<string,string>>>").alias("j"))
    s = j.select(F.explode_outer("j.points").alias("station", "times"))
    t = s.select("station", F.explode_outer("times").alias("minute", "values"))
    v = t.select("station", "minute", F.explode_outer("values").alias("parameter", "value"))
    minutes = F.regexp_replace("minute", "^_", "").cast("long")
    start = -5364662400  # 1800-01-01 in seconds since 1970
    return v.select(F.regexp_replace("station", "^_", "").alias("station"), F.timestamp_seconds(minutes * 60 + start).alias("local_time"), "parameter", number(F.col("value")).alias("value"))


def bufr_json(df: DataFrame) -> DataFrame:
    """Lines of BUFR-like JSON: code B12101 is kelvin, B13013 metres of snow; integer coordinates are 1e-5 degrees."""
    j = df.select(F.from_json("payload", "date string, lat double, lon double, data array<struct<vars:map<string,struct<v:string>>>>").alias("j"))
    degrees = lambda c: F.when(F.abs(c) > 1000, c * 1e-5).otherwise(c)
    v = j.select("j.date", degrees(F.col("j.lat")).alias("lat"), degrees(F.col("j.lon")).alias("lon"), F.explode_outer("j.data").alias("d"), "j")
    name = F.element_at(F.filter(F.transform("j.data", lambda d: F.try_element_at(d["vars"], F.lit("B01019"))["v"]), lambda x: x.isNotNull()), 1)
    e = v.select(name.alias("station"), "date", "lat", "lon", F.explode_outer("d.vars").alias("code", "cell")).filter(F.col("code") != "B01019")
    x = number(F.col("cell.v"))
    scaled = F.when(F.col("code") == "B12101", x - 273.15).when(F.col("code") == "B13013", x * 100).otherwise(x)
    return e.select("station", _time(F.col("date"), "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss").alias("local_time"), "lat", "lon", "code", F.round(scaled, 6).alias("value"))


def delimited(lines: DataFrame, sep: str, time: list[str], formats: list[str], candidates: list[str]) -> DataFrame:
    """Rows of text files (file, n, line) whose first line of each file is a header: file, local_time, value.

    The time column is the first of ``time``, the value column the first of
    ``candidates`` that the file has.  Headers are one row a file.
    """
    import re

    head = lines.filter("n = 0").select("file", F.split("line", re.escape(sep)).alias("h"))
    rows = lines.filter("n > 0").join(head, "file").withColumn("c", F.split("line", re.escape(sep)))
    pick = lambda names: F.get("c", F.coalesce(*[F.nullif(F.array_position("h", x), F.lit(0)) for x in names]).cast("int") - 1)
    return rows.select("file", _time(F.trim(pick(time)), *formats).alias("local_time"), number(pick(candidates)).alias("value"))


def sectioned(files: DataFrame) -> DataFrame:
    """Hydrographic text files (file, text): header lines ``key;value`` then ``date;value`` rows; degrees may be d m s; "Lücke" is missing."""
    rows = files.select("file", "text", F.posexplode_outer(F.split("text", r"\r?\n")).alias("n", "line"))
    key = lambda k: F.trim(F.regexp_extract("text", rf"(?m)^{k}\s*;\s*(.*)$", 1))
    dms = lambda c: F.when(c.rlike(r"^\d+\s+\d+\s+\d+"), F.regexp_extract(c, r"^(\d+)", 1).cast("double") + F.regexp_extract(c, r"^\d+\s+(\d+)", 1).cast("double") / 60 + F.regexp_extract(c, r"^\d+\s+\d+\s+(\d+)", 1).cast("double") / 3600).otherwise(number(c))
    data = rows.filter(F.col("line").rlike(r"^\d{2}\.\d{2}\.\d{4}"))
    cell = F.split("line", ";")
    return data.select("file", key("Name").alias("station"), dms(key("Breite")).alias("lat"), dms(key("Laenge")).alias("lon"), _time(F.trim(cell[0]), "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm").alias("local_time"), number(cell[1]).alias("value"))


def catalogue(rows: DataFrame, parameters: list[str]) -> DataFrame:
    """One row per station with a 0/1 flag for each parameter it delivers."""
    return rows.groupBy("station").agg(*[F.max(F.when(F.col("parameter") == p, 1).otherwise(0)).alias(f"has_{p}") for p in parameters])


def normalize_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename to canonical names: the first alias present serves, the others go; NaN becomes null."""
    out = df
    for name, names in aliases.items():
        have = [c for c in [name, *names] if c in df.columns]
        if have:
            out = out.withColumn(name, F.col(have[0])).drop(*[c for c in have if c != name])
    floats = [f.name for f in out.schema if f.dataType.simpleString() in ("double", "float")]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def first_field(doc: Column, names: list[str]) -> Column:
    """The number under the first of ``names`` that a JSON text holds at any depth."""
    return F.nullif(F.regexp_extract(doc, rf'"(?:{"|".join(names)})"\s*:\s*"?(-?[0-9]+(?:\.[0-9]+)?)', 1), F.lit("")).try_cast("double")


def write_panel(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned zstd Parquet; replaces the partitions it writes and leaves others."""
    df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

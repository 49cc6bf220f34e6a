"""Round trips through the record layouts: events written as a layout and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimbara.functions.session import scratch
from nimbara.plans.base import DAILY, OBS, STATIONS, daily, obs, r, read, stations
from nimbara.plans.registry import query
from nimbara.sources import archives as A
from nimbara.sources import providers as P
from nimbara.sources import sinks as S

PARSED = f"""WITH {OBS}, {STATIONS} SELECT 'st' || station AS station, lat, lon, elev::DOUBLE AS height, count(*) AS n, count(value) AS n_valid, round(sum(value), 3) + 0.0 AS total, min(strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M')) AS first_time FROM obs JOIN stations USING (station) GROUP BY ALL"""


def _series(spark, sf, fmt: str, *fields: tuple[str, str]):
    """Rows of a station as an array of structs, with its attributes as strings."""
    t = F.date_format(F.timestamp_seconds("sec"), fmt)
    o = obs(spark, sf).join(stations(spark, sf), "station").withColumn("time", t)
    cell = [(F.col("time") if kind == "time" else F.coalesce(F.col("value").cast("string"), F.lit("---"))).alias(name) for name, kind in fields]
    g = o.groupBy(F.concat(F.lit("st"), F.col("station").cast("string")).alias("name"), F.col("lat").cast("string").alias("la"), F.col("lon").cast("string").alias("lo"), F.col("elev").cast("string").alias("el"))
    return g.agg(F.collect_list(F.struct(*cell)).alias("rows"))


def _summary(df):
    return df.groupBy("station", "lat", "lon", "height").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), r(F.sum("value"), 3).alias("total"), F.date_format(F.min("local_time"), "yyyy-MM-dd HH:mm").alias("first_time"))


@query(PARSED)
def parse_datapoints(spark, sf):
    """Metadata and datapoints."""
    s = _series(spark, sf, "yyyy-MM-dd HH:mm:ss", ("timestamp", "time"), ("TT", "value"))
    j = F.to_json(F.struct(F.struct("name", F.col("el").alias("hoehe"), F.col("la").alias("breite"), F.col("lo").alias("laenge")).alias("metadata"), F.col("rows").alias("datapoints")))
    return _summary(P.dwd(s.select(j.alias("payload"))))


@query(PARSED)
def parse_parallel_arrays(spark, sf):
    """Parallel arrays and the first parameter present."""
    s = _series(spark, sf, "yyyy-MM-dd'T'HH:mm", ("t", "time"), ("v", "value"))
    feature = F.struct(F.struct(F.struct(F.struct(F.col("rows.v").alias("data")).alias("rf")).alias("parameters")).alias("properties"), F.struct(F.array(F.col("lo").cast("double"), F.col("la").cast("double")).alias("coordinates")).alias("geometry"))
    j = F.to_json(F.struct(F.col("rows.t").alias("timestamps"), F.array(feature).alias("features"), F.struct("name", F.col("el").alias("altitude")).alias("station_metadata")))
    return _summary(P.zamg(s.select(j.alias("payload"))))


def _simple(spark, sf, fmt, time, value, lat, lon, parser):
    s = _series(spark, sf, fmt, (time, "time"), (value, "value"))
    j = F.to_json(F.struct("name", F.col("el").alias("hoehe"), F.col("la").alias(lat), F.col("lo").alias(lon), F.col("rows").alias("data")))
    return _summary(parser(s.select(j.alias("payload"))))


@query(PARSED)
def parse_day_first_times(spark, sf):
    """Day.month.year times."""
    return _simple(spark, sf, "dd.MM.yyyy HH:mm", "time", "value", "lat", "lon", P.meteoswiss)


@query(PARSED)
def parse_iso_times(spark, sf):
    """ISO times."""
    return _simple(spark, sf, "yyyy-MM-dd'T'HH:mm:ss", "timestamp", "value", "lat", "lon", P.slf)


@query(PARSED)
def parse_flat_records(spark, sf):
    """Longitude and latitude keys."""
    return _simple(spark, sf, "yyyy-MM-dd HH:mm:ss", "timestamp", "value", "latitude", "longitude", P.flat)


@query(PARSED)
def parse_alternate_time_key(spark, sf):
    """Times under another key."""
    return _simple(spark, sf, "yyyy-MM-dd HH:mm:ss", "time", "value", "lat", "lon", P.hydro)


@query(PARSED)
def parse_zone_suffix(spark, sf):
    """A zone name after the time."""
    return _simple(spark, sf, "yyyy-MM-dd'T'HH:mm:ss'CET'", "DATE", "VALUE", "latitude", "longitude", P.suedtirol)


@query(PARSED)
def parse_metadata_struct(spark, sf):
    """Station metadata in a struct, through the dispatcher."""
    s = _series(spark, sf, "yyyy-MM-dd'T'HH:mm:ss", ("time", "time"), ("value", "value"))
    j = F.to_json(F.struct(F.struct("name", F.col("el").alias("altitude"), F.col("la").alias("lat"), F.col("lo").alias("lon")).alias("station_metadata"), F.col("rows").alias("data")))
    return _summary(P.parse(s.select(F.lit("meteofrance").alias("network"), j.alias("payload"))))


@query(f"WITH {OBS} SELECT 'f' || (station % 20) AS file, count(*) AS n, count(value) AS n_valid, round(sum(value), 3) + 0.0 AS total FROM obs GROUP BY ALL")
def parse_delimited(spark, sf):
    """Text rows with a header, decimal commas and missing markers."""
    o = obs(spark, sf).withColumn("file", F.concat(F.lit("f"), (F.col("station") % 20).cast("string")))
    t = F.date_format(F.timestamp_seconds("sec"), "yyyyMMddHHmm")
    body = o.select("file", F.lit(1).alias("n"), F.concat_ws(";", t, F.lit("x"), F.coalesce(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("---"))).alias("line"))
    head = o.select("file").distinct().select("file", F.lit(0).alias("n"), F.lit("DATE;Q;RR1").alias("line"))
    d = P.delimited(head.unionByName(body), ";", ["AAAAMMJJHH", "DATE"], ["yyyyMMddHHmm"], ["T", "RR1"])
    return d.groupBy("file").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), r(F.sum("value"), 3).alias("total"))


@query(f"WITH {OBS} SELECT station::VARCHAR AS station, count(*) AS n, round(sum(value), 3) + 0.0 AS total FROM obs WHERE variable = 'view' AND value IS NOT NULL GROUP BY ALL")
def parse_js_object(spark, sf):
    """A repaired object literal with minutes since 1800."""
    o = obs(spark, sf).filter((F.col("variable") == "view") & F.col("value").isNotNull())
    cell = F.concat(F.lit("_"), F.floor((F.col("sec") + 5364662400) / 60).cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.lit(':{p0:"'), F.col("value").cast("string"), F.lit('"}'))
    t = o.groupBy("station").agg(F.concat_ws(",", F.collect_list(cell)).alias("body")).select(F.concat(F.lit("{points:{_"), F.col("station").cast("string"), F.lit(":{"), "body", F.lit("}}}")).alias("payload"))
    return P.arso(t).groupBy("station").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query(f"WITH {OBS}, {STATIONS} SELECT 'st' || station AS station, round(lat, 3) + 0.0 AS lat, count(value) AS n_valid, round(sum(value - 273.15), 3) + 0.0 AS total FROM obs JOIN stations USING (station) GROUP BY ALL")
def parse_coded_records(spark, sf):
    """Coded records with unit changes and integer coordinates."""
    o = obs(spark, sf).join(stations(spark, sf), "station")
    v = lambda c: F.struct(c.cast("string").alias("v"))
    data = F.array(F.struct(F.create_map(F.lit("B01019"), v(F.concat(F.lit("st"), F.col("station").cast("string")))).alias("vars")), F.struct(F.create_map(F.lit("B12101"), v(F.coalesce(F.col("value").cast("string"), F.lit("-")))).alias("vars")))
    j = F.to_json(F.struct(F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.round(F.col("lat") * 100000).alias("lat"), F.round(F.col("lon") * 100000).alias("lon"), data.alias("data")))
    return P.bufr_json(o.select(j.alias("payload"))).groupBy("station", r("lat", 3).alias("lat")).agg(F.count("value").alias("n_valid"), r(F.sum("value"), 3).alias("total"))


@query("SELECT l_orderkey, l_linenumber, parameter, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_tax AS tax, l_discount AS discount FROM lineitem) UNPIVOT (value FOR parameter IN (quantity, tax, discount))")
def wide_to_long(spark, sf):
    """Columns of variables as rows."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "tax", "discount"], "parameter", "value")


@query(f"WITH {OBS} SELECT station, " + ", ".join(f"max(CASE WHEN variable = '{v}' AND value > 120 THEN 1 ELSE 0 END) AS has_{v}" for v in ("click", "error", "view")) + " FROM obs GROUP BY station")
def station_catalogue(spark, sf):
    """Capability flags of each station."""
    o = obs(spark, sf).withColumn("parameter", F.when(F.col("value") > 120, F.col("variable")))
    return P.catalogue(o, ["click", "error", "view"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def pruned_scan(spark, sf):
    """A scan that reads one column."""
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS size FROM documents WHERE lang = 'en' AND doc_id < 1000000000")
def pushed_filter(spark, sf):
    """Filters that reach the Parquet scan."""
    return read(spark, sf, "documents").filter((F.col("lang") == "en") & (F.col("doc_id") < 1000000000)).select("doc_id", F.char_length("text").cast("long").alias("size"))


@query("SELECT c_custkey AS station, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS elev, c_name AS name FROM customer")
def normalized_columns(spark, sf):
    """Canonical column names, and NaN as null."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("station"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).otherwise(float("nan")).alias("hoehe"), F.col("c_name").alias("station_name"))
    return P.normalize_columns(c, {"elev": ["elev_dem", "hoehe"], "name": ["station_name"]})


def _zip(batches):
    """An archive of one product file for each row (path, body)."""
    import io
    import zipfile

    import pyarrow as pa

    for batch in batches:
        out = []
        for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist()):
            f = io.BytesIO()
            with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("Metadaten.txt", "nothing")
                z.writestr(f"produkt_{path}.txt", body.encode("latin-1"))
            out.append(f.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


@query(f"""WITH {OBS}, x AS (SELECT station, sec // 600 AS t, arg_min(value, event_id) AS v FROM obs WHERE value IS NOT NULL GROUP BY ALL)
SELECT lpad(station::VARCHAR, 5, '0') AS station, count(*) AS n, round(sum(v), 3) + 0.0 AS total FROM x WHERE t * 600 BETWEEN epoch(TIMESTAMP '2024-01-05 00:00:00') AND epoch(TIMESTAMP '2024-01-20 00:00:00') GROUP BY ALL""")
def parse_zipped_products(spark, sf):
    """Product files inside archives, within a date window, one row a time."""
    o = obs(spark, sf).filter(F.col("value").isNotNull())
    t = F.date_format(F.timestamp_seconds(F.expr("sec div 600 * 600")), "yyyyMMddHHmm")
    line = F.concat_ws(";", F.lpad(F.col("station").cast("string"), 11, " "), t, F.lit("    3"), F.col("value").cast("string"), F.lit("eor"))
    rows = o.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    body = F.concat(F.lit("STATIONS_ID;MESS_DATUM;  QN;TT_10;eor\n"), F.array_join("x.line", "\n"), F.lit("\n"))
    files = rows.select(F.col("station").cast("string").alias("path"), body.alias("body")).mapInArrow(_zip, "path string, content binary")
    d = A.product_rows(A.zipped_lines(files), "TT_10", "yyyyMMddHHmm", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return d.groupBy("station").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query(f"WITH {STATIONS} SELECT lpad(station::VARCHAR, 5, '0') AS station, '2001-02-03' AS first_day, elev::DOUBLE AS height, lat + 0.0 AS lat, lon + 0.0 AS lon, 'Bad Ort ' || station AS name, upper(provider) AS region FROM stations")
def parse_station_list(spark, sf):
    """A station list set with blanks."""
    s = stations(spark, sf)
    text = F.concat_ws("   ", F.col("station").cast("string"), F.lit("20010203 20231231"), F.col("elev").cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.concat(F.lit("Bad Ort "), F.col("station").cast("string")), F.concat(F.upper("provider"), F.lit("  ")))
    extra = spark.createDataFrame([("Stations_id von_datum bis_datum Stationshoehe geoBreite geoLaenge Stationsname Bundesland",), ("----------- --------- ---------",), ("99 20010203 20231231 1 95.0 9.0 Nirgends X",)], "line string")
    return A.station_list(s.select(text.alias("line")).unionByName(extra)).withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd")).drop("last_day")


@query(f"""WITH {OBS}, g AS (SELECT *, (sec - lag(sec) OVER (PARTITION BY station ORDER BY sec)) / 3600.0 AS gap FROM (SELECT station, sec, avg(value) AS value FROM obs GROUP BY ALL)),
m AS (SELECT station, quantile_cont(gap, 0.5) AS m FROM g GROUP BY station), a AS (SELECT g.station, sec // 1800 AS slot, value, value * least(coalesce(gap, CASE WHEN m > 0 THEN m ELSE 5 / 60.0 END), 1.0) AS a FROM g JOIN m USING (station))
SELECT station, slot, round(avg(value), 4) + 0.0 AS value, round(sum(a), 4) + 0.0 AS amount FROM a GROUP BY ALL""")
def native_half_hours(spark, sf):
    """Native rows in local time as half hours; rates become amounts."""
    o = obs(spark, sf).groupBy("station", "sec").agg(F.avg("value").alias("value"))
    zone = F.when(F.col("station") % 2 == 0, "Europe/Berlin").otherwise("UTC")
    local = F.convert_timezone(F.lit("UTC"), zone, F.timestamp_seconds("sec").cast("timestamp_ntz")).cast("string")
    back = o.withColumn("sec", A.utc_seconds(local, zone))
    return A.half_hours(back, ["value"], "value").select("station", "slot", r("value").alias("value"), r("amount").alias("amount"))


@query(f"""WITH {OBS}, x AS (SELECT station, variable, sec // 60 AS t, arg_min(value, event_id) AS v FROM obs WHERE value IS NOT NULL AND variable IN ('view', 'click') GROUP BY ALL)
SELECT station::VARCHAR AS station, CASE variable WHEN 'view' THEN 'temperature' ELSE 'rh' END AS variable, count(*) AS n, round(sum(v), 3) + 0.0 AS total FROM x GROUP BY ALL""")
def native_json(spark, sf):
    """Arrays of records with alternative keys."""
    o = obs(spark, sf).filter(F.col("value").isNotNull() & F.col("variable").isin("view", "click"))
    t = F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm")
    key = F.when(F.col("event_id") % 2 == 0, "observation_time_utc").otherwise("observation_time_local")
    name = F.when(F.col("variable") == "click", "rh").when(F.col("event_id") % 3 == 0, "temperature").otherwise("t2m")
    record = F.map_from_arrays(F.array(key, name), F.array(t, F.col("value").cast("string")))
    rows = o.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(record).alias("j")))).alias("x"))
    files = rows.select(F.col("station").cast("string").alias("station"), F.concat(F.lit("["), F.array_join("x.j", ","), F.lit("]")).alias("payload"))
    d = A.native_json(files, {"temperature": ["temperature", "t2m"], "rh": ["rh"]})
    return d.groupBy("station", "variable").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query(f"WITH {OBS} SELECT 'st' || station AS station, round(any_value(47 + 15 / 60.0 + (station % 60) / 3600.0), 6) + 0.0 AS lat, count(*) AS n, count(value) AS n_valid, round(sum(value), 3) + 0.0 AS total FROM obs GROUP BY station")
def parse_sectioned(spark, sf):
    """Text files of sections with degrees, minutes and seconds."""
    o = obs(spark, sf)
    line = F.concat(F.date_format(F.timestamp_seconds("sec"), "dd.MM.yyyy HH:mm:ss"), F.lit(";"), F.coalesce(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("Lücke")))
    rows = o.groupBy("station").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    id_, second = F.col("station").cast("string"), (F.col("station") % 60).cast("string")
    text = F.concat(F.lit("Name;st"), id_, F.lit("\nBreite;47 15 "), second, F.lit("\nLaenge;11,4\nWerte\n"), "body", F.lit("\n"))
    d = P.sectioned(rows.select(id_.alias("file"), text.alias("text")))
    return d.groupBy("station").agg(r(F.max("lat"), 6).alias("lat"), F.count("*").alias("n"), F.count("value").alias("n_valid"), r(F.sum("value"), 3).alias("total"))


_SINK = f"WITH {DAILY} SELECT variable, count(*) AS n, round(sum(value), 3) + 0.0 AS total FROM daily"


def _back(spark, df, path):
    return spark.read.schema(df.schema).parquet(path).groupBy("variable").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query(f"{_SINK} WHERE variable IN ('view', 'click', 'error') GROUP BY variable")
def panel_sink(spark, sf):
    """Partitioned Parquet in batches; a batch replaces its own partitions only."""
    d, path = daily(spark, sf).select("variable", "station", "day", "value"), scratch(spark, "panel")
    for batch in (["view", "click"], ["error"], ["click"]):
        P.write_panel(d.filter(F.col("variable").isin(batch)), path, ["variable"])
    return _back(spark, d, path)


@query(f"{_SINK} WHERE variable = 'error' GROUP BY variable")
def replaced_table(spark, sf):
    """A table replaced as a whole."""
    d, path = daily(spark, sf).select("variable", "station", "day", "value"), scratch(spark, "table")
    S.replace_table(d.filter("variable = 'view'"), path)
    S.replace_table(d.filter("variable = 'error'"), path)
    return _back(spark, d, path)


@query(f"{_SINK} WHERE day % 3 <> 2 GROUP BY variable")
def map_sink(spark, sf):
    """One partition a period; a later run adds its periods and replaces them alone."""
    d = daily(spark, sf).select("variable", "station", "day", "value", F.concat(F.lit("P"), (F.col("day") % 3).cast("string")).alias("period"))
    path = scratch(spark, "maps")
    S.write_maps(d.filter("period = 'P0'"), path, "period")
    S.write_maps(d.filter("period = 'P1'"), path, "period")
    S.write_maps(d.filter("period = 'P0'"), path, "period")
    return _back(spark, d, path)


@query(f"{_SINK} GROUP BY variable")
def report_sink(spark, sf):
    """A report as CSV and as JSON lines, read again."""
    d = daily(spark, sf).groupBy("variable").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))
    a, b = scratch(spark, "csv"), scratch(spark, "json")
    S.write_report(d, a, "csv")
    S.write_report(d, b, "json")
    schema = "variable string, n long, total double"
    return spark.read.schema(schema).option("header", True).csv(a).intersect(spark.read.schema(schema).json(b))

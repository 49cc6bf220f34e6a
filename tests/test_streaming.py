"""Streaming forms give the batch result; the paged source retries and reads every page."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from nimbara.sources.paged import PagedJson
from nimbara.streaming import panels


def events(spark, sf, folder):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    return spark.read.parquet(folder)


def test_stream_panel_matches_batch(spark, sf, tmp_path):
    e = events(spark, sf, str(tmp_path / "in"))
    s = panels.read_events(spark, str(tmp_path / "in"), e.schema)
    panels.run_available(panels.stream_panel(s, ["user_id"], "ts", "1 day", "40 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = e.groupBy("user_id", F.date_trunc("day", "ts").alias("start")).agg(F.count("*").alias("n"), F.when(F.count("value") / F.count("*") >= 0.8, F.round(F.sum("value"), 4)).alias("s"))
    got = {(r.user_id, r.start): (r.n_rows, r.value_sum) for r in spark.read.schema("user_id long, start timestamp, n_rows long, value_sum double").parquet(str(tmp_path / "out")).collect()}
    by = {(r.user_id, r.start): (r.n, r.s) for r in want.collect()}
    # Windows behind the watermark are final; the others wait for more rows.
    assert all(by[k][0] == n and (s is None) == (by[k][1] is None) and (s is None or abs(s - by[k][1]) < 1e-3) for k, (n, s) in got.items())


def test_stream_periods(spark, tmp_path):
    rows = [(1, f"2024-01-01 {h:02d}:{m:02d}:00", 1.0) for h, m in ((0, 0), (0, 30), (1, 30), (3, 0))] + [(1, "2024-02-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "station int, t string, value double").select("station", F.to_timestamp("t").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = panels.read_events(spark, str(tmp_path / "in"), df.schema)
    q = panels.stream_periods(s, ["station"], "ts", F.col("value") > 0, "1 hour", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("periods").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("periods").collect()) == [1, 1, 3]


def test_paged_source(spark):
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            seen[page] = seen.get(page, 0) + 1
            if page == 2 and seen[page] == 1:
                self.send_error(503)
                return
            self.send_response(200 if self.headers["Authorization"] == "Bearer t" else 403)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": [{"v": page * 10 + i} for i in range(3)]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(PagedJson)
        df = spark.read.format("paged_json").option("url", f"http://127.0.0.1:{server.server_port}/x?page={{page}}").option("pages", 4).option("items", "rows").option("token", "t").option("backoff", 0.01).load()
        assert sorted(json.loads(r.record)["v"] for r in df.collect()) == [p * 10 + i for p in range(4) for i in range(3)]
        assert seen[2] == 2
    finally:
        server.shutdown()

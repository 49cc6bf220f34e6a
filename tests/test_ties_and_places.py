"""Queries on tables made for a case: stations of one place, and rows of one second."""

import datetime as dt

import duckdb

from nimbara.plans.registry import QUERIES, SQL


def matches(spark, folder, name, events, suppliers=()):
    """Whether a query gives the rows of its SQL; events: event_id, seconds, user_id, event_type, value in file order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    start = dt.datetime(2024, 1, 1)
    e = [[r[0] for r in events], [start + dt.timedelta(seconds=r[1]) for r in events], *[[r[i] for r in events] for i in (2, 3, 4)]]
    pq.write_table(pa.table(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), e)), schema=pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64())])), f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    if suppliers:
        pq.write_table(pa.table({"s_suppkey": pa.array([k for k, _ in suppliers], pa.int64()), "s_name": [n for _, n in suppliers]}), f"{folder}/supplier.parquet")
        con.execute(f"create view supplier as select * from '{folder}/supplier.parquet'")
    cur = con.execute(SQL[name])
    df = QUERIES[name](spark, str(folder)).select(*[d[0] for d in cur.description])
    key = lambda r: tuple((v is not None, round(v, 6) if isinstance(v, float) else v) for v in r)
    want = sorted(map(key, cur.fetchall()))
    return bool(want) and sorted(map(key, df.collect())) == want


def joined_rows(spark, df):
    """Most rows that one operator of the plan gave while ``df`` was collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        m = p.metrics().get("numOutputRows")
        if "Join" in p.nodeName() and m.isDefined():
            most = max(most, m.get().value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_variogram_joins_places(spark, tmp_path):
    # Stations 300 apart share their place: 40 in each of four places.
    events = [(i + 1 + i // 10, 60 * i, (i % 4) * 7 + 300 * (i // 4 % 40), "view", 20.0 + i * 37 % 101) for i in range(160)]
    assert matches(spark, tmp_path, "empirical_variogram", events)
    assert joined_rows(spark, QUERIES["empirical_variogram"](spark, str(tmp_path))) < 1000  # 12,000 pairs of stations


def test_nearest_provider_searches_cells(spark, tmp_path):
    events = [(i, 60 * i, i, "view", 1.0) for i in range(900)]
    suppliers = [(k, f"s{k * 7 % 1000:04d}") for k in range(1, 901) if k % 300 < 40]
    assert matches(spark, tmp_path, "nearest_provider", events, suppliers)
    assert joined_rows(spark, QUERIES["nearest_provider"](spark, str(tmp_path))) < 60_000  # 107,100 pairs
    assert matches(spark, tmp_path, "nearest_provider", events, suppliers[:1])


def test_rescue_asks_every_neighbour(spark, tmp_path):
    # Runs at one place, 40 apart or more; to every fourth one station agrees, whose median difference is 25 or just above.
    events, n = [], 1
    for s in range(60):
        level = 40.0 * (s * 17 % 60)
        rows = [(60 * j, 300 * s, level) for j in range(6)]
        if s % 4 == 0:
            rows += [(60 * j + 30, 300 * (1000 + s), v) for j, v in enumerate([level + 2000, level + 20, level + 30 + s % 8, level - 2000])]
        for at, station, v in rows:
            n += 1 + (n % 11 == 10)
            events.append((n, at, station, "view", v))
    assert matches(spark, tmp_path, "neighbour_rescue", events)


def test_rescue_joins_few_rows(spark, tmp_path):
    events = [(11 * i + 1, 60 * (i // 300), 300 * (i % 300), "view", 50.0 + i % 7) for i in range(1500)]
    assert matches(spark, tmp_path, "neighbour_rescue", events)
    assert joined_rows(spark, QUERIES["neighbour_rescue"](spark, str(tmp_path))) < 400_000  # 2,242,500 pairs of rows


TIES = [(1, 5, 7, "view", 9.0), (2, 5, 7, "view", 4.0), (3, 1830, 7, "view", 3.0), (4, 1830, 7, "view", 8.0), (5, 3605, 7, "click", 6.0), (6, 3605, 7, "view", 6.5), (7, 3605, 7, "view", 1.5)]


def test_regrid_takes_the_first_event_of_a_second(spark, tmp_path):
    assert matches(spark, tmp_path, "exact_regrid", TIES)


def test_forward_fill_takes_the_first_event_of_a_second(spark, tmp_path):
    assert matches(spark, tmp_path, "nearest_forward_fill", TIES)

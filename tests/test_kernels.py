"""Numeric kernels and sources against plain versions."""

import datetime as dt

import numpy as np
import pytest

from nimbara.operators import kernels as K
from nimbara.sources import providers as P


def test_kriging_is_exact_at_points_and_regresses_to_the_mean():
    g = np.random.default_rng(0)
    x, v = g.uniform(0, 100, (20, 2)), g.normal(size=20)
    z, var = K.ordinary_kriging(x, v, x[:3], (0.0, 1.0, 30.0))
    assert np.allclose(z, v[:3], atol=1e-5) and (var < 1e-5).all()
    far, _ = K.ordinary_kriging(x, v, np.array([[1e6, 1e6]]), (0.0, 1.0, 30.0), k=20)
    assert abs(far[0]) < np.abs(v).max()


def test_covariances_fall_from_the_sill():
    for kind in ("spherical", "exponential", "gaussian", "matern05", "matern15"):
        c = K.covariance(kind, np.array([0.0, 5.0, 50.0]), 2.0, 10.0)
        assert c[0] == 2.0 and c[0] > c[1] > c[2] >= 0
    with pytest.raises(ValueError):
        K.covariance("none", np.zeros(1), 1, 1)


def test_surface_and_additive_fit_smooth_fields():
    g = np.random.default_rng(1)
    x, y, z = g.uniform(0, 1, (3, 200))
    v = 3 + 2 * x - y + z**2
    assert np.abs(K.surface(x, y, v, z[:, None])[0] - v).mean() < 0.1
    assert np.abs(K.additive([x, y, z], v) - v).mean() < 0.05
    b = K.spline_basis(x)
    assert np.allclose(b.sum(1), 1)


def test_profile_is_robust():
    z = np.linspace(0, 2000, 100)
    v = 15 - 0.006 * z
    v[::20] += 40
    fit = K.elevation_profile(z, v)
    assert np.median(np.abs(fit - (15 - 0.006 * z))) < 0.5


def test_snow_water():
    d = np.array([0, 0.3, 0.5, 0.5, 0.45, 0.2, 0.0, 0.1])
    s = K.snow_water(d)
    assert s[0] == 0 and s[6] == 0 and (s[1:6] > 0).all() and s[2] > s[1] and abs(s[7] - 8.119417) < 1e-6
    assert (s[1:6] / d[1:6] <= 402).all()


def test_snow_water_by_hand():
    """Two days worked out by hand: settling, then a layer of new snow with its load."""
    m0 = 0.3 * 81.19417
    assert abs(K.snow_water(np.array([0, 0.3]))[1] - m0) < 1e-9
    h = 0.3 / (1 + m0 * 9.81 * 86400 / (8523356.0 * np.exp(0.02993175 * 81.19417)))
    # A change within the tolerance keeps the mass.
    assert abs(K.snow_water(np.array([0, 0.3, h + 0.02]))[2] - m0) < 1e-9
    load = (0.5 - h) * 81.19417 * 9.81
    rho = m0 / h
    h *= 1 - 0.0005104722 * load * np.exp(-0.37856737 * rho / (401.2588 - rho))
    assert abs(K.snow_water(np.array([0, 0.3, 0.5]))[2] - (m0 + (0.5 - h) * 81.19417)) < 1e-9
    # A fall drenches: layers reach the greatest density from the top, the rest runs off.
    assert abs(K.snow_water(np.array([0, 0.3, 0.01]))[2] - 4.012588) < 1e-6


def test_snow_water_gaps():
    nan = np.nan
    swe, rho = K.daily_snow_water(np.array([0.3, nan, 0.5, nan, nan, nan, nan, 0.2, 0.005]))
    whole = K.snow_water(np.array([0, 0.3, 0.4, 0.5]))[1:]
    assert np.allclose(swe[:3], whole) and np.isnan(swe[3:7]).all()
    assert np.isclose(swe[7], 0.2 * 81.19417) and np.isnan(rho[8]) and np.isclose(rho[0], 81.19417)
    assert np.isnan(K.daily_snow_water(np.full(3, nan))[0]).all()


@pytest.mark.parametrize("n", [1, 2, 5, 300, 900])
def test_nearest_matches_brute_force(n):
    g = np.random.default_rng(n)
    x, y, ids = np.round(g.uniform(0, 50, n), 1), np.round(g.uniform(0, 50, n), 1), g.permutation(n)
    got = {}
    for a, b, d, rank in zip(*K.nearest(x, y, ids, 8, block=64)):
        got.setdefault(a, []).append((rank, b))
    for a in range(n):
        d = np.round(np.hypot(x - x[a], y - y[a]), 6)
        assert [b for _, b in sorted(got.get(a, []))] == [b for b in sorted(range(n), key=lambda b: (d[b], ids[b])) if b != a][:8]


def test_pair_sums_leave_a_station_out():
    g = np.random.default_rng(0)
    n = 40
    x = g.uniform(0, 100, (n, 2))
    t = np.column_stack([np.ones(n), x / 100, g.uniform(0, 1, n)])
    y = g.normal(size=n) + 3 * t[:, 1]
    inverse = np.linalg.pinv(t.T @ t)
    lever = t @ inverse
    e = y - t @ (inverse @ (t.T @ y))
    pairs = K.PairSums(x, t, e)
    for i in range(n):
        m = np.arange(n) != i
        res = y[m] - t[m] @ np.linalg.lstsq(t[m], y[m], rcond=None)[0]
        a, b = np.triu_indices(n - 1, 1)
        edge = pairs.edge[m][:, m][a, b]
        counts, h, v = pairs.without(i, e[i] / (1 - lever[i] @ t[i]), lever[i])
        assert np.allclose(counts, np.bincount(edge, minlength=13)[:12])
        assert np.allclose(v * np.maximum(counts, 1), np.bincount(edge, 0.5 * (res[a] - res[b]) ** 2, 13)[:12])


def test_boosting_finds_the_best_split_and_follows_a_step():
    g = np.random.default_rng(3)
    x = g.integers(0, 9, (60, 3)).astype(float)
    e = np.where(x[:, 1] > 4, 2.0, -1.0) + g.normal(0, 0.01, 60)

    def left_over(c, t):
        low = x[:, c] <= t
        return ((e[low] - e[low].mean()) ** 2).sum() + ((e[~low] - e[~low].mean()) ** 2).sum()

    c, t, low, high = K.best_stump(x, e)
    assert c == 1 and 4 < t < 5 and low < 0 < high
    assert left_over(c, t) <= min(left_over(a, v) for a in range(3) for v in np.unique(x[:, a])[:-1]) + 1e-9
    assert np.abs(K.boosted(x, e, x, rounds=80) - e).mean() < 0.05
    assert np.allclose(K.boosted(np.zeros((5, 2)), np.arange(5.0), np.zeros((2, 2))), 2.0)


def test_gated_amounts():
    g = np.random.default_rng(4)
    x, y = g.uniform(0, 1, (2, 300))
    v = np.where(x > 0.5, 5 + 40 * y, 0.0)
    fit = K.gated_amounts([x, y], v, 1.0)
    assert ((fit > 0) == (x > 0.5)).mean() > 0.95 and np.abs(fit - v)[x > 0.6].mean() < 3
    assert fit.max() <= np.quantile(v[v > 1], 0.99) and (K.gated_amounts([x, y], np.zeros(300), 1.0) == 0).all()
    few = np.where(np.arange(300) < 5, 7.0, 0.0)
    assert K.gated_amounts([x, y], few, 1.0).max() <= 7.0


def test_shrunk_profiles_lie_between():
    z = np.tile(np.linspace(0, 2000, 40), 2)
    region = np.repeat([0, 1], 40)
    v = np.where(region == 0, 10 - 0.004 * z, 14 - 0.008 * z)
    fit, whole = K.shrunk_profile(z, v, region), K.elevation_profile(z, v)
    own = np.concatenate([K.elevation_profile(z[region == i], v[region == i]) for i in (0, 1)])
    assert ((fit - whole) * (own - fit) >= -1e-9).all()


def test_divide_distance():
    b = np.array([[0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0]])
    assert K.divide_distance(b).tolist() == [[3, 2, 1, 1], [3, 2, 1, 1], [4, 3, 2, 1]]
    assert (K.divide_distance(np.zeros((2, 2), int)) == -1).all()


def test_sinks_and_basins():
    z = np.array([[5, 5, 5, 5], [5, 1, 2, 4], [5, 5, 5, 5], [5, 5, 5, 5]], float)
    f = K.fill_sinks(z)
    assert f[1, 1] == 4 and f[1, 2] == 4 and (f >= z).all()
    assert K.basins(f)[1, 1] == 1 * 4 + 3


def test_ward_separates_groups():
    x = np.array([[0, 0], [0.1, 0], [10, 10], [10, 10.1], [0, 0.1]])
    assert K.ward(x, 2).tolist() == [0, 0, 1, 1, 0]


def test_rate_filter_and_greedy_clusters(spark):
    df = spark.createDataFrame([(1, t, t, float(v)) for t, v in enumerate([0, 1, 50, 2, 3])], "station long, sec long, event_id long, value double")
    assert sorted(r.sec for r in K.rate_filter(df, "station", "sec", 2.0).collect()) == [0, 1, 3, 4]
    s = spark.createDataFrame([(1, 47.0, 11.0, 0), (2, 47.00005, 11.0, 0), (3, 47.0001, 11.0, 0), (4, 47.0, 11.0, 1)], "station long, lat double, lon double, region int")
    assert {r.station: r.seed for r in K.greedy_clusters(s, "region", 6.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sectioned_and_repaired_sources(spark):
    text = "Name;Innsbruck\nBreite;47 15 36\nLaenge;11,4\nWerte\n01.02.2020 00:00:00;1,5\n01.02.2020 01:00:00;Lücke\n"
    got = P.sectioned(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert [(r.station, round(r.lat, 4), r.lon, r.value) for r in got] == [("Innsbruck", 47.26, 11.4, 1.5), ("Innsbruck", 47.26, 11.4, None)]
    js = '{points:{_7:{_115713120:{p0:"1.5",p1:NaN}}}}'
    got = {r.parameter: (r.station, r.local_time, r.value) for r in P.arso(spark.createDataFrame([(js,)], "payload string")).collect()}
    assert got["p0"] == ("7", dt.datetime(1800, 1, 1) + dt.timedelta(minutes=115713120), 1.5) and got["p1"][2] is None


def test_files_are_deduplicated_by_content(spark, tmp_path):
    for net, name, body in (("slf", "a", '{"name":"x","data":[]}'), ("slf", "b", '{"name":"x","data":[]}'), ("hydro", "a", '{"name":"x","data":[]}')):
        (tmp_path / net).mkdir(exist_ok=True)
        (tmp_path / net / f"{name}.json").write_text(body)
    assert sorted(r.network for r in P.read_folder(spark, str(tmp_path)).collect()) == ["hydro", "slf"]


def test_panel_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "panel")
    P.write_panel(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "station long, month string, v double"), path, ["month"])
    P.write_panel(spark.createDataFrame([(3, "b", 3.0)], "station long, month string, v double"), path, ["month"])
    assert sorted((r.station, r.month) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_tables_are_replaced_whole(spark, tmp_path):
    from nimbara.sources import sinks

    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5, 7), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [5, 6]
    assert [p.name for p in tmp_path.iterdir() if "t" == p.name or p.name.startswith("t.")] == ["t"]


def test_reports_and_maps(spark, tmp_path):
    from nimbara.sources import sinks

    df = spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "v long, period string")
    sinks.write_report(df, str(tmp_path / "csv"))
    sinks.write_report(df, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_maps(df, str(tmp_path / "maps"), "period")
    sinks.write_maps(spark.createDataFrame([(9, "2024-02")], "v long, period string"), str(tmp_path / "maps"), "period")
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "maps")).collect()) == [1, 9]
    with pytest.raises(ValueError):
        sinks.write_report(df, str(tmp_path / "x"), "xml")


def test_map_cells_separate_groups():
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(m, 0.1, (20, 2)) for m in (0, 5, 10)])
    cell = K.self_organising_map(x)
    sets = [set(cell[i * 20 : i * 20 + 20]) for i in range(3)]
    assert not (sets[0] & sets[1] or sets[0] & sets[2] or sets[1] & sets[2])


def peak_mb(f, *args):
    """Result of a call and the memory it took at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_surface_with_elevation_needs_no_square_of_stations():
    g = np.random.default_rng(5)
    x, y, z = g.uniform(0, 200, (3, 6000))
    (fit, lam), mb = peak_mb(K.surface, x, y, x / 20 + z / 100 + g.normal(0, 0.1, 6000), z[:, None] / 100)
    assert mb < 60 and np.abs(fit - x / 20 - z / 100).mean() < 0.1  # a hat matrix alone would take 288 MB


def co_located(n: int, places: int, seed: int = 6):
    """A day of ``n`` stations at few places, as a frame."""
    import pandas as pd

    g = np.random.default_rng(seed)
    xy = g.uniform(0, 200, (places, 2))[g.integers(0, places, n)]
    f = pd.DataFrame({"station": np.arange(n), "day": 1, "x": xy[:, 0], "y": xy[:, 1], "z": g.uniform(0, 3, n)})
    return f.assign(value=f["x"] / 50 + g.normal(size=n))


class Groups:
    """Stands for a DataFrame of one group."""

    def __init__(self, frame):
        self.frame = frame

    def groupBy(self, *_):
        return self

    def applyInPandas(self, f, _):
        return f(self.frame)


def test_kriging_needs_no_square_of_stations():
    f = co_located(3000, 60)
    f["wet"] = (f["value"] > 2).astype(float)
    out, mb = peak_mb(K.regression_kriging, Groups(f), "day", "wet", ["x", "y", "z"])
    assert mb < 40 and out["predicted"].notna().all()  # distances of all pairs would take 72 MB


def test_plain_surface_needs_no_square_of_stations():
    g = np.random.default_rng(7)
    x, y = g.uniform(0, 200, (2, 6000))
    (fit, lam), mb = peak_mb(K.surface, x, y, x / 20 + g.normal(0, 0.1, 6000))
    b = K.bilinear_design(x[:300], y[:300], 6, 5, (x[:300].min(), x[:300].max() + 1e-9, y[:300].min(), y[:300].max() + 1e-9))
    few, lam = K.surface(x[:300], y[:300], x[:300] / 20)
    hat = b @ np.linalg.solve(b.T @ b + lam * K.roughness(6, 5) + 1e-8 * np.eye(30), b.T)
    assert mb < 60 and np.abs(fit - x / 20).mean() < 0.1 and np.allclose(few, hat @ (x[:300] / 20), atol=1e-6)


def test_kriging_of_co_located_stations_matches_single_ones():
    """Every station left out by hand, with trend, bins and neighbours of the others."""
    f = co_located(60, 25, 8)
    trend = ["x", "y", "z"]
    x, y, n = f[["x", "y"]].to_numpy(), f["value"].to_numpy(), len(f)
    t = np.column_stack([np.ones(n), f[trend].to_numpy()])
    i, j = np.triu_indices(n, 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    far = d[d <= np.quantile(d, 0.75)].max()
    edge = np.where(d <= far, np.minimum((d / far * 12).astype(int), 11), 12)
    out = K.regression_kriging(Groups(f), "day", "value", trend)["predicted"].to_numpy()
    for s in range(n):
        m = np.arange(n) != s
        beta = np.linalg.lstsq(t[m], y[m], rcond=None)[0]
        res, here = y - t @ beta, (i != s) & (j != s) & (edge < 12)
        count = np.bincount(edge[here], minlength=12)
        mean = lambda v: np.bincount(edge[here], v[here], 12) / np.maximum(count, 1)
        model = K.fit_bins(count, mean(d), mean(0.5 * (res[i] - res[j]) ** 2), "exponential")
        z, _ = K.ordinary_kriging(x[m], res[m], x[s : s + 1], model)
        assert abs(out[s] - t[s] @ beta - z[0]) < 1e-6


def test_pair_quantile_in_blocks(monkeypatch):
    f = co_located(300, 80, 9)
    x = f[["x", "y"]].to_numpy()
    place, count = np.unique(x, axis=0, return_counts=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(300, 1)]
    monkeypatch.setattr(K, "HELD", 500)
    for q in (0.1, 0.5, 0.75, 0.99):
        value, upto = K.pair_quantile(place, count.astype(float), q)
        assert np.isclose(value, np.quantile(d, q), rtol=1e-12) and upto == d[d <= value].max()


def test_mean_of_other_stations_needs_no_square_of_stations(monkeypatch):
    f = co_located(6000, 300, 10)
    x, v = f[["x", "y"]].to_numpy(), f["value"].to_numpy()
    out, mb = peak_mb(K.others_mean, x, v, 20.0)
    assert mb < 60  # weights of all pairs would take 288 MB
    monkeypatch.setattr(K, "HELD", 700)
    w = np.exp(-np.sqrt(((x[:500, None] - x[None]) ** 2).sum(2)) / 20)
    w[np.arange(500), np.arange(500)] = 0
    assert np.allclose(out[:500], w @ v / w.sum(1)) and np.allclose(K.others_mean(x, v, 20.0), out)
    far = np.array([[0.0, 0.0], [1e6, 0.0], [1e6, 0.0]])
    assert np.allclose(K.others_mean(far, np.array([1.0, 2.0, 4.0]), 20.0), [0, 4, 2])

"""Vectorised kernels for what has no relational form: sequential filters and dense algebra.

Each works on one group of rows (a station or a time), so groups are small and
independent; Spark deals them out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_filter(df: DataFrame, key: str, sec: str, most: float) -> DataFrame:
    """Rows whose slope against the last accepted row is at most ``most`` per second."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([sec, "event_id"])
        keep, t0, v0 = [], None, None
        for t, v in zip(g[sec].to_numpy(), g["value"].to_numpy()):
            ok = v0 is None or t == t0 or abs(v - v0) / (t - t0) <= most
            keep.append(ok)
            if ok:
                t0, v0 = t, v
        return g[keep]

    return df.filter("value IS NOT NULL").groupBy(key).applyInPandas(run, df.schema)


def greedy_clusters(df: DataFrame, region: str, metres: float) -> DataFrame:
    """Seeds in order of station; members join the first seed within ``metres``.  region: a column that no cluster crosses."""
    schema = f"station long, seed long, {region} {df.schema[region].dataType.simpleString()}"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("station")
        lat, lon, ids = g["lat"].to_numpy(), g["lon"].to_numpy(), g["station"].to_numpy()
        scale = 111320.0 * np.cos(np.radians(lat.mean()))
        x, y, seed = lon * scale, lat * 111320.0, np.full(len(g), -1)
        for i in range(len(g)):
            if seed[i] < 0:
                near = (seed < 0) & (np.hypot(x - x[i], y - y[i]) <= metres)
                seed[near] = ids[i]
        return pd.DataFrame({"station": ids, "seed": seed, region: g[region].to_numpy()})

    return df.groupBy(region).applyInPandas(run, schema)


#: Published constants of the layer model (Winkler, Schellander and Gruber, 2021; Alpine calibration).
#: Greatest and new-snow density (kg m-3), overburden factors, viscosity exponent
#: (m3 kg-1), tolerance (m), viscosity of no snow (Pa s), gravity (m s-2).
RHO_MAX, RHO_NEW = 401.2588, 81.19417
C_OVER, K_OVER = 0.0005104722, 0.37856737
K_VISCOUS, TOLERANCE, ETA_NULL, GRAVITY = 0.02993175, 0.02362476, 8523356.0, 9.81
THIN = 1e-10  #: depths and masses below it are none


class Snowpack:
    """Layers of a snowpack, lowest first: thickness ``h`` (m) and mass ``m`` (mm water)."""

    def __init__(self, h=(), m=()):
        self.h, self.m = np.array(h, float), np.array(m, float)

    def density(self) -> np.ndarray:
        return np.divide(self.m, self.h, out=np.zeros_like(self.m), where=self.h > THIN)

    def settled(self, seconds: float) -> "Snowpack":
        """After a step of Newtonian settling under the own and higher layers' weight."""
        weight = GRAVITY * np.cumsum(self.m[::-1])[::-1]
        strain = seconds * weight / (ETA_NULL * np.exp(K_VISCOUS * self.density()))
        h = np.where(self.h > THIN, np.maximum(self.h / (1 + strain), self.m / RHO_MAX), 0.0)
        return Snowpack(h, self.m)

    def snowed(self, depth: float) -> "Snowpack":
        """With a layer of new snow up to ``depth``; its load strains the layers below at once."""
        rho = self.density()
        load = (depth - self.h.sum()) * RHO_NEW * GRAVITY
        strain = C_OVER * load * np.exp(-K_OVER * rho / np.maximum(RHO_MAX - rho, THIN))
        h = self.h * (1 - np.clip(strain, 0.0, 0.95))
        fresh = max(depth - h.sum(), 0.0)
        return Snowpack([*h, fresh], [*self.m, fresh * RHO_NEW])

    def scaled(self, share: float) -> "Snowpack":
        """Thinned to ``share``; mass beyond the greatest density moves to lighter layers from the top, the rest runs off."""
        h = self.h * min(1.0, share)
        full = self.m - h * RHO_MAX > THIN * np.maximum(h, THIN)
        m = np.where(full, h * RHO_MAX, self.m)
        over = self.m.sum() - m.sum()
        room = np.where(full, 0.0, np.maximum(h * RHO_MAX - m, 0.0))[::-1]
        taken = np.clip(over - (np.cumsum(room) - room), 0.0, room)
        return Snowpack(h, m + taken[::-1])

    def drenched(self, depth: float) -> "Snowpack":
        """Pressed to ``depth``: layers reach the greatest density from the top down; if all have, water runs off."""
        least = self.m / RHO_MAX
        # Total depth once the top 1, 2, ... layers are as dense as can be.
        after = self.h.sum() - np.cumsum((self.h - least)[::-1])
        reached = np.flatnonzero(after - depth < THIN)
        n, h = len(self.h), self.h.copy()
        if len(reached):
            top = n - 1 - int(reached[0])
            h[top + 1 :] = least[top + 1 :]
            h[top] = least[top] + abs(after[reached[0]] - depth)
        else:
            h = least
        new = Snowpack(h, self.m)
        if (RHO_MAX - new.density() <= THIN).all() and h.sum() > THIN:
            share = depth / h.sum()
            return Snowpack(h * share, self.m * share)
        return new


def snow_water(depth: np.ndarray, hours: float = 24.0) -> np.ndarray:
    """Snow water equivalent (mm) from a gapless depth series (m) by a multilayer densification model.

    Overnight the layers settle.  A rise beyond the tolerance is new snow, a
    change within it rescales the settling, a fall beyond it drenches the pack.
    """
    depth = np.maximum(np.nan_to_num(np.asarray(depth, float)), 0.0)
    out = np.zeros(len(depth))
    pack, before = Snowpack(), 0.0
    for i, d in enumerate(depth):
        if d <= THIN:
            pack = Snowpack()
        elif before <= THIN:
            pack = Snowpack([d], [d * RHO_NEW])
        else:
            night = pack.settled(hours * 3600.0)
            rise = d - night.h.sum()
            pack = night.snowed(d) if rise > TOLERANCE else pack.scaled(d / before) if rise >= -TOLERANCE else night.drenched(d)
        out[i], before = pack.m.sum(), d
    return out


def daily_snow_water(depth: np.ndarray, gap: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Water equivalent (mm) and density (kg m-3) of a daily depth series (m) with missing days.

    Gaps of up to ``gap`` days are filled linearly; after longer ones the model
    starts anew.  Density needs an observed centimetre of snow.
    """
    depth = np.asarray(depth, float)
    swe, rho = np.full(len(depth), np.nan), np.full(len(depth), np.nan)
    known = np.flatnonzero(np.isfinite(depth))
    if not len(known):
        return swe, rho
    days = np.arange(known[0], known[-1] + 1)
    filled = np.interp(days, known, depth[known])
    after = np.searchsorted(known, days)  # the next known day
    wide = (known[after] != days) & (known[after] - known[np.maximum(after - 1, 0)] - 1 > gap)
    for run in np.split(np.flatnonzero(~wide), np.flatnonzero(np.diff(np.flatnonzero(~wide)) > 1) + 1):
        swe[days[run]] = snow_water(np.concatenate([[0.0], filled[run]]))[1:]
        thick = filled[run] >= 0.01
        rho[days[run][thick]] = swe[days[run][thick]] / filled[run][thick]
    rho[np.isfinite(depth) & (depth < 0.01)] = np.nan
    return swe, rho


def swe_series(df: DataFrame, key: str, at: str) -> DataFrame:
    """key, ``at`` (a day), depth, swe and density of every row, per series; null depths are missing days."""
    schema = f"{key} long, {at} long, depth double, swe double, density double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(at)
        day, d = g[at].to_numpy(), g["depth"].to_numpy(float)
        every = np.full(day[-1] - day[0] + 1, np.nan)
        every[day - day[0]] = d
        swe, rho = daily_snow_water(every)
        return pd.DataFrame({key: g[key].to_numpy(), at: day, "depth": d, "swe": swe[day - day[0]], "density": rho[day - day[0]]})

    return df.select(key, at, "depth").groupBy(key).applyInPandas(run, schema)


# --- nearest neighbours ------------------------------------------------------


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, other row, distance and rank (from 1) of the ``k`` nearest other points; ties by id.

    Points are taken in order of x, so a block of rows needs only a strip of
    the others; the strip grows until no point outside it can be nearer.
    Distances count to six decimals.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    x, y, ids = x[order], y[order], ids[order]
    rows, others, dists, ranks = [], [], [], []
    for lo in range(0, n, block):
        hi, reach = min(lo + block, n), max(block, 4 * k)
        while True:
            a, b = max(0, lo - reach), min(n, hi + reach)
            d = np.sqrt((x[lo:hi, None] - x[None, a:b]) ** 2 + (y[lo:hi, None] - y[None, a:b]) ** 2)
            r = np.round(d, 6)
            r[np.arange(hi - lo), np.arange(lo - a, hi - a)] = np.inf
            m = min(k, b - a - 1)
            if m < 1:
                break
            far = np.partition(r, m - 1, axis=1)[:, m - 1]
            edge = np.minimum(x[lo:hi] - x[a] if a else np.inf, x[b - 1] - x[lo:hi] if b < n else np.inf)
            if (a == 0 and b == n) or (m == k and (far < np.round(edge, 6)).all()):
                break
            reach *= 2
        if m < 1:
            continue
        i, j = np.nonzero(r <= far[:, None])
        by = np.lexsort((ids[a + j], r[i, j], i))
        i, j = i[by], j[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        keep = (rank <= k) & np.isfinite(r[i, j])
        rows.append(order[lo + i[keep]])
        others.append(order[a + j[keep]])
        dists.append(d[i[keep], j[keep]])
        ranks.append(rank[keep])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    return np.concatenate(rows), np.concatenate(others), np.concatenate(dists), np.concatenate(ranks)


def neighbours_by_time(df: DataFrame, time: str, k: int) -> DataFrame:
    """time, station, value, z, other, u (the other's value), dxy, dz (z / 1000) and rank of the k nearest stations of the same time.

    df: time, station, value, x, y, z.  A time has one row a station, so a group is as large as the network.
    """

    def run(g: pa.Table) -> pa.Table:
        x, y, z, value, ids = (g.column(c).to_numpy() for c in ("x", "y", "z", "value", "station"))
        i, j, d, rank = nearest(x, y, ids, k)
        cols = {time: g.column(time).take(pa.array(i)), "station": ids[i], "value": value[i], "z": z[i], "other": ids[j], "u": value[j], "dxy": d, "dz": np.abs(z[i] - z[j]) / 1000, "rank": rank.astype(np.int32)}
        return pa.table(cols)

    kind = df.schema[time].dataType.simpleString()
    return df.select(time, "station", "value", "x", "y", "z").groupBy(time).applyInArrow(
        run, f"{time} {kind}, station long, value double, z double, other long, u double, dxy double, dz double, rank int")


# --- kriging -----------------------------------------------------------------


def covariance(kind: str, d: np.ndarray, sill: float, reach: float) -> np.ndarray:
    """Spherical, exponential, Gaussian and Matérn (1/2, 3/2) covariances."""
    x = d / max(reach, 1e-9)
    if kind == "spherical":
        return sill * np.where(x < 1, 1 - 1.5 * x + 0.5 * x**3, 0.0)
    if kind in ("exponential", "matern05"):
        return sill * np.exp(-x)
    if kind == "gaussian":
        return sill * np.exp(-(x**2))
    if kind == "matern15":
        return sill * (1 + np.sqrt(3) * x) * np.exp(-np.sqrt(3) * x)
    raise ValueError(f"unknown covariance {kind}")


def fit_variogram(x: np.ndarray, v: np.ndarray, kind: str = "exponential", bins: int = 12) -> tuple[float, float, float]:
    """nugget, sill and reach by weighted least squares over a grid of reaches."""
    i, j = np.triu_indices(len(v), 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    half = 0.5 * (v[i] - v[j]) ** 2
    near = d <= np.quantile(d, 0.75) if len(d) else d > 0
    d, half = d[near], half[near]
    if len(d) < 10 or d.max() <= 0:
        return 0.0, max(float(np.var(v)), 1e-9), 1.0
    edge = np.minimum((d / d.max() * bins).astype(int), bins - 1)
    n = np.bincount(edge, minlength=bins)
    each = np.maximum(n, 1)
    return fit_bins(n, np.bincount(edge, d, bins) / each, np.bincount(edge, half, bins) / each, kind) or (0.0, max(float(np.var(v)), 1e-9), float(d.max()))


def ordinary_kriging(x: np.ndarray, v: np.ndarray, at: np.ndarray, model: tuple[float, float, float], kind: str = "exponential", k: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and variances from the ``k`` nearest points."""
    nugget, sill, reach = model
    out, var = np.empty(len(at)), np.empty(len(at))
    for n, p in enumerate(at):
        d = np.sqrt(((x - p) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:k]
        a = np.ones((len(near) + 1, len(near) + 1))
        a[:-1, :-1] = covariance(kind, np.sqrt(((x[near][:, None] - x[near][None]) ** 2).sum(2)), sill, reach)
        a[range(len(near)), range(len(near))] += nugget + 1e-9 * sill
        a[-1, -1] = 0
        b = np.append(covariance(kind, d[near], sill, reach), 1.0)
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        out[n] = w[:-1] @ v[near]
        var[n] = max(0.0, sill + nugget - w @ b)
    return out, var


#: Place pairs whose distances are held at once.
HELD = 1 << 20


def place_distances(xy: np.ndarray):
    """Blocks of places: number of the first one, and distances of each to all places."""
    step = max(1, HELD // max(1, len(xy)))
    for lo in range(0, len(xy), step):
        yield lo, np.sqrt(((xy[lo : lo + step, None] - xy[None]) ** 2).sum(2))


def pair_quantile(xy: np.ndarray, count: np.ndarray, q: float, fine: int = 1 << 16) -> tuple[float, float]:
    """Quantile (linear) of the distances of all pairs of points, and the largest distance up to it; count: points at each place.

    A histogram shows which distances lie at the two ranks, so that only those are sorted.
    """
    n = float(count.sum())
    at = (n * (n - 1) / 2 - 1) * q
    ranks = (np.floor(at), np.floor(at) + 1)
    top = max(max(float(d.max()) for _, d in place_distances(xy)), 1e-300)

    def pairs():
        for lo, d in place_distances(xy):
            i = np.arange(lo, lo + len(d))
            w = count[i][:, None] * count[None] * (np.arange(len(xy))[None] > i[:, None])
            w[np.arange(len(d)), i] = count[i] * (count[i] - 1) / 2
            yield (d / top * fine).astype(np.int64), d, w

    total = sum(np.bincount(k.ravel(), w.ravel(), fine + 1) for k, _, w in pairs())
    upto = np.cumsum(total)
    cells = np.unique(np.minimum(np.searchsorted(upto, ranks, "right"), np.flatnonzero(total)[-1]))
    held = [(d[m], w[m]) for k, d, w in pairs() for m in [np.isin(k, cells) & (w > 0)]]
    d, w = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(d)
    d, w = d[order], w[order]
    skipped = np.concatenate([[0.0], upto])[(d / top * fine).astype(np.int64)]  # pairs of smaller cells
    cell = (d / top * fine).astype(np.int64)
    own = np.cumsum(w)
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    before = np.maximum.accumulate(np.where(first, own - w, 0.0))
    last = skipped + own - before  # pairs up to and with this distance
    low, high = (float(d[min(np.searchsorted(last, r, "right"), len(d) - 1)]) for r in ranks)
    part = at - ranks[0]
    value = low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)
    return value, high if high <= value else low


class PairSums:
    """Binned sums over station pairs, from which any station can be taken out again.

    With station i left out of a least-squares trend, the residual of j becomes
    e_j + s_i * (t_j . w_i), where s_i = e_i / (1 - h_ii), w_i is the trend's
    inverse times t_i.  Semivariances of such residuals are quadratic in w_i,
    so their sums over all pairs follow from sums and products a bin; the pairs
    of i itself are then subtracted.  Stations at one place have the same
    distances, so pairs are those of places, in blocks of them.
    """

    def __init__(self, x: np.ndarray, t: np.ndarray, e: np.ndarray, bins: int = 12):
        self.bins = bins
        self.place, of = np.unique(x, axis=0, return_inverse=True)
        self.of = of.ravel()
        u = np.column_stack([e, t])
        self.u = u - u.mean(0)  # only differences count
        q, at = u.shape[1], len(self.place)
        sums = lambda v=None: np.bincount(self.of, v, at).astype(float)
        self.count = sums()
        self.order = np.argsort(self.of, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(self.count.astype(np.int64))])
        self.one = np.stack([sums(self.u[:, a]) for a in range(q)], 1)
        self.two = np.stack([sums(self.u[:, a] * self.u[:, b]) for a in range(q) for b in range(q)], 1)
        self.far = pair_quantile(self.place, self.count, 0.75)[1]
        self.n, self.h, self.uu = np.zeros(bins), np.zeros(bins), np.zeros((bins, q, q))
        for lo, d in place_distances(self.place):
            n, h, one, two = self._own(d)
            c, s, m = (v[lo : lo + len(d)] for v in (self.count, self.one, self.two))
            self.n += c @ n / 2
            self.h += c @ h / 2
            cross = np.einsum("pi,pbj->bij", s, one)
            self.uu += (np.einsum("p,pbk->bk", c, two) + n.T @ m).reshape(bins, q, q) / 2 - (cross + cross.transpose(0, 2, 1)) / 2
        self.n[0] -= len(x) / 2  # a station and itself

    def _bins(self, d: np.ndarray) -> np.ndarray:
        edge = np.minimum((d / max(self.far, 1e-9) * self.bins).astype(int), self.bins - 1)
        edge[d > self.far] = self.bins  # beyond: not counted
        return edge

    def _own(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stations, their distances, sums and products in each bin around places; d: distances to all places."""
        edge, out = self._bins(d), []
        for b in range(self.bins):
            m = (edge == b).astype(float)
            out.append((m @ self.count, (m * d) @ self.count, m @ self.one, m @ self.two))
        return tuple(np.stack(v, 1) for v in zip(*out))

    @property
    def edge(self) -> np.ndarray:
        """Bin of each pair of stations (as a matrix; for small tables)."""
        d = np.sqrt(((self.place[:, None] - self.place[None]) ** 2).sum(2))
        out = self._bins(d)[self.of][:, self.of]
        np.fill_diagonal(out, self.bins)
        return out

    def left_out(self, own: tuple, rows: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, mean distance (both the same for all) and mean semivariances of all stations but each of ``rows``, which are at one place; c: (1, s * w) of each."""
        n_own, h_own, one, two = own
        n = self.n - n_own
        n[0] += 1
        r = (self.u[rows] * c).sum(1)[:, None]
        products = self.uu - two.reshape(self.uu.shape)
        square = np.einsum("bij,mi,mj->mb", products, c, c) - n_own * r**2 + 2 * r * (c @ one.T)
        return n, (self.h - h_own) / np.maximum(n, 1), 0.5 * np.maximum(square, 0.0) / np.maximum(n, 1)

    def without(self, i: int, s: float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, mean distance and mean semivariance of each bin over all stations but ``i``."""
        d = np.sqrt(((self.place[self.of[i]] - self.place) ** 2).sum(1))
        own = tuple(v[0] for v in self._own(d[None]))
        n, h, y = self.left_out(own, np.array([i]), np.append(1.0, s * w)[None])
        return n, h, y[0]

    def each_place(self):
        """Rows of the stations at each place, its distances to all places and its sums."""
        for lo, d in place_distances(self.place):
            own = self._own(d)
            for p in range(len(d)):
                yield self.order[self.starts[lo + p] : self.starts[lo + p + 1]], d[p], tuple(v[p] for v in own)

    def nearest_rows(self, d: np.ndarray, k: int) -> np.ndarray:
        """Rows of the ``k`` nearest stations of a place, the first of equally far ones; d: its distances to all places."""
        by = np.argsort(d, kind="stable")
        cut = min(int(np.searchsorted(np.cumsum(self.count[by]), k)), len(d) - 1)
        by = by[: np.searchsorted(d[by], d[by[cut]], "right")]
        rows = np.sort(np.concatenate([self.order[self.starts[p] : self.starts[p + 1]][:k] for p in by]))
        return rows[np.argsort(d[self.of[rows]], kind="stable")][:k]


def fit_bins(n: np.ndarray, h: np.ndarray, y: np.ndarray, kind: str, least: int = 5, steps: int = 24) -> tuple[float, float, float] | None:
    """nugget, sill and reach of binned semivariances by weighted least squares over a grid of reaches; None if bins are too few."""
    fit = fit_each(n, h, y[None], kind, least, steps)
    return None if fit is None else tuple(float(v[0]) for v in fit)


def fit_each(n: np.ndarray, h: np.ndarray, y: np.ndarray, kind: str, least: int = 5, steps: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """As ``fit_bins`` for each row of ``y``."""
    ok = n >= least
    if ok.sum() < 2:
        return None
    n, h, y = n[ok], h[ok], y[:, ok]
    w = n / np.maximum(h, 1e-9) ** 2
    reach = np.geomspace(h.min() / 2 + 1e-9, h.max() * 2, steps)
    f = np.stack([1 - covariance(kind, h, 1.0, q) for q in reach])  # steps x bins
    s0, sf, sff, sy, sfy = w.sum(), f @ w, (f**2) @ w, (y @ w)[:, None], (y * w) @ f.T
    det = s0 * sff - sf**2
    safe = np.where(det > 1e-12, det, 1.0)
    sill = np.maximum(np.where(det > 1e-12, (s0 * sfy - sf * sy) / safe, 0.0), 0.0)
    nugget = np.maximum(np.where(det > 1e-12, (sff * sy - sf * sfy) / safe, sy / s0), 0.0)
    error = (w * (nugget[:, :, None] + sill[:, :, None] * f - y[:, None]) ** 2).sum(2)
    best, row = np.argmin(error, 1), np.arange(len(y))
    return nugget[row, best], np.maximum(sill[row, best], 1e-9), reach[best]


def regression_kriging(df: DataFrame, time: str, target: str, trend: list[str], kind: str = "exponential", k: int = 16) -> DataFrame:
    """Leave-one-out regression kriging of every time: time, station, observed, predicted.

    Trend: least squares on ``trend``; residuals: ordinary kriging in x, y.
    Trend and variogram are those of the other stations; only the bins' edges
    come from all places.  Stations of one place share bins and neighbours, and
    no array is as large as the square of the stations.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("station")
        y, x = g[target].to_numpy(float), g[["x", "y"]].to_numpy(float)
        n, pred = len(g), np.full(len(g), np.nan)
        if n >= len(trend) + 4:
            t = np.column_stack([np.ones(n), g[trend].to_numpy(float)])
            t = t / np.maximum(np.abs(t).max(0), 1e-9)
            inverse = np.linalg.pinv(t.T @ t)
            lever = t @ inverse  # rows: w_i
            e = y - t @ (inverse @ (t.T @ y))
            s = e / np.maximum(1 - (lever * t).sum(1), 1e-9)
            pairs = PairSums(x, t, e)
            for at, d, own in pairs.each_place():
                near = pairs.nearest_rows(d, k + 1)
                for lo in range(0, len(at), 1024):
                    rows = at[lo : lo + 1024]
                    counts, h, v = pairs.left_out(own, rows, np.column_stack([np.ones(len(rows)), s[rows, None] * lever[rows]]))
                    fit = fit_each(counts, h, v, kind)
                    for m, i in enumerate(rows):
                        if fit is None:
                            res = np.delete(e + s[i] * (t @ lever[i]), i)
                            model = (0.0, max(float(np.var(res)), 1e-9), max(pairs.far, 1.0))
                        else:
                            model = tuple(float(c[m]) for c in fit)
                        others = near[near != i][:k]
                        z, _ = ordinary_kriging(x[others], e[others] + s[i] * (t[others] @ lever[i]), x[i : i + 1], model, kind, k)
                        pred[i] = y[i] - s[i] + z[0]  # y_i - s_i is the others' trend at i
        return pd.DataFrame({time: g[time].to_numpy(), "station": g["station"].to_numpy(), "observed": y, "predicted": pred})

    return df.groupBy(time).applyInPandas(run, f"{time} long, station long, observed double, predicted double")


# --- spline surfaces ---------------------------------------------------------


def bilinear_design(x: np.ndarray, y: np.ndarray, nx: int, ny: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """Weights of the four knots around each point on an nx by ny grid."""
    x0, x1, y0, y1 = box
    fx = np.clip((x - x0) / (x1 - x0) * (nx - 1), 0, nx - 1 - 1e-9)
    fy = np.clip((y - y0) / (y1 - y0) * (ny - 1), 0, ny - 1 - 1e-9)
    i, j = fx.astype(int), fy.astype(int)
    u, v = fx - i, fy - j
    out = np.zeros((len(x), nx * ny))
    r = np.arange(len(x))
    for di, dj, w in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)):
        out[r, (j + dj) * nx + i + di] += w
    return out


def roughness(nx: int, ny: int) -> np.ndarray:
    """Sum of squared second differences along both axes."""
    def second(n: int) -> np.ndarray:
        return np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((1, n))

    dx, dy = np.kron(np.eye(ny), second(nx)), np.kron(second(ny), np.eye(nx))
    return dx.T @ dx + dy.T @ dy


def surface(x, y, v, extra=None, nx=6, ny=5, lams=(1e-3, 1e-2, 1e-1, 1.0, 10.0)):
    """Penalised bilinear surface (with linear ``extra`` terms); smoothing by generalised cross-validation.  Returns fitted values and the penalty."""
    b = bilinear_design(x, y, nx, ny, (x.min(), x.max() + 1e-9, y.min(), y.max() + 1e-9))
    p = roughness(nx, ny)
    if extra is not None:
        b = np.column_stack([b, extra])
        p = np.pad(p, ((0, extra.shape[1]), (0, extra.shape[1])))
    best, square = None, b.T @ b
    for lam in lams:
        a = square + lam * p + 1e-8 * np.eye(b.shape[1])
        f = b @ np.linalg.solve(a, b.T @ v)
        freedom = np.trace(np.linalg.solve(a, square))  # trace of the hat matrix, which has as many rows and columns as there are stations
        gcv = len(v) * ((v - f) ** 2).sum() / max(1e-9, (len(v) - freedom) ** 2)
        if best is None or gcv < best[0]:
            best = (gcv, f, lam)
    return best[1], best[2]


def spline_basis(x: np.ndarray, knots: int = 6) -> np.ndarray:
    """Cubic B-splines on quantile knots."""
    inner = np.unique(np.quantile(x, np.linspace(0, 1, knots)))
    t = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])
    xx = np.clip(x, inner[0], inner[-1] - 1e-9 * max(1.0, abs(inner[-1])))
    b = ((xx[:, None] >= t[:-1]) & (xx[:, None] < t[1:])).astype(float)
    for k in range(1, 4):
        den1, den2 = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        left = np.where(den1 > 0, (xx[:, None] - t[: -k - 1]) / np.where(den1 > 0, den1, 1), 0.0) * b[:, :-1]
        right = np.where(den2 > 0, (t[k + 1 :] - xx[:, None]) / np.where(den2 > 0, den2, 1), 0.0) * b[:, 1:]
        b = left + right
    return b


def additive_design(columns: list[np.ndarray], lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns and penalty of one spline for each covariate; few distinct values make a linear term."""
    parts, pens = [], []
    for c in columns:
        if len(np.unique(c)) < 4:
            parts.append(c[:, None].astype(float))
            pens.append(np.full((1, 1), 1e-6))
            continue
        s = spline_basis(c)
        d = np.diff(np.eye(s.shape[1]), 2, axis=0)
        parts.append(s - s.mean(0))
        pens.append(lam * d.T @ d + 1e-6 * np.eye(s.shape[1]))
    b = np.column_stack([np.ones(len(columns[0])), *parts])
    p = np.full((b.shape[1], b.shape[1]), 0.0)
    at = 1
    for q in pens:
        p[at : at + len(q), at : at + len(q)] = q
        at += len(q)
    return b, p + 1e-9 * np.eye(len(p))


def additive(columns: list[np.ndarray], v: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """Fitted values of a penalised additive model: one spline a column, second-difference penalties."""
    b, p = additive_design(columns, lam)
    return b @ np.linalg.solve(b.T @ b + p, b.T @ v)


def additive_odds(columns: list[np.ndarray], wet: np.ndarray, lam: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Fitted probabilities of a penalised additive logistic model."""
    b, p = additive_design(columns, lam)
    beta = np.zeros(b.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(b @ beta, -20, 20)))
        w = np.maximum(mu * (1 - mu), 1e-6)
        step = np.linalg.solve((b * w[:, None]).T @ b + p, b.T @ (wet - mu) - p @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(b @ beta, -20, 20)))


def gated_amounts(columns: list[np.ndarray], v: np.ndarray, wet: float, least: int = 30) -> np.ndarray:
    """Occurrence by odds, amounts of wet rows by an additive model of log1p, capped at their 99th percentile.

    With fewer than ``least`` wet rows the amount is a linear fit, with fewer
    than a third of that the wet mean; where all or none are wet there is no gate.
    """
    rain = v > wet
    if not rain.any():
        return np.zeros(len(v))
    p = np.ones(len(v)) if rain.all() else additive_odds(columns, rain.astype(float))
    y = np.log1p(v[rain])
    if rain.sum() >= least:
        b, q = additive_design(columns, 1.0)
    elif rain.sum() >= least // 3:
        b = np.column_stack([np.ones(len(v)), *[(c - c.mean()) / max(c.std(), 1e-9) for c in columns]])
        q = 1e-6 * np.eye(b.shape[1])
    else:
        b, q = np.ones((len(v), 1)), np.zeros((1, 1))
    amount = np.expm1(b @ np.linalg.solve(b[rain].T @ b[rain] + q, b[rain].T @ y))
    return np.where(p >= 0.5, np.clip(amount, 0.0, np.quantile(v[rain], 0.99)), 0.0)


def shrunk_profile(z: np.ndarray, v: np.ndarray, region: np.ndarray, shrink: float = 20.0) -> np.ndarray:
    """Elevation profiles of regions, each drawn towards the profile of all by ``shrink`` rows."""
    whole = elevation_profile(z, v)
    out = whole.copy()
    for g in np.unique(region):
        own = region == g
        if own.sum() >= 8:
            out[own] = (own.sum() * elevation_profile(z[own], v[own]) + shrink * whole[own]) / (own.sum() + shrink)
    return out


def others_mean(x: np.ndarray, v: np.ndarray, reach: float) -> np.ndarray:
    """Mean of the other stations' values, weighted by exp(-distance / reach); 0 where all weights vanish.

    Sums are made for each place, in blocks of places, and a station's own value comes off those of its place.
    """
    place, of, count = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    of = of.ravel()
    total = np.bincount(of, v, len(place))
    num, den = np.empty(len(place)), np.empty(len(place))
    for lo, d in place_distances(place):
        w = np.exp(-d / reach)
        w[np.arange(len(d)), np.arange(lo, lo + len(d))] = 0  # the own place follows
        num[lo : lo + len(d)], den[lo : lo + len(d)] = w @ total, w @ count
    alone = count[of] == 1
    return (num[of] + np.where(alone, 0.0, total[of] - v)) / np.maximum(den[of] + count[of] - 1, 1e-9)


def elevation_profile(z: np.ndarray, v: np.ndarray, breaks: int = 2, rounds: int = 20) -> np.ndarray:
    """Piecewise linear profile with robust (soft absolute) weights: fitted values."""
    at = np.quantile(z, np.linspace(0, 1, breaks + 2)[1:-1])
    b = np.column_stack([np.ones_like(z), z, *[np.maximum(0, z - a) for a in at]])
    scale = np.maximum(np.abs(b).max(0), 1e-9)
    w = np.ones(len(z))
    for _ in range(rounds):
        s = np.sqrt(w)[:, None]
        beta = np.linalg.lstsq(b / scale * s, v * s[:, 0], rcond=None)[0]
        res = v - b / scale @ beta
        unit = max(1e-9, 1.4826 * np.median(np.abs(res)))
        w = 1 / np.sqrt(1 + (res / unit) ** 2)
    return b / scale @ beta


def per_time(df: DataFrame, time: str, fit) -> DataFrame:
    """``fit(frame) -> fitted values`` for every time: time, station, observed, fitted."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("station")
        y = g["value"].to_numpy(float)
        return pd.DataFrame({time: g[time].to_numpy(), "station": g["station"].to_numpy(), "observed": y, "fitted": fit(g) if len(g) >= 12 else np.full(len(g), np.nan)})

    return df.groupBy(time).applyInPandas(run, f"{time} long, station long, observed double, fitted double")


# --- grids, trees, clusters ----------------------------------------------------


def divide_distance(basin: np.ndarray) -> np.ndarray:
    """Steps (four neighbours) of every cell to the nearest cell of another basin; -1 if there is none."""
    out = np.full(basin.shape, -1)
    front = np.zeros(basin.shape, bool)
    for axis in (0, 1):
        edge = np.diff(basin, axis=axis) != 0
        low, high = [slice(None)] * 2, [slice(None)] * 2
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        front[tuple(low)] |= edge
        front[tuple(high)] |= edge
    step = 1
    while front.any():
        out[front] = step
        grown = np.zeros_like(front)
        grown[1:] |= front[:-1]
        grown[:-1] |= front[1:]
        grown[:, 1:] |= front[:, :-1]
        grown[:, :-1] |= front[:, 1:]
        front = grown & (out < 0)
        step += 1
    return out


def fill_sinks(z: np.ndarray) -> np.ndarray:
    """Priority-flood: every cell is raised to the lowest level from which it drains to the border."""
    import heapq

    ny, nx = z.shape
    out, seen, heap = z.astype(float).copy(), np.zeros(z.shape, bool), []
    for j in range(ny):
        for i in range(nx):
            if j in (0, ny - 1) or i in (0, nx - 1):
                heapq.heappush(heap, (out[j, i], j, i))
                seen[j, i] = True
    while heap:
        level, j, i = heapq.heappop(heap)
        for b in range(max(0, j - 1), min(ny, j + 2)):
            for a in range(max(0, i - 1), min(nx, i + 2)):
                if not seen[b, a]:
                    seen[b, a] = True
                    out[b, a] = max(out[b, a], level)
                    heapq.heappush(heap, (out[b, a], b, a))
    return out


def basins(filled: np.ndarray) -> np.ndarray:
    """Label of the border cell that each cell drains to by steepest descent (flooded order on flats)."""
    import heapq

    ny, nx = filled.shape
    label, heap = np.full(filled.shape, -1), []
    for j in range(ny):
        for i in range(nx):
            if j in (0, ny - 1) or i in (0, nx - 1):
                label[j, i] = j * nx + i
                heapq.heappush(heap, (filled[j, i], j, i))
    while heap:
        _, j, i = heapq.heappop(heap)
        for b in range(max(0, j - 1), min(ny, j + 2)):
            for a in range(max(0, i - 1), min(nx, i + 2)):
                if label[b, a] < 0:
                    label[b, a] = label[j, i]
                    heapq.heappush(heap, (filled[b, a], b, a))
    return label


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Ward clustering of a small table of points into ``k`` groups (labels by first member)."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        mean = np.array([x[g].mean(0) for g in groups])
        size = np.array([len(g) for g in groups], float)
        d = ((mean[:, None] - mean[None]) ** 2).sum(2) * size[:, None] * size[None] / (size[:, None] + size[None])
        np.fill_diagonal(d, np.inf)
        best = np.unravel_index(np.argmin(d), d.shape)
        a, b = min(best), max(best)
        groups[a] += groups.pop(b)
    out = np.empty(len(x), int)
    for n, g in enumerate(sorted(groups, key=min)):
        out[g] = n
    return out


def synthetic_panel(stations: int = 120, times: int = 24, seed: int = 42) -> pd.DataFrame:
    """A seeded panel with elevation gradient, a smooth field, AR(1) residuals and dry spells."""
    g = np.random.default_rng(seed)
    x, y = g.uniform(0, 100_000, (2, stations))
    elev = np.clip(np.where(np.arange(stations) < stations // 4, g.normal(2200, 600, stations), g.normal(800, 400, stations)), 200, 3500)
    d = np.sqrt((x[:, None] - x[None]) ** 2 + (y[:, None] - y[None]) ** 2)
    chol = np.linalg.cholesky(np.exp(-d / 25_000) + 1e-6 * np.eye(stations))
    res, rows = np.zeros(stations), []
    for t in range(times):
        res = 0.45 * res + np.sqrt(1 - 0.45**2) * (chol @ g.normal(size=stations))
        temp = 15 - 0.0055 * elev + 8 * np.sin(2 * np.pi * t / 24) + 1.5 * res
        wet = chol @ g.normal(size=stations) > 0.18
        rain = np.where(wet, g.gamma(0.8, 8.0, stations), 0.0)
        rows.append(pd.DataFrame({"station": np.arange(stations), "t": t, "x": x, "y": y, "elev": elev, "temp": temp, "precip": rain, "is_heldout": np.argsort(np.argsort(elev)) % 8 == 0, "split": "train" if t < times * 0.67 else "tune" if t < times * 0.84 else "test"}))
    return pd.concat(rows, ignore_index=True)


def self_organising_map(x: np.ndarray, rows: int = 2, cols: int = 2, rounds: int = 40, seed: int = 42) -> np.ndarray:
    """Cell of each point on a small map, trained in batches with a shrinking neighbourhood."""
    g = np.random.default_rng(seed)
    place = np.array([(i, j) for i in range(rows) for j in range(cols)], float)
    gap = ((place[:, None] - place[None]) ** 2).sum(2)
    nodes = x[g.choice(len(x), rows * cols, replace=len(x) < rows * cols)].astype(float)
    for k in range(rounds):
        width = max(rows, cols) / 2 * (0.05 ** (k / rounds)) + 1e-3
        best = ((x[:, None] - nodes[None]) ** 2).sum(2).argmin(1)
        pull = np.exp(-gap[best] / (2 * width**2))
        total = pull.sum(0)[:, None]
        nodes = np.where(total > 1e-9, pull.T @ x / np.maximum(total, 1e-9), nodes)
    return ((x[:, None] - nodes[None]) ** 2).sum(2).argmin(1)


def search_protocol(scores: DataFrame, time: str, parameters: list[str], prefix: int, worse: float, stable: int) -> DataFrame:
    """times, combinations and the median of every parameter over the winners of a search.

    Combinations more than ``worse`` times the best mean score of the first
    ``prefix`` times are dropped.  Of the others each time has a winner; the
    search ends once the most frequent winner has been the same for ``stable``
    times.  Ties go to the smaller parameters.
    """
    from pyspark.sql import Window

    by = F.struct(*parameters)
    at = scores.select(time).distinct().select(time, F.dense_rank().over(Window.orderBy(time)).alias("i"))  # one row a time
    s = scores.join(at, time)
    m = s.filter(F.col("i") <= prefix).groupBy(*parameters).agg(F.round(F.avg("rmse"), 6).alias("m"))
    good = m.join(m.agg(F.min("m").alias("least"))).filter(F.col("m") <= worse * F.col("least")).select(*parameters)
    won = s.join(good, parameters).groupBy("i").agg(F.min_by(by, F.struct("rmse", *parameters)).alias("won"))
    so_far = at.select("i").join(won.select(F.col("i").alias("j"), "won"), F.col("j") <= F.col("i")).groupBy("i", "won").agg(F.count("*").alias("wins"))
    mode = so_far.groupBy("i").agg(F.min_by("won", F.struct((-F.col("wins")).alias("w"), "won")).alias("mode"))
    w = Window.orderBy("i")
    same = F.lit(True)
    for back in range(1, stable):
        same &= F.coalesce(F.lag("mode", back).over(w) == F.col("mode"), F.lit(False))
    last = mode.withColumn("same", same).agg(F.coalesce(F.min(F.when(F.col("same"), F.col("i"))), F.max("i")).cast("long").alias("times"))
    middle = [F.percentile(F.col(f"won.{p}"), 0.5).alias(p) for p in parameters]
    out = won.join(last, F.col("i") <= F.col("times")).groupBy("times").agg(*middle)
    return out.join(good.agg(F.count("*").alias("combinations"))).select("times", "combinations", *parameters)


# --- boosted forecasts ---


def best_stump(x: np.ndarray, e: np.ndarray) -> tuple[int, float, float, float]:
    """Column, threshold and means on either side of the split of ``x`` that explains ``e`` best."""
    order = np.argsort(x, axis=0, kind="stable")
    xs, es = np.take_along_axis(x, order, 0), e[order]
    left = np.cumsum(es, 0)[:-1]
    n = np.arange(1, len(e))[:, None]
    gain = left**2 / n + (es.sum(0) - left) ** 2 / (len(e) - n)
    gain = np.where(xs[1:] > xs[:-1], gain, -np.inf)
    i, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not np.isfinite(gain[i, c]):
        return 0, np.inf, float(e.mean()), 0.0
    return int(c), float((xs[i, c] + xs[i + 1, c]) / 2), float(left[i, c] / (i + 1)), float((es[:, c].sum() - left[i, c]) / (len(e) - i - 1))


def boosted(x: np.ndarray, y: np.ndarray, at: np.ndarray, rounds: int = 40, rate: float = 0.1) -> np.ndarray:
    """Predictions at ``at`` of stumps boosted on squared error."""
    fit, out = np.full(len(y), y.mean()), np.full(len(at), y.mean())
    for _ in range(rounds):
        c, t, low, high = best_stump(x, y - fit)
        fit += rate * np.where(x[:, c] <= t, low, high)
        out += rate * np.where(at[:, c] <= t, low, high)
    return out


def station_forecasts(rows: DataFrame, time: str, features: list[str], label: str, folds: int, least: int = 8) -> DataFrame:
    """station, ``time``, fold, observed, predicted: a model a station, each fold of its times predicted from those before."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        x, y = g[features].to_numpy(float), g[label].to_numpy(float)
        edge = [len(g) * (i + 1) // (folds + 1) for i in range(folds + 1)]
        parts = []
        for i, (a, b) in enumerate(zip(edge, edge[1:])):
            if a >= least and b > a:
                parts.append(pd.DataFrame({"station": g["station"].to_numpy()[a:b], time: g[time].to_numpy()[a:b], "fold": i, "observed": y[a:b], "predicted": boosted(x[:a], y[:a], x[a:b])}))
        return pd.concat(parts) if parts else pd.DataFrame({"station": [], time: [], "fold": [], "observed": [], "predicted": []})

    return rows.groupBy("station").applyInPandas(run, f"station long, {time} long, fold int, observed double, predicted double")


# --- similar stations --------------------------------------------------------

#: Stations of a block whose series are compared with another block's at once.
SERIES = 512


def haversine_km(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 6371.0 * 2 * np.arcsin(np.sqrt(a))


def similar_stations(series: DataFrame, weights: dict[str, tuple[float, float, float, int]], least: int, blocks: int) -> DataFrame:
    """weighting, station, other, n, score: for each station of a block its best others of another block, by every weighting.

    series: station, lat, lon, elev, days and values (arrays of one length).
    weights: name -> weight of kilometres, metres of elevation and 1 -
    correlation on common days (at least ``least``), and how many others; a
    weighting without correlation takes all others.  Common days, sums and
    products of all pairs of two blocks are matrix products, so pairs never
    become rows; only the best of each block do.
    """
    cols = ["station", "lat", "lon", "elev", "days", "values"]
    own = F.pmod(F.xxhash64("station"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = series.select(*cols).withColumn("bi", own).withColumn("bj", every)
    b = series.select(*cols).withColumn("bj", own).withColumn("bi", every)
    b = b.select(*[F.col(c).alias(f"{c}2") for c in b.columns])

    def matrix(t: pa.Table, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        has, v = np.zeros((t.num_rows, len(days))), np.zeros((t.num_rows, len(days)))
        for i, (d, x) in enumerate(zip(t.column("days").to_pylist(), t.column("values").to_pylist())):
            at = np.searchsorted(days, d)
            has[i, at], v[i, at] = 1.0, x
        return has, v

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.sort_by("station"), y.rename_columns([c[:-1] for c in y.column_names]).sort_by("station")
        days = np.unique(np.concatenate([np.array(d, np.int64) for t in (x, y) for d in t.column("days").to_pylist()] or [np.zeros(0, np.int64)]))
        (hx, vx), (hy, vy) = matrix(x, days), matrix(y, days)
        n = hx @ hy.T
        sx, sy, many = vx @ hy.T, hx @ vy.T, np.maximum(n, 1)
        cov = vx @ vy.T - sx * sy / many
        var = np.maximum((vx**2) @ hy.T - sx**2 / many, 0) * np.maximum(hx @ (vy**2).T - sy**2 / many, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = np.where(var > 1e-18, cov / np.sqrt(var), np.nan)
        place = [[t.column(c).to_numpy().astype(float) for c in ("lat", "lon", "elev")] for t in (x, y)]
        (la, lo, el), (la2, lo2, el2) = place
        km = haversine_km(la[:, None], lo[:, None], la2[None], lo2[None])
        rise = np.abs(el[:, None] - el2[None])
        ids, others = x.column("station").to_numpy(), y.column("station").to_numpy()
        out = {c: [] for c in ("weighting", "station", "other", "n", "score")}
        for name, (wk, we, wc, k) in weights.items():
            score = wk * km + we * rise + (wc * (1 - corr) if wc else 0.0)
            score = np.where((n >= least) if wc else True, score, np.nan)
            score = np.floor((score + 1e-7) * 1e4 + 0.5) / 1e4
            score[ids[:, None] == others[None]] = np.nan
            for i in range(len(ids)):
                ok = np.flatnonzero(np.isfinite(score[i]))
                best = ok[np.lexsort([others[ok], score[i, ok]])][:k]
                for c, v in (("weighting", [name] * len(best)), ("station", [ids[i]] * len(best)), ("other", others[best]), ("n", n[i, best].astype(int)), ("score", score[i, best])):
                    out[c] += list(v)
        schema = pa.schema([("weighting", pa.string()), ("station", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])
        return pa.table(out, schema=schema)

    pairs = a.groupBy("bi", "bj").cogroup(b.groupBy("bi2", "bj2"))
    return pairs.applyInArrow(run, "weighting string, station long, other long, n long, score double")

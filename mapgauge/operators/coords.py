"""Coordinates from distances: alignment and scaling, one group at a time in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.functions.geo import vincenty_km


def align(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """M5: rotation, translation and scale that bring points x to y: rotation from the singular vectors of the covariance,
    scale its trace over that of x; there is no guard against reflections."""
    mx, my = x.mean(0), y.mean(0)
    a, b = x - mx, y - my
    c = a.T @ b
    u, _, vt = np.linalg.svd(c)
    r = vt.T @ u.T
    s = float(np.trace(c) / np.trace(a.T @ a))
    return r, my - s * (r @ mx), s


def smacof(d: np.ndarray, start: np.ndarray, rounds: int = 30000, eps: float = 1e-5, metric: bool = True) -> np.ndarray:
    """Multidimensional scaling of a distance matrix by majorisation, from a given start. metric=False replaces distances
    by the monotone fit to their order."""
    n, x, last = len(d), start.astype(float).copy(), None
    up = np.triu_indices(n, 1)
    order = np.argsort(d[up], kind="stable")
    for _ in range(rounds):
        now = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        goal = d
        if not metric:
            v = now[up]
            fit = np.empty_like(v)
            fit[order] = _monotone(v[order])
            fit *= np.sqrt((n * (n - 1) / 2) / max(1e-300, (fit**2).sum()))
            goal = np.zeros_like(d, dtype=float)
            goal[up] = fit
            goal += goal.T
        stress = ((now - goal) ** 2).sum() / 2
        ratio = goal / np.where(now == 0, 1e-5, now)
        b = -ratio
        b[np.arange(n), np.arange(n)] += ratio.sum(1)
        x = b @ x / n
        size = np.sqrt((x**2).sum(1)).sum()
        if last is not None and last - stress / max(size, 1e-300) < eps:
            break
        last = stress / max(size, 1e-300)
    return x


def _monotone(y: np.ndarray) -> np.ndarray:
    """Least-squares fit that never falls, by pooling neighbours."""
    out: list[list[float]] = []
    for v in y.tolist():
        out.append([v, 1])
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            b, a = out.pop(), out.pop()
            n = a[1] + b[1]
            out.append([(a[0] * a[1] + b[0] * b[1]) / n, n])
    return np.concatenate([np.full(int(n), v) for v, n in out])


def recover(names: list, d: np.ndarray, points: np.ndarray, metric: bool = True, asymmetric: bool = False, similarity: bool = False) -> list[tuple]:
    """M6: every place in turn is held out: places are scaled from their distances, starting at the known points and
    their centre for the held-out one, aligned on the known ones, and the held-out one's error in km is taken."""
    d = d.astype(float)
    if asymmetric:
        d = d + d.T
    if similarity:
        with np.errstate(divide="ignore"):
            d = 1 / d
        d[np.isinf(d)] = 2
        np.fill_diagonal(d, 0)
    out = []
    for k in range(len(names)):
        at = [i for i in range(len(names)) if i != k] + [k]
        known = points[at[:-1]]
        x = smacof(d[np.ix_(at, at)], np.vstack([known, known.mean(0)]), metric=metric)
        r, t, s = align(x[:-1], known)
        got = (r @ (s * (x - x.mean(0))).T).T + t
        lat, lon = got[-1]
        err = float(vincenty_km([min(90, max(-90, lat))], [lon], [points[k, 0]], [points[k, 1]])[0])
        out.append((names[k], float(points[k, 0]), float(points[k, 1]), float(lat), float(lon), err))
    return out


def recover_by_group(pairs: DataFrame, places: DataFrame, group: str, most: int = 500, **options) -> DataFrame:
    """M7: recover() for each group (division). pairs: group, a, b, d; places: group, name, lat, lon. A group's matrix is in
    one task; more than `most` places in a group is an error, for the work is that number cubed."""

    def run(key, p, q):
        q = q.sort_values("name")
        names = q["name"].tolist()
        if len(names) > most:
            raise ValueError(f"{len(names)} places in group {key[0]}; the limit is {most}")
        if len(names) < 3:
            return pd.DataFrame(columns=["group", "name", "lat", "lon", "pred_lat", "pred_lon", "err_km"])
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for a, b, v in zip(p["a"], p["b"], p["d"], strict=True):
            if a in at and b in at:
                d[at[a], at[b]] = v
        rows = recover(names, d, q[["lat", "lon"]].to_numpy(float), **options)
        return pd.DataFrame([(str(key[0]), *r) for r in rows], columns=["group", "name", "lat", "lon", "pred_lat", "pred_lon", "err_km"])

    kind = "group string, name string, lat double, lon double, pred_lat double, pred_lon double, err_km double"
    left = pairs.select(F.col(group).alias("_ga"), "a", "b", "d")
    right = places.select(F.col(group).alias("_gb"), "name", "lat", "lon")
    return left.groupBy("_ga").cogroup(right.groupBy("_gb")).applyInPandas(run, kind)


def align_by_group(df: DataFrame, group: str, x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """M5 for each group, from sums alone: the covariance and means come from one aggregate. The rotation that singular vectors
    give of a 2 by 2 covariance is its polar factor, which has a closed form, so no group's rows are gathered and
    nothing leaves the JVM. Null where the points do not spread."""
    n = F.count(F.lit(1))
    cov = [(F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n).alias(f"c{i}{j}") for i, a in enumerate(x) for j, b in enumerate(y)]
    var = sum((F.sum(F.col(a) * F.col(a)) - F.sum(a) * F.sum(a) / n) for a in x)
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate((*x, *y))]
    sums = df.groupBy(group).agg(n.alias("n"), *cov, var.alias("v"), *means)
    a, b, c, d = (F.col(k) for k in ("c00", "c01", "c10", "c11"))
    turned = a * d - b * c >= 0  # else a reflection
    p, q = F.when(turned, a + d).otherwise(a - d), F.when(turned, c - b).otherwise(c + b)
    long = F.sqrt(p * p + q * q)
    out = sums.withColumn("r00", F.try_divide(p, long)).withColumn("r01", F.try_divide(q, long))
    out = out.withColumn("r10", F.when(turned, -F.col("r01")).otherwise(F.col("r01"))).withColumn("r11", F.when(turned, F.col("r00")).otherwise(-F.col("r00")))
    out = out.withColumn("s", F.try_divide(a + d, F.col("v")))
    at = lambda i, j, m: F.col(m) - F.col("s") * (F.col(i) * F.col("m0") + F.col(j) * F.col("m1"))
    return out.select(group, "n", "r00", "r01", "r10", "r11", at("r00", "r01", "m2").alias("tx"), at("r10", "r11", "m3").alias("ty"), "s")

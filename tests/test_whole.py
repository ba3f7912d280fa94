"""Queries without SQL over whole series, against plain loops over every event."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from chronoweft.plans import registry
from chronoweft.plans.fit_queries import _OB, _PO, _PR, _SO, _SR

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_series(spark, tmp_path_factory):
    """Events of one user and type with 130 events, and one with three."""
    rnd = np.random.default_rng(4)
    rows = [Row(event_id=1000 * u + i, user_id=u, event_type=f"type{u}", i=i, value=float(rnd.integers(0, 5000)) / 100) for u, n in ((1, 130), (2, 3)) for i in range(n)]
    path = str(tmp_path_factory.mktemp("series"))
    df = spark.createDataFrame(rows).selectExpr("event_id", "user_id", "event_type", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, i, 0) AS ts", "value")
    df.write.parquet(f"{path}/events.parquet")
    by = defaultdict(list)
    for r in rows:
        by[r.user_id].append(round(r.value * 100))
    return path, by


def kalman(v):
    """Filtered and smoothed states and covariances by matrices."""
    f, q = np.array([[1, 1], [0, 1]]), np.array([[_SO**2 + _SR**2 / 3, _SR**2 / 2], [_SR**2 / 2, _SR**2]])
    x, p, made = np.array([0.25, 0.001]), np.diag([_PO**2, _PR**2]), []
    for i, value in enumerate(v):
        if i:
            x, p = f @ x, f @ p @ f.T + q
        px, pp = x, p
        k = p[:, 0] / (p[0, 0] + (_OB / ((value % 10 + 1) / 11)) ** 2)
        x, p = x + k * (value / 1e4 - x[0]), p - np.outer(k, p[0])
        made.append((x, p, px, pp))
    smooth = [made[-1][:2]]
    for (x, p, _, _), (_, _, nx, np_) in zip(made[-2::-1], made[:0:-1]):
        g = p @ f.T @ np.linalg.inv(np_)
        sx, sp = smooth[-1]
        smooth.append((x + g @ (sx - nx), p + g @ (sp - np_) @ g.T))
    return [m[:2] for m in made], smooth[::-1]


def test_states_of_every_event(spark, long_series):
    path, by = long_series
    for name, which in (("kalman_forward", 0), ("rts_smooth", 1)):
        got = {(r.track, r.n): (r.offset, r.rate, r.p00, r.p01, r.p11) for r in registry.QUERIES[name](spark, path).collect()}
        want = {(u, n): (*x, p[0, 0], p[0, 1], p[1, 1]) for u, v in by.items() for n, (x, p) in enumerate(kalman(v)[which])}
        assert set(got) == set(want)
        assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)
    for r in registry.QUERIES["uncertainty_summary"](spark, path).collect():
        sd = [1e3 * p[0, 0] ** 0.5 for _, p in kalman(by[r.track])[0]]
        assert np.allclose((r.median_offset_std_ms, r.max_offset_std_ms), (np.median(sd), max(sd)), atol=2e-5)


def test_knots_of_every_event(spark, long_series):
    path, by = long_series
    got = defaultdict(list)
    for r in registry.QUERIES["knot_decimation"](spark, path).orderBy("track", "n").collect():
        got[r.track].append((round(r.t, 6), r.y))
    for u, v in by.items():
        points, kept = sorted((i * 1.5 + x % 7 / 10, float(x)) for i, x in enumerate(v)), []
        for p in points:
            if not kept or p[0] - kept[-1][0] >= 4:
                kept.append(p)
        if kept[-1] != points[-1]:
            kept[-1 if points[-1][0] - kept[-1][0] < 4 and len(kept) > 1 else len(kept) :] = [points[-1]]
        assert got[u] == [(round(t, 6), y) for t, y in kept]

"""Intervals, rates and clips from the whole length of each series, by plain loops."""

from collections import defaultdict

import numpy as np
import pytest

from chronoweft.functions import signal
from chronoweft.plans import registry
from chronoweft.sources.tables import type_series, user_series

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def series(spark):
    out = []
    for bound in (user_series, type_series):
        by = defaultdict(list)
        for r in bound(spark, DATA).orderBy("track", "idx").collect():
            by[r.track].append(r.v)
        out.append(by)
    return out


def test_every_event_asks_and_every_segment_has_a_rate(spark, series):
    users, _ = series
    assert max(map(len, users.values())) > 10
    got = {(r.track, r.k): r.overlap_ratio for r in registry.QUERIES["overlap_ratio"](spark, DATA).collect()}
    assert set(got) == {(u, k) for u, v in users.items() for k in range(len(v))}
    for u in sorted(users)[:20]:
        solid = []
        for i, v in enumerate(users[u]):
            a, b = i * 60.0, i * 60.0 + v / 100
            if solid and a <= solid[-1][1]:
                solid[-1][1] = max(solid[-1][1], b)
            else:
                solid.append([a, b])
        for k in range(len(users[u])):
            x, y = k * 400.0, k * 400.0 + 250
            want = min(1.0, sum(max(0.0, min(y, b) - max(x, a)) for a, b in solid) / 250)
            assert abs(got[u, k] - want) < 2e-6
    got = {(r.track, r.segment): r.rate for r in registry.QUERIES["segment_rates"](spark, DATA).collect()}
    want = {(u, k): 1 + sum(v[1 : k + 1]) / 1e6 for u, v in users.items() if len(v) > 1 for k in range(len(v))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_clips_to_the_end(spark, series):
    _, types = series
    flat = {(r.track, r.k): r.spectral_flatness for r in registry.QUERIES["spectral_flatness"](spark, DATA).collect()}
    snr = {(r.track, r.k): r.snr_db for r in registry.QUERIES["local_snr"](spark, DATA).collect()}
    keys = {(t, k) for t, v in types.items() for k in range((len(v) - 1) // 200 + 1)}
    assert max(k for _, k in keys) > 2 and set(flat) == set(snr) == keys
    for t, k in keys:
        v = np.array(types[t])
        clip, a, b = v[200 * k : 200 * k + 128], 200 * k + 50, 200 * k + 90
        if len(clip) == 128:
            assert abs(flat[t, k] - signal.flatness(clip)) < 2e-6
        if b < len(v):
            level = lambda x: max(np.sqrt(np.mean(x * x) + 1e-18), 1e-9)
            assert abs(snr[t, k] - 20 * np.log10(level(v[a:b]) / level(v[[a - 1, b]]))) < 2e-6

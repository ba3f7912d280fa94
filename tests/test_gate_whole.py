"""The gate gives a verdict on every order, as plain Python does."""

from chronoweft.plans import registry
from chronoweft.plans.match_queries import SAFE

DATA = "/root/testdata/sf0.001"


def test_every_order_has_its_verdict(spark):
    got = {r.o_orderkey: (r.accepted, r.objections) for r in registry.QUERIES["fallback_gate"](spark, DATA).collect()}
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    assert set(got) == {r.o_orderkey for r in orders} and any(k % 89 == 44 for k in got)
    for k, c in orders:
        fb, conf, margin = k % 89 / 88, c % 101 / 100, k % 31 / 100 if c % 4 else None
        why = []
        if fb < SAFE.coarse_fallback_min_confidence:
            why.append(f"confidence {fb:.3f} is below 0.500")
        if margin is not None and margin < SAFE.coarse_fallback_min_peak_margin:
            why.append(f"peak margin {margin:.3f} is below 0.100")
        ahead = fb - conf >= SAFE.coarse_fallback_confidence_margin
        if not ahead:
            why.append(f"gain over the anchors {fb - conf:.3f} is below 0.150")
        accepted = fb >= 0.5 and (margin is None or margin >= 0.1) and (ahead or conf < 0.25)
        assert got[k] == (accepted, "; ".join(why)), k

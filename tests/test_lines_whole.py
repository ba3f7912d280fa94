"""Every line item is an observation."""

from chronoweft.plans import registry
from chronoweft.sources.tables import observations

DATA = "/root/testdata/sf0.001"


def test_every_line_is_a_match(spark):
    o = spark.read.parquet(f"{DATA}/orders.parquet")
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    owned = li.join(o, li.l_orderkey == o.o_orderkey)
    got = observations(spark, DATA)
    ids = [r.match_id for r in got.select("match_id").collect()]
    assert len(ids) == owned.count() and len(set(ids)) == len(ids)
    value = lambda df, q: sorted((r[0], r[1], round(r[2] * 50)) for r in df.select(*q).collect())
    assert value(got.selectExpr("shiftright(match_id, 20) k", "track", "confidence"), ("k", "track", "confidence")) == value(
        owned.selectExpr("o_orderkey k", "o_custkey % 40 track", "l_quantity / 50.0 confidence"), ("k", "track", "confidence")
    )


def test_orders_without_line_one_count(spark, tmp_path):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    li.where("l_linenumber <> 1").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    assert registry.QUERIES["model_selection_linear"](spark, str(tmp_path)).count() > 0
    assert registry.QUERIES["track_report"](spark, str(tmp_path)).count() > 0

"""Series, intervals and observations bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date"))
    return days * F.lit(86400.0) + F.hour(ts) * F.lit(3600.0) + F.minute(ts) * F.lit(60.0) + F.extract(F.lit("SECOND"), ts).cast("double")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, idx, v): each user's events in order, values in whole hundredths."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "ts", "event_id", F.rint(F.col("value") * 100).alias("v"))
    return numbered(e, "track", ["ts", "event_id"]).select("track", "idx", "v")


def type_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, idx, v): the same by event type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "ts", "event_id", F.rint(F.col("value") * 100).alias("v"))
    return numbered(e, "track", ["ts", "event_id"]).select("track", "idx", "v")


def observations(spark: SparkSession, sf_dir: str, tracks: int = 40) -> DataFrame:
    """Matches (track, match_id, local_start, ..., confidence), one for each line item that has its order.

    A track is a class of customers and local time the order's day number; the
    reference runs 200 ppm fast, with a scatter from the part's number and a jump
    for one supplier in seventeen; the quantity gives the confidence.  A match's
    id is made of the order's key and the line's place in the order.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_suppkey", place.alias("place"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    x = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    jump = F.when(F.col("l_suppkey") % 17 == 0, 0.8).otherwise(0.0)
    y = F.lit(0.75) + F.lit(1.0002) * x + (F.col("l_partkey") % 11 - 5) * F.lit(0.004) + jump
    return j.select(
        (F.col("o_custkey") % tracks).alias("track"),
        (F.shiftleft(F.col("o_orderkey").cast("long"), 20) + F.col("place")).alias("match_id"),
        x.alias("local_start"),
        (x + 1.0).alias("local_end"),
        y.alias("master_start"),
        (y + 1.0).alias("master_end"),
        (F.col("l_quantity") / 50.0).alias("confidence"),
    )


#: The same bindings for the SQL side.
USER_SERIES_SQL = "s AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, round_even(value * 100, 0) AS v FROM events)"
TYPE_SERIES_SQL = "s AS (SELECT event_type AS track, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, round_even(value * 100, 0) AS v FROM events)"
_X_SQL = "CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"
_Y_SQL = f"0.75::DOUBLE + 1.0002::DOUBLE * {_X_SQL} + (l_partkey % 11 - 5) * 0.004::DOUBLE + CASE WHEN l_suppkey % 17 = 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END"
OBSERVATIONS_SQL = f"""m AS (SELECT o_custkey % 40 AS track, (CAST(o_orderkey AS BIGINT) << 20) + place AS match_id,
  {_X_SQL} AS local_start, {_X_SQL} + 1.0::DOUBLE AS local_end,
  {_Y_SQL} AS master_start, {_Y_SQL} + 1.0::DOUBLE AS master_end, l_quantity / 50.0::DOUBLE AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey)"""

"""Helpers that the training-data operators share.

Intermediate results are cut from their lineage by writing them as Parquet
under the shared folder that ``spark.checkpoint.dir`` names, so that a lost
executor costs a re-read and not a recomputation.  Only where that setting is
absent and executors share the driver's disk (tests, a laptop) a folder of our
own is used.  Tables that later steps don't read are dropped as soon as they are
done; those that a lazy result still reads go with :func:`release`, or when the driver ends.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches for Python stages hold this many rows, so that a batch of
#: very long texts stays within a worker's memory.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._tables = [path]
    return out


def holding(df: DataFrame, *read: DataFrame) -> DataFrame:
    """``df``, a lazy result, with a note of the tables that it reads."""
    df._tables = [p for x in read for p in getattr(x, "_tables", [])]
    return df


def release(*done: DataFrame) -> None:
    """Remove the tables of :func:`staged` or :func:`holding` that nothing reads any more."""
    for df in done:
        for path in getattr(df, "_tables", []):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(taken: list[str], base: str) -> str:
    """``base``, or ``base_1`` ..., whichever no column of ``taken`` has."""
    low = {c.lower() for c in taken}
    name, n = base, 0
    while name.lower() in low:
        n += 1
        name = f"{base}_{n}"
    return name


def fresh_all(taken: list[str], *bases: str) -> list[str]:
    """A :func:`fresh` name for each of ``bases``, all different."""
    out: list[str] = []
    for b in bases:
        out.append(fresh([*taken, *out], b))
    return out


def hashed_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Rows of ``df`` with the ``n`` smallest distinct hashes of ``key``, one row for each hash.

    Only hashes are sorted; the rows themselves are filtered where they lie, so no
    task gathers more than ``n`` of them however many partitions there are.
    """
    h = fresh(df.columns, "h")
    rows = df.withColumn(h, F.xxhash64(key))
    top = rows.select(h).distinct().orderBy(h).limit(n).agg(F.max(h)).first()[0]
    if top is None:
        return df.limit(0)
    one = F.min(F.struct(*df.columns)).alias("row")
    return rows.where(F.col(h) <= top).groupBy(h).agg(one).select("row.*")


def min_labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """For ``n`` nodes and links a-b, the smallest node each can reach."""
    root = np.arange(n) if start is None else start.copy()
    if len(a) == 0:
        return root
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return root


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links ``(u, v)`` of type long.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until
    every link points at the smallest node of its component; returns
    ``(node, root)`` for every node that has a link to another.  Each round
    aggregates minima before it joins, so a hub's links are never gathered in
    one task, and AQE splits a hub's share of the join.  Links stay in Spark.
    """
    now = staged(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        links, nodes = now.agg(F.count("*"), F.countDistinct("u")).first()
        # Once every node has one link and no target has a link, all are stars.
        if links == nodes and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            now.withColumnRenamed("u", "w")
            .withColumnRenamed("v", "u")
            .join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = staged(small, "links")
        release(now)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    return holding(now.select(F.col("u").alias("node"), F.col("v").alias("root")), now)

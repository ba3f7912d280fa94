"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def _probe(batches):
    import importlib.util

    for b in batches:
        found = importlib.util.find_spec("chronoweft") is not None
        yield pa.RecordBatch.from_arrays([pa.array([found] * b.num_rows)], names=["found"])


# The probe must travel by value: a worker that can't import this module couldn't load it by name.
_probe.__module__ = "__main__"


def ship(spark: SparkSession) -> bool:
    """Make the package importable in Python workers; whether it had to be sent.

    On one machine they get this folder on their path.  On a cluster where they
    can't import the package (not installed, no shared folder) it is sent once in
    a session, as a zip through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return False
    _shipped.add(sc.applicationId)
    if sc.master.startswith("local[") or sc.master == "local":
        env = sc.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
        return False
    if all(r["found"] for r in spark.range(1).mapInArrow(_probe, "found boolean").collect()):
        return False
    path = os.path.join(tempfile.mkdtemp(), "chronoweft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "chronoweft")):
            for n in names:
                if n.endswith((".py", ".json")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(path)
    return True

"""A folder for databases that live as long as a query: in spark.checkpoint.dir, or a local one where that is unset."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a shared folder")
    own = tempfile.mkdtemp(prefix=f"siltstone-{name}-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"

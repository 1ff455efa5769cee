"""A folder for tables that a query makes and reads again.

It lies in the folder that ``spark.checkpoint.dir`` names, which driver and executors
share; where the setting is unset only a local master is served, with a temporary
folder of this process.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local() -> str:
    folder = tempfile.mkdtemp(prefix="tamarack-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch(spark: SparkSession) -> str:
    """A new path that nothing has been written to."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or _local()).rstrip('/')}/tamarack-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table: what is made of it doesn't make it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables that are made once and read again, in the store that all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the store that spark.checkpoint.dir names; on one machine a temporary folder will do."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="massgrid-")
    return f"{base.rstrip('/')}/massgrid/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own: what makes them runs once, and lost executors cost only their share."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

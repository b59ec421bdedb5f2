"""Cutting a plan: write an intermediate table once instead of computing it again for every later use."""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a single-process master may fall back to a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def staged_path(spark) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/barflow-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: columns stay prunable, lost executors cost nothing."""
    spark, path = df.sparkSession, staged_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""The shared folder of the cluster, and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_uri(spark: SparkSession) -> str:
    """Where the cluster keeps what all executors must see.

    Read from ``spark.checkpoint.dir``; only where that is unset and the driver is
    the one executor (tests) a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes see")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes and rows that go to a Python worker at once; held several times over on both sides.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, for whose texts the session sends batches of bounded bytes to Python.

    Settings that the cluster names itself stay.
    """
    named = df.sparkSession.sparkContext.getConf()
    for key, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        if not named.contains(f"spark.sql.execution.arrow.{key}"):
            df.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return df


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_uri(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The path of a shared folder that every node mounts."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"this operator maps files into memory and needs a shared folder that nodes mount, not {parts.scheme}://")
    return parts.path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

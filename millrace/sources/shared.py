"""Where intermediate and output tables of a job may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base: str | None = None


def shared_folder(spark: SparkSession, label: str) -> str:
    """Return a new path under the folder the cluster shares between its nodes.

    The folder is the one named by ``spark.checkpoint.dir``. Only a local-mode
    session may do without it; a cluster job without a shared folder is an
    error, because its executors could not read each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_folder(spark)
    return f"{base.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"


def _local_folder(spark: SparkSession) -> str:
    global _local_base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="millrace-")
    return _local_base

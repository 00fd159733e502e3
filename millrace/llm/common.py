"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage and keeps costly results (one pass over all texts) from
    being computed for each of their uses; every executor can read the files.
    """
    path = shared_folder(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder for raw files in the shared folder, as a URI that names its file system.

    A path without a scheme lies on Spark's default file system, which need not
    be the local one that ``pyarrow.fs`` would take it for.
    """
    jvm, path = spark.sparkContext._jvm, shared_folder(spark, f"llm-{label}")
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs or a plain path) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """Open a file under a name no other attempt of the task takes.

    Readers learn names from the rows of attempts that succeeded, so files of a
    lost or repeated attempt are never read.
    """
    uri = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, fs.open_output_stream(path, compression=None)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker; for what is costly to load."""
    return sys.modules["__main__"].__dict__.setdefault("_millrace_state", {})


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()

"""Files that tasks write and read in the shared folder, by any scheme that pyarrow knows (file, hdfs,
s3, gs, abfs). Each attempt of a task writes a name of its own; what counts is what the settled
table of names lists, so a lost or repeated attempt leaves a file that nobody reads."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def fresh(folder: str, kind: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}.{kind}"


def writer(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None, buffer_size=1 << 20)


def reader(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def folder(spark: SparkSession, path: str) -> str:
    """A path as a URI that tasks open: one without a scheme is in the store that Spark's own paths without one are in, and
    Spark's names of S3 (s3a, s3n) are pyarrow's s3."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString() if "://" not in path else path
    return task_uri(uri)


def task_uri(uri: str) -> str:
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return "file://" + "/" + rest.lstrip("/")
    return f"s3:{rest}" if scheme in ("s3a", "s3n") else uri

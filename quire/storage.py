"""The shared folder: where lineage is cut, and files that all machines reach."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach, as the session's spark.checkpoint.dir names it.

    Where that setting is absent, a local session (tests, a laptop) gets a folder of its own; on a
    cluster that folder would be another one on every machine, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir isn't set: name a folder that all machines share")
            at = tempfile.mkdtemp(prefix="quire-shared-")
        sc.setCheckpointDir(at)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def new_folder(spark: SparkSession, what: str) -> str:
    """The URI of a folder, not yet made, in the shared folder. It is of this session: all of them go when its
    driver ends."""
    sc = spark.sparkContext
    home = getattr(sc, "quire_home", None)
    if home is None:
        home = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(home)
        where = path.getFileSystem(sc._jsc.hadoopConfiguration())
        where.mkdirs(path)
        where.deleteOnExit(path)
        sc.quire_home = home
    return f"{home}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and free of their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows of df in four tasks a core, by the columns of key, for steps that cost far more than moving the rows:
    a table of short rows is else read by one task or two, however long the step takes for each row."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, 16), *key)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written to the shared folder as Parquet, so that readers take the columns they need."""
    at = new_folder(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def put(uri: str, content: bytes) -> None:
    """Writes a file whole or not at all: by another name first. uri is a path or has a scheme that pyarrow knows."""
    where, path = _place(uri)
    if folder := path.rpartition("/")[0]:
        where.create_dir(folder, recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        f.write(content)
    where.move(part, path)


def get(uri: str) -> bytes:
    where, path = _place(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder, on any file system that Spark knows; one that isn't there is fine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

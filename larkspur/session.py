"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("larkspur")
    for name, value in settings.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder. On a cluster a machine-local
    folder would be lost with its machine, so there a missing setting is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; every call gives another one."""
    return f"{shared_folder(spark)}/larkspur/{uuid.uuid4().hex}/{name}"


def shared_files(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder for files that tasks write themselves, as a URI."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; works in any task."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_file(uri: str, suffix: str) -> tuple[pafs.FileSystem, str]:
    """A file name that no other attempt of the same task uses, in a folder that exists."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    return system, f"{folder}/{uuid.uuid4().hex}{suffix}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that outlives executors, lets later passes read single columns, and
    tells the optimiser the true size of the data when it picks a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of intermediate tables of :func:`materialise` that nothing reads any more."""
    for df in frames:
        spark, files = df.sparkSession, df.inputFiles()
        own = f"{shared_folder(spark)}/larkspur/".split(":", 1)[-1].replace("//", "/")
        for name in {f.rsplit("/", 1)[0] for f in files}:
            if own not in name.replace("//", "/"):
                raise ValueError(f"{name} is no intermediate table")
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

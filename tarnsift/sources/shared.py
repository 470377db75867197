"""The folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a temporary folder if all runs on one machine; on a cluster that
    would be a folder of each machine, so it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named or f"file://{tempfile.gettempdir()}/tarnsift-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarnsift-{name}-{uuid.uuid4().hex}"


#: Paths stored inside each open `scratch`.
_scratch: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were stored inside it, for a caller that has written by then what reads them."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            _delete(spark, path)


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, lost executors cost no rework, and what follows
    may read it many times. instead_of: a table stored before that nothing reads from now on; its folder is deleted. keep: the
    table outlives the `scratch` it is stored in."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    if instead_of is not None:
        discard(instead_of)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a stored table that nothing reads from now on."""
    for old in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, old)

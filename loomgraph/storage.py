"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/checkpoints/loomgraph"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """``df`` as a new table in the shared folder: its path, and the table."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table and reads it again, so that lost executors lose nothing."""
    return written(df, label)[1]


def _place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _place(spark, path)
    return fs.exists(found)


def states(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of change of the files at each path (of a folder: those in it)."""
    out = []
    for path in paths:
        found, fs = _place(spark, path)
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(found)] if fs.exists(found) else [(path, None, None)]
    return tuple(out)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; a cluster gets it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root

"""Tables at rest in the folder that all executors share: what is used more than once is computed once, its lineage ends
there, and a lost executor costs only what comes after."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master, where all tasks share one machine, may leave it unset and gets a temporary
    folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="codexspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def staged(rows: DataFrame, label: str, release: bool = False) -> DataFrame:
    """rows written as Parquet under a name of their own and read again. With `release` the driver's garbage is collected
    afterwards, so that Spark deletes the shuffle files that led to them."""
    spark, schema = rows.sparkSession, rows.schema
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    del rows
    if release:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables. Only for those that no later result is computed from: their successors must be at rest."""
    for rows in tables:
        path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.staged_path)
        path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_FIXED: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, source: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A staged table that is made once for each application and source, as files that lie there would be."""
    key = (spark.sparkContext.applicationId, source, label)
    rows = _FIXED.get(key)
    if rows is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.staged_path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return rows
    _FIXED[key] = staged(make(), label)
    return _FIXED[key]

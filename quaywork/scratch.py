"""Tables written between the steps of a job, so that what follows plans over a scan and a lost executor costs a re-read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "quaywork-"
#: Tables that were written and not removed yet.
_paths: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a temporary folder if Spark runs in one process, as in tests; on a cluster that is an error, for executors
    wouldn't see it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix=PREFIX)
        spark.sparkContext.setCheckpointDir(known)
    return known


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table of its own in the shared folder, read back."""
    spark = rows.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"
    _paths.append(path)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def written_paths() -> list[str]:
    """Folders of the tables that exist now."""
    return list(_paths)


def remove_written(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables; no DataFrame that reads them may be used afterwards."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _paths.remove(path)

"""Small Spark helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_PREFIX = "quaywork-llm-"
#: Most bytes of the batches that tasks hand to Python while a scratch table is written; texts may be long.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: Scratch tables that were written and not removed yet.
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if Spark runs in one process, as in tests; on a cluster that is an error, for
    executors wouldn't see it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix=SCRATCH_PREFIX)
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the table, never a re-run of what made it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{SCRATCH_PREFIX}{uuid.uuid4().hex}"
    _written.append(path)
    usual = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, usual)
    return spark.read.schema(df.schema).parquet(path)


def written_tables() -> list[str]:
    """Paths of the scratch tables that exist now."""
    return list(_written)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables; no DataFrame that reads them may be used afterwards."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_fold(column: str, folds: int):
    """crc32 of the value as text, modulo ``folds``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds

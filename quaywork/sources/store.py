"""A store of the two fact tables by version: whole tables are replaced at once, and the last replacement can be undone.

Every version's tables are Parquet folders that are never changed; a log with one row a version says which folders it has.
A version exists from the moment its log row does, so readers see whole versions only. The row is moved to a folder named after its
version, which fails where that exists: of two writers of one version the second is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("inventory", "shipments")
LOG = "version long, inventory string, shipments string, undoable boolean"


class StaleUndo(Exception):
    """The version to undo isn't the current one, or has nothing before it to go back to."""


class SecondWriter(Exception):
    """Another writer made this version first; nothing was changed."""


class VersionedStore:
    """A store in the folder ``path``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list:
        try:
            log = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{self.path}/log")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return log.orderBy(F.desc("version")).limit(2).collect()  # the current version and the one before

    def _append(self, version: int, folders: dict[str, str | None], undoable: bool) -> int:
        row = self.spark.createDataFrame([(version, *[folders.get(t) for t in TABLES], undoable)], LOG)
        made, place = f"{self.path}/new/{uuid.uuid4().hex}", f"{self.path}/log/{version:012d}"
        row.coalesce(1).write.parquet(made)
        self.move(made, place)
        return version

    def exists(self, place: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def move(self, made: str, place: str) -> None:
        """Moves a folder to a new place, all at once or not at all; ``SecondWriter`` if the place is taken."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(place)
        conf = self.spark._jsc.hadoopConfiguration()
        path.getFileSystem(conf).mkdirs(path.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(path.toUri(), conf).rename(hadoop.Path(made), path, options)
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            raise SecondWriter(f"{place.rpartition('/')[2]} was made by another writer") from None

    def version(self) -> int:
        """The current version; 0 before the first replacement."""
        log = self._log()
        return log[0]["version"] if log else 0

    def replace(self, **tables: DataFrame) -> int:
        """Replaces the named tables (``inventory``, ``shipments``) together; others stay. Returns the new version."""
        return self._replace(tables, True)

    def replace_for_good(self, **tables: DataFrame) -> int:
        """``replace`` that can't be undone."""
        return self._replace(tables, False)

    def _replace(self, tables: dict[str, DataFrame], undoable: bool) -> int:
        if not tables or set(tables) - set(TABLES):
            raise ValueError(f"give one or both of {', '.join(TABLES)}")
        log = self._log()
        folders = {t: log[0][t] for t in TABLES} if log else {}
        for name, rows in tables.items():
            folders[name] = f"{self.path}/tables/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(folders[name])
        return self._append(log[0]["version"] + 1 if log else 1, folders, undoable and bool(log))

    def undo(self, version: int) -> int:
        """Takes back the replacement that made ``version``, which has to be the current one. Can't be undone itself."""
        log = self._log()
        if not log or log[0]["version"] != version or not log[0]["undoable"]:
            raise StaleUndo(f"version {version} can't be undone")
        return self._append(version + 1, {t: log[1][t] for t in TABLES}, False)

    def read(self, table: str) -> DataFrame | None:
        """The current rows of a table; None if it never was given."""
        log = self._log()
        return self.spark.read.parquet(log[0][table]) if log and log[0][table] else None


def json_lines(rows: DataFrame) -> DataFrame:
    """One text column ``value`` with a JSON object a row; nulls are written out. Write it with ``write.text``."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))

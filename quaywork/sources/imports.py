"""An import as one act: a file is read, mapped, checked, and replaces a table of the store, or nothing changes."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical as ca
from ..operators import importing as im
from ..operators.snapshot import snapshot_lines, snapshot_sections
from ..scratch import remove_written, written, written_paths
from .formats import FormatRegistry, standard_formats
from .store import TABLES, SecondWriter, VersionedStore

KEYS = {"inventory": (["sku", "warehouse"], 'SKU + warehouse "{} @ {}"'), "shipments": (["shipment_id"], 'shipment ID "{}"')}


@dataclass(frozen=True)
class Imported:
    """What an import did: the new version and its rows; or, with neither, its problems and how many there are."""

    version: int | None
    row_count: int
    problem_count: int
    problems: DataFrame
    ignored: tuple[str, ...] = ()


def columns_of(kind: str, locations: DataFrame) -> list[im.Spec]:
    if kind not in KEYS:
        raise ValueError(f"not a table: {kind!r}")
    if kind == "shipments":
        return im.SHIPMENT_COLUMNS
    return im.inventory_columns(warehouse_codes(locations))


def warehouse_codes(locations: DataFrame) -> list[str]:
    """The codes of the reference dimension's warehouses in its order; there are few."""
    return [r["code"] for r in locations.where("kind = 'warehouse'").orderBy("_ord").select("code").collect()]


def read_table(spark: SparkSession, path: str, format: str = "strict-csv", header_line: int | None = None, registry: FormatRegistry | None = None, **options) -> tuple[list[str], DataFrame]:
    """The header's cells and the records below it (file, line, cells); the header is the first record unless a line is named."""
    records = written((registry or standard_formats()).read(spark, format, path, **options))
    if records.select("file").distinct().limit(2).count() > 1:
        raise ValueError(f"{path}: import one file at a time, for lines are known by their number")
    found = records.where(F.col("line") == header_line) if header_line else records.orderBy("line").limit(1)
    header = found.first()
    if header is None:
        raise ValueError(f"{path}: the file is empty" if header_line is None else f"{path}: there is no line {header_line}")
    return header["cells"], records.where(F.col("line") > header["line"])


def import_file(
    store: VersionedStore, kind: str, path: str, locations: DataFrame, column_map: Sequence[str | None] | None = None, constants: Mapping[str, str] | None = None,
    choices: Mapping[str, DataFrame] | None = None, format: str = "strict-csv", header_line: int | None = None, presets: Mapping[str, object] | None = None, **options,
) -> Imported:
    """Replaces the table ``kind`` of the store by the rows of a file if none has a problem; else the store is left as it is.

    Without a ``column_map`` the header has to have the canonical names. With one, ``constants``, ``choices`` and ``presets`` (number_preset,
    date_preset, date_presets) say how the user's words are read. A header or map that doesn't fit is an error, and so is a file without rows.
    """
    columns = columns_of(kind, locations)
    header, rows = read_table(store.spark, path, format, header_line, **options)
    key, shown = KEYS[kind]
    names = [im.header_key(h) for h in header]
    if column_map is None:
        checked = im.checked(rows, header, columns, key, shown)
        found = lambda done: im.issues(done).withColumn("place", F.concat(F.lit("line "), F.col("line").cast("string")))
        ignored = tuple(n for n in names if n not in [c.name for c in columns])
    else:
        how = ca.plan(header, columns, column_map, constants, warehouse_codes(locations), **(presets or {}))
        checked = ca.dry_run(ca.cooked(rows, how, locations, choices), how, key, shown)
        found = lambda done: ca.problems(done, how)
        ignored = tuple(n for n, m in zip(names, column_map, strict=True) if m is None)
    done = written(checked)  # parsed once: the gate, the rows and the problems are read from it
    sums = done.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("problems")).first()
    if not sums["rows"]:
        raise ValueError(f"{path}: the file has a header but no data rows")
    if sums["problems"]:
        return Imported(None, 0, sums["problems"], found(done), ignored)
    version = store.replace(**{kind: done.select("row.*")})
    return Imported(version, sums["rows"], 0, found(done), ignored)


def reset(store: VersionedStore, inventory: DataFrame, shipments: DataFrame) -> int:
    """Puts the sample back in place of both tables; can't be undone."""
    return store.replace_for_good(inventory=inventory, shipments=shipments)


def status(store: VersionedStore) -> dict[str, object]:
    """The store's version and which tables it has."""
    return {"version": store.version(), "tables": [t for t in TABLES if store.read(t) is not None]}


def snapshot_of(store: VersionedStore, locations: DataFrame, today: date) -> DataFrame:
    """section and value: the snapshot of the store's current version on a day, made once for both and then read."""
    version, tables = store.version(), [store.read(t) for t in TABLES]
    if None in tables:
        raise ValueError("the store hasn't both tables yet")
    place = f"{store.path}/snapshots/{version:012d}-{today:%Y-%m-%d}"
    if not store.exists(place):
        before = written_paths()
        made = f"{store.path}/new/snapshot-{version}-{uuid.uuid4().hex}"
        snapshot_lines(snapshot_sections(*tables, locations, today)).write.partitionBy("section").text(made)
        remove_written(store.spark, [p for p in written_paths() if p not in before])
        try:
            store.move(made, place)
        except SecondWriter:
            pass  # the same snapshot, made beside this one
    return store.spark.read.text(place).select("section", "value")

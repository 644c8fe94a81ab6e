"""Nested records as tables: dotted path columns, and a table of its own for every array of objects, breadth first.

The schema is one distributed aggregate over all records; tables are then plain projections and explodes of the parsed
text, so a table that isn't asked for is never made.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_of(records: DataFrame, column: str) -> T.StructType:
    """The schema that fits every JSON text in ``column``, leaves as text; texts that aren't JSON objects count for nothing.

    What is an object here and something else there, and arrays of anything but objects, are leaves: their JSON.
    """
    parsed = records.select(F.try_parse_json(F.col(f"`{column}`")).alias("v"))
    told = parsed.where(F.schema_of_variant("v").startswith("OBJECT")).agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    found = T._parse_datatype_string(re.sub(r"\bOBJECT<", "STRUCT<", told or "VOID"))
    return _as_text(found) if isinstance(found, T.StructType) else T.StructType()


def _as_text(kind: T.DataType) -> T.DataType:
    """The same nesting of objects and arrays of objects with every other part as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return T.ArrayType(_as_text(kind.elementType))
    return T.StringType()


def _paths(schema: T.StructType, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    """Path and type of every leaf and array of objects, in the schema's order."""
    for f in schema:
        path = (*above, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _paths(f.dataType, path)
        else:
            yield path, f.dataType


def _at(root: Column, path: Sequence[str]) -> Column:
    for name in path:
        root = root.getField(name)
    return root


def headers(paths: Sequence[Sequence[str]]) -> list[str]:
    """Dotted paths; a path whose dotted form another one has already gets ``#2`` and so on."""
    out: list[str] = []
    for path in paths:
        name, n = ".".join(path), 2
        while name in out:
            name, n = f"{'.'.join(path)}#{n}", n + 1
        out.append(name)
    return out


def short_headers(paths: Sequence[Sequence[str]]) -> list[str]:
    """The last part of each path where no other path ends alike, else the dotted path: what a column map goes by."""
    last = [p[-1] for p in paths]
    return [p[-1] if last.count(p[-1]) == 1 else ".".join(p) for p in paths]


def flatten(records: DataFrame, key: str, column: str, name: str = "records", schema: T.StructType | None = None) -> dict[str, DataFrame]:
    """Tables by name of the JSON objects in ``column``; ``key`` tells records apart.

    The main table ``name`` has ``_key`` (the key as text) and a text column for every leaf path. For every array of objects
    there is a table named after its parent and path, with ``_key`` (parent's, path and ordinal), ``_parent``, ``_ordinal`` (from
    0) and its own leaves; null elements are rows without values. Missing values, nulls and records that can't be read are nulls;
    empty arrays have no rows. Numbers are text without zeros that say nothing (1.50 is 1.5). Tables come breadth first. A leading ``_`` more keeps the three names apart from leaves.
    """
    schema = schema if schema is not None else schema_of(records, column)
    rows = records.select(F.col(f"`{key}`").cast("string").alias("at"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("ordinal"), F.from_json(F.col(f"`{column}`"), schema).alias("node"))
    tables: dict[str, DataFrame] = {}
    queue = deque([(name, rows, schema, True)])
    while queue:
        table, rows, kind, is_main = queue.popleft()
        every = list(_paths(kind))
        leaves = [p for p, t in every if isinstance(t, T.StringType)]
        named = headers(leaves)
        mark = "_"
        while any(n in (f"{mark}key", f"{mark}parent", f"{mark}ordinal") for n in named):
            mark += "_"
        own = [F.col("at").alias(f"{mark}key")] + ([] if is_main else [F.col("parent").alias(f"{mark}parent"), F.col("ordinal").alias(f"{mark}ordinal")])
        tables[table] = rows.select(*own, *[_at(F.col("node"), p).alias(n) for p, n in zip(leaves, named, strict=True)])
        for path, t in every:
            if isinstance(t, T.ArrayType):
                inner = rows.select(F.col("at").alias("parent"), F.posexplode(_at(F.col("node"), path)).alias("ordinal", "node"))
                at = F.concat("parent", F.lit(f".{'.'.join(path)}["), F.col("ordinal").cast("string"), F.lit("]"))
                queue.append((f"{table}.{'.'.join(path)}", inner.select(at.alias("at"), "parent", "ordinal", "node"), t.elementType, False))
    return tables

"""Formats by name: what each reads, by which files it is tried, and how it becomes records as a DataFrame.

A format's reader is a Spark job over Spark's own file systems, so it reads what the session reads. (A data source written in
Python would open files in its tasks, where those file systems aren't at hand.)
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .delimited import read_records

# What names and file endings of formats look like.
NAME = re.compile(r"[a-z0-9][a-z0-9-]{1,39}")
VERSION = re.compile(r"\d+\.\d+\.\d+")
ENDING = re.compile(r"\.[a-z0-9]{1,12}")


class FormatError(ValueError):
    """A format that can't be registered, or isn't."""


@dataclass(frozen=True)
class Format:
    """``read`` takes (spark, path, **options) and returns file, line and cells, as ``read_records`` does."""

    name: str
    version: str
    family: str
    read: Callable[..., DataFrame]
    endings: tuple[str, ...] = ()
    options: dict[str, object] = field(default_factory=dict)
    #: Known and named, but never read: this says why.
    refusal: str | None = None

    def problems(self) -> list[str]:
        found = [] if NAME.fullmatch(self.name) else ["name must match [a-z0-9][a-z0-9-]{1,39}"]
        found += [] if VERSION.fullmatch(self.version) else ["version must look like 1.0.0"]
        found += [] if self.family.strip() else ["family is required"]
        found += [f'ending "{e}" must be lower case with a leading dot' for e in self.endings if not ENDING.fullmatch(e)]
        return found


class FormatRegistry:
    """Formats in the order in which they were registered."""

    def __init__(self):
        self._formats: dict[str, Format] = {}
        self._disabled: set[str] = set()

    def register(self, new: Format) -> Callable[[], None]:
        """Adds a format; returns what takes it out again. One that is malformed, or whose name is taken, is refused."""
        if found := new.problems():
            raise FormatError(f'Invalid format "{new.name}": {"; ".join(found)}.')
        if new.name in self._formats:
            raise FormatError(f'A format named "{new.name}" is already registered.')
        self._formats[new.name] = new
        return lambda: self._formats.pop(new.name, None)

    def names(self) -> list[str]:
        return list(self._formats)

    def supported(self) -> list[str]:
        return [f.name for f in self._formats.values() if not f.refusal and f.name not in self._disabled]

    def disable(self, *names: str) -> None:
        """From now on these, and no others, are known but not read."""
        self._disabled = set(names)

    def for_file(self, path: str) -> list[str]:
        """Names of the formats that a file's ending speaks for."""
        return [f.name for f in self._formats.values() if any(path.lower().endswith(e) for e in f.endings)]

    def read(self, spark: SparkSession, name: str, path: str, **options) -> DataFrame:
        """The records of the files at ``path``; options go over the format's own, others are refused."""
        known = self._formats.get(name)
        if known is None:
            raise FormatError(f'There is no format named "{name}".')
        if known.refusal or name in self._disabled:
            raise FormatError(known.refusal or f"This file type is not enabled ({known.family}).")
        if other := sorted(set(options) - set(known.options)):
            raise FormatError(f'The format "{name}" has no option {", ".join(other)}.')
        return known.read(spark, path, **{**known.options, **options})


def standard_formats() -> FormatRegistry:
    """A registry with delimited text: strict CSV, and lenient text by comma, semicolon, tab or bar, of detected encoding."""
    registry = FormatRegistry()
    registry.register(Format("strict-csv", "1.0.0", "CSV", read_records, (".csv",), {"delimiter": ",", "strict": True, "encoding": "utf-8"}))
    for name, mark, endings in (("comma-text", ",", (".csv", ".txt")), ("semicolon-text", ";", (".csv", ".txt")), ("tab-text", "\t", (".tsv", ".tab", ".txt")), ("bar-text", "|", (".psv", ".txt"))):
        registry.register(Format(name, "1.0.0", "delimited text", read_records, endings, {"delimiter": mark, "strict": False, "encoding": None}))
    return registry

"""Captured pages as a Python data source: one partition a file, folders skipped by market and label, and a stream over new files.

A folder holds JSON lines of the capture schema as <root>/market=<code>/label=<label>/<name>.json, names rising with time. Files are opened
through Arrow's file systems, so the root may be any place that driver and executors reach.

The options market and label (comma-separated) leave other folders out. With the option pushdown=true equality filters on the two columns do so too; Spark
keeps what one query pushed down in the frame that was loaded, so a frame loaded with it serves one query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from merchlake.sources.tables import CAPTURES

FOLDERS = ("market", "label")


class File(InputPartition):
    def __init__(self, path: str, market: str, label: str):
        self.path, self.market, self.label = path, market, label


def _place(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _files(root: str, wanted: dict[str, set[str]]) -> list[File]:
    """Files below root, by name, of the folders wanted."""
    from pyarrow import fs

    system, base = _place(root)
    out = []
    for market in sorted(system.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda i: i.path):
        code = market.base_name.removeprefix("market=")
        if market.type != fs.FileType.Directory or code == market.base_name or ("market" in wanted and code not in wanted["market"]):
            continue
        for kind in sorted(system.get_file_info(fs.FileSelector(market.path)), key=lambda i: i.path):
            label = kind.base_name.removeprefix("label=")
            if kind.type != fs.FileType.Directory or label == kind.base_name or ("label" in wanted and label not in wanted["label"]):
                continue
            out += [File(f.path, code, label) for f in system.get_file_info(fs.FileSelector(kind.path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(out, key=lambda f: (f.path.rsplit("/", 1)[-1], f.path))


def _rows(root: str, part: File, schema: T.StructType) -> Iterator[tuple]:
    """Rows of a file, line by line; a line that is no JSON object is a row of nulls but for its market and label."""
    system, _ = _place(root)
    with system.open_input_stream(part.path) as raw:
        import io

        for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
            if not line.strip():
                continue
            try:
                found = json.loads(line)
            except ValueError:
                found = None
            found = (found if isinstance(found, dict) else {}) | {"market": part.market, "label": part.label}
            yield tuple(_typed(found.get(f.name), f.dataType) for f in schema.fields)


def _typed(value, kind: T.DataType):
    """value as the type wants it, null where it is none of it."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.IntegralType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, T.TimestampType):
        try:
            return datetime.fromisoformat(value)
        except (TypeError, ValueError):
            return None
    return value if isinstance(value, str) else json.dumps(value)


class _Reader(DataSourceReader):
    def __init__(self, root: str, schema: T.StructType, wanted: dict[str, set[str]], pushdown: bool):
        self.root, self.schema, self.wanted, self.pushdown = root, schema, dict(wanted), pushdown

    def pushFilters(self, filters):
        for f in filters:
            if self.pushdown and isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FOLDERS:
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], {f.value}) & {f.value}
            else:
                yield f

    def partitions(self):
        return _files(self.root, self.wanted) or [File("", "", "")]

    def read(self, partition):
        return _rows(self.root, partition, self.schema) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset is the name of the last file read, so files are read once each, in order of their names."""

    def __init__(self, root: str, schema: T.StructType, wanted: dict[str, set[str]]):
        self.root, self.schema, self.wanted = root, schema, wanted

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max((f.path.rsplit("/", 1)[-1] for f in _files(self.root, self.wanted)), default="")}

    def partitions(self, start, end):
        return [f for f in _files(self.root, self.wanted) if start["after"] < f.path.rsplit("/", 1)[-1] <= end["after"]]

    def read(self, partition):
        return _rows(self.root, partition, self.schema)

    def commit(self, end):
        pass


class CaptureSource(DataSource):
    """spark.read.format("captures").load(root), spark.readStream.format("captures").load(root)"""

    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return CAPTURES

    def _wanted(self):
        return {k: set(self.options[k].split(",")) for k in FOLDERS if self.options.get(k)}

    def reader(self, schema):
        return _Reader(self.options["path"], schema, self._wanted(), self.options.get("pushdown", "false").lower() == "true")

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], schema, self._wanted())


def register(spark: SparkSession) -> None:
    """Make the format "captures" known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)

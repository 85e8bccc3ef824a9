"""Days of records as a data source of Spark's own: one partition for each day's file, only for the days that a filter asks for, and the same as a stream.

Spark plans the read; this names the days and yields their batches. spark.dataSource.register(DailyRecords), then
spark.read.format("daily_records").option("path", folder).schema(...). Files lie at day_date=YYYY-MM-DD/*.json, a record a line.
"""

from __future__ import annotations

import datetime as dt
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DAY = "day_date"
#: Records in a batch.
BATCH = 20_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL; Hadoop's own URLs go through its client."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def days_of(path: str) -> list[dt.date]:
    files, at = _at(path)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(dt.date.fromisoformat(x.base_name.removeprefix(f"{DAY}=")) for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{DAY}="))


class Day(InputPartition):
    def __init__(self, day: dt.date):
        super().__init__(day)
        self.day = day


def _read(path: str, schema: StructType, day: dt.date) -> Iterator[pa.RecordBatch]:
    """Batches of a day's records; a day whose files are missing or cannot be read is one row with nulls beside its date, so that it can be told from a day without trains."""
    files, at = _at(path)
    names, arrow = [f.name for f in schema.fields], to_arrow_schema(schema)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: day if n == DAY else r.get(n) for n in names} for r in rows], schema=arrow)

    try:
        paths = sorted(x.path for x in files.get_file_info(fs.FileSelector(f"{at}/{DAY}={day.isoformat()}")) if x.type == fs.FileType.File and x.base_name.endswith(".json") and x.size)
        if not paths:
            raise FileNotFoundError(day)
        whole: list[pa.RecordBatch] = []  # a day is whole or lost: a file that breaks off half way must not count
        for name in paths:
            rows: list[dict] = []
            with files.open_input_stream(name) as f:
                for line in io.TextIOWrapper(f, encoding="utf-8"):
                    rows.append(json.loads(line))
                    if len(rows) == BATCH:
                        whole.append(batch(rows))
                        rows = []
            if rows:
                whole.append(batch(rows))
    except (OSError, ValueError, pa.ArrowException):
        whole = [batch([{}])]
    yield from whole


class DailyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.asked = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what is asked of the day; hands all else back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (DAY,):
                self.asked.append(f)
            else:
                yield f

    def wanted(self, day: dt.date) -> bool:
        tests = {EqualTo: lambda v: day == v, In: lambda v: day in v, GreaterThan: lambda v: day > v, GreaterThanOrEqual: lambda v: day >= v, LessThan: lambda v: day < v, LessThanOrEqual: lambda v: day <= v}
        return all(tests[type(f)](f.value) for f in self.asked)

    def partitions(self) -> list[Day]:
        return [Day(d) for d in days_of(self.path) if self.wanted(d)] or [Day(None)]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        if partition.day is not None:
            yield from _read(self.path, self.schema, partition.day)


class DailyStream(DataSourceStreamReader):
    """Days in order, each once: an offset is the last day that was read."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        found = days_of(self.path)
        return {"day": found[-1].isoformat() if found else ""}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [Day(d) for d in days_of(self.path) if start["day"] < d.isoformat() <= end["day"]]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, self.schema, partition.day)


class DailyRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_records"

    def schema(self) -> str:
        return f"train_no string, station string, delay_arr string, delay_dep string, {DAY} date"

    def reader(self, schema: StructType) -> DailyReader:
        return DailyReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DailyStream:
        return DailyStream(self.options["path"], schema)


def use_daily_records(spark) -> None:
    """Makes the source known to the session, and lets Spark hand it filters, which a session does not do for sources in Python unless it is told."""
    spark.dataSource.register(DailyRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

"""A data source of recorded service answers: rows (service, url, body, written, payload) from JSON lines.

``spark.read.format("recorded").option("service", ...).load(folder)`` reads every file of a folder, one
partition per file; only answers of the service are given. There is no network here: a service's
answers are recorded once and read like any table.
"""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "service string, url string, body string, written timestamp, payload string"


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class RecordedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.service = options.get("path"), options.get("service")
        if not self.folder:
            raise ValueError("a folder of recorded answers is needed")

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(str(p)) for p in sorted(Path(self.folder).glob("*.jsonl"))] or [FilePartition("")]

    def read(self, partition: FilePartition):
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                if self.service in (None, row["service"]):
                    payload = row["payload"] if isinstance(row["payload"], str) else json.dumps(row["payload"], ensure_ascii=False)
                    yield row["service"], row["url"], row.get("body"), datetime.datetime.fromisoformat(row["written"]), payload


class RecordedSource(DataSource):
    """Registered under the name ``recorded``."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(RecordedSource)

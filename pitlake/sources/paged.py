"""A data source of pages in files, as cursors of REST services give them: each page names the next. It stands in for services that need a network."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class PagedSource(DataSource):
    """spark.read.format("paged").option("path", folder).option("symbols", "A,B").load(): one partition for each symbol, whose pages are followed in turn."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "sym string, t string, o double, h double, l double, c double, v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Symbol(InputPartition):
    def __init__(self, sym: str) -> None:
        super().__init__(sym)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.symbols = options["path"], [s for s in options.get("symbols", "").split(",") if s]

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, seen = f"{partition.value}.json", set()
        while page and page not in seen:
            seen.add(page)
            file = Path(self.path) / page
            if not file.exists():
                return
            body = json.loads(file.read_text())
            for b in body.get("bars", []):
                yield partition.value, b["t"], float(b["o"]), float(b["h"]), float(b["l"]), float(b["c"]), float(b.get("v") or 0)
            page = body.get("next")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)

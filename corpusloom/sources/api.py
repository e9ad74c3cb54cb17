"""A listing service as a data source: pages of JSON, one partition per list.

``base`` is a folder with ``<list>.json`` files (an array of objects each, the offline
stand-in) or an http address that answers ``<base>/<list>`` the same way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ListingSource(DataSource):
    """spark.read.format("listing").option("base", ...).option("lists", "a,b").schema(...)"""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "list string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base = options["base"].rstrip("/")
        self.lists = [x.strip() for x in options["lists"].split(",") if x.strip()]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.lists]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = partition.value
        if self.base.startswith(("http://", "https://")):
            with urlopen(f"{self.base}/{name}", timeout=30) as answer:  # noqa: S310
                rows = json.load(answer)
        else:
            file = Path(self.base.removeprefix("file://"), f"{name}.json")
            rows = json.loads(file.read_text(encoding="utf-8")) if file.exists() else []
        for row in rows:
            yield name, json.dumps(row, ensure_ascii=False)

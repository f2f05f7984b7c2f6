"""A data source over a folder of saved filing answers, one file ``CIK##########.json`` a company.

    spark.dataSource.register(FilingsSource)
    spark.read.format("filings").option("cik", "320, 789").option("form", "10-K").load("/shared/answers")

Each file is a partition. The option ``cik`` chooses files by their names, so no other file is opened, and
``form`` leaves rows out while a file is read; other filters are Spark's. (Filters pushed down by Spark
4.1 stay with the loaded table: a second query of the same DataFrame with another filter would get
the first one's rows. So options take their place.) Folders are reached through Arrow's file
systems, by a URI or a local path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "cik string, company string, place int, accession string, form string, date string, document string, description string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FilingsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilingsReader:
        chosen = lambda name: {x.strip() for x in self.options[name].split(",")} if name in self.options else None
        ciks = chosen("cik")
        return FilingsReader(self.options["path"], ciks and {x.lstrip("0").zfill(10) for x in ciks}, chosen("form"))


class FilingsReader(DataSourceReader):
    def __init__(self, path: str, ciks: set[str] | None, forms: set[str] | None):
        self.path, self.ciks, self.forms = path, ciks, forms

    def partitions(self) -> list[InputPartition]:
        system, folder = _opened(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(folder)):
            m = re.fullmatch(r"CIK(\d{10})\.json", info.base_name)
            if m and (self.ciks is None or m[1] in self.ciks):
                found.append(InputPartition((m[1], info.path)))
        return sorted(found, key=lambda p: p.value)

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no file was chosen
            return
        cik, path = partition.value
        with _opened(self.path)[0].open_input_stream(path) as f:
            data = json.loads(f.read())
        recent = data.get("filings", {}).get("recent", {})
        lists = [recent.get(c, []) for c in ("accessionNumber", "form", "filingDate", "primaryDocument", "primaryDocDescription")]
        for k in range(min(len(lists[1]), len(lists[2]))):
            accession, form, date, document, description = (x[k] if k < len(x) else "" for x in lists)
            if self.forms is None or form in self.forms:
                yield cik, data.get("name", ""), k, accession, form, date, document, description

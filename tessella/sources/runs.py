"""A tracking service's paged export as a Spark data source: spark.read.format("run_pages").load(folder), in batch and as a stream.

A folder holds pages, JSON files of a list of runs each, that sort by name in the order in which they were written, and never change. A page is
a partition; a stream's offset is the name of its last page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

NAME = "run_pages"
SCHEMA = """id string, name string, url string, created_at string, state string, dataset string, model string, method string, ratio double, seed int, lr double, epochs int,
  recipe string, steps int, miou double, rare_miou double, pixel_acc double, boundary_f double, runtime_h double"""
COLUMNS = [c.split()[0] for c in SCHEMA.split(",")]


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def pages(folder: str) -> list[str]:
    system, where = opened(folder)
    found = system.get_file_info(pafs.FileSelector(where))
    return sorted(f.base_name for f in found if f.is_file and f.extension == "json")


def number(value: object, kind: type) -> object:
    return None if value is None else kind(value)


def flat(run: dict) -> tuple:
    """A run of the export in the columns that reports use; fields that are missing are null or '?'."""
    config, summary = run.get("config") or {}, run.get("summary") or {}
    recipe, named = config.get("recipe") or {}, lambda x: (x or {}).get("name") or "?"
    hours = summary.get("_runtime")
    return (
        run.get("id"), run.get("name"), run.get("url"), run.get("created_at"), run.get("state"), named(config.get("dataset")), named(config.get("model")), config.get("selection_method") or "?",
        number(config.get("ratio"), float), number(recipe.get("seed_train"), int), number(recipe.get("lr"), float), number(recipe.get("epochs"), int), named(recipe), number(summary.get("_step"), int),
        *(number(summary.get(f"final/{k}"), float) for k in ("miou", "rare_class_miou", "pixel_acc", "boundary_f")), None if hours is None else hours / 3600,
    )


class Page(InputPartition):
    def __init__(self, folder: str, name: str):
        super().__init__(name)
        self.folder, self.name = folder, name


def rows(page: Page, wanted: list[tuple[str, str, object]]) -> Iterator[tuple]:
    system, where = opened(page.folder)
    with system.open_input_stream(f"{where.rstrip('/')}/{page.name}") as file:
        found = [flat(run) for run in json.loads(file.read())]
    for row in found:
        values = dict(zip(COLUMNS, row, strict=True))
        if all(values[c] is not None if op == "there" else values[c] in x if op == "in" else values[c] == x for c, op, x in wanted):
            yield row


class PageReader(DataSourceReader):
    """Pages as partitions. Equalities, lists and not-null tests on a column are applied as a page is read."""

    def __init__(self, folder: str):
        self.folder, self.wanted = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if column not in COLUMNS:
                yield one
            elif isinstance(one, (EqualTo, EqualNullSafe)) and one.value is not None:
                self.wanted.append((column, "is", one.value))
            elif isinstance(one, In):
                self.wanted.append((column, "in", [x for x in one.value if x is not None]))
            elif isinstance(one, IsNotNull):
                self.wanted.append((column, "there", None))
            else:
                yield one

    def partitions(self) -> list[Page]:
        return [Page(self.folder, p) for p in pages(self.folder)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows(partition, self.wanted)


class PageStream(DataSourceStreamReader):
    """A batch is the pages after one offset up to another; a page once read is never read again, and a batch that is run again reads the same pages."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        return {"page": max(pages(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(self.folder, p) for p in pages(self.folder) if start["page"] < p <= end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows(partition, [])

    def commit(self, end: dict) -> None:
        pass


class RunPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("run_pages needs the folder of the pages: load(folder)")
        return self.options["path"]

    def reader(self, schema) -> PageReader:
        return PageReader(self.folder())

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.folder())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunPages)

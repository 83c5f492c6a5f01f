"""Stored review pages as a data source: a partition for each film and level, and filters that reach the scan.

``spark.read.format("review_pages").option("maxPages", 6).load(path)`` reads what
``reviews.write.partitionBy("film", "level").parquet(path)`` wrote. Conditions on film and level leave whole partitions
unread, conditions on the page's number leave out its rows in the files. Paths are whatever pyarrow's filesystems open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

KEYS = ("film", "level")
#: What a column is compared by.
TESTS = {EqualTo: "==", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _holds(test: str, a, b) -> bool:
    """What is unknown passes no test."""
    if a is None or test == "known":
        return a is not None
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[test]


def _condition(test: str, value) -> ds.Expression:
    page = ds.field("page")
    return page.is_valid() if test == "known" else {"==": page == value, "<": page < value, "<=": page <= value, ">": page > value, ">=": page >= value}[test]


class LevelPages(InputPartition):
    """The files of one film's level."""

    def __init__(self, film: str | None, level: float | None, files: list[str]):
        super().__init__((film, level))
        self.film, self.level, self.files = film, level, files


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, max_pages: int | None):
        self.path, self.names = path, schema.names
        #: (column, test, value) of what was pushed down, and allowed values by column.
        self.tests: list[tuple[str, str, object]] = [] if max_pages is None else [("page", "<=", max_pages)]
        self.among: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take comparisons of film, level and page; Spark keeps the rest."""
        for one in filters:
            name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if name in (*KEYS, "page") and type(one) in TESTS and one.value is not None:
                self.tests.append((name, TESTS[type(one)], one.value))
            elif name in (*KEYS, "page") and isinstance(one, IsNotNull):
                self.tests.append((name, "known", None))
            elif name in KEYS and isinstance(one, In):
                own = set(one.value)
                self.among[name] = self.among.get(name, own) & own
            else:
                yield one

    def _wanted(self, values: dict) -> bool:
        among = all(values[c] in held for c, held in self.among.items())
        return among and all(_holds(test, values[c], v) for c, test, v in self.tests if c in KEYS)

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        held: dict[tuple[str | None, float | None], list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            folders = dict(x.split("=", 1) for x in info.path.split("/") if "=" in x)
            if info.type == fs.FileType.File and info.path.endswith(".parquet") and {*KEYS} <= {*folders}:
                film, level = (None if folders[c] == NO_VALUE else unquote(folders[c]) for c in KEYS)
                held.setdefault((film, None if level is None else float(level)), []).append(info.path)
        return [LevelPages(film, level, sorted(files)) for (film, level), files in sorted(held.items(), key=str) if self._wanted({"film": film, "level": level})]

    def read(self, partition: LevelPages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no level is wanted
            return
        system, _ = opened(self.path)
        condition = None
        for one in (_condition(test, value) for column, test, value in self.tests if column == "page"):
            condition = one if condition is None else condition & one
        stored = ds.dataset(partition.files, format="parquet", filesystem=system)
        for batch in stored.to_batches(columns=[n for n in self.names if n not in KEYS], filter=condition):
            own = {"film": pa.array([partition.film] * batch.num_rows, pa.string()), "level": pa.array([partition.level] * batch.num_rows, pa.float64())}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch[n] for n in self.names], self.names)


class ReviewPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_pages"

    def schema(self) -> StructType:
        """The columns of the files, and film and level."""
        system, root = opened(self.options["path"])
        found = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith(".parquet")]
        stored = from_arrow_schema(ds.dataset(sorted(found)[:1], format="parquet", filesystem=system).schema, prefer_timestamp_ntz=False)
        return StructType([StructField("film", StringType()), StructField("level", DoubleType()), *stored.fields])

    def reader(self, schema: StructType) -> PageReader:
        most = self.options.get("maxPages")
        return PageReader(self.options["path"], schema, None if most is None else int(most))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReviewPages)

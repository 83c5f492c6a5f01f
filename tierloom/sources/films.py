"""Film documents as files: one UTF-8 JSON file a film, indented by two spaces, written by tasks and moved into place on commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tierloom.sources.pages import opened


def file_name(film: str) -> str:
    """A film's file: its name, with what a path cannot hold percent-encoded."""
    return quote(film, safe="") + ".json"


def as_text(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, indent=2)


@dataclass
class Staged(WriterCommitMessage):
    """The files of a task, by film."""

    files: dict[str, str]


class FilmWriter(DataSourceWriter):
    """Tasks write to a staging folder of the run; only its commit touches the films' own files, and no others'."""

    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Staged:
        system, root = opened(self.path)
        attempt, files = TaskContext.get().taskAttemptId(), {}
        for row in rows:
            document = row.asDict(recursive=True)
            film = document.get("film")
            if not film:
                raise ValueError("a document without a film")
            if film in files:
                raise ValueError(f"two documents of {film}")
            files[film] = f"{root}/{self.staging}/{attempt}-{file_name(film)}"
            system.create_dir(f"{root}/{self.staging}", recursive=True)
            with system.open_output_stream(files[film]) as out:
                out.write(as_text(document).encode())
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.path)
        films = [film for m in messages if m is not None for film in m.files]
        if len(set(films)) < len(films):
            self.abort(messages)
            raise ValueError("two documents of one film")
        for m in messages:
            for film, staged in m.files.items() if m is not None else ():
                system.move(staged, f"{root}/{file_name(film)}")
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        staging = f"{root}/{self.staging}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class FilmFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "film_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilmWriter:
        return FilmWriter(self.options["path"])


def write_films(documents: DataFrame, path: str) -> None:
    """A file for each row's film at ``path``; films that ``documents`` lacks keep theirs, and a failed run changes none.

    Rows need a film, and no two the same one. Films are moved one by one on commit: a driver lost right then leaves some of them new.
    """
    documents.sparkSession.dataSource.register(FilmFiles)
    documents.write.format("film_files").mode("append").save(path)


def read_films(spark: SparkSession, path: str, schema: StructType | str, version: str | None = None) -> DataFrame:
    """Documents read back, a row for each file; ``version`` replaces the one that they were written under."""
    documents = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return documents if version is None else documents.withColumn("version", F.lit(version))

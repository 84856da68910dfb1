"""Named text files, written by tasks and put in place by a commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; without a scheme it is a shared local folder."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: for each file the place where it waits."""

    waiting: dict[str, str] = field(default_factory=dict)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.attempt = path.rstrip("/"), f"_waiting-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        files, root = store(self.path)
        done, name, out = Written(), None, None
        for file, line in rows:
            if file != name:
                if out is not None:
                    out.close()
                if file in done.waiting:
                    raise ValueError(f"the lines of {file} are not together")
                place = f"{root}/{self.attempt}/{uuid.uuid4().hex}"
                files.create_dir(place.rpartition("/")[0], recursive=True)
                name, out, done.waiting[file] = file, files.open_output_stream(place), place
            out.write((line + "\n").encode())
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        found = [(name, place) for m in messages if m for name, place in m.waiting.items()]
        if len({name for name, _ in found}) < len(found):
            self.abort(messages)
            raise ValueError("two tasks wrote one file; the rows have to be dealt by file")
        for name, place in found:
            files.move(place, f"{root}/{name}")
        self._swept(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._swept(*store(self.path))

    def _swept(self, files: fs.FileSystem, root: str) -> None:
        waiting = f"{root}/{self.attempt}"
        if files.get_file_info(waiting).type != fs.FileType.NotFound:
            files.delete_dir(waiting)


class NamedFiles(DataSource):
    """Rows (file, line) as one file for each name under the path, in the order of the rows. A task writes to a waiting folder; only
    what the finished tasks wrote is moved to its name, when all are done, so a task that is repeated or lost leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write(lines: DataFrame, path: str, *order: str) -> None:
    """``lines`` (file, line and the columns that order them) as named files; each file is one task's, streamed line by line."""
    spark = lines.sparkSession
    spark.dataSource.register(NamedFiles)
    own = lines.repartition("file").sortWithinPartitions("file", *order).select("file", F.coalesce("line", F.lit("")).alias("line"))
    own.write.format("named_files").mode("append").option("path", path).save()

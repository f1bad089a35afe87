"""Folders of Arrow files as a Spark source and sink: one partition a file, or a run of its record batches."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: The files that describe a folder, and one with a folder for each split.
STATE, SPLITS = "state.json", "dataset_dict.json"
#: Rows of a written record batch, and bytes of record batches that a partition reads, about.
BATCH_ROWS, PART_BYTES = 10_000, 64 << 20
_MAGIC = b"ARROW1"


def _at(path: str) -> tuple:
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _json(system, path: str) -> dict | None:
    try:
        with system.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def files(path: str, split: str | None = None) -> list[str]:
    """The Arrow files of a folder in order: those that its state names, else all; of a folder of splits, those of ``split`` or of all."""
    from pyarrow import fs

    system, root = _at(path)
    splits = _json(system, posixpath.join(root, SPLITS))
    if splits is not None:
        if split is not None and split not in splits["splits"]:
            raise ValueError(f"no split {split} in {path}; there are {', '.join(splits['splits'])}")
        return [f for s in splits["splits"] if split in (None, s) for f in files(posixpath.join(path, s))]
    if split is not None:
        raise ValueError(f"{path} has no splits")
    state = _json(system, posixpath.join(root, STATE))
    if state is not None:
        return [posixpath.join(path, f["filename"]) for f in state["_data_files"]]
    found = system.get_file_info(fs.FileSelector(root))
    return [posixpath.join(path, f.base_name) for f in sorted(found, key=lambda f: f.path) if f.extension == "arrow"]


def _opened(path: str):
    """A reader of record batches (random access if the file has a footer), and whether it has."""
    system, inner = _at(path)
    f = system.open_input_file(inner)
    indexed = f.read(len(_MAGIC)) == _MAGIC
    f.seek(0)
    return (pa.ipc.open_file(f) if indexed else pa.ipc.open_stream(f)), indexed


@dataclass
class Part(InputPartition):
    """Record batches ``begin`` up to ``end`` of a file; all of them if ``end`` is null."""

    path: str
    begin: int = 0
    end: int | None = None


class ArrowFolderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)

    def partitions(self) -> list[Part]:
        """One for each file in the stream format, which can only be read in order; of a file with a footer, one for each run of record batches of about ``partBytes``."""
        out, most = [], int(self.options.get("partbytes", PART_BYTES))
        for path in files(self.options["path"], self.options.get("split")):
            reader, indexed = _opened(path)
            n = reader.num_record_batches if indexed else 0
            if n < 2:
                out.append(Part(path))
                continue
            system, inner = _at(path)
            runs = min(n, max(1, -(-system.get_file_info(inner).size // most)))
            cuts = [n * k // runs for k in range(runs + 1)]
            out += [Part(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        reader, indexed = _opened(part.path)
        missing = set(self.names) - set(reader.schema.names)
        if missing:
            raise ValueError(f"{part.path} has no column {', '.join(sorted(missing))}")
        batches = (reader.get_batch(k) for k in range(part.begin, reader.num_record_batches if part.end is None else part.end)) if indexed else reader
        for b in batches:
            yield b.select(self.names)


class ArrowFolderWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite, self.run = to_arrow_schema(schema), options["path"], overwrite, uuid.uuid4().hex[:8]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file for each task, under a name of its own, so that a task that runs again does no harm."""
        from pyspark import TaskContext

        system, root = _at(self.path)
        system.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        name = f"data-{self.run}-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.arrow"
        rows = 0
        with system.open_output_stream(posixpath.join(root, name)) as out, pa.ipc.new_file(out, self.schema) as sink:
            for b in batches:
                sink.write_table(pa.Table.from_batches([b]).cast(self.schema), max_chunksize=BATCH_ROWS)
                rows += b.num_rows
        return Written(ctx.partitionId(), name, rows)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        """The state names the files of the tasks that count; with append, after those that were there."""
        system, root = _at(self.path)
        before = [] if self.overwrite else [posixpath.basename(f) for f in files(self.path) if _json(system, posixpath.join(root, STATE))]
        done = [m.name for m in sorted((m for m in messages if m), key=lambda m: m.partition)]
        with system.open_output_stream(posixpath.join(root, STATE)) as f:
            f.write(json.dumps({"_data_files": [{"filename": n} for n in [*before, *done]]}).encode())

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, root = _at(self.path)
        for m in messages:
            if m:
                system.delete_file(posixpath.join(root, m.name))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class ArrowFolder(DataSource):
    """``spark.read.format("arrow_folder").load(path)`` and ``df.write.format("arrow_folder").save(path)``.

    Reads folders of Arrow files as dataset libraries save them: the stream or
    the file format, with or without a state file, and folders of splits (option
    ``split``).  Options ``columns`` (names joined by commas) and ``partBytes``
    say which columns are taken from the files and how much a task reads.  An
    empty folder needs a schema.  Paths may be addresses that pyarrow opens and
    must be seen by the driver and all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_folder"

    def schema(self) -> StructType:
        found = files(self.options["path"], self.options.get("split"))
        if not found:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        schema = from_arrow_schema(_opened(found[0])[0].schema.remove_metadata())
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([schema[c] for c in names]) if names else schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowFolderReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowFolderWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session."""
    spark.dataSource.register(ArrowFolder)
    return spark

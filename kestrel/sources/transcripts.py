"""Transcripts of many conversations packed into few text files, as a Python data source.

Each task streams its lines into one text file and writes beside it a table of the segments it holds (conversation, byte
offset, length); the last step of the job, on the driver, publishes a manifest that names the files of the tasks that
committed.  Readers follow the manifest only, so files of failed or repeated attempts are never seen, and the number of
files follows the partitions, not the conversations.  A conversation that spans several partitions has a segment in each;
their order is that of the partitions.

Paths are those of ``pyarrow.fs`` (a local or mounted folder, ``hdfs://``, ``s3://``, ``gs://``).
"""
from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "kestrel_transcripts"
MANIFEST = "_manifest.json"
SCHEMA = "conv_id bigint, part int, text string"
SEGMENTS = 10_000  # segments written at a time


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    local = re.match("(file:)?/+(.*)", path)
    return (fs.LocalFileSystem(), "/" + local[2]) if local else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    segments: int


@dataclass
class Part(InputPartition):
    part: int
    name: str
    value: object = field(default=None)


class TranscriptSource(DataSource):
    """``spark.read`` / ``df.write`` ``.format(NAME)``: rows are written in the order in which tasks hold them."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return TranscriptWriter(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return TranscriptReader(self.options["path"])


class TranscriptWriter(DataSourceWriter):
    """Rows (conversation, line): the lines of a conversation follow each other."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"  # an attempt of its own
        kinds = pa.schema([("conv_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        at, count, held = 0, 0, []
        with files.open_output_stream(f"{folder}/{name}.txt") as out, pq.ParquetWriter(f"{folder}/{name}.parquet", kinds, filesystem=files) as table:
            def flush(rows):
                if rows:
                    table.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds))

            for conv_id, line in iterator:
                raw = ((line or "") + "\n").encode()
                out.write(raw)
                if held and held[-1][0] == conv_id:
                    held[-1][2] += len(raw)
                else:
                    if len(held) >= SEGMENTS:
                        flush(held)
                        held = []
                    held.append([conv_id, at, len(raw)])
                    count += 1
                at += len(raw)
            flush(held)
        return Written(part, name, count)

    def commit(self, messages) -> None:
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        parts = sorted((m.part, m.name, m.segments) for m in messages if m is not None)
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps([{"part": p, "name": n, "segments": s} for p, n, s in parts]).encode())

    def abort(self, messages) -> None:
        files, folder = file_system(self.path)
        for m in messages:
            if m is not None:
                for kind in ("txt", "parquet"):
                    files.delete_file(f"{folder}/{m.name}.{kind}")


def manifest(path: str) -> list[dict]:
    files, folder = file_system(path)
    with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class TranscriptReader(DataSourceReader):
    """(conversation, part, text) of every segment: a task reads one file and its table."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(p["part"], p["name"]) for p in manifest(self.path) if p["segments"]] or [Part(-1, "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if not partition.name:
            return
        files, folder = file_system(self.path)
        with files.open_input_file(f"{folder}/{partition.name}.txt") as text:
            with pq.ParquetFile(f"{folder}/{partition.name}.parquet", filesystem=files) as table:
                for batch in table.iter_batches():
                    for r in batch.to_pylist():
                        text.seek(r["offset"])
                        yield r["conv_id"], partition.part, text.read(r["length"]).decode()


def transcript(spark, path: str, conv_id: int) -> str:
    """One conversation's text by its offsets: only its segments are read."""
    files, folder = file_system(path)
    order = {p["name"]: p["part"] for p in manifest(path) if p["segments"]}
    if not order:
        return ""
    from pyspark.sql import functions as F

    table = spark.read.parquet(*[f"{path.rstrip('/')}/{name}.parquet" for name in order])
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.parquet$", 1)
    own = table.where(F.col("conv_id") == conv_id).select(name.alias("name"), "offset", "length").collect()  # a row for each of its segments
    out = []
    for r in sorted(own, key=lambda r: (order[r["name"]], r["offset"])):
        with files.open_input_file(f"{folder}/{r['name']}.txt") as text:
            text.seek(r["offset"])
            out.append(text.read(r["length"]).decode())
    return "".join(out)

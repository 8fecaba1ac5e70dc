"""One file of a DataFrame's rows in order, written by tasks: parts first, then each part copied to its place.

The data source ``onefile`` takes rows of one column, value (string, a line each, or binary, bytes as they are), in the order of
their partitions. Tasks write parts beside the file under names of their own and report their lengths; the commit turns
lengths into places and stores these few numbers. A second job copies every part to its place in a file of the full
length, which gets its name at the end. A failed write leaves nothing. The folder must be one that all machines see.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that a task copies at once.
COPY_BYTES = 1 << 22
PLAN = "places.json"


@dataclass
class Part(WriterCommitMessage):
    """A written part: number of its partition, name, bytes."""

    number: int
    name: str
    size: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        # another attempt at the same partition has another name
        name, size = f"{number}-{uuid.uuid4().hex}", 0
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, name), "wb") as out:
            for batch in batches:
                column = batch.column(0)
                line = not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type))
                for value in column.to_pylist():
                    if line:
                        size += out.write(((value or "") + "\n").encode())
                    elif value is not None:
                        size += out.write(value)
        return Part(number, name, size)

    def commit(self, messages: list[Part | None]) -> None:
        """Store the place of each part: the bytes of the parts of earlier partitions."""
        os.makedirs(self.folder, exist_ok=True)
        places, at = [], 0
        for part in sorted((m for m in messages if m), key=lambda m: m.number):
            places.append([part.name, at, part.size])
            at += part.size
        with open(os.path.join(self.folder, PLAN), "w") as out:
            json.dump({"size": at, "parts": places}, out)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class OneFileSource(DataSource):
    """df.write.format("onefile").option("path", folder): parts of one file and the plan of their places, see write_one_file."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        if len(schema.fields) != 1:
            raise ValueError("onefile takes one column")
        return PartsWriter(self.options["path"])


def place_parts(folder: str, target: str):
    """A function for mapInArrow over (name, at, size): copies each part to its place in target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(os.path.join(folder, row["name"]), "rb") as part, open(target, "r+b") as out:
                    out.seek(row["at"])
                    shutil.copyfileobj(part, out, COPY_BYTES)
            yield pa.RecordBatch.from_arrays([batch.column("size")], ["size"])

    return run


def write_one_file(rows: DataFrame, path: str) -> str:
    """Write rows (one column, in the order of their partitions) as the file path, replacing what is there; its absolute path.

    String rows are lines ended by a newline (a null is an empty line), binary rows are bytes (a null has none). No rows give
    an empty file. The driver holds one name and two numbers a partition. A task that runs again writes the same bytes to the same
    place.
    """
    spark, path = rows.sparkSession, os.path.abspath(path)
    spark.dataSource.register(OneFileSource)
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    target = os.path.join(folder, "whole")
    try:
        rows.write.format("onefile").mode("append").option("path", folder).save()
        with open(os.path.join(folder, PLAN)) as f:
            plan = json.load(f)
        with open(target, "wb") as out:
            out.truncate(plan["size"])
        parts = [p for p in plan["parts"] if p[2]]
        if parts:
            todo = spark.createDataFrame(parts, "name string, at long, size long").repartition(len(parts), "name")
            copied = todo.mapInArrow(place_parts(folder, target), "size long").agg(F.sum("size").alias("n")).first()["n"]
            if copied != plan["size"]:
                raise OSError(f"{copied} of {plan['size']} bytes of {path} were placed")
        if os.path.isdir(path):
            # an earlier run's folder of parts
            shutil.rmtree(path)
        os.replace(target, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return path

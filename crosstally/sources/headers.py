"""The header record of every CSV file, without reading the files.

A scan that gives paths only, no content, deals the files to tasks; each opens its files one by one
and reads blocks of ``BLOCK`` bytes until the first record is complete.  The driver gets one row
per distinct header.  Where a store is one that only Spark can read, its files are read as lines.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2**14

FOUND = "file string, header string, opened boolean"


def open_quote(text: str, delimiter: str = ",", quote: str = '"') -> bool:
    """Whether ``text`` ends inside a quoted field; a quote counts where a field begins."""
    quoted, start, i = False, True, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == quote and text[i + 1 : i + 2] == quote:
                i += 1
            elif c == quote:
                quoted = False
        elif c == quote and start:
            quoted = True
        start = not quoted and c in (delimiter, "\n")
        i += 1
    return quoted


def first_record(lines: Iterable[str]) -> str | None:
    """The first record that is not empty, across line breaks in quotes; ``lines`` is left there."""
    record = None
    for line in lines:
        line = line.removesuffix("\r")
        if record is None:
            line = line.removeprefix("﻿")
            if not line:
                continue
        record = line if record is None else f"{record}\n{line}"
        if not open_quote(record):
            break
    return record


def open_file(path: str) -> pa.NativeFile:
    """A file by the path that Spark's scans give, decompressed by its name."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        system, name = pa.fs.LocalFileSystem(), path.removeprefix("file:")
    else:
        at = path.index(":") + 1
        system, name = pa.fs.FileSystem.from_uri(path[:at] + quote(path[at:]))
    return system.open_input_stream(name, compression="detect")


def read_header(source: io.RawIOBase) -> str | None:
    """First record of an open file."""
    text = io.TextIOWrapper(io.BufferedReader(source, BLOCK), "utf-8", errors="replace", newline="\n")
    return first_record(line.removesuffix("\n") for line in text)


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header, opened) of the files that hold a byte."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                try:
                    with open_file(file) as source:
                        header, opened = read_header(source), True
                except (OSError, ValueError, NotImplementedError):
                    header, opened = None, False  # pyarrow does not know the store or may not read it
                columns = [pa.array([file]), pa.array([header], pa.string()), pa.array([opened])]
                yield pa.RecordBatch.from_arrays(columns, ["file", "header", "opened"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(read, FOUND)


def headers_by_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same by Spark's reader, from the lines of every file's first block."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        for batch in batches:
            for file, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(file, [])
                record = "\n".join(own)
                if not own or not record or open_quote(record):
                    own.append(line)
        rows = [(file, first_record(own)) for file, own in held.items()]
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([True] * len(rows))], ["file", "header", "opened"])

    return lines.filter("block = 0").select("file", "value").mapInArrow(first, FOUND)


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files below ``path`` that hold a record, grouped by their header record."""
    for find in (headers, headers_by_lines):
        found = find(spark, path).groupBy("header").agg(
            F.sort_array(F.collect_list("file")).alias("files"), F.bool_and("opened").alias("opened")
        )
        groups = found.collect()
        if all(g["opened"] for g in groups):
            break
    return [g["files"] for g in sorted(groups, key=lambda g: g["header"] or "") if g["header"] is not None]

"""Packing token ids into rows of one length: best fit, longest first.

Documents longer than a row are cut into pieces of full rows and a rest; nothing is lost.  The
pieces of a shard are placed by decreasing length, each into the row with the least room that
holds it; a segment tree over the possible amounts of room finds that row in log2(length) steps.
A shard is what a task reads, in runs of at most ``SHARD_TOKENS`` tokens, so ids are not shuffled
and a task holds a bounded number of them.

``write`` puts packed rows into binary files, four for each run of a shard, as little-endian numbers
without a header: ``ids`` is the id matrix (uint32), ``cu_seqlens`` and ``position_resets`` (int32)
are those of its rows one after the other, ``documents`` (int64) has document and first token of
every segment, and a null id as the smallest number.  Tasks write under a temporary name and rename,
and a run always has the same name, so a repeated task replaces its own files.  The manifest, a table
that Spark commits at the end, says which files count and how they are cut; ``read`` goes by it.

Defined cases: a document without tokens has no segment; repeated rows are packed each; a null id
is kept as null; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

LENGTH = 2048
SHARD_TOKENS = 2**22
#: Pieces a shard may hold besides; short documents count as 16 tokens.
LEAST_COST = 16
#: Rows sent back at once.
ROWS = 512

ROW = (
    "shard bigint, shard_run int, row int, n_tokens int, doc_ids array<bigint>, starts array<bigint>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)

SCHEMA = pa.schema(
    [
        ("shard", pa.int64()), ("shard_run", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()),
    ]
)


class Room:
    """Open rows by the room they have left; a segment tree of counts over 0..length."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.counts = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        i = self.base + room
        while i:
            self.counts[i] += n
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room that is at least ``need``, and that room."""
        i = self.base + need
        if not self.counts[i]:
            # Up until a right sibling has rows, then down its leftmost way.
            while i > 1 and not (i % 2 == 0 and self.counts[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.counts[2 * i] else 2 * i + 1
        room = i - self.base
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of indices into ``lengths``, none of which exceeds ``length``."""
    rows: list[list[int]] = []
    room = Room(length)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        if found is None:
            rows.append([i])
            left = length - lengths[i]
        else:
            rows[found[0]].append(i)
            left = found[1] - lengths[i]
        if left:
            room.put(len(rows) - 1 if found is None else found[0], left)
    return rows


def pack_shard(pieces: list[tuple[int | None, int, bytes]], length: int, pad: int) -> Iterator[dict]:
    """Packed rows of pieces (doc_id, first token, ids of at most ``length`` tokens)."""
    empty = np.array([pad], "<u4").tobytes()
    for number, row in enumerate(best_fit([len(x[2]) // 4 for x in pieces], length)):
        own = [pieces[i] for i in row]
        ends = [0]
        for _, _, ids in own:
            ends.append(ends[-1] + len(ids) // 4)
        yield {
            "row": number,
            "n_tokens": ends[-1],
            "doc_ids": [x[0] for x in own],
            "starts": [x[1] for x in own],
            "cu_seqlens": ends,
            # Positions count from 0 again at each of these, the padding included.
            "position_resets": ends if ends[-1] < length else ends[:-1],
            "ids": b"".join(x[2] for x in own) + empty * (length - ends[-1]),
        }


@lru_cache(2)
def library(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the library's ids of every text, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(path, pattern).encode_to_numpy
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                ids = [encode(x.as_py(), disallowed_special=()).astype("<u4").tobytes() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def packed(tokens: DataFrame, pad: int, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows of ``tokens`` (doc_id, ids as little-endian unsigned 32-bit integers).

    ``ids`` of a row is its line of the id matrix, ``length`` ids padded with ``pad``;
    ``cu_seqlens`` cumulates the segment lengths; ``position_resets`` are the places where
    positions begin at 0; ``doc_ids`` and ``starts`` say which tokens of which document stand there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int | None, int, bytes]] = []
        cost, runs, shard = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for x in pack_shard(pieces, length, pad):
                out.append(x | {"shard": shard, "shard_run": runs})
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_pylist(out, SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

        for batch in batches:
            for shard, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                for at in range(0, len(ids), 4 * length):
                    pieces.append((doc, at // 4, ids[at : at + 4 * length]))
                    cost += max(len(pieces[-1][2]) // 4, LEAST_COST)
                    if cost >= shard_tokens:
                        yield from flush()
                        pieces, cost, runs = [], 0, runs + 1
        yield from flush()

    ship(tokens.sparkSession)
    rows = tokens.select(F.spark_partition_id().cast("bigint").alias("shard"), F.col("doc_id").cast("bigint"), "ids")
    return rows.filter(F.octet_length("ids") > 0).mapInArrow(run, ROW)


PARTS = ("ids", "cu_seqlens", "position_resets", "documents")
NO_ID = -(2**63)
MANIFEST = (
    "shard bigint, shard_run int, length int, rows int, n_tokens bigint, segments array<int>, resets array<int>, "
    "files array<string>"
)


def _numbers(rows: list[dict]) -> dict[str, np.ndarray]:
    """The binary content of the rows of a run."""
    flat = lambda name, kind: np.array([v for x in rows for v in x[name]], kind)
    ids = [NO_ID if v is None else v for x in rows for v in x["doc_ids"]]
    return {
        "ids": np.frombuffer(b"".join(x["ids"] for x in rows), "<u4"),
        "cu_seqlens": flat("cu_seqlens", "<i4"),
        "position_resets": flat("position_resets", "<i4"),
        "documents": np.stack([np.array(ids, "<i8"), flat("starts", "<i8")], axis=1),
    }


def write(
    tokens: DataFrame, pad: int, directory: str, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Packs ``tokens``, writes the files below ``directory``, a new shared folder, and returns the manifest.

    The folder is one that pyarrow can open from the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def saved(rows: list[dict]) -> pa.RecordBatch:
            first, names = rows[0], []
            for part, values in _numbers(rows).items():
                name = f"{directory}/{first['shard']:08}-{first['shard_run']:06}.{part}"
                with_system(name, lambda system, path: save(system, path, values.tobytes()))  # noqa: B023
                names.append(name)
            out = {
                "shard": first["shard"], "shard_run": first["shard_run"], "length": length, "rows": len(rows),
                "n_tokens": sum(x["n_tokens"] for x in rows), "segments": [len(x["doc_ids"]) for x in rows],
                "resets": [len(x["position_resets"]) for x in rows], "files": names,
            }
            return pa.RecordBatch.from_pylist([out], manifest)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard_run"] != held[0]["shard_run"]:
                    yield saved(held)
                    held = []
                held.append(row)
        if held:
            yield saved(held)

    def save(system: pa.fs.FileSystem, path: str, content: bytes) -> None:
        hidden = f"{path}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(hidden) as out:
            out.write(content)
        system.move(hidden, path)

    manifest = pa.schema(
        [
            ("shard", pa.int64()), ("shard_run", pa.int32()), ("length", pa.int32()), ("rows", pa.int32()),
            ("n_tokens", pa.int64()), ("segments", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
            ("files", pa.list_(pa.string())),
        ]
    )
    with_system(directory, lambda system, path: system.create_dir(path, recursive=True))
    # One pass: a run's rows reach the writer together, from the task that packed them.
    packed(tokens, pad, length, shard_tokens).mapInArrow(run, MANIFEST).write.parquet(f"{directory}/manifest")
    return tokens.sparkSession.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def read(spark: SparkSession, directory: str) -> DataFrame:
    """The packed rows of the files that the manifest names, as ``packed`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                raw = [with_system(f, lambda system, path: system.open_input_file(path).read()) for f in x["files"]]
                ids, ends, resets, documents = (np.frombuffer(r, k) for r, k in zip(raw, ("<u4", "<i4", "<i4", "<i8"), strict=True))
                documents, width, a, b = documents.reshape(-1, 2), x["length"], 0, 0
                for row, (n, r) in enumerate(zip(x["segments"], x["resets"], strict=True)):
                    own, cu = documents[a : a + n], ends[a + row : a + row + n + 1].tolist()
                    out = {
                        "shard": x["shard"], "shard_run": x["shard_run"], "row": row, "n_tokens": cu[-1],
                        "doc_ids": [None if v == NO_ID else v for v in own[:, 0].tolist()], "starts": own[:, 1].tolist(),
                        "cu_seqlens": cu, "position_resets": resets[b : b + r].tolist(),
                        "ids": ids[row * width : (row + 1) * width].tobytes(),
                    }
                    yield pa.RecordBatch.from_pylist([out], SCHEMA)
                    a, b = a + n, b + r

    ship(spark)
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest").mapInArrow(run, ROW)


def with_system(path: str, act: Callable):
    """``act`` with the file system of a path and the path there."""
    at = path.find(":")
    if at < 0 or path.startswith("file:"):
        return act(pa.fs.LocalFileSystem(), path.removeprefix("file:"))
    return act(*pa.fs.FileSystem.from_uri(path[: at + 1] + quote(path[at + 1 :])))

"""Exact top-k by integer inner product over a bit-sliced index.

The index holds, for a block of vectors, one bitmap per bit of each quantised component.  A query
adds the slices, each as often as its weight says, with carry-save adders on whole bitmaps; the
sum's slices are then walked from the most significant downward.  Rows still tied at the end have
the same score and are resolved by the smaller id.  Every query meets every block.

Defined cases: vectors that are null, hold null or non-finite components or ones whose quantised
value does not fit 53 bits, and null ids, take no part; of several rows with one id each takes part
and answers, and meets the others; a score beyond 64 bits is null, its rank is right; missing trailing components count as 0; fewer candidates than k are all
returned; an empty table gives an empty result; columns that are not named are not looked at.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored

SCALE = 64
#: Rows of an index block and queries of a unit of work, at most about.
BLOCK, UNIT = 2**15, 2**12
LIMIT = 2**53

INDEX = "block int, n int, dims int, ids binary, rows binary, lows binary, bits binary, slices binary"
#: ``over`` is the score where it does not fit 64 bits; of 38 digits as components have 53 bits.
FOUND = "query_id bigint, query_row bigint, vec_id bigint, score bigint, over decimal(38,0)"


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, row, q): floor(scale * component) of the vectors that take part, with a row number.

    The number is generated, so the result is to be stored before it is used twice.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(
        F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(LIMIT))
    )
    return (
        vectors.select(F.col(id).cast("bigint").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(sound, F.lit(False)))
        .select("vec_id", F.monotonically_increasing_id().alias("row"), F.transform("x", lambda v: F.floor(v * scale)).alias("q"))
    )


def _part(id: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(parts)).cast("int")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, short ones filled with 0."""
    flat = column.combine_chunks()
    lengths = np.diff(np.asarray(flat.offsets))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(flat.flatten())
    return out


def _slices(table: pa.Table) -> pa.Table:
    """One row of the index from the vectors of a block, in the order of their ids."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    x = _matrix(table.column("q"))
    lows = x.min(axis=0) if x.shape[1] else np.zeros(0, np.int64)
    x = x - lows
    bits = np.array([int(v).bit_length() for v in x.max(axis=0, initial=0)], np.int32)
    rows = -(-len(x) // 64) * 64
    maps = np.zeros((int(bits.sum()), rows), np.uint8)
    k = 0
    for d, n in enumerate(bits):
        for b in range(n):
            maps[k, : len(x)] = (x[:, d] >> b) & 1
            k += 1
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "n": pa.array([len(x)], pa.int32()),
            "dims": pa.array([x.shape[1]], pa.int32()),
            "ids": [np.asarray(table.column("vec_id"), np.int64).tobytes()],
            "rows": [np.asarray(table.column("row"), np.int64).tobytes()],
            "lows": [lows.astype("<i8").tobytes()],
            "bits": [bits.astype("<i4").tobytes()],
            "slices": [np.packbits(maps, axis=1, bitorder="little").tobytes()],
        }
    )


def build_index(q: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index of all rows of ``quantised``: one row per block of at most about ``block``."""
    ship(q.sparkSession)
    blocks = max(1, math.ceil(q.count() / block))
    return q.withColumn("block", _part("vec_id", blocks)).groupBy("block").applyInArrow(_slices, INDEX)


class Block:
    """A block of the index, opened for queries."""

    def __init__(self, n: int, ids: bytes, rows: bytes, lows: bytes, bits: bytes, slices: bytes):
        self.n, self.ids, self.rows = n, np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.lows = np.frombuffer(lows, "<i8").tolist()
        self.bits = np.frombuffer(bits, "<i4").tolist()
        words = -(-n // 64)
        self.plain = np.frombuffer(slices, "<u8").reshape(-1, words)
        self.turned = ~self.plain
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).tolist()
        self.all = np.frombuffer(np.packbits(np.arange(words * 64) < n, bitorder="little").tobytes(), "<u8")

    def add(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the weighted sum and what is to be added to it.

        A negative weight takes the complement, weight * (ones - x), so that all is added.
        """
        columns: list[list[np.ndarray]] = []
        constant = 0
        for d, w in enumerate(weights[: len(self.bits)]):
            if not w:
                continue
            n, source = self.bits[d], self.plain if w > 0 else self.turned
            constant += w * self.lows[d] - (0 if w > 0 else -w * ((1 << n) - 1))
            size = abs(w)
            while len(columns) < n + size.bit_length():
                columns.append([])
            for b in range(size.bit_length()):
                if size >> b & 1:
                    for j in range(n):
                        columns[b + j].append(source[self.first[d] + j])
        out, i = [], 0
        while i < len(columns):
            column = columns[i]
            if len(column) > 1 and i + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                columns[i + 1].append((a & b) | (half & c))
                column.append(half ^ c)
            if len(column) == 2:
                a, b = column
                columns[i + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.all))
            i += 1
        return out, constant

    def top(self, weights: list[int], k: int, own: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but row ``row`` of id ``own``."""
        sums, constant = self.add(weights)
        tied, sure, need = self.all.copy(), np.zeros_like(self.all), k
        first, last = (int(np.searchsorted(self.ids, own, side)) for side in ("left", "right"))
        at = first + int(np.searchsorted(self.rows[first:last], row))
        if at < last and self.rows[at] == row:
            tied[at >> 6] &= ~np.uint64(1 << (at & 63))
        for slice_ in reversed(sums):
            ones = tied & slice_
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                tied = ones
            else:
                sure |= ones
                tied ^= ones
                need -= count
        # Rows stand in the order of their ids: of equal scores the first are the smaller ids.
        chosen = np.concatenate([self._rows(sure), self._rows(tied)[:need]])
        wide = len(sums) > 61 or abs(constant) >= 2**61
        scores = np.full(len(chosen), constant, object if wide else np.int64)
        for i, slice_ in enumerate(sums):
            scores += ((slice_[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(scores.dtype) << i
        return self.ids[chosen], scores

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(index: DataFrame, queries: DataFrame, k: int, unit: int = UNIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query, of all other rows.

    ``index`` is stored.  A unit of work is a block and a group of queries; a block's k best rows
    of each query are ranked with those of the other blocks.
    """
    ship(index.sparkSession)
    blocks, asked = index.count(), queries.count()
    spread = 2 * index.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(asked / unit), min(math.ceil(asked / 64), math.ceil(spread / max(1, blocks))))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    left = index.withColumn("part", numbers(groups)).groupBy("block", "part")
    right = queries.withColumn("part", _part("vec_id", groups)).withColumn("block", numbers(blocks))

    def answer(block: pa.Table, asking: pa.Table) -> pa.Table:
        ids, rows, found, scores = [], [], [], []
        if len(block) and len(asking):
            b = block.select(["n", "ids", "rows", "lows", "bits", "slices"]).to_pylist()[0]
            opened = Block(**b)
            columns = [asking.column(c).to_pylist() for c in ("vec_id", "row", "q")]
            for q, row, w in zip(*columns, strict=True):
                best, score = opened.top(w, k, q, row)
                ids.append(np.full(len(best), q, np.int64))
                rows.append(np.full(len(best), row, np.int64))
                found.append(best)
                scores.append(score)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        score, over = join(scores), pa.nulls(sum(map(len, scores)), pa.decimal128(38))
        if score.dtype == object:
            fits = np.array([abs(v) < 2**63 for v in score], bool)
            over = pa.array([None if f else Decimal(v) for v, f in zip(score, fits, strict=True)], pa.decimal128(38))
            score = pa.array([int(v) if f else None for v, f in zip(score, fits, strict=True)], pa.int64())
        names = ["query_id", "query_row", "vec_id", "score", "over"]
        return pa.table([join(ids), join(rows), join(found), score, over], names)

    order = W.partitionBy("query_id", "query_row").orderBy(F.coalesce("over", "score").desc(), "vec_id")
    return (
        left.cogroup(right.groupBy("block", "part"))
        .applyInArrow(answer, FOUND)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k(
    vectors: DataFrame, asked: Column, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``search`` over all rows, for the rows with ``asked`` (a condition on vec_id) as queries."""
    q = stored(quantised(vectors, id, vector, scale), "topk-quantised")
    return search(stored(build_index(q), "topk-index"), q.filter(asked), k)

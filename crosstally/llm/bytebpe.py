"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a pre-token has one encoding, so it has one last token: the only vocabulary entry
that ends the prefix and may follow the last token of what comes before it.  One array of last
tokens therefore holds the encodings of all prefixes.  Appending extends the array; after an edit
it is recomputed from the edit until it agrees with what it was.

Defined cases: a null or empty text has no tokens; repeated rows are encoded each; an empty table
gives an empty result; columns that are not named are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: What a process keeps of encodings, of verdicts on pairs and of beginnings of pre-tokens: this many
#: of the latest, and as many that came before.
MEMO = 2**17
#: Bytes of the beginnings whose last tokens are kept, to append the rest to.
HEADS = (4, 6, 8, 12)
#: After every rank.
NEVER = 1 << 60


class Memo:
    """The latest values by key, in two generations; a used old one becomes new."""

    def __init__(self, size: int = MEMO):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value


class Vocabulary:
    """Ranks of a vocabulary file (base64 token and rank per line)."""

    def __init__(self, path: str):
        lines = (x.split() for x in Path(path).read_bytes().splitlines() if x)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self.longest = max(self.sizes.values())
        #: Every ending of a token, with its rank if it is one itself: walking back from a byte
        #: stops where nothing longer can end.
        self.endings = {t[i:]: -1 for t in self.ranks for i in range(1, len(t))} | self.ranks
        self.pairs = Memo()
        self._growth: dict[tuple[int, int], list[tuple[bytes, int]]] = {}

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition: merge the neighbours of lowest rank, leftmost first, while any merge
        and there are more than ``least`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            ranked = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            lowest = min(ranked)
            if lowest == NEVER:
                break
            i = ranked.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether the two stand side by side in the encoding of their bytes."""
        key = before << 20 | token
        known = self.pairs.get(key)
        return self.pairs.put(key, self._apart(before, token)) if known is None else known

    def _apart(self, before: int, token: int) -> bool:
        """No merge crosses the border between the two tokens.

        Merges happen in the order of their ranks.  The last part before the border grows along
        one list, the first part after it along another; two parts that stand there at the same
        time merge if their token's rank comes before the growth of either (leftmost first).
        """
        left, right = self.growth(before, -1), self.growth(token, 0)
        i = j = 0
        while True:
            rank = self.ranks.get(left[i][0] + right[j][0])
            if rank is not None and rank < left[i][1] and rank <= right[j][1]:
                return False
            if left[i][1] <= right[j][1]:
                if left[i][1] == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def growth(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that a token's first (0) or last (-1) byte goes through, each with the rank
        of the merge that ends it."""
        known = self._growth.get((token, side))
        if known is None:
            known = [(self.tokens[token], NEVER)]
            while len(part := known[-1][0]) > 1:
                known.append((self.merged(part, 2)[side], self.ranks[part]))
            known = self._growth[token, side] = known[::-1]
        return known

    def begins(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        known = self.pairs.get(-1 - token)
        if known is None:
            known = self.pairs.put(-1 - token, self.merged(self.tokens[token]) == [self.tokens[token]])
        return known


class Prefixes:
    """A piece of bytes with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"", last: list[int] | None = None):
        """``last``: the last tokens of the piece's prefixes, where they are known."""
        self.vocabulary, self.piece, self.last = vocabulary, piece, list(last or ())
        self._extend(len(piece))

    def _extend(self, end: int) -> None:
        """Last tokens of the prefixes up to ``end``, from where they stop."""
        v, piece, last = self.vocabulary, self.piece, self.last
        ending, sizes, pairs = v.endings.get, v.sizes, v.pairs
        for stop in range(len(last) + 1, end + 1):
            found = []
            start = stop - 1
            while start >= 0 and (token := ending(piece[start:stop])) is not None:
                if token >= 0:
                    found.append(token)
                start -= 1
            # One of them fits, most often a long one.
            for token in reversed(found):
                start = stop - sizes[token]
                if start:
                    before = last[start - 1]
                    fits = pairs.new.get(before << 20 | token)
                    if fits is None:
                        fits = v.follows(before, token)
                else:
                    fits = v.begins(token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")

    def append(self, more: bytes) -> None:
        """Extends the piece; what stands already keeps its last tokens."""
        self.piece += more
        self._extend(len(self.piece))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` for the bytes ``start:stop``; returns how many prefixes were recomputed.

        Past the edit a last token depends on the ``longest`` bytes and last tokens before it, so
        once that many in a row are as they were, the rest is too.
        """
        old, longest = self.last, self.vocabulary.longest
        shift = len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last, alike, end = old[:start], 0, start
        while end < len(self.piece):
            end += 1
            self._extend(end)
            before = end - shift
            alike = alike + 1 if before > stop and self.last[-1] == old[before - 1] else 0
            if alike >= longest and before - stop > longest:
                self.last += old[before:]
                break
        return end - start

    def tokens(self) -> list[int]:
        ids, end, sizes = [], len(self.last), self.vocabulary.sizes
        while end:
            ids.append(token := self.last[end - 1])
            end -= sizes[token]
        return ids[::-1]


class Encoder:
    """Texts to ids and back, each match of the pattern on its own."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(path), regex.compile(pattern)
        self._memo, self._heads = Memo(), Memo()

    def prefixes(self, raw: bytes) -> Prefixes:
        """The piece's prefixes; its beginning may be known from another piece."""
        heads = sum(n < len(raw) for n in HEADS)
        return Prefixes(self.vocabulary, raw, self._head(raw, heads - 1) if heads else None)

    def _head(self, raw: bytes, k: int) -> list[int]:
        """The last tokens of the first ``HEADS[k]`` bytes, from those of the shorter beginnings."""
        head = raw[: HEADS[k]]
        last = self._heads.get(head)
        if last is None:
            shorter = self._head(raw, k - 1) if k else None
            last = self._heads.put(head, Prefixes(self.vocabulary, head, shorter).last)
        return last

    def piece(self, text: str) -> bytes:
        known = self._memo.get(text)
        if known is None:
            raw = text.encode()
            token = self.vocabulary.ranks.get(raw)  # a whole token stands for itself
            ids = [token] if token is not None else self.prefixes(raw).tokens()
            known = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) <= 64:
                self._memo.put(text, known)
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pattern.findall(text)
        known = list(map(self._memo.new.get, pieces))
        return b"".join([self.piece(p) if ids is None else ids for p, ids in zip(pieces, known, strict=True)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a process and vocabulary."""
    return Encoder(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            ids = [e.encode(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes that the ids stand for."""
    ship(tokens.sparkSession)
    shape = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            back = pa.array([e.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), back],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, shape)


def round_trip(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and the hashes of ids and of decoded bytes.

    Encodes and decodes in one pass: a task holds the ids of one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            n, before, after = [], [], []
            for x in batch.column("text"):
                ids = e.encode(x.as_py())
                n.append(len(ids) // 4)
                before.append(hashlib.sha256(ids).hexdigest())
                after.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

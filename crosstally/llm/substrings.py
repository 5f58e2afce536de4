"""Near-duplicate passages by compact windows.

For one hash function all passages of at least ``WORDS`` words whose smallest shingle is the same
one form a compact window (left, place, right): their smallest value stands at ``place``, and
left..right is how far nothing smaller stands, which the Cartesian tree of the values tells.  Texts
whose windows share a value are candidates; where the windows of enough hash functions overlap,
the regions are compared word by word.  A passage pair is reported when it has at least ``WORDS``
words and its shingle sets a similarity of at least ``PERCENT``.

Equal texts are one text.  ``PERCENT`` of a passage's shingles stand in the other text too, so a
passage lies where enough shingles are found at two places or more of all texts.  These stretches
are found first, by exchanging the hashes of all shingles, and only they have windows.

Of the windows that share a value, each is first paired with that of the
first text (the smallest hash of a text).  Where three or more texts share the value, every window
whose place no confirmed passage with a smaller text covers is then compared, in blocks, with those
of all smaller texts until one does, and if none does and its place is in no passage, with those of
the larger ones.

Defined cases: A-Z count as a-z; null, empty and short texts have no passages; repeated rows are
copies, which are duplicates as a whole if they are long enough; an empty table gives an empty
result; columns that are not named are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, drop, fresh, ship, stored, whole, words

SIZE, WORDS, PERCENT = 5, 50, 80
#: Hash functions, and how many must agree: at 0.8 a pair is missed with probability 0.002.
HASHES, ENOUGH = 6, 2
#: Shingles without a counterpart that a passage may hold in a row.
GAP = 20
#: Windows of a value that a unit of the later comparison holds on a side, at most about.
BLOCK = 2**10
#: Texts, pairs or windows of an Arrow batch.
BATCH = 500
#: Shingles whose windows are built together, at most, where texts have fewer.
STACK = 2**17
#: Shingles of a bucket in which equal ones are looked for, about, and shingles sent at once.
BUCKET, SENT = 2**19, 2**19
#: Words whose hashes a process keeps.
MEMO = 2**18

_random = np.random.default_rng(6)
FACTORS = _random.integers(0, 2**63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)
XOR = _random.integers(0, 2**63, HASHES, np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
NEVER = -(2**40)
#: Windows of at most so many shingles are looked at side by side, so many at a time.
SIDE, ABREAST = 1024, 256
#: A value's upper bits order the shingles, its lower ones say where they stand.
PLACE = 28

SENT_ROW = "slot bigint, block bigint, bucket int, sizes binary, data binary"
STRETCHES = "text_key bigint, stretches array<struct<first:int,last:int>>"
WINDOW = "value bigint, text_key bigint, place int, left int, right int"
PAIR = "value bigint, a bigint, b bigint, hash int, ap int, al int, ar int, bp int, bl int, br int"
MEMBER = "value bigint, i int, j int, own int, text_key bigint, place int, left int, later boolean, told boolean, words string"
PASSAGE = "a bigint, b bigint, a_start int, a_end int, b_start int, b_end int, similarity double"


class WordHashes(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(w: list[bytes], memo: WordHashes) -> np.ndarray:
    n = len(w) - SIZE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    mixed = np.zeros(n, np.uint64)
    for k in range(SIZE):
        mixed += h[k : k + n] * FACTORS[k]
    return mixed ^ (mixed >> np.uint64(31))


def stacked_windows(values: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """(text, place, left, right) of all compact windows of at least ``least`` values in several
    texts, whose values stand one after another; places count from the first text's first value.

    Only a place that is the smallest of some stretch of ``least`` values has one, so the Cartesian
    tree is built over these few: the nearest smaller value of such a place is one of them.
    """
    n, ends = len(values), np.cumsum(sizes)
    if n < least:
        return np.zeros((0, 4), np.int64)
    ranked = (values >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(n, dtype=np.uint64)
    best, width = ranked, 1
    while 2 * width <= least:
        best, width = np.minimum(best[:-width], best[width:]), 2 * width
    if width < least:
        best = np.minimum(best[: n - least + 1], best[least - width :])
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(text[: n - least + 1] == text[least - 1 :])
    best = best[inside]
    best = best[np.flatnonzero(np.diff(best, prepend=best[:1] ^ np.uint64(1)))]
    places = (best & np.uint64(2**PLACE - 1)).astype(np.int64)
    owners = text[places]
    out = np.stack([owners, places, ends[owners] - sizes[owners], ends[owners] - 1], axis=1)
    at, owner, best = places.tolist(), owners.tolist(), best.tolist()
    left, right, stack, current = out[:, 2].tolist(), out[:, 3].tolist(), [], -1
    for i, v in enumerate(best):
        if owner[i] != current:
            stack, current = [], owner[i]
        while stack and best[stack[-1]] > v:
            right[stack.pop()] = at[i] - 1
        if stack:
            left[i] = at[stack[-1]] + 1
        stack.append(i)
    out[:, 2], out[:, 3] = left, right
    return out


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place, left, right) of all compact windows of one text."""
    return [tuple(x) for x in stacked_windows(values, np.array([len(values)]), least)[:, 1:].tolist()]


def _once(x: np.ndarray) -> np.ndarray:
    """One row for each value of a text: the first place, and what all its windows cover.

    A line that a text repeats would otherwise send the same value once per repetition.
    """
    x = x[np.lexsort((x[:, 2], x[:, 0], x[:, 1]))]
    new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)]) if len(x) else np.zeros(0, bool)
    if new.all():
        return x
    first = np.flatnonzero(new)
    out = x[first]
    out[:, 3] = np.minimum.reduceat(x[:, 3], first)
    out[:, 4] = np.maximum.reduceat(x[:, 4], first)
    return out


def _stacks(hashes: Iterator[tuple[int, int, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, firsts, sizes, shingles) of stretches of several texts at a time, at most ``most``
    shingles or one text.  A stretch begins at the text's shingle ``first``."""
    listed, n = [], 0
    for x in hashes:
        if listed and n + len(x[2]) > most and x[0] != listed[-1][0]:
            yield _stack(listed)
            listed, n = [], 0
        listed.append(x)
        n += len(x[2])
    if listed:
        yield _stack(listed)


def _stack(listed: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    keys, firsts, held = zip(*listed, strict=True)
    return np.array(keys, np.int64), np.array(firsts), np.array([len(x) for x in held]), np.concatenate(held)


def dense(known: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last place of the stretches in which passages may lie: what all those of at least
    ``least`` places cover of which ``PERCENT`` are ``known``, the first and the last among them."""
    n = len(known)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(np.where(known, 100 - PERCENT, -PERCENT), out=upto[1:])
    best = np.maximum.accumulate(np.where(known, upto[1:], NEVER)[::-1])[::-1]  # the highest sum up to any later end
    ends = np.searchsorted(-best, -upto[:n], side="right")  # the last one that does for a start
    starts = np.flatnonzero(known & (ends - np.arange(n) >= least))
    cover = np.bincount(starts, minlength=n + 1) - np.bincount(ends[starts], minlength=n + 1)
    borders = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
    return [(int(x), int(y) - 1) for x, y in zip(borders[::2], borders[1::2], strict=True)]


def _sent(texts: DataFrame, buckets: int) -> DataFrame:
    """``SENT_ROW``: the shingles of a block of texts by bucket, and with bucket -1 the texts' keys
    and sizes and the buckets of their shingles, in order."""
    kind = next(x for x in (np.uint8, np.uint16, np.uint32) if buckets - 1 <= np.iinfo(x).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        texts_ = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("text_key", "text")), strict=True) for b in batches)
        hashes = ((key, 0, shingle_hashes(t.encode().lower().split(), memo)) for key, t in texts_)
        for keys, _, sizes, h in _stacks((x for x in hashes if len(x[2]) > WORDS - SIZE), SENT):
            sizes = np.stack([keys, sizes]).tobytes()
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(kind)
            low = h.astype(np.uint32)[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            parts = [x.tobytes() for x in np.split(low, ends[:-1])]
            # Rows of a bucket go to its number, the block's own to the block's.
            block = np.int64(np.uint64(xxhash.xxh3_64_intdigest(sizes)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*range(buckets), block], pa.int64()), pa.array([block] * (buckets + 1), pa.int64()),
                    pa.array([*range(buckets), -1], pa.int32()), pa.array([None] * buckets + [sizes], pa.binary()),
                    pa.array([*parts, bucket.tobytes()], pa.binary()),
                ],
                ["slot", "block", "bucket", "sizes", "data"],
            )

    ship(texts.sparkSession)
    return texts.select("text_key", "text").mapInArrow(run, SENT_ROW)


def _met(sent: DataFrame) -> DataFrame:
    """``SENT_ROW`` with bits for the shingles: whether one's hash is found again in its bucket."""

    def told(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        blocks, parts = zip(*held, strict=True)
        x = np.concatenate([np.frombuffer(p, np.uint32) for p in parts])
        order = np.argsort(x)
        equal = np.diff(x[order]) == 0
        known = np.zeros(len(x), bool)
        known[order[1:][equal]] = known[order[:-1][equal]] = True
        bits = [np.packbits(y).tobytes() for y in np.split(known, np.cumsum([len(p) // 4 for p in parts])[:-1])]
        return batch_of([(b, b, bucket, None, y) for b, y in zip(blocks, bits, strict=True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["slot", "block", "bucket", "sizes", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = -1, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if row[2] < 0:
                    yield batch_of([row])
                    continue
                if row[2] != current and held:
                    yield told(current, held)
                    held = []
                current = row[2]
                held.append((row[1], row[4]))
        if held:
            yield told(current, held)

    order = sent.repartition("slot").sortWithinPartitions("bucket", "block")
    return order.mapInArrow(run, SENT_ROW)


def _stretched(met: DataFrame) -> DataFrame:
    """``STRETCHES`` of the texts that have any."""
    least = WORDS - SIZE + 1

    def block(rows: dict[int, tuple[bytes, bytes]]) -> Iterator[dict]:
        keys, sizes = np.frombuffer(rows[-1][0], np.int64).reshape(2, -1)
        buckets = np.frombuffer(rows[-1][1], f"u{len(rows[-1][1]) // sizes.sum()}")
        order, counts = np.argsort(buckets, kind="stable"), np.bincount(buckets)
        ends, known = np.cumsum(counts), np.zeros(len(buckets), bool)
        for k, n in enumerate(counts.tolist()):  # a bucket that did not come is an error
            known[order[ends[k] - n : ends[k]]] = np.unpackbits(np.frombuffer(rows[k][1], np.uint8), count=n)
        begins = np.cumsum(sizes) - sizes
        some = np.add.reduceat(known, begins, dtype=np.int64)
        for i in np.flatnonzero(100 * some >= PERCENT * least).tolist():
            if found := dense(known[begins[i] : begins[i] + sizes[i]], least):
                yield {"text_key": int(keys[i]), "stretches": [{"first": x, "last": y} for x, y in found]}

    schema = pa.schema([("text_key", pa.int64()), ("stretches", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for batch in batches:
            for _, key, bucket, *row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if key != current and held:
                    yield pa.RecordBatch.from_pylist(list(block(held)), schema)
                    held = {}
                current = key
                held[bucket] = row  # of rows that a table repeats there may be two equal blocks
        if held:
            yield pa.RecordBatch.from_pylist(list(block(held)), schema)

    order = met.repartition("slot").sortWithinPartitions("block", "bucket")
    return order.mapInArrow(run, STRETCHES)


def stretches(texts: DataFrame, shingles: int) -> DataFrame:
    """``STRETCHES``, stored: where texts may have passages.  ``shingles`` is about how many there are.

    A passage of a text has at least ``WORDS - SIZE + 1`` places, of whose shingles ``PERCENT`` stand
    in the other text too.  Shingles with a hash that no other place has stand in no other text, so
    no passage is lost; equal hashes of different shingles only leave more to be compared.
    """
    found = _stretched(_met(_sent(texts, max(1, -(-shingles // BUCKET)))))
    # A row that the table repeats has been sent twice.
    return stored(found.dropDuplicates(["text_key"]), "passage-stretches", BATCH)


def _windows(texts: DataFrame) -> DataFrame:
    """Compact windows of the stretches of (text_key, text, stretches), values numbered by hash
    function in the low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()

        def hashes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
            for key, text, found in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "stretches")), strict=True):
                h = shingle_hashes(text.encode().lower().split(), memo)
                for x in found:
                    yield key, x["first"], h[x["first"] : x["last"] + 1]

        for batch in batches:
            for keys, firsts, sizes, h in _stacks(hashes(batch), STACK):
                shift, rows = np.cumsum(sizes) - sizes - firsts, []
                for k in range(HASHES):
                    values = (h ^ XOR[k]) * ODD
                    values ^= values >> np.uint64(32)
                    found = stacked_windows(values, sizes, WORDS - SIZE + 1)
                    x = np.empty((len(found), 5), np.int64)
                    x[:, 0] = (values[found[:, 1]] // np.uint64(HASHES) * np.uint64(HASHES) + np.uint64(k)).view(np.int64)
                    x[:, 1] = keys[found[:, 0]]
                    x[:, 2:] = found[:, 1:] - shift[found[:, 0]][:, None]
                    rows.append(_once(x))
                out = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(out[:, i]) for i in (0, 1)), *(pa.array(out[:, i].astype(np.int32)) for i in (2, 3, 4))],
                    ["value", "text_key", "place", "left", "right"],
                )

    ship(texts.sparkSession)
    return texts.select("text_key", "text", "stretches").mapInArrow(run, WINDOW)


def _sharing(windows: DataFrame) -> DataFrame:
    """Pairs of windows with one value in different texts: each with the first one's.

    Windows stream by in the order of their values; only the first of a value is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            if not len(x):
                continue
            if held is not None:
                x = np.concatenate([held, x])
            start = np.concatenate([[True], x[1:, 0] != x[:-1, 0]])
            first = np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))
            held = x[first[-1]][None, :]
            other = np.flatnonzero(x[:, 1] != x[first, 1])
            a, b = x[first[other]], x[other]
            hashes = (b[:, 0].view(np.uint64) % np.uint64(HASHES)).astype(np.int32)
            small = [y[:, k].astype(np.int32) for y in (a, b) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(y) for y in (b[:, 0], a[:, 1], b[:, 1], hashes, *small)],
                ["value", "a", "b", "hash", "ap", "al", "ar", "bp", "bl", "br"],
            )

    order = windows.repartition("value").sortWithinPartitions("value", "text_key", "place")
    return order.mapInArrow(run, PAIR)


def regions(collisions: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(al, ar, bl, br): where windows (hash, al, ar, bl, br) overlap in both texts, from enough hash
    functions."""
    out, open_, hashes = [], None, set()
    for hash_, al, ar, bl, br in sorted(collisions, key=itemgetter(3, 4)):
        if open_ and bl <= open_[3]:
            open_ = [min(open_[0], al), max(open_[1], ar), open_[2], max(open_[3], br)]
            hashes.add(hash_)
        else:
            if open_ and len(hashes) >= ENOUGH:
                out.append(tuple(open_))
            open_, hashes = [al, ar, bl, br], {hash_}
    if open_ and len(hashes) >= ENOUGH:
        out.append(tuple(open_))
    return out


def shingle_numbers(words: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Equal shingles of a row of words, given as numbers below ``n``, get equal numbers; and how
    many numbers there are."""
    x, most = words, n
    for k in range(1, SIZE):
        if most * n >= 2**62:
            x, most = np.unique(x, return_inverse=True)[1], len(x)
        x, most = x[:-1] * n + words[k:], most * n
    different, x = np.unique(x, return_inverse=True)
    return x, len(different)


def _stretches(there: np.ndarray, gap: int = GAP) -> Iterator[tuple[int, int]]:
    """First and last of the groups of sorted places with at most ``gap`` others between."""
    if len(there):
        borders = np.flatnonzero(np.diff(there) > gap + 1)
        yield from zip(there[[0, *(borders + 1)]].tolist(), there[[*borders, -1]].tolist(), strict=True)


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    s, t = set(x.tolist()), set(y.tolist())
    both = len(s & t)
    return both / (len(s) + len(t) - both) if 100 * both >= PERCENT * (len(s) + len(t) - both) else 0.0


def _enough(both: int | np.ndarray, n: int, m: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of ``n`` and ``m`` that share ``both`` are alike enough."""
    return 100 * both >= PERCENT * (n + m - both)


def _runs(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """(first in a, first in b, length) of the common runs, in the order of b."""
    order = np.argsort(sa)
    ordered = sa[order]
    if (ordered[1:] != ordered[:-1]).all():
        near = np.minimum(np.searchsorted(ordered, sb), len(sa) - 1)
        there = np.flatnonzero(ordered[near] == sb)
        places = order[near]
        new = np.ones(len(there), bool)
        new[1:] = (np.diff(there) != 1) | (np.diff(places[there]) != 1)
        first = np.flatnonzero(new)
        return np.stack([places[there[first]], there[first], np.diff(first, append=len(there))], axis=1)
    a, b = sa.tolist(), sb.tolist()
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    runs: list[list[int]] = []
    for j, x in enumerate(b):
        if x not in where:
            continue
        if runs and runs[-1][1] + runs[-1][2] == j and runs[-1][0] + runs[-1][2] < len(a) and a[runs[-1][0] + runs[-1][2]] == x:
            runs[-1][2] += 1
        else:
            after = runs[-1][0] + runs[-1][2] if runs else 0
            k = bisect_left(where[x], after)
            runs.append([where[x][k] if k < len(where[x]) else where[x][0], j, 1])
    return np.array(runs, np.int64).reshape(-1, 3)


def _parts(
    sa: np.ndarray, sb: np.ndarray, least: int, at_a: int | None = None, at_b: int | None = None
) -> Iterator[tuple[int, int, int, int, float]]:
    """The longest parts of two stretches, from the left, that are alike enough, and where places
    are given, hold them.

    The common runs are lined up; sums of their lengths say which spans of runs may do, and these
    are confirmed on their sets.  Yields first and last shingle in a and in b, and the similarity.
    """
    runs = _runs(sa, sb)
    a_first, b_first = runs[:, 0], runs[:, 1]
    a_last, b_last = a_first + runs[:, 2] - 1, b_first + runs[:, 2] - 1
    upto = np.concatenate([[0], np.cumsum(runs[:, 2])])
    first = 0
    # What two parts of ``least`` must share is more than ``PERCENT`` of one.
    while first < len(runs) and b_last[-1] - b_first[first] + 1 >= least and _enough(upto[-1] - upto[first], least, least):
        if at_b is not None and b_first[first] > at_b:
            return
        a0, b0 = int(a_first[first]), int(b_first[first])
        a_long, b_long = a_last[first:] - a0 + 1, b_last[first:] - b0 + 1
        both = upto[first + 1 :] - upto[first]
        may = (a_long >= least) & (b_long >= least) & (100 * both >= PERCENT * (a_long + b_long - both))
        if at_a is not None:
            may &= (a0 <= at_a) & (a_last[first:] >= at_a)
        if at_b is not None:
            may &= b_last[first:] >= at_b
        step = 1
        for last in (np.flatnonzero(may)[::-1] + first).tolist():
            a1, b1 = int(a_last[last]), int(b_last[last])
            if alike := _similarity(sa[a0 : a1 + 1], sb[b0 : b1 + 1]):
                yield a0, a1, b0, b1, alike
                step = last - first + 1
                break
        first += step


def alike_parts(
    sa: np.ndarray, sb: np.ndarray, mark: np.ndarray, at_a: int | None = None, at_b: int | None = None
) -> Iterator[tuple[int, int, int, int, float]]:
    """First and last shingle in a and in b, and the similarity, of what two rows of shingle numbers
    have in common.  ``mark`` has a place for every number and is false, before and after.

    Shared shingles that lie close together make a stretch of b and one of a; if these are not alike
    enough as a whole, their longest parts that are.  Where places are given, only what holds them.
    """
    least = WORDS - SIZE + 1
    mark[sa] = True
    there = np.flatnonzero(mark[sb])
    mark[sa] = False
    for j0, j1 in _stretches(there):
        if j1 - j0 + 1 < least or at_b is not None and not j0 <= at_b <= j1:
            continue
        own = sb[j0 : j1 + 1]
        mark[own] = True
        here = np.flatnonzero(mark[sa])
        mark[own] = False
        for i0, i1 in _stretches(here):
            if i1 - i0 + 1 < least or at_a is not None and not i0 <= at_a <= i1:
                continue
            theirs = sa[i0 : i1 + 1]
            if alike := _similarity(theirs, own):
                found = [(0, i1 - i0, 0, j1 - j0, alike)]
            else:
                found = _parts(theirs, own, least, None if at_a is None else at_a - i0, None if at_b is None else at_b - j0)
            for a0, a1, b0, b1, alike in found:
                yield i0 + a0, i0 + a1, j0 + b0, j0 + b1, alike


def passages(a: list[bytes], b: list[bytes], region: tuple[int, int, int, int]):
    """(a_start, a_end, b_start, b_end, similarity) of near-duplicate passages in a region.

    Places are words, ends exclusive.
    """
    al, ar, bl, br = region
    number: dict[bytes, int] = {}
    both = [number.setdefault(w, len(number)) for w in (*a[al : ar + SIZE], *b[bl : br + SIZE])]
    x, n = shingle_numbers(np.array(both, np.int64), len(number))
    cut = ar - al + 1
    for a0, a1, b0, b1, alike in alike_parts(x[:cut], x[cut + SIZE - 1 :], np.zeros(n, bool)):
        yield al + a0, al + a1 + SIZE, bl + b0, bl + b1 + SIZE, alike


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(
        [("a", pa.int64()), ("b", pa.int64())]
        + [(c, pa.int32()) for c in ("a_start", "a_end", "b_start", "b_end")]
        + [("similarity", pa.float64())]
    )
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _verified(pairs: DataFrame) -> DataFrame:
    """Passages of (a, b, collisions, x, y), x and y the texts of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list[bytes]] = (0, [])
        for batch in batches:
            out = []
            lists = batch.column("collisions")
            rows = list(zip(*(lists.values.field(c).to_pylist() for c in ("hash", "al", "ar", "bl", "br")), strict=True))
            ends = lists.offsets.to_pylist()
            columns = (batch.column(c) for c in ("a", "b", "x", "y"))
            for a, b, x, y, begin, end in zip(*columns, ends[:-1], ends[1:], strict=True):
                key = a.as_py()
                if not held[1] or held[0] != key:
                    held = key, x.as_py().encode().lower().split()
                other = y.as_py().encode().lower().split()
                for region in regions(rows[begin:end]):
                    for p in passages(held[1], other, region):
                        out.append((key, b.as_py(), *p))
            yield _passage_batch(out)

    ship(pairs.sparkSession)
    return pairs.select("a", "b", "collisions", "x", "y").mapInArrow(run, PASSAGE)


def _members(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(value, text_key, place, left, right, later, told, blocks): windows of the values of three or
    more texts that are not yet explained.

    ``later`` says that a confirmed passage with a smaller text covers the place, ``told`` that one
    with any text does.  A value is explained where all windows but the first text's are later.
    """
    many = shared.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("a", "ap", "al", "ar")).alias("first"))
    many = stored(many.filter("n >= 2"), "passage-values")
    names = ["value", "text_key", "place", "left", "right"]
    firsts = many.select("value", "first.*").toDF(*names)
    rest = shared.join(bounded(many.select("value")), "value").select("value", "b", "bp", "bl", "br").toDF(*names)
    span = lambda x, later: found.select(
        F.col(x).alias("text_key"), F.struct(F.col(f"{x}_start").alias("s"), F.col(f"{x}_end").alias("e"), F.lit(later).alias("later")).alias("span")
    )
    spans = span("a", False).union(span("b", True)).groupBy("text_key").agg(F.collect_set("span").alias("spans"))
    here = F.filter(
        F.coalesce("spans", F.array()), lambda x: (x["s"] <= F.col("place")) & (F.col("place") + SIZE <= x["e"])
    )
    windows = rest.withColumn("is_first", F.lit(False)).union(firsts.withColumn("is_first", F.lit(True)))
    windows = windows.join(spans, "text_key", "left").withColumn("here", here)
    windows = windows.select(*names, "is_first", F.exists("here", lambda x: x["later"]).alias("later"), (F.size("here") > 0).alias("told"))
    windows = stored(windows, "passage-windows")
    groups = windows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("later") & ~F.col("is_first")).alias("n_open"))
    groups = groups.filter("n_open > 0").select("value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    groups = stored(groups, "passage-groups")
    members = stored(windows.drop("is_first").join(bounded(groups), "value"), "passage-members")
    drop(many, windows, groups)
    return members


def _dealt(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``MEMBER``: the words of every window, once for each unit (value, i, j) that it takes part in."""
    block = F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int")
    m = members.withColumn("own", block)
    m = m.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select(
        "value", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "text_key", "place", "left", "right", "later", "told"
    ).join(texts, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, list[bytes]] = ("", [])
        for batch in batches:
            out = []
            for left, right, text in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "text")), strict=True):
                if text != held[0]:
                    held = text, text.encode().lower().split()
                out.append(b" ".join(held[1][left : right + SIZE]).decode())
            names = ["value", "i", "j", "own", "text_key", "place", "left", "later", "told"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "words"])

    ship(members.sparkSession)
    return m.mapInArrow(run, MEMBER)


def _earlier(x: np.ndarray) -> np.ndarray:
    """The last earlier place with the same number, -1 where there is none."""
    order = np.argsort(x, kind="stable")
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    out = np.full(len(x), -1)
    out[order[same + 1]] = order[same]
    return out


def _fewest(earlier: np.ndarray, least: int) -> int:
    """How many different numbers ``least`` places in a row have at least, or all if they are fewer."""
    if len(earlier) <= least:
        return max(1, int((earlier < 0).sum()))
    rows = np.lib.stride_tricks.sliding_window_view(earlier, least)
    return int((rows < np.arange(len(rows))[:, None]).sum(axis=1).min())


def _dense(known: np.ndarray, first: np.ndarray | None, at: int, least: int, other: int = 0) -> bool:
    """Whether a stretch of at least ``least`` places around ``at`` has enough ``known`` ones for a
    passage, or with ``other`` for one of which the other side has so many different shingles.  It
    begins and ends with a known one.

    Of unknown shingles that repeat, only the ``first`` count, as a passage is a set.
    """
    gain = np.where(known, 100 if other else 100 - PERCENT, -PERCENT)
    if first is not None:
        gain[~(known | first)] = 0
    upto = np.zeros(len(known) + 1, np.int64)
    np.cumsum(gain, out=upto[1:])
    n = min(at, len(known) - least) + 1
    if n <= 0:
        return False
    # The highest sum up to any later end.
    best = np.maximum.accumulate(np.where(known, upto[1:], NEVER)[::-1])[::-1]
    start = np.where(known[:n], upto[:n], -NEVER)
    # The end lies ``least`` after the start and after ``at``.
    near = max(0, min(n, at + 1 - least))
    more = PERCENT * other
    return bool((best[at] >= start[:near] + more).any() or (best[near + least - 1 : n + least - 1] >= start[near:] + more).any())


class Unit:
    """The shingles of a unit's windows as numbers, and which windows hold each."""

    def __init__(self, words: Iterator[str]):
        number: dict[bytes, int] = defaultdict(count().__next__)
        listed = [list(map(number.__getitem__, x.encode().split())) for x in words]
        sizes = np.array([len(x) for x in listed])
        flat = np.fromiter(chain.from_iterable(listed), np.int64, sizes.sum())
        x, self.n = shingle_numbers(flat, len(number))
        begins = (np.cumsum(sizes) - sizes).tolist()
        self.shingles = [x[b : b + len(w) - SIZE + 1] for b, w in zip(begins, listed, strict=True)]
        windows = np.repeat(np.arange(len(listed)), [len(s) for s in self.shingles])
        both = np.sort(windows * self.n + np.concatenate(self.shingles))
        windows, one = np.divmod(both[np.flatnonzero(np.diff(both, prepend=-1))], self.n)
        self.sets = np.split(one, np.cumsum(np.bincount(windows, minlength=len(listed)))[:-1])
        order = np.argsort(one, kind="stable")
        self._windows = windows[order]
        self._ends = np.cumsum(np.bincount(one, minlength=self.n))

    def shared(self, u: int) -> np.ndarray:
        """How many different shingles of window ``u`` each window has."""
        s = self.sets[u]
        ends = self._ends[s]
        sizes = ends - np.where(s > 0, self._ends[s - 1], 0)
        places = np.arange(sizes.sum()) + np.repeat(ends - np.cumsum(sizes), sizes)
        return np.bincount(self._windows[places], minlength=len(self.sets))


def _lined_up(places: np.ndarray, ats: np.ndarray, least: int) -> np.ndarray:
    """For each row, which has the places that a window's shingles have in another one or -1, whether
    a passage may hold the place ``at``: a span of at least ``least`` that begins and ends with shared
    shingles and has enough of them for its own length and the other's.

    Without repeated shingles; where they stand in another order, the other side is no shorter.
    """
    known, t = places >= 0, np.arange(places.shape[1])
    score = (100 + PERCENT) * np.cumsum(known, axis=1) - PERCENT * (t + places)
    best = np.maximum.accumulate(np.where(known, score, NEVER)[:, ::-1], axis=1)[:, ::-1]  # up to any later end
    end = np.maximum(ats[:, None], t + least - 1)
    inside = end < len(t)
    best = np.take_along_axis(best, np.where(inside, end, 0), axis=1)
    return (known & inside & (t <= ats[:, None]) & (best + 100 - PERCENT >= score)).any(axis=1)


def explained(unit: list[tuple]) -> Iterator[tuple]:
    """Passages of a unit's windows (i, j, own, text_key, place, left, later, told, words), which
    stand in the order of their texts.

    A window is compared with those of smaller texts on the other side until a passage with one
    covers its place, and if there is none and nothing else covers it, with those of larger texts.
    A passage for which the value stands holds its place in both windows; where a window repeats
    shingles, the value may stand elsewhere in it too.  One that does not hold it has other values.
    A passage holds at least ``least`` shingles on either side, so windows that share fewer than two
    sets of so many must have none.
    """
    least = WORDS - SIZE + 1
    i, j = unit[0][:2]
    keys, places, lefts = ([m[k] for m in unit] for k in (3, 4, 5))
    later, told = ([m[k] for m in unit] for k in (6, 7))
    own, texts = np.array([m[2] for m in unit]), np.array(keys, np.int64)
    w = Unit(m[8] for m in unit)
    shingles, mark = w.shingles, np.zeros(w.n, bool)
    earlier = [_earlier(x) if len(x) > len(s) else None for x, s in zip(shingles, w.sets, strict=True)]
    # Shingles that a window repeats may leave fewer different ones in a passage.
    different = np.array([least if x is None else _fewest(x, least) for x in earlier])
    first = [None if x is None else x < 0 for x in earlier]
    ats = [p - left if x is None else None for p, left, x in zip(places, lefts, earlier, strict=True)]
    seen: set[tuple[int, int]] = set()

    sizes = np.array([len(x) for x in shingles])
    plain = np.array([x is None for x in earlier]) & (sizes <= SIDE)
    rows = np.full((len(unit), max(sizes[plain], default=0)), w.n)
    for z in np.flatnonzero(plain).tolist():
        rows[z, : sizes[z]] = shingles[z]
    inside, where = np.array(places) - np.array(lefts), np.full(w.n + 1, -1)

    def likely(u: int, some: np.ndarray) -> np.ndarray:
        """Those of ``some`` windows with which ``u`` may have a passage that holds the places."""
        if not plain[u]:
            return some
        where[shingles[u]] = np.arange(sizes[u])
        fits = ~plain[some]
        longest = sizes[some][~fits].max(initial=0)
        fits[~fits] = _lined_up(where[rows[some[~fits], :longest]], inside[some[~fits]], least)
        where[shingles[u]] = -1
        return some[fits]

    def may(z: int, other: int) -> bool:
        mark[w.sets[other]] = True
        known = mark[shingles[z]]
        mark[w.sets[other]] = False
        at = places[z] - lefts[z]
        return _dense(known, first[z], at, least) and _dense(known, first[z], at, least, int(different[other]))

    for u, m in enumerate(unit):
        if later[u]:
            continue
        enough = _enough(w.shared(u), different[u], different)
        candidates = np.flatnonzero(enough & (own == (j if m[2] == i else i)) & (texts != keys[u]))
        chunks = (candidates[k : k + ABREAST] for k in range(0, len(candidates), ABREAST))
        for c in chain.from_iterable(likely(u, some).tolist() for some in chunks):
            if c > u and told[u]:
                break
            x, y = pair = min(u, c), max(u, c)
            if pair in seen:
                continue
            seen.add(pair)
            if not (plain[u] and plain[c]) and not (may(c, u) and may(u, c)):
                continue
            for a0, a1, b0, b1, alike in alike_parts(shingles[x], shingles[y], mark, ats[x], ats[y]):
                yield keys[x], keys[y], a0 + lefts[x], a1 + lefts[x] + SIZE, b0 + lefts[y], b1 + lefts[y] + SIZE, alike
                if a0 <= places[x] - lefts[x] <= a1:
                    told[x] = True
                if b0 <= places[y] - lefts[y] <= b1:
                    told[y] = later[y] = True
            if later[u]:
                break


def _explained(dealt: DataFrame) -> DataFrame:
    """Passages of ``MEMBER``.  Units stream by in order; a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, []
        for batch in batches:
            out = []
            for value, *m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (value, m[0], m[1]) != key:
                    if unit:
                        out.extend(explained(unit))
                    key, unit = (value, m[0], m[1]), []
                unit.append(tuple(m))
            yield _passage_batch(out)
        if unit:
            yield _passage_batch(list(explained(unit)))

    order = dealt.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "text_key")
    return order.mapInArrow(run, PASSAGE)


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words): the texts' hashes, stored."""
    t = whole(text)
    return stored(
        docs.select(F.col(id).alias("doc_id"), F.xxhash64(t).alias("text_key"), F.size(words(t)).alias("n_words")), "passage-keys"
    )


def _texts(docs: DataFrame, keys: DataFrame, wanted: DataFrame | None, id: str, text: str) -> DataFrame:
    """(text_key, text), once per text: of all texts or of the wanted keys."""
    rows = docs.select(F.xxhash64(whole(text)).alias("text_key"), F.col(id).alias("id_"), whole(text).alias("text"))
    one = keys.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    if wanted is not None:
        one = stored(one.join(wanted, "text_key").select("text_key", "least"), "passage-wanted")
        rows = rows.join(bounded(one), "text_key").filter(F.col("id_").eqNullSafe(F.col("least")))
        rows = stored(rows.select("text_key", "text").dropDuplicates(["text_key"]), "passage-texts")
        drop(one)
        return rows
    # Copies go by their keys, which are few, so that the other texts need not be moved.
    rest = keys.join(one.filter("n > 1"), "text_key").filter(~F.col("doc_id").eqNullSafe(F.col("least")))
    rest = stored(rest.select("text_key", F.col("doc_id").alias("rest_id")).distinct(), "passage-copies")
    r = bounded(rest).withColumnRenamed("text_key", "rest_key")
    again = (F.col("text_key") == F.col("rest_key")) & F.col("id_").eqNullSafe(F.col("rest_id"))
    return rows.join(r, again, "left_anti").select("text_key", "text")


def near_passages(docs: DataFrame, keys: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, similarity): passages of b that repeat one of a.

    a and b are keys of texts (``keyed``); places are words.
    """
    texts = _texts(docs, keys, None, id, text)
    n_words = keys.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    places = stretches(texts, n_words)
    # Its rows are as wide as they have stretches, so these are counted.
    n = places.agg(F.coalesce(F.sum(F.size("stretches")), F.lit(0))).first()[0]
    texts = texts.join(F.broadcast(places) if n <= BROADCAST_ROWS else places, "text_key")
    shared = stored(_sharing(_windows(texts)), "passage-shared", BATCH)
    drop(places)
    pairs = (
        shared.groupBy("a", "b")
        .agg(F.collect_set(F.struct("hash", "al", "ar", "bl", "br")).alias("collisions"))
        .filter(F.size(F.array_distinct(F.transform("collisions", lambda c: c["hash"]))) >= ENOUGH)
    )
    pairs = stored(pairs, "passage-pairs")
    ends = shared.select(F.col("a").alias("text_key")).union(shared.select(F.col("b").alias("text_key"))).distinct()
    texts = _texts(docs, keys, ends, id, text)
    joined = pairs.join(texts.withColumnsRenamed({"text_key": "b", "text": "y"}), "b")
    joined = joined.join(texts.withColumnsRenamed({"text_key": "a", "text": "x"}), "a")
    found = stored(_verified(joined), "passages", BATCH)
    drop(pairs)
    members = _members(shared, found)
    drop(shared)
    more = stored(_explained(_dealt(members, texts)).distinct(), "passages-more", BATCH)
    drop(members, texts)
    return found.unionByName(more.join(found, found.columns, "left_anti"))


def _longest(spans: DataFrame) -> DataFrame:
    """The spans of (text_key, start_word, end_word, ...) that lie in no other one of their text."""
    so_far = Window.partitionBy("text_key").orderBy("start_word", F.desc("end_word")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.max("end_word").over(so_far)
    return spans.withColumn("before", end).filter(F.col("before").isNull() | (F.col("end_word") > F.col("before"))).drop("before")


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated passage of a document: doc_id, start_word, end_word, partner_id,
    similarity.  Passages that lie within a longer one of the document are left to it.

    Both documents of a pair have the passage; the partner is the smallest document with the other
    text.  Copies have their text's passages, and their whole text is one.
    """
    keys = keyed(docs, id, text)
    found = near_passages(docs, keys, id, text)
    sides = [
        found.select(F.col(x).alias("text_key"), F.col(f"{x}_start").alias("start_word"), F.col(f"{x}_end").alias("end_word"), F.col(y).alias("other"), "similarity")
        for x, y in (("a", "b"), ("b", "a"))
    ]
    one = keys.groupBy("text_key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words")
    )
    one = stored(one, "passage-classes")
    partner = one.select(F.col("text_key").alias("other"), F.col("least").alias("partner_id"))
    spans = (
        sides[0]
        .union(sides[1])
        .join(partner, "other")
        .groupBy("text_key", "start_word", "end_word")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "partner_id")).alias("best"))
        .select("text_key", "start_word", "end_word", F.col("best.partner_id").alias("partner_id"), (-F.col("best.s")).alias("similarity"))
    )
    spans = _longest(spans)
    copies = one.filter((F.col("n") > 1) & (F.col("n_words") >= WORDS)).select(
        "text_key", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.lit(None).cast(docs.schema[id].dataType).alias("partner_id"), F.lit(1.0).alias("similarity"), "least", "most"
    )
    spans = stored(spans.unionByName(copies, allowMissingColumns=True), "passage-spans")
    # The partner of a copy is the smallest one, that of the smallest the largest.
    copy = F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    return (
        keys.select("doc_id", "text_key")
        .join(spans, "text_key")
        .select("doc_id", "start_word", "end_word", F.coalesce("partner_id", copy).alias("partner_id"), "similarity")
    )


SPACES = re.compile(rb"[^\x20\x09-\x0d]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands between the other words stays."""
    raw = text.encode()
    places = [m.span() for m in SPACES.finditer(raw)]
    out, at, done = [], 0, 0
    for start, end in sorted(spans):
        start, end = max(start, done), min(end, len(places))
        if start < end:
            out.append(raw[at : places[start][0]])
            at, done = places[end - 1][1], end
    out.append(raw[at:])
    return b"".join(out).decode()


def cut(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The documents with all their columns, without passages that an earlier text has.

    The first text of a pair keeps the passage.  Of copies the smallest id keeps the text, in all
    its rows.  Documents that lose all their words go.
    """
    keys = keyed(docs, id, text)
    found = near_passages(docs, keys, id, text)
    spans = found.groupBy("b").agg(F.collect_set(F.struct(F.col("b_start").alias("s"), F.col("b_end").alias("e"))).alias("spans"))
    spans = stored(spans, "passage-cuts")
    key, spans_ = fresh(docs, "passage_key"), fresh(docs, "passage_spans")
    one = keys.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"))
    gone = keys.join(one.filter(f"n > 1 AND n_words >= {WORDS}").drop("n_words"), "text_key").filter(~F.col("doc_id").eqNullSafe(F.col("least")))
    gone_id = fresh(docs, "passage_gone")
    gone = stored(gone.select(F.col("text_key").alias(key), F.col("doc_id").alias(gone_id)).distinct(), "passage-gone")

    t = F.xxhash64(whole(text))
    left = docs.join(bounded(gone), (t == F.col(key)) & F.col(f"`{id}`").eqNullSafe(F.col(gone_id)), "left_anti")
    named = spans.select(F.col("b").alias(key), F.col("spans").alias(spans_))
    # Its rows are as wide as they have spans, so these are counted.
    n = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    if n <= BROADCAST_ROWS:
        named = F.broadcast(named)
    touched = left.join(named, t == F.col(key))
    names, at = touched.columns, touched.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                without(x or "", [(p["s"], p["e"]) for p in s])
                for x, s in zip(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True)
            ]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    touched = touched.mapInArrow(run, touched.schema).filter(F.size(words(F.col(text))) > 0)
    if chars in docs.columns:
        touched = touched.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType))
    untouched = left.join(named.select(key), t == F.col(key), "left_anti")
    columns: list[Column] = [F.col(f"`{c}`") for c in docs.columns]
    return untouched.select(*columns).unionByName(touched.select(*columns))

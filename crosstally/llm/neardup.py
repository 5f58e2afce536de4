"""Near-duplicate documents by b-bit MinHash.

Every text becomes a set of word shingles and a signature of minima.  Only the low bits of the
minima are kept, packed; bands of whole minima, hashed, name the candidates, the bit counts of two
packed signatures estimate their similarity, corrected for chance collisions, and links are
confirmed on the whole sets of shingles.

Copies (equal sets) are one class.  Within a band's bucket pairs are not listed: classes are first
compared with the bucket's smallest, which joins groups of near copies.  After that classes that are
still in different components are compared with each other, in blocks of bounded size, and what
passes the estimate is a family; of each family all pairs between components are then compared on
their whole sets, again in blocks.  A block gives only as many pairs as connect its members, so no
list of pairs grows with the square of a group, and no link that a bucket shows is lost.

Defined cases: A-Z count as a-z; a text with fewer words than a shingle is one shingle; null texts
and texts without words have no shingles and no links; repeated rows are copies; an empty table
gives an empty result; columns that are not named are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop, fresh, ship, stored, whole

#: Bands of rows: at similarity 0.8 a pair misses all bands with probability 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Bits kept of a minimum, and what they leave of a random pair: equal by chance in 1 of 16.
BITS = 4
#: Estimates this far (6 standard deviations) under the threshold still go to confirmation.
SLACK = 0.2
#: Members compared at once on each side, shingles hashed at once, rows a task gets at once.
BLOCK, STEP, BATCH = 256, 4096, 500
#: Pairs of a unit that are compared one by one; more go through products of 0/1 matrices.
FEW, WIDTH = 500, 4096

_random = np.random.default_rng(20)
XOR = _random.integers(0, 2**32, HASHES, np.uint32)[:, None]
FACTOR = (_random.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1))[:, None]
BAND = _random.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "n_shingles bigint, class bigint, signature array<bigint>, bands array<bigint>"


def shingles(text: str, size: int) -> set[bytes]:
    w = text.encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if len(w) < size:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def set_hashes(s: set[bytes]) -> np.ndarray:
    """The hashes of a set's shingles, in order."""
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, s), np.uint64, len(s)))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima, and the hash of each band of whole minima."""
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), STEP):
        np.minimum(least, ((short[i : i + STEP] ^ XOR) * FACTOR).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * BAND).sum(axis=1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    packed = (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return packed.view(np.int64), mixed.view(np.int64)


def signed(docs: DataFrame, size: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, copy (the text's hash), n_shingles, class, signature, bands."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, packed, bands = [], [], [], []
            for t in batch.column("text").to_pylist():
                h = set_hashes(shingles(t, size))
                sizes.append(len(h))
                if not len(h):
                    classes.append(None), packed.append(None), bands.append(None)
                    continue
                classes.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())))))
                a, b = signature(h)
                packed.append(a), bands.append(b)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("copy"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
                    pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "copy", "n_shingles", "class", "signature", "bands"],
            )

    ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(whole(text)).alias("copy"), whole(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, copy bigint, {SIGNED}")


def _unequal(x: Column, y: Column) -> Column:
    """Of a word of packed minima, how many differ."""
    v = x.bitwiseXOR(y)
    v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
    v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
    return F.bit_count(v.bitwiseAND(F.lit(0x1111111111111111)))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for minima whose low bits agree by chance."""
    unequal = F.aggregate(F.zip_with(a, b, _unequal), F.lit(0), lambda total, x: total + x)
    return 1 - unequal / F.lit(HASHES * (1 - 2.0**-BITS))


def buckets(bands: DataFrame) -> DataFrame:
    """(band, class, a): the buckets of several classes, stored, with their smallest class.

    Nearly all buckets have one class only; they are left out once, for all who compare buckets.
    """
    bucket = bands.select("class", F.explode("bands").alias("band"))
    first = bucket.groupBy("band").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stored(bucket.join(first, "band").select("band", "class", "a"), "neardup-buckets")


def stars(classes: DataFrame, shared: DataFrame, floor: float) -> DataFrame:
    """(a, b, similar): each class and the smallest class of a bucket it is in, where these pass
    the estimate."""
    pairs = shared.filter("class <> a").select("a", F.col("class").alias("b")).distinct()
    s = classes.select("class", "signature")
    pairs = pairs.join(s.withColumnsRenamed({"class": "a", "signature": "x"}), "a")
    pairs = pairs.join(s.withColumnsRenamed({"class": "b", "signature": "y"}), "b")
    return pairs.select("a", "b", estimate(F.col("x"), F.col("y")).alias("similar")).filter(F.col("similar") >= floor)


def _units(member: DataFrame, key: str) -> DataFrame:
    """Members (class, root) of groups with several components, dealt to units of two blocks.

    The group's largest component is compared with the others only, so its members meet the blocks
    of the others, and those meet all.
    """
    parts = member.groupBy(key, "root").agg(F.count(F.lit(1)).alias("n"))
    groups = (
        parts.groupBy(key)
        .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
        .filter("parts > 1")
    )
    groups = groups.select(
        key,
        F.col("most.root").alias("main"),
        F.ceil(F.col("most.n") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("other_blocks"),
    )
    dealt = lambda blocks: F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int")
    m = member.join(groups, key).withColumn("is_main", F.col("root") == F.col("main"))
    m = m.withColumn("own", F.when(F.col("is_main"), -1 - dealt("main_blocks")).otherwise(dealt("other_blocks")))
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    mains = F.sequence(-F.col("main_blocks"), F.lit(-1))
    m = m.withColumn("with", F.explode(F.when(F.col("is_main"), others).otherwise(F.concat(mains, others))))
    return m.select(
        F.col(key).alias("unit"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "class", "root"
    )


def _forest(passing: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (classes of left and right) that connect whatever the passing pairs connect.

    Every member takes the smallest label among its partners and remembers from whom, until
    nothing changes; what it remembers last is its edge.
    """
    label = {int(c): int(c) for c in (*left, *right)}
    edge: dict[int, int] = {}
    rows, columns = passing.any(axis=1), passing.any(axis=0)
    passing, left, right = passing[np.ix_(rows, columns)], left[rows], right[columns]
    top = np.iinfo(np.int64).max
    changed = bool(passing.size)
    while changed:
        changed = False
        for own, other, mask in ((right, left, passing.T), (left, right, passing)):
            labels = np.array([label[int(c)] for c in other], np.int64)
            best = np.where(mask, labels[None, :], top).argmin(axis=1)
            for c, k in zip(own.tolist(), best.tolist(), strict=True):
                if labels[k] < label[c]:
                    label[c], edge[c], changed = int(labels[k]), int(other[k]), True
    return np.array(list(edge), np.int64), np.array(list(edge.values()), np.int64)


def _compared(units: DataFrame, passes: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): of every unit the pairs in different components that connect all that pass.

    ``passes`` gets a unit and the places of its two sides and gives a matrix.  Units stream by in
    order; a task holds one.
    """

    def compare(unit: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(unit)
        ids, root, own = (t.column(c).to_numpy() for c in ("class", "root", "own"))
        left, right = np.flatnonzero(own == t.column("i")[0].as_py()), np.flatnonzero(own == t.column("j")[0].as_py())
        passing = passes(t, left, right) & (root[left][:, None] != root[right][None, :])
        a, b = _forest(passing, ids[left], ids[right])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("unit", "i", "j")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(starts, starts[1:], strict=False):
                if tuple(keys[s]) != key:
                    if unit:
                        yield compare(unit)
                    key, unit = tuple(keys[s]), []
                unit.append(batch.slice(s, e - s))
        if unit:
            yield compare(unit)

    ship(units.sparkSession)
    units = units.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return units.mapInArrow(run, "a bigint, b bigint").distinct()


def _alike(floor: float) -> Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]:
    """Whether two signatures differ in few enough minima, by bit counts."""
    most = int((1 - floor) * HASHES * (1 - 2.0**-BITS))

    def passes(t: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        packed = t.column("signature").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(t), -1)
        v = packed[left][:, None, :] ^ packed[right][None, :, :]
        v |= v >> np.uint64(1)
        v |= v >> np.uint64(2)
        return np.bitwise_count(v & np.uint64(0x1111111111111111)).sum(axis=2) <= most

    return passes


def _linked_sets(floor: float, percent: int) -> Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]:
    """Whether two whole sets are similar enough, for the pairs that pass the estimate."""
    alike = _alike(floor)

    def passes(t: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        root = t.column("root").to_numpy()
        asked = alike(t, left, right) & (root[left][:, None] != root[right][None, :])
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
        sizes = np.array([len(x) for x in sets])
        x, y = np.nonzero(asked)
        if len(x) <= FEW:
            both = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], True)) for i, j in zip(x, y, strict=True)], np.int64)
        else:
            rows, columns = np.unique(x), np.unique(y)
            members = [sets[left[i]] for i in rows], [sets[right[j]] for j in columns]
            known = np.unique(np.concatenate(members[0] + members[1]))
            total = np.zeros((len(rows), len(columns)), np.float32)
            for k in range(0, len(known), WIDTH):
                part = known[k : k + WIDTH]
                halves = []
                for side in members:
                    m = np.zeros((len(side), len(part)), np.float32)
                    for r, s in enumerate(side):
                        lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], "right")
                        m[r, np.searchsorted(part, s[lo:hi])] = 1
                    halves.append(m)
                total += halves[0] @ halves[1].T
            both = total[np.searchsorted(rows, x), np.searchsorted(columns, y)].astype(np.int64)
        out = np.zeros_like(asked)
        union = sizes[left[x]] + sizes[right[y]] - both
        out[x, y] = 100 * both >= percent * union
        return out

    return passes


def whole_sets(docs: DataFrame, sig: DataFrame, wanted: DataFrame, size: int, id: str, text: str) -> DataFrame:
    """(class, hashes): the sorted hashes of all shingles of the wanted classes, from one document
    of each."""
    one = sig.join(wanted, "class").groupBy("class").agg(F.min(F.struct("copy", "doc_id")).alias("x"))
    one = stored(one.select("class", F.col("x.copy").alias("copy_key"), F.col("x.doc_id").alias("id_key")), "neardup-wanted")
    rows = docs.select(F.col(id).alias("id_"), whole(text).alias("text")).withColumn("copy_", F.xxhash64("text"))
    found = rows.join(bounded(one), (F.col("copy_") == F.col("copy_key")) & F.col("id_").eqNullSafe(F.col("id_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_hashes(shingles(x.as_py(), size)).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.binary())], ["class", "hashes"])

    ship(docs.sparkSession)
    made = found.select("class", "text").mapInArrow(run, "class bigint, hashes binary")
    made = stored(made.dropDuplicates(["class"]), "neardup-sets", BATCH)
    drop(one)
    return made


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union.

    A row per member: the pairs' first class comes before its partners, and only its set is held.
    A class with many partners is dealt to several parts, each of which it leads.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    leads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("class"), F.lit(True).alias("first"))
    others = pairs.join(many, "a").select("a", part.alias("part"), F.col("b").alias("class"), F.lit(False).alias("first"))
    rows = leads.union(others).join(sets, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for first, hashes in zip(batch.column("first").to_pylist(), batch.column("hashes"), strict=True):
                s = np.frombuffer(hashes.as_py(), np.uint64)
                if first:
                    held = s
                both = 0 if first else len(np.intersect1d(held, s, True))
                ok.append(not first and 100 * both >= percent * (len(held) + len(s) - both))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("class")], ["a", "b"])
            yield out.filter(pa.array(ok, pa.bool_()))

    ship(pairs.sparkSession)
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("first"))
    return stored(rows.select("a", "class", "first", "hashes").mapInArrow(run, "a bigint, b bigint"), "neardup-links", BATCH)


def components(edges: DataFrame) -> DataFrame:
    """(class, root): of every class on an edge the smallest class it is connected with.

    Large star and small star in turn; both hang nodes on smaller ones, and minima combine before
    the shuffle.  Ends when every node hangs on its root.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "components")
    while True:
        both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = stored(large, "components")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
        new = stored(small.distinct(), "components")
        drop(e, large)
        # Done when no node hangs on one that hangs itself, and none on two.
        hanging = new.select(F.col("v").alias("u"))
        if new.join(hanging, "u", "left_semi").isEmpty() and new.groupBy("v").count().filter("count > 1").isEmpty():
            break
        e = new
    roots = new.select(F.col("u").alias("class")).distinct().withColumn("root", F.col("class"))
    found = stored(new.select(F.col("v").alias("class"), F.col("u").alias("root")).union(roots), "components")
    drop(new)
    return found


def linked(docs: DataFrame, sig: DataFrame, size: int, percent: int, id: str, text: str) -> DataFrame:
    """(class, root) of all classes with a link to another."""
    floor = percent / 100 - SLACK
    classes = sig.filter("n_shingles > 0").groupBy("class").agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = stored(classes, "neardup-classes")
    shared = buckets(classes.select("class", "bands"))
    first = stars(classes, shared, floor).groupBy("b").agg(F.min("a").alias("a"))
    first = stored(first.select("a", "b"), "neardup-first")
    ends = lambda p: p.select(F.col("a").alias("class")).union(p.select(F.col("b").alias("class")))
    sets = whole_sets(docs, sig, ends(first).distinct(), size, id, text)
    links = confirmed(first, sets, percent)
    drop(first, sets)
    roots = components(links)

    # What else the buckets show, now that most of a group is one component: families of classes.
    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))

    signatures = classes.select("class", "signature")
    bucket = rooted(shared.select("class", "band"))
    near = stored(_compared(_units(bucket, "band").join(signatures, "class"), _alike(floor)), "neardup-near", BATCH)
    drop(shared)
    if near.isEmpty():
        drop(classes, links, near)
        return roots
    hung = roots.filter("class <> root").select(F.col("root").alias("a"), F.col("class").alias("b"))
    families = components(near.union(hung))
    member = stored(rooted(families.withColumnRenamed("root", "family")), "neardup-members")
    drop(near, families, roots)
    units = stored(_units(member, "family"), "neardup-units")
    drop(member)
    sets = whole_sets(docs, sig, units.select("class").distinct(), size, id, text)
    compared = units.join(signatures, "class").join(sets, "class")
    more = stored(_compared(compared, _linked_sets(floor, percent)), "neardup-more", BATCH)
    drop(units, sets, classes)
    found = components(links.union(more))
    drop(links, more)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, copy, n_shingles, component_id (smallest id of its group), kept."""
    sig = stored(signed(docs, size, id, text), "neardup-signed", 4 * BATCH)
    roots = linked(docs, sig, size, percent, id, text)
    rows = sig.select("doc_id", "copy", "n_shingles", "class").join(roots, "class", "left")
    rows = stored(rows.withColumn("root", F.coalesce("root", "class")), "neardup-rows")
    drop(sig, roots)
    smallest = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (
        rows.join(smallest, "root", "left")
        .withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
        .select("doc_id", "copy", "n_shingles", "component_id")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group: that with the smallest id.

    Of repeated rows one stays.  Only what goes, and what occurs repeatedly, is joined to the texts.
    """
    rows = stored(near_duplicates(docs, size, percent, id, text), "neardup-kept")
    id_, copy_ = fresh(docs, "neardup_id"), fresh(docs, "neardup_copy")
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("copy").alias(copy_)).distinct()
    same = F.col(f"`{id}`").eqNullSafe(F.col(id_)) & (F.xxhash64(whole(text)) == F.col(copy_))
    out = docs.join(bounded(stored(named(rows.filter("NOT kept")), "neardup-gone")), same, "left_anti")
    again = rows.filter("kept").groupBy("doc_id", "copy").count().filter("count > 1")
    again = stored(named(again), "neardup-again")
    drop(rows)
    if again.isEmpty():
        return out
    again = bounded(again)
    once = out.join(again, same, "left_semi").withColumn(copy_, F.xxhash64(whole(text))).dropDuplicates([id, copy_]).drop(copy_)
    return out.join(again, same, "left_anti").unionByName(once)

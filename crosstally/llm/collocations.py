"""Collocations: phrases whose words stand together more often than the words alone explain.

Only the longest windows are counted: every word leads one window of ``ORDER`` words (its lead
columns), padded where its piece of text ends.  A window's shorter prefixes are the shorter phrases
at the same place, so Spark's ROLLUP over (lang, w1, w2, w3, w4) sums the counts of all lengths from
these windows, and no n-grams are made besides.

What a rare prefix starts can be no frequent phrase, so windows are cut there before they are rolled
up; nothing is lost, since they still count for what is left of them.

- Words below ``least`` are cut while windows are made, by a broadcast table of frequent words; it
  is bounded in rows and bytes.  If there are more of them, the most frequent ones are broadcast, no
  word is cut, and words that are not in the table travel as text beside the numbers of the others.
- Windows are combined per some ``CHUNK`` bytes of text and dealt by their first two words.  A pair
  that could occur more than ``HOT`` times, by the frequency of its rarer word, is dealt by its
  third word too, in parts of about that many, so no pair is counted in one task.  Every part holds
  all windows that share three words, and of a pair that is not split all, so that task sees
  whether three (and two) words reach ``least``.

Defined cases: a null text is empty, a null language ``und``; texts and words may be of any length;
repeated rows count each; an empty table gives no rows; columns that are not named are not looked
at.  Counts are whole numbers, and products that may pass 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, ship, stored, whole

ORDER = 4
LEAST = 30
#: Per cent of a phrase's count from which a longer one that holds it stands for it.
WITHIN = 80
TOP = 2000
#: Bytes of text that are combined at once.
CHUNK = 2**23
#: Bounds of the broadcast words: rows and bytes.  A word's number has ``BITS`` bits; 0 pads, and the
#: greatest one stands for a word that is not in the table.
KNOWN_ROWS, KNOWN_BYTES = 2**20, 2**26
BITS = 21
OTHER = 2**BITS - 1
#: Occurrences from which a pair of words may be dealt to several tasks.
HOT = 2**17
#: Parts of a language whose best phrases are found first.
SALTS = 64
#: Bytes of phrases that may be broadcast.
PHRASE_BYTES = 2**26

# What ends a piece, and what stands between words.
BREAK, BLANK = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Stands for the end of a piece between words; it is one of the characters that no word has.
STOP = "\n"

WORDS = "lang string, word string, n bigint"
#: The first two words and the part, the last two, with the words that have no number as text.
WINDOWS = "pair bigint, u12 string, last bigint, u34 string, n bigint"
CUT = "lang string, w1 string, w2 string, w3 string, w4 string, n bigint"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about ``CHUNK`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(lengths, before + CHUNK - size, "right")))
            held.append(batch.slice(start, end - start))
            size += int(lengths[end - 1]) - before
            start, before = end, int(lengths[end - 1])
            if size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """The words of a chunk: codes in the order of the texts, piece and language of each."""

    def __init__(self, table: pa.Table):
        langs = table.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        self.langs = langs.dictionary.to_pylist()
        text = pc.ascii_lower(table.column("text").combine_chunks().cast(pa.large_string()))
        text = pc.replace_substring_regex(text, BREAK, f" {STOP} ")
        split = pc.split_pattern_regex(text, BLANK)
        row = np.repeat(np.arange(len(text)), np.diff(np.asarray(split.offsets)))
        coded = split.flatten().dictionary_encode()
        codes, self.words = np.asarray(coded.indices, np.int64), coded.dictionary
        dropped = [np.asarray(pc.equal(self.words, x))[codes] if len(self.words) else np.zeros(0, bool) for x in ("", STOP)]
        piece = np.cumsum(dropped[1])
        kept = ~(dropped[0] | dropped[1])
        self.codes, self.row, self.piece = codes[kept], row[kept], piece[kept]
        self.lang = np.asarray(langs.indices, np.int64)[self.row]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, code and count of every distinct word of a language, and which one each word is."""
        keys, which, n = np.unique(self.lang * max(1, len(self.words)) + self.codes, return_inverse=True, return_counts=True)
        return *np.divmod(keys, max(1, len(self.words))), n, which


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            w = Words(chunk)
            lang, code, n, _ = w.distinct()
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.langs, pa.string()).take(lang), w.words.take(code).cast(pa.string()), pa.array(n, pa.int64())],
                ["lang", "word", "n"],
            )

    parts = docs.mapInArrow(run, WORDS)
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Known:
    """Frequent words, numbered from 1 within their languages; ``all`` if no frequent one is missing."""

    def __init__(self, words: dict[str, dict[str, int]], all: bool, others: int):
        self.all, self.others = all, others
        self.spans, lists = {}, []
        self.counts, self.langs = [0], [""]
        for lang, own in words.items():
            self.spans[lang] = (len(self.counts), len(own))
            lists.append(pa.array(list(own), pa.large_string()))
            self.counts += own.values()
            self.langs += [lang] * len(own)
        self.words = pa.concat_arrays([pa.array([""], pa.large_string()), *lists])
        self.langs = pa.array(self.langs, pa.string()).dictionary_encode()
        self.counts = np.array(self.counts, np.int64)

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        """Numbers of words; a word without one is 0 if it must be rare, else ``OTHER``."""
        default = 0 if self.all else OTHER
        if lang not in self.spans:
            return np.full(len(words), default, np.int64)
        first, size = self.spans[lang]
        own = self.words.slice(first, size)
        found = pc.index_in(words, own)
        return np.where(np.asarray(found.is_valid()), np.asarray(found.fill_null(0), np.int64) + first, default)


def known_words(frequent: DataFrame, rows: int = KNOWN_ROWS, size: int = KNOWN_BYTES) -> Known:
    """The frequent words, down to a power of two of occurrences where they are within the bounds."""
    level = F.floor(F.log2("n"))
    sizes = frequent.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("word") + F.octet_length("lang")).alias("bytes")
    )
    least, complete = 0, True
    for x in sorted(sizes.collect(), key=lambda x: -x["level"]):
        rows, size = rows - x["rows"], size - x["bytes"]
        if rows < 0 or size < 0:
            least, complete = x["level"] + 1, False
            break
    words: dict[str, dict[str, int]] = {}
    for r in frequent.filter(level >= least).collect():
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return Known(words, complete, 0 if complete else 2**least)


def _joined(mask: np.ndarray, texts: pa.Array, which: list[np.ndarray], numbers: list[np.ndarray], before: pa.Array | None):
    """Words without a number, blank-separated, for the rows of ``mask``; null for all others."""
    out = np.full(len(mask), None, object)
    if mask.any():
        columns = [texts.take(np.where(i[mask] == OTHER, w[mask], 0)).to_pylist() for w, i in zip(which, numbers, strict=True)]
        lines = [" ".join(x) for x in zip(*columns, strict=True)]
        if before is not None:
            lines = [f"{a}{STOP}{b}" for a, b in zip(before.filter(pa.array(mask)).to_pylist(), lines, strict=True)]
        out[mask] = lines
    return pa.array(out, pa.string())


def _windows(w: Words, known: Known, hot: int) -> Iterator[pa.RecordBatch]:
    """The distinct padded windows of a chunk with their counts and the part they are dealt to."""
    names = ["pair", "u12", "last", "u34", "n"]
    lang, code, _, which = w.distinct()
    numbers = np.zeros(len(lang) + 1, np.int64)
    texts = pa.concat_arrays([pa.array([""], pa.large_string()), w.words.take(code).cast(pa.large_string())])
    for k, name in enumerate(w.langs):
        own = np.flatnonzero(lang == k) + 1
        numbers[own] = known.numbers(name, texts.take(own))
    which = which + 1
    which[numbers[which] == 0] = 0

    # What a rare word leads has no prefix that counts; it is still one of the language's words.
    cut = np.bincount(w.lang[which == 0], minlength=len(w.langs))
    rare = np.flatnonzero(cut)
    none = pa.nulls(len(rare), pa.string())
    zeros = pa.array(np.zeros(len(rare), np.int64))
    yield pa.RecordBatch.from_arrays(
        [zeros, pc.binary_join_element_wise(pa.array(w.langs, pa.string()).take(rare), " ", STOP), zeros, none, pa.array(cut[rare])], names
    )

    lead, total = [which], len(which)
    for k in range(1, ORDER):
        following = np.zeros(total, np.int64)
        same = (w.row[k:] == w.row[: total - k]) & (w.piece[k:] == w.piece[: total - k])
        following[: max(0, total - k)] = np.where(same & (lead[-1][: total - k] > 0), which[k:], 0)
        lead.append(following)
    kept = which > 0
    size = len(numbers)
    # Two factors of a window, each in 64 bits, and then their combination.
    first, heads = pd.factorize((lead[0] * size + lead[1])[kept])
    last, tails = pd.factorize((lead[2] * size + lead[3])[kept])
    del lead
    keys, n = np.unique(first * max(1, len(tails)) + last, return_counts=True)
    head, tail = np.divmod(keys, max(1, len(tails)))
    w12, w34 = np.divmod(np.asarray(heads)[head], size), np.divmod(np.asarray(tails)[tail], size)
    (i1, i2), (i3, i4) = [numbers[x] for x in w12], [numbers[x] for x in w34]

    often = np.append(known.counts, known.others)
    parts = -(-np.minimum(often[np.minimum(i1, len(often) - 1)], often[np.minimum(i2, len(often) - 1)]) // hot)
    split = parts > 1
    part = np.zeros(len(keys), np.int64)
    if split.any():
        hashes = pd.util.hash_array(np.array(texts.to_pylist(), object), categorize=False)
        part[split] = 1 + (hashes[w34[0][split]] % np.minimum(parts[split], OTHER - 1).astype(np.uint64)).astype(np.int64)
    langs = pa.array(w.langs, pa.string()).take(lang[np.maximum(w12[0], 1) - 1]) if len(keys) else pa.array([], pa.string())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(i1 << 2 * BITS | i2 << BITS | part),
            _joined((i1 == OTHER) | (i2 == OTHER), texts, w12, [i1, i2], langs),
            pa.array(i3 << BITS | i4),
            _joined((i3 == OTHER) | (i4 == OTHER), texts, w34, [i3, i4], None),
            pa.array(n),
        ],
        names,
    )


def _decoded(table: pa.RecordBatch, known: Known) -> pa.RecordBatch:
    """Windows cut after their ``kept`` words, combined, as text."""
    pair, last, n, kept = (np.asarray(table.column(c), np.int64) for c in ("pair", "last", "n", "kept"))
    ids = [pair >> 2 * BITS, pair >> BITS & OTHER, last >> BITS, last & OTHER]
    ids = [np.where(kept > k, x, 0) for k, x in enumerate(ids)]
    texts = (table.column("u12").is_valid(), table.column("u34").is_valid())
    plain = ~(np.asarray(texts[0]) | np.asarray(texts[1]))

    keys = pd.DataFrame({k: x[plain] for k, x in enumerate(ids)} | {"n": n[plain]})
    summed = keys.groupby([0, 1, 2, 3], sort=False)["n"].sum().reset_index()
    columns = [known.langs.take(pa.array(summed[0])).cast(pa.string())]
    columns += [known.words.take(pa.array(summed[k])).cast(pa.string()) for k in range(ORDER)]
    columns.append(pa.array(summed["n"], pa.int64()))

    rows = []
    for i in np.flatnonzero(~plain):
        u12, u34 = table.column("u12")[i].as_py(), table.column("u34")[i].as_py()
        lang, _, own = (u12 or STOP).partition(STOP)
        given = [*own.split(" "), ""][:2] + ([*u34.split(" ")] if u34 else ["", ""])
        numbers = [int(x[i]) for x in ids]
        words = [given[k] if x == OTHER else known.words[x].as_py() for k, x in enumerate(numbers)]
        rows.append((lang if u12 else known.langs[numbers[0]].as_py(), *words, int(n[i])))
    other = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.string()] * 5 + [pa.int64()]
    merged = [pa.concat_arrays([c, pa.array(o, t)]) for c, o, t in zip(columns, other, types, strict=True)]
    return pa.RecordBatch.from_arrays(merged, ["lang", "w1", "w2", "w3", "w4", "n"])


def windows(docs: DataFrame, known: Known, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): padded windows, cut where their first words are too rare."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield from _windows(Words(chunk), shared.value, hot)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, shared.value)

    pair, three = ["pair", "u12"], ["pair", "u12", "w3", "u3"]
    # The order lets both sums do with one sort.
    pairs = Window.partitionBy(*pair).orderBy("w3", "u3").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = (
        docs.mapInArrow(count, WINDOWS)
        .repartition(*pair)
        .groupBy(*pair, "last", "u34")
        .agg(F.sum("n").alias("n"))
        .withColumns({"w3": F.shiftright("last", BITS), "u3": F.coalesce(F.substring_index("u34", " ", 1), F.lit(""))})
        .withColumn("n3", F.sum("n").over(Window.partitionBy(*three)))
        .withColumn("n2", F.sum("n").over(pairs))
    )
    whole_pair = F.col("pair").bitwiseAND(F.lit(OTHER)) == 0
    kept = (
        F.when(whole_pair & (F.col("n2") < least), 1)
        .when(F.col("n3") < least, 2)
        .when(F.col("n") < least, 3)
        .otherwise(ORDER)
    )
    return counted.select("pair", "u12", "last", "u34", "n", kept.cast("bigint").alias("kept")).mapInArrow(decode, CUT)


def rolled(cut: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, f): phrases of 1 to 4 words found ``least`` times; size 0 has all words."""
    names = [f"w{i}" for i in range(1, ORDER + 1)]
    # Of the prefixes, those that end in a word; the bits of the id tell which columns are summed.
    ends = F.col("level") == 2**ORDER - 1
    for i, w in enumerate(names, 1):
        ends |= (F.col("level") == 2 ** (ORDER - i) - 1) & (F.col(w) != "")
    sums = cut.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    size = F.size(F.array_compact(F.array(*names)))
    return (
        sums.filter(ends)
        .select("lang", size.alias("size"), F.concat_ws(" ", *names).alias("phrase"), "f")
        .filter((F.col("size") == 0) | (F.col("f") >= least))
    )


def _held(parts: DataFrame) -> DataFrame:
    """Broadcast after a count of rows and bytes, else left to a join by shuffle."""
    size = parts.agg(F.sum(F.octet_length("part"))).collect()[0][0] or 0
    return bounded(parts) if size <= PHRASE_BYTES else parts


def _text(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a) with l, r and score of their lowest-scoring cut."""
    counts = _held(phrases.filter("size between 1 and 3").select("lang", F.col("phrase").alias("part"), F.col("f").alias("g")))
    several = phrases.filter("size > 1").withColumnRenamed("f", "a")
    cuts = several.withColumn("ws", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    k = F.col("k")
    cuts = cuts.select(
        "lang", "phrase", "size", "a", "k",
        _text(F.col("ws"), F.lit(1), k).alias("first"),
        _text(F.col("ws"), k + 1, F.col("size") - k).alias("rest"),
    )
    left = counts.select("lang", F.col("part").alias("first"), F.col("g").alias("l"))
    right = counts.select("lang", F.col("part").alias("rest"), F.col("g").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    best = joined.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def standing(candidates: DataFrame, phrases: DataFrame, within: int = WITHIN) -> DataFrame:
    """Candidates that no longer phrase stands for."""
    spans = (
        "flatten(transform(sequence(2, size - 1), n ->"
        " transform(sequence(1, size - n + 1), i -> struct(i as start, n as length))))"
    )
    inner = phrases.filter("size > 2").withColumn("ws", F.split("phrase", " ")).select("lang", "f", "ws", F.inline(F.expr(spans)))
    longer = (
        inner.select("lang", _text(F.col("ws"), F.col("start"), F.col("length")).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longest"))
    )
    found = candidates.join(longer, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    stands = F.col("longest").isNotNull() & (wide("longest") * 100 >= wide("a") * within)
    return found.filter(~stands).drop("longest")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; first of each of its parts, so that no task sorts it all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    heads = (
        candidates.withColumn("salt", salt)
        .withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
        .filter(F.col("place") <= top)
    )
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
    rows: int = KNOWN_ROWS, hot: int = HOT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language."""
    ship(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole(text).alias("text"))
    frequent = stored(word_counts(base).filter(F.col("n") >= least), "collocation-words")
    phrases = stored(rolled(windows(base, known_words(frequent, rows), least, hot), least), "collocation-phrases")
    totals = bounded(phrases.filter("size = 0").select("lang", F.col("f").alias("n")))
    found = best(standing(scored(phrases), phrases), top).join(totals, "lang")
    return found.select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")

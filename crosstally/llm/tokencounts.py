"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token here is what ASCII white space delimits.  The vocabulary drops white space and none of
its pieces, normalisation steps or special strings reaches over it, so a text has the sum of its
pre-tokens' pieces.  Every distinct pre-token goes through the library once; the counts are joined
to the pre-tokens of each document.  The most frequent pre-tokens, at most ``FREQUENT`` of at most
``SHORT`` bytes, make a table of proven size that is broadcast; all others are joined by shuffle,
where none of the short ones can be a hot key, being rarer than those.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows are counted each; an
empty table gives an empty result; columns that are not named are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, whole, words

#: Bounds of the broadcast table: its rows and the bytes of a pre-token.
FREQUENT, SHORT = 2**19, 64
#: Pre-tokens handed to the library at once.
BATCH = 2000


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def counted(frequencies: DataFrame, path: str) -> DataFrame:
    """(word, occurrences) with ``pieces``: what the library makes of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for batch in batches:
            listed, pieces = batch.column("word").to_pylist(), []
            for i in range(0, len(listed), BATCH):
                made = t.encode_batch_fast(listed[i : i + BATCH], add_special_tokens=False)
                pieces += [len(x) for x in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("occurrences"), pa.array(pieces, pa.int32())],
                ["word", "occurrences", "pieces"],
            )

    ship(frequencies.sparkSession)
    return frequencies.mapInArrow(run, "word string, occurrences bigint, pieces int")


def frequent(counts: DataFrame, limit: int = FREQUENT):
    """Condition for the most frequent short words, of which there are at most ``limit``.

    Chosen by a histogram of eighths of a power of two, a few hundred numbers.
    """
    level = F.floor(8 * F.log2("occurrences"))
    short = F.octet_length("word") <= SHORT
    found = counts.filter(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 10_000, 0
    for x in sorted(found, key=lambda x: -x["level"]):
        total += x["n"]
        if total > limit:
            break
        least = x["level"]
    return short & (level >= least)


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens."""
    t = whole(text)
    counts = docs.select(F.explode(words(t)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    counts = stored(counted(counts, path), "token-words")
    hot = frequent(counts, limit)
    known, rest = counts.filter(hot).select("word", "pieces"), counts.filter(~hot).select("word", "pieces")
    # A document's key with its text's hash: equal rows share it, and a null word marks each row.
    key = ["doc_id", "copy", "n_bytes"]
    base = docs.select(
        F.col(id).alias("doc_id"),
        F.xxhash64(t).alias("copy"),
        F.octet_length(t).cast("bigint").alias("n_bytes"),
        words(t).alias("words"),
    )
    marks = base.select(*key, F.lit(0).cast("bigint").alias("pieces"), F.lit(1).cast("bigint").alias("rows"))
    each = base.select(*key, F.explode("words").alias("word"))
    small = F.broadcast(known)
    parts = [
        each.join(small, "word").select(*key, F.col("pieces").cast("bigint"), F.lit(0).cast("bigint").alias("rows")),
        each.join(small.select("word"), "word", "left_anti")
        .join(rest, "word")
        .select(*key, F.col("pieces").cast("bigint"), F.lit(0).cast("bigint").alias("rows")),
    ]
    sums = marks.unionByName(parts[0]).unionByName(parts[1]).groupBy(*key)
    sums = sums.agg(F.sum("pieces").alias("pieces"), F.sum("rows").alias("rows"))
    return sums.select(
        "doc_id",
        "n_bytes",
        F.expr("pieces div rows").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("n"),
    ).drop("n")

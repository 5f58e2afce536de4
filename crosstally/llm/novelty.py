"""Secrets by fixed patterns, and by how little a string compresses among the code around it.

Three kinds come from patterns (``KINDS``).  A fourth, ``novel``, comes from the method: a run of
``RUN`` characters near a sensitive word is compressed behind the text that surrounds it, by a
zstandard compressor that is primed with a dictionary of identifiers.  The bytes that it adds,
divided by its length, are its novelty: names built from known identifiers, repeated strings and
prose add little, random strings add about all they hold.  At ``NOVEL`` or more it is reported.

The dictionary is made of the corpus' own identifiers: the parts of all long runs of all texts, by
the number of texts that have them, at most ``IDENTIFIERS`` parts of at most 24 letters.  This
list is the only thing that leaves the tasks; documents are neither shuffled nor joined.

Spans count in code points, end exclusive.  A novel span that base spans cover whole is not given.
Defined cases: a null or empty text has no spans; a text is searched whole, whatever its length;
repeated rows are reported each; null ids are kept; an empty table gives no rows; columns that are
not named are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, ship, stored, whole

# The kinds in order, their patterns, the group that is measured, its least length.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
NOVEL_KIND = "novel"

#: What the method looks at, and the words that must stand at most ``NEAR`` characters before it.
RUN = re.compile(r"[A-Za-z0-9+/_.-]{15,}[A-Za-z0-9+/_-]={0,2}")
SENSITIVE = re.compile(
    r"passw|passphrase|pwd|secret|token|api.?key|private.?key|access.?key|credential|auth|bearer|signature|session",
    re.IGNORECASE | re.ASCII,
)
NEAR, AROUND = 64, 256
#: Added bytes over length from which a run is novel.
NOVEL = 0.7

#: Parts of identifiers, and how many of them prime the compressor.
PART = re.compile(r"[A-Z]?[a-z]{2,23}|[A-Z]{3,24}")
IDENTIFIERS = 4096
LEVEL = 19
BATCH = 1000

SPANS = "array<struct<kind: string, start: bigint, end: bigint, novelty: double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern, group, least in KINDS:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return found


class Primed:
    """A compressor that knows the identifiers."""

    def __init__(self, identifiers: list[str]):
        # The compressor refuses a dictionary of fewer than 8 bytes.
        known = " ".join(["value", "string", *identifiers]).encode()
        d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

    def novelty(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode()
        added = len(self.compressor.compress(around + text[start:end].encode())) - len(self.compressor.compress(around))
        return added / (end - start)

    def spans(self, text: str, least: float = NOVEL) -> list[tuple[str, int, int, float]]:
        """Novel runs of a text that stand near a sensitive word."""
        found = []
        for m in RUN.finditer(text):
            start, end = m.span()
            if SENSITIVE.search(text, max(0, start - NEAR), start):
                novelty = self.novelty(text, start, end)
                if novelty >= least:
                    found.append((NOVEL_KIND, start, end, novelty))
        return found


def covered(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether sorted spans cover the whole of ``span``."""
    at, end = span
    for a, z in spans:
        if a > at:
            break
        at = max(at, z)
    return at >= end


def secret_spans(text: str, primed: Primed, least: float = NOVEL) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind as listed."""
    base = base_spans(text)
    places = sorted((a, z) for _, a, z in base)
    order = {kind: k for k, (kind, *_) in enumerate(KINDS)} | {NOVEL_KIND: len(KINDS)}
    novel = [s for s in primed.spans(text, least) if not covered(s[1:3], places)]
    return sorted([(*s, None) for s in base] + novel, key=lambda s: (s[1], order[s[0]], s[2]))


def identifiers(docs: DataFrame, text: str = "text", limit: int = IDENTIFIERS) -> list[str]:
    """The parts that most texts have in long runs, at most ``limit``, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                n.update({p for m in RUN.finditer(t) for p in PART.findall(m.group())})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["part", "texts"]
            )

    parts = docs.select(whole(text).alias("text")).mapInArrow(run, "part string, texts bigint")
    counts = parts.groupBy("part").agg(F.sum("texts").alias("texts"))
    # A sort of a bounded head: every task keeps ``limit`` rows.
    top = counts.filter("texts > 1").orderBy(F.desc("texts"), "part").limit(limit).collect()
    return [r["part"] for r in reversed(top)]


def secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: float = NOVEL) -> DataFrame:
    """``docs``, or its columns ``keep``, with the column ``secrets``: kind, start, end and, for the
    method's, novelty."""
    ship(docs.sparkSession)
    known = identifiers(docs, text)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != "secrets"]
    schema = StructType([docs.schema[c] for c in names] + StructType.fromDDL(f"secrets {SPANS}").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = Primed(known)
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
        )
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in secret_spans(t, primed, least)]
                for t in batch.column(len(names)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*names, "secrets"])

    return docs.select(*names, whole(text).alias(fresh(docs, "whole"))).mapInArrow(run, schema)


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, hash of the base spans, all spans, the greatest novelty."""
    kept = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    found = stored(secrets(kept, keep=["doc_id"]), "secrets", BATCH)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] != NOVEL_KIND)
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS],
        F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("secrets")).alias("spans"),
        count(NOVEL_KIND).alias("n_novel"),
        F.array_max(F.transform("secrets", lambda s: s["novelty"])).alias("novelty"),
    )

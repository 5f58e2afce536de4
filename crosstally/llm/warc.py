"""WARC archives: writing pages as records, and reading archives back in parallel.

Reading cuts a file at every occurrence of the magic line, wherever Spark split the file.  Each
occurrence is a candidate: its header says where its successor would begin.  Candidates that follow
each other directly form runs; pointer jumping over the runs, from the start of the file, keeps
those that are reached, so magic inside a payload, even a whole record, is never taken for one.

Defined cases: a null html is an empty payload; a null page id is written and read as null, and of
equal payloads is the smallest; repeated rows of a response are responses each; an empty table
gives an empty archive and result; columns that are not named are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, new_path, stored, whole

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

DATE = "2026-01-01T00:00:00Z"
#: Records are put together again from pieces found by bins of this many bytes.
BIN = 2**20


def digest(payload: Column) -> Column:
    """SHA-1 in base32: every five hexadecimal digits are four letters."""
    shares = F.array(*[F.lit(32**k) for k in (3, 2, 1, 0)])

    def letters(hexadecimal: Column) -> Column:
        def letter(i: Column) -> Column:
            digits = F.substr(hexadecimal, (5 * F.floor(i / 4) + 1).cast("int"), F.lit(5))
            value = F.conv(digits, 16, 10).cast("int") / F.get(shares, i % 4)
            return F.substr(F.lit(BASE32), (F.floor(value) % 32 + 1).cast("int"), F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    return let(F.sha1(payload.cast("binary")), letters)


# -- writing -------------------------------------------------------------------------------------


def http_header(payload_bytes: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        payload_bytes.cast("string"),
        F.lit(END),
    )


def records(pages: DataFrame, least: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record): a record per page, without the blank lines that end it.

    Of equal payloads of at least ``least`` bytes the page with the largest id is the response.
    Pages whose payload is unique need no partner; the others' digests are a table of their own.
    """
    p = pages.select(
        F.col(id).cast("bigint").alias("page_id"),
        F.regexp_replace(url, r"[\x00-\x20]", "%20").alias("url"),
        whole(html).alias("payload"),
    )
    # The digest is computed from the payload, and read from the table that holds equal ones.
    sized = p.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", digest(F.col("payload")))
    equal = (
        sized.filter(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND response IS NOT NULL")
        .drop("n")
    )
    equal = stored(equal, "warc-equal")
    s, e = sized.alias("s"), equal.alias("e")
    joined = s.join(e, (F.col("s.digest") == F.col("e.digest")) & (F.col("s.bytes") == F.col("e.bytes")), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">\r\n"))
    line = lambda key, x: F.concat(F.lit(f"{key}: "), x, F.lit("\r\n"))
    block = F.concat(http_header(F.col("s.bytes")), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return joined.select(block.alias("block"), revisit.alias("revisit"), "page_id", "response", "url", F.col("s.digest").alias("digest")).select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            F.lit("WARC-Record-ID: "),
            name(F.col("page_id")),
            F.when(
                F.col("revisit"),
                F.concat(F.lit("WARC-Refers-To: "), name(F.col("response")), line("WARC-Profile", F.lit(PROFILE))),
            ).otherwise(F.lit("")),
            line("WARC-Date", F.lit(DATE)),
            F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("record")
    )


def write(records: DataFrame, path: str) -> None:
    """Archives below ``path``, one per task; the blank lines after a record separate the rows."""
    records.write.option("lineSep", END).text(path)


# -- reading -------------------------------------------------------------------------------------


def cuts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value): the bytes between magic lines, in order within a block."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("nth"),
            "value",
        )
    )


def _header_field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^-?\d{1,19}$"), text).try_cast("bigint")


def contents(value: Column, head: Column, length: Column) -> Column:
    """Fields of a record whose bytes after the magic line are ``value``: its header of ``head``
    bytes, a blank line, a block of ``length`` bytes."""
    header, upto = F.substring_index(value, END, 1), F.substring_index(value, END, 2)
    over_http = F.coalesce(_header_field(header, "Content-Type").contains("application/http"), F.lit(False))
    http = F.when(over_http, F.octet_length(upto) - head).otherwise(0)
    payload = F.substring(value.cast("binary"), (head + http).cast("int") + 5, (length - http).cast("int"))
    kind = _header_field(header, "WARC-Type")
    revisit = F.coalesce(kind == "revisit", F.lit(False))
    page = lambda key: _number(F.regexp_extract(F.coalesce(_header_field(header, key), F.lit("")), r"^<urn:page:(.*)>$", 1))
    said = F.regexp_extract(F.coalesce(_header_field(header, "WARC-Payload-Digest"), F.lit("")), r"^sha1:(\S+)$", 1)
    said_bytes = _number(F.coalesce(_header_field(F.substring_index(upto, END, -1), "Content-Length"), F.lit("")))
    return F.struct(
        page("WARC-Record-ID").alias("page_id"),
        # A revisit holds no payload; its headers speak of the whole one.
        F.when(revisit, said_bytes).otherwise(F.octet_length(payload).cast("bigint")).alias("payload_bytes"),
        F.when(revisit, said).otherwise(digest(payload)).alias("payload_digest"),
        kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
    )


def scanned(cuts: DataFrame) -> DataFrame:
    """Every cut's place and size, its header's claim, and the record if the cut holds all of it."""
    header = F.substring_index("value", END, 1)
    claim = F.regexp_extract(header, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    size, head = F.octet_length("value").cast("bigint"), F.octet_length(header).cast("bigint")
    rows = cuts.select(
        "file", "block", "nth", "value", size.alias("size"), head.alias("head"),
        F.when((head < size) & (claim != ""), claim).cast("bigint").alias("length"),
    )
    complete = F.coalesce(F.col("size") >= F.col("head") + F.col("length") + len(END), F.lit(False))
    record = F.when(complete, contents(F.col("value"), F.col("head"), F.col("length")))
    return rows.select("file", "block", "nth", "size", "head", "length", record.alias("record"))


def placed(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """``rows`` with ``at``, where their bytes begin in the file, from the sizes before them.

    Sizes are summed per block, then over the blocks of a file: no task sees a whole file's rows.
    """
    before = W.partitionBy("file", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0))
    return rows.withColumn("own", own).join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("own")).drop("own", "base")


def block_bases(scan: DataFrame) -> DataFrame:
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = scan.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    return sums.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))


def candidates(scan: DataFrame, bases: DataFrame) -> DataFrame:
    """Candidate records with offset, successor and the run they belong to.

    A run is a chain of direct neighbours within a block that nothing from outside points into but
    at its head.
    """
    c = (
        placed(scan, bases)
        .filter("length IS NOT NULL AND at > 0")
        .withColumn("offset", F.col("at") - len(MAGIC))
        .withColumn("next", F.col("at") + F.col("head") + F.col("length") + 2 * len(END))
    )
    order = W.partitionBy("file", "block").orderBy("offset")
    c = c.withColumn("direct", F.coalesce(F.col("next") == F.lead("offset").over(order), F.lit(False)))
    c = stored(c, "warc-candidates")
    aimed = c.filter("NOT direct").select("file", F.col("next").alias("offset"), F.lit(True).alias("aimed")).distinct()
    head = F.col("aimed").isNotNull() | ~F.coalesce(F.lag("direct").over(order), F.lit(False))
    c = c.join(aimed, ["file", "offset"], "left").withColumn("is_head", head)
    return stored(c.withColumn("run", F.sum(F.col("is_head").cast("int")).over(order)).drop("aimed", "is_head", "direct"), "warc-runs")


def reached(candidates: DataFrame) -> DataFrame:
    """(file, block, run) of the runs on the chain from the start of their file.

    Pointer jumping: each round doubles how far a pointer reaches, and what it reaches from a
    reached run is reached; so the rounds are the logarithm of the runs of the longest chain.
    """
    runs = candidates.groupBy("file", "block", "run").agg(F.min("offset").alias("offset"), F.max("next").alias("next"))
    runs = stored(runs.withColumn("on", F.col("offset") == 0), "warc-chain")
    most = runs.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) + 1 if most > 1 else 0):
        hit = runs.filter("on AND next IS NOT NULL").select("file", F.col("next").alias("offset"), F.lit(True).alias("hit")).distinct()
        further = runs.select("file", F.col("offset").alias("next"), F.col("next").alias("further"))
        runs = (
            runs.join(hit, ["file", "offset"], "left")
            .join(further, ["file", "next"], "left")
            .select("file", "block", "run", "offset", F.col("further").alias("next"), (F.col("on") | F.col("hit").isNotNull()).alias("on"))
        )
        runs = stored(runs, "warc-chain")
    return runs.filter("on").select("file", "block", "run")


def _put_together(spark: SparkSession, path: str, parts: DataFrame, bases: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, from all the cuts they span."""
    # A magic line may begin inside the payload's last bytes and end behind them.
    behind = F.col("end") + len(MAGIC)
    span = F.sequence(F.floor(F.col("at") / BIN), F.floor(behind / BIN))
    wanted = parts.withColumn("bin", F.explode(span)).alias("w")
    raw = cuts(spark, path).join(parts.select("file").distinct(), "file", "left_semi")
    raw = placed(raw.withColumn("size", F.octet_length("value").cast("bigint")), bases)
    raw = raw.withColumn("bin", F.floor(F.col("at") / BIN)).alias("r")
    inside = (
        (F.col("r.file") == F.col("w.file"))
        & (F.col("r.bin") == F.col("w.bin"))
        & F.col("r.at").between(F.col("w.at"), F.col("w.end") + len(MAGIC))
    )
    pieces = F.array_sort(F.collect_list(F.struct("r.at", "r.value")))
    whole_value = F.array_join(F.transform(pieces, lambda x: x["value"]), MAGIC)
    return (
        wanted.join(raw, inside)
        .groupBy("w.file", "w.offset", "w.head", "w.length")
        .agg(whole_value.alias("value"))
        .select("file", "offset", contents(F.col("value"), F.col("head"), F.col("length")).alias("record"))
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: file, offset, page_id, payload_bytes,
    payload_digest (of the payload read), record_type, refers_to."""
    scan = stored(scanned(cuts(spark, path)), "warc-scan")
    bases = stored(block_bases(scan), "warc-blocks")
    c = candidates(scan, bases)
    kept = stored(c.join(reached(c), ["file", "block", "run"]), "warc-records")
    rows = kept.select("file", "offset", "record")
    parts = kept.filter("record IS NULL").select(
        "file", "offset", "at", "head", "length", (F.col("at") + F.col("head") + F.col("length") + len(END)).alias("end")
    )
    if not parts.isEmpty():
        rows = rows.filter("record IS NOT NULL").unionByName(_put_together(spark, path, parts, bases))
    return rows.select("file", "offset", "record.*")


def archive(pages: DataFrame, least: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    path = new_path(pages.sparkSession, "warc")
    write(records(pages, least, id, url, html), path)
    return read(pages.sparkSession, path)

"""Quality rules: counts within a document, and lines that many documents of a host share.

Built-in functions only.  Defined cases: a null or empty text has no words and fails the rules; a
null host is a host of its own; repeated rows are judged alike and copies of a text count as one
document; an empty table gives an empty result; columns that are not named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, fresh, let, stored, whole, words

MIN_WORDS = 50
#: Share in percent of a text's words that may stand in repeated three-word windows.
MAX_REPEAT = 50
#: A line in more documents of a host than this is not the documents' own.
MAX_DOCUMENTS = 20
#: Percent of its words that a document must keep without such lines.
MIN_LEFT = 50

LINE = "struct<line: bigint, words: int>"


def _repeated(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(ranked: Column) -> Column:
        # Equal windows are neighbours once sorted.
        twice = F.filter(
            ranked,
            lambda x, j: (F.get(ranked, j - 1)["h"] == x["h"]) | (F.get(ranked, j + 1)["h"] == x["h"]),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["at"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda total, step: total + step,
            ),
        )

    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(
                F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))),
                covered,
            )
        ),
    )


def normal_line(line: Column) -> Column:
    """Lower case, one blank between words, none around."""
    return F.array_join(words(F.lower(line)), " ")


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: the counts of the text, its fingerprint and its hashed lines."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    counts = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    hashed = F.transform(
        lines,
        lambda x: let(
            words(F.lower(x)),
            lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("line"), F.size(w).alias("words")),
        ),
    )
    return docs.select(
        F.col(id).alias("doc_id"),
        F.col(host).alias("host"),
        F.xxhash64(t).alias("copy"),
        counts.alias("counts"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        dup.alias("n_dup_lines"),
        hashed.cast(f"array<{LINE}>").alias("lines"),
        F.monotonically_increasing_id().alias("row"),
    ).select("row", "doc_id", "host", "copy", "counts.*", "n_symbols", "n_dup_lines", "lines")


def frequent_lines(measured: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line, owner): lines in more than ``max_documents`` different texts of a host.

    The owner, the smallest document id, keeps the line, so that of a group of near copies one
    text stays whole.  Two levels of aggregation spread a frequent line over its documents.
    """
    each = measured.select("host", "copy", "doc_id", F.explode(F.array_distinct("lines.line")).alias("line"))
    return (
        each.groupBy("host", "line", "copy")
        .agg(F.min("doc_id").alias("owner"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("owner").alias("owner"))
        .filter(F.col("documents") > max_documents)
    )


def lost_lines(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, lost words, lost lines) of the rows that hold frequent lines of others."""
    m, f = measured.select("row", "doc_id", "host", F.explode("lines").alias("x")).alias("m"), frequent.alias("f")
    return (
        m.join(
            f,
            F.col("m.host").eqNullSafe(F.col("f.host"))
            & (F.col("m.x.line") == F.col("f.line"))
            & ~F.col("m.doc_id").eqNullSafe(F.col("f.owner")),
        )
        .groupBy("m.row")
        .agg(F.sum("m.x.words").alias("lost"), F.collect_set("f.line").alias("lost_lines"))
    )


def verdicts(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """The measures of every row, ``base_failed``, ``lost`` words, ``lost_lines`` and ``kept``."""
    m = stored(measures(docs, id, text, host), "quality-measures")
    frequent = stored(frequent_lines(m, max_documents), "quality-lines")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lost = F.coalesce("lost", F.lit(0))
    return (
        m.drop("lines")
        .join(lost_lines(m, frequent), "row", "left")
        .withColumn("lost", lost)
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (100 * (F.col("n_words") - lost) >= MIN_LEFT * F.col("n_words")))
    )


def clean(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    chars: str | None = "n_chars",
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """The kept rows with all their columns, without the frequent lines of others.

    ``chars`` names a column with the text's length, brought up to date where it is there.
    """
    # Rows that agree in these three have the same verdict.
    v = verdicts(docs, id, text, host, max_documents).groupBy("doc_id", "host", "copy")
    v = v.agg(F.first("kept").alias("kept"), F.first("lost_lines").alias("gone"))
    v = v.filter("NOT kept OR gone IS NOT NULL")
    names = {c: fresh(docs, f"quality_{c}") for c in v.columns}
    n = {k: F.col(x) for k, x in names.items()}
    v = stored(v.withColumnsRenamed(names), "quality-touched")
    # Only what goes or changes is joined to the texts.
    same = (
        F.col(f"`{id}`").eqNullSafe(n["doc_id"]) & F.col(f"`{host}`").eqNullSafe(n["host"]) & (F.xxhash64(whole(text)) == n["copy"])
    )
    left = F.array_join(
        F.filter(
            F.split(text, "\n"),
            lambda x: ~(x.rlike(WORD) & F.array_contains(n["gone"], F.xxhash64(normal_line(x)))),
        ),
        "\n",
    )
    lines = v.agg(F.coalesce(F.sum(F.greatest(F.size(n["gone"]), F.lit(1))), F.lit(0))).first()[0]
    if lines <= BROADCAST_ROWS:
        v = F.broadcast(v)
    kept = (
        docs.join(v, same, "left")
        .filter(F.coalesce(n["kept"], F.lit(True)))
        .withColumn(text, F.when(n["gone"].isNull(), F.col(text)).otherwise(left))
    )
    if chars in docs.columns:
        kept = kept.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

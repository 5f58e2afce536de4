"""Mixing sources to target weights by Pareto order sampling.

Built-in functions only.  Every document of a source is expected target / size times: the whole
part are certain copies, the rest is its inclusion probability for one copy more.  Documents are
ranked by random odds over inclusion odds, and the extra copies go down that ranking until the
source's words are reached, to the nearest document.  The randomness is a hash of seed and id.

Defined cases: a null text has no words; null is a source of its own, the last; rows that agree in
source and id (repeated rows, null ids) are taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, stored, whole

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def word_count(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def chance(id: str, seed: str = SEED) -> Column:
    """A number in (0, 1): 48 bits of a hash of the seed and the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id).cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def rank_key(u: Column, p: Column) -> Column:
    """Pareto's order: random odds over inclusion odds; null where nothing can be included."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source its size, weight and target words.

    ``sizes`` has a row per source: sources are the mix's configuration, one line each, so their
    ranking in one task is small whatever the number of documents.  Water filling: with sources
    ordered by size over weight, those below the water level stop at their cap.
    """
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w).cast("bigint") for w in weights])
    s = sizes.withColumn("nth", F.row_number().over(ranked)).withColumn(
        "weight", F.get(pattern, (F.col("nth") - 1) % len(weights))
    )
    everything = W.partitionBy()
    before = W.orderBy(F.col("source_size") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("cap", max_repeat * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn(
            "full",
            F.col("cap") * (F.col("weights") - F.col("weights_before"))
            <= F.col("weight") * (F.col("total") - F.col("caps_before")),
        )
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("sharing", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("rest") * F.col("weight")).cast("double") / F.col("sharing").cast("double")
    )
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source the certain copies and where its ranking ends.

    ``sized``: doc_id, source, size, u, stored.  A source is cut into about sqrt(documents) ranges
    of u, summed map-side; only the range in which the words run out is put in order, so neither
    step has a large group, however large a source is.
    """
    spread = max(1, round(sized.count() ** 0.5))
    sized = sized.withColumn("span", F.floor(F.col("u") * spread))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = (
        targets(sizes, weights, max_repeat)
        .withColumn("copies", F.floor(each))
        .withColumn("p", each - F.floor(each))
        .withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("spread", F.lit(spread))
    )
    s = stored(s, "mix-targets")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    order = W.partitionBy("source").orderBy("span")
    spans = sized.groupBy("source", "span").agg(F.sum("size").alias("words"))
    spans = spans.withColumn("upto", F.sum("words").over(order))
    last = (
        spans.alias("a")
        .join(s.filter("p > 0").alias("b"), same("a", "b"))
        .filter((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("words") <= F.col("wanted")))
        .select("b.source", "span", "p", (F.col("wanted") - F.col("upto") + F.col("words")).alias("left"))
    )
    last = stored(last, "mix-spans")
    ranked = W.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first())
    near = (
        sized.alias("a")
        .join(last.alias("b"), same("a", "b") & (F.col("a.span") == F.col("b.span")))
        .select("a.source", "doc_id", "size", "left", rank_key(F.col("u"), F.col("p")).alias("q"))
        .groupBy("source", "q", "doc_id", "left")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.sum("size").over(ranked))
        # Over the mark only by less than stopping before would be short of it.
        .filter(F.col("upto") - F.col("left") < F.col("left") - F.col("upto") + F.col("size"))
        .groupBy("source")
        .agg(F.max(F.struct("q", "doc_id")).alias("end"))
    )
    return stored(
        s.alias("s")
        .join(last.alias("l"), same("s", "l"), "left")
        .join(near.alias("n"), same("s", "n"), "left")
        .select("s.*", F.col("l.span").alias("last_span"), "n.end"),
        "mix-plan",
    )


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, size, u) with source_size, target and copies.

    Copies are those the plan gives the document; a copy is always whole.
    """
    r, p = rows.alias("r"), plan.alias("p")
    span, q = F.floor(F.col("r.u") * F.col("p.spread")), rank_key(F.col("r.u"), F.col("p.p"))
    # Without a last span the ranking's words do not run out: all are taken, or none has a chance.
    more = F.when(F.col("p.p") <= 0, False).otherwise(
        F.col("p.last_span").isNull()
        | (span < F.col("p.last_span"))
        | (
            (span == F.col("p.last_span"))
            & F.col("p.end").isNotNull()
            & (F.struct(q.alias("q"), F.col("r.doc_id").alias("doc_id")) <= F.col("p.end"))
        )
    )
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.*",
        "p.source_size",
        "p.target",
        (F.col("p.copies") + more.cast("int")).cast("int").alias("copies"),
    )


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    return docs.select(
        F.col(id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        chance(id, seed).alias("u"),
    )


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken words."""
    s = stored(sized(docs, id, text, source, seed), "mix-sizes")
    return mixed(s, plan(s)).withColumn("taken", F.col("size") * F.col("copies")).drop("u")


def mixed_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED
) -> DataFrame:
    """The documents of the mix with all their columns, a row for every copy."""
    s = stored(sized(docs, id, text, source, seed), "mix-sizes")
    p = plan(s)
    made = {"doc_id": F.col(f"`{id}`"), "source": F.col(f"`{source}`"), "size": word_count(text), "u": chance(id, seed)}
    row = fresh(docs, "document")
    rows = docs.select(*[c.alias(k) for k, c in made.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    return (
        mixed(rows, p)
        .filter("copies > 0")
        .withColumn("copy_number", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(f"{row}.*")
    )

"""Licence scans by a positional index of rare licence words.

Built-in functions only.  Base: places where a phrase's words stand in a row.  Method: the words of
the templates are ranked by the number of files that have them.  A file looks up the rarest words of
every template in the index (word, template, place), and each hit puts the template at a distance in
the file.  At that distance all indexed words of the template are counted that stand in their place,
or up to ``DRIFT`` words beside it, as a word more or less in the file moves those behind it.  A
template with enough of its words at one distance, and whose mandatory phrases all occur, gives its
label.  So many words of a template are looked up that a file with enough of them has one at least.
Letters A-Z are compared in lower case, all other characters as they are.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned
each; an empty table gives an empty result; columns that are not named are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored, whole

#: What stands between words; upper-case letters are word characters too.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and labels of the base.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licences and notices; label, wording, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl-3", "gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("agpl-3", "gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software",),
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express "
        "or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
        "and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "the software is provided as is"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the "
        "software is provided as is and the author disclaims all warranties with regard to this software including "
        "all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection "
        "with the use or performance of this software",
        ("permission to use copy modify and or distribute this software", "the author disclaims all warranties"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by the copyright holders and contributors "
        "as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or "
        "tort including negligence or otherwise arising in any way out of the use of this software even if advised of "
        "the possibility of such damage",
        ("redistribution and use in source and binary forms", "this software is provided by the copyright holders"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
        ("apache license version 2 0", "governing permissions and limitations under the license"),
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your option "
        "any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
        "public license for more details you should have received a copy of the gnu general public license along with "
        "this program",
        ("gnu general public license", "either version 3 of the license"),
    ),
)

#: Words of the templates that ordinary prose uses as well; they are not indexed.
COMMON = frozenset(
    "a above all an and any appear are as at be but by can code copy data deal do either even event except file files "
    "following for form forms free from general goods have holder holders hope if in including international is it kind "
    "language later law list loss may met more must no not of on option or other out person persons public purpose see "
    "sell services shall should so special subject such terms that the theory this to under unless use useful way "
    "whether whom will with without writing you your 0 2 3 4 v".split()
)
VOCABULARY = tuple(sorted({w for _, wording, _ in TEMPLATES for w in wording.split()} - COMMON))
#: Share of a template's indexed words that must stand at one distance, in per cent.
MIN_PERCENT = 60
#: Words by which a word may stand beside its place.
DRIFT = 2


def lookups(words: int) -> int:
    """How many of a template's words are looked up: a file may lack all others but one."""
    return words - -(-words * MIN_PERCENT // 100) + 1


def index(spark: SparkSession) -> DataFrame:
    """(word, template, place, label, n_words, n_lookups): one row per indexed place; fixed and small."""
    rows = []
    for k, (label, wording, _) in enumerate(TEMPLATES):
        placed = [(w, i) for i, w in enumerate(wording.split()) if w not in COMMON]
        n = len({x for x, _ in placed})
        rows += [(w, k, i, label, n, lookups(n)) for w, i in placed]
    return spark.createDataFrame(rows, "word string, template int, place int, label string, n_words int, n_lookups int")


def has_phrase(joined: Column, phrase: str) -> Column:
    return F.concat(F.lit(" "), joined, F.lit(" ")).contains(f" {phrase} ")


def places(w: Column, phrase: str) -> Column:
    """Starts of the phrase in the array of words."""
    parts = phrase.split()
    here = lambda i: F.get(w, i) == F.lit(parts[0])

    def all_there(i: Column) -> Column:
        found = here(i)
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(w, i + k) == F.lit(part))
        return found

    return F.when(
        F.size(w) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), all_there)
    ).otherwise(F.array().cast("array<int>"))


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, hits, joined): licence words of every file; the words in a row,
    joined by blanks, of files with at least two different ones.  Each phrase holds two."""
    t = whole(text)
    split = lambda x: F.array_remove(F.split(x, GAP), "")
    exact = F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    rough = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id).alias("doc_id"),
        # lower() finds at least what A-Z alone would; the words of hits are then made exactly.
        let(
            split(F.lower(t)),
            lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.array_intersect(w, vocabulary).alias("hits")),
        ).alias("found"),
        t.alias("body"),
    )
    exact = F.array_join(split(F.translate("body", string.ascii_uppercase, string.ascii_lowercase)), " ")
    return rough.select(
        "row", "doc_id", "found.n_words", "found.hits", F.when(F.size("found.hits") >= 2, exact).alias("joined")
    )


def base_places(scan: DataFrame) -> DataFrame:
    """(row, n_base, first_word, last_word, base): of files with a phrase."""
    any_phrase = F.lit(False)
    for phrase in BASE:
        any_phrase = any_phrase | has_phrase(F.col("joined"), phrase)
    w = F.split("joined", " ")
    found = let(w, lambda x: F.array(*[F.struct(F.lit(b).alias("label"), places(x, p).alias("at")) for p, b in BASE.items()]))
    listed = scan.filter("joined IS NOT NULL").filter(any_phrase).select("row", found.alias("found"))
    at = F.flatten(F.transform("found", lambda x: x["at"]))
    return listed.select(
        "row",
        F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        F.transform(F.filter("found", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("base"),
    )


def aligned(scan: DataFrame) -> DataFrame:
    """(row, label, share): templates with enough words at one distance and all their phrases.

    The index and the ranking hold the templates' words only; both are broadcast.
    """
    files = scan.filter("joined IS NOT NULL")
    held = let(
        F.split("joined", " "),
        lambda w: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda x: F.array_contains(F.col("hits"), x["word"])),
    )
    hits = files.select("row", F.explode(held).alias("x")).select("row", "x.word", "x.at")
    places = index(scan.sparkSession)
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("files", F.lit(0)), "word"))
    each = hits.groupBy("row").agg(F.collect_set("word").alias("own")).filter(F.size("own") >= 2)
    frequency = each.select(F.explode("own").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))
    words = places.select("template", "word", "n_lookups").distinct().join(frequency, "word", "left")
    rare = words.withColumn("rank", rank).filter("rank <= n_lookups").select("template", "word")
    distance = F.col("at") - F.col("place")
    candidates = (
        hits.join(F.broadcast(places.join(rare, ["template", "word"])), "word")
        .select("row", "template", distance.alias("distance"))
        .distinct()
    )
    beside = F.explode(F.sequence(distance - DRIFT, distance + DRIFT)).alias("distance")
    aligned_words = (
        hits.join(F.broadcast(places), "word")
        .select("row", "template", "label", "n_words", "word", beside)
        .join(candidates, ["row", "template", "distance"], "left_semi")
    )
    offsets = (
        aligned_words.groupBy("row", "template", "label", "n_words", "distance")
        .agg(F.count_distinct("word").alias("agree"))
        .groupBy("row", "template", "label", "n_words")
        .agg(F.max("agree").alias("agree"))
        .filter(F.col("agree") * 100 >= F.col("n_words") * MIN_PERCENT)
    )
    verified = F.lit(False)
    for k, (_, _, phrases) in enumerate(TEMPLATES):
        held_all = F.col("template") == k
        for phrase in phrases:
            held_all = held_all & has_phrase(F.col("joined"), phrase)
        verified = verified | held_all
    return (
        offsets.join(files.select("row", "joined"), "row")
        .filter(verified)
        .groupBy("row", "label")
        .agg(F.max(F.col("agree") / F.col("n_words")).alias("share"))
    )


def licences(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per file: words, base places and labels, all labels, score of the best label.

    The score is the best alignment's share of its template's indexed words; 1 for a base place.
    """
    scan = stored(scanned(docs, id, text), "licence-words")
    method = aligned(scan).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base = base_places(scan)
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base", none)
    together = F.array_distinct(F.concat(base_labels, F.coalesce("found", none)))
    return (
        scan.select("row", "doc_id", "n_words")
        .join(stored(base, "licence-base"), "row", "left")
        .join(stored(method, "licence-found"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
            F.array_join(F.array_sort(together), ",").alias("labels"),
            F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )

"""One query per operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bytebpe,
    collocations,
    licences,
    mixing,
    neardup,
    novelty,
    packing,
    quality,
    substrings,
    tokencounts,
    topk,
    warc,
    whitening,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bit_sliced_topk(spark: SparkSession, directory: str) -> DataFrame:
    return topk.top_k(table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLES["op1_bit_sliced_topk"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op3_warc_boundaries(spark: SparkSession, directory: str) -> DataFrame:
    return warc.archive(table(spark, directory, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op3_warc_boundaries"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, h,
        max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         CAST(((CAST(concat('0x', substr(h, 1 + 5 * (i // 4), 5)) AS BIGINT)) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN NULL ELSE response END AS refers_to
FROM d
"""


@query
def op2_pareto_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(table(spark, directory, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLES["op2_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST(concat('0x', substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT)
               AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM s0),
s2 AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER (ORDER BY source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
         coalesce(sum(w) OVER (ORDER BY source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
       FROM s2),
s4 AS (SELECT *, cap * (ws - wb) <= w * (total - cb) AS filled FROM s3),
s5 AS (SELECT *, total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER () AS rest,
         sum(CASE WHEN filled THEN 0 ELSE w END) OVER () AS sharing FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE)
         ELSE CAST(rest * w AS DOUBLE) / CAST(sharing AS DOUBLE) END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS each FROM s6),
s8 AS (SELECT *, floor(each) AS copies, each - floor(each) AS p, target - floor(each) * source_size AS wanted FROM s7),
r AS (SELECT d.*, s8.* EXCLUDE (source), CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
      FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source),
c AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM r)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN p > 0 AND upto - wanted < wanted - upto + size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query
def op4_licence_scan(spark: SparkSession, directory: str) -> DataFrame:
    return licences.licences(table(spark, directory, "documents"))


@query
def op5_bbit_minhash(spark: SparkSession, directory: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, directory, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op5_bbit_minhash"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM t)
  UNION SELECT doc_id, ws[1] FROM t WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.least AS component_id, t.doc_id = c.least AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c USING (doc_id)
"""


@query
def op6_compact_windows(spark: SparkSession, directory: str) -> DataFrame:
    return substrings.repeated(table(spark, directory, "documents"))


@query
def op7_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    counts = tokencounts.token_counts(
        table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: The id after the last of the vocabulary fills packed rows.
PAD = 50256


@query
def op8_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bytebpe.round_trip(
        table(spark, directory, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    )


@query
def op10_packed_ids(spark: SparkSession, directory: str) -> DataFrame:
    tokens = packing.token_ids(
        table(spark, directory, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    )
    return packing.packed(tokens, PAD)


def _licence_sql() -> str:
    """Base and method as SQL; templates, phrases and labels are the fixed values of ``licences``."""
    places = ", ".join(
        f"('{w}', {k}, {i}, '{label}')"
        for k, (label, wording, _) in enumerate(licences.TEMPLATES)
        for i, w in enumerate(wording.split())
        if w not in licences.COMMON
    )
    phrases = ", ".join(f"({k}, '{p}')" for k, (_, _, own) in enumerate(licences.TEMPLATES) for p in own)
    base = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in licences.BASE.items())
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
place(word, template, spot, label) AS (VALUES {places}),
size AS (SELECT template, any_value(label) AS label, count(DISTINCT word) AS n FROM place GROUP BY template),
phrase(template, words) AS (VALUES {phrases}),
base(words, label) AS (VALUES {base}),
w AS (SELECT r, i, ws[i + 1] AS word, ws FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM t)),
hit AS (SELECT DISTINCT r, word FROM w WHERE word IN (SELECT word FROM place)),
file AS (SELECT r FROM hit GROUP BY r HAVING count(*) >= 2),
often AS (SELECT word, count(*) AS c FROM hit JOIN file USING (r) GROUP BY word),
ranked AS (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(c, 0), word) AS k,
    count(*) OVER (PARTITION BY template) AS n
  FROM (SELECT DISTINCT template, word FROM place) LEFT JOIN often USING (word)),
rare AS (SELECT template, word FROM ranked WHERE k <= n - (n * {licences.MIN_PERCENT} + 99) // 100 + 1),
seen AS (SELECT r, template, w.i - spot AS distance, word FROM file JOIN w USING (r) JOIN place USING (word)),
candidate AS (SELECT DISTINCT r, template, distance FROM seen JOIN rare USING (template, word)),
held AS (SELECT r, template, c.distance, count(DISTINCT word) AS agree FROM candidate c JOIN seen s USING (r, template)
  WHERE abs(s.distance - c.distance) <= {licences.DRIFT} GROUP BY 1, 2, 3),
good AS (SELECT r, template, label, n, max(agree) AS agree FROM held JOIN size USING (template)
  GROUP BY ALL HAVING max(agree) * 100 >= n * {licences.MIN_PERCENT}),
sound AS (SELECT * FROM good JOIN t USING (r) WHERE NOT EXISTS (
    SELECT 1 FROM phrase p WHERE p.template = good.template
      AND NOT contains(' ' || array_to_string(t.ws, ' ') || ' ', ' ' || p.words || ' '))),
method AS (SELECT r, list(DISTINCT label) AS labels, max(CAST(agree AS DOUBLE) / n) AS share FROM sound GROUP BY r),
found AS (SELECT r, i, label FROM w JOIN base ON w.word = base.words[1] AND w.ws[i + 1 : i + len(base.words)] = base.words),
own AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(own.n, 0) AS BIGINT) AS n_base,
       CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(own.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own.labels, []), coalesce(method.labels, [])))), ',') AS labels,
       CASE WHEN own.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM t LEFT JOIN own USING (r) LEFT JOIN method USING (r)
"""


ORACLES["op4_licence_scan"] = _licence_sql()


@query
def op9_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return quality.verdicts(table(spark, directory, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.col("lost").cast("bigint").alias("n_shared_words"),
    )


ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM tri JOIN (SELECT doc_id, t FROM tri GROUP BY ALL HAVING count(*) > 1) USING (doc_id, t)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, pos, line,
         lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
freq AS (SELECT source, norm, min(doc_id) AS owner FROM ln GROUP BY source, norm HAVING count(DISTINCT text) > 20),
lost AS (SELECT ln.doc_id, CAST(sum(n) AS BIGINT) AS n FROM ln JOIN freq
         ON ln.source IS NOT DISTINCT FROM freq.source AND ln.norm = freq.norm AND ln.doc_id <> owner GROUP BY ln.doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(lost.n, 0) AS BIGINT) AS n_shared_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_shared_words) >= 50 * n_words AS kept
FROM m
"""


@query
def op11_secret_novelty(spark: SparkSession, directory: str) -> DataFrame:
    return novelty.report(table(spark, directory, "documents"))


@query
def op12_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations.collocations(table(spark, directory, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, ws[i : i + k - 1] AS phrase, count(*) AS f
      FROM places, (VALUES (1), (2), (3), (4)) AS o(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, c.k, a, unnest(range(1, c.k)) AS head FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, cut.head, x.f AS l, y.f AS r,
        CAST((2000000 * CAST(cut.a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.phrase[1 : cut.head]
      JOIN f y ON y.lang = cut.lang AND y.phrase = cut.phrase[cut.head + 1 : cut.k]),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1),
inside AS (SELECT lang, phrase[i : i + n - 1] AS phrase, max(a) AS longest
  FROM (SELECT lang, phrase, k, a, unnest(range(1, k)) AS i FROM c WHERE k > 2), (VALUES (2), (3)) AS o(n)
  WHERE n < k AND i + n - 1 <= k GROUP BY ALL),
left_over AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase)
  WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op13_polar_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whitening.whitened(table(spark, directory, "embeddings"))

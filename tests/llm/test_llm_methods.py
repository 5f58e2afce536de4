"""Operators against brute force and round trips on small data."""

import base64
import hashlib
import itertools
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from crosstally.llm import bytebpe, common, licences, mixing, neardup, packing, quality, substrings, tokencounts, topk, warc
from crosstally.llm.common import table
from verification import check

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def library():
    lines = (x.split() for x in open(RANKS, "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n.startswith("op")))
def test_query_agrees_with_sql(spark, name):
    assert check.compare(spark, SF, name) is None


def test_every_operator_is_registered():
    numbers = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in contract.queries()


# -- 1: top-k ------------------------------------------------------------------------------------


def test_top_k_over_several_blocks_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.2, 0.9]) for _ in range(5)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 400)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk.quantised(df)
    index = topk.build_index(q, block=100).cache()
    got = topk.search(index, q.filter("vec_id % 7 = 0"), 10, unit=16).collect()
    v = {i: [int(np.floor(64 * float(np.float32(x)))) for x in e] for i, e in rows}
    want = set()
    for i in v:
        if i % 7 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=True)), j) for j in v if j != i)[:10]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)}
    assert {tuple(r) for r in got} == want


def test_top_k_leaves_out_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [3.0, 1.0]),
        (None, [1.0, 1.0]), (6, [1e9, 1.0]), (7, [2.0]), (7, [2.0]), (8, []), (9, [1e15, 1.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    want = [(1, 6, 64 * 64 * (10**9 + 2)), (2, 5, 64 * 64 * 5), (3, 7, 64 * 64 * 2), (4, 7, 64 * 64 * 2), (5, 8, 0)]
    assert [(r["rank"], r.vec_id, r.score) for r in got] == want
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 20).count() == 0


def test_top_k_takes_every_row_of_an_id_and_large_values(spark):
    rows = [(20, [1.0, -3.0]), (20, [2.0, 1.0]), (1, [2e6, 0.0]), (2, [3.0, 0.0]), (2, [5.0, 0.5]), (3, [-1e12, 1e13]), (40, [1e13, 1e13])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 4).collect()
    v = [(i, [int(64 * x // 1) for x in e]) for i, e in rows]
    want = []
    for k, (i, q) in enumerate(v):
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for m, (j, e) in enumerate(v) if m != k)[:4]
            want += [(i, r, j, -s if abs(s) < 2**63 else None) for r, (s, j) in enumerate(found, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(w[3] is None for w in want)


# -- 2: mixing -----------------------------------------------------------------------------------


def test_targets_are_refilled_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 200, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = ["a", "b", "c", "d", None]
    weight, target, left = dict(zip(order, (5, 2, 1, 5, 2), strict=True)), {}, sum(sizes.values())
    while True:  # by rounds, as the definition says
        open_ = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not above:
            break
        for s in above:
            target[s] = 3 * sizes[s]
            left -= target[s]
    assert got == pytest.approx(target | share)


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert all(r.taken in {k * r.size for k in range(4)} for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
    assert sorted(rows) == sorted(mixing.mix(table(spark, "/root/testdata/sf0.01", "documents")).collect())


# -- 3: WARC -------------------------------------------------------------------------------------


def test_archives_with_magic_in_payloads(spark):
    fake = (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Type: application/http\r\n"
        "Content-Length: 45\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    )
    rng = random.Random(3)
    rows = []
    for i in range(120):
        t = "".join(rng.choice("abc é\r\n") for _ in range(rng.randrange(200)))
        kinds = [t, t + fake * 2, "WARC/1.1\r\n" + t, t + "WARC/1.1\r\n", t + "WARC/1.1", fake, None, "", "same", "same"]
        rows.append((i, f"http://x/{i}\r\n", "x" * 20_000 + fake + t if i % 40 == 0 else kinds[i % len(kinds)]))
    rows += [(None, None, "same"), (5, None, "same"), (119, None, "same"), (119, "u", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits within records
    try:
        out = warc.archive(df.repartition(3))
        got = [tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = None if best[h or ""] == i else best[h or ""]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), sha, "response" if to is None else "revisit", to))
    assert Counter(got) == Counter(want)
    assert warc.archive(df.limit(0)).count() == 0


def test_ids_of_nineteen_digits_come_back(spark):
    ids = [10**18 + 5, 2**63 - 1, -(2**63), -1, 7]
    pages = spark.createDataFrame([(i, "u", f"<p>{k // 2}") for k, i in enumerate(ids)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive(pages).collect()}
    assert got == {10**18 + 5: 2**63 - 1, 2**63 - 1: None, -(2**63): -1, -1: None, 7: None}


# -- 4: licences ---------------------------------------------------------------------------------


def test_licence_places_and_labels(spark):
    rows = [
        (1, "Used UNDER the  M.I.T license"),
        (2, "x under the MIT license, under\nthe mit-license; Apache License, Version 2.0"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "the license of apache is a version of the mit"),
        (6, None),
        (7, ""),
        (8, "Under the MİT license and K"),  # letters that only lower() would change
        (2, "x under the MIT license, under\nthe mit-license; Apache License, Version 2.0"),
        (9, "word " * 50_000 + "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files the software to deal in the software without restriction"),
        (None, "cc by nc"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licences.licences(df).collect())
    assert got[(2, 14, 3, 1, 9, "apache-2,mit", "apache-2,mit")] == 2
    want = {
        (1, 7, 0, None, None, "", ""), (3, 7, 1, 2, 2, "cc-by-nc", "cc-by-nc"), (4, 12, 0, None, None, "", "gpl-3"),
        (5, 10, 0, None, None, "", ""), (6, 0, 0, None, None, "", ""), (7, 0, 0, None, None, "", ""),
        (8, 6, 0, None, None, "", ""), (9, len(rows[9][1].split()), 0, None, None, "", "mit"), (None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc"),
    }
    assert {x for x in got if x[0] != 2} == want
    assert licences.licences(df.limit(0)).count() == 0


def test_licences_among_many_rarer_words(spark):
    """The label's words are the commonest ones of a file that uses most of the vocabulary."""
    gpl = "licensed under the gnu general public license version 3"
    rare = [w for w in licences.VOCABULARY if w not in gpl.split()]
    assert len(rare) > 12
    rows = [(0, f"{gpl} x {' x '.join(rare)}"), (1, gpl), *((i, "version of gnu license licensed") for i in range(2, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.licences(df).collect()}
    assert got[0] == got[1] == ("gpl-3", 1.0) and got[2] == ("", 0.0)


def licence_fixture():
    """Whole texts, notices, words dropped, added and moved, two licences in a file, prose."""
    rng, rows = random.Random(9), []
    vocabulary = [w for _, text, _ in licences.TEMPLATES for w in text.split()]
    for label, text, _ in licences.TEMPLATES:
        w = text.split()
        for drop, add in ((0, 0), (0, 0.05), (0.1, 0), (0.3, 0.1), (0.6, 0), (0, 0.3)):
            mixed = [x for x in w if rng.random() >= drop]
            mixed = [y for x in mixed for y in ([rng.choice(vocabulary), x] if rng.random() < add else [x])]
            rows.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + mixed))
        rows.append(f"{text} {rng.choice(licences.TEMPLATES)[1]} {text}")
    rows += [" ".join(rng.choices(vocabulary, k=200)) for _ in range(20)] + ["", "gnu", "License. Licensed\tGNU!"]
    return rows


def licence_labels(texts):
    """Labels of the method by the rule as written, over all places of all words."""
    placed = []
    for label, text, phrases in licences.TEMPLATES:
        placed.append((label, [(w, i) for i, w in enumerate(text.split()) if w not in licences.COMMON], phrases))
    files = [t.lower().replace(".", " ").replace("!", " ").split() for t in texts]
    own = [set(w) & set(licences.VOCABULARY) for w in files]
    often = Counter(x for o in own if len(o) >= 2 for x in o)
    out = []
    for w, o in zip(files, own, strict=True):
        found = set()
        for label, spots, phrases in placed if len(o) >= 2 else ():
            ranked = sorted({x for x, _ in spots}, key=lambda x: (often[x], x))
            n = len(ranked)
            seen = [(i - k, x) for i, y in enumerate(w) for x, k in spots if x == y]
            starts = {d for d, x in seen if x in ranked[: licences.lookups(n)]}
            agree = max((len({x for e, x in seen if abs(e - d) <= licences.DRIFT}) for d in starts), default=0)
            if agree * 100 >= 60 * n and all(f" {p} " in f" {' '.join(w)} " for p in phrases):
                found.add(label)
        out.append(",".join(sorted(found)))
    return out


def test_licence_labels_by_brute_force_and_sql(spark, tmp_path):
    import duckdb

    texts = licence_fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.licences(df)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    rows = con.execute(contract.oracle_sql()["op4_licence_scan"])
    names = [d[0] for d in rows.description]
    assert sorted(map(repr, rows.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
    base = [{b for p, b in licences.BASE.items() if f" {p} " in f" {t.lower()} "} for t in texts]
    want = licence_labels(texts)
    labels = {r.doc_id: r.labels for r in got.collect()}
    for i, (b, m) in enumerate(zip(base, want, strict=True)):
        assert labels[i] == ",".join(sorted(b | set(m.split(",")) - {""}))
    assert sum(m != "" for m in want) > 40


def test_one_word_more_does_not_cost_the_label(spark):
    grant = licences.TEMPLATES[1][1]
    texts = [grant.replace("any person", "any other person"), grant.replace("copy of this", "copy this"), grant]
    got = licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got)] == ["mit"] * 3
    # Words so rarely asked for that all others may be missing; one of them is always looked up.
    assert all(n - licences.lookups(n) < n * licences.MIN_PERCENT / 100 for n in range(1, 300))


def test_licence_base_by_brute_force(spark, texts):
    import re

    for r in licences.licences(table(spark, SF, "documents")).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, b) for p, b in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({b for _, b in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


# -- 5: near-duplicate documents -----------------------------------------------------------------


def groups(texts: dict, size: int, percent: int = 80) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_by_brute_force(spark, texts, size):
    want, sets = groups(texts, size)
    got = neardup.near_duplicates(table(spark, SF, "documents"), size).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_groups_that_share_buckets(spark):
    """Chains of near copies whose smallest member is not near to all, and passages in common."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for k in range(25):
            for _ in range(2):  # drifts, so that far members are no links
                base[rng.randrange(60)] = rng.choice(vocabulary)
            texts[rng.randrange(10**6) * 1000 + g * 30 + k] = " ".join(base)
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for k in range(60):
        texts[5_000_000_000 + k] = shared + " " + " ".join(rng.choice(vocabulary) for _ in range(15 + k % 5))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()}
    assert got == groups(texts, 2)[0]


def test_estimate_is_corrected_for_chance(spark):
    rng = random.Random(8)
    for share in (0.0, 0.5, 0.8):
        common = [f"c{i}" for i in range(int(2000 * share))]
        sets = [[*common, *(f"{side}{i}" for i in range((2000 - len(common)) // 2))] for side in "ab"]
        packed = []
        for s in sets:
            h = np.array([rng.getrandbits(0) or int.from_bytes(hashlib.sha1(x.encode()).digest()[:8]) for x in s], np.uint64)
            packed.append(neardup.signature(h)[0].tolist())
        df = spark.createDataFrame([tuple(packed)], "a array<bigint>, b array<bigint>")
        real = len(common) / (len(common) + 2 * ((2000 - len(common)) // 2))
        assert df.select(neardup.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(real, abs=0.15)


# -- 6: near-duplicate passages ------------------------------------------------------------------


def test_compact_windows_by_definition():
    rng = np.random.default_rng(2)
    for n in (0, 3, 10, 60):
        values = rng.integers(0, 2**63, n, np.uint64)
        if n > 10:
            values[20] = values[30] = values[:].min()  # equal values: the first counts as smaller
        for least in (1, 4, 10):
            want = set()
            for c in range(n):
                left = right = c
                while left > 0 and values[left - 1] > values[c]:
                    left -= 1
                while right + 1 < n and values[right + 1] >= values[c]:
                    right += 1
                if right - left + 1 >= least:
                    want.add((c, left, right))
            assert set(substrings.compact_windows(values, least)) == want


def test_windows_of_texts_that_stand_one_after_another():
    """Several texts at once have the windows that each has alone, and none reaches over a border."""
    rng = np.random.default_rng(5)
    sizes = np.array([0, 60, 3, 46, 0, 200, 45])
    values = rng.integers(0, 2**63, sizes.sum(), np.uint64)
    values[70] = values[100] = 0
    want, begin = set(), 0
    for i, n in enumerate(sizes.tolist()):
        for place, left, right in substrings.compact_windows(values[begin : begin + n], 46):
            want.add((i, begin + place, begin + left, begin + right))
        begin += n
    got = substrings.stacked_windows(values, sizes, 46)
    assert {tuple(x) for x in got.tolist()} == want and {x[0] for x in want} == {1, 3, 5}


def test_shingle_numbers_are_equal_for_equal_shingles_only():
    rng = np.random.default_rng(6)
    for n in (2, 3, 10**6):  # of many words the numbers are packed in several steps
        words_ = rng.integers(0, min(n, 4), 400) * (n // min(n, 4))
        got, most = substrings.shingle_numbers(words_, n)
        want = [tuple(words_[k : k + 5].tolist()) for k in range(396)]
        assert most == len(set(want)) == len(set(got.tolist())) == len(set(zip(got.tolist(), want, strict=True)))


def test_shuffle_files_go_when_a_table_is_stored(spark, tmp_path):
    """What earlier steps shuffled would count as disk until the driver collects its garbage."""
    blocks = Path(spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].toString())
    held = lambda: {x for x in blocks.rglob("shuffle_*.data")}
    before = held()
    rows = common.stored(spark.range(100_000).repartition("id"), "shuffled")
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.2)
    assert not left and rows.count() == 100_000
    assert spark.conf.get(common.CLEANUP, None) is None


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    prose = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    exact, near = prose(55), prose(80)
    changed = [*near[:20], "other", *near[21:50], "inserted", *near[50:]]
    texts = {
        1: [*prose(100), *exact, *prose(200)], 2: [*prose(10), *exact], 3: exact, 4: [*prose(300), *near, *prose(20)],
        5: [*changed, *prose(90)], 6: prose(500), 7: prose(60), 8: [*prose(40), *exact[:40], *prose(40)], 9: [], 10: prose(49),
    }
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    rows += [(11, rows[5][1]), (12, rows[9][1]), (13, None), (14, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in substrings.repeated(df).collect():
        got[r.doc_id].append(r)
    assert set(got) == {1, 2, 3, 4, 5, 6, 11}
    assert {(r.start_word, r.end_word) for r in got[1]} == {(100, 155)} and {(r.start_word, r.end_word) for r in got[2]} == {(10, 65)}
    # As a whole the two are less alike than 0.8; their first 50 words are not.
    assert [(r.start_word, r.end_word, r.partner_id) for r in got[4]] == [(300, 350, 5)]
    assert [(r.start_word, r.end_word, r.partner_id) for r in got[11]] == [(0, 500, 6)]
    left = {r.doc_id: (r.text or "").split() for r in substrings.cut(df, chars=None).collect()}
    holders = [i for i, w in left.items() if " ".join(exact) in " ".join(w)]
    assert len(holders) == 1 and 11 not in left and left[6] == texts[6] and left[13] == [] and left[8] == texts[8]
    assert {len(w) for i, w in left.items() if i in (1, 2, 3)} <= {355, 300, 65, 10, 55}


def test_passages_of_chains_and_common_phrases_are_found(spark):
    """Variants of which the first text is like none, and repeats made of phrases many texts have."""
    rng = random.Random(6)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts, planted, phrases = {}, {}, [prose(5) for _ in range(40)]
    add = lambda w: (texts.setdefault(i := len(texts), [*(x := prose(30)), *w, *prose(30)]), planted.setdefault(i, w))
    for _ in range(40):
        base = prose(52)
        for edits in ((17, 34), (), (26,)):  # the first is unlike the two others
            add([f"e{rng.randrange(10**6)}" if k in edits else x for k, x in enumerate(base)])
    for _ in range(20):
        some = [x for p in rng.sample(phrases, 12) for x in p]
        add(some)
        add(some)
    for p in phrases:
        for _ in range(12):
            add([*p, *prose(40)])
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in planted.items()}
    want = defaultdict(set)
    for i in sets:
        for j in sets:
            if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want[i].add(j)
    assert len(want) == 120
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = defaultdict(set)
    for r in substrings.repeated(df).collect():
        w = [texts[i] for i in (r.doc_id, r.partner_id)]
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8 and r.end_word <= len(w[0])
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    for i in want:
        assert len(got[i] & set(range(30, 30 + len(planted[i])))) >= 50, i
    assert set(got) == set(want)


def test_windows_are_only_built_where_enough_shingles_stand_in_two_places(spark):
    """A line that all texts have is no passage, so it leads to no comparison; what two texts share does."""
    rng = random.Random(9)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line, passage = prose(13), prose(60)
    texts = [[*prose(50), *line, *prose(50)] for _ in range(300)]
    texts += [[*prose(70), *passage, *prose(9)], [*passage[:30], "other", *passage[31:]]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "text_key long, text string")
    for many in (1, 40 * substrings.BUCKET):  # one bucket or many, and rows that are repeated
        got = {r.text_key: [tuple(x) for x in r.stretches] for r in substrings.stretches(df.repartition(3, "text_key"), many).collect()}
        assert set(got) == {300, 301} and got[301] == [(0, 55)]
        assert len(got[300]) == 1 and 60 <= got[300][0][0] <= 70 and 125 <= got[300][0][1] <= 136
    twice = substrings.stretches(df.union(df), 2).collect()
    assert len(twice) == len(texts)  # all is found again, nothing is lost


def test_dense_stretches_by_definition():
    rng = np.random.default_rng(7)
    for n, share in itertools.product((0, 3, 10, 40, 90), (0.6, 0.8, 0.9)):
        known, want = rng.random(n) < share, set()
        for s in range(n):
            for e in range(s + 10, n + 1):
                if known[s] and known[e - 1] and 100 * known[s:e].sum() >= 80 * (e - s):
                    want |= set(range(s, e))
        assert {i for x, y in substrings.dense(known, 10) for i in range(x, y + 1)} == want


def test_windows_side_by_side_lose_no_passage():
    rng, found = np.random.default_rng(8), 0
    for _ in range(400):
        base = np.arange(100)
        sides = []
        for _ in range(2):
            w = base.copy()
            w[rng.choice(100, rng.integers(0, 4), replace=False)] = rng.integers(1000, 10**6, 1)
            sides.append(np.delete(w, rng.choice(100, rng.integers(0, 2), replace=False)))
        number, n = substrings.shingle_numbers(np.concatenate(sides), 10**6)
        a, b = number[: len(sides[0]) - 4], number[len(sides[0]) :]
        if not len(both := np.intersect1d(a, b)) or len(set(a.tolist())) < len(a) or len(set(b.tolist())) < len(b):
            continue
        shingle = rng.choice(both)
        at_a, at_b = int(np.flatnonzero(a == shingle)[0]), int(np.flatnonzero(b == shingle)[0])
        where = np.full(n, -1)
        where[a] = np.arange(len(a))
        if list(substrings.alike_parts(a, b, np.zeros(n, bool), at_a, at_b)):
            found += 1
            assert substrings._lined_up(where[b][None, :], np.array([at_b]), 46).all()
    assert found > 100


def test_near_copies_are_not_compared_pair_by_pair():
    """Windows that a smaller text explains give one passage each, not one for each pair."""
    rng = random.Random(10)
    base, unit = [f"v{i}" for i in range(120)], []
    for key in range(60):
        w = [f"e{rng.randrange(10**6)}" if abs(k - 60) > 30 and rng.random() < 0.05 else x for k, x in enumerate(base)]
        unit.append((0, 0, 0, key, 60, 0, False, False, " ".join(w)))
    got = list(substrings.explained(unit))
    assert {x[1] for x in got} == set(range(1, 60)) and len(got) < 120


# -- 7, 8, 10: tokens ----------------------------------------------------------------------------

ODD = [
    None, "", " ", "\n\t\x0b", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "ΣΊΣΥΦΟΣ İstanbul K", "é ́a",
    "don't I'LL 123,456 ½", " nb sp em\x1cfs\x85nel", "日本語テキスト🙂👍🏽", "a" * 30_000, "x " * 5_000, "\x00\x7f",
]


def test_token_counts_by_the_library(spark, texts):
    t = Tokenizer.from_file(WORDS)
    rows = [(i, x, "clash", 1) for i, x in enumerate([*ODD, *texts.values()])] + [(3, "twice here", "", 0)] * 2 + [(None, "a b", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, pieces int")
    for limit in (tokencounts.FREQUENT, 50):  # also with most words outside of the broadcast table
        got = Counter(tuple(r) for r in tokencounts.token_counts(df, WORDS, limit=limit).collect())
        count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
        assert got == Counter((i, len((x or "").encode()), count(x)) for i, x, *_ in rows)
    assert tokencounts.token_counts(df.limit(0), WORDS).count() == 0


def test_byte_bpe_by_the_library(spark, texts, library):
    rows = [(i, x, b"clash") for i, x in enumerate([*ODD, *texts.values()])] + [(None, "again", b"")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    got = Counter(tuple(r) for r in bytebpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, x, _ in rows:
        ids = library.encode_ordinary(x or "")
        raw = np.array(ids, "<u4").tobytes()
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    assert got == want
    assert bytebpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_beginnings_of_several_lengths_are_kept(library):
    """A short piece too starts from what an earlier one with the same first bytes has left."""
    own = bytebpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abcdeéß語") for _ in range(rng.randrange(1, 24))) for _ in range(3000)]
    pieces += [x[:k] + y for x, y in zip(pieces, pieces[1:], strict=False) for k in (4, 7)]
    for x in pieces:
        raw = x.encode()
        assert own.prefixes(raw).last == bytebpe.Prefixes(own.vocabulary, raw).last
        assert np.frombuffer(own.encode(x), "<u4").tolist() == library.encode(x, disallowed_special=())
        for n in bytebpe.HEADS:
            if n < len(raw):
                assert own._heads.get(raw[:n]) == bytebpe.Prefixes(own.vocabulary, raw[:n]).last


def test_prefixes_append_and_edit(encoder):
    v, rng = encoder.vocabulary, random.Random(1)
    assert all(v.begins(i) for i in v.tokens)
    for _ in range(300):
        x = bytes(rng.choice(b"aeinrsth ABC\xc3\xa9\x00") for _ in range(rng.randrange(1, 40)))
        p = bytebpe.Prefixes(v, x)
        assert [v.tokens[i] for i in p.tokens()] == v.merged(x)
        y = bytes(rng.choice(b"aeinrsth") for _ in range(10))
        p.append(y)
        assert [v.tokens[i] for i in p.tokens()] == v.merged(x + y)
    for _ in range(20_000):
        a, b = rng.randrange(len(v.tokens)), rng.randrange(len(v.tokens))
        if rng.random() < 0.5:
            a, b = v.ranks[b"a" * rng.randrange(1, 3)], rng.choice([v.ranks[b"a"], v.ranks[b"aa"], b])
        both = [v.tokens[a], v.tokens[b]]
        assert v._apart(a, b) == (v.merged(both[0] + both[1]) == both)
    x = bytes(rng.choice(b"aeinrsth") for _ in range(2000))
    for _ in range(50):
        p, a = bytebpe.Prefixes(v, x), rng.randrange(2000)
        b, new = min(2000, a + rng.randrange(9)), bytes(rng.choice(b"aeinrsth") for _ in range(rng.randrange(6)))
        again = p.replace(a, b, new)
        edited = x[:a] + new + x[b:]
        assert p.piece == edited and p.last == bytebpe.Prefixes(v, edited).last
        assert again <= 2 * v.longest + 20  # near the edit only


def test_best_fit_by_brute_force():
    rng = random.Random(7)
    for _ in range(30):
        length = rng.choice([7, 16, 50])
        lengths = [rng.randrange(1, length + 1) for _ in range(rng.randrange(60))]
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            if fits:
                least = min(r for r, _ in fits)
                room[next(k for r, k in fits if r == least)] -= lengths[i]
            else:
                room.append(length - lengths[i])
        got = packing.best_fit(lengths, length)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        assert sorted(length - sum(lengths[i] for i in row) for row in got) == sorted(room)


def test_packed_rows_hold_every_token(spark, texts, library):
    rows = list(enumerate([*ODD, *texts.values()]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = packing.token_ids(df, RANKS, public_tokenizers.PATTERN)
    got = packing.packed(tokens, 50256, length=256, shard_tokens=20_000).collect()
    parts = defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        assert r.position_resets == [x for x in r.cu_seqlens if x < 256]
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            parts[doc][start] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for i, x in rows:
        assert [t for s in sorted(parts[i]) for t in parts[i][s]] == library.encode_ordinary(x or "")
    assert sum(r.n_tokens for r in got) / (256 * len(got)) > 0.95
    assert packing.packed(tokens.limit(0), 50256).count() == 0


# -- 9: quality ----------------------------------------------------------------------------------


def test_shared_lines_deplete_documents(spark):
    line = " ".join(f"nav{i}" for i in range(40))
    own = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    rows = [(i, f"{line}\n{own(i, 30)}", "h") for i in range(30)]  # more shared than own words
    rows += [(100 + i, f"  {line.upper()} \n{own(100 + i, 60)}", "h") for i in range(5)]
    rows += [(200 + i, f"{line}\n{own(200 + i, 30)}", None) for i in range(20)]  # at the limit in its host
    rows += [(300 + i, own(300, 80) + "\n" + own(301, 20), "h") for i in range(40)]  # copies of one text
    rows += [(400, None, "h"), (401, "", "h"), (0, rows[0][1], "h"), (402, "a b c " * 40, "x")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, source string, lost int, kept string")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert got[0].kept and not any(got[i].kept for i in range(1, 30))  # the owner keeps the line
    assert all(got[i].kept for x in (100, 200, 300) for i in range(x, x + 5))
    assert not got[400].kept and not got[401].kept and got[402].base_failed and got[402].n_repeat_words == 120
    kept = quality.clean(df)
    assert kept.columns == df.columns
    text = Counter((r.doc_id, r.text) for r in kept.collect())
    assert text[0, rows[0][1]] == 2 and text[100, own(100, 60)] == 1 and text[200, rows[35][1]] == 1
    assert quality.clean(df.limit(0)).count() == 0


# -- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, library):
    before, at = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF).cache()
        at[name] = before.collect(), out.collect()
        if name != "byte_tokens":
            assert out.columns == before.columns
        before = out
    docs, kept = at["quality_rules"]
    good = {r.doc_id for r in quality.verdicts(table(spark, SF, "documents")).filter("kept").collect()}
    assert {r.doc_id for r in kept} == good
    docs, kept = at["near_duplicates"]
    want = groups({r.doc_id: r.text for r in docs}, 5)[0]
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    docs, kept = at["repeated_passages"]
    where = defaultdict(set)
    for r in kept:
        w = r.text.lower().split()
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(r.doc_id)
    assert not [s for s in where.values() if len(s) > 1]
    docs, mixed = at["source_mix"]
    df = spark.createDataFrame(docs, table(spark, SF, "documents").schema)
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies})
    docs, tokens = at["byte_tokens"]
    sha = lambda x: hashlib.sha256(np.array(library.encode_ordinary(x), "<u4").tobytes()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in tokens) == Counter((r.doc_id, sha(r.text)) for r in docs)


def test_pipeline_over_odd_and_empty_documents(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, long, None, "s", len(long)), (2, long, None, "s", len(long))]
    rows += [(3, long + " more", "en", None, None), (None, "some words " * 20, "en", "s", 3), (4, None, "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, component_id string, size int"
    df = spark.createDataFrame([(*r, 7, "c", 1) for r in rows], schema)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).cache()
            if name != "byte_tokens":
                assert out.columns == df.columns
            docs = out
        assert docs.count() <= 3 * df.count()
    # Repeated rows and the near copy are one document.
    assert neardup.deduplicated(df.filter("doc_id IN (2, 3)")).select("doc_id").collect() == [(2,)]

"""Headers of CSV files are found without reading the files."""

import gzip
import io

import pytest

from crosstally.sources import headers
from crosstally.sources.files import empty_files, list_files, routed_paths
from crosstally.sources.tables import read_text_csv


@pytest.fixture
def folder(tmp_path):
    def make(**files):
        for name, text in files.items():
            (tmp_path / name.replace("__", " ").replace("_csv", ".csv")).write_text(text, newline="")
        return str(tmp_path)

    return make


class Counted(io.RawIOBase):
    """A stream that counts what is taken from it."""

    def __init__(self, data):
        self.data, self.taken = io.BytesIO(data), 0

    def readable(self):
        return True

    def readinto(self, into):
        got = self.data.read(len(into))
        into[: len(got)] = got
        self.taken += len(got)
        return len(got)


@pytest.mark.parametrize("body", [b"1,2\n" * 500_000, b"x" * 5_000_000])
def test_a_block_is_read_however_long_the_file(body):
    source = Counted(b'\xef\xbb\xbf\r\n"a\nb",c\r\n' + body)
    assert headers.read_header(source) == '"a\nb",c'
    assert source.taken <= headers.BLOCK


def test_a_long_header_is_read_whole():
    names = ",".join(f"column{i}" for i in range(10_000))
    source = Counted(names.encode() + b"\n" + b"0\n" * 100_000)
    assert headers.read_header(source) == names
    assert source.taken <= len(names) + 2 * headers.BLOCK


@pytest.mark.parametrize(
    "lines,record",
    [
        ([], None),
        (["", "\r", ""], None),
        (["﻿a,b\r", "1,2"], "a,b"),
        (['"a', "", 'b",c', "1,2"], '"a\n\nb",c'),
        (['a"b,c', "1,2"], 'a"b,c'),
        (['"a""', 'x",b', "1"], '"a""\nx",b'),
        (['a,"b', "1"], 'a,"b\n1'),
    ],
)
def test_first_record(lines, record):
    assert headers.first_record(iter(lines)) == record


def test_files_are_grouped_alike_whichever_way_they_are_opened(spark, folder, tmp_path, monkeypatch):
    path = folder(
        a__b_csv="x,y\n1,2\n", c_csv="x,y\n3,4\n", q_csv='"x\n1",y\n5,6\n', r_csv='"x\n2",y\n7,8\n', e_csv="", n_csv="\n\n"
    )
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"x,y\n9,10\n"))
    names = lambda: [sorted(f.rsplit("/", 1)[1] for f in g) for g in headers.files_by_header(spark, path)]
    want = [["q.csv"], ["r.csv"], ["a b.csv", "c.csv", "z.csv.gz"]]
    assert names() == want

    def unknown(spark, path):
        return headers.headers_by_lines(spark, path).selectExpr("file", "string(null) AS header", "false AS opened")

    monkeypatch.setattr(headers, "headers", unknown)
    assert [[f.replace("%20", " ") for f in g] for g in names()] == want


def test_files_whose_quoted_headers_go_on_differently_are_not_mixed(spark, folder):
    path = folder(q_csv='"x\n1",y\n5,6\n', r_csv='"x\n2",y\n7,8\n')
    rows = read_text_csv(spark, path)
    assert sorted(rows.columns) == ["x\n1", "x\n2", "y"] and rows.count() == 2


def test_a_store_that_is_not_known_is_not_opened(spark):
    with pytest.raises((OSError, ValueError)):
        headers.open_file("nowhere://host/a.csv")


def test_listing_has_empty_files_and_odd_names(spark, folder):
    path = folder(a__b_csv="x\n", **{"e%20_csv": "", "invoice_header_1_csv": "x\n", "note": ""})
    name = lambda df: sorted(r.file_name for r in df.collect())
    assert name(empty_files(spark, path)) == ["e%20.csv", "note"]
    assert name(list_files(spark, path, "*.csv")) == ["a b.csv", "e%20.csv", "invoice_header_1.csv"]
    assert {r: [p.rsplit("/", 1)[1] for p in ps] for r, ps in routed_paths(spark, path).items()} == {
        "invoice_header": ["invoice_header_1.csv"]
    }

"""Contract checks and the document catalogue."""

import json

import pytest

from crosstally.operators import doccatalog, quality
from crosstally.sources import files

HEADER = ("invoice_id STRING, account_id STRING, subtotal DECIMAL(18,2), discount_amount DECIMAL(18,2), "
          "tax_amount DECIMAL(18,2), total_amount DECIMAL(18,2)")


def found(df):
    return {r.subject: r.violations for r in df.collect()}


def test_nulls_and_duplicates(frame):
    df = frame([("1", "a"), ("1", None), ("2", "b"), ("2", "b"), ("3", "c")], "id STRING, v STRING")
    assert found(quality.required_nulls({"t": (df, ["id", "v"])})) == {"t.id": 0, "t.v": 1}
    assert found(quality.duplicate_keys({"t": (df, ["id"]), "u": (df, ["id", "v"])})) == {
        "t(id)": 2, "u(id, v)": 1,
    }
    assert found(quality.dimension_fanout({"t": (df, "v")})) == {"t(v)": 1}


def test_arithmetic(frame):
    header = frame([("1", "a", 100, 10, "7.43", "97.43"), ("2", "a", 100, 10, "7.43", "97.44"),
                    ("3", "zz", 5, 0, 0, 5)], HEADER)
    assert found(quality.total_arithmetic(header)) == {"invoice_header": 1}
    detail = frame([("1", "20", 2, "40.00"), ("1", "60", 1, "60.00"), ("2", "9", 2, "18.01"), ("9", "1", 1, "1")],
                   "invoice_id STRING, unit_price DECIMAL(18,2), quantity DECIMAL(18,4), line_amount DECIMAL(18,2)")
    assert found(quality.subtotal_vs_lines(header, detail)) == {
        "invoice_header.subtotal": 2, "invoice_header without lines": 1,
    }
    assert found(quality.line_arithmetic(detail)) == {"invoice_detail": 1}
    accounts = frame([("a",)], "account_id STRING")
    links = {"account": (header, "account_id", accounts, "account_id"),
             "invoice": (detail, "invoice_id", header, "invoice_id")}
    assert found(quality.orphans(links)) == {"account": 1, "invoice": 1}


def test_a_null_foreign_key_is_no_orphan(frame):
    child = frame([(None,), ("x",), ("x",)], "k STRING")
    parent = frame([("y",)], "k STRING")
    assert found(quality.orphans({"c": (child, "k", parent, "k")})) == {"c": 2}


def test_stores(frame):
    sites = frame([(1, "T5C0123"), (2, "MBL0123"), (3, "T5C7"), (4, "T5CX"), (5, "T5CY")],
                  "siteID BIGINT, storeNumber STRING")
    assert [tuple(r) for r in quality.store_collisions(sites).collect()] == [(123, 2)]
    keys = frame([(0, 1), (None, 2), (5, None), (5, 6)], "fleetAccountNumber BIGINT, storeNumber BIGINT")
    assert found(quality.bad_join_keys({"b": (keys, ("fleetAccountNumber", "storeNumber"))})) == {
        "b.fleetAccountNumber": 2, "b.storeNumber": 1,
    }


def test_catalogue_of_files(spark, tmp_path):
    documents = {
        "a": {"visibleName": "Quarter plan", "type": "DocumentType", "createdTime": "1751328000000",
              "parent": "5e1f0c22-shelf", "lastOpenedPage": 0, "new": False},
        "b": {"visibleName": "Shelf", "type": "CollectionType", "parent": ""},
        "c": {"visibleName": "Old", "type": "DocumentType", "parent": "trash", "deleted": True},
        "d": {"type": "DocumentType"},
        "e": {"visibleName": "Two\nlines \"quoted\"", "extra": {"nested": [1]}},
        "h": {"visibleName": "Odd", "pinned": "false", "lastOpenedPage": 1.5, "deleted": 1},
        "i": {"visibleName": 7, "lastOpenedPage": 99999999999, "deleted": 0, "parent": None},
    }
    for name, content in documents.items():
        (tmp_path / f"{name}.metadata").write_text(json.dumps(content, indent=4))
    (tmp_path / "f.metadata").write_text("not json")
    (tmp_path / "g.metadata").write_text("")
    (tmp_path / "j.metadata").write_text('[{"visibleName": "listed"}]')
    (tmp_path / "a.content").write_text("{}")
    found_files = files.read_documents(spark, str(tmp_path))
    rows = {r.file_name: r for r in doccatalog.document_summary(found_files).collect()}
    assert {n: r.line for n, r in rows.items() if n[0] in "abcdfghij"} == {
        "a.metadata": "[DOC] Quarter plan (in: 5e1f0c22...)",
        "b.metadata": "[FOLDER] Shelf",
        "c.metadata": "[DOC] Old [DELETED] (in: trash)",
        "d.metadata": "[DOC] (unknown)",
        "f.metadata": "[?] f.metadata (could not parse)",
        "g.metadata": "[?] g.metadata (could not parse)",
        "h.metadata": "[DOC] Odd [DELETED]",
        "i.metadata": "[DOC] 7",
        "j.metadata": "[?] j.metadata (could not parse)",
    }
    assert rows["e.metadata"].name == 'Two\nlines "quoted"'
    created = {r.file_name: r.created_at for r in doccatalog.parse_documents(found_files).collect()}
    assert created["a.metadata"].year == 2025 and created["b.metadata"] is None
    hits = doccatalog.name_search(found_files, "QUARTER").collect()
    assert [tuple(r) for r in hits] == [("Quarter plan", "a.metadata")]
    assert doccatalog.name_search(found_files, "%").count() == 0
    listed = files.list_files(spark, str(tmp_path))
    counts = {r.extension: r.files for r in doccatalog.extension_counts(listed).collect()}
    # The file without a byte (g) counts as well.
    assert counts == {".metadata": 10, ".content": 1, ".pagedata": 0, "total": 11}


@pytest.mark.parametrize(
    "text,parsed,deleted",
    [
        ('\n{"visibleName":"C"}', True, False),
        ('\t\r\n {"visibleName":"C"}\n', True, False),
        ('{"visibleName":"C"} x', False, None),
        ('{"visibleName":"C"}{}', False, None),
        ('{"visibleName":"C"}]', False, None),
        ('{"visibleName":"C"},5', False, None),
        ("{'visibleName':'H'}", False, None),
        ('[{"visibleName":"C"}]', False, None),
        ('"{}"', False, None),
        ("\ufeff{}", False, None),
        ('\x0b{"a":1}', False, None),
        ('{"a":"line\nbreak"}', False, None),
        ("{}", True, False),
        (None, False, None),
        ("", False, None),
        ('{"deleted":"0"}', True, True),
        ('{"deleted":"false"}', True, True),
        ('{"deleted":""}', True, False),
        ('{"deleted":0}', True, False),
        ('{"deleted":-0.0}', True, False),
        ('{"deleted":2}', True, True),
        ('{"deleted":null}', True, False),
        ('{"deleted":[]}', True, False),
        ('{"deleted":[0]}', True, True),
        ('{"deleted":{}}', True, False),
        ('{"deleted":true,"deleted":false}', True, False),
    ],
)
def test_one_json_object(spark, text, parsed, deleted):
    row = doccatalog.document_summary(spark.createDataFrame([("f", text)], "file_name string, text string")).first()
    assert (row.kind != "?", row.deleted) == (parsed, deleted)
    if parsed:
        assert bool(json.loads(text).get("deleted", False)) == deleted


def test_one_pass_finds_what_the_single_checks_find(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,), (None,)], "id bigint")
    hot = spark.range(3000).selectExpr("cast(CASE WHEN id % 3 > 0 THEN 2 WHEN id % 2 = 0 THEN 9 END AS int) AS ref")
    none = spark.createDataFrame([], "ref bigint")
    audit = quality.key_audit({"p": (parents, "id", "dimension_fanout", {"hot.ref": (hot, "ref"), "none.ref": (none, "ref")})})
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Join" not in plan
    links = {"hot.ref": (hot, "ref", parents, "id"), "none.ref": (none, "ref", parents, "id")}
    want = found(quality.dimension_fanout({"p": (parents, "id")})) | found(quality.orphans(links))
    assert found(audit) == want and want["hot.ref"] == 500 and want["p(id)"] == 2

"""Operators against literal values and plain loops."""

import io
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparktally.functions import text as tx, units
from sparktally.operators import corpus, matching, rows, sheets, spans
from sparktally.plans import QUERIES
from sparktally.plans.bridge import boq_rows
from sparktally.plans.row_queries import boq_with_units
from sparktally.sources import readers, sinks
from sparktally.streaming import intake


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "raw, canonical, dimension, ambiguous",
    [
        ("Sqm.", "sqm", "area", False), ("cu.m.", "cum", "volume", False), ("M", "unknown", "unknown", True), ("t", "unknown", "unknown", True),
        ("KW", "kW", "electrical", False), ("running metre", "rmt", "length", False), ("m^2", "m^2", "area", False), ("???", "???", "unknown", False),
        ("", "", "unknown", False), (None, "", "unknown", False), ("sqmm", "sqmm", "unknown", False), ("Metric Ton", "mt", "mass", False),
    ],
)
def test_units(spark, raw, canonical, dimension, ambiguous):
    r = units.normalize_units(spark.createDataFrame([(raw,)], "u string"), "u").first()
    assert (r.unit_canonical, r.unit_dimension, r.unit_ambiguous) == (canonical, dimension, ambiguous)


def test_units_are_idempotent(spark):
    rows_ = [(k,) for k, _, _ in units.unit_rows()]
    once = units.normalize_units(spark.createDataFrame(rows_, "u string"), "u").select("unit_canonical")
    twice = units.normalize_units(once.withColumnRenamed("unit_canonical", "u"), "u")
    # Single letters are canonical for spelled-out units but ambiguous as input.
    assert twice.where("NOT unit_ambiguous AND lower(u) <> lower(unit_canonical)").count() == 0


@pytest.mark.parametrize("raw, expected", [("IS 456 : 2000", "IS 456:2000"), ("astm A 615", "ASTM A:615"), ("ISO 9001", "ISO 9001"), ("none", None)])
def test_standards(spark, raw, expected):
    got = one(spark, raw, tx.standard)
    assert got == expected or (raw.startswith("ISO") and got.endswith("9001"))


@pytest.mark.parametrize("raw, expected", [("100 mm x 20cm", (0.1, 0.2, None)), ("12mm", (None, None, 0.012)), ("3 m", (None, None, 3.0)), ("wide", (None, None, None))])
def test_dimensions(spark, raw, expected):
    assert tuple(one(spark, raw, tx.metres)) == expected


def test_language(spark):
    assert one(spark, "plain text", tx.language) == "en"
    assert one(spark, "इस्पात", tx.language) == "hi"
    assert one(spark, None, tx.language) == "en"


def test_nfkc(spark):
    assert one(spark, "ｍ²", tx.nfkc) == "m2"


def test_flags_never_change_row_counts(spark, small):
    b = boq_with_units(spark, small)
    assert rows.flag_rows(b).count() == b.count()


def test_union_of_documents_is_invariant(spark, small):
    """Merging all documents is merging each."""
    b = boq_rows(spark, small)
    order = ["item_no", "line_key"]
    whole = rows.merge_duplicates(b, ["material", "location", "grade"], order)
    parts = rows.merge_duplicates(b.where("doc_id % 2 = 0"), ["material", "location", "grade"], order).unionByName(
        rows.merge_duplicates(b.where("doc_id % 2 = 1"), ["material", "location", "grade"], order)
    )
    assert whole.exceptAll(parts).count() == 0 == parts.exceptAll(whole).count()


def test_catalog(spark):
    items = spark.createDataFrame([("Hot Gear",), ("steel bar 12mm",), ("hot geer",), ("zzz",)], "m string")
    cat = spark.createDataFrame([("hot gear", 1), ("steel bar", 2)], "alias string, ord long")
    got = {r.norm: (r.alias, r.method) for r in matching.catalog_cascade(items, "m", cat).collect()}
    assert got["hot gear"] == ("hot gear", "exact")
    assert got["steel bar 12mm"] == ("steel bar", "substring")
    assert got["hot geer"][0] == "hot gear"
    assert "zzz" not in got


def test_bioes(spark):
    df = spark.createDataFrame([(1, ["A", "A", "A", "O", "B"]), (2, ["A", "B", "B"]), (3, [])], "doc_id long, types array<string>")
    got = {r.doc_id: r.t for r in df.select("doc_id", spans.bioes_tags().alias("t")).collect()}
    assert got == {1: ["B-A", "I-A", "E-A", "O", "S-B"], 2: ["S-A", "B-B", "E-B"], 3: []}
    bad = spark.createDataFrame([(["B-A", "O"],), (["S-A"],), (["I-A"],)], "tags array<string>")
    assert [r.v for r in bad.select(spans.bioes_valid().alias("v")).collect()] == [False, True, False]


def test_spans():
    found = spans.find_spans("Supply 12 kg steel M20 as per IS 456:2000, 100mm x 20mm", {"MATERIAL": ["steel"], "UNIT": ["kg"]})
    kinds = {(t, k) for t, k, *_ in found}
    assert {("Supply", "ACTION"), ("12", "QUANTITY"), ("kg", "UNIT"), ("steel", "MATERIAL"), ("M20", "GRADE"), ("IS 456:2000", "STANDARD")} <= kinds
    assert not any(k == "QUANTITY" and t in ("456", "2000", "100", "20") for t, k in kinds)


def test_hierarchy(spark):
    df = spark.createDataFrame([("11",), ("11.1",), ("12",), ("bad",)], "c string")
    assert [r.k for r in df.select(sheets.hierarchy_key(F.col("c")).alias("k")).collect()] == [11, 1101, 12, None]


def test_split_is_deterministic(spark):
    import hashlib

    def plain(key):
        rest = int(hashlib.sha256(str(key).encode()).hexdigest(), 16) % 1000
        return "train" if rest < 700 else "val" if rest < 850 else "test"

    got = spark.range(50).select("id", corpus.split_of(F.col("id")).alias("s")).collect()
    assert all(r.s == plain(r.id) for r in got)


def test_json_export_parses(spark, small):
    docs = [json.loads(r.json) for r in QUERIES["json_export"](spark, small).collect()]
    assert all(d["schema_version"] == "1.1.0" and d["total_items"] == len(d["items"]) for d in docs)


def _workbook() -> bytes:
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="BOQ" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Description</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>sand</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook())
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    got = readers.read_workbooks(spark, str(tmp_path)).collect()
    good = sorted((r.row_idx, r.cells) for r in got if r.error is None)
    assert good == [(0, ["Description", "", "5"]), (1, ["sand"])]
    assert sum(r.error is not None for r in got) == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"products": [{"name": "A", "product_id": "1", "row_no": 1}, {"name": "a ", "product_id": "2", "row_no": 2}]}))
    (got,) = readers.read_catalog(spark, str(tmp_path / "c.json")).collect()
    assert (got.product_id, got.source) == ("1", "c.json")
    assert got.sha256 == hashlib.sha256((tmp_path / "c.json").read_bytes()).hexdigest()
    (tmp_path / "o.json").write_text(json.dumps([{"name": "Sand", "aliases": ["grit"]}, {"name": "Gravel", "aliases": ["GRIT", "stone"]}, {"name": "Lime", "aliases": None}]))
    got = {r["key"]: r["name"] for r in readers.read_ontology(spark, str(tmp_path / "o.json")).collect()}
    assert got == {"sand": "Sand", "gravel": "Gravel", "grit": "Gravel", "stone": "Gravel", "lime": "Lime"}
    (tmp_path / "g.json").write_text(json.dumps({"doc_id": "d", "entries": [{"item_no": "1", "material": "m", "quantity": "2", "unit": "kg"}]}))
    assert readers.read_gold(spark, str(tmp_path / "g.json")).first().material == "m"


def test_writers(spark, small, tmp_path):
    b = boq_rows(spark, small)
    sinks.write_csv(b, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == b.count()
    sinks.write_json(b, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == b.select("doc_id").distinct().count()


def test_stream_gives_what_the_table_gives(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = intake.windowed(intake.intake(spark, str(tmp_path / "in"), events.schema), late="10000 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("windows").select("start", "event_type", "n")
    want = intake.windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).select("start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_trade_sheets_number_every_row(spark, small):
    items = [(r.doc_id, r.material.lower(), r.line_key) for r in boq_rows(spark, small).select("doc_id", "material", "line_key").collect()]
    got = QUERIES["trade_sheets"](spark, small).collect()
    assert sorted(r.line_key for r in got) == sorted(k for _, _, k in items)
    trades, material = {r.line_key: r.trade for r in got}, {k: m for _, m, k in items}
    sheets_ = {}
    for d, m, k in sorted(items, key=lambda x: (x[0], trades[x[2]], material[x[2]], x[2])):
        sheets_.setdefault(d, []).append(k)
    assert {r.line_key: (r.doc_id, r.serial) for r in got} == {k: (d, i) for d, ks in sheets_.items() for i, k in enumerate(ks, 1)}
    assert len(sheets_) > 100

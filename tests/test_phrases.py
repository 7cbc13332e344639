"""Phrases, sentences, cells and tables against literal values."""

import pytest
from pyspark.sql import functions as F

from sparktally.functions import phrases as ph
from sparktally.operators import tables as tb


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    d = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str | None) else 'array<string>' if not v or isinstance(v[0], str) else 'array<array<string>>'}" for n, v in zip(names, values)))
    return d.select(f(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Use steel. Lay it flat! Is it done?  Yes.", ["Use steel.", "Lay it flat!", "Is it done?", "Yes."]),
        ("As per IS 456. The slab follows Clause 7. Next line", ["As per IS 456. The slab follows Clause 7. Next line"]),
        ("First one. Mix 1.5 parts. Then pour. Done", ["First one.", "Mix 1.5 parts. Then pour. Done"]),
        ("no capital. after this", ["no capital. after this"]),
        ("  ", []),
        (None, []),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, ph.sentences, text) == expected


def test_tokens(spark):
    assert one(spark, ph.tokens, "Cable 3.5C x 25sq.mm, été") == ["Cable", "3", ".", "5C", "x", "25sq", ".", "mm", ",", "été"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Supply and installation of 100 mm thick lightly bonded Mineral Wool slabs as per drawings", "Mineral Wool slabs"),
        ("300 mm dia pipes", "300 mm dia pipes"),
        ("Providing and fixing hooks, retainer plates, wires etc.", "hooks, retainer plates, wires"),
        ("Rock wool blanket with GI mesh on both sides", "Rock wool blanket"),
        ("as per drawings", "as per drawings"),
        ("Mineral wool pads." + " filler" * 40, "Mineral wool pads"),
        ("", ""),
        (None, ""),
    ],
)
def test_material_phrase(spark, text, expected):
    assert one(spark, ph.material_phrase, text) == expected


def test_long_phrase_without_an_end_is_cut(spark):
    assert len(one(spark, ph.material_phrase, "x" * 400)) == ph.LONGEST


@pytest.mark.parametrize("text, expected", [("F0AM  TAPE\x0c", "foam tape"), ("IS: 9842 100", "is: 9842 100"), ("o0", "o0"), (None, "")])
def test_catalog_text(spark, text, expected):
    assert one(spark, ph.catalog_text, text) == expected


@pytest.mark.parametrize(
    "doc_id, path, expected",
    [
        ("01_a", "data/01_a/x.pdf", True), ("x", "data/01_a/x.pdf", True), ("x (spec1 PDF)", "d/x.pdf", True), ("10", "RFQ-75810 T.pdf", False), ("", "x.pdf", False), (None, "x.pdf", False),
    ],
)
def test_names_file(spark, doc_id, path, expected):
    assert one(spark, ph.names_file, doc_id, path) is expected


def test_cells(spark):
    cells = ["13 mm thk", "300 MM", "Rmt.", "Nos.", "sq.mtr", "wall", "1,200.5", "R.O.", "rate only", "", "12.", "100", "0", "2.1"]
    d = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r.c: r[1:] for r in d.select("c", tb.is_unit(F.col("c")), tb.is_quantity(F.col("c")), tb.is_item_number(F.col("c"))).collect()}
    assert [c for c in cells if got[c][0]] == ["Rmt.", "Nos.", "sq.mtr"]
    assert [c for c in cells if got[c][1]] == ["1,200.5", "R.O.", "rate only", "12.", "100", "0", "2.1"]
    assert [c for c in cells if got[c][2]] == ["12.", "2.1"]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([["Item", "Description"], ["a", "b"]], True),
        ([["a", "b", "c"], ["1", "Rock wool", "5", "sqm"]], True),
        ([["a", "b", "c"], ["Rock wool", "none", "sqm"]], False),
        ([["Sl.No", "Specification", "Bidder reply"], ["1", "quantity and unit", "5"]], False),
        ([["Item", "Qty"]], False),
        ([[], []], False),
        ([["x", None, "y"], ["ACOUSTIC LINING of the duct", None, "5", "sqm"]], True),
    ],
)
def test_item_table(spark, rows, expected):
    assert one(spark, tb.is_item_table, rows) is expected


@pytest.mark.parametrize(
    "lines, expected",
    [
        (["", "Bill of Quantities", "x"], "boq"),
        (["x", "y", "z", "bank guarantee", "annexure"], "commercial"),
        (["a", "b", "c", "annexure"], "unknown"),
        (["1.1 pipe 5 nos", "1.2 cable 7 m", "1.3 sand 8 cum"], "boq"),
        (["Annexure II"], "annexure"),
        ([" "], "unknown"),
    ],
)
def test_page_class(spark, lines, expected):
    assert one(spark, tb.page_class, lines) == expected


def test_section_lines(spark):
    pages = spark.createDataFrame([(1, 1, ["ab", " Scope of work"]), (1, 2, ["BOQ | qty | rate"]), (2, 1, ["none"])], "doc_id int, page int, lines array<string>")
    got = sorted(tuple(r) for r in tb.section_lines(pages).collect())
    assert got == [(1, 1, 4, 17, "SCOPE", "Scope of work", False), (1, 2, 18, 34, "SCHEDULE_OF_ITEMS", "BOQ | qty | rate", True)]

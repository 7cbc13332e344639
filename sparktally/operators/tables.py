"""Tables of cells, page classes and section lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

# Units that fill a cell, and words of a table's header.
CELL_UNITS = [
    "sqm", "sq.m", "sq. mtr", "sq meter", "square meter", "mtr", "kg", "nos", "no", "rm", "m³", "cum", "ltr", "m2", "m3", "sq.mtr", "rmt", "lm", "m²",
    "sqmtrs", "sq. mtrs", "sqmtr", "mtrs", "rmtr", "m", "sqft", "sq.ft", "sft", "cft", "cu.ft", "ea", "each", "hr", "hrs", "hour", "hours", "day", "days",
    "running metre", "running meter", "r.mtr", "ft", "mm", "cm", "bags", "bag",
]
HEADER_WORDS = ["item", "description", "material", "quantity", "unit", "grade", "rate", "amount", "sr.", "no.", "qty", "total"]
RATE_ONLY = ["RO", "R.O.", "R/O", "R.O", "RATEONLY", "RATE-ONLY"]
SIZED = r"\d+\s*(?:mm|cm|m|ft|inch|in)\s*(?:dia|diameter|thick|thk|wide|depth|length|size)"
SIZE = r"^\d+(?:\.\d+)?\s*(?:mm|cm|m|ft|inch|in)$"
UNIT = rf"\b(?:{'|'.join(u.replace('.', r'[.]') for u in CELL_UNITS)})\b"
NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"
AMOUNT = r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"
# Markers of page classes, in the order of the tests; whether the whole page is searched or its first three lines.
PAGE_MARKERS = [
    ("boq", False, ["bill of quantities", "boq schedule", "schedule of quantities", "abstract of quantities", "schedule of items"]),
    ("commercial", True, ["validity of tender", "safety goggles", "ppe requirements", "insurance", "penalty", "liquidated damages", "bank guarantee"]),
    ("front_matter", False, ["notice inviting tender", "nit - notice", "instructions to bidders", "emd details", "eligibility criteria", "schedule a - eligibility criteria"]),
    ("technical_spec", False, ["technical specifications", "technical specification"]),
    ("general_conditions", False, ["general conditions of contract"]),
    ("annexure", False, ["annexure"]),
]
PAGE_ROW = r"(?i)\d+\.\d+\s+.*?\s+\d+\s+(?:cum|kg|sqm|m3|nos|sq|m|rm|ft)"
# Patterns of section lines, in the order of the tests.
SECTION_LINES = [
    ("SCOPE", [r"\bSCOPE\s+OF\s+WORK\b", r"^\s*SCOPE\b"]),
    ("SPECIFICATIONS", [r"\bTECHNICAL\s+SPECIFICATIONS?\b", r"^\s*SPECIFICATIONS?\b"]),
    ("SCHEDULE_OF_ITEMS", [r"\bBILL\s+OF\s+QUANTITIES\b", r"\bSCHEDULE\s+OF\s+ITEMS\b", r"\bBOQ\b"]),
    ("GENERAL", [r"\bGENERAL\s+TERMS\b", r"\bGENERAL\s+CONDITIONS\b"]),
    ("COMMERCIAL", [r"\bCOMMERCIAL\s+TERMS\b", r"\bPAYMENT\s+TERMS\b"]),
    ("DRAWINGS_LIST", [r"\bLIST\s+OF\s+DRAWINGS\b", r"\bDRAWINGS?\s+LIST\b"]),
    ("PREAMBLE", [r"\bPREAMBLE\b", r"\bNOTICE\s+INVITING\s+TENDER\b"]),
]
TABLE_TERMS = ["qty", "quantity", "unit", "rate", "amount"]


def is_unit(cell: Column) -> Column:
    """A cell that is a unit, not a size or a description with one in it."""
    c = F.rtrim(F.trim(F.lower(cell)), F.lit("."))
    fragment = c.rlike(r"\d") & c.rlike(r"\b(?:mm|cm)\b")
    return (F.length(c) <= 25) & ~c.rlike(SIZED) & ~c.rlike(SIZE) & ~fragment & c.rlike(UNIT)


def is_quantity(cell: Column) -> Column:
    """A number, with separators, or a mark that only a rate is asked."""
    c = F.translate(F.trim(cell), " ,", "")
    return F.upper(c).isin(RATE_ONLY) | c.rlike(NUMBER)


def is_item_number(cell: Column) -> Column:
    """1 to 99, or a number with a point; not 0."""
    c = F.trim(cell)
    whole = c.rlike(r"^0*\d{1,2}$")
    return c.rlike(r"^\d+(?:\.\d*)?$") & ~c.isin("0", "0.") & (F.contains(c, F.lit(".")) | whole)


def _row_text(row: Column) -> Column:
    return F.array_join(F.filter(row, lambda c: F.coalesce(c, F.lit("")) != ""), " ")


def is_data_row(row: Column) -> Column:
    """A row of three cells or more with a number and a unit, and either an item
    number before them or more than 20 characters."""
    text = _row_text(row)
    unit = F.exists(row, lambda c: F.coalesce(is_unit(c), F.lit(False)))
    return (F.size(row) >= 3) & text.rlike(AMOUNT) & unit & (text.rlike(r"^\d+(?:\.\d+)?\s") | (F.length(text) > 20))


def is_item_table(rows: Column, headers: Column | None = None, scanned: int = 6) -> Column:
    """Whether an array of rows of cells is a table of work items: two rows or
    more, no compliance checklist in its first rows, and two header words in the
    headers or the first row, or a data row below it. A table stays in its row."""
    marks = lambda t: F.size(F.filter(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(t, w)))
    any_of = lambda t, words: F.greatest(*(F.contains(t, F.lit(w)) for w in words))
    checks = lambda t: any_of(t, ["specification", "tce spec"]) & any_of(t, ["reply", "compliance", "remarks"]) & any_of(t, ["sl.no", "sl. no"])
    checklist = F.exists(F.slice(rows, 1, scanned), lambda r: checks(F.lower(_row_text(r))))
    found = (marks(F.lower(_row_text(F.get(rows, F.lit(0))))) >= 2) | F.exists(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), is_data_row)
    if headers is not None:
        found = found | (marks(F.lower(F.array_join(headers, " "))) >= 2)
    return F.coalesce((F.size(rows) >= 2) & ~checklist & found, F.lit(False))


def page_class(lines: Column) -> Column:
    """Class of a page (array of lines) by its markers, else by three rows that
    look like items, else unknown."""
    solid = F.filter(F.transform(lines, lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    whole, head = F.lower(F.array_join(lines, "\n")), F.array_join(F.slice(solid, 1, 3), " ")
    out = F.when(F.regexp_count(F.array_join(lines, "\n"), F.lit(PAGE_ROW)) >= 3, "boq").otherwise("unknown")
    for kind, everywhere, words in reversed(PAGE_MARKERS):
        out = F.when((whole if everywhere else head).rlike("|".join(map(re.escape, words))), kind).otherwise(out)
    return F.when(F.size(solid) == 0, "unknown").otherwise(out)


def section_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, start, end, section, title, is_table of the lines of pages
    (doc_id, page, lines) that name a section; start counts the document's
    characters. Lines without a section leave before offsets are summed."""
    length = F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x) + 1)
    before = F.sum(F.greatest(length, F.lit(1))).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    placed = pages.withColumn("before", F.coalesce(before, F.lit(0)))
    each = placed.select("doc_id", "page", "before", "lines", F.posexplode("lines").alias("at", "line")).withColumn("title", F.regexp_replace("line", r"^\s+|\s+$", ""))
    kind = F.coalesce(*(F.when(F.col("title").rlike("(?i)" + "|".join(p)), name) for name, p in SECTION_LINES))
    hit = each.withColumn("section", kind).where("section IS NOT NULL")
    above = F.aggregate(F.slice("lines", F.lit(1), F.col("at")), F.lit(0), lambda n, x: n + F.length(x) + 1)
    start = F.col("before") + above + F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))
    low = F.lower("title")
    terms = sum((low.rlike(rf"\b{t}\b").cast("int") for t in TABLE_TERMS), F.lit(0))
    table = (F.regexp_count("title", F.lit(r"\|")) >= 2) | low.rlike(r"\bitem\s*no\b") | (terms >= 2)
    return hit.select("doc_id", "page", start.alias("start"), (start + F.length("title")).alias("end"), "section", "title", table.alias("is_table"))

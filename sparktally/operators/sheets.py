"""Spreadsheet operators on cells: one row per sheet row, cells in an array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

HEADER_WORDS = ["description", "material", "qty", "quantity", "unit", "remarks", "sr. no.", "s r no"]
# Column roles by header pattern, in order of precedence.
ROLES = [
    ("IGNORE", r"(?i)rate|amount|remark"),
    ("MATERIAL", r"(?i)description|material|particular"),
    ("QUANTITY", r"(?i)qty|quantity|total"),
    ("UNIT", r"(?i)\bunit\b|uom"),
    ("GRADE", r"(?i)grade"),
    ("STANDARD", r"(?i)standard|code"),
    ("LOCATION", r"(?i)location|area|floor"),
    ("SERIAL", r"(?i)s\.? ?no|sr\.? ?no|item no"),
]


def solid(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c.isNotNull() & ~c.isin("", "None", "nan"))


def header_rows(rows: DataFrame) -> DataFrame:
    """rows (sheet, row_idx, cells) -> sheet, header_row: the first row with two
    cells, a header word and no item number with a quantity; 0 without any."""
    cells = solid(F.col("cells"))
    words = F.exists(cells, lambda c: reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in HEADER_WORDS)))
    data = F.col("cells")[0].rlike(r"^\s*\d+(\.\d+)*\s*$") & F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)) > 0)
    fits = (F.size(cells) >= 2) & words & ~F.coalesce(data, F.lit(False)) & (F.length(F.array_join(cells, "")) <= 800)
    return rows.groupBy("sheet").agg(F.coalesce(F.min(F.when(fits, F.col("row_idx"))), F.lit(0)).alias("header_row"))


def column_roles(headers: DataFrame) -> DataFrame:
    """headers (sheet, header array) -> sheet, col_idx, role: first pattern that
    fits; each role goes to its first column."""
    role = F.lit(None).cast("string")
    for name, pattern in reversed(ROLES):
        role = F.when(F.col("h").rlike(pattern), name).otherwise(role)
    named = headers.select("sheet", F.posexplode("header").alias("col_idx", "h")).withColumn("role", role).where("role IS NOT NULL")
    return named.groupBy("sheet", "role").agg(F.min("col_idx").alias("col_idx"))


def classify_table(header: Column) -> Column:
    """Table type of a header array; the order of the tests matters."""

    def has(*words: str) -> Column:
        return F.exists(header, lambda h: reduce(lambda a, b: a | b, (F.contains(F.lower(h), F.lit(w)) for w in words)))

    return (
        F.when(has("compliance", "yes/no"), "COMPLIANCE_CHECKLIST")
        .when(has("make", "brand") & ~has("qty", "quantity"), "MAKE_LIST")
        .when(has("vendor", "supplier") & ~has("qty", "quantity"), "VENDOR_LIST")
        .when(has("qty", "quantity") & has("description", "material", "item"), "BOQ")
        .when(has("specification", "parameter"), "GENERIC_SPEC")
        .otherwise("UNKNOWN")
    )


def is_total(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.lower(c).rlike(r"\b(total|sub-?total|grand-?total)\b"))


def join_wrapped(rows: DataFrame, order: str, text: str, is_real: Column) -> DataFrame:
    """Continuation rows are appended to the real row before them; those before
    any real row stay on their own."""
    w = Window.partitionBy("doc_id").orderBy(order)
    islands = rows.withColumn("island", F.sum(is_real.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return islands.groupBy("doc_id", "island").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"), F.count(F.lit(1)).alias("n_rows"))


def item_parts(code: Column) -> Column:
    """'11.1.2' -> [11, 1, 2]; null for anything else."""
    clean = F.trim(code)
    return F.when(clean.rlike(r"^\d+(\.\d+)*$"), F.split(clean, r"\.").cast("array<int>"))


def with_parents(rows: DataFrame, code: str, text: str) -> DataFrame:
    """Adds context: the texts of a code's ancestors in the document (the last
    row of a repeated code counts), outermost first, then its own."""
    parts = F.split(F.trim(code), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    named = rows.groupBy("doc_id", F.trim(code).alias("prefix")).agg(F.max_by(text, "seq").alias("name"))
    exploded = rows.select("doc_id", "seq", F.posexplode(prefixes).alias("level", "prefix"))
    joined = exploded.join(named, ["doc_id", "prefix"])
    chain = F.array_sort(F.collect_list(F.struct("level", "name")))
    return joined.groupBy("doc_id", "seq").agg(F.array_join(F.transform(chain, lambda p: p["name"]), " > ").alias("context"))


def hierarchy_key(code: Column) -> Column:
    """Base-100 number of a code's parts; malformed codes have none."""
    return F.aggregate(item_parts(code), F.lit(0).cast("long"), lambda a, p: a * 100 + p)


def unpivot_quantities(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row per positive quantity column; a row without any keeps its first
    column at confidence 0.70."""
    pairs = F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).cast("double").alias("quantity"), F.lit(0.95).alias("confidence")) for c in columns))
    positive = F.filter(pairs, lambda p: p["quantity"] > 0)
    first = F.array(F.struct(F.lit(columns[0]).alias("source"), F.col(columns[0]).cast("double").alias("quantity"), F.lit(0.70).alias("confidence")))
    picked = F.when(F.size(positive) > 0, positive).otherwise(first)
    return rows.select(*ids, F.explode(picked).alias("p")).select(*ids, "p.source", "p.quantity", "p.confidence")


def select_sheets(rows: DataFrame) -> DataFrame:
    """Sheets of a workbook worth reading: all with two numeric rows, in order;
    if there are fewer than two of these, the best one."""
    numeric = F.exists("cells", lambda c: c.try_cast("double").isNotNull())
    scored = rows.groupBy("workbook", "sheet").agg(F.count_if(numeric).alias("score"), F.count(F.lit(1)).alias("n_rows")).where("n_rows >= 3 AND score > 0")
    w = Window.partitionBy("workbook")
    ranked = scored.withColumns({"good": F.count_if(F.col("score") >= 2).over(w), "nth": F.row_number().over(w.orderBy(F.desc("score"), "sheet"))})
    return ranked.where(((F.col("good") >= 2) & (F.col("score") >= 2)) | ((F.col("good") < 2) & (F.col("nth") == 1))).select("workbook", "sheet", "score")

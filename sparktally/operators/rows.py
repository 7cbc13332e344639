"""Line items: merging, duplicates, filters, confidence, flags, numbering.

Every function takes and gives DataFrames; rows are flagged, not dropped,
unless the operator is a filter. Grouping is by document wherever the
semantics are per document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The words and spellings that the scorer and the filters know.
SURFACE = ["plaster", "paint", "tile", "flooring", "granite", "marble", "insulation", "waterproofing", "coating"]
VOLUME = ["concrete", "cement", "mortar", "grout", "aggregate", "sand"]
LENGTH = ["pipe", "wire", "cable", "rod", "bar"]
COUNTED = ["brick", "block", "paver", "valve", "fan", "pump", "light", "switch", "door", "window"]
ACTIONS = ["supply", "providing", "provide", "laying", "fixing", "installation", "erection", "testing", "dismantling"]


def any_word(column: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(column, F.lit(w)) for w in words))


def key(column: str) -> Column:
    return F.trim(F.lower(F.coalesce(F.col(column), F.lit(""))))


def merge_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of one document with equal keys (in lower case, trimmed) become one:
    quantities add up, the largest confidence stays, other fields are the first
    row's. Aggregation is partial before the shuffle."""
    first = F.struct(*order)
    named = {f"key_{k}": key(k) for k in keys}
    grouped = rows.withColumns(named).groupBy("doc_id", *named)
    return grouped.agg(
        F.sum("quantity").alias("quantity"),
        F.max("confidence").alias("confidence"),
        F.min_by("material", first).alias("material"),
        F.min_by("item_no", first).alias("item_no"),
        F.count(F.lit(1)).alias("n_merged"),
        F.when(F.count(F.lit(1)) > 1, "duplicate_merged").alias("warning"),
    )


def merge_by_material_unit(rows: DataFrame, order: list[str]) -> DataFrame:
    """Case-sensitive (material, unit) groups: quantities add up, confidences average."""
    return rows.groupBy("doc_id", "material", "unit_canonical").agg(
        F.sum("quantity").alias("quantity"), F.avg("confidence").alias("confidence"), F.min_by("item_no", F.struct(*order)).alias("item_no")
    )


def drop_exact_duplicates(rows: DataFrame, order: list[str]) -> DataFrame:
    """First of equal (material, quantity, unit, page); rate-only rows all stay."""
    w = Window.partitionBy("doc_id", key("material"), "quantity", key("unit_raw"), "page").orderBy(*order)
    ranked = rows.withColumn("nth", F.when(F.col("rate_only"), 1).otherwise(F.row_number().over(w)))
    return ranked.where("nth = 1").drop("nth")


def collapse_zero_quantity(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of rows without quantity that aren't rate-only, the first per material."""
    zero = (F.col("quantity") == 0) & ~F.col("rate_only")
    squeezed = F.trim(F.regexp_replace(F.lower("material"), r"\s+", " "))
    w = Window.partitionBy("doc_id", squeezed, zero).orderBy(*order)
    return rows.withColumn("nth", F.when(zero, F.row_number().over(w)).otherwise(1)).where("nth = 1").drop("nth")


def disposition(rows: DataFrame) -> DataFrame:
    """Why a row would be kept or left out, first reason first; counting this
    column per document accounts for every source row."""
    m = F.trim(F.col("material"))
    return rows.withColumn(
        "disposition",
        F.when(F.length(m) <= 2, "material_too_short")
        .when(F.lower(m).rlike(r"\b(grand-?\s?total|sub-?\s?total|total)\b"), "total_row")
        .when((F.col("quantity") > 100000) & (F.length(m) < 30), "implausible_quantity")
        .when(m.rlike(r"^[0-9.xX ]+\s*(mm|cm|m|inch)?$"), "pure_dimension")
        .when((F.col("quantity") == 0) & ~F.col("rate_only"), "quantity_missing")
        .when(F.col("rate_only"), "rate_only")
        .otherwise("extracted"),
    )


def score_confidence(rows: DataFrame) -> DataFrame:
    """Confidence from material length, quantity and how well the unit fits."""
    mat, unit, size = F.lower("material"), F.lower(F.coalesce("unit_canonical", F.lit(""))), F.length("material")
    fits = (
        (any_word(mat, SURFACE) & unit.isin("m²", "sqm", "sq.m"))
        | (any_word(mat, VOLUME) & unit.isin("m³", "cum", "cbm"))
        | (any_word(mat, LENGTH) & unit.isin("m", "rm", "rmt"))
        | (F.contains(mat, F.lit("steel")) & unit.isin("kg", "ton", "tonne"))
    )
    hundredths = (
        F.lit(50)
        + F.when(size > 40, 20).when(size > 20, 10).when(size < 10, -10).otherwise(0)
        + F.when(F.col("quantity") <= 0, -15).when(F.col("quantity") > 100000, -10).otherwise(10)
        + F.when(fits, 10).otherwise(0)
        - F.when(unit.isin("no.", "nos", "each", "ea") & ~any_word(mat, COUNTED), 5).otherwise(0)
    )
    return rows.withColumn("scored_confidence", F.least(F.lit(100), F.greatest(F.lit(0), hundredths)) / 100)


def flag_rows(rows: DataFrame) -> DataFrame:
    """Adds flags (array of code, severity, stage, message); row counts never change."""

    def flag(code: str, severity: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("normalize").alias("stage"), F.lit(message).alias("message"))

    flags = F.array(
        F.when(F.col("confidence") < 0.7, flag("LOW_CONFIDENCE", "review", "confidence under 0.7")),
        F.when((F.col("quantity") == 0) & ~F.col("rate_only"), flag("QUANTITY_MISSING", "review", "no quantity")),
        F.when(F.col("unit_ambiguous"), flag("AMBIGUOUS_UNIT", "review", "unit has several readings")),
        F.when(F.col("unit_unknown") & ~F.col("unit_ambiguous"), flag("UNKNOWN_UNIT", "review", "unit is not known")),
        F.when(F.col("rate_only"), flag("RATE_ONLY", "info", "rate without quantity")),
    )
    return rows.withColumn("flags", F.array_compact(flags))


def valid(rows: DataFrame) -> DataFrame:
    """Material and unit present, quantity not negative or rate-only."""
    return rows.where("length(trim(material)) > 0 AND (quantity >= 0 OR rate_only) AND length(trim(unit_raw)) > 0")


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.withColumn("serial", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def trade(material: Column) -> Column:
    """Trade by the first keyword that fits."""
    # Trades in order of precedence.
    trades = [
        ("Civil", ["concrete", "cement", "brick", "masonry", "sand", "aggregate", "mortar", "excavation"]),
        ("Structural", ["steel", "tmt", "rebar", "reinforcement"]),
        ("Finishing", ["tile", "flooring", "paint", "plaster", "granite", "marble"]),
        ("Plumbing", ["pipe", "pvc", "sanitary", "valve"]),
        ("Electrical", ["cable", "wire", "switch", "panel", "light"]),
        ("HVAC", ["duct", "chiller", "insulation"]),
        ("Waterproofing", ["waterproof", "membrane"]),
    ]
    m, out = F.lower(material), F.lit("General")
    for name, words in reversed(trades):
        out = F.when(any_word(m, words), name).otherwise(out)
    return out


def trade_rollup(rows: DataFrame) -> DataFrame:
    """Items, a subtotal per trade and a grand total, in one pass."""
    t = rows.withColumn("trade", trade(F.col("material")))
    return t.rollup("trade").agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("quantity"), F.grouping("trade").cast("int").alias("is_total"))


def sheet_serials(rows: DataFrame) -> DataFrame:
    """Every row's trade and its serial on one sheet of all rows, by trade, then by
    lower-case description. Rows are numbered inside their trade and description
    and moved by the counts of those before, so no task has the whole table."""
    t = rows.withColumns({"trade": trade(F.col("material")), "m_": F.lower("material")})
    groups = t.groupBy("trade", "m_").agg(F.count(F.lit(1)).alias("n_"))
    in_trade = Window.partitionBy("trade").orderBy("m_").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before_", F.coalesce(F.sum("n_").over(in_trade), F.lit(0)))
    trades = t.groupBy("trade").agg(F.count(F.lit(1)).alias("t_"))  # nine fixed trades and General
    trades = trades.withColumn("first_", F.coalesce(F.sum("t_").over(Window.orderBy("trade").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = groups.join(F.broadcast(trades), "trade").select("trade", "m_", (F.col("first_") + F.col("before_")).alias("before_"))
    own = F.row_number().over(Window.partitionBy("trade", "m_").orderBy("line_key"))
    return t.withColumn("own_", own).join(placed, ["trade", "m_"]).withColumn("serial", (F.col("own_") + F.col("before_")).cast("int")).drop("own_", "before_", "m_")


def trade_serials(rows: DataFrame) -> DataFrame:
    """Every row's trade and its serial on its document's sheet, which has the
    items by trade, then by lower-case description. No task has more than
    whole documents."""
    t = rows.withColumn("trade", trade(F.col("material")))
    return t.withColumn("serial", F.row_number().over(Window.partitionBy("doc_id").orderBy("trade", F.lower("material"), "line_key")))


def junk(rows: DataFrame) -> Column:
    """One boolean over all junk predicates, evaluated in one pass."""
    m = F.lower(F.trim("material"))
    digits = F.regexp_replace(F.col("quantity").cast("string"), r"\..*$", "")
    return (
        (F.length(m) < 3)
        | ((F.col("quantity") > 100000) & (F.length(m) < 30))
        | digits.rlike("^(3882|7581)")
        | m.rlike(r"^(page|sheet|sr|s\.no|note|remarks)\b")
        | F.lower(F.coalesce("unit_raw", F.lit(""))).isin("page", "of", "rev", "date")
    )

"""Projections for export formats, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def csv_columns(rows: DataFrame) -> DataFrame:
    """Thirteen text columns; a zero quantity prints empty."""
    q = F.when(F.col("quantity") == 0, "").otherwise(F.regexp_replace(F.regexp_replace(F.col("quantity").cast("string"), r"0+$", ""), r"\.$", ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        text("doc_id").alias("doc_id"), text("item_no").alias("item_no"), text("material").alias("material"), q.alias("quantity"), text("unit_raw").alias("unit"),
        F.lit("supply").alias("action"), text("grade").alias("grade"), F.lit("").alias("dimensions"), text("standard").alias("standard"), text("location").alias("location"),
        F.format_string("%.2f", F.col("confidence")).alias("confidence"), F.col("rate_only").cast("string").alias("rate_only"), text("page").alias("source_pages"),
    )


def json_result(rows: DataFrame) -> DataFrame:
    """One JSON document per doc_id, items in order. A document's items meet in
    one row: the format asks for that."""
    item = F.struct("item_no", "material", F.col("quantity").cast("double").alias("quantity"), F.col("unit_raw").alias("unit"), "confidence")
    items = F.array_sort(F.collect_list(F.struct("item_no", "line_key", item.alias("item"))))
    grouped = rows.groupBy("doc_id").agg(F.transform(items, lambda x: x["item"]).alias("items"), F.count(F.lit(1)).alias("total_items"), F.avg("confidence").alias("avg_confidence"))
    return grouped.select("doc_id", F.to_json(F.struct(F.lit("1.1.0").alias("schema_version"), "doc_id", "total_items", "avg_confidence", "items")).alias("json"))


def code_map(column: Column, codes: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in codes.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def sap_items(rows: DataFrame) -> DataFrame:
    """Item numbers in tens, five digits; units by code."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_no", "line_key"))
    units = {"sqm": "M2", "cum": "M3", "kg": "KG", "mt": "TO", "nos": "EA", "rmt": "M", "ltr": "L"}
    return rows.select("doc_id", "line_key", F.lpad((n * 10).cast("string"), 5, "0").alias("item_num"), code_map(F.col("unit_canonical"), units, "EA").alias("sap_unit"))


def ifc_quantity(dimension: Column) -> Column:
    kinds = {"length": "IfcQuantityLength", "area": "IfcQuantityArea", "volume": "IfcQuantityVolume", "mass": "IfcQuantityWeight", "time": "IfcQuantityTime"}
    return code_map(dimension, kinds, "IfcQuantityCount")


def activities(rows: DataFrame) -> DataFrame:
    """Schedule lines: work-breakdown code, activity id and an escaped name."""
    name = F.replace(F.replace(F.replace("material", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select("doc_id", "line_key", F.concat(F.lit("WBS."), F.col("doc_id").cast("string")).alias("wbs"), F.concat(F.lit("A"), F.lpad(F.col("item_no").cast("string"), 4, "0")).alias("activity"), name.alias("name"))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_columns(rows).write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    json_result(rows).select("json").write.text(path)


def write_split(rows: DataFrame, path: str) -> None:
    """One folder per split, as JSON lines."""
    rows.write.partitionBy("split").json(path)

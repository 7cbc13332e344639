"""Repairs and reports on rows: carried context, shifted columns, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def carry_context(rows: DataFrame, order: list[str], is_header: Column, text: str) -> DataFrame:
    """Adds context: the text of the last header row before or at a row."""
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("context", F.last(F.when(is_header, F.col(text)), True).over(w))


def repair_shift(rows: DataFrame, material: str, unit: str, unit_words: list[str]) -> DataFrame:
    """Swaps material and unit where the material is a unit and the unit a size."""
    shifted = F.lower(F.trim(material)).isin(unit_words) & F.col(unit).rlike(r"(?i)^\d+(\.\d+)?\s*(mm|cm|m|inch|dia)\b")
    return rows.withColumns({"shifted": shifted, "m__": F.when(shifted, F.col(unit)).otherwise(F.col(material)), "u__": F.when(shifted, F.col(material)).otherwise(F.col(unit))}).withColumns({material: F.col("m__"), unit: F.col("u__")}).drop("m__", "u__")


def append_tasks(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The queue with tasks that it doesn't have yet; is_new tells them."""
    fresh = new.join(existing.select(key), key, "left_anti").dropDuplicates([key])
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))


def older_than(rows: DataFrame, time: str, cutoff: str) -> DataFrame:
    return rows.where(F.col(time) < F.lit(cutoff).cast("timestamp_ntz"))


def report_lines(rows: DataFrame) -> DataFrame:
    """One line of text per document."""
    g = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < 0.7).alias("low"), F.sum("quantity").cast("double").alias("q"))
    return g.select("doc_id", F.format_string("document %d: %d rows, %d to review, quantity %.2f", "doc_id", "n", "low", "q").alias("line"))


def both_signals(rows: DataFrame, name: Column, head: Column, word: str) -> DataFrame:
    """Adds listed: the name and the head of a text both have the word."""
    return rows.withColumn("listed", F.contains(F.lower(name), F.lit(word)) & F.contains(F.lower(F.substring(head, 1, 1000)), F.lit(word)))


def base_confidence(material: Column, quantity: Column, unit: Column, grade: Column, location: Column) -> Column:
    """A half, and a tenth for each field that is there."""
    tenths = sum((F.when(c, 1).otherwise(0) for c in (F.length(material) > 10, quantity > 0, unit != "", F.coalesce(grade, F.lit("")) != "", F.coalesce(location, F.lit("")) != "")), F.lit(5))
    return tenths / 10

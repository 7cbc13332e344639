"""Queries over repairs, queues and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair as rp
from .bridge import BOQ, boq_rows
from .registry import query, table

_ORDER = "item_no, line_key, quantity, price"


@query(
    "context_carry_down",
    f"SELECT line_key, material, last_value(CASE WHEN length(material) > 26 THEN material END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM {BOQ}",
)
def context_carry_down(spark, sf):
    return rp.carry_context(boq_rows(spark, sf), _ORDER.split(", "), F.length("material") > 26, "material").select("line_key", "material", "context")


_SHIFT = "CASE WHEN part % 23 = 0 THEN {a} ELSE {b} END"


@query(
    "column_shift_repair",
    f"SELECT line_key, part % 23 = 0 AS shifted, {_SHIFT.format(a=chr(39) + '100 mm dia' + chr(39), b='material')} AS material, {_SHIFT.format(a=chr(39) + 'Nos' + chr(39), b='unit_raw')} AS unit FROM {BOQ}",
)
def column_shift_repair(spark, sf):
    b = boq_rows(spark, sf).select("line_key", F.expr(_SHIFT.format(a="'Nos'", b="material")).alias("material"), F.expr(_SHIFT.format(a="'100 mm dia'", b="unit_raw")).alias("unit"))
    return rp.repair_shift(b, "material", "unit", ["nos", "kg", "sqm"])


@query(
    "review_queue_append",
    f"SELECT is_new, count(*) AS n FROM (SELECT line_key, false AS is_new FROM {BOQ} WHERE confidence < 0.3 GROUP BY line_key UNION ALL SELECT DISTINCT line_key, true FROM {BOQ} WHERE confidence < 0.5 AND line_key NOT IN (SELECT line_key FROM {BOQ} WHERE confidence < 0.3)) GROUP BY is_new",
)
def review_queue_append(spark, sf):
    b = boq_rows(spark, sf)
    queue = b.where("confidence < 0.3").select("line_key").distinct()
    return rp.append_tasks(queue, b.where("confidence < 0.5").select("line_key"), "line_key").groupBy("is_new").agg(F.count(F.lit(1)).alias("n"))


@query("expired_jobs", "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
def expired_jobs(spark, sf):
    return rp.older_than(table(spark, sf, "events"), "ts", "2024-01-10 00:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_report",
    f"SELECT doc_id, printf('document %d: %d rows, %d to review, quantity %.2f', doc_id, count(*), count(*) FILTER (confidence < 0.7), cast(sum(quantity) AS double)) AS line FROM {BOQ} GROUP BY doc_id",
)
def text_report(spark, sf):
    return rp.report_lines(boq_rows(spark, sf))


@query("catalog_signals", "SELECT contains(lower(url), 'the') AND contains(lower(html[1:1000]), 'the') AS listed, count(*) AS n FROM pages GROUP BY 1")
def catalog_signals(spark, sf):
    return rp.both_signals(table(spark, sf, "pages"), F.col("url"), F.col("html"), "the").groupBy("listed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "base_confidence",
    f"SELECT line_key, (5 + (length(material) > 10)::int + (quantity > 0)::int + (unit_raw <> '')::int + (coalesce(grade, '') <> '')::int + (coalesce(location, '') <> '')::int) / 10.0::double AS base_conf FROM {BOQ}",
)
def base_confidence(spark, sf):
    return boq_rows(spark, sf).select("line_key", rp.base_confidence(*(F.col(c) for c in ("material", "quantity", "unit_raw", "grade", "location"))).alias("base_conf"))


@query("best_page_range", f"SELECT doc_id, arg_max(page, (confidence, -page)) AS page, max(confidence) AS confidence FROM {BOQ} GROUP BY doc_id")
def best_page_range(spark, sf):
    """The page with the surest row, the first of equal ones."""
    return boq_rows(spark, sf).groupBy("doc_id").agg(F.max_by("page", F.struct("confidence", (-F.col("page")).alias("p"))).alias("page"), F.max("confidence").alias("confidence"))

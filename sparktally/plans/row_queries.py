"""Queries over line items: units, merging, filters, confidence, risk, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import risk, rows
from .bridge import BOQ, boq_rows, boq_units, pick
from .registry import query

ORDER = ["item_no", "line_key"]
BOQ_U = boq_units()


def boq_with_units(spark, sf):
    return units.normalize_units(boq_rows(spark, sf), "unit_raw")


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


SQL_TRADE = f"""CASE WHEN {sql_any("lower(material)", ["concrete", "cement", "brick", "masonry", "sand", "aggregate", "mortar", "excavation"])} THEN 'Civil'
  WHEN {sql_any("lower(material)", ["steel", "tmt", "rebar", "reinforcement"])} THEN 'Structural'
  WHEN {sql_any("lower(material)", ["tile", "flooring", "paint", "plaster", "granite", "marble"])} THEN 'Finishing'
  WHEN {sql_any("lower(material)", ["pipe", "pvc", "sanitary", "valve"])} THEN 'Plumbing'
  WHEN {sql_any("lower(material)", ["cable", "wire", "switch", "panel", "light"])} THEN 'Electrical'
  WHEN {sql_any("lower(material)", ["duct", "chiller", "insulation"])} THEN 'HVAC'
  WHEN {sql_any("lower(material)", ["waterproof", "membrane"])} THEN 'Waterproofing' ELSE 'General' END"""


@query("unit_normalize", f"SELECT line_key, unit_raw, unit_canonical, unit_dimension, unit_unknown, unit_ambiguous, conversion_needed FROM {BOQ_U}")
def unit_normalize(spark, sf):
    return boq_with_units(spark, sf).select("line_key", "unit_raw", "unit_canonical", "unit_dimension", "unit_unknown", "unit_ambiguous", "conversion_needed")


@query(
    "unit_dimension_profile",
    f"SELECT unit_dimension, unit_canonical, count(*) AS n, cast(sum(quantity) AS double) AS quantity FROM {BOQ_U} GROUP BY ALL",
)
def unit_dimension_profile(spark, sf):
    return boq_with_units(spark, sf).groupBy("unit_dimension", "unit_canonical").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"))


@query(
    "qty_parse",
    f"""SELECT line_key, try_cast(regexp_extract(t, '^\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)\\s+(.+?)\\s*$', 1) AS double) AS number,
        nullif(regexp_extract(t, '^\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)\\s+(.+?)\\s*$', 2), '') AS unit_text
        FROM (SELECT line_key, concat(cast(cast(quantity AS int) AS varchar), ' ', unit_raw) AS t FROM {BOQ})""",
)
def qty_parse(spark, sf):
    text = F.concat(F.col("quantity").cast("int").cast("string"), F.lit(" "), F.col("unit_raw"))
    number, unit = units.quantity_and_unit(F.col("t"))
    return boq_rows(spark, sf).select("line_key", text.alias("t")).select("line_key", number.alias("number"), unit.alias("unit_text"))


@query(
    "unit_for_material",
    "SELECT p_partkey, CASE lower(split_part(p_name, ' ', 2)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in units.DEFAULT_UNITS.items())
    + " ELSE 'no.' END AS default_unit FROM part",
)
def unit_for_material(spark, sf):
    word, out = F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("no.")
    for k, v in units.DEFAULT_UNITS.items():
        out = F.when(word == k, v).otherwise(out)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", out.alias("default_unit"))


@query(
    "unit_convert",
    f"""SELECT f.dimension, count(*) AS n, round(sum(cast(quantity AS double) * f.factor), 4) AS in_base_units FROM {BOQ_U} b
        JOIN (VALUES ('mm', 'length', 0.001), ('cm', 'length', 0.01), ('m', 'length', 1.0), ('rmt', 'length', 1.0), ('kg', 'mass', 1.0),
        ('mt', 'mass', 1000.0), ('ltr', 'capacity', 1.0), ('kl', 'capacity', 1000.0)) f(unit, dimension, factor) ON f.unit = b.unit_canonical GROUP BY f.dimension""",
)
def unit_convert(spark, sf):
    factors = [("mm", "length", 0.001), ("cm", "length", 0.01), ("m", "length", 1.0), ("rmt", "length", 1.0), ("kg", "mass", 1.0),
               ("mt", "mass", 1000.0), ("ltr", "capacity", 1.0), ("kl", "capacity", 1000.0)]
    table = spark.createDataFrame(factors, "unit string, dimension string, factor double")
    joined = boq_with_units(spark, sf).join(F.broadcast(table), F.col("unit_canonical") == F.col("unit"))  # eight rows
    return joined.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("quantity").cast("double") * F.col("factor")), 4).alias("in_base_units"))


@query(
    "boq_dedup_merge",
    f"""SELECT doc_id, arg_min(material, (item_no, line_key)) AS material, arg_min(item_no, (item_no, line_key)) AS item_no,
        cast(sum(quantity) AS double) AS quantity, max(confidence) AS confidence, count(*) AS n_merged, CASE WHEN count(*) > 1 THEN 'duplicate_merged' END AS warning
        FROM {BOQ} GROUP BY doc_id, trim(lower(material)), trim(lower(coalesce(location, ''))), trim(lower(coalesce(grade, '')))""",
)
def boq_dedup_merge(spark, sf):
    out = rows.merge_duplicates(boq_rows(spark, sf), ["material", "location", "grade"], ORDER)
    return out.select("doc_id", "material", "item_no", F.col("quantity").cast("double").alias("quantity"), "confidence", "n_merged", "warning")


@query(
    "boq_dedup_material_unit",
    f"""SELECT doc_id, material, unit_canonical, cast(sum(quantity) AS double) AS quantity, round(avg(confidence), 6) AS confidence,
        arg_min(item_no, (item_no, line_key)) AS item_no FROM {BOQ_U} GROUP BY doc_id, material, unit_canonical""",
)
def boq_dedup_material_unit(spark, sf):
    out = rows.merge_by_material_unit(boq_with_units(spark, sf), ORDER)
    return out.withColumns({"quantity": F.col("quantity").cast("double"), "confidence": F.round("confidence", 6)})


_EXACT = f"""(SELECT * FROM {BOQ} QUALIFY rate_only OR row_number() OVER (
  PARTITION BY doc_id, trim(lower(material)), quantity, trim(lower(unit_raw)), page ORDER BY item_no, line_key) = 1)"""


@query("exact_dup_drop", f"SELECT doc_id, item_no, line_key, material, page FROM {_EXACT}")
def exact_dup_drop(spark, sf):
    return rows.drop_exact_duplicates(boq_rows(spark, sf), ORDER).select("doc_id", "item_no", "line_key", "material", "page")


@query(
    "zero_qty_collapse",
    f"""SELECT doc_id, line_key FROM {BOQ} QUALIFY NOT (quantity = 0 AND NOT rate_only) OR row_number() OVER (
        PARTITION BY doc_id, trim(regexp_replace(lower(material), '\\s+', ' ', 'g')), (quantity = 0 AND NOT rate_only) ORDER BY item_no, line_key) = 1""",
)
def zero_qty_collapse(spark, sf):
    return rows.collapse_zero_quantity(boq_rows(spark, sf), ORDER).select("doc_id", "line_key")


@query(
    "row_dispositions",
    f"""SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN length(trim(material)) <= 2 THEN 'material_too_short'
        WHEN regexp_matches(lower(trim(material)), '\\b(grand-?\\s?total|sub-?\\s?total|total)\\b') THEN 'total_row'
        WHEN quantity > 100000 AND length(trim(material)) < 30 THEN 'implausible_quantity'
        WHEN regexp_matches(trim(material), '^[0-9.xX ]+\\s*(mm|cm|m|inch)?$') THEN 'pure_dimension'
        WHEN quantity = 0 AND NOT rate_only THEN 'quantity_missing' WHEN rate_only THEN 'rate_only' ELSE 'extracted' END AS disposition FROM {BOQ}) GROUP BY disposition""",
)
def row_dispositions(spark, sf):
    return rows.disposition(boq_rows(spark, sf)).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query(
    "junk_filter",
    f"""SELECT doc_id, count(*) AS n, count(*) FILTER (length(trim(material)) < 3 OR (quantity > 100000 AND length(trim(material)) < 30)
        OR regexp_matches(cast(cast(quantity AS bigint) AS varchar), '^(3882|7581)')
        OR regexp_matches(lower(trim(material)), '^(page|sheet|sr|s\\.no|note|remarks)\\b') OR lower(unit_raw) IN ('page', 'of', 'rev', 'date')) AS n_junk
        FROM {BOQ} GROUP BY doc_id""",
)
def junk_filter(spark, sf):
    b = boq_rows(spark, sf)
    return b.withColumn("junk", rows.junk(b)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("junk").alias("n_junk"))


_M, _U = "lower(material)", "lower(coalesce(unit_canonical, ''))"


@query(
    "confidence_score",
    f"""SELECT line_key, least(100, greatest(0, 50 + CASE WHEN length(material) > 40 THEN 20 WHEN length(material) > 20 THEN 10 WHEN length(material) < 10 THEN -10 ELSE 0 END
        + CASE WHEN quantity <= 0 THEN -15 WHEN quantity > 100000 THEN -10 ELSE 10 END
        + CASE WHEN {sql_any(_M, rows.SURFACE)} AND {_U} IN ('m²', 'sqm', 'sq.m') OR {sql_any(_M, rows.VOLUME)} AND {_U} IN ('m³', 'cum', 'cbm')
            OR {sql_any(_M, rows.LENGTH)} AND {_U} IN ('m', 'rm', 'rmt') OR contains({_M}, 'steel') AND {_U} IN ('kg', 'ton', 'tonne') THEN 10 ELSE 0 END
        - CASE WHEN {_U} IN ('no.', 'nos', 'each', 'ea') AND NOT {sql_any(_M, rows.COUNTED)} THEN 5 ELSE 0 END)) / cast(100 AS double) AS scored_confidence FROM {BOQ_U}""",
)
def confidence_score(spark, sf):
    return rows.score_confidence(boq_with_units(spark, sf)).select("line_key", "scored_confidence")


@query(
    "row_flags",
    f"""SELECT line_key, array_to_string(list_filter([CASE WHEN confidence < 0.7 THEN 'LOW_CONFIDENCE' END, CASE WHEN quantity = 0 AND NOT rate_only THEN 'QUANTITY_MISSING' END,
        CASE WHEN unit_ambiguous THEN 'AMBIGUOUS_UNIT' END, CASE WHEN unit_unknown AND NOT unit_ambiguous THEN 'UNKNOWN_UNIT' END,
        CASE WHEN rate_only THEN 'RATE_ONLY' END], lambda x: x IS NOT NULL), ',') AS codes FROM {BOQ_U}""",
)
def row_flags(spark, sf):
    return rows.flag_rows(boq_with_units(spark, sf)).select("line_key", F.array_join("flags.code", ",").alias("codes"))


@query(
    "flags_by_code",
    f"""SELECT code, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_filter([CASE WHEN confidence < 0.7 THEN 'LOW_CONFIDENCE' END,
        CASE WHEN quantity = 0 AND NOT rate_only THEN 'QUANTITY_MISSING' END, CASE WHEN unit_ambiguous THEN 'AMBIGUOUS_UNIT' END,
        CASE WHEN unit_unknown AND NOT unit_ambiguous THEN 'UNKNOWN_UNIT' END, CASE WHEN rate_only THEN 'RATE_ONLY' END], lambda x: x IS NOT NULL)) AS code FROM {BOQ_U}) GROUP BY code""",
)
def flags_by_code(spark, sf):
    flags = rows.flag_rows(boq_with_units(spark, sf)).select("doc_id", F.explode("flags").alias("flag"))
    return flags.groupBy(F.col("flag.code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("valid_rows", f"SELECT line_key FROM {BOQ} WHERE length(trim(material)) > 0 AND (quantity >= 0 OR rate_only) AND length(trim(unit_raw)) > 0")
def valid_rows(spark, sf):
    return rows.valid(boq_rows(spark, sf)).select("line_key")


@query("number_rows", f"SELECT line_key, row_number() OVER (PARTITION BY doc_id ORDER BY item_no, line_key) AS serial FROM {BOQ}")
def number_rows(spark, sf):
    return rows.number_rows(boq_rows(spark, sf), ORDER).select("line_key", "serial")


@query(
    "trade_rollup",
    f"""SELECT trade, count(*) AS n_items, cast(sum(quantity) AS double) AS quantity, cast(grouping(trade) AS int) AS is_total
        FROM (SELECT {SQL_TRADE} AS trade, quantity FROM {BOQ}) GROUP BY ROLLUP (trade)""",
)
def trade_rollup(spark, sf):
    return rows.trade_rollup(boq_rows(spark, sf)).withColumn("quantity", F.col("quantity").cast("double"))


@query(
    "trade_sheet",
    f"""SELECT trade, line_key, row_number() OVER (ORDER BY trade, lower(material), line_key) AS serial
        FROM (SELECT {SQL_TRADE} AS trade, material, line_key FROM {BOQ})""",
)
def trade_sheet(spark, sf):
    """Serial numbers of one export of all items."""
    return rows.sheet_serials(boq_rows(spark, sf)).select("trade", "line_key", "serial")


@query(
    "trade_sheets",
    f"""SELECT doc_id, trade, line_key, row_number() OVER (PARTITION BY doc_id ORDER BY trade, lower(material), line_key) AS serial
        FROM (SELECT {SQL_TRADE} AS trade, material, line_key, doc_id FROM {BOQ})""",
)
def trade_sheets(spark, sf):
    """Serial numbers of all exports: a sheet for every document, all rows."""
    return rows.trade_serials(boq_rows(spark, sf)).select("doc_id", "trade", "line_key", "serial")


_RISK = f"""(SELECT *, least(((material = '')::int + (length(material) < 3 AND material <> '')::int + (quantity < 0)::int
  + (coalesce(unit_canonical, '') IN ('', 'no.', 'nos'))::int + (coalesce(location, '') = '')::int) / 3.0::double, 1.0) AS ambiguity,
  CASE WHEN {sql_any(_M, risk.CONSTRUCTION)} AND coalesce(standard, '') = '' THEN 0.9::double
       WHEN {sql_any(_M, risk.CONSTRUCTION)} AND NOT contains(lower(standard), 'is') THEN 0.5 ELSE 0.0 END AS missing_standard,
  (CASE WHEN material <> '' THEN 0.3::double ELSE 0 END) + (CASE WHEN quantity > 0 THEN 0.3::double ELSE 0 END)
  + (CASE WHEN coalesce(unit_canonical, '') NOT IN ('', 'no.') THEN 0.2::double ELSE 0 END)
  + (CASE WHEN coalesce(grade, '') <> '' OR coalesce(standard, '') <> '' THEN 0.2::double ELSE 0 END) AS coverage FROM {BOQ_U})"""


@query(
    "risk_items",
    f"""SELECT line_key, round(ambiguity, 6) AS ambiguity, missing_standard, round(coverage, 6) AS coverage,
        round(ambiguity * 0.25 + missing_standard * 0.25 + coverage * 0.15, 6) AS risk,
        array_to_string(list_filter([CASE WHEN ambiguity > 0.5 THEN 'SCOPE_AMBIGUITY' END, CASE WHEN missing_standard > 0.8 THEN 'MISSING_STANDARD' END], lambda x: x IS NOT NULL), ',') AS risk_flags
        FROM {_RISK}""",
)
def risk_items(spark, sf):
    s = risk.item_risk(boq_with_units(spark, sf))
    return s.select("line_key", *(F.round(c, 6).alias(c) for c in ("ambiguity", "missing_standard", "coverage", "risk")), F.array_join("risk_flags", ",").alias("risk_flags"))


@query(
    "risk_project",
    f"""SELECT doc_id, count(*) AS n_items, round(avg(r) * 0.7 + max(r) * 0.3, 9) AS project_risk, count(*) FILTER (ambiguity > 0.7) AS n_ambiguous,
        count(*) FILTER (missing_standard > 0.7) AS n_without_standard FROM (SELECT *, ambiguity * 0.25 + missing_standard * 0.25 + coverage * 0.15 AS r FROM {_RISK}) GROUP BY doc_id""",
)
def risk_project(spark, sf):
    return risk.project_risk(risk.item_risk(boq_with_units(spark, sf))).withColumn("project_risk", F.round("project_risk", 9))


NORMS = {"concrete": (20.0, 5.0), "steel": (25.0, 8.0), "pipe": (10.0, 4.0)}
_Q = "cast(quantity AS double)"
_Z = "CASE WHEN quantity <> 0 THEN CASE " + " ".join(f"WHEN contains({_M}, '{w}') THEN abs({m} - {_Q}) / {s}" for w, (m, s) in NORMS.items()) + " END END"


@query(
    "risk_factors",
    f"""SELECT line_key, round(CASE WHEN z > 3 THEN 1.0 WHEN z > 2 THEN 0.8 WHEN z > 1.5 THEN 0.5 ELSE 0 END * 0.3::double
        + least((CASE WHEN length(material) < 3 THEN 30 ELSE 0 END + CASE WHEN quantity < 0 THEN 30 ELSE 0 END
          + CASE WHEN coalesce(unit_canonical, '') IN ('', 'no.', 'nos', 'na') THEN 20 ELSE 0 END + CASE WHEN coalesce(location, '') = '' THEN 20 ELSE 0 END) / 100::double, 1.0) * 0.25
        + CASE WHEN {sql_any(_M, risk.CONSTRUCTION)} AND coalesce(standard, '') = '' THEN 0.9
            WHEN {sql_any(_M, risk.CONSTRUCTION)} AND NOT {sql_any("lower(coalesce(standard, ''))", ["is", "bis", "irc", "ieee", "astm"])} THEN 0.5 ELSE 0 END * 0.2::double
        + CASE WHEN quantity < 0 THEN 1.0 WHEN quantity > 1e6 THEN 0.7 WHEN quantity > 0 AND quantity < 0.001 THEN 0.5 ELSE 0 END * 0.1::double
        + CASE WHEN c < 0.5 THEN 1 - c / 0.5 ELSE 0 END * 0.1::double
        + CASE WHEN material = '' THEN 0.8 WHEN NOT {sql_any(_M, risk.KNOWN)} THEN 0.6 ELSE 0 END * 0.05::double, 6) AS factor_risk
        FROM (SELECT *, {_Z} AS z, CASE WHEN confidence = 0 THEN 0.9 ELSE confidence END AS c FROM {BOQ_U})""",
)
def risk_factors(spark, sf):
    return risk.factor_risk(boq_with_units(spark, sf), NORMS).select("line_key", F.round("factor_risk", 6).alias("factor_risk"))


_POINTS = f"""(SELECT doc_id, line_key, grade, least(100, CASE WHEN coalesce(standard, '') = '' THEN 15 ELSE 0 END
  + CASE WHEN lower(trim(material)) IN ('unknown', 'na', 'none', '') OR length(trim(material)) < 3 THEN 20 ELSE 0 END
  + CASE WHEN quantity > 10000 OR (quantity > 0 AND quantity < 0.01) THEN 10 ELSE 0 END + CASE WHEN coalesce(grade, '') = '' THEN 10 ELSE 0 END
  + CASE WHEN length(material) > 500 THEN 5 ELSE 0 END) AS points FROM {BOQ})"""
_BAND = "CASE WHEN points < 15 THEN 'low' WHEN points < 30 THEN 'medium' ELSE 'high' END"


@query(
    "risk_legacy_distribution",
    f"SELECT {_BAND} AS band, count(*) AS n, cast(sum(points) AS bigint) AS points FROM {_POINTS} GROUP BY 1",
)
def risk_legacy_distribution(spark, sf):
    return risk.points(boq_rows(spark, sf)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@query(
    "recommendations",
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (points >= 30) > count(*) * 0.3 THEN 'review high-risk items' END,
        CASE WHEN count(*) FILTER (coalesce(grade, '') = '') > count(*) * 0.5 THEN 'add grades' END], lambda x: x IS NOT NULL), '; ') AS recommendations FROM {_POINTS} GROUP BY doc_id""",
)
def recommendations(spark, sf):
    return risk.recommendations(boq_rows(spark, sf))


_CAT = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS category, {w}::double AS weight FROM {BOQ} WHERE " + sql_any("concat(lower(material), ' ')", words) for n, (w, words) in risk.CATEGORIES.items()
)
_COVER = f"(SELECT doc_id, category, weight, count(*) AS n_items, least(count(*) / 3.0::double, 1.0) AS fraction FROM ({_CAT}) GROUP BY ALL)"


@query("category_coverage", f"SELECT doc_id, category, n_items, round(fraction, 6) AS fraction, weight, fraction < 0.3 AS low FROM {_COVER}")
def category_coverage(spark, sf):
    return risk.category_coverage(boq_rows(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@query("coverage_overall", f"SELECT doc_id, round(sum(fraction * weight), 6) AS coverage, count(*) AS n_present FROM {_COVER} GROUP BY doc_id")
def coverage_overall(spark, sf):
    c = risk.category_coverage(boq_rows(spark, sf))
    return c.groupBy("doc_id").agg(F.round(F.sum(F.col("fraction") * F.col("weight")), 6).alias("coverage"), F.count(F.lit(1)).alias("n_present"))


@query(
    "validation_warnings",
    f"""SELECT line_key, doc_id, unnest(list_filter([CASE WHEN length(trim(material)) = 0 THEN 'MATERIAL_MISSING' END, CASE WHEN quantity = 0 AND NOT rate_only THEN 'QUANTITY_MISSING' END,
        CASE WHEN quantity < 0 THEN 'QUANTITY_NEGATIVE' END, CASE WHEN unit_ambiguous THEN 'UNIT_AMBIGUOUS' END, CASE WHEN unit_unknown AND NOT unit_ambiguous THEN 'UNIT_UNKNOWN' END,
        CASE WHEN {sql_any(_M, risk.CONSTRUCTION)} AND coalesce(standard, '') = '' THEN 'STANDARD_UNKNOWN' END, CASE WHEN confidence < 0.5 THEN 'LOW_CONFIDENCE' END], lambda x: x IS NOT NULL)) AS warning FROM {BOQ_U}""",
)
def validation_warnings(spark, sf):
    return risk.validation_warnings(boq_with_units(spark, sf))


_UNC = "(line_key * 13 % 40) / cast(100 AS double)"
_QUEUE = f"""(SELECT line_key, confidence, CASE WHEN confidence < 0.4 OR u > 0.25 THEN 'high' WHEN confidence < 0.6 OR u > 0.15 THEN 'medium' ELSE 'low' END AS priority
  FROM (SELECT *, {_UNC} AS u FROM {BOQ}) WHERE confidence < 0.6 OR u > 0.15)"""


def _tasks(spark, sf):
    return risk.review_tasks(boq_rows(spark, sf).withColumn("uncertainty", F.expr(_UNC)))


@query("review_queue", f"SELECT line_key, priority FROM {_QUEUE}")
def review_queue(spark, sf):
    return _tasks(spark, sf).select("line_key", "priority")


@query("review_queue_stats", f"SELECT priority, count(*) AS n, round(avg(confidence), 6) AS confidence FROM {_QUEUE} GROUP BY priority")
def review_queue_stats(spark, sf):
    return _tasks(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("review_top_uncertain", f"SELECT line_key, {_UNC} AS uncertainty FROM {BOQ} ORDER BY uncertainty DESC, line_key LIMIT 25")
def review_top_uncertain(spark, sf):
    """A top-k report: the 25 most uncertain rows."""
    return boq_rows(spark, sf).select("line_key", F.expr(_UNC).alias("uncertainty")).orderBy(F.desc("uncertainty"), "line_key").limit(25)


@query(
    "flagship_boq",
    f"""SELECT doc_id, trade, count(*) AS n_rows, cast(sum(quantity) AS double) AS quantity, round(max(r), 6) AS max_risk, count(*) FILTER (unit_unknown) AS n_unknown_units
        FROM (SELECT *, {SQL_TRADE} AS trade, ambiguity * 0.25 + missing_standard * 0.25 + coverage * 0.15 AS r FROM {_RISK}) GROUP BY doc_id, trade""",
)
def flagship_boq(spark, sf):
    """Per document and trade: rows, quantity, largest risk, unknown units."""
    s = risk.item_risk(boq_with_units(spark, sf)).withColumn("trade", rows.trade(F.col("material")))
    return s.groupBy("doc_id", "trade").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").cast("double").alias("quantity"), F.round(F.max("risk"), 6).alias("max_risk"), F.count_if("unit_unknown").alias("n_unknown_units")
    )

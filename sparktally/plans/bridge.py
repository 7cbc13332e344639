"""The star-schema tables seen as line items of tender documents.

An order is a document, a line its item; spellings, places, grades and
confidences are fixed functions of the keys. The same expressions serve Spark
and the DuckDB equivalents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table


def pick(number: str, values: list[str]) -> str:
    """SQL for one of the values by number modulo their count."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE ({number}) % {len(values)} {cases} ELSE {values[-1]} END"


def quoted(values: list[str]) -> list[str]:
    return [f"'{v}'" for v in values]


MATERIALS = [
    "Cement concrete M20", "TMT steel bar", "Brick masonry", "Ceramic tile flooring", "PVC pipe", "Copper cable", "Acrylic paint",
    "River sand", "Glass window", "Waterproofing membrane", "GI duct with insulation", "Supply of",
]
UNITS = ["Sqm.", "cu.m", "KG", "Nos.", "m", "R.M.", "running metre", "Ltr", "", "widget", "MT", "Each", "sq ft", "T"]
COLUMNS = {
    "doc_id": "l_orderkey",
    "item_no": "l_linenumber",
    "part": "l_partkey",
    "material": f"concat({pick('l_partkey', quoted(MATERIALS))}, ' ', p_name)",
    "quantity": "cast(CASE WHEN (l_partkey * 3 + l_linenumber) % 11 = 0 THEN 0 ELSE l_quantity END AS decimal(18, 4))",
    "unit_raw": pick("l_partkey * 7 + l_linenumber", quoted(UNITS)),
    "grade": pick("p_size", quoted(["M20", "Fe500", "", ""])),
    "location": pick("l_suppkey", [*quoted(["Block A", "Block B", "Ground floor", ""]), "NULL"]),
    "standard": pick("l_partkey + p_size", quoted(["IS 456:2000", "", "ASTM A615", "", "IS:1786 - 2008"])),
    "trade_type": "p_type",
    "confidence": "((l_partkey * 31 + l_linenumber * 17) % 101) / cast(100 AS double)",
    "rate_only": "(l_partkey * 3 + l_linenumber) % 11 = 0 AND l_partkey % 2 = 0",
    "page": "cast(1 + l_linenumber % 3 AS int)",
    "price": "l_extendedprice",
    "line_key": "l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 10 * 10 + l_linenumber",
}
SELECT = ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items())
#: The line items as a DuckDB subquery.
BOQ = f"(SELECT {SELECT} FROM lineitem JOIN part ON l_partkey = p_partkey)"


def boq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to part, as line items. Spark picks the join: part is
    broadcast while its statistics say that it is small."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return rows.selectExpr(*(f"{e} AS {n}" for n, e in COLUMNS.items()))


def unit_values() -> str:
    """The unit table as DuckDB VALUES."""
    from ..functions.units import unit_rows

    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in unit_rows())
    return f"(VALUES {rows}) AS u(unit_key, canonical, dimension)"


def boq_units() -> str:
    """The line items with normalised units, as a DuckDB subquery."""
    amb = "('m', 't', 'l', 'a', 'v', 'w')"
    return f"""(SELECT b.*, CASE WHEN b.k IN {amb} THEN 'unknown' ELSE coalesce(u.canonical, b.k) END AS unit_canonical,
      CASE WHEN b.k IN {amb} THEN 'unknown' ELSE coalesce(u.dimension, 'unknown') END AS unit_dimension,
      b.k IN {amb} OR coalesce(u.dimension, 'unknown') = 'unknown' AS unit_unknown, b.k IN {amb} AS unit_ambiguous,
      b.k IN ('sqft', 'sq.ft', 'sft', 'sq ft', 'square feet', 'squarefeet') AS conversion_needed
      FROM (SELECT *, regexp_replace(trim(lower(coalesce(unit_raw, ''))), '[.,;: \\t]+$', '') AS k FROM {BOQ}) b
      LEFT JOIN {unit_values()} ON u.unit_key = b.k)"""

"""Risk, coverage, validation and review scoring: column arithmetic and one
aggregation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rows import any_word

# Materials, categories and weights of the scoring rules.
CONSTRUCTION = [
    "cement", "steel", "tmt", "brick", "block", "concrete", "aggregate", "sand", "mortar", "tile", "paint", "glass", "pipe", "cable",
    "conduit", "aluminum", "wood", "plywood",
]
KNOWN = [
    "cement", "concrete", "steel", "sand", "aggregate", "brick", "block", "paint", "tile", "wood", "plywood", "glass", "pipe", "cable",
    "aluminum", "copper", "gi", "pvc", "cpvc", "upvc", "tmt", "bitumen",
]
CATEGORIES = {
    "structure": (0.25, ["concrete", "cement", "steel", "brick", "block", "sand", "aggregate", "mortar", " reinforcement", " rcc"]),
    "finishing": (0.20, ["paint", "tile", "flooring", "putty", "plaster", "wood", "plywood", " dado", "skirting", "polish"]),
    "plumbing": (0.15, ["pipe", "pvc", "cpvc", "upvc", "gi", "plumb", "water", "drain", "sewage", "sanitary", "fixture"]),
    "electrical": (0.15, ["cable", "conduit", "wire", "switch", "socket", "db", "panel", "light", "fan", "earthing"]),
    "hvac": (0.10, ["duct", "ac", "air", "ventil", "hvac", "chiller", "cooling", "ventilation"]),
    "waterproofing": (0.10, ["waterproof", "damp proof", "membrane", " coating", "torching"]),
    "doors_windows": (0.05, ["door", "window", "ventilator", "frame", "shutter", "glazing", "partition"]),
}
FACTOR_WEIGHTS = {
    "price_outlier": 0.30, "scope_ambiguity": 0.25, "missing_standard": 0.20, "quantity_outlier": 0.10, "low_confidence": 0.10,
    "unknown_material": 0.05,
}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def item_risk(rows: DataFrame) -> DataFrame:
    """ambiguity, missing_standard, coverage, risk and risk_flags of each row.
    unit is the canonical unit, empty where there was none."""
    mat = F.lower("material")
    counted = (
        _blank("material").cast("int")
        + ((F.length("material") < 3) & ~_blank("material")).cast("int")
        + (F.col("quantity") < 0).cast("int")  # a quantity of zero counts as none
        + (_blank("unit_canonical") | F.col("unit_canonical").isin("no.", "nos")).cast("int")
        + _blank("location").cast("int")
    )
    construction, has = any_word(mat, CONSTRUCTION), ~_blank("standard")
    cited = F.contains(F.lower("standard"), F.lit("is"))
    out = rows.withColumns(
        {
            "ambiguity": F.least(counted / 3, F.lit(1.0)),
            "missing_standard": F.when(construction & ~has, 0.9).when(construction & ~cited, 0.5).otherwise(0.0),
            "coverage": F.when(~_blank("material"), 0.3).otherwise(0.0)
            + F.when(F.col("quantity") > 0, 0.3).otherwise(0.0)
            + F.when(~_blank("unit_canonical") & (F.col("unit_canonical") != "no."), 0.2).otherwise(0.0)
            + F.when(~_blank("grade") | has, 0.2).otherwise(0.0),
        }
    )
    return out.withColumns(
        {
            "risk": F.col("ambiguity") * 0.25 + F.col("missing_standard") * 0.25 + F.col("coverage") * 0.15,
            "risk_flags": F.array_compact(
                F.array(F.when(F.col("ambiguity") > 0.5, "SCOPE_AMBIGUITY"), F.when(F.col("missing_standard") > 0.8, "MISSING_STANDARD"))
            ),
        }
    )


def project_risk(scored: DataFrame) -> DataFrame:
    """Per document: 0.7 of the mean and 0.3 of the largest item risk."""
    return scored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.avg("risk") * 0.7 + F.max("risk") * 0.3).alias("project_risk"),
        F.count_if(F.col("ambiguity") > 0.7).alias("n_ambiguous"),
        F.count_if(F.col("missing_standard") > 0.7).alias("n_without_standard"),
    )


def factor_risk(rows: DataFrame, norms: dict[str, tuple[float, float]]) -> DataFrame:
    """Six weighted factors. norms: keyword -> (mean, deviation) of quantities;
    the first keyword in the material counts."""
    mat, q = F.lower("material"), F.col("quantity").cast("double")
    z = F.lit(None).cast("double")
    for word, (mean, sigma) in reversed(norms.items()):
        z = F.when(F.contains(mat, F.lit(word)), F.abs(F.lit(mean) - q) / sigma).otherwise(z)
    z = F.when(q != 0, z)
    construction, has = any_word(mat, CONSTRUCTION), ~_blank("standard")
    cited = any_word(F.lower(F.coalesce("standard", F.lit(""))), ["is", "bis", "irc", "ieee", "astm"])
    hundredths = (
        F.when(F.length("material") < 3, 30).otherwise(0)
        + F.when(q < 0, 30).otherwise(0)
        + F.when(_blank("unit_canonical") | F.col("unit_canonical").isin("no.", "nos", "na"), 20).otherwise(0)
        + F.when(_blank("location"), 20).otherwise(0)
    )
    sure = F.when(F.col("confidence") == 0, 0.9).otherwise(F.col("confidence"))
    factors = {
        "price_outlier": F.when(z > 3, 1.0).when(z > 2, 0.8).when(z > 1.5, 0.5).otherwise(0.0),
        "scope_ambiguity": F.least(hundredths / 100, F.lit(1.0)),
        "missing_standard": F.when(construction & ~has, 0.9).when(construction & ~cited, 0.5).otherwise(0.0),
        "quantity_outlier": F.when(q < 0, 1.0).when(q > 1e6, 0.7).when((q > 0) & (q < 0.001), 0.5).otherwise(0.0),
        "low_confidence": F.when(sure < 0.5, 1 - sure / 0.5).otherwise(0.0),
        "unknown_material": F.when(_blank("material"), 0.8).when(~any_word(mat, KNOWN), 0.6).otherwise(0.0),
    }
    scored = rows.withColumns(factors)
    return scored.withColumn("factor_risk", sum((F.col(n) * w for n, w in FACTOR_WEIGHTS.items()), F.lit(0.0)))


def points(rows: DataFrame) -> DataFrame:
    """Risk points of 0 to 100 with a band."""
    mat = F.lower(F.trim("material"))
    score = (
        F.when(_blank("standard"), 15).otherwise(0)
        + F.when(mat.isin("unknown", "na", "none", "") | (F.length(mat) < 3), 20).otherwise(0)
        + F.when((F.col("quantity") > 10000) | ((F.col("quantity") > 0) & (F.col("quantity") < 0.01)), 10).otherwise(0)
        + F.when(_blank("grade"), 10).otherwise(0)
        + F.when(F.length("material") > 500, 5).otherwise(0)
    )
    return rows.withColumn("points", F.least(score, F.lit(100))).withColumn("band", F.when(F.col("points") < 15, "low").when(F.col("points") < 30, "medium").otherwise("high"))


def category_coverage(rows: DataFrame) -> DataFrame:
    """Per document and category: items, fraction min(n / 3, 1), weight. One
    scan: the categories of a row are an array, counted after an explode."""
    mat = F.concat(F.lower("material"), F.lit(" "))
    hits = F.array_compact(F.array(*(F.when(any_word(mat, words), F.lit(name)) for name, (_, words) in CATEGORIES.items())))
    counted = rows.select("doc_id", F.explode(hits).alias("category")).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n_items"))
    weight = F.lit(0.0)
    for name, (w, _) in CATEGORIES.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    fraction = F.least(F.col("n_items") / 3, F.lit(1.0))
    return counted.withColumns({"fraction": fraction, "weight": weight, "low": fraction < 0.3})


def validation_warnings(rows: DataFrame) -> DataFrame:
    """One row per broken rule."""
    rules = F.array_compact(
        F.array(
            F.when(F.length(F.trim("material")) == 0, "MATERIAL_MISSING"),
            F.when((F.col("quantity") == 0) & ~F.col("rate_only"), "QUANTITY_MISSING"),
            F.when(F.col("quantity") < 0, "QUANTITY_NEGATIVE"),
            F.when(F.col("unit_ambiguous"), "UNIT_AMBIGUOUS"),
            F.when(F.col("unit_unknown") & ~F.col("unit_ambiguous"), "UNIT_UNKNOWN"),
            F.when(any_word(F.lower("material"), CONSTRUCTION) & _blank("standard"), "STANDARD_UNKNOWN"),
            F.when(F.col("confidence") < 0.5, "LOW_CONFIDENCE"),
        )
    )
    return rows.select("line_key", "doc_id", F.explode(rules).alias("warning"))


def review_tasks(rows: DataFrame, confidence: float = 0.6, uncertainty: float = 0.15) -> DataFrame:
    """Rows that need review, with priority; uncertainty is a column of rows."""
    c, u = F.col("confidence"), F.col("uncertainty")
    return rows.where((c < confidence) | (u > uncertainty)).withColumn(
        "priority", F.when((c < 0.4) | (u > 0.25), "high").when((c < 0.6) | (u > 0.15), "medium").otherwise("low")
    )


def recommendations(rows: DataFrame) -> DataFrame:
    """Per document, the texts whose thresholds are passed."""
    agg = points(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band") == "high").alias("high"), F.count_if(_blank("grade")).alias("no_grade"))
    return agg.select(
        "doc_id",
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(F.col("high") > F.col("n") * 0.3, F.lit("review high-risk items")),
                    F.when(F.col("no_grade") > F.col("n") * 0.5, F.lit("add grades")),
                )
            ),
            "; ",
        ).alias("recommendations"),
    )

"""Scalar text functions as columns, and page routing over text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

# Keywords by section type, project type and page rule.
SECTIONS = {
    "PREAMBLE": ["preamble", "general description", "scope of work", "project description", "introduction", "background", "scope", "general", "project overview"],
    "SCOPE": ["scope of work", "scope of the work", "scope", "work scope", "scope item", "schedule of items", "bill of quantities", "boq",
              "item description", "description of items", "schedule", "bill of materials"],
    "SCHEDULE_OF_ITEMS": ["schedule of items", "schedule of rates", "bill of quantities", "boq", "item schedule", "price schedule",
                          "rate schedule", "quantity schedule"],
    "SPECIFICATIONS": ["specification", "specifications", "technical specification", "tech spec", "material specification", "workmanship",
                       "quality requirement", "acceptance criteria", "standard", "standards", "codes", "code of practice"],
    "DRAWINGS_LIST": ["drawing", "drawings", "drawing list", "list of drawings", "drawing numbers", "architectural drawings", "structural drawings",
                      "plans", "sketches"],
    "COMMERCIAL": ["commercial", "payment terms", "price", "rates", "cost", "bid", "tender", "quoted price", " lumpsum", "basis of pricing", "taxes", "gst",
                   "terms of payment", "validity of tender", "bank guarantee", "safety goggle", "safety helmet", "insurance", "penalty",
                   "liquidated damages", "performance security"],
    "GENERAL": ["general terms", "general conditions", "terms and conditions", "t&c", "condition of contract", "general", "miscellaneous", "others",
                "note", "notes"],
}
PROJECTS = {
    "building": ["building", "residential", "commercial", "apartment", "office", "hospital", "school", "floor", "column", "beam", "slab", "wall", "foundation"],
    "road": ["road", "highway", "pavement", "asphalt", "bitumen", "crusher", "granular", "subgrade", "lane", "carriageway", "shoulder", "median"],
    "bridge": ["bridge", "flyover", "culvert", "abutment", "pier", "girder", "span", "foundation", "pile", "precast", "launching", "segmental"],
    "electrical": ["electrical", "cable", "wire", "conduit", "switch", "socket", "db", "panel", "transformer", "generator", "lighting", "earthing", "mcb", "mccb"],
    "plumbing": ["plumbing", "pipe", "pvc", "cpvc", "gi", "water", "drain", "sewage", "sanitary", "fixture", "tap", "valve", "pump", "tank", "cistern"],
}
HEADERS = ["item no", "item no.", "item number", "s.no", "s.no.", "sr.no", "description of item", "description of work", "material description",
           "quantity", "qty", "rate", "amount", "abstract"]
STANDARDS = [  # pattern, body; the first that is found counts
    (r"(?i)IS\s*[:.]?\s*(\d+)(?:\s*[:.]\s*(\d+))?", "IS"),
    (r"(?i)ASTM\s+([A-Z])\s*(\d+)", "ASTM"),
    (r"(?i)BS\s*EN\s*(\d+)", "BS EN"),
    (r"(?i)BS\s*:\s*EN\s*(\d+)", "BS EN"),
    (r"(?i)ACI\s*(\d+)", "ACI"),
    (r"(?i)EN\s*(\d+)", "EN"),
    (r"(?i)ISO\s*(\d+)", "ISO"),
]
QUANTITY_UNIT = r"(?i)\b\d+(\.\d+)?\s*(cum|kg|sqm|m3|nos|sq|m|rm|ft|mm|cm|each|set|pair|lot|rmt|lm|sft|cft|ft3|ft2|m2)\b"
ITEM_LINE = r"^\d+[.)\s]"
SPEC_LINE = r"^\d+\.\d+(\.\d+)+[.\s]"
NUMBER_LINE = r"^(\d+[.)]\s*)?\d+(,\d{3})*(\.\d+)?\s*$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """NFKC; only rows beyond ASCII leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def collapse_white(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_artifacts(text: Column) -> Column:
    for pattern in (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", r"&\w+;", r"%PDF-\d+"):
        text = F.regexp_replace(text, pattern, "")
    return text


def strip_page_numbers(text: Column) -> Column:
    for pattern in (r"(?i)Page\s+\d+\s+(of\s+)?\d+", r"\b\d+\s*/\s*\d+\b", r"(?m)^[ \t]*\d+[ \t]*$"):
        text = F.regexp_replace(text, pattern, "")
    return text


def plain_punctuation(text: Column) -> Column:
    return F.translate(text, "‘’“”–—", "''\"\"--")


def normalize_text(text: Column) -> Column:
    """Artifacts, page numbers, punctuation and white space, in that order."""
    return collapse_white(plain_punctuation(strip_page_numbers(strip_artifacts(text))))


def language(text: Column) -> Column:
    """hi, mixed or en by the share of Devanagari among characters that are
    neither blanks nor line ends."""
    text = F.coalesce(text, F.lit(""))
    solid = F.length(F.regexp_replace(text, r"[ \n]", ""))
    share = F.when(solid > 0, F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) / solid).otherwise(0.0)
    return F.when(share > 0.30, "hi").when(share > 0.02, "mixed").otherwise("en")


def standard(text: Column) -> Column:
    """'is:456 : 2000' -> 'IS 456:2000'; null where no standard is named."""
    out = F.lit(None).cast("string")
    for pattern, body in reversed(STANDARDS):
        first, second = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2) if pattern.count("(") - pattern.count("(?") > 1 else F.lit("")
        named = F.concat(F.lit(f"{body} "), first, F.when(second != "", F.concat(F.lit(":"), second)).otherwise(""))
        out = F.when(text.rlike(pattern), named).otherwise(out)
    return out


def metres(text: Column) -> Column:
    """Length, width or thickness in metres of '100 mm x 20cm', '12mm'."""
    pair = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(mm|cm|m)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|m)\b"
    one = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(mm|cm|m)\b"

    def scaled(pattern: str, number: int, unit: int) -> Column:
        u = F.lower(F.regexp_extract(text, pattern, unit))
        return F.nullif(F.regexp_extract(text, pattern, number), F.lit("")).cast("double") / F.when(u == "mm", 1000).when(u == "cm", 100).otherwise(1)

    two = text.rlike(pair)
    return F.struct(
        F.when(two, scaled(pair, 1, 2)).alias("length"), F.when(two, scaled(pair, 3, 4)).alias("width"), F.when(~two, scaled(one, 1, 2)).alias("thickness")
    )


def section_scores(title: Column, text: Column) -> dict[str, Column]:
    """3 points a keyword in the title, 1 in the text, and the rules' extras."""
    low_title, low = F.lower(title), F.lower(F.concat_ws(" ", title, text))
    scores = {}
    for kind, words in SECTIONS.items():
        hits = (low_title.rlike(rf"\b{w}\b").cast("int") * 3 + low.rlike(rf"\b{w}\b").cast("int") for w in words)
        scores[kind] = reduce(lambda a, b: a + b, hits).cast("double")
    boq = F.contains(low, F.lit("bill of quantities")) | F.contains(low, F.lit("boq"))
    work = F.contains(low, F.lit("scope")) & F.contains(low, F.lit("work"))
    scores["SCOPE"] = scores["SCOPE"] + F.when((scores["PREAMBLE"] > 0) & work, 1.5).otherwise(0) + F.when(boq, 0.5).otherwise(0)
    scores["SCHEDULE_OF_ITEMS"] = scores["SCHEDULE_OF_ITEMS"] + F.when(boq, 2.0).otherwise(0)
    scores["SPECIFICATIONS"] = scores["SPECIFICATIONS"] + F.when(low.rlike(r"\d+\.\d+\s*mm|\d+\.\d+\s*cm"), 0.5).otherwise(0)
    return scores


def classify_sections(df: DataFrame, title: Column, text: Column) -> DataFrame:
    """Adds section: the type with the highest score, the first of equal ones;
    GENERAL where nothing scores. Scores are columns first, so that none is
    evaluated twice."""
    low = df.withColumns({"low_title__": title, "low_text__": text})
    scored = low.withColumns({f"{k}__": v for k, v in section_scores(F.col("low_title__"), F.col("low_text__")).items()})
    names = [f"{k}__" for k in SECTIONS]
    best = scored.withColumn("best__", F.greatest(*names))
    out = F.lit("GENERAL")
    for kind in reversed(list(SECTIONS)):
        out = F.when(F.col(f"{kind}__") == F.col("best__"), kind).otherwise(out)
    return best.withColumn("section", F.when(F.col("best__") == 0, "GENERAL").otherwise(out)).drop(*names, "best__", "low_title__", "low_text__")


def project(text: Column) -> tuple[Column, Column]:
    """Project type with the most keywords (first of equal ones), and its share."""
    low = F.lower(text)
    scores = {k: reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words)) for k, words in PROJECTS.items()}
    best, total = F.greatest(*scores.values()), reduce(lambda a, b: a + b, scores.values())
    out = F.lit("general")
    for k in reversed(list(scores)):
        out = F.when(scores[k] == best, k).otherwise(out)
    share = F.when(best == 0, 0.5).otherwise(best / total)
    return F.when(best == 0, "general").otherwise(out), share


def pages_of(docs: DataFrame, lines_per_page: int = 20) -> DataFrame:
    """doc_id, page (from 1) and lines: pages of a text, cut without a shuffle."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    n = F.ceil(F.size(lines) / lines_per_page).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(lines, i * lines_per_page + 1, lines_per_page))
    return docs.select("doc_id", F.posexplode(cut).alias("page", "lines")).withColumn("page", F.col("page") + 1)


def page_signals(pages: DataFrame) -> DataFrame:
    """Per page: item rows, split quantity and unit pairs, header words and the
    routing score. Array functions only: a page never leaves its row."""
    lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "")
    p = pages.withColumn("l", lines).withColumn("head", F.lower(F.array_join(F.slice("l", 1, 8), " ")))
    rows = F.size(F.filter("l", lambda x: F.length(x).between(15, 250) & ~x.rlike(SPEC_LINE) & x.rlike(ITEM_LINE) & x.rlike(QUANTITY_UNIT)))
    pairs = F.size(F.filter("l", lambda x, i: x.rlike(NUMBER_LINE) & F.array_join(F.slice("l", i + 2, 5), " ").rlike(r"(?i)\b(cum|kg|sqm|m3|nos|each|set|rmt|lm)\b")))
    spec = F.size(F.filter("l", lambda x: x.rlike(SPEC_LINE)))
    headers = sum((F.when(F.contains("head", F.lit(h)), 2).otherwise(0) for h in HEADERS), F.lit(0))
    p = p.withColumns({"boq_rows": rows, "pairs": pairs, "spec_lines": spec, "header_score": headers, "n_lines": F.size("l")})
    score = (
        F.when(F.col("boq_rows") >= 5, 8.0).when(F.col("boq_rows") >= 3, 5.0).when(F.col("boq_rows") >= 1, 1.0).otherwise(0.0)
        + F.when(F.col("pairs") >= 3, 4.0).when(F.col("pairs") >= 1, 1.5).otherwise(0.0)
        + F.when(F.col("header_score") >= 4, 4.0).when(F.col("header_score") >= 2, 2.0).otherwise(0.0)
        - F.when(F.col("spec_lines") >= 3, 3.0).when(F.col("spec_lines") >= 1, 1.0).otherwise(0.0)
    )
    return p.withColumn("score", score).withColumn("is_boq", (F.col("boq_rows") >= 3) | ((F.col("score") >= 5) & ((F.col("boq_rows") >= 1) | (F.col("pairs") >= 2)))).drop("l", "head", "lines")


def expand_adjacent(signals: DataFrame) -> DataFrame:
    """Adds selected: item pages, and neighbours that show some item signal."""
    w = Window.partitionBy("doc_id").orderBy("page")
    near = F.coalesce(F.lag("is_boq").over(w), F.lit(False)) | F.coalesce(F.lead("is_boq").over(w), F.lit(False))
    return signals.withColumn("selected", F.col("is_boq") | (near & ((F.col("boq_rows") >= 1) | (F.col("header_score") >= 2))))


def coalesce_ranges(ranges: DataFrame, key: str, gap: int = 2) -> DataFrame:
    """Merges ranges (key, start, end) of which one starts at most `gap` after
    what precedes it ends. A running maximum finds the islands."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", (before.isNull() | (F.col("start") > before + gap)).cast("int"))
    islands = opened.withColumn("island", F.sum("opens").over(w))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")

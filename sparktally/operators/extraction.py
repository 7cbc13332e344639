"""Row extraction from lines and sheet rows, and page-level tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Action words in order, and the words of heading scores.
ACTIONS = ["supply", "install", "provide", "fix", "furnish", "erect", "apply", "commission", "lay"]
STRONG = ["schedule of items", "bill of quantities", "boq", "schedule of quantities", "price schedule"]
MEDIUM = ["quantity", "item", "abstract"]
LINE = r"^(.*\D)?(\d[\d,]*(?:\.\d+)?)\s{0,19}(kg|sqm|cum|nos|rmt|mt|ltr|set|each)\b"


def action_of(material: Column) -> Column:
    m, out = F.lower(material), F.lit("supply")
    for a in reversed(ACTIONS):
        out = F.when(m.startswith(a), a).otherwise(out)
    return out


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines with a quantity right before a unit (the last such pair of a line):
    material, quantity, unit and confidence. Bullets and item numbers go."""
    clean = F.trim(F.regexp_replace(F.trim(column), r"^(\d+[.)]\s+|[-*•]\s+)", ""))
    p = lines.withColumn("clean__", clean)
    low = F.lower("clean__")
    material = F.trim(F.regexp_replace(F.trim(F.regexp_extract(low, LINE, 1)), r"[-–—:]+$", ""))
    parsed = p.withColumns({"material": material, "quantity": F.regexp_replace(F.regexp_extract(low, LINE, 2), ",", "").try_cast("double"), "unit": F.regexp_extract(low, LINE, 3)})
    found = parsed.where("length(material) >= 5 AND quantity > 0")
    conf = F.lit(0.75) + F.when(F.col("unit") != "", 0.1).otherwise(0.0) + F.when(F.col("material").rlike(r"\bm\d{2}\b"), 0.05).otherwise(0.0)
    return found.withColumn("confidence", F.round(conf, 2)).drop("clean__")


def heading_score(title: Column, pairs: Column, rows: Column, lines: Column) -> Column:
    """0.5 heading, 0.3 quantity and unit pairs, 0.2 table density; 0 without a heading."""
    t = F.lower(title)
    has = lambda words: reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in words))
    heading = (
        0.45 * has(STRONG)
        + 0.04 * has(MEDIUM)
        + 0.30 * t.rlike(r"schedule\s*-?\s*[a-z]\b").cast("int")
        + 0.15 * t.rlike(r"\bschedule\s+of\b").cast("int")
        + 0.10 * t.rlike(r"\b(annexure|appendix)\s*[-:]?\s*[a-z0-9]+").cast("int")
        - 0.50 * F.contains(t, F.lit("schedule of rates")).cast("int")
    )
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), heading))
    density = F.least(F.lit(1.0), rows / F.greatest(lines, F.lit(1)) * 5)
    return F.when(h < 0.10, 0.0).otherwise(0.5 * h + 0.3 * F.least(F.lit(1.0), pairs / 15) + 0.2 * density)


def merge_name_and_detail(rows: DataFrame) -> DataFrame:
    """A short name row followed by a longer detail row with quantity becomes
    one row; a row is part of one pair only, the earlier one."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    name = F.length("text").between(5, 40) & (F.col("quantity") == 0)
    detail = F.lead(F.col("quantity") > 0).over(w) & (F.lead(F.length("text")).over(w) > F.length("text"))
    paired = rows.withColumn("opens", name & F.coalesce(detail, F.lit(False)))
    tagged = paired.withColumns({"taken": F.coalesce(F.lag("opens").over(w), F.lit(False)), "next_text": F.lead("text").over(w), "next_quantity": F.lead("quantity").over(w)})
    return tagged.where(~F.col("taken")).select(
        "doc_id", "seq", F.when(F.col("opens"), F.concat_ws(" ", "text", "next_text")).otherwise(F.col("text")).alias("text"), F.when(F.col("opens"), F.col("next_quantity")).otherwise(F.col("quantity")).alias("quantity")
    )


def quantity_columns(cells: DataFrame) -> DataFrame:
    """cells (sheet, col_idx, text) -> quantity columns: not the first, at least
    three numbers and half of what is filled, and not a small serial count."""
    number = F.col("text").try_cast("double")
    agg = cells.where("text <> ''").groupBy("sheet", "col_idx").agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("numbers"), F.count_distinct(number).alias("distinct"), F.min(number).alias("least"), F.max(number).alias("most"))
    serial = (F.col("least") == 1) & (F.col("most") == F.col("numbers")) & (F.col("distinct") == F.col("numbers"))
    return agg.where((F.col("col_idx") > 0) & (F.col("numbers") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.5))) & ~serial).select("sheet", "col_idx", "n", "numbers")


def best_quantity(total: Column, others: list[Column]) -> Column:
    """The total if there is one, else the largest positive, else the first."""
    top = F.greatest(*others)
    return F.when(total.isNotNull(), total).when(top > 0, top).otherwise(others[0])


def intro_row(rows: DataFrame) -> Column:
    """Section intros: no quantity, placeholder unit, and a title's shape."""
    unit = F.lower(F.trim("unit_raw")).isin("", "no.", "no", "nos.", "n/a")
    m = F.lower("material")
    return (F.col("quantity") <= 0) & ~F.col("rate_only") & unit & (m.startswith("providing") | m.startswith("supply") | (F.length("material") < 80))


def split_quantities(words: DataFrame, quantities: DataFrame, reach: float = 20.0) -> DataFrame:
    """Words within `reach` of a quantity's height, joined by x: left of 300 the
    material, right of it the consignee. Heights fall into buckets as wide as
    the interval, so the range join has an equality key."""
    width = 2 * reach
    q = quantities.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("qy") - reach) / width), F.floor((F.col("qy") + reach) / width)))))
    w = words.withColumn("bucket", F.floor(F.col("y") / width))
    near = q.join(w, ["doc_id", "bucket"]).where(F.abs(F.col("y") - F.col("qy")) <= reach)
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("x", "text")))), lambda s: s["text"]), " ")
    return near.groupBy("doc_id", "q_id").agg(text(F.col("x") < 300).alias("material"), text(F.col("x") >= 300).alias("consignee"))


def zip_streams(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Pairs the n-th of both streams of a document."""
    l = left.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    r = right.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    return l.join(r, [key, "nth"])


def row_confidence(material: Column, material_conf: Column, quantity_conf: Column, has_quantity: Column, has_unit: Column) -> Column:
    """Tiers by which of material, quantity and unit are there."""
    mean = (material_conf + quantity_conf) / 2
    clamp = lambda lo, x, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return F.round(
        F.when(F.trim(material) == "", 0.1)
        .when((F.length(F.trim(material)) <= 4) & ~has_quantity, 0.3)
        .when(has_quantity & has_unit, clamp(0.7, mean, 1.0))
        .when(has_quantity, clamp(0.5, mean, 0.69))
        .otherwise(clamp(0.3, material_conf * 0.6, 0.49)),
        2,
    )


def strip_headers(text: Column) -> Column:
    """Text without blank, rule, very short and header or footer lines."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: (F.length(F.trim(x)) >= 3) & ~F.trim(x).rlike(r"(?i)^(Confidential|Proprietary|UNCONTROLLED|DRAFT|REV\s+\d+)") & ~x.rlike(r"^\s*[-_=]{3,}\s*$"))
    return F.array_join(kept, "\n")


def completeness(rows: DataFrame) -> DataFrame:
    """Per document: captured and flagged rows as a share of all, and the rest."""
    g = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(F.col("confidence") >= 0.5).alias("captured"), F.count_if((F.col("confidence") < 0.5) & (F.col("confidence") >= 0.2)).alias("flagged"))
    return g.withColumns({"fidelity": (F.col("captured") + F.col("flagged")) / F.col("source_rows"), "dropped": F.greatest(F.lit(0), F.col("source_rows") - F.col("captured") - F.col("flagged"))})


def enforce_schema(raw: DataFrame, column: str) -> DataFrame:
    """JSON rows to typed columns with defaults."""
    p = raw.withColumn("j", F.from_json(column, "item_no string, material string, quantity double, unit string, confidence double"))
    return p.withColumns({
        "item_no": F.coalesce("j.item_no", F.lit("1")), "material": F.coalesce("j.material", F.lit("")), "quantity": F.coalesce("j.quantity", F.lit(0.0)),
        "unit": F.coalesce(F.nullif("j.unit", F.lit("")), F.lit("no.")), "confidence": F.coalesce("j.confidence", F.lit(0.0)),
    }).drop("j", column)

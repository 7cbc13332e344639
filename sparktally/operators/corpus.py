"""Corpus management, calibration, questions and answers, ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def split_of(key: Column, train: float = 0.70, val: float = 0.85) -> Column:
    """Train, val or test by sha256(key) modulo 1000, folded over hex digits."""
    digits = F.filter(F.split(F.sha2(key.cast("string"), 256), ""), lambda c: c != "")
    rest = F.aggregate(F.transform(digits, lambda c: F.conv(c, 16, 10).cast("int")), F.lit(0), lambda a, d: (a * 16 + d) % 1000)
    return F.when(rest < int(train * 1000), "train").when(rest < int(val * 1000), "val").otherwise("test")


def first_of_each(rows: DataFrame, fingerprint: Column, order: list[str]) -> DataFrame:
    """Rows whose fingerprint comes first: an aggregation, then a semi join, so
    that a very common fingerprint is no single task's group."""
    keyed = rows.withColumn("fp__", fingerprint)
    first = keyed.groupBy("fp__").agg(F.min(F.struct(*order)).alias("first__"))
    same = keyed.join(first, "fp__")
    return same.where(F.struct(*order) == F.col("first__")).drop("fp__", "first__")


def fence(train: DataFrame, test: DataFrame, key: Column) -> DataFrame:
    """Rows of train whose key test has, too."""
    return train.withColumn("k__", key).join(test.withColumn("k__", key).select("k__").distinct(), "k__", "left_semi").drop("k__")


def expected_calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Bins are [lo, hi); a confidence of 1 is in none but counts as a sample."""
    b = F.floor(F.col(confidence) * bins)
    per = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    total = F.sum("n").over(Window.partitionBy())  # at most eleven rows
    return per.withColumn("w", F.col("n") / total).where(F.col("bin") < bins).agg(F.sum(F.col("w") * F.abs(F.col("c") - F.col("a"))).alias("ece"))


def entropy(weights: Column) -> Column:
    """Entropy of an array of weights after normalisation."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a - (x / total) * F.log(x / total + 1e-10))


def k_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within `hops` of the start nodes, with the least distance. One join
    per hop, each with the nodes of the hop before only."""
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def translate_terms(rows: DataFrame, term: str, table: DataFrame) -> DataFrame:
    """Terms by a lookup (source, target); unknown ones stay as they are."""
    return rows.join(table.select(F.col("source").alias(term), "target"), term, "left").withColumn(f"{term}_translated", F.coalesce("target", term)).drop("target")


def answer(rows: DataFrame, question: str) -> DataFrame:
    """'total <material>', 'where is <material>' or 'item <number>': a filter,
    with a sum, a grouping by place, or the rows."""
    word, _, rest = question.strip().lower().partition(" ")
    if word == "total":
        hit = rows.where(F.contains(F.lower("material"), F.lit(rest)))
        return hit.agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"))
    if word == "where":
        hit = rows.where(F.contains(F.lower("material"), F.lit(rest.removeprefix("is "))))
        return hit.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"))
    return rows.where(F.col("item_no") == int(rest)).select("doc_id", "line_key", "material", F.col("quantity").cast("double").alias("quantity"))

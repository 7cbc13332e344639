"""Geometry of words on a page: clusters, bands, cells."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def cluster_positions(points: DataFrame, keys: list[str], x: str, gap: float = 3.0) -> DataFrame:
    """Bands of positions of which neighbours are at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(x)
    far = F.coalesce(F.col(x) - F.lag(x).over(w) > gap, F.lit(False))
    bands = points.withColumn("band", F.sum(far.cast("int")).over(w))
    return bands.groupBy(*keys, "band").agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.count(F.lit(1)).alias("n"))


def words_to_cells(words: DataFrame, bands: DataFrame, row_height: float = 20.0) -> DataFrame:
    """Words (doc_id, x, y, text) to cells: the row by y, the band by interval.

    bands (band, x_left, x_right) is a page template of a few rows; the interval
    join is a broadcast of just these. Texts of a cell are joined by x."""
    inside = (F.col("x") >= F.col("x_left") - 1) & (F.col("x") < F.col("x_right") + 1)
    placed = words.join(F.broadcast(bands), inside).withColumn("row", F.floor(F.col("y") / row_height))
    parts = F.array_sort(F.collect_list(F.struct("x", "text")))
    return placed.groupBy("doc_id", "row", "band").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("cell"), F.count(F.lit(1)).alias("n_words"))


def lines_by_anchor(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Words to lines: a word further than `tolerance` below the first word of
    its line opens a new one. The comparison is with the line's first word, not
    with the word before, so it folds the sorted words of a page."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,x:double,text:string>>").alias("out"))

    def step(acc, word):
        opens = acc["anchor"].isNull() | (F.abs(word["y"] - acc["anchor"]) > tolerance)
        line = acc["line"] + opens.cast("int")
        cell = F.struct(line.alias("line"), word["x"].alias("x"), word["text"].alias("text"))
        return F.struct(F.when(opens, word["y"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(cell)).alias("out"))

    pages = words.groupBy("doc_id", "page").agg(ordered.alias("w"))
    folded = pages.select("doc_id", "page", F.explode(F.aggregate("w", start, step, lambda a: a["out"])).alias("o"))
    parts = F.array_sort(F.collect_list(F.struct("o.x", "o.text")))
    return folded.groupBy("doc_id", "page", F.col("o.line").alias("line")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def _digit_columns(words: Iterator[tuple], tolerance: float) -> Iterator[tuple]:
    """(doc_id, cluster, n_digits, digits) of words sorted by (doc_id, x). What is
    too far from the last cluster's mean is too far from those before, so only
    the last one is open, and of it only the digits are kept."""
    doc, cluster, total, n, digits = None, -1, 0.0, 0, []

    def close() -> Iterator[tuple]:
        if len(digits) >= 3 and len(digits) >= 0.5 * n:
            yield doc, cluster, len(digits), "".join(t for *_, t in sorted(digits))

    for d, x, y, text in words:
        if n == 0 or d != doc:
            yield from close()
            doc, cluster, total, n, digits = d, 0, 0.0, 0, []
        elif abs(total / n - x) > tolerance:
            yield from close()
            cluster, total, n, digits = cluster + 1, 0.0, 0, []
        total, n = total + x, n + 1
        if len(text) == 1 and text.isdigit():
            digits.append((y, x, text))
    yield from close()


def digit_columns(words: DataFrame, tolerance: float = 30.0, size: int = 10_000) -> DataFrame:
    """Columns of single digits: clusters around a running mean of x, which
    depends on the order of the words. One shuffle and one sort by document; the
    words stream through, as a Python call for each document costs far more."""
    schema = "doc_id long, cluster int, n_digits int, digits string"
    types = pa.schema([("doc_id", pa.int64()), ("cluster", pa.int32()), ("n_digits", pa.int32()), ("digits", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found = _digit_columns(rows, tolerance)
        while part := list(islice(found, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types.types)], schema=types)

    keys = ["doc_id", "x", "y", "text"]
    return words.select(*keys).repartition(F.xxhash64("doc_id")).sortWithinPartitions(*keys).mapInArrow(run, schema)

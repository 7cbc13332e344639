"""Sources: texts, catalogs, ontologies, gold rows and workbooks.

Everything is read by Spark's own readers, so any store that Spark reaches will
do; workbooks are zipped XML and are parsed where their bytes are.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CELLS = "workbook string, sheet string, row_idx int, cells array<string>, error string"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_ontology(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """JSON entries (an array of objects in a file) by lower-case name and by
    every alias; the last entry wins. A file is read by one task, so ids ascend
    in its order."""
    raw = spark.read.option("multiLine", True).json(path)
    entries = raw.select(name, "aliases", F.monotonically_increasing_id().alias("ord"))
    keyed = entries.select(F.explode(F.array_union(F.array(F.col(name)), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"), name, "ord")
    return keyed.groupBy(F.lower("key").alias("key")).agg(F.max_by(name, "ord").alias(name))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """source, sha256 and size_bytes of files: their provenance."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """products of a JSON catalog, the first row of each name, with the file they
    are from and its hash."""
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("products").alias("p"), F.col("_metadata.file_path").alias("file"))
    w = Window.partitionBy(F.trim(F.lower("name"))).orderBy("row_no")
    products = raw.select("p.*", "file").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    name = lambda c: F.element_at(F.split(c, "/"), -1)  # noqa: E731  # readers spell a file's scheme differently
    hashes = file_hashes(spark, path).select(name("source").alias("source"), "sha256")
    return products.withColumn("source", name(F.col("file"))).drop("file").join(F.broadcast(hashes), "source", "left")  # a row a file


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Row-gold JSON files: one row per entry."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select("doc_id", F.posexplode("entries").alias("idx", "e")).select("doc_id", "idx", "e.item_no", "e.material", "e.quantity", "e.unit")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_workbook(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook's bytes, in its order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            for i, row in enumerate(ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row")):
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_NS}v")
                    if c.get("t") == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif value is not None:
                        cells[at] = value.text or ""
                yield sheet.get("name"), i, cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of all workbooks; a file that can't be read gives one
    row with its error instead of failing the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    rows += [(name, s, i, c, None) for s, i, c in parse_workbook(content.as_py())]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in CELLS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInArrow(run, CELLS)

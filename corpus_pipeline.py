"""Documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; each but the
last has the columns of `documents`. run() writes every stage's result and
reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktally.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from sparktally.llm._shared import forget, new_path, stored, stored_at, written

#: Decisions up to so many rows are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: A document that the line stage takes more than this share of is dropped.
MOST_LOST = 0.8


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name clashes."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(True).alias("boxed__")).alias("rest"))


def _unboxed(boxed: DataFrame, columns: list[str]) -> DataFrame:
    return boxed.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in columns))


def _listed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of docs with stored distinct keys (doc_id, text_key);
    broadcast only while their counted rows are few."""
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_key"))
    return docs.alias("d").join(keys.alias("k"), same, how)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return _listed(docs, stored(keys.select("doc_id", "text_key").distinct(), "dropped"), "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5.

    Only ids and texts go through the classifier; other columns stay where they
    are. Null and empty texts stay; rows that are equal in id and text have one
    score; null ids are scored like others; texts of any length are scored
    whole; where there is nothing to learn, all documents stay; an empty table
    gives no rows."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), model, keep=("doc_id", "text_key"))
    return _without(docs, scored.where("score >= 0.5"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later near-duplicate lines. One that loses all its words,
    or more than MOST_LOST of its characters, goes: it was a copy, and what is
    left are shreds that no longer resemble the original. n_chars follows the
    text. Null and blank texts stay as they are; rows that are equal in id and
    text stay both; the earlier of ties by id keeps its lines, null ids come
    last; an empty table gives no rows."""
    out = line_dedup.remove_lines(_boxed(docs.withColumn("chars__", F.length("text"))))
    left = F.length("text") >= (1 - MOST_LOST) * F.col("rest.chars__")
    out = out.where((F.col("n_removed") == 0) | (F.col("text").rlike(r"[^\x20\x09-\x0D]") & left))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        shorter = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("rest.n_chars"))
        out = out.withColumn("rest", F.col("rest").withField("n_chars", shorter))
    return _unboxed(out, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id."""
    near = stored(jaccard_join.near_duplicates(docs).where("label IS NOT NULL").select("doc_id", "text_key", "label"), "near")
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "text_key")
    first = near.groupBy("label").agg(F.min(key).alias("first"))
    others = near.join(first, "label").where(key != F.col("first")).select("doc_id", "text_key")
    kept = _without(docs, others)
    # Rows that repeat both id and text of the one that stays.
    repeated = stored(near.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = _boxed(_listed(kept, repeated, "left_semi")).dropDuplicates(["doc_id", "text"])
    return _listed(kept, repeated, "left_anti").unionByName(_unboxed(once, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null, empty and wordless texts
    contain none and stay; rows that are equal in id and text go or stay
    together; null ids are looked up like others; long texts are searched whole;
    without items all documents stay; an empty table gives no rows."""
    return _without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their places in sequences of 2048 ids. Every
    row is a document, also a repeated one; a null text is an empty one, of its
    closing id; long ones are cut, not shortened; an empty table gives no rows."""
    return packing.placements(packing.pack(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and token ids have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        docs = stored_at(stage(spark, docs, sf_dir), path)
        forget(spark, before, keep=path)  # the stage's own tables and its input
    return STAGES[-1][1](spark, docs, sf_dir)

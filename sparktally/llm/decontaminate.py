"""Operator 4: benchmark passages in documents, by size-partitioned MinHash
containment search and exact shingle containment. DataFrame operations only.

Comparing MinHash signatures of a 30-word item and a 20,000-word document says
nothing, so the sketch is one-sided. Items are partitioned by size (powers of
two); an item's sketch is its s least shingles by hash, and a document is
looked up in full. An item that a document contains to at least `threshold` is
short of at most floor((1 - threshold) * q) of its q shingles, so s is that
number plus the hits its size class asks for: no containment is missed, and
chance hits are few. Candidates are then verified on the shingles' texts.

The sketch table is broadcast only while its counted rows are within
broadcast_rows, and so are the candidates; beyond that both are joined by
shuffles.

Defined results: words are runs of letters and digits, in lower case; an item
of fewer than five words is one shingle of all its words; null or wordless
items and documents match nothing; documents equal in id and text are one;
an item is a distinct pair of id and words, so that every text of a repeated or
null id is searched, and a document has a row for each one that it contains;
empty tables give no rows; other columns are ignored. (The SQL takes ids as
unique and not null.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import stored

NOT_WORD = r"[^\p{L}\p{N}]+"
SHINGLE = 5


def text_words(column: str) -> Column:
    return F.filter(F.split(F.lower(F.col(column)), NOT_WORD), lambda w: w != "")


def _starts(words: Column, n: int) -> Column:
    """Places (from 0) at which a shingle of n words starts."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def hashed(words: Column, n: int) -> Column:
    return F.transform(_starts(words, n), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(n))))


def spelled(words: Column, n: int) -> Column:
    return F.transform(_starts(words, n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def items_of(benchmark: DataFrame, threshold: float) -> DataFrame:
    """benchmark (item_id, text) -> item (hash of id and words), item_id, n (words
    of a shingle), grams (distinct texts), keys (their hashes, least first), q,
    need and size class."""
    words = (
        benchmark.select("item_id", text_words("text").alias("w")).distinct()
        .withColumn("item", F.xxhash64("item_id", "w"))
        .withColumn("n", F.least(F.lit(SHINGLE), F.size("w")))
        .where("n > 0")
    )
    grams, keys = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    for n in range(SHINGLE, 0, -1):
        grams = F.when(F.col("n") == n, spelled(F.col("w"), n)).otherwise(grams)
        keys = F.when(F.col("n") == n, hashed(F.col("w"), n)).otherwise(keys)
    out = words.select("item", "item_id", "n", F.array_distinct(grams).alias("grams"), F.sort_array(F.array_distinct(keys)).alias("keys"))
    miss = F.floor((1 - threshold) * F.size("grams") + 1e-9).cast("int")
    return (
        out.withColumn("q", F.size("grams"))
        .withColumn("size_class", F.floor(F.log2("q")).cast("int"))
        .withColumn("sketch", F.least(F.col("q"), miss + F.expr("greatest(1, cast(pow(2, size_class - 3) AS int))")))
        .withColumn("need", F.col("sketch") - miss)
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, text_key (hash
    of the text), item_id, n_item_shingles, n_shared, containment."""
    items = stored(items_of(benchmark, threshold), "items")
    sizes = items.groupBy("n").agg(F.sum("sketch").alias("rows")).collect()  # at most five rows
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_words("text").alias("w"))
    sketch = items.select("n", "item", "need", F.explode(F.slice("keys", F.lit(1), F.col("sketch"))).alias("key"))
    found = []
    for n in sorted(r.n for r in sizes):
        total = next(r.rows for r in sizes if r.n == n)
        hits = rows.select("doc_id", "text_key", F.explode(hashed(F.col("w"), n)).alias("key"))
        hits = hits.join(_small(sketch.where(F.col("n") == n), total, broadcast_rows), "key")
        found.append(hits.groupBy("doc_id", "text_key", "item").agg(F.count_distinct("key").alias("hits"), F.first("need").alias("need")).where("hits >= need"))
    empty = items.limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), "item")
    pairs = empty.select(*(F.col(c).cast(t) for c, t in (("doc_id", dict(docs.dtypes)["doc_id"]), ("text_key", "bigint"))), "item")
    for f in found:
        pairs = pairs.unionByName(f.select("doc_id", "text_key", "item"))
    pairs = stored(pairs, "candidates")
    # Verification: the candidates' documents again, with their shingles' texts.
    by_doc = pairs.groupBy("doc_id", "text_key").agg(F.collect_set("item").alias("items"))  # at most all items
    n_docs = pairs.select("doc_id", "text_key").distinct().count()
    texts = docs.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text").alias("d")
    small = _small(by_doc, n_docs, broadcast_rows).alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key"))
    matched = texts.join(small, same).select("d.doc_id", "d.text_key", "text", "items").dropDuplicates(["doc_id", "text_key"])
    matched = matched.select("doc_id", "text_key", "items", text_words("text").alias("w"))
    ns = [r.n for r in sizes]
    own = matched.select("doc_id", "text_key", "items", *(F.array_distinct(spelled(F.col("w"), n)).alias(f"own{n}") for n in ns))
    own = own.select("doc_id", "text_key", *(f"own{n}" for n in ns), F.explode("items").alias("item"))
    n_items = items.count()
    full = own.join(_small(items.select("item", "item_id", "n", "grams", "q"), n_items, broadcast_rows // 50), "item")
    shared = F.lit(0)
    for n in ns:
        shared = F.when(F.col("n") == n, F.size(F.array_intersect("grams", f"own{n}"))).otherwise(shared)
    return (
        full.select("doc_id", "text_key", "item_id", F.col("q").cast("long").alias("n_item_shingles"), shared.cast("long").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
        .where(F.col("n_shared") >= threshold * F.col("n_item_shingles") - 1e-9)
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents, all pairs of 0.8 and more."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", F.round("containment", 6).alias("containment"))


#: DuckDB for op4_decontaminate.
SQL4 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
bn AS (SELECT item_id, ws, least(5, len(ws)) AS n FROM b WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)),
k AS (SELECT DISTINCT n FROM bn),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN k WHERE len(ws) >= n)),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id)
SELECT doc_id, item_id, q AS n_item_shingles, count(*) AS n_shared, round(count(*) / q, 6) AS containment
FROM ds JOIN bs USING (n, g) JOIN q USING (item_id) GROUP BY doc_id, item_id, q HAVING count(*) >= 0.8 * q - 1e-9
"""

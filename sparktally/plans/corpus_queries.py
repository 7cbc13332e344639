"""Queries over the corpus, labels, exports, events and the ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.units import normalize_units
from ..operators import corpus as co
from ..sources import sinks
from ..streaming import intake
from .bridge import BOQ, boq_rows, boq_units
from .registry import query, table


@query(
    "deterministic_split",
    """SELECT doc_id, CASE WHEN r < 700 THEN 'train' WHEN r < 850 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id,
       list_reduce(list_transform(string_split(sha256(cast(doc_id AS varchar)), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 1000) AS r FROM documents)""",
)
def deterministic_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", co.split_of(F.col("doc_id")).alias("split"))


@query("fingerprint_dedup", "SELECT min(doc_id) AS doc_id, md5(text) AS fp FROM documents GROUP BY md5(text)")
def fingerprint_dedup(spark, sf):
    return co.first_of_each(table(spark, sf, "documents"), F.md5("text"), ["doc_id"]).select("doc_id", F.md5("text").alias("fp"))


@query(
    "leakage_fence",
    "SELECT doc_id, text_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text_line FROM documents) WHERE text_line IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark)",
)
def leakage_fence(spark, sf):
    """Lines of documents that benchmark items have, too."""
    lines = lambda t: table(spark, sf, t).select("*", F.explode(F.split("text", "\n")).alias("text_line"))
    return co.fence(lines("documents"), lines("benchmark"), F.col("text_line")).select("doc_id", "text_line")


@query("corpus_sweep", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def corpus_sweep(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    "union_sources",
    "SELECT source, count(*) AS n FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY source",
)
def union_sources(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("source"), "text") for t in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("split_disjoint", "SELECT count(*) AS n_common FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def split_disjoint(spark, sf):
    return table(spark, sf, "documents").select("text").intersect(table(spark, sf, "benchmark").select("text")).agg(F.count(F.lit(1)).alias("n_common"))


@query(
    "ece",
    """WITH s AS (SELECT d.n_chars % 101 / 100.0::double AS conf, l.quality FROM labels l JOIN documents d USING (doc_id)),
       b AS (SELECT cast(floor(conf * 10) AS int) AS bin, count(*) AS n, avg(conf) AS c, avg(quality) AS a FROM s GROUP BY 1)
       SELECT round(sum(n / t * abs(c - a)) FILTER (bin < 10), 6) AS ece FROM (SELECT *, sum(n) OVER () AS t FROM b)""",
)
def ece(spark, sf):
    s = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((F.col("n_chars") % 101 / 100).alias("conf"), "quality")
    return co.expected_calibration_error(s, "conf", "quality").select(F.round("ece", 6).alias("ece"))


@query(
    "calibration_quantile",
    """SELECT toxic, round(quantile_cont(abs(d.n_chars % 101 / 100.0::double - quality), 0.95), 6) AS q95, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY toxic HAVING count(*) >= 10""",
)
def calibration_quantile(spark, sf):
    s = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").withColumn("r", F.abs(F.col("n_chars") % 101 / 100 - F.col("quality")))
    return s.groupBy("toxic").agg(F.round(F.percentile("r", 0.95), 6).alias("q95"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("uncertainty_histogram", f"SELECT cast(floor((line_key * 13 % 40) / 40.0 * 5) AS bigint) AS bin, count(*) AS n FROM {BOQ} GROUP BY 1")
def uncertainty_histogram(spark, sf):
    return boq_rows(spark, sf).groupBy(F.floor(F.col("line_key") * 13 % 40 / 40 * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "entropy_score",
    f"""SELECT line_key, round(-(a / t * ln(a / t + 1e-10) + b / t * ln(b / t + 1e-10) + c / t * ln(c / t + 1e-10)), 6) AS entropy, round((greatest(a, b, c) - (t - greatest(a, b, c) - least(a, b, c))) / t, 6) AS margin
        FROM (SELECT *, a + b + c AS t FROM (SELECT line_key, part % 7 + 1::double AS a, part % 5 + 1::double AS b, item_no + 1::double AS c FROM {BOQ}))""",
)
def entropy_score(spark, sf):
    w = F.array(*(F.expr(f"cast({e} AS double)") for e in ("part % 7 + 1", "part % 5 + 1", "item_no + 1")))
    s = boq_rows(spark, sf).select("line_key", w.alias("w")).withColumn("d", F.sort_array("w", False))
    margin = (F.col("d")[0] - F.col("d")[1]) / (F.col("d")[0] + F.col("d")[1] + F.col("d")[2])
    return s.select("line_key", F.round(co.entropy(F.col("w")), 6).alias("entropy"), F.round(margin, 6).alias("margin"))


@query("qa_total", f"SELECT count(*) AS n, cast(sum(quantity) AS double) AS quantity FROM {BOQ} WHERE contains(lower(material), 'steel')")
def qa_total(spark, sf):
    return co.answer(boq_rows(spark, sf), "total steel")


@query("qa_group_by_location", f"SELECT location, count(*) AS n, cast(sum(quantity) AS double) AS quantity FROM {BOQ} WHERE contains(lower(material), 'cement') GROUP BY location")
def qa_group_by_location(spark, sf):
    return co.answer(boq_rows(spark, sf), "where is cement")


@query("qa_item_lookup", f"SELECT doc_id, line_key, material, cast(quantity AS double) AS quantity FROM {BOQ} WHERE item_no = 3")
def qa_item_lookup(spark, sf):
    return co.answer(boq_rows(spark, sf), "item 3")


@query(
    "ontology_khop",
    """WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part UNION SELECT DISTINCT p_type, p_brand FROM part),
       r AS (SELECT 'Brand#1' AS node, 0 AS distance UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 3)
       SELECT node, min(distance) AS distance FROM r GROUP BY node""",
)
def ontology_khop(spark, sf):
    part = table(spark, sf, "part")
    e = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).unionByName(part.select(F.col("p_type").alias("src"), F.col("p_brand").alias("dst"))).distinct()
    return co.k_hops(e, spark.createDataFrame([("Brand#1",)], "node string"), 3)


_TERMS = [("gear", "गियर"), ("bolt", "बोल्ट"), ("nut", "नट"), ("pipe", "पाइप"), ("valve", "वाल्व")]


@query(
    "translate_lookup",
    f"SELECT p_partkey, word, coalesce(target, word) AS word_translated FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS word FROM part) LEFT JOIN (VALUES {', '.join(str(t) for t in _TERMS)}) t(source, target) ON source = word",
)
def translate_lookup(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"))
    return co.translate_terms(words, "word", spark.createDataFrame(_TERMS, "source string, target string"))


@query(
    "csv_projection",
    f"""SELECT cast(doc_id AS varchar) AS doc_id, cast(item_no AS varchar) AS item_no, material, CASE WHEN quantity = 0 THEN '' ELSE regexp_replace(regexp_replace(cast(quantity AS varchar), '0+$', ''), '\\.$', '') END AS quantity,
        unit_raw AS unit, 'supply' AS action, coalesce(grade, '') AS grade, '' AS dimensions, coalesce(standard, '') AS standard, coalesce(location, '') AS location,
        printf('%.2f', confidence) AS confidence, cast(rate_only AS varchar) AS rate_only, cast(page AS varchar) AS source_pages FROM {BOQ}""",
)
def csv_projection(spark, sf):
    return sinks.csv_columns(boq_rows(spark, sf))


@query("json_export", None)
def json_export(spark, sf):
    """One JSON document per document; tests parse it back."""
    return sinks.json_result(boq_rows(spark, sf))


@query(
    "sap_projection",
    f"""SELECT doc_id, line_key, lpad(cast(10 * row_number() OVER (PARTITION BY doc_id ORDER BY item_no, line_key) AS varchar), 5, '0') AS item_num,
        CASE unit_canonical WHEN 'sqm' THEN 'M2' WHEN 'cum' THEN 'M3' WHEN 'kg' THEN 'KG' WHEN 'mt' THEN 'TO' WHEN 'rmt' THEN 'M' WHEN 'ltr' THEN 'L' ELSE 'EA' END AS sap_unit FROM {boq_units()}""",
)
def sap_projection(spark, sf):
    return sinks.sap_items(normalize_units(boq_rows(spark, sf), "unit_raw"))


@query(
    "ifc_projection",
    f"""SELECT CASE unit_dimension WHEN 'length' THEN 'IfcQuantityLength' WHEN 'area' THEN 'IfcQuantityArea' WHEN 'volume' THEN 'IfcQuantityVolume' WHEN 'mass' THEN 'IfcQuantityWeight'
        WHEN 'time' THEN 'IfcQuantityTime' ELSE 'IfcQuantityCount' END AS kind, count(*) AS n FROM {boq_units()} GROUP BY 1""",
)
def ifc_projection(spark, sf):
    return normalize_units(boq_rows(spark, sf), "unit_raw").groupBy(sinks.ifc_quantity(F.col("unit_dimension")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "schedule_projection",
    f"SELECT doc_id, line_key, concat('WBS.', doc_id) AS wbs, concat('A', lpad(cast(item_no AS varchar), 4, '0')) AS activity, replace(replace(replace(material, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name FROM {BOQ}",
)
def schedule_projection(spark, sf):
    return sinks.activities(boq_rows(spark, sf))


@query("stream_intake_dedup", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY event_type")
def stream_intake_dedup(spark, sf):
    """The intake's duplicate rule over all events, as a table."""
    return intake.without_repeats(table(spark, sf, "events"), ["user_id", "event_type", "props"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return intake.windowed(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf):
    return intake.sessions(table(spark, sf, "events"))


@query(
    "extractor_arbitration",
    f"""WITH b AS (SELECT doc_id, 'plain' AS branch, 0 AS pref, confidence, quantity FROM {BOQ} WHERE page <= 2 UNION ALL SELECT doc_id, 'column_aware', 1, confidence, quantity FROM {BOQ} WHERE page >= 2),
        s AS (SELECT doc_id, branch, pref, count(*) FILTER (quantity > 0) AS good, count(*) AS n, avg(confidence) AS c FROM b GROUP BY ALL)
        SELECT doc_id, branch, good, n FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY good DESC, n DESC, c DESC, pref DESC) = 1""",
)
def extractor_arbitration(spark, sf):
    """The better of two extractions per document; equal ones go to the column-aware.

    Averages are of doubles, as in its SQL, added in ascending order: a result
    that its SQL can give, whatever the order of rows."""
    b = boq_rows(spark, sf).select("doc_id", "confidence", "quantity", F.explode(F.array_compact(F.array(F.when(F.col("page") <= 2, "plain"), F.when(F.col("page") >= 2, "column_aware")))).alias("branch"))
    s = b.groupBy("doc_id", "branch").agg(F.count_if(F.col("quantity") > 0).alias("good"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("confidence")).alias("all"))
    s = s.withColumn("c", F.aggregate("all", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    order = F.struct("good", "n", "c", (F.col("branch") == "column_aware").alias("pref"))
    return s.groupBy("doc_id").agg(F.max_by(F.struct("branch", "good", "n"), order).alias("b")).select("doc_id", "b.branch", "b.good", "b.n")

"""Queries over row extraction and page-level tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extraction as ex
from .bridge import BOQ, boq_rows
from .registry import query, table
from .structure_queries import _SHEET, _WORDS, page_words, sheet

_ACTION = "CASE " + " ".join(f"WHEN starts_with(lower(material), '{a}') THEN '{a}'" for a in ex.ACTIONS) + " ELSE 'supply' END"


@query("action_detect", f"SELECT {_ACTION} AS action, count(*) AS n FROM {BOQ} GROUP BY 1")
def action_detect(spark, sf):
    return boq_rows(spark, sf).groupBy(ex.action_of(F.col("material")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


_LINES = f"(SELECT line_key, concat(item_no, '. ', material, ' - ', cast(cast(quantity AS int) AS varchar), ' ', CASE part % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'Nos' WHEN 2 THEN 'sqm' ELSE 'lots' END) AS line FROM {BOQ})"


@query(
    "text_line_extract",
    rf"""SELECT line_key, material, quantity, unit, round(0.75 + 0.1 + CASE WHEN regexp_matches(material, '\bm\d{{2}}\b') THEN 0.05 ELSE 0 END, 2)::double AS confidence FROM (SELECT line_key,
        trim(regexp_replace(trim(regexp_extract(l, '{ex.LINE}', 1)), '[-–—:]+$', '')) AS material, try_cast(replace(regexp_extract(l, '{ex.LINE}', 2), ',', '') AS double) AS quantity, regexp_extract(l, '{ex.LINE}', 3) AS unit
        FROM (SELECT line_key, lower(trim(regexp_replace(trim(line), '^(\d+[.)]\s+|[-*•]\s+)', ''))) AS l FROM {_LINES})) WHERE length(material) >= 5 AND quantity > 0""",
)
def text_line_extract(spark, sf):
    line = F.concat(F.col("item_no").cast("string"), F.lit(". "), "material", F.lit(" - "), F.col("quantity").cast("int").cast("string"), F.lit(" "), F.expr("CASE part % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'Nos' WHEN 2 THEN 'sqm' ELSE 'lots' END"))
    return ex.parse_lines(boq_rows(spark, sf).select("line_key", line.alias("line"))).drop("line")


_TITLES = ["Schedule of Items", "Schedule - B Bill of Quantities", "Schedule of Rates", "Annexure 3 item", "General"]
_TITLE = "[" + ", ".join(f"'{t}'" for t in _TITLES) + f"][l_orderkey % {len(_TITLES)} + 1]"
_HEADING = " + ".join(f"0.45 * contains(t, '{w}')::int" for w in ex.STRONG) + " + " + " + ".join(f"0.04 * contains(t, '{w}')::int" for w in ex.MEDIUM)


@query(
    "heading_score",
    rf"""SELECT l_orderkey AS doc_id, round(CASE WHEN h < 0.1 THEN 0 ELSE 0.5 * h + 0.3 * least(1.0, pairs / 15) + 0.2 * least(1.0, rows_ / greatest(n, 1) * 5) END, 6) AS score FROM (SELECT *, greatest(0.0, least(1.0,
        {_HEADING} + 0.30 * regexp_matches(t, 'schedule\s*-?\s*[a-z]\b')::int + 0.15 * regexp_matches(t, '\bschedule\s+of\b')::int
        + 0.10 * regexp_matches(t, '\b(annexure|appendix)\s*[-:]?\s*[a-z0-9]+')::int - 0.50 * contains(t, 'schedule of rates')::int))::double AS h
        FROM (SELECT l_orderkey, lower({_TITLE}) AS t, count(*) AS n, count(*) FILTER (l_quantity > 20) AS pairs, count(*) FILTER (l_linenumber <= 2) AS rows_ FROM lineitem GROUP BY l_orderkey))""",
)
def heading_score(spark, sf):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("l_orderkey") % len(_TITLES) + 1).cast("int"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 20).alias("pairs"), F.count_if(F.col("l_linenumber") <= 2).alias("rows"))
    return g.select(F.col("l_orderkey").alias("doc_id"), F.round(ex.heading_score(title, F.col("pairs"), F.col("rows"), F.col("n")), 6).alias("score"))


@query(
    "name_detail_merge",
    f"""WITH s AS (SELECT doc_id, seq, material AS text, cast(quantity AS double) AS quantity FROM {_SHEET}),
        l AS (SELECT *, lead(quantity) OVER w AS nq, lead(text) OVER w AS nt FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
        o AS (SELECT *, length(text) BETWEEN 5 AND 40 AND quantity = 0 AND coalesce(nq > 0 AND length(nt) > length(text), false) AS opens FROM l),
        t AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY seq), false) AS taken FROM o)
        SELECT doc_id, seq, CASE WHEN opens THEN concat(text, ' ', nt) ELSE text END AS text, CASE WHEN opens THEN nq ELSE quantity END AS quantity FROM t WHERE NOT taken""",
)
def name_detail_merge(spark, sf):
    return ex.merge_name_and_detail(sheet(spark, sf).select("doc_id", "seq", F.col("material").alias("text"), F.col("quantity").cast("double").alias("quantity")))


@query(
    "quantity_columns",
    f"""WITH c AS (SELECT part % 50 AS sheet, unnest([0, 1, 2]) AS col_idx, unnest([cast(item_no AS varchar), material, cast(quantity AS varchar)]) AS text FROM {BOQ}),
        a AS (SELECT sheet, col_idx, count(*) AS n, count(try_cast(text AS double)) AS numbers, count(DISTINCT try_cast(text AS double)) AS d, min(try_cast(text AS double)) AS lo, max(try_cast(text AS double)) AS hi FROM c WHERE text <> '' GROUP BY ALL)
        SELECT sheet, col_idx, n, numbers FROM a WHERE col_idx > 0 AND numbers >= greatest(3, ceil(n * 0.5)) AND NOT (lo = 1 AND hi = numbers AND d = numbers)""",
)
def quantity_columns(spark, sf):
    cells = F.posexplode(F.array(F.col("item_no").cast("string"), F.col("material"), F.col("quantity").cast("string"))).alias("col_idx", "text")
    return ex.quantity_columns(boq_rows(spark, sf).select((F.col("part") % 50).alias("sheet"), cells))


@query(
    "best_quantity",
    f"""SELECT line_key, cast(CASE WHEN part % 5 = 0 THEN quantity * 2 WHEN greatest(quantity, item_no - 3) > 0 THEN greatest(quantity, item_no - 3) ELSE quantity END AS double) AS quantity FROM {BOQ}""",
)
def best_quantity(spark, sf):
    total = F.when(F.col("part") % 5 == 0, F.col("quantity").cast("double") * 2)
    return boq_rows(spark, sf).select("line_key", ex.best_quantity(total, [F.col("quantity").cast("double"), (F.col("item_no") - 3).cast("double")]).alias("quantity"))


@query(
    "intro_rows",
    f"""SELECT doc_id, count(*) FILTER (quantity <= 0 AND NOT rate_only AND lower(trim(unit_raw)) IN ('', 'no.', 'no', 'nos.', 'n/a') AND (starts_with(lower(material), 'providing') OR starts_with(lower(material), 'supply') OR length(material) < 80)) AS n_intro FROM {BOQ} GROUP BY doc_id""",
)
def intro_rows(spark, sf):
    b = boq_rows(spark, sf)
    return b.groupBy("doc_id").agg(F.count_if(ex.intro_row(b)).alias("n_intro"))


@query(
    "split_quantities",
    f"""WITH q AS (SELECT doc_id, line_key AS q_id, y AS qy FROM {_WORDS} WHERE line_key % 3 = 0)
        SELECT doc_id, q_id, coalesce(string_agg(text, ' ' ORDER BY x, text) FILTER (x < 300), '') AS material, coalesce(string_agg(text, ' ' ORDER BY x, text) FILTER (x >= 300), '') AS consignee
        FROM q JOIN {_WORDS} w USING (doc_id) WHERE abs(w.y - q.qy) <= 20 GROUP BY doc_id, q_id""",
)
def split_quantities(spark, sf):
    """Items whose key says that their quantity stands apart are the quantities."""
    w = page_words(spark, sf)
    q = w.where("line_key % 3 = 0").select("doc_id", F.col("line_key").alias("q_id"), F.col("y").alias("qy"))
    return ex.split_quantities(w.select("doc_id", "x", "y", "text"), q)


@query(
    "positional_zip",
    f"""WITH a AS (SELECT doc_id, line_key AS a_key, row_number() OVER (PARTITION BY doc_id ORDER BY line_key) AS nth FROM {BOQ} WHERE quantity = 0), b AS (SELECT doc_id, line_key AS b_key, row_number() OVER (PARTITION BY doc_id ORDER BY line_key) AS nth FROM {BOQ} WHERE quantity > 9)
        SELECT doc_id, nth, a_key, b_key FROM a JOIN b USING (doc_id, nth)""",
)
def positional_zip(spark, sf):
    b = boq_rows(spark, sf)
    return ex.zip_streams(b.where("quantity = 0").select("doc_id", F.col("line_key").alias("a_key")), b.where("quantity > 9").select("doc_id", F.col("line_key").alias("b_key")), "doc_id", "a_key", "b_key")


@query(
    "row_confidence",
    f"""SELECT line_key, CASE WHEN length(trim(material)) <= 4 AND NOT q THEN 0.3 WHEN q AND u THEN round(greatest(0.7, least(1.0, m)), 2) WHEN q THEN round(greatest(0.5, least(0.69, m)), 2) ELSE round(greatest(0.3, least(0.49, confidence * 0.6)), 2) END::double AS row_conf
        FROM (SELECT *, quantity > 0 AS q, unit_raw <> '' AS u, (confidence + 0.8125) / 2 AS m FROM {BOQ})""",
)
def row_confidence(spark, sf):
    c = ex.row_confidence(F.col("material"), F.col("confidence"), F.lit(0.8125), F.col("quantity") > 0, F.col("unit_raw") != "")
    return boq_rows(spark, sf).select("line_key", c.alias("row_conf"))


@query(
    "header_footer_strip",
    r"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 3 AND NOT regexp_matches(trim(x), '(?i)^(Confidential|Proprietary|UNCONTROLLED|DRAFT|REV\s+\d+)') AND NOT regexp_matches(x, '^\s*[-_=]{3,}\s*$')), chr(10))) AS kept_md5 FROM documents""",
)
def header_footer_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(ex.strip_headers(F.col("text"))).alias("kept_md5"))


@query(
    "completeness",
    f"""SELECT doc_id, source_rows, captured, flagged, round((captured + flagged) / source_rows, 6) AS fidelity, greatest(0, source_rows - captured - flagged) AS dropped FROM
        (SELECT doc_id, count(*) AS source_rows, count(*) FILTER (confidence >= 0.5) AS captured, count(*) FILTER (confidence < 0.5 AND confidence >= 0.2) AS flagged FROM {BOQ} GROUP BY doc_id)""",
)
def completeness(spark, sf):
    return ex.completeness(boq_rows(spark, sf)).withColumn("fidelity", F.round("fidelity", 6))


@query(
    "schema_enforce",
    f"SELECT line_key, '1' AS item_no, material, CASE WHEN part % 2 = 0 THEN cast(quantity AS double) ELSE 0 END AS quantity, CASE WHEN unit_raw = '' THEN 'no.' ELSE unit_raw END AS unit, 0.0::double AS confidence FROM {BOQ}",
)
def schema_enforce(spark, sf):
    q = F.when(F.col("part") % 2 == 0, F.col("quantity").cast("double"))
    raw = F.to_json(F.struct("material", q.alias("quantity"), F.col("unit_raw").alias("unit")))
    return ex.enforce_schema(boq_rows(spark, sf).select("line_key", raw.alias("raw")), "raw")


@query("scanned_pages", "SELECT count(*) AS n, count(*) FILTER (length(text) < 50) AS n_scanned FROM documents")
def scanned_pages(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < 50).alias("n_scanned"))


@query(
    "multi_column_pages",
    f"""WITH m AS (SELECT doc_id, median(x) AS mid FROM {_WORDS} GROUP BY doc_id) SELECT doc_id, count(*) FILTER (x < mid - 50) AS n_left, count(*) FILTER (x > mid + 50) AS n_right FROM {_WORDS} JOIN m USING (doc_id) GROUP BY doc_id""",
)
def multi_column_pages(spark, sf):
    w = page_words(spark, sf)
    m = w.groupBy("doc_id").agg(F.percentile("x", 0.5).alias("mid"))
    return w.join(m, "doc_id").groupBy("doc_id").agg(F.count_if(F.col("x") < F.col("mid") - 50).alias("n_left"), F.count_if(F.col("x") > F.col("mid") + 50).alias("n_right"))


@query(
    "sentence_priority",
    """SELECT doc_id, i, score FROM (SELECT doc_id, i, len(regexp_extract_all(s, '[0-9]+')) * 2.0 + len(string_split(s, ' ')) * 0.1 - CASE WHEN contains(lower(s), 'http') THEN 1.5 ELSE 0 END AS score FROM
       (SELECT doc_id, i, ls[i] AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))) ORDER BY score DESC, doc_id, i LIMIT 50""",
)
def sentence_priority(spark, sf):
    """A top-k report: the 50 lines most worth labelling."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    score = F.regexp_count("s", F.lit("[0-9]+")) * 2.0 + F.size(F.split("s", " ")) * 0.1 - F.when(F.contains(F.lower("s"), F.lit("http")), 1.5).otherwise(0.0)
    return lines.select("doc_id", (F.col("i") + 1).alias("i"), score.alias("score")).orderBy(F.desc("score"), "doc_id", "i").limit(50)


@query("nth_row_split", f"SELECT doc_id, count(*) FILTER (seq % 5 = 0) AS n_dev, count(*) FILTER (seq % 5 <> 0) AS n_train FROM {_SHEET} GROUP BY doc_id")
def nth_row_split(spark, sf):
    return sheet(spark, sf).groupBy("doc_id").agg(F.count_if(F.col("seq") % 5 == 0).alias("n_dev"), F.count_if(F.col("seq") % 5 != 0).alias("n_train"))


@query("text_nfkc")
def text_nfkc(spark, sf):
    """NFKC has no SQL form; a test compares it with Python's."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.nfkc(F.col("text"))).alias("nfkc_md5"))

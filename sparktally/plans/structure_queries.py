"""Queries over sheets, layout and spans built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import layout, sheets, spans as sp
from .bridge import BOQ, boq_rows
from .registry import query, table

# A sheet row per line item; every third row of a document carries on the row before.
_CODE = "concat(part % 3 + 1, CASE WHEN item_no % 2 = 0 THEN concat('.', part % 4 + 1, CASE WHEN item_no % 4 = 0 THEN '.1' ELSE '' END) ELSE '' END)"
_SEQ = "row_number() OVER (PARTITION BY doc_id ORDER BY item_no, line_key, quantity, price)"
_SHEET = f"(SELECT doc_id, {_SEQ} AS seq, material, {_CODE} AS code, quantity, unit_raw, part FROM {BOQ})"


def sheet(spark, sf):
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_no", "line_key", "quantity", "price"))
    code = F.expr(_CODE.replace("concat(", "concat("))
    return boq_rows(spark, sf).select("doc_id", seq.alias("seq"), "material", code.alias("code"), "quantity", "unit_raw", "part")


@query(
    "wrapped_rows",
    f"""SELECT doc_id, min(seq) AS seq, string_agg(material, ' ' ORDER BY seq) AS text, count(*) AS n_rows FROM
        (SELECT *, sum(CASE WHEN seq % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM {_SHEET}) GROUP BY doc_id, island""",
)
def wrapped_rows(spark, sf):
    return sheets.join_wrapped(sheet(spark, sf), "seq", "material", F.col("seq") % 3 != 0).drop("island")


@query(
    "parent_context",
    f"""WITH s AS (SELECT doc_id, seq, material, code, string_split(code, '.') AS p FROM {_SHEET}),
        n AS (SELECT doc_id, code AS prefix, arg_max(material, seq) AS name FROM s GROUP BY ALL),
        x AS (SELECT doc_id, seq, lvl, array_to_string(p[1:lvl], '.') AS prefix FROM (SELECT *, unnest(range(1, len(p) + 1)) AS lvl FROM s))
        SELECT doc_id, seq, string_agg(name, ' > ' ORDER BY lvl) AS context FROM x JOIN n USING (doc_id, prefix) GROUP BY doc_id, seq""",
)
def parent_context(spark, sf):
    return sheets.with_parents(sheet(spark, sf), "code", "material")


@query(
    "hierarchical_sort",
    f"""SELECT doc_id, seq, code, row_number() OVER (PARTITION BY doc_id ORDER BY list_reduce(list_transform(string_split(code, '.'), lambda x: cast(x AS bigint)), lambda a, b: a * 100 + b), seq) AS nth FROM {_SHEET}""",
)
def hierarchical_sort(spark, sf):
    s = sheet(spark, sf).withColumn("key", sheets.hierarchy_key(F.col("code")))
    w = Window.partitionBy("doc_id").orderBy(F.col("key").asc_nulls_last(), "seq")
    return s.select("doc_id", "seq", "code", F.row_number().over(w).alias("nth"))


@query(
    "wide_matrix_unpivot",
    f"""WITH w AS (SELECT line_key, cast(quantity AS double) AS ground, CASE WHEN part % 3 = 0 THEN part % 10 ELSE 0 END::double AS first, CASE WHEN part % 4 = 1 THEN 2.5 ELSE 0 END::double AS roof FROM {BOQ}),
        l AS (SELECT line_key, unnest(['ground', 'first', 'roof']) AS source, unnest([ground, first, roof]) AS quantity FROM w)
        SELECT line_key, source, quantity, 0.95::double AS confidence FROM l WHERE quantity > 0
        UNION ALL SELECT line_key, 'ground', ground, 0.70::double FROM w WHERE ground <= 0 AND first <= 0 AND roof <= 0""",
)
def wide_matrix_unpivot(spark, sf):
    w = boq_rows(spark, sf).selectExpr("line_key", "quantity AS ground", "CASE WHEN part % 3 = 0 THEN part % 10 ELSE 0 END AS first", "CASE WHEN part % 4 = 1 THEN 2.5 ELSE 0 END AS roof")
    return sheets.unpivot_quantities(w, ["line_key"], ["ground", "first", "roof"])


@query(
    "total_row_filter",
    f"""SELECT doc_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(lower(t), '\\b(total|sub-?total|grand-?total)\\b')) AS n_kept
        FROM (SELECT doc_id, CASE WHEN part % 19 = 0 THEN concat('Sub-total ', material) ELSE material END AS t FROM {BOQ}) GROUP BY doc_id""",
)
def total_row_filter(spark, sf):
    cells = F.array(F.expr("CASE WHEN part % 19 = 0 THEN concat('Sub-total ', material) ELSE material END"), F.col("unit_raw"))
    return boq_rows(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~sheets.is_total(cells)).alias("n_kept"))


_HEADS = [
    ["Sr. No.", "Description", "Qty", "Unit", "Rate"], ["Item", "Make", "Brand"], ["Vendor", "Address"], ["Clause", "Compliance", "Remarks"],
    ["Parameter", "Value"], ["A", "B"],
]


def headers(spark, sf):
    pick = F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in _HEADS)), (F.col("p_partkey") % len(_HEADS) + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sheet"), pick.alias("header"))


_HEADER_SQL = "(SELECT p_partkey AS sheet, [" + ", ".join(str(h) for h in _HEADS) + f"][p_partkey % {len(_HEADS)} + 1] AS header FROM part)"


@query(
    "table_classify",
    f"""SELECT sheet, CASE WHEN len(list_filter(h, lambda x: contains(x, 'compliance') OR contains(x, 'yes/no'))) > 0 THEN 'COMPLIANCE_CHECKLIST'
        WHEN len(list_filter(h, lambda x: contains(x, 'make') OR contains(x, 'brand'))) > 0 AND NOT q THEN 'MAKE_LIST'
        WHEN len(list_filter(h, lambda x: contains(x, 'vendor') OR contains(x, 'supplier'))) > 0 AND NOT q THEN 'VENDOR_LIST'
        WHEN q AND len(list_filter(h, lambda x: contains(x, 'description') OR contains(x, 'material') OR contains(x, 'item'))) > 0 THEN 'BOQ'
        WHEN len(list_filter(h, lambda x: contains(x, 'specification') OR contains(x, 'parameter'))) > 0 THEN 'GENERIC_SPEC' ELSE 'UNKNOWN' END AS table_type
        FROM (SELECT sheet, h, len(list_filter(h, lambda x: contains(x, 'qty') OR contains(x, 'quantity'))) > 0 AS q FROM (SELECT sheet, list_transform(header, lambda x: lower(x)) AS h FROM {_HEADER_SQL}))""",
)
def table_classify(spark, sf):
    return headers(spark, sf).select("sheet", sheets.classify_table(F.col("header")).alias("table_type"))


@query(
    "column_roles",
    f"""SELECT sheet, role, min(i) AS col_idx FROM (SELECT sheet, i - 1 AS i, CASE {" ".join(f"WHEN regexp_matches(header[i], '{p}') THEN '{r}'" for r, p in sheets.ROLES)} END AS role
        FROM (SELECT sheet, header, unnest(range(1, len(header) + 1)) AS i FROM {_HEADER_SQL})) WHERE role IS NOT NULL GROUP BY sheet, role""",
)
def column_roles(spark, sf):
    return sheets.column_roles(headers(spark, sf))


@query(
    "header_rows",
    f"""SELECT doc_id AS sheet, coalesce(min(CASE WHEN seq % 4 = 2 THEN seq END), 0) AS header_row FROM {_SHEET} GROUP BY doc_id""",
)
def header_rows(spark, sf):
    cells = F.when(F.col("seq") % 4 == 2, F.array(F.lit("Sr. No."), F.lit("Description"), F.lit("Qty"))).otherwise(F.array(F.col("seq").cast("string"), F.lit("sand"), F.lit("5")))
    return sheets.header_rows(sheet(spark, sf).select(F.col("doc_id").alias("sheet"), F.col("seq").alias("row_idx"), cells.alias("cells")))


@query(
    "sheet_selection",
    f"""WITH s AS (SELECT doc_id AS workbook, part % 3 AS sheet, count(*) FILTER (quantity > 0) AS score, count(*) AS n_rows FROM {BOQ} GROUP BY ALL),
        f AS (SELECT * FROM s WHERE n_rows >= 3 AND score > 0), r AS (SELECT *, count(*) FILTER (score >= 2) OVER (PARTITION BY workbook) AS good, row_number() OVER (PARTITION BY workbook ORDER BY score DESC, sheet) AS nth FROM f)
        SELECT workbook, sheet, score FROM r WHERE (good >= 2 AND score >= 2) OR (good < 2 AND nth = 1)""",
)
def sheet_selection(spark, sf):
    cells = F.array(F.col("material"), F.when(F.col("quantity") > 0, F.col("quantity").cast("string")).otherwise("none"))
    rows = boq_rows(spark, sf).select(F.col("doc_id").alias("workbook"), (F.col("part") % 3).alias("sheet"), cells.alias("cells"))
    return sheets.select_sheets(rows)


_WORDS = f"(SELECT doc_id, page, line_key, (part * 37 % 5000) / 10.0::double AS x, (part * 13 % 3000) / 10.0::double AS y, split_part(material, ' ', 1) AS text FROM {BOQ})"


def page_words(spark, sf):
    return boq_rows(spark, sf).selectExpr("doc_id", "page", "line_key", "cast(part * 37 % 5000 AS double) / 10.0D AS x", "cast(part * 13 % 3000 AS double) / 10.0D AS y", "split_part(material, ' ', 1) AS text")


@query(
    "band_clusters",
    f"""WITH w AS (SELECT doc_id, x, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS d FROM {_WORDS}),
        b AS (SELECT *, sum(CASE WHEN d > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x) AS band FROM w)
        SELECT doc_id, band, min(x) AS x_min, max(x) AS x_max, count(*) AS n FROM b GROUP BY doc_id, band""",
)
def band_clusters(spark, sf):
    return layout.cluster_positions(page_words(spark, sf), ["doc_id"], "x", 60.0)


@query(
    "cell_interval_join",
    f"""SELECT doc_id, cast(floor(y / 20) AS bigint) AS row, band, string_agg(text, ' ' ORDER BY x, text) AS cell, count(*) AS n_words FROM {_WORDS}
        JOIN (VALUES (0, 0.0, 60.0), (1, 60.0, 250.0), (2, 250.0, 320.0), (3, 320.0, 400.0), (4, 400.0, 520.0)) b(band, l, r) ON x >= l - 1 AND x < r + 1 GROUP BY ALL""",
)
def cell_interval_join(spark, sf):
    bands = spark.createDataFrame([(0, 0.0, 60.0), (1, 60.0, 250.0), (2, 250.0, 320.0), (3, 320.0, 400.0), (4, 400.0, 520.0)], "band int, x_left double, x_right double")
    return layout.words_to_cells(page_words(spark, sf), bands)


@query("lines_by_anchor")
def lines_by_anchor(spark, sf):
    """Lines by the first word's height: an order-dependent fold."""
    return layout.lines_by_anchor(page_words(spark, sf), 40.0)


@query("digit_columns")
def digit_columns(spark, sf):
    words = page_words(spark, sf).withColumn("text", (F.col("line_key") % 10).cast("string"))
    return layout.digit_columns(words.select("doc_id", "x", "y", "text"), 60.0)


# Words of documents as spans; a word's length gives its type.
_TYPE = "CASE WHEN length(w) = 12 THEN 'MATERIAL' WHEN length(w) = 11 THEN 'QUANTITY' WHEN length(w) = 10 THEN 'UNIT' WHEN length(w) = 13 THEN 'LOCATION' WHEN length(w) = 14 THEN 'STANDARD' END"
_SPANS = f"""(SELECT doc_id, i AS ent_id, w AS text, {_TYPE} AS type, s AS start, s + length(w) AS "end", (50 + length(w) * i % 50) / 100.0::double AS conf
  FROM (SELECT doc_id, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS s FROM
    (SELECT doc_id, ws[i + 1] AS w, i FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))) WHERE {_TYPE} IS NOT NULL)"""


def word_spans(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    start = F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id").orderBy("i")) - F.length("w") - 1
    placed = words.withColumn("start", start.cast("int")).withColumn("type", F.expr(_TYPE)).where("type IS NOT NULL")
    conf = F.expr("(50 + length(w) * i % 50) / 100.0D")
    return placed.select("doc_id", F.col("i").alias("ent_id"), F.col("w").alias("text"), "type", "start", (F.col("start") + F.length("w")).alias("end"), conf.alias("conf"))


_RULES = ", ".join(f"('{r}', '{h}', '{t}', {d})" for r, h, t, d, _ in sp.RULES)
_REL = f"""(SELECT h.doc_id, rule, h.ent_id AS head_id, t.ent_id AS tail_id, t.start - h."end" AS distance, round(1 - (t.start - h."end") / reach, 6) AS conf
  FROM {_SPANS} h JOIN (VALUES {_RULES}) r(rule, ht, tt, reach) ON h.type = ht JOIN {_SPANS} t ON t.doc_id = h.doc_id AND t.type = tt AND t.start >= h."end" AND t.start - h."end" <= reach)"""


@query("relation_band_join", f"SELECT doc_id, rule, head_id, tail_id, cast(distance AS int) AS distance, conf FROM {_REL}")
def relation_band_join(spark, sf):
    return sp.relations(word_spans(spark, sf))


@query(
    "scope_gap_antijoin",
    f"""SELECT doc_id, ent_id, CASE type WHEN 'MATERIAL' THEN 'NO_QUANTITY' ELSE 'NO_UNIT' END AS gap FROM {_SPANS} s WHERE type IN ('MATERIAL', 'QUANTITY')
        AND NOT EXISTS (SELECT 1 FROM {_REL} r WHERE r.doc_id = s.doc_id AND r.head_id = s.ent_id AND r.rule = CASE s.type WHEN 'MATERIAL' THEN 'HAS_QUANTITY' ELSE 'HAS_UNIT' END)""",
)
def scope_gap_antijoin(spark, sf):
    spans = word_spans(spark, sf)
    return sp.scope_gaps(spans, sp.relations(spans))


@query(
    "nearest_assembly",
    f"""WITH c AS (SELECT m.doc_id, m.ent_id, q.ent_id AS near_id, CASE WHEN q.start > m.start THEN greatest(q.start - m."end", 0) ELSE greatest(m.start - q."end", 0) END AS distance, CASE WHEN q.start > m.start THEN 0 ELSE 100 END AS side
        FROM {_SPANS} m JOIN {_SPANS} q ON q.doc_id = m.doc_id AND q.type = 'QUANTITY' WHERE m.type = 'MATERIAL')
        SELECT doc_id, ent_id, near_id, cast(distance AS int) AS distance FROM c WHERE distance <= 200 QUALIFY row_number() OVER (PARTITION BY doc_id, ent_id ORDER BY distance + side, distance, near_id) = 1""",
)
def nearest_assembly(spark, sf):
    return sp.nearest(word_spans(spark, sf), "MATERIAL", "QUANTITY")


@query(
    "fragment_merge",
    f"""WITH l AS (SELECT *, lag(type) OVER w AS lt, lag("end") OVER w AS le FROM {_SPANS} WINDOW w AS (PARTITION BY doc_id ORDER BY start, ent_id)),
        i AS (SELECT *, sum(CASE WHEN type = 'MATERIAL' AND lt = 'MATERIAL' AND start - le <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, ent_id) AS island FROM l)
        SELECT doc_id, cast(min(start) AS int) AS start, cast(max("end") AS int) AS "end", count(*) AS n_parts FROM i WHERE type = 'MATERIAL' GROUP BY doc_id, island""",
)
def fragment_merge(spark, sf):
    return sp.merge_fragments(word_spans(spark, sf))


@query("entity_counts", f"SELECT doc_id, type, count(*) AS n, round(avg(conf), 6) AS conf FROM {_SPANS} GROUP BY doc_id, type")
def entity_counts(spark, sf):
    return word_spans(spark, sf).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


@query("span_extraction")
def span_extraction(spark, sf):
    """Patterns and dictionary terms in whole texts."""
    return sp.extract_spans(table(spark, sf, "documents"), {"MATERIAL": ["steel", "sand", "the"], "UNIT": ["kg", "sqm"]})


@query("span_overlaps")
def span_overlaps(spark, sf):
    spans = word_spans(spark, sf).withColumn("end", (F.col("end") + F.col("ent_id") % 7 * 10).cast("int"))
    return sp.resolve_overlaps(spans)


_TYPES = "list_transform(string_split(material, ' '), lambda w: CASE WHEN length(w) > 5 THEN 'MATERIAL' WHEN length(w) > 3 THEN 'GRADE' ELSE 'O' END)"


def typed(spark, sf):
    types = F.transform(F.split("material", " "), lambda w: F.when(F.length(w) > 5, "MATERIAL").when(F.length(w) > 3, "GRADE").otherwise("O"))
    return boq_rows(spark, sf).select(F.col("line_key").alias("doc_id"), types.alias("types"))


_TAGS = f"""(SELECT line_key AS doc_id, list_transform(t, lambda x, i: CASE WHEN x = 'O' THEN 'O' ELSE concat(CASE WHEN coalesce(t[i - 1], '') <> x AND coalesce(t[i + 1], '') <> x THEN 'S'
  WHEN coalesce(t[i - 1], '') <> x THEN 'B' WHEN coalesce(t[i + 1], '') <> x THEN 'E' ELSE 'I' END, '-', x) END) AS tags FROM (SELECT line_key, {_TYPES} AS t FROM {BOQ}))"""


@query("bioes_encode", f"SELECT doc_id, array_to_string(tags, ' ') AS tags FROM {_TAGS}")
def bioes_encode(spark, sf):
    return typed(spark, sf).select("doc_id", F.array_join(sp.bioes_tags(), " ").alias("tags"))


@query("bioes_validate", f"SELECT count(*) AS n, count(*) AS n_valid FROM {_TAGS}")
def bioes_validate(spark, sf):
    tagged = typed(spark, sf).select("doc_id", sp.bioes_tags().alias("tags"))
    return tagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(sp.bioes_valid()).alias("n_valid"))


@query(
    "bioes_decode",
    f"""WITH t AS (SELECT doc_id, i - 1 AS i, tags[i] AS tag FROM (SELECT doc_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM {_TAGS})),
        s AS (SELECT *, sum(CASE WHEN tag[1] IN ('B', 'S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM t WHERE tag <> 'O')
        SELECT doc_id, cast(min(i) AS int) AS first, cast(max(i) AS int) AS last, any_value(tag[3:]) AS type, count(*) AS n FROM s GROUP BY doc_id, island""".replace(", count(*) AS n", ""),
)
def bioes_decode(spark, sf):
    return sp.spans_of_tags(spark, typed(spark, sf).select("doc_id", sp.bioes_tags().alias("tags")))

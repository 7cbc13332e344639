"""Queries over document texts: cleaning, language, sections, pages, matching."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as tx
from ..operators import matching as mt
from .bridge import BOQ, boq_rows, boq_units
from .registry import query, table
from .row_queries import boq_with_units


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(
    "lang_detect",
    "SELECT lang_class, count(*) AS n FROM (SELECT CASE WHEN share > 0.3 THEN 'hi' WHEN share > 0.02 THEN 'mixed' ELSE 'en' END AS lang_class FROM "
    "(SELECT CASE WHEN length(regexp_replace(text, '[ \\n]', '', 'g')) > 0 THEN len(regexp_extract_all(text, '[\\x{0900}-\\x{097F}]')) / length(regexp_replace(text, '[ \\n]', '', 'g')) ELSE 0 END AS share FROM documents)) GROUP BY 1",
)
def lang_detect(spark, sf):
    return docs(spark, sf).groupBy(tx.language(F.col("text")).alias("lang_class")).agg(F.count(F.lit(1)).alias("n"))


_CLEAN = r"""trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '&\w+;', '', 'g'), '%PDF-\d+', '', 'g'), '(?i)Page\s+\d+\s+(of\s+)?\d+', '', 'g'), '\b\d+\s*/\s*\d+\b', '', 'g'),
  '(?m)^[ \t]*\d+[ \t]*$', '', 'g'), '‘’“”–—', '''''""--'), '\s+', ' ', 'g'))"""


@query("text_normalize", f"SELECT doc_id, length({_CLEAN}) AS n_clean, md5({_CLEAN}) AS clean_md5 FROM documents")
def text_normalize(spark, sf):
    clean = docs(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("c"))
    return clean.select("doc_id", F.length("c").alias("n_clean"), F.md5("c").alias("clean_md5"))


@query(
    "standards_normalize",
    f"""SELECT standard, CASE WHEN regexp_matches(standard, '(?i)IS\\s*[:.]?\\s*(\\d+)') THEN concat('IS ', regexp_extract(standard, '(?i)IS\\s*[:.]?\\s*(\\d+)(?:\\s*[:.]\\s*(\\d+))?', 1),
        CASE WHEN regexp_extract(standard, '(?i)IS\\s*[:.]?\\s*(\\d+)(?:\\s*[:.]\\s*(\\d+))?', 2) <> '' THEN concat(':', regexp_extract(standard, '(?i)IS\\s*[:.]?\\s*(\\d+)(?:\\s*[:.]\\s*(\\d+))?', 2)) ELSE '' END)
        WHEN regexp_matches(standard, '(?i)ASTM\\s+([A-Z])\\s*(\\d+)') THEN concat('ASTM ', regexp_extract(standard, '(?i)ASTM\\s+([A-Z])\\s*(\\d+)', 1), ':', regexp_extract(standard, '(?i)ASTM\\s+([A-Z])\\s*(\\d+)', 2))
        END AS normal, count(*) AS n FROM {BOQ} GROUP BY standard""",
)
def standards_normalize(spark, sf):
    b = boq_rows(spark, sf).withColumn("normal", tx.standard(F.col("standard")))
    return b.groupBy("standard", "normal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dimension_parse",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 3 WHEN 0 THEN p_size / 1000 WHEN 1 THEN p_size / 100 ELSE p_size / 1 END END AS length,
       CASE WHEN p_partkey % 2 = 0 THEN (p_size + 10) / 100 END AS width, CASE WHEN p_partkey % 2 = 1 THEN CASE p_size % 3 WHEN 0 THEN p_size / 1000 WHEN 1 THEN p_size / 100 ELSE p_size / 1 END END AS thickness FROM part""",
)
def dimension_parse(spark, sf):
    unit = F.expr("CASE p_size % 3 WHEN 0 THEN 'mm' WHEN 1 THEN ' cm' ELSE 'm' END")
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), unit, F.lit(" x "), (F.col("p_size") + 10).cast("string"), F.lit(" cm"))).otherwise(F.concat(F.col("p_size").cast("string"), unit, F.lit(" thick")))
    return table(spark, sf, "part").select("p_partkey", tx.metres(spelled).alias("m")).select("p_partkey", "m.length", "m.width", "m.thickness")


def _section_sql() -> str:
    hits = {k: " + ".join(rf"regexp_matches(t, '\b{w}\b')::int * 3 + regexp_matches(x, '\b{w}\b')::int" for w in words) for k, words in tx.SECTIONS.items()}
    boq = "(contains(x, 'bill of quantities') OR contains(x, 'boq'))"
    extra = {"SCOPE": f" + CASE WHEN PREAMBLE > 0 AND contains(x, 'scope') AND contains(x, 'work') THEN 1.5 ELSE 0 END + CASE WHEN {boq} THEN 0.5 ELSE 0 END",
             "SCHEDULE_OF_ITEMS": f" + CASE WHEN {boq} THEN 2.0 ELSE 0 END", "SPECIFICATIONS": r" + CASE WHEN regexp_matches(x, '\d+\.\d+\s*mm|\d+\.\d+\s*cm') THEN 0.5 ELSE 0 END"}
    inner = ", ".join(f"{e} AS {k}" for k, e in hits.items())
    outer = ", ".join(f"{k}{extra.get(k, '')} AS {k}" for k in hits)
    cases = " ".join(f"WHEN {k} = greatest({', '.join(hits)}) THEN '{k}'" for k in hits)
    return f"""SELECT page_id, CASE WHEN greatest({', '.join(hits)}) = 0 THEN 'GENERAL' {cases} END AS section FROM (SELECT page_id, {outer} FROM
      (SELECT page_id, t, x, {inner} FROM (SELECT page_id, lower(url) AS t, lower(concat(url, ' ', regexp_replace(html, '<[^>]*>', ' ', 'g'))) AS x FROM pages)))"""


@query("section_classify", _section_sql())
def section_classify(spark, sf):
    """Types of pages: the page's URL stands for its title."""
    pages = table(spark, sf, "pages")
    return tx.classify_sections(pages, F.col("url"), F.regexp_replace("html", "<[^>]*>", " ")).select("page_id", "section")


def _project_sql() -> str:
    parts = {k: " + ".join(f"contains(t, '{w}')::int" for w in words) for k, words in tx.PROJECTS.items()}
    cols = ", ".join(f"{e} AS {k}" for k, e in parts.items())
    best, total = f"greatest({', '.join(parts)})", " + ".join(parts)
    cases = " ".join(f"WHEN {k} = best THEN '{k}'" for k in parts)
    return f"""SELECT line_key, CASE WHEN best = 0 THEN 'general' {cases} END AS project, round(CASE WHEN best = 0 THEN 0.5 ELSE best / total END, 6) AS share
      FROM (SELECT *, {best} AS best, {total} AS total FROM (SELECT line_key, {cols} FROM (SELECT line_key, lower(material) AS t FROM {BOQ})))"""


@query("project_route", _project_sql())
def project_route(spark, sf):
    kind, share = tx.project(F.col("material"))
    return boq_rows(spark, sf).select("line_key", kind.alias("project"), F.round(share, 6).alias("share"))


_PAGES = "(SELECT doc_id, i + 1 AS page, ls[i * 20 + 1:i * 20 + 20] AS lines FROM (SELECT doc_id, ls, unnest(range(0, cast(ceil(len(ls) / 20) AS bigint))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"
_HEADS = " + ".join(f"CASE WHEN contains(head, '{h}') THEN 2 ELSE 0 END" for h in tx.HEADERS)
_SIGNALS = rf"""(SELECT *, CASE WHEN boq_rows >= 5 THEN 8.0 WHEN boq_rows >= 3 THEN 5.0 WHEN boq_rows >= 1 THEN 1.0 ELSE 0.0 END + CASE WHEN pairs >= 3 THEN 4.0 WHEN pairs >= 1 THEN 1.5 ELSE 0.0 END
  + CASE WHEN header_score >= 4 THEN 4.0 WHEN header_score >= 2 THEN 2.0 ELSE 0.0 END - CASE WHEN spec_lines >= 3 THEN 3.0 WHEN spec_lines >= 1 THEN 1.0 ELSE 0.0 END AS score FROM (
  SELECT doc_id, page, len(l) AS n_lines, len(list_filter(l, lambda x: length(x) BETWEEN 15 AND 250 AND NOT regexp_matches(x, '{tx.SPEC_LINE}') AND regexp_matches(x, '{tx.ITEM_LINE}') AND regexp_matches(x, '{tx.QUANTITY_UNIT}'))) AS boq_rows,
  len(list_filter(l, lambda x, i: regexp_matches(x, '{tx.NUMBER_LINE}') AND regexp_matches(array_to_string(l[i + 1:i + 5], ' '), '(?i)\b(cum|kg|sqm|m3|nos|each|set|rmt|lm)\b'))) AS pairs,
  len(list_filter(l, lambda x: regexp_matches(x, '{tx.SPEC_LINE}'))) AS spec_lines, {_HEADS} AS header_score
  FROM (SELECT doc_id, page, l, lower(array_to_string(l[1:8], ' ')) AS head FROM (SELECT doc_id, page, list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> '') AS l FROM {_PAGES}))))"""
_IS_BOQ = "(boq_rows >= 3 OR (score >= 5 AND (boq_rows >= 1 OR pairs >= 2)))"


@query("page_score", f"SELECT doc_id, page, n_lines, boq_rows, pairs, spec_lines, header_score, cast(score AS double) AS score, {_IS_BOQ} AS is_boq FROM {_SIGNALS}")
def page_score(spark, sf):
    return tx.page_signals(tx.pages_of(docs(spark, sf))).select("doc_id", "page", "n_lines", "boq_rows", "pairs", "spec_lines", "header_score", "score", "is_boq")


@query(
    "page_adjacency",
    f"""SELECT doc_id, page, is_boq OR ((coalesce(lag(is_boq) OVER w, false) OR coalesce(lead(is_boq) OVER w, false)) AND (boq_rows >= 1 OR header_score >= 2)) AS selected
        FROM (SELECT *, {_IS_BOQ} AS is_boq FROM {_SIGNALS}) WINDOW w AS (PARTITION BY doc_id ORDER BY page)""",
)
def page_adjacency(spark, sf):
    return tx.expand_adjacent(tx.page_signals(tx.pages_of(docs(spark, sf)))).select("doc_id", "page", "selected")


@query(
    "range_coalesce",
    f"""WITH r AS (SELECT doc_id, item_no * 6 + part % 5 AS s, item_no * 6 + part % 5 + part % 7 AS e FROM {BOQ}),
        o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
        i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM o)
        SELECT doc_id, min(s) AS start, max(e) AS end, count(*) AS n FROM i GROUP BY doc_id, island""",
)
def range_coalesce(spark, sf):
    r = boq_rows(spark, sf).selectExpr("doc_id", "item_no * 6 + part % 5 AS start", "item_no * 6 + part % 5 + part % 7 AS end")
    return tx.coalesce_ranges(r, "doc_id")


@query(
    "heading_counts",
    r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(\d+\.\d*\s*|[A-Za-z0-9_ ]+:)'))) AS n_headings FROM documents""",
)
def heading_counts(spark, sf):
    headings = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^(\d+\.\d*\s*|[A-Za-z0-9_ ]+:)"))
    return docs(spark, sf).select("doc_id", F.size(headings).alias("n_headings"))


@query(
    "section_split",
    r"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
       s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][^.]{0,60}\.?$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l)
       SELECT doc_id, part, count(*) AS n_lines, min(i) AS first_line FROM s GROUP BY doc_id, part""",
)
def section_split(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    part = F.sum(F.col("line").rlike(r"^[A-Z][^.]{0,60}\.?$").cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("part", part).groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n_lines"), (F.min("i") + 1).alias("first_line"))


# The output side of the matchers: some rows lost, some changed, some twice.
_PRED = f"""(SELECT doc_id, line_key + 5 AS line_key, material, CASE WHEN part % 13 = 0 THEN quantity + 1 ELSE quantity END AS quantity, unit_canonical, confidence
  FROM {boq_units()} WHERE (part + item_no) % 17 <> 0)"""


def predicted(spark, sf):
    b = boq_with_units(spark, sf).where("(part + item_no) % 17 <> 0")
    q = F.expr("CASE WHEN part % 13 = 0 THEN quantity + 1 ELSE quantity END")
    return b.select("doc_id", (F.col("line_key") + 5).alias("line_key"), "material", q.alias("quantity"), "unit_canonical", "confidence")


_EDGES = f"""(SELECT s.doc_id, s.line_key AS s_line_key, o.line_key AS o_line_key,
  CASE WHEN greatest(length(s.material), length(o.material)) = 0 THEN 1.0 ELSE 1 - levenshtein(s.material, o.material) / greatest(length(s.material), length(o.material)) END AS sim
  FROM {boq_units()} s JOIN {_PRED} o ON s.doc_id = o.doc_id AND s.quantity IS NOT DISTINCT FROM o.quantity AND s.unit_canonical = o.unit_canonical)"""


def _candidates(spark, sf):
    return mt.edges(boq_with_units(spark, sf), predicted(spark, sf), mt.ratio(F.col("s_material"), F.col("o_material")), 0.8)


@query("fuzzy_edges", f"SELECT doc_id, s_line_key, o_line_key, round(sim, 6) AS sim FROM {_EDGES} WHERE sim >= 0.8")
def fuzzy_edges(spark, sf):
    return _candidates(spark, sf).select(F.col("s_doc_id").alias("doc_id"), "s_line_key", "o_line_key", F.round("sim", 6).alias("sim"))


@query(
    "reconciliation_full_outer",
    f"""SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, count(s.n) AS source_keys, count(o.n) AS output_keys, count(*) FILTER (s.n IS NULL) AS extra_keys, count(*) FILTER (o.n IS NULL) AS missing_keys
        FROM (SELECT doc_id, material, quantity, count(*) AS n FROM {boq_units()} GROUP BY ALL) s FULL JOIN (SELECT doc_id, material, quantity, count(*) AS n FROM {_PRED} GROUP BY ALL) o
        ON s.doc_id = o.doc_id AND s.material = o.material AND s.quantity = o.quantity GROUP BY 1""",
)
def reconciliation_full_outer(spark, sf):
    keys = ["doc_id", "material", "quantity"]
    s = boq_with_units(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("s_n"))
    o = predicted(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("o_n"))
    return s.join(o, keys, "full_outer").groupBy("doc_id").agg(
        F.count("s_n").alias("source_keys"), F.count("o_n").alias("output_keys"), F.count_if(F.col("s_n").isNull()).alias("extra_keys"), F.count_if(F.col("o_n").isNull()).alias("missing_keys")
    )


@query(
    "row_match_metrics",
    f"""WITH m AS (SELECT s.doc_id, count(DISTINCT s_line_key) AS tp FROM {_EDGES} s WHERE sim >= 0.8 GROUP BY s.doc_id), a AS (SELECT doc_id, count(*) AS n FROM {BOQ} GROUP BY doc_id),
        o AS (SELECT doc_id, count(*) AS n FROM {_PRED} GROUP BY doc_id), t AS (SELECT sum(coalesce(tp, 0)) AS tp, sum(a.n) AS n_s, (SELECT sum(n) FROM o) AS n_o FROM a LEFT JOIN m USING (doc_id))
        SELECT cast(tp AS bigint) AS tp, round(tp / n_o, 6) AS precision, round(tp / n_s, 6) AS recall, round(2 * (tp / n_o) * (tp / n_s) / ((tp / n_o) + (tp / n_s)), 6) AS f1 FROM t""",
)
def row_match_metrics(spark, sf):
    """Source rows with a match against all rows of both sides."""
    tp = _candidates(spark, sf).select("s_line_key", "s_doc_id").distinct().agg(F.count(F.lit(1)).alias("tp"))
    n_s = boq_rows(spark, sf).agg(F.count(F.lit(1)).alias("n_s"))
    n_o = predicted(spark, sf).agg(F.count(F.lit(1)).alias("n_o"))
    one = tp.crossJoin(n_s).crossJoin(n_o)  # three one-row tables
    m = mt.metrics(one.withColumns({"fp": F.col("n_o") - F.col("tp"), "fn": F.col("n_s") - F.col("tp")}))
    return m.select("tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("catalog_match_cascade")
def catalog_match_cascade(spark, sf):
    """Catalog entry of every distinct material; part names are the catalog."""
    catalog = table(spark, sf, "part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("ord"))
    return mt.catalog_cascade(boq_rows(spark, sf), "material", catalog).withColumn("confidence", F.round("confidence", 6))


@query(
    "catalog_exact_flag",
    f"""SELECT line_key, NOT EXISTS (SELECT 1 FROM part WHERE lower(p_name) = trim(lower(concat(split_part(material, ' ', len(string_split(material, ' ')) - 1), ' ', split_part(material, ' ', len(string_split(material, ' '))))))) AS non_catalog FROM {BOQ}""",
)
def catalog_exact_flag(spark, sf):
    """Rows whose last two words are no catalog name: flagged, never dropped."""
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name"), F.lit(True).alias("known")).distinct()
    words = F.split("material", " ")
    name = F.trim(F.lower(F.array_join(F.slice(words, -2, 2), " ")))
    return boq_rows(spark, sf).withColumn("name", name).join(names, "name", "left").select("line_key", F.col("known").isNull().alias("non_catalog"))


@query("sequence_ratio_pairs")
def sequence_ratio_pairs(spark, sf):
    """Ratcliff-Obershelp similarity of items in one document, where lengths
    leave 0.6 possible."""
    b = boq_rows(spark, sf).select("doc_id", "line_key", "material")
    o = b.select("doc_id", F.col("line_key").alias("other_key"), F.col("material").alias("other"))
    pairs = b.join(o, "doc_id").where("line_key < other_key").where(mt.sequence_bound(F.col("material"), F.col("other")) >= 0.6)
    return pairs.withColumn("ratio", mt.sequence_ratio("material", "other")).where("ratio >= 0.6").select("doc_id", "line_key", "other_key", F.round("ratio", 6).alias("ratio"))


@query(
    "material_cascade",
    f"""WITH p AS (SELECT DISTINCT a.p_name AS gold, b.p_name AS pred FROM part a JOIN part b ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND a.p_name <> b.p_name),
        t AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(gold), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS g, list_distinct(list_filter(string_split_regex(lower(pred), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS q FROM p)
        SELECT gold, pred, CASE WHEN len(list_intersect(g, q)) / len(g) >= 0.8 THEN 'containment' WHEN contains(lower(pred), lower(gold)) OR contains(lower(gold), lower(pred)) THEN 'substring'
        WHEN len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) >= 0.6 THEN 'jaccard' ELSE 'none' END AS method FROM t""",
)
def material_cascade(spark, sf):
    """How names that end alike match: containment, substring, Jaccard."""
    names = table(spark, sf, "part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("k")).distinct()
    p = names.select(F.col("p_name").alias("gold"), "k").join(names.select(F.col("p_name").alias("pred"), "k"), "k").where("gold <> pred")
    p = p.withColumns({"g": mt.token_set(F.col("gold")), "q": mt.token_set(F.col("pred"))})
    sub = F.contains(F.lower("pred"), F.lower("gold")) | F.contains(F.lower("gold"), F.lower("pred"))
    method = F.when(mt.containment(F.col("g"), F.col("q")) >= 0.8, "containment").when(sub, "substring").when(mt.jaccard(F.col("g"), F.col("q")) >= 0.6, "jaccard").otherwise("none")
    return p.select("gold", "pred", method.alias("method"))

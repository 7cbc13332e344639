"""Queries over sentences, tokens, phrases, cells, tables and page classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as ph, text as tx
from ..operators import tables as tb
from .bridge import BOQ, boq_rows, pick, quoted
from .registry import query, table
from .text_queries import _PAGES, docs

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _literal(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sentence_sql() -> str:
    head = f"CASE WHEN regexp_matches(t, '{ph.DECIMAL}') THEN regexp_extract(t, '^((?s:.*?)){ph.DECIMAL}', 1) ELSE t END"
    ends = f"regexp_replace(h, '{_literal(ph.SENTENCE_END)}', concat('\\1', chr(1), '\\2\\3'), 'g')"
    kept = f"regexp_replace({ends}, concat('({'|'.join(ph.REFERENCES)})([.!?])', chr(1)), '\\1\\2', 'g')"
    return f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM (SELECT doc_id,
      list_filter(list_transform(string_split(concat({kept}, substr(t, length(h) + 1)), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS s
      FROM (SELECT doc_id, t, {head} AS h FROM (SELECT doc_id, replace(coalesce(text, ''), chr(1), ' ') AS t FROM documents)))"""


@query("sentence_split", _sentence_sql())
def sentence_split(spark, sf):
    s = docs(spark, sf).select("doc_id", ph.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query(
    "word_tokens",
    f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{ph.TOKEN}') AS t FROM documents)",
)
def word_tokens(spark, sf):
    t = docs(spark, sf).select("doc_id", ph.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_STARTS = ["", "Supply and installation of ", "Providing and fixing ", "SUPPLYING ", "Testing and commissioning of "]
_SIZES = ["", "100 mm thick ", "grade A-1 50 mm dia ", "first layer of lightly resin bonded ", "Closed cell type B2 "]
_ENDS = ["", " as per drawings and notes", " with all accessories etc.", " of 25 mm thickness", " having density 48 kg; complete in all respects", "  etc"]
_SENTENCE = f"concat({pick('part', quoted(_STARTS))}, {pick('part + item_no', quoted(_SIZES))}, material, {pick('part * 3 + item_no', quoted(_ENDS))}, CASE WHEN part % 13 = 0 THEN repeat(', wire', 40) ELSE '' END)"


def _phrase_sql() -> str:
    before = lambda t, p, n: f"nullif(regexp_extract({t}, '(?i)^((?s:.{{{n},}}?)){p}', 1), '')"
    chain = lambda t, parts, test: f"coalesce({', '.join(f'CASE WHEN {test(p)} THEN regexp_replace({t}, {chr(39)}(?i){p}{chr(39)}, {chr(39) * 2}) END' for p in parts)}, {t})"
    changed = lambda p: f"regexp_replace(t, '(?i){p}', '') <> t"
    enough = lambda p: f"{changed(p)} AND length({_TRIM.format(f'regexp_replace(t, {chr(39)}(?i){p}{chr(39)}, {chr(39) * 2})')}) >= {ph.SHORTEST}"
    sql = f"SELECT line_key, {_TRIM.format(_SENTENCE)} AS t FROM {BOQ}"
    sql = f"SELECT line_key, regexp_replace(t, '(?i)^(?:{'|'.join(ph.ACTIONS)})', '') AS t FROM ({sql})"
    sql = f"SELECT line_key, t, t AS whole FROM (SELECT line_key, coalesce({', '.join(before('t', p, 1) for p in ph.CLOSINGS)}, t) AS t FROM ({sql}))"
    for _ in range(ph.ROUNDS):
        sql = f"SELECT line_key, whole, {chain('t', ph.LEADING, enough)} AS t FROM ({sql})"
    sql = f"SELECT line_key, CASE WHEN length({_TRIM.format('t')}) < {ph.SHORTEST} THEN whole ELSE t END AS t FROM ({sql})"
    for _ in range(ph.ROUNDS):
        sql = f"SELECT line_key, {chain('t', ph.TRAILING, changed)} AS t FROM ({sql})"
    first = "regexp_extract(t, '^([^.;]*)[.;]', 1)"
    cuts = ", ".join(f"CASE WHEN length({before('t', p, 1)}) >= {ph.SHORTEST} THEN {before('t', p, 1)} END" for p in ph.CLOSINGS)
    cut = f"CASE WHEN length(t) <= {ph.LONGEST} THEN t WHEN length({first}) >= {ph.SHORTEST} THEN {first} ELSE coalesce({cuts}, substr(t, 1, {ph.LONGEST})) END"
    return rf"SELECT line_key, trim(regexp_replace({cut}, '\s+', ' ', 'g'), '{ph.EDGES}') AS phrase FROM ({sql})"


@query("material_phrase", _phrase_sql())
def material_phrase(spark, sf):
    return boq_rows(spark, sf).selectExpr("line_key", f"{_SENTENCE} AS s").select("line_key", ph.material_phrase(F.col("s")).alias("phrase"))


_CELLS = ["13 mm thk", "300 MM", "RO", "rate only", "1,200.5", "12.", "0", "sq.mtr", " Nos. ", "1e3", "Rmt.", "100", "7", "2.1", "wall to roof", "m³", "no 5 mm", ".5", "-"]
_CELL = pick("part + item_no", quoted(_CELLS))


def _unit_sql(c: str) -> str:
    return rf"(length({c}) <= 25 AND NOT regexp_matches({c}, '{tb.SIZED}') AND NOT regexp_matches({c}, '{tb.SIZE}') AND NOT (regexp_matches({c}, '\d') AND regexp_matches({c}, '\b(?:mm|cm)\b')) AND regexp_matches({c}, '{tb.UNIT}'))"


@query(
    "cell_tests",
    rf"""SELECT line_key, {_unit_sql('u')} AS is_unit, upper(q) IN ({', '.join(quoted(tb.RATE_ONLY))}) OR regexp_matches(q, '{tb.NUMBER}') AS is_quantity,
      regexp_matches(i, '^\d+(\.\d*)?$') AND i NOT IN ('0', '0.') AND (contains(i, '.') OR try_cast(i AS bigint) <= 99) AS is_item
      FROM (SELECT line_key, rtrim(trim(lower(c)), '.') AS u, replace(replace(trim(c), ' ', ''), ',', '') AS q, trim(c) AS i FROM (SELECT line_key, {_CELL} AS c FROM {BOQ}))""",
)
def cell_tests(spark, sf):
    c = boq_rows(spark, sf).selectExpr("line_key", f"{_CELL} AS c")
    return c.select("line_key", tb.is_unit(F.col("c")).alias("is_unit"), tb.is_quantity(F.col("c")).alias("is_quantity"), tb.is_item_number(F.col("c")).alias("is_item"))


_ROW_TEXT = "array_to_string(list_filter(r, lambda c: c <> ''), ' ')"
_MARKS = "len(list_filter([" + ", ".join(quoted(tb.HEADER_WORDS)) + f"], lambda w: contains(lower({_ROW_TEXT}), w)))"
_HEAD_ROWS = [["Sl.No", "Specification", "Bidder reply", ""], ["Item", "Description", "Unit", "Qty"], ["", "", "", ""]]


@query(
    "item_tables",
    rf"""WITH c AS (SELECT doc_id, item_no, [cast(item_no AS varchar), material, unit_raw, cast(quantity AS varchar)] AS r FROM {BOQ}
           UNION ALL SELECT DISTINCT doc_id, 0, CASE doc_id % 5 WHEN 0 THEN {_HEAD_ROWS[0]} WHEN 1 THEN {_HEAD_ROWS[1]} ELSE {_HEAD_ROWS[2]} END FROM {BOQ}),
         f AS (SELECT doc_id, item_no, row_number() OVER (PARTITION BY doc_id ORDER BY item_no) AS k, lower({_ROW_TEXT}) AS x, {_MARKS} AS marks,
           len(r) >= 3 AND regexp_matches({_ROW_TEXT}, '{tb.AMOUNT}') AND len(list_filter(list_transform(r, lambda c: rtrim(trim(lower(c)), '.')), lambda c: {_unit_sql('c')})) > 0
           AND (regexp_matches({_ROW_TEXT}, '^\d+(\.\d+)?\s') OR length({_ROW_TEXT}) > 20) AS data FROM c)
         SELECT doc_id, count(*) AS n_rows, count(*) >= 2 AND NOT bool_or(k <= 6 AND (contains(x, 'specification') OR contains(x, 'tce spec'))
           AND (contains(x, 'reply') OR contains(x, 'compliance') OR contains(x, 'remarks')) AND (contains(x, 'sl.no') OR contains(x, 'sl. no')))
           AND (bool_or(k = 1 AND marks >= 2) OR bool_or(k > 1 AND data)) AS is_table FROM f GROUP BY doc_id""",
)
def item_tables(spark, sf):
    head = F.lit(_HEAD_ROWS)
    cells = F.array(F.col("item_no").cast("string"), "material", "unit_raw", F.col("quantity").cast("string"))
    lines = boq_rows(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_no", cells.alias("r")))).alias("l"))  # a document's items
    first = F.get(head, F.least(F.col("doc_id") % 5, F.lit(2)).cast("int"))
    rows = lines.select("doc_id", F.concat(F.array(first), F.transform("l", lambda x: x["r"])).alias("rows"))
    return rows.select("doc_id", F.size("rows").alias("n_rows"), tb.is_item_table(F.col("rows")).alias("is_table"))


_HEADS = ["Bill of Quantities", "x", "penalty clause", "Annexure II", "Technical Specifications", "1.1 pipe 5 nos  2.1 wire 7 m  3.1 sand 8 cum", "Notice inviting tender", " "]
_HEADED = f"concat({pick('doc_id', quoted(_HEADS))}, chr(10), coalesce(text, ''))"


def _page_sql() -> str:
    has = lambda where, words: "(" + " OR ".join(f"contains({where}, '{w}')" for w in words) + ")"
    cases = " ".join(f"WHEN {has('x' if everywhere else 'head', words)} THEN '{kind}'" for kind, everywhere, words in tb.PAGE_MARKERS)
    return f"""SELECT doc_id, page, CASE WHEN len(s) = 0 THEN 'unknown' {cases} WHEN len(regexp_extract_all(raw, '{tb.PAGE_ROW}')) >= 3 THEN 'boq' ELSE 'unknown' END AS page_class
      FROM (SELECT *, lower(raw) AS x, lower(array_to_string(s[1:3], ' ')) AS head FROM (SELECT doc_id, page, array_to_string(lines, chr(10)) AS raw,
      list_filter(list_transform(lines, lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS s FROM {_PAGES.replace("coalesce(text, '')", _HEADED)}))"""


@query("page_class", _page_sql())
def page_class(spark, sf):
    return tx.pages_of(docs(spark, sf).selectExpr("doc_id", f"{_HEADED} AS text")).select("doc_id", "page", tb.page_class(F.col("lines")).alias("page_class"))


_WITH_HEADS = "concat({}, CASE WHEN doc_id % 3 = 0 THEN concat({nl}, '  Scope of Work | qty | unit', {nl}, 'payment terms') ELSE concat({nl}, 'The BOQ, rate and amount') END)"


def _section_line_sql() -> str:
    kinds = " ".join(f"WHEN regexp_matches(title, '(?i){'|'.join(p)}') THEN '{k}'" for k, p in tb.SECTION_LINES)
    terms = " + ".join(rf"regexp_matches(lower(title), '\b{t}\b')::int" for t in tb.TABLE_TERMS)
    return rf"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split({_WITH_HEADS.format("coalesce(text, '')", nl='chr(10)')}, chr(10)) AS ls FROM documents)),
      p AS (SELECT doc_id, (i - 1) // 20 + 1 AS page, ls[i] AS line, {_TRIM.format('ls[i]')} AS title, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(ls[i]) - 1 AS before FROM l)
      SELECT doc_id, page, before + length(line) - length(regexp_replace(line, '^\s+', '')) AS start, before + length(line) - length(regexp_replace(line, '^\s+', '')) + length(title) AS "end", section, title,
      regexp_matches(title, '\|.*\|') OR regexp_matches(lower(title), '\bitem\s*no\b') OR {terms} >= 2 AS is_table FROM (SELECT *, CASE {kinds} END AS section FROM p) WHERE section IS NOT NULL"""


@query("section_lines", _section_line_sql())
def section_lines(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{_WITH_HEADS.format('text', nl='chr(10)')} AS text".replace("concat(text", "concat(coalesce(text, '')", 1))
    return tb.section_lines(tx.pages_of(d))


@query(
    "catalog_text",
    """SELECT p_partkey, array_to_string(list_transform(string_split(t, ' '), lambda w: CASE WHEN regexp_matches(replace(w, 'o', ''), '\\p{L}') THEN replace(w, '0', 'o') ELSE w END), ' ') AS catalog_text
       FROM (SELECT p_partkey, trim(regexp_replace(lower(concat(' F0AM  ', p_name, ' 100 o0 IS:', p_partkey, '0mm')), '\\s+', ' ', 'g')) AS t FROM part)""",
)
def catalog_text(spark, sf):
    t = F.concat(F.lit(" F0AM  "), "p_name", F.lit(" 100 o0 IS:"), F.col("p_partkey").cast("string"), F.lit("0mm"))
    return table(spark, sf, "part").select("p_partkey", ph.catalog_text(t).alias("catalog_text"))

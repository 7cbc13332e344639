"""Entity spans, relations and row assembly.

Spans are half-open character ranges of a document. Extraction of spans by
pattern and dictionary is the one Python step (positions of matches); all that
follows is joins and windows partitioned by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SPAN = "doc_id long, ent_id int, text string, type string, start int, end int, conf double, source string"
# Span patterns in their order, what blocks a quantity, and the
# relation rules.
PATTERNS = [
    ("STANDARD", 0.95, r"\b(?:IS|BS|EN|ISO|ACI|ASTM)\s*[:.]?\s*[A-Z]?\d{2,5}(?:\s*[:\-]\s*\d{4})?\b"),
    ("GRADE", 0.93, r"\b(?:M\s?\d{2}|Fe\s?\d{3}[A-Z]?)\b"),
    ("DIMENSION", 0.92, r"\b\d+(?:\.\d+)?\s*(?:mm|cm|m)\b(?:\s*[x×]\s*\d+(?:\.\d+)?\s*(?:mm|cm|m)\b)*"),
    ("QUANTITY", 0.90, r"\b\d[\d,]*(?:\.\d+)?\b"),
    ("ACTION", 0.94, r"\b(?:[Ss]upply|[Pp]roviding|[Ll]aying|[Ff]ixing|[Ii]nstallation|[Ee]rection|[Tt]esting)\b"),
]
RULES = [
    ("HAS_QUANTITY", "MATERIAL", "QUANTITY", 50, []),
    ("HAS_UNIT", "QUANTITY", "UNIT", 10, []),
    ("AT_LOCATION", "MATERIAL", "LOCATION", 100, ["at", "in", "for", "to"]),
    ("OF_GRADE", "MATERIAL", "GRADE", 30, ["grade", "of"]),
    ("COMPLIES_WITH", "MATERIAL", "STANDARD", 80, ["as per", "conforming to", "per", "according to", "complying with"]),
    ("HAS_DIMENSION", "MATERIAL", "DIMENSION", 40, ["thick", "dia", "diameter"]),
]


def find_spans(text: str, terms: dict[str, list[str]]) -> list[tuple]:
    """(text, type, start, end, conf, source) of patterns, then dictionary terms
    (type -> words); overlaps of one type keep the containing span."""
    found: list[tuple] = []

    def add(kind, start, end, conf, source):
        for i, (_, k, s, e, _, _) in enumerate(found):
            if k == kind and start < e and s < end:
                if start <= s and end >= e and (start, end) != (s, e):
                    found[i] = (text[start:end], kind, start, end, conf, source)
                return
        found.append((text[start:end], kind, start, end, conf, source))

    for kind, conf, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            if kind == "QUANTITY" and any(s < m.end() and m.start() < e for _, k, s, e, _, _ in found if k in ("STANDARD", "GRADE", "DIMENSION")):
                continue
            add(kind, m.start(), m.end(), conf, "REGEX")
    for kind, words in terms.items():
        for w in words:
            for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", text, re.IGNORECASE):
                add(kind, m.start(), m.end(), 0.9, "GAZETTEER")
    return sorted(found, key=lambda x: (x[2], x[3], x[1]))


def extract_spans(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """docs (doc_id, text) -> spans, one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPAN.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        for b in batches:
            rows = [(d, i, *s) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, s in enumerate(find_spans(t or "", terms))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SPAN)


def relations(spans: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Band join: a head and a tail after it within the rule's distance.

    Distances fall into buckets of the rule's width, so a head meets the tails
    of two buckets only, whatever the length of the document."""
    spark = spans.sparkSession
    table = spark.createDataFrame([(r, h, t, d) for r, h, t, d, _ in rules], "rule string, head_type string, tail_type string, reach int")
    heads = spans.join(F.broadcast(table), F.col("type") == F.col("head_type"))  # six rows
    heads = heads.select("doc_id", "rule", "tail_type", "reach", F.col("ent_id").alias("head_id"), F.col("end").alias("head_end"))
    heads = heads.withColumn("bucket", F.explode(F.array((F.col("head_end") / F.col("reach")).cast("int"), (F.col("head_end") / F.col("reach")).cast("int") + 1)))
    tails = spans.join(F.broadcast(table.select("rule", F.col("tail_type").alias("t"), "reach")), F.col("type") == F.col("t"))
    tails = tails.select("doc_id", "rule", F.col("ent_id").alias("tail_id"), F.col("start").alias("tail_start"), (F.col("start") / F.col("reach")).cast("int").alias("bucket"))
    near = heads.join(tails, ["doc_id", "rule", "bucket"]).where("tail_start >= head_end AND tail_start - head_end <= reach")
    return near.select("doc_id", "rule", "head_id", "tail_id", (F.col("tail_start") - F.col("head_end")).alias("distance"), F.round(1 - (F.col("tail_start") - F.col("head_end")) / F.col("reach"), 6).alias("conf"))


def scope_gaps(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Materials without quantity and quantities without unit: anti joins."""
    out = None
    for kind, rule in (("MATERIAL", "HAS_QUANTITY"), ("QUANTITY", "HAS_UNIT")):
        heads = found.where(F.col("rule") == rule).select("doc_id", F.col("head_id").alias("ent_id"))
        gap = spans.where(F.col("type") == kind).join(heads, ["doc_id", "ent_id"], "left_anti").select("doc_id", "ent_id", F.lit(f"NO_{rule[4:]}").alias("gap"))
        out = gap if out is None else out.unionByName(gap)
    return out


def nearest(spans: DataFrame, anchor: str, kind: str, reach: int = 200) -> DataFrame:
    """Nearest span of a kind to each anchor, those after it preferred by 100.

    As-of style: candidates are the last one before and the first one after,
    found by windows over the document in order; no pairs are formed."""
    w = Window.partitionBy("doc_id").orderBy("start", "ent_id")
    is_kind = F.col("type") == kind
    before = F.last(F.when(is_kind, F.struct("end", "ent_id")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(is_kind, F.struct("start", "ent_id")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = spans.withColumns({"b": before, "a": after}).where(F.col("type") == anchor)
    options = F.filter(
        F.array(
            F.struct(F.greatest(F.col("a.start") - F.col("end"), F.lit(0)).alias("cost"), F.greatest(F.col("a.start") - F.col("end"), F.lit(0)).alias("distance"), F.col("a.ent_id").alias("id")),
            F.struct((F.greatest(F.col("start") - F.col("b.end"), F.lit(0)) + 100).alias("cost"), F.greatest(F.col("start") - F.col("b.end"), F.lit(0)).alias("distance"), F.col("b.ent_id").alias("id")),
        ),
        lambda o: o["id"].isNotNull() & (o["distance"] <= reach),
    )
    return both.select("doc_id", "ent_id", F.array_min(options).alias("o")).where("o IS NOT NULL").select("doc_id", "ent_id", F.col("o.id").alias("near_id"), F.col("o.distance").alias("distance"))


def merge_fragments(spans: DataFrame, gap: int = 5) -> DataFrame:
    """Neighbouring materials at most `gap` apart, with no other span between."""
    w = Window.partitionBy("doc_id").orderBy("start", "ent_id")
    joins = (F.col("type") == "MATERIAL") & (F.lag("type").over(w) == "MATERIAL") & (F.col("start") - F.lag("end").over(w) <= gap)
    islands = spans.withColumn("opens", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("island", F.sum("opens").over(w))
    return islands.where("type = 'MATERIAL'").groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_parts")).drop("island")


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Of overlapping spans the surer (then longer, earlier) one stays. A fold
    over the sorted spans of one document, in the JVM."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "conf", "type", "ent_id")))
    empty = F.array().cast("array<struct<start:int,end:int,conf:double,type:string,ent_id:int>>")

    def step(kept, s):
        last = F.element_at(kept, -1)
        clear = (F.size(kept) == 0) | (s["start"] >= last["end"])
        wins = (s["conf"] > last["conf"]) | ((s["conf"] == last["conf"]) & (s["end"] - s["start"] > last["end"] - last["start"]))
        return F.when(clear, F.concat(kept, F.array(s))).when(wins, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))).otherwise(kept)

    docs = spans.groupBy("doc_id").agg(ordered.alias("all"))
    return docs.select("doc_id", F.explode(F.aggregate("all", empty, step)).alias("s")).select("doc_id", "s.*")


def bioes_tags(types: str = "types"):
    """BIOES tags of an array of token types ('O' outside): runs of one type."""

    def tag(t, i):
        before, after = F.get(types, i - 1), F.get(types, i + 1)
        first, last = ~F.coalesce(before == t, F.lit(False)), ~F.coalesce(after == t, F.lit(False))
        kind = F.when(first & last, "S").when(first, "B").when(last, "E").otherwise("I")
        return F.when(t == "O", "O").otherwise(F.concat(kind, F.lit("-"), t))

    return F.transform(types, tag)


def bioes_valid(tags: str = "tags"):
    """Whether every I and E follows B or I of its type, and every B and I is
    followed by I or E of it."""
    kind, name = (lambda t: F.substring(t, 1, 1)), (lambda t: F.substring(t, 3, 2**31 - 1))

    def fine(t, i):
        before, after = F.coalesce(F.get(tags, i - 1), F.lit("O")), F.coalesce(F.get(tags, i + 1), F.lit("O"))
        ok_before = F.when(kind(t).isin("I", "E"), kind(before).isin("B", "I") & (name(before) == name(t))).otherwise(True)
        ok_after = F.when(kind(t).isin("B", "I"), kind(after).isin("I", "E") & (name(after) == name(t))).otherwise(True)
        return ok_before & ok_after

    return F.forall(F.transform(tags, fine), lambda x: x)


def spans_of_tags(spark: SparkSession, tagged: DataFrame) -> DataFrame:
    """Token spans of BIOES tags: islands that open at B and S. The type is that
    of an island's first token, the least where documents share an id, so that
    it does not depend on the order of rows."""
    tokens = tagged.select("doc_id", F.posexplode("tags").alias("i", "tag")).where("tag <> 'O'")
    w = Window.partitionBy("doc_id").orderBy("i")
    islands = tokens.withColumn("island", F.sum(F.substring("tag", 1, 1).isin("B", "S").cast("int")).over(w))
    return islands.groupBy("doc_id", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min(F.struct("i", F.substring("tag", 3, 2**31 - 1).alias("type")))["type"].alias("type")).drop("island")

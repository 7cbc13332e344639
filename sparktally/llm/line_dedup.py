"""Operator 10: near-duplicate lines by an exact set-similarity join.
DataFrame operations only.

A line is the set of its distinct words. Lines with equal sets are one entry, at
the first place that has it, and entries are numbered in the order of places.
The words of an entry are ordered by rarity: by the count of their hash slot in
the whole corpus (`slots` slots, a table whose size never grows), then by hash.
Of two entries with Jaccard 0.8 or more, the larger has one of its first
n - ceil(0.8 n) + 1 words among the first n - ceil(8/9 n) + 1 of the smaller
(prefix filter); entries of fewer than four words resemble only equal ones.
Postings of these prefixes are joined by word, a join that may split the list of
a frequent word over tasks. Inside the join, sizes (length filter), the word's
places in both entries (positional filter) and parity sketches bound the
overlap. Of an entry's candidates only one is looked at first, by the sketches the
closest: of the first entries with one of its rarest words, else of the join.
Its words and the entry's are fetched, and Jaccard decides. Entries that this candidate does not
match then meet all their candidates. Later matches are
removed: a line goes if an earlier line (by document id, then line number) of
the input is at least 0.8 similar to it.

Defined results: words are runs of anything but ASCII white space, in lower
case; lines without words stay; a line of one to three words goes only if an
earlier one has the same words; null text is empty; null ids come last;
documents equal in id and text are one document, so neither loses lines to the
other, and both are returned; very long lines and texts are taken whole; an
empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import SPACE, setting, shuffles_removed, stored

LAST = 2**63 - 1
SLOTS = 1 << 18
#: Entries of more words have parities of twice as many classes.
LONG = 32
PLACE = ("doc_id", "text_key", "line_no")


def _plain(text: str, ends: str = "\t\x0b\x0c\r") -> Column:
    """A text in lower case, with spaces for other white space within lines. To
    split that at one plain character needs no pattern matching, and is several
    times faster. To look whether there is any is cheaper than to replace it."""
    low = out = F.lower(F.col(text))
    for c in ends:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(reduce(Column.__or__, (F.contains(low, F.lit(c)) for c in ends)), out).otherwise(low)


def _split(line: str) -> Column:
    """Words of a plain text's line and empty strings."""
    return F.split(line, " ")


def _words(line: str) -> Column:
    """Distinct words of a line."""
    return F.array_remove(F.array_distinct(F.split(_plain(line), " ")), "")


def _slot(word, slots: int) -> Column:
    return F.hash(word).bitwiseAND(F.lit(slots - 1))


def _least(n: Column, percent: int) -> Column:
    """Fewest words that an entry of n shares with a match."""
    return F.ceil(n * percent / 100).cast("int")


def _least_of_smaller(n: Column, percent: int) -> Column:
    """Fewest words that an entry of n shares with a match that is no smaller."""
    return F.ceil(n * (2 * percent) / (100 + percent)).cast("int")


def rarity(docs: DataFrame, slots: int = SLOTS) -> Column:
    """Array of `slots` numbers: four times the binary logarithm of how many
    words of all texts fall into a slot."""
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(_plain("text"), "\n")).alias("line"))
    words = lines.select(F.explode(_split("line")).alias("w"))
    counts = words.groupBy(_slot("w", slots).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    level = F.coalesce(F.floor(4 * F.log2("n")), F.lit(0)).cast("int")
    every = spark.range(slots).join(F.broadcast(counts), "id", "left").select(F.struct("id", level.alias("level")).alias("s"))
    # All slots are counted in the fast map, which by default takes 2^16 keys.
    with shuffles_removed(spark), setting(spark, "spark.sql.codegen.aggregate.fastHashMap.capacityBit", "19"):
        one = every.agg(F.to_json(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["level"]))).first()[0]
    return F.from_json(F.lit(one), "array<int>")  # a constant of the plan


def _some_left(n: Column, percent: int) -> Column:
    """Entries of n words that can match others than equal ones."""
    return n * (100 - percent) >= percent


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line (plain)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_key"), F.split(_plain("text"), "\n").alias("parts"))
    # A text's hash once, not for every line. Outer: for an inner explode Spark adds a filter that computes the array once more.
    return keyed.select("doc_id", "text_key", F.posexplode_outer("parts").alias("line_no", "line")).where("line_no IS NOT NULL")


def _parity(t: str, odd: bool = False) -> Column:
    """Parities of 64 classes of tokens, or of odd tokens: a shift takes the
    lowest six bits of a hash."""
    one = F.lit(1).cast("long")
    return F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", x.bitwiseAND(one) if odd else one, F.hash(x))))


def line_table(docs: DataFrame, percent: int = 80, slots: int = SLOTS) -> DataFrame:
    """Stored, one row per line that has words: its place, entry (128 bits of its
    set), n, prefix, and sketches z and q. All tokens are computed here, once."""
    level = rarity(docs, slots)
    # Never null: arrays that can't hold nulls are sorted as plain numbers.
    slot = lambda w: F.coalesce(F.get(level, _slot(w, slots)), F.lit(0)).cast("long")
    token = lambda w: F.call_function("shiftleft", slot(w), F.lit(55)).bitwiseOR(F.call_function("shiftrightunsigned", F.xxhash64(w), F.lit(9)))
    words = lines_of(docs).select(*PLACE, F.transform(_split("line"), token).alias("h"))
    tokens = words.select(*PLACE, F.sort_array(F.array_except("h", F.array(token(F.lit(""))))).alias("t"))
    n = F.size("t")
    # A prefix needs no order of its own any more: 32 bits of a token will do.
    prefix = F.when(_some_left(n, percent), F.transform(F.slice("t", F.lit(1), n - _least(n, percent) + 1), lambda x: F.hash(x)))
    return stored(
        tokens.select(
            *PLACE, F.xxhash64("t").alias("e1"), F.xxhash64(F.lit(1), "t").alias("e2"), n.alias("n"), prefix.alias("prefix"), _parity("t").alias("z"),
            F.when(n > LONG, _parity("t", odd=True)).otherwise(F.lit(0).cast("long")).alias("q"),
        ),
        "lines",
    ).where("n > 0")  # a filter on t would compute it twice


def entries_of(held: DataFrame) -> DataFrame:
    """Stored, one row per distinct set: eid (ascending with its first place),
    e1, e2, n, prefix, z, q, the place, and whether it occurs again."""
    place = F.struct(*PLACE)
    each = held.groupBy("e1", "e2").agg(
        F.min(place).alias("place"), *(F.first(c).alias(c) for c in ("n", "prefix", "z", "q")), (F.min(place) < F.max(place)).alias("again")
    )
    ordered = each.select("*", "place.*").repartitionByRange("doc_id", "text_key", "line_no").sortWithinPartitions("doc_id", "text_key", "line_no")
    return stored(ordered.select(F.monotonically_increasing_id().alias("eid"), "e1", "e2", "n", "prefix", "z", "q", "again", *PLACE), "entries")


def _postings(entries: DataFrame, percent: int, first: int | None = None) -> DataFrame:
    """tok, eid, n, at, z, q, late of the prefixes, or of their `first` words."""
    held = F.col("prefix") if first is None else F.slice("prefix", 1, first)
    return entries.where(_some_left(F.col("n"), percent)).select("eid", "n", "z", "q", "late", F.posexplode(held).alias("at", "tok"))


def _bound(y, x, percent: int) -> Column:
    """Whether entries y and x may match. Nothing that matches fails: of two sets
    of n and xn words with Jaccard 0.8, at least 4/9 (n + xn) are shared and at
    most 1/9 (n + xn) are not, and 80 % of the larger are in the smaller."""
    n, xn, both = y("n"), x("n"), y("n") + x("n")
    z, q = y("z").bitwiseXOR(x("z")), y("q").bitwiseXOR(x("q"))
    return (
        (100 * F.least(n, xn) >= percent * F.greatest(n, xn))
        & ((100 + percent) * F.bit_count(z) <= (100 - percent) * both)
        & ((F.least(n, xn) <= LONG) | ((100 + percent) * (F.bit_count(q) + F.bit_count(z.bitwiseXOR(q))) <= (100 - percent) * both))
    )


def _packed(postings: DataFrame, percent: int) -> DataFrame:
    """tok, eid, z, q and m: n, n - at, whether the word is early enough in the smaller
    entry of a pair, and late, in one number. Most of the join's time goes into its
    condition, which reads these columns for every pair of a word's postings."""
    sure = lambda c: F.coalesce(c, F.lit(0))
    n, left = F.col("n"), F.col("n") - F.col("at")
    flags = F.when(left >= _least_of_smaller(n, percent), F.lit(2)).otherwise(F.lit(0)) + F.when(F.col("late"), F.lit(1)).otherwise(F.lit(0))
    m = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(left.cast("long"), 2)).bitwiseOR(flags.cast("long"))
    return postings.select("tok", *(sure(F.col(c)).alias(c) for c in ("eid", "z", "q")), sure(m).alias("m"))


def candidates(small: DataFrame, large: DataFrame, percent: int, either: bool = False) -> DataFrame:
    """(late, early) of all pairs of postings, the first the smaller entry's, that
    may match and whose later entry looks for a match. No condition is about
    one side alone, so that a self-join shuffles its postings once. With `either`
    side's entry the smaller one, for which that join needs no second pass."""
    low = F.lit(2**32 - 1)
    of = {"n": lambda m: F.shiftright(m, 32), "left": lambda m: F.shiftright(m.bitwiseAND(low), 2)}
    side = lambda s: lambda c: of[c](F.col(f"{s}.m")) if c in of else F.col(f"{s}.{c}")
    y, x = side("y"), side("x")
    has = lambda a, flag: a("m").bitwiseAND(F.lit(flag).cast("long")) != 0
    n, xn, z = y("n"), x("n"), y("z").bitwiseXOR(x("z"))
    # a's word is early enough and a.n <= b.n, as one comparison of both sides.
    of_smaller = lambda a, b: F.when(has(a, 2), a("m")).otherwise(F.lit(LAST)) <= b("m").bitwiseOR(low)
    met = (
        (of_smaller(y, x) | of_smaller(x, y) if either else of_smaller(y, x))
        & ((100 + percent) * F.bit_count(z) <= (100 - percent) * (n + xn))  # most pairs fail here
        & F.when(y("eid") > x("eid"), has(y, 1)).otherwise(has(x, 1))
        & (y("eid") != x("eid"))
        & ((100 + percent) * F.least(y("left"), x("left")) >= percent * (n + xn))
        & _bound(y, x, percent)
    )
    pairs = _packed(small, percent).alias("y").join(_packed(large, percent).alias("x"), (F.col("y.tok") == F.col("x.tok")) & met)
    return pairs.select(F.greatest(y("eid"), x("eid")).alias("late"), F.least(y("eid"), x("eid")).alias("early"), F.bit_count(z).alias("differ"))


def closest(pairs: DataFrame) -> DataFrame:
    """Of (late, early, differ) the early entry whose sketch differs least."""
    return pairs.groupBy("late").agg(F.min(F.struct("differ", "early")).alias("b")).select("late", "b.early")


def frequent(postings: DataFrame, more_than: int, slots: int = SLOTS) -> Column:
    """Whether a posting's word may have more than so many: true of all that have,
    and of others in their slot. A table of `slots` marks, whose size never grows,
    is looked up; a join would pass on most postings of a large corpus."""
    return _marked(postings, more_than, slots)[0]


def _marked(postings: DataFrame, more_than: int, slots: int = SLOTS) -> tuple[Column, int]:
    """frequent(), and how many words have more than so many postings."""
    one, slot = F.lit(1).cast("long"), F.hash("tok").bitwiseAND(F.lit(slots - 1))
    often = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > more_than)
    # 64 marks a number: a constant is part of each plan, and of what the driver keeps about it.
    bits = often.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", one, slot.bitwiseAND(F.lit(63)))).alias("bits"), F.count(F.lit(1)).alias("words"))
    marks, words = [0] * -(-slots // 64), 0
    with shuffles_removed(postings.sparkSession):
        for r in bits.collect():  # at most a row for 64 slots
            marks[r["id"]] = r["bits"]
            words += r["words"]
    held = F.get(F.from_json(F.lit(str(marks)), "array<bigint>"), F.shiftright(slot, 6))
    return F.call_function("shiftrightunsigned", held, slot.bitwiseAND(F.lit(63))).bitwiseAND(one) == 1, words


def heads(entries: DataFrame, percent: int, broadcast_rows: int, first: int = 6, hubs: int = 32, share: int = 8) -> DataFrame:
    """Stored (late, early): entries and the closest of the hubs of their rarest
    words that may match. A word's hubs are the first entries that have it so
    early in their order, one of each of `hubs` classes of entries. A member of
    a large group of copies finds a match here, at a few comparisons a member,
    and so doesn't meet the whole group. Words of a group have much the same hubs:
    an entry's words share the classes out, in shares of at least so many hubs, and
    so it hardly meets a hub twice. Most words that no more than twice `hubs`
    entries have so early, of which hubs would be the most part, are left to the
    join. Where hubs are too many to be broadcast, a word's postings meet in one
    shuffle, from which both its hubs and those that look for one are read."""
    own = _postings(entries.withColumn("late", F.lit(True)), percent, first)
    # n and at in one number, and never null: both sides below have the same columns and filters, and so share a shuffle.
    sure = lambda c: F.coalesce(c, F.lit(0))
    own = own.select(*(sure(F.col(c)).alias(c) for c in ("tok", "eid", "z", "q")), sure(F.shiftleft("n", 4) + F.col("at")).alias("na"))
    often, words = _marked(own, 2 * hubs)
    own = own.where(often)
    shared = words * hubs > broadcast_rows
    if shared:
        own = own.repartition("tok")
    # min_by of numbers, not the least row: that is hashed, not sorted.
    of = lambda c: F.min_by(c, "eid").alias(c)
    kept = own.groupBy("tok", sure(F.pmod(F.xxhash64("eid"), F.lit(hubs)).cast("int")).alias("c")).agg(F.min("eid").alias("eid"), of("na"), of("z"), of("q"))
    if not shared:
        kept = stored(kept, "hubs")
        if kept.count() <= broadcast_rows:
            kept = F.broadcast(kept)
    col = lambda side, c: F.shiftright(f"{side}.na", 4) if c == "n" else F.col(f"{side}.{c}")
    y, x = (lambda c: col("y", c)), (lambda c: col("x", c))
    shares = F.least(y("n") - _least(y("n"), percent) + 1, F.lit(first), F.lit(max(1, hubs // share)))
    own_share = F.pmod(x("c"), shares) == F.pmod(y("na").bitwiseAND(F.lit(15)), shares)
    near = own.alias("y").join(kept.alias("x"), (y("tok") == x("tok")) & (y("eid") > x("eid")) & own_share & _bound(y, x, percent))
    differ = F.bit_count(y("z").bitwiseXOR(x("z")))
    return stored(closest(near.select(y("eid").alias("late"), x("eid").alias("early"), differ.alias("differ"))), "heads")


def _fetch(docs: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """Plain lines (eid, line, n: its distinct words) of the wanted entries (eid, place), from the texts, one row
    an entry, also where rows of docs are repeated. Wanted lines have a fixed
    width; they are broadcast, by document, only while they are few."""
    lines = stored(wanted, "wanted")
    n = lines.count()
    by_doc = lines.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "eid")).alias("wanted"))  # at most a document's lines
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    met = texts.join(F.broadcast(by_doc) if n <= broadcast_rows else by_doc, ["doc_id", "text_key"])
    parts = met.select(F.split("text", "\n").alias("parts"), F.explode("wanted").alias("w"))
    lines = parts.select("w.eid", F.get("parts", F.col("w.line_no")).alias("line")).dropDuplicates(["eid"])
    return lines.select("eid", _plain("line").alias("line"), F.size(_words("line")).alias("n"))


def verified(docs: DataFrame, pairs: DataFrame, entries: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """Of stored pairs (late, early), the late ones whose words match."""
    ends = pairs.select(F.col("late").alias("eid")).unionByName(pairs.select(F.col("early").alias("eid"))).distinct()
    lines = stored(_fetch(docs, ends.join(entries.select("eid", *PLACE), "eid"), broadcast_rows), "words")
    of = lambda side, line, n: lines.select(F.col("eid").alias(side), F.col("line").alias(line), F.col("n").alias(n))
    sides = pairs.join(of("late", "y", "yn"), "late").join(of("early", "x", "xn"), "early")
    # A stored line is less to write and to shuffle than its words. It is plain and its words are
    # counted already: this becomes a condition of the join, which computes again what it names again.
    shared = F.size(F.array_remove(F.array_intersect(_split("x"), _split("y")), ""))
    return sides.where((100 + percent) * shared >= percent * (F.col("xn") + F.col("yn"))).select(F.col("late").alias("eid")).distinct()


def matches(docs: DataFrame, entries: DataFrame, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """Entries (eid) that an earlier entry matches."""
    some = heads(entries, percent, broadcast_rows)
    held = some.select(F.col("late").alias("eid"), F.lit(False).alias("late"))
    if some.count() <= broadcast_rows:
        held = F.broadcast(held)
    all_ = _postings(entries.join(held, "eid", "left").withColumn("late", F.coalesce("late", F.lit(True))), percent)
    others = closest(candidates(all_, all_, percent))
    first = stored(some.unionByName(others), "first")
    found = stored(verified(docs, first, entries, percent, broadcast_rows), "found")
    open_ = stored(first.join(found.select(F.col("eid").alias("late")), "late", "left_anti").select(F.col("late").alias("eid")), "open")
    n = open_.count()
    if not n:
        return found
    if n <= broadcast_rows:
        open_ = F.broadcast(open_)
    some = stored(_postings(entries.join(open_, "eid", "left_semi").withColumn("late", F.lit(True)), percent), "some")
    if n <= broadcast_rows // 10:  # ten postings an entry, each of a fixed width
        some = F.broadcast(some)
    all_ = _postings(entries.withColumn("late", F.lit(False)), percent)
    near = candidates(all_, some, percent, either=True)  # pairs of open entries, too: all_ has the earlier one
    rest = stored(near.select("late", "early").distinct().join(first, ["late", "early"], "left_anti"), "rest")
    return stored(found.unionByName(verified(docs, rest, entries, percent, broadcast_rows)), "found")


def remove_lines(docs: DataFrame, percent: int = 80, broadcast_rows: int = 500_000, slots: int = SLOTS) -> DataFrame:
    """docs (doc_id, text, ...) with later matches taken out of text, and
    n_lines and n_removed added."""
    held = line_table(docs, percent, slots)
    entries = entries_of(held)
    gone = matches(docs, entries, percent, broadcast_rows).withColumn("gone", F.lit(True))
    # Only entries that lose lines somewhere: all, or all but the first.
    first = F.struct(*PLACE)
    losing = entries.join(gone, "eid", "left").where("again OR gone").select("e1", "e2", F.when(F.col("gone").isNull(), first).alias("stay"))
    lost = held.select(*PLACE, "e1", "e2").join(losing, ["e1", "e2"]).where(F.col("stay").isNull() | (F.col("stay") != first))
    by_doc = stored(lost.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("lost")), "lost")  # at most a document's lines
    lines_lost = by_doc.agg(F.sum(F.size("lost") + 8)).first()[0] or 0
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_key": F.xxhash64("text")})
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = keyed.join(F.broadcast(by_doc) if lines_lost <= 4 * broadcast_rows else by_doc, ["_id", "_key"], "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("lost", i)), "\n")
    return joined.withColumns(
        {
            "text": F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept),
            "n_lines": F.size(parts).cast("long"),
            "n_removed": F.coalesce(F.size("lost"), F.lit(0)).cast("long"),
        }
    ).drop("_id", "_key", "lost")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier line resembles."""
    out = remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB for op10_line_dedup. Words are ordered by exact counts there.
SQL10 = rf"""
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
s AS (SELECT doc_id, i, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '{SPACE}'), lambda w: w <> ''))) AS g FROM l),
e AS (SELECT g, len(g) AS n, min((doc_id, i)) AS place, row_number() OVER () AS e FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT e, place, n, unnest(g) AS tok FROM e),
t AS (SELECT e, place, tok FROM (SELECT u.*, row_number() OVER (PARTITION BY e ORDER BY c, tok) AS r FROM u JOIN (SELECT tok, count(*) AS c FROM u GROUP BY tok) USING (tok))
      WHERE r <= n - (80 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT y.e AS e, x.e AS x FROM t x JOIN t y ON x.tok = y.tok AND x.place < y.place),
gone AS (SELECT DISTINCT p.e FROM p JOIN e x ON x.e = p.x JOIN e y ON y.e = p.e
         WHERE 100 * len(list_intersect(x.g, y.g)) >= 80 * (x.n + y.n - len(list_intersect(x.g, y.g)))),
lost AS (SELECT s.doc_id, s.i FROM s JOIN e ON s.g = e.g LEFT JOIN gone ON gone.e = e.e WHERE gone.e IS NOT NULL OR e.place <> (s.doc_id, s.i))
SELECT doc_id, count(*) AS n_lines, count(lost.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (lost.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN lost USING (doc_id, i) GROUP BY doc_id
"""

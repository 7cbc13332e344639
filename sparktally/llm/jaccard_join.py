"""Operator 9: exact Jaccard join of documents on word shingles, in the metric
space of Jaccard distance.

1  Every document's set meets the corpus-wide document counts of its shingles
   (`_blocks.exchange`). A partner has at least 80 % of a document's shingles,
   so documents with fewer shared shingles than that are done: no links.
2  Documents with equal sets are one class. From here on only classes count.
3  The outer pivots are the single shingles. A class is at distance 1 from
   every pivot that it lacks; its nearest region is that of its rarest shingle,
   and the triangle inequality at distance 0.2 makes it a boundary document of
   just its n - ceil(0.8 n) + 1 rarest ones. Linked classes share one of them,
   so regions that share a class are joined to clusters (as components, without
   any pairs).
4  Inside a cluster distances to documents say something: pivot documents
   split it into Voronoi regions, windows of twice the link distance replicate
   boundary documents, and regions are split again until they are small or
   windows stop splitting them; there, each document that is not yet connected
   is compared with all others. Classes already in one component need no
   comparison. Clusters beyond `group_limit` classes are spread over tasks as
   pairs of sub-blocks, so that no task gets an unbounded group.
5  Components of the links give every document its component id.

Defined results: words are runs of anything but ASCII white space, A-Z lowered;
fewer than five words are one shingle; no words (or null text) is an empty set,
linked with nothing; repeated rows link with each other; null ids never become
a component id unless all ids of a component are null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._blocks import Docs, blocks, exchange, gram_starts, grams, mix, words
from ._components import components
from ._shared import SPACE, map_batches, partitions, stored

DOC = "block long, pos int, doc_id long, text_key long, n_shingles long, cls long, singles int, shared binary"


def doc_sets(docs: Docs, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block, and the sets of its documents as sorted
    pairs: document, index of key."""
    h, offsets, _, _ = words(docs, lower=True)
    starts, doc = gram_starts(offsets, size)
    found, owner = [grams(h, size)[starts]], [doc]
    for n in range(1, size):
        short = np.flatnonzero(np.diff(offsets) == n)
        if len(short):
            found.append(grams(h, n)[offsets[short]])
            owner.append(short)
    keys, index = np.unique(np.concatenate(found), return_inverse=True)
    pairs = np.concatenate(owner) * max(len(keys), 1) + index
    pairs.sort()
    if len(pairs):
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return keys, pairs // max(len(keys), 1), pairs % max(len(keys), 1)


def _keys(docs: Docs, size: int) -> tuple[np.ndarray, np.ndarray]:
    keys, _, index = doc_sets(docs, size)
    return keys, np.bincount(index, minlength=len(keys))


def rarity(df: np.ndarray) -> np.ndarray:
    """Classes of document counts: 1, 2, 3-4, 5-8 and so on are 1, 2, 3, 4. That
    is all the order of rarity needs, and far fewer bits to send."""
    return np.ceil(np.log2(df)).astype(np.int64) + 1


def _least(n, percent: int):
    """Fewest shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _shared(block: int, docs: Docs, keys: np.ndarray, totals: np.ndarray, size: int, percent: int):
    _, doc, index = doc_sets(docs, size)
    n = len(docs.ids)
    sizes = np.bincount(doc, minlength=n)
    df = totals[index].astype(np.int64)
    common = np.bincount(doc, df >= 2, n).astype(np.int64)
    keep = (sizes > 0) & (common >= _least(sizes, percent))
    cls = np.zeros(n, np.uint64)
    np.add.at(cls, doc, mix(keys[index] + np.uint64(0x5851F42D4C957F2D)))
    use = keep[doc] & (df >= 2)
    doc, index, df = doc[use], index[use], df[use]
    order = np.lexsort((keys[index], df, doc))
    flat = keys[index[order]]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    shared = [flat[bounds[i] : bounds[i + 1]].tobytes() if keep[i] else None for i in range(n)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, block), pa.int64()),
            pa.array(np.arange(n), pa.int32()),
            pa.array(docs.ids, pa.int64(), mask=~docs.has_id),
            # Spark's xxhash64 of the text, for joins with its rows.
            pa.array(np.array([xxhash.xxh64_intdigest(docs.text(i), 42) for i in range(n)], np.uint64).view(np.int64)),
            pa.array(sizes, pa.int64()),
            pa.array(cls.view(np.int64)),
            pa.array((sizes - common).astype(np.int32)),
            pa.array(shared, pa.binary()),
        ],
        [x.split()[0] for x in DOC.split(", ")],
    )


def _postings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(shingle, class) of each class's rarest shingles."""
    for b in batches:
        toks, ids = [], []
        for c, n, singles, shared in zip(*(b.column(x).to_pylist() for x in ("cls", "n_shingles", "singles", "shared"))):
            t = np.frombuffer(shared, "<i8")[: n - _least(n, percent) + 1 - singles]
            toks.append(t)
            ids.append(np.full(len(t), c))
        if toks:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks)), pa.array(np.concatenate(ids))], ["tok", "cls"])


class Region:
    """Exact join of a group of sets by pivots; links end up in a union-find."""

    LEAF, PIVOTS = 48, 8

    def __init__(self, ids: list[int], sizes: list[int], sets: list[np.ndarray], percent: int):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids = np.array(ids, np.int64)[order]
        self.sizes = np.array(sizes, np.int64)[order]
        lengths = np.array([len(s) for s in sets])[order]
        _, self.flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.mask = np.zeros(int(self.flat.max()) + 1, bool)
        self.percent, self.radius = percent, 1 - percent / 100
        self.parent = np.arange(len(ids))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self, members: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent[members]
            self.parent = up

    def _rows(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.bounds[members + 1] - self.bounds[members]
        first = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) - np.repeat(first - self.bounds[members], lengths)
        return self.flat[at], first

    def overlaps(self, i: int, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own = self.flat[self.bounds[i] : self.bounds[i + 1]]
        self.mask[own] = True
        out = np.add.reduceat(self.mask[rows[0]], rows[1], dtype=np.int64)
        self.mask[own] = False
        return out

    def link(self, i: int, members: np.ndarray, rows) -> np.ndarray:
        """Join i with its partners among members; Jaccard distances to all."""
        common = self.overlaps(i, rows)
        union = self.sizes[i] + self.sizes[members] - common
        for j in members[100 * common >= self.percent * union]:
            a, b = self.root(i), self.root(int(j))
            self.parent[max(a, b)] = min(a, b)
        return 1 - common / union

    def exhaust(self, members: np.ndarray, rows) -> None:
        """Compare every member outside the largest component with all."""
        roots = self.roots(members)
        names, counts = np.unique(roots, return_counts=True)
        for i in members[roots != names[counts.argmax()]]:
            self.link(int(i), members, rows)

    def join(self, members: np.ndarray | None = None) -> None:
        todo = [np.arange(len(self.ids)) if members is None else members]
        while todo:
            members = todo.pop()
            if len(np.unique(self.roots(members))) == 1:
                continue
            rows = self._rows(members)
            if len(members) <= self.LEAF:
                self.exhaust(members, rows)
                continue
            # Spread pivots: each next one is the farthest from those before.
            near, distances, pivot = np.full(len(members), np.inf), [], int(members[0])
            for _ in range(self.PIVOTS):
                distances.append(self.link(pivot, members, rows))
                near = np.minimum(near, distances[-1])
                if near.max() == 0:
                    break
                pivot = int(members[near.argmax()])
            # Rounding never leaves a boundary document out.
            inside = np.stack(distances) <= near + 2 * self.radius + 1e-9
            if inside.sum() > 0.75 * len(members) * len(members) or inside.sum(axis=1).max() > 0.8 * len(members):
                self.exhaust(members, rows)
            else:
                todo += [members[x] for x in inside if x.sum() > 1]


def _join_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    group, rows = None, []

    def done():
        ids, sizes, sets = zip(*rows)
        region = Region(list(ids), list(sizes), [np.frombuffer(s, "<u8") for s in sets], percent)
        region.join()
        roots = region.roots(np.arange(len(ids)))
        moved = np.flatnonzero(roots != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(region.ids[moved]), pa.array(region.ids[roots[moved]])], ["a", "b"])

    for b in batches:
        for key, *row in zip(*(b.column(x).to_pylist() for x in ("grp", "cls", "n_shingles", "shared"))):
            if key != group:
                if len(rows) > 1:
                    yield done()
                group, rows = key, []
            rows.append(row)
    if len(rows) > 1:
        yield done()


def sets_of(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One stored row per document: its set's size and class, and, where it may
    have partners, its shingles that other documents have too."""
    out = exchange(
        blocks(docs),
        lambda d: _keys(d, size),
        lambda block, d, k, t: _shared(block, d, k, t, size, percent),
        DOC,
        "<u1",
        rarity,
    )
    return stored(out, "sets")


def links(sets: DataFrame, percent: int = 80, group_limit: int = 800) -> DataFrame:
    """Links between classes, as the edges of a spanning forest of each group:
    (a, b), for the components of all links."""
    spark = sets.sparkSession
    classes = stored(
        sets.where("shared IS NOT NULL").groupBy("cls").agg(*(F.first(x).alias(x) for x in ("n_shingles", "singles", "shared"))), "classes"
    )
    postings = stored(map_batches(classes, lambda it: _postings(it, percent), "tok long, cls long"), "postings")
    hubs = postings.groupBy("tok").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    regions = postings.join(hubs, "tok").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    clusters = components(regions)
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    half = max(1, group_limit // 2)
    placed = (
        clusters.join(sizes, "label")
        .withColumn("k", F.when(F.col("members") <= group_limit, 1).otherwise(F.ceil(F.col("members") / half)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    )
    other = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own"))))
    groups = placed.select(F.col("node").alias("cls"), "label", "own", other.alias("other")).select(
        "cls", F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("grp")
    )
    met = groups.join(classes.select("cls", "n_shingles", "shared"), "cls")
    near = met.repartition(partitions(spark), "grp").sortWithinPartitions("grp", "cls")
    return stored(map_batches(near, lambda it: _join_groups(it, percent), "a long, b long"), "near")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, group_limit: int = 800) -> DataFrame:
    """docs (doc_id, text) -> block, pos (which row), doc_id, text_key (Spark's
    xxhash64 of the text; of an empty one for null), n_shingles, label
    (null without any partner), component_id (smallest doc_id reachable)."""
    sets = sets_of(docs, size, percent)
    merged = components(links(sets, percent, group_limit)).select(F.col("node").alias("cls"), "label")
    alone = F.col("shared").isNull()
    placed = stored(
        sets.where(~alone)
        .select("block", "pos", "doc_id", "text_key", "n_shingles", "cls")
        .join(merged, "cls", "left")
        .select("block", "pos", "doc_id", "text_key", "n_shingles", F.coalesce("label", "cls").alias("label")),
        "placed",
    )
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return (
        placed.join(least, "label")
        .select("block", "pos", "doc_id", "text_key", "n_shingles", "label", "component_id")
        .unionByName(sets.where(alone).select("block", "pos", "doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id")))
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard 0.8 and more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: DuckDB for op9_jaccard_join.
SQL9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda w: w <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

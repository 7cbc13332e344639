"""Operator 8: nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes nearest neighbour in a metric space by one more
component: a vector x gets sqrt(M^2 - |x|^2) (M the largest norm of its shard), a
query gets 0, and the Euclidean distance then falls as the product grows. Every
shard holds about shard_rows vectors, of one power of two of the norm, in a
tree; all queries visit all shards in blocks. A subtree whose distances to the vantage point lie in [lo, hi] has
nothing nearer than max(lo - d, d - hi) (triangle inequality); it is left out
if `factor` times that is beyond the query's k-th best so far. factor 1 is
exact search; larger factors leave out more.

Products of the candidates are summed in double precision, component by
component, so equal vectors get equal scores wherever they are.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; only vectors of equal length are compared; equal
scores go to the smaller id; rows with the query's own id are not its
candidates; repeated rows are each a candidate, but rows of one id are one
query, by the least of their vectors; products beyond the range of doubles are
infinite (or 0) and tie; a query without candidates has
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._shared import map_batches

QUERY_BLOCK = 512
LEAF = 512
HIT = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x with length 1, whatever their size (no square overflows)."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


class Tree:
    """Vantage-point tree over the rows of x, with batches of queries. Distances
    are those of x in units of its own largest norm and of queries of length 1,
    so that tolerances are relative."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.leaf = ids, x, leaf
        y = x / np.abs(x).max()
        self.y = y / np.sqrt(np.einsum("ij,ij->i", y, y).max())
        self.extra = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", self.y, self.y), 0))
        rng = np.random.RandomState(7)
        self.root = self._build(np.arange(len(x)), rng)

    def _build(self, rows: np.ndarray, rng):
        if len(rows) <= self.leaf:
            return np.sort(rows)
        v = int(rows[rng.randint(len(rows))])
        near = self.y[rows] @ self.y[v] + self.extra[rows] * self.extra[v]
        d = np.sqrt(np.maximum(2 - 2 * near, 0))
        order = np.argsort(d, kind="stable")  # halves by rank: copies don't unbalance it
        half = len(rows) // 2
        parts = [(order[:half]), (order[half:])]
        return v, [(float(d[p[0]]), float(d[p[-1]]), self._build(rows[p], rng)) for p in parts]

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of the k best of each query."""
        self.q, self.u, self.qids, self.k, self.factor = q, unit(q), qids, k, factor
        self.kth = np.full(len(q), -np.inf)  # scaled product of the k-th best so far
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self._visit(self.root, np.arange(len(q)))
        return self.best[:3]

    def _distance(self, product: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * product, 0))

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            return self._scan(node, active)
        v, children = node
        d = self._distance(self.u[active] @ self.y[v])
        middle = (children[0][1] + children[1][0]) / 2
        # The nearer half first: it lowers the k-th distance for the other.
        for mine, order in ((d <= middle, (0, 1)), (d > middle, (1, 0))):
            some, far = active[mine], d[mine]
            for c in order:
                lo, hi, child = children[c]
                bound = np.maximum(np.maximum(lo - far, far - hi), 0) * self.factor
                none = np.isinf(self.kth[some])
                reach = np.where(none, np.inf, self._distance(np.where(none, 0, self.kth[some])))
                self._visit(child, some[bound <= reach + 1e-9])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        about = self.u[active] @ self.y[rows].T
        least = self.kth[active]
        if about.shape[1] > self.k + 1 and np.isinf(least).any():  # k and the query itself
            least = np.maximum(least, np.partition(about, -self.k - 1, axis=1)[:, -self.k - 1])
        a, r = np.nonzero(about >= (least - 1e-9)[:, None])
        scaled = about[a, r]
        a, r = active[a], rows[r]
        other = self.ids[r] != self.qids[a]
        a, r, scaled = a[other], r[other], scaled[other]
        if not len(a):
            return
        left, right = self.q[a], self.x[r]
        score = np.zeros(len(a))
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            for j in range(left.shape[1]):
                score += left[:, j] * right[:, j]
        touched = np.zeros(len(self.q), bool)
        touched[a] = True
        bq, bi, bs, bz = self.best
        old = touched[bq]
        nq, ni, ns, nz = (np.concatenate([x[old], y]) for x, y in ((bq, a), (bi, self.ids[r]), (bs, score), (bz, scaled)))
        order = np.lexsort((ni, -ns, nq))
        nq, ni, ns, nz = nq[order], ni[order], ns[order], nz[order]
        first = np.concatenate([[True], nq[1:] != nq[:-1]])
        start = np.flatnonzero(first)
        rank = np.arange(len(nq)) - np.repeat(start, np.diff(np.append(start, len(nq))))
        keep = rank < self.k
        last = rank == self.k - 1
        # Products that overflow or vanish tie, which scaled ones don't show.
        telling = np.isfinite(ns) & (np.abs(ns) > 1e-290)
        self.kth[nq[last]] = np.where(telling, nz, -np.inf)[last]
        self.best = tuple(np.concatenate([x[~old], y[keep]]) for x, y in ((bq, nq), (bi, ni), (bs, ns), (bz, nz)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of one shard (or of queries) as blobs of at most QUERY_BLOCK or 4096."""
    limit = QUERY_BLOCK if kind else 4096
    for b in batches:
        t = pa.table(b) if not isinstance(b, pa.Table) else b
        keys = list(zip(t.column("shard").to_pylist(), t.column("dim").to_pylist()))
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(key, []).append(i)
        for (shard, dim), rows in groups.items():
            for k in range(0, len(rows), limit):
                some = t.take(rows[k : k + limit]).combine_chunks()
                ids = np.asarray(some.column("vec_id").combine_chunks(), dtype="<i8")
                x = _matrix(some.column("v").combine_chunks(), dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([dim], pa.int32()), pa.array([kind], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())],
                    ["shard", "dim", "kind", "ids", "x"],
                )


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    group, tree, parts = None, None, []
    for b in batches:
        for shard, dim, kind, ids, x in zip(*(b.column(c).to_pylist() for c in ("shard", "dim", "kind", "ids", "x"))):
            if (shard, dim) != group:
                group, tree, parts = (shard, dim), None, []
            ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<f8").reshape(-1, dim)
            if kind == 0:
                parts.append((ids, x))
                continue
            if not parts:
                continue
            if tree is None:
                tree = Tree(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
            at, found, score = tree.search(ids, x, k, factor)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 2.0, shard_rows: int = 16_384) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where("vec_id IS NOT NULL").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))

    # Shards of one power of two of the norm: one outlier would flatten all
    # other distances. A double has some 2,100 of them.
    items = sound(vectors).withColumn("most", F.array_max(F.transform("v", F.abs)))
    length = F.aggregate(F.transform("v", lambda x: x / F.col("most")), F.lit(0.0), lambda a, x: a + x * x)
    items = items.withColumn("norm", F.floor(F.log2("most") + F.log2(length) / 2).cast("int"))
    counts = sorted((r.norm, r.n) for r in items.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).collect())
    classes, shards = [], 0
    for norm, n in counts:
        classes.append((norm, shards, max(1, -(-n // shard_rows))))
        shards += classes[-1][2]
    if not shards:
        classes, shards = [(0, 0, 1)], 1
    packed = "shard int, dim int, kind int, ids binary, x binary"
    table = F.broadcast(spark.createDataFrame(classes, "norm int, base int, many int"))
    place = (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")
    held = items.join(table, "norm").select(place.alias("shard"), "dim", "vec_id", "v")
    # One query an id: of rows that repeat it, that with the least vector.
    asked = sound(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.lit(0).alias("shard"), F.size("v").alias("dim"), "vec_id", "v")
    blocks = map_batches(asked, lambda it: _pack(it, 1), packed)
    everywhere = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = map_batches(held, lambda it: _pack(it, 0), packed).unionByName(everywhere.select("shard", "dim", "kind", "ids", "x"))
    met = both.repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "kind")
    hits = map_batches(met, lambda it: _search(it, k, factor), HIT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest neighbours of every twentieth vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: DuckDB for op8_vp_search (exact search).
SQL8 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

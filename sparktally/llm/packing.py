"""Operator 3: hierarchical residual packing of tokenised documents.

Round 0 tokenises each partition, cuts documents longer than a sequence and
packs the pieces best-fit decreasing; bins that are nearly full are final, the
others go on. In every later round a task merges the underfull bins of several
tasks of the round before (a tree), taking whole bins as items of another
best-fit pass. The last round keeps what it has.

A bin has at most `capacity` members, a task at most `items_per_task` bins (more
bins mean more tasks), so memory is bounded. Bins of a round are written to the
shared folder: a lost executor repeats its own tasks only.

Defined results: null text is empty; every row, also a repeated one, is its
own document of at least the one closing id; an empty table gives no pieces;
other columns are ignored; special-token strings are read as the tokenizer's
own file reads them.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import map_batches, stored

CAPACITY = 2048
END = 0
BIN = "sequence_id long, fill int, doc_id array<long>, piece array<int>, start array<long>, length array<int>, crc array<long>"
_LISTS = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()))
#: Code points for which the two libraries split text alike (a test tries each).
_ALIKE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


class Encoder:
    """Ids of byte_bpe_50k. The rank file has the vocabulary of the JSON file
    and is several times faster; texts with rarer code points, where the two
    libraries' Unicode tables could differ, go to the JSON file."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if text.isascii() or not _ALIKE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_encoder() -> Encoder:
    import public_tokenizers as P

    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each bin."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # residual -> open bins
    mask = 0  # bit r: some bin has residual r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := mask >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if left := r - n:
            held = room.setdefault(left, [])
            held.append(b)
            mask |= 1 << left
    return bins


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


class _Bins:
    """Finished bins, handed on in batches."""

    def __init__(self, round_: int):
        self.next = (round_ << 56) | (TaskContext.get().partitionId() << 32)
        self.clear()

    def clear(self):
        self.ids, self.fills, self.rows = [], [], {n: [] for n, _ in _LISTS}

    def add(self, fill: int, members: tuple[list, ...]):
        self.ids.append(self.next)
        self.fills.append(fill)
        for (n, _), m in zip(_LISTS, members):
            self.rows[n].append(m)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(self.ids, pa.int64()), pa.array(self.fills, pa.int32())]
        columns += [pa.array(self.rows[n], pa.list_(t)) for n, t in _LISTS]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, ["sequence_id", "fill", *(n for n, _ in _LISTS)])


def _pack(items: list[tuple[int, tuple]], out: _Bins, capacity: int) -> Iterator[pa.RecordBatch]:
    """items: (length, members). Members of a bin are joined in order."""
    for bin_ in best_fit([n for n, _ in items], capacity):
        parts = [items[i] for i in bin_]
        out.add(sum(n for n, _ in parts), tuple(sum((p[k] for _, p in parts), []) for k in range(len(_LISTS))))
        if len(out.ids) >= 5000:
            yield out.batch()
    if out.ids:
        yield out.batch()


def _first_round(batches: Iterator[pa.RecordBatch], capacity: int, items_per_task: int, make_encoder) -> Iterator[pa.RecordBatch]:
    encode, out, items = make_encoder(), _Bins(0), []
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text")
        for i, doc in enumerate(ids):
            tokens = np.append(encode(texts[i].as_py() or ""), END).astype("<u4")
            for k, (start, n) in enumerate(pieces(len(tokens), capacity)):
                members = [doc], [k], [start], [n], [zlib.crc32(tokens[start : start + n].tobytes())]
                if n == capacity:
                    out.add(n, members)
                else:
                    items.append((n, members))
            if len(out.ids) >= 5000:
                yield out.batch()
            if len(items) >= items_per_task:
                yield from _pack(items, out, capacity)
                items = []
    yield from _pack(items, out, capacity)


def _next_round(batches: Iterator[pa.RecordBatch], capacity: int, items_per_task: int, round_: int) -> Iterator[pa.RecordBatch]:
    out, items = _Bins(round_), []
    for b in batches:
        lists = [b.column(n).to_pylist() for n, _ in _LISTS]
        for fill, *members in zip(b.column("fill").to_pylist(), *lists):
            items.append((fill, tuple(members)))
            if len(items) >= items_per_task:
                yield from _pack(items, out, capacity)
                items = []
    yield from _pack(items, out, capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, slack: int = 16, fan_in: int = 8, items_per_task: int = 100_000, make_encoder=default_encoder) -> DataFrame:
    """docs (doc_id, text) -> one row per bin (columns of BIN).

    A bin with at most `slack` free places is final in its round. Rounds end
    with one task, or when merging no longer lowers the number of bins."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bins = stored(map_batches(rows, lambda it: _first_round(it, capacity, items_per_task, make_encoder), BIN), "pack0")
    done = bins.where(F.col("fill") >= capacity - slack)
    rest, tasks, round_ = bins.where(F.col("fill") < capacity - slack), bins.rdd.getNumPartitions(), 0
    left = rest.count()
    while left > 1:
        before, round_ = left, round_ + 1
        tasks = max(-(-tasks // fan_in), -(-left // items_per_task))
        merged = map_batches(rest.coalesce(tasks), lambda it, r=round_: _next_round(it, capacity, items_per_task, r), BIN)
        bins = stored(merged, f"pack{round_}")
        done = done.unionByName(bins.where(F.col("fill") >= capacity - slack))
        rest = bins.where(F.col("fill") < capacity - slack)
        left = rest.count()
        if tasks == 1 or (tasks > 1 and -(-left // items_per_task) >= tasks and left > 0.95 * before):
            break
    return done.unionByName(rest)


def placements(bins: DataFrame) -> DataFrame:
    """One row per piece, with its place in its sequence."""
    zipped = F.arrays_zip("doc_id", "piece", "start", "length", "crc")
    # Members are laid end to end; a bin's offsets are running sums of lengths.
    offsets = F.aggregate(
        "length",
        F.array(F.lit(0).cast("long")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n.cast("long"))),
    )
    one = F.size("length") == 1
    return (
        bins.select("sequence_id", zipped.alias("m"), F.when(one, F.array(F.lit(0).cast("long"))).otherwise(offsets).alias("o"))
        .select("sequence_id", "o", F.posexplode("m").alias("k", "m"))
        .select(
            "m.doc_id",
            "m.piece",
            "m.start",
            F.col("m.length").cast("long").alias("length"),
            F.col("m.crc").alias("ids_crc32"),
            "sequence_id",
            F.col("o")[F.col("k")].alias("offset"),
        )
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return placements(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""Counting n-grams over a whole corpus with two compact exchanges.

A corpus is first written as blocks of a few MB of text (one row each, in the
shared folder), so a block's content and id are fixed from then on.

ask     each block sends its distinct keys (64-bit hashes of n-grams), with
        their counts in the block, to the hash partition that owns them. Keys
        are aggregated per block first: one that fills a third of the corpus
        costs a partition one entry per block.
answer  the owner adds up each key over all blocks and sends every block the
        totals of its keys, aligned with what it sent.
settle  a block, its text and all its answers meet, and the operator computes
        per document from exact corpus-wide totals.

Nothing is collected on the driver, and a task holds one block or one hash
partition of about keys_per_part keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._shared import map_batches, new_path, parts_for, small_batches

BLOCK_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.RandomState(20240117)
_BYTE = _RNG.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Docs:
    """Documents of a block. ids[i] counts only where has_id[i]."""

    ids: np.ndarray
    has_id: np.ndarray
    offsets: np.ndarray  # of bytes, one more than documents
    data: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _pack(ids: list, texts: list[bytes]) -> bytes:
    head = np.array([len(ids)], "<i8").tobytes()
    known = np.array([x is not None for x in ids], "u1").tobytes()
    values = np.array([x or 0 for x in ids], "<i8").tobytes()
    lengths = np.array([len(x) for x in texts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, values, lengths, known, *texts]))


def unpack(blob: bytes) -> Docs:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids = np.frombuffer(raw, "<i8", n, 8)
    lengths = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    known = np.frombuffer(raw, "u1", n, 8 + 16 * n).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Docs(ids, known, offsets, np.frombuffer(raw, np.uint8, -1, 8 + 17 * n))


def _make_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack(ids, texts)], pa.binary())], ["block", "bytes", "data"]
        )

    for b in batches:
        column = b.column("text")
        for i, doc in enumerate(b.column("doc_id").to_pylist()):
            text = (column[i].as_py() or "").encode()
            if ids and size + len(text) > limit:
                yield row()
                block, ids, texts, size = block + 1, [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text)
    if ids:
        yield row()


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) -> stored blocks (block, bytes, data). A document is
    never split over blocks; null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_batches(rows, lambda it: _make_blocks(it, limit), "block long, bytes long, data binary")
    path = new_path(docs.sparkSession, "blocks")
    with small_batches(docs.sparkSession):
        out.write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def words(docs: Docs, lower: bool = False, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, word offsets of the documents, and the words'
    first and end bytes. Long documents are hashed in chunks of whole words."""
    data, table = docs.data, _LOWER if lower else _BYTE
    n = len(data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[docs.offsets] = True
    solid = ~space
    before = np.concatenate([[True], space[:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(solid & (before | cut[:-1]))
    after = np.concatenate([space[1:], [True]]) if n else np.zeros(0, bool)
    ends = np.flatnonzero(solid & (after | cut[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        base = starts[w]
        v = max(w + 1, int(np.searchsorted(ends, base + chunk, "right")))
        m = int(ends[v - 1] - base)
        powers = np.full(m, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(table[data[base : base + m]] * powers, out=sums[1:])
        s = starts[w:v] - base
        inverse = np.full(int(s[-1]) + 1, _INVERSE, np.uint64)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        hashes[w:v] = (sums[ends[w:v] - base] - sums[s]) * inverse[s]
        w = v
    return mix(hashes), np.searchsorted(starts, docs.offsets, "left"), starts, ends


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word, ignoring documents."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _STEP + hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def gram_starts(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which an n-gram of one document starts, and its document."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(doc)) - first[doc] + offsets[:-1][doc], doc


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted distinct keys by owner, and the owners' bounds."""
    owner = (keys % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(owner, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=parts))])


def squeeze(values: np.ndarray) -> bytes:
    """Fixed-width numbers by byte planes: the high bytes of small counts, and
    of the gaps of sorted keys, take next to nothing."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8"), dtype=np.uint64)


#: (documents of a block) -> sorted distinct keys, and counts or None
Keys = Callable[[Docs], tuple[np.ndarray, np.ndarray]]


def _ask(batches: Iterator[pa.RecordBatch], keys_of: Keys, parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, blob in zip(b.column("block").to_pylist(), b.column("data")):
            keys, counts = keys_of(unpack(blob.as_py()))
            order, bounds = by_part(keys, parts)
            keys, counts = keys[order], counts[order].astype("<u4")
            full = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array(np.full(len(full), block), pa.int64()),
                    pa.array([squeeze_sorted(keys[bounds[p] : bounds[p + 1]]) for p in full], pa.binary()),
                    pa.array([squeeze(counts[bounds[p] : bounds[p + 1]]) for p in full], pa.binary()),
                ],
                ["part", "block", "keys", "counts"],
            )


def _answer(batches: Iterator[pa.RecordBatch], dtype: str, classes: Callable | None) -> Iterator[pa.RecordBatch]:
    rows, keys, counts = [], [], []
    for b in batches:
        rows += zip(b.column("part").to_pylist(), b.column("block").to_pylist())
        keys += [unsqueeze_sorted(x.as_py()) for x in b.column("keys")]
        counts += [unsqueeze(x.as_py(), "<u4") for x in b.column("counts")]
    if not rows:
        return
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
    flat, weights = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(flat)
    sorted_ = flat[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    del flat, sorted_
    sums = np.add.reduceat(weights[order].astype(np.int64), np.flatnonzero(new))
    if classes:
        sums = classes(sums)
    if sums.max() > np.iinfo(dtype).max:
        raise ValueError(f"a total of {sums.max()} does not fit {dtype}")
    totals = np.empty(len(order), dtype)
    totals[order] = sums[np.cumsum(new) - 1]
    for k in range(0, len(rows), 2000):
        some = range(k, min(k + 2000, len(rows)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in some], pa.int64()),
                pa.array([rows[i][0] for i in some], pa.int32()),
                pa.array([squeeze(totals[bounds[i] : bounds[i + 1]]) for i in some], pa.binary()),
            ],
            ["block", "part", "data"],
        )


#: (block id, its documents, keys by owner, their corpus totals) -> result batches
Settle = Callable[[int, Docs, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _settle(batches: Iterator[pa.RecordBatch], keys_of: Keys, parts: int, dtype: str, then: Settle) -> Iterator[pa.RecordBatch]:
    def done():
        docs = unpack(blob)
        keys, _ = keys_of(docs)
        order, _ = by_part(keys, parts)
        totals = np.concatenate([unsqueeze(x, dtype) for x in replies] or [np.zeros(0, dtype)])
        if len(totals) != len(keys):
            raise ValueError(f"block {block}: {len(keys)} keys, {len(totals)} answers")
        aligned = np.empty(len(keys), dtype)
        aligned[order] = totals
        return then(block, docs, keys, aligned)

    block, blob, replies = None, b"", []
    for b in batches:
        for at, part, data in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("data")):
            if part < 0:
                if block is not None:
                    yield from done()
                block, blob, replies = at, data.as_py(), []
            else:
                replies.append(data.as_py())
    if block is not None:
        yield from done()


def exchange(table: DataFrame, keys_of: Keys, then: Settle, schema: str, dtype: str = "<u8", classes: Callable | None = None, keys_per_part: int = 3_000_000) -> DataFrame:
    """table: stored blocks. keys_of gives a block's sorted distinct keys with
    counts; `then` gets them with their totals over all blocks, or with classes
    of the totals (which must fit dtype), and gives rows of schema."""
    spark = table.sparkSession
    size = table.agg(F.sum("bytes")).first()[0] or 0
    owners = parts_for(spark, size // 5, keys_per_part)
    parts = 8 * owners
    asked = map_batches(table.select("block", "data"), lambda it: _ask(it, keys_of, parts), "part int, block long, keys binary, counts binary")
    answers = map_batches(asked.repartition(owners, "part"), lambda it: _answer(it, dtype, classes), "block long, part int, data binary")
    both = table.select("block", F.lit(-1).alias("part"), "data").unionByName(answers)
    homes = parts_for(spark, size, 4 * BLOCK_BYTES)
    met = both.repartition(homes, "block").sortWithinPartitions("block", "part")
    return map_batches(met, lambda it: _settle(it, keys_of, parts, dtype, then), schema)

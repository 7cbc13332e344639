"""Operator 7: repeated passages by compressed FM-indexes.

A passage of `length` words that also starts in a document with a smaller id is
removed. One index over everything would not fit a task, and streaming every
document through every shard's index would grow with the square of the corpus.
So shards are cut by content instead of by document:

1  Every window of 13 words is represented by its least 7-gram (by hash), so
   equal windows have equal representatives. Representatives that only one
   document has are dropped by their corpus-wide document counts
   (`_blocks.exchange`): their windows occur nowhere else.
2  Runs of the other windows with one representative are segments. The shard of
   the representative gets each block's distinct segments once, with the least
   document id that has them there: a passage in a third of the corpus costs an
   entry per block.
3  A shard builds one FM-index (wavelet matrix over the Burrows-Wheeler
   transform, suffixes sorted by their first 16 words) over its distinct
   segments, and streams them through it: backward search, one word at a time,
   for all window ends at once. An interval that has shrunk to one suffix is
   the window's own. The least document id in the interval of the whole window
   is its answer.
4  Blocks meet their answers, compare them with each document's id and remove
   the words of the reported intervals.

Defined results: words are runs of anything but ASCII white space, unchanged;
null text has none; windows are judged on the input; repeated rows of one id
don't remove each other; a null id is never smaller than another and its
document loses nothing; documents shorter than a window stay as they are; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._blocks import BLOCK_BYTES, Docs, blocks, by_part, exchange, gram_starts, grams, mix, squeeze, unpack, unsqueeze, words
from ._shared import SPACE, map_batches, parts_for, stored

WINDOW, SEED = 13, 7
NOBODY = np.iinfo(np.int64).max
_STEP = np.uint64(0xD6E8FEB86659FD93)
OUT = "block long, pos int, doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string"


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for shift in range(self.bits - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]).astype(np.int32)
            self.levels.append((shift, packed, ones, len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, ones, zeros in self.levels:
            word = at >> 6
            below = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            rank = ones[word] + np.bitwise_count(below)
            at = np.where((symbols >> shift) & 1, zeros + rank, at - rank)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position `at`."""
        return self._descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Backward search for patterns of at most `depth` symbols."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int = 16):
        n = len(text)
        order, size = text.astype(np.int64), 1
        while size < depth:
            later = np.zeros(n, np.int64)
            later[: n - size] = order[size:] + 1
            order = np.unique(order * (n + n_symbols + 2) + later, return_inverse=True)[1]
            size *= 2
        self.suffixes = np.argsort(order, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.ranks = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), n_symbols)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of each pattern with one symbol put before it."""
        return self.first[symbols] + self.ranks.rank(symbols, lo), self.first[symbols] + self.ranks.rank(symbols, hi)


def matching_windows(text: np.ndarray, n_symbols: int, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window (by its start in text) the least owner of a position at
    which the same window starts. owner has a value for every position."""
    index = FMIndex(text, n_symbols)
    least = owner[starts].copy()
    live = np.arange(len(starts))
    last = text[starts + length - 1]
    lo, hi = index.first[last], index.first[last + 1]
    for back in range(length - 2, -1, -1):
        keep = hi - lo > 1
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not len(live):
            return least
        lo, hi = index.extend(text[starts[live] + back], lo, hi)
    by_suffix = owner[index.suffixes]
    # Equal windows have one interval: each is reduced once.
    bounds, which = np.unique(lo, return_index=True)
    mins = np.minimum.reduceat(np.append(by_suffix, NOBODY), np.column_stack([bounds, hi[which]]).ravel())[::2]
    least[live] = mins[np.searchsorted(bounds, lo)]
    return least


def _runs(docs: Docs, length: int, seed: int):
    """Word hashes and starts, and the runs of windows with one representative:
    (representative, document, first word, windows)."""
    h, offsets, starts, ends = words(docs)
    at, doc = gram_starts(offsets, length)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return h, offsets, starts, ends, np.zeros(0, np.uint64), empty, empty, empty
    small = grams(h, seed)
    least, place = small[at], at
    for j in range(1, length - seed + 1):
        other = small[at + j]
        less = other < least
        least, place = np.where(less, other, least), np.where(less, at + j, place)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    return h, offsets, starts, ends, least[new], doc[new], at[new], np.diff(np.append(new, len(at)))


def _keys(docs: Docs, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, _, rep, doc, _, _ = _runs(docs, length, seed)
    keys, index = np.unique(rep, return_inverse=True)
    pairs = np.unique(doc * max(len(keys), 1) + index)
    return keys, np.bincount(pairs % max(len(keys), 1), minlength=len(keys))


def _one_or_more(df: np.ndarray) -> np.ndarray:
    return np.minimum(df, 2)


def _content(h: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """A key of each segment; it has its first and last windows, which overlap."""
    whole = grams(h, length)
    return mix(whole[first] * _STEP + whole[first + windows - 1] * np.uint64(3) + windows.astype(np.uint64))


def _segments(block: int, docs: Docs, keys: np.ndarray, totals: np.ndarray, length: int, seed: int, shards: int):
    h, offsets, starts, ends, rep, doc, first, windows = _runs(docs, length, seed)
    use = totals[np.searchsorted(keys, rep)] > 1 if len(rep) else np.zeros(0, bool)
    rep, doc, first, windows = rep[use], doc[use], first[use], windows[use]
    if not len(rep):
        return
    content, where, index = np.unique(_content(h, first, windows, length), return_index=True, return_inverse=True)
    ids = np.where(docs.has_id, docs.ids, NOBODY)[doc]
    least = np.full(len(content), NOBODY)
    np.minimum.at(least, index, ids)
    order, bounds = by_part(rep[where], shards)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    raw = docs.data.tobytes()
    begin, end = starts[first[where]], ends[first[where] + windows[where] + length - 2]
    full = np.flatnonzero(np.diff(bounds))
    blobs = []
    for s in full:
        some = order[bounds[s] : bounds[s + 1]]
        text = b" ".join([raw[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist())])
        blobs.append((squeeze(windows[where][some].astype("<i4")), squeeze(least[some]), pa.compress(text, "zstd", asbytes=True), len(text)))
    uses = [squeeze(x.astype("<i4")) for x in (doc, first - offsets[doc], place[index])]
    n = len(full)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([-1, *full], pa.int32()),
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([uses[0], *(b[0] for b in blobs)], pa.binary()),
            pa.array([uses[1], *(b[1] for b in blobs)], pa.binary()),
            pa.array([uses[2], *(b[2] for b in blobs)], pa.binary()),
            pa.array([0, *(b[3] for b in blobs)], pa.int64()),
        ],
        ["shard", "block", "a", "b", "c", "size"],
    )


def _search(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """rows of one shard: (block, windows, least, text, size) -> the least ids
    of all windows, for each block in its own order."""
    counts = [unsqueeze(r[1], "<i4").astype(np.int64) for r in rows]
    windows = np.concatenate(counts)
    least = np.concatenate([unsqueeze(r[2], "<i8") for r in rows])
    texts = [pa.decompress(r[3], r[4], "zstd", asbytes=True) for r in rows]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    h, _, _, _ = words(Docs(np.zeros(1, np.int64), np.ones(1, bool), np.array([0, len(data)]), data))
    sizes = windows + length - 1
    begin = np.cumsum(sizes) - sizes
    if begin[-1] + sizes[-1] != len(h):
        raise ValueError(f"segments of {begin[-1] + sizes[-1]} words have {len(h)}")
    _, where, index = np.unique(_content(h, begin, windows, length), return_index=True, return_inverse=True)
    mins = np.full(len(where), NOBODY)
    np.minimum.at(mins, index, least)
    # Distinct segments one after the other, a separator (0) after each.
    d_sizes, d_windows = sizes[where], windows[where]
    d_begin = np.cumsum(d_sizes + 1) - (d_sizes + 1)
    seg = np.repeat(np.arange(len(where)), d_sizes)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(d_sizes) - d_sizes, d_sizes)
    vocabulary, ids = np.unique(h, return_inverse=True)
    text = np.zeros(int((d_sizes + 1).sum()), np.int64)
    text[d_begin[seg] + inner] = ids[begin[where][seg] + inner] + 1
    owner = np.repeat(mins, d_sizes + 1)
    w_seg = np.repeat(np.arange(len(where)), d_windows)
    w_first = np.cumsum(d_windows) - d_windows
    starts = d_begin[w_seg] + np.arange(len(w_seg)) - w_first[w_seg]
    found = matching_windows(text, len(vocabulary) + 1, starts, owner, length)
    at = 0
    for r, n in zip(rows, counts):
        which = index[at : at + len(n)]
        at += len(n)
        k = np.repeat(w_first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array([squeeze(found[k])], pa.binary()), pa.array([squeeze(n.astype("<i4"))], pa.binary())], ["block", "a", "b"])


def _search_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    def done():
        for out in _search(rows, length):
            yield out.append_column("shard", pa.array([shard], pa.int32()))

    shard, rows = None, []
    for b in batches:
        for key, *row in zip(*(b.column(x).to_pylist() for x in ("shard", "block", "a", "b", "c", "size"))):
            if key != shard:
                if rows:
                    yield from done()
                shard, rows = key, []
            rows.append(row)
    if rows:
        yield from done()


def _cover(docs: Docs, offsets: np.ndarray, uses: tuple | None, answers: list[tuple], length: int) -> np.ndarray:
    """Which words of a block are covered by a repeated window."""
    covered = np.zeros(int(offsets[-1]) + 1, np.int64)
    if uses:
        doc, first, seg = (unsqueeze(x, "<i4").astype(np.int64) for x in uses)
        least = np.concatenate([unsqueeze(a, "<i8") for a, _ in answers])
        n = np.concatenate([unsqueeze(b, "<i4") for _, b in answers]).astype(np.int64)
        w_first = np.cumsum(n) - n
        many = n[seg]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(offsets[doc] + first, many) + inner
        owner = np.repeat(np.where(docs.has_id, docs.ids, np.iinfo(np.int64).min)[doc], many)
        hit = at[least[np.repeat(w_first[seg], many) + inner] < owner]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + length, -1)
    return np.cumsum(covered)[:-1] > 0


def _remove(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    def done():
        docs = unpack(blob)
        _, offsets, _, _ = words(docs)
        gone = _cover(docs, offsets, uses, answers, length)
        rows = []
        for i in range(len(docs.ids)):
            w, lost = docs.text(i).split(), gone[offsets[i] : offsets[i + 1]]
            kept = b" ".join([x for x, g in zip(w, lost.tolist()) if not g] if lost.any() else w)
            rows.append((len(w), int(lost.sum()), kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        n = len(rows)
        fixed = [pa.array([block] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(docs.ids, pa.int64(), mask=~docs.has_id)]
        types = pa.int64(), pa.int64(), pa.binary(), pa.string()
        return pa.RecordBatch.from_arrays(fixed + [pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in OUT.split(", ")])

    block, blob, uses, answers = None, None, None, []
    for b in batches:
        for at, shard, *data in zip(*(b.column(x).to_pylist() for x in ("block", "shard", "a", "b", "c"))):
            if shard == -2:
                if block is not None:
                    yield done()
                block, blob, uses, answers = at, data[0], None, []
            elif shard == -1:
                uses = data
            else:
                answers.append(data[:2])
    if block is not None:
        yield done()


def remove_repeats(docs: DataFrame, length: int = WINDOW, seed: int = SEED, words_per_shard: int = 2_000_000, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per document (columns of OUT); `kept` has
    the kept words' text if with_text."""
    if not 0 < seed <= length <= 16:
        raise ValueError("a window has at most 16 words, a seed at most a window's")
    spark = docs.sparkSession
    table = blocks(docs)
    size = table.agg(F.sum("bytes")).first()[0] or 0
    # At most all text comes, each word in up to four segments.
    shards = parts_for(spark, 4 * size // 5, words_per_shard)
    schema = "shard int, block long, a binary, b binary, c binary, size long"
    segments = stored(exchange(table, lambda d: _keys(d, length, seed), lambda b, d, k, t: _segments(b, d, k, t, length, seed, shards), schema, "<u1", _one_or_more), "segments")
    asked = segments.where("shard >= 0").repartition(shards, "shard").sortWithinPartitions("shard", "block")
    answers = map_batches(asked, lambda it: _search_batches(it, length), "block long, a binary, b binary, shard int")
    nothing = F.lit(None).cast("binary")
    met = (
        table.select("block", F.lit(-2).alias("shard"), F.col("data").alias("a"), nothing.alias("b"), nothing.alias("c"))
        .unionByName(segments.where("shard = -1").select("block", "shard", "a", "b", "c"))
        .unionByName(answers.select("block", "shard", "a", "b", nothing.alias("c")))
    )
    homes = parts_for(spark, size, 4 * BLOCK_BYTES)
    return map_batches(met.repartition(homes, "block").sortWithinPartitions("block", "shard"), lambda it: _remove(it, length, with_text), OUT)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words that an earlier one has."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: DuckDB for op7_substring_dedup.
SQL7 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM w JOIN f USING (g) WHERE f.first < w.doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]), ' ') END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

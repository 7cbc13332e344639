"""Operator 2: token counts by a unigram model over a trie of pre-tokens.

Each task gathers the distinct pre-tokens of a few MB of text, inserts them in
a trie (sorted, a pre-token's nodes are its prefixes, and equal prefixes are
one node) and computes the unigram model's forward scores node by node, level
by level: best[node] = max over pieces that end there of best[ancestor] +
log p(piece). A prefix that thousands of pre-tokens share is scored once.
Terminal nodes give each pre-token's token count and score; a document's are
sums over its pre-tokens. No shuffle, and the result of each document depends
on its own text only. The memory of terminal counts between chunks is a cache:
when it is full it is emptied, which changes no result.

The model: the pieces of a rank file, with Zipf-Mandelbrot log probabilities
by rank, log p = -log(rank + 2.7) - log(sum of all). Every byte is a piece, so
every text has a segmentation. Of equally good ones the longer last piece wins.

Defined results: null and empty texts have no pre-tokens and score 0; rows are
independent, so repeated rows repeat results; an empty table gives no rows;
other columns are ignored. Pre-tokens longer than MATRIX bytes take the same
recursion one by one.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import map_batches

ROW = "doc_id long, n_pretokens long, n_tokens long, score double"
MATRIX = 40
CHUNK = 2 << 20
CACHE = 300_000
# The vocabulary's pre-token rule, with white space spelled out.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers as P

    return read_ranks(P.path("byte_bpe_50k.tiktoken"))


class Model:
    """Piece log probabilities, found by a hash of the piece's bytes."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        raw = {p: -math.log(r + 2.7) for p, r in ranks.items()}
        norm = math.log(math.fsum(math.exp(x) for x in raw.values()))
        self.logp = {p: x - norm for p, x in raw.items()}
        self.longest = max(map(len, raw))
        self.lengths = sorted({len(p) for p in raw if len(p) <= MATRIX}, reverse=True)
        # A piece's key: polynomial of its bytes, then spread. Table 0 takes the
        # first piece of a slot, table 1 those displaced, table 2 the rest.
        pieces = [p for p in self.logp if len(p) <= MATRIX]
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        if len(set(keys.tolist())) < len(keys):
            raise ValueError("two pieces share a key")
        values = np.array([self.logp[p] for p in pieces])
        self.keys, self.values = np.append(keys, np.uint64(0)), np.append(values, -np.inf)
        self.tables, left = [], np.arange(len(pieces))
        for bits in (20, 18, 16):
            slots = self._slot(keys[left], bits, len(self.tables))
            table = np.full(1 << bits, len(pieces), np.int32)
            _, first = np.unique(slots, return_index=True)
            table[slots[first]] = left[first]
            self.tables.append((bits, table))
            left = np.delete(left, first)
        if len(left):
            raise ValueError("piece table is too small")

    @classmethod
    def _key(cls, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(cls.BASE) + b + 1) & (2**64 - 1)
        return int(cls._spread(np.array([h], np.uint64))[0])

    @staticmethod
    def _spread(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
        return ((keys << np.uint64(11 * k)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Log probabilities of pieces given by their polynomials."""
        keys = self._spread(h)
        out = np.full(len(keys), -np.inf)
        left = np.arange(len(keys))
        for k, (bits, table) in enumerate(self.tables):
            at = table[self._slot(keys[left], bits, k)]
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (at < len(self.keys) - 1)]  # an empty slot displaced nothing
            if not len(left):
                break
        return out


def count_one(token: bytes, model: Model) -> tuple[int, float]:
    """Tokens and score of one pre-token by the plain recursion."""
    best, count = [0.0], [0]
    for end in range(1, len(token) + 1):
        top, n = -math.inf, 0
        for size in range(min(end, model.longest), 0, -1):
            p = model.logp.get(token[end - size : end])
            if p is not None and best[end - size] + p > top:
                top, n = best[end - size] + p, count[end - size] + 1
        best.append(top)
        count.append(n)
    return count[-1], best[-1]


def count_all(tokens: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and scores of distinct, sorted pre-tokens of at most MATRIX bytes."""
    n = len(tokens)
    sizes = np.array([len(t) for t in tokens])
    width = int(sizes.max())
    text = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(n, width)
    # Bytes shared with the row before: nodes deeper than that are new.
    same = np.zeros(n, np.int64)
    if n > 1:
        differ = np.hstack([text[1:] != text[:-1], np.ones((n - 1, 1), bool)])
        same[1:] = np.minimum(np.minimum(differ.argmax(axis=1), sizes[1:]), sizes[:-1])
    same[0] = -1
    poly = np.zeros((n, width + 1), np.uint64)
    for d in range(width):
        poly[:, d + 1] = poly[:, d] * model.BASE + text[:, d].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width, model.BASE)]))
    node = [np.zeros(n, np.int64)]
    best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    tokens_of, score_of = np.zeros(n, np.int64), np.zeros(n)
    for d in range(1, width + 1):
        new = (same < d) & (sizes >= d)
        rows = np.flatnonzero(new)
        node.append(np.cumsum(new) - 1)
        top, much = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        for size in model.lengths:
            if size > d:
                continue
            p = model.find(poly[rows, d] - poly[rows, d - size] * powers[size])
            hit = np.flatnonzero(p > -np.inf)
            back = node[d - size][rows[hit]]
            s = best[d - size][back] + p[hit]
            better = s > top[hit]
            hit, back = hit[better], back[better]
            top[hit], much[hit] = s[better], count[d - size][back] + 1
        best.append(top)
        count.append(much)
        ends = np.flatnonzero(sizes == d)
        tokens_of[ends], score_of[ends] = much[node[d][ends]], top[node[d][ends]]
    return tokens_of, score_of


class Counter:
    def __init__(self, model: Model, cache: int = CACHE):
        import regex

        self.model, self.size = model, cache
        self.known: dict[str, tuple[int, float]] = {}
        self.ascii, self.any = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall

    def split(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)

    def learn(self, tokens: set[str]) -> None:
        new = sorted(t.encode() for t in tokens if t not in self.known)
        if len(self.known) + len(new) > self.size:
            self.known = {}
            new = sorted(t.encode() for t in tokens)
        short = [t for t in new if len(t) <= MATRIX]
        if short:
            counts, scores = count_all(short, self.model)
            self.known.update(zip(map(bytes.decode, short), zip(counts.tolist(), scores.tolist())))
        for t in new:
            if len(t) > MATRIX:
                self.known[t.decode()] = count_one(t, self.model)

    def count(self, texts: list[str]) -> tuple[list[int], list[int], list[float]]:
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        found = [[self.known[t] for t in x] for x in split]
        return [len(x) for x in split], [sum(c for c, _ in x) for x in found], [math.fsum(s for _, s in x) for x in found]


def _count_batches(batches: Iterator[pa.RecordBatch], ranks_of) -> Iterator[pa.RecordBatch]:
    counter = Counter(Model(ranks_of()))
    names = [x.split()[0] for x in ROW.split(", ")]

    def row(ids, texts):
        n, c, s = counter.count(texts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names)

    for b in batches:
        column = b.column("text")
        ids, texts, size = [], [], 0
        for i, doc in enumerate(b.column("doc_id").to_pylist()):
            ids.append(doc)
            texts.append(column[i].as_py() or "")
            size += len(texts[-1])
            if size >= CHUNK:
                yield row(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)


def token_counts(docs: DataFrame, ranks_of=default_ranks) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_pretokens, n_tokens, score. ranks_of
    loads the vocabulary on an executor (bytes of a piece -> rank)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, lambda it: _count_batches(it, ranks_of), ROW)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the default vocabulary."""
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("score", F.round("score", 6))

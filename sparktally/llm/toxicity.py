"""Operator 6: toxicity by a subsequence-kernel support vector machine.

The kernel of two words counts common subsequences of three and four characters
(word ends count as characters); every character skipped between them costs a
factor DECAY, so insults with gaps or inserted characters stay close. Kernel
values of a word with the landmark words are its Nystroem coordinates, in which
a linear machine (squared hinge) is trained. As the kernel is a sum over
subsequences, the finished machine folds into one weight per subsequence of a
landmark, and a word costs a few table lookups, however many landmarks.

Training sees labelled documents only through sentences: words that sentences
of toxic documents have and those of clean ones don't are the positive words,
with variants that have characters inserted; words of clean sentences are the
negative ones, the hardest are added in rounds. A document's margin is its
worst word's (runs of single characters are tried as one word), and a logistic
fit over the training documents makes it a score.

Parameters bound what training collects: docs_per_class labelled documents of
at most doc_bytes each, in the order of a hash of their ids. Scoring covers all
words of all texts; long words are scored in overlapping pieces.

Defined results: null and empty texts have the score of no word at all; without
labels of both classes, or without any word to learn, every score is the share
of toxic labels, but under 0.5 (0 without any), so that nothing is rejected; a
null id is in no sample, and held_out is then false; very long texts are scored
whole; several labels of an id count as the largest; labels without document and
null labels are ignored; repeated rows repeat results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._shared import map_batches

DECAY = 0.6
#: Places of a subsequence's characters, from the first.
PLACES = [(0, *c) for c in combinations(range(1, 5), 2)] + [(0, *c) for c in combinations(range(1, 7), 3)]
PIECE, OVERLAP = 32, 12
#: Bytes of the words whose margins a task remembers.
CACHE = 16 << 20
#: Without anything to learn no document is called toxic.
UNSURE = 0.49
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SENTENCE = re.compile(r"[.!?]\s|\n")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def unit(token: str) -> str:
    """A token without the punctuation around it, in lower case."""
    if token.isalnum():
        return token.lower()
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b].lower()


def units(text: str) -> set[str]:
    """Distinct words of a text, those with inner punctuation also without it, and
    runs of three or more single characters."""
    tokens = text.split()
    found = {unit(t) for t in set(tokens)}
    found |= {"".join(filter(str.isalnum, u)) for u in found if not u.isalnum() and not any(map(str.isdigit, u))}
    if sum(len(t) < 4 for t in tokens) > 2:
        run = []
        for t in [*tokens, "end"]:
            u = unit(t) if len(t) < 4 else t
            if len(u) == 1:
                run.append(u)
            elif u or len(t) > 3:
                if len(run) > 2:
                    found.add("".join(run))
                run = []
    found.discard("")
    return found


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = ["\2" + w + "\3" for w in words]
    sizes = np.array([len(w) for w in marked])
    flat = np.frombuffer("".join(w.ljust(PIECE + 2, "\0") for w in marked).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), -1)[:, : max(int(sizes.max()), 7)].astype(np.uint64), sizes


def _features(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each kind of subsequence: its weight, keys by word and place, and
    which of them lie inside the word."""
    width = codes.shape[1]
    for places in PLACES:
        span = places[-1]
        if span >= width:
            continue
        h = np.full((len(codes), width - span), np.uint64(len(places)))
        for p in places:
            h = h * _STEP + codes[:, p : width - span + p]
        yield DECAY ** (span + 1 - len(places)), _mix(h), np.arange(width - span) < (sizes - span)[:, None]


def _norms(sizes: np.ndarray) -> np.ndarray:
    total = sum(DECAY ** (2 * (p[-1] + 1 - len(p))) * np.maximum(sizes - p[-1], 0) for p in PLACES)
    return np.sqrt(np.maximum(total, 1e-9))


def vectors(words: list[str]) -> list[dict[int, float]]:
    """Kernel features of a few words, spelled out."""
    codes, sizes = _codes(words)
    out: list[Counter] = [Counter() for _ in words]
    for weight, keys, inside in _features(codes, sizes):
        for i in range(len(words)):
            for k in keys[i][inside[i]].tolist():
                out[i][k] += weight
    return [{k: v / n for k, v in x.items()} for x, n in zip(out, _norms(sizes))]


class Table:
    """Weight columns by subsequence key: sums over a word's subsequences."""

    BITS = 18

    def __init__(self, weights: dict[int, np.ndarray], width: int):
        keys = np.array(sorted(weights), np.uint64)
        self.keys = keys
        self.values = np.vstack([np.array([weights[k] for k in keys.tolist()]).reshape(len(keys), width), np.zeros((1, width))])
        # First key of each slot; keys of one slot lie next to each other.
        slots = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << self.BITS)).astype(np.int32)
        self.deep = int(np.bincount(slots, minlength=1).max()) if len(keys) else 0
        self.padded = np.append(keys, np.uint64(0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of the keys, the last (zero) row for unknown ones."""
        at = self.first[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        out = np.full(h.shape, len(self.keys), np.int64)
        for d in range(self.deep):
            spot = np.minimum(at + d, len(self.keys))
            hit = self.padded[spot] == h
            out[hit] = spot[hit]
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.values.shape[1]))
        for k in range(0, len(words), 4096):
            codes, sizes = _codes(words[k : k + 4096])
            part = out[k : k + 4096]
            for weight, keys, inside in _features(codes, sizes):
                rows, _ = np.nonzero(inside)
                at = self.find(keys[inside])
                known = at < len(self.keys)
                for c in range(out.shape[1]):
                    part[:, c] += weight * np.bincount(rows[known], self.values[at[known], c], len(part))
            part /= _norms(sizes)[:, None]
        return out


@dataclass
class Model:
    table: Table | None
    bias: float
    slope: float
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        return self.table(words)[:, 0] + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(margin), self.shift)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on its active rows; the last
    coefficient is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(30):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(a.T @ x[active] + np.diag(penalty), a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score: 0.5 lies where the fewest training
    documents are on the wrong side, in the middle of such a gap; the slope is
    the logistic one there, with smoothed targets."""
    order = np.argsort(m, kind="stable")
    v, hit = m[order], y[order]
    cuts = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    wrong = np.concatenate([[0], np.cumsum(hit)]) + np.concatenate([[0], np.cumsum(~hit)])[-1] - np.concatenate([[0], np.cumsum(~hit)])
    gaps = np.concatenate([[0], np.diff(v), [0]])
    best = np.flatnonzero(wrong == wrong.min())
    cut = cuts[best[gaps[best].argmax()]]
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, slope = m - cut, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        step = ((t - p) @ x - 1e-3 * slope) / ((p * (1 - p)) @ (x * x) + 1e-3)
        slope = float(np.clip(slope + np.clip(step, -2, 2), 1.0, 20.0))
    return slope, float(-slope * cut)


def _stretched(word: str, rng: np.random.RandomState) -> list[str]:
    """Variants with inserted characters."""
    signs = "-*._~'x+"
    out = [signs[rng.randint(len(signs))].join(word)] if len(word) < 12 else []
    for n in (1, 1, 2):
        w = word
        for _ in range(n):
            at = rng.randint(1, max(2, len(w)))
            w = w[:at] + signs[rng.randint(len(signs))] + w[at:]
        out.append(w)
    return out


def _kin(text: str) -> list[int]:
    """Two min-hashes of word triples: near copies share one with ease."""
    w = text.lower().split()
    grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    hashed = [hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=16).digest() for g in grams]
    return [min(int.from_bytes(h[k : k + 8], "little") for h in hashed) * 2 + (k > 0) for k in (0, 8)]


def train(rows: list[tuple[str, int]], landmarks: int = 96, least_docs: int = 4, seed: int = 13) -> Model:
    """rows: (text, toxic) -> Model."""
    rng = np.random.RandomState(seed)
    seen: set[int] = set()
    docs = []
    for text, toxic in rows:
        kin = _kin(text)
        if not seen.intersection(kin):  # copies would make a document's own words look typical
            docs.append((text, bool(toxic)))
        seen.update(kin)
    y = np.array([t for _, t in docs], bool)
    if not y.any() or y.all():
        return Model(None, 0, 0, min(float(y.mean()), UNSURE) if len(y) else 0.0)
    # Texts are cut anew whenever they are needed: only counts and the distinct
    # clean words stay in memory.
    df = [Counter(), Counter()]
    for text, toxic in docs:
        df[int(toxic)].update(units(text))
    n1, n0 = int(y.sum()), int((~y).sum())
    least = min(least_docs, max(1, n1 // 4))
    gain = {w: np.log((c + 0.5) / (n1 + 1)) - np.log((df[0][w] + 0.5) / (n0 + 1)) for w, c in df[1].items() if c >= least and len(w) > 2}
    # A positive word is, documents counted alike, at least 20 times as common in toxic ones.
    positive = sorted((w for w, g in gain.items() if g > np.log(20)), key=lambda w: (-df[1][w], w))
    if not positive:
        return Model(None, 0, 0, min(float(y.mean()), UNSURE))
    bad = set(positive)
    del df
    kept: set[str] = set()
    for text, toxic in docs:
        for sentence in _SENTENCE.split(text):
            u = units(sentence)
            if not (toxic and u & bad):
                kept.update(p for w in u - bad for p in pieces(w))
    clean = sorted(kept - {""})
    del kept
    pos = positive + [v for w in positive for v in _stretched(w, rng)]
    chosen = [clean[i] for i in rng.permutation(len(clean))]
    negative = chosen[:4000]
    marks = [p for w in positive[:landmarks] for p in pieces(w)[:1]]
    # Clean landmarks: the clean words that are nearest to the positive ones.
    near = Table(_columns(vectors(marks)), len(marks))
    close = near(chosen[:30_000]).max(axis=1)
    marks += [chosen[i] for i in np.argsort(-close, kind="stable")[:landmarks]]
    features = vectors(marks)
    kernel = Table(_columns(features), len(marks))
    gram = kernel(marks)
    values, basis = np.linalg.eigh((gram + gram.T) / 2)
    sound = values > 1e-6 * values.max()
    root = basis[:, sound] / np.sqrt(values[sound])
    hard = [chosen[i] for i in np.argsort(-close, kind="stable")[:2000]]
    held = set(negative) | set(hard)
    negative = sorted(held)
    for _ in range(3):
        z = np.vstack([kernel(pos) @ root, kernel(negative) @ root])
        target = np.concatenate([np.ones(len(pos)), -np.ones(len(negative))])
        weight = np.concatenate([np.full(len(pos), max(1.0, len(negative) / len(pos) / 10)), np.ones(len(negative))])
        w = _machine(z, target, weight)
        alpha = root @ w[:-1]
        folded: dict[int, float] = {}
        for a, f in zip(alpha, features):
            for k, v in f.items():
                folded[k] = folded.get(k, 0.0) + a * v
        model = Model(Table({k: np.array([v]) for k, v in folded.items()}, 1), float(w[-1]), 1.0, 0.0)
        margin = model.margins(clean)
        worst = [clean[i] for i in np.argsort(-margin, kind="stable")[:2000] if clean[i] not in held]
        held.update(worst)
        negative = sorted(held)
    scorer = Scorer(model, 4 << 20)
    top = np.concatenate([scorer.margins([x for x, _ in docs[k : k + 100]]) for k in range(0, len(docs), 100)])
    model.slope, model.shift = _logistic(top, y)
    return model


def _columns(features: list[dict[int, float]]) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for c, f in enumerate(features):
        for k, v in f.items():
            out.setdefault(k, np.zeros(len(features)))[c] = v
    return out


class Scorer:
    """Margins of texts. Margins of short words are remembered, up to `cache`
    bytes of words (each takes about 100 bytes more)."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.cache, self.known, self.size = model, cache, {}, 0

    def margins(self, texts: list[str]) -> np.ndarray:
        if self.model.table is None:
            return np.zeros(len(texts))
        found = [units(t) for t in texts]
        new = set().union(*found).difference(self.known)
        if self.size > self.cache:
            self.known, self.size, new = {}, 0, set().union(*found)
        parts = [(w, p) for w in new for p in pieces(w)]
        for (w, _), m in zip(parts, self.model.margins([p for _, p in parts]).tolist() if parts else []):
            if m > self.known.get(w, -np.inf):
                self.known[w] = m
        out = np.array([max(map(self.known.__getitem__, u), default=self.model.bias) for u in found])
        for w in [w for w in new if len(w) > PIECE]:
            del self.known[w]
            new.discard(w)
        self.size += sum(map(len, new)) + 100 * len(new)
        return out


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model, keep: list[int]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b in batches:
        column, scores, texts, size = b.column(b.schema.get_field_index("text")), [], [], 0
        for x in column:
            texts.append(x.as_py() or "")
            size += len(texts[-1])
            if size > 2 << 20:
                scores.append(scorer.margins(texts))
                texts, size = [], 0
        scores.append(scorer.margins(texts))
        own = [b.column(i) for i in keep]
        yield pa.RecordBatch.from_arrays([*own, pa.array(model.probability(np.concatenate(scores)))], [*(b.schema.names[i] for i in keep), "score"])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 1500, doc_bytes: int = 32_768) -> Model:
    """Model from labels (doc_id, toxic) whose documents aren't held out."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for c in (0, 1):
        some = usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class)
        sample = some if sample is None else sample.unionByName(some)
    short = docs.where(F.octet_length("text") <= doc_bytes).select(F.col("doc_id").alias("doc_id"), "text")
    # The sample has at most 2 * docs_per_class rows: a broadcast with a fixed bound.
    rows = short.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    return train([(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with a column `score` added (an existing one is replaced); of the
    other columns all, or those to keep."""
    rows = docs.drop("score")
    places = [rows.columns.index(c) for c in keep or rows.columns]
    schema = StructType([*(rows.schema[i] for i in places), StructField("score", DoubleType())])
    return map_batches(rows, lambda it: _score_batches(it, model, places), schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model of the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model, keep=("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

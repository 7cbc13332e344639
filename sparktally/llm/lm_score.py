"""Operator 1: stupid-backoff scores from corpus-wide n-gram counts.

Unigram and bigram counts are tables partitioned by hash; every block's
n-grams are joined to them (`_blocks.exchange`), and the log scores are summed
per document. A document is scored by the others: its own occurrences are
taken off each count, so text that nothing else resembles scores low.

For a word w after v, with counts over all other documents, N their words:
c(v w) / c(v) if c(v w) > 0, else backoff * c(w) / N, and a word that no other
document has counts as `backoff` words. A first word has no context and no
backoff factor.

Defined results: words are runs of anything but ASCII white space; a document
without words (or null text) has score 0 and per-word score null; repeated rows
are separate documents; in a corpus of one document N counts as 1; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._blocks import Docs, blocks, exchange, gram_starts, grams, words
from ._shared import stored

ROW = "doc_id long, n_words long, log_sum double, n_backed_off long"
_NAMES = [x.split()[0] for x in ROW.split(", ")]


def _keys(docs: Docs) -> tuple[np.ndarray, np.ndarray]:
    h, offsets, _, _ = words(docs)
    starts, _ = gram_starts(offsets, 2)
    return np.unique(np.concatenate([grams(h, 1), grams(h, 2)[starts]]), return_counts=True)


def _own(key_index: np.ndarray, doc: np.ndarray, n_keys: int) -> np.ndarray:
    """For each occurrence, how often its document has its key."""
    pair = doc.astype(np.int64) * max(n_keys, 1) + key_index
    order = np.argsort(pair, kind="stable")
    new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
    sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(pair)]]))
    out = np.empty(len(pair), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _score(docs: Docs, keys: np.ndarray, totals: np.ndarray, backoff: float):
    h, offsets, _, _ = words(docs)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    sums, backed = np.zeros(len(n)), np.zeros(len(n), np.int64)
    if len(h):
        one = np.searchsorted(keys, grams(h, 1))
        c1 = totals[one].astype(np.int64) - _own(one, doc, len(keys))
        # The first word of a document, or any word whose bigram is unseen.
        logs = np.where(c1 > 0, np.log(np.maximum(c1, 1)), np.log(backoff))
        by_count = np.ones(len(h), bool)
        starts, doc2 = gram_starts(offsets, 2)
        if len(starts):
            two = np.searchsorted(keys, grams(h, 2)[starts])
            c2 = totals[two].astype(np.int64) - _own(two, doc2, len(keys))
            seen, at = c2 > 0, starts + 1
            logs[at] += np.log(backoff)
            logs[at[seen]] = np.log(c2[seen] / c1[starts[seen]])
            by_count[at[seen]] = False
        sums = np.bincount(doc, logs, len(n))
        backed = np.bincount(doc, by_count, len(n)).astype(np.int64)
    ids = pa.array(docs.ids, pa.int64(), mask=~docs.has_id)
    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sums), pa.array(backed)], _NAMES)


def score(docs: DataFrame, backoff: float = 0.4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_backed_off, score, score_per_word."""
    parts = stored(exchange(blocks(docs), _keys, lambda _, d, k, t: _score(d, k, t, backoff), ROW), "lm")
    total = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("total"))
    others = F.greatest(F.col("total") - F.col("n_words"), F.lit(1))
    value = F.col("log_sum") - F.col("n_backed_off") * F.log(others)
    return parts.crossJoin(F.broadcast(total)).select(  # one row: the corpus size
        "doc_id",
        "n_words",
        "n_backed_off",
        value.alias("score"),
        F.when(F.col("n_words") > 0, value / F.col("n_words")).alias("score_per_word"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document against all others, rounded to 4 places."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_backed_off", F.round("score", 4).alias("score"), F.round("score_per_word", 4).alias("score_per_word"))


#: DuckDB for op1_lm_score.
SQL1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
o AS (SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS n FROM o),
u AS (SELECT w, count(*) AS c FROM o GROUP BY w),
ud AS (SELECT r, w, count(*) AS c FROM o GROUP BY r, w),
b AS (SELECT v, w, count(*) AS c FROM o WHERE v IS NOT NULL GROUP BY v, w),
bd AS (SELECT r, v, w, count(*) AS c FROM o WHERE v IS NOT NULL GROUP BY r, v, w),
x AS (SELECT o.r, o.i, u.c - ud.c AS c1, uv.c - udv.c AS cv, coalesce(b.c - bd.c, 0) AS c2
      FROM o JOIN u ON u.w = o.w JOIN ud ON ud.r = o.r AND ud.w = o.w
      LEFT JOIN u uv ON uv.w = o.v LEFT JOIN ud udv ON udv.r = o.r AND udv.w = o.v
      LEFT JOIN b ON b.v = o.v AND b.w = o.w LEFT JOIN bd ON bd.r = o.r AND bd.v = o.v AND bd.w = o.w),
s AS (SELECT r, count(*) AS n_words, count(*) FILTER (c2 <= 0) AS n_backed_off,
             sum(CASE WHEN c2 > 0 THEN ln(c2 / cv)
                      ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + CASE WHEN c1 > 0 THEN ln(c1) ELSE ln(0.4) END END) AS l
      FROM x GROUP BY r),
f AS (SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_backed_off, 0) AS n_backed_off,
             coalesce(s.l, 0) - coalesce(s.n_backed_off, 0) * ln(greatest(n.n - coalesce(s.n_words, 0), 1)) AS score
      FROM d LEFT JOIN s USING (r) CROSS JOIN n)
SELECT doc_id, n_words, n_backed_off, round(score, 4) AS score,
       CASE WHEN n_words > 0 THEN round(score / n_words, 4) END AS score_per_word FROM f
"""

"""Small awkward tables that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) -> a documents table."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


def write(df, tmp_path, name):
    path = tmp_path / f"{name}.parquet"
    df.write.mode("overwrite").parquet(str(path))
    return path


def words(n, seed, vocabulary=400):
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"w{x // 7 % vocabulary}")
    return " ".join(out)


def awkward():
    """Nulls, empties, blanks, repeats, ties, a very long text, odd characters."""
    base = words(60, 1)
    return [
        (1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (7, "one two"), (None, base), (None, None),
        (8, base + " extra"), (9, words(30, 2) + "\n" + words(25, 3) + "\n" + words(30, 2)), (10, words(5000, 4)), (11, "x" * 3000),
        (12, "café \U0001f600 naïve 你好 " * 5), (13, "a b\x0bc\x0cd\re\x85f <|endoftext|> g"), (8, words(40, 9)),
    ]


#: Extra columns whose names the operators use inside.
CLASHES = ["score", "n_lines", "n_removed", "lost", "_id", "_key", "block", "pos", "label", "entry", "place", "rest", "k", "t", "row"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})

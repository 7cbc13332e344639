"""Matchers and columns that stream documents: one Python call for many of them."""

import random
from difflib import SequenceMatcher

import pytest

from sparktally.operators import layout, row_match as rm
from sparktally.plans import QUERIES


@pytest.mark.parametrize("name", ["digit_columns", "material_match_greedy", "row_match_n1_1n", "row_match_prf"])
def test_no_python_call_for_each_document(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan and "ArrowEvalPython" not in plan


def test_distances():
    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choices("abcé ", k=random.randint(1, 80))) for _ in range(2))
        row, common = list(range(len(b) + 1)), [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0], before = row[0], i, common
            common = [0] + [0] * len(b)
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
                common[j] = before[j - 1] + 1 if x == y else max(before[j], common[j - 1])
        assert (rm._distance(a, b), rm._common(rm._masks(a), b)) == (row[-1], common[-1])
        assert 2 * common[-1] / (len(a) + len(b)) >= SequenceMatcher(None, b, a).ratio()


def test_digit_columns(spark):
    """Words at one place, clusters by a running mean, a document over batches."""
    words = [(1, 10.0, 1.0, "7"), (1, 10.0, 1.0, "3"), (1, 30.0, 0.0, "5"), (1, 45.0, 9.0, "x"), (1, 90.0, 1.0, "1"), (1, 95.0, 2.0, "12"), (1, 96.0, 3.0, "2")]
    words += [(2, float(i % 10), float(i), "4") for i in range(25_000)]
    for rows in (words, words[::-1]):
        got = layout.digit_columns(spark.createDataFrame(rows, "doc_id long, x double, y double, text string")).collect()
        assert sorted(tuple(r) for r in got) == [(1, 0, 3, "537"), (2, 0, 25_000, "4" * 25_000)]


def test_sides_meet_wherever_their_rows_are(spark):
    """A plan whose sides are both partitioned by document already."""
    rows = spark.range(400).selectExpr("id % 100 AS doc_id", "id AS row", "concat('steel bar ', id) AS material", "1.0D AS quantity", "'kg' AS unit")
    sides = rows.repartition("doc_id"), rows.where("row % 3 > 0").repartition("doc_id")
    assert rm.match_rows(*sides).where("kind = 'missing'").count() == 0
    assert rm.match_signals(*sides).count() == rows.where("row % 3 > 0").count()

"""Results that must not depend on the order of rows."""

import pandas as pd

from sparktally.operators import spans
from sparktally.plans import QUERIES, SQL

from .oracle import agree


def test_bioes_types_of_a_shared_id(spark):
    tags = [(1, ["S-GRADE", "O"]), (1, ["S-MATERIAL", "O"]), (2, ["S-A", "B-C", "E-C"]), (2, ["O", "B-B", "E-B"])]
    for rows in (tags, tags[::-1]):
        got = spans.spans_of_tags(spark, spark.createDataFrame(rows, "doc_id long, tags array<string>").coalesce(1)).collect()
        assert sorted((r.doc_id, r.first, r.last, r.type) for r in got) == [(1, 0, 0, "GRADE"), (2, 0, 0, "A"), (2, 1, 2, "B")]


def test_equal_extractions_go_to_the_column_aware(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles."""
    lines = []
    for item, percent in ((3, 10), (6, 20), (9, 30), (2, 30), (5, 20), (8, 10)):
        part = next(p for p in range(2000) if (p * 31 + item * 17) % 101 == percent and (p * 3 + item) % 11 and p not in [x[0] for x in lines])
        lines.append((part, item))
    parts = [p for p, _ in lines]
    pd.DataFrame({"l_orderkey": 1, "l_partkey": parts, "l_suppkey": 1, "l_linenumber": pd.Series([n for _, n in lines], dtype="int32"), "l_quantity": 2.0, "l_extendedprice": 1.0}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": parts, "p_name": "hot bolt", "p_type": "SMALL", "p_size": pd.Series([1] * 6, dtype="int32")}).to_parquet(tmp_path / "part.parquet")
    got = QUERIES["extractor_arbitration"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, "column_aware", 3, 3)]


def test_extractions_of_unequal_double_averages(spark, small, tmp_path):
    """0.11 + 0.46 is more than 0.36 + 0.21 in doubles, in either order."""
    lines = []
    for order in (1, 2):
        for item, percent in ((3, 11), (6, 46), (2, 36), (5, 21))[:: 1 if order == 1 else -1]:
            part = next(p for p in range(2000) if (p * 31 + item * 17) % 101 == percent and (p * 3 + item) % 11 and (order, p, item) not in lines)
            lines.append((order, part, item))
    parts = sorted({p for _, p, _ in lines})
    made = {"lineitem": str(tmp_path / "lineitem.parquet"), "part": str(tmp_path / "part.parquet")}
    pd.DataFrame({"l_orderkey": [o for o, _, _ in lines], "l_partkey": [p for _, p, _ in lines], "l_suppkey": 1, "l_linenumber": pd.Series([n for _, _, n in lines], dtype="int32"), "l_quantity": 2.0, "l_extendedprice": 1.0}).to_parquet(made["lineitem"])
    pd.DataFrame({"p_partkey": parts, "p_name": "hot bolt", "p_type": "SMALL", "p_size": pd.Series([1] * len(parts), dtype="int32")}).to_parquet(made["part"])
    got = QUERIES["extractor_arbitration"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "plain", 2, 2), (2, "plain", 2, 2)]
    agree(got, SQL["extractor_arbitration"], small, made)

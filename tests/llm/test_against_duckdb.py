"""opN queries with a SQL form, on the smallest tables and on awkward ones."""

import pytest

from sparktally.llm import queries

from ..oracle import agree
from .helpers import awkward, docs, words, write

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_small_tables(spark, small, name):
    agree(queries.queries()[name](spark, small), SQL[name], small)


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if n not in ("op5_warc", "op8_vp_search")])
def test_awkward_documents(spark, small, tmp_path, name):
    # The SQL forms take ids as keys: unique ones here; other cases have own tests.
    rows = [(i, t) for i, (_, t) in enumerate(awkward())]
    where = {"documents": f"{write(docs(spark, rows), tmp_path, 'documents')}/*.parquet"}
    bench = spark.createDataFrame([(1, words(60, 1)), (2, "one two"), (3, None), (4, ""), (5, words(12, 77))], "item_id long, text string")
    where["benchmark"] = f"{write(bench, tmp_path, 'benchmark')}/*.parquet"
    agree(queries.queries()[name](spark, str(tmp_path)), SQL[name], small, where)


@pytest.mark.parametrize("name", [n for n in sorted(queries.queries()) if n not in ("op5_warc", "op8_vp_search")])
def test_empty_documents(spark, small, tmp_path, name):
    write(docs(spark, []), tmp_path, "documents")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0

"""The corpus pipeline: every stage on its own input, then all of them."""

import pytest

import corpus_pipeline as cp
from sparktally.llm import jaccard_join

from .helpers import awkward, docs, with_clashes, words
from .test_operators import near_copies, plain_components, plain_line_removal

STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    for t in ("benchmark", "labels", "documents"):
        spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/{t}.parquet").write.parquet(str(path / f"{t}.parquet"))
    return path


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_columns_stay_with_clashing_names(spark, folder):
    d = with_clashes(docs(spark, awkward()))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, str(folder))
        assert out.columns == d.columns, name
        assert {r[0] for r in out.select("score").collect()} <= {"own score"}, name
        assert {r[0] for r in out.select("lost").collect()} <= {"own lost"}, name


def test_empty_documents(spark, folder):
    d = docs(spark, [])
    for _, stage in cp.STAGES[:-1]:
        d = stage(spark, d, str(folder))
        assert d.count() == 0
    assert STAGES["packing"](spark, d, str(folder)).count() == 0


def test_toxic_documents_go(spark, folder):
    base = words(60, 70)
    own = spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "text").collect()
    planted = [(10**6, f"of the {base} idiot and moron {base}"), (10**6 + 1, base), (10**6 + 2, None), (10**6 + 3, "")]
    d = docs(spark, [(r.doc_id, r.text) for r in own] + planted)
    kept = set(ids(STAGES["toxicity"](spark, d, str(folder))))
    assert 10**6 not in kept
    assert {10**6 + 1, 10**6 + 2, 10**6 + 3} <= kept
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(str(folder / "labels.parquet")).collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_nothing_to_learn_keeps_all(spark, folder, tmp_path):
    d = docs(spark, awkward())
    for name, toxic in (("none", []), ("all", [(i, 1, 1) for i in range(1, 14)]), ("one", [(1, 1, 1), (2, 1, 0)])):
        spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert ids(STAGES["toxicity"](spark, d, str(tmp_path / name))) == ids(d)


def test_shreds_of_copies_go(spark, folder):
    lines = [words(30, s, 10_000) for s in range(90, 96)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:5], "a few other words"])), (3, "\n".join([*lines[:2], words(60, 97, 10_000)]))]
    got = {r.doc_id: r.text for r in STAGES["line_dedup"](spark, docs(spark, rows), str(folder)).collect()}
    assert got == {1: rows[0][1], 3: words(60, 97, 10_000)}


def test_lines(spark, folder):
    lines = [" ".join(t.split()[:60]) for t in near_copies(40, 81, 3)]
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(10)] + [(50, words(20, 82)), (51, words(20, 82)), (52, None), (53, ""), (54, "short")]
    got = {r.doc_id: r.text for r in STAGES["line_dedup"](spark, docs(spark, rows), str(folder)).collect()}
    want = {i: t for i, _, n, t in plain_line_removal(rows) if n == 0 or t.strip()}
    assert {i: t or "" for i, t in got.items()} == want
    assert 51 not in got and {50, 52, 53, 54} <= set(got)


def test_one_of_each_group(spark, folder):
    rows = [(i, t) for i, (_, t) in enumerate(awkward())] + [(1000 + i, t) for i, t in enumerate(near_copies(60, 83, 5))]
    got = ids(STAGES["near_duplicates"](spark, docs(spark, rows), str(folder)))
    assert got == sorted((i for i, _, c in plain_components(rows) if c == i), key=repr)


def test_repeated_rows_leave_one(spark, folder):
    t = words(30, 84)
    got = STAGES["near_duplicates"](spark, docs(spark, [(1, t), (1, t), (1, words(30, 85)), (None, t), (2, None), (2, None)]), str(folder))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, t), (1, words(30, 85)), (2, None), (2, None)], key=repr)


def test_contaminated_documents_go(spark, folder):
    items = [r.text for r in spark.read.parquet(str(folder / "benchmark.parquet")).collect()]
    rows = [(1, words(500, 86) + " " + items[0] + " " + words(300, 87)), (2, words(400, 88)), (3, items[1].upper()), (None, items[2]), (4, None)]
    assert ids(STAGES["decontamination"](spark, docs(spark, rows), str(folder))) == [2, 4]


def test_all_stages(spark, folder):
    rows = cp.run(spark, str(folder)).collect()
    d = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        d = stage(spark, d, str(folder))
    assert {r.doc_id for r in rows} == set(ids(d))
    assert max(r.offset + r.length for r in rows) <= 2048
    later = {r.doc_id for r in jaccard_join.near_duplicates(spark.read.parquet(str(folder / "documents.parquet"))).where("doc_id <> component_id").collect()}
    kept = {r.doc_id for r in rows}
    assert len(later) > 50 and len(later & kept) <= 0.05 * len(later)

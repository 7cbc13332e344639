"""Each operator against a plain version, and its awkward cases."""

import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktally.llm import _blocks, _shared, decontaminate, jaccard_join, line_dedup, lm_score, packing, substring_dedup, token_counts, toxicity, vp_search, warc

from .helpers import awkward, docs, with_clashes, words


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- shared block counting


def test_word_hashes_find_words():
    texts = [b"", b" a  bb\tccc ", "café x".encode(), b"last"]
    d = _blocks.unpack(_blocks._pack([1, None, 3, 4], texts))
    h, offsets, starts, ends = _blocks.words(d, chunk=3)
    found = [d.data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert found == [w for t in texts for w in t.split()]
    assert list(np.diff(offsets)) == [len(t.split()) for t in texts]
    again = _blocks.words(_blocks.unpack(_blocks._pack([9], [b" ".join(texts)])))[0]
    assert (np.sort(h) == np.sort(again)).all()


def test_squeeze_round_trips():
    x = np.array([1, 5, 2**63, 7], np.uint64)
    assert (_blocks.unsqueeze(_blocks.squeeze(x), "<u8") == x).all()
    assert (_blocks.unsqueeze_sorted(_blocks.squeeze_sorted(np.sort(x))) == np.sort(x)).all()


def test_totals_beyond_32_bits():
    import pyarrow as pa

    keys = np.array([5, 9], np.uint64)
    row = lambda block, n: [block, _blocks.squeeze_sorted(keys), _blocks.squeeze(np.array(n, "<u4"))]
    blocks = [row(1, [4_000_000_000, 1]), row(2, [4_000_000_000, 2])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0], pa.int32()), pa.array([b[0] for b in blocks]), pa.array([b[1] for b in blocks]), pa.array([b[2] for b in blocks])], ["part", "block", "keys", "counts"]
    )
    (out,) = _blocks._answer(iter([batch]), "<u8", None)
    assert [_blocks.unsqueeze(x.as_py(), "<u8").tolist() for x in out.column("data")] == [[8_000_000_000, 3]] * 2


def test_many_small_blocks_give_the_same(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    keys = lm_score._keys
    one = _blocks.exchange(_blocks.blocks(d), keys, lambda _, x, k, t: lm_score._score(x, k, t, 0.4), lm_score.ROW)
    many = _blocks.exchange(_blocks.blocks(d, 20_000), keys, lambda _, x, k, t: lm_score._score(x, k, t, 0.4), lm_score.ROW, keys_per_part=5000)
    rounded = lambda df: rows_of(df.withColumn("log_sum", F.round("log_sum", 6)), "doc_id", "n_words", "log_sum", "n_backed_off")
    assert rounded(one) == rounded(many)


def test_intermediate_tables_can_go(spark):
    import os

    d = _shared.stored(docs(spark, [(1, "a")]), "x")
    path = d.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    _shared.forget(spark)
    assert not os.path.exists(path)


def test_batches_for_python_are_small(spark):
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text")).coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    n = [r.n for r in _shared.stored(_shared.map_batches(d, sizes, "n long"), "x").collect()]
    assert sum(n) >= 30_000_000 and max(n) <= 2 * _shared.BATCH_BYTES


def test_hashing_in_small_chunks_takes_little_memory():
    import tracemalloc

    text = ("some words of a text " * 200_000).encode()
    d = _blocks.unpack(_blocks._pack([1], [text]))
    tracemalloc.start()
    few = _blocks.words(d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(text)
    for a, b in zip(few, _blocks.words(d, chunk=1 << 20)):
        assert (a == b).all()


def test_shuffle_files_go_with_their_query(spark):
    import time
    from pathlib import Path

    folders = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {x.name for d in folders for x in d.rglob("shuffle_*")}
    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    table = _shared.stored(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3, "count"), "x")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 1000 and spark.conf.get(key) == setting


def test_jaccard_join_leaves_no_shuffle_files(spark):
    import time
    from pathlib import Path

    folders = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for d in folders for x in d.rglob("shuffle_*.data")}
    before = files()
    jaccard_join.links(jaccard_join.sets_of(docs(spark, awkward())))
    left = lambda: sum(x.stat().st_size for x in files() - before if x.exists())
    for _ in range(50):
        if left() < 1000:
            break
        time.sleep(0.1)
    assert left() < 1000  # counts of a few rows; the exchange of shingles alone takes more than 40 kB


# --- 1 and 2


def test_lm_scores_repeated_rows(spark):
    got = rows_of(lm_score.score(docs(spark, [(1, "a b"), (1, "a b"), (2, None)])), "doc_id", "n_words", "n_backed_off")
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 0)]


def test_token_counts_are_the_plain_recursion(spark):
    model = token_counts.Model(token_counts.default_ranks())
    counter = token_counts.Counter(model, cache=50)
    for _, text in awkward():
        n, c, s = counter.count([text or ""])
        tokens = counter.split(text or "")
        assert "".join(tokens) == (text or "")
        plain = [token_counts.count_one(t.encode(), model) for t in tokens]
        assert (n[0], c[0]) == (len(tokens), sum(k for k, _ in plain))
        assert abs(s[0] - sum(x for _, x in plain)) < 1e-6
    assert token_counts.token_counts(with_clashes(docs(spark, awkward()))).count() == len(awkward())


# --- 3


def test_encoder_agrees_with_the_json_file():
    encode = packing.default_encoder()
    points = [*range(0x250), *range(0x2010, 0x2028), 0x20AC, 0x4F60, 0x1F600]
    for c in map(chr, points):
        for text in (c, f"a{c}b", f" {c}{c} {c}1{c}", f"\n{c}  {c}\n\n{c}s '{c}", f"{c}'s{c}'ll {c}9", "<|endoftext|>" + c):
            assert encode(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


def test_best_fit_is_whole_and_tight():
    rng = np.random.RandomState(3)
    lengths = rng.randint(1, 2049, 3000).tolist()
    bins = packing.best_fit(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1.02 * sum(lengths) / 2048 + 1


@pytest.mark.parametrize("items_per_task", [100_000, 7])
def test_packing_places_every_id(spark, items_per_task):
    rows = awkward() + [(100 + i, words(i * 3, i)) for i in range(60)]
    got = packing.placements(packing.pack(with_clashes(docs(spark, rows)).repartition(5), items_per_task=items_per_task)).collect()
    encode = packing.default_encoder()
    want = Counter()
    for i, t in rows:
        ids = np.append(encode(t or ""), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        starts = [0] if len(ids) <= 2048 else [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


# --- 4


def test_contamination_of_short_items_and_repeats(spark):
    d = docs(spark, [(1, "x one TWO, three y"), (1, "x one TWO, three y"), (2, "one three two"), (None, "one two three"), (3, None)])
    b = spark.createDataFrame([(7, "One two three", "c"), (8, None, "c"), (9, "...", "c")], "item_id long, text string, keys string")
    got = rows_of(decontaminate.contaminated(with_clashes(d), b), "doc_id", "item_id", "n_shared")
    assert got == [(1, 7, 1), (None, 7, 1)]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination_finds_damaged_passages(spark, limit):
    item = words(40, 5, 10_000)
    damaged = item.split()
    damaged[0] = "changed"
    far = item.split()
    for i in (5, 15, 25):
        far[i] = "changed"
    d = docs(spark, [(1, words(3000, 6) + " " + " ".join(damaged) + " " + words(500, 7)), (2, " ".join(far)), (3, words(900, 8))])
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows_of(decontaminate.contaminated(d, b, broadcast_rows=limit), "doc_id", "item_id", "n_shared") == [(1, 1, 35)]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination_by_repeated_and_null_ids(spark, limit):
    a, b, c, e = (words(20, s, 10_000) for s in (80, 81, 82, 83))
    d = docs(spark, [(1, "x " + a), (2, "x " + b), (3, a + " " + b), (4, c), (5, e), (None, c), (6, words(50, 84))])
    items = [(7, a), (7, b), (7, a), (7, a.upper() + "."), (None, c), (None, e), (None, None)]
    got = rows_of(decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit), "doc_id", "item_id", "n_shared")
    assert got == sorted([(1, 7, 16), (2, 7, 16), (3, 7, 16), (3, 7, 16), (4, None, 16), (5, None, 16), (None, None, 16)], key=repr)


def test_no_benchmark(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, awkward()), b).count() == 0


# --- 5


@pytest.mark.parametrize("limit", [500_000, 0])
def test_archives(spark, tmp_path, limit):
    big, small = "b" * 1500, "s" * 10
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u 4\r\nx", small), (5, "u5", small), (6, "u6", None), (3, "u3", big), (None, "u7", big), (8, "u8", "WARC/1.1\r\n\r\né" * 200)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=20_000, broadcast_bytes=limit)
    out = warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert all(r.payload_ok for r in out)
    got = Counter((r.page_id, r.record_type, r.payload_bytes, r.refers_to_id) for r in out)
    want = Counter([(1, "revisit", 1500, 3), (2, "revisit", 1500, 3), (3, "response", 1500, None), (3, "response", 1500, None), (None, "revisit", 1500, 3),
                    (4, "response", 10, None), (5, "response", 10, None), (6, "response", 0, None), (8, "response", len(rows[8][2].encode()), None)])
    assert got == want
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert raw.count(b"WARC-Record-ID") == len(rows)
    assert raw.count(b"b" * 1500) == 2  # the two rows of the largest id
    assert raw.count(b"WARC-Refers-To-Target-URI: u3") == 3  # the largest url of page 3
    named = {r.record_id for r in out if r.record_type == "response"}
    assert all(x.split(b"\r\n")[0].decode() in named for x in raw.split(b"WARC-Refers-To: ")[1:])
    digests = {r.page_id: r.digest for r in out}
    assert digests[5] == hashlib.sha1(small.encode()).hexdigest()


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


# --- 6


def test_toxicity_tolerates_inserted_characters(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    d, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(d, lab)
    scored = toxicity.score(with_clashes(d), model).join(lab, "doc_id").withColumn("held", toxicity.held_out()).collect()
    test = [(r.score >= 0.5, r.toxic == 1) for r in scored if r.held]
    english = [(r.score >= 0.5, r.toxic == 1) for r in scored if r.held and r.lang == "en"]
    assert np.mean([p == t for p, t in test]) > 0.9
    assert np.mean([p == t for p, t in english]) > 0.95
    base = "of the thing in that re"
    texts = [f"{base} idiot {base}", f"{base} id-iot {base}", f"{base} i d i o t {base}", f"{base} idi*ot {base}", base]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs(spark, list(enumerate(texts))), model).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_toxicity_without_labels(spark):
    d = docs(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, one)).collect()} == {toxicity.UNSURE}
    noise = [(words(40, i), i % 2) for i in range(60)]
    assert toxicity.train(noise).probability(np.zeros(1))[0] < 0.5


def test_kernel_table_is_the_kernel():
    words_ = ["idiot", "id-iot", "the", "x", "a" * 32]
    v = toxicity.vectors(words_)
    gram = toxicity.Table(toxicity._columns(v), len(words_))(words_)
    for i in range(len(words_)):
        for j in range(len(words_)):
            assert abs(gram[i, j] - sum(x * v[j].get(k, 0) for k, x in v[i].items())) < 1e-9


# --- 7


def plain_removal(rows, length=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    passage, near = words(40, 50), words(12, 51)
    rows = awkward() + [(20, words(30, 52) + " " + passage), (21, passage + " " + words(9, 53)), (22, near + " q"), (23, near + " r"), (24, "a " * 60), (25, "a " * 70), (26, passage)]
    got = rows_of(substring_dedup.remove_repeats(with_clashes(docs(spark, rows))), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain_removal(rows)


def test_fm_index_counts_patterns():
    rng = np.random.RandomState(5)
    text = np.append(rng.randint(1, 4, 500), 0)
    index = substring_dedup.FMIndex(text, 4)
    for _ in range(200):
        k = rng.randint(0, 480)
        pattern = text[k : k + rng.randint(1, 12)]
        if 0 in pattern:
            continue
        lo, hi = np.array([index.first[pattern[-1]]]), np.array([index.first[pattern[-1] + 1]])
        for c in pattern[-2::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1))


# --- 8


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [float(x) for x in rng.randn(8).astype("f4")]) for i in range(300)]
    rows += [(400 + i, rows[20][1]) for i in range(30)]  # copies: ties go to smaller ids
    rows += [(500, None), (520, [0.0] * 8), (540, [1.0, float("nan")] + [0.0] * 6), (560, [float("inf")] * 8), (580, [None] + [1.0] * 7), (600, []), (620, [1.0, 2.0]), (640, [3.0, 1.0]), (None, [1.0] * 8), (20, rows[20][1])]
    v = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in vp_search.nearest(v, v.where("vec_id % 20 = 0"), k=5, factor=1.0, shard_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fine = [(i, np.array(x, float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    asked = {i: x for i, x in fine if i % 20 == 0}
    assert set(got) == set(asked)
    for q, x in asked.items():
        want = sorted(((-float(np.add.accumulate(x * y)[-1]), i) for i, y in fine if i != q and len(y) == len(x)))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert all(abs(s + w) < 1e-9 for (_, s), (w, _) in zip(got[q], want))


def spread(kind, n=6000, dim=32):
    rng = np.random.RandomState(2)
    if kind == "clusters":
        return rng.randn(40, dim)[rng.randint(0, 40, n)] + 0.4 * rng.randn(n, dim)
    x = rng.randn(n, dim)
    if kind == "spread norms":
        return x * np.exp(2 * rng.randn(n))[:, None]
    x[7] *= {"outlier": 1e4, "huge": 1e160, "plain": 1.0}[kind]
    return x


@pytest.mark.parametrize("kind", ["plain", "clusters", "spread norms", "outlier", "huge"])
def test_recall_of_relaxed_search(spark, kind):
    x = spread(kind)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.arange(0, len(x), 100)
    products = x[q] @ x.T
    products[np.arange(len(q)), q] = -np.inf
    true = {int(i): set(np.lexsort((np.arange(len(x)), -p))[:20].tolist()) for i, p in zip(q, products)}
    for factor, least in ((1.0, 1.0), (2.0, 0.95)):
        got = vp_search.nearest(v, v.where("vec_id % 100 = 0"), factor=factor, shard_rows=2500).collect()
        assert sum(r.vec_id in true[r.query_id] for r in got) >= least * 20 * len(q)


def test_no_vectors(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vp_search.nearest(v, v).count() == 0


# --- 9


def plain_components(rows):
    def shingles(t):
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(n, seed, edits):
    base, out = words(200, seed, 5000).split(), []
    rng = np.random.RandomState(seed)
    for _ in range(n):
        w = list(base)
        for i in rng.randint(0, 200, rng.randint(0, edits + 1)):
            w[i] = f"e{rng.randint(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limit", [3000, 20])
def test_jaccard_components(spark, limit):
    rows = awkward() + [(1000 + i, t) for i, t in enumerate(near_copies(90, 31, 6) + near_copies(40, 32, 2) + [words(50, s) for s in range(20)])]
    got = jaccard_join.near_duplicates(with_clashes(docs(spark, rows)), group_limit=limit)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_components(rows)


# --- 10


def plain_line_removal(rows):
    entries, seen = [], {}
    keyed = sorted({(i if i is not None else 2**63 - 1, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    lines = []
    for i, t in keyed:
        for k, line in enumerate(t.split("\n")):
            g = frozenset(line.lower().replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")) - {""}
            if g:
                lines.append((i, t, k, g))
                if g not in seen:
                    seen[g] = (i, t, k)
                    entries.append(g)
    gone = set()
    for b in range(len(entries)):
        if any(100 * len(entries[a] & entries[b]) >= 80 * len(entries[a] | entries[b]) for a in range(b)):
            gone.add(entries[b])
    lost = defaultdict(set)
    for i, t, k, g in lines:
        if g in gone or seen[g] != (i, t, k):
            lost[(i, t)].add(k)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        drop = lost.get((i if i is not None else 2**63 - 1, t), set())
        out.append((i, len(parts), len(drop), "\n".join(x for k, x in enumerate(parts) if k not in drop)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    lines = [" ".join(t.split()[:60]) for t in near_copies(80, 41, 3)]
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(20)]
    rows += [(100, words(20, 60) + "\nshort one\n" + words(20, 61)), (101, "short one\n" + words(20, 61).upper()), (102, None), (103, ""), (102, words(20, 61)), (102, words(20, 61)), (None, words(20, 60))]
    out = line_dedup.remove_lines(docs(spark, rows))
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in out.collect()), key=repr)
    assert got == plain_line_removal(rows)
    d = docs(spark, rows)
    entries = line_dedup.entries_of(line_dedup.line_table(d))
    assert rows_of(line_dedup.matches(d, entries), "eid") == rows_of(line_dedup.matches(d, entries, broadcast_rows=0), "eid")


def test_lines_with_one_word_in_all(spark):
    """One word in every line, a tiny vocabulary, near misses, short repeats."""
    rng = np.random.RandomState(6)
    lines = [" ".join(["the", *(f"v{i}" for i in rng.randint(0, 40, rng.randint(1, 16)))]) for _ in range(400)]
    lines += [" ".join(["the", *(f"v{i}" for i in rng.randint(0, 400, rng.randint(60, 140)))]) for _ in range(30)]
    lines += [" ".join(w for w in x.split() if rng.rand() > 0.08) + f" e{rng.randint(9)}" for x in lines[200:]] + ["Subscribe now"] * 5 + ["now  SUBSCRIBE", "", " \t "]
    rows = [(i, "\n".join(lines[k] for k in rng.randint(0, len(lines), 12))) for i in range(70)]
    for slots in (line_dedup.SLOTS, 16):
        got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in line_dedup.remove_lines(docs(spark, rows), slots=slots).collect()), key=repr)
        assert got == plain_line_removal(rows)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lines_near_those_of_repeated_rows(spark, limit):
    a, b, c = (words(30, s, 10_000) for s in (70, 71, 72))
    rows = [(1, a), (1, a), (2, a + " end"), (3, b), (4, b + " end"), (4, b + " end"), (5, c + " end"), (None, c), (None, c)]
    d = docs(spark, rows)
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in line_dedup.remove_lines(d).collect()), key=repr)
    assert got == plain_line_removal(rows)
    assert line_dedup.matches(d, line_dedup.entries_of(line_dedup.line_table(d)), broadcast_rows=limit).count() == 3


def test_line_pairs_in_one_pass(spark):
    """One pass over all postings finds what two and one of open entries find; only words of
    more entries than hubs are looked up there; no pair is lost either way."""
    rng = np.random.RandomState(8)
    base = [words(20, s, 5000).split() for s in range(200, 206)]
    rows = [(i, " ".join(w for w in base[i % 6] if rng.rand() > 0.06) + f" own{i}\tx{rng.randint(9)}") for i in range(120)]
    d = docs(spark, rows)
    entries = line_dedup.entries_of(line_dedup.line_table(d))
    for limit in (500_000, 0):
        assert line_dedup.heads(entries, 80, limit).count() == 0  # 20 lines a group, 32 hubs
        assert line_dedup.heads(entries, 80, limit, hubs=4).count() > 60
    open_ = entries.where("eid % 3 = 0")
    some = line_dedup._postings(open_.withColumn("late", F.lit(True)), 80)
    all_ = line_dedup._postings(entries.withColumn("late", F.lit(False)), 80)
    one = line_dedup.candidates(all_, some, 80, either=True)
    parts = [line_dedup.candidates(a, b, 80) for a, b in ((all_, some), (some, all_), (some, some))]
    several = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows_of(one.distinct(), "late", "early") == rows_of(several.distinct(), "late", "early") != []
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in line_dedup.remove_lines(d).collect()), key=repr)
    assert got == plain_line_removal(rows)


def test_line_hubs_are_met_about_once(spark, monkeypatch):
    """Members of a large group meet each hub about once, not once a word, and no join passes
    on all postings of frequent words."""
    rng = np.random.RandomState(9)
    base = words(40, 300, 5000).split()
    rows = [(i, " ".join(w for w in base if rng.rand() > 0.04) + f" own{i}") for i in range(150)]
    d = docs(spark, rows)
    seen, closest = [], line_dedup.closest
    monkeypatch.setattr(line_dedup, "closest", lambda pairs: seen.append(pairs) or closest(pairs))
    assert line_dedup.heads(line_dedup.entries_of(line_dedup.line_table(d)), 80, 500_000).count() > 100
    pairs = rows_of(seen[0], "late", "early")
    assert len(pairs) < 1.7 * len(set(pairs))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "LeftSemi" not in plan
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in line_dedup.remove_lines(d).collect()), key=repr)
    assert got == plain_line_removal(rows)


def test_frequent_words_are_all_marked(spark):
    """Every word of more postings than asked is marked, also where slots are few."""
    postings = spark.createDataFrame([(w, k) for w in range(300) for k in range(w % 7)], "tok int, eid int")
    often = {w for w in range(300) if w % 7 > 3}
    for slots in (1 << 18, 16):
        marked = {r.tok for r in postings.where(line_dedup.frequent(postings, 3, slots)).select("tok").distinct().collect()}
        assert marked >= often
        assert slots == 16 or marked == often


def test_line_hubs_of_one_shuffle(spark, monkeypatch):
    """Too many hubs for a broadcast are not stored but read from the shuffle of their words'
    postings, with the same heads; words of no more than twice as many entries have none."""
    rng = np.random.RandomState(10)
    base = [words(20, s, 5000).split() for s in range(300, 306)]
    d = docs(spark, [(i, " ".join(w for w in base[i % 6] if rng.rand() > 0.06) + f" own{i}") for i in range(150)])
    entries = line_dedup.entries_of(line_dedup.line_table(d))
    assert line_dedup.heads(entries, 80, 500_000, hubs=15).count() == 0  # 25 lines a group
    few = rows_of(line_dedup.heads(entries, 80, 500_000, hubs=4), "late", "early")
    names, stored, seen, closest = [], line_dedup.stored, [], line_dedup.closest
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: names.append(name) or stored(df, name))
    monkeypatch.setattr(line_dedup, "closest", lambda pairs: seen.append(pairs) or closest(pairs))
    many = rows_of(line_dedup.heads(entries, 80, 0, hubs=4), "late", "early")
    assert {x for x, _ in many} == {x for x, _ in few} and len(many) > 60
    assert names == ["heads"]
    seen[0].collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("+- Exchange hashpartitioning(tok") == 1 == plan.count("ReusedExchange"), plan


def test_line_work_is_done_once(spark):
    """Texts are split into lines once, not once more for a filter; a pair's words are
    neither lowered nor counted in the join; postings meet in five columns of one shuffle."""
    rng = np.random.RandomState(11)
    base = [words(20, s, 5000).split() for s in range(400, 406)]
    rows = [(i, "\n".join(" ".join(w for w in base[(i + k) % 6] if rng.rand() > 0.06) + f"\tOwn{i} x{k}" for k in range(2))) for i in range(40)] + [(90, None), (91, "")]
    d = docs(spark, rows)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(line_dedup.lines_of(d)).count("split(") == 1
    assert line_dedup.lines_of(d).count() == 81  # none of a null text
    entries = line_dedup.entries_of(line_dedup.line_table(d))
    all_ = line_dedup._postings(entries.withColumn("late", F.lit(True)), 80)
    met = line_dedup.candidates(all_, all_, 80)
    pairs = _shared.stored(met.select("late", "early").distinct(), "pairs")
    join = plan(met).split("Join Inner")[1].split("\n")
    assert join[1].count(" AS ") == 4, join  # tok, and eid, z, q and m
    with _shared.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        met.collect()
    done = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("+- Exchange hashpartitioning(tok") == 1 == done.count("ReusedExchange"), done
    found = line_dedup.verified(d, pairs, entries, 80, 500_000)
    assert found.count() > 40
    assert "lower(" not in plan(found) and plan(found).count("array_intersect(") == 1
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in line_dedup.remove_lines(d).collect()), key=repr)
    assert got == plain_line_removal(rows)

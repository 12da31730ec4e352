"""The stored index, the vector table, lists and blocked search against plain versions."""

import sys
import threading

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import evaluation as M
from quillspark.operators import fusion as R
from quillspark.operators import lexical as B
from quillspark.operators import vectors as D
from quillspark.operators.index import InvertedIndex
from quillspark.operators.vector_table import ListIndex, VectorTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SF = "/root/testdata/sf0.001"


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    odd = spark.createDataFrame([(900_001, None, "src1"), (900_002, "", "src1"), (900_003, "<p> </p>", None), (5, "thea onre again", "src2")], docs.schema)
    return docs.union(docs.where("chunk_id % 5 = 0")).union(odd)  # repeated rows and ids


@pytest.fixture(scope="module")
def queries(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    odd = spark.createDataFrame([(901, "nowhere-to-be-found"), (902, ""), (903, None), (904, "the the the")], items.schema)
    return items.union(odd)


@pytest.fixture(scope="module")
def index(chunks):
    return InvertedIndex.build(chunks)


@pytest.mark.parametrize("k1, b, k", [(1.5, 0.75, 5), (0.9, 0.0, 20), (2.0, 1.0, 1)])
def test_index_equals_search_over_texts(index, chunks, queries, k1, b, k):
    expected = hits(B.search(queries, chunks, F.col("text"), k, k1, b))
    assert hits(index.search(queries, k, k1, b)) == expected
    # Terms that are joined by salts, no pruning, and few seeds give the same.
    assert hits(index.search(queries, k, k1, b, small=0, share=0.9, seeds=1)) == expected
    assert hits(index.search(queries, k, k1, b, share=0.0)) == expected


def test_index_filters_what_is_returned_only(index, chunks, queries):
    where = F.col("source") == "src1"
    assert hits(index.search(queries, 5, where=where)) == hits(B.search(queries, chunks, F.col("text"), 5, where=where))


def test_index_prunes(spark, index, queries):
    pruned, whole = {}, {}
    index.search(queries, 5, counts=pruned)
    index.search(queries, 5, share=0.0, seeds=0, counts=whole)
    assert whole["held"] == whole["read"]
    assert pruned["held"] < 0.3 * whole["held"] and pruned["scored"] < 0.1 * whole["held"]


def test_index_reads_no_text_and_is_reopened(spark, index, queries):
    again = InvertedIndex(spark, index.path)
    assert "text" not in again.rows.columns + again.postings.columns
    assert again.postings.where("n > 128").isEmpty()
    assert hits(again.search(queries, 3)) == hits(index.search(queries, 3))
    with pytest.raises(ValueError):
        again.search(queries, 0)


def test_index_of_nothing(spark, chunks, queries):
    empty = InvertedIndex.build(chunks.limit(0))
    assert empty.search(queries).count() == 0
    assert InvertedIndex.build(chunks).search(queries.limit(0)).count() == 0


def plain(queries, rows, k):
    out = []
    for qid, q in queries:
        scored = []
        for cid, v in rows:
            if v is None or len(v) != len(q) or not all(x is not None and np.isfinite(x) for x in v):
                continue
            dot, a, b = (sum(x * y for x, y in zip(s, t, strict=True)) for s, t in ((q, v), (q, q), (v, v)))
            scored.append((-(dot / (a**0.5 * b**0.5) if a and b else 0.0), cid))
        out += [(qid, i + 1, c, round(max(-1.0, min(1.0, -s)), 9)) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_blocked_cosine(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, 2.0]), (303, [float("nan")] + [0.0] * 5), (304, [None] + [1.0] * 5)]
    asked = [(i, rows[i][1]) for i in range(12)] + [(50, [0.0] * 6), (51, [1.0, 1.0]), (52, [1.0])]
    r, q = spark.createDataFrame(rows, "chunk_id long, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")
    for bound in (D.BLOCK, 20):
        monkeypatch.setattr(D.query_blocks, "__defaults__", (bound,))
        found = D.search(q, r.repartition(5), 7)
        assert hits(found) == plain(asked, rows, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert D.search(q.limit(0), r).count() == 0 and D.search(q, r.limit(0)).count() == 0
    names = spark.createDataFrame([("x", [1.0, 0.0]), ("a", [1.0, 0.0])], "chunk_id string, vector array<float>")
    assert [h.chunk_id for h in D.search(q.where("query_id = 51"), names, 1).collect()] == ["a"]


def recall(found, exact):
    return len({x[::2] for x in hits(found)} & {x[::2] for x in hits(exact)}) / exact.count()


def test_lists_find_most_and_prune(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    q = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    index = ListIndex.build(rows)
    assert recall(index.search(q), D.search(q, rows)) >= 0.95
    third = F.col("label") == 3  # the best of few rows may lie in any list
    assert recall(index.search(q, where=third, share=0.9), D.search(q, rows, where=third)) >= 0.95
    assert index.rows.count() == rows.count()
    one = index.search(q.limit(1), share=0.1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan or "PartitionFilters: [isnotnull(list" in plan
    read = index.rows.where(F.col("list").isin(sorted(index.probed(0.1)([q.first().vector]))))
    assert read.count() < 0.3 * rows.count()


def test_clustered_lists_need_few_probes(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 4
    data = [(i, (centres[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(1600)]
    rows = spark.createDataFrame(data, "chunk_id long, vector array<double>")
    q = rows.where("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "vector")
    index = ListIndex.build(rows, lists=40)
    assert recall(index.search(q, share=0.1), D.search(q, rows)) >= 0.95


def table_rows(t):
    return {r.chunk_id: r.label for r in t.read().collect()}


def test_table_merges_buckets_only(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"), "m", 1, buckets=8)
    make = lambda ids, label: spark.createDataFrame([(i, [1.0], label) for i in ids], "chunk_id long, vector array<double>, label int")
    assert t.upsert(make(range(100), 0)) == 100
    before = t._version(1)["folders"]
    assert t.upsert(make([7], 1)) == 1
    after = t._version(2)["folders"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert table_rows(t) == {i: int(i == 7) for i in range(100)}
    assert t.read(1).where("label = 1").isEmpty()
    assert t.upsert(make([], 1)) == 0 and len(t.versions()) == 2
    twice = spark.createDataFrame([(8, [1.0], 5, 1), (8, [1.0], 6, 2)], "chunk_id long, vector array<double>, label int, version int")
    other = VectorTable(spark, str(tmp_path / "o"), "m", 1)
    assert other.upsert(twice, order="version") == 2 and table_rows(other) == {8: 6}
    for i in range(4):
        t.upsert(make([i], 9))
    assert len(t.versions()) == 3 and t.versions()[-1] >= 6
    named = {f for v in t.versions() for f in t._version(v)["folders"].values()}
    assert set(t.files.names("data")) == named


def test_two_writers_lose_nothing(spark, tmp_path):
    path, errors = str(tmp_path / "t"), []
    tables = [VectorTable(spark, path, "m", 1, buckets=4) for _ in range(3)]

    def write(t, label):
        try:
            for part in range(2):
                ids = range(part * 10, part * 10 + 10)
                t.upsert(spark.createDataFrame([(1000 * label + i, [1.0], label) for i in ids], "chunk_id long, vector array<double>, label int"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(t, i)) for i, t in enumerate(tables)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    assert table_rows(tables[0]) == {1000 * n + i: n for n in range(3) for i in range(20)}


def test_a_taken_version_is_not_replaced(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"), "m", 1)
    assert t.files.create("versions/x", "a") and not t.files.create("versions/x", "b")
    assert t.files.read("versions/x") == "a" and t.files.names("versions") == ["x"]


class Loaded:
    """A model that counts its loads in files and its batches by what it gets."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return lambda texts, most: [[3.0 * len(texts), 4.0 * len(texts)] for _ in texts]


def test_model_encoder_is_loaded_once_a_worker(spark, tmp_path):
    encoder = D.ModelEncoder(Loaded(str(tmp_path)), f"m{tmp_path}", 2, batch_size=4)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "chunk_id long, text string").repartition(8)
    out = D.encode(rows, F.col("text"), encoder).collect()
    assert all(np.allclose(r.vector, [0.6, 0.8]) for r in out) and len(out) == 40
    D.encode(rows, F.col("text"), encoder).collect()
    assert 1 <= len(list(tmp_path.iterdir())) <= 8  # workers, not tasks or batches
    assert encoder.encode_documents([]) == []
    with pytest.raises(ValueError):
        D.encode(rows, F.col("text"), encoder, batch_size=0)
    with pytest.raises(ValueError):
        D.ModelEncoder(Loaded(""), "m", 2, batch_size=0)


def test_table_encodes_texts_and_searches(spark, tmp_path):
    class Fake:
        model_name, dimension = "fake", 2

        def encode_documents(self, texts):
            assert len(texts) <= 3
            return [[1.0, 0.0] if "vision" in t else [0.0, 1.0] for t in texts]

        encode_queries = encode_documents

    t = VectorTable(spark, str(tmp_path / "t"), "fake", 2)
    rows = spark.createDataFrame([(i, "vision" if i % 2 else "other") for i in range(20)], "chunk_id long, text string")
    assert t.upsert_texts(rows, F.col("text"), Fake(), batch_size=3) == 20
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [h.chunk_id for h in t.search(q, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert [h.chunk_id for h in t.index().search(q, 3, share=1.0).orderBy("rank").collect()] == [1, 3, 5]


def test_pair_scores_do_not_depend_on_batches(spark):
    seen = []

    def load():
        def model(pairs, most):
            seen.append([len(q) + len(d) for q, d in pairs])
            return [[len(q) * 1000.0 + len(d)] for q, d in pairs]

        return model

    pairs = [("q" * (i % 5 + 1), "d" * (37 * i % 50)) for i in range(30)]
    one = [R.PairScorer(load, f"x{n}", batch_size=n).score(pairs) for n in (1, 4, 100)]
    assert one[0] == one[1] == one[2]
    assert all(len(b) <= 100 for b in seen) and sorted(seen[-1]) == seen[-1]
    df = spark.createDataFrame(pairs, "q string, d string").repartition(3)
    scorer = R.PairScorer(load, "spark", batch_size=4)
    assert all(r.s == len(r.q) * 1000.0 + len(r.d) for r in df.withColumn("s", scorer(F.col("q"), F.col("d"))).collect())
    with pytest.raises(ValueError, match="one score per candidate"):
        R.PairScorer(lambda: lambda pairs, most: [], "none").score(pairs)


def test_containing_equals_contains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(1, "a b"), (2, "xa b cy d e"), (3, ""), (4, None), (5, "a  b  c  d"), (5, "q a  b  c  dd")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    more = [(901, "a b cy d"), (902, "a b"), (903, ""), (904, None), (905, "a  b  c  d"), (906, "b cy d e"), (907, "no such words here at all")]
    passages = items.union(spark.createDataFrame(more, items.schema))
    pair = lambda df: sorted((r.query_id, r.doc_id) for r in df.collect())
    assert pair(M.containing(docs, passages)) == pair(docs.join(passages, F.col("text").contains(F.col("passage"))))
    plan = M.containing(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bm25_evaluation(spark, chunks, queries):
    cases = queries.where("query_id < 3").withColumn("relevant", F.array(F.col("query_id")))
    one, two = M.evaluate_bm25(cases, chunks)
    three, _ = M.evaluate(cases, lambda q, k: B.search(q, chunks, F.col("text"), k))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, three.collect())) and two.count() == 1


def test_index_of_a_table_is_written_once(spark, tmp_path):
    from quillspark.plans import catalog

    spark.read.parquet(f"{SF}/documents.parquet").limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = (catalog._index(spark, str(tmp_path)) for _ in range(2))
    assert one.path == two.path and one.n_docs == 20
    spark.read.parquet(f"{SF}/documents.parquet").limit(5).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert catalog._index(spark, str(tmp_path)).n_docs == 25

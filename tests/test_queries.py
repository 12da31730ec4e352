"""Queries against their SQL on tables made for one finding each."""

import sys
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import evaluation as M
from quillspark.operators import fusion as R
from quillspark.operators import vectors as D
from quillspark.operators.index import InvertedIndex
from quillspark.plans import catalog

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def by_sql(folder, name, *tables):
    """Rows of a query by its SQL, in order."""
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        return sorted(c.execute(catalog.ORACLES[name]).fetchall())


def by_spark(spark, folder, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).collect()))


def test_pages_cut_within_an_entity(spark, tmp_path):
    rows = [(1, "<p>one &amp; two &amp<p>margin</p>"), (2, "a &quot;b&quot; &copy; &middot; &am"), (3, "&lt;x&gt; &amp;quot; &ampy;"), (4, None), (5, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = by_spark(spark, tmp_path, "tokenize_pages")
    assert got == by_sql(tmp_path, "tokenize_pages", "pages")


SF = "/root/testdata/sf0.001"


def shuffled(spark, work):
    """What some work returns and the bytes that it shuffled."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return work(), total() - before


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", "source")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@pytest.mark.parametrize("segment", [100, 2_000_000])
def test_postings_hold_the_texts_and_are_not_shuffled(spark, docs, monkeypatch, tmp_path, segment):
    monkeypatch.setattr("quillspark.operators.index.SEGMENT", segment)
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    spread = spark.read.parquet(f"{tmp_path}/docs")
    index, moved = shuffled(spark, lambda: InvertedIndex.build(spread))
    assert moved < 2_000  # the numbers of all rows, for the mean length
    one = index.postings.select("term", F.explode(F.arrays_zip("rows", "tfs", "lens")).alias("p")).select("term", "p.*")
    two = index.forward.select(F.explode("tfs").alias("term", "tf"), "row", "len").select("term", F.col("row").alias("rows"), F.col("tf").alias("tfs"), F.col("len").alias("lens"))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and not one.isEmpty()
    assert index.postings.where("n <> size(rows) or max_tf <> array_max(tfs) or min_len <> array_min(lens) or n > 128").isEmpty()


def test_frequencies_of_rows_are_not_shuffled(spark, docs, items):
    index = InvertedIndex.build(docs)
    _, moved = shuffled(spark, lambda: index.search(items, 1))
    many = docs.select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), F.lit("unasked " * 20).alias("text"), "source")
    other = InvertedIndex.build(docs.union(many.withColumn("text", F.concat("text", F.col("chunk_id").cast("string")))))
    _, more = shuffled(spark, lambda: other.search(items, 1))
    assert more < 1.5 * moved  # rows that no query asks for move nothing


def test_filter_goes_before_the_sums(spark, docs, items):
    index = InvertedIndex.build(docs)
    _, all_rows = shuffled(spark, lambda: index.search(items, 5, share=0.0, seeds=0))
    _, some = shuffled(spark, lambda: index.search(items, 5, share=0.0, seeds=0, where=F.col("source") == "src3"))
    assert some < 0.7 * all_rows


def test_passages_meet_texts_where_they_are(spark, docs, items):
    passages = items.withColumnRenamed("query", "passage")
    found, moved = shuffled(spark, lambda: sorted((r.query_id, r.chunk_id) for r in M.containing(docs, passages, "chunk_id").collect()))
    assert found == sorted((r.query_id, r.chunk_id) for r in docs.join(passages, F.col("text").contains(F.col("passage"))).collect())
    assert moved < 0.2 * docs.agg(F.sum(F.length("text"))).first()[0]
    # More passages than are broadcast give the same.
    M.PASSAGES, kept = 0, M.PASSAGES
    try:
        assert sorted((r.query_id, r.chunk_id) for r in M.containing(docs, passages, "chunk_id").collect()) == found
    finally:
        M.PASSAGES = kept


def test_hits_go_to_the_texts(spark, docs):
    hits = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "query_id long, chunk_id long").join(docs.select("chunk_id").distinct(), "chunk_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = shuffled(spark, lambda: R.with_payload(hits, docs, ["text"]).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 3 and moved < 0.2 * docs.agg(F.sum(F.length("text"))).first()[0]


@pytest.mark.parametrize("kinds", [3000, 1])
def test_products_of_a_batch_are_bounded(kinds):
    """3,000 rows, all different or all equal, against 12,000 queries: 288 MB of products."""
    r = np.random.default_rng(3)
    x = r.normal(size=(kinds, 4))[np.arange(3000) % kinds]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)[::-1]), pa.array(list(x))], names=["chunk_id", "vector"])
    q = r.normal(size=(12000, 4))
    asked = D.by_length(list(q))
    tracemalloc.start()
    try:
        t = D.nearest_in(batch, asked, np.full(12000, -np.inf), 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(t) == 36_000 and peak < 200e6
    for i in range(0, 12000, 997):
        score = D._cosines(D.folded(np.repeat(q[i : i + 1], 3000, 0), x), D.folded(q[i : i + 1], q[i : i + 1]), D.folded(x, x))
        best = sorted(zip(-score, 2999 - np.arange(3000), strict=True))[:3]
        assert [(-s, int(c)) for s, c in best] == [(s, c) for s, c in zip(t["score"].to_pylist()[3 * i : 3 * i + 3], t["id"].to_pylist()[3 * i : 3 * i + 3], strict=True)]

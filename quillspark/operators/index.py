"""A stored inverted index: BM25 over batches of queries that reads no text.

A posting list is kept in segments of the rows, as blocks of at most BLOCK postings, those
with high frequencies and short texts first; a block knows its highest frequency and shortest text, which bound every
score in it for any k1 and b. A search is a few joins over blocks:

1. The rarest terms of each query give some promising rows, and the k-th best whole score
   among them a threshold that k rows at least reach.
2. Terms are skipped, those first whose bound is small for the length of their list, as long
   as their bounds add up to no more than SHARE of the threshold. A row that only holds
   skipped terms can't reach it. Only the lists of the other terms are read, but for blocks
   whose bound, with all other terms at theirs, stays below the threshold.
3. Rows whose sum, with all skipped terms at their bounds, stays below the threshold go. The
   skipped terms of the best of the others are looked up in the rows' own frequencies, which
   gives a higher threshold; then those of what still reaches it, and the best are scored in
   query order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from quillspark.functions.text import with_tokens
from quillspark.sources.scratch import Kept, new_path, stored

from .lexical import check, query_terms, rank

POSTINGS = "term string, part long, n int, max_tf int, min_len int, rows array<long>, tfs array<int>, lens array<int>, bucket int"
BLOCK = 128
INVERTED = POSTINGS.removesuffix(", bucket int")
SEGMENT = 2_000_000  # postings that a task inverts at once
PIECE = 10_000  # blocks that are handed over at once
BUCKETS = 8
SEEDS = 20  # postings of the rarest terms read for the threshold, for each wanted hit
SHARE = 0.5
LITTLE = 1e-9  # more than sums in another order can differ by
TERMS = 100_000  # rows of (query, term) that are broadcast; more are joined by salted terms
SALTS = 16
PAIRS = 1_000_000  # (query, row) pairs that are broadcast to the frequencies of the rows


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (tokens, ...) with the frequencies of the tokens in their place."""
    for batch in batches:
        tokens = batch.column(0)
        codes = tokens.flatten().dictionary_encode()
        size = max(1, len(codes.dictionary))
        row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
        pairs, tfs = np.unique(row * size + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(tokens) + 1) * size)
        counts = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), codes.dictionary.take(pa.array(pairs % size)), pa.array(tfs, pa.int32()))
        yield pa.RecordBatch.from_arrays([counts, *batch.columns[1:]], names=["tfs", *batch.schema.names[1:]])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings from batches (row, len, terms, tfs): those of one segment with high
    frequencies and short texts first."""
    some, n, part = [], 0, 0
    for batch in batches:
        some.append(batch)
        n += len(batch.column(2).flatten())
        if n >= SEGMENT:
            yield from _segment(some, part)
            some, n, part = [], 0, part + 1
    if n:
        yield from _segment(some, part)


def _segment(some: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    flat = lambda c: pa.concat_arrays([b.column(c).flatten() for b in some])
    whole = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in some])
    of = np.repeat(np.arange(sum(map(len, some))), np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in some]))
    rows, lens, tfs, terms = whole(0)[of], whole(1)[of], flat(3).to_numpy(zero_copy_only=False), flat(2).dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((rows, lens, -tfs, code))
    code, rows, lens, tfs = code[order], rows[order], lens[order], tfs[order]
    place = np.arange(len(code)) - np.searchsorted(code, code)
    starts = np.flatnonzero(place % BLOCK == 0)
    for i in range(0, len(starts), PIECE):
        at = starts[i : i + PIECE]
        end = starts[i + PIECE] if i + PIECE < len(starts) else len(code)
        ends = np.append(at, end) - at[0]
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[at[0] : end], kind))  # noqa: B023, E731
        columns = [terms.dictionary.take(pa.array(code[at])), pa.array(np.full(len(at), part), pa.int64()), pa.array(np.diff(ends), pa.int32()), pa.array(tfs[at], pa.int32()), pa.array(np.minimum.reduceat(lens[at[0] : end], ends[:-1]), pa.int32()), lists(rows, pa.int64()), lists(tfs, pa.int32()), lists(lens, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "part", "n", "max_tf", "min_len", "rows", "tfs", "lens"])


class InvertedIndex:
    """An index in a folder: rows, postings (partitioned by a bucket of the term), forward (the
    frequencies of each row), about."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.rows = spark.read.schema(StructType.fromJson(json.loads(about.rows))).parquet(f"{path}/rows")
        self.forward = spark.read.schema("row long, len int, tfs map<string,int>").parquet(f"{path}/forward")
        self.postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        self.n_docs, self.avg_len, self.buckets, self.entities = about.n_docs, about.avg_len, about.buckets, about.entities

    @classmethod
    def build(cls, chunks: DataFrame, text: str = "text", path: str | None = None, id_col: str = "chunk_id", entities: bool = True, buckets: int = BUCKETS) -> InvertedIndex:
        """Tokenise once and write the index; `path` must not exist yet (one in the shared
        scratch folder, if none is given).

        All columns of chunks but the text are kept for filters, so pass those that are
        needed. Null texts are rows without tokens; equal ids stay rows of their own.
        Nothing is shuffled, but for texts in fewer partitions than there are cores: a task counts the tokens of its texts, and then inverts the rows
        of its files in segments of about SEGMENT postings. It writes one sorted file for
        each bucket.
        """
        spark = chunks.sparkSession
        path = path or new_path(spark, "index")
        cores = spark.sparkContext.defaultParallelism
        if chunks.rdd.getNumPartitions() < cores:
            chunks = chunks.repartition(cores)
        told = with_tokens(chunks, F.coalesce(F.col(text), F.lit("")), "_tokens", entities).drop(text)
        told = told.select("*", F.monotonically_increasing_id().alias("_row"), F.size("_tokens").alias("_len"))
        rows = told.drop("_tokens").withColumnRenamed(id_col, "chunk_id").schema
        counted = told.select("_tokens", *told.drop("_tokens").columns).mapInArrow(_counted, StructType([StructField("tfs", MapType(StringType(), IntegerType())), *rows.fields]))
        held = stored(counted.withColumnsRenamed({"_row": "row", "_len": "len"}), f"{path}/forward")
        rows = stored(held.drop("tfs").withColumnsRenamed({"row": "_row", "len": "_len"}), f"{path}/rows")
        about = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("_len"), F.lit(0.0)).alias("avg_len"), F.lit(buckets).alias("buckets"), F.lit(entities).alias("entities"), F.lit(rows.schema.json()).alias("rows"))
        stored(about.coalesce(1), f"{path}/about")
        blocks = held.select("row", "len", F.map_keys("tfs").alias("terms"), F.map_values("tfs").alias("tfs")).mapInArrow(_inverted, INVERTED)
        out = blocks.select(_bucket(F.col("term"), buckets).alias("bucket"), *blocks.columns)
        out.sortWithinPartitions("bucket", "term", "part").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        return cls(spark, path)

    def _terms(self, asked: DataFrame, share: Column, k1: float) -> DataFrame:
        """asked with what the index knows of each term: df, idf * qc and the bound of its
        scores. Reads the heads of the blocks only."""
        wanted = asked.select("bucket", "term").distinct()
        known = self.postings.join(wanted, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.max(share).alias("top"))
        idf = F.log(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(known.withColumn("idf", idf), "term").withColumn("bound", F.col("idf") * (k1 + 1) * F.col("top") * F.col("qc"))

    def search(self, queries: DataFrame, top_k: int = 5, k1: float = 1.5, b: float = 0.75, where: Column | None = None, share: float = SHARE, seeds: int = SEEDS, small: int = TERMS, counts: dict | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) for queries (query_id, query): as lexical.search.

        `where` filters what is returned by the kept columns, never the statistics. The result
        is stored. counts, if given, gets how many (query, row) pairs were read, held
        against the threshold, and scored to the end.
        """
        check(top_k, k1, b)
        with Kept(self.spark, "search") as scratch:
            asked = query_terms(queries, self.entities).withColumn("bucket", _bucket(F.col("term"), self.buckets))
            # tf / (tf + k1 * ...) grows with tf and falls with the length.
            norm = lambda n: k1 * (1 - b + b * n / max(self.avg_len, 1.0))
            head = F.col("max_tf") / (F.col("max_tf") + norm(F.col("min_len")))
            terms = scratch.keep(self._terms(asked, head, k1))
            few = terms.count() <= small
            weight = F.col("idf") * (k1 + 1) * F.col("qc")
            shown = None if where is None else scratch.keep(self.rows.where(where).select(F.col("_row").alias("row")))
            one = F.explode(F.arrays_zip("rows", "tfs", "lens")).alias("p")

            def sums(some: DataFrame) -> DataFrame:
                """(query_id, row, got): what the given terms add to each row."""
                if few:
                    met = self.postings.join(F.broadcast(some), ["bucket", "term"])
                else:  # a frequent term's blocks and their readers are dealt to SALTS groups
                    salt = F.pmod(F.xxhash64("part", "max_tf", "min_len", "n"), F.lit(SALTS))
                    spread = some.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
                    met = self.postings.withColumn("salt", salt).join(spread, ["bucket", "term", "salt"])
                if "slack" in some.columns:
                    met = met.where(weight * head + F.col("slack") >= 0)
                rows = met.select("query_id", weight.alias("weight"), one).select("query_id", F.col("p.rows").alias("row"), (F.col("weight") * F.col("p.tfs") / (F.col("p.tfs") + norm(F.col("p.lens")))).alias("x"))
                if shown is not None:  # dealt by row, which the groups below need no more than
                    rows = rows.join(shown, "row", "left_semi")
                return rows.groupBy("query_id", "row").agg(F.sum("x").alias("got"))

            def of_row(found: DataFrame, some: DataFrame) -> DataFrame:
                """found (query_id, row, ...) joined with what the given terms add to each row, as
                `sum`: the row's own frequencies are looked up, so no list is read. Frequencies
                stay where they are, unless there are too many pairs to bring to them. found
                is stored."""
                asked = some.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "idf", "qc"))).alias("asked"))
                held = self.forward.join(F.broadcast(found) if found.count() <= PAIRS else found, "row")
                held = held.join(F.broadcast(asked) if few else asked, "query_id", "left")

                def part(t):
                    tf = F.try_element_at(F.col("tfs"), t["term"])
                    # As the formula is written, so that equal texts have equal scores.
                    return F.coalesce(t["idf"] * tf * (k1 + 1) / (tf + norm(F.col("len"))) * t["qc"], F.lit(0.0))

                return held.withColumn("sum", F.coalesce(F.aggregate("asked", F.lit(0.0), lambda x, t: x + part(t)), F.lit(0.0))).drop("asked", "tfs", "len")

            def completed(found: DataFrame, others: DataFrame) -> DataFrame:
                """found (query_id, row, got) with what the other terms add."""
                return of_row(found, others).select("query_id", "row", (F.col("got") + F.col("sum")).alias("got"))

            by_query = Window.partitionBy("query_id")
            kth = lambda rows: rows.withColumn("at", F.row_number().over(by_query.orderBy(F.desc("got")))).withColumn("kth", F.min(F.when(F.col("at") == top_k, F.col("got"))).over(by_query))
            before = F.coalesce(F.sum("df").over(by_query.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            marked = scratch.keep(terms.withColumn("seed", before < seeds * top_k))
            first = rank(sums(marked.where("seed")).withColumnRenamed("got", "score"), 10 * top_k, F.desc("score"), F.asc("row")).withColumnRenamed("score", "got")
            first = completed(scratch.keep(first.select("query_id", "row", "got")), marked.where("not seed"))
            limit = kth(first).groupBy("query_id").agg((F.max("kth") * (1 - LITTLE)).alias("need"))

            order = by_query.orderBy(F.col("bound") / F.col("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
            planned = terms.join(limit, "query_id", "left").withColumn("need", F.coalesce("need", F.lit(0.0)))
            planned = planned.withColumn("skipped", F.sum("bound").over(order) <= share * F.col("need"))
            rest = F.coalesce(F.sum(F.when(F.col("skipped"), F.col("bound"))).over(by_query), F.lit(0.0))
            slack = F.sum("bound").over(by_query) * (1 + LITTLE) - F.col("bound") - F.col("need")
            planned = scratch.keep(planned.withColumn("rest", rest).withColumn("slack", slack))
            state = planned.select("query_id", "need", "rest").distinct()
            read = sums(planned.where("not skipped"))
            if counts is not None:
                read = scratch.keep(read)
                counts["read"] = read.count()
            found = scratch.keep(read.join(state, "query_id").where(F.col("got") + F.col("rest") * (1 + LITTLE) >= F.col("need")).select("query_id", "row", "got"))
            # The best of them, completed, give a higher threshold for the others.
            likely = scratch.keep(rank(found.withColumnRenamed("got", "score"), 10 * top_k, F.desc("score"), F.asc("row")).select("query_id", "row", F.col("score").alias("got")))
            limit = kth(completed(likely, planned.where("skipped"))).groupBy("query_id").agg((F.max("kth") * (1 - LITTLE)).alias("more"))
            state = scratch.keep(state.join(limit, "query_id"))
            left = found.join(F.broadcast(state) if few else state, "query_id").where(F.col("got") + F.col("rest") * (1 + LITTLE) >= F.coalesce("more", F.lit(0.0)))
            whole = kth(completed(scratch.keep(left.select("query_id", "row", "got")), planned.where("skipped")))
            best = scratch.keep(whole.where(F.col("got") >= F.coalesce("kth", F.lit(0.0)) * (1 - LITTLE)).select("query_id", "row"))
            if counts is not None:
                counts |= {"held": found.count(), "scored": best.count()}

            scored = of_row(best, terms).where("sum > 0").withColumnRenamed("sum", "score").join(self.rows.select(F.col("_row").alias("row"), "chunk_id"), "row")
            hits = rank(scored.select("query_id", "chunk_id", "score"), top_k, F.desc("score"), F.asc("chunk_id"))
            return stored(hits, new_path(self.spark, "hits"))

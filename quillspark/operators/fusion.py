"""Reciprocal rank fusion, hybrid hits and reranking, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import check, rank
from .vectors import held

HITS = 500_000  # hits that are broadcast to their chunks


class Retriever(Protocol):
    """queries (query_id, query, ...), top_k -> hits (query_id, chunk_id, score, rank)."""

    def __call__(self, queries: DataFrame, top_k: int) -> DataFrame: ...


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score) of any number of ranked lists (query_id, list_id, rank, chunk_id)."""
    parts = F.array_sort(F.collect_list(F.struct("list_id", (1.0 / (k + F.col("rank"))).alias("x"))))
    return ranked.groupBy("query_id", "chunk_id").agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["x"]).alias("score"))


def hybrid(sparse: DataFrame, dense: DataFrame, top_k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Fused hits with both ranks, null where a list lacks the chunk."""
    check(top_k)
    if rrf_k < 1:
        raise ValueError("rrf_k must be at least 1")
    side = lambda x, n: x.select("query_id", "chunk_id", F.col("rank").alias(n))
    both = side(sparse, "sparse_rank").join(side(dense, "dense_rank"), ["query_id", "chunk_id"], "full")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.withColumn("score", part("sparse_rank") + part("dense_rank"))
    return rank(fused, top_k, F.desc("score"), F.asc("chunk_id"))


def hybrid_retriever(sparse: Retriever, dense: Retriever, rrf_k: int = 60, candidate_k: int = 20) -> Retriever:
    if rrf_k < 1 or candidate_k < 1:
        raise ValueError("rrf_k and candidate_k must be at least 1")

    def run(queries: DataFrame, top_k: int = 5) -> DataFrame:
        check(top_k)
        wide = max(top_k, candidate_k)
        return hybrid(sparse(queries, wide), dense(queries, wide), top_k, rrf_k)

    return run


def with_payload(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with the columns of their chunks. Up to HITS hits go to the chunks, which stay where
    they are; they are counted first, so hits should be cheap to make again."""
    few = hits.count() <= HITS
    return (F.broadcast(hits) if few else hits).join(chunks.select("chunk_id", *columns), "chunk_id")


def scorer(score: Callable[[str, list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A (query, documents) -> scores function as a column function, in Arrow batches."""

    def column(query: Column, document: Column) -> Column:
        @F.pandas_udf("double")
        def run(q, d):
            import pandas as pd

            out = pd.Series(float("nan"), index=q.index)
            for query_, part in d.groupby(q):
                found = score(query_, part.tolist())
                if len(found) != len(part):
                    raise ValueError("the reranker must return exactly one score per candidate")
                out[part.index] = found
            return out

        return run(query, document)

    return column


class PairScorer:
    """A model of (query, document) pairs, loaded on executors once a worker.

    load() gives a function (pairs, max_length) -> scores, a number or a list of one each. Pairs
    of an Arrow batch, of any queries, are put in order of length and scored batch_size at a
    time, so that a batch pads little; a pair's score does not depend on its batch.
    """

    def __init__(self, load: Callable[[], Callable], model_name: str, batch_size: int = 8, max_length: int = 2048) -> None:
        if batch_size < 1 or max_length < 1:
            raise ValueError("batch_size and max_length must be at least 1")
        self.load, self.model_name, self.batch_size, self.max_length = load, model_name, batch_size, max_length

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        order = sorted(range(len(pairs)), key=lambda i: sum(map(len, pairs[i])))
        out = [0.0] * len(pairs)
        for i in range(0, len(order), self.batch_size):
            part = order[i : i + self.batch_size]
            found = list(held(("pairs", self.model_name), self.load)([pairs[j] for j in part], self.max_length))
            if len(found) != len(part):
                raise ValueError("the reranker must return exactly one score per candidate")
            for j, x in zip(part, found, strict=True):
                out[j] = float(x[0] if hasattr(x, "__len__") else x)
        return out

    def __call__(self, query: Column, document: Column) -> Column:
        me = self

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, d in batches:
                yield pd.Series(me.score(list(zip(q, d, strict=True))), dtype="float64")

        return run(query, document)


def rerank(candidates: DataFrame, score: Column, top_k: int = 5) -> DataFrame:
    """Candidates (query_id, chunk_id, score, rank, ...) by a new score, ties by old rank.

    Keeps the old score and rank as retrieval_score and retrieval_rank, and the ranks of
    the lists if the candidates have them.
    """
    check(top_k)
    kept = candidates.withColumnsRenamed({"score": "retrieval_score", "rank": "retrieval_rank"}).withColumn("score", score)
    for c in ("sparse_rank", "dense_rank"):
        if c not in kept.columns:
            kept = kept.withColumn(c, F.lit(None).cast("int"))
    return rank(kept, top_k, F.desc("score"), F.asc("retrieval_rank"))


def rerank_retriever(retriever: Retriever, score: Callable[[DataFrame], Column], candidate_k: int = 20) -> Retriever:
    if candidate_k < 1:
        raise ValueError("candidate_k must be at least 1")

    def run(queries: DataFrame, top_k: int = 5) -> DataFrame:
        check(top_k)
        found = retriever(queries, max(top_k, candidate_k))
        return rerank(found, score(found), top_k)

    return run

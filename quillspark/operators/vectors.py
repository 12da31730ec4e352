"""Dense retrieval by cosine: exact, by matrix products over blocks of queries and rows."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.sources.scratch import Kept

from .lexical import check, rank

BLOCK = 1 << 22  # components of queries that are broadcast at once (32 MB)
SCORES = 1 << 21  # products of a batch that a task holds at once (16 MB)
PAIRS = 1 << 16  # pairs of vectors whose products are added in order at once (64 MB at 64 components)


class Encoder(Protocol):
    """Texts to vectors of one dimension; called in batches on executors."""

    model_name: str
    dimension: int

    def encode_documents(self, texts: list[str]) -> list[list[float]]: ...
    def encode_queries(self, texts: list[str]) -> list[list[float]]: ...


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process makes once and keeps between its tasks."""
    kept = sys.modules.setdefault("quillspark_held", types.ModuleType("quillspark_held")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class ModelEncoder:
    """An encoder whose model is loaded on executors, once a worker and when first needed.

    load() gives a function (texts, max_length) -> vectors; it must be picklable, the model need
    not be. Vectors become unit vectors of 32-bit floats; queries get no prefix. Models of one
    name are one model: a worker keeps the first that it loaded.
    """

    def __init__(self, load: Callable[[], Callable], model_name: str, dimension: int, batch_size: int = 16, max_length: int = 8192) -> None:
        if batch_size < 1 or max_length < 1:
            raise ValueError("batch_size and max_length must be at least 1")
        self.load, self.model_name, self.dimension = load, model_name, dimension
        self.batch_size, self.max_length = batch_size, max_length

    def encode_documents(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch_size):
            part = texts[i : i + self.batch_size]
            x = np.asarray(held(("encoder", self.model_name), self.load)(part, self.max_length), np.float64).reshape(len(part), -1)
            size = np.sqrt((x * x).sum(1))
            out += (x / np.where(size > 0, size, 1)[:, None]).astype(np.float32).tolist()
        return out

    encode_queries = encode_documents


def encode(rows: DataFrame, text: Column, encoder: Encoder, queries: bool = False, batch_size: int | None = None) -> DataFrame:
    """Add vector; fails when the encoder returns another number or size of vectors. The
    encoder gets batch_size texts at a time, or those of an Arrow batch."""
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be at least 1")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = encoder.encode_queries if queries else encoder.encode_documents
        for s in batches:
            texts, out = s.tolist(), []
            size = batch_size or max(1, len(texts))
            for i in range(0, len(texts), size):
                out += work(texts[i : i + size])
            if len(out) != len(texts):
                raise ValueError("the encoder returned a different number of vectors than texts")
            yield pd.Series(out, dtype=object)

    return rows.withColumn("vector", checked(run(text), encoder.dimension))


def checked(vector: Column, dimension: int) -> Column:
    wrong = F.concat(F.lit(f"dimension mismatch: expected {dimension}, got "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(wrong).cast("array<double>"))


def by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, matrix and squared norms of the vectors of each length: plain arrays, which
    executors can read without this package."""
    size, out = np.array([len(v) for v in vectors], np.int64), {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        q = np.array([vectors[i] for i in at], np.float64).reshape(len(at), d)
        out[d] = at, q, folded(q, q)
    return out


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in order of the components: equal rows have equal ones."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def _cosines(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From products and squared norms; a zero vector scores 0."""
    size = np.sqrt(a) * np.sqrt(b)
    return np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)


def _first(t: pa.Table, k: int) -> pa.Table:
    """The k best rows (query, id, score) of each query, in order."""
    t = t.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = t["query"].to_numpy()
    return t.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def nearest_in(batch: pa.RecordBatch, asked: dict, floor: np.ndarray, k: int, probing: dict[int, np.ndarray] | None = None) -> pa.Table | None:
    """(query, id, score): the k best rows of a batch (id, vector[, list]) for each query.

    One matrix product picks the rows that can be among them; their scores are then added in
    order, so that equal vectors tie. floor holds for each query a score that k rows reach.
    At most SCORES products are held at once, however many queries there are.
    """
    column = batch.column(1)
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    lists = batch.column(2).to_numpy(zero_copy_only=False) if probing is not None else np.zeros(len(size), np.int64)
    found = []
    for d, (places, q, qn) in asked.items():
        rows = np.flatnonzero(size == d)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
        fine = np.isfinite(x).all(1)
        rows, x = rows[fine], x[fine]
        xn = folded(x, x)
        for one in np.unique(lists[rows]).tolist():
            at = np.flatnonzero(lists[rows] == one)
            mine = np.arange(len(places)) if probing is None else np.flatnonzero(np.isin(places, probing.get(one, [])))
            if not len(mine) or not len(at):
                continue
            step = max(1, SCORES // len(at))
            for some in (mine[s : s + step] for s in range(0, len(mine), step)):
                score = _cosines(q[some] @ x[at].T, qn[some][:, None], xn[at])
                need = floor[places[some]]
                if len(at) > k:
                    need = np.maximum(need, np.partition(score, len(at) - k, 1)[:, -k])
                i, j = np.nonzero(score >= need[:, None] - 1e-9)
                i, j = some[i], at[j]
                cuts = range(0, len(i), PAIRS)
                exact = [_cosines(folded(q[i[c : c + PAIRS]], x[j[c : c + PAIRS]]), qn[i[c : c + PAIRS]], xn[j[c : c + PAIRS]]) for c in cuts]
                t = pa.table({"query": places[i], "id": batch.column(0).take(pa.array(rows[j])), "score": np.concatenate([np.zeros(0), *exact])})
                found.append(_first(t, k) if len(i) > k * len(some) else t)  # many only where rows tie
    if not found:
        return None
    t = _first(pa.concat_tables(found), k)
    query = t["query"].to_numpy()
    last = t.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) == k - 1))
    at = last["query"].to_numpy()
    floor[at] = np.maximum(floor[at], last["score"].to_numpy())
    return t


def query_blocks(queries: DataFrame, bound: int = BLOCK) -> Iterator[tuple[list, list]]:
    """(ids, vectors) of queries (query_id, vector) in blocks of about `bound` components, one
    at a time; null vectors ask nothing."""
    with Kept(queries.sparkSession, "queries") as scratch:
        q = scratch.keep(queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")))
        count = max(1, -(-2 * q.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0] // bound))
        for b in range(count):
            rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == b).collect()
            if rows:
                yield [r.query_id for r in rows], [r.vector for r in rows]


def blocked(queries: DataFrame, rows: DataFrame, top_k: int, probed: Callable | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank), scores not clamped. rows: chunk_id, vector[, list].

    Queries are broadcast in blocks of BLOCK components; rows stay where they are, and each task
    keeps of each batch what can still be among the best. probed(ids, vectors), if given, names
    for each list the places of the queries that look into it.
    """
    kinds = queries.schema["query_id"].dataType, rows.schema["chunk_id"].dataType
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    arrow, parts = to_arrow_type(kinds[0]), []
    for ids, vectors in query_blocks(queries):
        probing = probed(vectors) if probed else None
        sent = queries.sparkSession.sparkContext.broadcast((pa.array(ids, arrow), by_length(vectors), probing))

        def run(batches, sent=sent):
            names, asked, probing = sent.value
            floor = np.full(len(names), -np.inf)
            for batch in batches:
                t = nearest_in(batch, asked, floor, top_k, probing)
                if t is not None:
                    t = t.set_column(0, "query_id", names.take(t["query"].combine_chunks())).rename_columns(["query_id", "chunk_id", "score"])
                    yield from t.to_batches()

        some = rows if probing is None else rows.where(F.col("list").isin(sorted(probing)))
        parts.append(some.mapInArrow(run, schema))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    return rank(reduce(DataFrame.union, parts), top_k, F.desc("score"), F.asc("chunk_id"))


def clamped(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))


def search(queries: DataFrame, rows: DataFrame, top_k: int = 5, where: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, score, rank) by exact cosine; queries has query_id, vector.

    A zero vector scores 0; ties go to the smaller id and are judged before scores are clamped
    to [-1, 1]. Vectors of another length than the query's, null ones and those with null or
    non-finite components take no part. See blocked() for the plan.
    """
    check(top_k)
    kept = rows if where is None else rows.where(where)
    return clamped(blocked(queries, kept.select(F.col(id_col).alias("chunk_id"), "vector"), top_k))


def keep_last(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return rows.withColumn("_at", last).where("_at = 1").drop("_at")

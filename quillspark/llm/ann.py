"""Approximate nearest neighbours by adaptive dimension scan.

Equal vectors are one class. Class vectors are extended by one component so that the
largest inner product is the smallest distance, dealt to the lists of a k-means quantiser
fitted on a bounded sample, and rotated at random. Within each probed list the rotated
components are scanned in column blocks: after a block, the partial distance of a
candidate estimates its whole distance, and a hypothesis test against the distance of the
current k-th neighbour abandons it early. What is left is scored exactly on the original
vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .util import cut, stored, table

K = 20
SAMPLE = 8192  # vectors that the quantiser is fitted on, at most
PROBED = 0.85  # share of the lists that a query probes, at every size
BLOCK = 4096  # candidates held by one task at a time
COLUMNS = 16
LEVEL = 2.1  # of the test: a candidate's estimate must exceed the limit by (1 + LEVEL / sqrt(seen)) ** 2
SEED = 7


def lists_for(n: int) -> int:
    return max(4, min(2048, round(2 * n ** (1 / 3))))


def fit(sample: np.ndarray, lists: int, steps: int = 10) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    rng = np.random.default_rng(SEED)
    lists = min(lists, len(sample))
    c = sample[rng.permutation(len(sample))[:lists]].astype(np.float64)
    for _ in range(steps):
        at = nearest(sample, c, 1)[:, 0]
        n = np.bincount(at, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    return np.argsort((c * c).sum(1)[None] - 2 * (x @ c.T), axis=1, kind="stable")[:, :k]


def extended(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates with the component that makes all norms equal."""
    return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]])


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(columns: list[np.ndarray], query: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that no test abandoned, for one rotated query.

    columns are blocks of components, candidates by rows. The first candidates are
    measured whole and give the first threshold.
    """
    n, d = len(columns[0]), len(query)
    first = min(n, max(2 * k, n // 8))
    whole = sum(((c[:first] - query[i * COLUMNS : i * COLUMNS + c.shape[1]]) ** 2).sum(1) for i, c in enumerate(columns))
    if first == n:
        return np.arange(n)
    limit = np.partition(whole, k - 1)[k - 1]
    alive, part, seen = np.arange(first, n), np.zeros(n - first), 0
    for i, c in enumerate(columns):
        step = (c[alive] if i else c[first:]) - query[seen : seen + c.shape[1]]
        part = part + (step * step).sum(1)
        seen += c.shape[1]
        level = (1 + LEVEL / math.sqrt(seen)) ** 2 if seen < d else 1.0
        keep = part * (d / seen) <= limit * level + 1e-9
        alive, part = alive[keep], part[keep]
    return np.concatenate([np.flatnonzero(whole <= limit), alive])


def _valid(rows: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


class Lists:
    """The quantisers of all lengths: list numbers, centres, and how vectors are dealt.

    lengths: (d, n, top) rows; samples: a matrix for each length that the sample holds. A
    length without a sample has one list, which is probed whole.
    """

    def __init__(self, lengths: list, samples: dict[int, np.ndarray], kind: type) -> None:
        self.kind, self.first, self.of, self.dims, lists = kind, {}, {}, [], 0
        for d, n, top in lengths:
            x = samples.get(d)
            c = fit(extended(x, top), lists_for(n)) if x is not None else np.zeros((1, d + 1))
            self.first[d], self.of[d] = lists, (c, top, math.ceil(PROBED * len(c)))
            self.dims += [d] * len(c)
            lists += len(c)

    def dealt(self, batch, query: bool):
        """(rows, lists) of a batch of vectors of any lengths."""
        sizes = batch.column(1).value_lengths().to_numpy()
        rows, lists = [], []
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            x = self.matrix(batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), d)
            centres, top, probes = self.of[d]
            found = nearest(np.hstack([x, np.zeros((len(x), 1))]) if query else extended(x, top), centres, probes if query else 1)
            rows.append(np.repeat(at, found.shape[1]))
            lists.append(found.ravel() + self.first[d])
        return np.concatenate(rows), np.concatenate(lists)

    def matrix(self, flat: np.ndarray, d: int) -> np.ndarray:
        return flat.astype(np.float64).reshape(-1, d)

    def packed(self, batch) -> pa.Array:
        return pa.array([np.array(v, self.kind).tobytes() for v in batch.column(1).to_pylist()], pa.binary())

    def unpacked(self, column, d: int) -> np.ndarray:
        return self.matrix(np.frombuffer(b"".join(column.to_pylist()), self.kind), d)


@stored
def search(rows: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    Queries are the rows whose id is divisible by `every`; all rows but the query's own
    are candidates; nearness is the inner product in double precision, ties go to the
    smaller id. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do null ids; ids that are no integers raise a TypeError; candidates of a query are the vectors of its length; other
    columns are ignored; an empty table has no result. With fewer candidates than k all
    that are found are returned. Rows that repeat an id are one candidate each.

    Scale: lists are scanned in blocks of about BLOCK candidates with the queries
    streamed past them, so no task holds a list. Copies are one class with its k + 1
    smallest ids, so a hot vector costs as much as any other. The driver gets one row for
    each length and at most SAMPLE vectors. The work grows with queries x probed lists.
    """
    spark, ids = rows.sparkSession, rows.schema[id_col].dataType
    if not isinstance(ids, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {ids.simpleString()}")
    valid = _valid(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")), "v").where("vec_id is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    lengths = [tuple(r) for r in valid.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy("d").collect()]
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    same = Window.partitionBy("v").orderBy("vec_id")
    firsts = valid.withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1)
    classes = firsts.groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # A class is named by its smallest id, for ties, and by its vector: an id may repeat.
    classes = cut(classes.withColumn("tie", F.xxhash64("v")), "vectors")
    asked = cut(valid.where(F.col("vec_id") % every == 0).join(classes.select("v", "cid", "tie"), "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q"), F.col("tie").alias("qt")), "queries")

    sample: dict[int, list] = {}
    for r in classes.orderBy("tie", "cid").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r.v), []).append(r.v)
    kind = np.float32 if "float" in classes.schema["v"].dataType.simpleString() else np.float64
    index = Lists(lengths, {d: np.array(x, np.float64) for d, x in sample.items()}, kind)
    tops, turns = {d: top for d, _, top in lengths}, {d: rotation(d + 1) for d in sample}

    def deal(query):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    at, lists = index.dealt(batch, query)
                    of = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(of), batch.column(2).take(of), index.packed(batch).take(of)], ["list", "id", "tie", "vec"])

        return run

    columns = "list int, id long, tie long, vec binary"
    data = cut(classes.select("cid", "v", "tie").mapInArrow(deal(False), columns), "lists")
    blocks = data.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))  # a row for each list: bounded
    data = data.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("tie"), F.col("blocks")).alias("block"), F.lit(0).alias("tag"), "id", "tie", "vec")
    asking = asked.select("q", "qt").distinct().join(classes.select(F.col("cid").alias("q"), F.col("tie").alias("qt"), "v"), ["q", "qt"])
    want = asking.select("q", "v", "qt").mapInArrow(deal(True), columns)
    want = want.join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("tag"), "id", "tie", "vec")

    def cells(batches):
        key, ids, ties, vecs, ready = None, [], [], [], None
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ends = np.flatnonzero((np.diff(names, axis=1) != 0).any(0)) + 1
            out: list = []
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True) if batch.num_rows else []:
                here, tag = (names[0, a], names[1, a]), names[2, a]
                if here != key:
                    key, ids, ties, vecs, ready = here, [], [], [], None
                part, dim = batch.slice(a, b - a), index.dims[here[0]]
                x = index.unpacked(part.column(5), dim)
                if tag == 0:
                    ids.append(part.column(3).to_numpy())
                    ties.append(part.column(4).to_numpy())
                    vecs.append(x)
                    continue
                if not ids:
                    continue
                turn = turns.get(dim)
                if ready is None:
                    exact = np.concatenate(vecs)
                    wide = extended(exact, tops[dim])
                    turned = wide if turn is None else wide @ turn
                    ready = np.concatenate(ids), np.concatenate(ties), exact, [np.ascontiguousarray(turned[:, i : i + COLUMNS]) for i in range(0, dim + 1, COLUMNS)]
                names_, ties_, exact, blocks_ = ready
                queries = np.hstack([x, np.zeros((len(x), 1))])
                for q, qt, plain, query in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), x, queries if turn is None else queries @ turn, strict=True):
                    left = scan(blocks_, query, k + 1)
                    score = exact[left] @ plain
                    best = np.lexsort((names_[left], -score))[: k + 1]
                    out.append((q, qt, names_[left][best], ties_[left][best], score[best]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind_) for c, kind_ in zip(zip(*out, strict=True), kinds, strict=True)], ["q", "qt", "cids", "ties", "scores"])

    dealt = data.unionByName(want).repartition("list", "block").sortWithinPartitions("list", "block", "tag", "id")
    found = dealt.mapInArrow(cells, "q long, qt long, cids array<long>, ties array<long>, scores array<double>")
    hits = F.transform(F.arrays_zip("cids", "ties", "scores"), lambda x: F.struct((-x["scores"]).alias("less"), x["cids"].alias("id"), x["ties"].alias("tie")))
    best = found.groupBy("q", "qt").agg(F.slice(F.array_sort(F.flatten(F.collect_list(hits))), 1, k + 1).alias("best"))
    wide = best.select("q", "qt", F.explode("best").alias("b")).select("q", "qt", F.col("b.id").alias("cid"), F.col("b.tie").alias("tie"), F.col("b.less").alias("less")).join(classes.select("cid", "tie", "ids"), ["cid", "tie"])
    members = F.transform("ids", lambda i: F.struct(F.col("less").alias("less"), i.alias("id")))
    ranked = wide.groupBy("q", "qt").agg(F.slice(F.array_sort(F.flatten(F.collect_list(members))), 1, k + 1).alias("best"))
    own = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    out = asked.join(ranked, ["q", "qt"]).select("query_id", F.posexplode(own).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20: query_id, rank, vec_id,
    score. Null, zero and unfit vectors take no part; see search()."""
    return search(table(spark, sf_dir, "embeddings"))

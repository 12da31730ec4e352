"""A table of vectors in a folder: keep-last upserts of buckets, and lists for search.

Rows lie in buckets of their key. An upsert merges the buckets that its rows touch into new
files and leaves the others where they are; a version is a small file that names the folder
of each bucket. Its creation is exclusive: of two writers one gets the number, and the other
merges again on top of it, so no row is lost. Readers see whole versions only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quillspark.sources.files import Files
from quillspark.sources.scratch import Kept, new_path

from .lexical import check
from .vectors import Encoder, blocked, checked, clamped, encode, keep_last, search

BUCKETS = 32
KEPT = 3  # versions that an upsert leaves for readers
ATTEMPTS = 20
BATCH = 32


class VectorTable:
    """Rows with a key and a vector, by model and dimension. Versions are numbered from 1."""

    def __init__(self, spark: SparkSession, path: str, model: str, dimension: int, buckets: int = BUCKETS) -> None:
        self.spark, self.files, self.dimension = spark, Files(spark, path), dimension
        if not self.files.fs.exists(self.files.path("about")):
            self.files.create("about", json.dumps({"model": model, "dimension": dimension, "buckets": buckets}))
        about = json.loads(self.files.read("about"))
        if (about["model"], about["dimension"]) != (model, dimension):
            raise ValueError(f"stored=({about['model']}, {about['dimension']}), requested=({model}, {dimension})")
        self.buckets = about["buckets"]

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names("versions") if n[1:].isdigit())

    def _version(self, number: int) -> dict:
        return json.loads(self.files.read(f"versions/v{number}"))

    def _rows(self, version: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.files.root}/data/{version['folders'][b]}/bucket={b}" for b in buckets]
        schema = StructType.fromJson(version["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, the last if none is named; None where nothing was written."""
        number = number or max(self.versions(), default=0)
        if not number:
            return None
        version = self._version(number)
        return self._rows(version, sorted(version["folders"]))

    def upsert(self, rows: DataFrame, key: str = "chunk_id", order: str | None = None) -> int:
        """rows has a vector column; of equal keys the new row stays, among new ones that of
        the highest `order` (any, if none is given). Returns the number of rows given.

        The rows are evaluated once. Only buckets that they touch are read and written; with a
        lost race only those that the other writer changed are merged again.
        """
        seen, bucket = Observation(), F.pmod(F.xxhash64(key), F.lit(self.buckets))
        with Kept(self.spark, "upsert") as scratch:
            given = rows.withColumn("vector", checked(F.col("vector"), self.dimension)).observe(seen, F.count(F.lit(1)).alias("n"))
            new = keep_last(given, key, order) if order else given.dropDuplicates([key])
            new = scratch.keep(new.withColumn("bucket", bucket))
            touched = sorted(str(r.bucket) for r in new.select("bucket").distinct().collect())
            todo, folders, base = touched, {}, {"folders": {}}
            for _ in range(ATTEMPTS):
                number = max(self.versions(), default=0)
                last = self._version(number) if number else {"folders": {}, "schema": new.drop("bucket").schema.jsonValue()}
                # What another writer has changed since is merged again.
                todo = [b for b in touched if b not in folders or last["folders"].get(b) != base["folders"].get(b)]
                if todo:
                    folders |= self._merged(new.where(F.col("bucket").isin([int(b) for b in todo])), last, todo, key)
                base = last
                text = json.dumps({"folders": last["folders"] | folders, "schema": last["schema"]})
                if not touched or self.files.create(f"versions/v{number + 1}", text):
                    self._forget()
                    return seen.get["n"]
        raise RuntimeError("the table was changed by others each time")

    def _merged(self, new: DataFrame, last: dict, todo: list[str], key: str) -> dict[str, str]:
        held = [b for b in todo if b in last["folders"]]
        old = self._rows(last, held)
        rest = old.join(new.select(key), key, "left_anti").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)))
        folder = uuid.uuid4().hex
        # A bucket is one file unless it is large: rebalanced, not gathered.
        both = new.unionByName(rest).hint("rebalance", "bucket")
        both.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.files.root}/data/{folder}")
        return dict.fromkeys(todo, folder)

    def _forget(self) -> None:
        """Delete versions before the last KEPT, and folders that only they name. Folders of
        unfinished upserts are named by none yet, so only those of old versions go."""
        old = self.versions()[:-KEPT]
        if not old:
            return
        used = {f for v in self.versions()[-KEPT:] for f in self._version(v)["folders"].values()}
        for f in {f for v in old for f in self._version(v)["folders"].values()} - used:
            self.files.delete(f"data/{f}")
        for v in old:
            self.files.delete(f"versions/v{v}")

    def upsert_texts(self, rows: DataFrame, text: Column, encoder: Encoder, key: str = "chunk_id", order: str | None = None, batch_size: int = BATCH) -> int:
        """Encode texts in batches of batch_size and upsert them."""
        return self.upsert(encode(rows, text, encoder, batch_size=batch_size), key, order)

    def search(self, queries: DataFrame, top_k: int = 5, where: Column | None = None) -> DataFrame:
        """Exact hits in the last version."""
        rows = self.read()
        return search(queries, rows, top_k, where) if rows is not None else self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")

    def index(self, path: str | None = None, key: str = "chunk_id") -> ListIndex:
        """Lists over the last version, for approximate search."""
        return ListIndex.build(self.read(), path, key)


SAMPLE = 8192  # vectors that the centres are fitted on, at most
PROBED = 0.7  # share of the lists that a query looks into


def centres_of(x: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors."""
    rng = np.random.default_rng(1)
    c = x[rng.permutation(len(x))[: min(n, len(x))]]
    for _ in range(steps):
        total = np.zeros_like(c)
        np.add.at(total, (x @ c.T).argmax(1), x)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], c)
    return c


def units(x: np.ndarray) -> np.ndarray:
    x = np.where(np.isfinite(x), x, 0.0)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


class ListIndex:
    """Vectors dealt to lists by their nearest centre: rows (partitioned by list), centres.

    A search looks into the lists whose centres are nearest to each query; the others are not
    read, since the list is a partition of the files. Filters go to the scan. Scores are
    exact cosines, clamped to [-1, 1]; ties go to the smaller id among the rows that were read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        self.centres = np.array([r.centre for r in held], np.float64).reshape(len(held), -1)

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, id_col: str = "chunk_id", lists: int | None = None, sample: int = SAMPLE) -> ListIndex:
        """rows has the id, vector and what filters need. The centres are fitted on at most
        `sample` vectors, which the driver holds; every row is put into a list. All vectors
        have one length; null ones are left out. A list of any size is split among tasks."""
        spark, path = rows.sparkSession, path or new_path(rows.sparkSession, "lists")
        kept = rows.where("vector is not null").withColumnRenamed(id_col, "chunk_id")
        some = kept.select(F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("vector")).limit(sample).collect()
        x = units(np.array([r.vector for r in some], np.float64).reshape(len(some), -1))
        n = kept.count()
        c = centres_of(x, lists or max(4, min(4096, round(n**0.5) // 2))) if len(x) else x
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, centre array<double>").write.parquet(f"{path}/centres")
        sent = spark.sparkContext.broadcast(c)

        def dealt(batches):
            for batch in batches:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((units(v) @ sent.value.T).argmax(1).astype(np.int32))], [*batch.schema.names, "list"])

        ordered = kept.select("vector", *(c for c in kept.columns if c != "vector"))
        out = ordered.mapInArrow(dealt, StructType.fromJson(ordered.schema.jsonValue()).add("list", IntegerType()))
        out.repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list").write.option("compression", "zstd").partitionBy("list").parquet(f"{path}/rows")
        return cls(spark, path)

    def probed(self, share: float) -> Callable[[list], dict[int, np.ndarray]]:
        def lists(vectors: list) -> dict[int, np.ndarray]:
            d = self.centres.shape[1]
            fit = np.array([i for i, v in enumerate(vectors) if len(v) == d], np.int64)
            q = units(np.array([vectors[i] for i in fit], np.float64).reshape(len(fit), d))
            near = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : max(1, round(share * len(self.centres)))]
            return {int(one): fit[(near == one).any(1)] for one in np.unique(near)}

        return lists

    def search(self, queries: DataFrame, top_k: int = 5, where: Column | None = None, share: float = PROBED) -> DataFrame:
        """(query_id, chunk_id, score, rank): fewer than top_k only where fewer are found. share
        is that of the lists that a query looks into; the fewer rows a filter leaves, the more
        lists it takes for the same recall, and 1 is exact."""
        check(top_k)
        rows = self.rows if where is None else self.rows.where(where)
        return clamped(blocked(queries, rows.select("chunk_id", "vector", "list"), top_k, self.probed(share)))

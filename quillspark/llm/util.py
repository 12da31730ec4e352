"""Tables, scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import suppress
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: below spark.checkpoint.dir.

    Where the session names none, a temporary folder is set once, but only where driver
    and executors are one process; a cluster must name a folder that all of them see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


#: Spark then deletes the shuffle files of a query when it ends, not when the driver
#: happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _before, _lock = 0, "false", threading.Lock()


def _cleanup(spark: SparkSession, by: int) -> None:
    """The setting holds while any write runs; the last one puts the old value back."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = spark.conf.get(CLEANUP, "false")
        _writing += by
        spark.conf.set(CLEANUP, "true" if _writing else _before)


def write_out(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage of df by a Parquet table in the shared folder.

    Once the table is written nothing needs the shuffles of the write any more; in
    loops of many steps they would pile up.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _cleanup(spark, 1)
    try:
        df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        with suppress(Exception):  # the session itself may be gone
            forget(spark, path)
        raise
    finally:
        _cleanup(spark, -1)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out, path


#: The tables that the running operator has written.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def cut(df: DataFrame, name: str) -> DataFrame:
    out, path = write_out(df, name)
    held = _held.get()
    if held is not None:
        held.append(path)
    return out


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() before their operator ends: nothing reads them any more."""
    for t in tables:
        forget(t.sparkSession, t.scratch_path)


def stored(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Store the operator's result and delete every other table that it has written, also
    when it raises."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        token = _held.set([])
        try:
            result, path = write_out(operator(docs, *args, **kwargs), operator.__name__)
        finally:
            with suppress(Exception):  # the session itself may be gone
                for p in _held.get():
                    forget(docs.sparkSession, p)
            _held.reset(token)
        if (outer := _held.get()) is not None:
            outer.append(path)
        return result

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def counted(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, if docs has it, is that of the new text."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every linked id: (id, component_id).

    links has columns a and b (long). Alternates the large-star and small-star
    steps: each is one shuffle by node, the rows never outnumber the links, and
    the number of steps is logarithmic in the longest path. Every step is written
    to the shared folder, so that lost executors cost one step at most. A hub is
    dealt with by map-side minima and a join that can be split.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, path = write_out(edges, name)
    total, held = None, _held.get()
    for _ in range(rounds):
        # Large star: each neighbour above the node is linked with the node's smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each neighbour below the node is linked with the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new, new_path = write_out(small, name)
        forget(spark, path)
        edges, path = new, new_path
        # A star forest is final: every node has one link, and no centre has one upwards.
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        if total == (state.n, state.h):
            break
        total = (state.n, state.h)
    else:
        raise RuntimeError("connected components did not settle")
    if held is not None:
        held.append(path)
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)

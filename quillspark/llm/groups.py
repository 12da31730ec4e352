"""Connected groups from shared buckets, without expanding a bucket into its pairs.

Used by the operators on near duplicates. Members of a bucket are compared with one
other member first and then with drawn ones, as long as the bucket holds several
components and a draw still links many; what is left - members of different components
that still share a bucket - is compared in blocks of bounded size. Nothing is capped: at
the end any two members of one bucket have been compared or are connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, cut, drop

DRAWS = 2
FEW = 16  # a draw that links fewer than one of so many members is the last one
BLOCK = 512
PAIRS = 1 << 13


def shared_buckets(buckets: DataFrame, name: str) -> DataFrame:
    """(key, id, hub) of the buckets with two or more ids; buckets has key, id."""
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "hub")
    return cut(buckets.join(hubs, "key").select("key", "id", "hub"), name)


def mixed(members: DataFrame) -> DataFrame:
    """Buckets that hold several components, with their sizes."""
    return members.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("size")).where("c1 <> c2")


def settle(shared: DataFrame, check: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], pairs: DataFrame | None = None, clustered: bool = True) -> DataFrame:
    """(id, component_id) of all linked ids.

    check keeps the pairs (a, b) that are links; rest finds links between different
    components among members (key, id, c, keys) of mixed buckets: key names a cluster of
    buckets, keys are the member's own ones. It finds at least one link for any two
    components that one cluster holds a link of between members that share a bucket.
    pairs (a, b) with a < b are checked besides. Where buckets chain up into few clusters,
    whose blocks would grow with their square, clustered=False has rest take each bucket for
    itself.
    """
    tried = shared.where("id <> hub").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    if pairs is not None:
        tried = tried.union(pairs).distinct()
    tried = cut(tried, "tried")
    links = cut(check(tried), "links")
    label = components(links)
    for draw in range(1, DRAWS + 2):
        members = shared.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
        members = cut(members.join(mixed(members).select("key", "size"), "key"), "members")
        if members.isEmpty():
            drop(members)
            break
        late: list[DataFrame] = []
        if draw <= DRAWS:
            drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(draw)), "id", "c")).alias("d")).select("key", F.col("d.id").alias("to"), F.col("d.c").alias("to_c"))
            pairs = members.join(drawn, "key").where("c <> to_c").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
            pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
            tried = tried.union(pairs)
            found = cut(check(pairs), "links")
            if found.count() * FEW >= members.count():
                drop(members)
                label = joined(label, found)
                continue
            late.append(found)
        more = members.where("size > 2")  # the pair of a bucket of two has been tried
        if not more.isEmpty():
            met = more.groupBy("id", "c").agg(F.collect_set("key").alias("keys"))
            if clustered:
                # Buckets that share members are one cluster: a pair meets once, not in each of them.
                least = more.groupBy("key").agg(F.min("id").alias("b"))
                cluster = components(more.select("key", F.col("id").alias("a")).join(least, "key").select("a", "b"))
                asked = met.join(cluster, "id").select(F.col("component_id").alias("key"), "id", "c", "keys")
            else:
                asked = met.select(F.explode("keys").alias("key"), "id", "c", "keys")
            late.append(cut(rest(asked), "links"))
        drop(members)
        label = joined(label, reduce(DataFrame.union, late)) if late else label
        break
    return label


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (id, component_id) with further links (a, b): only the components that they
    connect are gone through again, not their members."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    alone = ends.join(label, "id", "left_anti").select("id", F.col("id").alias("component_id"))
    label = cut(label.union(alone), "label")
    of = lambda x: label.select(F.col("id").alias(x), F.col("component_id").alias(f"c_{x}"))
    new = components(links.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    new = new.select(F.col("id").alias("c"), F.col("component_id").alias("new"))
    return label.join(new, F.col("component_id") == F.col("c"), "left").select("id", F.coalesce("new", "component_id").alias("component_id"))


def block_links(members: DataFrame, facts: DataFrame, columns: list[str], compare: Callable[..., Iterator[tuple[int, int]]], agreed: Callable[[list, list], Iterable[bool]] | None = None) -> DataFrame:
    """Links (a, b) between different components of one cluster.

    members: key, id, c, keys; facts: id and the columns. A cluster of more than BLOCK rows
    is dealt as pairs of blocks, so that no task gathers a whole one. compare(c, keys,
    *columns) yields places (i, j) of linked rows with different c. Where agreed is given,
    these pairs are candidates; it tells of several cells' pairs of rows at once which are links.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = members.join(sizes, "key").join(facts.select("id", *columns), "id").withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")))
    y = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = rows.withColumn("y", y).select("key", F.least("x", "y").alias("x1"), F.greatest("x", "y").alias("x2"), "id", "c", "keys", *columns)

    def links(found):
        if agreed and found:
            found = list(compress(found, agreed(*zip(*found, strict=True))))
        return pa.RecordBatch.from_arrays([pa.array([p[k][3] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        held: list = []
        found: list = []

        def cell():
            found.extend((held[i], held[j]) for i, j in compare(*zip(*(r[4:] for r in held), strict=True)))

        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    cell()
                    held = []
                    if len(found) >= PAIRS:
                        yield links(found)
                        found = []
                held.append(row)
        if held:
            cell()
        yield links(found)

    return cells.repartition("key", "x1", "x2").sortWithinPartitions("key", "x1", "x2", "id").mapInArrow(run, "a long, b long").distinct()

"""Sharding by jump consistent hashing (DataFrame only).

The law is `key`: the id and the number of shards alone decide. The jump sequence of a
key draws 31-bit numbers, the first 31 bits of md5("step:key"); the last jump below the
number of shards is the shard, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import table


def drawn(name: Column, key: Column) -> Column:
    """31 bits of md5("name:key")."""
    return F.shiftright(F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), key)), 1, 8), 16, 10).cast("long"), 1)


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """Shard of key (a string) among `shards`, and among one more.

    Each jump goes up by one at least, so `shards` + 1 steps always reach the end; the
    draws after the end are not made.
    """

    def step(s, i):
        go = s["j"] <= shards
        to = F.when(go, F.floor((s["j"] + 1) * F.lit(float(1 << 31)) / (drawn(i.cast("string"), key) + 1)))
        return F.struct(F.when(go & (s["j"] < shards), s["j"]).otherwise(s["a"]).alias("a"), F.when(go, s["j"]).otherwise(s["b"]).alias("b"), F.coalesce(F.least(to, F.lit(1 << 40)), s["j"]).alias("j"))

    zero = F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), zero, step)
    return ends["a"].cast("int"), ends["b"].cast("int")


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", parts: int = 64) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty; a null id has the key of the empty string; equal ids share a
    shard, ids may be of any type. Slots count from 0 without gaps in each shard, by part,
    id, size and checksum; rows equal in all of these may change places. Other columns are
    ignored.

    Scale: slots are numbered within shards x parts groups by one shuffle of narrow rows;
    the groups' first slots come from a count table of shards x parts rows, which is why
    it may be broadcast.
    """
    a, b = jump(F.col("k"), shards)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    rows = rows.select("doc_id", (F.coalesce(F.octet_length("t"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("text_crc32"), F.struct(a.alias("s"), b.alias("g")).alias("to"), F.pmod(drawn(F.lit("part"), F.col("k")), F.lit(parts)).cast("int").alias("part"))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("to.s").alias("shard"), F.col("to.g").alias("grown_shard"), "part")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(place))
    return numbered.join(F.broadcast(first), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, a row each; a null text has 16 bytes; see assign()."""
    return assign(table(spark, sf_dir, "documents"))


def _crc_step() -> str:
    """crc32 of one more byte b as an expression; each bit adds what eight halvings leave of it."""
    out = "xor(c, b) // 256"
    for bit in range(8):
        v = 1 << bit
        for _ in range(8):
            v = v >> 1 ^ 0xEDB88320 * (v & 1)  # fixed value: the polynomial of crc32
        out = f"xor({out}, (xor(c, b) // {1 << bit} % 2) * {v})"
    return out


ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, encode(coalesce(text, '')) AS t FROM documents),
j(r, k, i, a, b, j) AS (SELECT r, k, 1, -1::BIGINT, -1::BIGINT, 0::BIGINT FROM d UNION ALL
  SELECT r, k, i + 1, CASE WHEN j < 40 THEN j ELSE a END, j, floor((j + 1) * 2147483648::DOUBLE / (('0x' || md5(i || ':' || k)[1:8])::BIGINT // 2 + 1))::BIGINT FROM j WHERE j <= 40),
e AS (SELECT r, a AS shard, b AS grown_shard FROM j WHERE j > 40),
f AS (SELECT d.*, shard, grown_shard, octet_length(t) + 16 AS size, ('0x' || md5('part:' || k)[1:8])::BIGINT // 2 % 64 AS part,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(t) + 1), lambda i: ('0x' || hex(t[i:i]))::BIGINT)), lambda c, b: {_crc_step()}), 4294967295) AS text_crc32 FROM d JOIN e USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM f
"""

"""Repeated byte strings across documents, by longest-previous-factor arrays.

A position's previous factor is the longest string that starts there and also starts
earlier. In suffix order the earlier match is at the previous or the next smaller
position, so these two decide whether `size` bytes occurred before; the previous and next
larger positions tell the same about later ones. Lengths beyond `size` decide nothing and
are not computed. One suffix array over the corpus is
unbounded, so the order is built in parts that no equal factors cross:

1. Winnowing chooses anchors (64-byte grams) so that every `size`-byte factor holds one at
   a place that its bytes alone decide. Only anchors that occur twice matter.
2. Around such an anchor lie all factors that hold it. Anchors whose whole surroundings
   are equal are one class; a class of two or more is repeated throughout.
3. Classes of one anchor meet in one part (large ones in pairs of blocks). There the
   suffixes are put in order column by column from the right, the columns counted from the
   anchor, and each column tells which positions have smaller or larger ones as neighbours.
4. An anchor with more than CROWD classes is counted by the hash of each of its factors
   instead: the pairs of its blocks would grow with the square of the classes.
A document that repeats a gram gets a suffix array of its own, and exact copies of a
document are one class that is repeated as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import Hasher, mix
from .util import cut, drop, stored, table

SIZE, GRAM = 400, 64
SEGMENT = 1 << 20
BLOCK = 1024  # classes of one anchor in one block
ROWS = 1024  # classes compared at a time
CROWD = 8 * BLOCK


class Factors(Hasher):
    def hashes(self, raw: np.ndarray, size: int) -> np.ndarray:
        """A hash for every run of `size` bytes."""
        if len(raw) < size:
            return np.zeros(0, np.uint64)
        self.powers(len(raw))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.bytes[raw] * self.up[: len(raw)])))
        return mix((total[size:] - total[:-size]) * self.down[: len(raw) - size + 1])


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every `width` neighbours, from minima of blocks on both sides."""
    take, pad = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, np.uint64(0))
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % width, pad, np.uint64))).reshape(-1, width)
    ahead = take.accumulate(blocks, axis=1).ravel()
    behind = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[: n - width + 1], ahead[width - 1 : n])


def matched(order: np.ndarray, group: np.ndarray, w: np.ndarray, first: bool) -> np.ndarray:
    """Whether the previous-factor length at each place of `order` (positions in suffix order,
    by rows) reaches the size of the factors with hashes w - or, unless only later copies
    count, the length of a match with a later position does.

    In suffix order the positions whose factors agree form a run. The previous or the next
    smaller position of one that is not the least of its run lies in the run, so there its
    match is long enough; that of the least one lies outside. The same holds for larger
    positions and the last one. Runs do not cross groups.
    """
    n = order.shape[1]
    new = np.ones(order.shape, bool)
    new[:, 1:] = (w[:, 1:] != w[:, :-1]) | (group[:, 1:] != group[:, :-1])
    starts = np.flatnonzero(new.ravel())
    size = np.diff(np.append(starts, order.size))
    if not first:
        return np.repeat(size > 1, size).reshape(-1, n)
    return order > np.repeat(np.minimum.reduceat(order.ravel(), starts), size).reshape(-1, n)


def suffix_order(raw: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their suffixes, in `depth` bytes or more, by doubling."""
    n = len(raw)
    wide = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    name, seen = np.zeros(n, np.uint64), 7  # zeros behind the end: told apart by the length
    for i in range(7):
        name = name << np.uint64(8) | wide[i : i + n]
    name = name << np.uint64(3) | np.minimum(n - np.arange(n), 7).astype(np.uint64)
    while True:
        order = np.argsort(name)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(name[order], prepend=~name[order[:1]]) != 0)
        if seen >= depth:
            return np.argsort(rank * n + np.arange(n))
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - seen)] = rank[seen:]
        name, seen = (rank * (n + 1) + behind).astype(np.uint64), 2 * seen


def anchors(factors: Factors, raw: np.ndarray, size: int, gram: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, repeated factor starts) of a document of `size` bytes or more."""
    width = size - gram + 1
    hs, ps = [], []
    for a in range(0, len(raw) - size + 1, SEGMENT):
        g = factors.hashes(raw[a : a + SEGMENT + size - 1], gram)
        m = sliding(g, width, True)
        held = sliding(np.concatenate((np.zeros(width - 1, np.uint64), m, np.zeros(width - 1, np.uint64))), width, False)
        at = np.flatnonzero(held == g)
        hs.append(g[at])
        ps.append(at + a)
    h, p = np.concatenate(hs), np.concatenate(ps)
    p, once = np.unique(p, return_index=True)
    h = h[once]
    if len(np.unique(h)) == len(h):
        return h, p, p[:0]
    # The document repeats a gram: look at its own factors, and keep the first of equal ones.
    w = factors.hashes(raw, size)
    order = suffix_order(raw, size)
    order = order[order < len(w)][None]
    group = np.zeros(order.shape, np.int8)
    again, twice = np.zeros(len(w), bool), np.zeros(len(w), bool)
    again[order[0]] = matched(order, group, w[order], True)[0]
    twice[order[0]] = again[order[0]] if first else matched(order, group, w[order], False)[0]
    firsts = np.flatnonzero(~again)
    g = factors.hashes(raw, gram)
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.unique(np.concatenate([i + width - 1 - view[i, ::-1].argmin(1) for i in np.array_split(firsts, max(1, len(firsts) // 2048))]))
    return g[at], at, np.flatnonzero(twice)


def runs(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by factors at the sorted starts."""
    if not len(starts):
        return []
    cut_ = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.concatenate(([0], cut_ + 1))].tolist(), (starts[np.concatenate((cut_, [len(starts) - 1]))] + size).tolist(), strict=True))


SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _spans(lists):
    return pa.array([[{"s": s, "e": e} for s, e in x] for x in lists], SPANS)


PLACE = "h bigint, p int"


@stored
def removed(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", first: bool = False, keep_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that a repeated factor of `size` bytes covers is removed, the first
    occurrence included; with first=True only what an earlier factor equals goes, in order
    of (doc_id, place), a null id before the others. Null text counts as empty; texts under
    `size` bytes stay whole. Documents are told apart by their text, so ids may be null, of
    any type that can be sorted, or repeat with other texts; rows that repeat id and text
    are copies of each other, and with first=True all of them are the first copy. Other
    columns are ignored. keep_text adds the rest as binary.

    Scale: anchors are about 1/170 of the bytes; texts move twice, only those that share an
    anchor are stored; a part of the order is bounded by two blocks of one anchor, and a
    crowded anchor costs rows in proportion to its classes.
    """
    left = size - gram  # bytes before an anchor that a factor may hold
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("text"), F.unhex(F.md5(body)).alias("key"))

    def read(batches):
        factors = Factors()
        for batch in batches:
            out = []
            for t in batch.column(1):
                data = t.as_py().encode("utf-8", "surrogatepass")
                raw = np.frombuffer(data, np.uint8)
                h, p, twice = anchors(factors, raw, size, gram, first) if len(raw) >= size else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
                out.append((len(raw), hashlib.sha256(data).hexdigest(), h.view(np.int64), p.astype(np.int32), runs(twice, size)))
            n, sha, hs, ps, own = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(hs, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int32())), _spans(own)], ["doc_id", "key", "n_bytes", "sha", "hs", "ps", "own"])

    seen = cut(rows.mapInArrow(read, f"doc_id {kind}, key binary, n_bytes long, sha string, hs array<long>, ps array<int>, own array<struct<s:long,e:long>>"), "anchors")
    classes = cut(seen.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    # One row of each class stands for it; its id is part of the join, so copies don't meet.
    one = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    reps = seen.where(F.col("n_bytes") >= size).join(classes.select(F.col("key").alias("k"), "rep"), one, "left_semi").dropDuplicates(["key"])
    at = reps.select("key", "doc_id", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select("key", "doc_id", F.col("a.hs").alias("h"), F.col("a.ps").alias("p"))
    often = at.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = at.join(often, "h").groupBy("key", F.col("doc_id").alias("rep")).agg(F.collect_list(F.struct("h", "p")).alias("at"))
    own = reps.where(F.size("own") > 0).select("key", F.col("doc_id").alias("rep2"), "own")
    some = shared.join(own, "key", "full").select(F.col("key").alias("k"), F.coalesce("rep", "rep2").alias("rep"), "at", "own")
    held = rows.join(some, one).dropDuplicates(["key"])
    texts = cut(held.select("key", "doc_id", "text", F.coalesce("at", F.array().cast("array<struct<h:bigint,p:int>>")).alias("at"), "own"), "texts")

    def surroundings(batches):
        for batch in batches:
            place, cols = [], [[], [], [], []]
            for i, (t, places) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                for x in places:
                    a, b = max(0, x["p"] - left), min(len(raw), x["p"] + size)
                    place.append(i)
                    around = hashlib.blake2b(raw[a:b], digest_size=16, salt=(x["p"] - a).to_bytes(4, "little")).digest()
                    for c, v in zip(cols, (x["h"], x["p"], around, b - a), strict=True):
                        c.append(v)
            of = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True))], ["key", "doc_id", "h", "p", "around", "n"])

    around = cut(texts.where(F.size("at") > 0).select("key", "doc_id", "text", "at").mapInArrow(surroundings, f"key binary, doc_id {kind}, {PLACE}, around binary, n int").where(F.col("n") >= size), "around")
    kinds = cut(around.groupBy("h", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "p")).alias("m")), "kinds")
    whole = around.drop("n").join(kinds.where("n > 1").select("h", "around", F.col("m.key").alias("k"), F.col("m.p").alias("p1")), ["h", "around"])
    if first:
        whole = whole.where("not (key = k and p = p1)")
    whole = whole.select("key", F.greatest(F.col("p") - left, F.lit(0)).cast("long").alias("s"), (F.col("p") + size).cast("long").alias("e"))

    # Where an anchor has several kinds of surroundings, one of each kind is compared.
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1" if first else "kinds > 1 and least = 1")
    blocks = F.when(F.col("kinds") > crowd, 0).otherwise(F.ceil(F.col("kinds") / BLOCK)).cast("long")
    asked = kinds.join(several.select("h", blocks.alias("blocks")), "h").select("h", "n", "blocks", F.col("m.key").alias("k"), F.col("m.p").alias("p"))
    asked = asked.groupBy("k").agg(F.collect_list(F.struct("h", "p", "n", "blocks")).alias("ask"))
    asked = cut(texts.join(asked, F.col("key") == F.col("k")).select("key", "doc_id", "text", "ask"), "asked")
    mine = lambda crowded: asked.withColumn("ask", F.filter("ask", lambda x: (x["blocks"] == 0) == F.lit(crowded))).where(F.size("ask") > 0)

    def pieces(batches):
        for batch in batches:
            place, cols = [], [[], [], [], [], [], []]
            for i, (t, ask) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                for x in ask:
                    a = max(0, x["p"] - left)
                    place.append(i)
                    for c, v in zip(cols, (x["h"], x["p"], x["n"], x["blocks"], x["p"] - a, raw[a : x["p"] + size]), strict=True):
                        c.append(v)
            of = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], ["key", "doc_id", "h", "p", "n", "blocks", "before", "bytes"])

    found = mine(False).mapInArrow(pieces, f"key binary, doc_id {kind}, {PLACE}, n long, blocks long, before int, bytes binary")
    found = found.withColumn("x", F.pmod(F.xxhash64("key", "p"), F.col("blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = found.select("h", F.least("x", "y").alias("x1"), F.greatest("x", "y").alias("x2"), "doc_id", "key", "p", "n", "before", "bytes").repartition("h", "x1", "x2").sortWithinPartitions("h", "x1", "x2", "doc_id", "key", "p").drop("doc_id")

    def ordered(batches):
        factors, wide = Factors(), left + size
        factors.powers(wide)

        def compare(held):
            """The rows are in order of position, so their places stand for them."""
            n = len(held)
            text_ = np.zeros((n, wide), np.uint8)
            begin, end = np.empty(n, int), np.empty(n, int)
            for i, r in enumerate(held):
                begin[i] = left - r[6]
                end[i] = begin[i] + len(r[7]) - size  # of the factors' starts
                text_[i, begin[i] : begin[i] + len(r[7])] = np.frombuffer(r[7], np.uint8)
            total = np.zeros((n, wide + 1), np.uint64)
            np.cumsum(factors.bytes[text_] * factors.up[:wide], axis=1, out=total[:, 1:])
            w = np.ascontiguousarray((mix((total[:, size:] - total[:, :-size]) * factors.down[: left + 1])).T)
            cell = np.cumsum([0] + [a[:3] != b[:3] for a, b in zip(held, held[1:], strict=False)]) + 1
            place = np.arange(left + 1)[:, None]
            group = np.where((place >= begin) & (place <= end), cell, 0)  # 0: the factor leaves the row
            order = np.empty((left + 1, n), np.int64)
            columns, rank = np.ascontiguousarray(text_.T).astype(np.int64), np.zeros(n, np.int64)
            for at in range(wide - 1, -1, -1):  # the suffixes of one column, from those of the next
                name = columns[at] * (n + 1) + rank
                by = np.argsort(name, kind="stable")
                rank[by] = np.cumsum(np.diff(name[by], prepend=-1) != 0)
                if at <= left:
                    order[at] = np.argsort(group[at] * (n + 1) + rank, kind="stable")
            by_rank = lambda x: np.take_along_axis(x, order, 1)
            inside = by_rank(group)
            hit = matched(order, inside, by_rank(w), first) & (inside > 0)
            back = np.empty_like(hit)
            np.put_along_axis(back, order, hit, 1)
            out = [(r[3], s, e) for i, r in enumerate(held) if first or r[5] == 1 for s, e in runs(np.flatnonzero(back[:, i]) + (r[4] - left), size)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2))], ["key", "s", "e"])

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= ROWS and held[-1][:3] != row[:3]:
                    yield compare(held)
                    held = []
                held.append(row)
        if held:
            yield compare(held)

    def crowded(batches):
        """A name for each factor whose own anchor is the crowded one."""
        factors = Factors()
        for batch in batches:
            for i, (t, ask) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                for x in ask:
                    a = max(0, x["p"] - left)
                    part = raw[a : x["p"] + size]
                    h = np.int64(x["h"]).view(np.uint64)
                    starts = np.flatnonzero(sliding(factors.hashes(part, gram), left + 1, True) == h)
                    name = mix(factors.hashes(part, size)[starts] ^ mix(h + x["p"] - a - starts.astype(np.uint64)))
                    same = pa.array(np.full(len(starts), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(name.view(np.int64)), pa.array(starts + a)], ["key", "doc_id", "name", "s"])

    names = mine(True).mapInArrow(crowded, f"key binary, doc_id {kind}, name long, s long")
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "s")).alias("m")).where("n > 1").select("name", F.col("m.key").alias("k"), F.col("m.s").alias("s1"))
    crowd_spans = names.join(counts, "name")
    if first:
        crowd_spans = crowd_spans.where("not (key = k and s = s1)")
    crowd_spans = crowd_spans.select("key", "s", (F.col("s") + size).alias("e"))

    partial = cells.mapInArrow(ordered, "key binary, s long, e long")
    inner = texts.where("own is not null").select("key", F.explode("own").alias("o")).select("key", F.col("o.s").alias("s"), F.col("o.e").alias("e"))
    spans = whole.unionByName(partial).unionByName(crowd_spans).unionByName(inner).groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    spans = cut(spans, "spans")
    drop(around, kinds, asked)

    def apply(batches):
        for batch in batches:
            out = []
            for t, spans_ in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, rest, at_, gone, n = t.as_py().encode("utf-8", "surrogatepass"), [], 0, 0, 0
                merged: list[list[int]] = []
                for x in spans_:
                    s, e = x["s"], min(x["e"], len(raw))
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    rest.append(raw[at_:s])
                    at_, gone, n = e, gone + e - s, n + 1
                rest = b"".join([*rest, raw[at_:]])
                out.append((gone, n, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            a, b, c, d = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary())], ["k", "gone", "n", "kept", "rest"])

    done = texts.select("key", "text").join(spans, F.col("key") == F.col("k")).select("key", "text", "spans").mapInArrow(apply, "k binary, gone long, n long, kept string, rest binary")
    told = seen.select("doc_id", "key", "n_bytes", "sha").join(classes, "key").join(done, F.col("key") == F.col("k"), "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= size)
    if first:
        copy = copy & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    zero = F.lit(0).cast("long")
    out = told.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", zero)).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n", zero)).alias("n_spans"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"), F.when(copy, F.lit(b"")).otherwise(F.col("rest")).alias("rest"))
    return out if keep_text else out.drop("rest")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text has no
    bytes; see removed()."""
    return removed(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, unnest(range(0, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400),
f AS (SELECT r, i, md5(b[i + 1:i + 400]) AS h FROM p JOIN d USING (r)),
t AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM f WHERE h IN (SELECT h FROM f GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM t GROUP BY r, run),
n AS (SELECT r, s, e, sum(new) OVER (PARTITION BY r ORDER BY s) AS span FROM (SELECT *, (s > coalesce(max(e) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS new FROM g)),
m AS (SELECT r, min(s) AS s, max(e) AS e FROM n GROUP BY r, span),
c AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM m),
k AS (SELECT c.r, sum(e - s)::BIGINT AS gone, count(*) AS spans, string_agg(hex(b[before + 1:s]), '' ORDER BY s) || hex(any_value(b)[max(e) + 1:]) AS kept FROM c JOIN d USING (r) GROUP BY c.r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

"""MinHash near-duplicates by SetSketch registers.

A register is a truncated, exponentially spaced minimum: with E_i the smallest of
exponential draws of a set's shingles, K_i = floor(1 - log_base E_i). Registers merge by
their maximum and equal registers are locality sensitive, so bands of registers give the
candidates. The registers of a candidate pair and the known set sizes give a joint
likelihood of the similarity; pairs that the threshold cannot explain are dropped, the
others are verified on their full shingle sets.

A band's bucket is never expanded into pairs (see groups.py): exact copies of a set are
one class, and the likelihood leaves only the probable pairs of what stays unconnected.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import block_links, settle, shared_buckets
from .shingles import Hasher, mix
from .util import cut, fresh, stored, table

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
SPACING, RATE, TOP = 1.001, 20.0, 65534
THRESHOLD = 85  # hundredths of the union
LIKELIHOOD = 20.0  # natural-log units below the best similarity: about six deviations

_n = np.arange(1, REGISTERS + 1, dtype=np.uint64)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    return (mix(_n) >> np.uint64(32)).astype(np.uint32)[:, None], (mix(_n + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def registers(hashes: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set."""
    x = ((hashes >> np.uint64(32)) ^ (hashes & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[None, i : i + 1024] ^ flip) * times).min(axis=1), out=least)
    draw = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(draw) / math.log(SPACING)), 0, TOP).astype(np.uint16)


def band_keys(k: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band's registers."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + k.reshape(BANDS, ROWS)[:, i].astype(np.uint64))
    return total.view(np.int64)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float = THRESHOLD / 100) -> np.ndarray:
    """Whether each pair of register rows may reach the threshold, by joint likelihood."""
    na, nb = na.astype(float), nb.astype(float)
    possible = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (SPACING - 1) / SPACING) / math.log(SPACING)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))

    grid = np.linspace(0, 1, 51)[None, :] * np.minimum(u / v, v / u)
    at = likelihood(grid)
    best, where = at.max(1), np.take_along_axis(grid, at.argmax(1)[:, None], 1)[:, 0]
    return possible & ((where >= threshold) | (likelihood(np.full((len(a), 1), threshold))[:, 0] >= best - LIKELIHOOD))


def sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, n (set size), key (digest of the set), bands, regs; null where empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hasher, (flip, times) = Hasher(), _constants()
        for batch in batches:
            n, key, bands, regs = [], [], [], []
            for t in batch.column(1):
                h = hasher.shingles(t.as_py())
                n.append(len(h))
                k = registers(h, flip, times) if len(h) else None
                key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                bands.append(band_keys(k) if len(h) else None)
                regs.append(k.tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())], ["doc_id", "n", "key", "bands", "regs"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, key binary, bands array<long>, regs binary")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = plausible(_regs(batch.column(4)), _regs(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield batch.select([0, 1]).filter(pa.array(ok))

    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * THRESHOLD))
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches):
        hasher, seen = Hasher(), {}

        def hashes(i, t):
            if i not in seen:
                if len(seen) >= 64:
                    seen.pop(next(iter(seen)))
                seen[i] = hasher.shingles(t)
            return seen[i]

        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = hashes(a, ta.as_py()), hashes(b, tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * 100 >= (len(x) + len(y) - both) * THRESHOLD)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _rest(texts: DataFrame):
    """Links among what still shares a bucket: exact intersections by an inverted list
    of the shingles of a part."""

    def compare(c, keys, text):
        hasher, c = Hasher(), np.array(c)
        sets = [hasher.shingles(t) for t in text]
        n = np.array([len(x) for x in sets])
        names, of = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(of, kind="stable")
        rows, ends = row[order], np.cumsum(np.bincount(of, minlength=len(names)))
        starts, first = np.concatenate(([0], ends[:-1])), np.concatenate(([0], np.cumsum(n)))
        common = np.bincount(c_ := np.unique(c, return_inverse=True)[1]).argmax()
        for i in np.flatnonzero(c_ != common):  # two rows of the largest component need no test
            mine = of[first[i] : first[i + 1]]
            both = np.bincount(np.concatenate([rows[starts[k] : ends[k]] for k in mine]), minlength=len(sets))
            linked = np.flatnonzero((both * 100 >= (n + n[i] - both) * THRESHOLD) & (c != c[i]))
            yield from ((i, j) for j in linked[np.unique(c[linked], return_index=True)[1]])

    return lambda members: block_links(members, texts.withColumnRenamed("doc_id", "id"), ["text"], compare)


@stored
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= 85 * union of their sets of distinct
    5-word shingles (A-Z lower-cased; shorter texts are one shingle). Null, empty and
    blank texts have the empty set and are linked with nothing; equal sets are one class,
    so copies are never compared; an id may repeat only with equal text; other columns
    are ignored; ids are long; a null id is kept and links no other id. A pair at the threshold misses all bands with probability
    (1 - 0.85 ** 5) ** 24 < 1e-6.

    Scale: texts move once (only what shares a bucket is stored), the rest are ids,
    registers and keys; every loop step is stored in the shared folder.
    """
    s = cut(sketches(docs, id_col, text), "sketches")
    classes = s.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = s.join(classes, "key").where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "n", "bands", "regs")
    reps = cut(reps, "classes")
    shared = shared_buckets(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")), "buckets")
    ids = shared.select("id").distinct()
    texts = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"]), "texts")
    regs = reps.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "n", "regs")

    label = settle(shared, lambda pairs: _linked(_likely(pairs, regs), texts), _rest(texts))
    of = s.select("doc_id", "n", "key").join(classes, "key", "left").join(label, F.col("rep") == F.col("id"), "left")
    out = of.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept. Null and blank texts have no
    shingles and are linked with nothing; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays, with all rows that repeat it; null ids stay.

    Texts without words are in no group and stay. All columns of docs are kept.
    """
    name = fresh(docs, "kept_id")
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sn AS (SELECT doc_id, hash(s) AS s FROM sh),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ev AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sn a JOIN sn b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
li AS (SELECT a, b FROM ev JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 85 * (na.n + nb.n - n_both)),
re AS (SELECT a AS doc_id, a AS other FROM li UNION SELECT re.doc_id, li.b FROM re JOIN li ON li.a = re.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM re GROUP BY doc_id) c USING (doc_id)
"""

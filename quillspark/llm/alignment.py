"""Alignment of two tokenizers over the bytes of the same texts.

Python only tokenises: ids and end offsets in bytes, of both vocabularies. All else is array
functions of Spark. The offsets where tokens of both end are the intersection of the two end
arrays; they cut the tokens into groups. The overlapping pairs are read from one sorted
array of all ends: the p-th end, if it is the i-th of its own side, has p - i ends of the
other side before it, which is the place of the token that it overlaps. Nothing is searched,
so the work grows with the number of tokens, also of very long texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .shingles import worker
from .tokens import Codec, vocabulary
from .util import cut, stored, table

PIECES = "piece_bpe_32k.model"
GROUP = 1 << 19  # characters tokenised at once
PAIRS = 1 << 19  # pairs of ids that are broadcast; more are joined by a shuffle
SALTS = 16
#: Arrays without nulls: Spark then sorts and intersects plain numbers.
TOKENS = [StructField(f"{side}_{name}", ArrayType(kind, False), False) for side in "ab" for name, kind in (("ids", IntegerType()), ("ends", LongType()))]


class Pieces:
    """A sentencepiece model with the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def _coders(a_path: str, b_path: str) -> list[tuple[Callable, list[bytes], np.ndarray]]:
    """(encode a text, bytes of each id, their lengths) of both; kept by the worker."""
    kept, key = worker(), ("aligned", a_path, b_path)
    if key not in kept:
        a, b = Codec(a_path), Pieces(b_path)
        a.special, a.special_at = {}, None  # special tokens in a text are plain text
        kept[key] = [(f, x.bytes, np.array([len(t) for t in x.bytes])) for x, f in ((a, lambda t: a.encode_array(" " + t)), (b, b.encode))]
    return kept[key]


def tokenised(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, ids and end offsets of the bytes of space + text in both vocabularies.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have
    empty arrays. Repeated rows stay repeated; other columns are ignored.
    """
    a_path, b_path = a_path or vocabulary(), b_path or vocabulary(PIECES)
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *TOKENS])

    def one(t: str | None):
        if not t:
            return None
        whole, out = (" " + t).encode(), []
        for encode, parts, size in _coders(a_path, b_path):
            ids = encode(t)
            ids = ids if isinstance(ids, np.ndarray) else np.array(ids, np.int64)
            if b"".join(map(parts.__getitem__, ids.tolist())) != whole:
                return None
            out += [ids.astype(np.int32), np.cumsum(size[ids])]
        return out

    def rows(ids, found):
        none = [np.zeros(0, t) for t in (np.int32, np.int64)] * 2
        columns = []
        for k in range(4):
            flat = [none[k] if x is None else x[k] for x in found]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
        return pa.RecordBatch.from_arrays([ids, *columns], schema.names)

    def run(batches):
        for batch in batches:
            begin, held, size = 0, [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                held.append(one(t))
                size += len(t or "")
                if size >= GROUP or i + 1 == batch.num_rows:
                    yield rows(batch.column(0).slice(begin, i + 1 - begin), held)
                    begin, held, size = i + 1, [], 0

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


LOW, SIDE = (1 << 31) - 1, 1 << 31
ONE = (1 << 32) + 1  # one place further on both sides


def _high(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW)).cast("int")


def aligned(tokens: DataFrame) -> DataFrame:
    """tokens with n_groups, events and cuts.

    events: all ends in order, as end, side and place in one number; of equal ends that of a
    comes first. cuts: for each common end the places of the tokens of a and b that end there,
    as a * 2^32 + b. See links(), linked_ids() and groups(), which read them. Rows without tokens
    have empty arrays.
    """
    events = F.sort_array(F.concat(F.transform("a_ends", lambda e, i: F.shiftleft(e, 32) + i), F.transform("b_ends", lambda e, j: F.shiftleft(e, 32) + (j + F.lit(SIDE)))))
    found = tokens.withColumns({"n_groups": F.size(F.array_intersect("a_ends", "b_ends")), "events": events})

    def cut_at(x: Column, p: Column) -> Column:
        at = x.bitwiseAND(F.lit(LOW))
        ends = (x.bitwiseAND(F.lit(SIDE)) == 0) & (F.get(F.col("b_ends"), p - at.cast("int")) == F.shiftright(x, 32))
        return F.when(ends, F.shiftleft(at, 32) + (p - at))

    return found.withColumn("cuts", F.array_compact(F.transform("events", cut_at)))


def _overlaps(pair: Callable[[Column, Column], Column]) -> Column:
    """pair(place in a, place in b) of every end; an end of b that is one of a, too, is the same."""

    def link(x: Column, p: Column) -> Column:
        at = _low(x)
        same = F.get(F.col("a_ends"), p - at - 1).eqNullSafe(F.shiftright(x, 32))
        return F.when(x.bitwiseAND(F.lit(SIDE)) == 0, pair(at, p - at)).when(~same, pair(p - at, at))

    return F.array_compact(F.transform("events", link))


def links() -> Column:
    """The places of all overlapping tokens of an aligned row, in order of bytes."""
    return _overlaps(lambda a, b: F.struct(a.alias("a_at"), b.alias("b_at")))


def linked_ids() -> Column:
    """The pairs of ids of an aligned row's links, as a * 2^32 + b."""
    return _overlaps(lambda a, b: F.shiftleft(F.get(F.col("a_ids"), a).cast("long"), 32) + F.get(F.col("b_ids"), b))


def _run(ids: str, last: Column, before: Column) -> Column:
    return F.transform(F.sequence(before + 1, last), lambda i: F.get(F.col(ids), i))


def _before(k: Column) -> tuple[Column, Column]:
    """The places of the last tokens before the k-th group."""
    x = F.get(F.col("cuts"), k - 1)
    return tuple(F.coalesce(side(x), F.lit(-1)) for side in (_high, _low))


def groups() -> Column:
    """The groups of an aligned row: array<struct<a, b>> of the ids between common ends."""
    return F.transform("cuts", lambda x, k: F.struct(_run("a_ids", _high(x), _before(k)[0]).alias("a"), _run("b_ids", _low(x), _before(k)[1]).alias("b")))


def groups_text() -> Column:
    """`a1,a2|b1;a3|b2,b3`: the ids of both sides, group by group."""
    id_at = lambda ids, at: F.get(F.col(ids), at).cast("string")

    def name(ids: str, last: Column, before: Column) -> Column:
        return F.when(last == before + 1, id_at(ids, last)).otherwise(F.array_join(_run(ids, last, before).cast("array<string>"), ","))

    def text(x: Column, k: Column) -> Column:
        single = F.get(F.col("cuts"), k - 1) + F.lit(ONE) == x
        one = F.concat(id_at("a_ids", _high(x)), F.lit("|"), id_at("b_ids", _low(x)))
        return F.when(single, one).otherwise(F.concat(name("a_ids", _high(x), _before(k)[0]), F.lit("|"), name("b_ids", _low(x), _before(k)[1])))

    return F.array_join(F.transform("cuts", text), ";")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best) of rows with an array pairs: how many links hold a pair of ids, and
    whether no other pair of the same b has more. Counted map-side before the shuffle."""
    counts = cut(pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return cut(counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


@stored
def link_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, bound: int = PAIRS) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256, the digest of `a1,a2|b1;a3|b2,b3`: the ids of both sides, group by group.

    A link counts as best where no pair of its b id has more links in the whole corpus;
    count_sum adds the corpus counts of a row's links. See tokenised() for nulls, empty and
    unfit texts (zeros, an empty string); an empty table has no rows.

    Scale: a text is tokenised once; what is stored is a pair of ids for each link. Counts are
    combined before their shuffle. The pairs of the vocabularies are counted: up to `bound`
    they are broadcast, beyond that they are joined by pair and a salt of the row, so that a
    pair with a third of all links is spread over SALTS tasks. A row's sums are made in the
    task that holds it.
    """
    found = aligned(tokenised(docs, id_col, text, a_path, b_path))
    size = lambda c: F.size(c).cast("long")
    digest = F.when(F.size("cuts") > 0, F.sha2(groups_text(), 256)).otherwise("")
    rows = cut(found.select(F.monotonically_increasing_id().alias("uid"), "doc_id", size("a_ids").alias("n_a"), size("b_ids").alias("n_b"), F.col("n_groups").cast("long").alias("n_groups"), digest.alias("groups_sha256"), linked_ids().alias("pairs")).withColumn("n_links", size("pairs")), "links")
    counts = pair_counts(rows)
    links = rows.select("uid", F.explode("pairs").alias("pair"))
    if counts.count() <= bound:
        scored = links.join(F.broadcast(counts), "pair")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        scored = links.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS))).join(salted, ["pair", "salt"])
    sums = scored.groupBy("uid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs").join(sums, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE against pieces: doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256. Null, empty and unfit texts have zeros and ''."""
    return link_scores(table(spark, sf_dir, "documents"))

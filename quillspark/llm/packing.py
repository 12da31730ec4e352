"""Lexical retrieval packing.

Documents are dealt into bounded shards of lexically close texts (by the smallest hash of
their words). Each shard has a BM25 inverted index over token ids; a seed document is
followed by its best unused neighbours until the window is full. A document that crosses
the end of a window is cut there and is the seed of the next window, so only the last
window of a task is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import codec, vocabulary
from .util import table

WINDOW = 2048
END = 1
SHARD_CHARS, SHARD_DOCS = 4 << 20, 2048
NEAREST = 32
K1, B = 1.5, 0.75


class Index:
    """BM25 over the documents of one shard; what is taken out is not found again.

    An inverted index: the postings (document, gain) of a term lie together, so a seed reads
    only the postings of its own terms - of all of them.
    """

    def __init__(self, ids: list[np.ndarray]) -> None:
        self.n = len(ids)
        self.free = np.ones(self.n, bool)
        terms, tfs = zip(*(np.unique(x[:-1], return_counts=True) for x in ids), strict=True)
        sizes = np.array([len(x) for x in ids], float)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        names, term, df = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1.0))
        tf = np.concatenate(tfs)
        gain = tf * (K1 + 1) / (tf + norm[doc]) * np.log1p((self.n - df + 0.5) / (df + 0.5))[term]
        shared = df[term] > 1  # a term of one document brings no neighbour
        self.asked = np.split(term[shared], np.searchsorted(doc[shared], np.arange(1, self.n)))
        order = np.argsort(term[shared], kind="stable")
        self.doc, self.term, self.gain = doc[shared][order], term[shared][order], gain[shared][order]
        self.names, self.held = len(names), self.n
        self._ends()

    def _ends(self) -> None:
        self.first = np.searchsorted(self.term, np.arange(self.names + 1))

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by falling score over all terms of the seed, ties in order of place.

        The best NEAREST and their ties are sorted first: a window seldom needs more.
        """
        if 4 * (left := int(self.free.sum())) < 3 * self.held:  # forget what is taken
            kept = self.free[self.doc]
            self.doc, self.term, self.gain, self.held = self.doc[kept], self.term[kept], self.gain[kept], left
            self._ends()
        first, size = self.first[self.asked[seed]], np.diff(self.first)[self.asked[seed]]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.gain[at], self.n)
        score[~self.free] = 0
        best = np.flatnonzero(score > 0)
        if len(best) > 2 * NEAREST:
            lead = score[best] >= np.partition(score[best], -NEAREST)[-NEAREST]
            first, best = best[lead], best[~lead]
            yield from first[np.argsort(-score[first], kind="stable")].tolist()
        yield from best[np.argsort(-score[best], kind="stable")].tolist()


class Packer:
    """Places documents one after another into windows; keeps the open window."""

    def __init__(self, first: int, window: int) -> None:
        self.sequence, self.at, self.window = first, 0, window

    def place(self, ids: np.ndarray):
        """(start, length, crc32, sequence, offset) of each piece."""
        start = 0
        while start < len(ids):
            n = min(self.window - self.at, len(ids) - start)
            yield start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), self.sequence, self.at
            start, self.at = start + n, self.at + n
            if self.at == self.window:
                self.sequence, self.at = self.sequence + 1, 0


def order(ids: list[np.ndarray], packer: Packer):
    """(document, its pieces) in the order of retrieval."""
    index, following = Index(ids), iter(range(len(ids)))
    near = iter(())
    for _ in range(len(ids)):
        new = next((x for x in near if index.free[x]), None)
        if opens := new is None:
            new = next(x for x in following if index.free[x])
        index.free[new] = False
        before = packer.sequence
        yield new, list(packer.place(ids[new]))
        if opens or packer.sequence != before:
            near = index.neighbours(new)  # it opens the window


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then id 1; null text counts as empty, so it is the
    one id. Repeated rows are packed each for itself, other columns are ignored, and an
    empty table has no pieces. with_ids adds the ids of the piece.

    Scale: one shuffle of the texts, by their smallest word hash; partitions that one
    key makes large are split by the REBALANCE hint, and a task holds one shard of
    bounded size at a time. Sequence numbers are unique: task number and place. Within a
    task the rows are in order of key, id and text, so a task that runs again after a
    lost executor places them alike; ids may be null or of any type.
    """
    path = path or vocabulary()

    def run(batches):
        coder, packer = codec(path), Packer(TaskContext.get().partitionId() << 33, window)
        kind = [pa.int64()] * 7

        def shard(rows):
            ids = [np.append(coder.encode_array(t), np.uint32(END)) for _, t in rows]
            out = [(rows[d][0], s, n, crc, len(ids[d]), seq, at, *([ids[d][s : s + n].tolist()] if with_ids else ())) for d, pieces in order(ids, packer) for s, n, crc, seq, at in pieces]
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(cols[0], keys), *(pa.array(c, k) for c, k in zip(cols[1:7], kind, strict=False)), *([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])]
            return pa.RecordBatch.from_arrays(arrays, names)

        held, chars = [], 0
        for batch in batches:
            keys = batch.schema.field(0).type
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((d, t.as_py() or ""))
                chars += len(held[-1][1])
                if chars >= SHARD_CHARS or len(held) >= SHARD_DOCS:
                    yield shard(held)
                    held, chars = [], 0
        if held:
            yield shard(held)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    key = F.coalesce(F.array_min(F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.xxhash64(w))), F.lit(0))
    dealt = rows.withColumn("near", key).hint("rebalance", "near").sortWithinPartitions("near", "doc_id", F.xxhash64("text"))
    return dealt.select("doc_id", "text").mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, a row for each piece; a null text is its
    end token alone; see pack()."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; see pack for nulls, ties and repeated rows."""
    return pack(docs)

"""Byte-level BPE encoding and decoding, exact at any length.

Texts are split as the vocabulary's pre-tokenizer does, and each distinct piece is
merged once per task. A long piece that the pre-tokenizer leaves unsplit is encoded by
tree concatenation: its halves are encoded apart, and around each join a growing window
is encoded again until the pairs at both of its edges are pairs that BPE itself would
leave apart, which makes the whole sequence the encoding of the joined text.

Texts over SPREAD characters leave their task: their parts, and the slices of an unsplit
piece, are rows of their own that tasks encode in parallel, and the joins of the tree are
made where the parts of a text meet again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import worker
from .util import cut, table

LEAF = 2048  # bytes; longer pieces are encoded as a tree
CHUNK = 1 << 16  # characters split at once
SPREAD = 1 << 18  # characters; the parts of longer texts are encoded in parallel
SLICE = 1 << 16  # bytes of an unsplit piece in one such part
CACHED = 400_000  # distinct pieces kept per task


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def codec(path: str) -> Codec:
    """The worker process's codec of a vocabulary: kept between its tasks."""
    kept = worker()
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


class Codec:
    """Encoder and decoder of one vocabulary file, with a bounded cache of pieces."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import public_tokenizers
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        whole = Tokenizer.from_file(path)
        self.split = whole.pre_tokenizer.pre_tokenize_str
        self.merge = Tokenizer(whole.model)  # merges alone, no splitting
        self.leaf = leaf
        alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(alphabet)}
        back = {c: b for b, c in enumerate(alphabet)}
        vocab = whole.get_vocab(with_added_tokens=True)
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        self.names = [str(i) for i in range(len(self.bytes))]
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Texts of these characters alone are of the same classes in every version of
        # Unicode; without a long piece a faster library with the same merges takes them.
        self.plain = re.compile("[\t\n\r\x20-\x7e\xa0-±´-¸º»¿-ɏ]*")
        self.long = re.compile(rf"(?<!\S)\S{{{leaf}}}|(?<!\s)\s{{{leaf}}}")
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in self.special.values()}
        coder = lambda pattern: Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.fast = coder(public_tokenizers.PATTERN)
        # Where no two spaces meet, the look ahead at the end of a run of them decides nothing,
        # and a pattern without it is matched faster.
        self.quick = coder(public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))
        self.space, self.spaces = re.compile(r"\s"), re.compile(r"\s\s")
        self.gap = re.compile(r"(?<=\S) (?=\S)")
        self.mapped: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def learn(self, pieces: set[str]) -> None:
        short = [p for p in pieces if len(p) <= self.leaf]
        for p, e in zip(short, self.merge.encode_batch_fast(short), strict=True):
            self.mapped[p] = e.ids
        for p in pieces:
            if len(p) > self.leaf:
                self.mapped[p] = self.encode_piece(p)

    def encode_piece(self, piece: str) -> list[int]:
        """A pre-token in the byte alphabet."""
        if len(piece) <= self.leaf:
            return self.merge.encode(piece).ids
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        return self.tree([e.ids for e in self.merge.encode_batch_fast(leaves)])

    def tree(self, level: list[list[int]]) -> list[int]:
        """The encoding of a piece from those of its slices in order."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they meet."""
        key = (a, b)
        if key not in self.pairs:
            self.pairs[key] = self.merge.encode((self.bytes[a] + self.bytes[b]).decode("latin-1").translate(self.table)).ids == [a, b]
        return self.pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])).decode("latin-1").translate(self.table)
            middle = self.merge.encode(window).ids
            if (i == 0 or self.apart(left[i - 1], middle[0])) and (j == len(right) or self.apart(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def chunks(self, text: str, size: int = CHUNK) -> Iterator[str]:
        """Parts cut before single spaces between other characters, where the
        pre-tokenizer always cuts."""
        at = 0
        while len(text) - at > size and (m := self.gap.search(text, at + size)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def library(self, text: str) -> Encoding | None:
        """The faster library's encoder of a text, or None where it may not take it."""
        if not self.plain.fullmatch(text):
            return None
        half = max(1, self.leaf // 2)  # a long piece holds a whole one of these stretches
        if not self.spaces.search(text) and all(self.space.search(text, i, i + half) for i in range(0, len(text) - half + 1, half)):
            return self.quick
        return None if self.long.search(text) else self.fast

    def encode(self, text: str) -> list[int]:
        if len(self.mapped) > CACHED:
            self.mapped.clear()
        if len(self.pairs) > CACHED:
            self.pairs.clear()
        out: list[int] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for chunk in self.chunks(part):
                if library := self.library(chunk):
                    out.extend(library.encode_ordinary(chunk))
                else:
                    pieces = [p for p, _ in self.split(chunk)]
                    self.learn({p for p in pieces if p not in self.mapped})
                    out.extend(chain.from_iterable(map(self.mapped.__getitem__, pieces)))
        return out

    def parts(self, text: str, width: int, chunk: int) -> Iterator[tuple[str, str]]:
        """(sort, text) of the parts of a text whose encodings follow one another.

        "text" is encoded as a text of its own, "special" is an added token, "pieces" are
        pieces in the byte alphabet, one a line; "slice" begins an unsplit piece of more than
        `width` bytes, and each "more" is the next slice of it.
        """
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                yield "special", part
                continue
            for piece in self.chunks(part, chunk):
                if len(piece) <= width:
                    yield "text", piece
                    continue
                short: list[str] = []
                for name in [p for p, _ in self.split(piece)]:
                    if len(name) <= width:
                        short.append(name)
                        continue
                    if short:
                        yield "pieces", "\n".join(short)
                        short = []
                    for i in range(0, len(name), width):
                        yield "more" if i else "slice", name[i : i + width]
                if short:
                    yield "pieces", "\n".join(short)

    def encode_part(self, sort: str, text: str) -> list[int]:
        if sort == "special":
            return [self.special[text]]
        if sort == "text":
            return self.encode(text)
        if sort == "pieces":
            pieces = text.split("\n")
            self.learn({p for p in pieces if p not in self.mapped})
            return list(chain.from_iterable(map(self.mapped.__getitem__, pieces)))
        return self.encode_piece(text)

    def joined(self, sorts: list[str], ids: list[list[int]]) -> list[int]:
        """The encoding of a text from those of its parts."""
        out: list[int] = []
        at = 0
        while at < len(sorts):
            end = at + 1
            while end < len(sorts) and sorts[end] == "more":
                end += 1
            out += self.tree(ids[at:end])
            at = end
        return out

    def encode_array(self, text: str) -> np.ndarray:
        if len(text) <= CHUNK and not (self.special_at and self.special_at.search(text)) and (library := self.library(text)):
            return library.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return np.array(self.encode(text), np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _encoded(docs: DataFrame, path: str | None, id_col: str, text: str, schema: str, finish: Callable[[Codec, list[list[int]]], list[pa.Array]], spread: int, width: int) -> DataFrame:
    """doc_id and the columns of schema, which finish makes of the ids of a batch."""
    path = path or vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def whole(batches):
        coder = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(coder, [coder.encode(t.as_py()) for t in batch.column(1)])], names)

    def split(batches):
        coder = codec(path)
        for batch in batches:
            for i, t in enumerate(batch.column(2)):
                sorts, texts = zip(*coder.parts(t.as_py(), width, width), strict=True)
                same = pa.array([i] * len(sorts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(range(len(sorts)), pa.int32()), pa.array(sorts), pa.array(texts)], ["doc_id", "uid", "part", "sort", "text"])

    def encode(batches):
        coder = codec(path)
        for batch in batches:
            ids = [coder.encode_part(s, t) for s, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "uid", "part", "sort", "ids"])

    def meet(batches):
        coder = codec(path)
        for batch in batches:
            ids = [coder.joined([p["sort"] for p in parts.as_py()], [p["ids"] for p in parts.as_py()]) for parts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(coder, ids)], names)

    out = f"doc_id {kind}, {schema}"
    short = rows.where(F.length("text") <= spread).mapInArrow(whole, out)
    long = rows.where(F.length("text") > spread)
    if long.isEmpty():
        return short
    # Stored, so that the numbers of the rows stay what they are.
    parts = cut(long.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(split, f"doc_id {kind}, uid long, part int, sort string, text string"), "parts")
    done = parts.repartition("uid", "part").mapInArrow(encode, f"doc_id {kind}, uid long, part int, sort string, ids array<int>")
    texts = done.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "sort", "ids"))).alias("parts"))
    return short.unionByName(texts.select("doc_id", "parts").mapInArrow(meet, out))


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", spread: int = SPREAD, width: int = SLICE) -> DataFrame:
    """(doc_id, ids array<int>); null text counts as empty and has no ids. See round_trip."""
    return _encoded(docs, path, id_col, text, "ids array<int>", lambda _, ids: [pa.array(ids, pa.list_(pa.int32()))], spread, width)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", spread: int = SPREAD, width: int = SLICE) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no tokens, digests of the empty string. Repeated rows stay
    repeated, ids may be null or of any type; other columns are ignored. Memory is that of
    one Arrow batch of texts and a bounded cache. Only texts over `spread` characters are
    shuffled, in parts of `width`; the ids of one text meet in one task.
    """

    def finish(coder, found):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        ids = [sha(",".join(map(coder.names.__getitem__, x)).encode()) for x in found]
        return [pa.array([len(x) for x in found], pa.int64()), pa.array(ids, pa.string()), pa.array([sha(coder.decode(x).encode()) for x in found], pa.string())]

    return _encoded(docs, path, id_col, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish, spread, width)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256.
    A null text has no tokens; see round_trip()."""
    return round_trip(table(spark, sf_dir, "documents"))

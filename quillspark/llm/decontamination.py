"""Benchmark decontamination by suffix arrays of the training texts.

The words of a task's texts are gathered into shards of about SHARD words. A shard's suffix
array holds, in order of their words, the places whose first words are those of a test
suffix anywhere; no other place can hold a match of that length. Every suffix of the
benchmark's items is then searched in it word by word: the places that begin with its first
t words are an interval of the array, which a binary search narrows by the next word. Where
the interval ends is the suffix's longest verbatim match; what it is at the length of a
window are all occurrences of that window. A document with an occurrence is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import Hasher, mix
from .util import cut, fresh, stored, table

WINDOW = 10
LEAD = 3  # words that choose the places of a suffix array; fewer where a window is shorter
SHARD = 1 << 20  # words
GROUP = 1 << 20  # bytes hashed at once
BLOCK = 1 << 20  # words of items that are broadcast at once; one item may have more
END, LAST = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)  # behind a text, behind an item


def word_hasher() -> Hasher:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z."""
    h = Hasher()
    h.bytes[65:91] = h.bytes[97:123]
    letter = np.zeros(256, bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    h.space, h.gap = ~letter, re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
    return h


def leads(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; the last k - 1 places have none."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : n + i]) * np.uint64(0xA0761D6478BD642F)
        out ^= out >> np.uint64(29)
    return mix(out)


class Tests:
    """The suffixes of a block of items: items are (id, words)."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, lead: int) -> None:
        items = [(i, w) for i, w in items if len(w)]
        self.names = np.array([i for i, _ in items], object)
        size = np.array([len(w) for _, w in items], np.int64)
        self.words = np.concatenate([x for _, w in items for x in (w, [LAST])]).astype(np.uint64) if items else np.zeros(0, np.uint64)
        first = np.cumsum(size + 1) - size - 1
        self.lead = lead
        self.depth = int(max(size, default=0))
        n = size - self.lead + 1
        self.item = np.repeat(np.arange(len(items)), n)
        self.place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = first[self.item] + self.place
        self.left = size[self.item] - self.place
        whole = (size[self.item] < window) & (self.place == 0)
        self.window = np.where(whole, self.left, np.where(self.left >= window, window, 0))
        self.key = leads(self.words, self.lead)[self.at] if items else np.zeros(0, np.uint64)
        bits = min(24, max(12, int(128 * max(1, len(self.key))).bit_length()))
        self.mask, self.seen = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.seen[self.key & self.mask] = True
        self.keys = np.unique(self.key)

    def places(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of a stream of words that begin like a suffix, and their keys."""
        key = leads(stream, self.lead)
        at = np.flatnonzero(self.seen[key & self.mask])
        key = key[at]
        if len(self.keys):
            near = np.searchsorted(self.keys, key)
            fine = self.keys[np.minimum(near, len(self.keys) - 1)] == key
            at, key = at[fine], key[fine]
        return at, key


def suffix_array(stream: np.ndarray, at: np.ndarray, key: np.ndarray, lead: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys in order of key, then of the words behind the first `lead` ones up to
    `depth` words. Only places that agree so far are put in order by their next word."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    live, t = np.arange(len(at)), lead
    while True:
        size = np.bincount(group[live]) if len(live) else np.zeros(0, np.int64)
        live = live[size[group[live]] > 1]
        if t >= depth or not len(live):
            return at, key
        word = stream[at[live] + t]
        order = np.lexsort((word, group[live]))
        at[live], word = at[live][order], word[order]
        new = (np.diff(group[live], prepend=-1) != 0) | (np.diff(word, prepend=word[:1]) != 0)
        group[live] = np.cumsum(new)
        live = live[word != END]
        t += 1


def _bound(stream, sa, t, low, high, word, right):
    low, high = low.copy(), high.copy()
    while (some := low < high).any():
        mid = (low + high) >> 1
        value = stream[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + t, len(stream) - 1)]
        less = value <= word if right else value < word
        low, high = np.where(some & less, mid + 1, low), np.where(some & ~less, mid, high)
    return low


def search(stream: np.ndarray, sa: np.ndarray, key: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """For each test suffix: length and interval of its longest match, interval of its window."""
    low, high = np.searchsorted(key, tests.key, "left"), np.searchsorted(key, tests.key, "right")
    length, first, last = np.zeros(len(low), np.int64), np.zeros_like(low), np.zeros_like(low)
    live, t = np.flatnonzero(low < high), tests.lead
    length[live] = t
    while len(live):
        whole = live[tests.window[live] == t]
        first[whole], last[whole] = low[whole], high[whole]
        live = live[tests.left[live] > t]
        word = tests.words[tests.at[live] + t]
        a = _bound(stream, sa, t, low[live], high[live], word, False)
        b = _bound(stream, sa, t, a, high[live], word, True)
        live, a, b = live[a < b], a[a < b], b[a < b]
        t += 1
        low[live], high[live], length[live] = a, b, t
    return length, low, high, first, last


def _ragged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places of the intervals."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]


class Shard:
    """Texts in a row as one stream of words, each text followed by END."""

    def __init__(self, streams: list[np.ndarray], counts: list[np.ndarray], rows: list[pa.RecordBatch], tests: Tests) -> None:
        self.rows, self.tests = rows, tests
        self.stream, self.n = np.concatenate(streams), np.concatenate(counts)
        self.begin = np.cumsum(self.n + 1) - self.n - 1
        at, key = tests.places(self.stream)
        self.sa, key = suffix_array(self.stream, at, key, tests.lead, tests.depth)
        self.length, self.low, self.high, self.first, self.last = search(self.stream, self.sa, key, tests)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def column(self, i: int) -> pa.Array:
        return pa.concat_arrays([b.column(i) for b in self.rows])

    def hits(self) -> pa.RecordBatch:
        """A row for each text: n_words, spans of hit words, and the ids of the items."""
        t = self.tests
        found = np.flatnonzero(self.first < self.last)
        # Equal windows have one interval; it is read once.
        ends = np.stack([self.first[found], self.last[found], t.window[found]], 1)
        uniq, of = np.unique(ends, axis=0, return_inverse=True) if len(found) else (ends, found)
        row, place = _ragged(uniq[:, 0], uniq[:, 1])
        at, width = self.sa[place], uniq[row, 2]
        edge = np.bincount(at, minlength=len(self.stream) + 1).astype(np.int64) - np.bincount(at + width, minlength=len(self.stream) + 1)
        side = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).view(np.int8))))
        start, end = np.flatnonzero(side == 1), np.flatnonzero(side == -1)
        text = self.text_of(start)
        spans = pa.StructArray.from_arrays([pa.array((x - self.begin[text]).astype(np.int64)) for x in (start, end)], ["start", "end"])
        cuts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.n))))).astype(np.int32)
        # Windows that the same items hold are one class: a text has each class once.
        pair = np.unique(np.stack([of.ravel(), t.item[found]], 1), axis=0)
        name = np.zeros(len(uniq), np.uint64)
        np.add.at(name, pair[:, 0], mix(pair[:, 1].astype(np.uint64) + np.uint64(1)))
        _, lead, kind = np.unique(name, return_index=True, return_inverse=True)
        held = np.unique(np.stack([self.text_of(at), kind[row]], 1), axis=0)
        begin = np.searchsorted(pair[:, 0], np.arange(len(uniq) + 1))
        which, where = _ragged(begin[lead[held[:, 1]]], begin[lead[held[:, 1]] + 1])
        owner, item = held[which, 0], pair[where, 1]
        names: dict[int, set[str]] = {}
        for o, i in zip(owner.tolist(), t.names[item].tolist(), strict=True):
            names.setdefault(o, set()).add(i)
        items = pa.array([sorted(names.get(i, ())) for i in range(len(self.n))], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([self.column(0), self.column(1), pa.array(self.n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), spans), items], ["doc_id", "th", "n_words", "spans", "items"])

    def longest(self) -> pa.RecordBatch:
        """A row for each test suffix that has a match here: its longest, in the first text by id."""
        t, found = self.tests, np.flatnonzero(self.length)
        row, place = _ragged(self.low[found], self.high[found])
        order = pc.rank(self.column(0), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        text = self.text_of(self.sa[place])
        best = np.lexsort((self.sa[place] - self.begin[text], order[text], row))
        at = self.sa[place][best[np.searchsorted(row, np.arange(len(found)))]]
        text = self.text_of(at)
        return pa.RecordBatch.from_arrays([pa.array(t.names[t.item[found]], pa.string()), pa.array(t.place[found]), pa.array(self.length[found]), self.column(0).take(pa.array(text)), pa.array(at - self.begin[text])], ["item_id", "at", "length", "doc_id", "start"])


def _words(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(stream, words of each text, first row, end) of groups of texts; column 2 holds the
    texts, each with a line feed behind it."""
    column = batch.column(2)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + GROUP, "right")) - 1)
        part = raw[ends[i] : ends[j]]
        if j == i + 1:
            words = hasher.words(part.tobytes())
            n = np.array([len(words)])
        else:
            words, first, _ = hasher.words_at(part)
            n = np.diff(np.searchsorted(first, ends[i : j + 1] - ends[i]))
        stream = np.full(len(words) + j - i, END, np.uint64)
        stream[np.arange(len(words)) + np.repeat(np.arange(j - i), n)] = words
        yield stream, n, i, j
        i = j


def _scan(docs: DataFrame, block, window: int, shard: int, out: Callable[[Shard], pa.RecordBatch], schema: str) -> DataFrame:
    """out() of each shard of docs (doc_id, th, text) against a broadcast block of items."""

    def run(batches):
        lead, items = block.value
        tests, hasher = Tests([(i, np.frombuffer(w, np.uint64)) for i, w in items], window, lead), word_hasher()
        held, size = ([], [], []), 0
        for batch in batches:
            for stream, n, i, j in _words(batch, hasher):
                for kept, x in zip(held, (stream, n, batch.slice(i, j - i).select([0, 1])), strict=True):
                    kept.append(x)
                size += len(stream)
                if size >= shard:
                    yield out(Shard(*held, tests))
                    held, size = ([], [], []), 0
        if held[0]:
            yield out(Shard(*held, tests))

    return docs.mapInArrow(run, schema)


def _blocks(items: DataFrame, item_id: str, text: str, window: int, bound: int) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """(words that choose a place, items with their words), in blocks of at most `bound` words
    or one item, one at a time."""

    def hashed(batches):
        hasher = word_hasher()
        for batch in batches:
            words = [hasher.words(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())], ["item_id", "n", "words"])

    named = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("t")).where("item_id is not null and t is not null")
    rows = cut(named.distinct().mapInArrow(hashed, "item_id string, n long, words binary").where("n > 0"), "items")
    total, least = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("n")).first()
    count = -(-total // bound)
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, count))))
        over = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where(F.col("n") > bound).where("m > 1")
        if over.isEmpty():
            break
        count *= 2
    for b in range(count):
        if held := dealt.where(F.col("block") == b).select("item_id", "words").collect():
            yield min(LEAD, window, least), [(r.item_id, bytes(r.words)) for r in held]


def _told(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("text"))


def _each(docs: DataFrame, items: DataFrame, window: int, id_col: str, text: str, item_id: str, item_text: str, bound: int, shard: int, out, schema: str) -> list[DataFrame]:
    """The scan of each block of items. With several blocks each scan is stored and its block
    forgotten, so that the driver holds two blocks at most."""
    if window < 1:
        raise ValueError("window must be at least 1")
    told, context = _told(docs, id_col, text), docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    parts, last = [], None
    for block in chain(_blocks(items, item_id, item_text, window, bound), [None]):
        if last and (block or parts):
            sent = context.broadcast(last)
            parts.append(cut(_scan(told, sent, window, shard, out, schema.format(kind)), "hits"))
            sent.destroy()
            last = None
        last = block or last
    return parts or [_scan(told, context.broadcast(last or (1, [])), window, shard, out, schema.format(kind))]


HITS = "doc_id {}, th long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


@stored
def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", bound: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row for each row of docs: doc_id, th, n_words, spans, items.

    spans are the maximal runs of hit words (start, end exclusive), items the ids, as sorted
    strings, of the items with a window in the text; th is xxhash64 of the text. A window is
    `window` words of an item in a row, or all words of an item that has fewer. Null and
    empty texts have no words and no hits; items with a null id, a null text or no word take
    no part; an empty benchmark hits nothing. Repeated rows stay repeated, ids may be null or
    of any type, other columns are ignored. Texts that share a window all have it as a hit.

    Scale: the texts are not shuffled. A task holds SHARD words and one Arrow batch; a text
    is a row, so a long one is held whole as 8 bytes a word. Items are broadcast in blocks
    of at most BLOCK words (8 MB) or one item, so the driver holds two at most; the
    texts are read once for each block, and with several blocks what they find is
    merged by (doc_id, th) afterwards.
    """
    parts = _each(docs, items, window, id_col, text, item_id, item_text, bound, shard, Shard.hits, HITS)
    if len(parts) == 1:
        return parts[0]
    first, every = parts[0], parts[0].where("size(spans) > 0")
    for p in parts[1:]:
        every = every.union(p.where("size(spans) > 0"))
    # A copy of the row has the same hits: one is enough.
    once = every.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    # Sorted by start: a run ends where the next span begins behind all ends so far.
    reach = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(F.element_at(acc, -1)["start"], F.greatest(F.element_at(acc, -1)["end"], x["end"]))))).otherwise(F.concat(acc, F.array(x)))
    merged = once.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.aggregate("s", F.array().cast("array<struct<start: long, end: long>>"), reach).alias("s"), "i")
    none = lambda kind: F.array().cast(kind)
    met = first.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return met.select("doc_id", "th", "n_words", F.coalesce("s", none("array<struct<start: long, end: long>>")).alias("spans"), F.coalesce("i", none("array<string>")).alias("items"))


@stored
def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, bound: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(item_id, at, length, doc_id, start): for each suffix of each item, by its first word
    `at`, the longest run of its words found verbatim in any text, and the first place of it
    in order of doc_id and start. Suffixes without a match of LEAD words (of the shortest
    window, if that is shorter) are absent. See contamination() for nulls and scale."""
    schema = "item_id string, at long, length long, doc_id {}, start long"
    parts = _each(docs, items, window, id_col, text, item_id, item_text, bound, shard, Shard.longest, schema)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = every.groupBy("item_id", "at").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "start")).alias("m"))
    return best.select("item_id", "at", (-F.col("m.less")).alias("length"), "m.doc_id", "m.start")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no window of an item, with all their columns."""
    hit = contamination(docs, items, window, id_col, text, item_id, item_text).where("size(spans) > 0")
    d, t = fresh(docs, "hit_id"), fresh(docs, "hit_th")
    hit = hit.select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left_anti")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words: doc_id, n_words,
    n_hit, n_items, items_sha256, contaminated. Null texts have no words, null items no
    windows; see contamination()."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS g
 FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
g AS (SELECT r, p, n, array_to_string(ws[p : p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
m AS (SELECT r, p, w.n, item_id FROM g JOIN w ON w.n = g.n AND w.g = g.g),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS x FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""

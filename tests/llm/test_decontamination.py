"""Decontamination against windows looked up word by word."""

import hashlib
import random
import re

import pytest

from quillspark.llm import decontamination as D

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(docs, items, window):
    """(doc_id, n_words, hit words, items) of each row."""
    windows = []
    for name, text in items:
        if name is None:
            continue
        w = words(text)
        n = min(window, len(w))
        windows += [(w[i : i + n], str(name)) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for g, name in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    held.add(name)
        out.append((doc_id, len(w), sorted(hit), sorted(held)))
    return sorted(out, key=repr)


def found(df):
    rows = [(r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in df.collect()]
    return sorted(rows, key=repr)


def corpus(seed, n_docs=40, n_items=12):
    """Few words, so that matches of all lengths occur; passages of items inside texts."""
    rng = random.Random(seed)
    vocabulary = ["a", "B2", "ça", "Ünder", "x", "été", "7", "中"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "-", "_ ", ", "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(n_items)]
    items += [(90, items[0][1]), (91, None), (None, text(12)), (92, "..."), (5, text(14))]
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(n_docs)]
    docs += [(100 + i, text(5) + (items[i][1] or "") + text(5)) for i in range(len(items))]
    docs += [(1, docs[1][1]), (1, "a B2"), (None, text(40)), (200, None), (201, "")]
    return docs, items


SCHEMAS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("window", [10, 4])
@pytest.mark.parametrize("bound", [D.BLOCK, 40])
def test_hits_equal_brute_force(spark, window, bound):
    docs, items = corpus(window)
    d, i = (spark.createDataFrame(x, s) for x, s in zip((docs, items), SCHEMAS, strict=True))
    got = D.contamination(d, i, window, bound=bound, shard=150)
    assert found(got) == brute(docs, items, window)


def test_spans_are_maximal_and_sorted(spark):
    docs, items = corpus(3)
    d, i = (spark.createDataFrame(x, s) for x, s in zip((docs, items), SCHEMAS, strict=True))
    for bound in (D.BLOCK, 40):
        for r in D.contamination(d, i, 4, bound=bound).collect():
            assert all(s.start < s.end for s in r.spans)
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_longest_matches_equal_brute_force(spark):
    docs, items = corpus(8, 15, 6)
    items = [x for x in items if x[0] is not None]
    d, i = (spark.createDataFrame(x, s) for x, s in zip((docs, items), SCHEMAS, strict=True))
    lead = min(3, 4, *(len(words(t)) for _, t in items if words(t)))
    expected = {}
    for name, text in items:
        w = words(text)
        for at in range(len(w)):
            for doc_id, t in docs:
                v = words(t)
                for s in range(len(v)):
                    n = 0
                    while at + n < len(w) and s + n < len(v) and w[at + n] == v[s + n]:
                        n += 1
                    if n >= lead:
                        new = (-n, doc_id is not None, doc_id or 0, s)
                        expected[str(name), at] = min(new, expected.get((str(name), at), new))
    for bound in (D.BLOCK, 20):
        got = D.longest_matches(d, i, window=4, bound=bound, shard=100).collect()
        seen = {}
        for r in got:
            new = (-r.length, r.doc_id is not None, r.doc_id or 0, r.start)
            seen[r.item_id, r.at] = min(new, seen.get((r.item_id, r.at), new))
        # An id that two items have is one name here: the better match counts.
        assert seen == expected


def test_edges(spark):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus(1), SCHEMAS, strict=True))
    assert D.contamination(docs.limit(0), items).count() == 0
    none = D.contamination(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.spans or r["items"] for r in none)
    assert D.longest_matches(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.contamination(docs, items, 0)


def test_long_text_and_frequent_window(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"n{i % 977}" for i in range(300_000))
    docs = [(0, f"{long} {passage} {long} {passage}"), *((i, passage) for i in range(1, 300))]
    items = [(f"i{i:03}", passage) for i in range(50)]
    got = D.contamination(spark.createDataFrame(docs, SCHEMAS[0]), spark.createDataFrame(items, "item_id string, text string"), shard=10_000).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in got if r.doc_id < 2} == {0: [(300_000, 300_030), (600_030, 600_060)], 1: [(0, 30)]}
    assert all(r["items"] == [n for n, _ in items] for r in got)


def test_decontaminated_keeps_columns_and_clean_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [("a", 1, f"x {item} y", 5), ("b", 2, "clean text", 6), ("b", 2, None, 7), (None, 3, item.upper(), 8), ("c", 4, item[4:], 9), ("d", 5, item[8:], 1)]
    docs = spark.createDataFrame(rows, "doc_id string, th int, text string, hit_id int")
    kept = D.decontaminated(docs, spark.createDataFrame([(1, item)], SCHEMAS[1]))
    assert kept.columns == docs.columns
    assert sorted(r.hit_id for r in kept.collect()) == [1, 6, 7]


def test_query_columns(spark, tmp_path):
    docs, items = corpus(5)
    for name, rows, schema in (("documents", docs, SCHEMAS[0]), ("benchmark", items, SCHEMAS[1])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = D.op11_decontamination(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    expected = sorted(((d, n, len(h), len(i), sha(i), bool(h)) for d, n, h, i in brute(docs, items, 10)), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected

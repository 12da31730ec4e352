"""Alignment against token bytes compared one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import alignment as A
from quillspark.llm.tokens import byte_alphabet

TEXTS = [
    "Hello world, this is a test.",
    "naïve café — “quotes” and 中文字符 mixed; emoji 😀👍🏽",
    "<|endoftext|> in a text <s> </s> <unk>",
    "<|endoftext|>",
    "tabs\tand\n\nnew lines  two spaces   three ",
    " leading space",
    "　ideographic space",
    "a",
    "1234567890" * 30,
    "x" * 5000,
    "ﬁ ligature ½ ① Ⅳ",
    "é combining",
]


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(coders, text):
    """[(id, bytes)] of both sides, or none where the bytes are not those of the text."""
    a, b = coders
    if not text:
        return [], []
    back = {c: i for i, c in enumerate(byte_alphabet())}
    left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (left, right)):
        return [], []
    return left, right


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(coders, docs):
    parts = []
    for doc_id, text in docs:
        left, right = (spans(x) for x in tokens(coders, text))
        links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in left} & {y[2] for y in right})
        groups, begin = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if begin < x[2] <= e) for side in (left, right)))
            begin = e
        parts.append((doc_id, left, right, groups, links))
    counts = Counter(p for *_, links in parts for p in links)
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for doc_id, left, right, groups, links in parts:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(left), len(right), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(rows, key=repr)


def corpus():
    rng = random.Random(4)
    words = ["the", "naïve", "中文", "alignment", "of", "tokens", "Überraschung", "été", "2024", "😀", "\n", "don't"]
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(20)]
    return docs + [(3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[1]), (50, None), (51, "")]


@pytest.mark.parametrize("bound", [A.PAIRS, 0])
def test_scores_equal_brute_force(spark, coders, bound):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, uid int")
    got = A.link_scores(df, bound=bound)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    expected = brute(coders, docs)
    assert any(r[1] for r in expected) and any(not r[1] for r in expected)
    assert rows == expected


def test_links_in_order_and_groups_whole(spark, coders):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    rows = A.aligned(A.tokenised(df)).select("*", A.groups().alias("groups"), A.links().alias("links"))
    for r in rows.collect():
        left, right = (list(zip(ids, [0, *ends], ends, strict=False)) for ids, ends in ((r.a_ids, r.a_ends), (r.b_ids, r.b_ends)))
        expected = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[1] < y[2] and y[1] < x[2]]
        assert [tuple(x) for x in r.links] == expected and r.n_groups == len(r.groups)
        assert [i for g in r.groups for i in g.a] == r.a_ids and [i for g in r.groups for i in g.b] == r.b_ids
        assert all(g.a and g.b for g in r.groups)


def test_special_strings_are_plain_text(spark, coders):
    a, _ = coders
    [row] = A.tokenised(spark.createDataFrame([("x", "<|endoftext|> a <|endoftext|>")], "doc_id string, text string")).collect()
    assert row.a_ids == a.encode(" <|endoftext|> a <|endoftext|>", add_special_tokens=False).ids
    assert 50256 not in row.a_ids


def test_empty_table_and_long_text(spark, coders):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.link_scores(empty).count() == 0
    long = " ".join(f"word{i % 501}" for i in range(60_000))
    [row] = A.link_scores(spark.createDataFrame([(1, long)], empty.schema)).collect()
    left, right = (spans(x) for x in tokens(coders, long))
    ends = {x[2] for x in left} & {y[2] for y in right}
    assert tuple(row)[1:5] == (len(left), len(right), len(ends), len({x[2] for x in left} | {y[2] for y in right}))


def test_array_functions_alone_after_tokenising(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = A.aligned(A.tokenised(df)).select(A.groups(), A.groups_text(), A.linked_ids())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Python" not in plan.replace("MapInArrow", "").replace("pythonUDF", "")


def test_ids_are_those_of_the_libraries(spark, coders):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in A.tokenised(docs).collect():
        left, right = tokens(coders, texts[r.doc_id])
        assert r.a_ids == [x for x, _ in left] and r.b_ids == [x for x, _ in right]


def test_plain_numbers(spark):
    """Ends are sorted and intersected as plain numbers: no array has nulls."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = A.aligned(A.tokenised(df))
    kinds = {f.name: f.dataType for f in found.schema}
    assert not any(kinds[c].containsNull for c in ("a_ids", "a_ends", "b_ids", "b_ends", "events"))

"""Each operator against a brute-force version, on small tables with odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, groups, line_dedup, near_dedup, packing, pii, quality, repeats, sharding, tokens, url_filter, util

WORDS = ["thea", "onre", "ingha", "tion", "erst", "whand", "lyesha", "ouble", "shin", "ored", "é", "naïve,"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def texts():
    """Copies, near copies, repeated lines and passages, and odd texts."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(25)]
    out = list(base)
    for _ in range(60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 1, 1, 3])):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(9))
        out.append(" ".join(w))
    line = prose(rng, 12)
    passage = prose(rng, 70)
    out += [f"{prose(rng, 30)}\n{line}\n{prose(rng, 5)}" for _ in range(15)]
    out += [prose(rng, rng.randint(0, 40)) + passage + prose(rng, 20) for _ in range(10)]
    out += [None, "", " \t\n ", "one", "a b c d", "A B C D", "x" * 5000, "ab" * 600, "é" * 900, prose(rng, 9000), "same " * 300]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, f"s{i % 3}" if i % 7 else None, "n", 1) for i, t in enumerate(texts())]
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, source string, h string, n int")


@pytest.fixture(scope="module")
def local(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, local):
    sets = {i: shingles(t) for i, t in local.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= 85 * len(sets[a] | sets[b])]
    want = grouped(ids, links)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id) for r in got)


def test_near_duplicates_left_over(spark):
    """One crowded bucket of texts that are near the threshold: nothing is lost."""
    rng = random.Random(8)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2])):
            w[rng.randrange(len(w))] = f"q{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    want = grouped(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= 85 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


def test_registers_estimate():
    rng = np.random.default_rng(0)
    flip, times = near_dedup._constants()
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = near_dedup.registers(x[:2000], flip, times), near_dedup.registers(x[1000:], flip, times)
    both = near_dedup.registers(x, flip, times)
    assert (np.maximum(a, b) == both).all()  # registers merge
    assert abs((a == b).mean() - 1 / 3) < 0.15
    one = np.array([2000])
    assert not near_dedup.plausible(a[None], b[None], one, one)[0] and near_dedup.plausible(a[None], a[None], one, one)[0]


@pytest.fixture(scope="module")
def codec():
    return tokens.Codec(tokens.vocabulary())


def test_codec_equals_library(codec):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.vocabulary())
    rng = random.Random(2)
    odd = [t or "" for t in texts()] + ["  a  b\n\n c's 'LL x<|endoftext|>y<|endoftext|>", "日本語 x\x1c\x1dy z½²", "İstanbul\x85 "]
    odd += [s * 9000 for s in ("a", "ab", "1", "!?", " ", "\n", "日本", "ñ", "<|endoftext|>")] + ["".join(rng.choice(["the", "ing", "er", "tion", "q"]) for _ in range(9000))]
    small = tokens.Codec(tokens.vocabulary(), leaf=16)
    for t in odd:
        want = lib.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == want and codec.encode_array(t).tolist() == want
        assert codec.decode(want) == lib.decode(want, skip_special_tokens=False)
        if len(t) < 20000:
            assert small.encode(t) == want


def test_round_trip(docs, local, codec):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in tokens.round_trip(docs).collect():
        ids = codec.encode(local[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(local[r.doc_id]))
    assert tokens.encoded(docs).count() == docs.count()


def test_spread(spark, codec):
    """Parts of long texts in parallel give what one task gives."""
    rng = random.Random(7)
    odd = ["a" * 3000, "the" * 900 + " x " + "ab" * 700, prose(rng, 200), "日本" * 500, " " * 900 + "x" * 900, "<|endoftext|>" * 60 + "y" * 500, "", None, "short", "".join(rng.choice(["the", "ing", "er", "tion", "q"]) for _ in range(3000))]
    rows = [(None if i == 2 else "same", t) for i, t in enumerate(odd + odd)]
    want = Counter((d, tuple(codec.encode(t or ""))) for d, t in rows)
    got = Counter((r.doc_id, tuple(r.ids)) for r in tokens.encoded(spark.createDataFrame(rows, "doc_id string, text string"), spread=300, width=64).collect())
    assert got == want


def test_packing(docs, local, codec):
    p = packing.pack(docs.dropDuplicates(["doc_id"])).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in p:
        ids = np.array([*codec.encode(local[r.doc_id]), 1], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == local.keys()
    for spans in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
    full = [sum(n for _, n in s) for s in by_seq.values()]
    assert max(full) <= 2048 and sum(x < 2048 for x in full) <= 5
    assert packing.pack(docs.limit(0)).count() == 0


def test_line_dedup(docs, local):
    """Against edit similarity alone over all pairs of lines."""
    rows = [(d, at, line_dedup.normalised(x)) for d in sorted(local) for at, x in enumerate(local[d].split("\n"))]
    rows = [r for r in rows if r[2]]
    names = sorted({n for _, _, n in rows if len(n) >= line_dedup.SHORTEST})
    want = grouped(range(len(names)), [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if line_dedup.similar(names[i], names[j])])
    of = {n: want[i] for i, n in enumerate(names)}
    first: dict = {}
    gone = {(d, at) for d, at, n in rows if first.setdefault(of.get(n, n), (d, at)) != (d, at)}
    got = {(r.doc_id, a) for r in line_dedup.repeated_lines(docs).collect() for a in r.gone}
    assert got <= gone and len(got) >= 0.98 * len(gone) > 60


def test_line_edges(spark):
    """Null ids, one id with two texts, repeated rows, short and blank lines."""
    line = "a line that is held by several rows of this table"
    rows = [(None, f"{line}\nok"), (5, f"{line} \nother words"), (5, f"x\n{line}s"), (7, None), (8, ""), (9, "--\n--"), (9, "--\n--"), (10, "ok"), (11, "ok\nOK"), (12, "it stays"), (12, "it stays")]
    got = {(r.doc_id, r.th, tuple(r.gone)) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(d, g) for d, _, g in got} == {(5, (0,)), (5, (1,)), (10, (0,)), (11, (0, 1))} and len(got) == 4
    wide = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, gone int, id int, th int, kept_id int")
    out = line_dedup.stage(spark, wide, "")
    assert out.columns == wide.columns and out.count() == 9


def test_edits():
    rng = random.Random(6)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert line_dedup.edits(a, b) == slow(a, b)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii(spark):
    plain = ["a@b.c_d@e.f x@y.z.w@q.r", "1.2.3.4.5.6.7.8 0000.1.2.255 256.1.1.1 1.1.1.000300", "éé+1 (743) 555-3824, 4444 4444 4444 4448 5", "1 " * 9000, "a.b" * 2000 + "@c" + ".d" * 5000, "9" * 9000, None, "", "😀 4532-0151-1283-0366 +44 20 7946 0958"]
    more = ["call (415) 555-1234 or mail joe [at] corp [dot] com"]
    rows = [(i, t) for i, t in enumerate(plain + more)] + [(100 + i, f"mail me{i}@corp.com or call +1 (415) 555-{1000 + i}") for i in range(30)]
    got = {r.doc_id: (r.base, r.spans) for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans")).collect()}
    for i, t in rows:
        assert got[i][0] == base_spans(t or "")
        assert i == len(plain) or got[i][0] == got[i][1]
    assert got[len(plain)][1] == "phone:5:19,email:28:51"


def test_url_filter(spark):
    urls = ["http://www.Example.com/en/x?q", "https://example.com/en/", "http://com/", "http://a.net/fr/1#x", "http://x.org", "http://example.com", None, "no", "://", "http://notexample.com/en/", "http://m.www.example.com/en/a", "http://a.com?x/en/", "http://net/es/"]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rules_frame(spark)).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def marked(texts_, seen_first):
    """For each text the bytes that a 400-byte string of another place covers - with
    seen_first, of an earlier place only."""
    places = defaultdict(list)
    for d, b in enumerate(texts_):
        for i in range(len(b) - 399):
            places[b[i : i + 400]].append((d, i))
    marks = [np.zeros(len(b), bool) for b in texts_]
    for found in places.values():
        for d, i in found[seen_first:] if len(found) > 1 else []:
            marks[d][i : i + 400] = True
    return marks


@pytest.mark.parametrize("crowd", [1, repeats.CROWD])
@pytest.mark.parametrize("first", [False, True])
def test_repeats(docs, first, crowd):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.dropDuplicates(["doc_id"]).collect())
    got = {r.doc_id: r for r in repeats.removed(docs.dropDuplicates(["doc_id"]), first=first, crowd=crowd).collect()}
    for (d, b), mark in zip(rows, marked([b for _, b in rows], first), strict=True):
        n = int((mark & ~np.concatenate(([False], mark[:-1]))).sum()) if len(b) else 0
        rest = bytes(np.frombuffer(b, np.uint8)[~mark])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), int(mark.sum()), n, hashlib.sha256(rest).hexdigest())


def test_repeats_edges(spark):
    """Null ids, string ids, one id with two texts, repeated rows."""
    rng = random.Random(5)
    passage, one = prose(rng, 80), prose(rng, 90)
    rows = [(None, one), ("a", one), ("b", prose(rng, 10) + passage), ("b", passage + prose(rng, 10)), ("c", passage), ("c", passage), ("d", None), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.removed(docs).collect())
    want = Counter((d, len((t or "").encode()), int(m.sum())) for (d, t), m in zip(rows, marked([(t or "").encode() for _, t in rows], False), strict=True))
    assert got == want and sum(m for (_, _, m), _ in got.items()) > 2000


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n, k in ((1, 2), (300, 2), (500, 1), (400, 4)):
        raw = rng.integers(0, k, n).astype(np.uint8)
        order = repeats.suffix_order(raw, 64).tolist()
        names = [raw[i : i + 64].tobytes() for i in order]
        assert names == sorted(names) and sorted(order) == list(range(n))
        assert repeats.suffix_order(raw, n).tolist() == sorted(range(n), key=lambda i: raw[i:].tobytes())
        w = np.array([hash(raw[i : i + 9].tobytes()) for i in order])[None]
        seen = repeats.matched(np.array(order)[None], np.zeros((1, n), int), w, True)[0]
        assert all(seen[k] == any(raw[j : j + 9].tobytes() == raw[i : i + 9].tobytes() for j in range(i)) for k, i in enumerate(order))


def jump(key, shards):
    """The published loop, with the operator's draws."""
    b, j, step = -1, 0, 1
    while j < shards:
        b = j
        draw = int(hashlib.md5(f"{step}:{key}".encode()).hexdigest()[:8], 16) >> 1
        j, step = int((b + 1) * float(1 << 31) / (draw + 1)), step + 1
    return b


def test_sharding(docs, local):
    a = sharding.assign(docs, 40).collect()
    assert len(a) == docs.count()
    for r in a:
        t = local[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(t) + 16, zlib.crc32(t), jump(r.doc_id, 40), jump(r.doc_id, 41))
        assert r.grown_shard in (r.shard, 40)
    for s in {r.shard for r in a}:
        assert sorted(r.slot for r in a if r.shard == s) == list(range(sum(r.shard == s for r in a)))
    many = docs.sparkSession.range(20000).selectExpr("id AS doc_id", "CAST(null AS string) AS text")
    sizes = Counter(r.shard for r in sharding.assign(many, 40).collect())
    assert len(sizes) == 40 and max(sizes.values()) < 650 and min(sizes.values()) > 380
    odd = docs.sparkSession.createDataFrame([(None, "x"), ("a", None), ("a", "y")], "doc_id string, text string")
    assert Counter(r.doc_id for r in sharding.assign(odd).collect()) == {None: 1, "a": 2}


def line_name(x):
    return re.sub(r"[^\w]+", " ", re.sub(r"\d", "0", x.lower())).replace("_", " ").strip()


def test_quality(docs, local):
    rows = {r.doc_id: (r.text or "", r.source) for r in docs.collect()}
    held, hosts = defaultdict(dict), defaultdict(set)
    for d, (t, h) in rows.items():
        hosts[h].add(t)
        for x in t.split("\n"):
            if x.strip():
                held[h, line_name(x)].setdefault(t, []).append(d)
    often = {k: min(map(min, v.values())) for k, v in held.items() if len(v) > max(quality.LEAST, quality.SHARE * len(hosts[k[0]]))}
    touched = 0
    for r in quality.judge(docs).collect():
        t, h = rows[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = Counter(windows)
        repeated = {p for i, x in enumerate(windows) if twice[x] > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        gone = [x for x in lines if often.get((h, line_name(x)), r.doc_id) != r.doc_id]
        total, lost = sum(map(len, lines)), sum(map(len, gone))
        touched += bool(gone)
        assert len(r.frequent) == len({line_name(x) for x in gone})
        assert r.kept == (not r.base_failed and not (gone and total - lost < quality.KEEP * total))
    assert touched > 5
    rng = random.Random(1)
    common = prose(rng, 40)
    rows = [(i, f"{prose(rng, 25 if i % 2 else 200)}\n{common}\n{common}", "s") for i in range(80)]
    out = {r.doc_id: (r.kept, len(r.frequent)) for r in quality.judge(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string"), keep_share=0.5).collect()}
    assert out[0] == (True, 0) and out[2] == (True, 1) and out[3] == (False, 1)


def test_quality_stage(spark):
    """Rows of one id with two texts, repeated rows, null ids and hosts, clashing columns."""
    rng = random.Random(2)
    menu = "menu " + prose(rng, 24)
    rows = [(i, f"{prose(rng, 30)}\n{menu}", "s") for i in range(6)] + [(7, f"x y\n{menu}", "s"), (8, prose(rng, 30), None), (None, prose(rng, 30), None), (8, "short", None), (9, None, "s"), (0, f"{prose(rng, 30)}\n{menu}", "s")]
    rows.append(rows[8])
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, d2 int, frequent int, id int, th int")
    out = quality.stage(spark, docs, "")
    got = sorted(((r.doc_id is None, r.doc_id or 0, "menu" in r.text) for r in out.collect()))
    assert out.columns == docs.columns
    assert got == [(False, 0, True), (False, 0, True), (False, 1, False), (False, 2, False), (False, 3, False), (False, 4, False), (False, 5, False), (False, 8, False), (True, 0, False), (True, 0, False)]


def nearest(rows, every=20, k=20):
    """Exact lists of all queries, by numpy."""
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for q, x in good:
        if q % every == 0:
            out[q] = sorted((-float(v @ x), i) for i, v in good if i != q and len(v) == len(x))[:k]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    x[100:140] = x[99]
    as_kind = np.float32 if kind == "float" else np.float64
    rows = [(i, [float(as_kind(v)) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (5061, [-2.0]), (5080, []), (5100, [None] * 16)]
    rows += [(6000 + i, [float(as_kind(v)) for v in rng.normal(size=3)]) for i in range(90)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = nearest(rows)
    assert sorted(got) == sorted(want) and len(got[5060]) == 1
    hits = total = 0
    for q, found in got.items():
        exact = dict((i, s) for s, i in nearest([r for r in rows if r[0] == q or r[0] in {i for _, i in found}])[q])
        assert found == sorted(found) and len(found) == len(want[q]) and all(s == pytest.approx(exact[i], abs=1e-12) for s, i in found)
        hits += len({i for _, i in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits >= 0.95 * total


def test_nearest_small(spark):
    """Repeated ids, ties to the smaller id, fewer candidates than asked for."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [9.0, 9.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank", "vec_id").collect()]
    assert sorted(got) == sorted([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 1, 2, 0.0), (0, 2, 3, 0.0)])


def test_empty_tables(docs):
    none = docs.limit(0)
    assert near_dedup.near_duplicates(none).count() == 0 and line_dedup.repeated_lines(none).count() == 0
    assert repeats.removed(none).count() == 0 and pii.find_spans(none).count() == 0 and quality.judge(none).count() == 0
    assert tokens.round_trip(none).count() == 0 and sharding.assign(none).count() == 0
    assert url_filter.judge(none.selectExpr("doc_id AS page_id", "text AS url"), url_filter.rules_frame(none.sparkSession)).count() == 0
    for stage in (quality.stage, line_dedup.stage, near_dedup.stage, pii.stage, packing.stage):
        assert stage(none.sparkSession, none.withColumn("n_chars", none.n), "").count() == 0
    assert ann.search(none.selectExpr("doc_id AS vec_id", "CAST(null AS array<float>) AS embedding")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS bigint) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in new.collect()}
        assert after.keys() <= before.keys() and after
        if k < 4:
            assert new.columns == columns and new.count() == len(after)
        if name == "quality_rules":
            assert after.keys() == {r.doc_id for r in quality.judge(now).where("kept").collect()}
        if name == "near_dedup":
            assert after.keys() == {r.doc_id for r in near_dedup.near_duplicates(now).where("kept").collect()}
        if name in ("pii", "packing"):
            assert after.keys() == before.keys()
        now = new


def near_lines(rng):
    """Lines of many lengths with copies of up to a tenth of edits: words or single letters."""
    out = []
    for n in (3, 4, 5, 6, 8, 10, 15, 30, 60, 100):
        for _ in range(12):
            w = [rng.choice(WORDS) + rng.choice(WORDS) + chr(rng.randrange(97, 123)) for _ in range(n)]
            out.append(" ".join(w))
            w[rng.randrange(n)] = rng.choice(WORDS) + "qz"
            out.append(" ".join(w))
            x = list(" ".join(w))
            x[rng.randrange(len(x))] = "k"
            out.append("".join(x))
    return out


def test_line_recall(spark):
    """Against edit similarity alone: no SimHash, no keys."""
    lines = near_lines(random.Random(12)) + ["ab " * 90 + "one", "ab " * 90 + "two q"]
    names = [line_dedup.normalised(x) for x in lines]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if line_dedup.similar(names[i], names[j])]
    want = grouped(range(len(names)), pairs)
    gone = {i for i, g in want.items() if i != g}
    got = {r.doc_id for r in line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got <= gone and len(gone) > 150 and len(got) >= 0.98 * len(gone)


def test_line_buckets(spark, monkeypatch):
    """Buckets of two are paired at once and larger ones settled; the groups are those of all pairs."""
    rng = random.Random(17)
    bases, lines = [prose(rng, 30) for _ in range(3)], []
    for _ in range(150):
        w = rng.choice(bases).split(" ")
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + rng.choice(WORDS)
        lines.append(" ".join(w))
    names = [line_dedup.normalised(x) for x in lines]
    want = grouped(range(len(names)), [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if line_dedup.similar(names[i], names[j])])
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    found = line_dedup.buckets(util.cut(line_dedup.occurrences(docs, "doc_id", "text"), "test"))
    assert found.where("key is null").count() > 0 and found.where("key is not null").count() > 0
    got = {r.doc_id for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {i for i, g in want.items() if i != g}


@pytest.mark.parametrize("easy", [True, False])
def test_line_batches(easy, monkeypatch):
    """Pairs compared side by side give what each gives alone: lengths mixed, edits around
    the limit, letters beyond 16 bits; nearly all of them go through the batch."""
    rng, pairs = random.Random(23), []
    for signs in ("ab", "abcdefgh ", "abв😀x"):
        for n in (16, 40, 90, 400):
            for _ in range(60):
                x = [rng.choice(signs) for _ in range(n + rng.randrange(9))]
                y = list(x)
                for _ in range(rng.randrange(len(x) // 5)):
                    y[rng.randrange(len(y))] = rng.choice(["", rng.choice(signs), rng.choice(signs) * 2])
                pairs.append(tuple(rng.sample(["".join(x), "".join(y)], 2)))
    want = [line_dedup.similar(*p) for p in pairs]
    alone, slow = [], line_dedup.edits
    monkeypatch.setattr(line_dedup, "edits", lambda *x: alone.append(x) or slow(*x))
    assert line_dedup.all_similar(*zip(*pairs, strict=True), easy=easy).tolist() == want
    assert 100 < sum(want) < len(want) - 100 and len(alone) < len(pairs) // 10
    assert line_dedup.all_similar([], []).tolist() == []


def test_line_packs(spark):
    """A line's keys are stored packed, 6 bytes each, and no row of their own."""
    docs = spark.createDataFrame([(i, prose(random.Random(i), 40)) for i in range(300)], "doc_id long, text string").repartition(3)
    rows = line_dedup.occurrences(docs, "doc_id", "text").where("keys is not null").collect()
    n = sum(np.frombuffer(r.sizes, np.uint32).sum() for r in rows)
    assert len(rows) <= 3 and sum(len(r.lines) for r in rows) == 8 * 300
    assert n >= 300 * line_dedup.LONG[1] and sum(len(r.parts) + len(r.keys) for r in rows) == 6 * n


def test_line_lists():
    lines = ["Ab  ΑΣ 12", "", "x" * 300 + "é", "ς – “q”"]
    names = line_dedup.normalised("\n".join(lines)).split("\n")
    assert names == [line_dedup.normalised(x) for x in lines]
    assert line_dedup.all_counts(names) == [line_dedup.letter_counts(x) for x in names]


def test_settle_chain(spark):
    """Buckets that chain up are taken one by one: no group of all of them, whose blocks grow
    with its square."""
    rows = [(k, i, 2 * k) for k in range(200) for i in (2 * k, 2 * k + 1, 2 * k + 2)]
    sizes = []

    def rest(members):
        sizes.extend(r["count"] for r in members.groupBy("key").count().collect())
        return members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)

    check = lambda pairs: pairs.where("a = 0 and b = 2")
    label = groups.settle(spark.createDataFrame(rows, "key long, id long, hub long"), check, rest, spark.createDataFrame([(0, 2)], "a long, b long"), clustered=False)
    assert {tuple(r) for r in label.collect()} == {(0, 0), (2, 0)} and len(sizes) == 200 and max(sizes) == 3


@pytest.mark.parametrize("share, least", [(0.03, 0.95), (0.05, 0.9), (0.08, 0.4)])
@pytest.mark.parametrize("n", [20, 40, 70, 80, 120, 300, 1000])
def test_line_scattered(n, share, least):
    """Letters changed, lost and added all over the line leave a common key; lengths and
    letter counts never rule a similar pair out."""
    rng, hasher, found = random.Random(n), line_dedup.Hasher(), []
    while len(found) < 200:
        x = prose(rng, n // 3)[:n].strip()
        y = list(x)
        for at in rng.sample(range(len(y)), max(1, int(len(y) * share))):
            y[at] = rng.choice([rng.choice("abcdefghijklmnopqrstuvwxyz"), "", y[at] + "e"])
        x, y = line_dedup.normalised(x), line_dedup.normalised("".join(y))
        if x != y and min(len(x), len(y)) >= line_dedup.SHORTEST and line_dedup.similar(x, y):
            _, _, _, of, keys = line_dedup.line_facts([x, y], hasher)
            found.append(bool(set(keys[of == 0]) & set(keys[of == 1])))
            counts = [np.frombuffer(line_dedup.letter_counts(t), np.uint8) for t in (x, y)]
            assert line_dedup.within((np.array(len(x)), np.array(len(y))), tuple(counts))
    assert np.mean(found) >= least


def test_nearest_ids(spark):
    """Ids that are no integers are refused, not lost."""
    with pytest.raises(TypeError, match="integer"):
        ann.search(spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<double>"))


def test_scratch_after_error(spark):
    """An operator that raises, itself or in its last job, leaves no table behind."""
    folder = util.scratch(spark)
    held = lambda: sorted(os.listdir(folder)) if os.path.isdir(folder) else []

    @util.stored
    def broken(docs, late):
        util.cut(docs, "inner")
        if not late:
            raise ValueError("no")
        return docs.select(F.raise_error(F.lit("no")).alias("x"))

    before = held()
    for late in (False, True):
        with pytest.raises(Exception, match="no"):
            broken(spark.range(3), late)
    assert held() == before


def test_line_gaps():
    """Any one stretch of edits of up to a tenth in a short line leaves a common key."""
    rng, hasher = random.Random(3), line_dedup.Hasher()
    for n in range(16, line_dedup.GAP):
        for _ in range(12):
            x = "".join(rng.choice("abcdefghij") for _ in range(n))
            at, k = rng.randrange(n), max(1, n // 10)
            y = (x[:at] + "".join(rng.choice("klm") for _ in range(rng.randint(0, k))) + x[at + rng.randint(0, k) :]).strip()
            if x != y and min(len(x), len(y)) >= line_dedup.SHORTEST and line_dedup.similar(x, y):
                _, _, _, of, keys = line_dedup.line_facts([x, y], hasher)
                assert set(keys[of == 0]) & set(keys[of == 1]), (x, y)


def test_line_signs(spark):
    rows = [(1, "It’s “quoted” – with ٣ signs here"), (2, "it's 'quoted' - with 3 signs here!"), (3, "Другая строка, с буквами")]
    got = [r.doc_id for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [2]


def test_pii_disguised(spark):
    """Each form of the pattern, alone in its text."""
    forms = ["jane [at] example.com", "jane(at)example.com", "jane {AT} example.com", "jane[@]example.co.uk", "jane (at) example [dot] com", "jane at example dot com", "jane at example.com"]
    rows = [(i, f"so {t} now") for i, t in enumerate(forms)] + [(50, "it is sold at noon. That is all")]
    rows += [(100 + i, f"mail me{i}@corp.com or call +1 (415) 555-{1000 + i}") for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    assert [got[i] for i in range(len(forms))] == [f"email:3:{3 + len(t)}" for t in forms]
    assert got[50] == ""


def test_libraries():
    """The pattern without look ahead is taken where no spaces meet and no piece is long, and
    gives the ids of the whole tokenizer."""
    from tokenizers import Tokenizer

    rng, coder, whole = random.Random(21), tokens.Codec(tokens.vocabulary(), leaf=16), Tokenizer.from_file(tokens.vocabulary())
    taken = Counter()
    for _ in range(600):
        t = "".join(rng.choice(["a", "lye", "é", "7", "42", ",", "'s", "'", " ", " ", "\n", "\xa0", "x" * rng.randint(1, 20), "  "][: rng.choice([12, 13, 14])]) for _ in range(rng.randint(0, 40)))
        found = coder.library(t)
        long = max(map(len, re.findall(r"\S+|\s+", t)), default=0) >= 16
        assert (found is None) == long or not long and found is coder.fast
        assert found is not coder.quick or not re.search(r"\s\s", t)
        assert coder.encode_array(t).tolist() == whole.encode(t, add_special_tokens=False).ids
        taken["quick" if found is coder.quick else "fast" if found else "none"] += 1
    assert all(taken[k] > 20 for k in ("quick", "fast", "none"))


def test_packing_order():
    """All terms and all neighbours count: one window, so the first document orders the rest."""
    rng = np.random.default_rng(5)
    ids = [np.append(rng.integers(10, 90, rng.integers(20, 60)), 1).astype(np.uint32) for _ in range(120)]
    ids[0] = np.append(np.arange(10, 80), 1).astype(np.uint32)
    got = [d for d, _ in packing.order(ids, packing.Packer(0, 1 << 20))]
    bags, mean = [Counter(x[:-1].tolist()) for x in ids], sum(map(len, ids)) / len(ids)
    df = Counter(t for b in bags for t in b)

    def score(d):
        norm = packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean)
        return sum(np.log1p((120 - df[t] + 0.5) / (df[t] + 0.5)) * bags[d][t] * (packing.K1 + 1) / (bags[d][t] + norm) for t in bags[0])

    assert got == [0, *sorted(range(1, 120), key=lambda d: (-score(d), d))]


def test_line_stage(spark):
    """Lines go, documents only when no word is left."""
    rng = random.Random(9)
    shared = [prose(rng, 40) for _ in range(6)]
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared, prose(rng, 8)])), (3, "\n".join(shared)), (4, None), (5, shared[0] + "\n \n"), (6, "ok\n" + shared[1])]
    now = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.stage(spark, now, "").collect()}
    unique = rows[1][1].split("\n")[-1]
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (unique, len(unique)), 4: (None, None), 6: ("ok", 2)}


def test_line_chance(spark):
    """Lines that quote one passage at other places share keys, but are no pairs; pairs of a
    few edits stay pairs."""
    rng, lines = random.Random(31), []
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    for _ in range(40):
        passage, rest = words(30), [words(20) for _ in range(4)]
        lines += [f"{passage} {rest[0]}", f"{rest[1]} {passage}"]
        x = list(f"{rest[2]} {passage} {rest[3]}")
        lines.append("".join(x))
        x[rng.randrange(len(x))] = x[rng.randrange(len(x))] = "k"
        lines.append("".join(x))
    names = dict(zip(*(line_dedup.line_facts(lines, line_dedup.Hasher())[i].tolist() for i in (2, 0)), strict=True))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    pairs = {tuple(sorted((names[r.a], names[r.b]))) for r in line_dedup.buckets(util.cut(line_dedup.occurrences(docs, "doc_id", "text"), "test")).collect()}
    assert pairs == {(i + 2, i + 3) for i in range(0, len(lines), 4)}


def test_least_edits():
    rng = random.Random(8)
    for n in (1, 2, 3, 20, 200):
        pairs = []
        for _ in range(40):
            x = [rng.choice("abc 😀") for _ in range(n)]
            y = [rng.choice(["", c, c, c, c + "b", "c"]) for c in x]
            pairs.append(("".join(x), "".join(y)))
        assert all(k <= line_dedup.edits(*p) for k, p in zip(line_dedup.least_edits(pairs), pairs, strict=True))
    assert line_dedup.least_edits([("abcd" * 30, "efgh" * 30)])[0] >= 35


def test_joined(spark):
    """Further links join components without another run over the old links."""
    rng = random.Random(2)
    old, new = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 12))
    frame = lambda links: spark.createDataFrame([p for p in links if p[0] != p[1]], "a long, b long")
    got = {r.id: r.component_id for r in groups.joined(util.components(frame(old)), frame(new)).collect()}
    assert got == {r.id: r.component_id for r in util.components(frame(old + new)).collect()}

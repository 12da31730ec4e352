"""Behaviours of the retrieval operators on small tables."""

import json
import math
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.functions import splits
from quillspark.functions import text as T
from quillspark.operators import chunks as C
from quillspark.operators import elements as E
from quillspark.operators import evaluation as M
from quillspark.operators import fusion as R
from quillspark.operators import lexical as B
from quillspark.operators import vectors as D
from quillspark.operators.vector_table import VectorTable
from quillspark.operators import workflow as W
from quillspark.sources import io

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, paper_id string, kind string, text string")


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def ids(hits):
    return [r.chunk_id for r in hits.orderBy("query_id", "rank").collect()]


def test_tokens(spark):
    row = spark.createDataFrame([("<td>A&amp;B</td> \\theta école 3.14 中文 &lt;td&gt; x-1_y",)], "t string").select(T.tokenize(F.col("t")).alias("k")).first()
    assert row.k == ["a", "b", "\\theta", "cole", "3.14", "中", "文", "td", "x-1_y"]


def test_normalize(spark):
    rows = [("  a \t b \r\n\n\n\n c &amp;amp; \x1c",), ("",), (None,)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(T.normalize(F.col("t")).alias("n")).collect()]
    assert got == ["a b\n\nc &amp;", "", None]


def test_bm25(spark):
    c = chunks(spark, [("a", "p", "text", "common common rare"), ("b", "p", "text", "common"), ("c", "q", "equation", "common word")])
    assert ids(B.search(ask(spark, "rare"), c, F.col("text"))) == ["a"]
    assert ids(B.search(ask(spark, "common"), c, F.col("text"), where=(F.col("paper_id") == "q") & (F.col("kind") == "equation"))) == ["c"]
    assert ids(B.search(ask(spark, "", "unseen"), c, F.col("text"))) == []
    assert ids(B.search(ask(spark, "common"), c.limit(0), F.col("text"))) == []
    for bad in ({"top_k": 0}, {"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            B.search(ask(spark, "x"), c, F.col("text"), **bad)


def test_cosine(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0]), ("n", [-1.0, 0.0])], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    hits = D.search(q, rows).orderBy("rank").collect()
    assert [(h.chunk_id, round(h.score, 6)) for h in hits] == [("a", 1.0), ("b", 0.6), ("z", 0.0), ("n", -1.0)]


class Fake:
    model_name, dimension = "fake", 2

    def encode_documents(self, texts):
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    encode_queries = encode_documents


def test_encoder_and_vector_table(spark, tmp_path):
    c = chunks(spark, [("a", "p", "text", "two words"), ("b", "p", "text", "one")])
    v = D.encode(c, F.col("text"), Fake())
    table = VectorTable(spark, str(tmp_path / "v"), "fake", 2)
    assert table.read() is None
    assert table.upsert(v) == 2
    assert table.upsert(v.where("chunk_id = 'a'").withColumn("text", F.lit("new"))) == 1
    assert {(r.chunk_id, r.text) for r in table.read().collect()} == {("a", "new"), ("b", "one")}
    with pytest.raises(ValueError):
        VectorTable(spark, str(tmp_path / "v"), "fake", 3)
    three = Fake()
    three.dimension = 3
    with pytest.raises(Exception, match="dimension mismatch"):
        D.encode(c, F.col("text"), three).collect()


def ranked(spark, *names):
    return spark.createDataFrame([("q", n, 1.0, i + 1) for i, n in enumerate(names)], "query_id string, chunk_id string, score double, rank int")


def test_fusion(spark):
    lists = ranked(spark, "a", "b").withColumn("list_id", F.lit(0)).unionByName(ranked(spark, "b", "c").withColumn("list_id", F.lit(1)))
    assert R.rrf(lists).orderBy(F.desc("score"), "chunk_id").first().chunk_id == "b"
    both = R.hybrid(ranked(spark, "k3", "k1", "k9"), ranked(spark, "k7", "k8", "k1")).orderBy("rank").collect()
    assert [(h.chunk_id, h.sparse_rank, h.dense_rank) for h in both] == [("k1", 2, 3), ("k3", 1, None), ("k7", None, 1), ("k8", None, 2), ("k9", 3, None)]
    one = R.hybrid(ranked(spark, "a"), ranked(spark, "b")).orderBy("rank").collect()
    assert [(h.chunk_id, h.sparse_rank, h.dense_rank) for h in one] == [("a", 1, None), ("b", None, 1)]


def test_rerank(spark):
    rows = ranked(spark, "a", "b", "c").withColumn("text", F.repeat("chunk_id", F.when(F.col("chunk_id") == "c", 9).otherwise(4))).withColumn("query", F.lit("q"))
    good = R.scorer(lambda q, docs: [float(len(d)) for d in docs])
    out = R.rerank(rows, good(F.col("query"), F.col("text"))).orderBy("rank").collect()
    assert [(h.chunk_id, h.retrieval_rank) for h in out] == [("c", 3), ("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="one score per candidate"):
        R.rerank(rows, R.scorer(lambda q, docs: [])(F.col("query"), F.col("text"))).collect()


def test_metrics(spark):
    hits = ranked(spark, "k7", "k2", "k5", "k9", "k4", "k1")
    cases = spark.createDataFrame([("q", ["k2", "k9", "k2", "k1", "k8"]), ("none", [])], "query_id string, relevant array<string>")
    got = {r.query_id: r for r in M.case_metrics(cases, hits).collect()}
    assert got["q"].recall_at_1 == 0 and got["q"].recall_at_5 == 0.5 and got["q"].reciprocal_rank == 0.5
    gain = lambda *ranks: sum(1 / math.log2(r + 1) for r in ranks)
    assert got["q"].ndcg_at_5 == pytest.approx(gain(2, 4) / gain(1, 2, 3, 4))
    assert got["none"].recall_at_1 == 1 and got["none"].ndcg_at_5 == 1 and got["none"].reciprocal_rank == 0
    with pytest.raises(Exception, match="at least one"):
        M.macro(M.case_metrics(cases.limit(0), hits)).collect()


def test_selection(spark):
    pick = lambda v, n: spark.createDataFrame([(v, n)], "v string, n int").select(M.selection(F.col("v"), F.col("n")).alias("p")).first().p
    assert pick("2, 6-8,7,", 8) == [2, 6, 7, 8]
    for bad in (("1,4", 3), ("3-1", 5), ("0", 2)):
        with pytest.raises(Exception, match="selection|descending"):
            pick(*bad)


ITEMS = [
    {"type": "text", "text": "Title", "text_level": 1, "page_idx": 0, "bbox": [0, 0, 1, 1]},
    {"type": "text", "text": "Method", "text_level": 2, "page_idx": 0},
    {"type": "text", "text": "  padded   text  ", "page_idx": 0},
    {"type": "interline_equation", "latex": "x=1", "page_idx": 1},
    {"type": "image", "image_caption": ["Fig", "one"], "img_path": "a.png", "page_idx": 1},
    {"type": "header", "text": "skip", "page_idx": 1},
    {"type": "chart", "img_path": "c.png", "page_idx": 1},
    {"type": "table", "table_caption": ["Cap"], "table_body": "<table/>", "page_idx": 1},
    "no object",
    {"type": "text", "text": " "},
]


def items(spark, rows):
    return spark.createDataFrame([("p", i, json.dumps(x)) for i, x in enumerate(rows)], "paper_id string, source_index int, item string")


def test_parse(spark, tmp_path):
    e = E.parse(items(spark, ITEMS)).orderBy("seq").collect()
    assert [x.content for x in e] == ["Title", "Method", "padded text", "x=1", "Fig\none", "Image: c.png", "Cap\n\n<table/>"]
    assert [x.page for x in e] == [1, 1, 1, 2, 2, 2, 2]
    assert e[3].section_path == ["Title", "Method"] and e[1].parent_id == e[0].element_id and e[2].parent_id == e[1].element_id
    assert e[0].prev_id is None and e[0].next_id == e[1].element_id and e[0].bbox.x2 == 1.0
    assert E.papers(E.parse(items(spark, ITEMS))).first().title == "Title"
    for bad in ({"page_idx": -1}, {"page_idx": True}, {"bbox": [1, 0, 0, 1]}, {"bbox": [1]}):
        with pytest.raises(Exception, match="invalid"):
            E.parse(items(spark, [{"type": "text", "text": "x"} | bad])).collect()
    (tmp_path / "f_content_list.json").write_text(json.dumps(ITEMS))
    path = io.locate_items(spark, str(tmp_path), "f")
    assert E.parse(io.parser_items(spark, path, "p")).count() == 7


def fold(levels):
    """Headings in force, one element at a time."""
    stack, out = {}, []
    for i, level in enumerate(levels):
        if level:
            stack = {k: v for k, v in stack.items() if k < level}
        path = [stack[k] for k in sorted(stack)]
        if level:
            stack[level] = i
            path.append(i)
        out.append(path)
    return out


def test_sections_random(spark):
    rng = random.Random(1)
    papers = [[rng.choice([None, None, 1, 2, 3]) for _ in range(40)] for _ in range(10)]
    rows = [(str(p), i, v, str(i), str(i)) for p, x in enumerate(papers) for i, v in enumerate(x)]
    got = {(r.paper_id, r.seq): r.section_path for r in E.sections(spark.createDataFrame(rows, "paper_id string, seq int, text_level int, content string, element_id string")).collect()}
    assert all(got[str(p), i] == list(map(str, path)) for p, x in enumerate(papers) for i, path in enumerate(fold(x)))


def elements(spark, rows):
    full = [("p", i, f"e{i}", 1, kind, content, level, section, excluded) for i, (kind, content, level, section, excluded) in enumerate(rows)]
    return spark.createDataFrame(full, "paper_id string, seq int, element_id string, page int, element_type string, content string, text_level int, section_path array<string>, retrieval_excluded boolean")


def test_chunks(spark):
    s = ["T", "M"]
    e = elements(spark, [("paragraph", "M", 2, s, False), ("paragraph", "with $x_t$", None, s, False), ("equation", "x=1", None, s, False), ("paragraph", "after", None, s, False), ("table", "<table/>", None, s, False), ("figure", "Fig", None, s, False), ("paragraph", "foot", None, s, True)])
    c = C.chunk(e)
    got = {r.content: r for r in c.collect()}
    assert {k: r.kind for k, r in got.items()} == {"with $x_t$": "text", "x=1": "equation", "after": "text", "<table/>": "table", "Fig": "figure"}
    assert got["x=1"].context == "with $x_t$\n\nafter" and got["with $x_t$"].contains_inline_latex and not got["after"].contains_inline_latex
    assert M.integrity(c, C.parents(e), e).count() == 0
    with pytest.raises(ValueError):
        C.chunk(e, max_chars=100)


def packed(rows, limit, overlap):
    """The same groups, one row at a time."""
    size = lambda b: sum(n + 2 for _, n, _ in b)
    out, buf = [], []
    for row in rows:
        if buf and (buf[-1][2] != row[2] or size(buf) + row[1] > limit):
            tail = buf[-overlap:] if overlap else []
            out.append(buf)
            buf = tail if size(tail) + row[1] <= limit else []
        buf = [*buf, row]
    return [[i for i, _, _ in g] for g in [*out, buf] if g]


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_pack_random(spark, overlap):
    rng = random.Random(overlap)
    rows = [(i, rng.randint(1, 200), rng.choice("aab")) for i in range(300)]
    df = spark.createDataFrame([("p", i, f"e{i}", 1, "x" * n, [s]) for i, n, s in rows], "paper_id string, seq int, element_id string, page int, content string, section_path array<string>")
    got = sorted([m.seq for m in r.members] for r in C.text_groups(df, ["paper_id"], 260, overlap).collect())
    assert got == sorted(packed(rows, 260, overlap))


def test_splits():
    parts = splits.prose_parts("One short sentence here. " * 100, 220)
    assert len(parts) > 1 and all(len(p) <= 220 for p in parts) and " ".join(parts) == ("One short sentence here. " * 100).strip()
    assert splits.prose_parts("x" * 500, 200) == ["x" * 200, "x" * 200, "x" * 100]
    table = "Cap\n<table><tr><td>H</td></tr>" + "".join(f"<tr><td>{i:070d}</td></tr>" for i in range(12)) + "</table>"
    cut = splits.table_parts(table, 300)
    assert len(cut) > 1 and all(p.startswith("Cap\n\n<table><tr><td>H</td></tr>") and p.endswith("</table>") and len(p) <= 300 for p in cut)


def test_findings_and_duplicates(spark):
    rows = [("c1", "supported", [], 0.5), ("c2", "insufficient", [], 2.0), ("c3", "supported", ["e"], 1.0)]
    f = spark.createDataFrame(rows, "claim_id string, verdict string, evidence_ids array<string>, confidence double")
    assert {(r.rule, r.key) for r in M.violations(f, "claim_id", M.finding_rules()).collect()} == {("supported_needs_evidence", "c1"), ("confidence_range", "c2")}
    cases = spark.createDataFrame([("a", "Why? ", None), ("b", "why?", None), ("a", "x", "p")], "query_id string, query string, paper_id string")
    assert {(r.rule, r.key) for r in M.duplicate_cases(cases).collect()} == {("query_id", "a"), ("query", "why?")}


def test_splits_random():
    """The rule, looked up anew for each part of random texts."""

    def slow(text, limit):
        text = text.strip()
        if len(text) <= limit:
            return [text] if text else []
        head = text[: limit + 1]
        fine = [limit]
        for kind in (splits.BLANK, splits.SENTENCE, splits.CLAUSE):
            for m in re.finditer(kind, head):
                signs = len(re.findall(r"(?<!\\)\$", head[: m.end()]))
                if m.end() >= limit // 2 and signs % 2 == 0:
                    fine.append(m.end())
        at = max(fine[1:], default=limit)
        return [text[:at].strip(), *slow(text[at:], limit)]

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b c", ".", " ", "; ", "\n", "\n\n", "$", "\\$", "? ", "\\", "  "]) for _ in range(rng.randint(0, 50)))
        limit = rng.randint(2, 25)
        assert splits.prose_parts(text, limit) == slow(text, limit)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_cases(spark, tmp_path):
    path = str(tmp_path / "cases.json")
    assert io.read_cases(spark, path).count() == 0
    cases = spark.createDataFrame([(f"q{i}", f"t\n{i}", [f"c{i}", "d"], None if i % 2 else "p", None, "x", "", "", "") for i in range(5)], io.CASE)
    for some in (cases.limit(0), cases, cases.where("query_id <> 'q3'"), cases):
        io.write_cases(some, path)
        assert rows_of(io.read_cases(spark, path)) == rows_of(some)
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["cases.json"]
    (tmp_path / "array.json").write_text(json.dumps([r.asDict() for r in cases.collect()], indent=2))
    assert rows_of(io.read_cases(spark, str(tmp_path / "array.json"))) == rows_of(cases)


def test_papers_and_bundles(spark, tmp_path):
    more = items(spark, ITEMS).unionByName(items(spark, ITEMS[:5]).withColumn("paper_id", F.lit("p2")))
    e = E.parse(more)
    path, about = str(tmp_path / "papers"), spark.createDataFrame([("p", "T", "a.pdf", "00"), ("p2", None, None, None)], "paper_id string, title string, source_path string, sha256 string")
    io.write_papers(e, path, about)
    papers = io.read_papers(spark, path)
    assert {(r.paper_id, r.title, len(r.elements)) for r in papers.collect()} == {("p", "T", 7), ("p2", None, 5)}
    back = io.elements_of(papers)
    assert rows_of(back.select(*[c for c in e.columns if c != "source_index"])) == rows_of(e.drop("source_index"))
    chunks_, parents = C.chunk(e), C.parents(e)
    io.write_bundles(chunks_, parents, str(tmp_path / "chunks"))
    bundles = io.read_bundles(spark, str(tmp_path / "chunks"))
    assert rows_of(io.chunks_of(bundles).select(*chunks_.columns)) == rows_of(chunks_) and chunks_.count() > 6
    assert rows_of(io.parents_of(bundles).select(*parents.columns)) == rows_of(parents)
    with pytest.raises(FileNotFoundError):
        io.read_bundles(spark, str(tmp_path / "nothing"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "chunks.json").write_text(json.dumps({"paper_id": "p", "parents": [], "children": [{"chunk_id": "c", "content": "x"}]}, indent=1))
    assert io.chunks_of(io.read_bundles(spark, str(tmp_path / "p"), "chunks.json")).first().chunk_id == "c"
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert io.pdf_papers(spark, str(tmp_path / "a.pdf")).first().paper_id.startswith("paper_")


def test_metadata(spark):
    rows = [{"type": "text", "text": "x", "score": 0.5, "tags": ["a"], "source_index": 9}, {"type": "page_footnote", "text": "y"}, {"type": "odd", "text": "z"}]
    got = [json.loads(r.metadata) for r in E.parse(items(spark, rows)).orderBy("seq").collect()]
    assert got == [
        {"type": "text", "score": 0.5, "tags": ["a"], "mineru_type": "text", "source_index": 0},
        {"type": "page_footnote", "mineru_type": "page_footnote", "source_index": 1, "retrieval_excluded": True},
        {"type": "odd", "mineru_type": "odd", "source_index": 2, "unmapped_type": True},
    ]


class Step:
    def __init__(self, state, to, fails=0):
        self.state, self.to, self.fails = state, to, fails

    def execute(self, run):
        if self.fails:
            self.fails -= 1
            raise RuntimeError("broken")
        return W.Result(self.to, {self.state: True})


def test_workflow(spark):
    path = ["parsing", "indexing", "extracting_claims", "retrieving_evidence", "critiquing", "judging", "reporting", "finished"]
    nodes = [Step(a, b, fails=a == "indexing") for a, b in zip(path, path[1:], strict=False)]
    store = W.MemoryCheckpoints()
    run = W.Machine(nodes, store).run(W.Run("r", "p", "f.pdf"))
    assert run.state == "finished" and store.load("r").history == ["init", *path[:-1]] and run.attempts["indexing"] == 2
    assert W.Machine([Step("parsing", "indexing", 5)], store).run(W.Run("r", "p", "f")).state == "failed"
    assert W.Machine([Step("parsing", "judging")], store).run(W.Run("r", "p", "f")).errors[0]["error"].startswith("illegal")
    assert W.Machine(nodes, store, max_steps=2).run(W.Run("r", "p", "f")).state == "failed"


def test_stream(spark, tmp_path):
    from quillspark.streaming.upsert import stream_upserts

    table = VectorTable(spark, str(tmp_path / "t"), "m", 1)
    schema = "chunk_id string, vector array<double>, version long"
    spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 2), ("b", [3.0], 1)], schema).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream_upserts(rows, table, str(tmp_path / "ck")).awaitTermination()
    assert {(r.chunk_id, r.vector[0]) for r in table.read().collect()} == {("a", 2.0), ("b", 3.0)}

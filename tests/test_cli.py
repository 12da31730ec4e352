"""The command line, checkpoints in files, and JSON files of several forms."""

import json
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark import cloudpickle

from quillspark import __main__ as cli
from quillspark.operators import workflow as W
from quillspark.sources import io

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROOT = Path(__file__).parent.parent


def parsed(tmp_path):
    """A PDF and what a parser made of it."""
    (tmp_path / "study.pdf").write_bytes(b"%PDF-1.4 some bytes")
    items = [
        {"type": "text", "text": "Rivers and Lakes", "text_level": 1, "page_idx": 0},
        {"type": "text", "text": "Methods", "text_level": 2, "page_idx": 0},
        {"type": "text", "text": "We measure vision of fish in rivers.", "page_idx": 0},
        {"type": "interline_equation", "latex": "a = b + c", "page_idx": 1},
        {"type": "text", "text": "Lakes are calm and deep.", "page_idx": 1},
    ]
    (tmp_path / "out" / "deep").mkdir(parents=True)
    (tmp_path / "out" / "deep" / "study_content_list.json").write_text(json.dumps(items))


class Words:
    """Counts of two words as vectors."""

    model_name, dimension = "words", 2

    def encode_documents(self, texts):
        return [[1.0 + 5 * t.lower().count("fish"), 1.0 + 5 * t.lower().count("calm")] for t in texts]

    encode_queries = encode_documents


def encoder():
    return Words()


def scorer():
    from quillspark.operators.fusion import PairScorer

    return PairScorer(lambda: lambda pairs, most: [float("deep" in d) for _, d in pairs], "deep")


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_from_pdf_to_report(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setitem(sys.modules, "models_of_test", sys.modules[__name__])
    parsed(tmp_path)
    at = lambda name: str(tmp_path / name)
    cli.main(["parse", "--pdf", at("study.pdf"), "--items", at("out"), "--output", at("papers"), "--parser-version", "9"])
    [paper] = io.read_papers(spark, at("papers")).collect()
    assert paper.title == "Rivers and Lakes" and len(paper.elements) == 5 and paper.elements[0].parser_version == "9"
    cli.main(["chunk", "--papers", at("papers"), "--output", at("bundles")])
    chunks = {r.content: r.chunk_id for r in io.chunks_of(io.read_bundles(spark, at("bundles"))).collect()}
    assert any("fish" in c for c in chunks) and "a = b + c" in chunks
    cli.main(["index", "--chunks", at("bundles"), "--table", at("table"), "--encoder", "models_of_test:encoder"])
    assert lines(capsys) == [{"indexed": len(chunks)}]
    models = ["--table", at("table"), "--encoder", "models_of_test:encoder", "--scorer", "models_of_test:scorer"]
    for method in cli.METHODS:
        cli.main(["search", method, "--chunks", at("bundles"), "--query", "fish in rivers", "--top-k", "2", *models])
        hits = lines(capsys)
        assert [h["rank"] for h in hits] == [1, 2] and hits[0]["section_path"][0] == "Rivers and Lakes"
        if method != "reranked":
            assert "fish" in hits[0]["content"]
    cli.main(["search", "bm25", "--chunks", at("bundles"), "--query", "fish b", "--kind", "equation"])
    assert {h["kind"] for h in lines(capsys)} == {"equation"}
    case = {"query_id": "q1", "query": "fish", "relevant_chunk_ids": [v for k, v in chunks.items() if "fish" in k], "category": "x", "annotator": "y", "expected_answer": "", "notes": ""}
    (tmp_path / "golden.json").write_text(json.dumps([case]))
    for method in cli.METHODS[:3]:
        cli.main(["evaluate", method, "--chunks", at("bundles"), "--golden", at("golden.json"), "--output", at(f"report-{method}"), *models])
        [macro] = lines(capsys)
        assert macro["macro_recall_at_1"] == 1.0 and macro["mean_reciprocal_rank"] == 1.0
        assert spark.read.json(at(f"report-{method}/cases")).count() == 1


def test_wrong_calls(spark, tmp_path):
    with pytest.raises(SystemExit, match="PDF"):
        cli.main(["parse", "--pdf", str(tmp_path / "a.txt"), "--items", "x", "--output", "y"])
    with pytest.raises(SystemExit, match="no such file"):
        cli.main(["parse", "--pdf", str(tmp_path / "a.pdf"), "--items", "x", "--output", "y"])
    with pytest.raises(SystemExit):
        cli.main(["search", "magic", "--chunks", "x", "--query", "y"])


def test_health():
    from http.server import ThreadingHTTPServer
    from threading import Thread
    from urllib.error import HTTPError
    from urllib.request import urlopen

    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.Health)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    with urlopen(f"{at}/health") as answer:
        assert answer.status == 200 and json.load(answer) == {"status": "ok"}
    with pytest.raises(HTTPError):
        urlopen(f"{at}/other")
    server.shutdown()


def test_files_of_several_forms(spark, tmp_path):
    row = lambda i: {"query_id": f"q{i}", "query": "x", "relevant_chunk_ids": [str(i)]}
    (tmp_path / "a b.json").write_text("\n\n" + "\n".join(json.dumps(row(i)) for i in range(3)))
    (tmp_path / "array.json").write_text(json.dumps([row(3), row(4)]))
    (tmp_path / "pretty.json").write_text(json.dumps(row(5), indent=2))
    (tmp_path / "list.json").write_text(json.dumps([row(6)], indent=1))
    (tmp_path / "empty.json").write_text("")
    assert {r.query_id for r in io._json(spark, str(tmp_path), io.CASE, "*.json").collect()} == {f"q{i}" for i in range(7)}
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):
        io._json(spark, str(tmp_path), io.CASE, "*.json").collect()


class Step:
    def __init__(self, state, to):
        self.state, self.to = state, to

    def execute(self, run):
        return W.Result(self.to, {self.state: len(run.history)})


PATH = ["parsing", "indexing", "extracting_claims", "retrieving_evidence", "critiquing", "judging", "reporting", "finished"]


def test_versions_are_kept_and_exclusive(spark, tmp_path):
    store = W.FileCheckpoints(spark, str(tmp_path / "c"))
    machine = W.Machine([Step(a, b) for a, b in zip(PATH, PATH[1:], strict=False)], store)
    assert store.load("r/1") is None
    with pytest.raises(KeyError):
        machine.resume("r/1")
    end = machine.run(W.Run("r/1", "p", "x.pdf"))
    assert end.state == "finished" and W.FileCheckpoints(spark, str(tmp_path / "c")).load("r/1") == end
    rows = sorted((r.version, r.state) for r in store.table().where("run_id = 'r/1'").collect())
    assert rows == list(enumerate(PATH, 1))
    assert [(r.run_id, r.state) for r in W.latest(store.table()).collect()] == [("r/1", "finished")]
    one, two = (W.FileCheckpoints(spark, str(tmp_path / "c")) for _ in range(2))
    run = W.Run("r2", "p", "x.pdf", artifacts={"a": [1, {"b": None}]}, errors=[{"state": "init", "error": "e"}])
    one.save(run)
    assert two.load("r2") == run
    one.save(run.moved("parsing"))
    with pytest.raises(W.ConcurrentRun):
        two.save(run.moved("failed"))
    assert two.load("r2").state == "parsing" and isinstance(two.load("r2").updated_at, datetime)


FIRST = """
import sys, os
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from quillspark.operators import workflow as W
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
class Step:
    def __init__(self, state, to): self.state, self.to = state, to
    def execute(self, run):
        if self.state == "critiquing": os._exit(7)  # the driver is lost
        return W.Result(self.to, {{self.state: 1}})
path = {path!r}
W.Machine([Step(a, b) for a, b in zip(path, path[1:])], W.FileCheckpoints(spark, {folder!r})).run(W.Run("r", "p", "x.pdf"))
"""


def test_another_process_goes_on(spark, tmp_path):
    folder = str(tmp_path / "c")
    code = subprocess.run([sys.executable, "-c", FIRST.format(root=str(ROOT), path=PATH, folder=folder)], capture_output=True, timeout=120).returncode
    assert code == 7
    store = W.FileCheckpoints(spark, folder)
    assert store.load("r").state == "critiquing"
    end = W.Machine([Step(a, b) for a, b in zip(PATH, PATH[1:], strict=False)], store).resume("r")
    assert end.state == "finished" and end.history == ["init", *PATH[:-1]]
    assert store.table().count() == len(PATH)

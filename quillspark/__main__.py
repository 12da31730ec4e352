"""Command line: parse, chunk, index, search and evaluate, each as Spark jobs; serve for /health.

    python -m quillspark parse --pdf paper.pdf --items parsed/ --output papers/
    python -m quillspark chunk --papers papers/ --output bundles/
    python -m quillspark index --chunks bundles/ --table vectors/ --encoder my_models:encoder
    python -m quillspark search bm25 --chunks bundles/ --query "..."
    python -m quillspark evaluate hybrid --chunks bundles/ --table vectors/ --encoder my_models:encoder --golden cases.json

An encoder or scorer is named as module:function; the function returns it (see
operators.vectors.Encoder and operators.fusion.PairScorer).
"""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from importlib import import_module
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks as C
from quillspark.operators import elements as E
from quillspark.operators import evaluation as M
from quillspark.operators import fusion as R
from quillspark.operators.index import InvertedIndex
from quillspark.operators.vector_table import VectorTable
from quillspark.operators.vectors import encode
from quillspark.sources import io

METHODS = ("bm25", "dense", "hybrid", "reranked")


def named(name: str | None, what: str) -> Any:
    if not name:
        raise SystemExit(f"--{what} is needed: module:function")
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)()


def parse(spark: SparkSession, args: argparse.Namespace) -> None:
    if not args.pdf.lower().endswith(".pdf"):
        raise SystemExit(f"expected a PDF file: {args.pdf}")
    if not io.exists(spark, args.pdf):
        raise SystemExit(f"no such file: {args.pdf}")
    paper = io.pdf_papers(spark, args.pdf).first()
    items = io.parser_items(spark, io.locate_items(spark, args.items, PurePosixPath(args.pdf).stem), paper.paper_id)
    elements = E.parse(items).withColumn("parser_version", F.lit(args.parser_version))
    about = E.papers(elements).select("paper_id", "title", F.lit(paper.source_path).alias("source_path"), F.lit(paper.sha256).alias("sha256"))
    io.write_papers(elements, args.output, about)


def chunk(spark: SparkSession, args: argparse.Namespace) -> None:
    elements = io.elements_of(io.read_papers(spark, args.papers))
    io.write_bundles(C.chunk(elements, args.max_chars, args.overlap_elements), C.parents(elements), args.output)


def _chunks(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = io.chunks_of(io.read_bundles(spark, args.chunks))
    return rows.withColumn("text", T.embedding_text(F.col("section_path"), F.col("context"), F.col("content")))


def _table(spark: SparkSession, args: argparse.Namespace, encoder: Any) -> VectorTable:
    if not args.table:
        raise SystemExit("--table is needed: a folder of vectors")
    return VectorTable(spark, args.table, encoder.model_name, encoder.dimension)


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    encoder = named(args.encoder, "encoder")
    rows = _chunks(spark, args)
    n = _table(spark, args, encoder).upsert_texts(rows, F.col("text"), encoder, batch_size=args.batch_size)
    print(json.dumps({"indexed": n}))


def retriever(spark: SparkSession, args: argparse.Namespace, where: Column | None) -> R.Retriever:
    """queries (query_id, query), top_k -> hits."""

    def bm25():
        kept = _chunks(spark, args).select("chunk_id", "text", "paper_id", "kind")
        lists = InvertedIndex.build(kept)
        return lambda queries, k: lists.search(queries, k, where=where)

    def dense():
        encoder = named(args.encoder, "encoder")
        held = _table(spark, args, encoder)
        return lambda queries, k: held.search(encode(queries, F.col("query"), encoder, queries=True), k, where)

    if args.method == "bm25":
        return bm25()
    if args.method == "dense":
        return dense()
    both = R.hybrid_retriever(bm25(), dense(), args.rrf_k, args.candidate_k)
    if args.method == "hybrid":
        return both
    scorer = named(args.scorer, "scorer")
    texts = _chunks(spark, args).select("chunk_id", T.rerank_text(F.col("section_path"), F.col("context"), F.col("content")).alias("document"))

    def reranked(queries: DataFrame, k: int) -> DataFrame:
        found = both(queries, max(k, args.candidate_k)).join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id")
        return R.rerank(found, scorer(F.col("query"), F.col("document")), k)

    return reranked


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    """One JSON line for each hit, best first."""
    conditions = [F.col(c) == v for c, v in (("paper_id", args.paper_id), ("kind", args.kind)) if v]
    where = None
    for c in conditions:
        where = c if where is None else where & c
    queries = spark.createDataFrame([("query", args.query)], "query_id string, query string")
    hits = retriever(spark, args, where)(queries, args.top_k)
    shown = _chunks(spark, args).select("chunk_id", "paper_id", "kind", "pages", "section_path", T.snippet(F.col("content")).alias("content"))
    ranks = [c for c in ("sparse_rank", "dense_rank", "retrieval_rank", "retrieval_score") if c in hits.columns]
    for line in hits.join(shown, "chunk_id").orderBy("rank").select("rank", "score", *ranks, "chunk_id", "paper_id", "kind", "pages", "section_path", "content").toJSON().collect():
        print(line)  # top_k lines


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    cases = io.read_cases(spark, args.golden).withColumn("relevant", F.col("relevant_chunk_ids"))
    per_case, macro = M.evaluate(cases, retriever(spark, args, None), args.top_k)
    if args.output:
        io.write_report(per_case, macro, args.output)
    print(macro.toJSON().first())


class Health(BaseHTTPRequestHandler):
    """GET /health tells that the process is up."""

    def do_GET(self) -> None:
        up = self.path.partition("?")[0] == "/health"
        body = json.dumps({"status": "ok"} if up else {"detail": "Not Found"}).encode()
        self.send_response(200 if up else 404)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_) -> None:
        pass


def serve(_: None, args: argparse.Namespace) -> None:
    ThreadingHTTPServer((args.host, args.port), Health).serve_forever()


def options(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="python -m quillspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(required=True)

    def command(run, *needed: str):
        p = commands.add_parser(run.__name__)
        p.set_defaults(run=run)
        if run in (search, evaluate):
            p.add_argument("method", choices=METHODS)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        return p

    p = command(parse, "pdf", "items", "output")
    p.add_argument("--parser-version", default="unknown")
    p = command(chunk, "papers", "output")
    p.add_argument("--max-chars", type=int, default=C.MAX_CHARS)
    p.add_argument("--overlap-elements", type=int, default=C.OVERLAP)
    p = command(serve)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p = command(index, "chunks", "table", "encoder")
    p.add_argument("--batch-size", type=int, default=8)
    for run, need in ((search, "query"), (evaluate, "golden")):
        p = command(run, "chunks", need)
        for name in ("table", "encoder", "scorer", "paper-id", "kind", "output"):
            p.add_argument(f"--{name}")
        for name, default in (("top-k", 5), ("candidate-k", 20), ("rrf-k", 60)):
            p.add_argument(f"--{name}", type=int, default=default)
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = options(argv)
    args.run(None if args.run is serve else SparkSession.builder.appName("quillspark").getOrCreate(), args)


if __name__ == "__main__":
    main()

"""What a user may plug in: a parser, stores, and a client of a language model."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame


class Parser(Protocol):
    """PDF files to parser items (paper_id, source_index, item), as elements.parse takes them."""

    version: str

    def parse(self, papers: DataFrame) -> DataFrame: ...


class VectorStore(Protocol):
    """Rows with a vector in; (query_id, chunk_id, score, rank) out."""

    def upsert(self, rows: DataFrame) -> int: ...
    def search(self, queries: DataFrame, top_k: int) -> DataFrame: ...


class GraphStore(Protocol):
    """Relations of papers: (paper_id, relation, target)."""

    def upsert_relations(self, relations: DataFrame) -> None: ...


class LanguageModel(Protocol):
    """Answers of a given shape; called on executors, in batches."""

    def answer(self, prompts: list[str], schema: dict[str, Any]) -> list[dict[str, Any]]: ...

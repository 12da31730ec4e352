"""Scalar rules on text as columns: normalising, tokens, ids, serialisations."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Line ends and white space as Python's splitlines() and strip() know them.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
TOKEN = r"\\[A-Za-z]+|[A-Za-z][A-Za-z0-9_-]*|\p{Nd}+(?:\.\p{Nd}+)?|[\u4e00-\u9fff]"


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities as characters. The only rule here that needs Python: its table has
    over two thousand names; texts without & are not sent to it."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def resolved(c: Column, entities: bool | tuple[str, ...]) -> Column:
    """Entities as characters: all that HTML knows, open ones such as &amp without a semicolon
    included; none; or only those named, one after the other and closed by a semicolon."""
    if isinstance(entities, bool):
        return unescape(c) if entities else c
    for name in entities:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def normalize(c: Column) -> Column:
    """Entities, no-break spaces, runs of white space, line edges and blank lines."""
    plain = F.translate(unescape(c), "\u00a0", " ")
    lines = F.transform(F.split(plain, LINE_ENDS, -1), lambda x: strip(F.regexp_replace(x, r"[\t\r\f\x0b ]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def tokenize(c: Column, entities: bool | tuple[str, ...] = True) -> Column:
    """Lower-case tokens: LaTeX commands, words, numbers and single Han characters.

    Tags go first, then entities are resolved; entities=False skips the latter for
    sources known to have none, and names resolve only those (see resolved()).
    """
    bare = F.regexp_replace(c, "<[^>]+>", " ")
    return F.transform(F.regexp_extract_all(resolved(bare, entities), F.lit(TOKEN), F.lit(0)), F.lower)


def with_tokens(rows: DataFrame, text: Column, name: str = "tokens", entities: bool | tuple[str, ...] = True) -> DataFrame:
    """rows with the tokens of a text; the text without tags is a column of its own on the
    way, so that it is made once."""
    bare = F.col("_bare")
    found = F.regexp_extract_all(resolved(bare, entities), F.lit(TOKEN), F.lit(0))
    return rows.withColumn("_bare", F.regexp_replace(text, "<[^>]+>", " ")).withColumn(name, F.transform(found, F.lower)).drop("_bare")


def digest(*parts: Column, length: int = 24) -> Column:
    return F.left(F.sha2(F.concat_ws("\x00", *parts), 256), F.lit(length))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), digest(*parts))


def query_id(query: Column, paper_id: Column) -> Column:
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(40))
    name = F.when(slug == "", F.lit("query")).otherwise(slug)
    return F.concat(name, F.lit("_"), digest(F.coalesce(paper_id, F.lit("")), query, length=8))


def _joined(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def embedding_text(section_path: Column, context: Column, content: Column) -> Column:
    section = F.when(F.size(section_path) > 0, F.concat(F.lit("Section: "), F.array_join(section_path, " > ")))
    return _joined("\n\n", section, context, content)


def rerank_text(section_path: Column, context: Column, content: Column) -> Column:
    return _joined("\n", F.array_join(section_path, " > "), context, content)


def snippet(c: Column, size: int = 500) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, size)


def has_latex(c: Column) -> Column:
    return c.contains("$") | c.contains("\\begin{") | c.contains("\\[")

"""BM25 over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokenize, with_tokens


def check(top_k: int, k1: float = 1.5, b: float = 0.75) -> None:
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if k1 <= 0:
        raise ValueError("k1 must be positive")
    if not 0 <= b <= 1:
        raise ValueError("b must be between 0 and 1")


def tokens(rows: DataFrame, id_col: str, text: Column, entities: bool | tuple[str, ...] = True) -> DataFrame:
    """(id_col, tokens)."""
    return with_tokens(rows.select(id_col, text.alias("_text")), F.col("_text"), entities=entities).select(id_col, "tokens")


def term_frequencies(tokenized: DataFrame, id_col: str) -> DataFrame:
    return tokenized.select(id_col, F.explode("tokens").alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokenized: DataFrame) -> DataFrame:
    """n_docs and avg_len of all documents, those without tokens included."""
    return tokenized.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_len"))


def query_terms(queries: DataFrame, entities: bool = True) -> DataFrame:
    """(query_id, term, pos, qc): distinct terms with their first place and count."""
    terms = queries.select("query_id", F.posexplode(tokenize(F.col("query"), entities)).alias("pos", "term"))
    return terms.groupBy("query_id", "term").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("qc"))


def rank(scored: DataFrame, top_k: int, *order: Column) -> DataFrame:
    """The top_k rows of each query with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def search(queries: DataFrame, chunks: DataFrame, text: Column, top_k: int = 5, k1: float = 1.5, b: float = 0.75, where: Column | None = None, entities: bool = True, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, query).

    `where` filters what is returned, never the statistics. Scores add the terms in
    query order; ties go to the smaller id; null texts count as empty. Only postings of query terms are shuffled:
    the terms of the batch meet the exploded tokens before anything is grouped. Frequencies,
    lengths and scores come from the same postings, so texts are read once (twice with a
    filter, which goes to the scan).
    """
    check(top_k, k1, b)
    shown = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    told = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(text, F.lit("")).alias("_text"), shown.alias("shown"))
    tokenized = with_tokens(told, F.col("_text"), entities=entities).drop("_text")
    terms = query_terms(queries, entities)
    # Equal ids stay apart, as rows of their own. Each row also has the empty term, which no
    # token is: it tells the length of rows without any term of the queries.
    numbered = tokenized.select("*", F.monotonically_increasing_id().alias("row"), F.size("tokens").alias("len"))
    wanted = terms.select("term").distinct().union(chunks.sparkSession.range(1).select(F.lit("").alias("term")))
    found = numbered.select("chunk_id", "shown", "len", "row", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term")).join(wanted, "term", "left_semi")
    # All below read one exchange: every use asks for tf, so that the plans are the same.
    postings = found.groupBy("row", "chunk_id", "shown", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    one = F.signum("tf").cast("long")
    df = postings.groupBy("term").agg(F.sum(one).alias("df"))
    own = F.col("term") == ""
    stats = postings.agg(F.coalesce(F.sum(F.when(own, one)), F.lit(0)).alias("n_docs"), F.coalesce(F.avg(F.when(own & (F.col("tf") > 0), F.col("len"))), F.lit(0.0)).alias("avg_len"))
    joined = postings.where("shown").join(terms.join(df, "term"), "term").crossJoin(stats)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("avg_len", F.lit(1.0)))
    part = joined.select("query_id", "chunk_id", "row", "pos", (idf * F.col("tf") * (k1 + 1) / norm * F.col("qc")).alias("x"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "x"))), F.lit(0.0), lambda s, p: s + p["x"])
    scored = part.groupBy("query_id", "chunk_id", "row").agg(total.alias("score")).where("score > 0").drop("row")
    return rank(scored, top_k, F.desc("score"), F.asc("chunk_id"))

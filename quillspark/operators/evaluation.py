"""Retrieval metrics, annotation helpers and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import InvertedIndex

PASSAGES = 10_000  # passages whose anchors are broadcast


def case_metrics(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: recall_at_1, recall_at_5, reciprocal_rank, ndcg_at_5.

    cases has query_id and relevant (array); hits has query_id, chunk_id, rank. Without
    relevant ids recall and nDCG are 1.
    """
    rel = cases.select("query_id", F.array_distinct("relevant").alias("relevant"))
    found = rel.join(hits.select("query_id", "chunk_id", "rank"), "query_id", "left").withColumn("good", F.coalesce(F.array_contains("relevant", F.col("chunk_id")), F.lit(False)))
    seen = lambda k: F.count_distinct(F.when(F.col("good") & (F.col("rank") <= k), F.col("chunk_id")))
    gain = F.sum(F.when(F.col("good") & (F.col("rank") <= 5), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    one = found.groupBy("query_id", F.size("relevant").alias("n")).agg(seen(1).alias("n1"), seen(5).alias("n5"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(5))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    none = F.col("n") == 0
    share = lambda c: F.when(none, F.lit(1.0)).otherwise(F.try_divide(F.col(c), F.col("n")))
    return one.select("query_id", share("n1").alias("recall_at_1"), share("n5").alias("recall_at_5"), F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("reciprocal_rank"), F.when(none, F.lit(1.0)).otherwise(F.try_divide(F.col("dcg"), ideal)).alias("ndcg_at_5"))


def macro(metrics: DataFrame) -> DataFrame:
    """One row of means; no case at all fails."""
    n = F.count(F.lit(1))
    need = F.when(n == 0, F.raise_error(F.lit("at least one retrieval case is required")).cast("double"))
    mean = lambda c, name: F.coalesce(need, F.avg(c)).alias(name)
    return metrics.agg(mean("recall_at_1", "macro_recall_at_1"), mean("recall_at_5", "macro_recall_at_5"), mean("reciprocal_rank", "mean_reciprocal_rank"), mean("ndcg_at_5", "mean_ndcg_at_5"))


def evaluate(cases: DataFrame, retriever, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(per case, macro) of a retriever over all cases as one batch."""
    per_case = case_metrics(cases, retriever(cases, top_k))
    return per_case, macro(per_case)


def evaluate_bm25(cases: DataFrame, chunks: DataFrame, text: str = "text", top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(per case, macro) of BM25 over an index of chunks; cases has query_id, query, relevant."""
    return evaluate(cases, InvertedIndex.build(chunks, text).search, top_k)


def containing(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs joined with the passages (query_id, passage) that their text contains.

    A contained passage shares all pairs of neighbouring words, but for its first and last word,
    which may be parts of longer ones. Its rarest pair among the docs is its anchor: only docs
    with that pair are compared with it. A passage of fewer than four words between spaces has no
    pair inside it; those few are compared with every text. Null texts and passages match
    nothing; an empty passage is in every text. With up to PASSAGES passages nothing of the
    texts is shuffled: pairs are held against broadcast ones, and each text meets its passages
    where it is read.
    """
    words = F.split("passage", " ", -1)
    some = passages.where("passage is not null").withColumn("words", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(F.col(c), i), F.lit(" "), F.get(F.col(c), i + 1)))
    long = some.where("size(words) >= 2").withColumn("pair", F.explode(F.array_distinct(pairs("words")))).drop("words")
    told = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("_doc"), F.split(text, " ", -1).alias("words")).where("size(words) >= 2")
    few = passages.count() <= PASSAGES
    wanted = long.select("pair").distinct()
    held = told.select("_doc", F.explode(F.array_distinct(pairs("words"))).alias("pair")).join(F.broadcast(wanted) if few else wanted, "pair", "left_semi")
    df = held.groupBy("pair").agg(F.count(F.lit(1)).alias("df"))
    # A pair that no text has rules its passage out.
    rarest = long.join(df, "pair", "left").groupBy("query_id", "passage").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "pair")).alias("m")).select("query_id", "passage", F.col("m.pair").alias("pair")).where("m.df > 0")
    if few:
        anchors = rarest.distinct().collect()
        rarest = docs.sparkSession.createDataFrame(anchors, rarest.schema)
        words = F.split(text, " ", -1)
        of_text = F.when(F.size("_words") >= 2, F.filter(F.array_distinct(pairs("_words")), lambda p: p.isin(sorted({r.pair for r in anchors}))))
        near = docs.withColumn("_words", words).withColumn("pair", F.explode(of_text)).drop("_words")
        found = near.join(F.broadcast(rarest), "pair").drop("pair").where(F.col(text).contains(F.col("passage")))
    else:
        near = held.join(rarest, "pair").select("_doc", "query_id", "passage").distinct()
        found = docs.join(near, F.col(id_col).eqNullSafe(F.col("_doc"))).drop("_doc").where(F.col(text).contains(F.col("passage")))
    short = some.where("size(words) < 2").select("query_id", "passage")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(short, F.col(text).contains(F.col("passage"))))


def selection(value: Column, count: Column) -> Column:
    """Sorted distinct places of a list like "1,3-5"; a falling range or a place out of
    1..count fails."""
    parts = F.filter(F.split(F.replace(value, F.lit(" "), F.lit("")), ","), lambda p: p != "")

    def places(p):
        ends = F.split(p, "-", 2)
        a, b = ends[0].cast("int"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).cast("int")
        return F.when(a > b, F.raise_error(F.concat(F.lit("invalid descending range: "), p)).cast("array<int>")).otherwise(F.sequence(a, b))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, places))))
    wrong = F.exists(chosen, lambda i: (i < 1) | (i > count))
    return F.when(wrong, F.raise_error(F.lit("selection out of range")).cast("array<int>")).otherwise(chosen)


def duplicate_cases(cases: DataFrame) -> DataFrame:
    """(rule, key, n): query ids that repeat, and equal queries (case and edges aside) of
    one paper, null papers being equal. Case is folded by lower()."""
    ids = cases.groupBy(F.col("query_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("query_id").alias("rule"), "key", "n")
    text = F.lower(F.trim("query"))
    same = cases.groupBy(text.alias("key"), "paper_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("query").alias("rule"), "key", "n")
    return ids.unionByName(same)


def new_cases(cases: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the queries that have been annotated."""
    return cases.join(done.select("query_id"), "query_id", "left_anti")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every row that breaks a rule; a rule is true where it holds."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def finding_rules() -> dict[str, Column]:
    return {"supported_needs_evidence": (F.col("verdict") != "supported") | (F.size("evidence_ids") > 0), "confidence_range": F.col("confidence").between(0, 1)}


def chunk_rules() -> dict[str, Column]:
    return {"content": F.length("content") > 0, "element_ids": F.size("element_ids") > 0, "pages": (F.size("pages") > 0) & F.forall("pages", lambda p: p >= 1)}


def score_rules() -> dict[str, Column]:
    """Bounds of the scores of hits that say which retriever found them."""
    of = lambda name, fine: (F.col("retriever") != name) | fine
    return {"dense": of("dense", F.col("score").between(-1, 1)), "sparse": of("sparse", F.col("score") >= 0), "hybrid": of("hybrid", F.col("score") > 0)}


def integrity(chunks: DataFrame, parents: DataFrame, elements: DataFrame) -> DataFrame:
    """(rule, key): chunks without a parent, element ids that do not resolve, repeated
    chunk ids and equations without context."""
    orphan = chunks.join(parents.select("parent_chunk_id"), "parent_chunk_id", "left_anti").select(F.lit("parent").alias("rule"), F.col("chunk_id").alias("key"))
    ids = chunks.select("chunk_id", F.explode("element_ids").alias("element_id")).join(elements.select("element_id"), "element_id", "left_anti").select(F.lit("element").alias("rule"), F.col("chunk_id").alias("key"))
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select(F.lit("duplicate").alias("rule"), F.col("chunk_id").alias("key"))
    bare = chunks.where("kind = 'equation' and context = ''").select(F.lit("context").alias("rule"), F.col("chunk_id").alias("key"))
    return orphan.union(ids).union(twice).union(bare)


def reports(findings: DataFrame) -> DataFrame:
    """One report per paper with its findings."""
    return findings.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "verdict", "evidence_ids", "confidence"))).alias("findings"))

"""Quality rules by cross-document line frequency (DataFrame only).

Lines are normalised and hashed; for each host (source), the distinct documents that
hold a line are counted, where documents with equal text count once. Lines above the
limit leave every document of the host but the first (smallest id) that holds them,
and a document that loses most of its text is rejected. The limit is a share of the
host's documents, and LEAST documents are too few to tell anything; so a host of any
size has lines above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import counted, cut, fresh, stored, table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
SHARE, LEAST = 0.02, 2
KEEP = 0.3  # share of the characters of its lines that a document must keep


def _text(docs, id_col, text, host):
    return docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def _lines(t):
    return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))


def _line_hash(x):
    """Normalised: lower case, digits as 0, other signs and white space as one space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{N}", "0"), r"[^\p{L}0]+", " ")))


def base_measures(rows: DataFrame) -> DataFrame:
    """doc_id, host, t -> the base measures, the hash of the text, and that and the length of each line."""
    words = F.array_remove(F.split("t", SPACE, -1), "")
    a = rows.select("doc_id", "host", F.xxhash64("t").alias("th"), F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), _lines(F.col("t")).alias("ls"), F.transform(words, lambda w: F.xxhash64(w)).alias("wh"))
    at = lambda i, k: F.get("wh", i + k)
    windows = F.when(F.size("wh") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("wh") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    b = a.select("doc_id", "host", "th", "word_chars", "n_symbols", F.size("wh").cast("long").alias("n_words"), (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), F.transform("ls", lambda x: F.struct(_line_hash(x).alias("h"), F.length(x).alias("n"))).alias("lines"), windows.alias("win"))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    c = b.withColumn("win", F.when(repeats, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce(F.get("win", k)["h"] == x["h"], F.lit(False))
    d = c.withColumn("twice", F.array_sort(F.transform(F.filter("win", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate("twice", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct((p + WINDOW).alias("end"), (s["n"] + p + WINDOW - F.greatest(s["end"], p)).alias("n")))["n"]
    e = d.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return e.select("doc_id", "host", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "lines")


def frequent_lines(base: DataFrame, share: float, least: int) -> DataFrame:
    """(host, h, first): lines in more than max(least, share of the host's distinct texts)."""
    lines = base.select("doc_id", "host", "th", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    each = lines.groupBy("host", "h", "th").agg(F.min("doc_id").alias("first"))
    counts = each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") > least)
    size = base.select("host", "th").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    joined = counts.join(size.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2")))
    return joined.where(F.col("n") > share * F.col("docs")).select("host", "h", "first")


@stored
def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST, keep_share: float = KEEP) -> DataFrame:
    """One row per document: doc_id, host, th (xxhash64 of the text), the base measures,
    base_failed, kept, frequent.

    frequent holds the normalised hashes of the lines to remove. A document is rejected
    when base_failed or when the other lines hold less than keep_share of the characters
    of its lines. Null text counts as empty (and fails the base), a null host is a host
    of its own, repeated rows stay repeated and are one document, rows of one id with
    different texts are judged apart, other columns are ignored.

    Scale: the texts are read once; what follows works on hashes of lines. Counting moves
    them in two narrow shuffles with map-side combining, so a line that every document
    holds is counted before it moves; a host's size is not the size of a task.
    """
    base = cut(base_measures(_text(docs, id_col, text, host)), "measures")
    often = frequent_lines(base, share, least).select(F.col("host").alias("host2"), F.col("h").alias("h2"), "first")
    # The lines of the documents that hold a frequent line, other than the first of them.
    lines = base.select("doc_id", "host", "th", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    hit = lines.join(often, F.col("host").eqNullSafe(F.col("host2")) & (F.col("h") == F.col("h2"))).where("not doc_id <=> first")
    hits = hit.groupBy("doc_id", "host", "th").agg(F.collect_set("h").alias("frequent")).select(F.col("doc_id").alias("d2"), F.col("host").alias("host2"), F.col("th").alias("th2"), "frequent")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("host").eqNullSafe(F.col("host2")) & (F.col("th") == F.col("th2")), "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<bigint>")))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.when(F.array_contains("frequent", x["h"]), x["n"]).otherwise(0))
    depleted = (F.size("frequent") > 0) & ((total - lost) < keep_share * total)
    return joined.select("doc_id", "host", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "frequent")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, counts of the rules, base_failed, kept. A null text has no words
    and fails; see judge()."""
    return judge(table(spark, sf_dir, "documents")).drop("host", "th", "frequent")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without the lines above the limits.

    Null and empty texts fail the base and go. Rows are matched by id, source and text, so
    rows of one id with different texts have verdicts of their own and repeated rows share
    theirs; a null id or source is matched like any other. All columns of docs are kept.
    """
    d, h, t, often = (fresh(docs, c) for c in ("id", "host", "th", "frequent"))
    verdicts = judge(docs).where("kept").select(F.col("doc_id").alias(d), F.col("host").alias(h), F.col("th").alias(t), F.col("frequent").alias(often)).dropDuplicates([d, h, t])
    joined = docs.join(verdicts, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(h)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(t)))
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(often, _line_hash(x)))), "\n")
    return counted(joined.withColumn("text", F.when(F.size(often) > 0, rest).otherwise(F.col("text"))), docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
li AS (SELECT r, x, trim(regexp_replace(regexp_replace(lower(x), '\p{N}', '0', 'g'), '[^\p{L}0]+', ' ', 'g')) AS h
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
du AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM li GROUP BY r),
wi AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
tw AS (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM wi JOIN (SELECT r, g FROM wi GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
re AS (SELECT r, count(*) AS n FROM tw GROUP BY r),
ba AS (SELECT d.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  coalesce(du.n, 0) AS n_dup_lines, coalesce(re.n, 0) AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN du USING (r) LEFT JOIN re USING (r)),
ho AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
fr AS (SELECT d.host, h, min(doc_id) AS first, count(DISTINCT t) AS n FROM li JOIN d USING (r) GROUP BY ALL),
fq AS (SELECT fr.* FROM fr JOIN ho ON fr.host IS NOT DISTINCT FROM ho.host WHERE n > 2 AND n > 0.02 * docs),
lo AS (SELECT li.r, sum(length(x)) AS total, coalesce(sum(length(x)) FILTER (fq.h IS NOT NULL AND d.doc_id IS DISTINCT FROM fq.first), 0) AS lost
  FROM li JOIN d USING (r) LEFT JOIN fq ON d.host IS NOT DISTINCT FROM fq.host AND li.h = fq.h GROUP BY li.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(lost > 0 AND total - lost < 0.3 * total, false) AS kept
FROM ba LEFT JOIN lo USING (r)
"""

"""Elements to parent sections and retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.splits import parts
from quillspark.functions.text import has_latex, stable_id

MAX_CHARS, OVERLAP = 2800, 1
KINDS = {"paragraph": "text", "equation": "equation", "table": "table", "figure": "figure", "caption": "figure"}


def check(max_chars: int, overlap: int) -> None:
    if max_chars < 200:
        raise ValueError("max_chars must be at least 200")
    if overlap < 0:
        raise ValueError("overlap must not be negative")


def eligible(elements: DataFrame) -> DataFrame:
    return elements.where(~F.coalesce("retrieval_excluded", F.lit(False)))


def _section(c: Column) -> Column:
    name = F.concat_ws("\x00", c)
    return F.when(name == "", F.lit("root")).otherwise(name)


def parents(elements: DataFrame) -> DataFrame:
    """One row per paper and section: parent_chunk_id, content, element_ids, pages, position."""
    body = eligible(elements).where("text_level is null")
    rows = F.array_sort(F.collect_list(F.struct("seq", "element_id", "content")))
    grouped = body.groupBy("paper_id", "section_path").agg(rows.alias("r"), F.sort_array(F.collect_set("page")).alias("pages"), F.min("seq").alias("position"))
    return grouped.select("paper_id", "section_path", parent_id(F.col("paper_id"), F.col("section_path")).alias("parent_chunk_id"), F.array_join(F.transform("r", lambda x: x["content"]), "\n\n").alias("content"), F.transform("r", lambda x: x["element_id"]).alias("element_ids"), "pages", "position")


def pack(rows: Column, max_chars: int, overlap: int) -> Column:
    """Groups of places of rows (structs with n, the length, and section).

    A group ends where the section changes or the next row would pass max_chars; its last
    `overlap` rows open the next group if they and the row fit.
    """
    empty = F.array().cast("array<int>")
    size = lambda buf: F.aggregate(buf, F.lit(0), lambda s, j: s + F.get(rows, j)["n"] + 2)

    def add(s, i):
        buf, row = s["buf"], F.get(rows, i)
        ends = (F.size(buf) > 0) & (~F.get(rows, F.element_at(buf, F.when(F.size(buf) > 0, -1).otherwise(F.raise_error(F.lit("empty")).cast("int"))))["section"].eqNullSafe(row["section"]) | (size(buf) + row["n"] > max_chars))
        tail = F.slice(buf, F.greatest(F.size(buf) - overlap + 1, F.lit(1)), overlap) if overlap else empty
        kept = F.when(size(tail) + row["n"] <= max_chars, tail).otherwise(empty)
        return F.struct(F.concat(F.when(ends, kept).otherwise(buf), F.array(i)).alias("buf"), F.when(ends, F.concat(s["out"], F.array(buf))).otherwise(s["out"]).alias("out"))

    zero = F.struct(empty.alias("buf"), F.array().cast("array<array<int>>").alias("out"))
    places = F.sequence(F.lit(0), F.size(rows) - 1)
    return F.aggregate(places, zero, add, lambda s: F.concat(s["out"], F.array(s["buf"])))


def text_groups(rows: DataFrame, keys: list[str], max_chars: int, overlap: int, more: tuple[str, ...] = ()) -> DataFrame:
    """keys, members: arrays of rows (seq, element_id, page, content, section_path, more)."""
    item = F.struct("seq", "element_id", "page", "content", "section_path", *more, F.length("content").alias("n"), F.col("section_path").alias("section"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    groups = lists.select(*keys, "rows", F.explode(pack(F.col("rows"), max_chars, overlap)).alias("g"))
    return groups.select(*keys, F.transform("g", lambda i: F.get("rows", i)).alias("members"))


def equation_context(elements: DataFrame) -> DataFrame:
    """Add context: the nearest paragraphs around each row within its run of one section."""
    order = Window.partitionBy("paper_id").orderBy("seq")
    new = F.when(F.lag("section_path").over(order).eqNullSafe(F.col("section_path")), 0).otherwise(1)
    rows = elements.withColumn("_run", F.sum(new.cast("int")).over(order))
    rows = rows.withColumn("_prose", F.when((F.col("element_type") == "paragraph") & F.col("text_level").isNull(), F.col("content")))
    run = Window.partitionBy("paper_id", "_run").orderBy("seq")
    before = F.last("_prose", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_prose", ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("context", F.when(F.col("element_type") == "equation", F.concat_ws("\n\n", before, after)).otherwise("")).drop("_run", "_prose")


def parent_id(paper_id: Column, section_path: Column) -> Column:
    return stable_id("parent", paper_id, _section(section_path))


def chunk(elements: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Retrieval chunks of elements (see elements.parse for their columns).

    chunk_id, parent_chunk_id, paper_id, kind, content, context, element_ids, pages,
    section_path, char_count, contains_inline_latex, oversized, part_index, part_count.
    The elements are read once: one shuffle by paper for the order and one by the
    stretches between headings and other elements. An element that is no short prose is a
    stretch of its own; one UDF splits those that are long paragraphs or tables.
    """
    check(max_chars, overlap)
    rows = equation_context(eligible(elements)).where("text_level is null or text_level >= 1")
    order = Window.partitionBy("paper_id").orderBy("seq")
    prose = F.col("text_level").isNull() & (F.col("element_type") == "paragraph") & (F.length("content") <= max_chars)
    marked = rows.withColumn("prose", prose).withColumn("stretch", F.sum(F.when(prose, 0).otherwise(1)).over(order)).where("text_level is null")
    groups = text_groups(marked, ["paper_id", "stretch", "prose"], max_chars, overlap, ("element_type", "context"))
    first = F.get("members", F.lit(0))
    groups = groups.select("paper_id", "prose", "members", first["element_type"].alias("type"), F.when(F.col("prose"), "").otherwise(first["context"]).alias("context"), F.array_join(F.transform("members", lambda m: m["content"]), "\n\n").alias("whole"))
    long, table = ~F.col("prose") & (F.col("type") == "paragraph"), F.col("type") == "table"
    pieces = F.coalesce(parts(F.when(long | table, F.col("whole")), max_chars, table), F.array("whole"))
    cut = groups.withColumn("pieces", pieces).select("*", F.size("pieces").alias("part_count"), F.posexplode("pieces").alias("part_index", "content"))

    ids, section = F.transform("members", lambda m: m["element_id"]), first["section_path"]
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    kind = F.element_at(kinds, F.col("type"))
    return cut.select(
        "paper_id",
        section.alias("section_path"),
        stable_id("child", F.col("paper_id"), kind, ids, F.left(F.sha2("content", 256), F.lit(16))).alias("chunk_id"),
        kind.alias("kind"),
        "content",
        "context",
        ids.alias("element_ids"),
        F.array_sort(F.array_distinct(F.transform("members", lambda m: m["page"]))).alias("pages"),
        F.length("content").alias("char_count"),
        ((kind == "text") & has_latex(F.col("content"))).alias("contains_inline_latex"),
        (F.length("content") > max_chars).alias("oversized"),
        "part_index",
        "part_count",
        parent_id(F.col("paper_id"), section).alias("parent_chunk_id"),
    )


def kind_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

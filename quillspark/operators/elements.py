"""Parser items to typed, linked and sectioned elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize, stable_id

# The parser's item types and their element types.
TYPES = {
    "text": "paragraph",
    "aside_text": "paragraph",
    "page_footnote": "paragraph",
    "equation": "equation",
    "interline_equation": "equation",
    "inline_equation": "equation",
    "table": "table",
    "image": "figure",
    "figure": "figure",
    "chart": "figure",
    "image_caption": "caption",
    "figure_caption": "caption",
    "table_caption": "caption",
}
SKIPPED = ["header", "page_number"]
EXCLUDED = "page_footnote"
#: Item keys that have columns of their own; the others are kept as metadata.
OWN_KEYS = ["text", "content", "latex", "table_body", "bbox", "page_idx"]


def element_type(raw: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, raw), F.lit("paragraph"))


def unmapped(raw: Column) -> Column:
    return ~raw.isin(list(TYPES))


def _get(key: str, kind: str = "variant") -> Column:
    return F.try_variant_get("v", f"$.{key}", kind)


def _type(key: str) -> Column:
    return F.schema_of_variant(_get(key))


def _string(key: str) -> Column:
    return F.when(_type(key) == "STRING", _get(key, "string"))


def _list(key: str) -> Column:
    return F.when(_type(key).startswith("ARRAY"), F.filter(_get(key, "array<string>"), lambda x: x.isNotNull() & (x != "")))


def _first(*keys: Column) -> Column:
    return F.coalesce(*keys)


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _captioned(captions: list[str], bodies: list[str]) -> Column:
    """Parts of a table or chart; the first caption key of the right type ends the search
    even if it is empty."""
    caption = F.coalesce(*(F.coalesce(F.when(_string(k).isNotNull(), F.array(_string(k))), _list(k)) for k in captions), F.array().cast("array<string>"))
    body = F.coalesce(*(F.when(F.regexp_replace(_string(k), r"(?U)\s+", "") != "", _string(k)) for k in bodies))
    return F.array_join(F.when(body.isNotNull(), F.concat(caption, F.array(body))).otherwise(caption), "\n\n")


def _image() -> Column:
    path = F.trim(F.coalesce(_filled(_string("img_path")), _string("image_path")))
    return F.coalesce(F.when(path != "", F.concat(F.lit("Image: "), path)), F.lit(""))


def parse(items: DataFrame) -> DataFrame:
    """Elements of papers: items has paper_id, source_index, item (JSON text).

    Items that are no objects, skipped types and items without content are dropped
    before pages and boxes are checked; a bad page or box fails the job. Result:
    element_id, paper_id, seq, page, bbox, section_path, element_type, content,
    parent_id, prev_id, next_id, text_level, retrieval_excluded, unmapped_type, metadata.
    """
    rows = items.select("paper_id", F.col("source_index").cast("int").alias("source_index"), F.parse_json("item").alias("v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT")).withColumn("raw_type", F.coalesce(_get("type", "string"), F.lit("text"))).where(~F.col("raw_type").isin(SKIPPED))
    caption = lambda k: F.coalesce(_string(k), F.array_join(_list(k), "\n"))
    plain = F.array(*(_string(k) for k in ("text", "latex", "table_body", "content")), *(caption(k) for k in ("image_caption", "table_caption", "caption")))
    chosen = F.array_compact(F.when(F.col("raw_type") == "table", F.array(_captioned(["table_caption", "caption"], ["table_body", "text", "content"]))).when(F.col("raw_type") == "chart", F.array(_captioned(["chart_caption", "image_caption", "caption"], ["chart_body", "text", "content"]))).otherwise(plain))
    # One Python pass over all candidates of an item: joined, normalised, taken apart again.
    mark = "\ue000"
    candidates = F.split(normalize(F.array_join(chosen, f"\n{mark}\n")), mark)
    first = F.try_element_at(F.filter(F.transform(candidates, lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")), lambda x: x != ""), F.lit(1))
    image = F.when(F.col("raw_type") == "table", F.lit("")).otherwise(_image())
    rows = rows.withColumn("content", F.coalesce(first, image)).where("content <> ''")

    page = F.when(_get("page_idx").isNull(), 0).when((_type("page_idx") == "BIGINT") & (_get("page_idx", "bigint") >= 0), _get("page_idx", "int"))
    box = _get("bbox", "array<double>")
    has_box = _get("bbox").isNotNull() & ~F.is_variant_null(_get("bbox"))
    fine = ~has_box | F.coalesce((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()) & (box[2] >= box[0]) & (box[3] >= box[1]), F.lit(False))
    rows = rows.withColumn("page_idx", F.when(page.isNull(), F.raise_error(F.lit("invalid page_idx")).cast("int")).otherwise(page))
    rows = rows.withColumn("bbox", F.when(~fine, F.raise_error(F.lit("invalid bbox")).cast("struct<x1:double,y1:double,x2:double,y2:double>")).when(has_box, F.struct(*(box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))))
    level = F.when((_type("text_level") == "BIGINT") & (_get("text_level", "int") >= 1), _get("text_level", "int"))
    metadata = F.map_filter(F.col("v").cast("map<string,variant>"), lambda k, x: ~k.isin(OWN_KEYS))
    flag = lambda name, value, on: F.when(on, F.struct(F.lit(name).alias("k"), value.cast("variant").alias("v")))
    always, raw = F.lit(True), F.col("raw_type")
    flags = F.array_compact(F.array(flag("mineru_type", raw, always), flag("source_index", F.col("source_index"), always), flag("retrieval_excluded", always, raw == EXCLUDED), flag("unmapped_type", always, unmapped(raw))))
    kept = F.map_filter(metadata, lambda k, x: ~F.exists(flags, lambda f: f["k"] == k))
    told = F.to_json(F.map_concat(kept, F.map_from_entries(flags)))
    rows = rows.select(
        "paper_id",
        "source_index",
        stable_id("elem", F.col("paper_id"), F.col("source_index").cast("string"), F.col("page_idx").cast("string"), F.col("raw_type"), F.col("content")).alias("element_id"),
        F.row_number().over(Window.partitionBy("paper_id").orderBy("source_index")).alias("seq"),
        (F.col("page_idx") + 1).alias("page"),
        "bbox",
        element_type(F.col("raw_type")).alias("element_type"),
        "content",
        level.alias("text_level"),
        (F.col("raw_type") == EXCLUDED).alias("retrieval_excluded"),
        unmapped(F.col("raw_type")).alias("unmapped_type"),
        told.alias("metadata"),
    )
    return link(sections(rows), "paper_id", "seq", "element_id")


def sections(elements: DataFrame) -> DataFrame:
    """Add section_path and parent_id. A heading of level L is in force until the next
    heading of level L or less; the path lists the headings in force by level.

    The headings of a paper are folded to the stack that each of them leaves; an element
    has that of the last heading up to it.
    """
    stack = "array<struct<level:int,seq:long,text:string,id:string>>"
    head = F.struct(F.col("seq").cast("long").alias("seq"), F.col("text_level").cast("int").alias("level"), F.col("content").alias("text"), F.col("element_id").alias("id"))

    def add(s, h):
        now = F.concat(F.filter(s["now"], lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["seq"].alias("seq"), h["text"].alias("text"), h["id"].alias("id"))))
        return F.struct(now.alias("now"), F.concat(s["all"], F.array(now)).alias("all"))

    zero = F.struct(F.array().cast(stack).alias("now"), F.array().cast(f"array<{stack}>").alias("all"))
    found = elements.where("text_level is not null").groupBy(F.col("paper_id").alias("hp")).agg(F.array_sort(F.collect_list(head)).alias("heads"))
    left = found.select("hp", F.explode(F.aggregate("heads", zero, add)["all"]).alias("stack")).withColumn("hs", F.element_at("stack", -1)["seq"])
    last = F.last(F.when(F.col("text_level").isNotNull(), F.col("seq").cast("long")), ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("seq"))
    joined = elements.withColumn("_last", last).join(left, (F.col("paper_id") == F.col("hp")) & (F.col("_last") == F.col("hs")), "left")
    path = F.coalesce(F.transform("stack", lambda x: x["text"]), F.array().cast("array<string>"))
    above = F.filter("stack", lambda x: x["seq"] < F.col("seq"))
    return joined.withColumn("section_path", path).withColumn("parent_id", F.try_element_at(above, F.lit(-1))["id"]).drop("stack", "hp", "hs", "_last")


def link(rows: DataFrame, group: str, order: str, id_col: str) -> DataFrame:
    """Add prev_id and next_id in reading order."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("prev_id", F.lag(id_col).over(w)).withColumn("next_id", F.lead(id_col).over(w))


def papers(elements: DataFrame) -> DataFrame:
    """One row per paper: paper_id, title (first element of level 1, else the first)."""
    titled = F.min_by(F.when(F.col("text_level") == 1, F.col("content")), F.when(F.col("text_level") == 1, F.col("seq")))
    return elements.groupBy("paper_id").agg(F.coalesce(titled, F.min_by("content", "seq")).alias("title"), F.count(F.lit(1)).alias("n_elements"))

"""Files in and out: parser items, papers, chunk bundles, cases and reports."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

ELEMENT = "element_id string, seq int, page int, bbox array<double>, section_path array<string>, element_type string, content string, parent_id string, prev_id string, next_id string, text_level int, retrieval_excluded boolean, unmapped_type boolean, parser_version string, metadata string"
PAPER = f"paper_id string, title string, source_path string, sha256 string, elements array<struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>>"
INNER = ["char_count", "contains_inline_latex", "oversized", "part_index", "part_count"]
CHUNK = "chunk_id string, parent_chunk_id string, paper_id string, kind string, content string, context string, element_ids array<string>, pages array<int>, section_path array<string>, metadata struct<char_count:int,contains_inline_latex:boolean,oversized:boolean,part_index:int,part_count:int>"
PARENT = "parent_chunk_id string, paper_id string, section_path array<string>, content string, element_ids array<string>, pages array<int>, position int"
CASE = "query_id string, query string, relevant_chunk_ids array<string>, paper_id string, kind string, category string, annotator string, expected_answer string, notes string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def pdf_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, source_path, sha256) of PDF files; other suffixes fail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pdf = F.lower("path").endswith(".pdf")
    sha = F.when(pdf, F.sha2("content", 256)).otherwise(F.raise_error(F.concat(F.lit("expected a PDF file: "), "path")))
    return files.select("path", sha.alias("sha256")).select(F.concat(F.lit("paper_"), F.left("sha256", F.lit(16))).alias("paper_id"), F.col("path").alias("source_path"), "sha256")


def locate_items(spark: SparkSession, root: str, stem: str) -> str:
    """The one {stem}_content_list.json below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{stem}_content_list.json").load(root).select("path").limit(2).collect()
    if len(found) != 1:
        raise FileNotFoundError(f"expected exactly one {stem}_content_list.json below {root}")
    return found[0].path


def parser_items(spark: SparkSession, path: str, paper_id: str) -> DataFrame:
    """(paper_id, source_index, item) of a file that holds a JSON array."""
    text = spark.read.text(path, wholetext=True)
    checked = F.when(F.schema_of_variant(F.parse_json("value")).startswith("ARRAY"), F.col("value")).otherwise(F.raise_error(F.lit("the file must hold a JSON array")))
    items = F.from_json(checked, "array<variant>")
    return text.select(F.lit(paper_id).alias("paper_id"), F.posexplode(items).alias("source_index", "item")).withColumn("item", F.to_json("item"))


def _json(spark: SparkSession, path: str, schema, name: str | None = None) -> DataFrame:
    """Rows of JSON files, each of its own form: one object a line, or a whole file as one
    object or an array of them. Malformed files fail.

    The first line of each file that is not blank tells its form, so lines are read by Spark's
    line reader in parts of any size, and only files that are one value are read whole.
    """

    def files(reader):
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name) if name else reader

    lines = files(spark.read).text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    # A line that is a whole object begins a file of lines.
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("begin", "at")).alias("value"))
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    forms = first.select("file", (~whole).alias("whole")).groupBy("whole").agg(F.collect_list("file").alias("files")).collect()
    rows = spark.createDataFrame([], schema)
    for form in forms:
        rows = rows.union(spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", form.whole).json([unquote(f) for f in form.files]))
    return rows


def _as_json(columns: dict[str, str], present: list[str]) -> list[Column]:
    return [(F.col(c) if c in present else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]


def _columns(ddl: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}


def write_papers(elements: DataFrame, path: str, papers: DataFrame | None = None) -> None:
    """One JSON line per paper: its id, its columns in `papers` (title, source_path,
    sha256) and its elements in order of seq, a box as four numbers."""
    box = elements.withColumn("bbox", F.when(F.col("bbox").isNotNull(), F.array(*(f"bbox.{c}" for c in ("x1", "y1", "x2", "y2")))))
    item = F.struct("seq", F.struct(*_as_json(_columns(ELEMENT), box.columns)).alias("e"))
    nested = box.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(item).alias("e")))), lambda x: F.from_json(x["e"], f"e struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>")["e"]).alias("elements"))
    about = elements.select("paper_id").distinct() if papers is None else papers
    nested.join(about.select("paper_id", *_as_json({c: "string" for c in ("title", "source_path", "sha256")}, about.columns)), "paper_id", "full").write.mode("overwrite").json(path)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, source_path, sha256, elements) of a file or a folder of files."""
    return _json(spark, path, PAPER, "*.json")


def elements_of(papers: DataFrame) -> DataFrame:
    """The elements of papers, one a row; those without a seq are numbered in order."""
    rows = papers.select("paper_id", F.posexplode("elements").alias("at", "e")).select("paper_id", "at", "e.*")
    box = F.when(F.col("bbox").isNotNull(), F.struct(*(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2")))))
    return rows.withColumns({"bbox": box, "seq": F.coalesce("seq", F.col("at") + 1)}).drop("at")


def write_bundles(chunks: DataFrame, parents: DataFrame, path: str) -> None:
    """One JSON line per paper with its parents and children."""
    flat = chunks if "metadata" in chunks.columns else chunks.withColumn("metadata", F.struct(*_as_json(_columns(CHUNK.split("struct<")[1][:-1].replace(":", " ")), chunks.columns)))
    nest = lambda df, ddl, name: df.groupBy("paper_id").agg(F.collect_list(F.struct(*_as_json(_columns(ddl), df.columns))).alias(name))
    nest(flat, CHUNK, "children").join(nest(parents, PARENT, "parents"), "paper_id", "full").write.mode("overwrite").json(path)


def read_bundles(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(paper_id, parents, children) of a file, or of all files of that name below a folder."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(root)
    bundles = _json(spark, root, _bundle(), None if fs.getFileStatus(p).isFile() else pattern)
    if bundles.isEmpty():
        raise FileNotFoundError(f"no {pattern} below {root}")
    return bundles


def _bundle():
    return StructType([StructField("paper_id", StringType()), StructField("parents", ArrayType(StructType.fromDDL(PARENT))), StructField("children", ArrayType(StructType.fromDDL(CHUNK)))])


def chunks_of(bundles: DataFrame) -> DataFrame:
    """The chunks of bundles with the columns that chunks.chunk() gives them."""
    return bundles.select(F.inline("children")).select(*(c for c in _columns(CHUNK) if c != "metadata"), *(F.col(f"metadata.{c}").alias(c) for c in INNER))


def parents_of(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.inline("parents"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases; a missing file is an empty table."""
    return _json(spark, path, CASE) if exists(spark, path) else spark.createDataFrame([], CASE)


def write_cases(cases: DataFrame, path: str) -> None:
    """One file of JSON lines. It is written beside the target and then takes its place in
    one step, so a reader sees the old cases or the new ones. Cases are made by hand, so
    one file holds them."""
    spark = cases.sparkSession
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    cases.select(*_as_json(_columns(CASE), cases.columns)).coalesce(1).write.json(tmp)
    fs, folder = _fs(spark, tmp)
    written = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    hadoop = spark._jvm.org.apache.hadoop.fs
    if not written:  # no case at all
        written = [hadoop.Path(f"{tmp}/none")]
        fs.create(written[0]).close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop.Options, "Rename"), 1)
    how[0] = getattr(hadoop.Options, "Rename").OVERWRITE
    target = fs.makeQualified(_fs(spark, path)[1])
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(written[0]), target, how)
    fs.delete(folder, True)


def write_report(per_case: DataFrame, macro: DataFrame, path: str) -> None:
    per_case.write.mode("overwrite").json(f"{path}/cases")
    macro.coalesce(1).write.mode("overwrite").json(f"{path}/macro")

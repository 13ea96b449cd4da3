"""Files in: JSON in several shapes, lines, status exports, floors, markdown decisions, PDF listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_TEXT = T.StructType([T.StructField("heading", T.StringType()), T.StructField("body", T.StringType())])
_ARTICLE = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("texts", T.MapType(T.StringType(), _TEXT))])
#: A parsed document: its kind, what it says of itself, and its articles by language.
PARSED = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("source", T.StructType([T.StructField(n, T.StringType()) for n in ("lawNumber", "instrument", "publishedAt", "promulgatedAt")] + [T.StructField("titles", T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("articles", T.ArrayType(_ARTICLE)),
])


def parsed_documents(spark: SparkSession, folder: str, kind: str | None = None, schema: T.StructType = PARSED) -> DataFrame:
    """Documents of a folder of JSON files with their ``file``; unreadable ones and other kinds are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).withColumn("file", F.col("_metadata.file_name"))
    return rows.where(F.col("kind").isNotNull() if kind is None else F.col("kind") == kind)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest written by ``sinks.write_manifest``, with ``n_warnings``."""
    rows = spark.read.schema("file string, kind string, law_number string, n_articles long, warnings array<string>").json(folder)
    return rows.withColumn("n_warnings", F.size("warnings").cast("long"))


def article_rows(parsed: DataFrame) -> DataFrame:
    """(file, law_number, number, language, heading, body) of parsed documents."""
    articles = parsed.select("file", F.col("source.lawNumber").alias("law_number"), F.explode("articles").alias("a"))
    return articles.select("file", "law_number", F.col("a.number").alias("number"), F.explode("a.texts").alias("language", "t")).select("file", "law_number", "number", "language", "t.heading", "t.body")


def json_lines(spark: SparkSession, path: str, schema: str = "`from` string, `to` string, source string, target string", pair: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a JSON lines file; with ``pair``, those from and to these languages."""
    rows = spark.read.schema(schema).json(path)
    return rows if pair is None else rows.where((F.col("from") == pair[0]) & (F.col("to") == pair[1]))


def status_export(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records (of the DDL ``record``) of an export that is a bare array or wraps one in ``data``,
    ``results`` or ``items``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    names = ("data", "results", "items")
    wrapped = F.from_json("value", ", ".join(f"{n} array<struct<{record}>>" for n in names))
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<struct<{record}>>")).otherwise(F.coalesce(*(wrapped[n] for n in names)))
    return whole.select(F.inline(rows))


def floors(spark: SparkSession, path: str) -> dict[str, float]:
    """The floors of an artifact written by ``sinks.write_floors``; a missing or empty one is fatal."""
    rows = spark.read.schema("language string, floor double, derived_against string").json(path).collect()
    if not rows:
        raise FileNotFoundError(f"no floors at {path}")
    return {r["language"]: r["floor"] for r in rows}


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of all PDF files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(id, decision) of a markdown file: a heading ``## id`` followed by ``- [x] decision`` boxes."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    headed = whole.withColumn("id", F.last(F.nullif(F.regexp_extract("line", r"^##\s+(\S+)", 1), F.lit("")), ignorenulls=True).over(order))
    return headed.withColumn("decision", F.lower(F.trim(F.regexp_extract("line", r"^-\s*\[[xX]\]\s*(.+)$", 1)))).where("decision <> '' AND id IS NOT NULL").select("id", "decision")

"""Document collections: a tree of Markdown files, or the standard tables rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size, content) of all .md files below a folder; bytes that aren't UTF-8 drop the file, newlines are made \\n.

    Spark's file scan passes over files of no bytes, so an empty file has no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.filter(valid).select(T.below("path", folder).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("content"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder, whatever they are; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(T.below("path", folder).alias("path"))


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(path, error) of the .md files that read_tree leaves out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    return files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select(T.below("path", folder).alias("path"), F.lit("not UTF-8").alias("error"))


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, title_text, content): documents rendered as Markdown with the part of the same key."""
    documents, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    both = documents.select("doc_id", "text", "lang", "source").join(part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("doc_id") == F.col("p_partkey"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".md"))
    cell = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n"))
    key = F.col("doc_id").cast("string")
    content = F.concat(
        F.lit("# "), F.col("p_name"), F.lit("\n\n"), F.col("text"), F.lit("\n\n## Specs\n\nPart specification\n| Field | **Value** |\n|---|---|\n"),
        cell("brand", F.concat(F.lit("`"), F.col("p_brand"), F.lit("`"))), cell("type", F.col("p_type")), cell("size", F.concat(F.lit("*"), F.col("p_size").cast("string"), F.lit("*"))),
        F.lit("\n### Config\n```yaml\nsku: "), key, F.lit("\nbrand: "), F.col("p_brand"), F.lit("\n```\n\nSee [next](doc-"), F.lpad((F.col("doc_id") + 20).cast("string"), 6, "0"), F.lit(".md#specs) and [site](https://example.com/"), key,
        F.lit(") or [top](#specs) and <https://auto.example.com/"), key, F.lit(">.\n![diagram](img/"), key, F.lit(".png)\n"),
    )
    return both.select("doc_id", path.alias("path"), content.alias("content"))

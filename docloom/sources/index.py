"""The persisted index: one Parquet table for each relation, built from a collection and read back with column pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.plugins import embed
from docloom.operators import extract
from docloom.sources import images as pictures

TABLES = ("docs", "doc_tables", "doc_links", "doc_images", "doc_chunks", "code_blocks", "doc_embeddings")


def derived(docs: DataFrame, embedder: str = "hashed") -> dict[str, DataFrame]:
    """The relations that a document's own raw_content and content decide: all but docs itself and the validity of links."""
    raw = docs.select("path", F.col("raw_content").alias("content"))
    return {
        "doc_links": extract.links(raw),
        "doc_chunks": extract.chunks(raw),
        "code_blocks": extract.code_blocks(raw),
        "doc_embeddings": docs.filter("content <> ''").select("path", embed(F.col("content"), embedder).alias("embedding")),
    }


def build(docs: DataFrame, folder: str, embedder: str = "hashed", files: DataFrame | None = None, images: DataFrame | None = None, progress: Callable[[int, str], None] = lambda percent, name: None) -> DataFrame:
    """Writes the relations of docs(path, content) below a folder and gives the totals; an empty collection writes empty tables.

    The collection is read once for its tables and images and once for docs; the rest comes from the written docs. docs'
    content has the texts of its tables and images at its end, raw_content is as read. files(path) are all files that
    links may lead to, images those of sources.images. index_meta has one row: when, how many, with what, and the newest
    modification, for stale(). progress is told the percentage and name of each relation that is written."""
    spark, path = docs.sparkSession, F.col("path")

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        done.append(name)
        progress(100 * len(done) // (len(TABLES) + 1), name)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    done: list[str] = []
    tables = keep("doc_tables", extract.tables(docs))
    refs = extract.images(docs)
    refs = keep("doc_images", pictures.enriched(refs, images) if images is not None else refs)
    raw = F.col("content")
    rows = docs.select("*", T.title(raw, path).alias("title"), T.team(path).alias("team"), T.category(path).alias("category"), T.headings(raw).alias("headings"))
    rows = keep("docs", extract.enriched(rows, tables, pictures.ocr_section(refs) if images is not None else None))
    for name, df in derived(rows, embedder).items():
        keep(name, extract.resolved(df, rows, files.select("path").union(rows.select("path")) if files is not None else None) if name == "doc_links" else df)
    newest = F.max("modified") if "modified" in rows.columns else F.lit(None)
    features = ["tables", "links", "chunks", "code", "embeddings", *["images"] * (images is not None)]
    keep("index_meta", rows.agg(F.current_timestamp().alias("created"), F.count("*").alias("docs_count"), newest.cast("timestamp").alias("newest")).select("*", F.array(*map(F.lit, features)).alias("features"), F.lit(embedder).alias("embedder")))
    return totals(spark, folder)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """(created, docs_count, newest, features, embedder), one row."""
    return spark.read.parquet(f"{folder}/index_meta")


def stale(meta: DataFrame, docs: DataFrame) -> DataFrame:
    """(created, indexed, found, changed, stale): one row that tells whether docs(path, modified) has files that are newer than the index, or more or fewer."""
    now = docs.agg(F.count("*").alias("found"), F.max(F.col("modified").cast("timestamp")).alias("latest"))
    x = meta.select("created", F.col("docs_count").alias("indexed")).crossJoin(F.broadcast(now))  # one row each
    changed = F.coalesce(F.col("latest") > F.col("created"), F.lit(False))
    return x.select("created", "indexed", "found", changed.alias("changed"), (changed | (F.col("indexed") != F.col("found"))).alias("stale"))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(relation, n): rows of each relation."""
    out = None
    for name, df in load(spark, folder).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out

"""Incremental refresh: a stream of new or changed documents merged into all relations of an index, a version for each batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import extract
from docloom.sources import index

KEPT = 2  # versions that stay: the newest and the one before it, for readers that are still at it


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old but those whose path is in new, and the latest row of new for each path; both have path, modified and the same columns."""
    latest = new.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modified")))).filter("__n = 1").drop("__n")
    return old.join(latest.select("path"), "path", "left_anti").unionByName(latest)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions below a folder that are complete, in order."""
    fs, path = _path(spark, folder)
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "docs/_SUCCESS"))  # noqa: E731  docs is written last
    return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and done(p))


def latest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations of the newest version, for Library."""
    return index.load(spark, f"{folder}/v{versions(spark, folder)[-1]}")


def start(stream: DataFrame, folder: str, checkpoint: str, embedder: str = "hashed"):
    """Merges each micro-batch of (path, modified, content) into a new version of every relation below ``folder`` (v0, v1, ...).

    What a document's own text decides is worked out for the batch's documents alone and replaces their rows; links, whose
    validity hangs on other documents, are looked up anew. A batch that is run again writes the same version; versions
    before the last KEPT are deleted."""

    def merge(batch: DataFrame, n: int) -> None:
        spark, to = batch.sparkSession, f"{folder}/v{n}"
        before = [v for v in versions(spark, folder) if v < n]
        fresh = merged(batch.limit(0), batch)
        tables, refs, raw, path = extract.tables(fresh), extract.images(fresh), F.col("content"), F.col("path")
        rows = fresh.select("*", T.title(raw, path).alias("title"), T.team(path).alias("team"), T.category(path).alias("category"), T.headings(raw).alias("headings"))
        new = {"docs": extract.enriched(rows, tables), "doc_tables": tables, "doc_images": refs}
        new |= index.derived(new["docs"], embedder)
        old = index.load(spark, f"{folder}/v{before[-1]}") if before else {}
        gone = fresh.select("path")
        put = lambda name: reduce(DataFrame.unionByName, [old[name].select(new[name].columns).join(gone, "path", "left_anti"), new[name]]) if old else new[name]
        docs = put("docs")
        for name in (*(t for t in index.TABLES if t != "docs"), "docs"):
            df = put(name)
            (extract.resolved(df, docs) if name == "doc_links" else df).write.mode("overwrite").parquet(f"{to}/{name}")
        for v in before[: 1 - KEPT or None]:
            fs, where = _path(spark, f"{folder}/v{v}")
            fs.delete(where, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The folder tree of a collection, as a relation and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.search import in_folder

SKIPPED = ("node_modules", "__pycache__")


def _hidden(name: Column) -> Column:
    return name.startswith(".") | name.isin(*SKIPPED)


def tree(docs: DataFrame, folder: str = "", depth: int = 3) -> DataFrame:
    """(parent, name, is_file, depth, n_docs, size, is_last, key): entries below a folder, down to ``depth`` levels.

    Names are relative to the folder; folders come before files, each by lower-cased name, and ``key`` sorts the whole
    tree. n_docs and size count all documents below an entry, those in hidden folders too; hidden entries themselves
    (and node_modules, __pycache__) are left out. docs needs path and size; a path that climbs (..) finds nothing."""
    cut = folder.strip("/")
    parts = F.split(F.substring("path", len(cut) + 2 if cut else 1, 1 << 30), "/")
    x = in_folder(docs, cut or None).select(parts.alias("parts"), "size")
    x = x.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth))))).withColumn("own", F.slice("parts", 1, F.col("depth")))
    x = x.withColumn("is_file", F.col("depth") == F.size("parts")).filter(~F.exists("own", _hidden))
    x = x.groupBy("own", "is_file", "depth").agg(F.count("*").alias("n_docs"), F.sum("size").cast("long").alias("size"))
    rank = F.concat(F.when(F.col("is_file"), "1").otherwise("0"), F.lower(F.element_at("own", -1)), F.lit("\0"), F.element_at("own", -1))
    above = F.transform(F.slice("own", 1, F.col("depth") - 1), lambda p: F.concat(F.lit("0"), F.lower(p), F.lit("\0"), p))
    x = x.select(F.array_join(F.slice("own", 1, F.col("depth") - 1), "/").alias("parent"), F.element_at("own", -1).alias("name"), "is_file", "depth", "n_docs", "size", rank.alias("rank"), F.array_join(F.concat(above, F.array(rank)), "\1").alias("key"))
    last = x.groupBy("parent").agg(F.max("rank").alias("last"))  # combined on the map side, however many entries a folder has
    return x.join(last, "parent").select("parent", "name", "is_file", "depth", "n_docs", "size", (F.col("rank") == F.col("last")).alias("is_last"), "key")


def render(found: DataFrame, title: str = "", most: int = 10_000) -> str:
    """The tree as text, an entry a line; of more than ``most`` entries, the first ones and a note."""
    rows = found.orderBy("key").limit(most + 1).collect()
    out, bars = [f"Documentation Structure: {title}"], [""]
    for r in rows[:most]:
        bars[r.depth :] = [bars[r.depth - 1] + ("    " if r.is_last else "│   ")]
        note = f"📄 {r.name} ({r.size / 1024:.1f} KB)" if r.is_file else f"📁 {r.name}/ ({r.n_docs} docs)"
        out.append(bars[r.depth - 1] + ("└── " if r.is_last else "├── ") + note)
    return "\n".join(out + ["..."] * (len(rows) > most))

"""Rich context for search results: a section for each, of its structure, tables, images and links, within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.extract import link_stats
from docloom.operators.search import within_budget


def _block(title: str, body):
    return F.when(body != "", F.concat(F.lit(f"### {title}\n"), body, F.lit("\n")))


def _ordered(df: DataFrame, key: str, name: str, most: int | None = None) -> DataFrame:
    """(path, name): texts l of a document in the order of key, one a line; of more than ``most``, the first and a count."""
    x = df.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(key, "l"))), lambda s: s["l"]).alias("ls"))
    shown = F.slice("ls", 1, most) if most else F.col("ls")
    rest = F.when(F.size("ls") > most, F.format_string("\n  *(... and %d more)*", F.size("ls") - most)).otherwise("") if most else F.lit("")
    return x.select("path", F.concat(F.array_join(shown, "\n"), rest).alias(name))


def sections(found: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """(rank, path, section) of results(rank, path, score, match_type, excerpt); results whose document the index doesn't know are left out.

    The results are a search's top rows, a few: the index's relations are cut to their paths before anything is put together."""
    paths = F.broadcast(found.select("path").distinct())  # the result's limit bounds it
    of = lambda name: index[name].join(paths, "path", "left_semi")
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    tables = of("doc_tables")
    shown = F.when(F.col("row_count") <= 5, F.col("rows")).otherwise(F.slice("rows", 1, 3))
    more = F.when(F.col("row_count") > 5, F.format_string("\n*... and %d more rows*", F.col("row_count") - 3)).otherwise("")
    body = F.concat(row(F.col("headers")), F.lit("\n|"), F.repeat(F.lit("---|"), F.size("headers")), F.array_join(F.concat(F.array(F.lit("")), F.transform(shown, row)), "\n"), more)
    text = F.concat(F.format_string("**Table %d** ", F.col("table_index") + 1), F.coalesce("caption", F.lit("")), F.format_string("\n**Columns:** %s\n**Rows:** %d\n", F.array_join("headers", ", "), F.col("row_count")), body)
    t = _ordered(tables.withColumn("l", text), "table_index", "tables")
    i = _ordered(of("doc_images").withColumn("l", F.format_string("- **%s**: `%s`", F.when(F.col("alt") == "", "Untitled Image").otherwise(F.col("alt")), F.col("img_path"))), "pos", "images")
    links = of("doc_links")
    stats = link_stats(links).select("path", F.concat(F.format_string("**Links:** %d internal, %d external", "internal", "external"), F.when(F.col("broken") > 0, F.format_string("\n*%d broken link(s)*", "broken")).otherwise("")).alias("stats"))
    related = links.filter("type = 'internal' AND valid AND target LIKE '%.md'").select("path", "target").distinct()
    titles = index["docs"].select(F.col("path").alias("target"), F.col("title").alias("t"))
    r = _ordered(related.join(titles, "target", "left").withColumn("l", F.format_string("- [%s](%s)", F.coalesce("t", "target"), "target")), "target", "related", 5)
    x = found.select("rank", "path", "score", "match_type", "excerpt").join(of("docs").select("path", "title", "team", "category", "headings"), "path")
    for df in (t, i, stats, r):
        x = x.join(df, "path", "left")
    eight = F.array_join(F.transform(F.slice("headings", 1, 8), lambda h: F.concat(F.lit("- "), h)), "\n")
    eight = F.concat(eight, F.when(F.size("headings") > 8, F.format_string("\n  *(... and %d more sections)*", F.size("headings") - 8)).otherwise(""))
    head = F.format_string("## Result %d: %s\n**Location:** `%s`\n**Category:** %s/%s\n**Match:** %s (score: %.2f)\n", "rank", "title", "path", "team", "category", "match_type", "score")
    section = F.concat_ws("\n", head, _block("Content", F.coalesce("excerpt", F.lit(""))), _block("Document Structure", eight), _block("Tables", F.col("tables")), _block("Images", F.col("images")), _block("Related Documents", F.col("related")), F.col("stats"))
    return x.select(F.col("rank").cast("int").alias("rank"), "path", section.alias("section"), F.col("tables").isNotNull().alias("has_tables"), F.col("images").isNotNull().alias("has_images"))


def rich_context(query: str, found: DataFrame, index: dict[str, DataFrame], most: int = 8000) -> str:
    """The sections of a search's results as one text of about ``most`` characters, under a header and a summary."""
    every = sections(found, index)
    n = every.agg(F.count("*").alias("n"), F.count_if("has_tables").alias("t"), F.count_if("has_images").alias("i")).first()
    head = f"# Search Results for: {query}\n\n"
    summary = "\n".join([f"**Found {n.n} relevant document(s)**\n", *[f"- {n.t} with tables"] * (n.t > 0), *[f"- {n.i} with images"] * (n.i > 0)]) + "\n" if n.n else "*No results found.*\n"
    kept = within_budget(every.select("rank", "path", "section"), most, len(head) + len(summary)).orderBy("rank").collect()
    parts = [head, summary, *(r.section + "\n\n*[Content truncated...]*" * r.truncated for r in kept)]
    return "\n\n".join(parts + ["*[Additional results truncated...]*"] * (len(kept) < n.n and not any(r.truncated for r in kept)))

"""The engine's queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import extract, search, tree
from docloom.sources.corpus import md_docs, table


def _titled(s: SparkSession, d: str) -> DataFrame:
    return md_docs(s, d).withColumn("title", T.title(F.col("content"), F.col("path")))


def _plain(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"))


def _cut(docs: DataFrame, **more) -> DataFrame:
    return docs.select("path", *(c.alias(k) for k, c in more.items()))


def _blend(s: SparkSession, d: str) -> list[float]:
    a, b = (r.embedding for r in table(s, d, "embeddings").filter("vec_id IN (0, 1)").orderBy("vec_id").collect())
    return [x + y for x, y in zip(a, b, strict=True)]


def _tables(s, d):
    return extract.tables(md_docs(s, d))


def _resolved(s, d):
    docs = md_docs(s, d)
    return extract.resolved(extract.links(docs), docs)


def table_hits_query(s, d):
    return search.table_hits(_tables(s, d), "brand size").select("path", "table_index", "score")


def matching_rows(s, d):
    hits = search.table_hits(_tables(s, d), "brand size").select("path", "table_index", F.posexplode("matching_rows").alias("pos", "row"))
    return hits.select("path", "table_index", "pos", F.array_join("row", "|").alias("row"))


def _health(s, d):
    docs = md_docs(s, d)
    return extract.health(docs, _tables(s, d), extract.images(docs), _resolved(s, d))


def _related(s, d):
    return _resolved(s, d).filter("type = 'internal' AND valid AND target LIKE '%.md'").select("path", "target").distinct()


def semantic_fallback(s, d):
    miss = table(s, d, "embeddings").filter("vec_id BETWEEN 10 AND 17").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("v"))
    v = [r.v for r in miss.orderBy("i").collect()]
    found = search.semantic(table(s, d, "embeddings"), v).select(F.col("vec_id").cast("string").alias("path"), F.lit("semantic").alias("match_type"), "score")
    return search.or_else(found, search.exact(_titled(s, d), "red").select("path", "match_type", "score").orderBy(F.desc("score"), "path").limit(5))


def deep_search_merge(s, d):
    v = _blend(s, d)
    near = search.semantic(table(s, d, "embeddings"), v, 10).select(F.col("vec_id").alias("doc_id"), "score")
    docs = _titled(s, d)
    near = docs.join(F.broadcast(near), "doc_id").select("path", "title", "score", F.lit("semantic").alias("match_type"))  # ten rows at most
    return search.first_seen(search.exact(docs, "red"), near).orderBy(F.desc("score"), "path").limit(10).select("path", "title", "score", "match_type")


def rerank_blend(s, d):
    hits = search.content(_plain(s, d), "the")
    return search.reranked(hits, F.least(F.lit(1.0), F.length("excerpt") / 300.0), 10).select("path", "score", "match_type")


def context_budget(s, d):
    hits = search.content(_plain(s, d), "the").withColumn("n", F.col("path").cast("long")).orderBy("n").limit(20)
    sections = hits.select((F.col("n") + 1).alias("rank"), "path", F.col("excerpt").alias("section"))
    return search.within_budget(sections, 2000)


QUERIES = {
    "doc_scan": lambda s, d: _cut(md_docs(s, d), size=F.octet_length("content").cast("long"), digest=F.md5("content")),
    "path_parts": lambda s, d: _cut(md_docs(s, d), team=T.team(F.col("path")), category=T.category(F.col("path"))),
    "titles": lambda s, d: _titled(s, d).select("path", "title"),
    "headings": lambda s, d: md_docs(s, d).select("path", F.posexplode(T.headings(F.col("content"))).alias("pos", "heading")),
    "headings_per_team": lambda s, d: md_docs(s, d).select(T.team(F.col("path")).alias("team"), T.category(F.col("path")).alias("category"), F.size(T.headings(F.col("content"))).alias("n")).rollup("team", "category").agg(F.sum("n").cast("long").alias("headings")),
    "folder_counts": lambda s, d: extract.folder_counts(md_docs(s, d)),
    "table_islands": lambda s, d: _tables(s, d).select("path", "table_index", "line_start", "line_end", "caption", "row_count", "col_count"),
    "table_cells": lambda s, d: _tables(s, d).select("path", F.posexplode("rows").alias("row", "cells")).select("path", "row", F.posexplode("cells").alias("col", "cell")),
    "table_text": lambda s, d: _tables(s, d).select("path", extract.table_text().alias("text")),
    "get_table": lambda s, d: _tables(s, d).filter("path LIKE '%doc-000021.md' AND table_index = 0").select("path", F.array_join("headers", ",").alias("headers")),
    "search_tables": table_hits_query,
    "image_refs": lambda s, d: extract.images(md_docs(s, d)),
    "links": lambda s, d: extract.links(md_docs(s, d)),
    "links_html": lambda s, d: extract.links(table(s, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))).groupBy("type").agg(F.count("*").alias("n")),
    "link_validate": lambda s, d: _resolved(s, d).select("path", "url", "target", "valid"),
    "broken_links": lambda s, d: _resolved(s, d).filter("NOT valid").select("path", "url"),
    "link_stats": lambda s, d: extract.link_stats(_resolved(s, d)),
    "related_titles": lambda s, d: _resolved(s, d).filter("type = 'internal' AND valid AND target LIKE '%.md'").select("path", "target").distinct().join(_titled(s, d).select(F.col("path").alias("target"), "title"), "target", "left").select("path", "target", F.coalesce("title", "target").alias("title")),
    "code_blocks": lambda s, d: extract.code_blocks(md_docs(s, d)),
    "find_configs": lambda s, d: extract.code_blocks(search.exact(_titled(s, d), "red").select("path").join(md_docs(s, d), "path"), "yaml"),
    "chunks": lambda s, d: extract.chunks(md_docs(s, d)).select("path", "chunk_index", "token_count", F.md5("content").alias("digest"), F.array_join("heading_hierarchy", " > ").alias("headings")),
    "fixed_chunks": lambda s, d: extract.fixed_chunks(md_docs(s, d)).select("path", "chunk_index", F.md5("content").alias("digest")),
    "enrich_content": lambda s, d: extract.enriched(md_docs(s, d), _tables(s, d)).select("path", F.md5("content").alias("enriched"), F.md5("raw_content").alias("raw")),
    "exact_search": lambda s, d: search.exact(_titled(s, d), "red"),
    "exact_search_folder": lambda s, d: search.exact(_titled(s, d), "doc-", "src1/en"),
    "grep_search": lambda s, d: search.grep(_plain(s, d), "the").select("path", "score", F.md5("excerpt").alias("digest")),
    "content_search": lambda s, d: search.content(_plain(s, d), "the").select("path", "score", "excerpt"),
    "term_frequency": lambda s, d: table(s, d, "documents").select("doc_id", T.occurrences(F.col("text"), "the").alias("n")).filter("n > 0"),
    "fuzzy_titles": lambda s, d: search.fuzzy(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("title")), "red widgit").select("path", "score"),
    "semantic_topk": lambda s, d: search.semantic(table(s, d, "embeddings"), _blend(s, d), 5, -1.0),
    "semantic_threshold": lambda s, d: search.semantic(table(s, d, "embeddings"), _blend(s, d)),
    "vector_norms": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm")),
    "hybrid_search": lambda s, d: search.hybrid(_titled(s, d), "red"),
    "rerank_blend": rerank_blend,
    "context_budget": context_budget,
    "index_totals": lambda s, d: md_docs(s, d).select(F.size(T.headings(F.col("content"))).alias("h"), F.length("content").alias("n")).agg(F.count("*").alias("docs"), F.sum("h").alias("headings"), F.sum("n").alias("chars")),
    "conversation_search": lambda s, d: table(s, d, "conversations").filter(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn", T.occurrences(F.col("text"), "the").alias("n")),
    "get_file": lambda s, d: md_docs(s, d).filter("path LIKE '%/doc-000003.md'").select("path", F.format_string("%.1f KB", F.octet_length("content") / 1024.0).alias("size"), T.team(F.col("path")).alias("team")),
    "summary_inputs": lambda s, d: _cut(md_docs(s, d), text=F.md5(F.when(F.length("content") > 4000, F.concat(F.substring("content", 1, 4000), F.lit("\n...(truncated)"))).otherwise(F.col("content")))),
    "table_captions": lambda s, d: _tables(s, d).filter("caption IS NOT NULL").select("path", "table_index", "caption"),
    "list_tables": lambda s, d: _tables(s, d).select("path", "table_index", F.array_join("headers", ",").alias("headers"), "row_count", "col_count"),
    "matching_rows": matching_rows,
    "link_lines": lambda s, d: extract.link_lines(md_docs(s, d)).select("path", "url", "line"),
    "related_docs": _related,
    "chunk_stats": lambda s, d: extract.chunks(md_docs(s, d)).groupBy("path").agg(F.count("*").alias("chunks"), F.max("token_count").alias("longest")),
    "fuzzy_titles_weighted": lambda s, d: search.fuzzy(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("title")), "red widgit", scorer="weighted").select("path", "score"),
    "semantic_fallback": semantic_fallback,
    "knn_per_label": lambda s, d: search.semantic_per_group(table(s, d, "embeddings"), _blend(s, d), "label", 3),
    "deep_search_merge": deep_search_merge,
    "tree_listing": lambda s, d: tree.tree(md_docs(s, d).withColumn("size", F.octet_length("content"))).select("parent", "name", "is_file", "depth", "n_docs", "size", "is_last"),
    "index_health": _health,
    "benchmark_overlap": lambda s, d: table(s, d, "benchmark").filter(F.contains(F.lower("text"), F.lit("the"))).select("item_id", T.occurrences(F.col("text"), "the").alias("n")),
    "ragged_pad": lambda s, d: _tables(s, d).select("path", F.posexplode("rows").alias("row", "cells"), "col_count").select("path", "row", F.array_join(T.padded(F.col("cells"), F.col("col_count") + 1), "|").alias("padded")),
    "json_export": lambda s, d: search.exact(_titled(s, d), "red").select("path", F.to_json(F.struct("path", "score", "match_type")).alias("json")),
}

"""A collection with its index, and the tools and workflows over it: methods give DataFrames, ``call`` gives text."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import plugins
from docloom.functions import text as T
from docloom.operators import context, extract, search, tree
from docloom.sources import index


def table_text(t, most: int = 10) -> str:
    """A row of tables as Markdown, rows filled up to the header's width; of more than ``most`` rows, the first and a count."""
    line = lambda r: f"| {' | '.join([*r, *[''] * (len(t.headers) - len(r))])} |"
    out = [f"**{t.caption}**\n"] * bool(t.caption) + [line(t.headers), "|" + "---|" * len(t.headers), *map(line, t.rows[:most])]
    return "\n".join(out + [f"\n*... and {t.row_count - most} more rows*"] * (t.row_count > most))


class Library:
    """Relations of an index, and what its tools use: vectors of queries come from the embedder of the index's own."""

    def __init__(self, relations: dict[str, DataFrame], reranker: str = "none", embedder: str = "hashed", meta: DataFrame | None = None):
        self.of, self.reranker, self.embedder, self.meta = relations, reranker, embedder, meta
        self.docs = relations["docs"]

    @classmethod
    def open(cls, spark: SparkSession, folder: str, docs: DataFrame | None = None, reranker: str = "none", **build) -> Library:
        """The index below a folder; where there is none, it is built from docs, with index.build's options."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index_meta/_SUCCESS")
        if docs is not None and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            index.build(docs, folder, **build)
        meta = index.meta(spark, folder)
        return cls(index.load(spark, folder), reranker, meta.first().embedder, meta)

    def _ranked(self, found: DataFrame, query: str, limit: int) -> DataFrame:
        """(rank, path, title, score, match_type, excerpt, team, category, headings, image_count) of a search's rows, re-ranked if there are more than the limit."""
        docs = self.docs.select("path", "title", "team", "category", "headings", "content")
        images = self.of["doc_images"].groupBy("path").agg(F.count("*").alias("image_count"))
        x = found.select("path", "score", "match_type").join(docs, "path").withColumn("excerpt", T.excerpt(F.col("content"), query)).drop("content")
        model = plugins.RERANKERS[self.reranker](query, F.col("excerpt"))
        if model is not None:  # scores change only if there are more results than the limit, which a window over these few rows tells
            n = F.count("*").over(search.Window.partitionBy())
            more = search.reranked(x, model, 1 << 30).select("path", F.col("score").alias("new"), F.col("match_type").alias("kind"))
            x = x.withColumn("n", n).join(more, "path").withColumn("score", F.when(F.col("n") > limit, F.col("new")).otherwise(F.col("score"))).withColumn("match_type", F.when(F.col("n") > limit, F.col("kind")).otherwise(F.col("match_type"))).drop("n", "new", "kind")
        top = x.orderBy(F.desc("score"), "path").limit(limit).join(images, "path", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
        return top.withColumn("rank", F.row_number().over(search.Window.orderBy(F.desc("score"), "path")))  # limit rows

    def search_docs(self, query: str, folder: str | None = None, limit: int = 5) -> DataFrame:
        wide = 5 * limit if self.reranker != "none" else limit
        return self._ranked(search.hybrid(self.docs, query, wide, folder, gate=max(2 * limit, wide)), query, limit)

    def semantic_search(self, query: str, limit: int = 5) -> DataFrame:
        """Documents by their vectors; keyword results where no vector is near enough."""
        k = 3 * limit if self.reranker != "none" else limit
        vectors = self.of["doc_embeddings"].withColumnRenamed("path", "vec_id")
        near = search.semantic(vectors, plugins.query_vector(query, self.embedder), k).select(F.col("vec_id").alias("path"), "score", F.lit("semantic").alias("match_type"))
        wide = 5 * limit if self.reranker != "none" else limit
        words = search.hybrid(self.docs, query, wide, gate=max(2 * limit, wide)).select("path", "score", "match_type")
        return self._ranked(search.or_else(near, words), query, limit)

    def get_file(self, path: str) -> DataFrame:
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError("a path must lie below the collection's root")
        return self.docs.filter(F.col("path") == path).select("path", "team", F.format_string("%.1f KB", F.octet_length("raw_content") / 1024.0).alias("size"), F.col("raw_content").alias("content"))

    def list_structure(self, path: str = "", depth: int = 3) -> DataFrame:
        return tree.tree(self.docs.select("path", F.octet_length("raw_content").alias("size")), path, depth)

    def find_configs(self, query: str, language: str | None = None, limit: int = 10) -> DataFrame:
        """Up to three code blocks of each document that a search for "<query> config" finds."""
        hits = self.search_docs(f"{query} config", limit=limit).select("path", "rank", "title")
        blocks = self.of["code_blocks"].filter(F.col("language") == language) if language else self.of["code_blocks"]
        n = F.row_number().over(search.Window.partitionBy("path").orderBy("pos"))
        return blocks.join(F.broadcast(hits), "path").withColumn("n", n).filter("n <= 3").select("rank", "path", "title", "pos", "language", "code")  # limit rows

    def summary_inputs(self, topic: str, folder: str | None = None) -> DataFrame:
        top = self.search_docs(topic, folder, 10).filter("rank <= 5").select("path", "rank", "title")
        raw = F.col("raw_content")
        cut = F.when(F.length(raw) > 4000, F.concat(F.substring(raw, 1, 4000), F.lit("\n...(truncated)"))).otherwise(raw)
        return top.join(self.docs.select("path", cut.alias("text")), "path")

    def summarize_topic(self, topic: str, folder: str | None = None, backend: str = "first_paragraphs") -> str:
        rows = self.summary_inputs(topic, folder).orderBy("rank").collect()  # five
        return plugins.SUMMARIZERS[backend](topic, [(r.title, r.text) for r in rows])

    def search_tables(self, query: str, limit: int = 10, min_score: float = 0.3) -> DataFrame:
        return search.table_hits(self.of["doc_tables"], query, min_score, limit)

    def get_table(self, path: str, table_index: int) -> DataFrame:
        return self.of["doc_tables"].filter((F.col("path") == path) & (F.col("table_index") == table_index))

    def list_tables(self) -> DataFrame:
        return self.of["doc_tables"].select("path", "table_index", "caption", "headers", "row_count", "col_count")

    def health(self) -> DataFrame:
        return extract.health(self.docs, self.of["doc_tables"], self.of["doc_images"], self.of["doc_links"])

    def missing(self, path: str) -> str:
        """What to answer for a path that is no document."""
        below = search.in_folder(self.docs, path).limit(1).count()
        return f"{path} is a folder, not a file" if below else f"No file {path}"

    def staleness(self, docs: DataFrame) -> DataFrame:
        """One row: is the index older than the collection docs(path, modified), or of another size?"""
        return index.stale(self.meta, docs)

    def rich_context(self, query: str, found: DataFrame | None = None, most: int = 8000) -> str:
        return context.rich_context(query, self.search_docs(query) if found is None else found, self.of, most)

    # workflows

    def deep_search(self, query: str) -> DataFrame:
        """Keyword, vector and table results in one list of ten."""
        of_tables = self.search_tables(query, 5).groupBy("path").agg(F.max(F.col("score") * 100).alias("score")).join(self.docs.select("path", "title"), "path").withColumn("match_type", F.lit("table"))
        return self._ranked(search.first_seen(self.search_docs(query, limit=10), self.semantic_search(query, 10), of_tables), query, 10)

    def find_table(self, description: str) -> DataFrame:
        return self.search_tables(description, 5).join(self.docs.select("path", "title", F.col("headings")), "path")

    def explain_topic(self, topic: str) -> str:
        """A summary, then tables and code on a topic."""
        tables = [table_text(t) for t in self.search_tables(topic, 3).orderBy(F.desc("score"), "path").collect()]
        code = [f"```{b.language or ''}\n{b.code}\n```" for b in self.find_configs(topic).orderBy("rank", "pos").collect()]
        return "\n\n".join([self.summarize_topic(topic), self.rich_context(topic, self.semantic_search(topic, 10)), *tables, *code])

    def find_config(self, config_type: str, language: str | None = None) -> DataFrame:
        return self.find_configs(config_type, language).join(self.docs.select("path", "headings"), "path")

    def explore_docs(self, folder_path: str = "") -> DataFrame:
        """(path, title, summary, tables, images, links): the first paragraph that isn't a heading, and counts, of each document below a folder."""
        first = F.get(F.filter(F.transform(F.split("raw_content", "\n\n"), T.strip), lambda p: (p != "") & ~p.startswith("#")), F.lit(0))
        x = search.in_folder(self.docs, folder_path or None).select("path", "title", first.alias("summary"))
        for name in ("tables", "images", "links"):
            n = self.of[f"doc_{name}"].groupBy("path").agg(F.count("*").alias(name))
            x = x.join(n, "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
        return x

    def quick_answer(self, question: str) -> str:
        """The context of the three nearest documents, and the best table."""
        tables = self.search_tables(question, 1).collect()
        return "\n\n".join([self.rich_context(question, self.semantic_search(question, 3)), *map(table_text, tables)])


TOOLS = ("search_docs", "semantic_search", "get_file", "list_structure", "find_configs", "summarize_topic", "search_tables", "get_table", "list_tables", "rich_context", "health")
SKILLS = {"deep-search": "deep_search", "find-table": "find_table", "explain-topic": "explain_topic", "find-config": "find_config", "explore-docs": "explore_docs", "quick-answer": "quick_answer"}


#: what each workflow is for and how long it takes as a rule
MANIFEST = {
    "deep-search": ("search", "keywords, vectors and tables in one list", "seconds"),
    "find-table": ("data", "tables that match a description", "seconds"),
    "explain-topic": ("summary", "a summary with context, tables and code", "tens of seconds"),
    "find-config": ("code", "configuration blocks, by language", "seconds"),
    "explore-docs": ("navigation", "documents below a folder with counts", "seconds"),
    "quick-answer": ("answer", "context of the nearest documents and the best table", "seconds"),
}
_KINDS = {"str": "string", "int": "integer", "float": "number"}


def arguments(name: str) -> dict[str, inspect.Parameter]:
    """The arguments of a tool or workflow that a caller may give as plain values."""
    found = inspect.signature(getattr(Library, SKILLS.get(name, name))).parameters
    return {k: p for k, p in found.items() if k != "self" and str(p.annotation).split(" ")[0] in _KINDS}


def schema(name: str) -> dict:
    """JSON schema of a tool's or workflow's arguments."""
    given = arguments(name)
    kinds = {k: {"type": _KINDS[str(p.annotation).split(" ")[0]]} | ({} if p.default is p.empty or p.default is None else {"default": p.default}) for k, p in given.items()}
    return {"name": name, "description": (getattr(Library, SKILLS.get(name, name)).__doc__ or name.replace("_", " ")).split("\n")[0], "parameters": {"type": "object", "properties": kinds, "required": [k for k, p in given.items() if p.default is p.empty]}}


def parsed(name: str, given: dict[str, str]) -> dict:
    """Arguments given as text, as the types that the tool's signature names; unknown ones are refused by the call itself."""
    known = arguments(name)
    make = {"int": int, "float": float}
    return {k: make.get(str(known[k].annotation).split(" ")[0], str)(v) if k in known else v for k, v in given.items()}


def image_text(i) -> str:
    """A row of images as Markdown: its name, what is known of its file, and the text in it (200 characters at most)."""
    known = i.asDict()
    size = f" ({known['width']}x{known['height']} {known['format']})" if known.get("width") else ""
    text = known.get("ocr_text") or ""
    return f"![{i.alt}]({i.img_path}){size}" + (f"\n> {text[:200]}{'...' if len(text) > 200 else ''}" if text else "")


def rows_text(found: DataFrame, most: int = 100) -> str:
    """A result as JSON lines, at most ``most`` of them."""
    rows = found.select(F.to_json(F.struct("*"))).limit(most).collect()
    return "\n".join(r[0] for r in rows)


def results_text(query: str, found: DataFrame) -> str:
    rows = found.orderBy("rank").collect()
    out = [f"Found {len(rows)} documentation matches for '{query}':"] if rows else [f"No documentation found for '{query}'"]
    for r in rows:
        out.append(f"\n{r.rank}. **{r.title}**\n   Path: `{r.path}`\n   Team: {r.team} | Category: {r.category}\n   Score: {r.score:.1f} ({r.match_type} match)\n   {r.excerpt}" + f"\n   📷 Contains {r.image_count} image(s)" * (r.image_count > 0))
    return "\n".join(out)


RENDERERS: dict[str, Callable] = {
    "search_docs": lambda found, **a: results_text(a["query"], found),
    "semantic_search": lambda found, **a: results_text(a["query"], found),
    "deep_search": lambda found, **a: results_text(a["query"], found),
    "list_structure": lambda found, **a: tree.render(found, re.sub(".*/", "", a.get("path", "").rstrip("/"))),
    "search_tables": lambda found, **_: "\n\n".join(f"`{t.path}` table {t.table_index} (score {t.score:.2f})\n{table_text(t)}" for t in found.orderBy(F.desc("score"), "path", "table_index").collect()),
    "get_table": lambda found, **_: "\n".join(map(table_text, found.collect())),
}


def call(library: Library, tool: str, **arguments) -> str:
    """A tool or workflow by name, as text; an error is told, not raised."""
    name = SKILLS.get(tool, tool)
    if name not in (*TOOLS, *SKILLS.values()):
        return f"Unknown tool: {tool}"
    try:
        found = getattr(library, name)(**arguments)
        if name == "get_file":
            rows = found.collect()
            return "\n".join(f"{r.path} ({r['size']}, {r.team})\n\n{r.content}" for r in rows) or library.missing(arguments["path"])
        return found if isinstance(found, str) else RENDERERS.get(name, lambda f, **_: rows_text(f))(found, **arguments)
    except Exception as e:  # noqa: BLE001
        return f"Error in {tool}: {e}"

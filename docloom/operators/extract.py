"""Relations drawn from Markdown: tables, links, images, code blocks, chunks and folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def tables(docs: DataFrame) -> DataFrame:
    """(path, table_index, headers, rows, line_start, line_end, caption, row_count, col_count): islands of row lines that begin with a header and a separator.

    A document is matched as a whole and its rows come from its own matches: no line is exploded, nothing is shuffled.
    Lines are counted by the newlines of the matches and of the texts between them."""
    between, blocks = F.split("content", T.TABLE, -1), F.regexp_extract_all("content", F.lit(T.TABLE), F.lit(0))
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    x = docs.filter(F.contains("content", F.lit("|"))).select("path", blocks.alias("blocks"), between.alias("between"))
    x = x.withColumn("gaps", F.transform("between", newlines)).withColumn("own", F.transform("blocks", newlines))
    total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, g: a + g)
    start = lambda i: (total(F.col("gaps"), i + 1) + total(F.col("own"), i)).cast("int")
    x = x.select("path", F.posexplode(F.transform("blocks", lambda b, i: F.struct(b.alias("block"), start(i).alias("line_start"), F.try_element_at(F.split(F.get("between", i), "\n"), F.lit(-2)).alias("before")))).alias("table_index", "t"))
    x = x.select("path", "table_index", "t.line_start", F.split("t.block", "\n").alias("lines"), T.strip(F.col("t.before")).alias("before"))
    caption = F.when((F.col("before") != "") & ~F.col("before").rlike(r"^[#|]"), F.col("before"))
    body = F.filter(F.slice("lines", 2, F.size("lines")), lambda z: ~z.rlike(T.SEPARATOR))
    y = x.select("path", "table_index", T.cells(F.get("lines", F.lit(0))).alias("headers"), body.alias("body"), "line_start", (F.col("line_start") + F.size("lines") - 1).alias("line_end"), caption.alias("caption"))
    return y.select("path", "table_index", "headers", F.transform("body", T.cells).alias("rows"), "line_start", "line_end", "caption", F.size("body").alias("row_count"), F.size("headers").alias("col_count"))


def table_text(headers="headers", rows="rows", caption="caption"):
    """A table as lines of text: its caption, its header and its rows, cells between bars."""
    head = F.when(F.col(caption) != "", F.concat(F.lit("Table: "), F.col(caption)))
    return F.concat_ws("\n", head, F.array_join(headers, " | "), F.nullif(F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n"), F.lit("")))


def enriched(docs: DataFrame, tables: DataFrame, image_text: DataFrame | None = None) -> DataFrame:
    """docs with raw_content and, as content, what a search should find: the text, its tables as text in their order, the texts of its images."""
    texts = tables.select("path", "table_index", table_text().alias("t")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("table_index", "t"))).alias("ts"))
    x = docs.join(texts.select("path", F.array_join(F.transform("ts", lambda z: z["t"]), "\n\n").alias("table_text")), "path", "left")
    x = x.join(image_text.select("path", "image_ocr_text"), "path", "left") if image_text is not None else x.withColumn("image_ocr_text", F.lit(None).cast("string"))
    return x.withColumn("raw_content", F.col("content")).withColumn("content", F.concat_ws("\n\n", "raw_content", "table_text", "image_ocr_text")).drop("table_text", "image_ocr_text")


def links(docs: DataFrame) -> DataFrame:
    """(path, url, text, type): Markdown links, then HTML links, then bare ones."""
    c = F.col("content")
    group = lambda pattern, i: F.regexp_extract_all(c, F.lit(pattern), F.lit(i))
    pair = lambda u, t: F.transform(F.arrays_zip(u.alias("u"), t.alias("t")), lambda z: F.struct(z["u"].alias("url"), F.when(z["t"] == "", z["u"]).otherwise(z["t"]).alias("text")))
    auto = F.transform(group(T.AUTO_LINK, 1), lambda u: F.struct(u.alias("url"), u.alias("text")))
    found = docs.select("path", F.explode(F.concat(pair(group(T.MD_LINK, 2), group(T.MD_LINK, 1)), pair(group(T.HTML_LINK, 1), group(T.HTML_LINK, 2)), auto)).alias("l"))
    url = T.strip(F.col("l.url"))
    kind = F.when(url.rlike("^https?://"), "external").when(url.startswith("#"), "anchor").otherwise("internal")
    return found.select("path", F.col("l.url").alias("url"), F.col("l.text").alias("text"), kind.alias("type"))


def places(paths: DataFrame) -> DataFrame:
    """(path): files and all folders above them, each once."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()


def resolved(found: DataFrame, docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """links with target and valid: internal targets are cut at #, joined to the file's folder, freed of . and .., and looked up
    among all files(path), or the documents where these aren't given, and the folders above them."""
    x = found.withColumn("target", F.when(F.col("type") == "internal", T.resolved(F.col("path"), F.col("url"))))
    known = places((files if files is not None else docs).select("path")).select(F.col("path").alias("target"), F.lit(True).alias("there"))
    return x.join(known, "target", "left").select("path", "url", "text", "type", "target", ((F.col("type") != "internal") | F.coalesce("there", F.lit(False))).alias("valid"))


def link_stats(found: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return found.groupBy("path").agg(F.count("*").alias("total"), n(F.col("type") == "internal").alias("internal"), n(F.col("type") == "external").alias("external"), n(F.col("type") == "anchor").alias("anchor"), n("valid").alias("valid"), n(~F.col("valid")).alias("broken"))


def images(docs: DataFrame) -> DataFrame:
    c = F.col("content")
    md = F.transform(F.arrays_zip(F.regexp_extract_all(c, F.lit(T.MD_IMAGE), F.lit(2)).alias("u"), F.regexp_extract_all(c, F.lit(T.MD_IMAGE), F.lit(1)).alias("t")), lambda z: F.struct(z["u"].alias("img_path"), z["t"].alias("alt")))
    html = F.transform(F.regexp_extract_all(c, F.lit(T.HTML_IMAGE), F.lit(1)), lambda u: F.struct(u.alias("img_path"), F.lit("").alias("alt")))
    return docs.select("path", F.posexplode(F.concat(md, html)).alias("pos", "i")).select("path", "pos", "i.img_path", "i.alt")


def code_blocks(docs: DataFrame, language: str | None = None) -> DataFrame:
    c = F.col("content")
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(T.FENCE), F.lit(1)).alias("language"), F.regexp_extract_all(c, F.lit(T.FENCE), F.lit(2)).alias("code"))
    out = docs.select("path", F.posexplode(both).alias("pos", "b")).select("path", "pos", F.nullif(F.col("b.language"), F.lit("")).alias("language"), T.strip(F.col("b.code")).alias("code"))
    return out.filter(F.col("language") == language) if language else out


def chunk_text(text: str, most: int) -> list[dict]:
    """The chunks of one text, in one pass over its lines: see chunks()."""
    out, lines, n, stack = [], [], 0, []

    def emit(headings):
        whole = "\n".join(lines)
        out.append({"content": whole.strip(), "heading_hierarchy": headings, "token_count": len(whole) // 4})

    for line in text.split("\n"):
        if line.strip().startswith("#"):
            title = line.lstrip("#")
            level = len(line) - len(title)
            while stack and stack[-1][0] >= level:
                stack.pop()
            if level <= 2 and lines:
                emit([t for _, t in stack])
                lines, n = [], 0
            stack.append((level, title.strip()))
        n += len(line) + (1 if lines else 0)
        lines.append(line)
        if n > most:
            emit([t for _, t in stack])
            lines, n = [], 0
    if lines:
        emit([t for _, t in stack])
    return out


CHUNKS = pa.list_(pa.struct([("content", pa.string()), ("heading_hierarchy", pa.list_(pa.string())), ("token_count", pa.int32())]))


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[pa.Array]:
    """An array of texts in its order, in slices of so many bytes at most (256 for a row beside its text), or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 256)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield texts.slice(start, stop - start)
        start = stop


def chunked(batches: Iterator[pa.Array], most: int) -> Iterator[pa.Array]:
    """The chunks of each text, null for a null one; sent back by slices, so that a Python worker never holds a batch of texts with all its chunks."""
    for texts in batches:
        for part in slices(texts):
            yield pa.array([None if t is None else chunk_text(t, most) for t in part.to_pylist()], CHUNKS)


def chunks(docs: DataFrame, max_tokens: int = 512) -> DataFrame:
    """(path, chunk_index, content, heading_hierarchy, token_count): lines in order, with a stack of headings; cuts before
    headings of level 1 and 2 and after max_tokens * 4 characters. One pass over each text, in slices of Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return chunked(batches, 4 * max_tokens)

    made = F.arrow_udf(run, "array<struct<content:string,heading_hierarchy:array<string>,token_count:int>>")
    return docs.select("path", F.posexplode(made(F.col("content"))).alias("chunk_index", "k")).select("path", "chunk_index", "k.*")


def fixed_chunks(docs: DataFrame, width: int = 2048) -> DataFrame:
    x = docs.filter(F.length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), F.expr(f"(length(content) - 1) div {width}"))).alias("chunk_index"))
    return x.select("path", "chunk_index", F.substring("content", F.col("chunk_index") * width + 1, F.lit(width)).alias("content"))


def folder_counts(docs: DataFrame) -> DataFrame:
    """(folder, n_docs): Markdown files below every folder, at any depth; the root is ''."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return docs.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_docs"))


def link_lines(docs: DataFrame) -> DataFrame:
    """(path, url, text, line): Markdown links with the line, from 1, on which each begins; a link may span lines.

    The text is split at the links' own beginnings, so that the count of newlines before the i-th link is a running sum."""
    c = F.col("content")
    group = lambda i: F.regexp_extract_all(c, F.lit(T.MD_LINK), F.lit(i))
    between = F.split(c, T.MD_LINK, -1)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    both = F.arrays_zip(group(0).alias("whole"), group(2).alias("url"), group(1).alias("text"), F.slice(between, 1, F.size(between) - 1).alias("before"))
    x = docs.select("path", F.posexplode(both).alias("pos", "l")).select("path", "pos", "l.url", "l.text", newlines(F.col("l.before")).alias("gap"), newlines(F.col("l.whole")).alias("own"))
    before = Window.partitionBy("path").orderBy("pos")
    line = 1 + F.sum("gap").over(before) + F.coalesce(F.sum("own").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("path", "url", "text", line.cast("int").alias("line"))


def health(docs: DataFrame, tables: DataFrame, images: DataFrame, links: DataFrame) -> DataFrame:
    """One row of totals: files, files with tables and images, tables, images, links and broken links. Four aggregates of one row each are put together."""
    n = docs.agg(F.count("*").alias("files"))
    t = tables.groupBy("path").count().agg(F.count("*").alias("files_with_tables"), F.coalesce(F.sum("count"), F.lit(0)).alias("tables"))
    i = images.groupBy("path").count().agg(F.count("*").alias("files_with_images"), F.coalesce(F.sum("count"), F.lit(0)).alias("images"))
    k = links.agg(F.count("*").alias("links"), F.count_if(~F.col("valid")).alias("broken_links"))
    return n.crossJoin(t).crossJoin(i).crossJoin(k)


def picture_text(annotations="annotations", fallback: str = "picture"):
    """A picture's annotations(kind, label, text) as lines: its class, its molecule and its description; the fallback where there are none."""
    line = lambda a: F.when(a["kind"] == "class", F.concat(F.lit("Picture type: "), a["label"])).when(a["kind"] == "molecule", F.concat(F.lit("SMILES: "), a["text"])).when(a["kind"] == "description", a["text"])
    found = F.array_join(F.filter(F.transform(annotations, line), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(fallback))

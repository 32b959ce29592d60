"""Exact, line, content, fuzzy, vector and hybrid search, re-ranking and context assembly, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.fuzzy import indel, partial, weighted


def _query(q: str) -> str:
    if not q:
        raise ValueError("a query must not be empty")
    return q.lower()


def in_folder(docs: DataFrame, folder: str | None, raw: bool = False) -> DataFrame:
    """Documents below a folder; with raw, those whose path merely starts with the text ("a" also takes "ab/...")."""
    return docs.filter(F.col("path").startswith(folder if raw else folder.rstrip("/") + "/")) if folder else docs


def exact(docs: DataFrame, q: str, folder: str | None = None) -> DataFrame:
    """Path hits score 100, title hits 95."""
    q = _query(q)
    score = F.when(F.contains(F.lower("path"), F.lit(q)), 100.0).when(F.contains(F.lower("title"), F.lit(q)), 95.0)
    return in_folder(docs, folder).withColumn("score", score).filter("score IS NOT NULL").select("path", "title", "score", F.lit("exact").alias("match_type"))


def grep(docs: DataFrame, q: str, folder: str | None = None, regex: bool = False) -> DataFrame:
    """The first three lines of a document that match, with two lines around each; the first five of these count for the score, 70 and 5 for each hit, at most 90."""
    order = Window.partitionBy("path").orderBy("ln")
    hit = F.col("line").rlike("(?i)" + q) if regex else F.contains(F.lower("line"), F.lit(_query(q)))
    x = in_folder(docs, folder).filter(F.col("content").rlike("(?i)" + q) if regex else F.contains(F.lower("content"), F.lit(_query(q))))
    x = x.select("path", "title", F.posexplode(T.lines(F.col("content"))).alias("ln", "line")).withColumn("hit", hit.cast("int"))
    x = x.withColumn("hit", F.when(F.sum("hit").over(order) <= 3, F.col("hit")).otherwise(0)).withColumn("near", F.max("hit").over(order.rowsBetween(-2, 2))).filter("near = 1")
    x = x.withColumn("n", F.row_number().over(order)).filter("n <= 5")
    x = x.groupBy("path", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda s: s["line"]), "\n").alias("excerpt"))
    return x.withColumn("score", F.least(F.lit(90.0), F.lit(70.0) + 5 * T.occurrences(F.col("excerpt"), q))).select("path", "title", "score", F.lit("grep").alias("match_type"), "excerpt")


def content(docs: DataFrame, q: str, folder: str | None = None) -> DataFrame:
    """Literal hits anywhere: 60 and 5 for each, at most 85, with an excerpt."""
    x = in_folder(docs, folder).filter(F.contains(F.lower("content"), F.lit(_query(q))))
    return x.select("path", "title", F.least(F.lit(85.0), F.lit(60.0) + 5 * T.occurrences(F.col("content"), q)).alias("score"), F.lit("content").alias("match_type"), T.excerpt(F.col("content"), q).alias("excerpt"))


def fuzzy(docs: DataFrame, q: str, k: int = 5, least: float = 60.0, folder: str | None = None, scorer: str = "indel") -> DataFrame:
    """The k titles nearest to a query: by the Indel ratio of lower-cased titles, in built-in functions, or by the weighted ratio ("weighted", case kept)."""
    ratio = weighted(F.col("title"), q) if scorer == "weighted" else indel(F.lower("title"), _query(q))
    x = in_folder(docs, folder).withColumn("ratio", F.round(ratio, 6)).orderBy(F.desc("ratio"), "path").limit(k).filter(F.col("ratio") > least)
    return x.select("path", "title", F.round(F.col("ratio") * 0.8, 6).alias("score"), F.lit("fuzzy").alias("match_type"))


def semantic(vectors: DataFrame, q: list[float], k: int = 5, least: float = 0.6) -> DataFrame:
    """(vec_id, similarity, score) of the k most similar vectors that reach ``least``; vectors without a length have no similarity."""
    sim = T.cosine(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(v)) for v in q]))
    x = vectors.select("vec_id", F.round(sim, 6).alias("similarity")).filter("similarity IS NOT NULL AND NOT isnan(similarity)")
    return x.orderBy(F.desc("similarity"), "vec_id").limit(k).filter(F.col("similarity") >= least).withColumn("score", F.round(F.col("similarity") * 100, 4))


def semantic_per_group(vectors: DataFrame, q: list[float], group: str, k: int) -> DataFrame:
    """(group, rank, vec_id, similarity): the k most similar vectors of each group."""
    sim = T.cosine(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(v)) for v in q]))
    x = vectors.select(group, "vec_id", F.round(sim, 6).alias("similarity")).filter("similarity IS NOT NULL AND NOT isnan(similarity)")
    order = Window.partitionBy(group).orderBy(F.desc("similarity"), "vec_id")  # Spark cuts each map task's groups to k rows before it shuffles
    return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(group, "rank", "vec_id", "similarity")


def or_else(found: DataFrame, other: DataFrame) -> DataFrame:
    """found, or other where found has no row: decided in the plan, without a job of its own."""
    none = found.agg((F.count("*") == 0).alias("none"))
    return found.unionByName(other.crossJoin(F.broadcast(none)).filter("none").drop("none"))  # one row


def first_seen(*found: DataFrame) -> DataFrame:
    """One row for each path, of the first search that has it."""
    every = [f.select("path", "title", "score", "match_type").withColumn("strategy", F.lit(i)) for i, f in enumerate(found)]
    out = every[0]
    for f in every[1:]:
        out = out.unionByName(f)
    first = F.row_number().over(Window.partitionBy("path").orderBy("strategy", F.desc("score")))
    return out.withColumn("n", first).filter("n = 1").drop("n")


def hybrid(docs: DataFrame, q: str, limit: int = 10, folder: str | None = None, gate: int | None = None) -> DataFrame:
    """Exact hits, then lines while there are fewer than the gate (2 * limit by default), then titles; first seen, best first.

    Whether a search is needed is decided in the plan: the documents of the next one pass a broadcast row that tells it, so
    that nothing is counted ahead and a search that isn't needed reads no lines."""
    cap, one = gate or 2 * limit, exact(docs, q, folder)
    counted = lambda f: F.broadcast(f.select("path").limit(cap).agg(F.count("*").alias("n")))  # noqa: E731  one row
    past = lambda d, n: d.crossJoin(n).filter(F.col("n") < cap).drop("n")
    first = counted(one)
    two = grep(past(docs, first), q, folder)
    both = F.broadcast(counted(two).select(F.col("n").alias("m")).crossJoin(first).select((F.col("n") + F.col("m")).alias("n")))
    three = fuzzy(past(docs.select("path", "title"), both), q, folder=folder, scorer="weighted")
    return first_seen(one, two, three).orderBy(F.desc("score"), "strategy", "path").limit(limit).select("path", "title", "score", "match_type")


def reranked(found: DataFrame, model_score, k: int) -> DataFrame:
    """0.7 of a model's score and 0.3 of the search's, in hundredths."""
    x = found.withColumn("score", F.round((0.7 * model_score + 0.3 * F.col("score") / 100) * 100, 6)).withColumn("match_type", F.concat("match_type", F.lit("+reranked")))
    return x.orderBy(F.desc("score"), "path").limit(k)


def within_budget(sections: DataFrame, most: int, used: int = 0) -> DataFrame:
    """sections(rank, path, section) cut to a running length; the section that crosses it is shortened if over 200 characters are left, and ends the row. Sections are a result's, few."""
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    x = sections.withColumn("len", F.length("section")).withColumn("before", used + F.coalesce(F.sum("len").over(order), F.lit(0)))
    left = most - F.col("before")
    fits = F.col("before") + F.col("len") <= most
    x = x.filter("before < %d" % most).withColumn("kept", F.when(fits, F.col("section")).when(left > 200, F.substring("section", F.lit(1), left.cast("int"))))
    return x.filter("kept IS NOT NULL").select("rank", "path", F.col("kept").alias("section"), (~fits).alias("truncated"))


def table_hits(tables: DataFrame, q: str, least: float = 0.3, limit: int = 10) -> DataFrame:
    """(all columns of tables, score, matching_rows): tables by 0.3 caption, 0.4 header and 0.3 row partial ratio to a query.

    matching_rows are the rows with a partial ratio of 60 or more, else the first five."""
    q = _query(q)
    text = lambda r: F.lower(F.array_join(r, " "))
    part = lambda c: partial(c, q) / 100
    rows = F.lower(F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), " "))
    score = F.coalesce(0.3 * part(F.lower(F.nullif("caption", F.lit("")))), F.lit(0.0)) + 0.4 * part(text("headers")) + 0.3 * part(rows)
    top = tables.withColumn("score", F.round(F.least(F.lit(1.0), score), 6)).filter(F.col("score") >= least).orderBy(F.desc("score"), "path", "table_index").limit(limit)
    hits = top.select("path", "table_index", F.posexplode("rows").alias("pos", "row")).withColumn("r", partial(text("row"), q)).filter("r >= 60")
    hits = hits.groupBy("path", "table_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]).alias("hits"))
    return top.join(hits, ["path", "table_index"], "left").withColumn("matching_rows", F.coalesce("hits", F.slice("rows", 1, 5))).drop("hits")

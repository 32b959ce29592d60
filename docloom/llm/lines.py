"""Line de-duplication by a fixed-depth log-template tree, in DataFrame functions only.

A line's tokens (between single spaces) lead it to a leaf: the number of tokens, then its first DEPTH tokens, tokens
with a digit being "<*>".
Each leaf that many lines of MIN_TOKENS or more tokens reach gets one template: at each place the commonest token if
SHARE of the leaf's lines have it, else "<*>". A line that fits its leaf's template, if at least half of its places are
fixed, belongs to the template; any other line, and every shorter one, is a template of its own, as it stands. Templates
of MIN_TEXTS or more different texts are dropped, but for the first occurrence of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

DEPTH, SHARE, MIN_TEXTS, MIN_TOKENS, FIELD = 4, 0.6, 10, 3, "<*>"


def _masked(tokens):
    return F.transform(tokens, lambda x: F.when(x.rlike("[0-9]"), FIELD).otherwise(x))


def dropped_lines(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS, scratch: Scratch | None = None) -> DataFrame:
    """(th, drops): for texts (th is md5 of the text) that lose lines, the sorted places of these lines."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    lines = texts.select(F.md5("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # the tree's cheap part for every line: only the leading tokens are looked at, by plain splitting
    tokens = F.split("line", " ")
    lines = lines.select("th", "pos", "line", F.size(tokens).alias("n"), F.xxhash64(F.size(tokens), _masked(F.slice(tokens, 1, DEPTH))).alias("leaf"))
    busy = lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.max("n").alias("n")).filter(F.col("lines") >= min_texts)
    busy = scratch.keep(busy.select("leaf", "n"), "busy")
    # the leaf's n, not the line's, so that only lines of busy leaves are looked at closely
    rows = lines.drop("n").join(busy, "leaf").filter((F.col("n") >= min_tokens) | F.col("line").rlike(r"[\p{L}\p{N}]"))
    rows = rows.select("th", "pos", "leaf", F.xxhash64(F.lit("line"), "line").alias("own"), _masked(tokens).alias("tokens"))
    rows = scratch.keep(rows, "rows")

    places = rows.filter(F.size("tokens") >= min_tokens).select("leaf", F.posexplode("tokens").alias("i", "token")).groupBy("leaf", "i", "token").count()
    common = places.groupBy("leaf", "i").agg(F.max(F.struct("count", "token")).alias("top"), F.sum("count").alias("n"))
    common = common.select("leaf", "i", F.when(F.col("top.count") >= SHARE * F.col("n"), F.col("top.token")).otherwise(FIELD).alias("token"))
    template = common.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("template"))
    template = template.filter(2 * F.size(F.filter("template", lambda x: x != FIELD)) >= F.size("template"))
    template = scratch.keep(template, "template")

    fits = F.forall(F.arrays_zip("tokens", "template"), lambda x: (x["template"] == FIELD) | (x["template"] == x["tokens"]))
    of = rows.join(template, "leaf", "left").select("th", "pos", F.when(F.col("template").isNotNull() & fits, F.col("leaf")).otherwise(F.col("own")).alias("tid"))
    of = scratch.keep(of.distinct(), "of")
    texts = of.groupBy("tid", "th").agg(F.min("pos").alias("pos")).groupBy("tid").agg(F.count("*").alias("texts"), F.min(F.struct("th", "pos")).alias("first"))
    recurring = scratch.keep(texts.filter(F.col("texts") >= min_texts).select("tid", "first"), "recurring")
    hits = of.join(recurring, "tid").filter((F.col("th") != F.col("first.th")) | (F.col("pos") != F.col("first.pos")))
    out = scratch.keep(hits.groupBy("th").agg(F.sort_array(F.collect_list("pos")).alias("drops")), "drops")
    scratch.drop("busy", "rows", "template", "of", "recurring")
    return out


def _without(lines: Column, drops: Column) -> Column:
    """Lines less those at the sorted places of drops: the stretches between them, put together."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(drops, k - 1) + 1)
    end = lambda k: F.coalesce(F.get(drops, k), F.size(lines))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k)))), "\n")


def _joined(docs: DataFrame, text_col: str, min_texts: int, min_tokens: int) -> DataFrame:
    """(row, left, n_lines, n_dropped): each row of docs packed, its text with recurring lines taken out, and counts of lines."""
    drops = dropped_lines(docs, text_col, min_texts, min_tokens)
    packed = docs.select(F.struct("*").alias("row"), F.md5(text_col).alias("key"))
    # lines are a column of their own before they are used: a lambda would else split the text at each step
    out = packed.join(drops, packed.key == drops.th, "left").select("row", F.col("row")[text_col].alias("text"), "drops")
    out = out.withColumn("lines", F.split("text", "\n"))
    left = F.when(F.col("drops").isNull(), F.col("text")).otherwise(_without(F.col("lines"), F.col("drops")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return out.select("row", left.alias("left"), n_lines.alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))


def without_recurring_lines(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with recurring lines taken out of the text, plus __lines and __dropped (counts); a row for each row of docs.

    Lines end at newline characters. Lines of fewer than min_tokens tokens are compared as they stand, and those of them
    without a letter or number (blank lines, marks, brackets) stay. Exact copies of a text count as one text, so copies
    alone make no line recur, and all rows with one text lose the same lines. Of occurrences that tie for the first, that
    of the smallest md5 of the text, then of the smallest place, stays. Null texts stay null, empty texts empty (their counts
    are 0 and 1); very long texts are read whole, in time that grows with their lines; an empty table gives an empty one.
    Other columns pass through, whatever their names but the two that are added, as the row travels packed in one column."""
    out = _joined(docs, text_col, min_texts, min_tokens)
    return out.select(*(F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), F.col("n_lines").alias("__lines"), F.col("n_dropped").alias("__dropped"))


def cleaned(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs in its own columns, whatever their names, recurring lines taken out of the text; n_chars, if there is such a
    column, is the new length where lines went. Nulls, empty texts and the rest are as in without_recurring_lines."""
    out = _joined(docs, text_col, min_texts, min_tokens)
    length = F.when(F.col("n_dropped") > 0, F.length("left"))
    new = {text_col: F.col("left")} | ({"n_chars": F.coalesce(length.cast(docs.schema["n_chars"].dataType), F.col("row")["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

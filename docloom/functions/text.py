"""Column functions on Markdown text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the Markdown patterns that decide what is a row, a link, an image or a code block
ROW = r"^\s*\|(.+)\|\s*$"
SEPARATOR = r"^\s*\|[\s\-:|]+\|\s*$"
MD_LINK = r"\[([^\]]+)\]\(([^\)]+)\)"
HTML_LINK = r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]*)</a>"
AUTO_LINK = r"<(https?://[^>]+)>"
MD_IMAGE = r"!\[(.*?)\]\((.*?)\)"
HTML_IMAGE = r"<img[^>]*src=[\"']([^\"']*)[\"'][^>]*>"
FENCE = r"(?sU)```(\w+)?\n(.*?)\n```"

# a run of row lines from the first that a separator follows, as one match in a whole text
_ROW_LINE, _SEPARATOR_LINE = r"[^\S\n]*\|[^\n]+\|[^\S\n]*$", r"[^\S\n]*\|[ \t\x0B\f\r\-:|]+\|[^\S\n]*$"
TABLE = rf"(?dm)^{_ROW_LINE}\n{_SEPARATOR_LINE}(?:\n{_ROW_LINE})*"



def below(path: str, folder: str) -> Column:
    """A file's path relative to a folder that was read."""
    return F.substring_index(path, re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/", -1)


def strip(c: Column) -> Column:
    """A text without white space of any script at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def title_case(c: Column) -> Column:
    """Upper case after anything but a letter of any script, lower case else."""
    letters = F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))
    return F.array_join(letters, "")


def title(content: Column, path: Column) -> Column:
    """The first heading of level 1 in the first 20 lines, else the file's name."""
    heads = F.filter(F.transform(F.slice(lines(content), 1, 20), strip), lambda x: x.startswith("# "))
    return F.coalesce(strip(F.substring(F.get(heads, F.lit(0)), 3, 1 << 30)), title_case(F.translate(stem(path), "-_", "  ")))


def headings(content: Column) -> Column:
    return F.transform(F.filter(F.transform(lines(content), strip), lambda x: x.startswith("#")), lambda x: F.regexp_replace(x, r"^#+\s*", ""))


def team(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.lit(0))


def category(path: Column) -> Column:
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("general"))


def occurrences(text: Column, word: str) -> Column:
    """Times that a word stands in a text, not overlapping, whatever the case."""
    return F.expr("0") if not word else ((F.length(text) - F.length(F.replace(F.lower(text), F.lit(word.lower()), F.lit("")))) / len(word)).cast("int")


def excerpt(content: Column, query: str, around: int = 100) -> Column:
    """The first hit with ``around`` characters on each side, or the first 200 characters."""
    at = F.locate(query.lower(), F.lower(content)) - 1
    lo = F.greatest(F.lit(0), at - around)
    hi = F.least(F.length(content), at + len(query) + around)
    cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(content, lo + 1, hi - lo), F.when(hi < F.length(content), "...").otherwise(""))
    return F.when(at < 0, F.concat(F.substring(content, 1, 200), F.lit("..."))).otherwise(cut)


def cells(row: Column) -> Column:
    """Cells of a table row, bold, italic and code marks taken off."""
    bare = F.regexp_replace(F.regexp_replace(strip(row), r"^\|", ""), r"\|$", "")
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(x), r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1"), r"`(.*?)`", "$1")
    return F.transform(F.split(bare, r"\|", -1), plain)


def padded(row: Column, width: Column) -> Column:
    """A table row with empty cells up to a width."""
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def resolved(path: Column, url: Column) -> Column:
    """A link's target from its document's folder, cut at #, freed of . and ..; null where it leaves the collection."""
    parts = F.split(F.concat(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.substring_index(url, "#", 1)), "/")
    up = lambda a: F.when((F.size(a) == 0) | (F.get(a, F.lit(0)) == "\0"), F.array(F.lit("\0"))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p))))
    target = F.array_join(walk, "/")
    return F.when(~target.contains("\0"), target)


INDEL_MOST = 62  # bits of a long that the fold may use


def indel_ratio(text: Column, query: str) -> Column:
    """100 * 2 LCS / (lengths), with the LCS length by a bit-parallel fold over the text's characters; query of up to INDEL_MOST characters."""
    m = len(query)
    if m > INDEL_MOST:
        raise ValueError(f"a query of more than {INDEL_MOST} characters is for functions.fuzzy.indel")
    full = (1 << m) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(query):
        masks[c] = masks.get(c, 0) | 1 << i
    known = F.create_map(*[F.lit(x) for c, v in masks.items() for x in (c, v)]) if masks else F.create_map()
    known = known.cast("map<string,bigint>")
    step = lambda s, c: F.aggregate(F.array(s.bitwiseAND(F.coalesce(F.try_element_at(known, c), F.lit(0)).cast("long"))), F.lit(0).cast("long"), lambda a, u: ((s + u).bitwiseOR(s - u)).bitwiseAND(F.lit(full)))
    left = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(full).cast("long"), step)
    return F.lit(200.0) * (m - F.bit_count(left)) / (m + F.length(text))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

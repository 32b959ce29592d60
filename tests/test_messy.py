"""A second collection, of odd Markdown put together at random: several tables or none, nested headings, escaped pipes,
broken images, HTML links, hidden folders and letters of other scripts; against line-by-line Python and DuckDB."""

import posixpath
import re

import duckdb
import numpy as np
import pytest

from docloom.functions import text as T
from docloom.operators import extract, search, tree
from docloom.plans import oracles
from pyspark.sql import functions as F

PARTS = [
    "# Café über Größe", "## Zwei", "### Drei ", "#tag", "  # indented", "####### deep", "plain text, no more", "", "   ", "Ports in use",
    "| a | b |\n|---|---|\n| 1 | 2 |", "| a \\| x | **b** |\n| :-- | --: |\n| `1` | *2* |\n| only one |", "|h|\n|-|", "| row without a separator |\n| another |", "| x |\n| head |\n|---|\n| y |\n|---|\n| z |",
    "  | in | dent |  \n  |---|---|  \n  | é | ü |", "|---|\n|---|\n| after |", "| cut |\n|---|", "text | with | bars", "|| |\n|--|\n||",
    "[one](../b/x.md) and [two](y.md#part)", "[gone](no/such.md)", "[top](#here) <https://h.example/p>", "<a class='k' href=\"z.md\">zed</a> <A HREF='http://u.example'></A>", "[folder](../a) [file](img/p.png) [out](../../../q.md)", "[two\nlines](x.md)",
    "![pic](img/p.png) ![](missing.png)", "<img alt='q' src=\"img/r.gif\">", "```yaml\nk: 1\n| not | a table? |\n```", "```\nno language\n```", "```größe\nunicode\n```", "the the The", "x" * 2100,
]


@pytest.fixture(scope="module")
def collection():
    rng = np.random.default_rng(11)
    folders = ["a", "b", "b/c d", "b/.hidden", "node_modules/m", "ü"]
    out = [(f"{folders[i % len(folders)]}/{'xyz'[i // 6 % 3]}{i // 18 or ''}.md", "\n".join(PARTS[j] for j in rng.integers(0, len(PARTS), rng.integers(0, 14)))) for i in range(90)]
    return [(p, c + "\n" * int(rng.integers(0, 2))) for p, c in out] + [(f"a/part{i}.md", p) for i, p in enumerate(PARTS)] + [("a/null.md", None)]


@pytest.fixture(scope="module")
def docs(spark, collection):
    return spark.createDataFrame(collection, "path string, content string").repartition(3)


def brute_tables(content):
    lines, out, i = content.split("\n"), [], 0
    row = lambda x: re.search(r"^\s*\|(.+)\|\s*$", x)
    sep = lambda x: re.search(r"^\s*\|[\s\-:|]+\|\s*$", x)

    def cells(x):
        x = re.sub(r"\|$", "", re.sub(r"^\|", "", x.strip()))
        return [re.sub(r"`(.*?)`", r"\1", re.sub(r"\*(.*?)\*", r"\1", re.sub(r"\*\*(.*?)\*\*", r"\1", c.strip()))) for c in x.split("|")]

    while i < len(lines):
        if row(lines[i]) and i + 1 < len(lines) and sep(lines[i + 1]):
            end = i + 1
            while end + 1 < len(lines) and row(lines[end + 1]):
                end += 1
            before = lines[i - 1].strip() if i else ""
            out.append((len(out), cells(lines[i]), [cells(x) for x in lines[i + 1 : end + 1] if not sep(x)], i, end, before if before and before[0] not in "#|" else None))
            i = end
        i += 1
    return out


def test_tables(docs, collection):
    got = {}
    for r in extract.tables(docs).orderBy("path", "table_index").collect():
        assert r.row_count == len(r.rows) and r.col_count == len(r.headers)
        got.setdefault(r.path, []).append((r.table_index, r.headers, r.rows, r.line_start, r.line_end, r.caption))
    want = {p: t for p, c in collection if c and (t := brute_tables(c))}
    assert got == want and len(want) > 40 and max(map(len, want.values())) > 2 and len(want) < len(collection)


def test_links_and_their_targets(docs, collection):
    want = []
    for p, c in collection:
        found = [(u, t) for t, u in re.findall(r"\[([^\]]+)\]\(([^\)]+)\)", c or "")]
        found += [(u, t or u) for u, t in re.findall(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]*)</a>", c or "")] + [(u, u) for u in re.findall(r"<(https?://[^>]+)>", c or "")]
        for u, t in found:
            kind = "external" if re.match("https?://", u) else "anchor" if u.startswith("#") else "internal"
            target = posixpath.normpath(posixpath.join(posixpath.dirname(p), u.split("#")[0])) if kind == "internal" else None
            want.append((p, u, t, kind, None if target and target.startswith("..") else target))
    files = {p for p, _ in collection} | {"a/img/p.png", "b/img/p.png"}
    known = {"/".join(f.split("/")[:i]) for f in files for i in range(1, len(f.split("/")) + 1)}
    extra = docs.select("path").union(docs.sparkSession.createDataFrame([("a/img/p.png",), ("b/img/p.png",)], "path string"))
    got = extract.resolved(extract.links(docs), docs, extra).select("path", "url", "text", "type", "target", "valid").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*w, w[3] != "internal" or w[4] in known)) for w in want)
    assert {r.valid for r in got if r.type == "internal"} == {True, False} and any(r.target is None for r in got if r.type == "internal")


def test_headings_titles_images_and_code(docs, collection):
    got = {r.path: r for r in docs.select("path", T.headings(F.col("content")).alias("h"), T.title(F.col("content"), F.col("path")).alias("t")).collect()}
    for p, c in collection:
        if c is None:
            continue
        lines = [x.strip() for x in c.split("\n")]
        first = next((x[2:].strip() for x in lines[:20] if x.startswith("# ")), p.split("/")[-1].removesuffix(".md").title())
        assert got[p].h == [re.sub(r"^#+\s*", "", x) for x in lines if x.startswith("#")] and got[p].t == first, p
    images, blocks = extract.images(docs).collect(), extract.code_blocks(docs).collect()
    for p, c in collection:
        both = [(u, t) for t, u in re.findall(r"!\[(.*?)\]\((.*?)\)", c or "")] + [(u, "") for u in re.findall(r"<img[^>]*src=[\"']([^\"']*)[\"'][^>]*>", c or "")]
        assert sorted((r.pos, r.img_path, r.alt) for r in images if r.path == p) == [(i, *x) for i, x in enumerate(both)]
        code = re.findall(r"(?s)```(\w+)?\n(.*?)\n```", c or "")
        assert sorted((r.pos, r.language or "", r.code) for r in blocks if r.path == p) == [(i, a, b.strip()) for i, (a, b) in enumerate(code)]


@pytest.mark.parametrize("name", ["doc_scan", "table_islands", "fixed_chunks", "chunks", "chunk_stats", "summary_inputs", "index_totals"])
def test_oracles_on_the_odd_collection(docs, collection, name):
    """The oracles' SQL over this collection in place of the standard one, for what it computes from the content."""
    from docloom.plans import queries

    plain = [(p, c) for p, c in collection if c and c.isascii() and "\\|" not in c and "||" not in c and "|-|" not in c]
    assert len(plain) > 30
    con = duckdb.connect()
    con.execute("create table fix (path varchar, content varchar)")
    con.executemany("insert into fix values (?, ?)", plain)
    sql = oracles.ORACLE_SQL[name].replace(oracles.MD, "md AS (select * from fix)").replace(oracles.MD.replace("md AS (", "recursive md AS (", 1), "recursive md AS (select * from fix)")
    some = docs.join(docs.sparkSession.createDataFrame([(p,) for p, _ in plain], "path string"), "path")
    before = queries.md_docs
    queries.md_docs = lambda *_: some
    try:
        df = queries.QUERIES[name](docs.sparkSession, "")
    finally:
        queries.md_docs = before
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_hybrid_with_few_exact_hits(docs):
    """One exact hit, so that lines and titles are searched too; many, so that they aren't."""
    x = docs.filter("content IS NOT NULL").withColumn("title", T.title(F.col("content"), F.col("path")))
    kinds = lambda q, n: [r.match_type for r in search.hybrid(x, q, n).collect()]
    assert kinds("part7", 10)[0] == "exact" and "fuzzy" in kinds("part7", 10)
    assert set(kinds("over size", 10)) == {"fuzzy"} or not kinds("over size", 10)
    some = kinds("no more", 10)
    assert set(some) == {"grep"} and len(some) == 10
    assert set(kinds("a/", 5)) == {"exact"}


def test_hidden_folders_stay_out_of_the_tree(docs):
    names = {r.name for r in tree.tree(docs.filter("content IS NOT NULL").withColumn("size", F.octet_length("content"))).collect()}
    assert {"a", "b", "c d", "ü"} <= names and not {".hidden", "node_modules"} & names


def test_picture_annotations(spark):
    rows = [(1, [("class", "chart", None), ("molecule", None, "CCO"), ("description", None, "two bars")]), (2, []), (3, None), (4, [("other", "x", "y")])]
    df = spark.createDataFrame(rows, "i int, annotations array<struct<kind:string,label:string,text:string>>")
    assert [r[0] for r in df.orderBy("i").select(extract.picture_text()).collect()] == ["Picture type: chart\nSMILES: CCO\ntwo bars", "picture", "picture", "picture"]

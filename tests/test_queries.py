"""Every query with an oracle against DuckDB on the smallest tables, the others for rows; and small golden cases."""

import os
import tracemalloc

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from docloom.functions import text as T
from docloom.operators import extract, search
from docloom.plans.oracles import ORACLE_SQL
from docloom.plans.queries import QUERIES

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert cols == sorted(want.columns)
        assert rows == sorted(map(repr, want.select(*cols).fetchall()))
    else:
        assert rows


def md(spark, *contents):
    return spark.createDataFrame([(f"a/b/{i}.md", c) for i, c in enumerate(contents)], "path string, content string")


def test_chunks(spark):
    docs = md(spark, "# A\nt\n## B\nu\n## C\nv\n# D\nw", "", "# A\n  # odd\nx", "#tag\nx", "# A\n### C\ny", "z" * 5000)
    got = {}
    for r in extract.chunks(docs).orderBy("path", "chunk_index").collect():
        got.setdefault(r.path[4], []).append((r.content, r.heading_hierarchy, r.token_count))
    assert [x[:2] for x in got["0"]] == [("# A\nt", ["A"]), ("## B\nu", ["A"]), ("## C\nv", []), ("# D\nw", ["D"])]
    assert got["1"] == [("", [], 0)] and [x[:2] for x in got["3"]] == [("#tag\nx", ["tag"])] and [x[:2] for x in got["4"]] == [("# A\n### C\ny", ["A", "C"])]
    assert got["5"] == [("z" * 5000, [], 1250)] and [x[:2] for x in got["2"]] == [("# A", []), ("# odd\nx", ["# odd"])]


def test_chunks_of_a_large_batch_are_made_by_slices():
    """A worker's memory follows a slice and not its batch: 32 MB of texts here, with nulls, empty texts and one longer than a slice."""
    long = "\n".join(["# Ä", "word " * 30] * 200)
    texts = [None, "", long * 80, *[f"{i}{long}" for i in range(1000)], "", None]
    batch, got, largest = pa.array(texts), [], 0
    tracemalloc.start()
    for part in extract.chunked(iter([batch, batch.slice(0, 0), batch.slice(1, 1)]), 2048):
        got += pc.list_value_length(part).to_pylist()
        largest = max(largest, part.nbytes if len(part) > 1 else 0)
        if len(got) == 3:  # the long text is a slice of its own, counted apart
            tracemalloc.reset_peak()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [None if t is None else len(extract.chunk_text(t, 2048)) for t in [*texts, ""]]
    assert 0 < largest < 6 << 20 and peak < 16 << 20 < batch.nbytes


def test_chunks_across_slices(spark):
    """Each path keeps its own chunks where a batch is answered in several slices, and where a task has no rows."""
    rows = [(f"{i}.md", None if i % 97 == 0 else "" if i % 89 == 0 else f"# {i}\n" + f"line of {i}\n" * (i * 7 % 3000)) for i in range(600)]
    docs = spark.createDataFrame(rows, "path string, content string").repartition(1)
    got = {}
    for r in extract.chunks(docs).orderBy("path", "chunk_index").collect():
        got.setdefault(r.path, []).append((r.content, r.heading_hierarchy, r.token_count))
    assert got == {p: [(k["content"], k["heading_hierarchy"], k["token_count"]) for k in extract.chunk_text(t, 2048)] for p, t in rows if t is not None}
    assert extract.chunks(docs.filter("path = 'none'")).collect() == []


def test_titles_and_links(spark):
    docs = spark.createDataFrame([("t/windows-vm_2x.md", "no heading"), ("t/x.md", "a\n  # Head \n"), ("b.md", "[n](t/x.md#s) [up](../q.md) <a href=\"u\"></a>")], "path string, content string")
    from pyspark.sql import functions as F

    assert {r.path: r.t for r in docs.select("path", T.title(F.col("content"), F.col("path")).alias("t")).collect()} == {"t/windows-vm_2x.md": "Windows Vm 2X", "t/x.md": "Head", "b.md": "B"}
    got = {r.url: r for r in extract.resolved(extract.links(docs), docs).collect()}
    assert got["t/x.md#s"].valid and not got["../q.md"].valid and got["../q.md"].target is None and got["u"].text == "u"


def test_empty_query_is_refused(spark):
    with pytest.raises(ValueError):
        search.exact(md(spark, "x").selectExpr("*", "'t' AS title"), "")

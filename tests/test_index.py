import pandas as pd
import pytest

from docloom.functions import plugins
from docloom.functions.plugins import embed, overlap
from docloom.sources import index
from docloom.sources.corpus import md_docs, read_files, read_tree, unreadable
from docloom.streaming import refresh


def test_build_and_load(spark, tmp_path):
    docs = md_docs(spark, "/root/testdata/sf0.001").select("path", "content")
    n = docs.count()
    got = {r.relation: r.n for r in index.build(docs, f"file://{tmp_path}/index").collect()}
    assert got["docs"] == got["doc_tables"] == got["doc_images"] == got["code_blocks"] == n and got["doc_links"] == 5 * n
    assert {r.relation: r.n for r in index.build(docs.limit(0), f"file://{tmp_path}/none").collect()} == dict.fromkeys(index.TABLES, 0)


def test_read_tree_and_stream(spark, tmp_path):
    (tmp_path / "docs/a b").mkdir(parents=True)
    (tmp_path / "docs/a b/x.md").write_bytes(b"# X\r\nline\r")
    (tmp_path / "docs/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "docs/no.txt").write_text("no")
    docs = read_tree(spark, f"file://{tmp_path}/docs").collect()
    assert [(r.path, r.content) for r in docs] == [("a b/x.md", "# X\nline\n")]
    schema = "path string, modified int, content string"
    spark.createDataFrame([("p", 1, "old"), ("q", 1, "q")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: refresh.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    for t, text in ((2, "new [q](q) [r](r)"), (3, "newer\n| a |\n|---|\n| b |\n")):
        spark.createDataFrame([("p" if t == 2 else "r", t, text)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = refresh.latest(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, got["docs"].select("path", "modified", "raw_content").collect())) == [("p", 2, "new [q](q) [r](r)"), ("q", 1, "q"), ("r", 3, "newer\n| a |\n|---|\n| b |\n")]
    assert sorted(map(tuple, got["doc_links"].select("path", "url", "valid").collect())) == [("p", "q", True), ("p", "r", True)]
    assert got["doc_tables"].count() == 1 and got["doc_embeddings"].count() == got["doc_chunks"].count() == 3 and refresh.versions(spark, f"{tmp_path}/out") == [1, 2]
    assert [tuple(r) for r in unreadable(spark, f"file://{tmp_path}/docs").collect()] == [("bad.md", "not UTF-8")]
    assert sorted(r.path for r in read_files(spark, f"file://{tmp_path}/docs").collect()) == ["a b/x.md", "bad.md", "no.txt"]


def test_meta_and_staleness(spark, tmp_path):
    import datetime

    docs = spark.createDataFrame([("a/x.md", datetime.datetime(2020, 1, 1), "# X\n| h |\n|---|\n| c |\n![p](p.png) [f](../b.pdf) [d](../a)"), ("y.md", datetime.datetime(2020, 1, 2), "")], "path string, modified timestamp, content string")
    files = spark.createDataFrame([("b.pdf",), ("a/x.md",)], "path string")
    images = spark.createDataFrame([("a/p.png", 9, 3, 2, "PNG", "words in it")], "path string, size_bytes long, width int, height int, format string, ocr_text string")
    said = []
    index.build(docs, f"file://{tmp_path}/i", files=files, images=images, progress=lambda percent, name: said.append((percent, name)))
    m = index.meta(spark, f"file://{tmp_path}/i").first()
    assert m.docs_count == 2 and m.embedder == "hashed" and "images" in m.features and said[-1] == (100, "index_meta")
    of = index.load(spark, f"file://{tmp_path}/i")
    x = of["docs"].filter("path = 'a/x.md'").first()
    assert x.content == x.raw_content + "\n\nh\nc\n\np: words in it" and {r.url: r.valid for r in of["doc_links"].collect()} == {"p.png": False, "../b.pdf": True, "../a": True}
    check = lambda d: index.stale(index.meta(spark, f"file://{tmp_path}/i"), d).first()
    assert not check(docs).stale and check(docs.limit(1)).stale and check(docs.selectExpr("path", "current_timestamp() + interval 1 day AS modified")).changed


def test_services_and_models_with_fakes(spark):
    sent = []
    plugins.register_embedder("fake", "inference", "http://none", send=lambda body: sent.append(body) or [[[1.0, 2.0]] if t else [0.0, 0.0] for t in body["inputs"]], batch=2)
    assert plugins.EMBEDDERS["fake"](pd.Series(["a", None, "b"])).tolist() == [[1.0, 2.0], [0.0, 0.0], [1.0, 2.0]] and len(sent) == 2
    plugins.register_embedder("fake2", "service", "http://none", "m", send=lambda body: {"data": [{"index": i, "embedding": [i]} for i in reversed(range(len(body["input"])))]})
    assert plugins.query_vector("x", "fake2") == [0.0] and plugins.EMBEDDERS["fake2"](pd.Series(["a", "b"])).tolist() == [[0.0], [1.0]]
    with pytest.raises(ValueError):
        plugins.register_embedder("x", "nothing")
    ranked = plugins.cross_encoder("m", score=lambda pairs: [float(len(t)) for _, t in pairs])
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(ranked("q", df.t)).collect()] == [3.0, 0.0] and plugins.available_reader(("nosuchlibrary",)) == "none"


def test_plugins(spark):
    df = spark.createDataFrame([("red car",), ("",), (None,)], "t string")
    rows = df.select(embed(df.t).alias("v"), overlap("red bus", df.t).alias("o")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-9 and rows[0].o == 0.5 and not any(rows[1].v)

import struct

import pytest

from docloom.operators import search
from docloom.plans.library import MANIFEST, SKILLS, TOOLS, Library, call, parsed, schema
from docloom.sources import images
from docloom.sources.corpus import read_tree

TABLE = "\nPorts\n| Port | Use |\n|---|---|\n" + "".join(f"| {p} | use {p} |\n" for p in range(12))


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("lib")
    (top / "docs/net/vpn").mkdir(parents=True)
    (top / "docs/net/vpn/setup.md").write_text("# VPN setup\n\nHow to set up the vpn config.\n" + TABLE + "\n```yaml\na: 1\n```\n[more](more.md) [gone](gone.md) ![d](d.png)\n")
    (top / "docs/net/vpn/more.md").write_text("# More\n\nNothing else.\n")
    (top / "docs/net/empty.md").write_text("")
    return Library.open(spark, f"file://{top}/index", read_tree(spark, f"file://{top}/docs"))


def test_tools(library):
    text = call(library, "search_docs", query="vpn")
    assert "1. **" in text and "net/vpn/setup.md" in text and "Contains 1 image" in text
    assert "No documentation" in call(library, "search_docs", query="zzzzqqqq")
    assert call(library, "search_docs", query="").startswith("Error") and call(library, "nothing").startswith("Unknown")
    assert "VPN setup" in call(library, "semantic_search", query="vpn setup") and "Error" in call(library, "get_file", path="../x")
    assert "... and 2 more rows" in call(library, "get_table", path="net/vpn/setup.md", table_index=0)
    assert "a: 1" in call(library, "find_configs", query="vpn", language="yaml") and "Ports" in call(library, "search_tables", query="port use")
    assert "setup.md" in call(library, "list_structure") and "How to set up" in call(library, "summarize_topic", topic="vpn")
    h = library.health().first()
    assert (h.files, h.tables, h.links, h.broken_links) == (2, 1, 3, 2)  # the scan gives no row for the empty file


def test_answers_and_arguments(library):
    assert "no-such.md" in call(library, "get_file", path="no-such.md") and "folder" in call(library, "get_file", path="net") and call(library, "get_file", path="net/vpn/more.md").endswith("Nothing else.\n")
    assert parsed("search_docs", {"query": "404", "limit": "3"}) == {"query": "404", "limit": 3} and parsed("search_tables", {"min_score": "0.5"}) == {"min_score": 0.5}
    assert schema("search_docs")["parameters"]["required"] == ["query"] and schema("get_table")["parameters"]["properties"]["table_index"] == {"type": "integer"}
    assert all(schema(name)["parameters"]["type"] == "object" for name in (*TOOLS, *SKILLS)) and set(MANIFEST) == set(SKILLS)
    long = "how to set up the virtual private network of the whole company " * 2
    assert search.fuzzy(library.docs, long, least=0.0).count() == 2
    assert {r.path for r in search.in_folder(library.docs, "net/v", raw=True).collect()} == {"net/vpn/setup.md", "net/vpn/more.md"} and search.in_folder(library.docs, "net/v").count() == 0
    assert library.docs.filter("content LIKE '%80%'").count() == 0 and "use 3" in library.docs.filter("path LIKE '%setup%'").first().content.split("Table: Ports")[1]


def test_rerank_only_beyond_the_limit(library):
    other = Library(library.of, "overlap")
    assert [r.match_type for r in other.search_docs("vpn", limit=1).collect()] == ["exact+reranked"]
    assert {r.match_type for r in other.search_docs("vpn", limit=5).collect()} == {"exact"}


def test_context_and_workflows(library):
    text = library.rich_context("vpn")
    assert text.startswith("# Search Results for: vpn") and "[More](net/vpn/more.md)" in text and "2 broken link(s)" in text and "... and 9 more rows" in text
    assert "truncated" in library.rich_context("vpn", most=400)
    for skill, argument in zip(SKILLS, ("query", "description", "topic", "config_type", "folder_path", "question"), strict=True):
        text = call(library, skill, **{argument: {"folder_path": "net/vpn", "config_type": "vpn"}.get(argument, "vpn port")})
        assert text and not text.startswith("Error"), (skill, text)


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 2)
    assert images.header(png) == (3, 2, "PNG") and images.header(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6, "GIF")
    assert images.header(b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx\xff\xc0" + struct.pack(">HBHH", 17, 8, 7, 9)) == (9, 7, "JPEG")
    assert images.header(b"\xff\xd8\xff") == images.header(None) == images.header(png[:20]) == (None, None, None)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(png)
    (tmp_path / "a/bad.png").write_bytes(b"no")
    refs = spark.createDataFrame([("a/d.md", 0, "x.png", "X"), ("a/d.md", 1, "bad.png", ""), ("a/d.md", 2, "https://h/y.png", "")], "path string, pos int, img_path string, alt string")
    got = images.enriched(refs, images.read_images(spark, f"file://{tmp_path}")).orderBy("pos").collect()
    assert [(r.img_path, r.type, r.width, r.height, r.format, r.has_text) for r in got] == [("x.png", "local", 3, 2, "PNG", False), ("https://h/y.png", "external", None, None, None, False)]
    assert images.ocr_section(images.enriched(refs, images.read_images(spark, f"file://{tmp_path}"))).count() == 0

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions import fuzzy
from docloom.operators import search, tree

WORD = st.text("ab c", max_size=7)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(WORD, WORD)
def test_ratios_equal_brute_force(a, b):
    plain = lambda x, y: 200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0
    assert abs(fuzzy.ratio(a, b) - plain(a, b)) < 1e-9
    s, t = sorted((a, b), key=len)
    if s:
        every = [plain(x, y[max(0, i) : i + len(x)]) for x, y in ((s, t), (t, s))[: 1 + (len(s) == len(t))] for i in range(1 - len(x), len(y))]
        assert abs(fuzzy.partial_ratio(a, b) - max(every)) < 1e-9
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100 + 1e-9


def test_weighted_ratio():
    assert fuzzy.weighted_ratio("red car", "car red") == 95.0  # the same tokens
    assert fuzzy.weighted_ratio("vpn", "the vpn guide") == 90.0  # a part of a longer title
    assert fuzzy.weighted_ratio("", "x") == 0.0 and fuzzy.weighted_ratio("Ab", "ab") == 50.0


def test_table_hits(spark):
    schema = "path string, table_index int, headers array<string>, rows array<array<string>>, caption string"
    tables = spark.createDataFrame([("a.md", 0, ["port", "use"], [["port use", "x"], ["80", "web"]], None), ("b.md", 0, ["q"], [], ""), ("c.md", 0, ["port use"], [["zz"]] * 7, "Port use")], schema)
    got = {r.path: r for r in search.table_hits(tables, "port use").collect()}
    assert got["a.md"].score == 0.7 and got["a.md"].matching_rows == [["port use", "x"]] and "b.md" not in got
    assert got["c.md"].matching_rows == [["zz"]] * 5


def test_tree(spark):
    docs = spark.createDataFrame([(p, 1024) for p in ("b/x.md", "b/.git/y.md", "A.md", "node_modules/z.md", "c/d/e/f.md")], "path string, size long")
    assert tree.render(tree.tree(docs), "docs").splitlines() == ["Documentation Structure: docs", "├── 📁 b/ (2 docs)", "│   └── 📄 x.md (1.0 KB)", "├── 📁 c/ (1 docs)", "│   └── 📁 d/ (1 docs)", "│       └── 📁 e/ (1 docs)", "└── 📄 A.md (1.0 KB)"]
    assert tree.render(tree.tree(docs, "c/d", 1), "d").splitlines()[1:] == ["└── 📁 e/ (1 docs)"]
    assert tree.tree(docs, "none").count() == 0

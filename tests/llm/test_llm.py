"""The corpus operators against brute force, round trips and held-out labels."""

import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import bpe, caps, common, components, lines, minhash, mixing, packing, quality, toxicity, vptree, windows
from docloom.llm.common import Scratch, table
from docloom.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and near copies in a chain."""
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join(base[:j] + [f"x{k}" for k in range(j)] + base[j:][j:]) for j in (0, 2, 4, 6, 8)]
    long = " ".join(f"long{i % 9973}" for i in range(60_000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "One", "en", "a", 3), (4, "one", "en", None, 3), (5, " \t\n", "en", "b", 3), (6, long, "en", "b", len(long)), (7, long + " end", "en", "b", len(long)), (8, "same row here", "en", "b", 4), (8, "same row here", "en", "b", 4), (None, "no id at all", "en", "b", 4), *((20 + i, t, "en", "c", len(t)) for i, t in enumerate(chain))]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_equals_brute_force(spark, k):
    rows = [tuple(r) for r in table(spark, DATA, "documents").collect()] + [(r[0] + 1000 if r[0] else r[0], *r[1:]) for r in odd_rows()]
    got = minhash.near_duplicates(docs_of(spark, rows), words=k).collect()
    sets = {r[0]: shingle_set(r[1], k) for r in rows if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(ids, links)
    assert links and len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in rng.integers(0, 100, 4):
            w[j] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    sets = {r[0]: shingle_set(r[1], 2) for r in rows}
    links = [(a, b) for a in sets for b in range(a + 1, 400) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = minhash.near_duplicates(docs_of(spark, rows), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_empty_tables(spark):
    docs, labels = docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (minhash.near_duplicates(docs), mixing.taken(docs), packing.pack(docs, tokenizer_path("word_bpe_49k.json")), bpe.token_counts(docs, tokenizer_path("byte_bpe_50k.json")), quality.scores(docs, labels), caps.near_duplicate_vectors(vectors), vptree.nearest(vectors, vectors), windows.repeated_passages(docs), lines.without_recurring_lines(docs), toxicity.scores(docs, labels), mixing.mixed_documents(docs), quality.accepted(docs, labels)):
        assert out.collect() == []


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (None, 3)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    want = closure({x for ab in links for x in ab if x is not None}, [ab for ab in links if None not in ab])
    assert all(want[r.id] == r.component for r in got) and {r.id for r in got} >= {1000, 1200}


def test_mixing(spark):
    rows = [tuple(r) for r in table(spark, DATA, "documents").collect()] + [(r[0] and r[0] + 1000, *r[1:]) for r in odd_rows()]
    docs = docs_of(spark, rows)
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(5)).collect()))
    size, n = defaultdict(int), {}
    for r in rows:
        size[r[3]] += len(words(r[1]))
        n[r[0]] = len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([(s, size[s]) for s in names]), strict=True))
    assert abs(sum(goals.values()) - sum(size.values())) < 1 or any(abs(g - 3 * size[s]) < 1e-6 for s, g in goals.items())
    source = {r[0]: r[3] for r in rows}
    total = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.size == n[r.doc_id] and r.source_size == size[s] and abs(r.target - goals[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        total[s] += r.taken
    assert all(abs(total[s] - goals[s]) <= 1 for s in names)
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(words(r.text)) for r in out) == sum(total.values())
    taken = defaultdict(int)
    for r in out:
        taken[r.doc_id] += len(words(r.text))
    want = defaultdict(int)
    for r in got:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(taken)


def test_mixing_shards_follow_the_plan():
    counts = mixing.shard_counts([5000, 100, 0, 900], 512)
    assert counts.sum(axis=0).tolist() == [5000, 100, 0, 900] and (counts[:-1].sum(axis=1) == 512).all()
    for n in (1, 2, 7, 256, 1000):
        a, c = mixing.permutation(n, 1, 0)
        assert sorted((a * j + c) % n for j in range(n)) == list(range(n))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [tuple(r) for r in table(spark, DATA, "documents").collect()] + odd_rows() + [(900, "a<|endoftext|>b <|startoftext|> It's 12 é é ́x y\x1cz ΑΣ Σ's", "en", "a", 1)]
    got = packing.pack(docs_of(spark, rows), path, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r.length <= 2048 and r.length & (r.length - 1) == 0 and len(r.ids) == r.length and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    assert len({r.sequence_id for r in got}) == len(got)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
    for doc, texts in want.items():
        assert sorted(i for t in texts for i in t) == sorted(i for p in pieces[doc] for i in p[1])
        if len(texts) == 1:
            assert [i for p in sorted(pieces[doc]) for i in p[1]] == texts[0] and {p[2] for p in pieces[doc]} == {len(texts[0])}


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [tuple(r) for r in table(spark, DATA, "documents").collect()] + odd_rows() + [(901, "a<|endoftext|><|endoftext|> b  \n\n c\t\x1c\x1d  ​ don't'LL 12٣ é ☃ 𝔘 " + "z" * 5000, "en", "a", 1)]
    got = bpe.token_counts(docs_of(spark, rows), path).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_pretokens_of_every_character():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), bpe.merger(tokenizer_path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} {c}b {c}{c}1" for c in chars]
    wrong = [hex(ord(c)) for c, t, e in zip(chars, texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if own.count(t) != len(e.ids)]
    assert wrong == []


def held_out(rows, labels, part):
    y = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for v, s in y if v], [s for v, s in y if not v]
    assert good and bad
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]), np.mean([(s >= 0.5) == bool(v) for v, s in y])


def test_quality_and_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    known = labels.collect()
    for module, label, mod, part in ((quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)):
        rows = module.scores(docs, labels).collect()
        assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == part) for r in rows)
        area, right = held_out(rows, {r.doc_id: r[label] for r in known}, part)
        print(label, area, right)
        assert area > 0.9 and right > 0.9
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "an idiot", "en", "a", 8), (3, "x " * 200_000, "en", "a", 1)]
    for module in (quality, toxicity):
        out = module.scores(docs_of(spark, rows), labels.limit(0)).collect()
        assert len(out) == 4 and all(r.score == 0.5 for r in out)


def test_toxic_offsets(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    assert model[0].codes[b"Idiot,"] >> 4 and not model[0].codes[b"noun."] >> 4 and model[0].codes[b"noun."] & 1
    text = "Thé noun. You are an Idiot, she said."
    odd = docs.select("doc_id", "text").limit(0).union(docs_of(spark, [(5, text, "en", "a", 1), (6, None, "en", "a", 1)]).select("doc_id", "text"))
    found = {r.doc_id: r.spans for r in odd.mapInArrow(lambda it: toxicity._scored(it, model), "doc_id long, score double, spans array<struct<start:int,end:int>>").collect()}
    assert "idiot" in " ".join(text[s.start : s.end] for s in found[5]).lower() and found[6] == []


def test_long_documents_are_learnt_from(spark):
    """A word that stands only in texts of over 100,000 characters is learnt."""
    rng = np.random.default_rng(6)
    plain = lambda n: " ".join(f"w{x}." if x % 9 == 0 else f"w{x}" for x in rng.integers(0, 300, n))
    rows = [(i, plain(25_000) + " grumblefoo " + plain(30), "en", "a", 0) if i % 8 == 0 else (i, plain(40), "en", "a", 0) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(160)], "doc_id long, toxic int")
    field, _ = toxicity.train(docs_of(spark, rows).select("doc_id", "text"), labels)
    assert any(u.startswith(b"gru") for u in field.learnt)


def random_field(seed):
    rng = np.random.default_rng(seed)
    field = toxicity.Field({b"a": 0, b"b": 1})
    field.w = rng.standard_normal(len(field.w)) / 2
    length = np.array([5, 1, 4, 6])
    codes = (rng.integers(0, 3, 16) * 16 + rng.integers(0, toxicity.SHAPES, 16) * 2).astype(np.int64)
    return field, codes, np.cumsum(length) - length, length, rng.integers(-1, 2, 16), np.array([1.0, 2.0, 1.0, 3.0])


def test_field_marginals_equal_enumeration():
    from itertools import product

    field, codes, start, length, label, _ = random_field(3)
    e = field.potentials(field.features(codes, start, length))
    p, moves, log_z = field.chain(e, start, length, want=True)
    *_, first, move = field.parts()
    for r, (a, n) in enumerate(zip(start, length, strict=True)):
        weight = {s: np.exp(first * s[0] + sum(e[a + i] * s[i] for i in range(n)) + sum(move[s[i], s[i + 1]] for i in range(n - 1))) for s in product((0, 1), repeat=n)}
        total = sum(weight.values())
        assert np.allclose(p[a : a + n], [sum(w for s, w in weight.items() if s[i]) / total for i in range(n)]) and np.isclose(log_z[r], np.log(total))
        pairs = [[sum(w * sum(s[i] == x and s[i + 1] == y for i in range(n - 1)) for s, w in weight.items()) / total for y in (0, 1)] for x in (0, 1)]
        assert np.allclose(moves[r], pairs)


def test_field_gradient_equals_finite_differences():
    field, codes, start, length, label, weight = random_field(4)
    assert set(label.tolist()) == {-1, 0, 1}
    _, grad = field.likelihood(codes, start, length, label, weight)
    w = field.w.copy()
    for i in range(len(w)):
        ends = []
        for step in (1e-5, -1e-5):
            field.w = w.copy()
            field.w[i] += step
            ends.append(field.likelihood(codes, start, length, label, weight)[0])
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[i]) < 1e-6


def test_sequences_end_with_sentences_and_texts():
    codes = np.array([0, 0, 1, 0, 0, 1, 0] + [0] * 130)
    start, length = toxicity.sequences(codes, np.array([4, 4, len(codes)]))
    assert start.tolist() == [0, 3, 4, 6, 70, 134] and length.tolist() == [3, 1, 2, 64, 64, 3]


def clustered(seed, n=600, d=64, copies=120):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[rng.integers(0, 12, copies)] + 0.024 * rng.standard_normal((copies, d))
    return np.concatenate([x, near, x[:5], x[:5] * 3]).astype(np.float32)


def test_caps_equal_brute_force(spark):
    x = clustered(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [None] + [1.0] * 63), (5004, [float("inf")] + [1.0] * 63), (None, x[0].tolist()), (5005, [1.0, 2.0]), (5006, [2.0, 4.0])]
    for block in (caps.BLOCK, 16):
        got = {r.vec_id: r for r in caps.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).collect()}
        unit = x.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.95
        np.fill_diagonal(linked, False)
        want = closure(range(len(x)), list(zip(*(i.tolist() for i in np.nonzero(np.triu(linked))), strict=True)))
        assert linked.sum() > 1000 and len(got) == len(rows)
        assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()
        assert [got[i].component_id for i in range(len(x))] == [want[i] for i in range(len(x))]
        assert all(got[i].n_links == 0 and got[i].kept for i in range(5000, 5005)) and got[5006].component_id == 5005 and got[5006].n_links == 1


def test_caps_lists_keep_their_length_as_the_table_grows():
    rng = np.random.default_rng(7)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 400, 64)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (10**4, 10**5, 10**6):
        f = caps.Filters(64, caps.codewords(64, n))
        lists = []
        for v in (x, y):
            own = [set() for _ in v]
            for i, c in zip(*f.decode(v), strict=True):
                own[i].add(c)
            lists.append(own)
        assert abs(np.mean([len(s) for s in lists[0]]) / caps.LISTED - 1) < 0.1
        assert sum(not a & b for a, b in zip(*lists, strict=True)) <= 1


@pytest.mark.parametrize("d", [1, 2, 3, 4, 6, 8, 12])
def test_caps_in_few_dimensions(d):
    """Lists stay as short as in many dimensions, whatever the table's size, and pairs at the threshold share a direction."""
    rng = np.random.default_rng(d)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 300, d)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True) if d > 1 else x
    for n in (2_000, 20_000, 2_000_000):
        f = caps.Filters(d, caps.codewords(d, n))
        lists = []
        for v in (x, y):
            own = [set() for _ in v]
            for i, c in zip(*f.decode(v), strict=True):
                own[i].add(c)
            lists.append(own)
        assert np.mean([len(s) for s in lists[0]]) < 3 * caps.LISTED
        assert sum(not a & b for a, b in zip(*lists, strict=True)) <= 1


def test_nearest_recall_and_exactness(spark):
    x = clustered(5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 64), (5040, [float("nan")] * 64), (5060, [None] + [1.0] * 63)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    score = x.astype(np.float64) @ x.astype(np.float64).T
    want = {i: sorted((-round(score[i, j], 9), j) for j in range(len(x)) if j != i)[:20] for i in range(0, len(x), 20)}
    for factor, least in ((1.0, 1.0), (None, 0.95)):
        got = defaultdict(list)
        for r in sorted(vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), factor=factor, shard=300).collect()):
            assert abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 and r["rank"] == len(got[r.query_id]) + 1
            got[r.query_id].append(r.vec_id)
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        right = np.mean([len(set(got[i]) & {j for _, j in want[i]}) / 20 for i in want])
        print(factor, right)
        assert right >= least
    few = vptree.nearest(vectors.filter("vec_id < 5"), vectors.filter("vec_id = 0")).collect()
    assert [r.vec_id for r in few] == [j for _, j in sorted((-score[0, j], j) for j in range(1, 5))]


def brute_passages(rows):
    """(doc, covered words) by exact runs of 50 words that another document holds."""
    runs = defaultdict(set)
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(doc)
    out = defaultdict(set)
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - 49):
            if len(runs[tuple(w[i : i + 50])]) > 1:
                out[doc] |= set(range(i, i + 50))
    return out


def test_passages(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"u{rng.integers(10**9)}" for _ in range(n)]
    shared, near = fresh(60), fresh(120)
    near2 = list(near)
    near2[40], near2[90] = "changed", "changed2"
    rows = [(i, " ".join(fresh(30 + i) + shared + fresh(20)), "en", "a", 0) for i in range(30)]
    rows += [(50, " ".join(fresh(200) + near + fresh(70)), "en", "a", 0), (51, " ".join(near2), "en", "a", 0), (60, " ".join(fresh(400)), "en", "a", 0), (61, " ".join(fresh(30) + shared[:49] + fresh(30)), "en", "a", 0)]
    rows += [tuple(r) for r in table(spark, DATA, "documents").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars").collect()]
    got = defaultdict(set)
    for r in windows.repeated_passages(docs_of(spark, rows + [r for r in odd_rows() if r[0] not in (6, 7)][:6])).collect():
        assert r.end_word - r.start_word == r.n_words >= 50 and r.other_doc != r.doc_id
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = brute_passages(rows)
    assert set(range(200, 320)) <= got[50] and set(range(120)) <= got[51] and 60 not in got and 61 not in got
    lost = {d: sorted(w - got[d])[:5] for d, w in want.items() if not w <= got[d]}
    assert not lost, lost


def test_passages_in_long_and_repeated_rows(spark):
    rng = np.random.default_rng(18)
    fresh = lambda n: [f"t{rng.integers(10**9)}" for _ in range(n)]
    long, shared = fresh(40_000), fresh(70)
    periodic = ["again", "and"] * 400
    rows = [(1, long + fresh(5)), (2, fresh(9) + long), (3, fresh(20) + shared), (3, fresh(20) + shared), (4, shared + fresh(30)), (None, shared), (5, fresh(30) + periodic), (6, periodic[:300] + fresh(30)), (7, ["x"] * 49), (8, ["x"] * 49), (9, []), (10, fresh(60))]
    got = defaultdict(set)
    out = windows.repeated_passages(docs_of(spark, [(i, " ".join(w), "en", "a", 0) for i, w in rows] + [(11, None, "en", "a", 0)])).collect()
    for r in out:
        got[r.doc_id] |= {(r.start_word, r.end_word)}
    assert got[1] == {(0, 40_000)} and got[2] == {(9, 40_009)} and got[3] == {(20, 90)} and got[4] == {(0, 70)}
    assert got[5] == {(30, 830)} and got[6] == {(0, 300)} and set(got) == {1, 2, 3, 4, 5, 6}


def test_near_passages_recall(spark):
    """Passages of 60 to 120 words with one edit in about 30 words, as substitutions, insertions and deletions, end to end."""
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"n{rng.integers(10**9)}" for _ in range(n)]
    rows, edits = [], 0
    for p in range(120):
        one = fresh(int(rng.integers(60, 121)))
        two = list(one)
        for at in sorted(rng.choice(len(one), len(one) // 60 + 1, replace=False).tolist(), reverse=True):
            kind = int(rng.integers(3))
            two[at : at + (kind != 1)] = fresh(1) if kind != 2 else []
            edits += 1
        rows += [(2 * p, " ".join(fresh(60) + one + fresh(40)), "en", "a", 0), (2 * p + 1, " ".join(fresh(30) + two + fresh(80)), "en", "a", 0)]
    sets = {i: shingle_set(t, 5) for i, t, *_ in rows}
    got = {(min(r.doc_id, r.other_doc), max(r.doc_id, r.other_doc)) for r in windows.repeated_passages(docs_of(spark, rows)).collect()}
    found = [p for p in range(120) if (2 * p, 2 * p + 1) in got]
    print("near passages found", len(found), "of 120, edits", edits)
    assert len(found) >= 108 and all(a // 2 == b // 2 for a, b in got) and len(sets) == 240


def test_passages_beyond_a_common_line(spark):
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"v{rng.integers(10**9)}" for _ in range(n)]
    rows = []
    for p in range(60):
        line, tail = fresh(49), fresh(6)
        texts = [fresh(40) + line + fresh(40) for _ in range(3)] + [fresh(30 + 9 * i) + line + tail + fresh(40) for i in range(2)]
        rows += [(10 * p + i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    got = defaultdict(set)
    for r in windows.repeated_passages(docs_of(spark, rows)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = brute_passages(rows)
    assert len(want) == 120 and not {d for d, w in want.items() if not w <= got[d]} and got.keys() == want.keys()


def test_near_passages_beyond_common_lines(spark):
    """Near passages whose every longer equal run is a line that an earlier text holds too: each text is still found, however large the line's group."""
    rng = np.random.default_rng(22)
    fresh = lambda n: [f"l{rng.integers(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for p in range(40):
        line, other = fresh(30), fresh(30)
        leads = [fresh(40) + x + fresh(40) for x in (line, other, line, other)]
        near = [fresh(20 + 9 * i) + line + fresh(1) + other + fresh(30) for i in range(2)]
        rows += [(100 * p + i, " ".join(t), "en", "a", 0) for i, t in enumerate(leads + near)]
        want |= {100 * p + 4 + i: (20 + 9 * i, 81 + 9 * i) for i in range(2)}
    line, tail = fresh(44), fresh(14)  # a common line, and two texts among many that share words beyond an edit
    texts = [fresh(30) + line + fresh(30) for _ in range(1500)]
    for i in (700, 900):
        texts[i] = fresh(30) + line + fresh(1) + tail + fresh(30)
        want[10_000 + i] = (30, 89)
    rows += [(10_000 + i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.start_word, r.end_word) for r in windows.repeated_passages(docs_of(spark, rows)).collect()}
    print(len(want.keys() - got.keys()), "lost of", len(want))
    assert got == want


def test_one_word_again_and_again_has_no_hoods(spark):
    """Runs with too few distinct shingles around for a passage aren't compared; the others of their group are, even if only two are left."""
    rng = np.random.default_rng(24)
    for size in (50, 90, 400):
        x = rng.integers(0, [3, 30, 1 << 31][size % 3], size).astype("<u4")
        at = np.arange(size - windows.CONTEXT + 1)
        around = [x[max(0, a - windows.REACH) : a + windows.CONTEXT + windows.REACH].astype(np.uint64) for a in at]
        assert windows.distinct_around(x, at).tolist() == [len(set(windows.shingles(w, windows.WORDS).tolist())) for w in around]
    poor, rich = np.repeat(rng.integers(0, 1 << 31, 2), 100).astype("<u4"), rng.integers(0, 1 << 31, 200).astype("<u4")
    places = list(range(0, 80))
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3], "words": [x.tobytes() for x in (poor, rich, rich[:50])], "keys": [places, [7, 8], [7, 9]], "ats": [places, [20, 100], [3, 40]], "starts": [None, [90], None], "ends": [None, [150], None]})
    got = [r for b in windows._hoods([batch], 80) for r in b.to_pylist()]
    assert [(r["key"], r["doc"], r["at"], r["open"]) for r in got] == [(7, 2, 20, True), (8, 2, 100, False), (7, 3, 3, True)]
    assert got[0]["hood"] == rich[:99].tobytes()
    fresh = lambda n: [f"k{rng.integers(10**9)}" for _ in range(n)]
    line, other = fresh(30), fresh(30)
    texts = [["the"] * 60 + x + ["of"] * 60 for x in (line, other)] + [fresh(20 + 9 * i) + line + fresh(1) + other + fresh(30) for i in range(2)]
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    assert {r.doc_id: (r.start_word, r.end_word) for r in windows.repeated_passages(docs_of(spark, rows)).collect() if r.doc_id > 1} == {2: (20, 81), 3: (29, 90)}


def test_a_group_of_near_copies_meets_in_rows_by_its_members(spark):
    """All members of a group are compared, but the rows grow with the members and not with their pairs; passages are those of the words."""
    rng = np.random.default_rng(25)
    draw = lambda n: rng.integers(0, 1 << 31, n).astype("<u4")
    line, tail = draw(30), draw(30)
    for size in (60, 240):
        none = pa.array([None] * size, pa.list_(pa.int32()))
        texts = [np.concatenate([draw(20 + i % 7), line, draw(1), tail[: 30 - i % 3], draw(40)]) for i in range(size)]
        batch = pa.RecordBatch.from_pydict({"doc": list(range(size)), "words": [x.tobytes() for x in texts], "keys": [[5]] * size, "ats": [[24 + i % 7] for i in range(size)], "starts": none, "ends": none})
        batches = [b.to_pydict() for b in windows._hoods([batch], 80)]
        hoods = spark.createDataFrame([r for b in batches for r in zip(*b.values(), strict=True)], ", ".join(f"{c} {'boolean' if c in ('open', 'part') else 'binary' if c == 'hood' else 'long' if c in ('key', 'doc') else 'int'}" for c in batches[0]))
        rows = windows.across(hoods, common.Scratch(spark, "test"), 80).collect()
        assert len(rows) <= 3 * size
        got = defaultdict(set)
        for r in rows:
            got[r.doc].update(range(r.start, r.end))
            got[r.other].update(range(r.other_start, r.other_end))
        assert all(got[i] == set(range(20 + i % 7, 20 + i % 7 + 61 - i % 3)) for i in range(size))
    for _ in range(200):  # pairs whose shingles stand in the same order against the definition, word sets included
        x = draw(143)
        y = x.copy()
        at = rng.choice(np.r_[0:64, 79:143], int(rng.integers(0, 9)), replace=False)
        y[at] = draw(len(at))
        s, t = windows.shingles(x.astype(np.uint64), 5), windows.shingles(y.astype(np.uint64), 5)
        both = s == t
        place = np.where(both, np.arange(139), 139).astype(np.int16)
        fits = [(a, b) for a in range(65) for b in range(max(74, a + 45), 139) if both[a] and both[b] and 180 * both[a : b + 1].sum() >= 160 * (b + 1 - a)]
        found = windows.longest(place < 139, place, 80)
        assert bool(fits) == bool(found) == bool(windows.dense((place < 139)[None], (place + np.arange(139))[None], 2, 180, 80)[0][0])
        assert set(found) <= set(fits) and (not fits or (min(found)[0], max(b for _, b in found)) == (min(fits)[0], max(b for _, b in fits)))


def test_every_run_of_24_words_meets():
    rng = np.random.default_rng(23)
    for _ in range(300):
        x, at = rng.integers(0, 1 << 63, 200).astype(np.uint64), int(rng.integers(1, 170))
        y = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        y[at : at + 24] = x[at : at + 24]
        one, two = (set(np.concatenate([k for k, *_ in windows.windows([z])]).tolist()) for z in (x, y))
        assert one & two


def test_passages_with_an_insertion(spark):
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"w{rng.integers(10**9)}" for _ in range(n)]
    x = rng.integers(0, 1 << 32, 60).astype("<u4")
    for cut in ([x[:30], [7], x[30:]], [x[:30], x[32:]], [x[:25], [1, 2, 3], x[25:]]):
        y = np.concatenate(cut).astype("<u4")
        assert windows.banded(x, y) == [(0, 60, 0, len(y))]
        assert windows.compared(x, y, [(0, 60, 0)]) == [(0, 60, 0, len(y))]
    assert windows.banded(x, rng.integers(0, 1 << 32, 60).astype("<u4")) == []
    rows, lengths = [], (60, 80, 96)
    for p in range(60):
        near = fresh(lengths[p % 3])
        m = len(near) // 2
        other = near[:m] + fresh(1) + near[m:] if p % 2 else near[:m] + near[m + 1 :]
        rows += [(2 * p, " ".join(fresh(70) + near + fresh(90)), "en", "a", 0), (2 * p + 1, " ".join(fresh(90) + other + fresh(20)), "en", "a", 0)]
    got = {r.doc_id: (r.start_word, r.end_word) for r in windows.repeated_passages(docs_of(spark, rows)).collect()}
    right = [p for p in range(60) if got.get(2 * p) == (70, 70 + lengths[p % 3]) and got.get(2 * p + 1) == (90, 91 + lengths[p % 3] if p % 2 else 89 + lengths[p % 3])]
    print(len(right))
    assert len(right) >= 54 and all(d // 2 in right for d in got)


def test_compact_windows_cover_each_subsequence():
    order = np.random.default_rng(2).integers(0, 50, 60)
    l, c, r = windows.compact_windows(order, 8)
    for i in range(60):
        for j in range(i + 7, 60):
            assert sum(a <= i <= m <= j <= b for a, m, b in zip(l, c, r, strict=True)) == 1


def test_lines(spark):
    rows = [(i, f"fresh line number q{i}x alpha\nUser u{i} logged in from host h{i % 3} today\nplain words that all of them share\n\nshort one", "en", "a", 0) for i in range(14)]
    rows += [(100 + i, "copied first line here now\ncopied second line here now", "en", "a", 0) for i in range(30)] + [(500 + i, *r[1:]) for i, r in enumerate(odd_rows())]
    got = {r.doc_id: r for r in lines.without_recurring_lines(docs_of(spark, rows)).collect()}
    gone = Counter(got[i].text for i in range(14))
    assert sum("share" in t for t in gone) == 1 and sum("logged in" in t for t in gone) == 1
    assert all(f"q{i}x alpha" in got[i].text for i in range(14)) or sum("alpha" in t for t in gone) == 1
    assert all(got[100 + i].__getitem__("__dropped") == 0 for i in range(30)) and got[500].text is None and got[501].text == ""
    assert sum("short one" in got[i].text for i in range(14)) == 1 and all("" in got[i].text.split("\n") for i in range(14))


def test_numeric_rows_that_differ_stay(spark):
    rows = [(i, f"own{i}x\n{i}.5 {i + 30} {7 * i}\n2019 4 88\nweight {i},1 {i},2 {i},3", "en", "a", 0) for i in range(40)]
    got = {r.doc_id: r.text.split("\n") for r in lines.without_recurring_lines(docs_of(spark, rows)).collect()}
    assert all(f"{i}.5 {i + 30} {7 * i}" in got[i] and f"weight {i},1 {i},2 {i},3" in got[i] for i in range(40))
    assert sum("2019 4 88" in t for t in got.values()) == 1


OWN_NAMES = ["row", "key", "place", "nth", "left", "drops", "th", "__drops", "__key", "__stats", "__gone", "stats", "run", "spans", "n", "size", "lines", "n_lines", "n_dropped", "id", "doc", "before", "kept", "found", "s", "words", "upper", "component_id", "pos", "leaf", "tokens", "__lines2", "x", "y", "again"]


def test_extra_columns_that_clash(spark):
    """Columns of names that the code itself uses change nothing and pass through where docs' columns do."""
    rows = odd_rows() + [(200 + i, f"line {i} of many words here\nshared boilerplate line of some words", "en", "a", 60) for i in range(12)]
    plain = docs_of(spark, rows)
    docs = plain.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(OWN_NAMES)))
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 1), (2, None, None), (20, 0, 1), (204, 1, 0), (207, 0, 0)], "doc_id long, quality int, toxic int")
    same = lambda a, b: sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    for f in (minhash.near_duplicates, mixing.taken, lambda d: quality.scores(d, labels), lambda d: toxicity.scores(d, labels), windows.repeated_passages, lambda d: bpe.token_counts(d, tokenizer_path("byte_bpe_50k.json")), lambda d: packing.pack(d, tokenizer_path("word_bpe_49k.json")).drop("sequence_id")):
        assert same(f(docs), f(plain))
    for f in (minhash.first_of_each, lines.cleaned, lines.without_recurring_lines, mixing.mixed_documents, lambda d: quality.accepted(d, labels)):
        out, want = f(docs), f(plain)
        assert out.columns[: len(docs.columns)] == docs.columns and same(out, want)
        assert all(r[c] == i for r in out.limit(3).collect() for i, c in enumerate(OWN_NAMES))


def test_repeated_rows_are_kept_once(spark):
    rows = [(1, "a text of some words", "en", "a", 1), (1, "a text of some words", "de", "b", 2), (1, "another text", "en", "a", 1), (2, "a text of some words", "en", "a", 1), (None, "a text of some words", "en", "a", 1), (3, None, "en", "a", 1), (3, None, "en", "a", 1)]
    got = minhash.first_of_each(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", "a text of some words"), ("1", "another text"), ("3", "None"), ("None", "a text of some words")]


def test_regions_are_parted_at_their_own_depth(spark, monkeypatch):
    """With a bound of 4 rows outside a region's largest group, regions are parted deeper; links between groups are still found."""
    monkeypatch.setattr(minhash, "CROSS", 4)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):  # far apart from each other, near enough to share regions; each has one near copy
        w = list(base)
        for j in rng.choice(200, 36, replace=False):
            w[j] = f"v{i}x{j}"
        rows.append((2 * i, " ".join(w), "en", "a", 0))
        w[int(rng.integers(200))] = f"z{i}"
        rows.append((2 * i + 1, " ".join(w), "en", "a", 0))
    sets = {r[0]: shingle_set(r[1], 1) for r in rows}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows), words=1).collect()}
    assert got == want and 100 < len(set(want.values())) <= 120


def test_stars_and_scratch_folder(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, (2, 250))
    want = closure(range(400), list(zip(a.tolist(), b.tolist(), strict=True)))
    ids, least = components.stars(a, b)
    assert {int(i): int(x) for i, x in zip(ids, least, strict=True)} == {i: r for i, r in want.items() if i != r}
    from types import SimpleNamespace

    from docloom.llm import common

    off = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))
    with pytest.raises(ValueError):
        common.shared_dir(off)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    Scratch(spark, "t").keep(spark.range(3), "x")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_mix_equals_its_slots_and_blocks(spark):
    """What each row gives, recomputed by laying slots over the streams; targets by bisection on the water level."""
    rows = [tuple(r) for r in table(spark, DATA, "documents").collect()]
    docs = docs_of(spark, rows)
    placed, filled, takes, sources, goals = mixing.mix(docs, shard_slots=8)
    level, total = (0.0, 1e12), sum(n for _, n in sources)
    for _ in range(200):
        mid = sum(level) / 2
        level = (mid, level[1]) if sum(min((i % 3 + 1) * mid, 3 * n) for i, (_, n) in enumerate(sources)) < total else (level[0], mid)
    assert np.allclose(goals, [min((i % 3 + 1) * level[0], 3 * n) for i, (_, n) in enumerate(sources)])
    owner, given = defaultdict(dict), Counter()
    for r in placed.collect():
        for i in range(r.start, r.start + r.size):
            assert i not in owner[r.s]
            owner[r.s][i] = r.doc_id
    slots = filled.collect()
    for r in slots:
        for i in range(r.block * mixing.BLOCK, r.block * mixing.BLOCK + r.words):
            given[owner[r.s][i]] += 1
    got = {r.doc_id: sum(x.hi - x.lo for x in r.spans or []) for r in takes.collect()}
    assert {k: v for k, v in got.items() if v} == dict(given)
    shards = Counter(r.shard for r in slots)
    assert set(shards) == set(range(len(shards))) and all(n == 8 for k, n in shards.items() if k < len(shards) - 1)
    assert len({tuple(sorted(Counter(r.s for r in slots if r.shard == k).items())) for k in list(shards)[:20]}) > 1


def test_driver_gives_its_memory_back_between_tables(spark, monkeypatch):
    """A collection is asked for after a written table, if the heap has grown past half of what it may, and else not."""
    calls = []
    for total, want in ((500, 0), (501, 1)):
        runtime = SimpleNamespace(totalMemory=lambda total=total: total, maxMemory=lambda: 1000)
        jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda runtime=runtime: runtime))), System=SimpleNamespace(gc=lambda: calls.append("gc")))
        common.relieved(SimpleNamespace(_jvm=jvm))
        assert len(calls) == want
    monkeypatch.setattr(common, "relieved", lambda session: calls.append(session))
    assert Scratch(spark, "relief").keep(spark.range(3), "rows").count() == 3 and calls == ["gc", spark]


def test_tasks_give_their_memory_back():
    """What a worker holds after tasks of signatures and packing, against what it held before: their caches go with them."""
    run = """
import re, sys
import pyarrow as pa
from docloom.llm import minhash, packing
from docloom.llm.common import WORDS

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n, tag):
    for i in range(20):
        texts = [" ".join(f"{tag}{i}x{j}y{k}" for k in range(200)) for j in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

def tasks(n, tag):
    return sum(b.num_rows for b in minhash._sets(batches(n, tag), 5)) + sum(b.num_rows for b in packing._packed(batches(n, tag), sys.argv[1], True))

tasks(1, "a")
before = held()
tasks(100, "b")
print(len(WORDS), held() - before)
"""
    out = subprocess.run([sys.executable, "-c", run, tokenizer_path("word_bpe_49k.json")], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    print(out)
    assert out[0] == "0" and float(out[1]) < 60


def test_pipeline_equals_brute_force_by_stage(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from docloom.llm.sql import LINES

    docs = table(spark, DATA, "documents").union(docs_of(spark, [(r[0] and r[0] + 100_000, *r[1:]) for r in odd_rows()]))
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "t")
    assert list(stages) == ["quality", "lines", "near_dedup", "mixing", "packing"]
    labels = table(spark, DATA, "labels")
    one = scratch.keep(stages["quality"](spark, docs, DATA), "one")
    good = Counter(r.doc_id for r in quality.scores(docs, labels).collect() if r.score >= 0.5)
    assert one.columns == docs.columns and Counter(r.doc_id for r in one.select("doc_id").collect()) == good and len(good) < docs.count()
    two = scratch.keep(stages["lines"](spark, one, DATA), "two")
    con = duckdb.connect()
    con.register("documents", one.toArrow())
    want = Counter((i, m) for i, _, _, m in con.execute(LINES).fetchall())
    import hashlib

    assert Counter((r.doc_id, None if r.text is None else hashlib.md5(r.text.encode()).hexdigest()) for r in two.collect()) == want
    three = scratch.keep(stages["near_dedup"](spark, two, DATA), "three")
    rows = {(r.doc_id, r.text): tuple(r) for r in two.collect()}
    sets = {i: shingle_set(t, 5) for i, t in rows if i is not None}
    reach = closure(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert sorted(map(repr, map(tuple, three.collect()))) == sorted(repr(r) for (i, _), r in rows.items() if i is None or reach[i] == i)
    four = scratch.keep(stages["mixing"](spark, three, DATA), "four")
    source = defaultdict(list)
    for r in three.collect():
        source[r.doc_id].append(words(r.text))
    for r in four.collect():
        part = words(r.text)
        assert part and any(part == w[i : i + len(part)] for w in source[r.doc_id] for i in range(len(w) - len(part) + 1)) and r.n_chars == len(r.text)
    taken = {r.doc_id: r.taken for r in mixing.taken(three).collect()}
    got = Counter()
    for r in four.collect():
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == {k: v for k, v in taken.items() if v}
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = Counter(i for r in four.collect() for i in [*library.encode(r.text, add_special_tokens=False).ids, 1])
    assert Counter(i for r in stages["packing"](spark, four, DATA).collect() for i in r.ids) == ids


def test_oracles(spark):
    from docloom.llm.queries import QUERIES
    from docloom.llm.sql import ORACLE_SQL

    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want, got = con.sql(sql), QUERIES[name](spark, DATA)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(repr, want.select(*cols).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())

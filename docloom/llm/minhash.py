"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is read as several sorted orders ("trees"): a tree's first ``DEPTH`` minima form a region key and eight
further minima, a byte each, order the region's documents. Rows are dealt by range of (region, order, document), so
even one region with a third of the corpus spreads over many tasks. Documents next to each other in an order are those
with the longest common prefix; they are the first candidates, and each is confirmed on the full shingle sets.

Regions that hold more than one group after that are searched at a depth of their own: if more than ``CROSS`` rows lie
outside a region's largest group, the region is parted by one further minimum after another until at most so many do, or
the order's minima are used up. Every row outside the largest group is compared with the rest of its part, by a 256-bit
sketch of the signature, then on the full sets. So a row meets at most CROSS others outside its group in each tree,
unless more agree in all DEPTH + 8 minima: those are searched in full too, in blocks.

Chance that a pair at the threshold 0.8 shares no region: (1 - 0.8**6)**40 = 5e-6, and 1e-4, 6e-4 and 2e-3 if all its
regions are parted one, two and three minima deeper; that the sketch rejects it: 6 standard deviations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORDS as WORD_HASHES
from docloom.llm.common import Scratch, mix64, released, shingles, word_hashes
from docloom.llm.components import components

TREES, DEPTH, LATER, FIRST_TREES, SKETCH_BITS, CROSS, BLOCK = 40, 6, 8, 4, 256, 1024, 4096


def _factors() -> np.ndarray:
    return (mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit shingle hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (factors[:, None] * x[None, at : at + 2048]).min(axis=1), out=least)
    return least


@released
def _signed(batches, k: int):
    WORD_HASHES.clear()
    factors = _factors()
    weights = mix64(np.arange(101, 101 + TREES * DEPTH, dtype=np.uint64)).reshape(TREES, DEPTH) | np.uint64(1)
    tree = np.arange(TREES, dtype=np.uint64)
    later = (np.arange(TREES)[:, None] * DEPTH + DEPTH + np.arange(LATER)[None, :]) % (TREES * DEPTH)
    order = (np.uint64(1) << (np.arange(7, -1, -1, dtype=np.uint64) * np.uint64(8)))[None, :]
    bits = [np.uint64(1) << np.arange(64, dtype=np.uint64)] * 4
    for batch in batches:
        out = {c: [] for c in ("n", "k1", "k2", "keys", "orders", "sketch")}
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            found = np.unique(shingles(word_hashes(text or b""), k))
            out["n"].append(len(found))
            if not len(found):
                for c in ("k1", "k2", "keys", "orders", "sketch"):
                    out[c].append(None)
                continue
            out["k1"].append(int(mix64(found).sum(dtype=np.uint64).view(np.int64)))
            out["k2"].append(int((mix64(found ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64).view(np.int64)))
            least = signature(found, factors)
            wide = mix64(least.astype(np.uint64) + np.uint64(1) + (np.arange(len(least), dtype=np.uint64) << np.uint64(33)))
            key = mix64((wide.reshape(TREES, DEPTH) * weights).sum(axis=1, dtype=np.uint64))
            out["keys"].append(((key & ~np.uint64(63)) | tree).view(np.int64))
            low = wide & np.uint64(255)
            out["orders"].append(((low[later] * order).sum(axis=1, dtype=np.uint64) >> np.uint64(1)).view(np.int64))
            one = (wide[: TREES * DEPTH] >> np.uint64(40)) & np.uint64(1)
            one = np.concatenate([one, (wide[: SKETCH_BITS - len(one)] >> np.uint64(41)) & np.uint64(1)])
            out["sketch"].append((one.reshape(4, 64) * np.stack(bits)).sum(axis=1, dtype=np.uint64).view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], pa.int64()) for c in ("n", "k1", "k2")), *(pa.array(out[c], longs) for c in ("keys", "orders", "sketch"))], names=["doc_id", "n", "k1", "k2", "keys", "orders", "sketch"])


@released
def _sets(batches, k: int):
    WORD_HASHES.clear()
    for batch in batches:
        found = [np.unique(shingles(word_hashes(x or b""), k)).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "found"])


@released
def _neighbours(batches):
    """Rows sorted by (region, order, document) -> those that share their region with the row before or after, with the row before.

    The first and last row of a task always stay, for regions that continue in another task."""
    held = None  # the last row so far: key, order, doc, the row before it in its region or None, and whether it is the task's first
    names = ["key", "order", "doc", "before"]
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if not rows.shape[1]:
            continue
        start = held is not None
        if start:
            rows = np.concatenate([held[0], rows], axis=1)
        key, doc = rows[0], rows[2]
        same = np.zeros(len(key) + 1, bool)  # same[i]: row i has the region of row i - 1
        same[1:-1] = key[1:] == key[:-1]
        keep, null = same[:-1] | same[1:], ~same[:-1]
        before = np.empty(len(key), np.int64)
        before[1:], before[0] = doc[:-1], 0
        if start:  # it has waited and knows its own predecessor
            keep[0] |= held[1] is not None or held[2]
            if held[1] is not None:
                before[0], null[0] = held[1], False
        else:
            keep[0] = True
        n = len(key) - 1  # the last row waits for the next batch
        index = np.flatnonzero(keep[:n])
        if len(index):
            yield pa.RecordBatch.from_arrays([*(pa.array(c[index]) for c in rows), pa.array(before[index], mask=null[index])], names=names)
        last = rows[:, n:]
        held = (last, held[1], held[2]) if n == 0 and start else (last, None if null[n] else int(before[n]), not start and n == 0)
    if held is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in held[0]), pa.array([held[1]], pa.int64())], names=names)


@released
def _confirmed(batches, percent: int):
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        linked = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared = int((y[at] == x).sum()) if len(y) else 0
            linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))


@released
def _across(batches, percent: int, most: int):
    """Rows sorted by block of a region -> the groups of linked documents: outer rows against inner ones of another group.

    Sets whose sizes or sketches rule a link out are passed over, the rest is counted in full."""

    def linked(rows):
        rows = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*rows, strict=True)]
        doc, g, inner, outer, found, *sketch = rows
        sets = [np.frombuffer(x, np.uint64) for x in found]
        size = np.array([len(x) for x in sets])
        bits = np.stack(sketch).view(np.uint64)
        out = set()
        for i in np.flatnonzero(outer):
            near = inner & (g != g[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            near = np.flatnonzero(near)
            near = near[np.bitwise_count(bits[:, near] ^ bits[:, i : i + 1]).sum(axis=0) <= most]
            if not len(near):
                continue
            every = np.concatenate([sets[j] for j in near])
            place = np.searchsorted(sets[i], every)
            place[place == size[i]] = 0
            shared = np.add.reduceat(sets[i][place] == every, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            for j in near[100 * shared >= percent * (size[near] + size[i] - shared)]:
                out.add((int(min(g[i], g[j])), int(max(g[i], g[j]))))
        return out

    def sent(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a_g", "b_g"])

    held, of = [], None
    for batch in batches:
        where = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7)] + [batch.column(7).to_pylist()] + [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8, 12)]
        edges = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            now = tuple(where[:, lo]) if hi > lo else of
            if held and now != of:
                yield sent(linked(held))
                held = []
            of = now
            if hi > lo:
                held.append([c[lo:hi] for c in columns])
    if held:
        yield sent(linked(held))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose full sets have percent of their union in common."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")


def parted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows(key, order, a, g) -> rows of regions with several groups: (key, level, part, a, g, top, n, out).

    A region's part is what agrees in ``level`` further minima: none, if at most CROSS rows lie outside its largest group,
    else the fewest that make it so. n counts a part's rows, top is its largest group and out counts the rows outside."""
    part = lambda level: F.when(level == 0, 0).otherwise(F.expr("shiftright(order, 63 - 8 * level)"))

    def counted(x: DataFrame) -> DataFrame:
        by = x.groupBy("key", "level", "part", "g").count().groupBy("key", "level", "part").agg(F.max(F.struct("count", "g")).alias("top"), F.sum("count").alias("n"))
        return by.select("key", "level", "part", F.col("top.g").alias("top"), "n", (F.col("n") - F.col("top.count")).alias("out"))

    whole = rows.withColumn("level", F.lit(0)).withColumn("part", F.lit(0).cast("long"))
    regions = scratch.keep(counted(whole).filter("out > 0"), "regions")
    hot = rows.join(regions.filter(F.col("out") > CROSS).select("key"), "key")
    deeper = hot.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LATER)))).withColumn("part", part(F.col("level")))
    # the first level that is small enough, or the last
    stats = scratch.keep(counted(deeper), "parts")
    found = hot.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LATER)))).withColumn("part", part(F.col("level"))).join(stats, ["key", "level", "part"])
    found = found.filter((F.col("out") <= CROSS) | (F.col("level") == LATER))
    chosen = found.groupBy("key", "order", "a", "g").agg(F.min(F.struct("level", "part", "top", "n", "out")).alias("s")).select("key", "order", "a", "g", "s.*").filter("out > 0")
    calm = whole.join(regions.filter(F.col("out") <= CROSS), ["key", "level", "part"])
    columns = ["key", "level", "part", "a", "g", "top", "n", "out"]
    return calm.select(*columns).unionByName(chosen.select(*columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs -> (id, n_shingles, component_id, kept): a row for each row of docs.

    Texts are compared by their sets of distinct ``words``-word shingles (A-Z lower-cased; a shorter text is one
    shingle), however long they are. Two documents are linked if their intersection has ``percent`` % of their union;
    component_id is the smallest id reachable. Equal sets are compared once. Null and empty texts, and texts without
    words, have no shingles and are linked with nothing. Rows that repeat an id are one node of the link graph and keep a
    row each; a row whose id is null is returned with itself as no component (component_id null, kept true). Pairs that tie
    at the threshold are linked. Other columns of docs, whatever their names, play no part. An empty table gives an empty
    result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(lambda it: _signed(it, words), "doc_id long, n long, k1 long, k2 long, keys array<long>, orders array<long>, sketch array<long>"), "signed")
    able = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(able.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")

    first = able.join(classes.select("k1", "k2", F.col("rep").alias("doc_id")), ["doc_id", "k1", "k2"], "left_semi")
    rows = first.select("doc_id", F.explode(F.arrays_zip("keys", "orders")).alias("t"))
    rows = rows.select(F.col("t.keys").alias("key"), F.col("t.orders").alias("order"), F.col("doc_id").alias("doc"))
    rows = rows.repartitionByRange("key", "order", "doc").sortWithinPartitions("key", "order", "doc")
    forest = scratch.keep(rows.mapInArrow(_neighbours, "key long, order long, doc long, before long"), "forest")

    wanted = forest.select(F.col("doc").alias("doc_id")).distinct()
    sets = scratch.keep(texts.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, words), "doc_id long, found binary"), "sets")
    sketch = able.select("doc_id", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(4))).distinct()

    def likely(side: str) -> DataFrame:
        return sketch.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "s0", "s1", "s2", "s3")))

    far = "bit_count(a_s0 ^ b_s0) + bit_count(a_s1 ^ b_s1) + bit_count(a_s2 ^ b_s2) + bit_count(a_s3 ^ b_s3)"
    p = (1 + percent / 100) / 2
    most = int(SKETCH_BITS * (1 - p) + 6 * (SKETCH_BITS * p * (1 - p)) ** 0.5)
    alike = f"{far} <= {most} AND 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"

    # 1. neighbours in the first orders
    chain = forest.filter("before IS NOT NULL AND before <> doc").select(F.least("doc", "before").alias("a"), F.greatest("doc", "before").alias("b"), (F.col("key").bitwiseAND(63) < FIRST_TREES).alias("early"))
    one = chain.filter("early").select("a", "b").distinct()
    same_id = able.join(classes, ["k1", "k2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    group = components(confirm(one, sets, percent).union(same_id), scratch, "g1")

    # 2. neighbours in all orders whose groups still differ
    def grouped(df: DataFrame, group: DataFrame, side: str) -> DataFrame:
        return df.join(group.select(F.col("id").alias(side), F.col("component").alias(f"{side}_g")), side, "left").withColumn(f"{side}_g", F.coalesce(f"{side}_g", side))

    two = grouped(grouped(chain.filter("NOT early").select("a", "b").distinct(), group, "a"), group, "b").filter("a_g <> b_g")
    two = scratch.keep(two.join(likely("a"), "a").join(likely("b"), "b").filter(alike).select("a", "b", "a_g", "b_g"), "two")
    group = joined(group, confirm(two.select("a", "b"), sets, percent).join(two, ["a", "b"]), scratch, "g2")

    # 3. regions whose groups still differ, at their own depth: each row outside a part's largest group against the part
    rows = grouped(forest.select("key", "order", F.col("doc").alias("a")).distinct(), group, "a").withColumnRenamed("a_g", "g")
    rows = parted(scratch.keep(rows, "rows"), scratch).withColumn("nx", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")).withColumn("ny", F.expr(f"(out + {CROSS - 1}) div {CROSS}"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("a"), "nx")).withColumn("y", F.when(F.col("g") != F.col("top"), F.pmod(F.xxhash64("a"), "ny")))
    at = "array_distinct(concat(transform(sequence(0L, ny - 1), v -> struct(x AS x, v AS y)), if(y IS NULL, array(), transform(sequence(0L, nx - 1), v -> struct(v AS x, y AS y)))))"
    rows = rows.withColumn("at", F.explode(F.expr(at))).select(F.xxhash64("key", "level", "part").alias("key"), F.col("at.x").alias("bx"), F.col("at.y").alias("by"), "a", "g", (F.col("at.x") == F.col("x")).alias("inner"), F.coalesce(F.col("at.y") == F.col("y"), F.lit(False)).alias("outer"))
    rows = rows.join(sets.withColumnRenamed("doc_id", "a"), "a").join(sketch.withColumnRenamed("doc_id", "a"), "a")
    rows = rows.select("key", "bx", "by", "a", "g", "inner", "outer", "found", "s0", "s1", "s2", "s3").repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by")
    group = joined(group, rows.mapInArrow(lambda it: _across(it, percent, most), "a_g long, b_g long"), scratch, "g3")
    scratch.drop("sets", "forest", "regions", "parts", "rows", "two")

    out = signed.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    out = out.join(group.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def joined(group: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Groups after further links(a_g, b_g) between them."""
    merged = components(links.select(F.col("a_g").alias("a"), F.col("b_g").alias("b")), scratch, name)
    new = merged.withColumnRenamed("component", "to")
    old = group.join(new.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    alone = merged.join(group.select("id"), "id", "left_anti")
    return scratch.keep(old.unionByName(alone.select("id", "component")), f"{name}-all")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of near-duplicates, that of the smallest id, in docs' columns.

    Rows without words (null, empty and blank texts) and rows without an id are all kept; rows that repeat a kept id and
    its text are one document and are kept once, whatever their other columns hold. Columns of any name pass through, as
    the row travels packed in one column; very long texts are compared whole; an empty table stays empty."""
    scratch = Scratch(docs.sparkSession, "first")
    found = scratch.keep(near_duplicates(docs, id_col, text_col, words, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")), "found")
    # tables of their own, whose sizes Spark knows before it plans the joins
    gone = scratch.keep(found.filter("NOT kept").select("doc_id"), "gone")
    again = scratch.keep(found.filter("kept AND n > 1").select("doc_id"), "again")
    rows = docs.select(F.struct("*").alias("row"))
    key = F.col("row")[id_col].cast("long")
    once = rows.join(gone, key == gone.doc_id, "left_anti").join(again, key == again.doc_id, "left_anti")
    more = rows.join(again, key == again.doc_id, "left_semi").withColumn("text", F.col("row")[text_col]).withColumn("id", key)
    return once.unionByName(more.dropDuplicates(["id", "text"]).select("row")).select("row.*")

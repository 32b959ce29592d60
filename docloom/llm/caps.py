"""Embedding near-duplicates by spherical-cap filters.

Filter directions are structured: a product code joins one codeword for each half of the (randomly rotated) space, and
several such codes are used. A vector is list-decoded to every direction whose inner product with it exceeds a
threshold, taken from the exact tail of a spherical cap: codewords of the first half are tried only if the best of the second half can still reach it, and the second
half's are walked in falling order.

Vectors that share a direction are candidates. A vector's home is the direction of its list that most vectors share: a
pair of one home is compared there only, any other pair under the first direction that both are listed under. So a large
cluster, whose vectors share most of their lists, is compared once and not under each of them. A first pass carries ids and
sketches of 128 signs and keeps the rows that have a candidate within reach; the kept ones are joined with their vectors and
compared in double precision."""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch
from docloom.llm.components import components

CODES, LISTED, PER_VECTOR, BLOCK, SEED, ROUNDS, WIDEST, SIGNS, SMALL = 8, 64, 4, 1024, 6, 4, 0.7, 128, 48


def usable(vector: str | Column) -> Column:
    """True for vectors that are not null, not zero and have only finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _caps(d: int) -> tuple[np.ndarray, np.ndarray]:
    """(angles from 0 to a quarter turn, share of all unit vectors of d components within each of them of a fixed direction)."""
    angle = np.linspace(0, np.pi / 2, 200_001)
    area = np.concatenate([[0.0], np.cumsum(np.convolve(np.sin(angle) ** max(0, d - 2), [0.5, 0.5], "valid"))])
    return angle, area / (2 * area[-1])


def cap(d: int, share: float) -> float:
    """The inner product with a fixed direction that a share of all unit vectors of d components exceeds."""
    angle, shares = _caps(d)
    return float(np.cos(np.interp(share, shares, angle)))


def codewords(d: int, n: int, listed: int = LISTED) -> int:
    """Codewords of each half for n vectors: PER_VECTOR directions a vector, but no more than keep caps at least WIDEST wide.

    In few dimensions finer caps would be narrower than the pairs that must share one."""
    angle, shares = _caps(d)
    most = ceil(sqrt(listed / CODES / float(np.interp(WIDEST, angle, shares))))
    return max(2, min(max(8, ceil(sqrt(PER_VECTOR * n / CODES))), most))


def units(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x / most, axis=1, keepdims=True) / most


class Filters:
    """CODES product codes of k * k directions each, for vectors of d components; about LISTED exceed the threshold for a vector."""

    def __init__(self, d: int, k: int, listed: int = LISTED, codes: int = CODES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.d, self.k, self.h = d, k, max(1, d // 2)
        self.codes = []
        for _ in range(codes):
            turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
            halves = []
            for n in (self.h, d - self.h):
                words = rng.standard_normal((k, n))
                halves.append(words / np.maximum(1e-12, np.linalg.norm(words, axis=1, keepdims=True)) * sqrt(n / d) if n else words)
            self.codes.append((turn, *halves))
        self.least = cap(d, min(0.5, listed / (codes * k * k)))
        self.signs = rng.standard_normal((d, SIGNS))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """[vector, SIGNS / 64] the signs of inner products with fixed random directions."""
        return np.packbits(x @ self.signs > 0, axis=1, bitorder="little").view("<i8")

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions that exceed the threshold, for unit vectors x."""
        rows, found = [], []
        for r, (turn, one, two) in enumerate(self.codes):
            y = x @ turn
            s, t = y[:, : self.h] @ one.T, y[:, self.h :] @ two.T
            order = np.argsort(-t, axis=1)
            t = np.take_along_axis(t, order, axis=1)
            i, c = np.nonzero(s >= self.least - t[:, :1])
            part = s[i, c]
            for j in range(self.k):
                over = part + t[i, j] >= self.least
                i, c, part = i[over], c[over], part[over]
                if not len(i):
                    break
                rows.append(i)
                found.append((r * self.k + c) * self.k + order[i, j])
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _listed(batches, n: int, listed: int, seed: int):
    made: dict[int, Filters] = {}
    for batch in batches:
        ids, weights = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        vectors = batch.column(2)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            x = np.array(vectors.take(pa.array(own)).to_pylist(), np.float64)
            unit = units(x)
            with np.errstate(over="ignore"):
                short = (x.astype(np.float32) == x).all()  # vectors travel in single precision if that loses nothing
            made[d] = made.get(d) or Filters(int(d), codewords(int(d), n, listed), listed, seed=seed)
            for at in range(0, len(own), 512):
                row, found = made[d].decode(unit[at : at + 512])
                order = np.lexsort((found, row))
                row, found = row[order], found[order] * 65536 + int(d)
                ends = np.searchsorted(row, np.arange(min(512, len(own) - at) + 1))
                lists = [found[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)]
                part = own[at : at + 512]
                raw = x[at : at + 512].astype("<f4" if short else "<f8")
                signs = made[d].sketch(unit[at : at + 512])
                columns = [pa.array(ids[part]), pa.array(weights[part]), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(lists, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in signs.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "weight", "raw", "filters", "s0", "s1"])


def _grouped(batches, n_keys: int, columns: int):
    """Sorted batches -> (keys, columns) of each stretch of whole groups of equal keys, as arrays; held over batches."""
    held: list[list] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(now[0]):
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in now[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        if held and any(c[0] != h[-1] for c, h in zip(now[:n_keys], held[-1][:n_keys], strict=True)):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if len(cut):
            held.append([c[: cut[-1]] for c in now])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = [[c[cut[-1] :] for c in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _edges(keys: list[np.ndarray]) -> np.ndarray:
    change = np.ones(len(keys[0]) + 1, bool)
    change[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(change)


def _reached(batches, most: int):
    """Rows (filter, one, two, block, id, home, sketch) sorted by the first three -> those with a candidate whose sketch differs in most signs at most."""

    def candidates(key, two_blocks, block, home, a, b):
        fits = (home[a] != home[b]) | (home[a] == key)
        return fits & (block[a] != block[b]) if two_blocks else fits

    for rows in _grouped(batches, 3, 8):
        key, one, two, block, ids, home, s0, s1 = rows
        sketch = np.stack([s0, s1]).view(np.uint64)
        edges = _edges([key, one, two])
        size = np.diff(edges)
        group = np.repeat(np.arange(len(size)), size)
        keep = np.zeros(len(key), bool)
        small = np.flatnonzero(size[group] <= SMALL)  # step by step: each row with the k-th after it in its group
        for k in range(1, int(size[size <= SMALL].max(initial=1))):
            a = small[small + k < edges[group[small] + 1]]
            if not len(a):
                break
            b = a + k
            near = ((home[a] != home[b]) | (home[a] == key[a])) & ((one[a] == two[a]) | (block[a] != block[b]))
            a, b = a[near], b[near]
            near = np.bitwise_count(sketch[:, a] ^ sketch[:, b]).sum(axis=0) <= most
            keep[a[near]] = keep[b[near]] = True
        for g in np.flatnonzero(size > SMALL):
            lo, hi = edges[g], edges[g + 1]
            if (home[lo:hi] == home[lo]).all() and home[lo] != key[lo]:
                continue
            for i in range(lo, hi):
                j = np.arange(lo, hi)
                j = j[candidates(key[lo], one[lo] != two[lo], block, home, i, j) & (j != i)]
                if len(j) and (np.bitwise_count(sketch[:, j] ^ sketch[:, i : i + 1]).sum(axis=0) <= most).any():
                    keep[i] = True
        kept = np.flatnonzero(keep)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (key, one, two, block, ids)], names=["filter", "one", "two", "block", "id"])


def _linked(key, block, ids, weight, home, raw, lists, least: float):
    """(id, links, next) of one group's rows: the links that count under this filter, and a chain through each component."""
    d = key[0] % 65536
    x = units(np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * d else "<f8").astype(np.float64) for b in raw]))
    n = len(x)
    at_home = home == key[0]
    linked = np.zeros((n, n), bool)
    names, counts = np.unique(home, return_counts=True)
    rest = np.arange(n) if at_home.any() else np.flatnonzero(home != names[counts.argmax()])
    linked[rest] = x[rest] @ x.T >= least
    linked[:, rest] |= linked[rest].T
    linked[np.arange(n), np.arange(n)] = False
    if key[1] != key[2]:  # only pairs across the two blocks; pairs within one have a group of their own
        linked &= block[:, None] != block[None, :]
    other = home[:, None] != home[None, :]
    linked &= other | at_home[:, None]
    # a pair of different homes counts in the first filter that both are listed under
    own = np.flatnonzero((linked & other).any(axis=1))
    if len(own):
        rows, under = np.repeat(own, [len(lists[i]) for i in own]), np.concatenate([lists[i] for i in own])
        before = under < key[0]
        order = np.argsort(under[before], kind="stable")
        rows, under = rows[before][order], under[before][order]
        edges = np.flatnonzero(np.r_[True, under[1:] != under[:-1], True]) if len(under) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                at = np.ix_(rows[lo:hi], rows[lo:hi])
                linked[at] &= ~other[at]
    own = np.flatnonzero(linked.any(axis=1))
    if not len(own):
        return None
    linked = linked[np.ix_(own, own)]
    label = np.arange(len(own))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(own)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    follows = np.full(len(own), -1)
    same = label[order][1:] == label[order][:-1]
    follows[order[1:][same]] = order[:-1][same]
    return ids[own], linked @ weight[own], np.where(follows >= 0, ids[own][follows], ids[own])


def _compared(batches, least: float):
    """Rows (filter, one, two, block, id, weight, home, raw, filters) sorted by the first three -> the links of each group; see _linked."""
    for rows in _grouped(batches, 3, 9):
        edges, out = _edges(rows[:3]), []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1 and (found := _linked(tuple(int(c[lo]) for c in rows[:3]), *(c[lo:hi] for c in rows[3:]), least)):
                out.append(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["id", "links", "next"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, listed: int = LISTED, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of vectors.

    Links are pairs with cosine of at least ``cosine`` in double precision; equal vectors are compared once and counted as
    often as they stand. Null vectors, zero ones and such with null or non-finite components are linked with nothing, nor
    are vectors of different lengths, however long; repeated ids are one node; rows with a null id stand alone
    (component_id null, kept true). Pairs that tie at the threshold are linked. A direction that more than ``block`` vectors share is dealt out as pairs of blocks, so no pair is lost and no
    task holds more than two blocks. Other columns, whatever their names, play no part; an empty table gives an empty result."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = rows.withColumn("able", usable("v") & F.col("vec_id").isNotNull())
    keyed = keyed.select("vec_id", "able", "v", F.when(F.col("able"), F.xxhash64("v")).alias("k1"), F.when(F.col("able"), F.hash("v")).alias("k2"))
    classes = keyed.filter("able").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = scratch.keep(classes, "classes")
    n = classes.count()
    lists = classes.select("rep", "weight", "v").mapInArrow(lambda it: _listed(it, n, listed, seed), "id long, weight long, raw binary, filters array<long>, s0 long, s1 long")
    lists = scratch.keep(lists, "lists")
    flat = lists.select("id", F.explode("filters").alias("filter"))
    sizes = flat.groupBy("filter").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}"))
    sizes = scratch.keep(sizes, "sizes")
    homes = flat.join(sizes, "filter").groupBy("id").agg(F.max(F.struct("n", "filter")).alias("home")).select("id", F.col("home.filter").alias("home"))
    known = scratch.keep(lists.join(homes, "id"), "homes")  # vectors that share no direction drop out
    share = np.arccos(min(1.0, cosine)) / np.pi  # of signs in which a pair at the threshold differs
    most = ceil(SIGNS * share + 6 * sqrt(SIGNS * share * (1 - share)))
    links = []
    for turn in range(ROUNDS):  # a part of the filters at a time, so that the disk holds a part of their shuffle
        at = known.select("id", "home", "s0", "s1", F.explode(F.filter("filters", lambda f: F.pmod(F.shiftright(f, 16), F.lit(ROUNDS)) == turn)).alias("filter"))
        at = at.join(sizes.select("filter", "blocks"), "filter")
        at = at.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        at = at.select("filter", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "home", "s0", "s1")
        at = at.repartition("filter", "one", "two").sortWithinPartitions("filter", "one", "two")
        near = scratch.keep(at.mapInArrow(lambda it: _reached(it, most), "filter long, one long, two long, block long, id long"), f"near-{turn}")
        both = near.join(known.select("id", "weight", "home", "raw", "filters"), "id")
        both = both.select("filter", "one", "two", "block", "id", "weight", "home", "raw", "filters").repartition("filter", "one", "two").sortWithinPartitions("filter", "one", "two")
        links.append(scratch.keep(both.mapInArrow(lambda it: _compared(it, cosine), "id long, links long, next long"), f"links-{turn}"))
        scratch.drop(f"near-{turn}")
    links = reduce(DataFrame.union, links)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    same_id = keyed.filter("able").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    group = components(links.filter("next <> id").select(F.col("id").alias("a"), F.col("next").alias("b")).union(same_id), scratch)
    found = classes.select("k1", "k2", "rep", "weight").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(group.withColumnRenamed("id", "rep"), "rep", "left")
    found = scratch.keep(found, "found")
    scratch.drop("classes", "lists", "homes", "sizes", *(f"links-{turn}" for turn in range(ROUNDS)))
    out = keyed.drop("v").join(found, ["k1", "k2"], "left")
    n_links = F.when(F.col("able"), F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("able"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Nearest neighbours by largest inner product, with a vantage-point tree for each shard.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the longest length, so that the largest inner product is the
least Euclidean distance. A search skips the far side of a vantage point if it lies beyond a factor times the distance
of the k-th nearest so far: factor 1 is the triangle inequality and exact, smaller ones skip more. By default the
smallest factor is taken that finds enough of the nearest on a bounded sample.

A top tree over such a sample parts the vectors into regions, each of one or more shards. A query first searches its own
region; with the k-th nearest of there it then goes only to the regions that the same inequality, with the same factor,
doesn't rule out. Queries travel to shards, in blocks; a shard's tree is built once."""

from __future__ import annotations

import pickle
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.caps import usable
from docloom.llm.common import Scratch

SHARD, QUERIES, LEAF, K, SEED = 4096, 1024, 256, 20, 7
FACTORS, RECALL, SAMPLE, SAMPLE_QUERIES = (0.1, 0.15, 0.2, 0.3, 0.5, 1.0), 0.999, 4096, 128  # factor and regions are fitted on a sample so bounded
REGION_SAMPLE = 8  # sampled vectors of a region at least


def build(x: np.ndarray, leaf: int = LEAF, seed: int = SEED) -> list[tuple]:
    """Nodes of a tree over the rows of x: ("leaf", rows) or ("split", vantage row, radius, inner node, outer node)."""
    rng, nodes = np.random.default_rng(seed), [None]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) <= leaf:
            nodes[at] = ("leaf", rows)
            continue
        vantage = rows[rng.integers(len(rows))]
        rows = rows[rows != vantage]
        away = np.sqrt(np.maximum(0, ((x[rows] - x[vantage]) ** 2).sum(axis=1)))
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        radius = float(away[order[half]])
        nodes[at] = ("split", int(vantage), radius, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), rows[order[:half]]), (len(nodes) + 1, rows[order[half:]])]
        nodes += [None, None]
    return nodes


def gaps(nodes: list[tuple], x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves' nodes, [query, leaf] the least distance at which the triangle inequality lets a query's neighbour lie there): 0 for its own leaf."""
    out, todo = {}, [(0, np.zeros(len(q)))]
    norms = (q**2).sum(axis=1)
    while todo:
        at, low = todo.pop()
        if nodes[at][0] == "leaf":
            out[at] = low
            continue
        _, vantage, radius, inner, outer = nodes[at]
        away = np.sqrt(np.maximum(0, norms + (x[vantage] ** 2).sum() - 2 * (q @ x[vantage])))
        gap, inside = np.abs(away - radius), away < radius
        todo += [(inner, np.maximum(low, np.where(inside, 0, gap))), (outer, np.maximum(low, np.where(inside, gap, 0)))]
    leaves = np.array(sorted(out))
    return leaves, np.stack([out[i] for i in leaves], axis=1)


def search(nodes: list[tuple], x: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0, within: np.ndarray | None = None) -> np.ndarray:
    """For each row of q the rows of x found nearest, [len(q), k], -1 where there are fewer; many queries go down together.

    within: the square of the distance from which neighbours of a query are of no use."""
    best = np.full((len(q), k), np.inf) if within is None else np.repeat(within[:, None], k, axis=1)
    found = np.full((len(q), k), -1, np.int64)
    norms, own = (x**2).sum(axis=1), (q**2).sum(axis=1)

    def see(active, rows):
        d = own[active][:, None] + norms[rows][None, :] - 2 * (q[active] @ x[rows].T)
        hit = np.flatnonzero(d.min(axis=1) < best[active, -1])
        if not len(hit):
            return
        d, active = d[hit], active[hit]
        all_d = np.concatenate([best[active], d], axis=1)
        all_r = np.concatenate([found[active], np.broadcast_to(rows, d.shape)], axis=1)
        top = np.argpartition(all_d, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(all_d, top, axis=1)
        order = np.argsort(d, axis=1)
        best[active] = np.take_along_axis(d, order, axis=1)
        found[active] = np.take_along_axis(np.take_along_axis(all_r, top, axis=1), order, axis=1)

    todo = [(0, np.arange(len(q)), None)]
    while todo:
        at, active, gap = todo.pop()
        if gap is not None:  # the far side, decided when it is its turn
            near = ~(gap >= factor * np.sqrt(np.maximum(0, best[active, -1])))
            active = active[near]
        if not len(active):
            continue
        node = nodes[at]
        if node[0] == "leaf":
            if len(node[1]):
                see(active, node[1])
            continue
        _, vantage, radius, inner, outer = node
        see(active, np.array([vantage]))
        away = np.sqrt(np.maximum(0, own[active] + norms[vantage] - 2 * (q[active] @ x[vantage])))
        inside, gap = away < radius, np.abs(away - radius)
        for side, first, second in ((inside, inner, outer), (~inside, outer, inner)):
            if side.any():
                todo += [(second, active[side], gap[side]), (first, active[side], None)]
    return found


def tuned(x: np.ndarray, q: np.ndarray, most: float, k: int) -> float:
    """The factor after the first of FACTORS that finds RECALL of the k nearest of sampled queries among sampled vectors: a step of margin, as shards' trees are others."""
    full = np.concatenate([x, np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))[:, None]], axis=1)
    asked, k = np.concatenate([q, np.zeros((len(q), 1))], axis=1), min(k, len(x))
    nodes, best = build(full), -np.sort(-(q @ x.T), axis=1)[:, k - 1 : k]
    for i, factor in enumerate(FACTORS):
        found = search(nodes, full, asked, k, factor)
        right = (np.take_along_axis(q @ x.T, np.maximum(found, 0), axis=1) >= best - 1e-9) & (found >= 0)
        if right.mean() >= RECALL:
            return FACTORS[min(i + 1, len(FACTORS) - 1)]
    return 1.0


class Regions:
    """The top tree over a sample, in the space with one more component: where vectors lie and which regions queries must see."""

    def __init__(self, sample: np.ndarray, n: int, most: float, shard: int):
        self.most = most
        self.x = self.longer(sample)
        self.nodes = build(self.x, max(REGION_SAMPLE, len(sample) * shard // max(1, n))) if len(sample) else [("leaf", np.zeros(0, np.int64))]

    def longer(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.most - (x**2).sum(axis=1)))[:, None]], axis=1)

    def of(self, full: np.ndarray) -> np.ndarray:
        leaves, low = gaps(self.nodes, self.x, full)
        return leaves[low.argmin(axis=1)]


def _placed(batches, regions: Regions, query: bool):
    """Rows (id, v) with the region where they lie; a query's added component is 0."""
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
        full = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else regions.longer(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(regions.of(full).astype(np.int32)) if len(x) else pa.array([], pa.int32())], names=["id", "v", "region"])


def _sent(batches, regions: Regions, factor: float):
    """Queries (id, v, region, kth score or null) -> a row (id, v, kth, region) for each other region that may hold one of the k nearest."""
    for batch in batches:
        q = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
        if not len(q):
            continue
        leaves, low = gaps(regions.nodes, regions.x, np.concatenate([q, np.zeros((len(q), 1))], axis=1))
        kth = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(0, (q**2).sum(axis=1) + regions.most - 2 * kth)))
        i, j = np.nonzero((low <= factor * reach[:, None] + 1e-9) & (leaves[None, :] != batch.column(2).to_numpy(zero_copy_only=False)[:, None]))
        at = pa.array(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(leaves[j].astype(np.int32))], names=["id", "v", "kth", "region"])


def _indexer(most: float, k: int):
    """One shard's index: distinct vectors, the k smallest ids of each, and the tree."""

    def index(pdf):
        import pandas as pd

        x = np.stack(pdf["v"].to_list()).astype(np.float64)
        order = np.argsort(pdf["id"].to_numpy(), kind="stable")
        x, ids = x[order], pdf["id"].to_numpy()[order]
        x, of = np.unique(x, axis=0, return_inverse=True)
        owners: list[list[int]] = [[] for _ in x]
        for i, c in zip(ids, of.ravel(), strict=True):
            if len(owners[c]) <= k:  # one more than k, as the query itself may be among them
                owners[c].append(int(i))
        longer = np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))[:, None]
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "tree": [pickle.dumps((x, owners, build(np.concatenate([x, longer], axis=1)), longer))]})

    return index


def _packed(pdf):
    import pandas as pd

    return pd.DataFrame({"region": [pdf["region"].iloc[0]], "queries": [pickle.dumps((pdf["id"].tolist(), np.stack(pdf["v"].to_list()).astype(np.float64), pdf["kth"].to_numpy(np.float64)))]})


def _answers(batches, k: int, factor: float, most: float):
    for batch in batches:
        for tree, block in zip(batch.column(0), batch.column(1), strict=True):
            x, owners, nodes, longer = pickle.loads(tree.as_py())
            ids, q, kth = pickle.loads(block.as_py())
            full, asked = np.concatenate([x, longer], axis=1), np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            within = np.where(np.isnan(kth), np.inf, np.maximum(0, (q**2).sum(axis=1) + most - 2 * kth) * (1 + 1e-9) + 1e-9)
            found = search(nodes, full, asked, min(len(x), k + 1), factor, within)
            out = ([], [], [])
            for i, row in enumerate(found):
                row = row[row >= 0]
                if not len(row):
                    continue
                score = np.cumsum(x[row] * q[i], axis=1)[:, -1]  # summed from left to right, so that every run and SQL agree
                near = sorted((-s, o) for s, r in zip(score.tolist(), row, strict=True) for o in owners[r] if o != ids[i])[:k]
                out[0].extend([ids[i]] * len(near))
                out[1].extend(o for _, o in near)
                out[2].extend(-s for s, _ in near)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", factor: float | None = None, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors of largest inner product, but those with its own id.

    A region's vectors are dealt to shards of about ``shard`` by a hash of id, however many lie there, and its queries to
    blocks. Vectors that are null, zero or have null or non-finite components take no part on either side, nor do null
    ids; vectors are compared with such of their own length only, however long. Ties go to the smaller id; equal vectors
    are indexed once with their ids. Rows that repeat an id and vector are one candidate; a repeated query is answered
    once. Other columns, whatever their names, play no part; empty tables give an empty result."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vptree")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable("v")).withColumn("d", F.size("v"))
    rows = scratch.keep(pick(vectors).distinct(), "rows")
    facts = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).collect()  # a row for each length
    asked = scratch.keep(pick(queries).dropDuplicates(["id", "d"]), "asked")
    out = None
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for fact in facts:
        part = _of_length(rows.filter(F.col("d") == fact.d).select("id", "v"), asked.filter(F.col("d") == fact.d).select("id", "v"), fact, k, factor, shard, block, scratch, order)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scratch.drop("rows", "asked", *(f"{t}-{f.d}" for f in facts for t in ("trees", "placed", "asked")))
    ranked = out.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_length(own: DataFrame, ask: DataFrame, fact, k: int, factor: float | None, shard: int, block: int, scratch: Scratch, order) -> DataFrame:
    """(query_id, vec_id, score) found for queries of one length of vectors."""
    spark, most = own.sparkSession, float(fact.most)
    some = [np.array([r.v for r in df.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(n).collect()], np.float64).reshape(-1, fact.d) for df, n in ((own, SAMPLE), (ask, SAMPLE_QUERIES))]
    speed = factor if factor is not None else tuned(*some, most, k) if len(some[1]) else 1.0
    regions = Regions(some[0], fact.n, most, shard)
    schema = "id long, v array<double>, region int"
    placed = scratch.keep(own.mapInArrow(lambda it: _placed(it, regions, False), schema), f"placed-{fact.d}")
    home = scratch.keep(ask.mapInArrow(lambda it: _placed(it, regions, True), schema), f"asked-{fact.d}")

    def parts(df: DataFrame, size: int) -> DataFrame:
        """(region, parts): into how many pieces of about size each region's rows are dealt; SAMPLE / REGION_SAMPLE regions at most."""
        return F.broadcast(df.groupBy("region").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")))

    def dealt(df: DataFrame, size: int) -> DataFrame:
        return df.join(parts(df, size), "region").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts"))

    trees = scratch.keep(dealt(placed, shard).groupBy("region", "part").applyInPandas(_indexer(most, k), "region int, tree binary"), f"trees-{fact.d}")

    def answered(df: DataFrame, name: str) -> DataFrame:
        blocks = dealt(df, block).groupBy("region", "part").applyInPandas(_packed, "region int, queries binary")
        met = blocks.join(trees, "region").select("tree", "queries")
        met = met.mapInArrow(lambda it: _answers(it, k, speed, most), "query_id long, vec_id long, score double")
        return scratch.keep(met, f"{name}-{fact.d}", batch=4)  # a row here is a whole shard with a block of queries

    first = answered(home.withColumn("kth", F.lit(None).cast("double")), "home")
    kth = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    more = home.join(kth, "id", "left").select("id", "v", "region", "kth").mapInArrow(lambda it: _sent(it, regions, speed), "id long, v array<double>, kth double, region int")
    return first.unionByName(answered(scratch.keep(more, f"sent-{fact.d}"), "more"))

"""Connected components of a link table, by repeated minimum hooking and pointer shortcuts on DataFrames.

Links are first contracted within the task that finds them: the spanning stars of a task's links hold all it knows. Each
round is then one written table of joins and map-side combined minima, so that no component, however large, meets in one
task: AQE splits the skewed joins, and every join reads a written table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, released


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id linked with it) for the ids of links a-b that aren't the smallest of their own component."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[one], label[two])
        np.minimum.at(new, label[one], least)
        np.minimum.at(new, label[two], least)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


@released
def _contracted(batches, most: int = 1 << 21):
    """Links (a, b) -> those of their stars, a few million links at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sent():
        a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)))
        size += batch.num_rows
        if size >= most:
            yield sent()
            held, size = [], 0
    if size:
        yield sent()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (id, component): for every id on a link, the smallest id reachable from it.

    Rows with a null end and self-links are ignored; repeated links count once; no links give an empty table. Each round
    at least halves the height of what is left, so 60 rounds are beyond any table; should they not do, this fails."""
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").mapInArrow(_contracted, "a long, b long")
    edges = scratch.keep(edges, f"{name}-links")
    both = scratch.keep(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    state = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("f")), f"{name}-0")
    before = None
    for i in range(1, most_rounds + 1):
        up = state.join(state.select(F.col("id").alias("f"), F.col("f").alias("g")), "f").select("id", "f", "g")
        seen = both.join(up.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m")).withColumnRenamed("a", "id")
        hook = up.join(seen, "id").select(F.explode(F.array(F.struct("id", F.least("m", "g", "f").alias("f")), F.struct(F.col("f").alias("id"), F.col("m").alias("f")))).alias("x"))
        told = Observation()
        new = hook.select("x.*").groupBy("id").agg(F.min("f").alias("f")).observe(told, F.count("*").alias("n"), F.sum(F.col("f").cast("decimal(38,0)")).alias("f"))
        state = scratch.keep(new, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        after = told.get
        if after == before or not after["n"]:  # labels only fall, so an equal sum means that none moved
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    scratch.drop(f"{name}-edges", f"{name}-links")
    return state.select("id", F.col("f").alias("component"))

"""Mixing sources to target weights.

Each source's tokens form one stream (documents in a pseudorandom order), cut into blocks of fixed length. The mix is a
row of output shards; a shard draws how many of its slots each source gets from a multinomial over what the sources
still owe. A source's slots are mapped through a pseudorandom permutation of its block indices (one for each pass over
the source), and slots and blocks are joined by index. A source's last slot is cut so that its total meets its target."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, mix64, n_words, released

BLOCK, SHARD_SLOTS, RUN_SHARDS, SEED, MOST, BUCKET_DOCS = 256, 1024, 1024, 20, 3, 2048


def targets(sizes: list[tuple[str | None, int]], weights: list[float] | None = None, most: float = MOST) -> list[float]:
    """Tokens for each source: its weight's share of all tokens, at most ``most`` times its own, the excess reshared by weight.

    sizes: (source, tokens) in the order of the weights; by default weights are 1, 2, 3, repeating."""
    weights = weights or [i % 3 + 1 for i in range(len(sizes))]
    left = float(sum(n for _, n in sizes))
    out, open_ = [0.0] * len(sizes), [i for i, (_, n) in enumerate(sizes) if n]
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * share > most * sizes[i][1]]
        if not full:
            for i in open_:
                out[i] = weights[i] * share
            break
        for i in full:
            out[i] = float(most * sizes[i][1])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permutation(n: int, source: int, turn: int, seed: int = SEED) -> tuple[int, int]:
    """(a, c) of the pseudorandom permutation j -> (a * j + c) mod n of a source's block indices in one pass."""
    x = int(mix64(np.array([seed * 1_000_003 + source * 101 + turn + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
    c, a = x % n, (x >> 20) % n | 1
    while gcd(a, n) != 1:
        a += 1
    return a, c


def plan(source_words: list[int], goals: list[float], block: int = BLOCK, seed: int = SEED) -> list[dict]:
    """For each source and pass: blocks, permutation, slots to fill and words that the pass takes (the last slot may be cut)."""
    out = []
    for s, (words, goal) in enumerate(zip(source_words, goals, strict=True)):
        left, turn = round(goal), 0
        while words and left > 0:
            n = -(-words // block)
            a, c = permutation(n, s, turn, seed)
            take = min(left, words)
            short = block * n - words
            at = (n - 1 - c) * pow(a, -1, n) % n if n > 1 else 0  # the slot of the last, shorter block
            slots = n if take == words else -(-take // block)
            if take < words and at < slots and block * slots - short < take:
                slots += 1
            out.append({"s": s, "turn": turn, "n": n, "a": a, "c": c, "slots": slots, "take": take, "short": short, "short_at": at})
            left -= take
            turn += 1
    return out


def shard_counts(owed: list[int], slots: int = SHARD_SLOTS, seed: int | tuple[int, ...] = SEED) -> np.ndarray:
    """[shard, source]: slots drawn from a multinomial over what sources still owe, never more than that; all is dealt in the end.

    The same draw deals runs of RUN_SHARDS shards (on the driver) and a run's shards (where its slots are filled)."""
    owed_now, out, rng = np.array(owed, np.int64), [], np.random.default_rng(seed)
    while (left := int(owed_now.sum())) > 0:
        now = np.zeros(len(owed_now), np.int64)
        while (need := min(slots, left) - int(now.sum())) > 0:
            free = owed_now - now
            now += np.minimum(rng.multinomial(need, free / free.sum()), free)
        out.append(now)
        owed_now = owed_now - now
    return np.array(out, np.int64).reshape(-1, len(owed))


def stream(docs: DataFrame, scratch: Scratch, id_col: str, source_col: str, text_col: str, seed: int = SEED) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """(doc_id, source, s, size, start): each row's place in its source's stream, and the sources in order with their words.

    The sums run over buckets of some thousand rows: within each, then over the buckets of a source."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("place"))
    sizes = scratch.keep(sizes, "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # a row for each source
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    names = [r.source for r in found]
    sources = docs.sparkSession.createDataFrame([(n, i, max(1, -(-r.rows // BUCKET_DOCS))) for i, (n, r) in enumerate(zip(names, found, strict=True))], "source string, s int, buckets int")
    known = sizes.join(F.broadcast(sources), sizes.source.eqNullSafe(sources.source)).drop(sources.source)
    known = scratch.keep(known.withColumn("bucket", F.pmod("place", "buckets").cast("int")).drop("buckets"), "known")
    by_bucket = known.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = by_bucket.withColumn("base", F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).drop("n")
    inner = Window.partitionBy("s", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.withColumn("within", F.sum("size").over(inner) - F.col("size")).join(before, ["s", "bucket"])
    placed = scratch.keep(placed.select("doc_id", "source", "s", "size", "place", (F.col("base") + F.col("within")).alias("start")), "placed")
    scratch.drop("known", "sizes")
    return placed, [(r.source, int(r.n)) for r in found]


def slots(spark: SparkSession, passes: list[dict], runs: np.ndarray, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, s, turn, slot, block, words): every slot of the mix, with the block that it holds and how many of its first words.

    runs[run, source]: slots of each run of RUN_SHARDS shards. A run's shards are drawn by the tasks that need them, from
    the run's own seed, so that the driver never holds a table of all shards."""
    schema = "shard long, s int, turn int, slot long, block long, words int"
    total = sum(p["slots"] for p in passes)
    if not total:
        return spark.createDataFrame([], schema)
    ends = np.cumsum([p["slots"] for p in passes])
    base = ends - [p["slots"] for p in passes]
    by_source = np.cumsum(runs, axis=0)  # slots of a source up to and with a run
    first = {}
    for p, b in zip(passes, base, strict=True):
        first.setdefault(p["s"], int(b))

    @released
    def fill(batches):
        import pandas as pd

        drawn: dict[int, np.ndarray] = {}

        def ends_of(run: int) -> np.ndarray:
            if run not in drawn:
                if len(drawn) > 16:
                    drawn.clear()
                drawn[run] = np.cumsum(shard_counts(runs[run].tolist(), shard_slots, (seed, run)), axis=0)
            return drawn[run]

        for pdf in batches:
            i = pdf["id"].to_numpy()
            at = np.searchsorted(ends, i, side="right")
            get = lambda k: np.array([p[k] for p in passes], np.int64)[at]
            j, n, s = i - base[at], get("n"), get("s")
            index = np.array([(p["a"] * int(x) + p["c"]) % p["n"] for p, x in ((passes[q], y) for q, y in zip(at, j, strict=True))], np.int64)
            start = j * block - np.where(j > get("short_at"), get("short"), 0)
            length = np.where(index == n - 1, block - get("short"), block)
            shard = np.empty(len(i), np.int64)
            for x in np.unique(s):
                own = np.flatnonzero(s == x)
                place = i[own] - first[x]
                run = np.searchsorted(by_source[:, x], place, side="right")
                for r in np.unique(run):
                    mine = run == r
                    within = place[mine] - (by_source[r, x] - runs[r, x])
                    shard[own[mine]] = r * RUN_SHARDS + np.searchsorted(ends_of(int(r))[:, x], within, side="right")
            yield pd.DataFrame({"shard": shard, "s": s.astype("int32"), "turn": get("turn").astype("int32"), "slot": i, "block": index, "words": np.clip(get("take") - start, 0, length).astype("int32")})

    parts = max(1, min(total // 50_000, 10_000))
    return spark.range(0, total, 1, parts).mapInPandas(fill, schema)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, weights: list[float] | None = None):
    """(placed, slots, takes, sources, goals): the stream, the mix's slots, and what each row of docs gives to it.

    takes: (doc_id, source, s, size, place, start, spans) with spans an array of (turn, lo, hi): words [lo, hi) of the
    row's own words that a pass takes; several runs of one pass are several spans. Rows with null or empty text have
    size 0 and no spans; very long texts are cut into as many blocks as they fill; null sources are a source of their own,
    the last; rows without an id are rows like others; repeated rows are separate rows, and rows that tie for a place stand
    by id; an empty table gives empty results. Other columns, whatever their names, play no part. Reruns on the same rows
    give the same mix."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    placed, sources = stream(docs, scratch, id_col, source_col, text_col, seed)
    goals = targets(sources, weights)
    passes = plan([n for _, n in sources], goals, block, seed)
    owed = [sum(p["slots"] for p in passes if p["s"] == s) for s in range(len(sources))]
    runs = shard_counts(owed, shard_slots * RUN_SHARDS, seed) if passes else np.zeros((0, len(sources)), np.int64)
    filled = slots(spark, passes, runs, block, shard_slots, seed)
    overlaps = placed.filter("size > 0").select("doc_id", "place", "s", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    given = filled.filter("words > 0").select("s", "block", "turn", "words").join(overlaps, ["s", "block"])
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    given = given.select("s", "start", "doc_id", "turn", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi")).filter("lo < hi")
    # a row's place in its source's stream is its key: rows with words have a start of their own
    spans = given.groupBy("s", "start").agg(F.sort_array(F.collect_list(F.struct("turn", "lo", "hi"))).alias("spans"))
    own = placed.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    takes = own.join(spans.withColumnRenamed("start", "key"), ["s", "key"], "left").drop("key")
    return placed, filled, takes, sources, goals


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs; see mix."""
    _, _, takes, sources, goals = mix(docs, **options)
    spark = docs.sparkSession
    facts = spark.createDataFrame([(i, n, g) for i, ((_, n), g) in enumerate(zip(sources, goals, strict=True))], "s int, source_size long, target double")
    words = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<turn:int,lo:bigint,hi:bigint>>")), F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return takes.join(F.broadcast(facts), "s").select("doc_id", "size", "source_size", "target", words.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each run of words that a pass takes from a document.

    A run of the whole document keeps its text as it is; part of one has its words joined by single spaces. n_chars, if
    there is such a column, is the new text's length. Rows without words (null, empty and blank texts) give nothing to
    the mix; columns of any name pass through, as the row travels packed in one column; the rest is as in mix."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    seed = options.get("seed", SEED)
    _, _, takes, _, _ = mix(docs, **options)
    # neighbouring runs of a pass become one
    run = "struct<turn:int,lo:bigint,hi:bigint>"
    merged = F.aggregate("spans", F.array().cast(f"array<{run}>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["turn"] == x["turn"]) & (F.try_element_at(acc, F.lit(-1))["hi"] == x["lo"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x["turn"].alias("turn"), F.try_element_at(acc, F.lit(-1))["lo"].alias("lo"), x["hi"].alias("hi"))))).otherwise(F.concat(acc, F.array(x))))
    # rows that repeat an id and a text are alike: the n-th of them here is the n-th of them there. One equal key, the
    # rest as plain conditions, so that window and join share one exchange of the texts
    runs = takes.filter("spans IS NOT NULL").select(F.col("doc_id").alias("id"), "place", "size", merged.alias("spans"))
    nth = F.row_number().over(Window.partitionBy("place").orderBy("id"))
    runs = runs.withColumn("n", nth).select(F.col("place").alias("key"), "n", "size", "spans")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("place")).withColumn("nth", nth)
    hit = rows.join(runs, F.expr("place = key AND NOT (nth <> n)"))
    hit = hit.select("row", F.col("row")[text_col].cast("string").alias("text"), "size", F.explode("spans").alias("run"))
    # words are runs of anything but space and control characters 9 to 13
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    whole = (F.col("run.lo") == 0) & (F.col("run.hi") == F.col("size"))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, F.col("run.lo").cast("int") + 1, (F.col("run.hi") - F.col("run.lo")).cast("int")), " "))
    out = hit.select("row", text.alias("text"))
    new = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

"""Document quality by a sparse rule ensemble: paths of small boosted trees over text statistics become conjunctive
rules, lasso logistic regression weighs them, and the rules that keep a weight are compiled into one Spark column."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, give_back, released, small_batches

STATS = ["words", "word_length", "longest_word", "upper", "digits", "marks", "bars", "bangs", "odd", "wide", "distinct", "distinct_lines", "line_words", "top_word", "sentence_end", "spaces"]
SAMPLE_ROWS = 20_000  # labelled rows that the model is fitted on, at most
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _MARKS, _ODD = b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*@^_~<>={}[]\\"
_END = re.compile(rb"[.!?]+[\"')]*(?:\s|$)")


def statistics(text: bytes) -> list[float]:
    """STATS of one UTF-8 text; all of an empty text are 0."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(STATS)
    count = lambda chars: len(text) - len(text.translate(None, chars))
    upper, lower = count(_UPPER), count(_LOWER)
    found: dict[bytes, int] = {}
    for w in words:
        found[w] = found.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, float(max(map(len, words))), upper / max(1, upper + lower), count(_DIGITS) / size, count(_MARKS) / size, text.count(b"|") / n, text.count(b"!") / n,
        count(_ODD) / size, count(bytes(range(128, 256))) / size, len(found) / n**0.75, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), max(found.values()) / n, sum(1 for _ in _END.finditer(text)) / n, (size - sum(map(len, words))) / size,
    ]


@released
def _measured(batches):
    for batch in batches:
        found = np.array([statistics(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(STATS)))], names=["doc_id", *STATS])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATS): the statistics of every row's whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} double" for c in STATS))


def grow(x: np.ndarray, r: np.ndarray, h: np.ndarray, depth: int, path: tuple, rules: set, cuts: list[np.ndarray], rng) -> list:
    """One regression tree on residuals r with weights h; every node's path goes to rules. Returns (rows' mask conditions, value) leaves."""
    total_r, total_h = r.sum(), h.sum() + 1.0
    best = None
    if depth and len(r) >= 40:
        for f in rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False):
            at = np.searchsorted(cuts[f], x[:, f], side="left")
            left_r = np.bincount(at, r, len(cuts[f]) + 1).cumsum()[:-1]
            left_h = np.bincount(at, h, len(cuts[f]) + 1).cumsum()[:-1]
            left_n = np.bincount(at, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            gain = left_r**2 / (left_h + 1) + (total_r - left_r) ** 2 / (total_h - left_h) - total_r**2 / total_h
            gain[(left_n < 10) | (left_n > len(r) - 10)] = -1
            if len(gain) and (best is None or gain.max() > best[0]):
                best = (gain.max(), f, cuts[f][gain.argmax()])
    if best is None or best[0] <= 1e-3:
        return [(path, total_r / total_h)]
    _, f, cut = best
    out = []
    for low in (True, False):
        own = x[:, f] <= cut if low else x[:, f] > cut
        step = (*path, (int(f), low, float(cut)))
        rules.add(step)
        out += grow(x[own], r[own], h[own], depth - 1, step, rules, cuts, rng)
    return out


def covers(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= x[:, f] <= cut if low else x[:, f] > cut
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-4, steps: int = 400, seed: int = 5) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) of the rules whose lasso weight isn't zero. One class only, or no rows: no rules."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else 4.0 if y[0] else -4.0), []
    rng, rules = np.random.default_rng(seed), set()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    prior = np.log(y.mean() / (1 - y.mean()))
    score = np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        some = rng.random(len(y)) < 0.7
        for path, value in grow(x[some], (y - p)[some], (p * (1 - p))[some], depth, (), rules, cuts, rng):
            score[covers(x, path)] += 0.2 * np.clip(value, -4, 4)
    # rules that hold for the same rows are one; the columns of one single-precision matrix, filled in place
    seen: dict[bytes, tuple] = {}
    for rule in sorted(rules):
        seen.setdefault(np.packbits(covers(x, rule)).tobytes(), rule)
    rules = list(seen.values())
    a = np.empty((len(rules), len(y)), np.float32)
    for i, bits in enumerate(seen):
        a[i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(y))
    del seen
    mean = a.mean(axis=1)
    a -= mean[:, None]
    rate, y = np.float32(4.0 / max(1e-6, largest(a) / len(y))), y.astype(np.float32)
    w = z = np.zeros(len(rules), np.float32)
    b, t = prior, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        off = 1 / (1 + np.exp(-(z @ a + np.float32(b)))) - y
        new = z - rate * ((a @ off) / np.float32(len(y)))
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * np.float32(penalty))
        b -= 2.0 * float(off.mean())
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + np.float32((t - 1) / after) * (new - w)
        w, t = new, after
    kept = [(rules[i], float(w[i])) for i in np.flatnonzero(w)]
    return float(b - float(w.astype(np.float64) @ mean)), kept


def largest(a: np.ndarray, rounds: int = 30) -> float:
    """The square of a matrix's spectral norm, a little more rather than less, by power iteration."""
    v, size = np.random.default_rng(0).standard_normal(len(a)).astype(np.float32), 0.0
    for _ in range(rounds):
        v = a @ (v @ a)
        size = float(np.linalg.norm(v))
        if not size:
            return 0.0
        v /= np.float32(size)
    return 1.05 * size


def compiled(intercept: float, rules: list[tuple[tuple, float]], names: list[str] = STATS) -> Column:
    """The probability that the rules give, as a Spark column over the statistics."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        held = F.lit(True)
        for f, low, cut in rule:
            held = held & (F.col(names[f]) <= cut if low else F.col(names[f]) > cut)
        total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS):
    """Fits on labelled rows that aren't held out, the first sample_rows of them in hash order; labels(doc_id, label)."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("__y")).distinct()
    known = known.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(1)) != 1)
    rows = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "__y", *STATS[:3]).select(*STATS, "__y").limit(sample_rows).toArrow()
    data = np.stack([c.to_numpy() for c in rows.columns], axis=1).astype(np.float64) if len(rows) else np.zeros((0, len(STATS) + 1))
    out = fit(data[:, :-1], data[:, -1])
    del rows, data
    give_back()
    return out


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    held_out marks rows whose crc32 of the id as text has remainder 1 by 3; their labels are never learnt from. Null and
    empty texts have statistics of 0 and are scored by the same rules; very long texts are measured whole; a null id is
    scored and not held out; repeated rows and labels count as they stand, null labels not at all; equal texts have equal
    scores; without labels every score is 0.5. Other columns, whatever their names, play no part; an empty table gives an
    empty result."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(measured(docs, id_col, text_col), "stats")
    intercept, rules = train(stats, labels, sample_rows=sample_rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = stats.select("doc_id", held.alias("held_out"), compiled(intercept, rules).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of docs whose score is at least ``least``, in docs' columns: one pass over the texts to fit, one to filter.

    Null and empty texts have statistics of 0 and stay or go by the same rules, as do very long ones, which are measured
    whole; rows that tie or repeat, and rows without an id, are each judged by their own text. Columns of any name pass
    through, as the row travels packed in one column. An empty table stays empty; without labels every row stays."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.select(F.col("doc_id").alias(id_col)).distinct()
    training = scratch.keep(measured(docs.select(id_col, text_col).join(known, id_col, "left_semi"), id_col, text_col), "training")
    intercept, rules = train(training, labels)
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.arrow_udf(_vectors, "array<double>")(F.col("row")[text_col].cast("string")).alias("stats"))
    rows = rows.select("row", *(F.col("stats")[i].alias(c) for i, c in enumerate(STATS)))
    return rows.filter(compiled(intercept, rules) >= least).select("row.*")


def _vectors(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(x or b"") for x in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

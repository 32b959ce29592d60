"""Toxicity by a linear-chain conditional random field.

The labels are of documents, so they label tokens in part: every token of a document marked clean is clean; in one marked
toxic, the words and stems that are far commoner there than in clean documents are toxic, and its other tokens are left
open. The field has two states (clean, toxic). A token's potential is a sum of weights: of its own unit (a word or stem
that leans to toxic documents, or any other), of the units before and after it, and of its shape; transitions and the
start have weights too. A sequence is a sentence. All weights are fitted by the gradient of the likelihood of what is
labelled: expected counts, by forward-backward, with the labels given less those without.

Forward-backward runs over all sentences of a text. The tokens' marginals are aggregated to the document's score, whose
calibration is fitted on documents that the field was not fitted on; offending offsets are those of tokens of 1/2 or more."""

from __future__ import annotations

import re
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ASCII_LOWER, mix64, shingles, small_batches, word_hashes

SAMPLE_ROWS = 8_000  # labelled documents that the model is fitted on, at most
STEMS = (3, 4, 5, 6)  # bytes of a word's stem
LONGEST = 64  # a sentence of more tokens is cut into sequences of so many
SURE, LEANING = 100.0, 8.0  # odds from which a unit labels tokens, and from which it has weights of its own
SHAPES = 3  # in upper case, without a letter, or any other
EMITTED, MOVED = 1e-5, 2e-2  # penalties on squared weights; open tokens would else be drawn into one long toxic stretch
TOKENS = 1 << 20  # tokens that are scored at a time; a longer text is scored alone
_EDGE = b"\"'`()[]{}<>*_,;:-.!?#$%&@|"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search


def units(word: bytes) -> list[bytes]:
    """What a word may be learnt as, the shortest stem first: its first 3 to 6 bytes (marked by *), then itself."""
    return [word[:k] + b"*" for k in STEMS if len(word) >= k] + [word]


def lexicon(counts: dict[bytes, list[int]], toxic_docs: int, clean_docs: int, odds: float = SURE) -> dict[bytes, float]:
    """unit -> log-odds, from unit -> [toxic documents, clean documents]: units at least ``odds`` times commoner in toxic
    documents whose surplus is beyond chance among so many units; longer ones under a learnt stem are left out."""
    out: dict[bytes, float] = {}
    base = toxic_docs / max(1, toxic_docs + clean_docs)
    chance = log(max(2, len(counts))) + 2
    for unit in sorted(counts, key=lambda u: (len(u.rstrip(b"*")), u)):
        t, c = counts[unit]
        share = t / (t + c)
        gain = log((t + 0.5) / (toxic_docs + 1)) - log((c + 0.5) / (clean_docs + 1))
        if len(unit) < 3 or t < 3 or share <= base or gain < log(odds):
            continue
        far = t * log(share / base) + (c * log((1 - share) / (1 - base)) if c else 0.0)
        if far >= chance and not any(unit[:k] + b"*" in out for k in STEMS if k < len(unit.rstrip(b"*"))):
            out[unit] = gain
    return out


def shape(plain: bytes) -> int:
    """The shape of a word without marks at its ends, from 0 to SHAPES - 1."""
    if not _LETTER(plain):
        return 2
    return 1 if len(plain) > 1 and plain.isupper() else 0


class Codes(dict):
    """word as it stands in a text -> 16 * (unit + 1) + 2 * shape + (does it end a sentence?), unit -1 for no learnt one;
    emptied when it has grown past ``bound`` words."""

    bound = 400_000

    def __init__(self, learnt: dict[bytes, int]):
        self.learnt = learnt

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        plain = word.strip(_EDGE)
        low = plain.translate(ASCII_LOWER)
        unit = next((self.learnt[u] for u in reversed(units(low)) if u in self.learnt), -1) if low else -1
        code = self[word] = 16 * (unit + 1) + 2 * shape(plain) + (word[-1:] in (b".", b"!", b"?"))
        return code


def sequences(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the sequences of texts whose codes stand one after another, each up to one of ends: sentences, cut every LONGEST tokens."""
    last = np.union1d(np.flatnonzero(codes & 1) + 1, ends)
    last = last[last > 0]
    start = np.concatenate([[0], last[:-1]]).astype(np.int64)
    parts = -(-(last - start) // LONGEST)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(start, parts) + at * LONGEST
    return first, np.minimum(np.repeat(last, parts) - first, LONGEST)


class Field:
    """Two-state chain over units 0 (none learnt) to n: weights for the toxic state over the clean one, and transitions.

    w holds, one after another: own[n + 1], before[n + 1], after[n + 1], shape[SHAPES], start, move[2, 2]."""

    def __init__(self, learnt: dict[bytes, int], w: np.ndarray | None = None):
        self.learnt, self.n = learnt, len(learnt) + 1
        self.w = np.zeros(3 * self.n + SHAPES + 5) if w is None else w
        self.codes = Codes(learnt)

    def __reduce__(self):  # the cache of words stays behind
        return Field, (self.learnt, self.w)

    def parts(self) -> tuple[np.ndarray, ...]:
        n = self.n
        return (*(self.w[i * n : (i + 1) * n] for i in range(3)), self.w[3 * n : 3 * n + SHAPES], self.w[3 * n + SHAPES], self.w[-4:].reshape(2, 2))

    def features(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every token its unit, the unit before, the unit after (0 at a sequence's ends) and its shape."""
        unit = codes >> 4
        before, after = np.zeros_like(unit), np.zeros_like(unit)
        before[1:], after[:-1] = unit[:-1], unit[1:]
        before[start], after[start + length - 1] = 0, 0
        return unit, before, after, (codes >> 1) & 7

    def potentials(self, found: tuple[np.ndarray, ...]) -> np.ndarray:
        own, before, after, shapes, _, _ = self.parts()
        return own[found[0]] + before[found[1]] + after[found[2]] + shapes[found[3]]

    def chain(self, e: np.ndarray, start: np.ndarray, length: np.ndarray, want: bool = False):
        """P(toxic) of every token by forward-backward; with want also P(state a, then b) summed by sequence, [sequence, a, b], and log Z.

        e: potentials, which may be infinite (a labelled token). All sequences take a step together, the longest first, in
        ratios of the toxic state to the clean one."""
        order = np.argsort(-length, kind="stable")
        s, size = start[order], length[order]
        m, first = np.exp(self.parts()[5]), np.exp(self.parts()[4])
        x = np.exp(np.clip(e, -60, 60))
        active = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), side="right")
        f, b = np.empty(len(e)), np.ones(len(e))
        log_z = np.zeros(len(s))
        f[s] = first * x[s]
        for t in range(1, len(active)):
            i = s[: active[t]] + t
            r = f[i - 1]
            low = m[0, 0] + r * m[1, 0]
            f[i] = np.clip(x[i] * (m[0, 1] + r * m[1, 1]) / low, 1e-100, 1e100)
            if want:
                log_z[: active[t]] += np.log(low)
        for t in range(len(active) - 1, 0, -1):
            i = s[: active[t]] + t
            r = x[i] * b[i]
            b[i - 1] = np.clip((m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r), 1e-100, 1e100)
        p = f * b
        p /= 1 + p
        if not want:
            return p
        moves = np.zeros((len(s), 2, 2))
        for t in range(1, len(active)):
            i = s[: active[t]] + t
            both = np.stack([np.full(len(i), m[0, 0]), m[0, 1] * x[i] * b[i], f[i - 1] * m[1, 0], f[i - 1] * m[1, 1] * x[i] * b[i]], axis=1)
            moves[: active[t]] += (both / both.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
        log_z += np.log1p(f[s + size - 1])
        back = np.argsort(order)
        return p, moves[back], log_z[back]

    def likelihood(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """(log-likelihood of the labels, its gradient) of weighted sequences; label: 0 clean, 1 toxic, -1 open, for each token."""
        found = self.features(codes, start, length)
        e = self.potentials(found)
        held = np.where(label < 0, e, np.where(label > 0, 60.0, -60.0))
        p, moves, z = self.chain(e, start, length, want=True)
        q, given, zq = self.chain(held, start, length, want=True)
        zq += np.add.reduceat(np.where(label > 0, e - held, 0.0), start) if len(start) else 0  # what clamping added to a toxic token's potential
        each = np.repeat(weight, length)
        off = (q - p) * each
        grad = np.concatenate([np.bincount(found[k], off, self.n) for k in range(3)] + [np.bincount(found[3], off, SHAPES), [(off[start]).sum()], ((given - moves) * weight[:, None, None]).sum(axis=0).ravel()])
        total, penalty = weight.sum(), np.full(len(self.w), EMITTED)
        penalty[-5:] = MOVED
        return float((weight * (zq - z)).sum() / total - (penalty * self.w**2).sum() / 2), grad / total - penalty * self.w

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(P(toxic) of the tokens of all texts one after another, where each text's end)."""
        found = [text.split() for text in texts]
        ends = np.cumsum([len(w) for w in found], dtype=np.int64)
        codes = np.fromiter((c for w in found for c in map(self.codes.__getitem__, w)), np.int64, int(ends[-1]) if len(ends) else 0)
        if not len(codes):
            return np.zeros(0), ends
        start, length = sequences(codes, ends)
        return self.chain(self.potentials(self.features(codes, start, length)), start, length), ends


def fit_field(texts: list[bytes], toxic: list[int], sure: dict[bytes, float], leaning: dict[bytes, float], steps: int = 80, rate: float = 0.3) -> Field:
    """Fits the field on the labels that documents give their tokens, by Adam steps up the exact gradient; equal sequences are one."""
    field = Field({u: i for i, u in enumerate(sorted({*sure, *leaning}))})
    own, *_, move = field.parts()
    own[0], move[:] = -3.0, [[0.5, -0.5], [-0.5, 0.5]]
    known = np.zeros(field.n, bool)
    known[[field.learnt[u] + 1 for u in sure]] = True
    counts: dict[tuple[bytes, int], int] = {}
    for text, y in zip(texts, toxic, strict=True):
        codes = np.fromiter(map(field.codes.__getitem__, text.split()), np.int64)
        if len(codes):
            for a, n in zip(*sequences(codes, np.array([len(codes)])), strict=True):
                key = codes[a : a + n].tobytes(), y
                counts[key] = counts.get(key, 0) + 1
    if not counts or not field.learnt:
        return field
    parts = [np.frombuffer(c, np.int64) for c, _ in counts]
    codes, length = np.concatenate(parts), np.array([len(c) for c in parts])
    start = np.cumsum(length) - length
    marked = np.repeat(np.array([y for _, y in counts]), length)
    label = np.where(marked == 0, 0, np.where(known[codes >> 4], 1, -1))
    weight = np.array(list(counts.values()), float)
    first, second = np.zeros_like(field.w), np.zeros_like(field.w)
    for t in range(1, steps + 1):
        _, g = field.likelihood(codes, start, length, label, weight)
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        field.w += rate * (1 - t / (steps + 1)) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.98**t)) + 1e-6)
    return field


def evidence(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[text, 3] features of token marginals: the strongest token's log-odds, log of the expected toxic tokens, and their share of words."""
    out = np.tile([-8.0, -8.0, 0.0], (len(ends), 1))
    start = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(ends > start)
    if len(some):
        top = np.clip(np.maximum.reduceat(p, start[some]), 1e-4, 1 - 1e-4)
        total = np.add.reduceat(p, start[some])
        out[some] = np.stack([np.log(top / (1 - top)), np.log(np.maximum(total, 3e-4)), total / np.sqrt(ends[some] - start[some])], axis=1)
    return out


def distinct_texts(texts: list[bytes]) -> list[int]:
    """Places of one text of each group of near copies: those that share fewer than 2 of 4 shingle minima with texts before.

    Copies of one toxic document would else make any of its words look telling."""
    seen: list[set[int]] = [set() for _ in range(4)]
    out = []
    for i, text in enumerate(texts):
        found = shingles(word_hashes(text), 5)
        least = [int(mix64(found ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))).min()) if len(found) else 0 for j in range(4)]
        if sum(x in s for x, s in zip(least, seen, strict=True)) < 2:
            out.append(i)
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic weights (with an intercept last) by damped Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
    return w


def unit_counts(texts: list[bytes], toxic: list[int], part: list[int]) -> list[dict[bytes, list[int]]]:
    """unit -> [toxic documents, clean documents] of each half (part: 0 or 1 by text), for units in three toxic documents or more."""
    def of(text: bytes) -> set[bytes]:
        return {u for w in {w.strip(_EDGE) for w in set(text.translate(ASCII_LOWER).split())} for u in units(w)}

    seen: dict[bytes, int] = {}
    for text, y in zip(texts, toxic, strict=True):
        if y:
            for u in of(text):
                seen[u] = seen.get(u, 0) + 1
    kept = {u for u, n in seen.items() if n >= 3}
    out: list[dict[bytes, list[int]]] = [{}, {}]
    for text, y, h in zip(texts, toxic, part, strict=True):
        for u in of(text) & kept:
            out[h].setdefault(u, [0, 0])[0 if y else 1] += 1
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(field, weights) from docs(doc_id, text) and labels(doc_id, toxic); rows whose crc32 of the id has remainder 0 by 5 are never read."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "y").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True))
    rows = [rows[i] for i in distinct_texts([r[1] for r in rows])]
    texts, y = [r[1] for r in rows], [r[2] for r in rows]
    if not y or min(y) == max(y):
        return Field({}), np.array([0.0, 0.0, 0.0, 0.0 if not y else 4.0 if y[0] else -4.0])
    # calibration on documents that the field has seen would trust words too much: each half is weighed by a field of the other
    part = [i % 2 for i in range(len(y))]
    counts = unit_counts(texts, y, part)
    whole = {u: [sum(c.get(u, [0, 0])[k] for c in counts) for k in (0, 1)] for u in {*counts[0], *counts[1]}}

    def fitted(found: dict[bytes, list[int]], own: list[int]) -> Field:
        marks = [y[i] for i in own]
        sure, leaning = (lexicon(found, sum(marks), len(marks) - sum(marks), odds) for odds in (SURE, LEANING))
        return fit_field([texts[i] for i in own], marks, sure, leaning)

    x = np.zeros((len(y), 3))
    for h in (0, 1):
        other, own = ([i for i in range(len(y)) if part[i] == k] for k in (1 - h, h))
        x[own] = evidence(*fitted(counts[1 - h], other).of_texts([texts[i] for i in own]))
    return fitted(whole, list(range(len(y)))), calibrate(x, np.array(y, float))


def _spans(text: bytes, bad: set[int]) -> list[dict[str, int]]:
    """Character offsets of the words at the places of bad."""
    out, chars, at = [], 0, 0
    for i, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
        if i in bad:
            chars += len(text[at : m.start()].decode("utf-8", "replace"))
            at = m.start()
            out.append({"start": chars, "end": chars + len(m[0].decode("utf-8", "replace"))})
    return out


def _scored(batches, model):
    field, weights = model
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        size = np.cumsum([len(x) // 2 for x in texts])  # no fewer than the words
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOKENS, side="right")))
            p, ends = field.of_texts(texts[lo:hi])
            score = 1 / (1 + np.exp(-np.clip(np.concatenate([evidence(p, ends), np.ones((hi - lo, 1))], axis=1) @ weights, -30, 30)))
            spans: list[list] = [[] for _ in range(hi - lo)]
            bad = np.flatnonzero(p >= 0.5)
            of = np.searchsorted(ends, bad, side="right")
            for i in np.unique(of):
                first = int(ends[i - 1]) if i else 0
                spans[i] = _spans(texts[lo + i], {int(k) - first for k in bad[of == i]})
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])
            lo = hi


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of docs; spans are the character offsets of toxic tokens.

    Labels of rows whose crc32 of the id as text has remainder 0 by 5 (held_out) are never learnt from. Null and empty
    texts are scored as texts without a toxic word; very long ones are scored, and learnt from, whole; null ids are scored
    and not held out; repeated rows keep a row each, and equal texts have equal scores; null labels are skipped; without
    labels every score is 0.5. Other columns, whatever their names, play no part; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    model = train(rows, labels, sample_rows)
    out = rows.mapInArrow(lambda it: _scored(it, model), "doc_id long, score double, spans array<struct<start:int,end:int>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

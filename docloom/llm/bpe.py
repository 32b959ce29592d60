"""Token counts by heap-and-linked-list byte-pair merging, without ever naming a token.

A pretoken's bytes form a linked list of symbols; a heap yields the adjacent pair of the lowest rank, the leftmost
first; the count is the number of symbols less the number of merges."""

from __future__ import annotations

import json
from copy import copy
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches

CACHED = 1_000_000

# fixed value: the pretoken pattern of this tokenizer family
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Merger:
    """Counts tokens of texts by the merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretokens = regex.compile(PATTERN).findall
        symbols = {letter: i for i, letter in enumerate(byte_letters())}
        self.ranks: dict[int, int] = {}  # left symbol and right symbol -> rank and merged symbol
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            new = symbols.setdefault(left + right, len(symbols))
            self.ranks[symbols[left] << 20 | symbols[right]] = rank << 20 | new
        self.known: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Tokens that the bytes of one pretoken merge into."""
        ranks = self.ranks.get
        symbols = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                heap.append((rank >> 20) << 32 | i)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = ranks(symbols[i] << 20 | symbols[j])
            if found is None or found >> 20 != top >> 32:  # the pair has changed since it was pushed
                continue
            symbols[i], symbols[j] = found & 0xFFFFF, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                rank = ranks(symbols[i] << 20 | symbols[k])
                if rank is not None:
                    heappush(heap, (rank >> 20) << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks(symbols[h] << 20 | symbols[i])
                if rank is not None:
                    heappush(heap, (rank >> 20) << 32 | h)
        return left

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            total = len(parts) - 1
        known = self.known
        for part in parts:
            words = self.pretokens(part)
            try:
                total += sum(map(known.__getitem__, words))
            except KeyError:
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= CACHED:
                            known.clear()
                        n = known[w] = self.merged(w.encode("utf-8", "replace"))
                    total += n
        return total


@cache
def _loaded(path: str) -> Merger:
    return Merger(path)


def merger(path: str) -> Merger:
    """A merger with an empty cache; the merges themselves are read once in a process."""
    out = copy(_loaded(path))
    out.known = {}
    return out


def _counted(batches, path: str):
    counter = merger(path)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(counter.count, texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, in one pass without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; very long texts are counted whole; null ids stay null; repeated rows are
    counted as often as they stand, equal texts alike; other columns, whatever their names, play no part; an empty table
    gives an empty result. Special strings inside a text count as one token each, as the file has them."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(lambda it: _counted(it, path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

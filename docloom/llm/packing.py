"""Packing by power-of-two decomposition: a document's tokens are split into pieces whose lengths are powers of two, and
pieces of equal length share a bucket. A piece is a sequence of its own, so that no sequence crosses documents and none
needs padding."""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import byte_letters
from docloom.llm.common import released, small_batches

LONGEST, END_ID = 2048, 1
CACHED = 1_000_000  # entries that each cache of a task holds: what bounds its memory, whatever the corpus
SLICE_BYTES = 8 << 20  # text that is worked on at a time; a longer document is a slice of its own

# fixed value: the pretoken pattern of this tokenizer family, as it stands for lower-case ASCII and Latin letters
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+"""
# words that normalising leaves alone but for lower case: printable ASCII, and the letters of two Latin blocks
_PLAIN = r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"


class Kept(dict):
    """A cache that keeps the first CACHED entries and makes others anew."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < CACHED:
            self[key] = value
        return value


class WordIds:
    """Ids of words by a tokenizer whose tokens never cross white space, as little-endian 32-bit numbers.

    A plain word is cut into pretokens here and each goes to the tokenizer's model alone; words with other characters,
    or with what may be a special token, go through the whole tokenizer. Both caches start empty with each task, so that
    no task's cost leans on what its worker did before."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.plain, self.cut = re.compile(_PLAIN).fullmatch, re.compile(_PIECES).findall
        self.specials = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.pieces, self.words = Kept(self.of_piece), Kept(self.of_word)

    def of_piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def of_word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain(text):
            low = text.lower()
            if "<" not in low or not any(s in low for s in self.specials):
                return b"".join(map(self.pieces.__getitem__, self.cut(low)))
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after another, each closed by END_ID, and where each text's end.

        Different words of the slice are looked up once; the ids are then gathered by place."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        known = [self.words[w] for w in words.dictionary.cast(pa.binary()).to_pylist()]
        known.append(END_ID.to_bytes(4, "little"))
        pool = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        index = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(known) - 1)
        n = size[index]
        until = np.cumsum(n)
        ids = pool[np.repeat(at[index] - (until - n), n) + np.arange(until[-1])]
        return ids, until[ends + np.arange(len(ends))]


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of documents of so many ids: whole pieces of the longest length, then the binary parts of the rest, longest first."""
    whole = sizes // longest
    of = np.repeat(np.arange(len(sizes)), whole)
    parts = [(of, (np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)) * longest, np.full(len(of), longest))]
    for bit in range(longest.bit_length() - 2, -1, -1):
        of = np.flatnonzero(sizes >> bit & 1)
        parts.append((of, sizes[of] >> (bit + 1) << (bit + 1), np.full(len(of), 1 << bit)))
    of, start, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, of))
    return of[order], start[order], length[order]


def _slices(texts: pa.Array):
    """(first, last + 1) of stretches of texts that hold SLICE_BYTES together, or one text."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
        yield lo, hi
        lo = hi


@released
def _packed(batches, path: str, with_ids: bool):
    words = WordIds(path)
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        for lo, hi in _slices(texts):
            ids, ends = words.of_texts(texts.slice(lo, hi - lo))
            first = np.concatenate([[0], ends[:-1]])
            of, start, length = pieces(ends - first)
            at, view = first[of] + start, memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            out = [batch.column(0).take(pa.array(lo + of)), *(pa.array(x, pa.int64()) for x in (start, length, crc, (ends - first)[of]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:  # pieces stand in the order of the ids, without gaps
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    A document's ids end with id 1; null and empty texts are that id alone; a very long text is encoded whole, in a slice of
    its own. Repeated rows are packed as often as they stand, and equal texts alike; a null id stays null; other columns,
    whatever their names, play no part; an empty table gives no pieces. bucket is log2(length), to write or batch pieces of
    one length together; sequence_id numbers the pieces."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    out = rows.mapInArrow(lambda it: _packed(it, path, with_ids), schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))

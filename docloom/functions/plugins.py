"""Models that can be plugged in: embedders and re-rankers by name; the defaults need no network."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDERS, RERANKERS = {}, {}


def hashed(texts: pd.Series, d: int = 64) -> pd.Series:
    """Feature hashing of words into d signed counts, scaled to length 1 (a text without words is all zeros)."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(d)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % d] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return texts.map(one)


EMBEDDERS["hashed"] = hashed


def _local(model: str):
    """Sentence vectors of a model on this machine; its library is loaded in the worker that needs it, once."""
    held = {}

    def run(texts: pd.Series) -> pd.Series:
        if not held:
            from sentence_transformers import SentenceTransformer

            held["model"] = SentenceTransformer(model)
        found = held["model"].encode([t or "" for t in texts])
        return pd.Series([list(map(float, v)) for v in found])

    return run


def _posted(url: str, body, vectors, key: str | None = None, batch: int = 64, send=None):
    """Vectors from a service: body(texts) is posted as JSON, vectors(answer) are those of its texts; any status but 200 is an error."""

    def post(data: dict) -> dict:
        import json
        import urllib.request

        request = urllib.request.Request(url, json.dumps(data).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310
            if answer.status != 200:
                raise RuntimeError(f"the embedding service answered {answer.status}")
            return json.load(answer)

    def run(texts: pd.Series) -> pd.Series:
        texts, out = [t or "" for t in texts], []
        for at in range(0, len(texts), batch):
            out += [list(map(float, v)) for v in vectors((send or post)(body(texts[at : at + batch])))]
        return pd.Series(out)

    return run


def inference_service(url: str, key: str | None = None, **more):
    """A service that takes {"inputs": texts} and answers vectors, or a matrix for each text, whose first row then counts."""
    flat = lambda answer: [v[0] if v and isinstance(v[0], list) else v for v in answer]
    return _posted(url, lambda texts: {"inputs": texts}, flat, key, **more)


def embeddings_service(url: str, model: str, key: str | None = None, **more):
    """A service that takes {"model", "input"} and answers {"data": [{"index", "embedding"}]}."""
    return _posted(url, lambda texts: {"model": model, "input": texts}, lambda a: [d["embedding"] for d in sorted(a["data"], key=lambda d: d["index"])], key, **more)


#: what a name with settings makes: register_embedder("mine", "local", "a-model")
EMBEDDER_KINDS = {"local": _local, "inference": inference_service, "service": embeddings_service}


def register_embedder(name: str, kind: str, *settings, **more) -> None:
    """Makes an embedder of a kind known by a name; kinds: local (a model), inference (url, key), service (url, model, key)."""
    if kind not in EMBEDDER_KINDS:
        raise ValueError(f"no embedder of kind {kind!r}; there are {', '.join(sorted(EMBEDDER_KINDS))}")
    EMBEDDERS[name] = EMBEDDER_KINDS[kind](*settings, **more)


def embed(c: Column, backend: str = "hashed", most_chars: int = 2000) -> Column:
    f = EMBEDDERS[backend]

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return f(texts)

    return run(F.substring(c, 1, most_chars))


def overlap(query: str, c: Column) -> Column:
    """Share of the query's words that a text holds: the default re-ranking score."""
    words = sorted(set(query.lower().split()))
    return sum((F.contains(F.lower(c), F.lit(w)).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))


RERANKERS["overlap"] = overlap


def cross_encoder(model: str, score=None):
    """A re-ranker that scores pairs of query and text by a cross-encoder; its library is loaded in the worker that needs it, once."""
    held = {}

    def ranked(query: str, c: Column) -> Column:
        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            if not held:
                if score is None:
                    from sentence_transformers import CrossEncoder

                    held["score"] = CrossEncoder(model).predict
                else:
                    held["score"] = score
            return pd.Series(held["score"]([(query, t or "") for t in texts]), dtype="float64")

        return run(c)

    return ranked

READERS, SUMMARIZERS = {"none": None}, {}


def image_reader(library: str):
    """Text in images by a library of that name, if it can be imported where it runs: pytesseract or easyocr."""
    held = {}

    def one(data: bytes | None) -> str | None:
        import io

        if not data:
            return None
        if library == "pytesseract":
            import pytesseract
            from PIL import Image

            return pytesseract.image_to_string(Image.open(io.BytesIO(data))).strip() or None
        if not held:
            import easyocr

            held["reader"] = easyocr.Reader(["en"], gpu=False)
        return "\n".join(held["reader"].readtext(data, detail=0)).strip() or None

    def run(data: pd.Series) -> pd.Series:
        return data.map(one)

    return run


READERS |= {name: image_reader(name) for name in ("pytesseract", "easyocr")}


def available_reader(preferred: tuple[str, ...] = ("easyocr", "pytesseract")) -> str:
    """The first reader whose library is installed here, or none."""
    from importlib.util import find_spec

    return next((name for name in preferred if find_spec(name)), "none")


def read_text(c: Column | str, backend: str = "none") -> Column:
    """Text in an image's bytes, by the reader of that name, a function of a Series; no reader, no text."""
    f = READERS[backend]
    return F.pandas_udf(f, "string")(c) if f else F.lit(None).cast("string")


def passthrough(query: str, c: Column) -> None:
    """A re-ranker that leaves scores and order alone."""


RERANKERS["none"] = passthrough


def first_paragraphs(topic: str, texts: list[tuple[str, str]]) -> str:
    """The default summary: each document's title and first paragraph that isn't a heading."""
    out = [f"# {topic}"]
    for title, text in texts:
        paragraphs = (p.strip() for p in text.split("\n\n"))
        out.append(f"## {title}\n{next((p for p in paragraphs if p and not p.startswith('#')), '')}")
    return "\n\n".join(out)


SUMMARIZERS["first_paragraphs"] = first_paragraphs


def query_vector(query: str, backend: str = "hashed") -> list[float]:
    return list(map(float, EMBEDDERS[backend](pd.Series([query])).iloc[0]))

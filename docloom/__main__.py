"""python -m docloom build DOCS INDEX [--embedder NAME] [--ocr NAME] [--no-images] | python -m docloom tools | python -m docloom TOOL INDEX name=value..."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from docloom.functions.plugins import available_reader
from docloom.plans.library import SKILLS, TOOLS, Library, call, parsed, schema
from docloom.sources import index
from docloom.sources.corpus import read_files, read_tree, unreadable
from docloom.sources.images import read_images


def options(args: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """(plain arguments, --name value pairs; --no-name is name: False)."""
    plain, named, rest = [], {}, iter(args)
    for a in rest:
        if a.startswith("--no-"):
            named[a[5:]] = False
        elif a.startswith("--"):
            named[a[2:]] = next(rest, "")
        else:
            plain.append(a)
    return plain, named


def main(args: list[str]) -> str:
    if args == ["tools"]:
        return "\n".join(json.dumps(schema(name)) for name in (*TOOLS, *SKILLS))
    plain, named = options(args)
    if len(plain) < 2:
        return __doc__
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if plain[0] == "build":
        files = read_files(spark, plain[1])
        ocr = named.get("ocr", "none")
        pictures = read_images(spark, plain[1], available_reader() if ocr == "auto" else ocr) if named.get("images", True) else None
        out = [f"{r.relation}: {r.n}" for r in index.build(read_tree(spark, plain[1]), plain[2], named.get("embedder", "hashed"), files, pictures, lambda percent, name: print(f"{percent} % {name}", file=sys.stderr)).collect()]
        return "\n".join(out + [f"left out: {r.path} ({r.error})" for r in unreadable(spark, plain[1]).limit(100).collect()])
    given = dict(a.split("=", 1) for a in plain[2:])
    try:
        given = parsed(plain[0], given) if plain[0] in (*TOOLS, *SKILLS) else given
    except ValueError as e:
        return f"Error in {plain[0]}: {e}"
    return call(Library.open(spark, plain[1]), plain[0], **given)


if __name__ == "__main__":
    print(main(sys.argv[1:]))

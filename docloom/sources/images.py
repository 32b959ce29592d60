"""Image files: format and size from their headers, texts by a pluggable reader, and references joined to them."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import plugins
from docloom.functions import text as T

PATTERN = "*.{png,PNG,jpg,JPG,jpeg,JPEG,gif,GIF,bmp,BMP}"


def header(data: bytes | None) -> tuple[int | None, int | None, str | None]:
    """(width, height, format) of PNG, GIF, BMP and JPEG bytes; nulls for anything else and for cut headers."""
    data = data or b""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return *struct.unpack(">II", data[16:24]), "PNG"
        if data.startswith((b"GIF87a", b"GIF89a")):
            return *struct.unpack("<HH", data[6:10]), "GIF"
        if data.startswith(b"BM"):
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height), "BMP"
        if data.startswith(b"\xff\xd8"):
            at = 2
            while True:  # segments up to the frame header, which is any of C0 to CF but C4, C8 and CC
                mark, size = struct.unpack(">xBH", data[at : at + 4])
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height, "JPEG"
                at += 2 + size
    except struct.error:
        pass
    return None, None, None


def _headers(data: pd.Series) -> pd.DataFrame:
    """header of each value."""
    found = pd.DataFrame([header(x) for x in data], columns=["width", "height", "format"])
    return found.astype({"width": "Int32", "height": "Int32", "format": object})


def read_images(spark: SparkSession, folder: str, ocr: str = "none") -> DataFrame:
    """(path, size_bytes, width, height, format, ocr_text) of the image files below a folder; files of no known format are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).load(folder)
    x = files.select(T.below("path", folder).alias("path"), F.col("length").alias("size_bytes"), F.pandas_udf(_headers, "struct<width:int,height:int,format:string>")("content").alias("h"), plugins.read_text("content", ocr).alias("ocr_text"))
    return x.filter("h.format IS NOT NULL").select("path", "size_bytes", "h.width", "h.height", "h.format", "ocr_text")


def enriched(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Image references (path, pos, img_path, alt) with what is known of their files: external ones as they are, local ones joined; missing files drop the reference."""
    x = refs.withColumn("type", F.when(F.col("img_path").rlike("^https?://"), "external").otherwise("local"))
    x = x.withColumn("full_path", F.when(F.col("type") == "local", T.resolved(F.col("path"), F.col("img_path"))))
    x = x.join(files.withColumnRenamed("path", "full_path"), "full_path", "left").filter("type = 'external' OR format IS NOT NULL")
    return x.select("path", "pos", "img_path", "full_path", "alt", "type", "width", "height", "format", "ocr_text", "size_bytes", (F.coalesce("ocr_text", F.lit("")) != "").alias("has_text"))


def ocr_section(images: DataFrame) -> DataFrame:
    """(path, image_ocr_text): a line "alt: text" for each image with text, in their order."""
    x = images.filter("has_text").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(": ", "alt", "ocr_text").alias("l")))).alias("ls"))
    return x.select("path", F.array_join(F.transform("ls", lambda s: s["l"]), "\n").alias("image_ocr_text"))

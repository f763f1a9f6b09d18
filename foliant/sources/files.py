"""Files in and out: whole files with their type, DOCX pages, upload checks, CSV export."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import expressions as X

#: What may be uploaded, as extension, declared type, and type by the first bytes.
ACCEPTED = {
    "pdf": ("application/pdf", "application/pdf"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip"),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/zip"),
    "doc": ("application/msword", "application/msword"),
}
MOST_BYTES = 100 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, sha256 and the type by the first bytes of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), X.sniff_type(F.col("content")).alias("detected"))


def check_uploads(files: DataFrame) -> DataFrame:
    """Adds reason, null for files (name, declared, detected, length) whose extension, declared and detected type agree and whose size is allowed."""
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    declared = F.create_map(*[F.lit(x) for e, (d, _) in ACCEPTED.items() for x in (e, d)])
    detected = F.create_map(*[F.lit(x) for e, (_, d) in ACCEPTED.items() for x in (e, d)])
    reason = (
        F.when(declared[extension].isNull(), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "size")
        .when(~F.col("declared").eqNullSafe(declared[extension]), "declared type").when(~F.col("detected").eqNullSafe(detected[extension]), "content")
    )
    return files.withColumn("reason", reason)


def docx_text(content: bytes) -> str | None:
    """Paragraphs and tables in body order; a table row is its cells with bars between. None for what is no DOCX."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    out = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            out.append(text(child))
        elif child.tag == f"{_W}tbl":
            out += [" | ".join(text(c) for c in row.iter(f"{_W}tc")) for row in child.iter(f"{_W}tr")]
    return "\n".join(line for line in out if line.strip())


def docx_pages(files: DataFrame) -> DataFrame:
    """path, page_number 1 and text of the DOCX files among files (path, content); others are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame({"path": f["path"], "page_number": 1, "text": [docx_text(c) for c in f["content"]]})
            yield out[out["text"].notna()]

    return files.select("path", "content").mapInPandas(read, "path string, page_number int, text string")


def parsed_pages(uploads: DataFrame) -> DataFrame:
    """path, page_number, text and reason of files (path, content, kind) by the parser of their kind: docx, or text in UTF-8.

    Files of other kinds, and those that their parser cannot read, give one row with the reason and no text.
    """
    docx = docx_pages(uploads.filter("kind = 'docx'"))
    text = uploads.filter("kind = 'text'").select("path", F.lit(1).alias("page_number"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).filter("text IS NOT NULL")
    read = docx.unionByName(text).withColumn("_read", F.lit(True))
    reason = F.when(F.col("_read"), F.lit(None).cast("string")).when(F.col("kind").isin("docx", "text"), "unreadable").otherwise("unsupported")
    return uploads.select("path", "kind").join(read, "path", "left").select("path", "page_number", "text", reason.alias("reason"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words (page, block, par, line, word_no, text, conf, left, top, width, height): text, box and mean confidence."""
    good = words.filter((F.col("conf") >= 0) & (F.trim("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return good.groupBy("page", "block", "par", "line").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), F.bround(F.avg("conf"), 2).alias("conf"),
    )


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def newest(rows: DataFrame, time: str, tie: str, most: int = 1000) -> DataFrame:
    """The dead-letter list: the newest rows, bounded."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(most)

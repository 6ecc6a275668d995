"""File sources and parsers (SRC1-SRC7) and table sinks (SNK1-SNK5, SNK9)."""

from __future__ import annotations

import importlib.util
import io
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lakelens.functions import text as T

ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")
PARSED = StructType().add("title", StringType()).add("content", StringType()).add("sections", ArrayType(StringType())).add("pages", ArrayType(StructType().add("page", "integer").add("text", "string")))


def decode(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    for name in encodings:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def parse_text(data: bytes, name: str) -> dict:
    return {"title": T.python_title(os.path.splitext(os.path.basename(name))[0]), "content": decode(data), "sections": [], "pages": []}


def parse_markdown(data: bytes, name: str) -> dict:
    content = decode(data, ("utf-8", "latin-1"))
    first = re.search(r"(?m)^#\s+(.+)$", content)
    sections = [s.strip() for s in re.findall(r"(?m)^#{1,3}\s+(.+)$", content)]
    return {"title": first.group(1).strip() if first else parse_text(b"", name)["title"], "content": content, "sections": sections, "pages": []}


def parse_pdf(data: bytes, name: str) -> dict:
    if importlib.util.find_spec("pypdf") is None:
        raise RuntimeError("PDF files need the optional package pypdf")
    import pypdf

    pages = []
    for number, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1):
        try:
            content = (page.extract_text() or "").strip()
        except Exception:  # a broken page is skipped, the rest is kept
            continue
        if content:
            pages.append({"page": number, "text": content})
    return {"title": parse_text(b"", name)["title"], "content": "\n\n".join(p["text"] for p in pages), "sections": [], "pages": pages}


def parser_for(name: str):
    extension = os.path.splitext(name)[1].lower()
    return parse_pdf if extension == ".pdf" else parse_markdown if extension in (".md", ".markdown") else parse_text


@F.pandas_udf(PARSED)
def parse_file(data: pd.Series, name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parser_for(n)(bytes(d), n) for d, n in zip(data, name, strict=True)], columns=PARSED.names)


def scan_directory(spark: SparkSession, folder: str, pattern: str = "*.{md,markdown,txt}") -> DataFrame:
    """Parsed files below ``folder`` with department, the first folder of their path below it, or general."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = re.escape(folder.rstrip("/"))
    below = F.regexp_extract("path", rf"{base}/(.*)$", 1)
    department = F.when(F.instr(below, "/") > 0, F.split(below, "/")[0]).otherwise("general")
    rows = files.select("path", below.alias("source"), department.alias("department"), parse_file("content", "path").alias("p")).select("path", "source", "department", "p.*")
    return rows.withColumn("content", T.sanitize(F.col("content"))).withColumn("checksum", T.checksum(F.col("content"))).withColumn("document_id", F.sha2("source", 256))


def page_ends(pages: Column) -> Column:
    """(page, end offset) of pages joined by blank lines, for the chunker's page lookup."""
    step = lambda a, p: F.struct((a["at"] + F.length(p["text"]) + 2).alias("at"), F.concat(a["out"], F.array(F.struct(p["page"].alias("page"), (a["at"] + F.length(p["text"])).alias("end")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,end:int>>").alias("out"))
    return F.aggregate(pages, start, step, lambda a: a["out"])


def html_sections(html: Column) -> Column:
    return F.struct(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)).alias("sections"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The last write of each key wins: stored rows whose key comes again give way."""
    both = stored.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("_age"))).filter("_nth = 1").drop("_age", "_nth")


def delete_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("document_id"), "document_id", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

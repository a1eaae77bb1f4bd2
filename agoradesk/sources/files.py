"""File inventories: size, hash, kind and layout of uploaded files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match

# Kinds, signatures, size limit, layouts that cannot be read reliably.
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PDF_MAGIC = "255044462D"
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
MAX_BYTES = 20 * 1024 * 1024
COMPLEX_PARTS = re.compile(r"^word/(?:charts|diagrams|embeddings)/", re.I)
COMPLEX_XML = re.compile(
    r"<(?:w:txbxContent|v:textbox|wps:txbx|w:object|w:control|w:altChunk|o:OLEObject|dgm:relIds|c:chart)\b", re.I | re.A
)
COLUMNS = re.compile(r"<w:cols\b[^>]*(?:/>|>.*?</w:cols>)", re.I | re.S)


def file_inventory(spark: SparkSession, path: str, declared: DataFrame | None = None) -> DataFrame:
    """One row per file below ``path``: size, SHA-256, kind and admission status.

    ``declared`` may give (path, mime_type). Files over the limit are refused by
    their size from the listing; their bytes take no part in the checks. A scan
    leaves out files without bytes, so these are found by being declared.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.join(declared, "path", "full_outer") if declared is not None else files.withColumn("mime_type", F.lit(None).cast("string"))
    extension = F.lower(F.regexp_extract("path", "\\.[^./]+$", 0))
    kind = F.when(extension == ".pdf", PDF).when(extension == ".docx", DOCX)
    head = F.hex(F.substring("content", 1, 5))
    status = first_match(
        (kind.isNull(), "invalid_file_type"),
        (F.col("mime_type").isNotNull() & (F.col("mime_type") != "") & (F.col("mime_type") != kind), "invalid_file_type"),
        (F.coalesce("length", F.lit(0)) < 1, "empty_file"),
        (F.col("length") > MAX_BYTES, "file_too_large"),
        ((extension == ".pdf") & (head != PDF_MAGIC), "invalid_pdf"),
        ((extension == ".docx") & ~F.left(head, F.lit(8)).isin(*ZIP_MAGIC), "invalid_docx"),
        default="ok",
    )
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_sha256"), extension.alias("extension"),
                        kind.alias("kind"), status.alias("status"), "content")


def _layout(content: bytes) -> str:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = [n.replace("\\", "/") for n in archive.namelist()]
        xml = archive.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, RuntimeError, NotImplementedError):
        return "docx_extraction_failed"
    for columns in COLUMNS.findall(xml):
        count = re.search(r"\bw:num\s*=\s*[\"'](\d+)[\"']", columns, re.I | re.A)
        if (count and int(count.group(1)) > 1) or len(re.findall(r"<w:col\b", columns, re.I | re.A)) > 1:
            return "docx_complex_layout"
    if COMPLEX_XML.search(xml) or any(COMPLEX_PARTS.match(n) for n in names):
        return "docx_complex_layout"
    return "ok"


def docx_layout(files: DataFrame) -> DataFrame:
    """Layout status of each Word file; one file is in memory at a time."""

    def screen(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "layout_status": [_layout(c) for c in batch["content"]]})

    return files.where("extension = '.docx' and status = 'ok'").select("path", "content").mapInPandas(screen, "path string, layout_status string")

"""Document folders: listing, text of word-processor files, and JSON Lines output."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of the document's body, one a line; empty if it can't be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    body = root.find(f"{_W}body")
    paragraphs = [] if body is None else body.findall(f"{_W}p")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in paragraphs)


def read_documents(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path, text`` of all files below a folder whose suffix (any case) has an extractor; ``.docx`` is built in.

    Other formats take a function from bytes to text. A file that its extractor gives no text for is an empty text.
    """
    use = {".docx": docx_text} | (extractors or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    wanted = "|".join(s.lstrip(".").lower() for s in use)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [use["." + p.rpartition(".")[2].lower()](c) for p, c in zip(b["path"], b["content"], strict=True)]})

    return files.where(f"lower(path) rlike '[.]({wanted})$'").mapInPandas(run, "path string, text string")


def write_jsonl(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """One ``{"text": ...}`` a line."""
    docs.selectExpr(f"`{text_col}` AS text").write.json(path)

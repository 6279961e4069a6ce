"""File sources: directories of PDFs through a pluggable extractor, text files, JSON records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, root: str, extension: str = ".pdf", content: bool = False) -> DataFrame:
    """path, mtime, size (and content) of the files below a folder with an extension in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.filter(F.lower("path").endswith(extension.lower()))
    columns = [F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    return found.select(*columns, *([F.col("content")] if content else []))


def pages_of(files: DataFrame, extract: Callable[[bytes], Iterable[str]], with_errors: bool = False) -> DataFrame:
    """(path, page_num, text) of files with content; blank pages are left out.

    Extractors are foreign code: a file on which one fails yields no pages, but one row
    of (path, -1, null, error) where ``with_errors`` asks for the column ``error``.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path, n, t.strip(), None) for n, t in enumerate(extract(content)) if t and t.strip()]
                except Exception as e:
                    rows = [r for r in rows if r[0] != path] + [(path, -1, None, f"{type(e).__name__}: {e}"[:500])]
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error"])

    found = files.select("path", "content").mapInPandas(run, "path string, page_num int, text string, error string")
    return found if with_errors else found.filter("error IS NULL").drop("error")


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)

"""Answers about single files and folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError, PrimitiveError
from ..functions.classify import language
from ..operators import languages
from . import tree

MARKERS = (".ctx.json", ".git", "pyproject.toml", "package.json", "go.mod", "Cargo.toml", "setup.py", "pom.xml")


def project_root(start: str) -> str | None:
    """The nearest folder at or above start that holds a project's marker."""
    at = os.path.abspath(start if os.path.isdir(start) else os.path.dirname(start) or ".")
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in MARKERS):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def file_infos(rows: DataFrame) -> DataFrame:
    """path, language, size_bytes, chunks, imports, exports and error of files(path, content).

    A file that is binary or in no known language has an error and empty lists.
    """
    c = F.col("content")
    lang = language(F.col("path"), F.regexp_extract(F.substring(c, 1, 256).cast("string"), r"^([^\n]*)", 1))
    text = tree.is_text(c) & ~tree.is_binary_extension(F.col("path"))
    f = rows.select("path", F.octet_length("content").alias("size_bytes"), lang.alias("language"), F.when(text, tree.decoded(c)).alias("source"), text.alias("text"))
    out = languages.parsed(f).join(f.select("path", "size_bytes", "text"), "path")
    error = F.when(~F.col("text"), F.lit("binary file")).when(F.col("language").isNull(), F.lit("unsupported language")).otherwise(F.col("error"))
    return out.select("path", "language", "size_bytes", "chunks", "imports", "exports", error.alias("error"))


def file_info(spark: SparkSession, path: str, root: str | None = None) -> dict:
    """One file's facts; PrimitiveError where there is none, ParseError where it can't be read."""
    if not os.path.exists(path):
        raise PrimitiveError(f"File not found: {path}")
    if os.path.isdir(path):
        raise ParseError(f"Path is a directory: {path}", path)
    try:
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        raise ParseError(str(e), path) from e
    name = os.path.relpath(os.path.abspath(path), os.path.abspath(root or os.getcwd())).replace(os.sep, "/")
    name = os.path.abspath(path).replace(os.sep, "/") if name.startswith("../") else name
    row = file_infos(spark.createDataFrame([(name, bytearray(content))], "path string, content binary")).first()
    if row.error:
        raise ParseError(f"{row.error}: {path}", path)
    return row.asDict(recursive=True)


def line_of(source: str, n: int) -> str:
    """Line n, from 1, without its indent; empty beyond the end."""
    lines = source.split("\n")
    return lines[n - 1].strip() if 0 < n <= len(lines) else ""


def docstring_after(source: str, n: int) -> str | None:
    """The quoted text right after line n."""
    return languages._docstring(source.split("\n"), n)

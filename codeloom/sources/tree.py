"""Source trees as DataFrames, by a Python data source.

``spark.read.format("codetree")`` lists a tree on the driver (names and sizes only,
ignored directories are not entered) and reads the files in tasks of about
SPLIT_BYTES.  The built-in binary file source can't serve here: it hides names that
begin with '_' or '.', such as ``__init__.py``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.classify import is_binary_extension, language
from ..functions.ignore import DEFAULT_RULES, parse_rules, rule_regex
from ..functions.paths import extension

RULE_FILE = ".ctxignore"
MOST_KB = 1024
HASHED_BYTES = 65536
SNIFFED_BYTES = 2048
SPLIT_BYTES = 32 << 20
STREAMED = (".anim", ".asset", ".controller", ".mat", ".overridecontroller", ".prefab", ".unity")
INDEXED_BINARY = tuple(".aif .aiff .avi .bmp .exr .fbx .flac .gif .hdr .jpeg .jpg .mov .mp3 .mp4 .ogg .otf .png .psd .svg .tga .tif .tiff .ttf .wav .webm".split())
_FIELDS = "path string, size_bytes long, mtime double, problem string, content binary"


def load_rules(root: str) -> list[str]:
    """The default rules and those of the tree's own rule file, which come last and so decide."""
    own = Path(root, RULE_FILE)
    return [*DEFAULT_RULES, *(parse_rules(own.read_text(encoding="utf-8", errors="replace").splitlines()) if own.is_file() else [])]


class _Matcher:
    def __init__(self, rules: list[str]):
        self.rules = [(re.compile(p, re.S), again) for p, again in map(rule_regex, rules)]

    def __call__(self, path: str) -> bool:
        out = False
        for pattern, again in self.rules:
            if pattern.match(path):
                out = not again
        return out


class _Split(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["root"])
        self.rules = json.loads(options["rules"]) if "rules" in options else load_rules(self.root)
        self.most = int(options.get("maxkb", MOST_KB)) * 1024
        self.content = options.get("content", "true") == "true"
        self.links = options.get("followsymlinks", "false") == "true"

    def _walk(self) -> Iterator[tuple]:
        """(path, size, mtime, problem), in path order within directories."""
        ignored = _Matcher(self.rules)
        for at, dirs, names in os.walk(self.root, followlinks=self.links):
            base = os.path.relpath(at, self.root).replace(os.sep, "/")
            base = "" if base == "." else base + "/"
            keep = []
            for d in sorted(dirs):
                # a directory is ignored where everything below would be
                if ignored(f"{base}{d}/x") and ignored(f"{base}{d}/y.z"):
                    yield f"{base}{d}/", 0, 0.0, "ignored"
                else:
                    keep.append(d)
            dirs[:] = keep
            for name in sorted(names):
                path = base + name
                if ignored(path):
                    yield path, 0, 0.0, "ignored"
                    continue
                try:
                    s = os.stat(os.path.join(at, name))
                    yield path, s.st_size, s.st_mtime, None
                except PermissionError:
                    yield path, 0, 0.0, "permission"
                except OSError:
                    yield path, 0, 0.0, "read_error"

    def partitions(self) -> list[InputPartition]:
        out, own, size = [], [], 0
        for f in self._walk():
            own.append(f)
            size += f[1] + 4096
            if size >= SPLIT_BYTES:
                out.append(_Split(own))
                own, size = [], 0
        return [*out, _Split(own)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.binary()]
        names = ["path", "size_bytes", "mtime", "problem", "content"]
        rows, held = [], 0
        for path, size, mtime, problem in split.files:
            data = None
            if problem is None:
                # of files beyond the limit the head is enough, but for those that are read whole
                most = -1 if size <= self.most or path.lower().endswith((*STREAMED, ".fbx")) else HASHED_BYTES
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        data = f.read(most if self.content else min(HASHED_BYTES, self.most))
                except PermissionError:
                    problem = "permission"
                except OSError:
                    problem = "read_error"
            rows.append((path, size, mtime, problem, data))
            held += len(data or b"")
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class CodeTree(DataSource):
    """Options: root, rules (a JSON list), maxkb, content, followsymlinks."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return _FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def encoding(content: Column) -> Column:
    """By byte order mark, else utf-8 where the bytes are valid, else latin-1."""
    h = F.hex(F.substring(content, 1, 4))
    return (
        F.when(h.startswith("EFBBBF"), "utf-8-sig").when(h == "FFFE0000", "utf-32-le").when(h == "0000FEFF", "utf-32-be").when(h.startswith("FFFE"), "utf-16-le").when(h.startswith("FEFF"), "utf-16-be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")
    )


def decoded(content: Column) -> Column:
    """The text of a file's bytes; what doesn't decode is replaced."""
    e = encoding(content)
    text = (
        F.when(e == "utf-8-sig", F.expr("substring(make_valid_utf8(string(content)), 2)")).when(e == "utf-16-le", F.decode(F.expr("substring(content, 3)"), "UTF-16LE"))
        .when(e == "utf-16-be", F.decode(F.expr("substring(content, 3)"), "UTF-16BE")).when(e == "latin-1", F.decode(content, "ISO-8859-1")).otherwise(F.make_valid_utf8(content.cast("string")))
    )
    return F.when(content.isNotNull(), text)


def is_text(content: Column) -> Column:
    """No zero byte in the head, or a mark of a wide encoding; empty files are text."""
    head = F.substring(content, 1, SNIFFED_BYTES)
    return ~head.cast("string").contains("\x00") | encoding(content).rlike("^utf-(16|32)")


def scan_log(spark: SparkSession, root: str, rules: list[str] | None = None, most_kb: int = MOST_KB, overrides: dict[str, str] | None = None, content: bool = True, follow_symlinks: bool = False) -> DataFrame:
    """One row a file: path, size_bytes, mtime, extension, is_binary, outcome, language, content_hash, content.

    The first that applies is the outcome: ignored, permission, read_error, too_large
    (but for streamed YAML assets and indexed binaries), binary (but for the latter), ok.
    """
    spark.dataSource.register(CodeTree)
    reader = spark.read.format("codetree").option("root", root).option("maxkb", most_kb).option("content", str(content).lower()).option("followsymlinks", str(follow_symlinks).lower())
    df = (reader if rules is None else reader.option("rules", json.dumps(rules))).load()
    c, ext = F.col("content"), extension(F.col("path"))
    indexed = ext.isin(*INDEXED_BINARY)
    head = F.ltrim(F.regexp_replace(F.substring(c, 1, SNIFFED_BYTES).cast("string"), "^\\x{FEFF}", ""))
    streamed = ext.isin(*STREAMED) & is_text(c) & (head.startswith("%YAML") | head.startswith("--- !u!"))
    binary = is_binary_extension(F.col("path")) | ~is_text(c)
    outcome = F.when(F.col("problem").isNotNull(), F.col("problem")).when((F.col("size_bytes") > most_kb * 1024) & ~streamed & ~indexed, "too_large").when(binary & ~indexed, "binary").otherwise("ok")
    line = F.regexp_extract(F.substring(c, 1, 256).cast("string"), r"^([^\n]*)", 1)
    hashed = F.when(ext == ".fbx", c).otherwise(F.substring(c, 1, HASHED_BYTES))
    ok = outcome == "ok"
    return df.select(
        "path", "size_bytes", "mtime", ext.alias("extension"), F.coalesce(binary, F.lit(False)).alias("is_binary"), outcome.alias("outcome"), F.when(ok, language(F.col("path"), line, overrides)).alias("language"),
        F.when(ok, F.substring(F.sha2(hashed, 256), 1, 16)).alias("content_hash"), F.when(ok, c).alias("content"),
    )


def files(log: DataFrame) -> DataFrame:
    """path, size_bytes, mtime, extension, language, hash, is_binary, source of the files that a scan keeps; the source of text files is decoded."""
    return log.filter("outcome = 'ok'").select("path", "size_bytes", "mtime", "extension", "language", F.col("content_hash").alias("hash"), "is_binary", F.when(~F.col("is_binary"), decoded(F.col("content"))).alias("source"))


def scan_summary(log: DataFrame) -> DataFrame:
    """outcome, files, size_bytes."""
    return log.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))

"""Queries of the code parsers, over one small source file made of each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, parse
from .registry import query, spread, table

# lines 1 and 2 import, 5 to 7 are a function, 10 and 11 a class
_FILES = """files as (select 'seg/' || c_mktsegment || '/c' || c_custkey || '.py' as path, c_custkey as k, c_mktsegment as seg from customer)"""
_CHUNKS = f"""{_FILES}, chunks as (select path || ':5:function:f' || k as id, path, 'function' as type, 'f' || k as name, 'def f' || k || '(x)' as signature, 5 as start_line, 9 as end_line, true as exported, 'Doubles.' as docstring from files
  union all select path || ':10:class:_K' || k, path, 'class', '_K' || k, 'class _K' || k, 10, 12, false, null from files)"""
_SITES = f"""{_FILES}, sites as (select path || ':5:function:f' || k as caller, 'f' || k as name, 5 as line, k as target from files
  union all select path || ':5:function:f' || k, 'f' || (k % 10), 7, k % 10 from files union all select path || ':5:function:f' || k, 'm' || (k % 7), 8, null from files)"""


def sources(spark, sf_dir):
    """path, language, source."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    body = F.concat(
        F.lit("import os\nfrom seg."), "c_mktsegment", F.lit(" import c"), s(k), F.lit(", d as e\n\n\ndef f"), s(k), F.lit('(x):\n    """Doubles."""\n    y = f'), s(k % 10), F.lit("(x)\n    return y.m"), s(k % 7), F.lit("()\n\nclass _K"), s(k), F.lit(":\n    pass\n"),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select(F.concat(F.lit("seg/"), "c_mktsegment", F.lit("/c"), s(k), F.lit(".py")).alias("path"), F.lit("python").alias("language"), body.alias("source"))


@query(f"with {_CHUNKS} select id, path, type, name, signature, start_line, end_line, exported, docstring from chunks")
def code_chunks(spark, sf_dir):
    return parse.chunks(sources(spark, sf_dir)).select("id", "path", "type", "name", "signature", "start_line", "end_line", "exported", "docstring")


@query(f"with {_CHUNKS} select path, name, type, start_line as line from chunks where exported")
def code_exports(spark, sf_dir):
    return parse.exports(parse.chunks(sources(spark, sf_dir))).select("path", "name", "type", "line")


@query(f"with {_FILES} select path, 'os' as module, '' as symbols, 1 as line from files union all select path, 'seg.' || seg, 'c' || k || ',d', 2 from files")
def code_imports(spark, sf_dir):
    return parse.imports(sources(spark, sf_dir)).select("path", "module", F.array_join("symbols", ",").alias("symbols"), "line")


@query(f"with {_SITES} select caller, name, cast(line as int) as line from sites")
def call_sites(spark, sf_dir):
    files = sources(spark, sf_dir)
    return calls.call_sites(parse.chunk_lines(parse.chunks(files), files)).select("caller", "name", "line")


@query(f"with {_SITES} select s.caller, s.name, cast(s.line as int) as line, case when target is not null then f.path || ':5:function:f' || f.k end as callee from sites s left join files f on f.k = target")
def resolved_calls(spark, sf_dir):
    files = sources(spark, sf_dir)
    chunks = parse.chunks(files)
    return calls.resolve_calls(calls.call_sites(parse.chunk_lines(chunks, files)), chunks).select("caller", "name", "line", "callee")


@query()
def semantic_anchors(spark, sf_dir):
    """Anchors of normalised code; the normaliser walks lines with state, so tests hold it against worked examples."""
    return parse.chunks(sources(spark, sf_dir)).select("id", "semantic_anchor", "signature_anchor")

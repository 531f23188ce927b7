"""A whole tree at once: scan, parse, resolve, graph, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import architecture, calls, coupling, parse, resolve
from ..operators.graph import CodeGraph
from ..sources import manifest, tree


@dataclass
class Analysis:
    """Lazy tables of an analysed tree; the graph's are cut, as every analysis reads them."""

    files: DataFrame
    chunks: DataFrame
    imports: DataFrame
    exports: DataFrame
    resolved: DataFrame
    graph: CodeGraph

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files.drop("source"), "chunks": self.chunks, "imports": self.imports, "exports": self.exports, "edges": self.graph.edges}

    def coupling(self) -> DataFrame:
        return coupling.coupling(self.graph, coupling.definition_counts(self.chunks))

    def architecture(self) -> DataFrame:
        return architecture.classify(self.graph, self.exports)

    def calls(self, skip_definition: bool = False) -> DataFrame:
        sites = calls.call_sites(parse.chunk_lines(self.chunks, self.files), skip_definition)
        return calls.resolve_calls(sites, self.chunks, self.resolved)

    def save(self, at: str) -> None:
        manifest.write_tables(self.tables(), at)

    def stats(self) -> DataFrame:
        return manifest.project_stats(self.tables())


def analyze_files(files: DataFrame, fix_python_relative: bool = False) -> Analysis:
    """files(path, language, source, ...)"""
    code = files.filter("source is not null")
    chunks, imports = parse.chunks(code), parse.imports(code)
    resolved = resolve.resolve(imports, files, fix_python_relative)
    graph = CodeGraph.of(resolve.internal_edges(resolved), files.select(F.col("path").alias("id"))).kept()
    return Analysis(files, chunks, imports, parse.exports(chunks), resolved, graph)


def analyze_tree(spark: SparkSession, root: str, rules: list[str] | None = None, most_kb: int = tree.MOST_KB, fix_python_relative: bool = False) -> Analysis:
    return analyze_files(tree.files(tree.scan_log(spark, root, rules, most_kb)), fix_python_relative)

"""The command line: python -m codeloom COMMAND, in or below the folder of a project.

scan writes the tables of an analysis to the output folder; stats, graph, focus,
optimize, deps and verify read them; overview, tree, scripts, entries and file read the
project itself.  Exit codes: 0, 1 for errors that the rest survived or a stale
analysis, 2 where nothing could be done.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors, settings
from .operators import calls, coupling, focus, parse, resolve, select, snapshots, trees, unity
from .operators.architecture import classify, layer_counts, violations
from .operators.graph import CodeGraph
from .plans import analysis
from .session import local_session
from .sinks import diagrams, maps, reports
from .sources import editor, freshness, game_project, lookup, manifest, project, tree

FORMS = ("json", "human", "markdown")


class Project:
    """A project's folder, its settings and what is stored of it."""

    def __init__(self, root: str, config: str | None = None):
        self.root = lookup.project_root(root) or os.path.abspath(root)
        self.settings = settings.load(self.root, config)
        wrong = settings.problems(self.settings)
        if wrong:
            raise errors.SettingsError("; ".join(wrong))
        self.folder = os.path.join(self.root, self.settings.output_dir)

    def files(self, spark: SparkSession, content: bool = True) -> DataFrame:
        rules = tree.load_rules(self.root) + list(self.settings.exclude_patterns) + [f"{self.settings.output_dir}/"]
        return tree.scan_log(spark, self.root, rules, int(self.settings.max_file_size_kb), self.settings.language_overrides or None, content)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        found = manifest.read_tables(spark, self.folder)
        if "files" not in found:
            raise errors.ManifestError("nothing is stored; run scan first")
        return found

    def graph(self, tables: dict[str, DataFrame]) -> CodeGraph:
        return CodeGraph.of(tables["edges"], tables["files"].select(F.col("path").alias("id"))).kept()

    def ranks(self, graph: CodeGraph) -> DataFrame:
        return graph.pagerank(self.settings.pagerank_damping, int(self.settings.pagerank_iterations))


def _known(tables: dict[str, DataFrame], path: str) -> str:
    path = path.replace("\\", "/").removeprefix("./")
    if not tables["files"].filter(F.col("path") == path).limit(1).count():
        near = [r.path for r in trees.similar_paths(tables["files"], path).collect()]
        raise errors.PrimitiveError(f"{path} is not known" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return path


def _out(text: str, at: str | None = None) -> None:
    if at:
        with open(at, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


def _analysed(spark: SparkSession, p: Project) -> tuple[analysis.Analysis, DataFrame]:
    log = p.files(spark)
    failed = log.filter(F.col("outcome").isin("permission", "read_error")).select("path", F.when(F.col("outcome") == "permission", "permission").otherwise("encoding").alias("error_type"), F.col("outcome").alias("message"), F.lit(None).cast("int").alias("line"), F.lit(True).alias("recoverable"))
    return analysis.analyze_files(tree.files(log)), failed


def scan(spark, p: Project, a) -> int:
    found, failed = _analysed(spark, p)
    manifest.write_tables({**found.tables(), "errors": failed}, p.folder)
    tables = p.tables(spark)
    freshness.save(tables["files"], p.folder)
    if p.settings.manifest_file:
        manifest.write_json(tables, os.path.join(p.folder, p.settings.manifest_file), p.root)
    s = manifest.project_stats(tables).first()
    _out("\n".join(f"{k}: {v}" for k, v in s.asDict().items()))
    text = errors.report(tables["errors"], verbose=a.verbose)
    if text:
        print(text, file=sys.stderr)
    return errors.exit_code(tables["errors"])


def agents(spark, p: Project, a) -> int:
    known = maps.load_summaries(p.root)
    for assignment in a.summary or []:
        path, text = maps.parse_summary(assignment)
        known[path] = text
    if a.summary and not a.dry_run:
        maps.save_summaries(p.root, known)
    found, failed = _analysed(spark, p)
    at = freshness.now()
    done = maps.write_maps(spark, found, p.root, a.depth, a.dry_run, freshness.footer(snapshots.source_hash(freshness.hashed(found.files)).first()[0], at))
    if not a.dry_run:
        os.makedirs(p.folder, exist_ok=True)
        freshness.save(found.files, p.folder, at)
    _out("\n".join(f"{k}: {len(getattr(done, k))}" for k in ("written", "unchanged", "removed", "errors")))
    return 1 if done.errors else errors.exit_code(failed)


def stats(spark, p: Project, a) -> int:
    t = p.tables(spark)
    g = p.graph(t)
    ranks = p.ranks(g)
    m = coupling.coupling(g, coupling.definition_counts(t["chunks"]))
    layers = classify(g, t["exports"])
    if a.json:
        _out(json.dumps({"graph": g.stats().first().asDict(), "top": [r.asDict() for r in ranks.orderBy(F.desc("score"), "id").limit(a.top).collect()], "coupling": coupling.coupling_summary(m).first().asDict()}, indent=2))
        return 0
    parts = [reports.table(ranks, {"id": "File", "score": "PageRank"}, [F.desc("score"), "id"], a.top, {"score": lambda x: f"{x:.6f}"}), reports.cycles(g.cycles()), reports.coupling(m), reports.bridges(focus.bridges(g, g.betweenness(), ranks)), reports.layers(layer_counts(layers), violations(g, layers))]
    _out("\n\n".join(parts))
    return 0


def graph(spark, p: Project, a) -> int:
    t = p.tables(spark)
    if a.kind == "calls":
        files = tree.files(p.files(spark))
        found = calls.resolve_calls(calls.call_sites(parse.chunk_lines(t["chunks"], files)), t["chunks"]).filter("callee is not null")
        g = CodeGraph.of(found.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))).kept()
        if a.format == "markdown":
            _out(reports.calls(calls.call_stats(found), calls.hot_functions(found), calls.entry_points(found).count(), calls.leaves(found).count()), a.output)
            return 0
    else:
        g = p.graph(t)
    _out(diagrams.export(g, "mermaid" if a.format == "markdown" else a.format, p.ranks(g), g.cycles(), most=a.most), a.output)
    return 0


def focused(spark, p: Project, a) -> int:
    t = p.tables(spark)
    path = _known(t, a.path)
    g = p.graph(t)
    found = focus.focus(g, p.ranks(g), path, a.depth, a.decay)
    if a.no_tests:
        found = found.filter("not is_test")
    _out(reports.as_json(found) if a.format == "json" else reports.focus(found, path), a.output)
    return 0


def optimize(spark, p: Project, a) -> int:
    t = p.tables(spark)
    c = t["chunks"]
    chunks = c.select("id", "path", "name", "type", "exported", select.chunk_tokens(None, F.col("end_line") - F.col("start_line") + 1).alias("tokens"), F.coalesce("docstring", F.lit("")).alias("description"))
    prepared = select.prepare(chunks, p.ranks(p.graph(t)), a.keyword, a.task)
    picked = select.optimize(prepared, a.budget, a.strategy, filtered=bool(a.keyword or a.task))
    _out(reports.as_json(picked.orderBy("pick")) if a.format == "json" else reports.selection(picked, a.budget), a.output)
    return 0


def verify(spark, p: Project, a) -> int:
    now = tree.files(p.files(spark)).select("path", "hash")
    state, diff = freshness.check(spark, p.folder, now)
    stale = state.first().is_stale
    _out(reports.as_json(diff.filter("state <> 'unchanged'").orderBy("path")) if a.json else reports.staleness(diff, a.verbose))
    return 1 if stale else 0


def clean(spark, p: Project, a) -> int:
    if a.maps:
        for at, _, names in os.walk(p.root):
            if maps.NAME in names:
                maps.remove_map(os.path.join(at, maps.NAME))
    if os.path.isdir(p.folder):
        shutil.rmtree(p.folder)
    return 0


def overview(spark, p: Project, a) -> int:
    began = time.time()
    found = project.overview(tree.files(p.files(spark)))
    _out(reports.as_json(found) if a.format == "json" else reports.overview(found, a.format == "markdown"))
    if a.timing:
        print(f"{time.time() - began:.3f} s", file=sys.stderr)
    return 0


def trees_(spark, p: Project, a) -> int:
    f = tree.files(p.files(spark, content=False))
    d = trees.directories(f, a.depth)
    _out(reports.as_json(d.orderBy("directory")) if a.format == "json" else reports.tree(d, p.root, f.count(), a.format == "markdown"))
    return 0


def scripts(spark, p: Project, a) -> int:
    f = tree.files(p.files(spark))
    s = project.scripts(f)
    _out(reports.as_json(s) if a.format == "json" else reports.scripts(s, project.golden_commands(f), a.format == "markdown"))
    return 0


def entries(spark, p: Project, a) -> int:
    e = project.entry_points(tree.files(p.files(spark)))
    _out(reports.as_json(e) if a.format == "json" else reports.entries(e, a.format == "markdown"))
    return 0


def file(spark, p: Project, a) -> int:
    info = lookup.file_info(spark, a.path, p.root)
    _out(json.dumps(info, indent=2, ensure_ascii=False) if a.format == "json" else reports.file(info, a.format == "markdown"))
    return 0


def deps(spark, p: Project, a) -> int:
    try:
        t = p.tables(spark)
        g, imports = p.graph(t), t["imports"]
    except errors.ManifestError:
        found, _ = _analysed(spark, p)
        t, g, imports = found.tables(), found.graph, found.imports
    path = _known(t, a.path)
    rows = focus.dependencies_of(g, path, imports=resolve.resolve(imports, t["files"]))
    _out(reports.as_json(rows) if a.format == "json" else reports.deps(rows, path, a.format == "markdown"))
    return 0


def assets(spark, p: Project, a) -> int:
    f = tree.files(p.files(spark))
    docs = unity.documents(f.filter("source is not null"))
    guids = unity.guid_index(f)
    by_type = lambda df, column, value: df if not value else unity.same_name(df, column, value)
    own = lambda df: df if not getattr(a, "asset", None) else df.filter(F.col("asset") == a.asset)
    if a.what == "list":
        found = unity.asset_counts(docs, unity.references(docs, guids)).withColumn("kind", game_project.kind(F.col("asset")))
        found = by_type(found, "kind", a.kind).orderBy("asset").limit(a.limit)
    elif a.what == "show":
        found = unity.game_objects(docs).filter(F.col("asset") == a.asset)
        found = (found if a.depth < 0 else found.filter(F.size(F.split("path", "/")) <= a.depth + 1)).orderBy("path")
    elif a.what == "bindings":
        found = by_type(by_type(own(unity.event_bindings(docs, guids)), "target_type", a.type), "method", a.method)
    else:
        found = by_type(own(unity.components(docs, guids)), "qualified_type", a.type)
        found = found if not a.object else found.filter(F.col("object") == a.object)
    _out(reports.as_json(found))
    return 0


def editor_(spark, p: Project, a) -> int:
    state, reasons = editor.status(os.path.join(p.folder, editor.FILE_NAME), p.root)
    _out(json.dumps({"status": state, "reasons": reasons}, indent=2))
    return 0 if state == "fresh" else 1


COMMANDS = {"scan": scan, "agents": agents, "stats": stats, "graph": graph, "focus": focused, "verify": verify, "optimize": optimize, "clean": clean, "overview": overview, "tree": trees_, "scripts": scripts, "entries": entries, "file": file, "deps": deps, "unity": assets, "editor": editor_}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeloom", description="Questions about a code base, answered by Spark.")
    top.add_argument("--root", default=".", help="the project's folder, or one below it")
    top.add_argument("--config", help="a settings file in place of the project's own")
    top.add_argument("--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    form = lambda x, default="json", forms=FORMS: x.add_argument("--format", choices=forms, default=default)
    add("scan", "analyse the project and store its tables")
    x = add("agents", "write the maps of all directories")
    x.add_argument("--depth", type=int, default=-1)
    x.add_argument("--dry-run", action="store_true")
    x.add_argument("--summary", action="append", metavar="PATH=TEXT")
    x = add("stats", "the most important files, cycles, coupling and layers")
    x.add_argument("--top", type=int, default=10)
    x.add_argument("--json", action="store_true")
    x = add("graph", "the graph of imports or calls")
    x.add_argument("--kind", choices=("imports", "calls"), default="imports")
    x.add_argument("--most", type=int, default=50)
    x.add_argument("--output")
    form(x, "mermaid", ("mermaid", "dot", "json", "markdown"))
    x = add("focus", "what is near a file")
    x.add_argument("path")
    x.add_argument("--depth", type=int, default=3)
    x.add_argument("--decay", type=float, default=0.8)
    x.add_argument("--no-tests", action="store_true")
    x.add_argument("--output")
    form(x, "markdown", ("json", "markdown"))
    x = add("verify", "whether the stored analysis still holds")
    x.add_argument("--json", action="store_true")
    x = add("optimize", "chunks within a budget of tokens")
    x.add_argument("--budget", type=int, default=8000)
    x.add_argument("--strategy", choices=("greedy", "knapsack"), default="greedy")
    x.add_argument("--keyword", action="append")
    x.add_argument("--task")
    x.add_argument("--output")
    form(x, "markdown", ("json", "markdown"))
    x = add("clean", "take away what was written")
    x.add_argument("--maps", action="store_true")
    x = add("overview", "language, frameworks and layout")
    x.add_argument("--timing", action="store_true")
    form(x)
    x = add("tree", "directories")
    x.add_argument("--depth", type=int, default=2)
    form(x)
    for name, text in (("scripts", "what can be run"), ("entries", "where programs begin")):
        form(add(name, text))
    for name, text in (("file", "what is in a file"), ("deps", "what a file needs and what needs it")):
        x = add(name, text)
        x.add_argument("path")
        form(x)
    x = add("unity", "serialized assets")
    kinds = x.add_subparsers(dest="what", required=True)
    y = kinds.add_parser("list")
    y.add_argument("--kind")
    y.add_argument("--limit", type=int, default=50)
    y = kinds.add_parser("show")
    y.add_argument("asset")
    y.add_argument("--depth", type=int, default=-1)
    y = kinds.add_parser("bindings")
    for name in ("--asset", "--type", "--method"):
        y.add_argument(name)
    y = kinds.add_parser("components")
    for name in ("--asset", "--type", "--object"):
        y.add_argument(name)
    add("editor", "whether the editor's snapshot is there and fresh")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        p = Project(a.root, a.config)
        return COMMANDS[a.command](spark or SparkSession.getActiveSession() or local_session(cores="*"), p, a)
    except (errors.LoomError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

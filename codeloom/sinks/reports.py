"""Texts for readers: tables of results as Markdown, plain lists or JSON.

A report shows the first rows of a result in its order and says how many it leaves
out; only what is shown is fetched.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import LAYERS

ZONE_SIGNS = {"main": "✅", "pain": "⚠️", "uselessness": "❌", "neutral": "➖"}
LAYER_SIGNS = {"presentation": "🖥️", "application": "⚙️", "domain": "💼", "infrastructure": "🔧", "shared": "📦"}


def table(df: DataFrame, titles: dict[str, str], order: list, most: int | None = None, forms: dict[str, Callable] | None = None, empty: str = "") -> str:
    """A Markdown table of the named columns, the first ``most`` rows in order, and a last row for the others."""
    total = df.count() if most is not None else None
    if total == 0:
        return empty
    ordered = df.orderBy(*order)
    rows = (ordered if most is None else ordered.limit(most)).collect()
    if not rows:
        return empty
    forms = forms or {}
    cell = lambda r, c: str(forms[c](r[c]) if c in forms else r[c] if r[c] is not None else "-").replace("|", "\\|")
    lines = ["| " + " | ".join(titles.values()) + " |", "|" + "---|" * len(titles)]
    lines += ["| " + " | ".join(cell(r, c) for c in titles) + " |" for r in rows]
    if total is not None and total > len(rows):
        lines.append("| ... |" + " |" * (len(titles) - 2) + f" ({total - len(rows)} more) |")
    return "\n".join(lines)


def bullets(df: DataFrame, line: Callable, order: list, most: int, none: str = "") -> list[str]:
    """Lines of the first ``most`` rows and how many are left."""
    total = df.count()
    if not total:
        return [none] if none else []
    shown = [line(r) for r in df.orderBy(*order).limit(most).collect()]
    return shown + [f"- ... and {total - most} more"] * (total > most)


_2, _4 = (lambda x: f"{x:.2f}"), (lambda x: f"{x:.4f}")
_code = lambda x: f"`{x}`"


def coupling(metrics: DataFrame, most: int = 20) -> str:
    """Modules by their distance from the main sequence, the worst first."""
    titles = {"id": "File", "ca": "Ca", "ce": "Ce", "i": "I", "a": "A", "d": "D", "zone": "Zone"}
    return table(metrics, titles, [F.desc("d"), "id"], most, {"i": _2, "a": _2, "d": _2, "zone": lambda z: f"{ZONE_SIGNS.get(z, '➖')} {z}"})


def bridges(found: DataFrame, most: int = 10) -> str:
    titles = {"id": "File", "betweenness": "Betweenness", "pagerank": "PageRank", "risk": "Risk", "description": "Description"}
    return table(found, titles, [F.desc("betweenness"), "id"], most, {"id": _code, "betweenness": _4, "pagerank": _4, "risk": str.title}, "No bridge files detected.")


def layers(counts: DataFrame, violations: DataFrame, most: int = 5) -> str:
    n = {r.layer: r.files for r in counts.collect()}  # one row a layer
    lines = ["## 🏗️ Architecture Layers", ""] + [f"| {LAYER_SIGNS[x]} {x.title()} | {n.get(x, 0)} files |" for x in LAYERS]
    bad = violations.count()
    if bad:
        lines += ["", f"⚠️ **{bad} layer violation(s) detected**", ""]
        lines += bullets(violations, lambda r: f"- {r.src} ({r.src_layer}) imports {r.dst} ({r.dst_layer})", ["src", "dst"], most)
    return "\n".join(lines)


def violations(found: DataFrame, most: int | None = None) -> str:
    return table(found, {"src": "Source", "src_layer": "Source Layer", "dst": "Target", "dst_layer": "Target Layer"}, ["src", "dst"], most, empty="✅ No layer violations detected.")


def calls(stats: DataFrame, hot: DataFrame, entry_points: int, leaves: int, most: int = 10) -> str:
    s = stats.first()
    head = ["## 📞 Call Graph Analysis", "", f"- Total call sites: {s.calls}", f"- Resolved: {s.resolved} ({s.resolution_rate:.1%})", f"- Entry points: {entry_points}", f"- Leaf functions: {leaves}", "", "### Most-Called Functions", ""]
    return "\n".join([*head, table(hot, {"callee": "Function", "calls": "Call Count"}, [F.desc("calls"), "callee"], most, {"callee": _code}, "_None_")])


def cycles(found: DataFrame, most: int = 10) -> str:
    """component, id rows as one line a cycle, the largest first."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.count()
    if not total:
        return "No circular dependencies."
    shown = sizes.orderBy(F.desc("n"), "component").limit(most)
    rows = found.join(F.broadcast(shown), "component").groupBy("component", "n").agg(F.slice(F.sort_array(F.collect_set("id")), 1, 20).alias("ids")).orderBy(F.desc("n"), "component").collect()  # at most ``most`` components
    lines = [f"{total} circular dependencies:", ""] + [f"- {' ↔ '.join(map(str, r.ids))}" + f" and {r.n - 20} more" * (r.n > 20) for r in rows]
    return "\n".join(lines + [f"- ... and {total - most} more"] * (total > most))


def focus(found: DataFrame, start: str, most: int = 50) -> str:
    lines = [f"# Focus: `{start}`", ""]
    for kind, title in (("dependency", "Dependencies"), ("dependent", "Dependents"), ("both", "Both ways")):
        own = found.filter(F.col("direction") == kind)
        lines += [f"## {title}", "", table(own, {"id": "File", "distance": "Distance", "score": "Score"}, [F.desc("score"), "id"], most, {"id": _code, "score": _4}, "_None_"), ""]
    return "\n".join(lines)


def selection(picked: DataFrame, budget: int) -> str:
    used = picked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = table(picked, {"pick": "#", "id": "Chunk", "path": "File", "tokens": "Tokens", "adjusted_score": "Score"}, ["pick"], None, {"id": _code, "adjusted_score": _4}, "_Nothing fits._")
    return f"# Selected context\n\n{used} of {budget} tokens ({used / budget:.0%})\n\n{rows}" if budget else rows


def staleness(diff: DataFrame, verbose: bool = False, most: int = 5) -> str:
    """path, state rows of a snapshot's diff."""
    n = {r.state: r.n for r in diff.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}  # four states
    changed = {k: n.get(k, 0) for k in ("modified", "added", "removed")}
    if not sum(changed.values()):
        return "[fresh] nothing has changed"
    lines = ["[stale] " + ", ".join(f"{v} {k}" for k, v in changed.items() if v)]
    for state, sign in (("modified", "~"), ("added", "+"), ("removed", "-")):
        own = diff.filter(F.col("state") == state).orderBy("path")
        rows = (own if verbose else own.limit(most)).collect() if changed[state] else []
        lines += [f"  {sign} {r.path}" for r in rows] + [f"  ... and {changed[state] - len(rows)} more {state}"] * (changed[state] > len(rows))
    return "\n".join(lines)


def cache(hits: int, misses: int) -> str:
    n = hits + misses
    return f"Cache: {hits} hits, {misses} misses ({100 * hits / n if n else 100:.1f}% hit rate)"


# answers about a tree: tree, overview, scripts, entries, file, deps


def _facts(title: str, facts: dict, markdown: bool) -> list[str]:
    shown = [(k, ", ".join(v) if isinstance(v, list) else v) for k, v in facts.items() if v not in (None, "", [])]
    return [f"# {title}", "", *(f"- **{k}**: {v}" for k, v in shown)] if markdown else [*(f"{k}: {v}" for k, v in shown)]


def as_json(df: DataFrame) -> str:
    """Rows as a JSON list, streamed through the driver."""
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()], indent=2, ensure_ascii=False)


def tree(directories: DataFrame, root: str, files: int, markdown: bool = False) -> str:
    """directory, file_count, extensions rows."""
    rows = directories.orderBy("directory").collect()  # directories to a depth
    lines = _facts(f"Project: {root.rstrip('/').rsplit('/', 1)[-1]}", {"Project Root": root, "Total Files": files, "Total Directories": len(rows)}, markdown) + [""]
    if markdown:
        lines += ["## Directory Structure", "", "| Directory | Files | Extensions |", "|---|---|---|"]
        return "\n".join(lines + [f"| `{r.directory or '.'}/` | {r.file_count} | {', '.join(f'{k}: {v}' for k, v in r.extensions.items())} |" for r in rows])
    return "\n".join(lines + [f"{r.directory or '.'}/ ({r.file_count} files)" for r in rows])


def overview(facts: DataFrame, markdown: bool = False) -> str:
    r = facts.first()
    return "\n".join(_facts("Project Overview", {"Project": r.name, "Primary Language": r.primary_language or "Unknown", "Package Manager": r.package_manager, "Frameworks": r.frameworks, "Workspace Type": r.workspace_type, "Source Directories": r.source_dirs, "Test Directories": r.test_dirs}, markdown))


def scripts(found: DataFrame, golden: DataFrame, markdown: bool = False) -> str:
    if markdown:
        parts = ["# Scripts", "", "## Golden Commands", "", table(golden, {"name": "Action", "run_as": "Command"}, ["name"], None, {"run_as": _code}, "_None_"), "", "## Available Scripts", ""]
        return "\n".join([*parts, table(found, {"name": "Name", "run_as": "Command", "source": "Source"}, ["source", "name"], None, {"run_as": _code}, "_None_")])
    head = ["Golden Commands:", *(f"  {r.name}: {r.run_as}" for r in golden.orderBy("name").collect()), ""]
    return "\n".join([*head, "Scripts:", *(f"  {r.name} ({r.source}): {r.run_as}" for r in found.orderBy("source", "name").collect())])


def entries(found: DataFrame, markdown: bool = False) -> str:
    if markdown:
        return "# Entry Points\n\n" + table(found, {"path": "Path", "type": "Type", "language": "Language", "name": "Name"}, ["path", "type"], None, {"path": _code}, "_None_")
    return "\n".join(["Entry Points:", *(f"  - {r.path} [{r.type}]" + (f" ({r.name})" if r.name else "") for r in found.orderBy("path", "type").collect())])


def file(info: dict, markdown: bool = False) -> str:
    """What sources.lookup.file_info() tells of a file."""
    lines = _facts(f"File: {info['path']}", {"File": info["path"], "Language": info["language"], "Size": f"{info['size_bytes']} bytes", **{k.title(): len(info[k]) for k in ("chunks", "imports", "exports")}}, markdown)
    if markdown:
        lines += ["", "## Exports", "", "| Name | Type | Line |", "|---|---|---|", *(f"| `{e['name']}` | {e['type']} | {e['line']} |" for e in info["exports"])] if info["exports"] else []
        lines += ["", "## Chunks", "", "| Name | Type | Lines |", "|---|---|---|", *(f"| `{c['name']}` | {c['type']} | {c['start_line']}-{c['end_line']} |" for c in info["chunks"])] if info["chunks"] else []
    elif info["exports"]:
        lines += ["", "Exports:", *(f"  - {e['name']} ({e['type']})" for e in info["exports"])]
    return "\n".join(lines)


def deps(found: DataFrame, path: str, markdown: bool = False) -> str:
    """relation, id rows of focus.dependencies_of()."""
    lines = [f"# Dependencies: `{path}`" if markdown else f"Dependencies for {path}:"]
    rows = found.collect()
    for kind, title, sign in (("dependency", "Imports (Dependencies)", "->"), ("dependent", "Imported By (Dependents)", "<-")):
        own = [r.id for r in rows if r.relation == kind]
        lines += ["", f"## {title}" if markdown else f"{title}:"]
        lines += [f"- `{x}`" if markdown else f"  {sign} {x}" for x in own] or ["_None_" if markdown else "  (None)"]
    return "\n".join(lines)

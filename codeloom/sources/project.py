"""Project facts from configuration files: scripts, entry points, tooling.

Everything here works on files(project, path, source) of many projects at once: the few
configuration files of a project meet in one group, which is small however many
projects there are.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, extension

CONFIGURATION = ("pyproject.toml", "package.json", "Makefile", "setup.py", "requirements.txt", "go.mod", "Cargo.toml")
LOCKS = ("uv.lock", "poetry.lock", "pdm.lock", "Pipfile", "Pipfile.lock", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "package-lock.json", "pnpm-workspace.yaml", "Cargo.lock")
HEURISTIC = {"main.py": "script", "app.py": "app", "cli.py": "cli", "index.js": "app", "index.ts": "app", "server.js": "server", "main.go": "app"}
_PYTHON_LIBRARIES = ("django", "fastapi", "flask", "pytest")
_NODE_LIBRARIES = {"react": "react", "next": "next.js", "vue": "vue", "svelte": "svelte", "express": "express", "jest": "jest", "vitest": "vitest"}
SOURCE_DIRS, TEST_DIRS = ("app", "cmd", "core", "lib", "pkg", "src"), ("__tests__", "spec", "test", "tests")
ENTRY_NAMES = ("__main__.py", "app.py", "cli.py", "index.js", "index.ts", "main.go", "main.js", "main.py", "main.rs", "main.ts", "server.js", "server.ts")


def with_project(files: DataFrame, project: str = "") -> DataFrame:
    return files if "project" in files.columns else files.withColumn("project", F.lit(project))


def _toml(text: str | None) -> dict:
    try:
        return tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return {}


def _json(text: str | None) -> dict:
    try:
        out = json.loads(text or "{}")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def _manager(names: set[str], ladder: tuple[tuple[str, str], ...], default: str) -> str:
    return next((tool for lock, tool in ladder if lock in names), default)


_PYTHON = (("uv.lock", "uv"), ("poetry.lock", "poetry"), ("pdm.lock", "pdm"))
_NODE = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"))


def _scripts(files: dict[str, str | None]) -> list[tuple[str, str, str, str, bool]]:
    """(name, command, run_as, source, golden); later golden ones of a name win."""
    out, names = [], set(files)
    if "pyproject.toml" in files:
        tools = _toml(files["pyproject.toml"]).get("tool", {})
        tool = _manager(names, _PYTHON, "pip")
        run = "" if tool == "pip" else f"{tool} run "
        for key, golden in (("pytest", {"test": "pytest"}), ("ruff", {"lint": "ruff check", "format": "ruff format"}), ("mypy", {"typecheck": "mypy ."})):
            if key in tools:
                out += [(name, cmd, run + cmd, "pyproject.toml", True) for name, cmd in golden.items()]
    if "package.json" in files:
        tool = _manager(names, _NODE, "npm")
        for name, cmd in (_json(files["package.json"]).get("scripts") or {}).items():
            short = tool == "npm" and name in ("start", "test")
            out.append((name, str(cmd), f"{tool} {name}" if short else f"{tool} run {name}", "package.json", name in ("build", "clean", "format", "lint", "start", "test")))
    for line in (files.get("Makefile") or "").splitlines():
        name = line.split(":", 1)[0].strip()
        if ":" in line and line[0] not in "\t #." and not line.startswith("PHONY:") and name and "%" not in name:
            out.append((name, f"make {name}", f"make {name}", "Makefile", name in ("build", "clean", "format", "install", "lint", "test")))
    return out


def scripts(files: DataFrame) -> DataFrame:
    """project, name, command, run_as, source, golden: what can be run; tool commands of pyproject are golden only."""
    return _by_project(files, lambda f: [(n, c, r, s, g) for n, c, r, s, g in _scripts(f)], "name string, command string, run_as string, source string, golden boolean")


def golden_commands(files: DataFrame) -> DataFrame:
    """project, name, run_as: the one command for each usual task; Makefile goes before package.json before pyproject."""

    def work(f):
        return list({n: r for n, _, r, _, g in _scripts(f) if g}.items())

    return _by_project(files, work, "name string, run_as string")


def _entries(files: dict[str, str | None]) -> list[tuple[str, str, str, str | None]]:
    out = []
    if "pyproject.toml" in files:
        t = _toml(files["pyproject.toml"])
        for table in (t.get("project", {}).get("scripts", {}), t.get("tool", {}).get("poetry", {}).get("scripts", {})):
            for name, target in table.items():
                module = str(target).split(":")[0].replace(".", "/") + ".py"
                path = next((p for p in (f"src/{module}", module) if p in files), None)
                if path:
                    out.append((path, "cli", "python", name))
    if "package.json" in files:
        p = _json(files["package.json"])
        bins = p.get("bin", {})
        each = {p.get("name"): bins} if isinstance(bins, str) else bins
        out += [(str(path).removeprefix("./"), "cli", "javascript", name) for name, path in each.items()]
        if "main" in p:
            out.append((p["main"], "library", "javascript", "main"))
    seen = {e[0] for e in out}
    for base in ("", "src/"):
        out += [(base + name, kind, name.rsplit(".", 1)[1], None) for name, kind in HEURISTIC.items() if base + name in files and base + name not in seen]
    return sorted(out, key=lambda e: e[0])


def entry_points(files: DataFrame) -> DataFrame:
    """project, path, type, language, name, from configuration first, then by usual names at the top and in src/."""
    return _by_project(files, _entries, "path string, type string, language string, name string")


def named_entry_points(files: DataFrame) -> DataFrame:
    """project, path of files anywhere in the tree with a usual name of an entry point."""
    return with_project(files).filter(basename(F.col("path")).isin(*ENTRY_NAMES)).select("project", "path")


def _overview(project: str, files: dict[str, str | None]) -> list[tuple]:
    names = set(files)
    name, lang, tool, file, frames, kind = project.rstrip("/").rsplit("/", 1)[-1], None, None, None, set(), "single"
    tops = {p.split("/", 1)[0] for p in names if "/" in p}
    dirs, tests = set(), set()
    if "Assets" in tops and "ProjectSettings/ProjectVersion.txt" in names:
        lang, tool, file = "csharp", "unity-package-manager", "Packages/manifest.json"
        frames.add("unity")
        dirs |= {"Assets"} | ({"Packages"} & tops)
        tests |= {d for d in ("Assets/Tests", "Assets/Editor/Tests") if any(p.startswith(d + "/") for p in names)}
    if "pyproject.toml" in names and lang is None:
        lang, file = "python", "pyproject.toml"
        t = _toml(files[file])
        poetry = t.get("tool", {}).get("poetry", {})
        name = t.get("project", {}).get("name") or poetry.get("name", name)
        wants = json.dumps([t.get("project", {}).get("dependencies", []), t.get("project", {}).get("optional-dependencies", {}), list(poetry.get("dependencies", {}))]).lower()
        frames |= {x for x in _PYTHON_LIBRARIES if x in wants}
        tool = _manager(names, (*_PYTHON, ("Pipfile", "pipenv")), "pip")
    elif lang is None and names & {"setup.py", "requirements.txt"}:
        lang, tool, file = "python", "pip", "setup.py" if "setup.py" in names else "requirements.txt"
    if "package.json" in names and lang is None:
        p = _json(files["package.json"])
        wants = {**(p.get("dependencies") or {}), **(p.get("devDependencies") or {})}
        lang, file, name = "typescript" if "typescript" in wants else "javascript", "package.json", p.get("name", name)
        frames |= {shown for key, shown in _NODE_LIBRARIES.items() if key in wants}
        kind = "monorepo" if "workspaces" in p else kind
        tool = _manager(names, _NODE, "npm")
    if "go.mod" in names and lang is None:
        lang = tool = "go"
        file = "go.mod"
        module = next((x.split() for x in (files[file] or "").splitlines() if x.startswith("module")), [])
        name = module[1].rsplit("/", 1)[-1] if len(module) > 1 else name
    dirs |= tops & set(SOURCE_DIRS)
    tests |= tops & set(TEST_DIRS)
    if not dirs and any("/" not in p and p.endswith((".cs", ".go", ".js", ".py", ".rs", ".ts")) for p in names):
        dirs.add(".")
    return [(name, lang, tool, file, sorted(frames), kind, sorted(dirs), sorted(tests))]


def overview(files: DataFrame) -> DataFrame:
    """project, name, primary_language, package_manager, package_file, frameworks, workspace_type, source_dirs, test_dirs."""
    fields = "name string, primary_language string, package_manager string, package_file string, frameworks array<string>, workspace_type string, source_dirs array<string>, test_dirs array<string>"
    return _by_project(files, None, fields, _overview)


def _by_project(files: DataFrame, work, fields: str, named=None) -> DataFrame:
    """work({path: source}) for each project; sources of configuration files, of the rest only the paths that matter."""
    f = with_project(files)
    p = F.col("path")
    top = dirname(p) == ""
    wanted = f.select("project", "path", F.when(top & p.isin(*CONFIGURATION), F.col("source")).alias("source"), top.alias("top")).filter(
        F.col("top") | dirname(p).isin("src", "ProjectSettings") | extension(p).isin(".py") | F.substring_index(p, "/", 1).isin(*SOURCE_DIRS, *TEST_DIRS, "Assets", "Packages")
    )
    names = [x.split()[0] for x in fields.split(", ")]

    def run(key, pdf):
        own = {path: source for path, source in zip(pdf["path"], pdf["source"])}
        rows = named(key[0], own) if named else work(own)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["project", *names])

    return wanted.select("project", "path", "source").groupBy("project").applyInPandas(run, f"project string, {fields}")

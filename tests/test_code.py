import pytest
from pyspark.sql import functions as F

from codeloom.catalog import QUERIES
from codeloom.functions import classify, paths, text
from codeloom.functions.ignore import ignored
from codeloom.operators import calls, parse, resolve, select, snapshots, trees
from codeloom.plans.analysis import analyze_files, analyze_tree
from codeloom.sources import manifest, project, tree
from codeloom.streaming.incremental import IncrementalTables, follow

PY = '''import os.path as p
from .models import User, Group as G

class Service:
    """Runs things."""

    def run(self, x):
        # call
        return helper(x).go(1)


def _hidden(a,
            b):
    return 1

def helper(x): return x
'''
TS = """import React from 'react';
import { a, b as c } from "./util";
import * as d from '../lib';
/** Adds. */
export function add(x: number) {
  const s = "}";
  return x;
}
export interface Shape { w: number }
const inner = (y) => { return add(y); };
"""
GO = '''package main
import (
\t"fmt"
\talias "os/exec"
)
// Runs it.
func (s *Server) Run(x int) {
\tfmt.Println("x")
}
type Server struct {
\tn int
}
'''


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, language string, source string")


@pytest.fixture(scope="module")
def code(spark):
    return files(spark, [("app/service.py", "python", PY), ("web/add.ts", "typescript", TS), ("srv/main.go", "go", GO), ("none.txt", None, "x"), ("null.py", "python", None)])


def test_chunks(code):
    got = {(r.path, r.type, r.name): r for r in parse.chunks(code).collect()}
    lines = {k[2]: (r.start_line, r.end_line, r.exported) for k, r in got.items()}
    assert lines == {"Service": (4, 6, True), "run": (7, 11, True), "_hidden": (12, 15, False), "helper": (16, 17, True), "add": (5, 8, True), "Shape": (9, 9, True), "inner": (10, 10, False), "Run": (7, 9, True), "Server": (10, 12, True)}
    assert got["app/service.py", "class", "Service"].docstring == "Runs things." and got["web/add.ts", "function", "add"].docstring == "Adds." and got["srv/main.go", "method", "Run"].docstring == "Runs it."
    assert got["app/service.py", "function", "_hidden"].signature == "def _hidden(a, b)" and got["web/add.ts", "function", "add"].signature == "export function add(x: number)"


def test_imports(code):
    got = {(r.module, tuple(r.symbols), r.alias, r.line) for r in parse.imports(code).collect()}
    assert got == {("os.path", (), "p", 1), (".models", ("User", "Group"), None, 2), ("react", ("React",), None, 1), ("./util", ("a", "b"), None, 2), ("../lib", (), "d", 3), ("fmt", (), None, 3), ("os/exec", (), "alias", 4)}


def test_anchors_outlive_comments_and_spaces():
    a = parse.normalized("def f(x):\n    # note\n    return  'a' + x\n", "python")
    assert a == parse.normalized('def f(x):\n\n    """doc"""\n    return "b" + x\n', "python") == 'I0:def f(x):\nI1:return "STR" + x'
    assert parse.normalized("f() { // x\n /* y\n z */ g(1_000); }", "javascript") == "B1:f() {\nB-1:g(1000); }"


def test_calls(spark, code):
    a = analyze_files(code)
    got = {(r.caller.rsplit(":", 1)[1], r.name, r.callee.rsplit(":", 1)[1] if r.callee else None) for r in a.calls(skip_definition=True).collect()}
    assert {("run", "helper", "helper"), ("run", "go", None), ("inner", "add", "add")} - got == {("inner", "add", "add")}  # its only line is its definition
    assert ("inner", "add", "add") in {(r.caller.rsplit(":", 1)[1], r.name, r.callee.rsplit(":", 1)[1] if r.callee else None) for r in a.calls().collect()}


def test_resolution(spark):
    f = files(spark, [(p, "python", "") for p in ("pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "other/a.py", "web/index.ts", "web/x/y.ts", "models.py")])
    i = spark.createDataFrame([("pkg/a.py", m) for m in ("pkg.sub.b", "pkg", "a", "pkg.nothing", "os", "nope", ".models")] + [("web/x/y.ts", m) for m in ("../index", "./y", "@scope/lib", "../../models")] + [("pkg/sub/b.py", "..a")], "path string, module string")
    got = {(r.path, r.module): (r.target, r.confidence, r.is_external) for r in resolve.resolve(i, f).collect()}
    assert got["pkg/a.py", "pkg.sub.b"] == ("pkg/sub/b.py", 1.0, False) and got["pkg/a.py", "pkg"] == ("pkg/__init__.py", 1.0, False)
    assert got["pkg/a.py", "a"][0] == "other/a.py"  # the first of the name
    assert got["pkg/a.py", "pkg.nothing"] == ("pkg/__init__.py", 0.7, False)
    assert got["pkg/a.py", "os"] == (None, 0.0, True) and got["pkg/a.py", "nope"] == (None, 0.3, False) and got["web/x/y.ts", "@scope/lib"] == (None, 0.0, True)
    assert got["web/x/y.ts", "../index"][0] == "web/index.ts" and got["web/x/y.ts", "../../models"][0] == "models.py"
    fixed = {(r.path, r.module): r.target for r in resolve.resolve(i, f, fix_python_relative=True).collect()}
    assert got["pkg/a.py", ".models"][0] is None and fixed["pkg/sub/b.py", "..a"] == "pkg/a.py"


@pytest.mark.parametrize("path,rules,want", [
    ("a/b.pyc", ["*.pyc"], True), ("a/b.py", ["*.pyc"], False), ("build/x/y", ["build/"], True), ("src/build/x", ["build/"], True), ("build", ["build/"], False), ("a/x/b/c", ["a/**/b"], False), ("a/x/b", ["a/**/b"], True),
    ("d/e.log", ["*.log", "!e.log"], False), ("d/e.log", ["!e.log", "*.log"], True), ("x/y/z.md", ["**/z.md"], True), ("x/y.txt", ["x/*.txt"], True), ("x/q/y.txt", ["x/*.txt"], True), ("y/x/y.txt", ["x/*.txt"], False),
])
def test_ignore(spark, path, rules, want):
    assert spark.range(1).select(ignored(F.lit(path), rules)).first()[0] is want


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for p, want in (("Assets/Plugins/a.cs", "vendor"), ("Assets/a.cs", "project-owned"), ("x.sln", "unity-generated"), ("Packages/m.json", "package"), ("src/generated_x/a.py", "generated"), ("src/a.py", "repository")):
        assert one(classify.ownership(F.lit(p))) == want
    for p, want in (("platform/x.py", "presentation"), ("src/api/x.py", "application"), ("src/models/x.py", "domain"), ("db/x.py", "infrastructure"), ("utils/x.py", "shared"), ("zzz/q.py", None)):
        assert one(classify.layer_from_path(F.lit(p))) == want
    for p, want in (("test_a.py", True), ("a_test.go", True), ("x/tests/y.py", True), ("a.spec.ts", True), ("testing.py", False), ("latest.py", False), ("test2.py", True)):
        assert one(classify.is_test_file(F.lit(p))) is want
    assert one(paths.extension(F.lit("a/.bashrc"))) == "" and one(paths.extension(F.lit("a.b/c.TAR.gz"))) == ".gz"
    assert one(paths.shorten(F.lit("a/very/long/path/with/many/parts/of/it.py"))) == ".../of/it.py" and one(paths.node_id(F.lit("1a/b-c.d"))) == "_1a_b_c_d"
    assert one(text.semantic_tokens(F.lit("parseHTTPFile_v2 parse"))) == ["parse", "httpfile", "v2"]
    assert one(classify.language(F.lit("run"), F.lit("#!/usr/bin/env python3"))) == "python" and one(classify.language(F.lit("a.TSX"))) == "typescript"


def brute_greedy(rows, budget, factor=select.DIVERSITY):
    left, picks, order = budget, [], sorted(rows, key=lambda r: (-r["base_score"] / r["tokens"], r["id"]))
    while True:
        def adjusted(r):
            f = sum(p["path"] == r["path"] for p in picks)
            n = sum(r["name"].lower().startswith(p["name"].lower()[:3]) or p["name"].lower().startswith(r["name"].lower()[:3]) for p in picks)
            t = sum(p["type"] == r["type"] for p in picks)
            return r["base_score"] * (1 - factor * (1 - 1 / ((1 + 0.5 * f) * (1 + 0.3 * n) * (1 + 0.1 * t))))

        order.sort(key=lambda r: -adjusted(r) / r["tokens"])
        fit = next((r for r in order if r["tokens"] <= left), None)
        if fit is None or left <= 0:
            return [p["id"] for p in picks]
        picks.append(fit)
        order.remove(fit)
        left -= fit["tokens"]


def chunk_rows(n=25):
    return [(f"c{k:02}", f"p{k % 4}", f"{'abc'[k % 3]}name{k % 5}", "fn" if k % 2 else "cls", k % 3 == 0, 20 + 13 * k % 90, "") for k in range(n)]


def test_selection(spark):
    c = spark.createDataFrame(chunk_rows(), "id string, path string, name string, type string, exported boolean, tokens long, description string")
    s = spark.createDataFrame([(f"p{k}", 0.1 + 0.2 * k) for k in range(4)], "id string, score double")
    p = select.prepare(c, s)
    got = [r.id for r in select.optimize(p, 300).orderBy("pick").collect()]
    assert got == brute_greedy([r.asDict() for r in p.collect()], 300)
    k = select.optimize(p, 300, "knapsack").collect()
    weight = {r.id: (max(1, r.tokens // 10), r.base_score) for r in p.collect()}
    best = [0.0] * 32
    for w, v in weight.values():
        for b in range(31, w - 1, -1):
            best[b] = max(best[b], best[b - w] + v)
    assert sum(r.base_score for r in k) == pytest.approx(best[31])
    two = select.optimize(p.withColumn("q", F.lit("x")).union(p.withColumn("q", F.lit("y"))), 300, query="q")
    assert [r.id for r in two.filter("q = 'y'").orderBy("pick").collect()] == got
    f = spark.createDataFrame([("a", 3.0, 500), ("b", 2.0, 5000), ("c", 1.0, 250)], "id string, score double, size_bytes long")
    assert [(r.id, r.used) for r in select.within_budget(f, 70).collect()] == [("a", 40), ("c", 60)]


def test_snapshots(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    old, new = t([("a", "1"), ("b", "2"), ("c", "3")]), t([("a", "1"), ("b", "9"), ("d", "4")])
    assert {r.path: r.state for r in snapshots.diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}
    assert tuple(snapshots.staleness(None, new).first()) == (True, 0, 3, 0) and tuple(snapshots.staleness(new, new).first()) == (False, 0, 0, 0)
    assert snapshots.source_hash(t([])).first()[0] == "0" * 16 and snapshots.hit_rate(t([]), old).first().hit_rate == 100.0


def test_trees(spark):
    f = spark.createDataFrame([("a/b/x.py", 1), ("a/y.ts", 2), ("z", 3)], "path string, size_bytes long")
    assert {r.directory: (r.file_count, r.extensions) for r in trees.directories(f).collect()} == {"": (1, {"": 1}), "a": (1, {".ts": 1}), "a/b": (1, {".py": 1})}
    assert {r.directory: (r.total_files, r.direct_files, r.subdirectories, r.size_bytes) for r in trees.rollup(f).collect()} == {"": (3, 1, 1, 6), "a": (2, 1, 1, 3), "a/b": (1, 1, 0, 1)}
    assert trees.render(f).splitlines() == ["./", "├── a/", "│   ├── b/", "│   │   └── x.py", "│   └── y.ts", "└── z"]
    assert [r.path for r in trees.similar_paths(f, "y.ts").collect()] == ["a/y.ts"]


@pytest.fixture(scope="module")
def project_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("project")
    put = {
        "pkg/__init__.py": "", "pkg/a.py": "from pkg.b import f\n\ndef g():\n    return f()\n", "pkg/b.py": "def f():\n    return 1\n", "node_modules/x/i.js": "x", "big.txt": "y" * 5000, "pic.png": "\x89PNG\0", "raw.dat": "a\0b", "tool": "#!/usr/bin/env node\n",
        "pyproject.toml": '[project]\nname = "demo"\ndependencies = ["flask>=2"]\n[project.scripts]\ngo = "pkg.a:g"\n[tool.pytest]\nx = 1\n', "uv.lock": "", "Makefile": "test: build\n\tgo\n.PHONY: x\nbuild:\n", "package.json": '{"name": "w", "scripts": {"test": "jest", "dev": "vite"}, "bin": "cli.js"}', "main.py": "", ".ctxignore": "# own\nskip/\n", "skip/s.py": "",
    }
    for name, body in put.items():
        p = d / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body.encode("latin-1"))
    return str(d)


def test_scan(spark, project_dir):
    log = {r.path: r for r in tree.scan_log(spark, project_dir, most_kb=4).collect()}
    assert log["pkg/__init__.py"].outcome == "ok" and log["node_modules/"].outcome == "ignored" and log["skip/"].outcome == "ignored" and log["big.txt"].outcome == "too_large" and log["raw.dat"].outcome == "binary"
    assert log["pic.png"].outcome == "ok" and log["pic.png"].is_binary  # listed, not read as text
    assert log["tool"].language == "javascript" and log["pkg/a.py"].language == "python" and len(log["pkg/a.py"].content_hash) == 16


def test_project_facts(spark, project_dir):
    f = tree.files(tree.scan_log(spark, project_dir))
    o = project.overview(f).first()
    assert (o.name, o.primary_language, o.package_manager, o.frameworks, o.source_dirs) == ("demo", "python", "uv", ["flask"], ["pkg"])
    assert {(r.path, r.type, r.name) for r in project.entry_points(f).collect()} == {("pkg/a.py", "cli", "go"), ("cli.js", "cli", "w"), ("main.py", "script", None)}
    assert {r.name: r.run_as for r in project.golden_commands(f).collect()} == {"test": "make test", "build": "make build"}
    assert {(r.name, r.run_as) for r in project.scripts(f).collect() if r.source == "package.json"} == {("test", "npm test"), ("dev", "npm run dev")}


def test_analysis_and_manifest(spark, project_dir, tmp_path):
    a = analyze_tree(spark, project_dir)
    assert [(r.src, r.dst) for r in a.graph.edges.collect()] == [("pkg/a.py", "pkg/b.py")]
    a.save(str(tmp_path / "m"))
    assert manifest.read_tables(spark, str(tmp_path / "m"))["chunks"].count() == 2
    manifest.write_json(a.tables(), str(tmp_path / "m.json"))
    t = manifest.read_json(spark, str(tmp_path / "m.json"))
    assert {r.name for r in t["chunks"].collect()} == {"f", "g"} and t["edges"].count() == 1
    assert manifest.project_stats({**t}).first().files == a.files.count()


def test_incremental(spark, tmp_path):
    incoming, t = str(tmp_path / "in"), IncrementalTables(spark, str(tmp_path / "tables"))
    rows = lambda r: spark.createDataFrame(r, "path string, language string, hash string, source string").coalesce(1).write.mode("append").parquet(incoming)
    rows([("a.py", "python", "1", "def f(): pass"), ("b.py", "python", "1", "def g(): pass")])
    run = lambda: follow(spark, incoming, t, str(tmp_path / "cp")).awaitTermination()
    run()
    assert {r.name for r in t.current("chunks").collect()} == {"f", "g"}
    rows([("a.py", "python", "2", "def h(): pass"), ("b.py", "python", None, None), ("c.py", "python", "1", "def k(): pass")])
    run()
    assert {r.name for r in t.current("chunks").collect()} == {"h", "k"} and {r.path for r in t.current("files").collect()} == {"a.py", "c.py"}
    t.write(spark.createDataFrame([("c.py", "python", "1", "def never(): pass")], "path string, language string, hash string, source string"), 5)
    assert {r.name for r in t.compact(str(tmp_path / "c")).current("chunks").collect()} == {"h", "k"}


def test_every_page_has_a_node(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r.node for r in QUERIES["page_node_ids"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    safe = {r.page_id: "".join("_" if c in "/.- ()[]" else c for c in r.url) for r in pages}
    assert got == {i: "_" + n if n[0] in "0123456789" else n for i, n in safe.items()}
    assert any(r.url.startswith("https:") for r in pages)

import json
import os
import warnings

import pytest

from codeloom import cli, errors, settings
from codeloom.sinks import maps, reports
from codeloom.sources import editor, freshness, game_project, lookup


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "pyproject.toml": '[project]\nname = "demo"\n[project.scripts]\nrun = "app.main:main"\n',
        "app/__init__.py": "",
        "app/main.py": "from app.util import helper\n\n\ndef main():\n    return helper(1)\n",
        "app/util.py": '"""Tools."""\n\n\ndef helper(x):\n    """Helps."""\n    return x\n',
        "app/deep/more.py": "import app.util\n\n\nclass More:\n    pass\n",
        "tests/test_main.py": "from app.main import main\n\n\ndef test_main():\n    assert main() == 1\n",
    }
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


# settings and errors


def test_settings_have_defaults_files_and_checks(tmp_path):
    assert settings.problems(settings.defaults()) == []
    assert settings.load(str(tmp_path)) == settings.defaults()
    (tmp_path / settings.FILE_NAME).write_text(json.dumps({"max_file_size_kb": 7, "odd": 1}))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = settings.load(str(tmp_path))
    assert found.max_file_size_kb == 7 and found.pagerank_damping == 0.85 and "odd" in str(said[0].message)
    (tmp_path / settings.FILE_NAME).write_text("{")
    with pytest.warns(UserWarning):
        assert settings.load(str(tmp_path)) == settings.defaults()


@pytest.mark.parametrize(
    "name,value", [("max_file_size_kb", 0), ("pagerank_damping", 1), ("pagerank_iterations", 0), ("chunk_max_lines", 1), ("unity_asset_scope", "some"), ("unity_agents_asset_limit", True), ("unity_editor_mode", "x"), ("unity_editor_required", 1), ("unity_editor_path", 3)]
)
def test_wrong_settings_are_named(name, value):
    (problem,) = settings.problems(settings.merged(settings.defaults(), {name: value}))
    assert name in problem
    assert settings.defaults().language_overrides is not settings.defaults().language_overrides


def test_errors_are_counted_and_reported(spark):
    rows = [("b.py", "parse", "odd", 3, True)] + [(f"a{k}.py", "encoding", "bytes", None, True) for k in range(5)]
    e = spark.createDataFrame(rows, errors.ERROR_FIELDS)
    assert errors.summary(e) == "Errors: 5 encoding, 1 parse" and errors.exit_code(e) == 1
    text = errors.report(e)
    assert "6 file(s)" in text and "... and 2 more" in text and "b.py:3: odd" in text
    assert errors.exit_code(e.limit(0)) == 0 and errors.summary(e.limit(0)) == "No errors or warnings" and errors.report(e.limit(0)) == ""
    assert errors.exit_code(e.union(spark.createDataFrame([("c", "permission", "no", None, False)], errors.ERROR_FIELDS))) == 2


# freshness and anchors


def test_stored_hashes_come_back(spark, tmp_path):
    files = spark.createDataFrame([("b", "2"), ("a", "1"), ("x/AGENTS.md", "9")], "path string, hash string")
    at = str(tmp_path)
    assert freshness.load(spark, at) is None
    state, diff = freshness.check(spark, at, files)
    assert state.first().added == 2
    freshness.save(files, at, "2024-01-01T00:00:00+00:00")
    head, stored = freshness.load(spark, at)
    assert head["file_count"] == 2 and head["generated_at"].startswith("2024") and sorted(map(tuple, stored.collect())) == [("a", "1"), ("b", "2")]
    now = spark.createDataFrame([("b", "3"), ("c", "1")], "path string, hash string")
    state, diff = freshness.check(spark, at, now)
    assert tuple(state.first()) == (True, 1, 1, 1)
    assert reports.staleness(diff) == "[stale] 1 modified, 1 added, 1 removed\n  ~ b\n  + c\n  - a"
    assert reports.staleness(freshness.check(spark, at, files)[1]) == "[fresh] nothing has changed"
    (tmp_path / freshness.FILE_NAME).write_text("{")
    assert freshness.load(spark, at) is None


def test_footers_tell_their_hash():
    text = freshness.footer("0123456789abcdef", "2024")
    assert freshness.footer_hash("x\n" + text) == "0123456789abcdef" and freshness.footer_hash("none") is None and freshness.footer_hash(None) is None


def test_anchors_keep_their_moves(spark, tmp_path):
    kind = "anchor string, path string, line int, location string"
    old = spark.createDataFrame([("x", "a.py", 1, "a.py:1"), ("y", "a.py", 9, "a.py:9"), ("z", "c.py", 2, "c.py:2")], kind)
    new = spark.createDataFrame([("x", "b.py", 4, "b.py:4"), ("y", "a.py", 9, "a.py:9"), ("n", "d.py", 1, "d.py:1")], kind)
    places, moves = freshness.update_anchors(old, new, "now")
    assert [tuple(r) for r in moves.collect()] == [("x", "a.py:1", "b.py:4", "now")]
    assert freshness.resolve_anchor(places, "x") == ("b.py", 4) and freshness.resolve_anchor(places, "z") == ("c.py", 2) and freshness.resolve_anchor(places, "?") is None
    freshness.write_anchors(places, moves, str(tmp_path))
    p, m = freshness.read_anchors(spark, str(tmp_path))
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, places.collect())) and m.count() == 1


# files


def test_file_facts_and_their_errors(spark, tree, tmp_path):
    info = lookup.file_info(spark, os.path.join(tree, "app/util.py"), tree)
    assert info["path"] == "app/util.py" and info["language"] == "python" and [c["name"] for c in info["chunks"]] == ["helper"] and info["chunks"][0]["docstring"] == "Helps."
    assert "helper (function)" in reports.file(info) and "| `helper` | function | 4-6 |" in reports.file(info, markdown=True)
    with pytest.raises(errors.PrimitiveError):
        lookup.file_info(spark, os.path.join(tree, "gone.py"))
    with pytest.raises(errors.ParseError):
        lookup.file_info(spark, tree)
    for name, data in (("a.py", b"\x00\x01"), ("a.unknown", b"text")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(errors.ParseError):
            lookup.file_info(spark, str(tmp_path / name))


def test_the_project_root_is_the_nearest_marked_folder(tree, tmp_path):
    assert lookup.project_root(os.path.join(tree, "app", "deep")) == tree == lookup.project_root(os.path.join(tree, "app/util.py"))
    assert lookup.line_of("a\n  b", 2) == "b" and lookup.line_of("a", 5) == "" and lookup.docstring_after('def f():\n    """D."""', 1) == "D."


# maps


def test_summaries_are_checked(tmp_path):
    assert maps.parse_summary("./a/b/ = two  words") == ("a/b", "two words")
    for bad in ("a", "/x=y", "../x=y", "C:/x=y", "a=", "a=" + "x" * 241):
        with pytest.raises(ValueError):
            maps.parse_summary(bad)
    assert maps.load_summaries(str(tmp_path)) == {}
    maps.save_summaries(str(tmp_path), {"": "root", "a": "b"})
    assert maps.load_summaries(str(tmp_path)) == {"": "root", "a": "b"}
    maps.save_summaries(str(tmp_path), {})
    assert not os.path.exists(tmp_path / maps.SUMMARIES)


def test_managed_blocks_leave_the_rest(tmp_path):
    at = tmp_path / maps.NAME
    block = f"{maps.BEGIN}\nnew\n{maps.END}\n"
    assert maps.merged("", block) == block
    assert maps.merged("mine\n", block) == "mine\n\n" + block
    assert maps.merged(f"mine\n\n{maps.BEGIN}\nold\n{maps.END}\n\nafter\n", block) == f"mine\n\n{maps.BEGIN}\nnew\n{maps.END}\n\nafter\n"
    at.write_text("mine\n\n" + block)
    assert maps.remove_map(str(at)) and at.read_text() == "mine\n" and not maps.remove_map(str(at))
    at.write_text(block)
    assert maps.remove_map(str(at)) and not at.exists() and not maps.remove_map(str(at))


# editor snapshots


def test_editor_snapshots_are_missing_corrupt_stale_or_fresh(spark, tmp_path):
    root, at = str(tmp_path), str(tmp_path / "snap.json")
    for name, text in ((editor._VERSION, "m_EditorVersion: 6000.0.1\n"), ("Assets/a.mat", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert editor.status(at, root)[0] == "missing"
    (tmp_path / "snap.json").write_text("{")
    assert editor.status(at, root)[0] == "corrupt"
    good = {"schema_version": editor.SCHEMA_VERSION, "bridge_version": editor.BRIDGE_VERSION, "unity_version": "6000.0.1", "source_hash": editor.source_hash(root), "package_lock_hash": editor.lock_hash(root)}
    good |= {"assets": [{"path": "Assets\\a.mat", "guid": "AB", "facts": [{"key": "shader", "value": "Lit"}], "subassets": [{"local_id": "7", "name": "s", "facts": []}, {"name": "none"}]}], "scripts": [{"guid": "CD", "path": "p.cs", "qualified_type": "N.P"}]}
    (tmp_path / "snap.json").write_text(json.dumps(good))
    assert editor.status(at, root) == ("fresh", [])
    t = editor.read(spark, at)
    a = t["assets"].first()
    assert (a.path, a.guid, a.facts) == ("Assets/a.mat", "ab", {"shader": "Lit"}) and t["scripts"].first().guid == "cd"
    assert [(r.guid, r.local_id) for r in t["subassets"].collect()] == [("ab", "7")]
    (tmp_path / "Assets/a.mat").write_text("longer")
    (tmp_path / "snap.json").write_text(json.dumps(good | {"status": "failed", "bridge_version": "0"}))
    assert editor.status(at, root) == ("stale", ["bridge version mismatch", "project assets changed", "editor export reported failure"])


def test_stored_analyses_are_gated(tmp_path):
    at = str(tmp_path)
    assert editor.manifest_problems(at, "1", "s", "h") == ["no stored analysis"]
    (tmp_path / "manifest.json").write_text(json.dumps({"meta": {"version": "1", "generated_at": "t", "config_hash": "s"}}))
    assert editor.manifest_problems(at, "2", "s", "h") == ["schema 1 instead of 2"] and editor.manifest_problems(at, "1", "s", "h") == ["no freshness data"]
    (tmp_path / "staleness.json").write_text(json.dumps({"generated_at": "t", "source_hash": "h"}))
    assert editor.manifest_problems(at, "1", "s", "h") == [] and len(editor.manifest_problems(at, "1", "?", "?")) == 2


# game projects


def game(spark):
    rows = [
        (game_project.VERSION_FILE, "m_EditorVersion: 6000.0.1f1\n"), (game_project.SETTINGS_FILE, "PlayerSettings:\n  companyName: Us\n  productName: Demo\n  bundleVersion: \n"),
        (game_project.PACKAGES_FILE, json.dumps({"dependencies": {"com.a": "1.0.0", "com.b": "file:../libs/b", "com.c": "https://x.com/c.git"}})),
        (game_project.BUILD_FILE, "  - enabled: 1\n    path: Assets/One.unity\n  - enabled: 0\n    path: Assets/Two.unity\n"),
        ("Assets/One.unity", "%YAML"), ("Assets/Plugins/Lib/Three.unity", "%YAML"), ("Assets/Core/Core.asmdef", json.dumps({"name": "Core", "references": ["X"], "autoReferenced": False})), ("Assets/Bad.asmdef", "{"),
        ("Assets/Tests/A.cs", ""), ("Assets/PlayerTest.cs", ""), ("Assets/Plugins/Lib/test_x.cs", ""), ("Assets/Tests/A.cs.meta", ""),
        ("Library/ScriptAssemblies/Core.dll", None), ("Library/ScriptAssemblies/Other.dll", None), ("Library/ScriptAssemblies/Assembly-CSharp.dll", None),
        ("Game.csproj", "<HintPath>libs\\Third.dll</HintPath><HintPath>$(V)/Gone.dll</HintPath>"),
    ]
    return spark.createDataFrame(rows, "path string, source string")


def test_game_projects_tell_their_facts(spark):
    f = game(spark)
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(game_project.settings(f)) == [("company_name", "Us"), ("product_name", "Demo"), ("unity_version", "6000.0.1f1")]
    assert got(game_project.packages(f)) == [("com.a", "1.0.0", "registry"), ("com.b", "file:b", "local"), ("com.c", "https://x.com/c.git", "git")]
    assert got(game_project.scenes(f)) == [("Assets/One.unity", True, True, "project-owned"), ("Assets/Plugins/Lib/Three.unity", False, False, "vendor"), ("Assets/Two.unity", False, True, "project-owned")]
    assert got(game_project.assemblies(f)) == [("Assets/Core/Core.asmdef", "Core", ["X"], False)]
    assert [r.path for r in game_project.test_files(f).collect()] == ["Assets/PlayerTest.cs", "Assets/Tests/A.cs"] and [r.path for r in game_project.test_files(f, "vendor").collect()] == ["Assets/Plugins/Lib/test_x.cs"]
    assert [r.root for r in game_project.owner_roots(f, "vendor").collect()] == ["Assets/Plugins"]
    assert got(game_project.hint_paths(f)) == [("Game.csproj", "libs/Third.dll")]
    assert got(game_project.reference_assemblies(f)) == [("Library/ScriptAssemblies/Other.dll",), ("libs/Third.dll",)]
    assert game_project.settings(f.limit(0)).count() == game_project.packages(f.limit(0)).count() == game_project.scenes(f.limit(0)).count() == 0


# the command line


def run(spark, capsys, tree, *args):
    code = cli.main(["--root", tree, *args], spark)
    return code, capsys.readouterr().out


def test_the_command_line_from_scan_to_clean(spark, tree, capsys):
    do = lambda *args: run(spark, capsys, tree, *args)
    assert do("stats")[0] == 2  # nothing stored yet
    code, out = do("scan")
    assert code == 0 and "files: 6" in out
    assert do("verify") == (0, "[fresh] nothing has changed\n")
    code, out = do("stats")
    assert code == 0 and "app/util.py" in out and "No circular dependencies." in out
    assert json.loads(do("stats", "--json")[1])["graph"]["edge_count"] == 3
    code, out = do("focus", "app/main.py", "--format", "json")
    assert {r["id"] for r in json.loads(out)} >= {"app/main.py", "app/util.py", "tests/test_main.py"}
    assert "`app/util.py`" in do("focus", "./app/main.py")[1] and do("focus", "app/mian.py")[0] == 2
    assert "-> app/util.py" in do("deps", "app/main.py", "--format", "human")[1]
    assert do("graph")[1].startswith("graph") and "digraph" in do("graph", "--format", "dot")[1]
    assert "Call Graph" in do("graph", "--kind", "calls", "--format", "markdown")[1]
    assert "tokens" in do("optimize", "--budget", "500")[1]
    for name in ("overview", "tree", "scripts", "entries"):
        code, out = do(name, "--format", "json" if name in ("overview", "scripts") else "human")
        assert code == 0 and out.strip()
    assert "| Directory |" in do("tree", "--format", "markdown")[1]
    assert json.loads(do("file", os.path.join(tree, "app/util.py"))[1])["language"] == "python"
    assert do("editor")[0] == 1
    code, out = do("agents", "--summary", "app=The program.")
    assert code == 0 and "written: 4" in out
    with open(os.path.join(tree, "app", maps.NAME)) as f:
        text = f.read()
    assert "[`util.py`](util.py)" in text and "](more.py)" not in text and "**Responsibility:** The program." in text
    with open(os.path.join(tree, maps.NAME)) as f:
        assert freshness.footer_hash(f.read())
    with open(os.path.join(tree, "app/util.py"), "a") as f:
        f.write("\nX = 1\n")
    assert do("verify")[0] == 1
    assert do("clean", "--maps")[0] == 0 and not os.path.exists(os.path.join(tree, ".codeloom")) and not os.path.exists(os.path.join(tree, "app", maps.NAME))

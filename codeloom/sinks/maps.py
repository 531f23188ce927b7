"""Maps of a tree for its readers: one managed block of Markdown in each directory.

What a map shows is chosen by Spark, for all directories at once: the files of a
directory that come first by summary, centrality and path, its children, calls taken
from its files in turn.  The driver only joins the chosen rows to text and writes them,
one directory after the other.  Text outside the block is left as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import ownership
from ..functions.paths import ancestors, basename, dirname
from ..operators.graph import CodeGraph

BEGIN, END = "<!-- codeloom:begin -->", "<!-- codeloom:end -->"
NAME = "AGENTS.md"
SUMMARIES = ".ctx-summaries.json"
MOST_SUMMARY = 240
LEAST_FILES = 30
_BLOCK = re.compile(re.escape(BEGIN) + r".*?" + re.escape(END), re.DOTALL)

# summaries: one short text for a path


def summary_path(path: str) -> str:
    """A path below the root; '' is the root itself."""
    parts = [p for p in path.strip().replace("\\", "/").rstrip("/").split("/") if p != "."]
    if path.strip().startswith(("/", "\\")) or ".." in parts or re.match(r"[A-Za-z]:", path.strip()):
        raise ValueError("a summary's path must be relative to the root")
    return "/".join(parts)


def summary_text(text: str) -> str:
    text = " ".join(text.split())
    if not 0 < len(text) <= MOST_SUMMARY:
        raise ValueError(f"a summary has 1 to {MOST_SUMMARY} characters")
    return text


def parse_summary(assignment: str) -> tuple[str, str]:
    """PATH=TEXT"""
    path, sign, text = assignment.partition("=")
    if not sign:
        raise ValueError("a summary is given as PATH=TEXT")
    return summary_path(path), summary_text(text)


def load_summaries(root: str) -> dict[str, str]:
    at = os.path.join(root, SUMMARIES)
    if not os.path.exists(at):
        return {}
    try:
        with open(at, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as e:
        raise ValueError(f"{SUMMARIES}: {e}") from e
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise ValueError(f"{SUMMARIES} must map paths to texts")
    return {summary_path(k): summary_text(v) for k, v in found.items()}


def save_summaries(root: str, summaries: dict[str, str]) -> None:
    at = os.path.join(root, SUMMARIES)
    if summaries:
        with open(at, "w", encoding="utf-8") as f:
            json.dump({k or ".": v for k, v in sorted(summaries.items())}, f, ensure_ascii=False, indent=2)
    elif os.path.exists(at):
        os.remove(at)


# what is shown


def key_files(files: DataFrame, scores: DataFrame, k: int = 12) -> DataFrame:
    """path, score of the k most central files in a language that belong to the project."""
    own = files.filter(F.col("language").isNotNull() & (F.col("language") != "") & ~F.col("path").endswith(".meta") & ownership(F.col("path")).isin("project-owned", "repository"))
    return own.join(scores.select(F.col("id").alias("path"), "score"), "path").select("path", "score").orderBy(F.desc("score"), "path").limit(k)


def in_turn(rows: DataFrame, group: str, order: list, k: int = 15) -> DataFrame:
    """The first row of every group, then the second of every group and so on, k rows in all, with their place.

    Of a group at most k rows can be taken, so no more are kept; the rest is a top-k.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= k).orderBy("turn", group).limit(k).withColumn("place", F.row_number().over(Window.orderBy("turn", group)))  # k rows


def directory_set(files: DataFrame, most_depth: int = -1) -> DataFrame:
    """directory of every map: all directories above a file, down to vendor and generated ones, which get no map."""
    d = files.filter(~ownership(F.col("path")).isin("vendor", "generated")).select(F.explode(ancestors(F.col("path"))).alias("directory")).distinct()
    return d if most_depth < 0 else d.filter(F.size(F.split("directory", "/")) <= most_depth)


def file_rows(files: DataFrame, graph: CodeGraph, scores: DataFrame, exports: DataFrame, metrics: DataFrame, summaries: DataFrame) -> DataFrame:
    """directory, place, hidden, path, owner, summary, api, dependencies, dependents, metrics of the files that maps show.

    summaries(path, summary).  Files with a summary come first, then by centrality and
    path; LEAST_FILES are shown, or all with a summary if those are more.
    """
    shown = files.filter((basename(F.col("path")) != NAME) & ~F.col("path").endswith(".meta")).select("path", dirname(F.col("path")).alias("directory"), ownership(F.col("path")).alias("owner"))
    shown = shown.join(scores.select(F.col("id").alias("path"), "score"), "path", "left").join(summaries, "path", "left")
    own = Window.partitionBy("directory")
    place = F.row_number().over(own.orderBy(F.col("summary").isNull(), F.desc(F.coalesce("score", F.lit(0.0))), "path"))
    limit = F.greatest(F.lit(LEAST_FILES), F.count("summary").over(own))
    chosen = shown.withColumns({"place": place, "limit": limit, "total": F.count(F.lit(1)).over(own)}).filter("place <= limit")
    first = lambda df, key, value, name: df.groupBy(F.col(key).alias("path")).agg(F.slice(F.sort_array(F.collect_set(value)), 1, 5).alias(name))
    api = first(exports.join(chosen.select("path"), "path", "left_semi"), "path", "name", "api")
    out = first(graph.edges.join(chosen.select(F.col("path").alias("src")), "src", "left_semi"), "src", "dst", "dependencies")
    into = graph.edges.join(chosen.select(F.col("path").alias("dst")), "dst", "left_semi")
    turn = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    into = first(into.withColumn("turn", turn).filter("turn <= 5"), "dst", "src", "dependents")
    cell = F.format_string("%d/%d/%.2f/%.2f/%.2f", "ca", "ce", "i", "a", "d")
    for part in (api, out, into, metrics.select(F.col("id").alias("path"), cell.alias("metrics"))):
        chosen = chosen.join(part, "path", "left")
    return chosen.select("directory", "place", (F.col("total") - F.least("total", "limit")).alias("hidden"), "path", "owner", "summary", "api", "dependencies", "dependents", "metrics")


def runtime_score(assets: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """path, score of assets(path, high_signal, scripts, events, states, transitions): what a map shows first."""
    score = F.coalesce("high_signal", F.lit(0)) + F.size("scripts") * 20 + F.size("events") * 30 + F.coalesce("states", F.lit(0)) * 2 + F.coalesce("transitions", F.lit(0))
    if scenes is None:
        return assets.select("path", score.alias("score"))
    built = scenes.select("path").distinct().withColumn("built", F.lit(50))
    return assets.join(built, "path", "left").select("path", (score + F.coalesce("built", F.lit(0))).alias("score"))


# text and files


@dataclass
class Written:
    """Paths of maps, by what became of them."""

    written: list[str] = field(default_factory=list)
    unchanged: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def merged(text: str, block: str) -> str:
    """text with its managed block replaced, or with the block after it."""
    if _BLOCK.search(text):
        return _BLOCK.sub(lambda _: block.rstrip(), text).rstrip() + "\n"
    return block if not text.strip() else text.rstrip() + "\n\n" + block


def without_block(text: str) -> str:
    return _BLOCK.sub("", text).strip()


def remove_map(path: str) -> bool:
    """Takes the managed block out of a file, and the file away if nothing else is in it."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return False
    if not _BLOCK.search(text):
        return False
    rest = without_block(text)
    if rest:
        with open(path, "w", encoding="utf-8") as f:
            f.write(rest + "\n")
    else:
        os.remove(path)
    return True


def _cell(x) -> str:
    return " ".join((", ".join(x) if isinstance(x, list) else str(x or "—")).split()).replace("|", "\\|") or "—"


def block(directory: str, rows: Iterable, children: list[str], summaries: dict[str, str], extra: list[str] = ()) -> str:
    """The managed block of one directory from its file_rows() and children."""
    rows = sorted(rows, key=lambda r: r.place)
    lines = [BEGIN, f"## Folder map: {directory or 'repository'}", ""]
    if directory in summaries:
        lines += [f"**Responsibility:** {_cell(summaries[directory])}", ""]
    lines += [*extra, ""] if extra else []
    if children:
        lines += ["### Child folders", "", "| Folder | Summary |", "|---|---|"]
        lines += [f"| [`{c.rsplit('/', 1)[-1]}/`]({quote(c.rsplit('/', 1)[-1], safe='')}/{NAME}) | {_cell(summaries.get(c))} |" for c in sorted(children)] + [""]
    if rows:
        lines += ["### Files", "", "| File | Boundary | Responsibility | Public API | Dependencies / dependents | Ca/Ce/I/A/D |", "|---|---|---|---|---|---|"]
        for r in rows:
            name = r.path.rsplit("/", 1)[-1]
            lines.append(f"| [`{_cell(name)}`]({quote(name, safe='._-~')}) | {r.owner} | {_cell(r.summary)} | {_cell(r.api)} | {_cell(r.dependencies)} / {_cell(r.dependents)} | {r.metrics or '—'} |")
        lines += [f"| … | — | {rows[0].hidden} more files | — | — | — |"] * (rows[0].hidden > 0) + [""]
    lines += [f"Parent map: [`../{NAME}`](../{NAME})"] if directory else ["Read the maps from the root down. Keep your own notes outside this block."]
    return "\n".join([*lines, "", END, ""])


def write_maps(spark: SparkSession, analysis, root: str, most_depth: int = -1, dry_run: bool = False, footer: str = "") -> Written:
    """One map in every directory of an analysed tree; blocks in directories that have none any more go."""
    summaries = load_summaries(root)
    table = spark.createDataFrame(list(summaries.items()), "path string, summary string")
    ranks = analysis.graph.pagerank()
    rows = file_rows(analysis.files, analysis.graph, ranks, analysis.exports, analysis.coupling(), table)
    wanted = directory_set(analysis.files, most_depth)
    directories = sorted(r.directory for r in wanted.collect())  # one short text a directory
    below: dict[str, list[str]] = {}
    for d in directories:
        if d:
            below.setdefault(d.rpartition("/")[0], []).append(d)
    key = ["### Key files", "", *(f"- `{r.path}` {r.score:.6f}" for r in key_files(analysis.files, ranks).collect())]
    done = Written()
    pending = iter(rows.join(wanted, "directory").orderBy("directory", "place").toLocalIterator())
    row = next(pending, None)
    for d in directories:
        own = []
        while row is not None and row.directory == d:
            own.append(row)
            row = next(pending, None)
        extra = [*key, *footer.splitlines()] if not d else []
        _write(os.path.join(root, d, NAME), f"{d}/{NAME}".lstrip("/"), block(d, own, below.get(d, []), summaries, extra), dry_run, done)
    kept = set(directories)
    for at, _, names in os.walk(root):
        d = os.path.relpath(at, root).replace(os.sep, "/")
        if NAME in names and ("" if d == "." else d) not in kept:
            target = os.path.join(at, NAME)
            with open(target, encoding="utf-8", errors="replace") as f:
                managed = _BLOCK.search(f.read())
            if managed and (dry_run or remove_map(target)):
                done.removed.append(f"{d}/{NAME}".removeprefix("./"))
    return done


def _write(target: str, name: str, text: str, dry_run: bool, done: Written) -> None:
    try:
        old = ""
        if os.path.exists(target):
            with open(target, encoding="utf-8") as f:
                old = f.read()
        new = merged(old, text)
        if new == old:
            done.unchanged.append(name)
            return
        if not dry_run:
            with open(target, "w", encoding="utf-8") as f:
                f.write(new)
        done.written.append(name)
    except OSError as e:
        done.errors.append(f"{name}: {e}")

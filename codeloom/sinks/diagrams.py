"""Graph exports as diagrams and JSON.

What a diagram shows is bounded (the top nodes, some files a group), so selection and
edge lines are plans and only their few rows are put together on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import LAYERS, diagram_layer, directory_group
from ..functions.paths import escape_label, node_id, shorten
from ..operators.graph import CodeGraph

HIGH = 0.05
_CYCLE_CLASS = "    classDef cycleNode fill:#faa,stroke:#f00,stroke-width:2px"


def shown_nodes(graph: CodeGraph, scores: DataFrame | None, most: int) -> DataFrame:
    """The nodes of a diagram: all, or those with the best scores, or without scores the first by id."""
    if scores is None:
        return graph.nodes.orderBy("id").limit(most)
    s = graph.nodes.join(scores.select("id", "score"), "id", "left").fillna(0.0, ["score"])
    return s.orderBy(F.desc("score"), "id").limit(most).select("id")


def _marked_edges(graph: CodeGraph, shown: DataFrame, cycles: DataFrame | None) -> DataFrame:
    """src, dst, in_cycle of the edges among shown(id); cycles(component, id)."""
    e = graph.edges if shown is graph.nodes else graph.subgraph(shown).edges
    if cycles is None:
        return e.withColumn("in_cycle", F.lit(False))
    a, b = (cycles.select(F.col("id").alias(c), F.col("component").alias(k)) for c, k in (("src", "ca"), ("dst", "cb")))
    return e.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("in_cycle"))


def mermaid_edges(graph: CodeGraph, shown: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """line: the edges among shown(id) in the diagram language; those of a cycle are dashed."""
    arrow = F.when(F.col("in_cycle"), " -.->|cycle| ").otherwise(" --> ")
    return _marked_edges(graph, shown, cycles).select(F.concat(F.lit("    "), node_id(F.col("src")), arrow, node_id(F.col("dst"))).alias("line"))


def _sorted_edges(graph: CodeGraph, shown: DataFrame, cycles: DataFrame | None) -> list:
    e = _marked_edges(graph, shown, cycles).select("src", "dst", "in_cycle", node_id(F.col("src")).alias("a"), node_id(F.col("dst")).alias("b"))
    return sorted(e.collect(), key=lambda r: (r.src, r.dst))


def _nodes(graph: CodeGraph, shown: DataFrame, scores: DataFrame | None, width: int = 30) -> list:
    s = shown.join(scores.select("id", "score"), "id", "left") if scores is not None else shown.withColumn("score", F.lit(None).cast("double"))
    rows = s.select("id", "score", node_id(F.col("id")).alias("node"), shorten(F.col("id"), width).alias("label"), escape_label(shorten(F.col("id"), width)).alias("escaped"))
    return sorted(rows.collect(), key=lambda r: r.id)


def mermaid(graph: CodeGraph, scores: DataFrame | None = None, cycles: DataFrame | None = None, most: int = 50, direction: str = "LR", labels: bool = True) -> str:
    shown = shown_nodes(graph, scores, most)
    rows = _nodes(graph, shown, scores)
    high = [r.node for r in rows if r.score is not None and r.score > HIGH]
    text = [f"graph {direction}"]
    for r in rows:
        body = r.label if labels else r.node
        text.append(f'    {r.node}[("{body}")]' if r.node in high else f'    {r.node}["{body}"]')
    text += [f"    {e.a} {'-.->|cycle|' if e.in_cycle else '-->'} {e.b}" for e in _sorted_edges(graph, shown, cycles)]
    text += ["", "    classDef highCentrality fill:#f9f,stroke:#333,stroke-width:2px"]
    if high:
        text.append(f"    class {','.join(high)} highCentrality")
    return "\n".join(text)


def dot(graph: CodeGraph, scores: DataFrame | None = None, cycles: DataFrame | None = None, most: int = 100, rankdir: str = "LR") -> str:
    shown = shown_nodes(graph, scores, most)
    text = ["digraph dependencies {", f"    rankdir={rankdir};", '    node [shape=box, fontname="Arial"];', '    edge [fontname="Arial", fontsize=10];', ""]
    for r in _nodes(graph, shown, scores):
        facts = [f'label="{r.escaped}"']
        if scores is not None:
            score = r.score or 0.0
            facts.append(f"width={0.5 + 5 * score:.2f}")
            if score > HIGH:
                facts += ["style=filled", f'fillcolor="{"#ff9999" if score > 2 * HIGH else "#ffcccc"}"']
        text.append(f'    "{r.id}" [{", ".join(facts)}];')
    text.append("")
    for e in _sorted_edges(graph, shown, cycles):
        text.append(f'    "{e.src}" -> "{e.dst}"' + (' [color=red, style=dashed, label="cycle"];' if e.in_cycle else ";"))
    return "\n".join([*text, "}"])


def json_rows(graph: CodeGraph, scores: DataFrame | None = None, layers: DataFrame | None = None) -> DataFrame:
    """id, label, centrality, layer, in_degree, out_degree of every node."""
    df = graph.degrees()
    df = df.join(scores.select("id", F.col("score").alias("centrality")), "id", "left").fillna(0.0, ["centrality"]) if scores is not None else df.withColumn("centrality", F.lit(None).cast("double"))
    df = df.join(layers.select("id", "layer"), "id", "left") if layers is not None else df.withColumn("layer", F.lit(None).cast("long"))
    return df.select("id", shorten(F.col("id")).alias("label"), "centrality", "layer", "in_degree", "out_degree")


def to_json(graph: CodeGraph, scores: DataFrame | None = None, layers: DataFrame | None = None, cycles: DataFrame | None = None, pretty: bool = True) -> str:
    """The whole graph as one JSON text, for graphs that a viewer can hold; larger ones are written from json_rows()."""
    nodes = [r.asDict() for r in sorted(json_rows(graph, scores, layers).collect(), key=lambda r: r.id)]
    edges = [{"source": r.src, "target": r.dst} for r in sorted(graph.edges.collect())]
    out = {"nodes": nodes, "edges": edges, "stats": {"node_count": len(nodes), "edge_count": len(edges)}}
    if cycles is not None and (groups := _cycle_lists(cycles)):
        out["cycles"] = groups
    return json.dumps(out, indent=2 if pretty else None)


def _cycle_lists(cycles: DataFrame, most: int | None = None) -> list[list]:
    g = cycles.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("component")
    return [r.ids for r in (g if most is None else g.limit(most)).collect()]


def export(graph: CodeGraph, form: str = "mermaid", scores: DataFrame | None = None, cycles: DataFrame | None = None, layers: DataFrame | None = None, most: int = 50) -> str:
    kind = form.lower()
    if kind == "mermaid":
        return mermaid(graph, scores, cycles, most)
    if kind in ("dot", "graphviz"):
        return dot(graph, scores, cycles, most)
    if kind == "json":
        return to_json(graph, scores, layers, cycles)
    raise ValueError(f"no export as {form!r}; there are mermaid, dot and json")


def _grouped(graph: CodeGraph, groups: DataFrame, order: list, most: int, cycles: DataFrame | None, width: int = 25) -> list:
    """group, id, node, label, rank, size, in_cycle of the first ``most`` of each group(id, group)."""
    by = Window.partitionBy("group")
    df = groups.withColumns({"rank": F.row_number().over(by.orderBy(*order)), "size": F.count(F.lit(1)).over(by)}).filter(F.col("rank") <= most)
    if cycles is not None:
        df = df.join(cycles.select("id", F.lit(True).alias("in_cycle")).distinct(), "id", "left").fillna(False, ["in_cycle"])
    else:
        df = df.withColumn("in_cycle", F.lit(False))
    return df.select("group", "id", node_id(F.col("id")).alias("node"), shorten(F.col("id"), width).alias("label"), "rank", "size", "in_cycle").collect()


def architecture(graph: CodeGraph, groups: DataFrame | None = None, cycles: DataFrame | None = None, most: int = 10, direction: str = "TB") -> str:
    """Files by layer (by directory where layers tell too little), edges among those shown."""
    if groups is None:
        groups = graph.nodes.select("id", diagram_layer(F.col("id")).alias("group"))
        if groups.select("group").distinct().count() <= 2:
            groups = graph.nodes.select("id", directory_group(F.col("id")).alias("group"))
    rows = _grouped(graph, groups, ["id"], most, cycles)
    known = [*LAYERS, "other"]
    text = [f"graph {direction}"]
    for g in sorted({r.group for r in rows}, key=lambda g: (known.index(g) if g in known else len(known), g)):
        own = sorted((r for r in rows if r.group == g), key=lambda r: r.id)
        text += _box(g_id := _safe(g), g.replace("_", " ").title(), own)
        if own[0].size > most:
            text.append(f'        more_{g_id}[("...{own[0].size - most} more")]')
        text.append("    end")
    text.append("")
    shown = graph.spark.createDataFrame([(r.id,) for r in rows], "id string")
    text += [f"    {e.a} {'-.-o|cycle|' if e.in_cycle else '-->'} {e.b}" for e in _sorted_edges(graph, shown, cycles)]
    return "\n".join([*text, "", _CYCLE_CLASS])


def _safe(name: str) -> str:
    out = "".join("_" if c in "/.- ()[]" else c for c in name)
    return "_" + out if out[:1].isdigit() else out


def _box(name: str, title: str, rows: list) -> list[str]:
    return [f'    subgraph {name}["{title}"]', *(f'        {r.node}["{r.label}"]' + (":::cycleNode" if r.in_cycle else "") for r in rows)]


def layer_diagram(graph: CodeGraph, layers: DataFrame | None = None, cycles: DataFrame | None = None, most: int = 8) -> str:
    """Topological layers, in each the files with most dependents."""
    layers = graph.layers(condense=False) if layers is None else layers
    groups = layers.join(graph.degrees().select("id", "in_degree"), "id").select("id", F.col("layer").alias("group"), "in_degree")
    rows = _grouped(graph, groups, [F.desc("in_degree"), "id"], most, cycles)
    last = max((r.group for r in rows), default=0)
    text = ["graph TB"]
    for g in sorted({r.group for r in rows}):
        own = sorted((r for r in rows if r.group == g), key=lambda r: r.rank)
        title = {0: "Foundation (no imports)", 1: "Core Utilities"}.get(g, "Application Layer" if g == last else f"Layer {g}")
        text += _box(f"layer_{g}", title, own)
        if own[0].size > most:
            text.append(f'        more_layer_{g}[("...{own[0].size - most} more")]')
        text.append("    end")
    text.append("")
    shown = graph.spark.createDataFrame([(r.id,) for r in rows], "id string")
    text += [f"    {e.a} --> {e.b}" for e in _sorted_edges(graph, shown, None)]
    return "\n".join([*text, "", _CYCLE_CLASS])


def cycle_diagram(graph: CodeGraph, cycles: DataFrame, most: int = 5) -> str:
    """The files of the first cycles and the edges among them."""
    groups = _cycle_lists(cycles)
    if not groups:
        return 'graph LR\n    no_cycles["No circular dependencies detected ✓"]:::good\n    classDef good fill:#afa,stroke:#0a0'
    ring = {(x, g[(k + 1) % len(g)]) for g in groups[:most] for k, x in enumerate(g)}
    ids = sorted({x for g in groups[:most] for x in g})
    shown = graph.spark.createDataFrame([(x,) for x in ids], "id string")
    text = ["graph LR", *(f'    {r.node}["{r.label}"]:::cycleNode' for r in _nodes(graph, shown, None, 25)), ""]
    text += [f"    {_safe(a)} ==>|cycle| {_safe(b)}" for a, b in sorted(ring)]
    text += [f"    {e.a} --> {e.b}" for e in _sorted_edges(graph, shown, None) if (e.src, e.dst) not in ring]
    text += ["", _CYCLE_CLASS]
    if len(groups) > most:
        text.append(f'    note["...and {len(groups) - most} more cycles"]')
    return "\n".join(text)


def diagram(graph: CodeGraph, kind: str = "architecture", layers: DataFrame | None = None, cycles: DataFrame | None = None, groups: DataFrame | None = None) -> str:
    name = kind.lower()
    if name == "architecture":
        return architecture(graph, groups, cycles)
    if name == "layers":
        return layer_diagram(graph, layers, cycles)
    if name == "cycles":
        return cycle_diagram(graph, graph.cycles() if cycles is None else cycles)
    raise ValueError(f"no diagram {kind!r}; there are architecture, layers and cycles")

"""Directed graphs as two tables: nodes(id) and distinct edges(src, dst).

Degree, density, neighbour and set operators are plain relational plans.  The
fixpoints (reachability, PageRank, components, layers, betweenness) have two ways:
graphs of at most SMALL_EDGES edges and as many nodes are fetched once and solved in
numpy on the driver, larger ones run as loops of joins whose state is cut to the shared
folder.  There what leads only to nodes with one edge out at most is solved first, by
pointers that double (chains.py), in rounds that grow with the logarithm of the depth;
only the rest takes a round for each step.  Both ways give the same result; tests and
queries hold one against the other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..lineage import cut
from . import chains, solvers

SMALL_EDGES = 1_000_000
#: Rows of ids that are sent to all tasks.
FEW = 100_000


@dataclass
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame
    small_edges: int = SMALL_EDGES

    # construction

    @staticmethod
    def of(edges: DataFrame, nodes: DataFrame | None = None, small_edges: int = SMALL_EDGES, keep: bool = False) -> CodeGraph:
        """Nodes are those given and all ends of edges; parallel edges collapse.  With keep both tables are cut, and edges are made once."""
        e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
        e = cut(e) if keep else e
        ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
        n = ends if nodes is None else nodes.select("id").filter("id is not null").union(ends)
        return CodeGraph(cut(n.distinct()) if keep else n.distinct(), e, small_edges)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def kept(self) -> CodeGraph:
        """This graph with both tables cut from their lineage, for repeated use."""
        return CodeGraph(cut(self.nodes), cut(self.edges), self.small_edges)

    # lookups and set operators

    def dependencies(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node).select(F.col("dst").alias("id"))

    def dependents(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == node).select(F.col("src").alias("id"))

    def has_edge(self, src: str, dst: str) -> bool:
        return self.edges.filter((F.col("src") == src) & (F.col("dst") == dst)).limit(1).count() > 0

    def subgraph(self, keep: DataFrame) -> CodeGraph:
        """The graph induced by keep(id); ids that aren't nodes are ignored."""
        k = self.nodes.join(keep.select("id").distinct(), "id", "left_semi")
        e = self.edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return CodeGraph(k, e.select("src", "dst"), self.small_edges)

    # degrees

    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree; a self-loop counts in both."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
        d = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
        return self.nodes.join(d, "id", "left").select("id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])

    def stats(self) -> DataFrame:
        n, i, o = F.count(F.lit(1)), F.col("in_degree"), F.col("out_degree")
        zero = lambda c: F.coalesce(c, F.lit(0))
        return self.degrees().agg(
            n.alias("node_count"), zero(F.sum(o)).alias("edge_count"), F.round(zero(F.try_divide(F.sum(o), n * n)), 6).alias("density"),
            zero(F.max(i)).alias("max_in_degree"), zero(F.max(o)).alias("max_out_degree"), F.round(zero(F.avg(i)), 6).alias("avg_in_degree"), F.round(zero(F.avg(o)), 6).alias("avg_out_degree"),
            F.count_if(o == 0).alias("leaf_count"), F.count_if(i == 0).alias("root_count"),
        )

    def top(self, column: str, k: int = 10) -> DataFrame:
        """The k nodes of the greatest in_degree (most imported) or out_degree (most dependencies)."""
        return self.degrees().select("id", column).orderBy(F.desc(column), "id").limit(k)

    def isolated(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")

    # fixpoints

    def is_small(self) -> bool:
        return max(self._sizes) <= self.small_edges

    @cached_property
    def _sizes(self) -> tuple[int, int]:
        return self.nodes.count(), self.edges.count()

    def _arrays(self) -> tuple[list, np.ndarray, np.ndarray]:
        ids, e = self.nodes.toArrow()["id"], self.edges.toArrow()
        if pa.types.is_integer(ids.type):
            ids = np.sort(ids.to_numpy())
            return ids.tolist(), np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
        ids = sorted(ids.to_pylist())
        at = {x: k for k, x in enumerate(ids)}
        return ids, np.array([at[x] for x in e["src"].to_pylist()], np.int64), np.array([at[x] for x in e["dst"].to_pylist()], np.int64)

    def _table(self, ids: list, columns: dict, kinds: str, rows: list[int] | None = None) -> DataFrame:
        rows = range(len(ids)) if rows is None else rows
        kind = self.nodes.schema["id"].dataType.simpleString()
        schema = _parse_datatype_string(f"id {kind}" + (f", {kinds}" if kinds else ""))
        values = [[ids[k] for k in rows], *([c[k] for k in rows] if isinstance(c, list) else c[np.asarray(rows, np.int64)] for c in columns.values())]
        return self.spark.createDataFrame(pa.table([pa.array(v, f.type) for v, f in zip(values, to_arrow_schema(schema))], names=schema.names), schema)

    def _steps(self, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """outs(id, to, n), the n edges out of each node and one's end; inner(id), the nodes with edges in; steps(id, to) of those of them with one edge out."""
        outs = cut(edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to"), F.count(F.lit(1)).alias("n")))
        inner = cut(edges.select(F.col("dst").alias("id")).distinct())
        return outs, inner, cut(outs.filter("n = 1").select("id", "to").join(inner, "id", "left_semi"))

    def pagerank(self, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
        """id, score; the mass of nodes without edges out is spread over all; scores add up to 1."""
        if self.is_small():
            ids, s, d = self._arrays()
            return self._table(ids, {"score": solvers.pagerank(len(ids), s, d, damping, iterations, tolerance)}, "score double")
        return self._pagerank_loop(damping, iterations, tolerance)

    def _pagerank_loop(self, damping: float, iterations: int, tolerance: float) -> DataFrame:
        """Scores as weighted sums of the masses of walks.

        A walk's mass is the product of 1 / edges out over its nodes but the last; the
        mass j of a node sums those of all walks of j edges that end there, mass 0 is 1.
        A round has rows only for the nodes that walks of its length end at, and all else
        that scores depend on is one number a round.  Without a tolerance, what is left of
        the graph is solved on the driver once it is small.
        """
        n = self._sizes[0]
        if not n:
            return self.nodes.select("id", F.lit(0.0).alias("score"))
        out = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
        sources, wide = out.agg(F.count(F.lit(1)), F.count_if(F.col("out") > 1)).first()
        # large graphs are spared the joins that would change nothing
        edges = self.edges.join(out.filter("out > 1"), "src", "left").select("src", "dst", (1 / F.coalesce("out", F.lit(1))).alias("share")) if wide else self.edges.select("src", "dst", F.lit(1.0).alias("share"))
        mass = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("mass"))
        if sources < n:
            mass = cut(mass.join(out.select(F.col("src").alias("id"), F.lit(False).alias("last")), "id", "left").fillna(True, ["last"]))
            edges = edges.join(mass.filter("last").select(F.col("id").alias("dst"), "last"), "dst", "left").fillna(False, ["last"])
        else:
            mass, edges = cut(mass.withColumn("last", F.lit(False))), edges.withColumn("last", F.lit(False))
        sums = lambda m: m.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("mass"), F.when(F.col("last"), F.col("mass")))]).first()
        # by round: the mass of all nodes, and that of those without edges out
        total, lost = [float(n)], [float(n - sources)]
        masses, known, rest = [], float("inf"), None
        rows, *both = sums(mass)
        while rows and len(masses) < iterations:
            masses.append(mass)
            total.append(both[0])
            lost.append(both[1])
            if len(masses) == iterations:
                break
            if 2 * rows <= known:  # walks go on from nodes with mass only
                edges, known = cut(edges.join(mass.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "share", "last")), rows
                if tolerance <= 0 and max(rows, edges.count()) <= self.small_edges:
                    rest = _walks(mass, edges)
                    for m in rest[2](iterations - len(masses)):
                        total.append(float(m.sum()))
                        lost.append(float(m[rest[1]].sum()))
                    break
            step = edges.join(mass.select(F.col("id").alias("src"), "mass"), "src").groupBy(F.col("dst").alias("id"))
            mass = cut(step.agg(F.sum(F.col("mass") * F.col("share")).alias("mass"), F.max("last").alias("last")))
            rows, *both = sums(mass)
        weights = solvers.walk_weights(n, lost, damping, iterations)
        at = iterations
        if tolerance > 0 and masses:
            names = [f"m{k}" for k in range(1, len(masses) + 1)]
            wide = None
            for k, m in zip(names, masses, strict=True):
                part = m.select("id", *[(F.col("mass") if c == k else F.lit(0.0)).alias(c) for c in names])
                wide = part if wide is None else wide.union(part)
            wide = wide.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
            steps = [np.subtract(b, a) for a, b in zip(weights, weights[1:])]
            moved = wide.agg(F.count(F.lit(1)), *[F.sum(F.abs(sum((F.col(c) * float(w) for c, w in zip(names, d[1:], strict=False)), F.lit(float(d[0]))))) for d in steps]).first()
            at = next((t for t, d in enumerate(steps, 1) if moved[t] + (n - moved[0]) * abs(d[0]) < tolerance), at)
        w = [float(x) for x in weights[at][: len(total)]]
        scale = sum(x * y for x, y in zip(w, total, strict=True))
        parts = [m.select("id", (F.col("mass") * x).alias("more")) for m, x in zip(masses, w[1:])]
        if rest:
            ids, _, rounds = rest
            later = w[len(masses) + 1 :]
            more = sum((x * m for x, m in zip(later, rounds(len(later)), strict=True)), np.zeros(len(ids)))
            schema = _parse_datatype_string(f"id {self.nodes.schema['id'].dataType.simpleString()}, more double")
            parts.append(self.spark.createDataFrame(pa.table([ids.cast(to_arrow_schema(schema)[0].type), pa.array(more)], names=schema.names), schema))
        if not parts:
            return self.nodes.select("id", F.lit(1.0 / n).alias("score"))
        more = parts[0]
        for p in parts[1:]:
            more = more.union(p)
        more = cut(more.groupBy("id").agg(F.sum("more").alias("more")))
        return self.nodes.join(more, "id", "left").select("id", ((F.coalesce("more", F.lit(0.0)) + w[0]) / scale).alias("score"))

    def reach(self, start: str, forward: bool = True) -> DataFrame:
        """Ids that paths from (or to) start lead to, without start; none for an unknown one."""
        if self.is_small():
            ids, s, d = self._arrays()
            if start not in ids:
                return self.nodes.limit(0)
            dist = solvers.distances(len(ids), s if forward else d, d if forward else s, ids.index(start))
            return self._table(ids, {}, "", [k for k in np.flatnonzero(dist > 0)]) if (dist > 0).any() else self.nodes.limit(0)
        return self._reach_loop(start) if forward else self._reach_back_loop(start)

    def _reach_loop(self, start: str) -> DataFrame:
        """Paths of single edges are closed at once; a round is taken for each node of several edges out on the way."""
        first = cut(self.nodes.filter(F.col("id") == start))
        outs, _, steps = self._steps(self.edges)
        steps = cut(steps.union(outs.filter((F.col("n") == 1) & (F.col("id") == start)).select("id", "to")).distinct())
        hubs = cut(outs.filter("n > 1").select("id"))
        edges = cut(self.edges.join(hubs.select(F.col("id").alias("src")), "src", "left_semi")) if hubs.limit(1).count() else None
        close = chains.closure(steps)
        seen, front = None, first
        while front.limit(1).count():
            new = close(front)
            new = new if seen is None else cut(new.join(seen, "id", "left_anti"))
            seen = new if seen is None else cut(seen.union(new))
            if edges is None:
                break
            front = cut(edges.join(new.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        return first if seen is None else seen.filter(F.col("id") != start)

    def _reach_back_loop(self, start: str) -> DataFrame:
        """All nodes below start in the trees of single edges, then those below each node of several edges out that leads there."""
        edges = self.edges.filter(F.col("src") != start)
        outs, inner, steps = self._steps(edges)
        steps = cut(steps.join(chains.cyclic(steps), "id", "left_anti"))
        at = chains.trees(inner.select("id", F.lit(1).alias("weight")), steps).select("id", "root")
        found = below = cut(at.filter(F.col("root") == start).select("id"))
        hubs = outs.filter("n > 1").select("id")
        wide = cut(edges.join(hubs.select(F.col("id").alias("src")), "src", "left_semi")) if hubs.limit(1).count() else None
        while wide is not None and below.limit(1).count():
            new = wide.join(below.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti")
            new = cut(new)
            below = cut(at.join(new.select(F.col("id").alias("root")), "root", "left_semi").select("id").union(new).distinct())
            found = cut(found.union(below))
        outer = outs.filter("n = 1").join(inner, "id", "left_anti").join(found.select(F.col("id").alias("to")), "to", "left_semi").select("id")
        return found.union(outer).filter(F.col("id") != start)

    def distances(self, start: str, most: int, forward: bool = True) -> DataFrame:
        """id, distance of all nodes within ``most`` steps of start."""
        a, b = ("src", "dst") if forward else ("dst", "src")
        front = cut(self.nodes.filter(F.col("id") == start).select("id", F.lit(0).alias("distance")))
        found = front
        for k in range(1, most + 1):
            front = self.edges.select(F.col(a).alias("id"), F.col(b).alias("to")).join(spread_small(front.select("id")), "id").select(F.col("to").alias("id")).distinct().select("id", F.lit(k).alias("distance"))
            front = cut(front)
            found = found.union(front)
        return found.groupBy("id").agg(F.min("distance").alias("distance"))

    def components(self) -> DataFrame:
        """id, component of the strongly connected components, each named by its least member."""
        if self.is_small():
            ids, s, d = self._arrays()
            return self._table(ids, {"component": [ids[k] for k in solvers.components(len(ids), s, d)]}, f"component {self.nodes.schema['id'].dataType.simpleString()}")
        return self._components_loop()

    def _components_loop(self, whole: bool = True) -> DataFrame:
        """Cycles of single edges, then of what leads to nodes of several edges out: trimming, forward colouring by the least label and a backward search within each colour.

        Unless whole, nodes that are found to lie on no cycle get no row.
        """
        edges = self.edges.filter("src <> dst")
        outs, inner, steps = self._steps(edges)
        on = cut(steps.join(chains.cyclic(steps), "id", "left_semi"))
        done = chains.rings(on).select("id", F.col("ring").alias("component")) if on.limit(1).count() else self.nodes.select("id", F.col("id").alias("component")).limit(0)
        settled = self.nodes.join(on, "id", "left_anti")
        hubs = outs.filter("n > 1").select("id")
        if not hubs.limit(1).count():
            return cut(done.union(settled.select("id", F.col("id").alias("component")))) if whole else done
        at = chains.trees(inner.select("id", F.lit(1).alias("weight")), cut(steps.join(on, "id", "left_anti")))
        outer = outs.filter("n = 1").join(inner, "id", "left_anti").select("id", "to")
        left = at.join(hubs.select(F.col("id").alias("root")), "root", "left_semi").select("id")
        left = cut(left.union(hubs).union(outer.join(left.select(F.col("id").alias("to")), "to", "left_semi").select("id")).distinct())
        if whole:
            done = cut(done.union(settled.join(left, "id", "left_anti").select("id", F.col("id").alias("component"))))
        edges = cut(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        while True:
            while True:  # nodes without edges in or out are components of their own
                inner = left.join(edges.select(F.col("src").alias("id")), "id", "left_semi").join(edges.select(F.col("dst").alias("id")), "id", "left_semi")
                inner = cut(inner)
                gone = cut(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
                if not gone.limit(1).count():
                    break
                done, left = done.union(gone) if whole else done, inner
                edges = cut(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
            if not left.limit(1).count():
                return cut(done)
            colour = cut(left.select("id", F.col("id").alias("colour")))
            while True:
                near = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
                step = cut(colour.join(near, "id", "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), F.col("colour").alias("was")))
                colour = step.drop("was")
                if not step.filter("colour <> was").limit(1).count():
                    break
            own = edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").filter("c1 = c2").select("src", "dst")
            own = cut(own)
            seen = front = cut(colour.filter("id = colour"))
            while front.limit(1).count():
                front = cut(own.join(front.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct().join(seen, "id", "left_anti"))
                seen = cut(seen.union(front))
            found = seen.select("id", F.col("colour").alias("component"))
            done = done.union(found)
            left = cut(left.join(seen, "id", "left_anti"))
            edges = cut(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))

    def cycles(self) -> DataFrame:
        """component, id of components of two nodes or more; a self-loop alone is no cycle."""
        found = self.components() if self.is_small() else self._components_loop(whole=False)
        others = cut(found.filter("id <> component"))
        return others.select("component", "id").union(others.select("component", F.col("component").alias("id")).distinct())

    def cycle_edges(self) -> DataFrame:
        """component, src, dst of the edges inside cycles."""
        c = self.cycles()
        a, b = (c.select(F.col("component").alias(k), F.col("id").alias(e)) for k, e in (("component", "src"), ("other", "dst")))
        return self.edges.join(a, "src").join(b, "dst").filter("component = other").select("component", "src", "dst")

    def cycle_breaks(self) -> DataFrame:
        """component, src, dst: in each cycle the edge to cut, from the source with most edges in; ties by src, dst."""
        e = self.cycle_edges().join(self.degrees().select(F.col("id").alias("src"), "in_degree"), "src")
        best = e.groupBy("component").agg(F.min(F.struct((-F.col("in_degree")).alias("rank"), "src", "dst")).alias("best"))
        return best.select("component", "best.src", "best.dst")

    def condensed(self) -> CodeGraph:
        """The graph of components, named by their least members."""
        return self._condensed(cut(self.cycles().filter("id <> component")))

    def _condensed(self, members: DataFrame) -> CodeGraph:
        """members(component, id): those that don't name their component themselves."""
        a, b = (members.select(F.col("id").alias(e), F.col("component").alias(k)) for e, k in (("src", "a"), ("dst", "b")))
        e = self.edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).filter("src <> dst").distinct()
        return CodeGraph(self.nodes.join(members, "id", "left_anti"), e, self.small_edges)

    def layers(self, condense: bool = True) -> DataFrame:
        """id, layer: 0 without dependencies, else one above the highest dependency.

        With condense, cycles count as one node where the graph has any.  Without a
        cycle of two nodes a self-looping node, and what depends on it, has no layer;
        without condense that holds for cycles too.
        """
        if condense:
            members = cut(self.cycles().filter("id <> component"))
            if members.limit(1).count():
                found = self._condensed(members).kept()._peel()
                return found.union(members.join(found.withColumnRenamed("id", "component"), "component").select("id", "layer"))
        return self._peel()

    def _peel(self) -> DataFrame:
        if self.is_small():
            ids, s, d = self._arrays()
            level = solvers.layers(len(ids), s, d)
            return self._table(ids, {"layer": level}, "layer long", np.flatnonzero(level >= 0).tolist())
        # the depth of trees of single edges that end at a node without edges out; what ends in a cycle has no layer
        outs, inner, steps = self._steps(self.edges)
        at = chains.trees(inner.select("id", F.lit(1).alias("weight")), cut(steps.join(chains.cyclic(steps), "id", "left_anti")))
        found = at.join(outs.select(F.col("id").alias("root")), "root", "left_anti").select("id", F.col("depth").alias("layer"))
        outer = self.nodes.join(inner, "id", "left_anti").join(outs, "id", "left")
        found = cut(found.union(outer.filter("to is null").select("id", F.lit(0).cast("long"))))
        singles = outer.filter("n = 1").select("id", "to").join(found.select(F.col("id").alias("to"), "layer"), "to").select("id", F.col("layer") + 1)
        done = cut(found.union(singles))
        if not outs.filter("n > 1").limit(1).count():
            return done
        # a node of several edges out, and what leads to it, waits until all its dependencies are known
        edges = cut(self.edges.join(done.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
        wait = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("need"), F.lit(-1).cast("long").alias("best"))
        front = done
        while True:
            got = edges.join(front.select(F.col("id").alias("dst"), "layer"), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("got"), F.max("layer").alias("most"))
            wait = cut(wait.join(got, "id", "left").select("id", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.greatest("best", "most").alias("best")))
            front = cut(wait.filter("need = 0").select("id", (F.col("best") + 1).alias("layer")))
            if not front.limit(1).count():
                return done
            done, wait = cut(done.union(front)), wait.filter("need > 0")

    def layer_stats(self) -> DataFrame:
        by = self.layers().groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
        return by.agg(F.count(F.lit(1)).alias("layer_count"), F.round(F.avg("n"), 6).alias("avg_size"), F.max("n").alias("max_size"), F.coalesce(F.max(F.when(F.col("layer") == 0, F.col("n"))), F.lit(0)).alias("foundation_count"))

    def betweenness(self) -> DataFrame:
        """id, betweenness over shortest directed paths, by (n-1)(n-2); all 0 for two nodes or fewer.

        Where no node has more than one edge out, all paths are of the trees and cycles
        that these make, and are counted without walking them.  Else each task solves some of the sources against the whole adjacency, which is
        sent to it; that is for graphs of at most small_edges edges.  Larger ones take
        the loop over levels, whose rows are pairs of nodes.
        """
        if not self.is_small():
            return self._betweenness_loop()
        ids, s, d = self._arrays()
        n = len(ids)
        if n <= 2:
            return self._table(ids, {"betweenness": np.zeros(n)}, "betweenness double")
        s, d = s[s != d], d[s != d]
        if np.bincount(s, minlength=n).max() <= 1:
            return self._table(ids, {"betweenness": solvers.crossings(n, s, d) / float((n - 1) * (n - 2))}, "betweenness double")
        sent = self.spark.sparkContext.broadcast((n, s, d))

        def run(batches):
            import pandas as pd

            total = np.zeros(n)
            for b in batches:
                total += solvers.betweenness(*sent.value, b["id"].tolist())
            yield pd.DataFrame({"k": np.arange(n), "part": total})

        parts = self.spark.range(0, n, numPartitions=max(1, min(n, 4 * self.spark.sparkContext.defaultParallelism))).mapInPandas(run, "k long, part double")
        names = self._table(ids, {"k": np.arange(n)}, "k long")
        return names.join(parts.groupBy("k").agg(F.sum("part").alias("betweenness")), "k").select("id", "betweenness")

    def _betweenness_loop(self) -> DataFrame:
        n = self.nodes.count()
        if n <= 2:
            return self.nodes.select("id", F.lit(0.0).alias("betweenness"))
        edges = cut(self.edges.filter("src <> dst"))
        outs, inner, steps = self._steps(edges)
        if not outs.filter("n > 1").limit(1).count():
            ends = outs.join(inner, "id", "left_anti").groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("ends"))
            crossed = chains.crossings(inner.join(ends, "id", "left").select("id", (1 + F.coalesce("ends", F.lit(0))).alias("weight")), steps)
            none = self.nodes.join(inner, "id", "left_anti").select("id", F.lit(0.0))
            return crossed.select("id", (F.col("crossed") / float((n - 1) * (n - 2))).alias("betweenness")).union(none)
        front = cut(self.nodes.select(F.col("id").alias("s"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")))
        seen, k = front, 0
        while front.limit(1).count():
            k += 1
            step = front.join(edges.select(F.col("src").alias("id"), "dst"), "id").groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
            front = cut(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(k).alias("dist"), "paths"))
            seen = cut(seen.union(front))
        share = cut(seen.filter(F.col("dist") == k).select("s", "id", F.lit(0.0).alias("share")))
        total = None
        for level in range(k - 1, 0, -1):
            below = seen.filter(F.col("dist") == level + 1).join(share, ["s", "id"], "left").select("s", F.col("id").alias("dst"), ((1 + F.coalesce("share", F.lit(0.0))) / F.col("paths")).alias("w"))
            here = seen.filter(F.col("dist") == level).select("s", F.col("id").alias("src"), "paths")
            share = cut(here.join(edges, "src").join(below, ["s", "dst"]).groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("paths") * F.col("w")).alias("share")))
            got = share.groupBy("id").agg(F.sum("share").alias("share"))
            total = got if total is None else total.union(got)
        scale = float((n - 1) * (n - 2))
        if total is None:
            return self.nodes.select("id", F.lit(0.0).alias("betweenness"))
        total = total.groupBy("id").agg(F.sum("share").alias("share"))
        return self.nodes.join(total, "id", "left").select("id", (F.coalesce("share", F.lit(0.0)) / scale).alias("betweenness"))


def spread_small(ids: DataFrame) -> DataFrame:
    """Kept ids, to be sent to all tasks of a join where there are few, so that the other side needn't be shuffled."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def _walks(mass: DataFrame, edges: DataFrame) -> tuple[pa.Array, np.ndarray, Callable]:
    """Ids; which have no edge out; a function that yields their masses of the next so many rounds."""
    e, m = edges.toArrow(), mass.toArrow()
    ids = pc.unique(pa.chunked_array([*e["src"].chunks, *e["dst"].chunks, *m["id"].chunks], m["id"].type))
    place = lambda c: pc.index_in(c, value_set=ids).to_numpy()
    s, d, share, first = place(e["src"]), place(e["dst"]), e["share"].to_numpy(), np.zeros(len(ids))
    first[place(m["id"])] = m["mass"].to_numpy()

    def rounds(k: int):
        now = first
        for _ in range(k):
            now = np.bincount(d, weights=now[s] * share, minlength=len(ids))
            yield now

    return ids, np.bincount(s, minlength=len(ids)) == 0, rounds


def top_scores(scores: DataFrame, k: int = 10, column: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(column), "id").limit(k)


def _running(scores: DataFrame, c: Column) -> DataFrame:
    """value, n, below and all: how many rows have each value, a smaller one, any.

    Values are sorted by ranges; the rows of each range are counted, and only these
    counts, one a partition, are cumulated in one place.
    """
    by = scores.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    by = cut(by.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = by.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value")) - F.col("n")
    return by.withColumn("inside", inside).join(F.broadcast(before), "part").select("value", "n", (F.col("before") + F.col("inside")).alias("below"), "all")  # one row a partition


def rounded(c: Column | str, places: int) -> Column:
    """A score of 1 at most, rounded to fewer than 15 places; what lies within 5e-16 of a half, as sums in another order do, counts as the half."""
    return F.round(F.round(c, 15), places)


def percentile(scores: DataFrame, column: Column | str = "score") -> DataFrame:
    """id, percentile: share in percent of scores strictly below each."""
    c = F.col(column) if isinstance(column, str) else column
    return scores.select("id", c.alias("value")).join(_running(scores, c), "value").select("id", F.round(100 * F.col("below") / F.col("all"), 6).alias("percentile"))


def score_stats(scores: DataFrame, column: str = "score") -> DataFrame:
    """Largest, least, mean and upper median of a score."""
    middle = F.floor(F.col("all") / 2)
    median = F.max(F.when((F.col("below") <= middle) & (middle < F.col("below") + F.col("n")), F.col("value")))
    return _running(scores.filter(F.col(column).isNotNull()), F.col(column)).agg(F.round(F.max("value"), 6).alias("max_score"), F.round(F.min("value"), 6).alias("min_score"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean_score"), F.round(median, 6).alias("median_score"))

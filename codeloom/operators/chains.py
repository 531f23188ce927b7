"""Pointers that double, for the part of a graph in which every node has one edge out at most.

steps(id, to) has one row for each id.  From there a node's whole future is one path:
into a node without a step (its root) or into a cycle.  Each round doubles the length
that is known of every path, so rounds grow with the logarithm of the depth; rows never
grow beyond the nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def cyclic(steps: DataFrame) -> DataFrame:
    """id of the nodes on cycles, a self-loop included.

    Only images of the doubled step are kept; once these stop to shrink, the step
    permutes them.
    """
    at = cut(steps.select("id", "to"))
    n = at.count()
    while n:
        image = at.select(F.col("to").alias("id")).distinct()
        kept = cut(at.join(image, "id", "left_semi"))
        m = kept.count()
        if m == n:
            return kept.select("id")
        then = kept.select(F.col("id").alias("to"), F.col("to").alias("then"))
        at = cut(kept.join(then, "to").select("id", F.col("then").alias("to")))
        n = at.count()
    return at.select("id")


def trees(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """id, root, depth (steps to the root) and size (the sum of weights of the node and all that lead to it) of nodes(id, weight), where steps have no cycle."""
    at = nodes.join(steps, "id", "left").select("id", F.coalesce("to", "id").alias("root"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("weight").cast("long").alias("size"))
    at, reach = cut(at), 1
    while True:
        far = at.filter(F.col("depth") == reach)
        if not far.limit(1).count():
            return at
        got = far.groupBy(F.col("root").alias("id")).agg(F.sum("size").alias("got"))
        on = at.select(F.col("id").alias("root"), F.col("root").alias("on"), F.col("depth").alias("more"))
        at = at.join(on, "root").join(got, "id", "left")
        at = cut(at.select("id", F.col("on").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("size") + F.coalesce("got", F.lit(0))).alias("size")))
        reach *= 2


def rings(steps: DataFrame) -> DataFrame:
    """id, ring (the least member of its cycle) and to, where steps permute their ids."""
    at = cut(steps.select("id", "to", F.col("id").alias("ring")))
    while True:
        on = at.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("ring").alias("other"))
        new = cut(at.join(on, "to").select("id", F.col("then").alias("to"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")))
        at = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return cut(at.drop("to").join(steps, "id").select("id", "ring", "to"))


def closure(steps: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that adds to ids all that lies on their paths.  Doubled steps are kept for its next calls."""
    jumps = [steps.select("id", "to")]

    def close(ids: DataFrame) -> DataFrame:
        got, k = ids.select("id"), 0
        while True:
            if k == len(jumps):
                last = jumps[-1]
                jumps.append(cut(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to"))))
            more = cut(jumps[k].join(got, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(got, "id", "left_anti"))
            if not more.limit(1).count():
                return got
            got, k = cut(got.union(more)), k + 1

    return close


def crossings(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """id, crossed: how many ordered pairs of other nodes have a path through each of nodes(id, weight).

    weight is 1 and the number of further nodes whose one edge leads straight to it and
    that nothing leads to.  In a tree those are the nodes before times the nodes
    behind.  On a cycle of n nodes a path that entered it j steps before ends at one of
    n - 1 - j nodes behind; these are summed by place on the cycle.
    """
    round_ = cut(steps.join(cyclic(steps), "id", "left_semi"))
    tail = cut(steps.join(round_, "id", "left_anti"))
    at = trees(nodes, tail)
    if not round_.limit(1).count():
        return at.select("id", ((F.col("size") - 1) * F.col("depth")).alias("crossed"))
    ring = rings(round_)
    place = trees(ring.select("id", F.lit(1).alias("weight")), ring.filter("id <> ring").select("id", "to")).select("id", F.col("depth").alias("left"))
    each = ring.select("id", "ring").join(place, "id").join(at.select("id", "size"), "id")
    of, after = Window.partitionBy("ring"), Window.partitionBy("ring").orderBy("left").rowsBetween(Window.unboundedPreceding, -1)
    # places run from the first node, to which no step is left, on: the more steps are left, the earlier
    n, w = F.col("n"), F.col("size")
    each = each.withColumn("n", F.count(F.lit(1)).over(of)).withColumn("place", (n - F.col("left")) % n)
    later = F.coalesce(F.sum(F.when(F.col("left") > 0, w)).over(after), F.lit(0))
    each = each.withColumns({"all": F.sum(w).over(of), "moment": F.sum(w * F.col("place")).over(of), "later": later})
    later = F.when(F.col("left") == 0, F.col("all") - w).otherwise(F.col("later"))
    before = F.col("place") * F.col("all") - F.col("moment") + n * later  # of all that enter, the steps from there
    on = cut(each.select("id", "n", ((w - 1) * (n - 1) + (n - 1) * (F.col("all") - w) - before).alias("crossed")))
    # a tree's root is one of the nodes behind, and on a cycle so are the others of it
    root = on.select(F.col("id").alias("root"), "n")
    off = at.join(on, "id", "left_anti").join(root, "root", "left").select("id", ((F.col("size") - 1) * (F.col("depth") + F.coalesce(F.col("n") - 1, F.lit(0)))).alias("crossed"))
    return off.union(on.select("id", "crossed"))

"""Queries of the graph operators over the derived graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import importance
from ..operators import architecture, calls, coupling, evidence, focus
from ..operators.graph import percentile, rounded, score_stats, top_scores
from ..sinks import diagrams
from . import graphs as G
from .registry import query, table

NATION = "NATION_3"
KEY = 3
PART = 7
_R = "with recursive "


def r6(c):
    return F.round(c, 6)


# exact halves of the last place are common among scores, so 1e-9 is added before they are rounded


@query(f"""with {G.TRADE}, {G.DEGREES} select count(*) as node_count, cast(coalesce(sum(out_degree), 0) as bigint) as edge_count,
  round(coalesce(sum(out_degree) / nullif(count(*) * count(*), 0), 0), 6) as density, coalesce(max(in_degree), 0) as max_in_degree, coalesce(max(out_degree), 0) as max_out_degree,
  round(coalesce(avg(in_degree), 0), 6) as avg_in_degree, round(coalesce(avg(out_degree), 0), 6) as avg_out_degree,
  cast(count(case when out_degree = 0 then 1 end) as bigint) as leaf_count, cast(count(case when in_degree = 0 then 1 end) as bigint) as root_count from degrees""")
def graph_stats(spark, sf_dir):
    return G.trade(spark, sf_dir).stats()


@query(f"with {G.FOLLOW}, {G.DEGREES} select id, in_degree, out_degree from degrees")
def degrees(spark, sf_dir):
    return G.follow(spark, sf_dir).degrees()


@query(f"with {G.FOLLOW}, {G.DEGREES} select id, in_degree from degrees order by in_degree desc, id limit 10")
def most_imported(spark, sf_dir):
    return G.follow(spark, sf_dir).top("in_degree")


@query(f"with {G.FOLLOW}, {G.DEGREES} select id, out_degree from degrees order by out_degree desc, id limit 10")
def most_dependencies(spark, sf_dir):
    return G.follow(spark, sf_dir).top("out_degree")


@query("select 'd' || doc_id as id from documents where doc_id not in (select doc_id from labels)")
def isolated_nodes(spark, sf_dir):
    """Documents without a label, in the graph of labels and the documents that have them."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "documents").select(name("d", "doc_id").alias("id"))
    return G.CodeGraph.of(table(spark, sf_dir, "labels").select(name("q", "quality").alias("src"), name("d", "doc_id").alias("dst")), nodes).isolated()


@query(f"with {G.TRADE}, near as (select n_name as id from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')) select src, dst from edges where src in (select id from near) and dst in (select id from near)")
def subgraph_edges(spark, sf_dir):
    keep = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"))
    return G.trade(spark, sf_dir).subgraph(keep).edges


@query(f"with {G.KEYS} select 'dependency' as relation, dst as id from edges where src = {KEY} union all select 'dependent', src from edges where dst = {KEY}")
def neighbors(spark, sf_dir):
    return focus.dependencies_of(G.keys(spark, sf_dir), KEY).select("relation", "id")


def _reach_sql(graph: str, start: str, forward: bool = True) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"{_R}{graph}, found as (select {b} as id from edges where {a} = {start} union select {b} from found join edges on {a} = found.id) select id from found where id <> {start}"


@query(_reach_sql(G.KEYS, str(KEY)))
def reach_forward(spark, sf_dir):
    return G.keys(spark, sf_dir).reach(KEY)


@query(_reach_sql(G.KEYS, str(KEY), forward=False))
def reach_backward(spark, sf_dir):
    return G.keys(spark, sf_dir).reach(KEY, forward=False)


@query(_reach_sql(G.FOLLOW, str(PART)))
def reach_parts(spark, sf_dir):
    return G.follow(spark, sf_dir).kept().reach(PART)


@query(f"{_R}{G.KEYS}, {G.pagerank_sql()} select id, round(score + 1e-9, 6) as score from scores")
def pagerank20(spark, sf_dir):
    return G.keys(spark, sf_dir).pagerank(tolerance=0.0).select("id", r6(F.col("score") + 1e-9).alias("score"))


@query(f"""{_R}{G.KEYS}, {G.pagerank_sql()} select id, round(score + 1e-9, 6) as score from scores order by round(score, 12) desc, id limit 10""")
def top_files(spark, sf_dir):
    s = G.keys(spark, sf_dir).pagerank(tolerance=0.0).withColumn("score", F.round("score", 12))
    return top_scores(s).select("id", r6(F.col("score") + 1e-9).alias("score"))


@query(f"""{_R}{G.KEYS}, {G.pagerank_sql()}, ranked as (select score, row_number() over (order by score) - 1 as k, count(*) over () as n from scores)
select round(max(score), 6) as max_score, round(min(score), 6) as min_score, round(avg(score), 6) as mean_score, round(max(case when k = n // 2 then score end), 6) as median_score from ranked""")
def pagerank_stats(spark, sf_dir):
    return score_stats(G.keys(spark, sf_dir).pagerank(tolerance=0.0))


@query(f"""{_R}{G.KEYS}, {G.pagerank_sql()}, s as (select id, round(score, 9) as score from scores)
select id, round(100.0 * (rank() over (order by score) - 1) / count(*) over (), 6) as percentile from s""")
def score_percentile(spark, sf_dir):
    return percentile(G.keys(spark, sf_dir).pagerank(tolerance=0.0).withColumn("score", rounded("score", 9)))


@query(f"""{_R}{G.KEYS}, {G.pagerank_sql()}, r as (select id, round(score, 9) * (select count(*) from nodes) as x from scores)
select id, case when x > 5 then 'Very High (critical hub)' when x > 2 then 'High (key file)' when x > 1 then 'Above Average' when x > 0.5 then 'Average' when x > 0.2 then 'Below Average' else 'Low (leaf file)' end as importance from r""")
def importance_bucket(spark, sf_dir):
    g = G.keys(spark, sf_dir)
    return g.pagerank(tolerance=0.0).select("id", importance(rounded("score", 9), F.lit(g.nodes.count())).alias("importance"))


_COMP = f"{_R}{G.KEYS}, {G.COMPONENTS}, large as (select component from comp group by 1 having count(*) > 1)"


@query(f"{_COMP} select component, id from comp where component in (select component from large)")
def scc_members(spark, sf_dir):
    return G.keys(spark, sf_dir).cycles()


@query(f"{_R}{G.FLOW}, {G.COMPONENTS} select id, component from comp")
def flow_components(spark, sf_dir):
    return G.flow(spark, sf_dir).components()


_CYCLE_EDGES = f"{_COMP}, inner_edges as (select a.component, src, dst from edges join comp a on a.id = src join comp b on b.id = dst where a.component = b.component and a.component in (select component from large))"


@query(f"{_CYCLE_EDGES} select * from inner_edges")
def cycle_edges(spark, sf_dir):
    return G.keys(spark, sf_dir).cycle_edges()


@query(f"{_CYCLE_EDGES}, {G.DEGREES} select component, src, dst from (select e.*, row_number() over (partition by component order by in_degree desc, src, dst) as rn from inner_edges e join degrees on id = src) q where rn = 1")
def cycle_break(spark, sf_dir):
    return G.keys(spark, sf_dir).cycle_breaks()


@query(f"{_COMP} select distinct a.component as src, b.component as dst from edges join comp a on a.id = src join comp b on b.id = dst where a.component <> b.component")
def condensed_edges(spark, sf_dir):
    return G.keys(spark, sf_dir).condensed().edges


# without a cycle of two nodes a self-loop, and all that leads to it, has no layer
_LAYERS = f"""{_COMP}, links as (select distinct a.component as src, b.component as dst from edges join comp a on a.id = src join comp b on b.id = dst where a.component <> b.component),
looped as (select src as id from edges where src = dst and not exists (select 1 from large)), barred as (select id from looped union select r.src from reach r join looped on looped.id = r.dst),
walks as (select distinct component as id, 0 as k from comp union select links.src, walks.k + 1 from walks join links on links.dst = walks.id),
layered as (select c.id, cast(max(k) as bigint) as layer from comp c join walks w on w.id = c.component where c.id not in (select id from barred) group by c.id)"""


@query(f"{_LAYERS} select id, layer from layered")
def topo_layers(spark, sf_dir):
    return G.keys(spark, sf_dir).layers()


@query(f"""{_LAYERS}, sizes as (select layer, count(*) as n from layered group by 1)
select count(*) as layer_count, round(avg(n), 6) as avg_size, max(n) as max_size, cast(coalesce(max(case when layer = 0 then n end), 0) as bigint) as foundation_count from sizes""")
def layer_stats(spark, sf_dir):
    return G.keys(spark, sf_dir).layer_stats()


_FLOW_LAYERS = _LAYERS.replace(G.KEYS, G.FLOW)


@query(f"{_FLOW_LAYERS} select id, layer from layered")
def flow_layers(spark, sf_dir):
    """One component of all event types: a single layer."""
    return G.flow(spark, sf_dir).layers()


_FOCUS = f"""{_R}{G.KEYS}, {G.pagerank_sql()},
ahead as (select {KEY} as id, 0 as d union select dst, d + 1 from ahead join edges on src = id where d < 3),
behind as (select {KEY} as id, 0 as d union select src, d + 1 from behind join edges on dst = id where d < 3),
f as (select id, min(d) as f from ahead group by 1), b as (select id, min(d) as b from behind group by 1),
near as (select coalesce(f.id, b.id) as id, least(coalesce(f, 99), coalesce(b, 99)) as distance, f, b from f full join b on f.id = b.id),
found as (select near.id, distance, case when near.id = {KEY} then 'focal' when b is null or f < b then 'dependency' when f is null or b < f then 'dependent' else 'both' end as direction,
  coalesce(score, 0.001) * pow(0.8, distance) as score from near left join scores s on s.id = near.id)"""


@query(f"{_FOCUS} select id, distance, direction, round(score + 1e-9, 6) as score from found where score >= 0.0000001")
def focus_neighborhood(spark, sf_dir):
    g = G.keys(spark, sf_dir)
    return focus.focus(g, g.pagerank(tolerance=0.0), KEY, least=0.0000001).select("id", "distance", "direction", r6(F.col("score") + 1e-9).alias("score"))


# shortest paths are the walks of least length; they are counted by length, and none of this graph is longer than 300
_PATHS = f"""{_R}{G.KEYS}, e as (select src, dst from edges where src <> dst), n as (select count(*) as n from nodes),
walks as (select src as s, dst as t, 1 as l, 1.0::double as k from e union all
  select w.s, e.dst, w.l + 1, sum(w.k) from walks w join e on e.src = w.t where w.l < 300 group by w.s, e.dst, w.l),
short as (select s, t, min(l) as d, arg_min(k, l) as k from walks where s <> t group by s, t),
bc as (select nodes.id, case when (select n from n) <= 2 then 0.0 else coalesce((select sum(a.k * b.k / c.k) from short a join short b on a.t = b.s join short c on c.s = a.s and c.t = b.t
  where a.t = nodes.id and a.d + b.d = c.d and a.s <> b.t), 0) / (((select n from n) - 1) * ((select n from n) - 2)) end as betweenness from nodes)"""


@query(f"{_PATHS} select id, round(betweenness, 6) as betweenness from bc")
def betweenness(spark, sf_dir):
    return G.keys(spark, sf_dir).betweenness().select("id", r6("betweenness").alias("betweenness"))


@query(f"""{_PATHS}, {G.pagerank_sql()}, b as (select id, round(betweenness, 9) as betweenness from bc)
select b.id, round(betweenness, 6) as betweenness, round(score, 6) as pagerank, case when betweenness > 0.2 then 'high' when betweenness > 0.1 then 'medium' else 'low' end as risk
from b join scores s on s.id = b.id where betweenness >= 0.0005 order by b.betweenness desc, b.id limit 10""")
def bridge_files(spark, sf_dir):
    g = G.keys(spark, sf_dir)
    bc = g.betweenness().withColumn("betweenness", F.round("betweenness", 9))
    return focus.bridges(g, bc, g.pagerank(tolerance=0.0), threshold=0.0005).select("id", r6("betweenness").alias("betweenness"), r6("pagerank").alias("pagerank"), "risk")


@query(f"""{_PATHS}, {G.pagerank_sql()} select bc.id, round(betweenness / score, 6) as ratio, case when betweenness > 0.1 then 'high' when betweenness > 0.05 then 'medium' else 'low' end as risk
from bc join scores s on s.id = bc.id where betweenness > 0.0005 and betweenness / nullif(score, 0) > 0.1""")
def hidden_bridges(spark, sf_dir):
    g = G.keys(spark, sf_dir)
    return focus.hidden_bridges(g.betweenness(), g.pagerank(tolerance=0.0), least=0.0005, ratio=0.1).select("id", r6("ratio").alias("ratio"), "risk")


def _loop(spark, sf_dir):
    """The keys graph, too large for one process as it is told."""
    return G.keys(spark, sf_dir, small_edges=0)


@query(_reach_sql(G.KEYS, str(KEY)))
def reach_loop(spark, sf_dir):
    return _loop(spark, sf_dir).reach(KEY)


@query(f"{_R}{G.KEYS}, {G.pagerank_sql()} select id, round(score + 1e-9, 6) as score from scores")
def pagerank_loop(spark, sf_dir):
    return _loop(spark, sf_dir).pagerank(tolerance=0.0).select("id", r6(F.col("score") + 1e-9).alias("score"))


@query(f"{_COMP} select id, component from comp")
def components_loop(spark, sf_dir):
    return _loop(spark, sf_dir).components()


@query(f"{_LAYERS} select id, layer from layered")
def layers_loop(spark, sf_dir):
    return _loop(spark, sf_dir).layers()


@query(f"{_FOCUS} select id, distance, direction, round(score + 1e-9, 6) as score from found where score >= 0.0000001")
def focus_loop(spark, sf_dir):
    g = _loop(spark, sf_dir)
    return focus.focus(g, g.pagerank(tolerance=0.0), KEY, least=0.0000001).select("id", "distance", "direction", r6(F.col("score") + 1e-9).alias("score"))


@query(f"{_PATHS} select id, round(betweenness, 6) as betweenness from bc")
def betweenness_loop(spark, sf_dir):
    return _loop(spark, sf_dir).betweenness().select("id", r6("betweenness").alias("betweenness"))


# chunks of a nation: its customers; those of two segments count as abstract
_DEFS = """defs as (select n_name as path, count(case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1 end) as x, count(case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 1 end) as y
  from customer join nation on c_nationkey = n_nationkey group by 1)"""
_ZONE = "case when abs(a + i - 1) <= 0.2 then 'main' when i < 0.3 and a < 0.3 then 'pain' when i > 0.7 and a > 0.7 then 'uselessness' else 'neutral' end"
_METRICS = f"""with {G.TRADE}, {G.DEGREES}, {_DEFS},
m as (select id, in_degree as ca, out_degree as ce, case when in_degree + out_degree = 0 then 0.5 else out_degree::double / (in_degree + out_degree) end as i,
  case when coalesce(x, 0) + coalesce(y, 0) > 0 then x::double / (x + y) else 0.0 end as a from degrees left join defs on path = id),
metrics as (select *, abs(a + i - 1) as d, {_ZONE} as zone from m)"""


def _metrics(spark, sf_dir):
    chunks = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "interface").otherwise("class")
    return coupling.coupling(G.trade(spark, sf_dir), coupling.definition_counts(chunks.select(F.col("n_name").alias("path"), kind.alias("type"))))


@query(f"{_METRICS} select id, ca, ce, round(i, 6) as i, round(a, 6) as a, round(d, 6) as d, zone from metrics")
def coupling_all(spark, sf_dir):
    return _metrics(spark, sf_dir).select("id", "ca", "ce", r6("i").alias("i"), r6("a").alias("a"), r6("d").alias("d"), "zone")


@query(f"{_METRICS} select zone, count(*) as files, round(avg(d), 6) as avg_distance from metrics group by 1")
def zone_counts(spark, sf_dir):
    return coupling.zone_counts(_metrics(spark, sf_dir))


@query(f"""{_METRICS} select count(*) as files, round(avg(i), 6) as avg_instability, round(avg(a), 6) as avg_abstractness, round(avg(d), 6) as avg_distance,
  round(count(case when zone = 'main' then 1 end)::double / count(*), 6) as health_score from metrics""")
def coupling_summary(spark, sf_dir):
    return coupling.coupling_summary(_metrics(spark, sf_dir))


@query(f"""{_METRICS}, s as (select id, case when ca >= 5 then 2.0 * ca else 0 end + case when zone = 'pain' and d > 0.4 then 20 else 0 end + case when zone = 'uselessness' then 15 else 0 end + case when i > 0.7 and ca > 0 then 10 else 0 end as score from metrics)
select id, cast(score as double) as score from s where score > 0""")
def critical_modules(spark, sf_dir):
    return coupling.critical_modules(_metrics(spark, sf_dir)).select("id", "score")


@query(f"""with {G.TRADE_FILES}, dirs as (select distinct split_part(id, '/', 1) as directory from nodes),
cross_edges as (select src, dst, split_part(src, '/', 1) as a, split_part(dst, '/', 1) as b from edges where split_part(src, '/', 1) <> split_part(dst, '/', 1)),
m as (select directory, cast((select count(distinct src) from cross_edges where b = directory) as bigint) as ca, cast((select count(distinct dst) from cross_edges where a = directory) as bigint) as ce from dirs),
k as (select *, case when ca + ce = 0 then 0.5 else ce::double / (ca + ce) end as i, 0.0::double as a from m)
select directory, ca, ce, round(i, 6) as i, a, round(abs(a + i - 1), 6) as d, {_ZONE} as zone from k""")
def coupling_dir(spark, sf_dir):
    return coupling.directory_coupling(G.trade_files(spark, sf_dir)).select("directory", "ca", "ce", r6("i").alias("i"), "a", r6("d").alias("d"), "zone")


_LAYER_OF = "case split_part(id, '/', 1) when 'components' then 'presentation' when 'handlers' then 'application' when 'models' then 'domain' when 'database' then 'infrastructure' else 'shared' end"
_LAYER_NO = "case {} when 'presentation' then 0 when 'application' then 1 when 'domain' then 2 when 'infrastructure' then 3 else 4 end"


@query(f"with {G.TRADE_FILES} select id, {_LAYER_OF} as layer, 'path' as method from nodes")
def architecture_layers(spark, sf_dir):
    return architecture.classify(G.trade_files(spark, sf_dir)).select("id", "layer", "method")


@query(f"""with {G.TRADE_FILES}, l as (select id, {_LAYER_OF} as layer from nodes)
select src, dst, a.layer as src_layer, b.layer as dst_layer from edges join l a on a.id = src join l b on b.id = dst where {_LAYER_NO.format('b.layer')} > {_LAYER_NO.format('a.layer')}""")
def layer_violations(spark, sf_dir):
    g = G.trade_files(spark, sf_dir)
    return architecture.violations(g, architecture.classify(g))


@query(f"with {G.TRADE_FILES}, l as (select {_LAYER_OF} as layer from nodes) select layer, count(*) as files from l group by 1")
def architecture_counts(spark, sf_dir):
    return architecture.layer_counts(architecture.classify(G.trade_files(spark, sf_dir)))


_EVIDENCE = """records as (select sn.n_name as source, cn.n_name as target, l_returnflag as kind, l_linestatus as symbol, l_linenumber as line, o_orderpriority, c_mktsegment as engine
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey)"""
_RANK = "case left(o_orderpriority, 1) when '1' then 4 when '2' then 3 when '3' then 2 else 1 end"


@query(f"""with {_EVIDENCE} select source, target, string_agg(distinct kind, ',' order by kind) as kinds, string_agg(distinct symbol, ',' order by symbol) as symbols,
  string_agg(distinct cast(line as varchar), ',' order by cast(line as varchar)) as lines, case max({_RANK}) when 4 then 'exact' when 3 then 'structured' when 2 then 'resolved' else 'partial' end as confidence,
  case when count(distinct engine) > 1 then 'mixed' else min(engine) end as engine, count(distinct (kind, symbol, line, engine)) as evidence from records group by 1, 2""")
def edge_evidence_merge(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    name = lambda c: t("nation").select(F.col("n_nationkey").alias(f"{c}_key"), F.col("n_name").alias(c))
    supply = t("supplier").join(name("source"), F.col("s_nationkey") == F.col("source_key")).select("s_suppkey", "source")
    buy = t("customer").join(name("target"), F.col("c_nationkey") == F.col("target_key")).select("c_custkey", "target", F.col("c_mktsegment").alias("engine"))
    first = F.substring("o_orderpriority", 1, 1)
    confidence = F.when(first == "1", "exact").when(first == "2", "structured").when(first == "3", "resolved").otherwise("partial")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(buy, F.col("o_custkey") == F.col("c_custkey")).join(supply, F.col("l_suppkey") == F.col("s_suppkey"))
    merged = evidence.merge(rows.select("source", "target", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("symbol"), F.col("l_linenumber").alias("line"), confidence.alias("confidence"), "engine"))
    text = lambda c: F.array_join(c, ",")
    return merged.select("source", "target", text("kinds").alias("kinds"), text("symbols").alias("symbols"), text("lines").alias("lines"), "confidence", "engine", F.size("evidence").cast("long").alias("evidence"))


# calls


@query(f"with {G.TALK} select distinct src as id from edges where src not in (select dst from edges)")
def call_entry_points(spark, sf_dir):
    return calls.entry_points(G.talk_calls(spark, sf_dir))


@query(f"with {G.TALK} select distinct dst as id from edges where dst not in (select src from edges)")
def call_leaves(spark, sf_dir):
    return calls.leaves(G.talk_calls(spark, sf_dir))


@query("select cast(l_partkey as varchar) as callee, count(*) as calls from lineitem group by 1 order by 2 desc, 1 limit 10")
def hot_callees(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("caller"), F.col("l_partkey").cast("string").alias("callee"))
    return calls.hot_functions(c)


@query(f"""{_R}{G.TALK}, up as (select '0:3' as id, 0 as d union select src, d + 1 from up join edges on dst = up.id where d < 10) select id, cast(min(d) as int) as distance from up group by 1 having min(d) > 0""")
def transitive_callers(spark, sf_dir):
    return calls.transitive(G.talk_calls(spark, sf_dir), "0:3")


@query(f"""{_R}{G.TALK}, down as (select '0:0' as id, 0 as d union select dst, d + 1 from down join edges on src = down.id where d < 2) select id, cast(min(d) as int) as distance from down group by 1 having min(d) > 0""")
def transitive_callees(spark, sf_dir):
    return calls.transitive(G.talk_calls(spark, sf_dir), "0:0", most=2, up=False)


@query(f"with {G.TALK} select count(*) as calls, count(*) as resolved, 1.0::double as resolution_rate, count(distinct src) as callers, count(distinct dst) as callees from edges")
def call_stats(spark, sf_dir):
    return calls.call_stats(G.talk_calls(spark, sf_dir))


# exports


@query(f"""{_COMP}, shown as (select id from nodes), hot as (select a.component, src, dst from edges join comp a on a.id = src join comp b on b.id = dst where a.component = b.component and a.component in (select component from large))
select '    _' || src || case when (src, dst) in (select (src, dst) from hot) then ' -.->|cycle| ' else ' --> ' end || '_' || dst as line from edges""")
def mermaid_edges(spark, sf_dir):
    g = G.keys(spark, sf_dir)
    return diagrams.mermaid_edges(g, g.nodes, g.cycles())

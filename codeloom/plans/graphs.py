"""Graphs and file tables derived from the relational tables, each with the SQL that derives the same.

- trade: nations; an edge from each to every nation whose customers buy of its suppliers;
- keys: orders and customers under one numbering; an edge from each order to its
  customer, so that a key which is both leads on: long paths into a few cycles;
- follow: parts; an edge where one part follows another in an order;
- flow: event types; an edge from the type of each event to that of the user's next;
- talk: turns of conversations; an edge from each to the next;
- tree: documents as files, source/lang/doc_id with a suffix by language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import SMALL_EDGES, CodeGraph
from .registry import table

#: Directories that stand for regions where paths are asked for.
REGION_DIRS = {"AFRICA": "components", "AMERICA": "handlers", "ASIA": "models", "EUROPE": "database", "MIDDLE EAST": "utils"}

TRADE = """nodes as (select n_name as id from nation),
edges as (select distinct sn.n_name as src, cn.n_name as dst
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey)"""
KEYS = """nodes as (select o_orderkey as id from orders union select o_custkey from orders),
edges as (select distinct o_orderkey as src, o_custkey as dst from orders)"""
FOLLOW = """nodes as (select p_partkey as id from part),
edges as (select distinct src, dst from (
  select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem) q where dst is not null)"""
FLOW = """edges as (select distinct src, dst from (
  select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) q where dst is not null),
nodes as (select src as id from edges union select dst from edges)"""
TALK = """edges as (select distinct a.conv_id || ':' || a.turn as src, b.conv_id || ':' || b.turn as dst
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
nodes as (select distinct conv_id || ':' || turn as id from conversations)"""
SUFFIX_SQL = "case lang when 'en' then '.py' when 'de' then '.ts' when 'fr' then '.go' else '.md' end"
TREE = f"""files as (select source || '/' || lang || '/' || doc_id || {SUFFIX_SQL} as path, source, lang, doc_id, text, n_chars as size_bytes,
  substr(sha256(text), 1, 16) as hash from documents)"""
#: Every node's component: the least of the nodes that it reaches and that reach it.
COMPONENTS = """reach as (select src, dst from edges union select reach.src, edges.dst from reach join edges on reach.dst = edges.src),
comp as (select n.id, coalesce((select min(a.dst) from reach a join reach b on b.src = a.dst and b.dst = a.src where a.src = n.id and a.dst <= n.id), n.id) as component from nodes n)"""
DEGREES = """ins as (select dst as id, count(*) as n from edges group by 1), outs as (select src as id, count(*) as n from edges group by 1),
degrees as (select nodes.id, cast(coalesce(ins.n, 0) as bigint) as in_degree, cast(coalesce(outs.n, 0) as bigint) as out_degree
  from nodes left join ins on ins.id = nodes.id left join outs on outs.id = nodes.id)"""


def pagerank_sql(iterations: int = 20) -> str:
    """scores(id, score) over nodes and edges, with the mass of nodes without edges out spread over all."""
    return f"""outdeg as (select src, count(*) as k from edges group by 1), total as (select count(*) as n from nodes),
ranks as (
  select 0 as i, id, 1.0::double / (select n from total) as score from nodes
  union all
  select t.i + 1, v.id, 0.15 / (select n from total) + 0.85 * t.lost / (select n from total) + 0.85 * coalesce(g.got, 0)
  from (select r.i, coalesce(sum(case when d.src is null then r.score end), 0) as lost from ranks r left join outdeg d on d.src = r.id where r.i < {iterations} group by r.i) t
    cross join nodes v left join (select e.dst, sum(r.score / d.k) as got from ranks r join edges e on e.src = r.id join outdeg d on d.src = e.src group by e.dst) g on g.dst = v.id),
scores as (select id, score / (select sum(score) from ranks where i = {iterations}) as score from ranks where i = {iterations})"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    name = lambda c: t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias(c))
    # the keys of both sides become nation names before the one large join, which then carries two narrow columns
    sold = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("key")), "l_suppkey").join(name("src"), "key").select("l_orderkey", "src").distinct()
    bought = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("key")), "c_custkey").join(name("dst"), "key").select(F.col("o_orderkey").alias("l_orderkey"), "dst")
    return sold.join(bought, "l_orderkey").select("src", "dst").distinct()


def trade(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph.of(trade_edges(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))).kept()


def keys(spark: SparkSession, sf_dir: str, small_edges: int = SMALL_EDGES) -> CodeGraph:
    return CodeGraph.of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), small_edges=small_edges, keep=True)


def region_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path: nations as files in a directory of their region."""
    dirs = F.create_map(*[F.lit(x) for kv in REGION_DIRS.items() for x in kv])
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.concat(dirs[F.col("r_name")], F.lit("/"), "n_name").alias("path"))


PATHS = f"""paths as (select n_name as id, case r_name {' '.join(f"when '{k}' then '{v}'" for k, v in REGION_DIRS.items())} end || '/' || n_name as path
  from nation join region on n_regionkey = r_regionkey)"""
TRADE_FILES = TRADE.replace("nodes as", "names as").replace("edges as", "links as") + f""", {PATHS},
nodes as (select path as id from paths), edges as (select a.path as src, b.path as dst from links join paths a on a.id = src join paths b on b.id = dst)"""


def trade_files(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The trade graph over the paths of its nations."""
    p = region_paths(spark, sf_dir)
    e = trade_edges(spark, sf_dir).join(p.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(p.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    return CodeGraph.of(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), p.select(F.col("path").alias("id"))).kept()


def follow(spark: SparkSession, sf_dir: str) -> CodeGraph:
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), nxt.alias("dst"))
    return CodeGraph.of(e, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


def flow(spark: SparkSession, sf_dir: str) -> CodeGraph:
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return CodeGraph.of(table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), nxt.alias("dst"))).kept()


def talk_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee of conversations: each turn calls the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda t: F.concat_ws(":", "conv_id", t)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.join(nxt, ["conv_id", "turn"], "left_semi").select(name(F.col("turn")).alias("caller"), name(F.col("turn") + 1).alias("callee"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, source, lang, doc_id, text, size_bytes, hash of documents as files."""
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".ts").when(F.col("lang") == "fr", ".go").otherwise(".md")
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"), "source", "lang", "doc_id", "text", F.col("n_chars").alias("size_bytes"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("hash"))

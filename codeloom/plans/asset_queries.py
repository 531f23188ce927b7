"""Queries of asset, map and store operators over tables taken as files of a game project."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coupling
from ..sinks import maps
from ..sources import freshness, game_project, manifest
from .graph_queries import _METRICS, _metrics
from .registry import query, table

_SUFFIXES = (".unity", ".prefab", ".PNG", ".cs", ".mat", ".wav", ".asset", ".fbx")
_FOLDERS = ("Assets/", "Assets/Plugins/Kit/", "Assets/Tests/", "Assets/Generated/Code/", "src/", "Library/", "Assets/Vendor/")
_case = lambda key, values: f"case {key} % {len(values)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"
_ASSETS = f"""assets as (select p_partkey as k, {_case('p_partkey', _FOLDERS)} || replace(p_name, ' ', '') || p_partkey || case when p_size % 5 = 0 then 'Test' else '' end || {_case('p_size', _SUFFIXES)} as path from part),
owned as (select *, case when path like 'Library/%' then 'generated' when path like 'Assets/Generated/%' then 'generated' when path like 'Assets/Plugins/%' or path like 'Assets/Vendor/%' then 'vendor' when path like 'Assets/%' then 'project-owned' else 'repository' end as owner from assets)"""


def _assets(spark, sf_dir):
    pick = lambda key, values: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    path = F.concat(pick("p_partkey", _FOLDERS), F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "Test").otherwise(""), pick("p_size", _SUFFIXES))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), path.alias("path"))


@query(f"""with {_ASSETS} select path, case lower(right(path, length(path) - strpos(path, '.') + 1)) when '.unity' then 'scene' when '.prefab' then 'prefab' when '.png' then 'texture' when '.mat' then 'material' when '.wav' then 'audio_clip' when '.fbx' then 'model' else 'asset' end as kind from assets""")
def asset_kinds(spark, sf_dir):
    return _assets(spark, sf_dir).select("path", game_project.kind(F.col("path")).alias("kind"))


@query(f"with {_ASSETS} select owner as ownership, count(*) as files from owned group by 1")
def asset_owners(spark, sf_dir):
    return game_project.owners(_assets(spark, sf_dir))


@query(f"with {_ASSETS} select path from (select path, owner from owned where path like '%/Tests/%' or path like '%Test.%' order by path limit 200) t where owner = 'project-owned'")
def project_tests(spark, sf_dir):
    return game_project.test_files(_assets(spark, sf_dir))


@query(f"with {_ASSETS} select distinct case when path like 'Assets/Plugins/%' then 'Assets/Plugins' else 'Assets/Vendor' end as root from owned where owner = 'vendor'")
def vendor_roots(spark, sf_dir):
    return game_project.owner_roots(_assets(spark, sf_dir), "vendor")


@query(f"with {_ASSETS} select path, k % 2 = 0 and path like 'Assets/%' as enabled, k % 2 = 0 and path like 'Assets/%' as in_build, owner as ownership from owned where path like '%.unity'")
def project_scenes(spark, sf_dir):
    """Every second scene below Assets is in the build, whose list is one file."""
    a = _assets(spark, sf_dir)
    listed = a.filter(F.col("path").endswith(".unity") & F.col("path").startswith("Assets/") & (F.col("k") % 2 == 0))
    text = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("  - enabled: 1\n    path: "), "path"))), "\n")
    build = listed.agg(text.alias("source")).select(F.lit(game_project.BUILD_FILE).alias("path"), "source")
    return game_project.scenes(a.select("path", F.lit(None).cast("string").alias("source")).unionByName(build))


@query("""select cast(p_partkey as varchar) as path, cast(p_size % 4 * 3 + p_size % 3 * 5 + p_size % 7 + p_size % 2 + p_size % 5 * 2 + case p_size % 3 when 0 then 4 when 1 then 2 else 0 end
  + case when p_size > 25 then 1 else 0 end + case when p_size % 6 > 1 then 3 else 0 end + case when p_retailprice > 1000 then 2 else 0 end as bigint) as score from part""")
def asset_signal(spark, sf_dir):
    s = F.col("p_size")
    kind = F.when(s % 3 == 0, "scriptable_object").when(s % 3 == 1, "sprite_atlas").otherwise("prefab")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("path"), kind.alias("kind"), (s % 4).alias("project_scripts"), (s % 3).alias("events"), (s % 7).alias("states"), (s % 2).alias("transitions"), (s % 5).alias("blend_trees"), (s > 25).alias("art"), (s % 6).alias("subassets"), (F.col("p_retailprice") > 1000).alias("own_importer"),
    )
    return game_project.high_signal(rows).select("path", F.col("score").cast("long").alias("score"))


@query("select cast(l_partkey as varchar) as path, case when count(case when l_returnflag in ('A') then 1 end) > 0 then 'partial' else 'exact' end as confidence from lineitem group by 1")
def asset_confidence(spark, sf_dir):
    c = F.when(F.col("l_returnflag") == "A", "unresolved").otherwise("exact")
    return game_project.asset_confidence(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), c.alias("confidence")))


@query("""with a as (select cast(p_partkey as varchar) as path, p_size % 9 + (p_size % 3) * 20 + (p_size % 2) * 30 + p_size % 4 * 2 + p_size % 5 as s, p_size from part)
select path, cast(s + case when p_size > 40 then 50 else 0 end as bigint) as score from a""")
def runtime_ranking(spark, sf_dir):
    s = F.col("p_size")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size")
    rows = t.select("path", (s % 9).alias("high_signal"), F.array_repeat(F.lit("s"), (s % 3).cast("int")).alias("scripts"), F.array_repeat(F.lit("e"), (s % 2).cast("int")).alias("events"), (s % 4).alias("states"), (s % 5).alias("transitions"))
    return maps.runtime_score(rows, t.filter("p_size > 40").select("path")).select("path", F.col("score").cast("long").alias("score"))


@query(f"""with {_ASSETS}, d as (select path, k % 97 / 100.0 as score from owned where owner in ('project-owned', 'repository') and path like '%.cs') select path, round(score::double, 6) as score from d order by d.score desc, path limit 12""")
def key_files(spark, sf_dir):
    a = _assets(spark, sf_dir).withColumn("language", F.when(F.col("path").endswith(".cs"), "csharp"))
    scores = a.select(F.col("path").alias("id"), (F.col("k") % 97 / 100.0).cast("double").alias("score"))
    return maps.key_files(a, scores).select("path", F.round("score", 6).alias("score"))


@query("""with t as (select n_name as source, c_name as callee, row_number() over (partition by n_name order by c_custkey) as turn from customer join nation on c_nationkey = n_nationkey),
p as (select *, row_number() over (order by turn, source) as place from t) select source, callee, cast(place as int) as place from p where place <= 15""")
def calls_in_turn(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), F.col("c_name").alias("callee"), "c_custkey")
    return maps.in_turn(t, "source", ["c_custkey"]).select("source", "callee", "place")


@query(f"{_METRICS} select id, ca, ce, round(d, 6) as d, zone from metrics order by metrics.d desc, id limit 20")
def coupling_worst(spark, sf_dir):
    return coupling.worst(_metrics(spark, sf_dir)).select("id", "ca", "ce", F.round("d", 6).alias("d"), "zone")


_PLACES = """a as (select p_brand || p_size as anchor, 'old/' || p_partkey as path, p_size as line from part), o as (select anchor, min((path, line)) as p from a group by 1),
b as (select p_brand || (p_size % 40) as anchor, 'new/' || p_partkey as path, p_size as line from part), n as (select anchor, min((path, line)) as p from b group by 1)"""


def _anchors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = lambda anchor, folder: p.select(F.concat("p_brand", anchor.cast("string")).alias("anchor"), F.concat(F.lit(folder), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("int").alias("line")).withColumn("location", F.concat_ws(":", "path", "line"))
    return freshness.update_anchors(row(F.col("p_size"), "old/"), row(F.col("p_size") % 40, "new/"), "now")


@query(f"with {_PLACES} select coalesce(n.anchor, o.anchor) as anchor, coalesce(n.p[1], o.p[1]) as path, cast(coalesce(n.p[2], o.p[2]) as int) as line from o full join n on o.anchor = n.anchor")
def anchor_places(spark, sf_dir):
    return _anchors(spark, sf_dir)[0].select("anchor", "path", "line")


@query(f"with {_PLACES} select o.anchor, o.p[1] || ':' || o.p[2] as old_location, n.p[1] || ':' || n.p[2] as new_location from o join n on o.anchor = n.anchor where o.p <> n.p")
def anchor_history(spark, sf_dir):
    return _anchors(spark, sf_dir)[1].select("anchor", "old_location", "new_location")


_OWN = "(not (x like 'Assets/Plugins/%' or x like 'Assets/Vendor/%' or x like 'Library/%' or x like 'Assets/Generated/%'))"


@query(f"""with {_ASSETS}, e as (select distinct a.path as src, b.path as dst from lineitem join assets a on a.k = l_partkey join assets b on b.k = l_suppkey)
select (select count(*) from assets) as files, (select count(*) from assets where path like '%.cs') as source_files, (select count(*) from customer) as symbols, (select count(*) from customer where c_acctbal > 0) as public_symbols,
  (select count(*) from e) as dependencies, (select count(*) from e where {_OWN.replace('x ', 'src ')} and {_OWN.replace('x ', 'dst ')}) as project_owned_dependencies,
  (select count(*) from lineitem where l_returnflag <> 'N') as semantic_csharp_dependencies, (select count(*) from lineitem where l_linestatus = 'O') as serialized_dependencies,
  (select count(*) from orders where o_orderstatus <> 'F') as roslyn_call_sites, (select count(*) from orders where o_orderstatus = 'F') as unity_event_calls, (select count(*) from orders) as call_sites,
  (select count(distinct k % 10) from assets) as cycles, (select count(*) from (select k % 10 from assets group by 1 having bool_and({_OWN.replace('x ', 'path ')})) q) as project_owned_cycles""")
def manifest_metrics(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    a = _assets(spark, sf_dir)
    at = lambda key, name: a.select(F.col("k").alias(key), F.col("path").alias(name))
    edges = t("lineitem").join(at("l_partkey", "src"), "l_partkey").join(at("l_suppkey", "dst"), "l_suppkey").select("src", "dst").distinct()
    evidence = t("lineitem").select(F.array(F.when(F.col("l_linestatus") == "O", "unity_event").otherwise("import")).alias("kinds"), F.when(F.col("l_returnflag") == "A", "mixed").when(F.col("l_returnflag") == "R", "roslyn").otherwise("regex").alias("engine"))
    calls = t("orders").select(F.when(F.col("o_orderstatus") == "F", "unity_event").otherwise("call").alias("kind"))
    files = a.withColumn("language", F.when(F.col("path").endswith(".cs"), "csharp"))
    return manifest.project_metrics(files, t("customer").select((F.col("c_acctbal") > 0).alias("exported")), edges, evidence, calls, a.select((F.col("k") % 10).alias("component"), F.col("path").alias("id")))




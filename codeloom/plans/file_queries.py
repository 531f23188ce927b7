"""Queries of file, text, snapshot and resolution operators over documents and pages taken as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, paths, text
from ..functions.ignore import ignored
from ..operators import resolve, select, snapshots, trees
from . import graphs as G
from .registry import query, table

_T = f"with {G.TREE}"


@query(f"""{_T}, dirs as (select source || '/' || lang as directory, source as parent, size_bytes from files),
each as (select '' as directory, 0 as direct, size_bytes from dirs union all select parent, 0, size_bytes from dirs union all select directory, 1, size_bytes from dirs),
subs as (select '' as directory, count(distinct parent) as n from dirs union all select parent, count(distinct directory) from dirs group by 1)
select e.directory, count(*) as total_files, cast(sum(direct) as bigint) as direct_files, coalesce(max(n), 0) as subdirectories, cast(sum(size_bytes) as bigint) as size_bytes from each e left join subs on subs.directory = e.directory group by 1""")
def dir_rollup(spark, sf_dir):
    return trees.rollup(G.tree(spark, sf_dir))


@query(f"""{_T}, each as (select '' as directory, lang as language from files union all select source, lang from files union all select source || '/' || lang, lang from files)
select directory, language, count(*) as files from each group by 1, 2""")
def dir_languages(spark, sf_dir):
    return trees.language_rollup(G.tree(spark, sf_dir).withColumn("language", F.col("lang")))


@query(f"""{_T}, d as (select '' as directory, 0 as n union all select source, 0 from files group by 1 union all select source || '/' || lang, count(*) from files group by 1) select directory, cast(n as bigint) as file_count from d""")
def dir_tree(spark, sf_dir):
    return trees.directories(G.tree(spark, sf_dir)).select("directory", "file_count")


@query(f"{_T} select {G.SUFFIX_SQL} as extension, count(*) as files, cast(sum(size_bytes) as bigint) as size_bytes from files group by 1")
def inventory_summary(spark, sf_dir):
    return trees.inventory(G.tree(spark, sf_dir))


@query(f"{_T} select case lang when 'en' then 'python' when 'de' then 'typescript' when 'fr' then 'go' else 'markdown' end as language, count(*) as files from files group by 1")
def language_counts(spark, sf_dir):
    return G.tree(spark, sf_dir).groupBy(classify.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query("""select layer, count(*) as pages from (select case when regexp_matches(p, 'component|dialog|form|layout|modal|page|screen|template|ui|view|widget') then 'presentation'
  when regexp_matches(p, 'action|api|command|controller|endpoint|handler|queries|query|route|use-case|use_case|usecase') then 'application'
  when regexp_matches(p, 'aggregate|business|core|domain|entities|entity|model|repositories|repository|service|value') then 'domain'
  when regexp_matches(p, 'adapter|cache|client|database|db|driver|external|gateway|http|integration|messaging|persistence|provider|queue|storage') then 'infrastructure'
  when regexp_matches(p, 'common|config|constant|dto|helper|interface|lib|schema|shared|type|util') then 'shared' end as layer from (select lower(url) as p from pages) u) q group by 1""")
def layer_from_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(classify.layer_from_path(F.col("url")).alias("layer")).agg(F.count(F.lit(1)).alias("pages"))


_OWN_PATHS = """own as (select p_partkey, case p_size % 7 when 0 then 'Assets/' || p_name || '.cs' when 1 then 'Assets/Plugins/' || p_name || '.cs' when 2 then 'Packages/' || p_name || '.json'
  when 3 then 'ProjectSettings/' || p_name when 4 then 'Library/' || p_name when 5 then p_name || '.csproj' else 'src/' || p_name || '.py' end as path from part)"""


def _own_paths(spark, sf_dir):
    k, n = F.col("p_size") % 7, F.col("p_name")
    c = lambda a, b="": F.concat(F.lit(a), n, F.lit(b))
    path = F.when(k == 0, c("Assets/", ".cs")).when(k == 1, c("Assets/Plugins/", ".cs")).when(k == 2, c("Packages/", ".json")).when(k == 3, c("ProjectSettings/")).when(k == 4, c("Library/")).when(k == 5, c("", ".csproj")).otherwise(c("src/", ".py"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@query(f"""with {_OWN_PATHS} select case when path like '%.csproj' then 'unity-generated' when path like 'Library/%' then 'generated' when path like 'Packages/%' then 'package' when path like 'ProjectSettings/%' then 'project-configuration'
  when path like 'Assets/Plugins/%' then 'vendor' when path like 'Assets/%' then 'project-owned' else 'repository' end as ownership, count(*) as files from own group by 1""")
def ownership_class(spark, sf_dir):
    return _own_paths(spark, sf_dir).groupBy(classify.ownership(F.col("path")).alias("ownership")).agg(F.count(F.lit(1)).alias("files"))


@query(f"with {_OWN_PATHS} select p_partkey, path from own where not (path like 'Library/%' or path like '%.csproj' or (path like 'Packages/%' and path not like 'Packages/s%'))")
def ignore_rules(spark, sf_dir):
    df = _own_paths(spark, sf_dir)
    return df.filter(~ignored(F.col("path"), ["Library/", "*.csproj", "Packages/", "!Packages/s*"]))


@query("""with items as (select url as item from pages union all select '@pages/' || page_id from pages)
select item, starts_with(item, '@') as external, (contains(lower(item), 'tests/') or contains(lower(item), '/test/')) as is_test from items""")
def path_predicates(spark, sf_dir):
    """Addresses, and packages of a scope."""
    p, u = table(spark, sf_dir, "pages"), F.col("item")
    return p.select(F.explode(F.array("url", F.concat(F.lit("@pages/"), F.col("page_id").cast("string")))).alias("item")).select(u.alias("item"), classify.looks_external(u).alias("external"), classify.is_test_file(u).alias("is_test"))


@query("select page_id, translate(url, '/.- ()[]', '________') as node from pages")
def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.node_id(F.col("url")).alias("node"))


# text


@query("select lang, cast(sum(greatest(1, length(text) // 4)) as bigint) as tokens, max(greatest(1, length(text) // 4)) as largest from documents group by 1")
def token_estimate(spark, sf_dir):
    t = text.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(t).alias("tokens"), F.max(t).alias("largest"))


@query("""select page_id, cast(len(list_distinct(list_transform(regexp_extract_all(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)))) as int) as tokens from pages""")
def semantic_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.semantic_tokens(F.col("url"))).alias("tokens"))


@query("""with t as (select page_id, list_transform(regexp_extract_all(url, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from (select page_id, regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as url from pages) u)
select page_id, round(((case when list_contains(w, 'blog') then 1 else 0 end + case when list_contains(w, 'https') then 1 else 0 end) / 2.0
  + (case when list_contains(w, 'example') then 1 else 0 end + case when list_contains(w, 'en') then 1 else 0 end + case when list_contains(w, 'html') then 1 else 0 end) / 3.0) / 2, 6) as relevance from t""")
def relevance(spark, sf_dir):
    r = text.relevance(text.semantic_tokens(F.col("url")), ["blog", "https"], "example en html")
    return table(spark, sf_dir, "pages").select("page_id", F.round(r, 6).alias("relevance"))


# snapshots

_NORMAL = "substr(sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))), 1, 16)"


@query(f"with {G.TREE}, a as (select path as location, {_NORMAL} as anchor from files) select anchor, count(*) as copies, min(location) as first_location from a group by 1 having count(*) > 1")
def anchor_dups(spark, sf_dir):
    return snapshots.duplicate_anchors(G.tree(spark, sf_dir).select(F.col("path").alias("location"), text.sha16(text.collapse(F.col("text")).cast("binary")).alias("anchor")))


@query(f"{_T} select substr(sha256(string_agg(path || ':' || hash, '|' order by path)), 1, 16) as source_hash from files")
def source_hash(spark, sf_dir):
    return snapshots.source_hash(G.tree(spark, sf_dir))


_SNAPS = """a as (select cast(o_custkey as varchar) as path, cast(count(*) as varchar) as hash from orders where o_orderdate < timestamp '1995-07-01' group by 1),
b as (select cast(o_custkey as varchar) as path, cast(count(*) as varchar) as hash from orders where o_orderdate >= timestamp '1995-07-01' group by 1),
d as (select coalesce(a.path, b.path) as path, case when a.hash is null then 'added' when b.hash is null then 'removed' when a.hash = b.hash then 'unchanged' else 'modified' end as state from a full join b on a.path = b.path)"""


def _half(spark, sf_dir, late):
    """Customers with the number of their orders before or from the middle of the period on."""
    middle = F.lit("1995-07-01").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= middle if late else F.col("o_orderdate") < middle)
    return o.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.count(F.lit(1)).cast("string").alias("hash"))


@query(f"with {_SNAPS} select path, state from d")
def snapshot_diff(spark, sf_dir):
    """Customers with the number of their orders as their hash, in both halves of the period."""
    return snapshots.diff(_half(spark, sf_dir, False), _half(spark, sf_dir, True))


@query(f"with {_SNAPS} select count(case when state <> 'unchanged' then 1 end) > 0 as is_stale, count(case when state = 'modified' then 1 end) as changed, count(case when state = 'added' then 1 end) as added, count(case when state = 'removed' then 1 end) as removed from d")
def staleness(spark, sf_dir):
    return snapshots.staleness(_half(spark, sf_dir, False), _half(spark, sf_dir, True))


@query(f"with {_SNAPS} select path, hash from b where (path, hash) not in (select (path, hash) from a)")
def cache_misses(spark, sf_dir):
    return snapshots.split_by_cache(_half(spark, sf_dir, True), _half(spark, sf_dir, False))[1]


@query(f"with {_SNAPS}, h as (select count(*) as n, count(case when exists (select 1 from a where a.path = b.path and a.hash = b.hash) then 1 end) as hits from b) select hits, n - hits as misses, coalesce(100.0 * hits / nullif(n, 0), 100.0)::double as hit_rate from h")
def cache_hit_rate(spark, sf_dir):
    return snapshots.hit_rate(_half(spark, sf_dir, True), _half(spark, sf_dir, False))


@query(f"""with {G.TREE}, o as (select {_NORMAL} as anchor, min(path) as old_location from files group by 1), n as (select {_NORMAL} as anchor, min(lang || '/' || path) as new_location from files group by 1)
select anchor, old_location, new_location from o join n using (anchor) where old_location <> new_location""")
def anchor_moves(spark, sf_dir):
    """All files, moved into a directory of their language."""
    c = G.tree(spark, sf_dir).select("lang", F.col("path").alias("location"), text.sha16(text.collapse(F.col("text")).cast("binary")).alias("anchor"))
    return snapshots.anchor_moves(c, c.withColumn("location", F.concat("lang", F.lit("/"), "location")))


@query("select 'repeated chunk' as problem, cast(l_orderkey as varchar) || ':' || l_linenumber as subject from lineitem group by 2 having count(*) > 1 union all select 'dangling edge', cast(o_custkey as varchar) from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer)) q")
def validate_tables(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    files = t("customer").select(F.col("c_custkey").cast("string").alias("path"))
    chunks = t("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    edges = t("orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_custkey").cast("string").alias("dst"))
    return snapshots.validate(files, chunks, edges)


# import resolution: every document imports the next of its source by its dotted name, itself by its path, and an outer package

_IMPORTS = f"""{G.TREE}, named as (select *, lead(source || '.' || lang || '.' || doc_id) over (partition by source order by doc_id) as nxt, lead(path) over (partition by source order by doc_id) as nxt_path from files),
found as (select path, nxt as module, nxt_path as target, 1.0::double as confidence, false as is_external from named where nxt is not null
  union all select path, path, path, 1.0, false from named union all select path, 'react', null, 0.0, true from named union all select path, 'nowhere.at.all', null, 0.3, false from named)"""


def _resolved(spark, sf_dir):
    from pyspark.sql import Window

    files = G.tree(spark, sf_dir)
    module = F.lead(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string"))).over(Window.partitionBy("source").orderBy("doc_id"))
    rows = files.withColumn("next", module).select("path", F.explode(F.array("next", "path", F.lit("react"), F.lit("nowhere.at.all"))).alias("module")).filter("module is not null")
    return resolve.resolve(rows, files.select("path"))


@query(f"with {_IMPORTS} select * from found")
def resolve_imports(spark, sf_dir):
    return _resolved(spark, sf_dir).select("path", "module", "target", "confidence", "is_external")


@query(f"with {_IMPORTS} select distinct path as src, target as dst from found where target is not null")
def internal_edges(spark, sf_dir):
    return resolve.internal_edges(_resolved(spark, sf_dir))


@query(f"""with {_IMPORTS} select count(*) as imports, count(target) as resolved, count(case when is_external then 1 end) as external, count(case when target is null and not is_external then 1 end) as unresolved,
  round(count(target)::double / count(case when not is_external then 1 end), 6) as resolution_rate from found""")
def resolution_stats(spark, sf_dir):
    return resolve.resolution_stats(_resolved(spark, sf_dir)).withColumn("resolution_rate", F.round("resolution_rate", 6))


@query("select 'react' as package from documents having count(*) > 0")
def external_packages(spark, sf_dir):
    return resolve.external_packages(_resolved(spark, sf_dir))


# selection

_SCORED = "s as (select cast(p_partkey as varchar) as id, p_retailprice as score, p_size * 100 as size_bytes from part)"


@query(f"""with recursive {_SCORED}, r as (select id, cast(floor(size_bytes / 50.0 * 4) as bigint) as tokens, row_number() over (order by score desc, id) as k from s),
fold as (select 0::bigint as k, null::varchar as id, 0::bigint as tokens, 0::bigint as used, false as taken union all
  select r.k, r.id, r.tokens, case when f.used + r.tokens <= 5000 then f.used + r.tokens else f.used end, f.used + r.tokens <= 5000 from fold f join r on r.k = f.k + 1)
select id, tokens, used from fold where taken""")
def budget_prefix(spark, sf_dir):
    """Parts as files by price, within 5000 tokens; those that don't fit are passed over."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("score"), (F.col("p_size") * 100).alias("size_bytes"))
    return select.within_budget(files, 5000)


def _prepared(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    scores = t("part").select(F.col("p_brand").alias("id"), "p_retailprice").groupBy("id").agg((F.sum("p_retailprice") / 1e6).alias("score"))
    chunks = t("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), (F.col("p_size") % 2 == 0).alias("exported"), (F.col("p_size") * 7).cast("long").alias("tokens"), F.lit("").alias("description"))
    return select.prepare(chunks, scores, ["red", "widget"], "economy ring")


@query("""with s as (select p_brand as brand, sum(p_retailprice) / 1e6 as score from part group by 1),
w as (select 'part:' || p_partkey as id, p_brand, p_size, score, regexp_extract_all(lower(p_brand || ' ' || p_name || ' ' || p_type), '[a-z0-9]+') as t from part join s on brand = p_brand where p_size * 7 >= 10),
r as (select id, p_size * 7 as tokens, score, ((list_contains(t, 'red')::int + list_contains(t, 'widget')::int) / 2.0 + (list_contains(t, 'economy')::int + list_contains(t, 'ring')::int) / 2.0) / 2 as rel, p_size from w)
select id, cast(tokens as bigint) as tokens, round(rel, 6) as relevance, round(score * rel * case when p_size % 2 = 0 then 1.2 else 1.0 end, 6) as base_score from r""")
def portfolio_candidates(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "tokens", F.round("relevance", 6).alias("relevance"), F.round("base_score", 6).alias("base_score"))


@query()
def portfolio_greedy(spark, sf_dir):
    """Sequential by nature; tests hold it against a brute-force version."""
    return select.optimize(_prepared(spark, sf_dir), 2000, filtered=True)


@query()
def portfolio_knapsack(spark, sf_dir):
    return select.optimize(_prepared(spark, sf_dir), 2000, "knapsack", filtered=True)

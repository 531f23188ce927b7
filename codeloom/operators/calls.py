"""Call graphs: call sites in chunks, resolution, callers and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import CodeGraph
from .resolve import first_rows

#: Names that look like calls and are none worth following, by language.
NOT_CALLS = {
    "python": "False None True abs all and any as assert async await bool break callable class continue def delattr dict elif else enumerate except filter finally float for from getattr global hasattr if import in int is isinstance issubclass iter lambda len list map max min next nonlocal not open or pass print raise range return reversed round set setattr sorted str sum super try tuple type while with yield zip",
    "javascript": "Array Boolean Date Error JSON Map Math Number Object Promise RegExp Set String async await break case catch class console const continue default delete do else export extends false finally for from function if import in instanceof let new null of require return super switch this throw true try typeof undefined var void while yield",
    "typescript": "Array Boolean Date Error JSON Map Math Number Object Promise RegExp Set String abstract as async await break case catch class console continue default delete do else enum export extends false finally for from if implements import in instanceof interface is new null of private protected public readonly require return static super switch this throw true try type typeof undefined void while yield",
    "go": "append bool break cap case chan close const continue copy default defer delete else error false float64 for func go if import int interface len make map new nil package panic print println range recover return select string struct switch true type var",
}


def call_sites(lines: DataFrame, skip_definition: bool = False) -> DataFrame:
    """caller, path, language, name, line of every call in lines(caller, path, language, line, text[, first_line]).

    Comment lines are left out.  Plain calls are names before '(' that no letter, '_'
    or '.' precedes, without leading '_'; calls of methods are names after a '.'.
    """
    t = F.trim(F.col("text"))
    df = lines.filter(~t.startswith("#") & ~t.startswith("//"))
    if skip_definition:
        df = df.filter("line <> first_line")
    script = F.col("language").isin("typescript", "javascript")
    generic = F.when(F.col("language") == "typescript", F.regexp_replace("text", r"<[^<>()]+>(?=\s*\()", "")).otherwise(F.col("text"))
    found = lambda mark, word: F.regexp_extract_all(generic, F.lit(mark + "(" + word + r")\s*\("), 1)
    word, dollar = "[A-Za-z_][A-Za-z0-9_]*", "[A-Za-z_$][A-Za-z0-9_$]*"
    plain = F.filter(F.when(script, found(r"(?<![A-Za-z_.])", dollar)).otherwise(found(r"(?<![A-Za-z_.])", word)), lambda x: ~x.startswith("_"))
    method = F.when(script, found(r"\.", dollar)).otherwise(found(r"\.", word))
    each = df.select("caller", "path", "language", "line", F.explode(F.concat(plain, method)).alias("name"))
    skip = F.lit(False)
    for lang, names in NOT_CALLS.items():
        skip = skip | ((F.col("language") == lang) & F.col("name").isin(*names.split()))
    return each.filter(F.col("language").isin(*NOT_CALLS) & ~skip)


def resolve_calls(sites: DataFrame, chunks: DataFrame, resolved_imports: DataFrame | None = None) -> DataFrame:
    """sites with callee: a chunk of the same file, else one imported, else any function, method or class of that name.

    Of several the first by path and line.  resolved_imports(path, target, symbols);
    an import without symbols offers every name.
    """
    own = first_rows(chunks, ["path", "name"], ["start_line", "id"]).select("path", "name", F.col("id").alias("own"))
    wide = first_rows(chunks.filter(F.col("type").isin("function", "method", "class")), ["name"], ["path", "start_line", "id"]).select("name", F.col("id").alias("wide"))
    df = sites.join(own, ["path", "name"], "left").join(wide, "name", "left")
    if resolved_imports is not None:
        offers = resolved_imports.filter("target is not null").select("path", "target", "symbols").join(own.select(F.col("path").alias("target"), "name", "own"), "target")
        offers = offers.filter((F.size("symbols") == 0) | F.array_contains("symbols", F.col("name")))
        offers = first_rows(offers, ["path", "name"], ["target"]).select("path", "name", F.col("own").alias("via"))
        df = df.join(offers, ["path", "name"], "left")
    else:
        df = df.withColumn("via", F.lit(None).cast("string"))
    return df.select(*sites.columns, F.coalesce("own", "via", "wide").alias("callee"))


def callers(calls: DataFrame) -> DataFrame:
    """callee, callers (one entry a call)."""
    return calls.filter("callee is not null").groupBy("callee").agg(F.sort_array(F.collect_list("caller")).alias("callers"))


def callees(calls: DataFrame) -> DataFrame:
    return calls.filter("callee is not null").groupBy("caller").agg(F.sort_array(F.collect_list("callee")).alias("callees"))


def hot_functions(calls: DataFrame, k: int = 10) -> DataFrame:
    """callee, calls: those called most, repeated calls counted."""
    return calls.filter("callee is not null").groupBy("callee").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "callee").limit(k)


def entry_points(calls: DataFrame) -> DataFrame:
    """id of callers that nothing calls."""
    c = calls.filter("callee is not null")
    return c.select(F.col("caller").alias("id")).distinct().join(c.select(F.col("callee").alias("id")), "id", "left_anti")


def leaves(calls: DataFrame) -> DataFrame:
    """id of callees that call nothing."""
    c = calls.filter("callee is not null")
    return c.select(F.col("callee").alias("id")).distinct().join(c.select(F.col("caller").alias("id")), "id", "left_anti")


def transitive(calls: DataFrame, start: str, most: int = 10, up: bool = True) -> DataFrame:
    """id, distance of all callers (or callees) within ``most`` calls."""
    edges = calls.filter("callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return CodeGraph.of(edges).distances(start, most, forward=not up).filter("distance > 0")


def call_stats(calls: DataFrame) -> DataFrame:
    done = F.count_if(F.col("callee").isNotNull())
    n = F.count(F.lit(1))
    return calls.agg(n.alias("calls"), done.alias("resolved"), F.coalesce(F.try_divide(done, n), F.lit(1.0)).alias("resolution_rate"), F.countDistinct(F.when(F.col("callee").isNotNull(), F.col("caller"))).alias("callers"), F.countDistinct("callee").alias("callees"))

"""Import resolution as joins against an index of module names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import looks_external
from ..functions.paths import basename, dirname, stem

EXACT, HEURISTIC, UNRESOLVED, EXTERNAL = 1.0, 0.7, 0.3, 0.0


def file_index(files: DataFrame) -> DataFrame:
    """key, path: the names under which files(path) can be imported.

    The exact path wins over all; of other files with the same name the first by path.
    """
    p = F.col("path")
    s, d = stem(p), dirname(p)
    package = F.when(p.endswith("__init__.py") & (d != ""), d)
    names = [s, F.replace(s, F.lit("/"), F.lit(".")), basename(s), package, F.replace(package, F.lit("/"), F.lit(".")), F.when((basename(s) == "index") & (d != ""), d)]
    keys = F.array(F.struct(p.alias("key"), F.lit(0).alias("rank")), *[F.struct(n.alias("key"), F.lit(1).alias("rank")) for n in names])
    each = files.select("path", F.explode(keys).alias("k")).select("path", "k.key", "k.rank").filter("key is not null")
    first = each.groupBy("key").agg(F.min(F.struct("rank", "path")).alias("m"))
    return first.select("key", F.col("m.path").alias("path"))


def _relative_candidate(fix_python: bool):
    """The path that a relative specifier names, null where it climbs above the root."""
    spec, src = F.col("module"), F.col("path")
    ups = F.length(F.regexp_extract(spec, r"^((?:\.\.(?:/|(?=[^/])|$))*)", 1))
    climbed = F.regexp_extract(spec, r"^((?:\.\./?)*)", 1)
    count = F.size(F.regexp_extract_all(climbed, F.lit(r"(\.\.)"), 1))
    rest = F.regexp_replace(F.substring(spec, F.length(climbed) + 1, 10_000), r"^\./", "")
    parts = F.when(dirname(src) == "", F.array().cast("array<string>")).otherwise(F.split(dirname(src), "/"))
    if fix_python:
        dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
        python = src.rlike(r"\.pyi?$") & spec.rlike(r"^\.+\w")
        count = F.when(python, dots - 1).otherwise(count)
        rest = F.when(python, F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))).otherwise(rest)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - count, F.lit(0))), "/")
    del ups
    return F.when(count > F.size(parts), None).when(base == "", rest).otherwise(F.concat_ws("/", base, rest))


def resolve(imports: DataFrame, files: DataFrame, fix_python_relative: bool = False) -> DataFrame:
    """imports(path, module, ...) with target, confidence and is_external.

    A relative import is looked up by its candidate path, then without its suffix;
    another by its specifier, with dots as slashes, then by its first part.  What
    isn't found and looks like a package is external.  With ``fix_python_relative``
    leading dots of Python imports count directories as the language means them.
    """
    index = file_index(files)
    spec = F.col("module")
    relative = spec.startswith(".")
    cand = _relative_candidate(fix_python_relative)
    keys = imports.withColumns({
        "k1": F.when(relative, cand).otherwise(spec),
        "k2": F.when(relative, stem(cand)).otherwise(F.replace(spec, F.lit("."), F.lit("/"))),
        "k3": F.when(~relative & spec.contains("."), F.split(spec, r"\.")[0]),
    })
    for k in ("k1", "k2", "k3"):
        keys = keys.join(index.select(F.col("key").alias(k), F.col("path").alias(f"{k}_path")), k, "left")
    target = F.coalesce("k1_path", "k2_path", "k3_path")
    external = target.isNull() & looks_external(spec)
    confidence = F.when(F.coalesce("k1_path", "k2_path").isNotNull(), EXACT).when(F.col("k3_path").isNotNull(), HEURISTIC).when(external, EXTERNAL).otherwise(UNRESOLVED)
    return keys.select(*imports.columns, target.alias("target"), confidence.alias("confidence"), external.alias("is_external"))


def external_packages(resolved: DataFrame) -> DataFrame:
    """package: the first part of external specifiers, two parts for scoped ones."""
    spec = F.col("module")
    name = F.when(spec.startswith("@"), F.array_join(F.slice(F.split(spec, "/"), 1, 2), "/")).otherwise(F.split(spec, "[/.]")[0])
    return resolved.filter("is_external").select(name.alias("package")).distinct()


def internal_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def resolution_stats(resolved: DataFrame) -> DataFrame:
    inner = ~F.col("is_external")
    done = F.count_if(F.col("target").isNotNull())
    return resolved.agg(F.count(F.lit(1)).alias("imports"), done.alias("resolved"), F.count_if(F.col("is_external")).alias("external"), F.count_if(inner & F.col("target").isNull()).alias("unresolved"), F.coalesce(F.try_divide(done, F.count_if(inner)), F.lit(1.0)).alias("resolution_rate"))


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")

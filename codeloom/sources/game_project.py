"""Facts of game projects, from files(path, source): settings, packages, scenes, assemblies, tests, owners.

Each is a plan over the few files that tell it; nothing but lists of one value a
project is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ownership
from ..functions.paths import basename, dirname, extension, stem

SETTINGS_FILE, VERSION_FILE, BUILD_FILE, PACKAGES_FILE = "ProjectSettings/ProjectSettings.asset", "ProjectSettings/ProjectVersion.txt", "ProjectSettings/EditorBuildSettings.asset", "Packages/manifest.json"
_KINDS = {
    "scene": ".unity", "prefab": ".prefab", "animator_controller": ".controller", "override_controller": ".overridecontroller", "animation_clip": ".anim", "material": ".mat", "model": ".fbx",
    "texture": ".png .jpg .jpeg .tga .tif .tiff .psd .exr .hdr .bmp", "sprite_atlas": ".spriteatlas", "shader": ".shader .shadergraph .shadersubgraph", "audio_clip": ".wav .mp3 .ogg .aif .aiff .flac",
    "video_clip": ".mp4 .mov .webm .avi", "font": ".ttf .otf",
}
VENDOR_FOLDERS = ("plugins", "thirdparty", "third-party", "third_party", "vendor", "external")
GENERATED_FOLDERS = ("generated", "gen", "autogenerated", "auto-generated")
MOST_ROOTS, MOST_TESTS = 50, 200


def kind(path: Column) -> Column:
    """What an asset is, by its suffix."""
    found, ext = F.lit("asset"), F.lower(extension(path))
    for name, own in _KINDS.items():
        found = F.when(ext.isin(*own.split()), name).otherwise(found)
    return found


def _one(files: DataFrame, path: str) -> DataFrame:
    return files.filter((F.col("path") == path) & F.col("source").isNotNull())


def settings(files: DataFrame) -> DataFrame:
    """key, value: unity_version, product_name, bundle_version, company_name where they are told."""
    x = lambda c, key: F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^\s*{key}:[ \t]*(.*?)\s*$", 1)), F.lit(""))
    keys = {"unity_version": (VERSION_FILE, "m_EditorVersion"), "product_name": (SETTINGS_FILE, "productName"), "bundle_version": (SETTINGS_FILE, "bundleVersion"), "company_name": (SETTINGS_FILE, "companyName")}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.when(F.col("path") == at, x("source", key)).alias("value")) for k, (at, key) in keys.items()])
    return files.filter(F.col("path").isin(SETTINGS_FILE, VERSION_FILE) & F.col("source").isNotNull()).select(F.explode(rows).alias("r")).select("r.key", "r.value").filter("value is not null")


def packages(files: DataFrame) -> DataFrame:
    """name, version, source (local, git, registry) of the declared packages; of local ones the folder's name alone is told."""
    each = F.explode(F.from_json(F.get_json_object("source", "$.dependencies"), "map<string,string>")).alias("name", "version")
    v = F.col("version")
    source = F.when(v.startswith("file:"), "local").when(v.startswith("git") | v.contains(".git"), "git").otherwise("registry")
    local = F.concat(F.lit("file:"), F.coalesce(F.nullif(F.regexp_extract(v, r"([^/\\:]+)[/\\]*$", 1), F.lit("")), F.lit("<local>")))
    return _one(files, PACKAGES_FILE).select(each).select("name", F.when(v.startswith("file:"), local).otherwise(v).alias("version"), source.alias("source"))


def build_scenes(files: DataFrame) -> DataFrame:
    """path, enabled of the scenes of the build, the last mention of each."""
    entries = F.regexp_extract_all("source", F.lit(r"(?s)enabled:\s*(\d+).*?path:[ \t]*(Assets/[^\n]*\.unity)"), F.lit(0))
    each = _one(files, BUILD_FILE).select(F.posexplode(entries).alias("n", "e")).select("n", F.regexp_extract("e", r"path:[ \t]*(Assets/[^\n]*\.unity)", 1).alias("path"), (F.regexp_extract("e", r"enabled:\s*(\d+)", 1) == "1").alias("enabled"))
    return each.groupBy("path").agg(F.max_by("enabled", "n").alias("enabled"))


def scenes(files: DataFrame) -> DataFrame:
    """path, enabled, in_build, ownership of all scenes, in the tree or the build."""
    build = build_scenes(files).withColumn("in_build", F.lit(True))
    own = files.filter(F.lower(extension(F.col("path"))) == ".unity").select("path")
    j = own.join(build, "path", "full_outer")
    return j.select("path", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("in_build", F.lit(False)).alias("in_build"), ownership(F.col("path")).alias("ownership"))


def assemblies(files: DataFrame) -> DataFrame:
    """path, name, references, auto_referenced of assembly definitions; broken ones are left out."""
    s = F.from_json("source", "name string, references array<string>, autoReferenced boolean, broken string", {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
    d = files.filter(F.col("path").endswith(".asmdef") & F.col("source").isNotNull()).select("path", s.alias("s")).filter("s is not null and s.broken is null")
    return d.select("path", F.coalesce("s.name", stem(basename(F.col("path")))).alias("name"), F.coalesce("s.references", F.array().cast("array<string>")).alias("references"), F.coalesce("s.autoReferenced", F.lit(True)).alias("auto_referenced"))


def is_test_path(path: Column) -> Column:
    """In a folder of tests, or with a test's name."""
    name = stem(basename(path))
    folder = F.exists(F.split(F.lower(dirname(path)), "/"), lambda x: x.isin("test", "tests"))
    return (F.lower(extension(path)) != ".meta") & (folder | name.startswith("test_") | name.rlike("(_test|_tests|Test|Tests)$"))


def test_files(files: DataFrame, owner: str = "project-owned", most: int = MOST_TESTS) -> DataFrame:
    """path of the first ``most`` tests of an owner; the limit is taken over the tests of all owners, by path."""
    return files.filter(is_test_path(F.col("path"))).select("path").orderBy("path").limit(most).filter(ownership(F.col("path")) == owner)


def owners(files: DataFrame) -> DataFrame:
    """ownership, files."""
    return files.groupBy(ownership(F.col("path")).alias("ownership")).agg(F.count(F.lit(1)).alias("files"))


def owner_roots(files: DataFrame, owner: str, most: int = MOST_ROOTS) -> DataFrame:
    """root: the first folders, by name, that hold vendor or generated files.

    A root ends at the folder whose name tells the owner, or else after two parts.
    """
    p = F.regexp_replace("path", r"\.meta$", "")
    parts = F.split(p, "/")
    inner = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    names = GENERATED_FOLDERS if owner == "generated" else VENDOR_FOLDERS
    tells = lambda x: F.lower(x).isin(*names) | (F.lower(x).startswith("generated") if owner == "generated" else F.lit(False))
    hit = F.array_position(F.transform(inner, tells), True)
    root = F.array_join(F.slice(parts, F.lit(1), F.when(hit > 0, hit).otherwise(F.least(F.lit(2), F.size(parts))).cast("int")), "/")
    return files.filter(ownership(F.col("path")) == owner).select(root.alias("root")).distinct().orderBy("root").limit(most)


def hint_paths(files: DataFrame) -> DataFrame:
    """project, hint: assemblies that C# project files name, without those that hold a variable."""
    found = F.regexp_extract_all("source", F.lit(r"(?is)<HintPath>(.*?)</HintPath>"), F.lit(1))
    h = F.replace(F.trim("hint"), F.lit("\\"), F.lit("/"))
    return files.filter(F.col("path").endswith(".csproj") & F.col("source").isNotNull()).select(F.col("path").alias("project"), F.explode(found).alias("hint")).filter(~F.col("hint").contains("$")).select("project", h.alias("hint"))


def reference_assemblies(files: DataFrame) -> DataFrame:
    """path of built assemblies beside those that the tree's own definitions make: in the script folder, or hinted at."""
    made = assemblies(files).select("name").union(files.sparkSession.createDataFrame([("Assembly-CSharp",), ("Assembly-CSharp-Editor",)], "name string"))
    built = files.filter((dirname(F.col("path")) == "Library/ScriptAssemblies") & F.col("path").endswith(".dll")).select("path")
    h, d = F.col("hint"), dirname(F.col("project"))
    hinted = hint_paths(files).filter(F.lower("hint").endswith(".dll")).select(F.when(h.startswith("/") | (d == ""), h).otherwise(F.concat(d, F.lit("/"), h)).alias("path"))
    return built.union(hinted).distinct().withColumn("name", stem(basename(F.col("path")))).join(made, "name", "left_anti").select("path")


def high_signal(assets: DataFrame) -> DataFrame:
    """path, score: how much a serialized asset tells.

    assets(path, kind, project_scripts, events, states, transitions, blend_trees, art,
    subassets, own_importer): counts, and whether it is a clip, material, mesh or model.
    """
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    one = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0)
    score = n("project_scripts") * 3 + n("events") * 5 + n("states") + n("transitions") + n("blend_trees") * 2 + one(F.col("kind") == "scriptable_object", 4) + one(F.col("art"), 1) + one(n("subassets") > 1, 3) + one(F.col("own_importer"), 2) + one(F.col("kind") == "sprite_atlas", 2)
    return assets.select("path", score.alias("score"))


def asset_confidence(parts: DataFrame) -> DataFrame:
    """path, confidence of parts(path, confidence): 'partial' where any part is partial or unresolved."""
    return parts.groupBy("path").agg(F.when(F.count_if(F.col("confidence").isin("partial", "unresolved")) > 0, "partial").otherwise("exact").alias("confidence"))

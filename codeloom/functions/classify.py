"""Predicates and classifications of files, symbols and scores, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, extension, stem

LANGUAGES = {
    "c": ".h .c", "cpp": ".hxx .cxx .cc .hpp .cpp", "csharp": ".cs", "css": ".css", "go": ".go", "html": ".htm .html", "java": ".java", "javascript": ".cjs .mjs .jsx .js", "json": ".json", "kotlin": ".kts .kt",
    "less": ".less", "markdown": ".markdown .md", "php": ".php", "python": ".pyw .pyi .py", "rst": ".rst", "ruby": ".rake .rb", "rust": ".rs", "sass": ".sass", "scss": ".scss", "shell": ".zsh .bash .sh",
    "svelte": ".svelte", "swift": ".swift", "toml": ".toml", "typescript": ".cts .mts .tsx .ts", "vue": ".vue", "xml": ".xml", "yaml": ".yml .yaml",
}
EXTENSIONS = {e: name for name, each in LANGUAGES.items() for e in each.split()}
SHEBANGS = (("python", "python"), ("node", "javascript"), ("deno", "typescript"), ("bash", "shell"), ("zsh", "shell"), ("sh", "shell"), ("ruby", "ruby"), ("php", "php"))

BINARY_EXTENSIONS = frozenset(
    (".7z .a .aac .app .avi .beam .bin .bmp .bz2 .class .cur .db .deb .dll .dmg .doc .docx .ds_store .dylib .elc .eot .exe .flac .gif .gz .heic .heif .ico .jpeg .jpg .lib .m4a .m4v .mdb .mkv .mov "
     ".mp3 .mp4 .msi .o .obj .odp .ods .odt .ogg .otf .pdf .png .ppt .pptx .psd .pyc .pyo .rar .raw .rpm .so .sqlite .sqlite3 .svg .tar .tbz2 .tgz .tif .tiff .ttf .txz .wav .webm .webp .wma .wmv .woff .woff2 .xls .xlsx .xz .zip .zst").split()
)

GENERATED = ("generated", "generatedlocalrepo", "library", "obj", "temp")
VENDOR = ("demigiant", "dotween", "external", "googlemobileads", "plugin", "plugins", "textmesh pro", "third-party", "thirdparty", "tools", "unirx", "vendor")

#: Layers in the order that decides; a layer applies where any of its words is part of the lower-case path.  Plurals are left out, as they hold their singulars.
LAYERS = ("presentation", "application", "domain", "infrastructure", "shared")
LAYER_WORDS = {
    "presentation": "component dialog form layout modal page screen template ui view widget",
    "application": "action api command controller endpoint handler queries query route use-case use_case usecase",
    "domain": "aggregate business core domain entities entity model repositories repository service value",
    "infrastructure": "adapter cache client database db driver external gateway http integration messaging persistence provider queue storage",
    "shared": "common config constant dto helper interface lib schema shared type util",
}
#: A shorter table with the same layers, for diagrams.
DIAGRAM_WORDS = {
    "presentation": "component layout page screen template ui view",
    "application": "action api controller endpoint handler middleware route",
    "domain": "business core domain entity logic model service",
    "infrastructure": "adapter client database db http repository storage",
    "shared": "common config constant helper lib shared type util",
}
ABSTRACT_TYPES = ("abc", "abstract_class", "interface", "protocol", "type", "type_alias")
EXTERNAL = ("axios", "dataclasses", "django", "express", "fastapi", "flask", "json", "lodash", "next", "os", "pathlib", "pytest", "re", "react", "sys", "typing")


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def is_binary_extension(path: Column) -> Column:
    return extension(path).isin(*sorted(BINARY_EXTENSIONS))


def language(path: Column, first_line: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """Configured extensions first, then the known ones, then a shebang where there is no extension."""
    ext = extension(path)
    found = _lookup(ext, EXTENSIONS | (overrides or {}))
    if first_line is None:
        return found
    bang = F.lit(None).cast("string")
    for word, name in reversed(SHEBANGS):
        bang = F.when(first_line.rlike(rf"^#!.*\b{word}[0-9.]*\b"), name).otherwise(bang)
    return F.when(ext == "", bang).otherwise(found)


def ownership(path: Column) -> Column:
    """Who a file belongs to; the first rule that applies decides."""
    p = F.lower(path)
    parts = F.split(p, "/")
    first = parts[0]
    return (
        F.when(p.rlike(r"\.(csproj|sln|slnx)$"), "unity-generated")
        .when(F.exists(parts, lambda x: x.isin(*GENERATED) | x.startswith("generated")), "generated")
        .when(first == "packages", "package")
        .when(first == "projectsettings", "project-configuration")
        .when(F.exists(parts, lambda x: x.isin(*VENDOR)), "vendor")
        .when(first == "assets", "project-owned")
        .otherwise("repository")
    )


def _any_word(text: Column, words: str) -> Column:
    return text.rlike("|".join(w.replace("-", r"\-") for w in words.split()))


def layer_from_path(path: Column, words: dict[str, str] = LAYER_WORDS) -> Column:
    """The architecture layer that a path's words tell, or null."""
    p = F.lower(path)
    out = F.lit(None).cast("string")
    for name in reversed(LAYERS):
        out = F.when(_any_word(p, words[name]), name).otherwise(out)
    return out


def diagram_layer(path: Column) -> Column:
    """The layer by the shorter table; 'other' where no word applies."""
    return F.coalesce(layer_from_path(path, DIAGRAM_WORDS), F.lit("other"))


def directory_group(path: Column, levels: int = 2) -> Column:
    """The first directories of a path; 'root' for files at the top."""
    p = F.split(path, "/")
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.least(F.lit(levels), F.size(p) - 1)), "/")).otherwise("root")


def layer_index(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAYERS]), layer) - 1


def is_test_file(path: Column) -> Column:
    p = F.lower(path)
    s = basename(stem(p))
    rules = [s.startswith("test_"), s.endswith("_test"), s.rlike("^test[^a-z]"), p.contains("tests/"), p.contains("/test/"), p.rlike(r"[._]test\.(ts|js)$|\.spec\.(ts|js)$")]
    return reduce(lambda a, b: a | b, rules)


def is_type_file(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("types") | p.contains("interfaces") | basename(stem(p)).isin("models", "schemas") | p.endswith(".d.ts") | p.endswith(".pyi")


def looks_external(spec: Column) -> Column:
    """A package by its look: scoped, or its first part is a known outer name; never a relative or absolute path."""
    head = F.split(F.replace(spec, F.lit("/"), F.lit(".")), r"\.")[0]
    return ~spec.startswith(".") & ~spec.startswith("/") & ~spec.rlike("^.:") & (head.isin(*EXTERNAL, "@", "node_modules") | spec.startswith("@"))


def is_exported(name: Column, line: Column, lang: Column, listed: Column | None = None) -> Column:
    """Python: in __all__ where there is one, else no leading underscore; script languages: 'export' before a comment; Go: upper-case first letter."""
    python = ~name.startswith("_")
    if listed is not None:
        python = F.when(listed.isNotNull(), F.array_contains(listed, name)).otherwise(python)
    return (
        F.when(lang == "python", python)
        .when(lang.isin("typescript", "javascript"), F.substring_index(line, "//", 1).contains("export"))
        .when(lang == "go", name.rlike(r"^\p{Lu}"))
        .otherwise(F.lit(False))
    )


def is_abstract(kind: Column, flags: Column | None = None) -> Column:
    """By type, or by a true flag in a MAP<STRING, BOOLEAN>."""
    found = kind.isin(*ABSTRACT_TYPES)
    if flags is None:
        return found
    flag = lambda k: F.coalesce(flags[k], F.lit(False))
    return found | flag("is_abstract") | flag("is_protocol") | flag("is_interface")


def zone(instability: Column, abstractness: Column) -> Column:
    return (
        F.when(F.abs(abstractness + instability - 1) <= 0.2, "main")
        .when((instability < 0.3) & (abstractness < 0.3), "pain")
        .when((instability > 0.7) & (abstractness > 0.7), "uselessness")
        .otherwise("neutral")
    )


def importance(score: Column, nodes: Column) -> Column:
    r = score * nodes
    buckets = ((5, "Very High (critical hub)"), (2, "High (key file)"), (1, "Above Average"), (0.5, "Average"), (0.2, "Below Average"))
    out = F.lit("Low (leaf file)")
    for least, name in reversed(buckets):
        out = F.when(r > least, name).otherwise(out)
    return F.when(nodes == 0, "Unknown").otherwise(out)


def bridge_risk(betweenness: Column) -> Column:
    return F.when(betweenness > 0.2, "high").when(betweenness > 0.1, "medium").otherwise("low")


def hidden_risk(betweenness: Column) -> Column:
    return F.when(betweenness > 0.1, "high").when(betweenness > 0.05, "medium").otherwise("low")

"""Serialized game assets: documents, objects, components, references, events, animators.

The line syntax depends on indentation and so on all lines before, so one pass in
Python (Arrow batches, one file after the other) turns each file into document rows
with their fields, references, lists and calls.  All that relates documents, files
and scripts is joins over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ownership
from ..lineage import cut
from .graph import CodeGraph

YAML_SUFFIXES = tuple(".anim .asset .controller .cubemap .lighting .mat .mixer .overridecontroller .physicmaterial .physicsmaterial2d .playable .prefab .rendertexture .spriteatlas .terrainlayer .unity".split())
CLASSES = {1: "GameObject", 4: "Transform", 21: "Material", 43: "Mesh", 74: "AnimationClip", 91: "AnimatorController", 95: "Animator", 114: "MonoBehaviour", 206: "BlendTree", 224: "RectTransform", 1001: "PrefabInstance", 1101: "AnimatorStateTransition", 1102: "AnimatorState", 1107: "AnimatorStateMachine"}
PARAMETER_TYPES = {1: "float", 3: "int", 4: "bool", 9: "trigger"}
#: Blocks of local references, of maps, and lists whose length is asked for.
LOCAL_BLOCKS = ("m_Children", "m_Transitions", "m_AnyStateTransitions", "m_EntryTransitions", "m_StateMachineBehaviours")
MAP_BLOCKS = ("m_AnimatorParameters", "m_AnimatorLayers", "m_Conditions", "m_Childs", "m_Events", "m_FloatCurves", "m_PositionCurves", "m_RotationCurves", "m_ScaleCurves", "m_PPtrCurves", "m_EditorCurves")
COUNTED = ("m_Modifications", "m_SubMeshes", *MAP_BLOCKS[5:])
CURVES = MAP_BLOCKS[5:]

_HEADER = re.compile(r"---\s+!u!(-?\d+)\s+&(-?\d+)(\s+stripped)?\s*$")
_LINE = re.compile(r"(\s*)(-\s+)?(?:([A-Za-z_][A-Za-z0-9_ ]*):\s*(.*)|(\{.*))$")
_REF = re.compile(r"\{\s*fileID:\s*(-?\d+)\s*((?:,\s*(?:guid:\s*[0-9a-fA-F]{32}|type:[^,{}]*)\s*)*)\}$")
_GUID = re.compile(r"guid:\s*([0-9a-fA-F]{32})")

_REFERENCE = pa.struct([("line", pa.int32()), ("field", pa.string()), ("file_id", pa.string()), ("guid", pa.string())])
_CALL = pa.struct([("line", pa.int32()), ("field", pa.string()), ("file_id", pa.string()), ("guid", pa.string()), ("assembly_type", pa.string()), ("method", pa.string()), ("mode", pa.int32()), ("call_state", pa.int32())])
_SCHEMA = pa.schema([
    ("asset", pa.string()), ("file_id", pa.string()), ("class_id", pa.int32()), ("type_name", pa.string()), ("stripped", pa.bool_()), ("scalars", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(_REFERENCE)),
    ("locals", pa.map_(pa.string(), pa.list_(pa.string()))), ("lists", pa.map_(pa.string(), pa.list_(pa.map_(pa.string(), pa.string())))), ("counts", pa.map_(pa.string(), pa.int32())), ("calls", pa.list_(_CALL)), ("fields", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
])
DOCUMENT_FIELDS = (
    "asset string, file_id string, class_id int, type_name string, stripped boolean, scalars map<string,string>, refs array<struct<line:int,field:string,file_id:string,guid:string>>, "
    "locals map<string,array<string>>, lists map<string,array<map<string,string>>>, counts map<string,int>, calls array<struct<line:int,field:string,file_id:string,guid:string,assembly_type:string,method:string,mode:int,call_state:int>>, fields array<struct<key:string,value:string>>"
)


class _Row(NamedTuple):
    number: int
    indent: int
    dash: bool
    key: str | None
    value: str


def _unquote(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def reference(text: str) -> tuple[str, str] | None:
    """(file id, guid in lower case or '') of an inline reference; None for any other value."""
    m = _REF.match(text.strip())
    if not m:
        return None
    g = _GUID.search(m[2])
    return m[1], g[1].lower() if g else ""


def _number(text: str | None) -> int:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else 0


class _Document:
    """The lines of one document, each with its value joined over indented continuations."""

    def __init__(self, lines: list[tuple[int, str]]):
        self.rows: list[_Row] = []
        for k, (n, text) in enumerate(lines):
            m = _LINE.match(text)
            if not text.strip():
                continue
            if not m or text.lstrip().startswith("#") or (m[5] and not m[2]):
                self.rows.append(_Row(n, len(text) - len(text.lstrip()), text.lstrip().startswith("-"), None, ""))
                continue
            value = (m[4] if m[3] else m[5]).strip()
            if value.startswith("{") and not value.endswith("}"):
                parts = [value]
                for _, more in lines[k + 1 : k + 9]:
                    t = more.strip()
                    if not t or t[0] == "#" or len(more) - len(more.lstrip()) <= len(m[1]):
                        break
                    parts.append(t)
                    if t.endswith("}"):
                        value = " ".join(parts)
                        break
            self.rows.append(_Row(n, len(m[1]), bool(m[2]), m[3] or "item", value))

    def scalars(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for r in self.rows:
            if r.key and not r.dash:
                out.setdefault(r.key, _unquote(r.value))
        return out

    def refs(self) -> list[dict]:
        return [{"line": r.number, "field": r.key, "file_id": x[0], "guid": x[1]} for r in self.rows if r.key and (x := reference(r.value))]

    def block(self, key: str) -> tuple[list[_Row], str]:
        """The rows below the first field of this name, and the value beside it."""
        for k, r in enumerate(self.rows):
            if r.key == key and not r.dash:
                end = k + 1
                while end < len(self.rows) and (self.rows[end].indent > r.indent or (self.rows[end].indent == r.indent and self.rows[end].dash)):
                    end += 1
                return ([] if r.value in ("[]", "{}") else self.rows[k + 1 : end]), r.value
        return [], ""

    def local(self, key: str) -> list[str]:
        rows, value = self.block(key)
        own = reference(value)
        return [own[0]] if own else [x[0] for r in rows if r.dash and r.key and (x := reference(r.value))]

    def maps(self, key: str) -> list[dict[str, str]]:
        out: list[dict[str, str]] = []
        level = None
        for r in self.block(key)[0]:
            if not r.key:
                continue
            if r.dash and level is None:
                level = r.indent
            if r.dash and r.indent == level:
                out.append({r.key: _unquote(r.value)})
            elif out and not r.dash:
                out[-1][r.key] = _unquote(r.value)
        return out

    def count(self, key: str) -> int:
        rows = [r for r in self.block(key)[0] if r.dash and r.key]
        return sum(r.indent == rows[0].indent for r in rows) if rows else 0

    def calls(self) -> list[dict]:
        out = []
        for k, p in enumerate(self.rows):
            if p.key != "m_PersistentCalls" or p.dash:
                continue
            end = next((j for j in range(k + 1, len(self.rows)) if self.rows[j].indent <= p.indent), len(self.rows))
            head = next((j for j in range(k + 1, end) if self.rows[j].key == "m_Calls" and not self.rows[j].dash), None)
            if head is None or self.rows[head].value == "[]":
                continue
            field = next((r.key for r in reversed(self.rows[:k]) if r.key and not r.dash and r.indent < p.indent), "UnityEvent")
            for j in range(head + 1, end):
                r = self.rows[j]
                if not (r.dash and r.key == "m_Target" and r.indent >= self.rows[head].indent):
                    continue
                target = reference(r.value)
                if not target or target[0] == "0":
                    continue
                values: dict[str, str] = {}
                for x in self.rows[j + 1 : end]:
                    if x.indent < r.indent or (x.dash and x.key and x.indent == r.indent):
                        break
                    if x.key:
                        values[x.key] = _unquote(x.value)
                method = values.get("m_MethodName", "")
                if method not in ("", "0"):
                    out.append({"line": r.number, "field": field, "file_id": target[0], "guid": target[1], "assembly_type": values.get("m_TargetAssemblyTypeName", ""), "method": method, "mode": _number(values.get("m_Mode")), "call_state": _number(values.get("m_CallState"))})
        return out


def parse_asset(asset: str, source: str) -> list[dict]:
    """The documents of one file."""
    lines = list(enumerate(source.splitlines(), 1))
    heads = [(k, m) for k, (_, t) in enumerate(lines) if (m := _HEADER.match(t))]
    out = []
    for j, (k, m) in enumerate(heads):
        body = lines[k + 1 : heads[j + 1][0] if j + 1 < len(heads) else len(lines)]
        first = next((t for _, t in body if t.strip()), "")
        named = re.fullmatch(r"([A-Za-z_]\w*):\s*", first)
        d = _Document(body)
        local, lists = {x: d.local(x) for x in LOCAL_BLOCKS}, {x: d.maps(x) for x in MAP_BLOCKS}
        out.append({
            "asset": asset, "file_id": m[2], "class_id": int(m[1]), "type_name": named[1] if named else CLASSES.get(int(m[1]), f"ClassID{m[1]}"), "stripped": bool(m[3]), "scalars": list(d.scalars().items()), "refs": d.refs(),
            "locals": [(x, v) for x, v in local.items() if v], "lists": [(x, [list(i.items()) for i in v]) for x, v in lists.items() if v], "counts": [(x, n) for x in COUNTED if (n := d.count(x))], "calls": d.calls(),
            "fields": [{"key": r.key, "value": _unquote(r.value)} for r in d.rows if r.key and not r.dash and r.indent == 2 and r.value and not reference(r.value)],
        })
    return out


def documents(files: DataFrame) -> DataFrame:
    """Document rows of files(path, source) with a suffix of YAML_SUFFIXES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, source in zip(b.column("path").to_pylist(), b.column("source").to_pylist()):
                rows = parse_asset(path, source)
                if rows:
                    yield from pa.Table.from_pylist(rows, _SCHEMA).to_batches()

    yaml = F.lower("path").rlike(r"(" + "|".join(re.escape(s) for s in YAML_SUFFIXES) + r")$")
    return files.filter(yaml & F.col("source").isNotNull()).select("path", "source").mapInArrow(run, DOCUMENT_FIELDS)


def guid_index(files: DataFrame) -> DataFrame:
    """guid, assets (sorted) from the .meta files of assets that exist."""
    metas = files.filter(F.col("path").endswith(".meta")).select(F.expr("substring(path, 1, length(path) - 5)").alias("path"), F.lower(F.regexp_extract("source", r"(?m)^guid:\s*([0-9a-fA-F]{32})\s*$", 1)).alias("guid"))
    return metas.filter("guid <> ''").join(files.select("path"), "path", "left_semi").groupBy("guid").agg(F.sort_array(F.collect_set("path")).alias("assets"))


def _first(field: str, part: str = "file_id") -> Column:
    """The file id or guid of the first reference under a field; null without one."""
    return F.try_element_at(F.filter("refs", lambda r: r["field"] == field), F.lit(1))[part]


def _resolved(df: DataFrame, guids: DataFrame) -> DataFrame:
    """Adds target, candidates, confidence and reason to a table with a guid."""
    n = F.coalesce(F.size("assets"), F.lit(0))
    return df.join(guids, "guid", "left").withColumns({
        "target": F.when(n == 1, F.col("assets")[0]).otherwise(""), "candidates": F.when(n > 1, F.col("assets")).otherwise(F.array().cast("array<string>")),
        "confidence": F.when(n == 1, "exact").when(n > 1, "partial").otherwise("unresolved"), "reason": F.when(n == 1, "meta_guid").when(n > 1, "duplicate_guid").otherwise("guid_not_in_inventory"),
    }).drop("assets")


def references(docs: DataFrame, guids: DataFrame) -> DataFrame:
    """asset, document_file_id, field, file_id, guid, line, target, candidates, confidence, reason of every reference to another file."""
    each = docs.select("asset", F.col("file_id").alias("document_file_id"), F.explode("refs").alias("r")).select("asset", "document_file_id", "r.field", "r.file_id", "r.guid", "r.line")
    return _resolved(each.filter((F.col("guid") != "") & ~F.col("guid").startswith("0" * 16)), guids)


def game_objects(docs: DataFrame) -> DataFrame:
    """asset, file_id, name, active, tag, layer, stripped, parent_file_id, children and path of every object.

    Parents are found through transforms.  Paths grow by doubling: every round puts
    what the ancestor reached so far has collected before the own part.  An object in
    a circle of parents, or below one, has its name as its path.
    """
    s = F.col("scalars")
    base = docs.filter("type_name = 'GameObject'").select(
        "asset", "file_id", F.coalesce(F.nullif(s["m_Name"], F.lit("")), F.concat(F.lit("GameObject "), "file_id")).alias("name"), F.coalesce(s["m_IsActive"] == "1", F.lit(True)).alias("active"),
        F.coalesce(F.nullif(s["m_TagString"], F.lit("")), F.lit("Untagged")).alias("tag"), F.coalesce(F.expr("try_cast(scalars['m_Layer'] as int)"), F.lit(0)).alias("layer"), "stripped",
    )
    t = docs.filter(F.col("type_name").isin("Transform", "RectTransform")).select("asset", F.col("file_id").alias("transform"), _first("m_GameObject").alias("object"), _first("m_Father").alias("father"), F.col("locals")["m_Children"].alias("below"))
    owner = t.select("asset", F.col("transform").alias("father"), F.col("object").alias("parent_file_id"))
    parents = t.join(owner, ["asset", "father"], "left").select("asset", F.col("object").alias("file_id"), F.coalesce("parent_file_id", F.lit("0")).alias("parent_file_id")).dropDuplicates(["asset", "file_id"])
    kids = t.select("asset", "object", F.posexplode("below").alias("k", "child")).join(t.select("asset", F.col("transform").alias("child"), F.col("object").alias("child_object")), ["asset", "child"]).join(base.select("asset", F.col("file_id").alias("child_object")), ["asset", "child_object"], "left_semi")
    children = kids.groupBy("asset", F.col("object").alias("file_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "child_object"))), lambda x: x["child_object"]).alias("children"))
    rows = base.join(parents, ["asset", "file_id"], "left").join(children, ["asset", "file_id"], "left")
    rows = cut(rows.select(*base.columns, F.coalesce("parent_file_id", F.lit("0")).alias("parent_file_id"), F.coalesce("children", F.array().cast("array<string>")).alias("children")))
    known = rows.select("asset", F.col("file_id").alias("up")).withColumn("known", F.lit(True))
    paths = rows.select("asset", "file_id", "name", F.col("parent_file_id").alias("up"), F.col("name").alias("path")).join(known, ["asset", "up"], "left")
    paths = cut(paths.select("asset", "file_id", F.when(F.col("known"), F.col("up")).alias("up"), "path"))
    open_, before = paths.filter("up is not null").count(), None
    # a path of any depth has ancestors of all smaller ones, so if a round ends none, only circles are left
    while open_ and open_ != before:
        above = paths.select("asset", F.col("file_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("prefix"))
        paths = cut(paths.join(above, ["asset", "up"], "left").select("asset", "file_id", F.col("next").alias("up"), F.concat(F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit("/"))).otherwise(""), "path").alias("path")))
        open_, before = paths.filter("up is not null").count(), open_
    return rows.join(paths.select("asset", "file_id", F.when(F.col("up").isNull(), F.col("path")).alias("whole")), ["asset", "file_id"]).withColumn("path", F.coalesce("whole", "name")).drop("whole")


def script_of(df: DataFrame, guids: DataFrame, types: DataFrame | None) -> DataFrame:
    """Adds script, script_type, qualified_type, type_id, script_confidence and script_reason to a table with a guid.

    types(path, name, qualified_name, id, is_abstract) are the component types declared
    in script files; of several the only concrete one counts.
    """
    df = _resolved(df, guids)
    if types is None:
        types = df.sparkSession.createDataFrame([], "path string, name string, qualified_name string, id string, is_abstract boolean")
    one = F.struct("name", "qualified_name", "id")
    t = types.groupBy(F.col("path").alias("target")).agg(F.collect_list(one).alias("all"), F.collect_list(F.when(~F.coalesce("is_abstract", F.lit(False)), one)).alias("concrete"))
    df = df.join(t, "target", "left")
    n = F.coalesce(F.size("all"), F.lit(0))
    pick = F.when(n == 1, F.col("all")[0]).when((n > 1) & (F.size("concrete") == 1), F.col("concrete")[0])
    script = F.col("target").endswith(".cs")
    return df.withColumn("pick", pick).withColumns({
        "script": F.col("target"), "script_type": F.coalesce("pick.name", F.lit("")), "qualified_type": F.coalesce("pick.qualified_name", "pick.name", F.lit("")), "type_id": F.coalesce("pick.id", F.lit("")),
        "script_confidence": F.when(F.col("pick").isNotNull() & script, "exact").when((F.col("confidence") == "partial") | (n > 1), "partial").otherwise("unresolved"),
        "script_reason": F.when(F.col("confidence") != "exact", F.col("reason")).when(~script, "guid_target_is_not_csharp").when(n == 0, "no_script_type").when(F.col("pick").isNull(), "ambiguous_script_types").when(n > 1, "unique_concrete_script_type").otherwise("meta_guid_script_type"),
    }).drop("pick", "all", "concrete", "target", "candidates", "confidence", "reason")


def components(docs: DataFrame, guids: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """asset, object, file_id, class_id, type, qualified_type, boundary, confidence, enabled, fields, script of every component.

    An object's own list counts; documents that name an object which doesn't list them
    are its components too.  A listed document that isn't there is a MissingComponent.
    """
    objects = docs.filter("type_name = 'GameObject'").select("asset", F.col("file_id").alias("object"), F.transform(F.filter("refs", lambda r: (r["field"] == "component") & (r["file_id"] != "0")), lambda r: r["file_id"]).alias("own"))
    listed = objects.select("asset", "object", F.explode("own").alias("file_id"))
    naming = docs.filter("type_name <> 'GameObject'").select("asset", _first("m_GameObject").alias("object"), "file_id").join(objects.select("asset", "object"), ["asset", "object"], "left_semi")
    every = listed.select("asset", "object", "file_id").union(naming.join(listed.select("asset", "file_id"), ["asset", "file_id"], "left_anti").select("asset", "object", "file_id")).distinct()
    facts = docs.select("asset", "file_id", "class_id", "type_name", "stripped", F.col("scalars")["m_Enabled"].alias("enabled"), F.slice("fields", 1, 12).alias("fields"), F.when(F.col("type_name") == "MonoBehaviour", _first("m_Script", "guid")).alias("guid"))
    df = script_of(every.join(facts, ["asset", "file_id"], "left"), guids, types)
    scripted, missing = F.coalesce(F.col("guid") != "", F.lit(False)), F.col("type_name").isNull()
    builtin = F.concat(F.lit("UnityEngine."), "type_name")
    return df.select(
        "asset", "object", "file_id", F.coalesce("class_id", F.lit(0)).alias("class_id"), F.when(missing, "MissingComponent").when(scripted & (F.col("script_type") != ""), F.col("script_type")).otherwise(F.col("type_name")).alias("type"),
        F.when(scripted & (F.col("qualified_type") != ""), F.col("qualified_type")).otherwise(builtin).alias("qualified_type"), F.when(scripted, F.when(F.col("script") != "", ownership(F.col("script")))).when(~missing, "builtin").alias("boundary"),
        F.when(missing, "unresolved").when(scripted, F.col("script_confidence")).when(F.col("stripped"), "partial").otherwise("exact").alias("confidence"), (F.col("enabled") == "1").alias("enabled"), "fields",
        F.when(scripted, F.col("script")).alias("script"), F.when(scripted, F.col("type_id")).alias("type_id"), F.when(scripted, F.col("script_reason")).alias("script_reason"),
    )


def prefab_instances(docs: DataFrame, guids: DataFrame) -> DataFrame:
    """asset, file_id, guid, target, candidates, confidence, modification_count, transform_parent, stripped_documents."""
    p = docs.filter("type_name = 'PrefabInstance'").select("asset", "file_id", F.coalesce(_first("m_SourcePrefab", "guid"), F.lit("")).alias("guid"), F.coalesce(F.col("counts")["m_Modifications"], F.lit(0)).alias("modification_count"), F.coalesce(_first("m_TransformParent"), F.lit("")).alias("transform_parent"))
    stripped = docs.filter("stripped").groupBy("asset").agg(F.count(F.lit(1)).alias("stripped_documents"))
    return _resolved(p, guids).drop("reason").join(stripped, "asset", "left").fillna(0, ["stripped_documents"])


def event_bindings(docs: DataFrame, guids: DataFrame, types: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """Persistent calls of serialized events, with their targets and how sure those are.

    methods(type_id, name, id).  A call is exact where its target's script has one type
    and that type exactly one method of the name; several are partial, and so is a
    declared type that differs from the target's.
    """
    spark = docs.sparkSession
    owned = components(docs, guids, types).select("asset", "file_id", "object", F.col("type").alias("component_type"), "script", "type_id", F.col("qualified_type").alias("component_qualified"))
    paths = game_objects(docs).select("asset", F.col("file_id").alias("object"), "path")
    places = owned.join(paths, ["asset", "object"])
    c = docs.select("asset", F.col("file_id").alias("owner_file_id"), F.explode("calls").alias("c")).select("asset", "owner_file_id", "c.*").withColumnRenamed("file_id", "target_file_id")
    c = c.join(places.select("asset", F.col("file_id").alias("owner_file_id"), F.col("path").alias("owner_path")), ["asset", "owner_file_id"], "left")
    c = c.join(places.select("asset", F.col("file_id").alias("target_file_id"), F.col("path").alias("local_path"), F.col("script").alias("local_script"), F.col("type_id").alias("local_type_id"), F.col("component_type").alias("local_type"), F.col("component_qualified").alias("local_qualified")), ["asset", "target_file_id"], "left")
    c = script_of(c.withColumnRenamed("type_id", "x") if "type_id" in c.columns else c, guids, types)
    outer = F.col("guid") != ""
    pick = lambda a, b: F.when(outer, F.col(a)).otherwise(F.coalesce(F.col(b), F.lit("")))
    c = c.withColumns({"target_script": pick("script", "local_script"), "target_type_id": pick("type_id", "local_type_id"), "short": pick("script_type", "local_type"), "full": pick("qualified_type", "local_qualified")})
    if methods is None:
        methods = spark.createDataFrame([], "type_id string, name string, id string")
    m = methods.groupBy(F.col("type_id").alias("target_type_id"), F.col("name").alias("method")).agg(F.count(F.lit(1)).alias("found"), F.min("id").alias("method_id"))
    c = c.join(m, ["target_type_id", "method"], "left")
    n, declared = F.coalesce("found", F.lit(0)), F.trim(F.substring_index("assembly_type", ",", 1))
    known = F.col("target_type_id") != ""
    differs = (declared != "") & (declared != F.col("full")) & (declared != F.col("short"))
    confidence = F.when(known & (n == 1) & differs, "partial").when(known & (n == 1), "exact").when(known & (n > 1), "partial").otherwise("unresolved")
    reason = F.when(~known, "target_component_not_resolved").when(n == 0, "method_not_found_in_type").when(n > 1, "ambiguous_method_overload").when(differs, "serialized_type_disagrees_with_guid_target").otherwise("target_guid_and_method")
    return c.select(
        "asset", "field", "owner_file_id", F.coalesce("owner_path", F.lit("")).alias("owner_path"), "target_file_id", F.when(outer, F.col("script")).otherwise(F.coalesce("local_path", "asset")).alias("target_path"), "target_script",
        F.when(F.col("full") != "", F.col("full")).otherwise(declared).alias("target_type"), "method", "mode", "call_state", confidence.alias("confidence"), F.when(F.col("call_state") == 0, "disabled").otherwise(confidence).alias("status"), reason.alias("reason"), "line",
        F.when(confidence == "exact", F.col("method_id")).alias("method_id"),
    )


def event_calls(bindings: DataFrame) -> DataFrame:
    """caller, path, callee, target, line: the calls that enabled, exact bindings make."""
    on = bindings.filter("confidence = 'exact' and call_state <> 0")
    return on.select(F.concat_ws(":", "asset", "owner_file_id", "field").alias("caller"), F.col("asset").alias("path"), F.col("method_id").alias("callee"), F.col("target_script").alias("target"), "line")


def edges(refs: DataFrame, bindings: DataFrame | None = None, scriptable: DataFrame | None = None) -> DataFrame:
    """Edge evidence records (source, target, kind, symbol, line, confidence, engine) of exact references and events.

    scriptable(asset): assets of scriptable objects, whose script is their type.
    """
    f = F.col("field")
    r = refs.filter((F.col("confidence") == "exact") & ~F.col("target").endswith(".meta"))
    r = r.join(scriptable.select("asset", F.lit(True).alias("typed")).distinct(), "asset", "left") if scriptable is not None else r.withColumn("typed", F.lit(False))
    animated = F.lower("asset").rlike(r"\.(override)?controller$")
    kind = F.when((f == "m_Script") & F.coalesce("typed", F.lit(False)), "scriptable_object_type").when(f == "m_Script", "unity_component").when(f.isin("m_SourcePrefab", "m_ParentPrefab"), "prefab_instance").when((f == "m_Motion") & animated, "animator_motion").otherwise("serialized_guid")
    out = r.select(F.col("asset").alias("source"), "target", kind.alias("kind"), f.alias("symbol"), "line", F.lit("exact").alias("confidence"), F.lit("unity-runtime").alias("engine"))
    if bindings is not None:
        b = bindings.filter("confidence = 'exact' and call_state <> 0 and target_script <> ''")
        out = out.unionByName(b.select(F.col("asset").alias("source"), F.col("target_script").alias("target"), F.lit("unity_event").alias("kind"), F.concat_ws(".", "target_type", "method").alias("symbol"), "line", F.lit("exact").alias("confidence"), F.lit("unity-runtime").alias("engine")))
    return out


def asset_graph(refs: DataFrame, files: DataFrame) -> CodeGraph:
    """Files and the exact references among them."""
    e = edges(refs).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return CodeGraph.of(e, files.filter(~F.col("path").endswith(".meta")).select(F.col("path").alias("id")))


# animators


def animator_parameters(docs: DataFrame) -> DataFrame:
    """asset, name, type, default."""
    p = docs.filter("type_name = 'AnimatorController'").select("asset", F.explode(F.col("lists")["m_AnimatorParameters"]).alias("p"))
    k = F.expr("try_cast(p['m_Type'] as int)")
    names = F.create_map(*[F.lit(x) for kv in PARAMETER_TYPES.items() for x in kv])
    default = F.when(k == 3, F.col("p")["m_DefaultInt"]).when(k.isin(4, 9), F.when(F.col("p")["m_DefaultBool"] == "1", "true").otherwise("false")).otherwise(F.col("p")["m_DefaultFloat"])
    return p.select("asset", F.col("p")["m_Name"].alias("name"), F.coalesce(names[k], k.cast("string")).alias("type"), F.coalesce(default, F.lit("0")).alias("default"))


def animator_layers(docs: DataFrame) -> DataFrame:
    """asset, name, state_machine_file_id, default_state_file_id."""
    machine = F.regexp_extract(F.col("p")["m_StateMachine"], r"fileID:\s*(-?\d+)", 1)
    p = docs.filter("type_name = 'AnimatorController'").select("asset", F.explode(F.col("lists")["m_AnimatorLayers"]).alias("p")).select("asset", F.col("p")["m_Name"].alias("name"), F.when(machine == "", "0").otherwise(machine).alias("state_machine_file_id"))
    m = docs.filter("type_name = 'AnimatorStateMachine'").select("asset", F.col("file_id").alias("state_machine_file_id"), F.coalesce(_first("m_DefaultState"), F.lit("0")).alias("default_state_file_id"))
    return p.join(m, ["asset", "state_machine_file_id"], "left").fillna("0", ["default_state_file_id"])


def animator_states(docs: DataFrame, guids: DataFrame) -> DataFrame:
    """asset, file_id, name, motion (a file, or a local document's type), confidence, behaviours."""
    s = docs.filter("type_name = 'AnimatorState'").select("asset", "file_id", F.coalesce(F.col("scalars")["m_Name"], F.lit("")).alias("name"), F.coalesce(_first("m_Motion", "guid"), F.lit("")).alias("guid"), _first("m_Motion").alias("motion_file_id"), F.coalesce(F.col("locals")["m_StateMachineBehaviours"], F.array().cast("array<string>")).alias("behaviours"))
    local = docs.select("asset", F.col("file_id").alias("motion_file_id"), F.col("type_name").alias("local_type"))
    df = _resolved(s, guids).join(local, ["asset", "motion_file_id"], "left")
    inner = F.col("guid") == ""
    return df.select("asset", "file_id", "name", F.when(inner, F.coalesce("local_type", F.lit(""))).otherwise(F.col("target")).alias("motion"), F.when(inner, F.when(F.col("local_type").isNotNull(), "exact").otherwise("unresolved")).otherwise(F.col("confidence")).alias("confidence"), "behaviours")


def animator_transitions(docs: DataFrame) -> DataFrame:
    """asset, file_id, source, destination, has_exit_time, is_exit, conditions of every transition."""
    start = lambda kind, key, prefix: docs.filter(F.col("type_name") == kind).select("asset", F.concat(F.lit(prefix), "file_id").alias("source"), F.explode(F.col("locals")[key]).alias("file_id"))
    sources = start("AnimatorState", "m_Transitions", "").union(start("AnimatorStateMachine", "m_AnyStateTransitions", "AnyState:")).union(start("AnimatorStateMachine", "m_EntryTransitions", "Entry:")).groupBy("asset", "file_id").agg(F.max("source").alias("source"))
    item = lambda x: F.struct(F.coalesce(x["m_ConditionEvent"], F.lit("")).alias("parameter"), F.coalesce(x["m_ConditionMode"].cast("int"), F.lit(0)).alias("mode"), F.coalesce(x["m_EventTreshold"], F.lit("0")).alias("threshold"))
    s = F.col("scalars")
    t = docs.filter("type_name = 'AnimatorStateTransition'").select("asset", "file_id", F.coalesce(_first("m_DstState"), F.lit("")).alias("destination"), F.coalesce(s["m_HasExitTime"] == "1", F.lit(False)).alias("has_exit_time"), F.coalesce(s["m_IsExit"] == "1", F.lit(False)).alias("is_exit"), s["m_TransitionDuration"].alias("duration"), F.transform(F.col("lists")["m_Conditions"], item).alias("conditions"))
    return t.join(sources, ["asset", "file_id"], "left").fillna("", ["source"])


def blend_trees(docs: DataFrame, guids: DataFrame) -> DataFrame:
    """asset, file_id, name, parameter, k, threshold, motion, confidence of every child of a blend tree."""
    b = docs.filter("type_name = 'BlendTree'").select("asset", "file_id", F.col("scalars")["m_Name"].alias("name"), F.col("scalars")["m_BlendParameter"].alias("parameter"), F.posexplode(F.col("lists")["m_Childs"]).alias("k", "c"))
    guid = F.lower(F.regexp_extract(F.col("c")["m_Motion"], r"guid:\s*([0-9a-fA-F]{32})", 1))
    return _resolved(b.select("asset", "file_id", "name", "parameter", "k", F.coalesce(F.col("c")["m_Threshold"], F.lit("0")).alias("threshold"), F.coalesce(guid, F.lit("")).alias("guid")), guids).select("asset", "file_id", "name", "parameter", "k", "threshold", F.col("target").alias("motion"), "confidence")


# assets


def animation_clips(docs: DataFrame) -> DataFrame:
    """asset, name, sample_rate, curve_count, binding_paths, properties, events."""
    s = F.col("scalars")
    curves = F.flatten(F.array(*[F.coalesce(F.col("lists")[c], F.array().cast("array<map<string,string>>")) for c in CURVES]))
    named = lambda maps, key: F.sort_array(F.array_distinct(F.filter(F.transform(maps, lambda m: m[key]), lambda x: x.isNotNull() & (x != ""))))
    events = F.coalesce(F.col("lists")["m_Events"], F.array().cast("array<map<string,string>>"))
    count = sum((F.coalesce(F.col("counts")[c], F.lit(0)) for c in CURVES), F.lit(0))
    return docs.filter("type_name = 'AnimationClip'").select("asset", s["m_Name"].alias("name"), s["m_SampleRate"].try_cast("double").alias("sample_rate"), count.alias("curve_count"), named(curves, "path").alias("binding_paths"), named(curves, "attribute").alias("properties"), named(events, "functionName").alias("events"))


def materials(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """asset, name, shader, textures, texture_references."""
    m = docs.filter("type_name = 'Material'").select("asset", F.col("scalars")["m_Name"].alias("name"))
    f = F.col("field")
    r = refs.groupBy("asset").agg(F.first(F.when(f == "m_Shader", F.col("target")), ignorenulls=True).alias("shader"), F.sort_array(F.collect_set(F.when((f == "m_Texture") & (F.col("target") != ""), F.col("target")))).alias("textures"), F.count_if(f == "m_Texture").alias("texture_references"))
    return m.join(r, "asset", "left").select("asset", "name", F.coalesce("shader", F.lit("")).alias("shader"), F.coalesce("textures", F.array().cast("array<string>")).alias("textures"), F.coalesce("texture_references", F.lit(0)).alias("texture_references"))


def meshes(docs: DataFrame) -> DataFrame:
    """asset, name, vertex_count, submesh_count."""
    s = F.col("scalars")
    return docs.filter("type_name = 'Mesh'").select("asset", s["m_Name"].alias("name"), F.coalesce(s["m_VertexCount"].try_cast("int"), F.lit(0)).alias("vertex_count"), F.coalesce(F.col("counts")["m_SubMeshes"], F.lit(0)).alias("submesh_count"))


def asset_counts(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """asset, documents, objects, references, exact, partial, unresolved."""
    d = docs.groupBy("asset").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("type_name") == "GameObject").alias("objects"))
    c = lambda x: F.count_if(F.col("confidence") == x).alias(x)
    return d.join(refs.groupBy("asset").agg(F.count(F.lit(1)).alias("references"), c("exact"), c("partial"), c("unresolved")), "asset", "left").fillna(0)


def same_name(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column equals the value, letter case aside."""
    return df.filter(F.lower(column) == value.lower())

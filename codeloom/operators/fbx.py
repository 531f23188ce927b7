"""Models in FBX files, binary and text: objects and connections as tables, and plans over those.

A file's tree of nodes is walked once, in Arrow batches; long arrays are passed over,
only their length and number of negative values (polygon ends) are kept.  What the
model holds (hierarchy, meshes, materials, skeleton, animations) follows by joins.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

MAGIC = b"Kaydara FBX Binary  \x00\x1a\x00"
TICKS = 46_186_158_000
#: Frames a second of each time mode; 14 is a rate of the file's own.
RATES = {1: 120.0, 2: 100.0, 3: 60.0, 4: 50.0, 5: 48.0, 6: 30.0, 7: 30.0, 8: 29.97, 9: 29.97, 10: 25.0, 11: 24.0, 12: 1000.0, 13: 23.976, 15: 96.0, 16: 72.0, 17: 59.94}
_SCALARS = {"Y": ("<h", 2), "C": ("<?", 1), "I": ("<i", 4), "F": ("<f", 4), "D": ("<d", 8), "L": ("<q", 8)}
_ARRAYS = {"f": "<f4", "d": "<f8", "l": "<i8", "i": "<i4", "b": "|i1", "c": "|i1"}
_OBJECT = re.compile(r"^\s*(\w+):\s*(\d+),\s*\"([^\"]*)\",\s*\"([^\"]*)\"\s*\{")
_LINK = re.compile(r"^\s*C:\s*\"(\w+)\",\s*(\d+),\s*(\d+)")
_FIELDS = (
    "asset string, format string, version int, time_mode int, custom_rate double, "
    "objects array<struct<id:bigint,kind:string,name:string,subtype:string,points:bigint,corners:bigint,polygons:bigint,start:bigint,stop:bigint>>, links array<struct<kind:string,child:bigint,parent:bigint>>, error string"
)


class FbxError(ValueError):
    """A file that is no FBX, or a broken one."""


class _Array(tuple):
    """(length, negative values) of an array property."""


def _name(raw) -> str:
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else str(raw)
    return text.split("\x00\x01")[0] if "\x00\x01" in text else text.rsplit("::", 1)[-1]


def _property(data: bytes, at: int):
    kind = chr(data[at])
    at += 1
    if kind in _SCALARS:
        form, size = _SCALARS[kind]
        return struct.unpack_from(form, data, at)[0], at + size
    if kind in "SR":
        (n,) = struct.unpack_from("<I", data, at)
        return data[at + 4 : at + 4 + n], at + 4 + n
    if kind in _ARRAYS:
        count, packed, size = struct.unpack_from("<III", data, at)
        raw = data[at + 12 : at + 12 + size]
        negative = 0
        if kind in "il":
            values = np.frombuffer(zlib.decompress(raw) if packed else raw, _ARRAYS[kind], count)
            negative = int((values < 0).sum())
        return _Array((count, negative)), at + 12 + size
    raise FbxError(f"property of unknown type {kind!r}")


def _nodes(data: bytes, at: int, end: int, wide: bool, wanted: frozenset | None, depth: int = 0):
    """(name, properties, first byte below, end) of the nodes in a span; with wanted, of those names only."""
    form, size = ("<QQQB", 25) if wide else ("<IIIB", 13)
    while at + size <= end:
        stop, count, _, n = struct.unpack_from(form, data, at)
        if stop == 0:
            return
        if stop <= at or stop > end:
            raise FbxError("node beyond its parent")
        name = data[at + size : at + size + n].decode("ascii", "replace")
        if wanted is None or name in wanted:
            inside, values = at + size + n, []
            for _ in range(count):
                value, inside = _property(data, inside)
                values.append(value)
            yield name, values, inside, stop
        at = stop


def _settings(data, inside, stop, wide, names) -> dict:
    found = {}
    for _, _, a, b in _nodes(data, inside, stop, wide, frozenset({"Properties70"})):
        for _, values, _, _ in _nodes(data, a, b, wide, frozenset({"P"})):
            if values and _name(values[0]) in names and len(values) > 4:
                found[_name(values[0])] = values[4]
    return found


def read_binary(data: bytes) -> dict:
    if len(data) < 27:
        raise FbxError("no header")
    (version,) = struct.unpack_from("<I", data, 23)
    wide = version >= 7500
    out = {"format": "binary", "version": version, "time_mode": None, "custom_rate": None, "objects": [], "links": []}
    found = False
    for name, _, inside, stop in _nodes(data, 27, len(data), wide, frozenset({"Objects", "Connections", "GlobalSettings"})):
        if name == "GlobalSettings":
            s = _settings(data, inside, stop, wide, ("TimeMode", "CustomFrameRate"))
            out["time_mode"], out["custom_rate"] = s.get("TimeMode"), s.get("CustomFrameRate")
        elif name == "Connections":
            out["links"] += [dict(kind=_name(v[0]), child=v[1], parent=v[2]) for k, v, _, _ in _nodes(data, inside, stop, wide, None) if k == "C" and len(v) > 2 and isinstance(v[1], int) and isinstance(v[2], int)]
        else:
            found = True
            for kind, v, a, b in _nodes(data, inside, stop, wide, None):
                if len(v) < 3 or not isinstance(v[0], int):
                    continue
                row = dict(id=v[0], kind=kind, name=_name(v[1]), subtype=_name(v[2]), points=0, corners=0, polygons=0, start=None, stop=None)
                if kind == "Geometry":
                    for part, values, _, _ in _nodes(data, a, b, wide, frozenset({"Vertices", "PolygonVertexIndex"})):
                        if values and isinstance(values[0], _Array):
                            n, negative = values[0]
                            row |= {"points": n // 3} if part == "Vertices" else {"corners": n, "polygons": negative}
                elif kind == "AnimationStack":
                    s = _settings(data, a, b, wide, ("LocalStart", "LocalStop"))
                    row |= {"start": s.get("LocalStart", 0), "stop": s.get("LocalStop", 0)}
                out["objects"].append(row)
    if not found:
        raise FbxError("no objects")
    return out


def read_text(source: str) -> dict:
    version = re.search(r"FBXVersion:\s*(\d+)", source)
    objects, links = [], []
    for line in source.splitlines():
        if m := _OBJECT.match(line):
            objects.append(dict(id=int(m[2]), kind=m[1], name=_name(m[3]), subtype=m[4], points=0, corners=0, polygons=0, start=None, stop=None))
        elif m := _LINK.match(line):
            links.append(dict(kind=m[1], child=int(m[2]), parent=int(m[3])))
    if not objects:
        raise FbxError("no objects")
    return {"format": "text", "version": int(version[1]) if version else 0, "time_mode": None, "custom_rate": None, "objects": objects, "links": links}


def read(data: bytes) -> dict:
    if data.startswith(MAGIC):
        return read_binary(data)
    head = data[:4096].decode("latin-1")
    if "FBX" not in head:
        raise FbxError("no FBX file")
    return read_text(data.decode("utf-8", "replace"))


def models(files: DataFrame) -> DataFrame:
    """asset, format, version, time_mode, custom_rate, objects, links and error of files(path, content).

    A file that can't be read has empty lists and says why.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_FIELDS))

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                row = {"asset": path, "format": None, "version": None, "time_mode": None, "custom_rate": None, "objects": [], "links": [], "error": None}
                try:
                    row |= read(data or b"")
                except (ValueError, struct.error, zlib.error, IndexError) as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, _FIELDS)


def objects(found: DataFrame) -> DataFrame:
    """asset, id, kind, name, subtype and the counts of every object; of an id told twice the last."""
    each = found.select("asset", F.posexplode("objects").alias("n", "o"))
    return each.groupBy("asset", F.col("o.id").alias("key")).agg(F.max_by("o", "n").alias("o")).select("asset", "o.*")


def links(found: DataFrame) -> DataFrame:
    return found.select("asset", F.explode("links").alias("l")).select("asset", "l.*")


def _owned(objs: DataFrame, ties: DataFrame, kind: str) -> DataFrame:
    """asset, id and the sorted names of the models that objects of a kind hang on."""
    own = objs.filter(F.col("kind") == kind).select("asset", "id")
    t = ties.select("asset", F.col("child").alias("id"), F.col("parent"))
    m = objs.filter("kind = 'Model'").select("asset", F.col("id").alias("parent"), F.col("name").alias("model"))
    return own.join(t, ["asset", "id"]).join(m, ["asset", "parent"]).groupBy("asset", "id").agg(F.sort_array(F.collect_set("model")).alias("models"))


def meshes(objs: DataFrame, ties: DataFrame) -> DataFrame:
    """asset, name, control_points, polygon_vertices, polygons, models."""
    g = objs.filter("kind = 'Geometry' and subtype = 'Mesh'")
    return g.join(_owned(objs, ties, "Geometry"), ["asset", "id"], "left").select("asset", "name", F.col("points").alias("control_points"), F.col("corners").alias("polygon_vertices"), "polygons", F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def materials(objs: DataFrame, ties: DataFrame) -> DataFrame:
    """asset, name, models."""
    return objs.filter("kind = 'Material'").join(_owned(objs, ties, "Material"), ["asset", "id"], "left").select("asset", "name", F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def textures(objs: DataFrame) -> DataFrame:
    return objs.filter(F.col("kind").isin("Texture", "Video") & (F.col("name") != "")).select("asset", "name").distinct()


def parents(objs: DataFrame, ties: DataFrame) -> DataFrame:
    """asset, id, parent of models below models, by the last link told."""
    m = objs.filter("kind = 'Model'").select("asset", "id")
    t = ties.filter(F.col("kind").isin("OO", "OP")).select("asset", F.col("child").alias("id"), "parent")
    return t.join(m, ["asset", "id"]).join(m.withColumnRenamed("id", "parent"), ["asset", "parent"]).groupBy("asset", "id").agg(F.max("parent").alias("parent"))


def hierarchy(objs: DataFrame, ties: DataFrame) -> DataFrame:
    """asset, id, name, type, depth, path of every model; those in a circle of parents, or below one, have no depth and their name as path.

    Paths double: each round puts what the ancestor reached so far has collected first.
    """
    m = objs.filter("kind = 'Model'").select("asset", "id", "name", F.coalesce(F.nullif("subtype", F.lit("")), F.lit("Null")).alias("type"))
    p = cut(m.join(parents(objs, ties), ["asset", "id"], "left").select("asset", "id", "name", "type", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col("name").alias("path")))
    p = cut(p.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0)))
    left, before = p.filter("up is not null").count(), None
    while left and left != before:
        above = p.select("asset", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("prefix"))
        p = cut(p.join(above, ["asset", "up"], "left").select("asset", "id", "name", "type", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.concat(F.coalesce(F.concat("prefix", F.lit("/")), F.lit("")), "path").alias("path")))
        left, before = p.filter("up is not null").count(), left
    open_ = F.col("up").isNotNull()
    return p.select("asset", "id", "name", "type", F.when(~open_, F.col("depth")).alias("depth"), F.when(open_, F.col("name")).otherwise(F.col("path")).alias("path"))


def bones(objs: DataFrame, ties: DataFrame) -> DataFrame:
    """asset, name, parent, is_root of the skeleton's bones; a root has no bone above it."""
    b = objs.filter("kind = 'Model' and subtype in ('LimbNode', 'Root')").select("asset", "id", "name")
    up = objs.filter("kind = 'Model'").select("asset", F.col("id").alias("parent"), F.col("name").alias("parent_name"), F.col("subtype").isin("LimbNode", "Root").alias("bone"))
    j = b.join(parents(objs, ties), ["asset", "id"], "left").join(up, ["asset", "parent"], "left")
    return j.select("asset", "name", F.coalesce("parent_name", F.lit("")).alias("parent"), (~F.coalesce("bone", F.lit(False))).alias("is_root"))


def animations(found: DataFrame, objs: DataFrame, ties: DataFrame) -> DataFrame:
    """asset, name, layers, curves, frame_rate, start_seconds, end_seconds, first_frame, last_frame of animation stacks.

    Curves hang on curve nodes, those on layers, those on the stack.
    """
    rate = F.when((F.col("time_mode") == 14) & (F.col("custom_rate") > 0), F.col("custom_rate"))
    for mode, value in RATES.items():
        rate = rate.when(F.col("time_mode") == mode, value)
    t = ties.select("asset", "child", "parent")
    of = lambda kind, name, up: objs.filter(F.col("kind") == kind).select("asset", F.col("id").alias("child")).join(t, ["asset", "child"]).select("asset", F.col("child").alias(name), F.col("parent").alias(up)).distinct()
    layers = of("AnimationLayer", "layer", "id")
    curves = of("AnimationCurve", "curve", "node").join(of("AnimationCurveNode", "node", "layer"), ["asset", "node"]).select("asset", "layer", "curve")
    n = layers.join(curves, ["asset", "layer"], "left").groupBy("asset", "id").agg(F.countDistinct("layer").alias("layers"), F.countDistinct("curve").alias("curves"))
    s = objs.filter("kind = 'AnimationStack'").join(n, ["asset", "id"], "left").join(found.select("asset", rate.alias("frame_rate")), "asset")
    told = (F.col("stop") >= F.col("start")) & ((F.col("start") != 0) | (F.col("stop") != 0))
    sec = lambda c: F.when(told, F.col(c) / TICKS)
    return s.select("asset", "name", F.coalesce("layers", F.lit(0)).alias("layers"), F.coalesce("curves", F.lit(0)).alias("curves"), "frame_rate", sec("start").alias("start_seconds"), sec("stop").alias("end_seconds"), F.round(sec("start") * F.col("frame_rate"), 3).alias("first_frame"), F.round(sec("stop") * F.col("frame_rate"), 3).alias("last_frame"))


def summary(found: DataFrame) -> DataFrame:
    """asset, format, version, models, meshes, materials, textures, bones, animations, confidence, error.

    Text files tell no counts of meshes, so they are partial; broken files unresolved.
    """
    o = objects(found)
    n = lambda c, name: F.count_if(c).alias(name)
    k, s = F.col("kind"), F.col("subtype")
    counts = o.groupBy("asset").agg(n(k == "Model", "models"), n((k == "Geometry") & (s == "Mesh"), "meshes"), n(k == "Material", "materials"), F.countDistinct(F.when(k.isin("Texture", "Video") & (F.col("name") != ""), F.col("name"))).alias("textures"), n((k == "Model") & s.isin("LimbNode", "Root"), "bones"), n(k == "AnimationStack", "animations"))
    confidence = F.when(F.col("error").isNotNull(), "unresolved").when(F.col("format") == "text", "partial").otherwise("exact")
    return found.select("asset", "format", "version", "error", confidence.alias("confidence")).join(counts, "asset", "left").fillna(0, ["models", "meshes", "materials", "textures", "bones", "animations"])

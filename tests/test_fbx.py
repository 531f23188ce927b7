import struct
import zlib

import pytest

from codeloom.operators import fbx


def prop(v):
    if isinstance(v, str):
        return b"S" + struct.pack("<I", len(v.encode())) + v.encode()
    if isinstance(v, float):
        return b"D" + struct.pack("<d", v)
    if isinstance(v, tuple):  # (kind, values, packed)
        kind, values, packed = v
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        out = zlib.compress(raw) if packed else raw
        return kind.encode() + struct.pack("<III", len(values), int(packed), len(out)) + out
    return b"L" + struct.pack("<q", v)


def node(at, name, props=(), children=(), wide=False):
    """Bytes of a node that begins at offset at."""
    form, size = ("<QQQB", 25) if wide else ("<IIIB", 13)
    own = b"".join(map(prop, props))
    body, pos = b"", at + size + len(name) + len(own)
    for c in children:
        part = node(pos, *c, wide=wide)
        body, pos = body + part, pos + len(part)
    if children:
        body += b"\0" * size
    return struct.pack(form, at + size + len(name) + len(own) + len(body), len(props), len(own), len(name)) + name.encode() + own + body


def binary(top, version=7400):
    out = fbx.MAGIC + struct.pack("<I", version)
    for t in top:
        out += node(len(out), *t, wide=version >= 7500)
    return out + b"\0" * 25


def values(**kw):
    return ("Properties70", (), [("P", (k, "KTime", "Time", "", v)) for k, v in kw.items()])


S = fbx.TICKS
TOP = [
    ("GlobalSettings", (), [values(TimeMode=6)]),
    ("Objects", (), [
        ("Model", (1, "Root\0\1Model", "Null")), ("Model", (2, "Hip\0\1Model", "LimbNode")), ("Model", (3, "Leg\0\1Model", "LimbNode")), ("Model", (4, "Body\0\1Model", "Mesh")),
        ("Geometry", (10, "Shape\0\1Geometry", "Mesh"), [("Vertices", (("d", [0.0] * 12, True),)), ("PolygonVertexIndex", (("i", [0, 1, -3, 0, 2, -4], False),))]),
        ("Material", (20, "Skin\0\1Material", "")), ("Texture", (21, "Map\0\1Texture", "")),
        ("AnimationStack", (30, "Walk\0\1AnimStack", ""), [values(LocalStart=S, LocalStop=3 * S)]), ("AnimationLayer", (31, "Base\0\1AnimLayer", "")), ("AnimationCurveNode", (32, "T\0\1AnimCurveNode", "")), ("AnimationCurve", (33, "\0\1AnimCurve", "")),
    ]),
    ("Connections", (), [("C", ("OO", c, p)) for c, p in ((2, 1), (3, 2), (4, 1), (10, 4), (20, 4), (31, 30), (32, 31), (33, 32))]),
]
TEXT = '; FBX 7.4.0 project file\nFBXVersion: 7400\nObjects: {\n  Model: 1, "Model::A", "Mesh" {\n  }\n  Model: 2, "Model::B", "Null" {\n  }\n}\nConnections: {\n  C: "OO",1,2\n}\n'


@pytest.mark.parametrize("version", [7400, 7700])
def test_binary_models(spark, version):
    found = fbx.models(spark.createDataFrame([("a.fbx", bytearray(binary(TOP, version)))], "path string, content binary")).cache()
    o, t = fbx.objects(found), fbx.links(found)
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got(fbx.summary(found).select("asset", "format", "version", "confidence", "models", "meshes", "materials", "textures", "bones", "animations")) == [("a.fbx", "binary", version, "exact", 4, 1, 1, 1, 2, 1)]
    assert got(fbx.meshes(o, t)) == [("a.fbx", "Shape", 4, 6, 2, ["Body"])]
    assert got(fbx.materials(o, t)) == [("a.fbx", "Skin", ["Body"])] and got(fbx.textures(o)) == [("a.fbx", "Map")]
    assert got(fbx.hierarchy(o, t).select("path", "depth", "type")) == [("Root", 0, "Null"), ("Root/Body", 1, "Mesh"), ("Root/Hip", 1, "LimbNode"), ("Root/Hip/Leg", 2, "LimbNode")]
    assert got(fbx.bones(o, t)) == [("a.fbx", "Hip", "Root", True), ("a.fbx", "Leg", "Hip", False)]
    assert got(fbx.animations(found, o, t)) == [("a.fbx", "Walk", 1, 1, 30.0, 1.0, 3.0, 30.0, 90.0)]


def test_text_broken_and_circular_models(spark):
    circle = [("Objects", (), [("Model", (1, "A\0\1Model", "Null")), ("Model", (2, "B\0\1Model", "Null"))]), ("Connections", (), [("C", ("OO", 1, 2)), ("C", ("OO", 2, 1))])]
    rows = [("t.fbx", TEXT.encode()), ("b.fbx", binary(TOP)[:200]), ("n.fbx", b"nothing"), ("e.fbx", b""), ("z.fbx", None), ("c.fbx", binary(circle))]
    found = fbx.models(spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in rows], "path string, content binary")).cache()
    state = {r.asset: r.confidence for r in fbx.summary(found).collect()}
    assert state == {"t.fbx": "partial", "b.fbx": "unresolved", "n.fbx": "unresolved", "e.fbx": "unresolved", "z.fbx": "unresolved", "c.fbx": "exact"}
    paths = {(r.asset, r.path, r.depth) for r in fbx.hierarchy(fbx.objects(found), fbx.links(found)).collect()}
    assert paths == {("t.fbx", "B", 0), ("t.fbx", "B/A", 1), ("c.fbx", "A", None), ("c.fbx", "B", None)}
    assert fbx.summary(found.limit(0)).count() == 0

import pytest

from codeloom.operators import evidence
from codeloom.operators import unity as U

A, B, C, D = (x * 32 for x in "abcd")
PREFAB = f"""%YAML 1.1
--- !u!1 &100
GameObject:
  m_Component:
  - component: {{fileID: 200}}
  - component: {{fileID: 300}}
  - component: {{fileID: 999}}
  m_Name: Root
  m_Layer: 5
  m_TagString: Player
  m_IsActive: 1
--- !u!4 &200
Transform:
  m_GameObject: {{fileID: 100}}
  m_Father: {{fileID: 0}}
  m_Children:
  - {{fileID: 201}}
  - {{fileID: 202}}
--- !u!114 &300
MonoBehaviour:
  m_GameObject: {{fileID: 100}}
  m_Enabled: 1
  m_Script: {{fileID: 11500000, guid: {A}, type: 3}}
  speed: 3.5
  icon: {{fileID: 21300000, guid: {B},
    type: 3}}
  onClick:
    m_PersistentCalls:
      m_Calls:
      - m_Target: {{fileID: 300}}
        m_TargetAssemblyTypeName: Game.Player, Assembly-CSharp
        m_MethodName: Jump
        m_Mode: 1
        m_CallState: 2
      - m_Target: {{fileID: 300}}
        m_MethodName: Fly
        m_CallState: 0
--- !u!1 &101
GameObject:
  m_Component:
  - component: {{fileID: 201}}
  m_Name: Child
--- !u!4 &201
Transform:
  m_GameObject: {{fileID: 101}}
  m_Father: {{fileID: 200}}
  m_Children: []
--- !u!1 &102
GameObject:
  m_Name: Leaf
--- !u!4 &202 stripped
Transform:
  m_GameObject: {{fileID: 102}}
  m_Father: {{fileID: 201}}
--- !u!1001 &500
PrefabInstance:
  m_Modifications:
  - target: {{fileID: 1}}
    value: x
  - target: {{fileID: 2}}
    value: y
  m_SourcePrefab: {{fileID: 100100000, guid: {C}, type: 3}}
"""
CONTROLLER = f"""--- !u!91 &9100000
AnimatorController:
  m_AnimatorParameters:
  - m_Name: speed
    m_Type: 1
    m_DefaultFloat: 0.5
  - m_Name: jump
    m_Type: 9
    m_DefaultBool: 1
  m_AnimatorLayers:
  - m_Name: Base
    m_StateMachine: {{fileID: 1107}}
--- !u!1107 &1107
AnimatorStateMachine:
  m_AnyStateTransitions:
  - {{fileID: 51}}
  m_DefaultState: {{fileID: 40}}
--- !u!1102 &40
AnimatorState:
  m_Name: Idle
  m_Transitions:
  - {{fileID: 50}}
  m_Motion: {{fileID: 7400000, guid: {D}, type: 2}}
--- !u!1101 &50
AnimatorStateTransition:
  m_Conditions:
  - m_ConditionMode: 3
    m_ConditionEvent: speed
    m_EventTreshold: 0.1
  m_DstState: {{fileID: 41}}
  m_HasExitTime: 1
--- !u!1101 &51
AnimatorStateTransition:
  m_DstState: {{fileID: 40}}
"""
CLIP = """--- !u!74 &7400000
AnimationClip:
  m_Name: Walk
  m_PositionCurves:
  - curve: x
    path: Hips
    attribute: m_LocalPosition
  m_SampleRate: 60
  m_Events:
  - time: 0
    functionName: Step
"""


@pytest.fixture(scope="module")
def world(spark):
    meta = lambda path, guid: (path + ".meta", f"fileFormatVersion: 2\nguid: {guid}\n")
    rows = [("p.prefab", PREFAB), ("c.controller", CONTROLLER), ("w.anim", CLIP), ("Player.cs", "class"), ("icon.png", None), ("q1.prefab", ""), ("q2.prefab", ""), ("n.txt", PREFAB), meta("Player.cs", A), meta("icon.png", B), meta("q1.prefab", C), meta("q2.prefab", C.upper()), meta("w.anim", D), meta("gone.cs", "e" * 32)]
    files = spark.createDataFrame(rows, "path string, source string")
    types = spark.createDataFrame([("Player.cs", "Player", "Game.Player", "t1", False), ("Player.cs", "Base", "Game.Base", "t0", True)], "path string, name string, qualified_name string, id string, is_abstract boolean")
    methods = spark.createDataFrame([("t1", "Jump", "m1")], "type_id string, name string, id string")
    return U.documents(files).cache(), U.guid_index(files).cache(), types, methods


def test_documents(world):
    docs = {(r.asset, r.file_id): r for r in world[0].collect()}
    assert {k[0] for k in docs} == {"p.prefab", "c.controller", "w.anim"} and len(docs) == 14
    assert docs["p.prefab", "202"].stripped and docs["p.prefab", "300"].type_name == "MonoBehaviour"
    assert {r.field: r.guid for r in docs["p.prefab", "300"].refs}["icon"] == B  # joined over two lines


def test_guid_index(world):
    assert {r.guid: r.assets for r in world[1].collect()} == {A: ["Player.cs"], B: ["icon.png"], C: ["q1.prefab", "q2.prefab"], D: ["w.anim"]}


def test_hierarchy(world):
    got = {r.file_id: (r.path, r.tag, r.layer, r.children) for r in U.game_objects(world[0]).collect()}
    assert got == {"100": ("Root", "Player", 5, ["101", "102"]), "101": ("Root/Child", "Untagged", 0, []), "102": ("Root/Child/Leaf", "Untagged", 0, [])}


def test_deep_and_circular_parents(spark):
    body = "".join(f"--- !u!1 &{k}\nGameObject:\n  m_Name: n{k}\n--- !u!4 &{1000 + k}\nTransform:\n  m_GameObject: {{fileID: {k}}}\n  m_Father: {{fileID: {1000 + k - 1 if k > 1 else 0}}}\n" for k in range(1, 41))
    body += "--- !u!1 &90\nGameObject:\n  m_Name: ring\n--- !u!4 &91\nTransform:\n  m_GameObject: {fileID: 90}\n  m_Father: {fileID: 91}\n"
    got = {r.file_id: r.path for r in U.game_objects(U.documents(spark.createDataFrame([("d.unity", body)], "path string, source string"))).collect()}
    assert got["40"] == "/".join(f"n{k}" for k in range(1, 41)) and got["90"] == "ring"


def test_components(world):
    docs, guids, types, _ = world
    got = {(r.object, r.file_id): (r.type, r.confidence, r.boundary) for r in U.components(docs, guids, types).collect()}
    assert got == {("100", "200"): ("Transform", "exact", "builtin"), ("100", "300"): ("Player", "exact", "repository"), ("100", "999"): ("MissingComponent", "unresolved", None), ("101", "201"): ("Transform", "exact", "builtin"), ("102", "202"): ("Transform", "partial", "builtin")}


def test_references_and_edges(world):
    docs, guids, types, methods = world
    refs = U.references(docs, guids)
    assert {(r.field, r.target, r.confidence, r.line) for r in refs.filter("asset = 'p.prefab'").collect()} == {("m_Script", "Player.cs", "exact", 23), ("icon", "icon.png", "exact", 25), ("m_SourcePrefab", "", "partial", len(PREFAB.splitlines()))}
    e = evidence.merge(U.edges(refs, U.event_bindings(docs, guids, types, methods)))
    assert {(r.source, r.target): r.kinds for r in e.collect()} == {("p.prefab", "Player.cs"): ["unity_component", "unity_event"], ("p.prefab", "icon.png"): ["serialized_guid"], ("c.controller", "w.anim"): ["animator_motion"]}


def test_events(world):
    docs, guids, types, methods = world
    got = {r.method: r for r in U.event_bindings(docs, guids, types, methods).collect()}
    assert (got["Jump"].confidence, got["Jump"].status, got["Jump"].field, got["Jump"].owner_path, got["Jump"].target_script) == ("exact", "exact", "onClick", "Root", "Player.cs")
    assert (got["Fly"].confidence, got["Fly"].status, got["Fly"].reason) == ("unresolved", "disabled", "method_not_found_in_type")
    calls = U.event_calls(U.event_bindings(docs, guids, types, methods)).collect()
    assert [(r.caller, r.callee) for r in calls] == [("p.prefab:300:onClick", "m1")]


def test_prefabs_animators_and_clips(world):
    docs, guids, _, _ = world
    p = U.prefab_instances(docs, guids).first()
    assert (p.confidence, p.candidates, p.modification_count, p.stripped_documents) == ("partial", ["q1.prefab", "q2.prefab"], 2, 1)
    assert {(r.name, r.type, r.default) for r in U.animator_parameters(docs).collect()} == {("speed", "float", "0.5"), ("jump", "trigger", "true")}
    assert [tuple(r)[1:] for r in U.animator_layers(docs).collect()] == [("1107", "Base", "40")]
    assert [(r.name, r.motion, r.confidence) for r in U.animator_states(docs, guids).collect()] == [("Idle", "w.anim", "exact")]
    t = {r.file_id: (r.source, r.destination, r.has_exit_time, len(r.conditions or [])) for r in U.animator_transitions(docs).collect()}
    assert t == {"50": ("40", "41", True, 1), "51": ("AnyState:1107", "40", False, 0)}
    c = U.animation_clips(docs).first()
    assert (c.name, c.sample_rate, c.curve_count, c.binding_paths, c.properties, c.events) == ("Walk", 60.0, 1, ["Hips"], ["m_LocalPosition"], ["Step"])

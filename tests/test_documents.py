"""Schema constructs and rules on single documents, and the document plan on a DataFrame."""

import json
import sys

import pytest

from treeline.errors import CircularUsesError, RefineTargetError, SchemaError, SchemaSyntaxError, XPathError
from treeline.plans import document_catalog
from treeline.plans.documents import RULES, DocumentPlan, Options, Validator, summary, violations
from treeline.schema.load import parse_file, parse_string


def module(body, head=""):
    return parse_string(f'module m {{ namespace "urn:m"; prefix m; {head} {body} }}')


def errors(m, data, **options):
    return Validator(m, **options).validate(data)[1]


LISTS = "container r { list items { key name; leaf name { type string; } leaf value { type string; } } }"


@pytest.mark.parametrize(
    "body,good,bad,text",
    [
        (LISTS, {"r": {"items": [{"name": "a"}, {"name": "b"}]}}, {"r": {"items": [{"name": "a"}, {"name": "a"}]}}, "Duplicate key in list 'items': name='a' (entries at index 0 and 1)"),
        ("container d { leaf type { type string; } container t { when \"../type = 'array'\"; leaf p { type string; } } }", {"d": {"type": "array", "t": {}}}, {"d": {"type": "x", "t": {}}}, "this node must not exist"),
        ("leaf f { type bits { bit execute { position 0; } bit read { position 2; } bit write; } }", {"f": "read write"}, {"f": "read read"}, "Duplicate bit 'read'"),
        ("leaf f { type bits { bit a; } }", {"f": "a"}, {"f": "z"}, "Unknown bit 'z'"),
        ("leaf v { type union { type int32; type bits { bit a; bit b; } } }", {"v": "a b"}, {"v": "z"}, "does not match any union member type (int32, bits)"),
        ("leaf b { type binary { length 0..16; } }", {"b": "aGVsbG8="}, {"b": "not!!!base64"}, "not valid base64"),
        ("leaf b { type binary { length 0..4; } }", {"b": "aGk="}, {"b": "aGVsbG8="}, "exceeds maximum 4"),
        ("leaf n { type int8; }", {"n": "12"}, {"n": 128}, "Value 128 exceeds maximum 127"),
        ("leaf n { type uint64; }", {"n": 18446744073709551615}, {"n": -1}, "less than minimum 0"),
        ("leaf n { type decimal64 { fraction-digits 2; range 0..1; } }", {"n": 0.25}, {"n": 0.125}, "more than 2 fraction digits"),
        ("leaf s { type string { length 1..3; pattern '[a-z]+' { error-message lower; error-app-tag tag; } } }", {"s": "ab"}, {"s": "AB"}, "lower (error-app-tag: tag)"),
        ("leaf s { type string { pattern 'x.*' { modifier invert-match; } } }", {"s": "ab"}, {"s": "xb"}, "matches forbidden pattern"),
        ("leaf e { type enumeration { enum a; enum b; } }", {"e": "a"}, {"e": "c"}, "not one of the allowed enum values: a, b"),
        ("leaf e { type boolean; }", {"e": "true"}, {"e": "yes"}, "not a valid boolean"),
        ("leaf e { type empty; }", {"e": None}, {"e": 5}, "Empty type leaf"),
        ("container c { leaf a { type string; mandatory true; } }", {"c": {"a": "x"}}, {"c": {}}, "Mandatory leaf 'a' is missing"),
        ("leaf-list l { type string; min-elements 2; max-elements 3; }", {"l": ["a", "b"]}, {"l": ["a"]}, "requires at least 2"),
        ("container c { leaf a { type string; } }", {"c": {}}, {"c": {"z": 1}}, "Unknown field 'z'"),
        ("container c { leaf a { type int32; must '. < ../b'; } leaf b { type int32; } }", {"c": {"a": 1, "b": 2}}, {"c": {"a": 3, "b": 2}}, "must constraint not satisfied on 'a'"),
        ("container c { list t { key n; leaf n { type string; } } leaf r { type leafref { path ../t/n; } } }", {"c": {"t": [{"n": "a"}], "r": "a"}}, {"c": {"t": [], "r": "a"}}, "not found via path '../t/n'"),
        ("container d { container top { leaf x { type string; } } leaf ptr { type instance-identifier; } }", {"d": {"top": {"x": "1"}, "ptr": "/d/top/x"}}, {"d": {"ptr": "/d/top/x"}}, "does not refer to an existing node"),
        ("container c { choice k { mandatory true; case a { leaf x { type string; } } leaf y { type string; } } }", {"c": {"x": "1"}}, {"c": {"x": "1", "y": "2"}}, "allows only one case"),
        ("container c { choice k { mandatory true; leaf x { type string; } } }", {"c": {"x": "1"}}, {"c": {}}, "Mandatory choice 'k' has no active case"),
    ],
)
def test_rules(body, good, bad, text):
    m = module(body)
    assert errors(m, good) == []
    found = errors(m, bad)
    assert len(found) == 1 and text in found[0], found


def test_nested_mandatory_choice_is_demanded_only_beside_its_case():
    m = module("container c { choice o { case a { leaf s { type string; } choice i { mandatory true; leaf x { type string; } } } case b { leaf z { type string; } } } }")
    assert errors(m, {"c": {"z": "1"}}) == [] and errors(m, {"c": {}}) == []
    assert "Mandatory choice 'i'" in errors(m, {"c": {"s": "1"}})[0]


def test_identities():
    head = "identity animal; identity mammal { base animal; } identity dog { base mammal; }"
    m = module("leaf k { type identityref { base animal; } must \"derived-from-or-self(., 'm:mammal')\"; }", head)
    assert errors(m, {"k": "m:dog"}) == [] and errors(m, {"k": "m:mammal"}) == []
    assert any("is not derived from all bases" in e for e in errors(m, {"k": "m:animal"}))
    assert any("does not resolve" in e for e in errors(m, {"k": "dog"}))
    strict = module("leaf k { type identityref { base animal; } must \"derived-from(., 'm:mammal')\"; }", head)
    assert errors(strict, {"k": "m:dog"}) == [] and errors(strict, {"k": "m:mammal"}) != []


def test_features():
    m = module("leaf a { if-feature 'f and not g'; type string; } leaf b { type string; }", "feature f; feature g;")
    assert errors(m, {"a": "x"}, features={"m": {"f"}}) == []
    assert "if-feature" in errors(m, {"a": "x"}, features={"m": {"f", "g"}})[0]
    assert errors(m, {"b": "x"}, features={"m": set()}) == []
    chained = module("leaf a { if-feature g; type string; }", "feature f; feature g { if-feature f; }")
    assert errors(chained, {"a": "x"}, features={"m": {"g"}}) != []


def test_uses_refine_augment():
    g = "grouping g { container c { leaf a { type string; default x; } leaf-list l { type string; } } }"
    m = module("uses g { refine c/a { mandatory true; default y; description d; } refine c/l { max-elements 1; } augment c { leaf n { type int8; } } }", g)
    c = m.root.find("c")
    assert (c.find("a").default, c.find("a").mandatory, c.find("l").max_elements) == ("y", True, 1)
    assert "allows at most 1" in errors(m, {"c": {"l": ["a", "b"], "n": 1}})[0]
    with pytest.raises(RefineTargetError):
        module("uses g { refine c/zz { mandatory true; } }", g)
    with pytest.raises(CircularUsesError):
        module("uses g;", "grouping g { container c { uses g; } }")


def test_two_modules(tmp_path):
    (tmp_path / "lib.yang").write_text('module lib { namespace "urn:l"; prefix l; container root { leaf x { type string; } } typedef pct { type int8 { range 0..100; } } }')
    (tmp_path / "main.yang").write_text('module main { namespace "urn:m"; prefix mm; import lib { prefix l; } augment "/l:root" { leaf y { type l:pct; } } }')
    main = parse_file(tmp_path / "main.yang")
    lib = main.imports["l"]
    assert errors(lib, {"root": {"x": "1", "main:y": 5}}) == []
    assert "Unknown field 'y'" in errors(lib, {"root": {"y": 5}})[0]
    assert "exceeds maximum 100" in errors(lib, {"root": {"main:y": 101}})[0]


def test_submodules_and_missing_imports(tmp_path):
    (tmp_path / "s.yang").write_text("submodule s { belongs-to a { prefix a; } leaf inside { type string; } }")
    (tmp_path / "a.yang").write_text('module a { namespace "urn:a"; prefix a; include s; }')
    assert errors(parse_file(tmp_path / "a.yang"), {"inside": "x"}) == []
    with pytest.raises(SchemaError):
        parse_string('module b { namespace "urn:b"; prefix b; import nowhere { prefix n; } }')


ENTITIES = """container dm { list entities { key name; leaf name { type string; } leaf pk { type string; }
  list fields { key name; leaf name { type string; }
    list fks { key entity; leaf entity { type leafref { path /dm/entities/name; }
      must "deref(current())/../pk = 'id'"; must "count(/dm/entities[name = current()]/fields) >= 1"; } } } } }"""


def test_deref_and_current():
    m = module(ENTITIES)
    data = {"dm": {"entities": [{"name": "a", "pk": "id", "fields": [{"name": "f", "fks": [{"entity": "a"}]}]}]}}
    assert errors(m, data) == []
    data["dm"]["entities"][0]["pk"] = "x"
    assert len(errors(m, data)) == 1
    data["dm"]["entities"][0]["fields"][0]["fks"][0]["entity"] = "zz"
    assert any("not found via path '/dm/entities/name'" in e for e in errors(m, data))


def test_anydata_modes_and_leafref_warnings():
    host = module("container n { anydata payload; }")
    payload = parse_string('module p { namespace "urn:p"; prefix p; container s { list i { key name; leaf name { type string; } leaf c { type uint64; } } } }')
    data = {"n": {"payload": {"p:s": {"i": [{"name": "a", "c": "not-a-number"}]}}}}
    assert errors(host, data) == []
    assert "not a valid integer" in errors(host, data, anydata={"p": payload})[0]
    assert errors(host, data, anydata={"p": payload}, anydata_candidate=True) == []
    assert "Unknown anydata member" in errors(host, {"n": {"payload": {"q:s": {}}}}, anydata={"p": payload})[0]
    ref = module("container c { leaf r { type leafref { path ../t; } } leaf t { type string; } }")
    ok, bad, warned = Validator(ref, leafref_severity="warning").validate({"c": {"r": "x"}})
    assert ok and not bad and len(warned) == 1


def test_structures():
    text = """module m { namespace "urn:m"; prefix m; import ietf-yang-structure-ext { prefix sx; }
      sx:structure box { leaf a { type int8; } } sx:augment-structure "/box" { leaf b { type int8; } } }"""
    from treeline.schema.load import Loader

    loader = Loader()
    loader.text('module ietf-yang-structure-ext { namespace "urn:sx"; prefix sx; extension structure { argument name; } extension augment-structure { argument path; } }')
    m = loader.text(text)
    assert errors(m, {"m:box": {"a": 1, "b": 2}}) == [] and errors(m, {"box": {"b": 200}}) != []


def test_own_extension():
    from treeline.schema.extensions import REGISTRY, extension

    @extension("m", "note")
    def note(builder, statement):
        builder.module.warnings.append(f"noted {statement.arg}")

    try:
        m = module('m:note "here"; m:other x;', "extension note { argument text; }")
    finally:
        del REGISTRY["m", "note"]
    assert m.warnings == ["noted here", "unknown extension 'm:other'"]


def test_parity_meanings_and_rfc():
    ranges = module("leaf n { type int32 { range '1..10 | 20..30'; } }")
    assert errors(ranges, {"n": 15}) == [] and errors(ranges, {"n": 15}, rfc=True) != []
    narrowed = module("leaf n { type t { length 1..2; } }", "typedef t { type string { length 1..9; } }")
    assert errors(narrowed, {"n": "abcd"}) == [] and errors(narrowed, {"n": "abcd"}, rfc=True) != []


@pytest.mark.parametrize(
    "text",
    ["module m {", "module m { leaf a }", "module m { bogus x; }", "container c { }", "module m { leaf a { type t; } leaf-list b { type enumeration; } }"],
)
def test_bad_text(text):
    with pytest.raises(SchemaError):
        parse_string(text)


@pytest.mark.parametrize("text", ["a//b", "a |b", "a div 2", "count(", "a[1", "*"])
def test_bad_expressions(text):
    with pytest.raises((XPathError, SchemaSyntaxError)):
        module(f'leaf a {{ type string; must "{text}"; }}')


@pytest.mark.parametrize(
    "expression,holds",
    [
        ("1 + 1 = 2", True), ("../b = ('x', 'y')", True), ("not(../zz)", True), ("../zz = ../yy", True), ("../zz != ../yy", False),
        ("'10' = 10", True), ("' a ' = 'a'", True), ("number('x') = number('x')", False), ("string-length(../b) = 1", True),
        ("translate(../b, 'x', 'z') = 'z'", True), ("concat(../b, 'q') = 'xq'", True), ("count(../l) = 3", True), ("../l[2] = 'n2'", True),
        ("../l = 'n3'", True), ("-1 < 0", True), ("../d = false()", True), ("unknown(1)", False), ("boolean(../l) and ../b = 'x'", True),
    ],
)
def test_expressions(expression, holds):
    m = module(f'container c {{ leaf a {{ type string; must "{expression}"; }} leaf b {{ type string; }} leaf-list l {{ type string; }} leaf d {{ type boolean; default false; }} }}')
    assert (errors(m, {"c": {"a": "1", "b": "x", "l": ["n1", "n2", "n3"]}}) == []) is holds


def test_dataframe(spark):
    docs = spark.createDataFrame(
        [(1, json.dumps({"r": {"items": [{"name": "a"}]}})), (2, json.dumps({"r": {"items": [{"name": "a"}, {"name": "a"}], "z": 1}})), (3, "{"), (4, None)],
        "doc_id bigint, doc string",
    )
    found = violations(docs, module(LISTS), Options())
    rows = {(r.doc_id, r.rule, r.seq) for r in found.collect()}
    assert rows == {(2, "key", 0), (2, "unknown", 1), (3, "malformed-json", 0), (4, "malformed-json", 0)}
    assert {(r.doc_id, r.valid) for r in summary(docs, found).collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert violations(docs.limit(0), module(LISTS)).count() == 0


MANY = """container r { must "x = 1"; leaf x { type int8 { range 1..5; } } leaf y { type string { length 1..2; } mandatory true; }
  leaf w { when "../x = 1"; type decimal64 { fraction-digits 1; } } leaf f { if-feature off; type string; } leaf-list l { type enumeration { enum a; } min-elements 1; max-elements 2; must ". = 'a'"; }
  list e { key k; must "v > 1"; leaf k { type int8; } leaf v { type uint8; } container in { leaf q { type string; mandatory true; } } }
  choice c { mandatory true; case a { leaf a1 { type int8; } leaf a2 { type string { pattern 'x'; } } } leaf b { type string; } } anydata any; }"""
WRONG = [
    {"r": {"x": 9, "y": "abc", "w": 1.25, "f": "", "l": ["b", "a", "c"], "e": [{"k": 1, "v": 0}, {"k": 2, "v": 300, "in": {}, "odd": 1}], "a1": 300, "a2": "y", "any": {"p:s": {"n": 900}, "q": 1}}},
    {"r": {"x": 1, "w": 0.25, "l": [], "e": [{"k": 1, "v": 7}, {"k": 1, "v": "z"}], "a1": 1, "b": "z", "odd": [1]}, "more": None},
    {"r": {"x": 1, "y": "a", "l": "a"}}, {"r": 5}, {}, 7,
]


def test_rules_asked_for_are_those_of_all(spark):
    payload = parse_string('module p { namespace "urn:p"; prefix p; container s { leaf n { type int8; must ". > 1000"; } } }')
    m, options = module(MANY, "feature off;"), Options(features={"m": set()}, anydata={"p": payload})
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(WRONG)] + [(9, "{")], "doc_id bigint, doc string")
    shown = lambda found: sorted((r.doc_id, r.path, r.rule, r.message, r.expression or "", r.severity) for r in found.collect())
    every = shown(violations(docs, m, options))
    assert {v[2] for v in every} == set(RULES)
    for rule in RULES:
        assert shown(violations(docs, m, options, rules=[rule])) == [v for v in every if v[2] == rule]
    assert [v.rule for v in DocumentPlan(m, options, ["key", "unknown"]).check(WRONG[1])] == ["key", "unknown", "unknown"]
    with pytest.raises(ValueError):
        DocumentPlan(m, options, ["musts"])


@pytest.mark.parametrize("name", [n for n in document_catalog.QUERIES if n.startswith(("must_", "doc_"))])
def test_a_rule_costs_no_walk_over_all_members(name):
    """Calls that checking one order of seven lines makes; the walk over all members and rules made 443 to 1,293."""
    run = document_catalog.QUERIES[name]
    held = dict(zip(run.__code__.co_freevars, (c.cell_contents for c in run.__closure__), strict=True))
    plan = DocumentPlan(parse_string(held["text"]), held["options"], [held["rule"]])
    line = {"no": 1, "part": 3230, "supplier": 532, "qty": 45, "returned": "R", "status": "O"}
    order = {
        "key": 0, "status": "O", "total": 75462.67, "priority": "5-LOW", "customer": 3686, "size": 6, "wanted": 5, "bits": "a a", "raw": "aGk=", "flag": "TRUE",
        "mark": "x", "kind": "made:open", "place": "/order/none", "one": "x", "code": "5", "line": [line | {"no": i} for i in range(7)],
    }
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    plan.check({"order": order})
    sys.setprofile(count)
    try:
        plan.check({"order": order})
    finally:
        sys.setprofile(None)
    assert calls < 250


def test_quick_type_tests_say_nothing_of_their_own():
    kinds = ["string", "string { length '1..3'; }", "int8", "int32 { range '2..6'; }", "int32 { range '1..3 | 5..6'; }", "int64 { range '2.5..max'; }", "decimal64 { fraction-digits 2; }",
             "decimal64 { fraction-digits 1; range '0.1..5.5'; }", "number", "enumeration { enum a; enum 3; }", "small", "date", "unheard"]
    values = [True, False, 0, 1, 3, 6, 7, 300, 10**400, 0.1, 0.125, 5.5, 2.5, 1e20, 1.5e20, 1e-7, -0.0, float("nan"), float("inf"), "", "a", "3", "abcd", " a ", [], {}]
    for rfc in (False, True):
        for kind in kinds:
            m = module(f"leaf f {{ type {kind}{'' if kind.endswith('}') else ';'} }}", "typedef small { type int8 { range '0..4'; } }")
            checker, t = DocumentPlan(m, Options(rfc=rfc)).checker, m.root.find("f").type
            fine, said = checker.fine(t), [checker.messages(v, t, None) for v in values]
            assert not any(messages and fine and fine(v) for v, messages in zip(values, said, strict=True)), kind
            assert checker.restricts(t) or not any(said), kind

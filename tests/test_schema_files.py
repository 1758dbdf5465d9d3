"""JSON Schema round trips, the command line, sources and streams."""

import json

from treeline import sources
from treeline.cli import main
from treeline.plans.documents import Validator
from treeline.schema import json_schema
from treeline.schema.load import parse_string
from treeline.streaming import stream_violations, windowed_counts

TEXT = """module m { namespace "urn:m"; prefix m; organization o; description d;
  feature f; identity base-id; identity sub { base base-id; }
  typedef pct { type int8 { range 0..100; } default 5; } typedef short { type string { length 1..3; pattern '[a-z]+' { error-message low; } } }
  container c { presence p; must "a < 5" { error-message big; }
    leaf a { type pct; mandatory true; } leaf s { type short; default ab; } leaf b { type boolean; default true; }
    leaf u { type union { type int32; type enumeration { enum none; } } } leaf d { type decimal64 { fraction-digits 2; } }
    leaf k { type identityref { base base-id; } } leaf x { type bits { bit one; bit two { position 4; } } }
    leaf e { type empty; } leaf n { when "../b = true()"; if-feature f; type uint16 { range 1..9; } units s; }
    choice ch { mandatory true; case one { leaf o1 { type string; } leaf o2 { type string; } } case two { leaf t { type string; } } }
    leaf-list ll { type string { pattern 'q.*' { modifier invert-match; } } min-elements 1; max-elements 4; }
    list l { key i; leaf i { type int64; } leaf r { type leafref { path ../../l/i; } } }
    anydata any; leaf p { type instance-identifier { require-instance false; } } leaf raw { type binary { length 1..4; } } } }"""


def test_round_trip():
    m = parse_string(TEXT)
    out = json.loads(json.dumps(json_schema.emit(m)))
    again = json_schema.load(out)
    strip = lambda n: (n.kind, n.name, n.mandatory, n.default, n.key, n.min_elements, n.max_elements, n.presence, n.units, n.type and n.type.builtin().name, [x.expression for x in n.musts], [w.expression for w in n.whens], n.if_features, [strip(c) for c in n.children])
    assert strip(m.root) == strip(again.root)
    assert json_schema.emit(again) == out
    assert again.identities == m.identities and again.features == m.features


def test_round_trip_checks_alike():
    m = parse_string(TEXT)
    again = json_schema.load(json_schema.emit(m))
    good = {"c": {"a": 1, "o1": "x", "k": "m:sub", "x": "one", "u": "none", "l": [{"i": 1, "r": 1}], "ll": ["a"], "n": 3}}
    bad = [{"c": {}}, {"c": {"a": 7, "t": "x", "o1": "y"}}, {"c": {"a": 1, "t": "1", "s": "ABCD", "u": "z", "d": 0.125, "n": 10, "b": False, "ll": []}}, {"z": 1}]
    assert Validator(again).validate(good) == Validator(m).validate(good) == (True, [], [])
    for data in bad:
        assert Validator(again).validate(data) == Validator(m).validate(data)
        assert not Validator(m).validate(data)[0]


def test_several_choices_round_trip():
    m = parse_string('module m { namespace "urn:m"; prefix m; container c { leaf z { type string; } choice a { leaf x { type string; } leaf y { type string; } } choice b { leaf p { type string; } leaf q { type string; } } } }')
    again = json_schema.load(json_schema.emit(m))
    for data in ({"c": {"x": "1", "p": "2"}}, {"c": {"x": "1", "y": "2"}}, {"c": {"p": "1", "q": "2", "z": "3"}}):
        assert Validator(again).validate(data) == Validator(m).validate(data)


def test_command_line(tmp_path, capsys):
    (tmp_path / "m.yang").write_text('module m { namespace "urn:m"; prefix m; leaf a { type int8; } }')
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.yaml").write_text("a: 1000\n")
    assert main(["validate", str(tmp_path / "m.yang"), str(tmp_path / "good.json")]) == 0
    assert main(["validate", str(tmp_path / "m.yang"), str(tmp_path / "bad.yaml")]) == 1
    assert main(["convert", str(tmp_path / "m.yang"), "-o", str(tmp_path / "m.yang.json")]) == 0
    assert main(["validate", str(tmp_path / "m.yang.json"), str(tmp_path / "good.json")]) == 0
    assert main(["parse", str(tmp_path / "m.yang")]) == 0 and main(["parse", str(tmp_path / "none.yang")]) == 2
    out = capsys.readouterr().out
    assert "Valid." in out and "exceeds maximum 127" in out and "namespace: urn:m" in out


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"l": [{"i": 1}, {"i": 2}]}')
    (tmp_path / "b.yaml").write_text("x: 1\n")
    docs = sources.json_files(spark, str(tmp_path / "a.json"))
    assert [r.position for r in sources.entries(docs, "$.l").collect()] == [0, 1]
    assert sources.shredded(docs, {"i": "$.l[1].i bigint"}).first().i == 2
    assert json.loads(sources.yaml_files(spark, str(tmp_path / "b.yaml")).first().doc) == {"x": 1}
    assert sources.json_lines(spark, str(tmp_path / "a.json")).count() == 1
    assert sources.objects(spark, [(1, {"a": 1})]).first().doc == '{"a": 1}'
    rows = sources.rows_as_documents(spark.createDataFrame([(1, None)], "k int, v string"), "k", "r")
    assert json.loads(rows.first().doc) == {"r": {"k": 1}}


def test_stream(spark, tmp_path):
    m = parse_string('module m { namespace "urn:m"; prefix m; leaf a { type int8; } }')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"a": 1}\n{"a": 1000}\n{"b": 1}\n')
    stream = spark.readStream.text(str(tmp_path / "in")).selectExpr("value as doc_id", "value as doc")
    q = stream_violations(stream, m).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.rule for r in spark.table("found").collect()} == {"type", "unknown"}
    timed = spark.table("found").selectExpr("timestamp'2024-01-01 00:00:10' as at", "rule")
    assert windowed_counts(timed, "at").count() == 2


def test_imports_by_revision(tmp_path):
    from treeline.schema.load import Loader

    for revision, leaf in (("2020-01-01", "old"), ("2021-01-01", "new")):
        (tmp_path / f"a@{revision}.yang").write_text(f"module a {{ namespace 'urn:a'; prefix a; revision {revision}; grouping g {{ leaf {leaf} {{ type string; }} }} }}")
    loader = Loader([tmp_path])
    new, old, again = (loader.imported("a", r, None) for r in (None, "2020-01-01", None))
    assert [list(m.groupings) for m in (new, old)] == [["g"], ["g"]] and again is new
    assert [m.revisions[0][0] for m in (new, old)] == ["2021-01-01", "2020-01-01"]


def test_patterns_are_of_the_whole_value():
    import re

    from treeline.schema.json_schema import emit_type, load_type
    from treeline.schema.model import Pattern, TypeSpec

    for patterns in ([Pattern("a|b")], [Pattern("[a-z]+"), Pattern("x.*", True)], [Pattern("x", True)]):
        out, extra = emit_type(TypeSpec("string", patterns=patterns))
        tests = out.get("allOf") or [{"pattern": out["pattern"]}]
        for value in ("a", "ab", "b", "xy", "x"):
            want = all((re.fullmatch(p.text, value) is not None) != p.invert for p in patterns)
            got = all((re.search(t.get("not", t)["pattern"], value) is not None) != ("not" in t) for t in tests)
            assert got == want
        assert [(p.text, p.invert) for p in load_type(out, {}, {}).patterns] == [(p.text, p.invert) for p in patterns]


def test_modules_as_rows(spark):
    from treeline.cli import described
    from treeline.schema.load import parse_string

    row = described(spark, [parse_string("module m { namespace 'urn:m'; prefix m; feature f; leaf a { type string; } }")]).first()
    assert (row.module, row.features, row.nodes) == ("m", 1, 1)

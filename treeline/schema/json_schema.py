"""Modules as annotated JSON Schema and back.

Plain keywords carry what JSON Schema can say; the ``x-yang`` annotation carries the
rest, so that ``load(emit(module))`` gives the same expanded nodes. ``uses`` and
``augment`` are emitted expanded.
"""

from __future__ import annotations

import json
from pathlib import Path

from treeline.errors import SchemaError
from treeline.functions.intervals import single
from treeline.schema.load import _check
from treeline.schema.model import INTEGERS, Module, Must, Node, Pattern, TypeSpec, When

DIALECT = "https://json-schema.org/draft/2020-12/schema"
ANY = {"type": ["array", "boolean", "integer", "null", "number", "object", "string"]}


def _number(d):
    return None if d is None else int(d) if d == d.to_integral_value() else float(d)


def emit_type(t: TypeSpec) -> tuple[dict, dict]:
    """(JSON Schema keywords, x-yang entries) of a type."""
    out: dict = {}
    extra: dict = {}
    if t.base is not None or t.problem:
        out["$ref"] = f"#/$defs/{t.name.rpartition(':')[2]}"
        extra["typedef"] = t.name
    elif t.name in INTEGERS or t.name in ("integer", "decimal64", "number"):
        out["type"] = "integer" if t.name in INTEGERS or t.name == "integer" else "number"
        low, high = map(_number, single(t.range)[0]) if t.range else INTEGERS.get(t.name, (None, None))
        out |= {k: v for k, v in (("minimum", low), ("maximum", high)) if v is not None}
        if t.fraction_digits is not None:
            out |= {"multipleOf": 10**-t.fraction_digits, "x-fraction-digits": t.fraction_digits}
        extra["base"] = t.name
    elif t.name == "boolean":
        out["type"] = "boolean"
    elif t.name == "empty":
        out["type"] = ["object", "null"]
        extra["base"] = "empty"
    elif t.name == "enumeration":
        out |= {"type": "string", "enum": list(t.enums)}
    elif t.name == "union":
        out["oneOf"] = []
        for m in t.members:
            inner, more = emit_type(m)
            out["oneOf"].append(inner | ({"x-yang": more} if more else {}))
    else:
        out["type"] = "string"
        extra |= {"type": t.name} if t.name in ("leafref", "identityref", "instance-identifier", "bits") else {"base": t.name} if t.name != "string" else {}
        if t.length:
            low, high = map(_number, single(t.length)[0])
            out |= {k: v for k, v in (("minLength", low), ("maxLength", high)) if v is not None}
        # every pattern is of the whole value, and all of them hold
        tests = [{"not": {"pattern": _anchored(p.text)}} if p.invert else {"pattern": _anchored(p.text)} for p in t.patterns]
        if len(tests) == 1 and "pattern" in tests[0]:
            out |= tests[0]
        elif tests:
            out["allOf"] = tests
    if t.range:
        extra["range"] = t.range
    if t.length:
        extra["length"] = t.length
    if t.patterns:
        extra["string-patterns"] = [_pattern(p) for p in t.patterns]
    if t.path:
        extra |= {"path": t.path, "require-instance": t.require_instance}
    if t.name == "instance-identifier":
        extra["require-instance"] = t.require_instance
    if t.bases:
        extra |= {"base": t.bases[0]} if len(t.bases) == 1 else {"bases": list(t.bases)}
    if t.bits:
        extra["bits"] = [{"name": b, "position": p} for b, p in t.bits.items()]
    return out, extra


def _anchored(text: str) -> str:
    if text.startswith("^") and text.endswith("$"):
        return text
    return f"^(?:{text})$" if "|" in text else f"^{text}$"


def _plain(text: str) -> str:
    """An anchored pattern as the schema language has it."""
    inner = text.removeprefix("^").removesuffix("$")
    return inner[3:-1] if inner.startswith("(?:") and inner.endswith(")") and _anchored(inner[3:-1]) == text else inner


def _pattern(p: Pattern) -> dict:
    entry: dict = {"pattern": p.text}
    if p.invert:
        entry["invert-match"] = True
    if p.message:
        entry["error-message"] = p.message
    if p.app_tag:
        entry["error-app-tag"] = p.app_tag
    return entry


def load_type(out: dict, extra: dict, typedefs: dict[str, TypeSpec]) -> TypeSpec:
    """The type that keywords and annotation stand for."""
    if "$ref" in out:
        name = extra.get("typedef") or out["$ref"].rpartition("/")[2]
        return TypeSpec(name, range=extra.get("range"), length=extra.get("length"), patterns=_patterns(extra), base=typedefs.get(name.rpartition(":")[2]))
    if "oneOf" in out:
        return TypeSpec("union", members=[load_type(m, m.get("x-yang", {}), typedefs) for m in out["oneOf"]])
    kind = out.get("type")
    t = TypeSpec("string", extra.get("range"), extra.get("length"), _patterns(extra))
    if extra.get("type") in ("leafref", "identityref", "instance-identifier", "bits"):
        t.name = extra["type"]
        t.path, t.require_instance = extra.get("path"), extra.get("require-instance", True)
        t.bases = extra.get("bases") or ([extra["base"]] if "base" in extra else [])
        t.bits = {b["name"]: b["position"] for b in extra.get("bits", [])}
    elif "enum" in out:
        t.name, t.enums = "enumeration", list(out["enum"])
    elif kind == "boolean":
        t.name = "boolean"
    elif kind in ("integer", "number"):
        t.name = extra.get("base") or _integer_name(out) or ("integer" if kind == "integer" else "decimal64")
        t.fraction_digits = out.get("x-fraction-digits")
        if not t.range and INTEGERS.get(t.name) != (out.get("minimum"), out.get("maximum")) and ("minimum" in out or "maximum" in out):
            t.range = f"{out.get('minimum', 'min')}..{out.get('maximum', 'max')}"
    else:
        t.name = extra.get("base", "string")
        if not t.length and ("minLength" in out or "maxLength" in out):
            t.length = f"{out.get('minLength', 'min')}..{out.get('maxLength', 'max')}"
        if not t.patterns and "pattern" in out:
            t.patterns = [Pattern(_plain(out["pattern"]))]
        if not t.patterns:
            for test in out.get("allOf", []):
                inner = test.get("not", test)
                if "pattern" in inner:
                    t.patterns.append(Pattern(_plain(inner["pattern"]), "not" in test))
    return t


def _patterns(extra: dict) -> list[Pattern]:
    return [Pattern(p["pattern"], p.get("invert-match", False), p.get("error-message"), p.get("error-app-tag")) for p in extra.get("string-patterns", [])]


def _integer_name(out: dict) -> str | None:
    """The built-in type whose bounds these are."""
    return next((n for n, b in INTEGERS.items() if b == (out.get("minimum"), out.get("maximum"))), None)


def _note(n: Node) -> dict:
    """The annotation all nodes share."""
    note: dict = {}
    if n.musts:
        note["must"] = [{"must": m.expression} | ({"error-message": m.message} if m.message else {}) for m in n.musts]
    if n.whens:
        note["when"] = [{"condition": w.expression} | ({"context": "parent"} if w.on_parent else {}) for w in n.whens]
    if n.if_features:
        note["if-features"] = list(n.if_features)
    for key, value in (("mandatory", n.mandatory or None), ("config", n.config), ("presence", n.presence), ("key", n.key), ("units", n.units), ("defined-in", n.module)):
        if value is not None:
            note[key] = value
    return note


def emit_node(n: Node) -> dict:
    out: dict = {"description": n.description or ""}
    note = _note(n)
    if n.kind in ("leaf", "leaf-list"):
        kind, extra = emit_type(n.type)
        inner = kind | {"x-yang": {"type": n.kind} | extra}
        if n.kind == "leaf":
            out |= inner
            if n.default is not None:
                out["default"] = n.default
        else:
            out |= {"type": "array", "items": inner}
            if n.defaults:
                out["default"] = list(n.defaults)
            note = {"type": "leaf-list"} | note
    elif n.kind == "list":
        out |= {"type": "array", "items": _object(n)}
        note = {"type": "list"} | note
    elif n.kind in ("anydata", "anyxml"):
        out |= ANY
        note = {"type": n.kind} | note
    else:
        out |= _object(n)
        note = {"type": n.kind} | note
    if n.min_elements is not None:
        out["minItems"] = n.min_elements
    if n.max_elements is not None:
        out["maxItems"] = n.max_elements
    out["x-yang"] = out.get("x-yang", {}) | note
    return out


def _object(n: Node) -> dict:
    """Properties of the children; choices are named in ``x-yang`` of branches under ``oneOf`` or ``allOf``."""
    plain = [c for c in n.children if c.kind != "choice"]
    choices = [c for c in n.children if c.kind == "choice"]
    out: dict = {"type": "object", "properties": {c.name: emit_node(c) for c in plain}, "additionalProperties": False}
    required = [c.name for c in plain if c.mandatory or c.name in n.keys]
    if required:
        out["required"] = required
    if choices:
        out["x-order"] = [c.name for c in n.children]
        bodies = [_choice(c) for c in choices]
        out |= bodies[0] if len(bodies) == 1 else {"allOf": bodies}
    return out


def _choice(c: Node) -> dict:
    branches = [
        _object(case) | {"description": case.description or "", "x-yang": {"name": case.name} | _note(case), "required": [x.name for x in case.children if x.kind != "choice"]}
        for case in c.children
    ]
    none = [] if c.mandatory else [{"type": "object", "maxProperties": 0}]
    return {"oneOf": none + branches, "x-choice": {"name": c.name, "description": c.description or ""} | _note(c)}


def _load_note(n: Node, note: dict) -> Node:
    n.musts = [Must(m["must"], m.get("error-message")) for m in note.get("must", [])]
    when = note.get("when", [])
    when = [when] if isinstance(when, (dict, str)) else when
    n.whens = [When(w if isinstance(w, str) else w["condition"], not isinstance(w, str) and w.get("context") == "parent") for w in when]
    n.if_features = list(note.get("if-features", []))
    n.mandatory = bool(note.get("mandatory"))
    n.config, n.presence, n.key, n.units, n.module = (note.get(k) for k in ("config", "presence", "key", "units", "defined-in"))
    return n


def load_node(name: str, out: dict, typedefs: dict[str, TypeSpec]) -> Node:
    note = out.get("x-yang", {})
    kind = note.get("type", "")
    n = Node("", name, description=out.get("description") or None)
    if kind in ("container", "list", "anydata", "anyxml", "notification", "rpc", "input", "output"):
        n.kind = kind
    elif kind == "leaf-list" or out.get("type") == "array" and "properties" not in out.get("items", {}):
        n.kind = "leaf-list"
    else:
        n.kind = {"object": "container", "array": "list"}.get(out.get("type"), "leaf") if "properties" in out or out.get("type") == "array" else "leaf"
    _load_note(n, note)
    if n.kind == "leaf":
        n.type = load_type(out, note, typedefs)
        n.default = out.get("default")
        if isinstance(n.default, bool):
            n.default = str(n.default).lower()
        elif n.default is not None:
            n.default = str(n.default)
    elif n.kind == "leaf-list":
        n.type = load_type(out["items"], out["items"].get("x-yang", {}), typedefs)
        n.defaults = list(out.get("default", []))
    elif n.kind in ("container", "list", "notification", "rpc", "input", "output"):
        n.children = _children(out["items"] if n.kind == "list" else out, typedefs)
    n.min_elements, n.max_elements = out.get("minItems"), out.get("maxItems")
    return n


def _children(out: dict, typedefs: dict[str, TypeSpec]) -> list[Node]:
    found = [load_node(k, v, typedefs) for k, v in out.get("properties", {}).items()]
    for body in out.get("allOf", [out] if "oneOf" in out else []):
        about = body.get("x-choice", {"name": "choice"})
        choice = _load_note(Node("choice", about["name"], description=about.get("description") or None), about)
        branches = [b for b in body["oneOf"] if "properties" in b]
        choice.mandatory = len(branches) == len(body["oneOf"])
        for b in branches:
            case = _load_note(Node("case", b.get("x-yang", {}).get("name", "case"), description=b.get("description") or None), b.get("x-yang", {}))
            case.children = _children(b, typedefs)
            choice.children.append(case)
        found.append(choice)
    order = {name: i for i, name in enumerate(out.get("x-order", []))}
    return sorted(found, key=lambda n: order.get(n.name, len(order)))


def emit(module: Module) -> dict:
    """The module as a JSON Schema document."""
    note = {
        "module": module.name, "yang-version": module.version or "1.1", "namespace": module.namespace, "prefix": module.prefix,
        "organization": module.organization, "contact": module.contact,
    }
    out = {"$schema": DIALECT, "$id": module.namespace or module.name, "description": module.description or ""}
    out["x-yang"] = {k: v for k, v in note.items() if v is not None}
    if module.identities:
        out["x-yang"]["identities"] = {k: list(v) for k, v in sorted(module.identities.items())}
    if module.features:
        out["x-yang"]["features"] = {k: list(v) for k, v in module.features.items()}
    out |= _object(module.root)
    defs = {}
    for name, t in sorted(module.typedefs.items()):
        kind, extra = emit_type(t)
        defs[name] = kind | ({"x-yang": extra} if extra else {})
    if defs:
        out["$defs"] = defs
    return out


def load(source: dict | str | Path) -> Module:
    """A module from a JSON Schema document, its text, or a file."""
    if isinstance(source, Path) or isinstance(source, str) and not source.lstrip().startswith("{"):
        source = Path(source).read_text(encoding="utf-8")
    out = json.loads(source) if isinstance(source, str) else source
    note = out.get("x-yang") or {}
    if "module" not in note:
        raise SchemaError("the document names no module in x-yang")
    m = Module(
        note["module"], note.get("namespace"), note.get("prefix"), note.get("yang-version"),
        note.get("organization"), note.get("contact"), out.get("description") or None,
    )
    m.identities = {k: list(v) for k, v in note.get("identities", {}).items()}
    m.features = {k: list(v) for k, v in note.get("features", {}).items()}
    todo = dict(out.get("$defs", {}))
    while todo:  # typedefs that refer to others come after them
        ready = [k for k, v in todo.items() if "$ref" not in v or v["$ref"].rpartition("/")[2] not in todo] or list(todo)
        for k in ready:
            v = todo.pop(k)
            m.typedefs[k] = load_type(v, v.get("x-yang", {}), m.typedefs)
    m.root.children = _children(out, m.typedefs)
    _check(m.root)
    return m


def write(module: Module, path: str | Path, indent: int = 2) -> None:
    Path(path).write_text(json.dumps(emit(module), indent=indent) + "\n", encoding="utf-8")

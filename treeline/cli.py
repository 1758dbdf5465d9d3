"""Command line: ``parse``, ``validate`` and ``convert``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from treeline.errors import SchemaError
from treeline.plans.documents import Validator
from treeline.schema import json_schema
from treeline.schema.load import parse_file
from treeline.schema.model import Module


def load_module(path: str, include: list[str]) -> Module:
    return json_schema.load(Path(path)) if path.endswith(".json") else parse_file(path, tuple(include))


def describe(module: Module) -> dict:
    """One row about a module."""
    return {
        "module": module.name, "version": module.version, "namespace": module.namespace, "prefix": module.prefix,
        "typedefs": len(module.typedefs), "identities": len(module.identities), "features": len(module.features),
        "groupings": len(module.groupings), "nodes": len(module.root.children),
    }


def described(spark, modules: list[Module]):
    """A DataFrame of one row for each module."""
    numbers = ("typedefs", "identities", "features", "groupings", "nodes")
    schema = ", ".join(["module string", "version string", "namespace string", "prefix string", *(f"{n} int" for n in numbers)])
    return spark.createDataFrame([tuple(describe(m).values()) for m in modules], schema)


def load_data(path: str | None):
    text = Path(path).read_text(encoding="utf-8") if path else sys.stdin.read()
    if path and path.endswith((".yaml", ".yml")):
        import yaml

        return json.loads(json.dumps(yaml.safe_load(text), default=str))
    return json.loads(text)


def anydata_modules(paths: list[str], include: list[str]) -> dict[str, Module]:
    """Modules by name from files and folders; files of a folder that do not load are skipped with a warning."""
    found = {}
    for p in paths:
        files = sorted(Path(p).glob("*.yang")) if Path(p).is_dir() else [Path(p)]
        for f in files:
            try:
                m = parse_file(f, (*include, f.parent))
                found[m.name] = m
            except SchemaError as e:
                if len(files) == 1:
                    raise
                print(f"warning: {f}: {e}", file=sys.stderr)
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeline")
    parser.add_argument("--include", action="append", default=[], help="folder to look for imports in")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("parse", help="load a module and say what it holds")
    p.add_argument("module")
    v = commands.add_parser("validate", help="check one JSON or YAML document")
    v.add_argument("module")
    v.add_argument("data", nargs="?")
    v.add_argument("--anydata-module", action="append", default=None)
    v.add_argument("--anydata-candidate", action="store_true")
    v.add_argument("--feature", action="append", default=None, help="module:feature; others of that module are off")
    c = commands.add_parser("convert", help="write a module as JSON Schema")
    c.add_argument("module")
    c.add_argument("-o", "--output")
    args = parser.parse_args(argv)
    try:
        module = load_module(args.module, args.include)
        if args.command == "parse":
            print("\n".join(f"{k}: {x}" for k, x in describe(module).items()))
        elif args.command == "convert":
            text = json.dumps(json_schema.emit(module), indent=2)
            Path(args.output).write_text(text + "\n") if args.output else print(text)
        else:
            features: dict[str, set[str]] | None = None
            for f in args.feature or []:
                features = features or {}
                name, _, feature = f.partition(":")
                features.setdefault(name, set()).add(feature)
            anydata = anydata_modules(args.anydata_module, args.include) if args.anydata_module else None
            checked = Validator(module, features=features, anydata=anydata, anydata_candidate=args.anydata_candidate)
            valid, errors, warnings = checked.validate(load_data(args.data))
            print("Valid." if valid else "Validation failed:")
            for line in errors:
                print(f"  {line}")
            for line in warnings:
                print(f"  warning: {line}")
            return 0 if valid else 1
    except (SchemaError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

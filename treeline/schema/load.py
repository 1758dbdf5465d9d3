"""From module text to an expanded module: imports, includes, uses, refine and augment."""

from __future__ import annotations

from pathlib import Path

from treeline.errors import CircularUsesError, RefineTargetError, SchemaError
from treeline.schema.extensions import REGISTRY
from treeline.schema.model import Module, Must, Node, Pattern, TypeSpec, When
from treeline.schema.statements import Statement, parse
from treeline.xpath.parser import parse as parse_xpath

DATA = ("container", "list", "leaf", "leaf-list", "choice", "anydata", "anyxml", "uses", "notification", "rpc")
BUILTIN = frozenset(
    """binary bits boolean decimal64 empty enumeration identityref instance-identifier int8 int16 int32 int64
    leafref string uint8 uint16 uint32 uint64 union integer number""".split()
)


def _flag(stmt: Statement, keyword: str) -> bool | None:
    value = stmt.value(keyword)
    if value is not None and value not in ("true", "false"):
        raise SchemaError(f"{keyword} must be true or false, not {value!r} (line {stmt.line})")
    return None if value is None else value == "true"


def _number(stmt: Statement, keyword: str) -> int | None:
    value = stmt.value(keyword)
    if value is None or value == "unbounded":
        return None
    if not value.isdigit():
        raise SchemaError(f"{keyword} must be a number, not {value!r} (line {stmt.line})")
    return int(value)


class Loader:
    """Loads modules and what they import from the folder of a file and an include path; each module once."""

    def __init__(self, include_path: tuple[str | Path, ...] = ()):
        self.include_path = [Path(p) for p in include_path]
        self.loaded: dict[str, Module] = {}

    def file(self, path: str | Path) -> Module:
        path = Path(path)
        return self.text(path.read_text(encoding="utf-8"), str(path), path.parent)

    def text(self, text: str, source: str | None = None, folder: Path | None = None) -> Module:
        stmt = parse(text, source)
        if stmt.keyword == "submodule":
            raise SchemaError(f"{stmt.arg} is a submodule; load the module it belongs to")
        return _Builder(self, stmt, folder).module

    def find(self, name: str, revision: str | None, folder: Path | None) -> tuple[str, Path]:
        for d in [*([folder] if folder else []), *self.include_path]:
            exact = [d / f"{name}@{revision}.yang"] if revision else []
            for p in [*exact, d / f"{name}.yang", *sorted(d.glob(f"{name}@*.yang"), reverse=True)]:
                if p.exists():
                    return p.read_text(encoding="utf-8"), p
        raise SchemaError(f"module {name!r} was not found")

    def imported(self, name: str, revision: str | None, folder: Path | None) -> Module:
        """A module by name, and by revision if one is asked for: what another import got may be a later one."""
        known = self.loaded.get(name)
        if known is not None and (revision is None or not known.revisions or revision in (r for r, _ in known.revisions)):
            return known
        text, path = self.find(name, revision, folder)
        found = self.text(text, str(path), path.parent)
        if known is not None:
            self.loaded[name] = known  # imports without a revision stay as they were
        return found


class _Builder:
    def __init__(self, loader: Loader, stmt: Statement, folder: Path | None):
        self.loader, self.folder = loader, folder
        m = self.module = Module(
            stmt.arg, stmt.value("namespace"), stmt.value("prefix"), stmt.value("yang-version"),
            stmt.value("organization"), stmt.value("contact"), stmt.value("description"),
        )
        loader.loaded[m.name] = m
        m.raw_typedefs, m.raw_groupings, m.builder = {}, {}, self  # type: ignore[attr-defined]
        body = self._with_submodules(stmt)
        for s in body:
            if s.keyword == "import":
                other = loader.imported(s.arg, s.value("revision-date"), folder)
                if s.value("prefix"):
                    m.imports[s.value("prefix")] = other
        for s in body:
            match s.keyword:
                case "typedef":
                    self._once(m.raw_typedefs, s.arg, s)
                case "grouping":
                    self._once(m.raw_groupings, s.arg, s)
                case "identity":
                    self._once(m.identities, s.arg, [b.arg for b in s.all("base")])
                case "feature":
                    self._once(m.features, s.arg, [f.arg for f in s.all("if-feature")])
                case "extension":
                    a = s.one("argument")
                    self._once(m.extensions, s.arg, a.arg if a else None)
                case "revision":
                    m.revisions.append((s.arg, s.value("description")))
                case "deviation" | "action":
                    m.warnings.append(f"{s.keyword} {s.arg!r} is not supported and was skipped")
        self._collect_inner(body)
        for name, s in m.raw_typedefs.items():
            m.typedefs[name] = self.type(s.one("type"), (name,))
            m.typedefs[name].default = s.value("default")
        m.groupings = m.raw_groupings
        for s in body:
            m.root.children += self.data(s, m, ())
        for s in body:
            if s.keyword == "augment":
                self.augment(s)
            elif ":" in s.keyword:
                self._extension(s)
        _check(m.root)

    @staticmethod
    def _once(into: dict, name: str, value) -> None:
        if name in into:
            raise SchemaError(f"{name!r} is defined twice")
        into[name] = value

    def _with_submodules(self, stmt: Statement, seen: set[str] | None = None) -> list[Statement]:
        seen = seen if seen is not None else set()
        body = []
        for s in stmt.subs:
            if s.keyword == "include":
                if s.arg not in seen:
                    seen.add(s.arg)
                    text, path = self.loader.find(s.arg, s.value("revision-date"), self.folder)
                    sub = parse(text, str(path))
                    if sub.keyword != "submodule" or sub.value("belongs-to") != self.module.name:
                        raise SchemaError(f"{s.arg!r} is not a submodule of {self.module.name!r}")
                    body += self._with_submodules(sub, seen)
            elif stmt.keyword != "submodule" or s.keyword not in ("yang-version", "belongs-to"):
                body.append(s)
        return body

    def _collect_inner(self, body: list[Statement]) -> None:
        """Typedefs and groupings inside other statements share the module's namespace."""
        for s in body:
            for inner in s.subs:
                if inner.keyword == "typedef":
                    self.module.raw_typedefs.setdefault(inner.arg, inner)
                elif inner.keyword == "grouping":
                    self.module.raw_groupings.setdefault(inner.arg, inner)
            self._collect_inner(s.subs)

    # types -------------------------------------------------------------

    def type(self, stmt: Statement | None, seen: tuple[str, ...] = ()) -> TypeSpec:
        if stmt is None:
            raise SchemaError("a leaf, leaf-list or typedef needs a type")
        t = TypeSpec(stmt.arg, stmt.value("range"), stmt.value("length"))
        for p in stmt.all("pattern"):
            t.patterns.append(Pattern(p.arg, p.value("modifier") == "invert-match", p.value("error-message"), p.value("error-app-tag")))
        t.enums = [e.arg for e in stmt.all("enum")]
        position = 0
        for b in stmt.all("bit"):
            position = _number(b, "position") if b.one("position") else position
            if b.arg in t.bits or position in t.bits.values():
                raise SchemaError(f"bit {b.arg!r} or its position is used twice")
            t.bits[b.arg] = position
            position += 1
        t.path = stmt.value("path")
        t.require_instance = _flag(stmt, "require-instance") is not False
        t.bases = [b.arg for b in stmt.all("base")]
        t.fraction_digits = _number(stmt, "fraction-digits")
        t.members = [self.type(s, seen) for s in stmt.all("type")]
        if t.path:
            parse_xpath(t.path)
        if t.name == "enumeration" and not t.enums:
            raise SchemaError("an enumeration needs at least one enum")
        if t.name not in BUILTIN:
            self._resolve(t, seen)
        return t

    def _resolve(self, t: TypeSpec, seen: tuple[str, ...]) -> None:
        prefix, _, name = t.name.rpartition(":")
        owner = self.module.by_prefix(prefix or None)
        if owner is None:
            t.problem = f"unknown type prefix {prefix!r} in type {name!r}"
        elif owner is not self.module:
            t.base = owner.typedefs.get(name)
            if t.base is None:
                t.problem = f"unknown typedef {name!r} in imported module {prefix!r}"
        elif name in owner.raw_typedefs:
            if name in seen:
                raise SchemaError(f"typedef {name!r} is defined by itself")
            t.base = owner.typedefs.get(name) or self.type(owner.raw_typedefs[name].one("type"), (*seen, name))
            if t.default is None:
                t.default = owner.raw_typedefs[name].value("default")

    # data nodes ----------------------------------------------------------

    def data(self, s: Statement, scope: Module, using: tuple[str, ...]) -> list[Node]:
        """The nodes a statement stands for: none, one, or what a uses brings in."""
        if s.keyword == "uses":
            return self._uses(s, scope, using)
        if s.keyword not in DATA and s.keyword not in ("case", "input", "output"):
            return []
        n = Node(s.keyword, s.arg or s.keyword, description=s.value("description"), units=s.value("units"))
        n.mandatory = bool(_flag(s, "mandatory"))
        n.config = _flag(s, "config")
        n.presence, n.key = s.value("presence"), s.value("key")
        n.min_elements, n.max_elements = _number(s, "min-elements"), _number(s, "max-elements")
        n.if_features = [f.arg for f in s.all("if-feature")]
        self._conditions(n, s)
        if s.keyword in ("leaf", "leaf-list"):
            n.type = scope.builder.type(s.one("type"))
            given = [d.arg for d in s.all("default")]
            if s.keyword == "leaf-list":
                n.defaults = given
            else:
                n.default = given[0] if given else n.type.default
        for inner in s.subs:
            made = self.data(inner, scope, using)
            if s.keyword == "choice" and inner.keyword != "case":
                made = [Node("case", x.name, [x], if_features=list(x.if_features)) for x in made]
            n.children += made
        if s.keyword == "choice":
            names = [c.name for case in n.children for c in case.children if c.kind != "choice"]
            twice = {x for x in names if names.count(x) > 1}
            if twice:
                raise SchemaError(f"cases of choice {n.name!r} share {', '.join(sorted(twice))}")
        return [n]

    @staticmethod
    def _conditions(n: Node, s: Statement, on_parent: bool = False) -> None:
        for m in s.all("must"):
            parse_xpath(m.arg)
            n.musts.append(Must(m.arg, m.value("error-message"), m.value("error-app-tag")))
        for w in s.all("when"):
            parse_xpath(w.arg)
            n.whens.append(When(w.arg, on_parent))

    def _uses(self, s: Statement, scope: Module, using: tuple[str, ...]) -> list[Node]:
        prefix, _, name = s.arg.rpartition(":")
        owner = scope.by_prefix(prefix or None)
        grouping = owner and owner.raw_groupings.get(name)
        if not grouping:
            raise SchemaError(f"unknown grouping {s.arg!r} (line {s.line})")
        if (owner.name, name) in using:
            raise CircularUsesError(f"grouping {name!r} uses itself: {' -> '.join([*(u[1] for u in using), name])}")
        nodes = [n for inner in grouping.subs for n in self.data(inner, owner, (*using, (owner.name, name)))]
        for r in s.all("refine"):
            self._refine(nodes, r, name)
        for a in s.all("augment"):
            target = _by_path(nodes, a.arg)
            if target is None:
                raise SchemaError(f"augment target {a.arg!r} is not in grouping {name!r}")
            target.children += self._added(a, scope, target, using)
        features = [f.arg for f in s.all("if-feature")]
        for n in nodes:
            n.if_features = features + n.if_features
            for w in s.all("when"):
                parse_xpath(w.arg)
                n.whens.insert(0, When(w.arg, True))
        return nodes

    def _added(self, a: Statement, scope: Module, target: Node, using: tuple[str, ...]) -> list[Node]:
        made = [n for inner in a.subs for n in ([self._case(inner, scope, using)] if inner.keyword == "case" else self.data(inner, scope, using))]
        if target.kind == "choice":
            made = [n if n.kind == "case" else Node("case", n.name, [n]) for n in made]
        features = [f.arg for f in a.all("if-feature")]
        for n in made:
            n.if_features = features + n.if_features
            for w in a.all("when"):
                parse_xpath(w.arg)
                n.whens.insert(0, When(w.arg, True))
        return made

    def _case(self, s: Statement, scope: Module, using: tuple[str, ...]) -> Node:
        return self.data(s, scope, using)[0]

    def _refine(self, nodes: list[Node], r: Statement, grouping: str) -> None:
        n = _by_path(nodes, r.arg) or _by_suffix(nodes, r.arg)
        if n is None:
            raise RefineTargetError(f"refine target {r.arg!r} was not found in grouping {grouping!r}")
        if r.one("type") and n.kind in ("leaf", "leaf-list"):
            n.type = self.type(r.one("type"))
        if r.one("mandatory"):
            n.mandatory = bool(_flag(r, "mandatory"))
        if r.one("config"):
            n.config = _flag(r, "config")
        if r.one("default"):
            if n.kind == "leaf-list":
                n.defaults = [d.arg for d in r.all("default")]
            else:
                n.default = r.value("default")
        if r.one("min-elements"):
            n.min_elements = _number(r, "min-elements")
        if r.one("max-elements"):
            n.max_elements = _number(r, "max-elements")
        if r.one("presence"):
            n.presence = r.value("presence")
        if r.one("description"):
            n.description = r.value("description")
        n.if_features = n.if_features + [f.arg for f in r.all("if-feature")]
        self._conditions(n, r)

    def augment(self, a: Statement) -> None:
        """Merge an augment into the module its path starts in; added nodes know their module."""
        first = a.arg.strip("/").split("/")[0]
        prefix = first.partition(":")[0] if ":" in first else None
        owner = self.module.by_prefix(prefix)
        target = owner and _by_path(owner.root.children, a.arg)
        if target is None:
            raise SchemaError(f"augment target {a.arg!r} was not found")
        added = self._added(a, self.module, target, ())
        if owner is not self.module:
            for n in added:
                _stamp(n, self.module.name)
        target.children += added

    def _extension(self, s: Statement) -> None:
        """A use of an extension: what is registered for it, or a warning if its module does not define it."""
        prefix, _, name = s.keyword.partition(":")
        owner = self.module.by_prefix(prefix)
        callback = owner and REGISTRY.get((owner.name, name))
        if callback:
            callback(self, s)
        elif owner is None or name not in owner.extensions:
            self.module.warnings.append(f"unknown extension {s.keyword!r}")

    def add_structure(self, s: Statement) -> None:
        n = Node("container", s.arg, description=s.value("description"), presence="structure")
        self._conditions(n, s)
        n.children = [c for inner in s.subs for c in self.data(inner, self.module, ())]
        self.module.root.children.append(n)


def _stamp(n: Node, module: str) -> None:
    n.module = module
    for c in n.children:
        _stamp(c, module)


def _by_path(nodes: list[Node], path: str) -> Node | None:
    """The node at a schema path (prefixes dropped; choices and cases may be named or skipped)."""
    steps = [p.rpartition(":")[2] for p in path.strip("/").split("/")]
    found: Node | None = None
    for step in steps:
        found = next((n for n in nodes if n.name == step), None)
        if found is None:
            inner = [c for n in nodes if n.kind in ("choice", "case") for c in n.children]
            found = _by_path(inner, step) if inner else None
        if found is None:
            return None
        nodes = found.children
    return found


def _by_suffix(nodes: list[Node], path: str) -> Node | None:
    """The first node, in document order, below which the path can be followed."""
    for n in nodes:
        found = _by_path(n.children, path) or _by_suffix(n.children, path)
        if found:
            return found
    return None


def _check(n: Node) -> None:
    """A list's keys are leaves of it that always apply."""
    for c in n.children:
        if c.kind == "list" and c.key:
            for k in c.keys:
                leaf = c.find(k.rpartition(":")[2])
                if leaf is None or leaf.kind != "leaf":
                    raise SchemaError(f"key {k!r} of list {c.name!r} is not a leaf of it")
                if leaf.whens or leaf.if_features:
                    raise SchemaError(f"key {k!r} of list {c.name!r} must not have when or if-feature")
        _check(c)


def parse_file(path: str | Path, include_path: tuple[str | Path, ...] = ()) -> Module:
    """Load a module file; imports are looked for beside it and on the include path."""
    return Loader(include_path).file(path)


def parse_string(text: str, source: str | None = None, include_path: tuple[str | Path, ...] = ()) -> Module:
    return Loader(include_path).text(text, source)

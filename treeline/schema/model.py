"""The expanded schema: what the checks are compiled from."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Bounds of the built-in integer types (fixed values).
INTEGERS = {f"{sign}int{bits}": (-(1 << bits - 1) if not sign else 0, (1 << bits - (not sign)) - 1) for sign in ("", "u") for bits in (8, 16, 32, 64)}


@dataclass
class Pattern:
    text: str
    invert: bool = False
    message: str | None = None
    app_tag: str | None = None


@dataclass
class TypeSpec:
    """A type with its restrictions; ``base`` is the resolved typedef's type."""

    name: str
    range: str | None = None
    length: str | None = None
    patterns: list[Pattern] = field(default_factory=list)
    enums: list[str] = field(default_factory=list)
    bits: dict[str, int] = field(default_factory=dict)
    path: str | None = None
    require_instance: bool = True
    bases: list[str] = field(default_factory=list)
    fraction_digits: int | None = None
    members: list[TypeSpec] = field(default_factory=list)
    base: TypeSpec | None = None
    problem: str | None = None
    default: str | None = None

    def builtin(self) -> TypeSpec:
        t = self
        while t.base:
            t = t.base
        return t


@dataclass
class Must:
    expression: str
    message: str | None = None
    app_tag: str | None = None


@dataclass
class When:
    expression: str
    on_parent: bool = False


@dataclass
class Node:
    """A schema node after expansion."""

    kind: str
    name: str
    children: list[Node] = field(default_factory=list)
    type: TypeSpec | None = None
    mandatory: bool = False
    default: str | None = None
    defaults: list[str] = field(default_factory=list)
    presence: str | None = None
    key: str | None = None
    min_elements: int | None = None
    max_elements: int | None = None
    musts: list[Must] = field(default_factory=list)
    whens: list[When] = field(default_factory=list)
    if_features: list[str] = field(default_factory=list)
    config: bool | None = None
    description: str | None = None
    units: str | None = None
    #: The module that defines the node, if it is not the module it stands in.
    module: str | None = None

    def find(self, name: str) -> Node | None:
        """The child with a name; cases and choices are looked through."""
        for c in self.children:
            if c.kind in ("choice", "case"):
                found = c.find(name)
                if found:
                    return found
            elif c.name == name:
                return c
        return None

    @property
    def keys(self) -> list[str]:
        return self.key.split() if self.key else []


@dataclass
class Module:
    """A module: its expanded top nodes and what is looked up by name."""

    name: str
    namespace: str | None = None
    prefix: str | None = None
    version: str | None = None
    organization: str | None = None
    contact: str | None = None
    description: str | None = None
    revisions: list[tuple[str, str | None]] = field(default_factory=list)
    root: Node = field(default_factory=lambda: Node("module", ""))
    typedefs: dict[str, TypeSpec] = field(default_factory=dict)
    identities: dict[str, list[str]] = field(default_factory=dict)
    features: dict[str, list[str]] = field(default_factory=dict)
    extensions: dict[str, str | None] = field(default_factory=dict)
    groupings: dict[str, object] = field(default_factory=dict)
    imports: dict[str, Module] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def by_prefix(self, prefix: str | None) -> Module | None:
        """The module a prefix stands for here."""
        return self if prefix in (None, "", self.prefix) else self.imports.get(prefix)

    def closure(self) -> dict[str, Module]:
        """This module and all it imports, by name."""
        found, todo = {}, [self]
        while todo:
            m = todo.pop()
            if m.name not in found:
                found[m.name] = m
                todo += m.imports.values()
        return found

"""Identity hierarchies as a closure computed once per schema."""

from __future__ import annotations

from treeline.schema.model import Module

Name = tuple[str, str]


def qualified(module: Module, name: str) -> Name | None:
    """(module, identity) of a [prefix:]name in a module's scope."""
    prefix, _, local = name.rpartition(":")
    owner = module.by_prefix(prefix or None)
    return (owner.name, local) if owner and local in owner.identities else None


def closure(module: Module) -> dict[Name, frozenset[Name]]:
    """For each identity of the module and its imports all strict ancestors."""
    bases = {
        (m.name, i): [q for b in named if (q := qualified(m, b))]
        for m in module.closure().values()
        for i, named in m.identities.items()
    }
    found: dict[Name, frozenset[Name]] = {}
    for identity in bases:
        seen: set[Name] = set()
        todo = list(bases[identity])
        while todo:
            base = todo.pop()
            if base not in seen:
                seen.add(base)
                todo += bases.get(base, [])
        found[identity] = frozenset(seen)
    return found


class Identities:
    """Look-ups of identity values as they are written in a module's documents."""

    def __init__(self, module: Module):
        self.module = module
        self.ancestors = closure(module)

    def value(self, text: str) -> Name | None:
        """A value must be written ``prefix:name``."""
        return qualified(self.module, text) if ":" in text else None

    def derived(self, value: str, target: str, or_self: bool = False) -> bool:
        v, t = self.value(value), qualified(self.module, target) if ":" in target else None
        return bool(v and t) and (t in self.ancestors[v] or or_self and v == t)

    def valid(self, value: str, bases: list[str]) -> bool:
        """Derived from every base."""
        v = self.value(value)
        return v is not None and all((q := qualified(self.module, b)) and q in self.ancestors[v] for b in bases)

    def members(self, bases: list[str]) -> list[str]:
        """All values valid for the bases, as written in this module: a literal set for column checks."""
        prefixes = {self.module.name: self.module.prefix} | {m.name: p for p, m in self.module.imports.items()}
        names = [f"{prefixes[m]}:{i}" for m, i in self.ancestors if prefixes.get(m)]
        return sorted(n for n in names if self.valid(n, bases))

"""Features: if-feature expressions and the set that is enabled, decided before any data is read."""

from __future__ import annotations

import re

from treeline.schema.model import Module

_PART = re.compile(r"\s*(\(|\)|[^\s()]+)")


def holds(expression: str, module: Module, enabled: dict[str, frozenset[str]]) -> bool:
    """Evaluate ``or``, ``and``, ``not``, parentheses and [prefix:]feature; a malformed expression is false."""
    parts = _PART.findall(expression)
    at = 0

    def take(*words: str) -> bool:
        nonlocal at
        if at < len(parts) and parts[at] in words:
            at += 1
            return True
        return False

    def either() -> bool:
        value = both()
        while take("or"):
            value = both() or value
        return value

    def both() -> bool:
        value = single()
        while take("and"):
            value = single() and value
        return value

    def single() -> bool:
        nonlocal at
        if take("not"):
            return not single()
        if take("("):
            value = either()
            if not take(")"):
                raise ValueError
            return value
        if at >= len(parts) or parts[at] in (")", "or", "and"):
            raise ValueError
        name = parts[at]
        at += 1
        prefix, _, local = name.rpartition(":")
        owner = module.by_prefix(prefix or None)
        return owner is not None and local in enabled.get(owner.name, frozenset())

    try:
        value = either()
        return value and at == len(parts)
    except ValueError:
        return False


def all_hold(expressions: list[str], module: Module, enabled: dict[str, frozenset[str]]) -> bool:
    return all(holds(e, module, enabled) for e in expressions)


def enabled_features(module: Module, wanted: dict[str, set[str]] | None = None) -> dict[str, frozenset[str]]:
    """Features by module: those wanted (all, for a module not named), less those whose own if-feature fails, to a fixpoint."""
    modules = module.closure()
    found = {
        name: frozenset(m.features if wanted is None or name not in wanted else set(wanted[name]) & set(m.features))
        for name, m in modules.items()
    }
    while True:
        pruned = {
            name: frozenset(f for f in fs if all_hold(modules[name].features[f], modules[name], found))
            for name, fs in found.items()
        }
        if pruned == found:
            return found
        found = pruned

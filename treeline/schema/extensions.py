"""Extension statements: what a module's ``prefix:name`` statements do is registered by (module, extension)."""

from __future__ import annotations

from collections.abc import Callable

#: (module name, extension name) -> callback(builder, statement), called once per top-level use while a module is built.
REGISTRY: dict[tuple[str, str], Callable] = {}


def extension(module: str, name: str) -> Callable[[Callable], Callable]:
    """Register a callback; a later one for the same extension replaces it."""

    def register(callback: Callable) -> Callable:
        REGISTRY[module, name] = callback
        return callback

    return register


@extension("ietf-yang-structure-ext", "structure")
def structure(builder, statement) -> None:
    """RFC 8791: a top container of its own."""
    builder.add_structure(statement)


@extension("ietf-yang-structure-ext", "augment-structure")
def augment_structure(builder, statement) -> None:
    """RFC 8791: nodes added to such a container."""
    builder.augment(statement)

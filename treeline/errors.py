"""Errors of schema loading."""


class SchemaError(ValueError):
    """A module cannot be used: its text, a reference or a constraint on statements is wrong."""


class SchemaSyntaxError(SchemaError):
    """A module's text does not follow the grammar; carries the line."""

    def __init__(self, message: str, line: int | None = None, source: str | None = None):
        where = f"{source or '<text>'}:{line}: " if line else ""
        super().__init__(where + message)
        self.line = line


class CircularUsesError(SchemaError):
    """A grouping uses itself, directly or through others."""


class RefineTargetError(SchemaError):
    """A refine names a node that the grouping does not have."""


class XPathError(SchemaError):
    """An expression is malformed or outside the supported subset."""

"""Treeline: schema-tree validation and corpus preparation as Spark DataFrame plans."""

from treeline.errors import SchemaError, SchemaSyntaxError, XPathError
from treeline.plans.documents import Options, Validator, summary, violations
from treeline.plans.tables import TablePlan
from treeline.schema.load import parse_file, parse_string
from treeline.schema.model import Module

__all__ = [
    "Module", "Options", "SchemaError", "SchemaSyntaxError", "TablePlan", "Validator", "XPathError",
    "parse_file", "parse_string", "summary", "violations",
]

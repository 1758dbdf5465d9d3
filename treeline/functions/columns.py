"""Type predicates and coercions as columns, without Python in the tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.intervals import several, single
from treeline.schema.identities import Identities
from treeline.schema.model import INTEGERS, TypeSpec


def within(n: Column, spec: str, rfc: bool = False) -> Column:
    """Whether a number lies in a range or length text."""

    def inside(lo, hi) -> Column:
        tests = [n >= F.lit(lo)] * (lo is not None) + [n <= F.lit(hi)] * (hi is not None)
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    plain = lambda d: None if d is None else int(d) if d == d.to_integral_value() else float(d)
    intervals = several(spec) if rfc else single(spec)
    return reduce(lambda a, b: a | b, [inside(plain(lo), plain(hi)) for lo, hi in intervals])


_WHOLE, _REAL = ("tinyint", "smallint", "int", "bigint"), ("float", "double", "decimal")


def valid(value: Column, t: TypeSpec, identities: Identities | None = None, rfc: bool = False, kind: str = "string") -> Column:
    """Whether a column's values have a type; an absent (null) leaf breaks none.

    ``kind`` is the column's own type. Numbers are compared as what they are, so
    that the scan can skip what is in range. Leafrefs and instance-identifiers are
    joins, not predicates.
    """
    return value.isNull() | _present(value, t, identities, rfc, kind)


def _integer(value: Column, t: TypeSpec, rfc: bool, kind: str) -> Column:
    low, high = INTEGERS.get(t.name, (None, None))
    spec = t.range or ("min..max" if low is None else f"{low}..{high}")
    if kind in _WHOLE:
        return within(value, spec, rfc)
    if kind.startswith(_REAL):
        finite = F.lit(True) if kind.startswith("decimal") else ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
        return finite & within(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)), spec, rfc)  # a fraction is cut off
    if kind == "boolean":
        return within(value.cast("int"), spec, rfc)
    n = value.cast("string").try_cast("decimal(38,6)")
    return n.isNotNull() & within(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)), spec, rfc)


def _decimal(value: Column, t: TypeSpec, rfc: bool, kind: str) -> Column:
    own = kind in _WHOLE or kind.startswith(_REAL)
    n = value if own else value.cast("string").try_cast("double")
    test = F.lit(True) if own else n.isNotNull()
    if t.range:
        test &= within(n, t.range, rfc)
    if t.fraction_digits is not None and kind not in _WHOLE:
        if own:
            test &= F.round(value, t.fraction_digits) == value
        else:
            test &= F.length(F.regexp_extract(F.trim(value), r"(?s)\.(.*)\z", 1)) <= t.fraction_digits
    return test


def _matches(text: Column, t: TypeSpec) -> Column:
    test = F.lit(True)
    for p in t.patterns:
        # anchored at the very ends: $ would let a last newline through
        found = F.regexp_like(text, F.lit(rf"\A(?:{p.text})\z"))
        test &= ~found if p.invert else found
    return test


def _present(value: Column, t: TypeSpec, identities: Identities | None, rfc: bool, kind: str) -> Column:
    text = value.cast("string")
    name = t.name
    number = kind in _WHOLE or kind.startswith(_REAL)
    if name in INTEGERS or name == "integer":
        return _integer(value, t, rfc, kind)
    if name in ("decimal64", "number"):
        return _decimal(value, t, rfc, kind)
    if name == "boolean":
        return F.lit(True) if kind == "boolean" else value.isin(0, 1) if number else text.isin("true", "false")
    if name == "empty":
        return value if kind == "boolean" else value == 1 if number else text == ""
    if name == "enumeration":
        return text.isin(list(t.enums))
    if name == "bits":
        parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")
        return (F.size(F.array_except(parts, F.array(*map(F.lit, t.bits)))) == 0) & (F.size(F.array_distinct(parts)) == F.size(parts))
    if name == "binary":
        raw = F.try_to_binary(text, F.lit("base64"))
        return raw.isNotNull() & (within(F.octet_length(raw), t.length, rfc) if t.length else F.lit(True)) & _matches(F.trim(text), t)
    if name == "identityref":
        return text.isin(identities.members(t.bases)) if identities else F.lit(True)
    if name == "union":
        return reduce(lambda a, b: a | b, [_present(value, m, identities, rfc, kind) for m in t.members])
    if t.base is not None and name != "string":
        return _present(value, t.base, identities, rfc, kind)
    return (within(F.char_length(text), t.length, rfc) if t.length else F.lit(True)) & _matches(text, t)

"""Range and length texts."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation


def _bound(text: str) -> Decimal | None:
    try:
        return None if text.strip() in ("min", "max") else Decimal(text.strip())
    except InvalidOperation:
        return None


def single(text: str) -> list[tuple[Decimal | None, Decimal | None]]:
    """One interval, split at the first ``..``: what follows a bar is not read, so the upper bound falls away."""
    low, dots, high = text.partition("..")
    return [(_bound(low), _bound(high))] if dots else [(_bound(low), _bound(low))]


def several(text: str) -> list[tuple[Decimal | None, Decimal | None]]:
    """All intervals of ``a..b | c..d``."""
    return [single(part)[0] for part in text.split("|")]

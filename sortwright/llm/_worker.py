"""What a Python worker keeps between batches: one operator's tables at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_slot: dict[tuple[str, object], object] = {}


def held(kind: str, key: object, make: Callable[[], T]) -> T:
    """The thing made before under this kind and key; else everything held is let go and it is made.

    Workers outlive their task and serve other operators of the same job, whose tables would add up.
    """
    if (kind, key) not in _slot:
        _slot.clear()
        _slot[kind, key] = make()
    return _slot[kind, key]  # type: ignore[return-value]

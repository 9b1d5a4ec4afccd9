"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Sequence


def free_names(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, with underscores added to those that are among ``columns`` in any case."""
    used, free = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        free.append(name)
    return free

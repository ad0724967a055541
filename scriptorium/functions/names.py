"""Names for columns that operators add for themselves."""

from __future__ import annotations


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to clash with a column."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out

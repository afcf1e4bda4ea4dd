"""Names of tables and columns: made valid, unique without regard to case."""

from __future__ import annotations

import re
from collections.abc import Iterable

RESERVED = frozenset(
    "abort action add after all alter analyze and as asc attach before begin between by case cast check collate column commit conflict constraint create cross "
    "current default deferred delete desc detach distinct do drop each else end escape except exists explain fail filter for foreign from full glob group having "
    "if ignore immediate in index inner insert instead intersect into is isnull join key left like limit match natural no not null of offset on or order outer "
    "over plan pragma primary query raise references regexp reindex release rename replace restrict right rollback row rows savepoint select set table temp then "
    "to transaction trigger union unique update using vacuum values view virtual when where window with without".split()
)


def valid_name(name: str | None, prefix: str) -> str:
    """``name`` as an identifier; a keyword or a name that doesn't begin with a letter gets ``prefix``."""
    if name is None:
        return "none"
    name = name.strip()
    if not name:
        return "empty"
    if name.lower() in RESERVED or not name[0].isalpha():
        name = f"{prefix}_{name}"
    return re.sub("_{2,}", "_", re.sub(r"\W+", "_", name)).rstrip("_")


def unique_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_1``, ``name_2`` ... such that no other name equals it but for case."""
    used = {t.casefold() for t in taken}
    candidate, k = name, 0
    while candidate.casefold() in used:
        k += 1
        candidate = f"{name}_{k}"
    return candidate


def unique_names(names: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Each name made unique against ``taken`` and the names before it."""
    used, out = list(taken), []
    for name in names:
        out.append(unique_name(name, used))
        used.append(out[-1])
    return out


def resolve(name: str, columns: Iterable[str]) -> str | None:
    """The column that ``name`` means, whatever its case."""
    by_fold = {c.casefold(): c for c in columns}
    return by_fold.get(name.casefold())

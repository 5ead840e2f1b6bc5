"""Routing of labelled rows down a policy tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Route:
    """A node of the tree: rows that meet all ``matchers`` (column, = != =~ !~, value) go to its children, or stay with ``receiver``.

    A row that a node has taken is shown to the next sibling only with ``go_on``.  Without a receiver the parent's holds.
    """

    receiver: str | None = None
    matchers: tuple[tuple[str, str, str], ...] = ()
    go_on: bool = False
    children: tuple[Route, ...] = ()


def _meets(route: Route) -> Column:
    """Whether a row meets all matchers; a null label counts as empty, a pattern must match the whole label."""
    out = F.lit(True)
    for column, sign, value in route.matchers:
        label = F.coalesce(F.col(column).cast("string"), F.lit(""))
        one = label.rlike(f"^(?:{value})$") if sign.endswith("~") else label == value
        out = out & (~one if sign.startswith("!") else one)
    return out


def receivers(root: Route, inherited: str | None = None) -> Column:
    """The array of receivers of each row: those of the deepest routes that take it, each once; the root takes all rows."""
    own = root.receiver or inherited
    found, open_ = F.array().cast("array<string>"), F.lit(True)
    for child in root.children:
        takes = open_ & _meets(child)
        found = F.when(takes, F.concat(found, receivers(child, own))).otherwise(found)
        if not child.go_on:
            open_ = open_ & ~takes
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(own))))

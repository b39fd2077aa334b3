"""The operators that a frame depends on, breadth first."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lineage(df: DataFrame) -> list[tuple[int, str, str | None]]:
    """(depth, operator, its successor) of the analysed plan; an operator reached twice is listed twice."""
    out, level, depth = [], [(df._jdf.queryExecution().analyzed(), None)], 0
    while level:
        below = []
        for node, successor in level:
            name = node.nodeName()
            out.append((depth, name, successor))
            children = node.children()
            below += [(children.apply(i), name) for i in range(children.size())]
        level, depth = below, depth + 1
    return out

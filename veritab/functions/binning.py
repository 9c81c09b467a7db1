"""Bin-index expressions.  All rules differ in which side of a bin is closed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BRANCHES = 5


def with_edge_counts(df: DataFrame, searches: dict[str, tuple[Column, list[float], bool]]) -> DataFrame:
    """Add one column per search (value, ascending edges, inclusive): edges <= value, or < value.

    NULL stays NULL.  The search runs by levels: the coarsest compares with every s-th
    edge, the next only inside the block found, addressed by arithmetic.  Each level is
    a projection of its own, so its result is a local variable of the generated code; a
    comparison per edge, or levels nested in one expression, would outgrow the size up
    to which the JVM compiles a method.
    """
    names = list(searches)
    staged = df.select("*", *[searches[n][0].cast("double").alias(f"__v_{n}") for n in names])
    plans = {}
    for n in names:
        count, step = len(searches[n][1]), 1
        while step * BRANCHES <= count:
            step *= BRANCHES
        plans[n] = step
    columns = {n: None for n in names}
    for step in sorted({BRANCHES**i for i in range(20) if BRANCHES**i <= max(plans.values(), default=1)}, reverse=True):
        added = []
        for n in names:
            _, edges, inclusive = searches[n]
            if step > plans[n]:
                continue
            value = F.col(f"`__v_{n}`")
            found = None if columns[n] is None else F.col(columns[n])
            # NaN sorts above every number, so the padding is never passed
            table = F.array(*[F.lit(float(e)) for e in [*edges, *[math.nan] * (BRANCHES * plans[n])]])
            places = range(step - 1, len(edges) if found is None else (BRANCHES - 1) * step, step)
            total = F.lit(0) if found is None else found
            for place in places:
                edge = F.lit(float(edges[place])) if found is None else F.get(table, found + place)
                hit = value >= edge if inclusive else value > edge
                total = total + (hit.cast("int") * step if step > 1 else hit.cast("int"))
            if not edges:
                total = F.when(value.isNotNull(), F.lit(0))
            output = f"`{n}`" if step == 1 else f"`__l{step}_{n}`"
            added.append((n, output, total))
        if added:
            staged = staged.select("*", *[total.alias(output.strip("`")) for _, output, total in added])
            for n, output, _ in added:
                columns[n] = output
    return staged.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{n}`") for n in names])


def unit_scale(value: Column, low: float, high: float) -> Column:
    """(value - low) / (high - low); a constant column maps to 0."""
    if high <= low:
        return value - F.lit(float(low))
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low))


def histogram_bin(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """`bins` equally spaced edges over [low, high] make bins-1 left-closed bins.

    The last bin is closed on both sides; NULL and out-of-range give NULL.
    """
    if low is None or high is None:
        return F.lit(None).cast("int")
    z = unit_scale(value, low, high)
    index = F.least(F.floor(z * (bins - 1)), F.lit(bins - 2).cast("long"))
    return F.when((z >= 0) & (z <= 1), index.cast("int"))


def right_closed_bin(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """Equal-width bins (e_i, e_i+1] with the lowest edge included; else NULL."""
    if low is None or high is None:
        return F.lit(None).cast("int")
    z = unit_scale(value, low, high)
    index = F.greatest(F.ceil(z * (bins - 1)) - 1, F.lit(0).cast("long"))
    return F.when((z >= 0) & (z <= 1), index.cast("int"))


def right_closed_index(below: Column, count: int) -> Column:
    """I4: bin (e_i, e_i+1] from the number of edges below the value.

    The lowest edge is included by the caller's search; NULL or outside is -1.
    """
    return F.coalesce(F.when(below < count, F.greatest(below - 1, F.lit(0))), F.lit(-1))


def quantile_search(value: Column, edges: list[float]) -> tuple[Column, list[float], bool]:
    """I4: the search behind `right_closed_index`: values outside the edges drop out as NULL."""
    inside = (value >= F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1])))
    return F.when(inside, value), edges, False


def open_ended_search(value: Column, edges: list[float]) -> tuple[Column, list[float], bool]:
    """Left-closed bins whose first and last reach to infinity; a NULL count means bin 0."""
    return value, edges[1:-1], True


def is_uniform_grid(edges: list[float]) -> bool:
    last = len(edges) - 1
    return last > 0 and all(abs(edge - i / last) < 1e-12 for i, edge in enumerate(edges))

"""Settings written into file paths, read by a table of patterns (G2, N4), and metric names."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def part_from_end(path: Column, k: int) -> Column:
    """k-th part from the end, NULL when the path is shorter."""
    return F.try_element_at(path_parts(path), F.lit(-k))


@dataclass(frozen=True)
class Setting:
    """One column read from a path.

    `marks` are (pattern, value) pairs tried first; then the first group of `pattern`,
    cast to `kind`, with `replace` applied to its text; else `default`.
    """

    name: str
    pattern: str = ""
    kind: str = "string"
    default: str | int | float | None = None
    marks: tuple[tuple[str, str], ...] = ()
    replace: tuple[str, str] | None = None

    def column(self, path: Column) -> Column:
        found = [F.when(path.rlike(mark), F.lit(value).cast(self.kind)) for mark, value in self.marks]
        if self.pattern:
            text = F.regexp_extract(path, self.pattern, 1)
            if self.replace:
                text = F.replace(text, F.lit(self.replace[0]), F.lit(self.replace[1]))
            found.append(F.when(path.rlike(self.pattern), text.try_cast(self.kind)))
        return F.coalesce(*found, F.lit(self.default).cast(self.kind)).alias(self.name)


def read_settings(path: Column, settings: Iterable[Setting]) -> list[Column]:
    """One column for each setting; the layout of the paths belongs to the caller."""
    return [setting.column(path) for setting in settings]


def merged_metric_name(metric: Column, scorer: Column, model: Column, bins: Column) -> Column:
    """efficacy_<model>_<scorer>, histogram_<bins>_<scorer>, else <metric>_<scorer>."""
    head = F.get(F.split(metric, "_"), F.lit(0))
    return (
        F.when(metric == "efficacy_test", F.concat_ws("_", head, model, scorer))
        .when(metric == "histogram_intersection", F.concat_ws("_", head, bins.cast("int").cast("string"), scorer))
        .otherwise(F.concat_ws("_", head, scorer))
    )


def short_metric_name(metric: Column, scorer: Column) -> Column:
    """<metric>_<scorer>."""
    return F.concat_ws("_", F.get(F.split(metric, "_"), F.lit(0)), scorer)

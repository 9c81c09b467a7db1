"""Operator 11: how quality filters interact, from the potential of the game of removals.

Each text gets a mask of the filters that it fails.  For a part of the table, the worth
of a coalition of filters is the number of documents that fail at least one of them:
what these filters remove together, in any order.  The potential of Hart and Mas-Colell
is found by recursion over the 32 coalitions, P(S) = (v(S) + sum of P(S without i)) / |S|
with P of none zero, and the Shapley value of a filter is P(all) less P(all but it).
Every step of every order is a difference of two coalitions.

The texts are read once.  What follows works on small rows: a first-of-its-text table by
digest, two joins by id, and counts by part and mask that are combined before they are
shuffled, so a part or a text that holds a third of the rows is no hot group.

Potentials are kept as whole numbers, sixty-fold, since their denominators divide 60.

Defined results: NULL texts are empty; an empty text has no words and fails A only, and
E if a smaller id is empty too.  A NULL part is the empty string.  A row without an id
has no smaller id, is nobody's smaller id and has no labels.  Rows that repeat an id
each count, and equal texts under one id do not make each other fail E.  A document is
good or toxic if any of its label rows says 1.  Other columns are ignored; an empty
table has no parts and gives no rows.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.session import freeze

FILTERS = "ABCDE"
#: Coalitions are bit masks, filter A in the lowest bit.
ALL = (1 << len(FILTERS)) - 1
#: Common denominator of the potentials: lcm(1, ..., 5).
SCALE = 60


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask): the filters A to D that each whole text fails, and the digest that tells equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.length(text).alias("size"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
        text.rlike("[#$%&*|]").alias("signs"),
    )
    fails = [
        F.size("words") < 200,
        100 * F.size(F.array_distinct("words")).cast("long") < 50 * F.size("words").cast("long"),
        100 * F.col("capitals").cast("long") > 3 * F.col("size").cast("long"),
        F.col("signs"),
    ]
    mask = F.lit(0)
    for bit, failing in enumerate(fails):
        mask = mask + F.when(failing, 1 << bit).otherwise(0)
    return split.select("id", "part", "digest", mask.cast("int").alias("mask"))


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every document, with filter E: the text of a smaller id."""
    rows = freeze(measured(docs, id_col, text_col, part_col))
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    named = (
        rows.where("id IS NOT NULL").join(firsts, ["id", "digest"], "left").join(known, "id", "left")
        .select(
            "part",
            (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))).alias("mask"),
            *[F.coalesce(name, F.lit(0)).alias(name) for name in ("good", "toxic")],
        )
    )
    unnamed = rows.where("id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(unnamed)


def coalitions(rows: DataFrame) -> DataFrame:
    """(part, n, v, good, toxic): documents of a part, and for each coalition how many of them, of the good and of the toxic it removes."""
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def removed(what: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(what)).otherwise(F.lit(0).cast("long"))) for s in range(ALL + 1)])

    return cells.groupBy("part").agg(
        F.sum("n").alias("n"), removed("n").alias("v"), removed("good").alias("good"), removed("toxic").alias("toxic")
    )


def potentials(games: DataFrame) -> DataFrame:
    """Adds `potential`: of each coalition, times `SCALE`, as whole numbers; a coalition waits for the smaller ones."""
    names = [f"p{s}" for s in range(ALL + 1)]
    found = games.withColumn("p0", F.lit(0).cast("long"))
    for members in range(1, len(FILTERS) + 1):
        found = found.withColumns({
            names[s]: F.expr(f"({SCALE} * v[{s}] + {' + '.join(names[s & ~(1 << i)] for i in range(len(FILTERS)) if s >> i & 1)}) div {members}")
            for s in range(1, ALL + 1) if s.bit_count() == members
        })
    return found.withColumn("potential", F.array(*names)).drop(*names)


def steps() -> Column:
    """An array of (filter_order, step, before, after, own): all steps of all orders as coalitions."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            found.append(("".join(FILTERS[j] for j in order), step, before, before | 1 << i, 1 << i))
            before |= 1 << i
    rows = [{"filter_order": a, "step": b, "before": c, "after": d, "own": e} for a, b, c, d, e in found]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, before: int, after: int, own: int>>")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step of it."""
    games = potentials(coalitions(marked(docs, labels, id_col, text_col, part_col)))
    at = games.select("*", F.explode(steps()).alias("at")).select("*", "at.*")
    return at.select(
        "part", "filter_order", "step",
        F.expr("n - v[after]").alias("kept"),
        F.expr("v[after] - v[before]").alias("removed"),
        F.expr("v[own] - (v[after] - v[before])").alias("redundant"),
        F.expr(f"v[{ALL}] - v[{ALL} - own]").alias("unique_fails"),
        F.expr("good[after] - good[before]").alias("good_lost"),
        F.expr("toxic[after] - toxic[before]").alias("toxic_lost"),
        # 120 orders = 2 * SCALE
        F.expr(f"2 * (potential[{ALL}] - potential[{ALL} - own])").alias("shapley"),
    )

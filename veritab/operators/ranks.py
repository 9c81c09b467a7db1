"""Global order without a global window: prefix sums, ranks, quantiles, exact cuts.

Row-level order questions are answered on the table of distinct values and
their counts, which a hot value cannot blow up.  Where that table is large its
prefix sums run in two steps over range partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.functions.binning import with_edge_counts
from veritab.functions.scalars import literal_array, named, numeric_of, seeded_hash
from veritab.operators.sides import SIDE, melt
from veritab.session import freeze

ROWS_PER_TASK = 2_000_000
# Fixed value: parts of a two-step sum; beyond it they grow, as the driver hears of every part of every step.
MOST_PARTS = 500
HOT_SHARE = 1000
BROADCAST_STRATA = 100_000


def running_totals(
    table: DataFrame, group: list[str], order: list[str], sums: list[str], rows_per_task: int = ROWS_PER_TASK,
    at_most: int | None = None,
) -> DataFrame:
    """Add `running_<c>` (inclusive prefix sum) for every c in `sums`.

    `table` holds one row per (group, order).  Small tables use one window per
    group.  Larger ones are range-partitioned into at most MOST_PARTS parts and frozen; each
    part is summed by itself and shifted by the totals of the parts before it.  `at_most` is a known bound
    on the rows, which spares counting them.
    """
    ordered = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    small = at_most is not None and at_most <= rows_per_task
    parts = 1 if small else min(-(-table.count() // rows_per_task), MOST_PARTS)
    if parts <= 1:
        return table.select("*", *[F.sum(c).over(ordered).alias(f"running_{c}") for c in sums])
    ranged = freeze(
        table.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id())
    )
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "__part")
        .agg(*[F.sum(c).alias(f"__sum_{c}") for c in sums])
        .select(
            *group, "__part",
            *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        )
    )
    inside = W.partitionBy(*group, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"__local_{c}") for c in sums])
    joined = local.join(offsets, [*group, "__part"])
    return joined.select(
        *[F.col(c) for c in table.columns],
        *[(F.col(f"__local_{c}") + F.col(f"__before_{c}")).alias(f"running_{c}") for c in sums],
    )


def attach_by_value(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, take: list[str], table_key: str | None = None) -> DataFrame:
    """Left join of `rows` to a per-value `table` that knows each value's row count.

    `table_key` is the key's name in the table, its `value` or else `key` by default.

    Values holding at least total/HOT_SHARE rows number at most HOT_SHARE: those
    are broadcast.  Their rows then travel under a salt instead of their value, so
    no task of the shuffle join receives more than a small share of the rows.
    """
    floor = max(1, total // HOT_SHARE)
    value = table_key or ("value" if "value" in table.columns else key)
    hot = table.filter(F.col(count) >= floor).select(
        F.col(value).alias("__hot_key"), *[F.col(c).alias(f"__hot_{c}") for c in take]
    )
    cold = table.filter(F.col(count) < floor).select(
        F.col(value).alias("__cold_key"), F.lit(0).alias("__cold_salt"), *[F.col(c).alias(f"__cold_{c}") for c in take]
    )
    flagged = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn(
        "__salt",
        F.when(F.col("__hot_key").isNull(), 0).otherwise(
            1 + F.pmod(F.xxhash64(*[named(c) for c in rows.columns]), F.lit(HOT_SHARE)).cast("int")
        ),
    )
    joined = flagged.join(
        cold, (F.col(key) == F.col("__cold_key")) & (F.col("__salt") == F.col("__cold_salt")), "left"
    )
    return joined.select(
        *[named(c) for c in rows.columns],
        *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in take],
    )


def percent_rank01(df: DataFrame, column: str, output: str, fill: float | None = None) -> DataFrame:
    """Average rank / n, at least 1e-6, shifted down by 1e-6 into [0, 1).

    NULL takes `fill` (the caller passes the median) before ranking.
    """
    value = numeric_of(df, column)
    rows = df.withColumn("__value", value if fill is None else F.coalesce(value, F.lit(float(fill))))
    counts = rows.filter(F.col("__value").isNotNull()).groupBy("__value").agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("__value")).first()[0]
    table = running_totals(counts.withColumn("__all", F.lit(1)), ["__all"], ["__value"], ["__n"], at_most=total)
    average_rank = F.col("running___n") - F.col("__n") + (F.col("__n") + 1) / 2
    share = F.greatest(average_rank / F.lit(float(max(total, 1))), F.lit(1e-6)) - F.lit(1e-6)
    table = table.select("__value", "__n", share.alias(output))
    return attach_by_value(rows, table, "__value", "__n", total, [output]).drop("__value")


def top_values(counts: DataFrame, group: list[str], k: int, count: str = "n", value: str = "value") -> DataFrame:
    """The k most frequent values per group, ties by value; adds `rank`.

    Spark limits each map task to k rows per group before the shuffle.
    """
    order = W.partitionBy(*group).orderBy(F.col(count).desc(), F.col(value).asc())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _brackets(marks: list[float], shares: int) -> tuple[list[float], list[float]]:
    """Disjoint closed intervals from the lower and upper marks of all shares, in order."""
    lows, highs = [], []
    for low, high in sorted(zip(marks[:shares], marks[shares:])):
        if highs and low <= highs[-1]:
            highs[-1] = max(high, highs[-1])
        else:
            lows.append(low)
            highs.append(high)
    return lows, highs


def exact_quantiles(df: DataFrame, cells: dict[str, Column], pieces: int, accuracy: int = 10_000) -> dict[str, list[float]]:
    """pieces+1 evenly spaced quantiles per column with linear interpolation, exact, one way at any size.

    A mergeable sketch brackets every wanted rank; its rank error is at most 1/accuracy, and
    the brackets are wider than that.  The second scan counts the values between the
    brackets and keeps the values inside them, some 2 * (pieces + 1) * 4 / accuracy of the
    rows, as (value, count).  Ranks inside a bracket then give the exact values.  Nothing
    else is shuffled, and (pieces+1) numbers per column reach the driver.
    """
    if not cells:
        return {}
    aliased = {f"c{i}": cell for i, cell in enumerate(cells.values())}
    names = dict(zip(aliased, cells))
    narrow = df.select(*[cell.cast("double").alias(k) for k, cell in aliased.items()])
    sizes = narrow.agg(*[F.count(k).alias(k) for k in aliased]).first().asDict()
    shares = [i / pieces for i in range(pieces + 1)]

    def marks(k: str) -> Column:
        slack = 2 / accuracy + 3 / max(1, sizes[k])
        wanted = [max(0.0, s - slack) for s in shares] + [min(1.0, s + slack) for s in shares]
        return F.percentile_approx(k, F.array(*[F.lit(s) for s in wanted]), accuracy)

    row = narrow.agg(*[marks(k).alias(k) for k in aliased]).first()
    brackets = {k: _brackets(list(row[k]), len(shares)) for k in aliased if sizes[k]}
    if not brackets:
        return {names[k]: [] for k in aliased}
    counted = with_edge_counts(narrow, {f"at_{k}": (F.col(k), lows, True) for k, (lows, _) in brackets.items()})

    def place(k: str) -> Column:
        """Bracket number 2j, or 2j + 1 for the gap after it; only values in a bracket are kept."""
        j, x = F.col(f"at_{k}") - 1, F.col(k)
        inside = (j >= 0) & (x <= F.get(literal_array(brackets[k][1]), F.greatest(j, F.lit(0))))
        return F.struct(F.lit(k).alias("column"), (2 * j + F.when(inside, 0).otherwise(1)).cast("int").alias("place"), F.when(inside, x).alias("value"), x.isNotNull().alias("known"))

    counts = (
        counted.select(F.explode(F.array(*[place(k) for k in brackets])).alias("m")).where("m.known")
        .groupBy("m.column", "m.place", "m.value").agg(F.count("*").alias("n"))
    )
    counts = counts.persist()
    ends: dict[str, int] = {k: 0 for k in brackets}
    before = []
    for found in counts.groupBy("column", "place").agg(F.sum("n").alias("n")).orderBy("column", "place").collect():  # a few rows for each share
        before.append((found["column"], found["place"], ends[found["column"]]))
        ends[found["column"]] += found["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "column string, place int, before long"))  # as many rows
    inside = W.partitionBy("column", "place").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    table = counts.where(F.col("value").isNotNull()).join(offsets, ["column", "place"]).withColumn("stop", F.col("before") + F.sum("n").over(inside))
    size = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(n))]), F.col("column"))
    table = table.select("column", "value", (F.col("stop") - F.col("n")).alias("start"), "stop", F.greatest(size - 1, F.lit(1)).cast("long").alias("span"))

    # the i whose rank floor(i*span/pieces)+shift falls among this value's ranks: low..high
    for shift in (0, 1):
        table = table.withColumn(f"low{shift}", F.expr(f"greatest(0L, ((start - {shift}) * {pieces} + span - 1) div span)"))
        table = table.withColumn(f"high{shift}", F.expr(f"least({pieces}L, ((stop - {shift}) * {pieces} + span - 1) div span - 1)"))
    table = table.filter("low0 <= high0 OR low1 <= high1")  # few values hold a wanted rank

    def covered(shift: int) -> Column:
        low, high = F.col(f"low{shift}"), F.col(f"high{shift}")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    marked = table.select(
        "column", "value",
        F.explode(
            F.concat(
                F.transform(covered(0), lambda i: F.struct(i.alias("i"), F.lit(0).alias("upper"))),
                F.transform(covered(1), lambda i: F.struct(i.alias("i"), F.lit(1).alias("upper"))),
            )
        ).alias("m"),
    )
    found = marked.groupBy("column", F.col("m.i").alias("i")).agg(
        F.max(F.when(F.col("m.upper") == 0, F.col("value"))).alias("low"),
        F.max(F.when(F.col("m.upper") == 1, F.col("value"))).alias("high"),
    ).collect()
    counts.unpersist()
    edges: dict[str, list[float]] = {names[k]: [] for k in aliased}
    for key in aliased:
        by_rank = {r["i"]: r for r in found if r["column"] == key}
        for i in range(pieces + 1 if sizes[key] else 0):
            whole, rest = divmod(i * (sizes[key] - 1), pieces)
            low = by_rank[i]["low"]
            high = by_rank[i]["high"] if rest else low
            edges[names[key]].append(low + (high - low) * (rest / pieces))
    return edges


def cut_by_hash(
    df: DataFrame,
    keys: list[str],
    seed: int,
    ends: Callable[[Column], list[tuple[str, Column]]],
    strata: list[str] | None = None,
    output: str = "part",
    sizes: DataFrame | None = None,
    bits: int = 16,
) -> DataFrame:
    """Cut a seeded random order of the rows at exact sizes, without sorting the rows.

    `keys` identify a row.  Each row gets a 64-bit seeded hash; a histogram of its
    top bits tells in which bucket each cut falls.  All other rows are labelled by
    comparing bucket numbers; only the rows of the cut buckets are ranked.
    `ends(n)` lists (label, rank at which the label ends) for a stratum of n rows, or
    `sizes` supplies one `__end_<label>` column per stratum.  Rows past the last
    end are dropped; give the last label the end n to keep everything.
    """
    strata = strata or []
    group = [f"__s{i}" for i in range(len(strata))] or ["__s0"]
    tagged = df.withColumn("__hash", seeded_hash(seed, *[named(k) for k in keys]))
    tagged = tagged.withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bits))
    if strata:
        for alias, name in zip(group, strata):
            tagged = tagged.withColumn(alias, F.coalesce(named(name).cast("string"), F.lit("\u0000")))
    else:
        tagged = tagged.withColumn("__s0", F.lit(0))

    histogram = tagged.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    whole = W.partitionBy(*group)
    histogram = histogram.select(
        "*",
        F.sum("__n").over(whole).alias("__size"),
        F.sum("__n").over(whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)).alias("__before"),
    ).withColumn("__before", F.coalesce("__before", F.lit(0)))
    if sizes is not None:
        histogram = histogram.join(sizes, group)
        labels = [c[len("__end_"):] for c in sizes.columns if c.startswith("__end_")]
        limits = [(label, F.col(f"__end_{label}")) for label in labels]
    else:
        limits = ends(F.col("__size"))
    after = F.col("__before") + F.col("__n")
    cuts = []
    for i, (_, end) in enumerate(limits):
        holds_cut = (F.col("__before") < end) & (end < after)
        cuts += [
            F.max(F.when(after <= end, F.col("__bucket"))).alias(f"__full{i}"),
            F.max(F.when(holds_cut, F.col("__bucket"))).alias(f"__cut{i}"),
            F.max(F.when(holds_cut, F.col("__before"))).alias(f"__start{i}"),
            F.max(end).alias(f"__limit{i}"),
        ]
    bounds = histogram.groupBy(*group).agg(*cuts)
    if not strata:  # a single row: its values become literals
        kinds = dict(bounds.dtypes)
        row = bounds.drop(*group).first()
        found = row.asDict() if row is not None else {c: None for c in bounds.columns if c not in group}
        placed = tagged.select("*", *[F.lit(v).cast(kinds[c]).alias(c) for c, v in found.items()])
    else:  # one row per stratum: frozen, so that its size is known before the join is chosen
        bounds = freeze(bounds)
        if bounds.count() <= BROADCAST_STRATA:
            bounds = F.broadcast(bounds)
        placed = tagged.join(bounds, group)

    def label_by(test: Callable[[int], Column]) -> Column:
        column = F.lit(None).cast("string")
        for i in reversed(range(len(limits))):
            column = F.when(test(i), limits[i][0]).otherwise(column)
        return column

    in_cut = F.lit(False)
    for i in range(len(limits)):
        in_cut = in_cut | F.coalesce(F.col("__bucket") == F.col(f"__cut{i}"), F.lit(False))
    kept = [named(c) for c in df.columns]
    by_bucket = placed.filter(~in_cut).select(
        *kept, label_by(lambda i: F.coalesce(F.col("__bucket") <= F.col(f"__full{i}"), F.lit(False))).alias(output)
    )
    order = W.partitionBy(*group, "__bucket").orderBy("__hash", *[named(k) for k in keys])
    start = F.coalesce(
        *[F.when(F.col("__bucket") == F.col(f"__cut{i}"), F.col(f"__start{i}")) for i in range(len(limits))]
    )
    by_rank = placed.filter(in_cut).withColumn("__rank", start + F.row_number().over(order)).select(
        *kept, label_by(lambda i: F.col("__rank") <= F.col(f"__limit{i}")).alias(output)
    )
    return by_bucket.unionByName(by_rank).filter(F.col(output).isNotNull())


def equalize(pair: DataFrame, keys: list[str], seed: int = 1000) -> DataFrame:
    """Keep a seeded random subset of the larger side so that both sides are equally large."""
    counts = {r[SIDE]: r["count"] for r in pair.groupBy(SIDE).count().collect()}
    smallest = min(counts.values()) if len(counts) == 2 else 0
    if set(counts.values()) == {smallest}:
        return pair
    return cut_by_hash(
        pair, keys, seed, lambda n: [("keep", F.lit(smallest))], strata=[SIDE], output="__keep"
    ).drop("__keep")


def carried(events: DataFrame, group: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Fill every column of `take` with its last non-NULL value at or before the row, in order within the group.

    The rows are range-partitioned by group and order, so that neither a group nor a run
    of equal positions has to fit a task as long as `order` ends with a column that tells
    them apart.  Each part fills its own rows; what a part inherits is one row a part.
    """
    ranged = freeze(events.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy(*group, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy(*group, "__part").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__end_{c}") for c in take]
    )
    inherited = ends.select(*group, "__part", *[F.last(f"__end_{c}", ignorenulls=True).over(before).alias(f"__start_{c}") for c in take])
    local = ranged.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"__local_{c}") for c in take])
    joined = local.join(inherited, [*group, "__part"])
    return joined.select(*[
        F.coalesce(f"__local_{c}", f"__start_{c}").alias(c) if c in take else F.col(c) for c in events.columns
    ])


def positional_pairs(pair: DataFrame, columns: list[str], value_of: Callable[[str], Column], type_name: str) -> DataFrame:
    """I-th smallest real value next to the i-th smallest fake value, as weighted pairs.

    Each distinct value covers an interval of ranks.  The interval starts of both sides
    are merged, the interval that is open on each side is carried on, and a segment
    (column, real, fake, n) up to the nearer end stands for n row pairs, however many.
    Ranks that only one side has pair with nothing.
    """
    counts = (
        melt(pair, {c: value_of(c).cast(type_name) for c in columns}, [F.col(SIDE)])
        .filter(F.col("value").isNotNull())
        .groupBy("column", SIDE, "value").agg(F.count("*").alias("n"))
    )
    bound = pair.count() * len(columns)
    spans = running_totals(counts, ["column", SIDE], ["value"], ["n"], at_most=bound).select(
        "column", SIDE, (F.col("running_n") - F.col("n")).alias("start"), F.struct("value", F.col("running_n").alias("stop")).alias("span")
    )
    borders = spans.groupBy("column", "start").agg(*[
        F.max(F.when(F.col(SIDE) == side, F.col("span"))).alias(side) for side in ("real", "fake")
    ])
    open_spans = carried(borders, ["column"], ["start"], ["real", "fake"])
    return open_spans.select(
        "column", F.col("real.value").alias("real"), F.col("fake.value").alias("fake"),
        (F.least("real.stop", "fake.stop") - F.col("start")).alias("n"),
    ).filter(F.col("real").isNotNull() & F.col("fake").isNotNull() & (F.col("n") > 0))

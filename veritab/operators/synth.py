"""Pseudo rows, conditional sampling, imputation and splits."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.binning import with_edge_counts
from veritab.functions.scalars import (
    clip, literal_array, literal_map, lookup, named, numeric_of, seeded_hash, seeded_normal, seeded_uniform,
)
from veritab.operators.encode import IGNORE, bounds_of, decode_category, decode_numeric, encode_labels
from veritab.operators.profile import UNKNOWN, ColumnProfile, SchemaMetadata, TableProfile
from veritab.operators.ranks import carried, cut_by_hash, exact_quantiles, percent_rank01, running_totals
from veritab.operators.sides import text_of
from veritab.session import freeze

LITERAL_CATEGORIES = 1000
ID = "row_id"


# ------------------------------------------------------------------- uniform K1
def uniform_pseudo(spark: SparkSession, profile: TableProfile, n: int, sets: int = 1, seed: int = 0, include_unknown: bool = False) -> DataFrame:
    """K1: every column independently uniform over its range or vocabulary; `set_id` tells the sets apart.

    Q8: each column uses its own range, and the unknown token is left out unless asked for.
    """
    rows = spark.range(n * sets).withColumnRenamed("id", ID)
    values = []
    for i, info in enumerate(profile.columns.values()):
        u = seeded_uniform(seed * 1009 + i, F.col(ID))
        if info.tail:
            # places are drawn evenly, so no key of the join is hot
            codes = profile.codes(info.name).select(F.col("id").alias("__id"), F.col("value").alias(f"__word{i}"))
            first = 0 if include_unknown else 1
            rows = rows.withColumn("__id", (F.floor(u * (info.size - first)) + first).cast("int")).join(codes, "__id", "left").drop("__id")
            value = F.coalesce(f"__word{i}", F.lit(UNKNOWN))
        elif info.kind == "categorical":
            words = info.vocabulary if include_unknown else [v for v in info.vocabulary if v != UNKNOWN]
            value = F.get(literal_array(words, "string"), F.floor(u * len(words)).cast("int"))
        elif info.integer:
            value = (F.floor(u * F.lit(info.maximum - info.minimum + 1)) + F.lit(info.minimum)).cast("bigint")
        else:
            value = F.lit(info.minimum) + u * F.lit(info.maximum - info.minimum)
        values.append(value.alias(info.name))
    return rows.select(ID, F.floor(F.col(ID) / n).cast("int").alias("set_id"), *values)


def pseudo_from_metadata(spark: SparkSession, metadata: SchemaMetadata, n: int, seed: int = 0, missing_rate: float = 0.0) -> DataFrame:
    """Q11: independent columns from plain metadata, with nulls at a rate; categories may be many.

    Small vocabularies are literals; a large one is numbered and joined by number.
    """
    rows = spark.range(n).withColumnRenamed("id", ID)
    large = {}
    for i, (c, (low, high, kind)) in enumerate(metadata.numeric.items()):
        u = seeded_uniform(seed * 1013 + i, F.col(ID))
        value = F.lit(low) + u * F.lit(high - low) if kind == "float" else F.floor(u * F.lit(high - low + 1)) + F.lit(low)
        rows = rows.withColumn(c, value.cast("double" if kind == "float" else "bigint"))
    small = [c for c, size in metadata.sizes.items() if size <= LITERAL_CATEGORIES]
    words = category_lists(metadata, small)
    for i, (c, size) in enumerate(metadata.sizes.items()):
        place = F.floor(seeded_uniform(seed * 1019 + 500 + i, F.col(ID)) * size).cast("int")
        if c in words:
            rows = rows.withColumn(c, F.get(literal_array(words[c], "string"), place))
        else:
            large[c] = place
    for c, place in large.items():
        table = category_codes(metadata, c).select(F.col("code").alias("__code"), F.col("value").alias(c))
        rows = rows.withColumn("__code", place).join(table, "__code").drop("__code")
    if missing_rate > 0:
        names = [c for c in rows.columns if c != ID]
        rows = rows.select(ID, *[
            F.when(seeded_uniform(seed * 1021 + 900 + i, F.col(ID)) >= missing_rate, named(c)).alias(c) for i, c in enumerate(names)
        ])
    return rows


def category_lists(metadata: SchemaMetadata, columns: list[str]) -> dict[str, list[str]]:
    """Sorted categories of columns with at most LITERAL_CATEGORIES values."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        for row in metadata.categories.filter(F.col("column").isin(columns)).collect():
            found[row["column"]].append(row["value"])
    return {c: sorted(v, key=lambda text: text.encode()) for c, v in found.items()}


def category_codes(metadata: SchemaMetadata, column: str) -> DataFrame:
    """(value, code) of one column in sorted order, at any size."""
    values = metadata.categories.filter(F.col("column") == column).withColumn("one", F.lit(1))
    return running_totals(values, ["column"], ["value"], ["one"]).select(
        "value", (F.col("running_one") - 1).cast("int").alias("code")
    )


# -------------------------------------------------------------- dependencies K3
def draw_rules(columns: list[str], count: int, seed: int) -> list[tuple[str, str]]:
    """K3: source/target pairs along one random order of the columns, so that they form no circle."""
    generator = random.Random(seed)
    order = columns[:]
    generator.shuffle(order)
    rules = []
    for _ in range(count):
        i = generator.randrange(len(order) - 1)
        rules.append((order[i], order[generator.randrange(i + 1, len(order))]))
    return rules


def inject_dependencies(
    df: DataFrame, metadata: SchemaMetadata, keys: list[str], rules: list[tuple[str, str]] | None = None, count: int = 6,
    seed: int = 0, noise: bool = True,
) -> DataFrame:
    """K3: make targets depend on sources, within the known ranges and categories.

    Without `noise`, number-to-number and category-to-number rules are exact.
    """
    rules = rules if rules is not None else draw_rules([*metadata.numeric, *metadata.sizes], count, seed)
    key_columns = [named(k) for k in keys]
    lists = category_lists(metadata, [c for c, size in metadata.sizes.items() if size <= LITERAL_CATEGORIES])
    for step, (source, target) in enumerate(rules):
        salt = seed * 7919 + step * 31
        order = [c for c in df.columns]
        if source in metadata.numeric:
            middle = exact_quantiles(df, {source: numeric_of(df, source)}, 2)[source]
            df = percent_rank01(df, source, "__u", fill=middle[1] if middle else 0.0)
        if target in metadata.numeric:
            low, high, kind = metadata.numeric[target]
            if source in metadata.numeric:
                alpha = random.Random(salt).uniform(0.6, 1.4) if noise else 1.0
                shift = 0.08 * seeded_normal(salt, *key_columns) if noise else F.lit(0.0)
                value = F.lit(low) + F.lit(high - low) * clip(F.lit(alpha) * F.col("__u") + shift, 0.0, 1.0)
            else:
                size = max(1, metadata.sizes[source])
                df = with_code(df, source, metadata, lists, "__code")
                code = F.greatest(F.least(F.col("__code"), F.lit(size - 1)), F.lit(0))
                shift = F.lit(0.12 * (high - low)) * seeded_normal(salt, *key_columns) if noise else F.lit(0.0)
                value = F.lit(low) + F.lit(high - low) * (code + 0.5) / size + shift
            value = clip(value, low, high)
            value = F.bround(value, 0).cast("bigint") if kind == "int" else value
            df = df.withColumn(target, value)
        else:
            size = metadata.sizes[target]
            if source in metadata.numeric:
                groups = min(8, max(2, size))
                slot = F.least(F.floor(F.col("__u") * groups), F.lit(groups - 1).cast("long"))
                start = F.floor(slot * size / groups)
                stop = F.greatest(F.floor((slot + 1) * size / groups), start + 1)
                pick = start + F.floor(seeded_uniform(salt, *key_columns) * (stop - start))
                df = df.withColumn("__pick", F.least(pick, F.lit(size - 1).cast("long")).cast("int"))
            else:
                df = with_code(df, source, metadata, lists, "__code")
                df = df.withColumn("__pick", F.pmod(F.col("__code"), F.lit(size)).cast("int"))
            df = with_category(df.drop(target), target, "__pick", metadata, lists, shuffle_seed=None if source in metadata.numeric else salt)
        # frozen after each rule: the next one reads the frame several times
        df = freeze(df.select(*[named(c) for c in order]))
    return df


def with_code(df: DataFrame, column: str, metadata: SchemaMetadata, lists: dict[str, list[str]], output: str) -> DataFrame:
    """Position of a category in sorted order; -1 for an unknown one."""
    text = text_of(column, "?")
    if column in lists:
        ids = literal_map({v: i for i, v in enumerate(lists[column])})
        return df.withColumn(output, F.coalesce(lookup(ids, text), F.lit(-1)))
    table = category_codes(metadata, column).select(F.col("value").alias("__value"), F.col("code").alias(output))
    joined = df.withColumn("__text", text).join(table, F.col("__text") == F.col("__value"), "left")
    return joined.withColumn(output, F.coalesce(output, F.lit(-1))).drop("__text", "__value")


def with_category(df: DataFrame, column: str, code: str, metadata: SchemaMetadata, lists: dict[str, list[str]], shuffle_seed: int | None = None) -> DataFrame:
    """Category at a position: a literal for small vocabularies, else a join by position.

    `shuffle_seed` puts the categories in the order of a digest, the same in both ways.
    """
    if column in lists:
        words = lists[column]
        if shuffle_seed is not None:
            words = sorted(words, key=lambda v: (hashlib.md5(f"{shuffle_seed}:{v}".encode()).hexdigest(), v.encode()))
        return df.withColumn(column, F.get(literal_array(words, "string"), F.col(code)))
    values = metadata.categories.filter(F.col("column") == column).withColumn("one", F.lit(1))
    if shuffle_seed is not None:
        values = values.withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(shuffle_seed)), "value").cast("binary")))
    table = running_totals(values, ["column"], ["value"] if shuffle_seed is None else ["__order", "value"], ["one"]).select(
        (F.col("running_one") - 1).cast("int").alias(code), F.col("value").alias(column)
    )
    return df.join(table, code, "left")


# -------------------------------------------------------------- value draws K4-K5
def edges_passed(edges: Column, value: Column, most: int) -> Column:
    """How many of the at most `most` ascending edges are at most the value, by halving; the value is computed once."""
    if not most:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])

    def search(v: Column) -> Column:
        # a place past the last edge is NULL, which is never passed
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(edges, at + step - 1) <= v, step).otherwise(0))

    return F.get(F.transform(F.array(value), search), F.lit(0))


def weighted_category(info: ColumnProfile, seed: int, keys: list[Column], weights: dict[str, float] | None = None) -> Column:
    """K4: a category drawn with its stored or the given weights, tied to the keys."""
    if weights is None and info.tail:
        raise ValueError(f"{info.name} has {info.size - 1} values: draw it with sample_from_profile")
    words = list(weights) if weights is not None else info.vocabulary
    shares = [weights[w] for w in words] if weights is not None else info.weights
    total, running, edges = sum(shares), 0.0, []
    for share in shares[:-1]:
        running += share / total
        edges.append(running)
    place = edges_passed(literal_array(edges), seeded_uniform(seed, *keys), len(edges))
    return F.get(literal_array(words, "string"), place)


def draw_by_share(draws: DataFrame, spans: DataFrame, group: list[str], output: str) -> DataFrame:
    """The value of the interval that holds each row's `__u`, NULL for a group without intervals.

    `spans` has (group, `__from`, value) with the start of every interval in [0, 1).
    Draws and interval starts are merged in one order; the last start is carried on, so
    an interval may hold any number of draws and a group any number of intervals.
    """
    keep = [c for c in draws.columns if c != "__u"]
    kind = spans.schema["value"].dataType
    row = F.struct(*[named(c) for c in keep])
    events = spans.select(
        *group, F.col("__from").alias("__at"), F.lit(0).cast("long").alias("__tie"), F.struct("value").alias("__span"), F.lit(None).cast(draws.select(row).schema[0].dataType).alias("__row")
    ).unionByName(draws.select(
        # never 0, so that the interval that starts at a draw comes before it
        *group, F.col("__u").alias("__at"), (F.xxhash64(*[named(c) for c in keep]).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(2**63 - 1))).alias("__tie"), F.lit(None).cast(f"struct<value:{kind.simpleString()}>").alias("__span"), row.alias("__row")
    ))
    filled = carried(events, group, ["__at", "__tie"], ["__span"]).filter(F.col("__row").isNotNull())
    return filled.select("__row.*", F.col("__span.value").alias(output))


def empirical_sample(df: DataFrame, column: str, ids: DataFrame, keys: list[str], seed: int = 0, output: str = "value") -> DataFrame:
    """K5: for every row of `ids` an observed number, drawn with its frequency.

    A drawn rank is looked up in the rank intervals of the distinct values by one merge
    of both; without observed numbers there are no rows.
    """
    counts = df.select(numeric_of(df, column).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    one = F.lit(1).alias("__all")
    spans = running_totals(counts.select("*", one), ["__all"], ["value"], ["n"]).select("__all", "value", (F.col("running_n") - F.col("n")).alias("__from"))
    ranks = F.floor(seeded_uniform(seed, *[named(k) for k in keys]) * F.lit(total)).cast("bigint")
    drawn = draw_by_share(ids.select("*", one, ranks.alias("__u")), spans, ["__all"], "__drawn").filter(F.col("__drawn").isNotNull())
    return drawn.select(*[named(c) for c in ids.columns], F.col("__drawn").alias(output))


# ------------------------------------------------------- fitted frequencies K6-K7
def slot_of(label: Column, info: ColumnProfile) -> Column:
    """Category id, bin, or for mixed columns bin + 1 with 0 for "zero or missing"."""
    if info.kind == "categorical":
        return label["cat_id"]
    if info.kind == "numerical":
        return label["num_bin"]
    return F.when(label["mixed_bin"] == IGNORE, F.lit(0)).otherwise(label["mixed_bin"] + 1)


def slot_count(info: ColumnProfile) -> int:
    if info.kind == "categorical":
        return info.size or len(info.vocabulary)
    bins = len(info.edges) - 1
    return bins + 1 if info.kind == "mixed" else bins


def slot_value(slot: Column, residual: Column, info: ColumnProfile) -> Column:
    """Value of a slot: the category, or the decoded position inside the bin."""
    if info.kind == "categorical":
        value = F.nullif(decode_category(slot, info), F.lit(UNKNOWN))
    elif info.kind == "numerical":
        value = decode_numeric(slot, residual, info)
    else:
        value = F.when(slot == 0, F.lit(0.0)).otherwise(decode_numeric(slot - 1, residual, info))
    return value.cast("bigint") if info.integer else value


@dataclass
class SlotModel:
    """Frequencies of slots, alone and given the slot of the parent column.

    Lists on the driver are bounded by the profile: at most 101 slots per column and
    101 x 101 per pair.  Columns that have more values than the profile lists, or whose
    parents do, are drawn from the table `counted` (c, p, s, n) instead.
    """

    profile: TableProfile
    parents: dict[str, str | None]
    marginal: dict[str, list[float]]
    conditional: dict[str, dict[int, list[float]]]
    counted: DataFrame | None = None

    def listed(self, column: str) -> bool:
        """Whether the shares of a column, given its parent, are lists on the driver."""
        parent = self.parents[column]
        return not (self.profile.columns[column].tail or parent is not None and self.profile.columns[parent].tail)


def slots(df: DataFrame, profile: TableProfile, keep: list[str] | None = None) -> DataFrame:
    """One integer slot column `__s<i>` per profiled column."""
    labels = encode_labels(df, profile, "__labels", keep=keep or [])
    infos = list(profile.columns.values())
    return labels.select(
        *[named(c) for c in keep or []], *[slot_of(F.get("__labels", F.lit(i)), info).alias(f"__s{i}") for i, info in enumerate(infos)]
    )


def fit_slots(df: DataFrame, profile: TableProfile, parents: dict[str, str | None] | None = None) -> SlotModel:
    """K6/K7: count slots once and pairs (parent slot, slot) once, in a single grouped pass.

    Without `parents` each column depends on the one before it.
    """
    names = list(profile.columns)
    if parents is None:
        parents = {c: (names[i - 1] if i else None) for i, c in enumerate(names)}
    place = {c: i for i, c in enumerate(names)}
    entries = [
        F.struct(
            F.lit(i).alias("c"), (F.col(f"__s{place[parents[c]]}") if parents[c] else F.lit(0)).alias("p"), F.col(f"__s{i}").alias("s")
        )
        for i, c in enumerate(names)
    ]
    counted = slots(df, profile).select(F.explode(F.array(*entries)).alias("e")).groupBy("e.c", "e.p", "e.s").agg(F.count("*").alias("n"))
    counted = freeze(counted)
    narrow = [c for c in names if not profile.columns[c].tail]
    marginal = {c: [0.0] * slot_count(profile.columns[c]) for c in narrow}
    conditional: dict[str, dict[int, list[float]]] = {c: {} for c in narrow}
    model = SlotModel(profile, parents, marginal, conditional, counted)
    listed = [place[c] for c in names if model.listed(c)]
    for row in counted.filter(F.col("c").isin(listed)).collect():  # columns x 101 x 101 rows at most
        c = names[row["c"]]
        marginal[c][row["s"]] += row["n"]
        conditional[c].setdefault(row["p"], [0.0] * slot_count(profile.columns[c]))[row["s"]] += row["n"]
    return model


def sharpened(counts: list[float], temperature: float) -> list[float]:
    """Cumulative shares of p^(1/T); the last one is 1."""
    total = sum(counts)
    if total <= 0:
        counts, total = [1.0] * len(counts), float(len(counts))
    powered = [math.exp(math.log(n / total) / temperature) if n > 0 else 0.0 for n in counts]
    norm, running, shares = sum(powered), 0.0, []
    for p in powered:
        running += p / norm
        shares.append(running)
    return shares


def share_spans(model: SlotModel, column: str, temperature: float, marginal: bool) -> DataFrame:
    """(__group, __from, value) of a column's slots: where each starts in [0, 1), for every parent slot or alone.

    The value of a slot whose column has more values than the profile lists carries its
    text with it.
    """
    info, place = model.profile.columns[column], list(model.profile.columns).index(column)
    rows = model.counted.filter(F.col("c") == place)
    group = F.lit(0) if marginal else F.col("p")
    sums = rows.groupBy(group.alias("__group"), "s").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("__group").agg(F.sum("n").alias("__total"))
    weight = F.col("n") if temperature == 1 else F.exp(F.log(F.col("n") / F.col("__total")) / temperature)
    weighed = sums.join(totals, "__group").select("__group", "s", weight.alias("w"))
    running = running_totals(weighed, ["__group"], ["s"], ["w"])
    whole = weighed.groupBy("__group").agg(F.sum("w").alias("__all"))
    spans = running.join(whole, "__group").select("__group", "s", ((F.col("running_w") - F.col("w")) / F.col("__all")).alias("__from"))
    if not info.tail:
        return spans.select("__group", "__from", F.struct("s", F.lit(None).cast("string").alias("word")).alias("value"))
    words = model.profile.codes(info.name).select(F.col("id").alias("s"), F.col("value").alias("word"))
    return spans.join(words, "s", "left").select("__group", "__from", F.struct("s", "word").alias("value"))


def draw_from_table(df: DataFrame, model: SlotModel, column: str, parent_slot: Column | None, u: Column, temperature: float, output: str) -> DataFrame:
    """Adds `output`, a slot and its text, by merging the rows with the intervals of their parent's slot; an unseen one uses the marginal."""
    rows = df.select("*", u.alias("__u"), F.lit(0).alias("__group"))
    if parent_slot is not None:
        given = df.select("*", u.alias("__u"), F.coalesce(parent_slot, F.lit(-1)).alias("__group"))
        drawn = freeze(draw_by_share(given, share_spans(model, column, temperature, False), ["__group"], output))
        found = drawn.filter(F.col(output).isNotNull()).select(*df.columns, output)
        rest = drawn.filter(F.col(output).isNull()).select(*df.columns, u.alias("__u"), F.lit(0).alias("__group"))
        if rest.isEmpty():
            return found
        return found.unionByName(draw_by_share(rest, share_spans(model, column, temperature, True), ["__group"], output).select(*df.columns, output))
    return draw_by_share(rows, share_spans(model, column, temperature, True), ["__group"], output).select(*df.columns, output)


def sample_from_profile(ids: DataFrame, model: SlotModel, seed: int = 0, temperature: float = 1.0, key: str = ID) -> DataFrame:
    """K6: every column drawn on its own from its fitted slot frequencies."""
    infos = list(model.profile.columns.values())
    tables = [i for i, c in enumerate(model.profile.columns) if not model.listed(c)]
    rows = ids
    for i in tables:
        rows = draw_from_table(rows, model, list(model.profile.columns)[i], None, seeded_uniform(seed * 2003 + i, named(key)), temperature, f"__t{i}")
    searches = {
        f"__s{i}": (seeded_uniform(seed * 2003 + i, named(key)), sharpened(model.marginal[c], temperature)[:-1], True)
        for i, c in enumerate(model.profile.columns) if i not in tables
    }
    drawn = with_edge_counts(rows, searches)
    residual = [seeded_uniform(seed * 2003 + 1000 + i, named(key)) for i in range(len(infos))]
    return drawn.select(
        *[named(c) for c in ids.columns],
        *[drawn_value(i, info, residual[i], i in tables).alias(info.name) for i, info in enumerate(infos)],
    )


def drawn_value(i: int, info: ColumnProfile, residual: Column, from_table: bool) -> Column:
    """The value of a drawn slot, listed (`__s<i>`) or from a table (`__t<i>`)."""
    if info.tail:
        return F.col(f"__t{i}.word")
    return slot_value(F.col(f"__t{i}.s") if from_table else F.col(f"__s{i}"), residual, info)


def conditional_table(spark: SparkSession, model: SlotModel, column: str, temperature: float, output: str) -> DataFrame:
    """Parent slot -> cumulative shares; at most 101 rows."""
    rows = [(p, sharpened(counts, temperature)[:-1]) for p, counts in model.conditional[column].items()]
    return spark.createDataFrame(rows, f"__parent int, {output} array<double>")


def draw_slot(df: DataFrame, model: SlotModel, index: int, column: str, seed: int, key: str, temperature: float, output: str) -> DataFrame:
    """K7 step: draw the slot of a column given its parent's slot; an unseen parent slot uses the marginal.

    The slot of a column that is drawn from a table is `<output>`, its text `__t<index>`.
    """
    parent = model.parents[column]
    u = seeded_uniform(seed * 2003 + index, named(key))
    if not model.listed(column):
        slot = None if parent is None else F.col(f"__s{list(model.profile.columns).index(parent)}")
        drawn = draw_from_table(df.drop(f"__t{index}"), model, column, slot, u, temperature, f"__t{index}")
        return drawn.withColumn(output, F.col(f"__t{index}.s"))
    base = literal_array(sharpened(model.marginal[column], temperature)[:-1])
    if parent is None:
        shares = base
        joined = df
    else:
        names = list(model.profile.columns)
        table = conditional_table(df.sparkSession, model, column, temperature, "__shares")
        joined = df.join(F.broadcast(table), F.col(f"__s{names.index(parent)}") == F.col("__parent"), "left")
        shares = F.coalesce("__shares", base)
    most = max(len(counts) for counts in [model.marginal[column], *model.conditional[column].values()]) - 1
    drawn = joined.withColumn(output, edges_passed(shares, u, most))
    return drawn.drop("__parent", "__shares")


def sequential_generate(ids: DataFrame, model: SlotModel, seed: int = 0, temperature: float = 1.0, key: str = ID) -> DataFrame:
    """K7: columns drawn one after the other, each given its parent's slot in the same row."""
    infos = list(model.profile.columns.values())
    rows = ids
    for i, c in enumerate(model.profile.columns):
        rows = draw_slot(rows, model, i, c, seed, key, temperature, f"__s{i}")
    # columns of their own, as a value names its residual several times
    rows = rows.select("*", *[seeded_uniform(seed * 2003 + 1000 + i, named(key)).alias(f"__r{i}") for i, info in enumerate(infos) if info.kind != "categorical"])
    return rows.select(
        *[named(c) for c in ids.columns],
        *[drawn_value(i, info, F.col(f"__r{i}"), info.tail).alias(info.name) for i, info in enumerate(infos)],
    )


# ------------------------------------------------------------ rejection loops K8-K9
def generate_until(
    spark: SparkSession, n: int, make: Callable[[DataFrame, int], DataFrame], accept: Callable[[DataFrame], DataFrame],
    key: str = ID, first_guess: float = 1.0, max_rounds: int = 20, seed: int = 0,
) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """K8: generate batches until `n` rows are accepted; returns (raw, accepted, log).

    `make(ids, round)` produces one row per id and `accept` keeps the valid ones.
    The next batch is sized by the acceptance seen so far.  Batches are frozen, so a
    lost executor cannot change rows that were already counted.  Only the last batch
    is cut, by a seeded hash of its ids.
    """
    raw, kept, log = None, None, []
    sampled = accepted = 0
    for attempt in range(max_rounds):
        rate = accepted / sampled if accepted else first_guess
        size = max(1, math.ceil((n - accepted) / max(rate, 1e-3) * 1.1))
        ids = spark.range(sampled, sampled + size).withColumnRenamed("id", key)
        batch = freeze(make(ids, attempt))
        good = freeze(accept(batch))
        count = good.count()
        if accepted + count > n:
            good = freeze(cut_by_hash(good, [key], seed, lambda size, need=n - accepted: [("keep", F.lit(need))], output="__keep").drop("__keep"))
            count = n - accepted
        sampled, accepted = sampled + size, accepted + count
        raw = batch if raw is None else raw.unionByName(batch)
        kept = good if kept is None else kept.unionByName(good)
        log.append((sampled, accepted, n))
        if accepted >= n:
            return raw, kept, log
    raise RuntimeError(f"{accepted} of {n} rows after {max_rounds} rounds")


def impute_rows(
    df: DataFrame, model: SlotModel, key: str, seed: int = 0, max_retries: int = 5, temperature: float = 1.0
) -> tuple[DataFrame, int]:
    """K9: fill missing cells by draws given the parent's cell; rows still incomplete after the retries leave.

    Present cells never change and a row keeps its key.  Returns the rows and the number
    of row retries.
    """
    names = [info.name for info in model.profile.columns.values()]
    infos = list(model.profile.columns.values())
    missing = F.lit(False)
    for c in names:
        missing = missing | named(c).isNull()
    complete, open_rows = df.filter(~missing), freeze(df.filter(missing))
    done, retries = complete, 0
    for attempt in range(max_retries):
        waiting = open_rows.count()
        if not waiting:
            break
        retries += waiting
        rows = slots(open_rows, model.profile, keep=df.columns)
        for i, (c, info) in enumerate(zip(model.profile.columns, infos)):
            step = seed * 101 + attempt * 13
            rows = draw_slot(rows, model, i, c, step, key, temperature, "__drawn")
            hole = named(info.name).isNull()
            value = F.col(f"__t{i}.word") if info.tail else slot_value(F.col("__drawn"), seeded_uniform(step * 2003 + 1000 + i, named(key)), info)
            rows = rows.withColumn(f"__s{i}", F.when(hole, F.col("__drawn")).otherwise(F.col(f"__s{i}")))
            rows = rows.withColumn(info.name, F.coalesce(named(info.name), value.cast(df.schema[info.name].dataType))).drop("__drawn")
        rows = freeze(rows.select(*[named(c) for c in df.columns]))
        done = done.unionByName(rows.filter(~missing))
        open_rows = rows.filter(missing)
    return done, retries


# ------------------------------------------------------------------- splits K10-K15
def stratified_split(df: DataFrame, keys: list[str], target: str, test_share: float = 0.2, valid_share: float = 0.1, seed: int = 0) -> DataFrame:
    """Label every row train, val or test; exact sizes overall, class shares as even as possible.

    ceil(test_share n) rows go to test, ceil(valid_share rest) of the rest to val.  Classes
    get their floor, and the rows left over go to the largest remainders.  A single class
    is a plain split.
    """
    label = F.coalesce(named(target).cast("string"), F.lit("\u0000"))
    classes = freeze(df.groupBy(label.alias("__s0")).agg(F.count("*").alias("size")))
    total = classes.agg(F.sum("size")).first()[0] or 0
    test = math.ceil(round(test_share * total, 9))
    valid = math.ceil(round(valid_share * (total - test), 9))

    def apportion(table: DataFrame, size: str, goal: int, output: str) -> DataFrame:
        base = table.agg(F.sum(size).alias("n")).first()["n"] or 1
        exact = F.col(size) * F.lit(goal / base)
        floors = table.withColumn("__floor", F.floor(exact)).withColumn("__rest", -F.round(exact - F.floor(exact), 9)).withColumn("__one", F.lit(1)).withColumn("__all", F.lit(1))
        short = goal - (floors.agg(F.sum("__floor")).first()[0] or 0)
        ranked = running_totals(floors, ["__all"], ["__rest", "__s0"], ["__one"])
        return ranked.select(*table.columns, (F.col("__floor") + (F.col("running___one") <= short).cast("long")).alias(output))

    sized = freeze(apportion(classes, "size", test, "__end_test"))
    sized = sized.withColumn("__left", F.col("size") - F.col("__end_test"))
    sized = apportion(sized, "__left", valid, "__valid")
    ends = freeze(sized).select("__s0", "__end_test", (F.col("__end_test") + F.col("__valid")).alias("__end_val"), F.col("size").alias("__end_train"))
    return cut_by_hash(df, keys, seed, lambda n: [], strata=[target], sizes=ends)


def split_metadata(parts: DataFrame, target: str) -> DataFrame:
    """Sizes and label shares per part and overall, one document."""
    per = parts.groupBy("part", named(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    whole = per.groupBy(F.lit("total").alias("part"), "label").agg(F.sum("n").alias("n"))
    counts = per.unionByName(whole)
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))
    return counts.join(F.broadcast(sizes), "part").select("part", "label", "n", "size", (F.col("n") / F.col("size")).alias("share"))


def split_by_seed(df: DataFrame, keys: list[str], train: int, valid: int, seeds: list[int]) -> DataFrame:
    """Per seed a train subset, a validation subset (the rest if smaller) and the remaining test rows.

    A seed is a stratum of the rows repeated for each, so one histogram holds the cuts of
    all seeds.
    """
    repeated = df.withColumn("seed", F.explode(F.array(*[F.lit(seed) for seed in seeds])))
    return cut_by_hash(
        repeated, [*keys, "seed"], 0,
        lambda n: [("train", F.least(n, F.lit(train))), ("valid", F.least(n, F.lit(train + valid))), ("test", n)], strata=["seed"],
    )


def demo_sample(df: DataFrame, keys: list[str], n: int = 100, seed: int = 0) -> DataFrame:
    """N seeded random rows."""
    return cut_by_hash(df, keys, seed, lambda size: [("keep", F.least(size, F.lit(n)))], output="__keep").drop("__keep")


def seeded_order(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """A seeded permutation of the rows."""
    return df.orderBy(seeded_hash(seed, *[named(k) for k in keys]), *[named(k) for k in keys])

"""Discretisers and joint-distribution distances."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.binning import open_ended_search, quantile_search, right_closed_bin, right_closed_index, with_edge_counts
from veritab.functions.scalars import literal_array, literal_map, lookup, missing_text, named, numeric_of
from veritab.operators.marginals import fit_ranges
from veritab.operators.ranks import exact_quantiles, running_totals
from veritab.operators.sides import FAKE, REAL, SIDE, ColumnTypes, data_columns, melt, on_side, text_of, types_by_dtype, types_by_parsing
from veritab.session import freeze

SUBSETS_PER_SCAN = 64
LITERAL_VOCABULARY = 1000
DROPPED_TEXT, DROPPED_CODE = "\u0000drop", -9


# --------------------------------------------------------------------- subsets
def subset_at(rank: int, size: int, k: int) -> tuple[int, ...]:
    """The k-subset of range(size) with a place in lexicographic order."""
    picked, candidate = [], 0
    while len(picked) < k:
        following = math.comb(size - candidate - 1, k - len(picked) - 1)  # subsets that go on with the candidate
        if rank < following:
            picked.append(candidate)
        else:
            rank -= following
        candidate += 1
    return tuple(picked)


def choose_subsets(columns: list[str], k: int, limit: int | None = None, seed: int = 0) -> list[tuple[str, ...]]:
    """All k-subsets of the columns, or, if the caller states a limit, so many drawn without repetition.

    Ranks are drawn and turned into subsets; this handles column names, never data.
    """
    total = math.comb(len(columns), k)
    ranks = range(total) if limit is None or limit >= total else sorted(random.Random(seed).sample(range(total), limit))
    return [tuple(columns[i] for i in subset_at(rank, len(columns), k)) for rank in ranks]


# ---------------------------------------------------------------- joint counts
def joint_counts(codes: DataFrame, subsets: list[tuple[str, ...]]) -> DataFrame:
    """D3: (subset, n_real, n_fake) per distinct code tuple of each column subset.

    Codes must not be NULL.  A batch of subsets is one GROUPING SETS pass.
    """
    names = sorted({c for subset in subsets for c in subset})
    parts = []
    for start in range(0, len(subsets), SUBSETS_PER_SCAN):
        batch = subsets[start:start + SUBSETS_PER_SCAN]
        used = [c for c in names if any(c in subset for subset in batch)]
        real, fake = F.count_if(on_side(REAL)), F.count_if(on_side(FAKE))
        grouped = codes.groupingSets(
            [[named(c) for c in subset] for subset in batch], *[named(c) for c in used]
        ).agg(F.grouping_id().alias("gid"), real.alias("n_real"), fake.alias("n_fake"))
        mask = {
            sum(1 << (len(used) - 1 - i) for i, c in enumerate(used) if c not in subset): start + offset
            for offset, subset in enumerate(batch)
        }
        subset_id = F.element_at(literal_map(mask, "bigint", "int"), F.col("gid"))
        parts.append(grouped.select(subset_id.alias("subset"), *[named(c) for c in used], "n_real", "n_fake"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def lattice_counts(codes: DataFrame, subsets: list[tuple[str, ...]]) -> DataFrame:
    """`joint_counts` of all subsets with the rows read for the largest ones only.

    Subsets that no other one contains are counted from the rows.  Any other is rolled
    up from the cells of a counted subset that contains it, the one with the fewest, a
    size at a time; each size is stored, so that no cell is counted twice.
    """
    members = [frozenset(subset) for subset in subsets]
    top = [i for i, own in enumerate(members) if not any(own < other for other in members)]
    names = sorted({c for subset in subsets for c in subset})

    def stored(table: DataFrame) -> DataFrame:
        return freeze(table.select("subset", *[named(c) if c in table.columns else F.lit(None).cast(codes.schema[c].dataType).alias(c) for c in names], "n_real", "n_fake"))

    ids = literal_map(dict(enumerate(top)), "int", "int")
    tables = [stored(joint_counts(codes, [subsets[i] for i in top]).withColumn("subset", F.element_at(ids, F.col("subset"))))]
    cells = dict.fromkeys(top, 0)
    rest = sorted(set(range(len(subsets))) - set(top), key=lambda i: -len(members[i]))
    for size in sorted({len(members[i]) for i in rest}, reverse=True):
        cells |= {r["subset"]: r["count"] for r in tables[-1].groupBy("subset").count().collect()}  # one row a subset
        children: dict[int, list[int]] = {}
        for i in rest:
            if len(members[i]) == size:
                children.setdefault(min((p for p in cells if members[i] < members[p]), key=lambda p: (cells[p], p)), []).append(i)
        counted = tables[0]
        for table in tables[1:]:
            counted = counted.unionByName(table)
        lists = F.map_from_arrays(literal_array(children, "int"), F.array(*[literal_array(c, "int") for c in children.values()]))
        source = counted.filter(F.col("subset").isin(list(children))).withColumn("__child", F.explode(F.element_at(lists, F.col("subset"))))
        made = [i for own in children.values() for i in own]
        kept = [F.when(F.col("__child").isin([i for i in made if c in members[i]]), named(c)).alias(c) if any(c in members[i] for i in made) else F.lit(None).cast(codes.schema[c].dataType).alias(c) for c in names]
        rolled = source.select(F.col("__child").alias("subset"), *kept, "n_real", "n_fake").groupBy("subset", *[named(c) for c in names])
        tables.append(stored(rolled.agg(F.sum("n_real").alias("n_real"), F.sum("n_fake").alias("n_fake"))))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def subset_distances(codes: DataFrame, subsets: list[tuple[str, ...]], drop_code: bool = False) -> DataFrame:
    """Total variation distance per subset: (subset, k, columns, tvd).

    With `drop_code`, tuples holding a dropped code leave both the counts and the totals
    of their subset.
    """
    columns = sorted({c for subset in subsets for c in subset})
    counts = lattice_counts(codes, subsets)
    if drop_code:
        kinds = dict(counts.dtypes)
        marked = F.lit(False)
        for c in columns:
            dropped = F.lit(DROPPED_TEXT) if kinds[c] == "string" else F.lit(DROPPED_CODE).cast(kinds[c])
            marked = marked | F.coalesce(named(c) == dropped, F.lit(False))
        counts = counts.filter(~marked)
    counts = counts.select("subset", "n_real", "n_fake")
    totals = counts.groupBy("subset").agg(F.sum("n_real").alias("t_real"), F.sum("n_fake").alias("t_fake"))
    one = F.lit(1).cast("long")
    gap = F.abs(
        F.col("n_real") / F.greatest("t_real", one) - F.col("n_fake") / F.greatest("t_fake", one)
    )
    distances = (
        counts.join(F.broadcast(totals), "subset")  # one row per subset, at most a few thousand
        .groupBy("subset").agg((F.sum(gap) / 2).alias("tvd"))
    )
    labels = literal_map({i: ",".join(s) for i, s in enumerate(subsets)}, "int", "string")
    sizes = literal_map({i: len(s) for i, s in enumerate(subsets)}, "int", "int")
    return distances.select(
        F.element_at(sizes, F.col("subset")).alias("k"), F.element_at(labels, F.col("subset")).alias("columns"), "tvd"
    )


# ------------------------------------------------------- pairwise similarity H9
def cut_codes(pair: DataFrame, types: ColumnTypes, bins: int | None, null_policy: str = "asymmetric") -> DataFrame:
    """Equal-width codes over the real range.

    `asymmetric` (Q3): outside or NULL drops a real value and puts a fake one into
    the first bin.  `drop`: both are dropped.  A NULL category is always dropped.
    `bins` None keeps every distinct number as its own code.
    """
    ranges = fit_ranges(pair.filter(on_side(REAL)), types.numeric) if bins is not None else {}
    codes = []
    for name in types.numeric:
        value = numeric_of(pair, name)
        if bins is None:
            codes.append(F.coalesce(value.cast("string"), F.lit(DROPPED_TEXT)).alias(name))
            continue
        code = right_closed_bin(value, *ranges[name], bins)
        if null_policy == "asymmetric":
            code = F.coalesce(code, F.when(on_side(FAKE), 0))
        codes.append(F.coalesce(code, F.lit(DROPPED_CODE)).alias(name))
    for name in types.categorical:
        codes.append(F.coalesce(named(name).cast("string"), F.lit(DROPPED_TEXT)).alias(name))
    return pair.select(SIDE, *codes)


def pair_similarities(pair: DataFrame, types: ColumnTypes | None = None, bins: int | None = 50,
                      null_policy: str = "asymmetric") -> DataFrame:
    """1 - total variation distance for every pair of columns."""
    types = types or types_by_dtype(pair)
    wanted = set(types.numeric) | set(types.categorical)
    order = [c for c in data_columns(pair) if c in wanted]
    distances = subset_distances(
        cut_codes(pair, types, bins, null_policy), list(combinations(order, 2)), drop_code=True
    )
    return distances.select("columns", (1 - F.col("tvd")).alias("similarity"))


def pairwise_similarity(pair: DataFrame, **options) -> DataFrame:
    """H9: mean similarity over all pairs."""
    return pair_similarities(pair, **options).agg(F.avg("similarity").alias("score")).select(
        "score", F.col("score").alias("normalized_score"), F.lit("pairwise_similarity").alias("metric")
    )


# ------------------------------------------------------- aligned discretiser I4
def aligned_codes(pair: DataFrame, pieces: int = 10, types: ColumnTypes | None = None) -> DataFrame:
    """I4: codes from deduplicated quantile edges of the real side.

    Columns reading as numbers in more than 80 % of the real rows are binned
    right-closed; outside or unreadable is -1.  Fewer than two edges make the
    column categorical.  The code of a category is its cleaned text.
    """
    real = pair.filter(on_side(REAL)).drop(SIDE)
    types = types or types_by_parsing(real, threshold=0.8, strict=True)
    edges = exact_quantiles(real, {c: numeric_of(real, c) for c in types.numeric}, pieces)
    names = [*types.numeric, *types.categorical]
    searches, texts = {}, []
    for name in names:
        distinct = sorted(set(edges.get(name, [])))
        if len(distinct) >= 2:
            searches[f"__code_{name}"] = quantile_search(numeric_of(pair, name), distinct)
        else:
            texts.append(missing_text(named(name), pair.schema[name].dataType).alias(f"__code_{name}"))
    found = with_edge_counts(pair.select("*", *texts), searches)
    return found.select(
        SIDE,
        *[
            (right_closed_index(named(f"__code_{c}"), len(searches[f"__code_{c}"][1])) if f"__code_{c}" in searches
             else named(f"__code_{c}")).alias(c)
            for c in names
        ],
    )


def kway_aligned(
    pair: DataFrame, ks: list[int], pieces: int = 10, limit: int | None = None, seed: int = 0,
    types: ColumnTypes | None = None, subsets: list[tuple[str, ...]] | None = None,
) -> DataFrame:
    """Mean and population standard deviation of the k-column distances."""
    codes = aligned_codes(pair, pieces, types)
    columns = data_columns(codes)
    chosen = subsets or [s for k in ks for s in choose_subsets(columns, k, limit, seed)]
    return subset_distances(codes, chosen).groupBy("k").agg(
        F.avg("tvd").alias("tvd_mean"), F.stddev_pop("tvd").alias("tvd_std"), F.count("*").alias("subsets")
    )


# -------------------------------------------------------- fitted discretiser I5
@dataclass
class QuantileEncoder:
    """Edges and vocabularies learnt from a fit table.

    A vocabulary of up to LITERAL_VOCABULARY values is kept as a list; a larger one
    stays a DataFrame (value, id) and is joined.
    """

    edges: dict[str, list[float]]
    vocabulary: dict[str, list[str]]
    large: dict[str, DataFrame] = field(default_factory=dict)


def fit_encoder(fit: DataFrame, types: ColumnTypes, pieces: int = 20, null_text: str = "__NA__") -> QuantileEncoder:
    """Quantile edges and sorted vocabularies of the fit table (three small results)."""
    edges = exact_quantiles(fit, {c: numeric_of(fit, c) for c in types.numeric}, pieces)
    edges = {c: sorted(set(v)) if len(set(v)) >= 2 else [-math.inf, math.inf] for c, v in edges.items()}
    encoder = QuantileEncoder(edges, {})
    if not types.categorical:
        return encoder
    values = melt(fit, {c: text_of(c, null_text) for c in types.categorical}, []).distinct()
    sizes = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    small = [c for c in types.categorical if sizes.get(c, 0) <= LITERAL_VOCABULARY]
    for c in small:
        encoder.vocabulary[c] = []
    for row in values.filter(F.col("column").isin(small)).collect():
        encoder.vocabulary[row["column"]].append(row["value"])
    for c in small:
        encoder.vocabulary[c].sort(key=lambda text: text.encode())
    for c in set(types.categorical) - set(small):
        table = running_totals(
            values.filter(F.col("column") == c).withColumn("one", F.lit(1)), ["column"], ["value"], ["one"]
        )
        encoder.large[c] = table.select("value", F.col("running_one").cast("int").alias("id"))
    return encoder


def encode_quantiles(df: DataFrame, encoder: QuantileEncoder, keep: list[str], null_text: str = "__NA__") -> DataFrame:
    """Integer codes; a category unseen in the fit table is 0."""
    found = with_edge_counts(df, {f"__code_{c}": open_ended_search(numeric_of(df, c), e) for c, e in encoder.edges.items()})
    codes = [F.coalesce(named(f"__code_{c}"), F.lit(0)).alias(c) for c in encoder.edges]
    for c, values in encoder.vocabulary.items():
        ids = literal_map({v: i for i, v in enumerate(values, start=1)})
        codes.append(F.coalesce(lookup(ids, text_of(c, null_text)), F.lit(0)).alias(c))
    if not encoder.large:
        return found.select(*keep, *codes)
    texts = [text_of(c, null_text).alias(f"__text_{c}") for c in encoder.large]
    coded = found.select(*keep, *codes, *texts)
    for c, table in encoder.large.items():
        side = table.select(F.col("value").alias(f"__value_{c}"), F.col("id").alias(f"__id_{c}"))
        coded = coded.join(side, named(f"__text_{c}") == named(f"__value_{c}"), "left")
    done = [*encoder.edges, *encoder.vocabulary]
    return coded.select(
        *keep, *[named(c) for c in done],
        *[F.coalesce(named(f"__id_{c}"), F.lit(0)).alias(c) for c in encoder.large],
    )


def kway_fitted(
    pair: DataFrame, fit: DataFrame, ks: list[int], target: str | None = None, pieces: int = 20, limit: int | None = None,
    seed: int = 0, types: ColumnTypes | None = None, subsets: list[tuple[str, ...]] | None = None,
) -> DataFrame:
    """Mean and sample standard deviation (0 for one subset) of the k-column distances."""
    types = types or types_by_parsing(fit, target)
    codes = encode_quantiles(pair, fit_encoder(fit, types, pieces), [SIDE])
    columns = [*types.numeric, *types.categorical]
    chosen = subsets or [s for k in ks for s in choose_subsets(columns, k, limit, seed)]
    return subset_distances(codes, chosen).groupBy("k").agg(
        F.avg("tvd").alias("tvd_mean"),
        F.coalesce(F.stddev_samp("tvd"), F.lit(0.0)).alias("tvd_std"),
        F.count("*").alias("subsets"),
    )

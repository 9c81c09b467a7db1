"""Association coefficients from aggregates (J1-J4) and their comparison."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import numeric_of
from veritab.operators.sides import FAKE, REAL, SIDE, ColumnTypes, melt, text_of, types_by_dtype

NULL_CATEGORY = "__NA__"
PAIRS_PER_AGGREGATE = 200


def coefficient_frame(contingency: DataFrame, keys: list[str], *kinds: str) -> DataFrame:
    """Cramer's V (bias-corrected) and Theil's U(a|b) per key from cell counts (a, b, n).

    Marginal counts come from the same cell table; a value met by very many
    partners is split by the adaptive skew join.  One coefficient row per key.
    """
    by_a = contingency.groupBy(*keys, "a").agg(F.sum("n").alias("n_a"))
    by_b = contingency.groupBy(*keys, "b").agg(F.sum("n").alias("n_b"))
    totals = by_a.groupBy(*keys).agg(
        F.sum("n_a").alias("total"), F.count("*").alias("r"), F.sum(F.col("n_a") * F.log("n_a")).alias("a_log")
    )
    columns_of_b = by_b.groupBy(*keys).agg(F.count("*").alias("k"))
    cells = contingency.join(by_b, [*keys, "b"])
    if "cramers_v" in kinds:
        cells = cells.join(by_a, [*keys, "a"])
        square = F.sum(F.col("n").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    else:
        square = F.lit(None).cast("double")
    sums = cells.groupBy(*keys).agg(
        square.alias("square") if "cramers_v" in kinds else F.max(square).alias("square"),
        F.sum(F.col("n") * F.log(F.col("n") / F.col("n_b"))).alias("cond_log"),
    )
    joined = sums.join(totals, keys).join(columns_of_b, keys)
    n = F.col("total").cast("double")
    r, k = F.col("r").cast("double"), F.col("k").cast("double")
    phi2 = F.col("square") - 1
    shrunk = F.greatest(F.lit(0.0), phi2 - (k - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0)))
    r_fit = r - (r - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0))
    k_fit = k - (k - 1) * (k - 1) / F.nullif(n - 1, F.lit(0.0))
    span = F.least(r_fit, k_fit) - 1
    cramers_v = F.when((r < 2) | (k < 2) | (span <= 0), 0.0).otherwise(
        F.sqrt(shrunk / F.nullif(span, F.lit(0.0)))
    )
    entropy = F.log(n) - F.col("a_log") / n
    conditional = -F.col("cond_log") / n
    theils_u = F.when(r < 2, 1.0).otherwise((entropy - conditional) / F.nullif(entropy, F.lit(0.0)))
    values = {"cramers_v": cramers_v, "theils_u": theils_u}
    return joined.select(*keys, *[values[kind].alias(kind) for kind in kinds])


def _side_column(df: DataFrame) -> DataFrame:
    return df if SIDE in df.columns else df.withColumn(SIDE, F.lit(REAL))


def pearson_pairs(df: DataFrame, numeric: list[str]) -> DataFrame:
    """R of every numeric pair, per side, NULL counting as 0.  Constant columns give 0."""
    tagged = _side_column(df)
    values = {c: F.coalesce(numeric_of(tagged, c), F.lit(0.0)) for c in numeric}
    narrow = tagged.select(SIDE, *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    index = {c: f"v{i}" for i, c in enumerate(numeric)}
    pairs = list(combinations(numeric, 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        chunk = pairs[start:start + PAIRS_PER_AGGREGATE]
        wide = narrow.groupBy(SIDE).agg(
            *[F.corr(index[a], index[b]).alias(f"r{i}") for i, (a, b) in enumerate(chunk)]
        )
        entries = [
            F.struct(
                F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit("pearson").alias("kind"),
                F.coalesce(F.nanvl(F.col(f"r{i}"), F.lit(0.0)), F.lit(0.0)).alias("value"),
            )
            for i, (a, b) in enumerate(chunk)
        ]
        parts.append(wide.select(SIDE, F.explode(F.array(*entries)).alias("e")).select(SIDE, "e.*"))
    return _union(parts)


def correlation_ratios(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Eta of every (categorical, numeric) pair, per side, in one grouped pass.

    Columns are centred on their overall mean first, which keeps the sums of
    squares free of cancellation.
    """
    tagged = _side_column(df)
    values = [F.coalesce(numeric_of(tagged, c), F.lit(0.0)) for c in numeric]
    wide = tagged.groupBy(SIDE).agg(
        F.count("*").alias("rows"),
        *[F.avg(v).alias(f"mean{i}") for i, v in enumerate(values)],
        *[F.var_pop(v).alias(f"var{i}") for i, v in enumerate(values)],
    )
    numbers = [v.alias(f"y{i}") for i, v in enumerate(values)]
    cells = {c: text_of(c, NULL_CATEGORY) for c in categorical}
    groups = melt(tagged, cells, [F.col(SIDE), *numbers], name="col_a").groupBy(SIDE, "col_a", "value").agg(
        F.count("*").alias("n"), *[F.avg(f"y{i}").alias(f"m{i}") for i in range(len(numeric))]
    )
    joined = groups.join(F.broadcast(wide), SIDE)  # one row per side
    between = joined.groupBy(SIDE, "col_a").agg(
        *[F.sum(F.col("n") * F.pow(F.col(f"m{i}") - F.col(f"mean{i}"), 2)).alias(f"b{i}") for i in range(len(numeric))],
        *[F.max(F.col("rows") * F.col(f"var{i}")).alias(f"t{i}") for i in range(len(numeric))],
    )
    entries = [
        F.struct(
            F.lit(c).alias("col_b"), F.lit("correlation_ratio").alias("kind"),
            F.when(F.col(f"t{i}") > 0, F.sqrt(F.least(F.col(f"b{i}") / F.col(f"t{i}"), F.lit(1.0))))
            .otherwise(0.0).alias("value"),
        )
        for i, c in enumerate(numeric)
    ]
    return between.select(SIDE, "col_a", F.explode(F.array(*entries)).alias("e")).select(SIDE, "col_a", "e.*")


def categorical_pairs(df: DataFrame, categorical: list[str], kind: str) -> DataFrame:
    """J3/J4 of every categorical pair, per side; Theil's U in both directions."""
    tagged = _side_column(df)
    text = {c: text_of(c, NULL_CATEGORY) for c in categorical}
    if kind == "theils_u":
        pairs = [(a, b) for a in categorical for b in categorical if a != b]
    else:
        pairs = list(combinations(categorical, 2))
    entries = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), text[a].alias("a"), text[b].alias("b"))
        for a, b in pairs
    ]
    keys = [SIDE, "col_a", "col_b"]
    cells = (
        tagged.select(SIDE, F.explode(F.array(*entries)).alias("e"))
        .groupBy(SIDE, "e.col_a", "e.col_b", "e.a", "e.b").agg(F.count("*").alias("n"))
    )
    return coefficient_frame(cells, keys, kind).select(*keys, F.lit(kind).alias("kind"), F.col(kind).alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def association_matrix(df: DataFrame, types: ColumnTypes | None = None, nominal: str = "cramer") -> DataFrame:
    """Full long matrix (side, col_a, col_b, kind, value), diagonal 1, both triangles."""
    types = types or types_by_dtype(df)
    tagged = _side_column(df)
    kind = {"cramer": "cramers_v", "theil": "theils_u"}[nominal]
    mirrored, directed = [], []
    if len(types.numeric) > 1:
        mirrored.append(pearson_pairs(tagged, types.numeric))
    if types.numeric and types.categorical:
        mirrored.append(correlation_ratios(tagged, types.categorical, types.numeric))
    if len(types.categorical) > 1:
        part = categorical_pairs(tagged, types.categorical, kind)
        (mirrored if kind == "cramers_v" else directed).append(part)
    columns = [SIDE, "col_a", "col_b", "kind", "value"]
    parts = [p.select(columns) for p in directed]
    for part in mirrored:
        both = F.array(
            F.struct(F.col("col_a").alias("x"), F.col("col_b").alias("y")),
            F.struct(F.col("col_b").alias("x"), F.col("col_a").alias("y")),
        )
        parts.append(
            part.select(SIDE, F.explode(both).alias("p"), "kind", "value").select(
                SIDE, F.col("p.x").alias("col_a"), F.col("p.y").alias("col_b"), "kind", "value"
            )
        )
    names = [*types.numeric, *types.categorical]
    diagonal = [
        F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit("self").alias("kind"), F.lit(1.0).alias("value"))
        for c in names
    ]
    sides = tagged.groupBy(SIDE).agg(F.count("*").alias("rows"))
    parts.append(sides.select(SIDE, F.explode(F.array(*diagonal)).alias("e")).select(SIDE, "e.*"))
    return _union(parts)


def compared_matrix(pair: DataFrame, types: ColumnTypes | None = None, nominal: str = "cramer") -> DataFrame:
    """Both matrices side by side: (col_a, col_b, value_real, value_fake)."""
    matrix = association_matrix(pair, types, nominal)
    return matrix.groupBy("col_a", "col_b").agg(
        F.max(F.when(F.col(SIDE) == REAL, F.col("value"))).alias("value_real"),
        F.max(F.when(F.col(SIDE) == FAKE, F.col("value"))).alias("value_fake"),
    )


def associations_difference(
    pair: DataFrame, types: ColumnTypes | None = None, nominal: str = "cramer", per_column: bool = True
) -> DataFrame:
    """Mean absolute difference of the matrices, per column or overall."""
    compared = compared_matrix(pair, types, nominal)
    gap = F.avg(F.abs(F.col("value_real") - F.col("value_fake")))
    if per_column:
        result = compared.groupBy(F.col("col_b").alias("column")).agg(gap.alias("score"))
    else:
        per = compared.groupBy("col_b").agg(gap.alias("gap"))
        result = per.agg(F.avg("gap").alias("score"))
    return result.select("*", F.col("score").alias("normalized_score"), F.lit("associations_difference").alias("metric"))


def strength_level(value: Column) -> Column:
    """Q4: absolute value to a level; an undefined value counts as strong."""
    size = F.abs(value)
    return F.when(size < 0.1, "low").when(size < 0.3, "weak").when(size < 0.5, "middle").otherwise("strong")


def correlation_accuracy(pair: DataFrame, types: ColumnTypes | None = None, nominal: str = "cramer") -> DataFrame:
    """Share of matrix cells (diagonal included) with the same level on both sides."""
    compared = compared_matrix(pair, types, nominal)
    same = (strength_level(F.col("value_real")) == strength_level(F.col("value_fake"))).cast("int")
    return compared.agg(F.avg(same).alias("score")).select(
        "score", F.col("score").alias("normalized_score"), F.lit("correlation_accuracy").alias("metric")
    )

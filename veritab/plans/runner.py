"""Metric runs that produce ledger rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators import aggregates, associations, efficacy, kway, marginals, overlap
from veritab.operators.ranks import equalize
from veritab.operators.sides import FAKE, REAL, SIDE, ColumnTypes, align_columns, align_types, types_by_dtype
from veritab.sources.ledger import conform

METRICS = ["histogram_intersection", "efficacy_test", "exact_duplicates", "correlation_accuracy", "pairwise_similarity"]


@dataclass
class Tables:
    """Train, test and synthetic table of one evaluation with the names they are recorded under."""

    train: DataFrame
    test: DataFrame
    fake: DataFrame
    train_path: str = "train"
    test_path: str = "test"
    fake_path: str = "fake"
    types: ColumnTypes | None = None
    keys: list[str] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    pairs: dict[tuple[str, str], efficacy.Prepared] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [c for c in self.test.columns if c not in self.keys]
        self.types = self.types or types_by_dtype(self.test.select([F.col(f"`{c}`") for c in names]))

    def without_keys(self, name: str) -> DataFrame:
        table = getattr(self, name)
        return table.select([F.col(f"`{c}`") for c in self.test.columns if c not in self.keys])

    def tagged(self, **sides: str) -> DataFrame:
        """Union of the named tables, each under its side."""
        result = None
        base = self.without_keys("test")
        for side, name in sides.items():
            _, table = align_columns(base, self.without_keys(name), "subset")
            part = align_types(table, base).withColumn(SIDE, F.lit(side))
            result = part if result is None else result.unionByName(part)
        return result

    def size(self, name: str) -> int:
        if name not in self.sizes:
            self.sizes[name] = getattr(self, name).count()
        return self.sizes[name]

    def prepared(self, name: str, target: str) -> efficacy.Prepared:
        """Feature tables to train on the named table and test on the test table, made once for all models."""
        if (name, target) not in self.pairs:
            test = self.without_keys("test")
            other = align_types(self.without_keys(name), test)
            self.pairs[name, target] = efficacy.prepare(test, other, target, self.types, fit=test.unionByName(other))
        return self.pairs[name, target]

    def real_tag(self) -> str:
        """Q13: a train table that is the test table makes the real rows perfect by construction."""
        return "real_same_file" if self.train_path == self.test_path else "real"


def ledger_rows(tables: Tables, scored: DataFrame, metric: str, bins: int | None = None, model: str | None = None, target: str | None = None) -> DataFrame:
    """`scored` (tag, scorer, score) with the paths and sizes that belong to each tag."""
    pairs = {"real": ("test", "train"), "fake": ("test", "fake"), "fake_train": ("train", "fake")}
    tag = F.col("tag")

    def choose(kind) -> Column:
        column = None
        for name, members in pairs.items():
            value = F.lit(kind(members))
            column = F.when(tag == name, value) if column is None else column.when(tag == name, value)
        return column

    return conform(scored.select(
        choose(lambda m: getattr(tables, f"{m[0]}_path")).alias("real_path"), choose(lambda m: getattr(tables, f"{m[1]}_path")).alias("fake_path"),
        choose(lambda m: tables.size(m[0])).alias("real_size"), choose(lambda m: tables.size(m[1])).alias("fake_size"),
        F.col("score").cast("double").alias("score"), F.lit(metric).alias("metric"), "scorer",
        F.when(tag == "real", tables.real_tag()).otherwise(tag).alias("tag"),
        F.lit(bins).cast("double").alias("bins"), F.lit(model).cast("string").alias("model_name"), F.lit(target).cast("string").alias("target_name"),
    ))


def run_metric(
    tables: Tables, metric: str, bins: int = 50, model: str | None = None, scorer: str | list[str] | None = None, target: str | None = None,
    seed: int = 1000, class_shares: bool = True,
) -> DataFrame:
    """Ledger rows of one metric, always for test/train ("real") and test/synthetic ("fake").

    `scorer` is one name, several, or None for all; a categorical target adds its class shares.
    """
    if metric == "histogram_intersection":
        three = tables.tagged(test="test", train="train", fake="fake")
        return ledger_rows(tables, marginals.histogram_summary(three, tables.types, bins), metric, bins=bins)
    if metric == "exact_duplicates":
        three = tables.tagged(test="test", train="train", fake="fake")
        found = overlap.exact_duplicates(three, {"real": ("test", "train"), "fake_train": ("train", "fake"), "fake": ("test", "fake")})
        scored = found.withColumn("scorer", F.when(F.col("tag") == "fake_train", "sum_fake_train").otherwise("sum"))
        return ledger_rows(tables, scored, metric)
    if metric in ("correlation_accuracy", "pairwise_similarity"):
        parts = []
        for tag, name in (("real", "train"), ("fake", "fake")):
            if metric == "pairwise_similarity":
                score = kway.pairwise_similarity(tables.tagged(**{REAL: "test", FAKE: name}), types=tables.types, bins=bins)
                scorer_name = "mean"
            else:
                pair = tables.tagged(**{REAL: "test", FAKE: name})
                if tables.keys:
                    other = align_types(getattr(tables, name).select(*[F.col(f"`{c}`") for c in tables.test.columns]), tables.test)
                    keyed = tables.test.withColumn(SIDE, F.lit(REAL)).unionByName(other.withColumn(SIDE, F.lit(FAKE)))
                    pair = equalize(keyed, tables.keys, seed).drop(*tables.keys)
                score = associations.correlation_accuracy(pair, tables.types)
                scorer_name = "accuracy"
            parts.append(score.select(F.lit(tag).alias("tag"), F.lit(scorer_name).alias("scorer"), "score"))
        return ledger_rows(tables, parts[0].unionByName(parts[1]), metric, bins=bins if metric == "pairwise_similarity" else None)
    if metric == "efficacy_test":
        if target is None:
            raise ValueError("efficacy_test needs a target")
        test, parts = tables.without_keys("test"), []
        for tag, name in (("real", "train"), ("fake", "fake")):
            other = align_types(tables.without_keys(name), test)
            scorers = [scorer] if isinstance(scorer, str) else scorer
            scored = efficacy.efficacy_test(test, other, target, model, scorers, ready=tables.prepared(name, target))
            parts.append(scored.select(F.lit(tag).alias("tag"), "scorer", "score"))
            if class_shares and target in tables.types.categorical:
                parts.append(aggregates.class_share_rows(other, target, tag).select("tag", "scorer", "score"))
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        return ledger_rows(tables, scored, metric, model=model, target=target)
    raise ValueError(f"unknown metric {metric!r}; choose from {METRICS}")


def run_full_evaluation(
    spark: SparkSession, train: DataFrame, test: DataFrame, fakes: dict[str, DataFrame | None], target: str,
    models: tuple[str, ...] = ("xgb", "logistic"), scorers: tuple[str, ...] = ("f1", "auc", "accuracy"), bins: tuple[int, ...] = (50,), **paths: str,
) -> DataFrame:
    """All metrics of every synthetic table; a missing one (None) is skipped."""
    result = None
    for name, fake in fakes.items():
        if fake is None:
            continue
        tables = Tables(train, test, fake, fake_path=name, **paths)
        parts = [run_metric(tables, "exact_duplicates"), run_metric(tables, "correlation_accuracy")]
        for b in bins:
            parts += [run_metric(tables, "histogram_intersection", bins=b), run_metric(tables, "pairwise_similarity", bins=b)]
        # one fit for each model gives all scores; the class shares are the same for all models
        parts += [run_metric(tables, "efficacy_test", model=m, scorer=list(scorers), target=target, class_shares=m == models[0]) for m in models]
        for part in parts:
            result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("no synthetic table found")
    return result

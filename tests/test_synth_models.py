"""Sampling, loops, models, privacy, ledger and paths."""

import bisect
import math

import pytest
from pyspark.sql import functions as F

from veritab.functions.scalars import normalize_score, to_number
from veritab.operators import efficacy, privacy, profile, synth
from veritab.plans import reports, runner
from veritab.sources import ledger, tables


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    return spark.range(600).select(
        (i % 50).alias("n"), F.when(i % 3 == 0, 0.0).otherwise((i * 37 % 1000).cast("double")).alias("m"),
        F.when(i % 50 < 25, "low").otherwise("high").alias("c"),
    )


@pytest.fixture(scope="module")
def model(table):
    return synth.fit_slots(table, profile.build_profile(table))


def test_uniform_sets(spark, table, model):
    made = synth.uniform_pseudo(spark, model.profile, 200, sets=2, seed=4)
    assert {r["set_id"]: r["count"] for r in made.groupBy("set_id").count().collect()} == {0: 200, 1: 200}
    row = made.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.collect_set("c").alias("c")).first()
    assert 0 <= row["a"] and row["b"] <= 49 and set(row["c"]) == {"low", "high"}
    assert made.exceptAll(synth.uniform_pseudo(spark, model.profile, 200, sets=2, seed=4).repartition(5)).isEmpty()


def test_sampling_keeps_dependence(spark, model):
    ids = spark.range(2000).withColumnRenamed("id", synth.ID)
    alone = synth.sample_from_profile(ids, model, seed=1)
    share = alone.agg(F.avg((F.col("m") == 0).cast("int"))).first()[0]
    assert share == pytest.approx(1 / 3, abs=0.05)
    half = (F.col("id") % 2).cast("string")
    twins = spark.range(600).select(half.alias("a"), half.alias("b"))
    rows = synth.sequential_generate(ids, synth.fit_slots(twins, profile.build_profile(twins)), seed=2)
    assert rows.filter("a <> b").isEmpty() and rows.select("a").distinct().count() == 2


def test_sharper_temperature():
    assert synth.sharpened([1.0, 3.0], 1.0) == pytest.approx([0.25, 1.0])
    assert synth.sharpened([1.0, 3.0], 0.5) == pytest.approx([0.1, 1.0])


def test_empirical_sample(spark):
    df = spark.createDataFrame([(5.0,)] * 900 + [(float(i),) for i in range(100)], "v double")
    drawn = synth.empirical_sample(df, "v", spark.range(4000), ["id"], seed=1)
    assert drawn.count() == 4000
    assert drawn.filter("value = 5").count() / 4000 == pytest.approx(0.901, abs=0.02)


def test_generate_until(spark, model):
    raw, kept, log = synth.generate_until(
        spark, 150, lambda ids, attempt: synth.sample_from_profile(ids, model, seed=attempt), lambda b: b.filter("m > 0"), first_guess=0.9
    )
    assert kept.count() == 150 and kept.filter("m <= 0").isEmpty() and kept.select(synth.ID).distinct().count() == 150
    assert log[-1][1:] == (150, 150) and raw.count() == log[-1][0]


def test_impute(spark, table, model):
    holed = table.withColumn("k", F.monotonically_increasing_id()).withColumn("c", F.when(F.col("n") % 5 > 0, F.col("c")))
    done, retries = synth.impute_rows(holed, model, "k", seed=3)
    assert retries > 0 and done.count() == 600 and done.filter("c IS NULL").isEmpty()
    before = holed.select("k", F.col("c").alias("was"))  # cells that were present never change
    assert done.join(before, "k").filter("was IS NOT NULL AND was <> c").isEmpty()


def test_dependency_rules(spark):
    base = spark.range(300).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 4).cast("string").alias("c"), (F.col("id") % 9).cast("string").alias("d"))
    meta = profile.schema_metadata(base.drop("id"), categorical=["c", "d"])
    ruled = synth.inject_dependencies(base, meta, ["id"], rules=[("x", "c"), ("c", "d")], seed=1)
    assert ruled.count() == 300 and set(ruled.columns) == set(base.columns)
    assert ruled.select("c", "d").distinct().count() <= 4  # d follows c
    assert ruled.filter("x < 70").select("c").distinct().count() == 1  # lowest quarter, first category


def test_dependencies_do_not_depend_on_the_vocabulary_path(spark, monkeypatch):
    """Literals and joins give the same rows."""
    base = spark.range(200).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 4).cast("string").alias("c"), (F.col("id") % 9).cast("string").alias("d"))
    meta = profile.schema_metadata(base.drop("id"), categorical=["c", "d"])
    rules = [("c", "d"), ("x", "c"), ("d", "x")]
    first = synth.inject_dependencies(base, meta, ["id"], rules=rules, seed=1).orderBy("id").collect()
    monkeypatch.setattr(synth, "LITERAL_CATEGORIES", 0)
    assert synth.inject_dependencies(base, meta, ["id"], rules=rules, seed=1).orderBy("id").collect() == first


def test_privacy_values(spark):
    mechanisms = spark.createDataFrame([("full", 1.0, 2.0, 10), ("sampled", 0.01, 1.0, 1000), ("none", 0.0, 1.0, 5)], "dataset string, q double, sigma double, steps int")
    got = {r["dataset"]: r for r in privacy.privacy_ledger(mechanisms, 1e-5).collect()}
    assert got["full"]["epsilon"] == pytest.approx(8.087862, abs=1e-5) and got["full"]["best_order"] == 4
    assert got["sampled"]["epsilon"] == pytest.approx(2.107753, abs=1e-5) and got["sampled"]["best_order"] == 8
    open_ended = spark.createDataFrame([("z", 0.1, 0.0, 1)], mechanisms.schema)
    assert math.isinf(privacy.privacy_ledger(open_ended, 1e-5).first()["epsilon"])


def test_noise_search(spark):
    targets = spark.createDataFrame([(2.107753, 1e-5, 0.01, 1000)], "epsilon double, delta double, q double, steps int")
    row = privacy.noise_for_budget(targets).first()
    assert row["sigma"] == pytest.approx(1.0, abs=0.02) and 2.097 <= row["spent"] <= 2.107753


def test_scores(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0, [0.9, 0.1]), (0.0, 1.0, [0.4, 0.6]), (0.0, 0.0, [0.7, 0.3]), (1.0, 1.0, [0.2, 0.8]), (1.0, 0.0, [0.6, 0.4])],
        "label double, prediction double, probability array<double>",
    )
    got = {r["scorer"]: r["score"] for r in efficacy.score_predictions(rows, ["f1", "auc", "accuracy"]).collect()}
    assert got["f1"] == pytest.approx(0.5) and got["accuracy"] == pytest.approx(0.6) and got["auc"] == pytest.approx(5 / 6)
    one = rows.filter("label = 1")
    assert efficacy.score_predictions(one, ["auc"]).first()["score"] is None
    assert efficacy.score_predictions(one, ["auc"], compat_zero=True).first()["score"] == 0.0


def test_predictions_are_made_once(spark):
    """Every scorer reads the same rows; the model that gives them runs once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    kinds = "label double, prediction double, probability array<double>"
    rows = spark.createDataFrame([(float(i % 2), float(i % 3 == 0), [i / 10, 1 - i / 10]) for i in range(10)], kinds).mapInArrow(counted, kinds)
    assert len(efficacy.score_predictions(rows, ["f1", "auc", "accuracy"]).collect()) == 3
    assert made.value == 10


def test_models_share_features(table, monkeypatch):
    calls, prepare = [], efficacy.prepare
    monkeypatch.setattr(efficacy, "prepare", lambda *a, **k: calls.append(1) or prepare(*a, **k))
    tables = runner.Tables(table, table, table)
    for model in ("tree", "logistic"):
        assert runner.run_metric(tables, "efficacy_test", model=model, scorer="accuracy", target="c").filter("scorer = 'accuracy'").count() == 2
    assert len(calls) == 2


def test_classes_are_counted_once(table, monkeypatch):
    """One pass over the features for the sizes of the classes, and none for their weights."""
    ready = efficacy.prepare(table, table, "c")
    efficacy.fit_predict(ready, "tree")
    assert sum(ready.sizes.values()) == ready.train.count()
    monkeypatch.setattr(efficacy, "class_sizes", None)
    efficacy.fit_predict(ready, "tree")


def test_edges_passed(spark):
    edges = [0.0, 0.1, 0.1, 0.1, 0.35, 0.7, 0.7]
    values = [-1.0, 0.0, 0.05, 0.1, 0.2, 0.35, 0.69, 0.7, 0.9]
    rows = spark.createDataFrame([(v, edges[:n]) for v in [*values, None] for n in range(len(edges) + 1)], "v double, e array<double>")
    found = rows.select("v", "e", synth.edges_passed(F.col("e"), F.col("v"), len(edges)).alias("n"))
    assert all(r["n"] == (0 if r["v"] is None else bisect.bisect_right(r["e"], r["v"])) for r in found.collect())
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_generated_rows_are_made_once(spark):
    """The ranges and the bins of generated rows read a table instead of drawing twice."""
    from veritab.queries.synthesis import QUERIES

    found = QUERIES["k7_fidelity_of_generated"](spark, "/root/testdata/sf0.001")
    assert "md5(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_efficacy_learns(table):
    scored = efficacy.efficacy_test(table, table, "c", "tree", ["accuracy"]).first()
    assert scored["score"] > 0.95
    constant = table.withColumn("c", F.lit("low"))
    assert efficacy.efficacy_test(table, constant, "c", "tree", ["accuracy"], fit=table).first()["score"] == pytest.approx(0.5)


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("r", "f", 5, 5, 0.5, "pairwise_similarity", "mean", "fake")], "real_path string, fake_path string, real_size int, fake_size int, score double, metric string, scorer string, tag string")
    path = str(tmp_path / "ledger")
    ledger.save_results(spark, path, rows)
    with pytest.raises(ValueError):
        ledger.save_results(spark, path, rows)
    ledger.save_results(spark, path, rows, overwrite=True)
    assert ledger.read_ledger(spark, path).count() == 1


def test_runner_flags_one_file(table):
    same = runner.Tables(table, table, table, "a.csv", "a.csv", "f.csv")
    found = runner.run_metric(same, "exact_duplicates").collect()
    assert {r["tag"] for r in found} == {"real_same_file", "fake", "fake_train"} and len({r["score"] for r in found}) == 1


def test_paths(spark):
    from veritab.queries.reports import RUN_SETTINGS

    path = "/data/x/y/z/out/runs/LR0.0005-x_uniform_y_shuffle-True_wl0.65/job1/w/adult/DP/GPT2/full/m-bs32-epoch10-eps1.0-clip1.5/epoch3/synth_impute-False/a/t.csv"
    short = "data/adult/train.csv"
    rows = {r["fake_path"]: r for r in reports.experiment_dimensions(spark.createDataFrame([(path,), (short,)], "fake_path string"), RUN_SETTINGS).collect()}
    full = rows[path]
    assert (full["bs"], full["train_epoch"], full["chkt_epoch"], full["eps"], full["clip"]) == (32, 10, "3", "1", "1.5")
    assert (full["LR"], full["approach"], full["impute"]) == ("0.0005", "uniform", "False")
    assert (rows[short]["bs"], rows[short]["exp"], rows[short]["llm"]) == (-1, "real", "real")


def test_numbers_and_ranges(spark):
    rows = spark.createDataFrame([(" 1.5 ",), ("1e3",), ("12d",), ("nan",), ("",), (None,), ("-.5",)], "t string")
    assert [r[0] for r in rows.select(to_number(F.col("t"))).collect()] == [1.5, 1000.0, None, None, None, None, -0.5]
    with pytest.raises(Exception, match="outside its range"):
        spark.createDataFrame([(2.0,)], "x double").select(normalize_score(F.col("x"), 0.0, 1.0)).collect()


def test_headerless_and_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("|remark\nx, 1\n\ny, 2\n")
    got = tables.read_headerless(spark, str(tmp_path / "t.csv"), ["name-a", "b"], skip_line=r"^\|")
    assert [tuple(r) for r in got.collect()] == [("x", "1"), ("y", "2")] and got.columns == ["name-a", "b"]

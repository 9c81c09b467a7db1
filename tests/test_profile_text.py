"""Profiles, labels, features, repair and row text on the typed six-row table."""

import pytest
from pyspark.sql import functions as F

from veritab.operators import clean, encode, features, profile, rowtext

ROWS = [
    (25.0, 1.0, "PhD", 0.0, 100.0), (30.0, 1.0, "Bachelors", 0.0, 100.0), (35.0, 1.0, "Masters", 1000.0, 100.0),
    (40.0, 1.0, "PhD", None, 100.0), (28.0, 1.0, "Bachelors", 500.0, 100.0), (32.0, 1e6, "HS-grad", 0.0, 100.0),
]
NAMES = ["age", "income", "education", "debt", "constant_num"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "age double, income double, education string, debt double, constant_num double")


@pytest.fixture(scope="module")
def built(table):
    return profile.build_profile(table)


def test_profile(built):
    assert built.of("age").kind == "numerical" and not built.of("age").needs_log
    assert built.of("age").skewness == pytest.approx(0.530108, abs=1e-6)
    assert built.of("income").needs_log and built.of("income").skewness == pytest.approx(2.449490, abs=1e-6)
    assert built.of("debt").kind == "mixed" and built.of("education").kind == "categorical"
    assert built.of("education").vocabulary == ["[UNK]", "Bachelors", "PhD", "HS-grad", "Masters"]
    assert len(built.of("age").edges) == 101 and built.of("constant_num").norm_max == 101.0


def test_labels(spark, table, built):
    extra = spark.createDataFrame([(35.0, None, "Alien", None, 100.0), (35.0, 1.0, None, 1000.0, 100.0), (35.0, 1.0, "phd", 0.0, 1.0)], table.schema)
    rows = [r["labels"] for r in encode.encode_labels(table.unionByName(extra).coalesce(1), built, keep=[]).collect()]
    assert all(len(r) == 5 for r in rows)
    age = rows[2][0]
    assert (age["num_bin"], age["col_type_id"], age["cat_id"]) == (79, 0, -100) and age["num_res"] == pytest.approx(1.0)
    assert [(r[1]["num_bin"], round(r[1]["num_res"], 6)) for r in (rows[0], rows[5])] == [(0, 0.0), (99, 1.0)]
    assert [r[3]["mixed_bin"] for r in rows[:6]] == [-100, -100, 99, -100, 0, -100]
    assert rows[3][3]["mixed_mask"] == 0.0 and rows[2][3]["mixed_mask"] == 1.0
    assert rows[0][4]["num_bin"] == 0 and rows[0][4]["num_res"] == 0.0
    assert [r[2]["cat_id"] for r in rows[6:]] == [0, 0, 2]  # unknown, missing without a missing token, other case


def test_decode(table, built):
    coded = encode.encode_labels(table, built, keep=["education"])
    back = encode.decode_labels(coded.withColumnRenamed("education", "was"), built, keep=["was"]).collect()
    assert all(r["education"] == r["was"] for r in back)
    assert sorted(round(r["age"], 4) for r in back) == [25.0, 28.0, 30.0, 32.0, 35.0, 40.0]
    assert sorted(round(r["debt"], 3) for r in back) == [0.0, 0.0, 0.0, 0.0, 500.0, 1000.0]
    assert sorted(round(r["income"], 2) for r in back)[-1] == pytest.approx(1e6, rel=1e-6)


def test_repair(spark, built):
    messy = spark.createDataFrame([("31", "x", "PHD", "0", "100"), ("bad", "2", "Alien", None, "1e2")], "Age string, income string, education string, debt string, constant_num string")
    first, second = sorted(clean.repair_rows(messy, built).collect(), key=lambda r: r["age"] is None)
    assert (first["age"], first["income"], first["education"]) == (31.0, None, "PhD")
    assert (second["age"], second["education"], second["constant_num"]) == (None, None, 100.0)
    assert clean.repair_rows(messy, built, dropna=True).count() == 0
    with pytest.raises(ValueError):
        clean.repair_rows(messy.drop("Age"), built)


def test_text_forms(table, built):
    texts = [r["text"] for r in rowtext.serialize(table, built, "great", NAMES, keep=[]).collect()]
    assert texts[0] == (
        "[BOS] [NUM] age is 25.0 [EOC] [NUM] income is 1.0 [EOC] [CAT] education is PhD [EOC] [MIX] debt is 0.0 [EOC] "
        "[NUM] constant_num is 100.0 [EOC] [EOS]"
    )
    assert "debt is Missing" in texts[3]
    assert all(t.count("[EOC]") == 5 for t in texts)


@pytest.mark.parametrize("style", list(rowtext.STYLES))
@pytest.mark.parametrize("seed", [None, 5])
def test_round_trip(table, built, style, seed):
    keyed = table.withColumn("id", F.monotonically_increasing_id())
    assert rowtext.round_trip_failures(keyed, built, ["id"], style, seed).count() == 0


def test_parsing_rules(spark):
    texts = spark.createDataFrame([("a is 1, b is 2, a is 3, z is 9, b",), ("nothing here",)], "t string")
    last = rowtext.deserialize(texts, "t", ["a", "b"]).collect()
    first = rowtext.deserialize(texts, "t", ["a", "b"], first_wins=True).collect()
    assert [tuple(r) for r in last] == [("3", "2"), ("placeholder", "placeholder")]
    assert tuple(first[0]) == ("1", "2")
    paired = spark.createDataFrame([(" a, b, c : 1, 2",)], "t string")
    assert tuple(rowtext.deserialize(paired, "t", ["a", "b", "c", "d"], "apval").first()) == ("1", "2", None, "placeholder")


def test_anchor_padding(table, built):
    texts = rowtext.serialize(table, built, "great", NAMES, keep=[])
    assert [r["anchors"] for r in rowtext.anchor_positions(texts, "text", 5, limit=8).collect()][0] == [1, 6, -1, -1, -1]


def test_features(spark, table):
    space = features.fit_features(table, numeric="standard")
    assert [b[1] for b in space.layout()] == [1, 1, 4, 1, 1]
    unknown = spark.createDataFrame([(25.0, 1.0, "Alien", 0.0, 100.0)], table.schema)
    vector = features.transform_features(unknown, space).first()["features"].toArray()
    assert list(vector[2:6]) == [0.0] * 4
    assert features.inverse_features(features.transform_features(unknown, space), space).first()["education"] is None
    assert features.value_id(space, "education", "Masters") == {"column_id": 2, "discrete_column_id": 0, "value_id": 2}
    with pytest.raises(ValueError):
        features.value_id(space, "education", "Alien")


def test_values_beyond_the_head(spark):
    """Every value of a wide column has an id and comes back; lower case is the second try."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "Hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("V"), F.col("id") % 400)).alias("c"))
    built = profile.build_profile(rows.select("c"))
    info = built.of("c")
    assert info.tail and len(info.vocabulary) == profile.HEAD + 1 and info.size == 1 + rows.na.fill("Missing").select("c").distinct().count()
    coded = encode.encode_labels(rows, built, keep=["id"])
    back = {r.id: r.c for r in encode.decode_labels(coded, built, keep=["id"]).collect()}
    assert back == {r.id: r.c or "Missing" for r in rows.collect()}
    other = spark.createDataFrame([(1, "hOT"), (2, "v7"), (3, "nothing"), (4, None)], "id long, c string")
    found = {r.id: r.c for r in encode.decode_labels(encode.encode_labels(other, built, keep=["id"]), built, keep=["id"]).collect()}
    assert found == {1: "Hot", 2: "V7", 3: "[UNK]", 4: "Missing"}
    capped = profile.build_profile(rows.select("c"), top_k=2).of("c")
    assert not capped.tail and len(capped.vocabulary) <= 4


def test_cells_keep_or_cut_at_separators(spark):
    texts = spark.createDataFrame([(1, "[BOS] [CAT] a is x is y is z [EOC] [NUM] b is 2 [EOC] [EOS]"), (2, "a is x is y is z, b, b is 2")], "k int, text string")
    rows = {r["k"]: (r["a"], r["b"]) for r in rowtext.deserialize(texts, "text", ["a", "b"], keep=["k"]).collect()}
    assert rows == {1: ("x is y is z", "2"), 2: ("x", "2")}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_out_before_parsing(spark):
    """A file of one row group is no single task for the parser, and a part is split once."""
    plan = _plan(rowtext.deserialize(spark.range(5).select("id", F.lit("a is 1").alias("text")), "text", ["a"], keep=["id"]).filter("a = '1'"))
    assert 0 <= plan.index("Filter") < plan.index("Repartition")


def test_round_trip_is_dealt_out(spark):
    """The comparison of a round trip stays behind the exchange, and so does the parsing it needs."""
    df = spark.range(50).select("id", F.concat(F.lit("w is "), F.col("id").cast("string")).alias("c"))
    built = profile.build_profile(df.select("c"))
    failures = rowtext.round_trip_failures(df, built, ["id"], "great", seed=1)
    plan = _plan(failures)
    assert 0 <= plan.index("Filter") < plan.index("Repartition")
    assert failures.count() == 0

"""Hand-checked metric values and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import associations, kway, marginals, overlap, ranks
from veritab.operators.sides import ColumnTypes, align_columns, tag_sides, types_by_parsing


def pair_of(spark, real, fake, ddl):
    return tag_sides(spark.createDataFrame(real, ddl), spark.createDataFrame(fake, ddl))


def scores(df):
    return {r["metric"]: r["score"] for r in df.collect()}


def test_categorical_histogram(spark):
    pair = pair_of(spark, [("a",), ("a",), ("b",), ("b",)], [("a",), ("b",), ("b",), ("c",)], "x string")
    found = scores(marginals.mass_scores(marginals.histogram_table(pair), marginals.MASS_SCORES))
    assert found["histogram_intersection"] == pytest.approx(0.75)
    assert found["jaccard_similarity"] == pytest.approx(0.6)
    assert found["jensonshannon_distance"] == pytest.approx(0.394511, abs=1e-6)
    assert scores(marginals.wasserstein_distance(pair))["wasserstein_distance"] == pytest.approx(0.5)
    assert scores(marginals.cumulative_difference(pair))["cumulative_difference"] == pytest.approx(0.5)
    assert kway.subset_distances(pair, [("x",)]).first()["tvd"] == pytest.approx(0.25)


def test_numeric_histogram_edge_goes_right(spark):
    pair = pair_of(spark, [(0.0,), (1.0,), (2.0,), (10.0,)], [(0.0,), (5.0,), (10.0,), (10.0,)], "x double")
    rows = {r["bin"]: (r["n_real"], r["n_fake"]) for r in marginals.histogram_table(pair, bins=5).collect()}
    assert rows == {0: (3, 1), 2: (0, 1), 3: (1, 2)}
    assert marginals.histogram_intersection(pair, bins=5).first()["score"] == pytest.approx(0.5)


def test_wasserstein_counts_empty_bins(spark):
    pair = pair_of(spark, [(0.0,)] * 4, [(9.0,), (9.0,), (10.0,), (0.0,)], "x double")
    # 4 bins of width 1/4 start at 0, .25, .5, .75: three quarters of the mass move from bin 0 to bin 3
    assert marginals.wasserstein_distance(pair, bins=5).first()["score"] == pytest.approx(0.75 * 3 * 0.25)


def test_identity_and_disjoint(spark):
    rows = [(float(i % 7), "abc"[i % 3], i % 4) for i in range(60)]
    ddl = "x double, c string, k int"
    same = pair_of(spark, rows, rows, ddl)
    assert {r["score"] for r in marginals.histogram_intersection(same).collect()} == {1.0}
    assert kway.pairwise_similarity(same).first()["score"] == pytest.approx(1.0)
    assert associations.correlation_accuracy(same).first()["score"] == 1.0
    assert [r["tvd_mean"] for r in kway.kway_aligned(same, [1, 2]).collect()] == [0.0, 0.0]
    assert overlap.exact_duplicates(same, {"t": ("real", "fake")}).first()["score"] == len(set(rows))
    apart = pair_of(spark, [("a",)], [("b",)], "x string")
    assert marginals.histogram_intersection(apart).first()["score"] == 0.0
    assert kway.subset_distances(apart, [("x",)]).first()["tvd"] == 1.0


def test_duplicates_treat_nulls_as_equal(spark):
    pair = pair_of(spark, [(1, None), (1, None), (2, "b")], [(1, None), (3, "c")], "a int, b string")
    assert overlap.exact_duplicates(pair, {"t": ("real", "fake")}).first()["score"] == 1


def test_pairwise_null_rules(spark):
    # real NULL leaves, fake NULL joins the first bin (Q3)
    real, fake = [(0.0, "a"), (10.0, "a"), (None, "a")], [(None, "a"), (10.0, "a")]
    pair = pair_of(spark, real, fake, "x double, c string")
    assert kway.pairwise_similarity(pair, bins=3).first()["score"] == pytest.approx(1.0)
    dropped = kway.pairwise_similarity(pair, bins=3, null_policy="drop").first()["score"]
    assert dropped == pytest.approx(0.5)


def test_associations_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = 2 * x + rng.normal(size=300)
    c = np.where(x > 0, "p", "n")
    d = np.where(rng.random(300) < 0.7, c, "z")
    df = spark.createDataFrame([(float(a), float(b), str(e), str(f)) for a, b, e, f in zip(x, y, c, d)], "x double, y double, c string, d string")
    found = {(r["col_a"], r["col_b"]): r["value"] for r in associations.association_matrix(df).collect()}
    assert found["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    between = sum((c == g).sum() * (y[c == g].mean() - y.mean()) ** 2 for g in "pn")
    assert found["c", "y"] == pytest.approx(np.sqrt(between / ((y - y.mean()) ** 2).sum()))
    assert found["c", "c"] == 1.0
    theil = {(r["col_a"], r["col_b"]): r["value"] for r in associations.categorical_pairs(df, ["c", "d"], "theils_u").collect()}
    assert 0 < theil["c", "d"] < 1 and theil["c", "d"] != theil["d", "c"]


def test_positional_pairs_across_chunks(spark):
    rng = np.random.default_rng(1)
    real, fake = rng.integers(0, 9, 200), rng.integers(0, 200, 200)
    pair = pair_of(spark, [(float(v),) for v in real], [(float(v),) for v in fake], "x double")
    parts = ranks.positional_pairs(pair, ["x"], lambda c: F.col(c), "double")
    got = {}
    for r in parts.collect():
        got[r["real"], r["fake"]] = got.get((r["real"], r["fake"]), 0) + r["n"]
    want = {}
    for a, b in zip(sorted(real), sorted(fake)):
        want[float(a), float(b)] = want.get((float(a), float(b)), 0) + 1
    assert got == want


def test_kway_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = lambda n: [(int(a), int(b), "uvw"[int(c)]) for a, b, c in rng.integers(0, 3, (n, 3))]
    real, fake = rows(80), rows(50)
    pair = pair_of(spark, real, fake, "a int, b int, c string")
    got = {r["columns"]: r["tvd"] for r in kway.subset_distances(pair, [("a", "c"), ("b",)]).collect()}
    for cols, places in (("a,c", (0, 2)), ("b", (1,))):
        count = lambda t: {k: sum(tuple(r[i] for i in places) == k for r in t) / len(t) for k in {tuple(r[i] for i in places) for r in real + fake}}
        p, q = count(real), count(fake)
        assert got[cols] == pytest.approx(sum(abs(p[k] - q[k]) for k in p) / 2)


def test_encoder_uses_joined_vocabulary_when_large(spark, monkeypatch):
    monkeypatch.setattr(kway, "LITERAL_VOCABULARY", 2)
    fit = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string")
    encoder = kway.fit_encoder(fit, ColumnTypes([], ["v"]))
    assert list(encoder.large) == ["v"]
    rows = spark.createDataFrame([("a", 1), ("c", 2), ("?", 3), (None, 4)], "v string, i int")
    got = {r["i"]: r["v"] for r in kway.encode_quantiles(rows, encoder, ["i"]).collect()}
    assert got == {1: 2, 2: 4, 3: 0, 4: 1}  # `__NA__` sorts first


def test_alignment_and_policies(spark):
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([("y", 2, 3)], "q string, p int, r int")
    with pytest.raises(ValueError):
        align_columns(a, b)
    assert align_columns(a, b, "shared")[1].columns == ["p", "q"]
    text = spark.createDataFrame([("1", "1"), ("2", "b"), ("12d", "3"), ("4", "4")], "m string, n string")
    assert types_by_parsing(text, threshold=0.7).numeric == ["m", "n"]
    assert types_by_parsing(text, threshold=0.75, strict=True).numeric == []

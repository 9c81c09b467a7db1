"""Train-on-synthetic, test-on-real queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.operators import efficacy, kway
from veritab.operators.clean import keep_known_labels
from veritab.operators.sides import ColumnTypes
from veritab.plans.evaluate import evaluate
from veritab.queries.common import Registry, load, r

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql


def _labelled(spark, folder):
    """Labelled documents: even ids are the real table, odd ids the candidate."""
    documents = load(spark, folder, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    labels = load(spark, folder, "labels")
    rows = documents.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.col("toxic").cast("double").alias("toxic"), F.col("quality").cast("string").alias("quality")
    )
    even = F.col("doc_id") % 2 == 0
    return rows.filter(even).drop("doc_id"), rows.filter(~even).drop("doc_id")


@query("l1_efficacy_test")
def _(spark, folder):
    real, fake = _labelled(spark, folder)
    return efficacy.efficacy_test(real, fake, "quality", "logistic", ["f1", "auc", "accuracy"])


@query("l2_classifiers")
def _(spark, folder):
    real, fake = _labelled(spark, folder)
    return efficacy.efficacy_models(real, fake, "quality", ["tree", "mlp", "xgb"], scorers=["accuracy", "auc"])


@query("l3_regressors")
def _(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    even = F.col("l_orderkey") % 2 == 0
    real, fake = lines.filter(even).drop("l_orderkey"), lines.filter(~even).drop("l_orderkey")
    return efficacy.efficacy_models(real, fake, "l_extendedprice", ["linear", "tree", "mlp"], scorers=["r2"])


def _predictions(spark, folder):
    """Predictions written into lineitem: return flag R against quantity, ranked by price."""
    score = F.col("l_extendedprice") / 200000
    return load(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.col("l_quantity") > 25).cast("double").alias("prediction"),
        F.array(1 - score, score).alias("probability"),
    )


L4_SQL = """WITH p AS (SELECT CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS z, l_extendedprice / 200000 AS s FROM lineitem),
m AS (SELECT y AS c FROM p GROUP BY y ORDER BY count(*), y LIMIT 1),
k AS (SELECT y, CASE WHEN c = 1 THEN rank() OVER (ORDER BY s) ELSE rank() OVER (ORDER BY 1 - s) END + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk, c FROM p, m)
SELECT 'accuracy' AS scorer, round(avg(CASE WHEN y = z THEN 1 ELSE 0 END), 9) AS score FROM p
UNION ALL SELECT 'f1', round(2 * count(*) FILTER (y = c AND z = c) / (count(*) FILTER (y = c) + count(*) FILTER (z = c)), 9) FROM p, m
UNION ALL SELECT 'r2', round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 9) FROM p
UNION ALL SELECT 'auc', round((sum(rk) FILTER (y = c) - count(*) FILTER (y = c) * (count(*) FILTER (y = c) + 1) / 2) / (count(*) FILTER (y = c) * count(*) FILTER (y <> c)), 9) FROM k
UNION ALL SELECT 'recall', round(count(*) FILTER (y = 1 AND z = 1) / count(*) FILTER (y = 1), 9) FROM p"""


def recall(y_true, y_pred):
    """A caller-supplied scorer."""
    return F.count_if((y_true == 1) & (y_pred == 1)) / F.count_if(y_true == 1)


@query("l4_u2_scorers", L4_SQL)
def _(spark, folder):
    table = efficacy.score_predictions(_predictions(spark, folder), ["accuracy", "f1", "auc", "r2", recall])
    return table.select("scorer", r("score").alias("score"))


@query("l4_micro_f1", "SELECT 'f1' AS scorer, round(avg(CASE WHEN l_linenumber = CASE WHEN l_quantity > 25 THEN 1 ELSE 2 END THEN 1 ELSE 0 END), 9) AS score FROM lineitem")
def _(spark, folder):
    rows = load(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("label"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(2.0).alias("prediction"),
        F.lit(None).cast("array<double>").alias("probability"),
    )
    return efficacy.score_predictions(rows, ["f1"]).select("scorer", r("score").alias("score"))


@query("l4_one_vs_one_auc", """WITH p AS (SELECT l_returnflag AS y, l_extendedprice / 200000 AS a, l_quantity / 50 AS n, l_discount AS r FROM lineitem),
u AS (SELECT y, CASE k WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END AS s, k, o FROM p, (SELECT * FROM (VALUES ('A', 'N'), ('A', 'R'), ('N', 'A'), ('N', 'R'), ('R', 'A'), ('R', 'N')) v(k, o)) WHERE y = k OR y = o),
w AS (SELECT *, rank() OVER (PARTITION BY k, o ORDER BY s) + (count(*) OVER (PARTITION BY k, o, s) - 1) / 2 AS rk FROM u),
x AS (SELECT k, o, (sum(rk) FILTER (y = k) - count(*) FILTER (y = k) * (count(*) FILTER (y = k) + 1) / 2) / (count(*) FILTER (y = k) * count(*) FILTER (y <> k)) AS auc FROM w GROUP BY k, o)
SELECT round(avg(auc), 9) AS auc FROM x""")
def _(spark, folder):
    flag = F.col("l_returnflag")
    rows = load(spark, folder, "lineitem").select(
        F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("label"), F.lit(0.0).alias("prediction"),
        F.array(F.col("l_extendedprice") / 200000, F.col("l_quantity") / 50, F.col("l_discount")).alias("probability"),
    )
    return efficacy.macro_auc(rows, 3).select(r("auc").alias("auc"))


@query("l5_models_of_one_target")
def _(spark, folder):
    real, fake = _labelled(spark, folder)
    return efficacy.efficacy_models(real, fake, "quality", ["logistic", "tree"], scorers=["f1"])


@query("l6_all_targets")
def _(spark, folder):
    real, fake = _labelled(spark, folder)
    return efficacy.all_targets_test(real, fake, ["tree", "xgb"], ["linear", "tree"])


@query("l7_grid_search")
def _(spark, folder):
    documents = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = documents.join(load(spark, folder, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("string"))
    types = ColumnTypes(["n_chars"], ["lang", "source"])
    codes = kway.encode_quantiles(rows, kway.fit_encoder(rows, types), ["doc_id", "quality"])
    known = keep_known_labels(codes, rows, "quality")
    odd = F.col("doc_id") % 2 == 1
    result = efficacy.grid_search(
        known.filter(odd), known.filter(~odd), ["n_chars", "lang", "source"], "label_id", ["doc_id"]
    )
    return spark.createDataFrame([(float(result["acc"]), float(result["auc"]))], "acc double, auc double")


@query("l8_evaluate")
def _(spark, folder):
    lines = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_orderstatus").alias("target"), F.month("o_orderdate").alias("month"))
    third = F.col("o_orderkey") % 3
    fit, test, fake = (lines.filter(third == i) for i in range(3))
    return evaluate(fit, test, fake, "target", "o_orderkey")

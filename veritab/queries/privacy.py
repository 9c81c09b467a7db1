"""Privacy queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veritab.operators import overlap, privacy
from veritab.queries.common import Registry, big, load, r, uniform_sql

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql
INF = math.inf

# one mechanism per priority and status: batches of 64 of its orders, one step per order date
MECHANISMS = """(SELECT o_orderpriority AS dataset, least(1.0, 64.0::DOUBLE / count(*)) AS q, 1 + avg(o_totalprice) / 500000 AS sigma, count(DISTINCT o_orderdate) AS steps
 FROM orders GROUP BY o_orderpriority, o_orderstatus)"""


def _mechanisms(spark, folder):
    return load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), "o_orderstatus").agg(
        F.least(F.lit(1.0), 64.0 / F.count("*")).alias("q"), (1 + F.avg("o_totalprice") / 500000).alias("sigma"), F.countDistinct("o_orderdate").alias("steps")
    )


LEDGER_SQL = f"""WITH m AS (SELECT row_number() OVER () AS id, * FROM {MECHANISMS}), a AS (SELECT unnest(list_concat(range(2, 11), range(12, 64))) AS a),
t AS (SELECT id, dataset, steps, a, q, sigma, lgamma(a + 1) - lgamma(i + 1) - lgamma(a - i + 1) + i * ln(q) + (a - i) * ln(1 - q) + (i * i - i) / (2 * sigma * sigma) AS s
 FROM m, a, range(64) r(i) WHERE i <= a AND q < 1),
l AS (SELECT id, dataset, a, max(steps) * (max(s) + ln(sum(exp(s - mx)))) / (a - 1) AS cost FROM (SELECT *, max(s) OVER (PARTITION BY id, a) AS mx FROM t) GROUP BY id, dataset, a
 UNION ALL SELECT id, dataset, a, steps * a / (2 * sigma * sigma) FROM m, a WHERE q >= 1),
e AS (SELECT dataset, a, sum(cost) - (ln(1e-5) + ln(a)) / (a - 1) + ln((a - 1) / a) AS eps FROM l GROUP BY dataset, a)"""


@query("p3_privacy_ledger", LEDGER_SQL + " SELECT dataset, round(min(eps), 6) AS epsilon, CAST(arg_min(a, eps) AS BIGINT) AS best_order FROM e GROUP BY dataset")
def _(spark, folder):
    ledger = privacy.privacy_ledger(_mechanisms(spark, folder), 1e-5)
    return ledger.select("dataset", r("epsilon", 6).alias("epsilon"), big("best_order").alias("best_order"))


# the grid of the query: 0.3 to 30 in 120 equal ratios, searched once
P4_SQL = """WITH m AS (SELECT o_orderpriority AS dataset, o_orderstatus AS status, least(1.0, 64.0::DOUBLE / count(*)) AS q, count(DISTINCT o_orderdate) AS steps
 FROM orders GROUP BY ALL), g AS (SELECT 0.3 * pow(pow(30.0 / 0.3, 1.0 / 120), p) AS sigma FROM range(121) x(p)), a AS (SELECT unnest(list_concat(range(2, 11), range(12, 64))) AS a),
t AS (SELECT dataset, status, sigma, steps, a, lgamma(a + 1) - lgamma(i + 1) - lgamma(a - i + 1) + i * ln(q) + (a - i) * ln(1 - q) + (i * i - i) / (2 * sigma * sigma) AS s
 FROM m, g, a, range(64) r(i) WHERE i <= a AND q < 1),
c AS (SELECT dataset, status, sigma, a, max(steps) * (max(s) + ln(sum(exp(s - mx)))) / (a - 1) AS cost
 FROM (SELECT *, max(s) OVER (PARTITION BY dataset, status, sigma, a) AS mx FROM t) GROUP BY dataset, status, sigma, a
 UNION ALL SELECT dataset, status, sigma, a, steps * a / (2 * sigma * sigma) FROM m, g, a WHERE q >= 1),
e AS (SELECT dataset, status, sigma, min(cost - (ln(1e-5) + ln(a)) / (a - 1) + ln((a - 1) / a)) AS spent FROM c GROUP BY dataset, status, sigma)
SELECT dataset, status, round(min(sigma), 9) AS sigma, round(arg_min(spent, sigma), 6) AS spent FROM e WHERE spent <= 2 GROUP BY dataset, status"""


@query("p4_noise_for_budget", P4_SQL)
def _(spark, folder):
    """Noise per group for a budget of 2, on one grid."""
    targets = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("status")).agg(
        F.least(F.lit(1.0), 64.0 / F.count("*")).alias("q"), F.countDistinct("o_orderdate").alias("steps")
    ).withColumn("epsilon", F.lit(2.0)).withColumn("delta", F.lit(1e-5))
    found = privacy.noise_for_budget(targets, lowest=0.3, highest=30.0, points=120, rounds=1)
    return found.select("dataset", "status", r("sigma", 9).alias("sigma"), r("spent", 6).alias("spent"))


@query("p5_split_budget", LEDGER_SQL + " SELECT dataset, round(0.1 * min(eps), 6) AS preprocess_epsilon, round(min(eps) - 0.1 * min(eps), 6) AS train_epsilon FROM e GROUP BY dataset")
def _(spark, folder):
    ledger = privacy.split_budget(privacy.privacy_ledger(_mechanisms(spark, folder), 1e-5), 0.1)
    return ledger.select("dataset", r("preprocess_epsilon", 6).alias("preprocess_epsilon"), r("train_epsilon", 6).alias("train_epsilon"))


@query("p1_min_max_scale", """SELECT c_custkey, round((b - lo) / (hi - lo), 8) AS c_acctbal FROM (SELECT c_custkey, greatest(0, least(8000, c_acctbal)) AS b FROM customer),
 (SELECT min(greatest(0, least(8000, c_acctbal))) AS lo, max(greatest(0, least(8000, c_acctbal))) AS hi FROM customer)""")
def _(spark, folder):
    """Without noise (infinite budget), clamped to the stated bounds."""
    scaled = privacy.private_min_max_scale(load(spark, folder, "customer"), {"c_acctbal": (0, 8000)}, INF)
    return scaled.select("c_custkey", r("c_acctbal", 8).alias("c_acctbal"))


def laplace_sql(scale: str, place: int) -> str:
    u = f"({uniform_sql(1, repr(str(place)))} - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"


CLAMPED = "greatest(-1000, least(10000, c_acctbal))"


@query("p1_min_max_scale_noisy", f"""SELECT c_custkey, round(({CLAMPED} - lo) / (hi - lo), 6) AS c_acctbal FROM customer,
 (SELECT min({CLAMPED}) + {laplace_sql('11000 / 4.0', 0)} AS lo, max({CLAMPED}) + {laplace_sql('11000 / 4.0', 1)} AS hi FROM customer)""")
def _(spark, folder):
    scaled = privacy.private_min_max_scale(load(spark, folder, "customer"), {"c_acctbal": (-1000, 10000)}, 8.0, seed=1)
    return scaled.select("c_custkey", r("c_acctbal", 6).alias("c_acctbal"))


@query("p2_standardize", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def _(spark, folder):
    scaled = privacy.private_standardize(load(spark, folder, "customer"), {"c_acctbal": (-10000, 20000)}, INF)
    return scaled.select("c_custkey", r("c_acctbal", 6).alias("c_acctbal"))


@query("p2_standardize_noisy", f"""SELECT c_custkey, round(({CLAMPED} - m) / s, 6) AS c_acctbal FROM customer, (SELECT avg({CLAMPED}) + {laplace_sql('11000.0 / count(*) / 0.5', 0)} AS m,
 stddev_pop({CLAMPED}) + {laplace_sql('11000.0 / sqrt(count(*)) / 0.5', 1)} AS s FROM customer)""")
def _(spark, folder):
    scaled = privacy.private_standardize(load(spark, folder, "customer"), {"c_acctbal": (-1000, 10000)}, 1.0, seed=1)
    return scaled.select("c_custkey", r("c_acctbal", 6).alias("c_acctbal"))


@query("p6_memorised_rows", """SELECT count(*) AS score FROM (SELECT l_quantity, l_discount, l_tax, l_linenumber FROM lineitem WHERE l_returnflag = 'R'
 INTERSECT SELECT l_quantity, l_discount, l_tax, l_linenumber FROM lineitem WHERE l_returnflag <> 'R')""")
def _(spark, folder):
    rows = load(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "train").otherwise("fake").alias("side"), "l_quantity", "l_discount", "l_tax", "l_linenumber"
    )
    return overlap.exact_duplicates(rows, {"fake_train": ("train", "fake")}).select("score")

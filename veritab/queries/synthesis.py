"""Generation, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions.scalars import named
from veritab.operators import kway, profile, ranks, synth
from veritab.operators.clean import split_complete
from veritab.operators.sides import ColumnTypes
from veritab.queries.common import Registry, big, load, order_pair, r, uniform_sql
from veritab.session import stored

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


def _lines(spark, folder):
    return load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *COLUMNS)


def _model(spark, folder):
    lines = _lines(spark, folder).select(*COLUMNS)
    return lines, synth.fit_slots(lines, profile.build_profile(lines))


# a column with more than a twentieth of zeros is profiled by its other values
K1_SQL = f"""WITH s AS (SELECT count(*) AS n, CASE WHEN avg((c_nationkey = 0)::INT) > 0.05 THEN min(c_nationkey) FILTER (c_nationkey <> 0) ELSE min(c_nationkey) END AS lo,
 max(c_nationkey) AS hi, min(c_acctbal) AS al, max(c_acctbal) AS ah FROM customer),
v AS (SELECT list(c_mktsegment ORDER BY k DESC, c_mktsegment) AS words FROM (SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY 1)),
i AS (SELECT unnest(range(2 * n)) AS id, * FROM s, v)
SELECT id AS {synth.ID}, CAST(id // n AS BIGINT) AS set_id, CAST(floor({uniform_sql(1009, 'id')} * (hi - lo + 1)) + lo AS BIGINT) AS c_nationkey,
 round(al + {uniform_sql(1010, 'id')} * (ah - al), 6) AS c_acctbal, words[1 + floor({uniform_sql(1011, 'id')} * len(words))::INT] AS c_mktsegment FROM i"""


@query("k1_uniform_pseudo", K1_SQL)
def _(spark, folder):
    """Two uniform sets, each as large as the profiled table."""
    customer = load(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    drawn = synth.uniform_pseudo(spark, profile.build_profile(customer), customer.count(), sets=2, seed=1)
    return drawn.select(synth.ID, big("set_id").alias("set_id"), "c_nationkey", r("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


@query("k3_inject_dependencies")
def _(spark, folder):
    """Independent columns from metadata with 2 % nulls, then six random rules."""
    customer = load(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment", "c_name")
    metadata = profile.schema_metadata(customer, categorical=["c_mktsegment", "c_name"])
    pseudo = synth.pseudo_from_metadata(spark, metadata, customer.count(), seed=3, missing_rate=0.02)
    return synth.inject_dependencies(pseudo, metadata, [synth.ID], seed=3)


@query("k3_rank_dependency", """SELECT o_orderkey, round(lo + (hi - lo) * greatest((rk + (c - 1) / 2) / n, 1e-6) - (hi - lo) * 1e-6, 4) AS o_totalprice FROM
 (SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) AS rk, count(*) OVER (PARTITION BY o_custkey) AS c, count(*) OVER () AS n, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders)""")
def _(spark, folder):
    """The number-to-number rule without noise."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    metadata = profile.schema_metadata(orders.select("o_custkey", "o_totalprice"))
    ruled = synth.inject_dependencies(orders, metadata, ["o_orderkey"], rules=[("o_custkey", "o_totalprice")], noise=False)
    return ruled.select("o_orderkey", r("o_totalprice", 4).alias("o_totalprice"))


@query("k3_category_dependency", """WITH v AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code, count(*) OVER () AS k FROM (SELECT DISTINCT p_type FROM part))
 SELECT p_partkey, round(lo + (hi - lo) * (code + 0.5) / k, 4) AS p_retailprice FROM part JOIN v USING (p_type), (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""")
def _(spark, folder):
    """The category-to-number rule without noise."""
    part = load(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    metadata = profile.schema_metadata(part.select("p_type", "p_retailprice"))
    ruled = synth.inject_dependencies(part, metadata, ["p_partkey"], rules=[("p_type", "p_retailprice")], noise=False)
    return ruled.select("p_partkey", r("p_retailprice", 4).alias("p_retailprice"))


def category_sql(table: str, column: str, seed: int, key: str) -> str:
    """Each key of a table with a value of a column drawn by its share, values in order of their counts."""
    return f"""(SELECT k, v FROM (SELECT {key} AS k, {uniform_sql(seed, key)} AS u FROM {table}) JOIN
 (SELECT v, sum(n) OVER w / sum(n) OVER () AS high, (sum(n) OVER w - n) / sum(n) OVER () AS low, row_number() OVER w = count(*) OVER () AS last
  FROM (SELECT {column} AS v, count(*)::DOUBLE AS n FROM {table} GROUP BY 1) WINDOW w AS (ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING)) ON u >= low AND (u < high OR last))"""


@query("k4_weighted_category", f"SELECT k AS p_partkey, v AS brand FROM {category_sql('part', 'p_brand', 2, 'p_partkey')}")
def _(spark, folder):
    """A brand per part, drawn with the brands' shares."""
    part = load(spark, folder, "part")
    built = profile.build_profile(part.select("p_brand"))
    return part.select("p_partkey", synth.weighted_category(built.of("p_brand"), 2, [F.col("p_partkey")]).alias("brand"))


def empirical_sql(table: str, column: str, ids: str, key: str, seed: int) -> str:
    """Each key with the value at a drawn rank of all values."""
    return f"""(SELECT k, v FROM (SELECT {key} AS k, CAST(floor({uniform_sql(seed, key)} * (SELECT count({column}) FROM {table})) AS BIGINT) AS rk FROM {ids})
 JOIN (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS rk FROM {table} WHERE {column} IS NOT NULL) USING (rk))"""


@query("k5_empirical_sample", f"SELECT k AS c_custkey, v AS price FROM {empirical_sql('orders', 'o_totalprice', 'customer', 'c_custkey', 2)}")
def _(spark, folder):
    """An observed price per customer, drawn with its frequency."""
    customers = load(spark, folder, "customer").select("c_custkey")
    return synth.empirical_sample(load(spark, folder, "orders"), "o_totalprice", customers, ["c_custkey"], seed=2, output="price")


@query("k6_sample_from_profile")
def _(spark, folder):
    lines, model = _model(spark, folder)
    ids = spark.range(lines.count()).withColumnRenamed("id", synth.ID)
    return synth.sample_from_profile(ids, model, seed=1, temperature=0.9)


@query("k7_sequential_generate")
def _(spark, folder):
    lines, model = _model(spark, folder)
    ids = spark.range(lines.count()).withColumnRenamed("id", synth.ID)
    return synth.sequential_generate(ids, model, seed=1)


@query("k7_fidelity_of_generated")
def _(spark, folder):
    """Generated against real lineitem rows: overlap per column."""
    from veritab.operators import marginals
    from veritab.operators.sides import tag_sides

    lines, model = _model(spark, folder)
    ids = spark.range(lines.count()).withColumnRenamed("id", synth.ID)
    # read twice, for the ranges and for the bins
    made = stored(synth.sequential_generate(ids, model, seed=1).drop(synth.ID), "generated")
    return marginals.histogram_intersection(tag_sides(lines, made))


# all customers of orders are categories: numbered by falling count, laid end to end, and looked up by the draw
WIDE = """WITH o AS (SELECT o_custkey::VARCHAR AS cust, o_orderpriority AS prio, o_orderkey AS k FROM orders),
 c AS (SELECT cust, n, row_number() OVER (ORDER BY n DESC, cust) AS id FROM (SELECT cust, count(*) AS n FROM o GROUP BY cust)),
 w AS (SELECT prio, row_number() OVER (ORDER BY n DESC, prio) AS pid FROM (SELECT prio, count(*) AS n FROM o GROUP BY prio)),
 t AS (SELECT count(*) AS total FROM o),
 cs AS (SELECT cust, id, (sum(n) OVER (ORDER BY id) - n) / total::DOUBLE AS lo, (sum(n) OVER (ORDER BY id)) / total::DOUBLE AS hi FROM c, t),
 i AS (SELECT unnest(range((SELECT total FROM t))) AS id)"""
K6_WIDE_SQL = f"""{WIDE}, ps AS (SELECT prio, (sum(n) OVER (ORDER BY pid) - n) / total::DOUBLE AS lo, sum(n) OVER (ORDER BY pid) / total::DOUBLE AS hi
 FROM (SELECT prio, pid, count(*) AS n FROM o JOIN w USING (prio) GROUP BY ALL), t)
SELECT i.id AS {synth.ID}, cs.cust, ps.prio FROM i JOIN cs ON {uniform_sql(2003, 'i.id')} >= cs.lo AND {uniform_sql(2003, 'i.id')} < cs.hi
 JOIN ps ON {uniform_sql(2004, 'i.id')} >= ps.lo AND {uniform_sql(2004, 'i.id')} < ps.hi"""
K7_WIDE_SQL = f"""{WIDE}, ps AS (SELECT cust, prio, (sum(n) OVER x - n) / (sum(n) OVER (PARTITION BY cust))::DOUBLE AS lo, sum(n) OVER x / (sum(n) OVER (PARTITION BY cust))::DOUBLE AS hi
 FROM (SELECT cust, prio, pid, count(*) AS n FROM o JOIN w USING (prio) GROUP BY ALL) WINDOW x AS (PARTITION BY cust ORDER BY pid))
SELECT i.id AS {synth.ID}, cs.cust, ps.prio FROM i JOIN cs ON {uniform_sql(2003, 'i.id')} >= cs.lo AND {uniform_sql(2003, 'i.id')} < cs.hi
 JOIN ps ON ps.cust = cs.cust AND {uniform_sql(2004, 'i.id')} >= ps.lo AND {uniform_sql(2004, 'i.id')} < ps.hi"""


def _wide(spark, folder):
    """Orders by customer, a column with very many values, and priority."""
    orders = load(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderpriority").alias("prio"))
    ids = spark.range(orders.count()).withColumnRenamed("id", synth.ID)
    return orders, ids, synth.fit_slots(orders, profile.build_profile(orders))


@query("k6_sample_many_values", K6_WIDE_SQL)
def _(spark, folder):
    _orders, ids, model = _wide(spark, folder)
    return synth.sample_from_profile(ids, model, seed=1)


@query("k7_generate_many_values", K7_WIDE_SQL)
def _(spark, folder):
    """The priority given the customer, who is drawn from all customers."""
    _orders, ids, model = _wide(spark, folder)
    return synth.sequential_generate(ids, model, seed=1)


@query("k9_impute_many_values", f"""{WIDE}, b AS (SELECT CASE WHEN k % 3 <> 0 THEN cust END AS cust, prio, k FROM o),
 d AS (SELECT k, c.cust FROM (SELECT k, {uniform_sql(101 * 2003, 'k')} AS u FROM b WHERE cust IS NULL) JOIN cs c ON u >= c.lo AND u < c.hi)
SELECT k, coalesce(b.cust, d.cust) AS cust, prio FROM b LEFT JOIN d USING (k)""")
def _(spark, folder):
    """Lost customers drawn anew from all of them."""
    orders, _ids, model = _wide(spark, folder)
    rows = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("cust"), F.col("o_orderpriority").alias("prio")
    )
    return synth.impute_rows(rows, model, "k", seed=1)[0]


@query("k8_generate_until", "SELECT count(*) AS accepted, count(*) AS wanted FROM customer")
def _(spark, folder):
    """As many accepted rows as there are customers."""
    customer = load(spark, folder, "customer").select("c_acctbal", "c_mktsegment")
    model = synth.fit_slots(customer, profile.build_profile(customer))
    wanted = customer.count()
    _raw, kept, _log = synth.generate_until(
        spark, wanted, lambda ids, attempt: synth.sample_from_profile(ids, model, seed=attempt), lambda batch: batch.filter("c_acctbal > 0")
    )
    return kept.filter("c_acctbal > 0").agg(F.count("*").alias("accepted"), F.lit(wanted).cast("bigint").alias("wanted"))


@query("k9_impute_rows", "SELECT count(*) AS rows, count(*) AS complete, count(*) FILTER (l_linenumber <> 2) AS unchanged FROM lineitem")
def _(spark, folder):
    """Missing cells filled; the present ones stay."""
    lines, model = _model(spark, folder)
    keyed = _lines(spark, folder).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    holed = keyed.withColumn("was", F.col("l_quantity")).withColumn("l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")))
    holed = holed.withColumn("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")))
    done, _retries = synth.impute_rows(holed, model, "key", seed=1)
    whole, _ = split_complete(done)
    kept = (F.col("l_quantity") == F.col("was")) & (F.col("l_linenumber") != 2)
    return whole.agg(
        F.lit(done.count()).cast("bigint").alias("rows"), F.count("*").alias("complete"), F.count_if(kept).alias("unchanged")
    )


@query("k10_equalize", """SELECT side, least(count(*), (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type = 'view'))) AS n FROM
 (SELECT CASE WHEN event_type = 'view' THEN 'real' ELSE 'fake' END AS side FROM events) GROUP BY side""")
def _(spark, folder):
    pair = load(spark, folder, "events").select(F.when(F.col("event_type") == "view", "real").otherwise("fake").alias("side"), "event_id", "value")
    return ranks.equalize(pair, ["event_id"]).groupBy("side").agg(F.count("*").alias("n"))


K11_SQL = """WITH n AS (SELECT count(*) AS n FROM customer) SELECT part, CAST(size AS BIGINT) AS n FROM (
 SELECT 'test' AS part, ceil(0.2 * n) AS size FROM n UNION ALL SELECT 'val', ceil(0.1 * (n - ceil(0.2 * n))) FROM n UNION ALL
 SELECT 'train', n - ceil(0.2 * n) - ceil(0.1 * (n - ceil(0.2 * n))) FROM n)"""


@query("k11_stratified_split", K11_SQL)
def _(spark, folder):
    parts = synth.stratified_split(load(spark, folder, "customer"), ["c_custkey"], "c_mktsegment")
    return parts.groupBy("part").agg(F.count("*").alias("n"))


@query("k11_split_class_balance", "SELECT c_mktsegment AS label, true AS balanced, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, folder):
    """Every class holds its share of the test part, to the row."""
    parts = synth.stratified_split(load(spark, folder, "customer"), ["c_custkey"], "c_mktsegment")
    per = parts.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("part") == "test").alias("t"))
    return per.select("label", (F.abs(F.col("t") - F.col("n") * 0.2) <= 1).alias("balanced"), "n")


@query("k11_split_metadata", "SELECT c_mktsegment AS label, count(*) AS n, (SELECT count(*) FROM customer) AS size, round(count(*) / (SELECT count(*) FROM customer), 9) AS share FROM customer GROUP BY ALL")
def _(spark, folder):
    parts = synth.stratified_split(load(spark, folder, "customer"), ["c_custkey"], "c_mktsegment")
    table = synth.split_metadata(parts, "c_mktsegment").filter("part = 'total'")
    return table.select("label", "n", "size", r("share").alias("share"))


@query("k12_split_by_seed", """SELECT CAST(s AS BIGINT) AS seed, part, CAST(n AS BIGINT) AS n FROM (SELECT unnest([1000, 1001]) AS s), (SELECT 'train' AS part, count(*) // 2 AS n FROM orders UNION ALL
 SELECT 'valid', count(*) // 10 FROM orders UNION ALL SELECT 'test', count(*) - count(*) // 2 - count(*) // 10 FROM orders)""")
def _(spark, folder):
    orders = load(spark, folder, "orders")
    n = orders.count()
    parts = synth.split_by_seed(orders, ["o_orderkey"], n // 2, n // 10, [1000, 1001])
    return parts.groupBy(big("seed").alias("seed"), "part").agg(F.countDistinct("o_orderkey").alias("n"))


@query("k13_demo_sample", "SELECT CAST(100 AS BIGINT) AS rows, CAST(100 AS BIGINT) AS keys")
def _(spark, folder):
    sample = synth.demo_sample(load(spark, folder, "orders"), ["o_orderkey"], 100, seed=1000)
    return sample.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys"))


@query("k14_subset_distances", "SELECT CAST(10 AS BIGINT) AS subsets, CAST(10 AS BIGINT) AS bounded, count(*) AS n FROM lineitem")
def _(spark, folder):
    """Ten drawn three-column subsets: each distance lies in [0, 1]."""
    lines = _lines(spark, folder).withColumn("side", F.when(F.col("l_orderkey") % 2 == 0, "real").otherwise("fake")).drop("l_orderkey")
    codes = kway.aligned_codes(lines, 10)
    chosen = kway.choose_subsets([c for c in codes.columns if c != "side"], 3, 10, seed=4)
    distances = kway.subset_distances(codes, chosen)
    return distances.agg(
        F.count("*").alias("subsets"), F.count_if(F.col("tvd").between(0, 1)).alias("bounded"), F.lit(lines.count()).cast("bigint").alias("n")
    )


@query("k15_seeded_order", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, folder):
    """A permutation: the same rows, in a drawn order."""
    return synth.seeded_order(load(spark, folder, "customer"), ["c_custkey"], seed=5)

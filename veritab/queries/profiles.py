"""Profile, label, feature and repair queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veritab.functions.scalars import named
from veritab.operators import clean, encode, features, profile
from veritab.operators.sides import ColumnTypes, melt
from veritab.queries.common import Registry, big, load, r

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql

PROFILED = """(SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 7 THEN l_discount END AS l_discount,
 CASE WHEN l_linenumber > 5 THEN 0 ELSE exp(l_discount * 100) * l_extendedprice END AS wide, l_returnflag, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
 CASE WHEN l_linenumber < 7 THEN l_linestatus END AS l_linestatus FROM lineitem)"""
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "wide"]
TEXT = ["l_returnflag", "l_suppkey", "l_linestatus"]
TYPES = ColumnTypes(NUMERIC, TEXT)


def _profiled(spark, folder):
    line = F.col("l_linenumber")
    return load(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", F.when(line != 7, F.col("l_discount")).alias("l_discount"),
        F.when(line > 5, 0.0).otherwise(F.exp(F.col("l_discount") * 100) * F.col("l_extendedprice")).alias("wide"),
        "l_returnflag", F.col("l_suppkey").cast("string").alias("l_suppkey"), F.when(line < 7, F.col("l_linestatus")).alias("l_linestatus"),
    )


def numeric_ctes(c: str) -> str:
    """CTEs ending in `f_<c>`: one row with all numeric profile values of a column."""
    shares = ", ".join(str(i / 100) for i in range(101))
    return f"""a_{c} AS (SELECT avg(CASE WHEN {c} = 0 OR {c} IS NULL THEN 1 ELSE 0 END) > 0.05 AS mixed FROM src),
v_{c} AS MATERIALIZED (SELECT {c}::DOUBLE AS x FROM src, a_{c} WHERE {c} IS NOT NULL AND NOT (mixed AND {c} = 0)),
s_{c} AS (SELECT min(x) AS mn, max(x) AS mx, avg(x) AS mean, skewness(x) AS sk, abs(skewness(x)) > 1 OR (min(x) > 0 AND max(x) / min(x) > 1000) AS lg,
 abs(least(0, min(x))) + 1e-6 AS sh FROM v_{c}),
n_{c} AS (SELECT *, CASE WHEN lg THEN ln(mn + sh) ELSE mn END AS lo, CASE WHEN lg THEN ln(mx + sh) ELSE mx END AS hi FROM s_{c}),
e_{c} AS (SELECT list_sort(list_distinct(quantile_cont((CASE WHEN lg THEN ln(x + sh) ELSE x END - lo) / (hi - lo), [{shares}]))) AS e FROM v_{c}, n_{c}),
f_{c} AS (SELECT *, CASE WHEN len(e) < 101 THEN list_transform(range(101), lambda i: i / 100) ELSE e END AS edges, len(e) < 101 AS grid FROM n_{c}, e_{c}, a_{c})"""


def profile_ctes(columns: list[str]) -> str:
    return f"WITH src AS MATERIALIZED (SELECT * FROM {PROFILED}), " + ", ".join(numeric_ctes(c) for c in columns)


I6_SQL = profile_ctes(NUMERIC) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN mixed THEN 'mixed' ELSE 'numerical' END AS kind, round(mn, 6) AS minimum, round(mx, 3) AS maximum,
 round(mean, 3) AS mean, round(sk, 6) AS skewness, lg AS needs_log, round(lo, 6) AS norm_min, round(hi, 6) AS norm_max,
 round(edges[26], 6) AS edge25, round(edges[76], 6) AS edge75 FROM f_{c}""" for c in NUMERIC)


@query("i6_profile_numeric", I6_SQL)
def _(spark, folder):
    built = profile.build_profile(_profiled(spark, folder), TYPES)
    frame = profile.profile_frame(spark, built).filter("kind <> 'categorical'")
    return frame.select(
        "column", "kind", r("minimum", 6).alias("minimum"), r("maximum", 3).alias("maximum"), r("mean", 3).alias("mean"), r("skewness", 6).alias("skewness"),
        "needs_log", r("norm_min", 6).alias("norm_min"), r("norm_max", 6).alias("norm_max"),
        r(F.get("edges", F.lit(25)), 6).alias("edge25"), r(F.get("edges", F.lit(75)), 6).alias("edge75"),
    )


I6_VOCABULARY_SQL = f"""WITH src AS (SELECT * FROM {PROFILED}), m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, coalesce({c}, 'Missing') AS value FROM src" for c in TEXT) + """),
g AS (SELECT col, value, count(*) AS n, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, value) AS rk FROM m GROUP BY col, value),
t AS (SELECT count(*) AS total FROM src), k AS (SELECT col, value, n / total AS w, CASE WHEN rk <= 50 THEN rk ELSE 51 END AS id FROM g, t WHERE rk <= 50 OR value = 'Missing')
SELECT col AS "column", id, value, round(w, 9) AS weight FROM k UNION ALL SELECT col, 0, '[UNK]', round(greatest(0, 1 - sum(w)), 9) + 0.0 FROM k GROUP BY col"""


@query("i6_profile_vocabulary", I6_VOCABULARY_SQL)
def _(spark, folder):
    built = profile.build_profile(_profiled(spark, folder), TYPES)
    frame = profile.profile_frame(spark, built).filter("kind = 'categorical'")
    cells = frame.select("column", F.posexplode(F.arrays_zip("vocabulary", "weights")).alias("id", "e"))
    return cells.select("column", big("id").alias("id"), F.col("e.vocabulary").alias("value"), r("e.weights").alias("weight"))


LABELLED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
LABEL_TYPES = ColumnTypes(["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])


def label_sql() -> str:
    parts = []
    for c in LABEL_TYPES.numeric:
        z = f"greatest(0, least(1, ({c} - lo) / (hi - lo + 1e-9)))"
        parts.append(f"""SELECT '{c}' AS "column", CASE WHEN mixed THEN 2 ELSE 0 END AS col_type_id,
 CASE WHEN mixed AND ({c} IS NULL OR {c} = 0) THEN -100 ELSE greatest(0, least(99, CASE WHEN grid THEN floor({z} * 100) ELSE len(list_filter(edges, lambda e: e <= {z})) - 1 END)) END AS slot,
 CASE WHEN mixed AND {c} <> 0 THEN 1.0 ELSE 0.0 END AS mask FROM src, f_{c}""")
    for c in LABEL_TYPES.categorical:
        parts.append(f"""SELECT '{c}', 1, (SELECT rk FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS rk FROM
 (SELECT coalesce({c}, 'Missing') AS v, count(*) AS n FROM src GROUP BY 1)) q WHERE q.v = coalesce(src.{c}, 'Missing')), 0.0 FROM src""")
    return profile_ctes(LABEL_TYPES.numeric) + f""" SELECT "column", CAST(col_type_id AS BIGINT) AS col_type_id, CAST(slot AS BIGINT) AS slot,
 CAST(mask AS DOUBLE) AS mask, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3, 4"""


@query("i7_row_labels", label_sql())
def _(spark, folder):
    table = _profiled(spark, folder).select(*LABELLED)
    built = profile.build_profile(table, LABEL_TYPES)
    labels = encode.encode_labels(table, built, keep=[])

    def one_word(label, i):
        slot = F.when(label["col_type_id"] == 0, label["num_bin"]).when(label["col_type_id"] == 1, label["cat_id"]).otherwise(label["mixed_bin"])
        return F.concat_ws("|", i, label["col_type_id"], slot, label["mixed_mask"])

    counts = labels.select(F.explode(F.transform("labels", one_word)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    part = F.split("w", r"\|")
    name = F.get(F.array(*[F.lit(c) for c in built.columns]), F.get(part, F.lit(0)).cast("int"))
    return counts.select(
        name.alias("column"), big(F.get(part, F.lit(1))).alias("col_type_id"), big(F.get(part, F.lit(2))).alias("slot"),
        F.get(part, F.lit(3)).cast("double").alias("mask"), "n",
    )


I8_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", CAST(0 AS BIGINT) AS changed FROM lineitem""" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"])


@query("i7_labels_of_many_values", """WITH c AS (SELECT cust, n, row_number() OVER (ORDER BY n DESC, cust) AS id FROM (SELECT coalesce(o_custkey::VARCHAR, 'Missing') AS cust, count(*) AS n FROM orders GROUP BY 1))
SELECT o_orderkey, id AS cat_id, cust AS back FROM orders JOIN c ON cust = coalesce(o_custkey::VARCHAR, 'Missing')""")
def _(spark, folder):
    """All customers are categories; the ids and what they decode to."""
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"))
    built = profile.build_profile(orders.select("cust"))
    coded = encode.encode_labels(orders, built, keep=["o_orderkey"])
    back = encode.decode_labels(coded, built, keep=["o_orderkey", "labels"])
    return back.select("o_orderkey", big(F.get("labels", F.lit(0))["cat_id"]).alias("cat_id"), F.col("cust").alias("back"))


@query("i8_decode_labels", I8_SQL)
def _(spark, folder):
    """Decoding the labels of a row gives the row back, to a part in 10^6 of the range."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    table = load(spark, folder, "lineitem").select(*columns)
    built = profile.build_profile(table)
    coded = encode.encode_labels(table.select(*columns, *[named(c).alias(f"was_{c}") for c in columns]), built, keep=[f"was_{c}" for c in columns])
    back = encode.decode_labels(coded, built, keep=[f"was_{c}" for c in columns])
    cells = {}
    for c in columns:
        info = built.of(c)
        if info.kind == "categorical":
            cells[c] = (named(c) != named(f"was_{c}")).cast("int")
        else:
            cells[c] = (F.abs(named(c) - named(f"was_{c}")) > 1e-6 * (info.maximum - info.minimum)).cast("int")
    return melt(back, cells, []).groupBy("column").agg(F.count("*").alias("rows"), big(F.sum("value")).alias("changed"))


I9_SQL = """WITH s AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY o_orderstatus) - 1 AS i, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT count(*) AS k FROM s)
SELECT i AS slot, CAST(n AS DOUBLE) AS total, CAST(n AS DOUBLE) AS squares FROM s UNION ALL SELECT k, 0.0::DOUBLE, CAST((SELECT count(*) FROM orders) AS DOUBLE) FROM k
UNION ALL SELECT k + 1 + i, CAST(n AS DOUBLE), CAST(n AS DOUBLE) FROM p, k"""


@query("i9_feature_sums", I9_SQL)
def _(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    space = features.fit_features(orders, numeric="standard")
    vectors = features.transform_features(orders, space).select(F.posexplode(vector_to_array("features")).alias("slot", "x"))
    sums = vectors.groupBy(big("slot").alias("slot")).agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))
    return sums.select("slot", r("total", 4).alias("total"), r("squares", 4).alias("squares"))


I9_BACK = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders"


@query("i9_inverse_features", I9_BACK)
def _(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    types = ColumnTypes(["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    space = features.fit_features(orders.drop("o_orderkey"), types, numeric="minmax")
    coded = features.transform_features(orders, space)
    back = features.inverse_features(coded, space, keep=["o_orderkey"])
    return back.select("o_orderkey", "o_orderstatus", r("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority")


@query("i10_mixture_modes")
def _(spark, folder):
    """Scaled value and drawn component per order, with the value they decode to."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    space = features.fit_mixture(orders, "o_totalprice", components=5)
    coded = features.encode_mixture(orders, "o_totalprice", space, ["o_orderkey"], seed=7)
    return coded.select("o_orderkey", "o_totalprice", "mode.scaled", "mode.component", features.decode_mixture(F.col("mode"), space).alias("decoded"))


I11_SQL = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(CAST(l_quantity AS DOUBLE), 4) AS l_quantity, round(l_tax, 4) AS l_tax, round(l_extendedprice, 3) AS l_extendedprice FROM lineitem"


@query("i11_square_image", I11_SQL)
def _(spark, folder):
    lines = load(spark, folder, "lineitem")
    names = ["l_quantity", "l_tax", "l_extendedprice"]
    row = lines.agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]).first()
    ranges = {c: (float(row[f"lo_{c}"]), float(row[f"hi_{c}"])) for c in names}
    images = features.square_scale(lines, ranges, 2, keep=["l_orderkey", "l_linenumber"])
    back = features.square_unscale(images, ranges, {"l_quantity"}, keep=["l_orderkey", "l_linenumber"])
    return back.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), r("l_quantity", 4).alias("l_quantity"), r("l_tax", 4).alias("l_tax"), r("l_extendedprice", 3).alias("l_extendedprice"))


@query("i12_onehot_union_fit", """WITH v AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS slot FROM (SELECT DISTINCT p_brand AS b FROM part UNION SELECT DISTINCT p_type FROM part))
 SELECT slot, (SELECT count(*) FROM part WHERE p_brand = b) AS real, (SELECT count(*) FROM part WHERE p_type = b) AS fake FROM v""")
def _(spark, folder):
    part = load(spark, folder, "part")
    real, fake = part.select(F.col("p_brand").alias("b")), part.select(F.col("p_type").alias("b"))
    both = real.withColumn("side", F.lit("real")).unionByName(fake.withColumn("side", F.lit("fake")))
    space = features.fit_features(both.select("b"))
    vectors = features.transform_features(both, space).select("side", F.posexplode(vector_to_array("features")).alias("slot", "x"))
    return vectors.groupBy(big("slot").alias("slot")).agg(
        big(F.sum(F.when(F.col("side") == "real", F.col("x")))).alias("real"), big(F.sum(F.when(F.col("side") == "fake", F.col("x")))).alias("fake")
    )


@query("i13_value_ids", """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, CAST(0 AS BIGINT) AS column_id, CAST(0 AS BIGINT) AS discrete_column_id, row_number() OVER (ORDER BY o_orderstatus) - 1 AS value_id FROM (SELECT DISTINCT o_orderstatus FROM orders)
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, 2, 1, row_number() OVER (ORDER BY o_orderpriority) - 1 FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def _(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    ids = features.value_ids(features.fit_features(orders))
    return spark.createDataFrame(ids, "column string, value string, column_id bigint, discrete_column_id bigint, value_id bigint")


K2_SQL = """SELECT 'c_custkey' AS name, 'num' AS dtype, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max, 'int' AS kind, CAST(NULL AS BIGINT) AS categories FROM customer
 UNION ALL SELECT 'c_acctbal', 'num', min(c_acctbal), max(c_acctbal), 'float', NULL FROM customer
 UNION ALL SELECT 'c_nationkey', 'cat', NULL, NULL, NULL, count(DISTINCT c_nationkey) FROM customer
 UNION ALL SELECT 'c_mktsegment', 'cat', NULL, NULL, NULL, count(DISTINCT c_mktsegment) FROM customer
 UNION ALL SELECT 'c_name', 'cat', NULL, NULL, NULL, count(DISTINCT c_name) FROM customer"""


@query("k2_schema_metadata", K2_SQL)
def _(spark, folder):
    customer = load(spark, folder, "customer")
    return profile.metadata_frame(customer, profile.schema_metadata(customer, categorical=["c_nationkey"]))


B12_SQL = """WITH t AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'Brand#x' WHEN p_size = 8 THEN NULL ELSE lower(p_brand) END AS b, CASE WHEN p_size = 9 THEN 'None' ELSE upper(p_type) END AS t,
 CASE WHEN p_size = 10 THEN 'ten' ELSE CAST(p_size AS VARCHAR) END AS s FROM part),
v AS (SELECT DISTINCT p_brand FROM part), w AS (SELECT DISTINCT p_type FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, v.p_brand, w.p_type, TRY_CAST(s AS BIGINT) AS p_size FROM t LEFT JOIN v ON lower(v.p_brand) = lower(t.b) LEFT JOIN w ON lower(w.p_type) = lower(t.t)"""


def _damaged(spark, folder):
    part = load(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    built = profile.build_profile(part)
    size = F.col("p_size")
    damaged = part.select(
        F.col("p_partkey").cast("string").alias("P_PARTKEY"),
        F.when(size == 7, "Brand#x").when(size == 8, None).otherwise(F.lower("p_brand")).alias("P_Brand"),
        F.when(size == 9, "None").otherwise(F.upper("p_type")).alias("p_TYPE"),
        F.when(size == 10, "ten").otherwise(size.cast("string")).alias("p_size"),
    )
    return damaged, built


@query("b12_repair_rows", B12_SQL)
def _(spark, folder):
    damaged, built = _damaged(spark, folder)
    return clean.repair_rows(damaged, built)


@query("b12_repair_many_values", """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size <> 7 THEN p_name END AS p_name,
 CASE WHEN p_size <> 8 THEN p_brand END AS p_brand FROM part""")
def _(spark, folder):
    """A column with as many values as rows keeps all of them."""
    part = load(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    size = load(spark, folder, "part").select(F.col("p_partkey").alias("key"), "p_size")
    damaged = part.join(size, F.col("p_partkey") == F.col("key")).select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        F.when(F.col("p_size") == 7, "no such name").otherwise(F.upper("p_name")).alias("P_NAME"),
        F.when(F.col("p_size") == 8, F.lit(None)).otherwise(F.lower("p_brand")).alias("p_brand"),
    )
    return clean.repair_rows(damaged, profile.build_profile(part))


@query("b12_repair_rows_dropna", f"SELECT * FROM ({B12_SQL}) WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL")
def _(spark, folder):
    damaged, built = _damaged(spark, folder)
    return clean.repair_rows(damaged, built, dropna=True)

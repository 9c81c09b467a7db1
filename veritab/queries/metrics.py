"""Fidelity, association and discretiser queries (H, J, I1-I5, C1, C2, C6, U1)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from veritab.operators import associations as assoc
from veritab.operators import kway, marginals, overlap, ranks
from veritab.operators.sides import SIDE, ColumnTypes, tag_sides
from veritab.queries.common import LINE_PAIR, ORDER_PAIR, big, line_pair, load, order_pair, parity_side, r

ORDER_TYPES = ColumnTypes(["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
LINE_TYPES = ColumnTypes(
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_linenumber"]
)
KWAY_TYPES = ColumnTypes(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_linenumber"])


# ------------------------------------------------------------------ SQL pieces
def histogram_sql(source: str, types: ColumnTypes, bins: int = 50) -> str:
    """CTEs up to `m(col, kind, bin, cat, n_real, n_fake, p, q)`."""
    ranges = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in types.numeric)
    cells = [
        f"""SELECT side, '{c}' AS col, 'numerical' AS kind,
 CAST(least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {bins - 1}), {bins - 2}) AS INTEGER) AS bin,
 CAST(NULL AS VARCHAR) AS cat FROM pair, fit WHERE {c} IS NOT NULL"""
        for c in types.numeric
    ] + [f"SELECT side, '{c}', 'categorical', 0, coalesce({c}, 'nan') FROM pair" for c in types.categorical]
    return f"""WITH pair AS (SELECT * FROM {source}), fit AS (SELECT {ranges} FROM pair),
cells AS ({' UNION ALL '.join(cells)}),
h AS (SELECT col, kind, bin, cat, count(*) FILTER (side = 'real') AS n_real, count(*) FILTER (side = 'fake') AS n_fake
 FROM cells GROUP BY col, kind, bin, cat),
m AS (SELECT *, n_real / sum(n_real) OVER (PARTITION BY col) AS p, n_fake / sum(n_fake) OVER (PARTITION BY col) AS q
 FROM h)"""


def placed_sql(source: str, types: ColumnTypes, bins: int = 50) -> str:
    return histogram_sql(source, types, bins) + f""",
k AS (SELECT col, kind, p, q,
 CASE WHEN kind = 'numerical' THEN bin ELSE row_number() OVER (PARTITION BY col ORDER BY bin, cat) - 1 END AS place,
 CASE WHEN kind = 'numerical' THEN {bins - 1} ELSE count(*) OVER (PARTITION BY col) END AS places,
 CASE WHEN kind = 'numerical' THEN 1.0::DOUBLE / {bins - 1} ELSE 1.0 END AS width FROM m),
s AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq,
 coalesce(lead(place) OVER w - place, CASE WHEN kind = 'numerical' THEN 0 ELSE places - place - 1 END) AS reach
 FROM k WINDOW w AS (PARTITION BY col ORDER BY place))"""


def column_scores_sql(source: str, types: ColumnTypes, expression: str, metric: str) -> str:
    return histogram_sql(source, types) + f"""
SELECT col AS "column", kind AS column_type, '{metric}' AS metric, round({expression}, 9) + 0.0 AS score,
 round({expression}, 9) + 0.0 AS normalized_score FROM m GROUP BY col, kind"""


OVERLAP = "sum(least(p, q))"
JACCARD = "sum(least(p, q)) / sum(greatest(p, q))"
JSD = """sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"""


def _rounded_scores(df):
    return df.select("column", "column_type", "metric", r("score").alias("score"), r("normalized_score").alias("normalized_score"))


def code_list_sql(columns_sql: dict[str, str], subsets: list[tuple[str, ...]], ddof: str) -> str:
    """k-way summary over a CTE `codes(side, ...)`; `ddof` is stddev_pop or stddev_samp."""
    parts = []
    for subset in subsets:
        keys = ", ".join(subset)
        parts.append(
            f"""SELECT {len(subset)} AS k, (SELECT sum(abs(a / (SELECT count(*) FROM codes WHERE side = 'real')
 - b / (SELECT count(*) FROM codes WHERE side = 'fake'))) / 2 FROM (SELECT count(*) FILTER (side = 'real') AS a,
 count(*) FILTER (side = 'fake') AS b FROM codes GROUP BY {keys})) AS tvd"""
        )
    select = ", ".join(f"{sql} AS {name}" for name, sql in columns_sql.items())
    return f"""codes AS MATERIALIZED (SELECT side, {select} FROM pair, fit), t AS ({' UNION ALL '.join(parts)})
SELECT CAST(k AS BIGINT) AS k, round(avg(tvd), 9) AS tvd_mean, round(coalesce({ddof}(tvd), 0), 9) AS tvd_std,
 count(*) AS subsets FROM t GROUP BY k"""


def quantile_list(column: str, pieces: int) -> str:
    shares = ", ".join(str(i / pieces) for i in range(pieces + 1))
    return f"list_sort(list_distinct(quantile_cont({column}::DOUBLE, [{shares}])))"


KWAY_COLUMNS = [*KWAY_TYPES.numeric, *KWAY_TYPES.categorical]
KWAY_SUBSETS = [s for k in range(1, 6) for s in combinations(KWAY_COLUMNS, k)]


def aligned_sql() -> str:
    fit = ", ".join(f"{quantile_list(c, 10)} AS e_{c}" for c in KWAY_TYPES.numeric)
    codes = {
        c: f"""CASE WHEN {c} IS NULL OR {c} < e_{c}[1] OR {c} > e_{c}[-1] THEN -1
 ELSE greatest(len(list_filter(e_{c}, lambda e: e < {c})) - 1, 0) END"""
        for c in KWAY_TYPES.numeric
    } | {c: f"lower(trim({c}))" for c in KWAY_TYPES.categorical}
    return (
        f"WITH pair AS (SELECT * FROM {LINE_PAIR}), fit AS (SELECT {fit} FROM pair WHERE side = 'real'), "
        + code_list_sql(codes, KWAY_SUBSETS, "stddev_pop")
    )


def fitted_sql() -> str:
    fit = ", ".join(f"{quantile_list(c, 20)} AS e_{c}" for c in KWAY_TYPES.numeric)
    codes = {
        c: f"CASE WHEN {c} IS NULL THEN 0 ELSE len(list_filter(e_{c}[2:-2], lambda e: e <= {c})) END"
        for c in KWAY_TYPES.numeric
    } | {c: c for c in KWAY_TYPES.categorical}
    return (
        f"WITH pair AS (SELECT * FROM {LINE_PAIR}), fit AS (SELECT {fit} FROM pair), "
        + code_list_sql(codes, KWAY_SUBSETS, "stddev_samp")
    )


def similarity_sql(source: str = LINE_PAIR, types: ColumnTypes = LINE_TYPES) -> str:
    fit = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in types.numeric)
    codes = []
    for c in types.numeric:
        z = f"(({c} - lo_{c}) / (hi_{c} - lo_{c}))"
        codes.append(
            f"""coalesce(CASE WHEN {z} BETWEEN 0 AND 1 THEN CAST(CAST(greatest(ceil({z} * 49) - 1, 0) AS INTEGER) AS VARCHAR)
 END, CASE WHEN side = 'fake' THEN '0' END) AS {c}"""
        )
    codes += types.categorical
    parts = [
        f"""SELECT '{a},{b}' AS columns, (WITH g AS (SELECT count(*) FILTER (side = 'real') AS x,
 count(*) FILTER (side = 'fake') AS y FROM codes WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b})
 SELECT 1 - sum(abs(x / (SELECT sum(x) FROM g) - y / (SELECT sum(y) FROM g))) / 2 FROM g) AS similarity"""
        for a, b in combinations([*types.numeric, *types.categorical], 2)
    ]
    return f"""WITH pair AS (SELECT * FROM {source}), fit AS (SELECT {fit} FROM pair WHERE side = 'real'),
codes AS MATERIALIZED (SELECT side, {', '.join(codes)} FROM pair, fit), t AS ({' UNION ALL '.join(parts)})"""


# ------------------------------------------------------------ association SQL
A_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
A_CAT = ["l_returnflag", "l_linestatus", "l_linenumber"]
A_TYPES = ColumnTypes(A_NUM, A_CAT)


def association_base_sql(source: str, types: ColumnTypes = A_TYPES) -> str:
    """CTE `t` with NULL policy applied."""
    numbers = ", ".join(f"coalesce({c}, 0) AS {c}" for c in types.numeric)
    texts = ", ".join(f"coalesce({c}, '__NA__') AS {c}" for c in types.categorical)
    return f"t AS MATERIALIZED (SELECT side, {numbers}, {texts} FROM {source})"


def pearson_sql(types: ColumnTypes = A_TYPES) -> list[str]:
    return [
        f"SELECT side, '{a}' AS col_a, '{b}' AS col_b, 'pearson' AS kind, corr({a}, {b}) AS value FROM t GROUP BY side"
        for a, b in combinations(types.numeric, 2)
    ]


def ratio_sql(types: ColumnTypes = A_TYPES) -> list[str]:
    return [
        f"""SELECT side, '{a}' AS col_a, '{y}' AS col_b, 'correlation_ratio' AS kind, sqrt(sum(n * (m - o) * (m - o))
 / max(n_all * v)) AS value FROM (SELECT side, {a}, count(*) AS n, avg({y}) AS m FROM t GROUP BY side, {a})
 JOIN (SELECT side, avg({y}) AS o, var_pop({y}) AS v, count(*) AS n_all FROM t GROUP BY side) USING (side) GROUP BY side"""
        for a in types.categorical for y in types.numeric
    ]


def cell_sql(a: str, b: str) -> str:
    return f"""(SELECT *, sum(n) OVER (PARTITION BY side, a) AS na, sum(n) OVER (PARTITION BY side, b) AS nb,
 sum(n) OVER (PARTITION BY side) AS nn FROM (SELECT side, {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM t GROUP BY side, {a}, {b}))"""


def cramer_sql(types: ColumnTypes = A_TYPES) -> list[str]:
    return [
        f"""SELECT side, '{a}' AS col_a, '{b}' AS col_b, 'cramers_v' AS kind,
 sqrt(greatest(0, phi - (k - 1) * (r - 1) / (nn - 1)) / (least(r - (r - 1) * (r - 1) / (nn - 1), k - (k - 1) * (k - 1) / (nn - 1)) - 1)) AS value
 FROM (SELECT side, sum(n * n / (na * nb)) - 1 AS phi, max(nn) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS k
 FROM {cell_sql(a, b)} GROUP BY side)"""
        for a, b in combinations(types.categorical, 2)
    ]


def theil_sql() -> list[str]:
    return [
        f"""SELECT side, '{a}' AS col_a, '{b}' AS col_b, 'theils_u' AS kind,
 (h - sum(-n / nn * ln(n / nb))) / h AS value FROM {cell_sql(a, b)} JOIN (SELECT side, sum(-x / y * ln(x / y)) AS h FROM
 (SELECT side, {a}, count(*)::DOUBLE AS x, sum(count(*)) OVER (PARTITION BY side)::DOUBLE AS y FROM t GROUP BY side, {a}) GROUP BY side) USING (side)
 GROUP BY side, h"""
        for a in A_CAT for b in A_CAT if a != b
    ]


def long_sql(parts: list[str], source: str = LINE_PAIR) -> str:
    return f"""WITH {association_base_sql(source)} SELECT side, col_a, col_b, kind, round(value, 8) + 0.0 AS value
FROM ({' UNION ALL '.join(parts)})"""


def matrix_sql(source: str = LINE_PAIR, types: ColumnTypes = A_TYPES) -> str:
    parts = " UNION ALL ".join(pearson_sql(types) + ratio_sql(types) + cramer_sql(types))
    diagonal = " UNION ALL ".join(
        f"SELECT DISTINCT side, '{c}', '{c}', 'self', 1.0::DOUBLE FROM t" for c in [*types.numeric, *types.categorical]
    )
    return f"""WITH {association_base_sql(source, types)}, u AS ({parts}),
f AS (SELECT * FROM u UNION ALL SELECT side, col_b, col_a, kind, value FROM u UNION ALL {diagonal}),
c AS (SELECT col_a, col_b, max(value) FILTER (side = 'real') AS x, max(value) FILTER (side = 'fake') AS y FROM f GROUP BY col_a, col_b)"""


LEVEL = "CASE WHEN abs({0}) < 0.1 THEN 'low' WHEN abs({0}) < 0.3 THEN 'weak' WHEN abs({0}) < 0.5 THEN 'middle' ELSE 'strong' END"


def _long(df):
    return df.select("side", "col_a", "col_b", "kind", r("value", 8).alias("value"))


# ----------------------------------------------------------------- Spark side
def _h1(spark, folder):
    return _rounded_scores(marginals.histogram_intersection(line_pair(spark, folder), types=LINE_TYPES))


def _h2(spark, folder):
    third = F.col("l_orderkey") % 3
    three = load(spark, folder, "lineitem").select(
        F.when(third == 0, "test").when(third == 1, "train").otherwise("fake").alias(SIDE),
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    )
    return marginals.histogram_summary(three).select("tag", "scorer", r("score").alias("score"))


def h2_sql() -> str:
    numeric, text = ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]

    def scores(tag: str, other: str) -> str:
        parts = [
            f"""SELECT '{tag}' AS tag, '{c}' AS col, (WITH b AS (SELECT side, least(floor(({c} - lo) / (hi - lo) * 49), 48) AS v
 FROM s, (SELECT min({c}) AS lo, max({c}) AS hi FROM s WHERE side IN ('test', '{other}')) WHERE side IN ('test', '{other}')),
 g AS (SELECT count(*) FILTER (side = 'test') AS a, count(*) FILTER (side <> 'test') AS d FROM b GROUP BY v)
 SELECT sum(least(a / (SELECT sum(a) FROM g), d / (SELECT sum(d) FROM g))) FROM g) AS score"""
            for c in numeric
        ] + [
            f"""SELECT '{tag}', '{c}', (WITH g AS (SELECT count(*) FILTER (side = 'test') AS a, count(*) FILTER (side <> 'test') AS d
 FROM s WHERE side IN ('test', '{other}') GROUP BY {c})
 SELECT sum(least(a / (SELECT sum(a) FROM g), d / (SELECT sum(d) FROM g))) FROM g)"""
            for c in text
        ]
        return " UNION ALL ".join(parts)

    return f"""WITH s AS MATERIALIZED (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'fake' END AS side, * FROM lineitem),
u AS MATERIALIZED ({scores('real', 'train')} UNION ALL {scores('fake', 'fake')})
SELECT tag, 'mean' AS scorer, round(avg(score), 9) AS score FROM u GROUP BY tag
UNION ALL SELECT 'fake', 'l2_dist', round(sqrt(sum(power(x.score - y.score, 2))), 9)
FROM u x JOIN u y ON x.col = y.col AND x.tag = 'real' AND y.tag = 'fake'"""


def _h4(spark, folder, theil=False):
    pair = ranks.equalize(order_pair(spark, folder), ["o_orderkey"]).drop("o_orderkey")
    scored = marginals.column_correlation(pair, ORDER_TYPES, theils_u=theil)
    return scored.select(
        "column", "column_type", "correlation_metric", r("score", 8).alias("score"),
        r("normalized_score", 8).alias("normalized_score"), "metric",
    )


def h4_sql(theil: bool) -> str:
    parts = []
    for c in ORDER_TYPES.categorical:
        cell = f"""(SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS nn FROM
 (SELECT x.v AS a, y.v AS b, count(*)::DOUBLE AS n FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM pair WHERE side = 'real') x
 JOIN (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM pair WHERE side = 'fake') y USING (i) GROUP BY x.v, y.v))"""
        if theil:
            score = f"""(SELECT (h - g) / h FROM (SELECT sum(-n / nn * ln(n / nb)) AS g FROM {cell}),
 (SELECT sum(-z / nn * ln(z / nn)) AS h FROM (SELECT a, sum(n) AS z, max(nn) AS nn FROM {cell} GROUP BY a)))"""
        else:
            score = f"""(SELECT sqrt(greatest(0, phi - (k - 1) * (r - 1) / (nn - 1)) / (least(r - (r - 1) * (r - 1) / (nn - 1),
 k - (k - 1) * (k - 1) / (nn - 1)) - 1)) FROM (SELECT sum(n * n / (na * nb)) - 1 AS phi, max(nn) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM {cell}))"""
        kind = "theils_u" if theil else "cramers_v"
        parts.append(f"SELECT '{c}' AS col, 'categorical' AS kind, '{kind}' AS cm, {score} AS s, {score} AS ns")
    parts.append(
        """SELECT 'o_totalprice', 'numerical', 'pearson', s, (s + 1) / 2 FROM (SELECT corr(x.v, y.v) AS s FROM
 (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i FROM pair WHERE side = 'real') x
 JOIN (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i FROM pair WHERE side = 'fake') y USING (i))"""
    )
    return f"""WITH pair AS (SELECT * FROM {ORDER_PAIR}), u AS ({' UNION ALL '.join(parts)})
SELECT col AS "column", kind AS column_type, cm AS correlation_metric, round(s, 8) AS score,
 round(ns, 8) AS normalized_score, 'column_correlation' AS metric FROM u"""


def _h9(spark, folder):
    scored = kway.pairwise_similarity(line_pair(spark, folder), types=LINE_TYPES)
    return scored.select(r("score").alias("score"), r("normalized_score").alias("normalized_score"), "metric")


def _i3(spark, folder):
    return kway.pair_similarities(line_pair(spark, folder), LINE_TYPES).select("columns", r("similarity").alias("similarity"))


def _kway(df):
    return df.select(big("k").alias("k"), r("tvd_mean").alias("tvd_mean"), r("tvd_std").alias("tvd_std"), "subsets")


def _h14(spark, folder):
    return _kway(kway.kway_aligned(line_pair(spark, folder), [1, 2, 3, 4, 5], types=KWAY_TYPES))


def _h15(spark, folder):
    pair = line_pair(spark, folder)
    return _kway(kway.kway_fitted(pair, pair.drop(SIDE), [1, 2, 3, 4, 5], types=KWAY_TYPES))


PART_PAIR = """(SELECT CASE WHEN p_partkey % 3 = 0 THEN 'test' WHEN p_partkey % 3 = 1 THEN 'train' ELSE 'fake' END AS side,
 p_brand, p_type, CASE WHEN p_size > 45 THEN NULL ELSE p_size END AS p_size FROM part)"""
DUPLICATE_TAGS = {"real": ("test", "train"), "fake_train": ("train", "fake"), "fake": ("test", "fake")}


def _part_three(spark, folder):
    third = F.col("p_partkey") % 3
    return load(spark, folder, "part").select(
        F.when(third == 0, "test").when(third == 1, "train").otherwise("fake").alias(SIDE),
        "p_brand", "p_type", F.when(F.col("p_size") <= 45, F.col("p_size")).alias("p_size"),
    )


def _h13(spark, folder):
    return overlap.exact_duplicates(_part_three(spark, folder), DUPLICATE_TAGS)


H13_SQL = f"WITH s AS (SELECT * FROM {PART_PAIR}) " + " UNION ALL ".join(
    f"""SELECT '{tag}' AS tag, (SELECT count(*) FROM (SELECT p_brand, p_type, p_size FROM s WHERE side = '{a}'
 INTERSECT SELECT p_brand, p_type, p_size FROM s WHERE side = '{b}')) AS score"""
    for tag, (a, b) in DUPLICATE_TAGS.items()
)

OOV_COLUMNS = ["brand_size", "p_type", "p_size"]
OOV_PAIR = """(SELECT CASE WHEN p_partkey % 4 <> 0 THEN 'real' ELSE 'fake' END AS side,
 concat(p_brand, '/', p_size, '/', p_type) AS brand_size, p_type, CAST(CASE WHEN p_size > 40 AND p_partkey % 4 <> 0 THEN NULL ELSE p_size END AS VARCHAR) AS p_size FROM part)"""


def _oov_pair(spark, folder):
    train = F.col("p_partkey") % 4 != 0
    return load(spark, folder, "part").select(
        F.when(train, "real").otherwise("fake").alias(SIDE),
        F.concat_ws("/", "p_brand", "p_size", "p_type").alias("brand_size"), "p_type",
        F.when(~((F.col("p_size") > 40) & train), F.col("p_size")).cast("string").alias("p_size"),
    )


def oov_base_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT side, '{c}' AS col, coalesce({c}, '__NA__') AS value FROM s" for c in OOV_COLUMNS)
    return f"""WITH s AS (SELECT * FROM {OOV_PAIR}), c AS ({cells}),
g AS (SELECT col, value, count(*) FILTER (side = 'real') AS a, count(*) FILTER (side = 'fake') AS b FROM c GROUP BY col, value)"""


def _h16(spark, folder):
    return overlap.oov_summary(_oov_pair(spark, folder), OOV_COLUMNS).select(
        "column", "oov_count", "oov_values", r("oov_rate").alias("oov_rate")
    )


def _h16_top(spark, folder, unseen=True):
    top = overlap.oov_top(_oov_pair(spark, folder), OOV_COLUMNS, k=10 if unseen else 5, only_unseen=unseen)
    return top.select("column", "value", "n", big("rank").alias("rank"))


def oov_top_sql(unseen: bool) -> str:
    return oov_base_sql() + f""" SELECT col AS "column", value, b AS n, rank FROM (SELECT *, row_number() OVER
 (PARTITION BY col ORDER BY b DESC, value) AS rank FROM g WHERE b > 0{' AND a = 0' if unseen else ''}) WHERE rank <= {10 if unseen else 5}"""


def _h17(spark, folder):
    documents = load(spark, folder, "documents")
    labels = load(spark, folder, "labels")
    joined = documents.select("doc_id", "lang", "n_chars", "source").join(labels, "doc_id")
    summary = overlap.group_summary(joined, [F.col("quality")], "toxic", "n_chars", "source")
    return summary.select(
        big("quality").alias("quality"), "n", r("positive_share").alias("positive_share"),
        r("positive_mean").alias("positive_mean"), r("mean").alias("mean"), "top",
    )


H17_SQL = """WITH j AS (SELECT l.quality, l.toxic, d.n_chars, d.source FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT quality, source, count(*) AS n, row_number() OVER (PARTITION BY quality ORDER BY count(*) DESC, source) AS rk
 FROM j GROUP BY quality, source),
b AS (SELECT quality, string_agg(source || ':' || n, ',' ORDER BY rk) AS top FROM g WHERE rk <= 5 GROUP BY quality),
a AS (SELECT quality, count(*) AS n, avg(CASE WHEN toxic > 0 THEN 1 ELSE 0 END) AS s, avg(toxic) AS t, avg(n_chars) AS m
 FROM j GROUP BY quality)
SELECT CAST(a.quality AS BIGINT) AS quality, a.n, round(s, 9) AS positive_share, round(t, 9) AS positive_mean,
 round(m, 9) AS mean, b.top FROM a JOIN b USING (quality)"""


def _h18(spark, folder):
    events = load(spark, folder, "events")
    ok = (F.col("value") > 0) & F.col("event_type").isin("view", "click", "purchase")
    table = overlap.acceptance(events, ok, F.col("user_id") * 0 + 1000, ["event_type"])
    return table.select(
        "event_type", "total_sampled", "total_processed", big("total_expected").alias("total_expected"), r("rate").alias("rate")
    )


H18_SQL = """SELECT event_type, count(*) AS total_sampled,
 count(*) FILTER (value > 0 AND event_type IN ('view', 'click', 'purchase')) AS total_processed, CAST(1000 AS BIGINT) AS total_expected,
 round(count(*) FILTER (value > 0 AND event_type IN ('view', 'click', 'purchase')) / count(*), 9) AS rate
FROM events GROUP BY event_type"""


def _h10(spark, folder):
    matrix = assoc.association_matrix(line_pair(spark, folder), A_TYPES)
    return matrix.select("side", "col_a", "col_b", "kind", r("value", 8).alias("value"))


def _h11(spark, folder):
    scored = assoc.associations_difference(line_pair(spark, folder), A_TYPES)
    return scored.select("column", r("score", 8).alias("score"), "metric")


def _h12(spark, folder):
    scored = assoc.correlation_accuracy(line_pair(spark, folder), A_TYPES)
    return scored.select(r("score").alias("score"), "metric")


def _i1(spark, folder):
    table = marginals.histogram_table(line_pair(spark, folder), LINE_TYPES)
    return table.select("column", "column_type", big("bin").alias("bin"), "category", "n_real", "n_fake")


def _i2(spark, folder):
    """Vocabulary ids by sorted text over both sides."""
    pair = order_pair(spark, folder)
    counts = overlap.vocabulary_counts(pair, ["o_orderstatus", "o_orderpriority"]).withColumn("one", F.lit(1))
    table = ranks.running_totals(counts, ["column"], ["value"], ["one"])
    return table.select("column", "value", (big("running_one") - 1).alias("id"))


def _i4(spark, folder):
    codes = kway.aligned_codes(line_pair(spark, folder), 10, KWAY_TYPES)
    return codes.groupBy("side", *KWAY_TYPES.numeric).agg(F.count("*").alias("n")).select(
        "side", *[big(c).alias(c) for c in KWAY_TYPES.numeric], "n"
    )


def i4_sql() -> str:
    base = aligned_sql()
    return base[:base.index(", t AS (")] + (
        " SELECT side, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in KWAY_TYPES.numeric) + ", count(*) AS n FROM codes GROUP BY ALL"
    )


def _i5(spark, folder):
    pair = line_pair(spark, folder)
    types = ColumnTypes(KWAY_TYPES.numeric, ["l_returnflag", "l_linenumber"])
    real = pair.filter((F.col(SIDE) == "real") & (F.col("l_returnflag") != "R"))
    codes = kway.encode_quantiles(pair, kway.fit_encoder(real, types), [SIDE])
    return codes.groupBy(*codes.columns).agg(F.count("*").alias("n")).select(
        "side", *[big(c).alias(c) for c in [*types.numeric, *types.categorical]], "n"
    )


def i5_sql() -> str:
    fit = ", ".join(f"{quantile_list(c, 20)} AS e_{c}" for c in KWAY_TYPES.numeric)
    codes = ", ".join(
        f"CAST(CASE WHEN {c} IS NULL THEN 0 ELSE len(list_filter(e_{c}[2:-2], lambda e: e <= {c})) END AS BIGINT) AS {c}"
        for c in KWAY_TYPES.numeric
    )
    vocab = ", ".join(f"list_sort(list_distinct(list({c}))) AS v_{c}" for c in ("l_returnflag", "l_linenumber"))
    ids = ", ".join(
        f"CAST(coalesce(list_position(v_{c}, {c}), 0) AS BIGINT) AS {c}" for c in ("l_returnflag", "l_linenumber")
    )
    return f"""WITH pair AS (SELECT * FROM {LINE_PAIR}), fit AS (SELECT {fit}, {vocab} FROM pair WHERE side = 'real' AND l_returnflag <> 'R')
SELECT side, {codes}, {ids}, count(*) AS n FROM pair, fit GROUP BY ALL"""


def _c1(spark, folder, join=False):
    build = overlap.aligned_frequencies_by_join if join else overlap.aligned_frequencies
    pair = _oov_pair(spark, folder)
    return build(pair, "brand_size").select("value", r("p_real").alias("p_real"), r("p_fake").alias("p_fake"))


C1_SQL = oov_base_sql() + """ SELECT value, round(a / sum(a) OVER (), 9) AS p_real, round(b / sum(b) OVER (), 9) AS p_fake
FROM g WHERE col = 'brand_size'"""


def _c6(spark, folder):
    pair = ranks.equalize(order_pair(spark, folder), ["o_orderkey"])
    segments = ranks.positional_pairs(pair, ["o_orderpriority", "o_orderstatus"], lambda c: F.col(c), "string")
    return segments.groupBy("column", "real", "fake").agg(F.sum("n").alias("n"))


C6_SQL = f"WITH pair AS (SELECT * FROM {ORDER_PAIR}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", x.v AS real, y.v AS fake, count(*) AS n FROM
 (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM pair WHERE side = 'real') x JOIN
 (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM pair WHERE side = 'fake') y USING (i) GROUP BY x.v, y.v"""
    for c in ("o_orderpriority", "o_orderstatus")
)


def total_variation(p, q):
    """A caller-supplied column metric."""
    return F.sum(F.abs(p - q)) / 2


def _u1(spark, folder):
    return _rounded_scores(marginals.column_metric(line_pair(spark, folder), total_variation, types=LINE_TYPES))


QUERIES = {
    "h1_histogram_intersection": _h1,
    "h2_histogram_summary": _h2,
    "h3_jaccard_similarity": lambda s, d: _rounded_scores(marginals.jaccard_similarity(order_pair(s, d), types=ORDER_TYPES)),
    "h4_column_correlation": _h4,
    "h4_column_correlation_theil": lambda s, d: _h4(s, d, theil=True),
    "h5_wasserstein_distance": lambda s, d: _rounded_scores(marginals.wasserstein_distance(line_pair(s, d), types=LINE_TYPES)),
    "h6_jensen_shannon_distance": lambda s, d: _rounded_scores(marginals.jensen_shannon_distance(order_pair(s, d), types=ORDER_TYPES)),
    "h7_cumulative_difference": lambda s, d: _rounded_scores(marginals.cumulative_difference(line_pair(s, d), types=LINE_TYPES)),
    "h8_column_metrics_together": lambda s, d: _rounded_scores(
        marginals.mass_scores(marginals.histogram_table(line_pair(s, d), LINE_TYPES), marginals.MASS_SCORES)
    ),
    "h9_pairwise_similarity": _h9,
    "h10_association_matrix": _h10,
    "h11_associations_difference": _h11,
    "h12_correlation_accuracy": _h12,
    "h13_exact_duplicates": _h13,
    "h14_kway_aligned": _h14,
    "h15_kway_fitted": _h15,
    "h16_oov_summary": _h16,
    "h16_oov_top_values": _h16_top,
    "h16_top_values": lambda s, d: _h16_top(s, d, unseen=False),
    "h17_label_drift": _h17,
    "h18_row_acceptance": _h18,
    "j1_pearson": lambda s, d: _long(assoc.pearson_pairs(line_pair(s, d), A_NUM)),
    "j2_correlation_ratio": lambda s, d: _long(assoc.correlation_ratios(line_pair(s, d), A_CAT, A_NUM)),
    "j3_cramers_v": lambda s, d: _long(assoc.categorical_pairs(line_pair(s, d), A_CAT, "cramers_v")),
    "j4_theils_u": lambda s, d: _long(assoc.categorical_pairs(line_pair(s, d), A_CAT, "theils_u")),
    "i1_histogram_table": _i1,
    "i2_vocabulary_ids": _i2,
    "i3_pair_similarities": _i3,
    "i4_aligned_codes": _i4,
    "i5_fitted_codes": _i5,
    "c1_aligned_frequencies": _c1,
    "c2_aligned_frequencies_join": lambda s, d: _c1(s, d, join=True),
    "c6_positional_join": _c6,
    "u1_custom_column_metric": _u1,
}

PLACED = placed_sql(LINE_PAIR, LINE_TYPES)
SQL = {
    "h1_histogram_intersection": column_scores_sql(LINE_PAIR, LINE_TYPES, OVERLAP, "histogram_intersection"),
    "h2_histogram_summary": h2_sql(),
    "h3_jaccard_similarity": column_scores_sql(ORDER_PAIR, ORDER_TYPES, JACCARD, "jaccard_similarity"),
    "h4_column_correlation": h4_sql(False),
    "h4_column_correlation_theil": h4_sql(True),
    "h5_wasserstein_distance": PLACED + """ SELECT col AS "column", kind AS column_type, 'wasserstein_distance' AS metric,
 round(sum(abs(cp - cq) * reach * width), 9) AS score, round(1 - exp(-sum(abs(cp - cq) * reach * width)), 9) AS normalized_score
 FROM s GROUP BY col, kind""",
    "h6_jensen_shannon_distance": column_scores_sql(ORDER_PAIR, ORDER_TYPES, JSD, "jensonshannon_distance"),
    "h7_cumulative_difference": PLACED + """ SELECT col AS "column", kind AS column_type, 'cumulative_difference' AS metric,
 round(sum((cp - cq) * width * (CASE WHEN lead_place IS NULL THEN places ELSE lead_place END - place)), 9) + 0.0 AS score,
 round(sum((cp - cq) * width * (CASE WHEN lead_place IS NULL THEN places ELSE lead_place END - place)), 9) + 0.0 AS normalized_score
 FROM (SELECT *, lead(place) OVER (PARTITION BY col ORDER BY place) AS lead_place FROM s) GROUP BY col, kind""",
    "h8_column_metrics_together": histogram_sql(LINE_PAIR, LINE_TYPES) + "".join(
        f"""{union} SELECT col AS "column", kind AS column_type, '{name}' AS metric, round({e}, 9) AS score,
 round({e}, 9) AS normalized_score FROM m GROUP BY col, kind"""
        for union, name, e in [
            ("", "histogram_intersection", OVERLAP), (" UNION ALL", "jaccard_similarity", JACCARD),
            (" UNION ALL", "jensonshannon_distance", JSD),
        ]
    ),
    "h9_pairwise_similarity": similarity_sql() + """ SELECT round(avg(similarity), 9) AS score,
 round(avg(similarity), 9) AS normalized_score, 'pairwise_similarity' AS metric FROM t""",
    "h10_association_matrix": matrix_sql() + " SELECT side, col_a, col_b, kind, round(value, 8) + 0.0 AS value FROM f",
    "h11_associations_difference": matrix_sql() + """ SELECT col_b AS "column", round(avg(abs(x - y)), 8) AS score,
 'associations_difference' AS metric FROM c GROUP BY col_b""",
    "h12_correlation_accuracy": matrix_sql() + f""" SELECT round(avg(CASE WHEN {LEVEL.format('x')} = {LEVEL.format('y')}
 THEN 1 ELSE 0 END), 9) AS score, 'correlation_accuracy' AS metric FROM c""",
    "h13_exact_duplicates": H13_SQL,
    "h14_kway_aligned": aligned_sql(),
    "h15_kway_fitted": fitted_sql(),
    "h16_oov_summary": oov_base_sql() + """ SELECT col AS "column", CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS oov_count,
 count(*) FILTER (a = 0 AND b > 0) AS oov_values, round(sum(CASE WHEN a = 0 THEN b ELSE 0 END) / sum(b), 9) AS oov_rate FROM g GROUP BY col""",
    "h16_oov_top_values": oov_top_sql(True),
    "h16_top_values": oov_top_sql(False),
    "h17_label_drift": H17_SQL,
    "h18_row_acceptance": H18_SQL,
    "j1_pearson": long_sql(pearson_sql()),
    "j2_correlation_ratio": long_sql(ratio_sql()),
    "j3_cramers_v": long_sql(cramer_sql()),
    "j4_theils_u": long_sql(theil_sql()),
    "i1_histogram_table": histogram_sql(LINE_PAIR, LINE_TYPES) + """ SELECT col AS "column", kind AS column_type,
 CAST(bin AS BIGINT) AS bin, cat AS category, n_real, n_fake FROM h""",
    "i2_vocabulary_ids": f"WITH s AS (SELECT * FROM {ORDER_PAIR}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS id FROM (SELECT DISTINCT {c} FROM s)"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
    "i3_pair_similarities": similarity_sql() + " SELECT columns, round(similarity, 9) AS similarity FROM t",
    "i4_aligned_codes": i4_sql(),
    "i5_fitted_codes": i5_sql(),
    "c1_aligned_frequencies": C1_SQL,
    "c2_aligned_frequencies_join": C1_SQL,
    "c6_positional_join": C6_SQL,
    "u1_custom_column_metric": column_scores_sql(LINE_PAIR, LINE_TYPES, "sum(abs(p - q)) / 2", "total_variation"),
}

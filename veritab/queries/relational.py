"""Sources, cleaning, joins, aggregates, order and set queries (A, B, C, D, E, F, G)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veritab.functions import paths
from veritab.functions import scalars as fn
from veritab.operators import aggregates, clean, overlap, ranks, sides
from veritab.queries.common import ORDER_PAIR, Registry, big, load, order_pair, parity_side, r
from veritab.session import scratch_folder
from veritab.sources import ledger, tables

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql


# ----------------------------------------------------------------- A: sources
@query("a1_read_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer")
def _(spark, folder):
    path = scratch_folder(spark, "customer-csv")
    tables.write_table(load(spark, folder, "customer"), path)
    read = tables.read_table(
        spark, path, schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    )
    return read.select("c_custkey", "c_name", big("c_nationkey").alias("c_nationkey"), r("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@query("a2_read_headerless", "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS \"order-status\", o_orderpriority AS priority FROM orders")
def _(spark, folder):
    path = scratch_folder(spark, "orders-headerless")
    rows = load(spark, folder, "orders").select(F.concat_ws(", ", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("value"))
    remark = rows.agg(F.concat(F.lit("|remark, rows: "), F.count("*").cast("string")).alias("value"))
    remark.unionByName(rows).write.text(path)
    return tables.read_headerless(spark, path, ["k", "order-status", "priority"], skip_line=r"^\|")


@query("a3_read_tagged_tsv", """SELECT event_type AS method, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def _(spark, folder):
    events = load(spark, folder, "events")
    kinds = [row[0] for row in events.select("event_type").distinct().collect()]
    base = scratch_folder(spark, "event-logs")
    logs = events.select("event_type", "event_id", F.col("value").alias(" value "))
    logs.write.partitionBy("event_type").option("header", True).option("sep", "\t").csv(base)
    read = tables.read_tagged(spark, {kind: f"{base}/event_type={kind}" for kind in kinds})
    return read.groupBy("method").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


REPORT_SQL = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'early' ELSE 'late' END AS dataset, o_orderpriority AS scorer,
 CASE WHEN o_orderstatus = 'F' THEN 50.0::DOUBLE END AS bins, CASE WHEN o_orderpriority <> '5-LOW' THEN round(avg(o_totalprice), 4) END AS score, count(*) AS fake_size
FROM orders GROUP BY dataset, bins, o_orderpriority"""


@query("a4_read_reports", REPORT_SQL)
def _(spark, folder):
    base = scratch_folder(spark, "reports")
    orders = load(spark, folder, "orders")
    rows = orders.groupBy((F.col("o_orderstatus") == "F").alias("early"), "o_orderpriority").agg(
        F.when(F.col("o_orderpriority") != "5-LOW", F.round(F.avg("o_totalprice"), 4)).alias("score"), F.count("*").alias("fake_size")
    )
    shared = [F.lit("t.csv").alias("real_path"), F.lit("f.csv").alias("fake_path"), F.col("fake_size").alias("real_size"), "fake_size",
              "score", F.lit("histogram_intersection").alias("metric"), F.col("o_orderpriority").alias("scorer"), F.lit("fake").alias("tag")]
    rows.filter("early").select(*shared, F.lit(50).alias("bins")).write.option("header", True).csv(f"{base}/report_early.csv")
    rows.filter("not early").select(*shared).write.option("header", True).csv(f"{base}/report_late.csv")
    return tables.read_reports(spark, base).select("dataset", "scorer", "bins", r("score", 4).alias("score"), "fake_size")


@query("a5_write_parquet", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_returnflag")
def _(spark, folder):
    path = scratch_folder(spark, "lineitem") + ".parquet"
    tables.write_table(load(spark, folder, "lineitem").select("l_returnflag", "l_quantity"), path)
    read = tables.read_table(spark, path)
    return read.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("a6_write_json", "SELECT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, folder):
    counts = load(spark, folder, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    documents = counts.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("c_nationkey").cast("string"), "n"))).alias("nations")
    )
    path = scratch_folder(spark, "summary-json")
    tables.write_json(documents, path)
    read = spark.read.schema("segment string, nations map<string,bigint>").json(path)
    return read.select("segment", F.explode("nations").alias("nation", "n"))


@query("a7_text_lines", r"""SELECT count(*) AS lines, CAST(sum(length(replace(replace(text, chr(13), ''), chr(10), '\n'))) AS BIGINT) AS characters FROM documents""")
def _(spark, folder):
    path = scratch_folder(spark, "text-lines")
    tables.write_text_lines(load(spark, folder, "documents"), "text", path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("characters"))


@query("a8_append_tables", """SELECT 2 * count(*) AS sampled, 2 * count(*) FILTER (value > 0) AS accepted, CAST(2 AS BIGINT) AS batches FROM events""")
def _(spark, folder):
    base = scratch_folder(spark, "generated")
    events = load(spark, folder, "events").select("event_id", "event_type", "value")
    good = events.filter("value > 0")
    log = events.agg(F.lit("run").alias("name"), F.count("*").alias("total_sampled"), F.count_if(F.col("value") > 0).alias("total_processed"))
    for _batch in range(2):
        tables.append_tables(events, good, log, base)
    accepted, batches = (spark.read.parquet(f"{base}/{name}.parquet").count() for name in ("processed", "log"))
    return spark.read.parquet(f"{base}/raw.parquet").agg(
        F.count("*").alias("sampled"), F.lit(accepted).cast("bigint").alias("accepted"), F.lit(batches).cast("bigint").alias("batches")
    )


LEDGER_ROWS = """SELECT 'real.csv' AS real_path, concat('fake_', o_orderpriority, '.csv') AS fake_path, count(*) AS fake_size,
 round(avg(o_totalprice), 4) AS score FROM orders WHERE o_orderstatus IN ({}) GROUP BY o_orderpriority, o_orderstatus"""


def _ledger_rows(spark, folder, statuses):
    orders = load(spark, folder, "orders").filter(F.col("o_orderstatus").isin(statuses))
    return orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("fake_size"), r(F.avg("o_totalprice"), 4).alias("score")
    ).select(
        F.lit("real.csv").alias("real_path"), F.concat(F.lit("fake_"), "o_orderpriority", F.lit(".csv")).alias("fake_path"),
        "fake_size", "score", F.lit("pairwise_similarity").alias("metric"), F.lit("mean").alias("scorer"),
    )


@query("a9_ledger_upsert", LEDGER_ROWS.format("'F', 'O'") + " UNION " + LEDGER_ROWS.format("'O', 'P'"))
def _(spark, folder):
    path = scratch_folder(spark, "ledger")
    ledger.save_results(spark, path, _ledger_rows(spark, folder, ["F", "O"]))
    ledger.save_results(spark, path, _ledger_rows(spark, folder, ["O", "P"]), overwrite=True)
    return ledger.read_ledger(spark, path).select("real_path", "fake_path", "fake_size", "score")


@query("a9_ledger_known_results", LEDGER_ROWS.format("'O'"))
def _(spark, folder):
    known = ledger.conform(_ledger_rows(spark, folder, ["F", "O"]))
    return ledger.existing_rows(known, _ledger_rows(spark, folder, ["O", "P"])).select("real_path", "fake_path", "fake_size", "score")


@query("a10_even_shares", """SELECT i AS worker, CAST((SELECT count(*) FROM lineitem) // 7 + CASE WHEN i < (SELECT count(*) FROM lineitem) % 7 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM range(7) t(i)""")
def _(spark, folder):
    return tables.even_shares(spark, load(spark, folder, "lineitem").count(), 7)


@query("a10_write_sharded", "SELECT CAST(4 AS BIGINT) AS files, count(*) AS rows FROM lineitem")
def _(spark, folder):
    path = scratch_folder(spark, "shards")
    tables.write_sharded(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path, 4)
    read = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).count()
    return read.agg(F.count("*").alias("files"), F.sum("count").alias("rows"))


# ---------------------------------------------------------------- B: cleaning
CAPITALIZE = "concat(upper(substr(trim({0}), 1, 1)), lower(substr(trim({0}), 2)))"


@query("b1_normalize_category", f"SELECT p_partkey, {CAPITALIZE.format('upper(p_name)')} AS name, {CAPITALIZE.format('p_type')} AS type FROM part")
def _(spark, folder):
    return load(spark, folder, "part").select(
        "p_partkey", fn.capitalize(F.upper("p_name")).alias("name"), fn.capitalize(F.col("p_type")).alias("type")
    )


@query("b2_slug_category", f"SELECT p_partkey, regexp_replace({CAPITALIZE.format('p_name')}, '\\s+', '-', 'g') AS \"part-name\" FROM part")
def _(spark, folder):
    slugged = load(spark, folder, "part").select("p_partkey", fn.hyphenate(F.col("p_name")).alias(" Part  Name "))
    return fn.hyphenate_names(slugged)


@query("b3_strip_chars", "SELECT doc_id, trim(text, '. ') AS stripped FROM documents")
def _(spark, folder):
    return load(spark, folder, "documents").select("doc_id", fn.strip_chars(F.col("text"), ". ").alias("stripped"))


B4_SOURCE = """(SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN ' ? ' WHEN 'purchase' THEN ' NaN' ELSE upper(event_type) END AS kind, value FROM events)"""


@query("b4_normalize_missing", f"""SELECT event_id, CASE WHEN k IN ('?', 'na', 'nan') THEN 'missing' ELSE k END AS kind, value FROM
 (SELECT event_id, lower(trim(coalesce(kind, 'MISSING'))) AS k, value FROM {B4_SOURCE})""")
def _(spark, folder):
    kind = F.col("event_type")
    events = load(spark, folder, "events").select(
        "event_id",
        F.when(kind == "view", None).when(kind == "click", " ? ").when(kind == "purchase", " NaN").otherwise(F.upper(kind)).alias("kind"),
        "value",
    )
    return clean.normalize_missing(events)


@query("b5_drop_token_rows", "SELECT c_custkey, seg FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '[UNK]' ELSE c_mktsegment END AS seg FROM customer) WHERE seg <> '[UNK]'")
def _(spark, folder):
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "[UNK]").otherwise(F.col("c_mktsegment"))
    return clean.drop_rows_with_token(load(spark, folder, "customer").select("c_custkey", seg.alias("seg")), ["seg", "c_custkey"])


@query("b5_token_counts", "SELECT count(*) FILTER (c_mktsegment <> 'BUILDING') AS kept, count(*) FILTER (c_mktsegment = 'BUILDING') AS dropped FROM customer")
def _(spark, folder):
    return clean.token_counts(load(spark, folder, "customer"), ["c_name", "c_mktsegment"], "BUILDING")


@query("b6_subset_and_cast", "SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem WHERE l_linenumber IN (1, 3)")
def _(spark, folder):
    lines = load(spark, folder, "lineitem").withColumnRenamed("l_quantity", "L_QUANTITY")
    kept = clean.subset_and_cast(lines, "l_linenumber", [1, 3], ["l_linenumber", "l_returnflag"], ["L_QUANTITY", "l_extendedprice"])
    return kept.withColumn("l_extendedprice", r("l_extendedprice", 4))


@query("b7_to_number", """SELECT c_custkey, round(TRY_CAST(CASE WHEN c_nationkey = 3 THEN '?' WHEN c_nationkey = 4 THEN 'nan' WHEN c_nationkey = 5 THEN NULL
 WHEN c_nationkey = 6 THEN '' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), 6) AS number FROM customer WHERE c_nationkey <> 4
 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_nationkey = 4""")
def _(spark, folder):
    nation = F.col("c_nationkey")
    text = F.when(nation == 3, "?").when(nation == 4, "nan").when(nation == 5, None).when(nation == 6, "").otherwise(F.col("c_acctbal").cast("string"))
    return load(spark, folder, "customer").select("c_custkey", r(fn.to_number(text), 6).alias("number"))


@query("b8_target_first", "SELECT c_mktsegment, c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def _(spark, folder):
    table = load(spark, folder, "customer").select("c_custkey", "c_name", big("c_nationkey").alias("c_nationkey"), "c_mktsegment")
    return clean.target_first(clean.target_first(table, "absent"), "c_mktsegment")


@query("b9_b10_align", """SELECT 'real' AS side, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, count(*) FILTER (l_quantity > 25) AS heavy FROM lineitem WHERE l_returnflag <> 'A'
 UNION ALL SELECT 'fake', count(*), sum(l_linenumber)::BIGINT, count(*) FILTER (l_quantity > 25) FROM lineitem WHERE l_returnflag = 'A'""")
def _(spark, folder):
    lines = load(spark, folder, "lineitem")
    real = lines.filter("l_returnflag <> 'A'").select("l_linenumber", "l_quantity")
    fake = lines.filter("l_returnflag = 'A'").select(F.col("l_quantity").cast("string").alias("l_quantity"), F.col("l_linenumber").cast("string").alias("l_linenumber"), "l_tax")
    pair = sides.tag_sides(real, fake, policy="subset")
    return pair.groupBy("side").agg(F.count("*").alias("n"), big(F.sum("l_linenumber")).alias("lines"), F.count_if(F.col("l_quantity") > 25).alias("heavy"))


@query("b11_null_sentinel", """SELECT c_custkey, CAST(coalesce(k, -1) AS BIGINT) AS filled, CAST(nullif(coalesce(k, -1), -1) AS BIGINT) AS restored FROM
 (SELECT c_custkey, CASE WHEN c_nationkey > 2 THEN c_nationkey END AS k FROM customer)""")
def _(spark, folder):
    table = load(spark, folder, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("k"))
    holed = clean.nullable_columns(table)
    filled = clean.null_sentinel(table, holed)
    return clean.restore_nulls(filled.withColumn("filled", big("k")), holed).select("c_custkey", "filled", big("k").alias("restored"))


B13 = r"""CASE WHEN NOT regexp_matches(w, '\p{L}') THEN 'lower' WHEN w = upper(w) THEN 'upper' WHEN w = lower(w) THEN 'lower'
 WHEN regexp_matches(w, '^\P{L}*\p{Lu}\p{Ll}*(\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$') THEN 'title'
 WHEN regexp_matches(w, '^\p{Lu}') AND NOT regexp_matches(w, '^\p{L}+$') THEN 'capitalize' ELSE 'lower' END"""


@query("b13_letter_case", f"""SELECT kind, count(*) AS words FROM (SELECT {B13} AS kind FROM
 (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY kind""")
def _(spark, folder):
    words = load(spark, folder, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(fn.letter_case(F.col("w")).alias("kind")).agg(F.count("*").alias("words"))


@query("b14_drop_null_target", "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id)")
def _(spark, folder):
    joined = load(spark, folder, "documents").select("doc_id").join(load(spark, folder, "labels"), "doc_id", "left")
    return clean.drop_null_target(joined, "quality").select("doc_id", big("quality").alias("quality"))


@query("b15_infinite_to_null", "SELECT count(*) AS n, count(*) FILTER (l_discount > 0) AS finite, round(sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 4) AS total FROM lineitem")
def _(spark, folder):
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.nullif("l_discount", F.lit(0.0))).otherwise(F.when(F.col("l_tax") > 0.04, math.inf).otherwise(-math.inf))
    cleaned = clean.drop_infinite(load(spark, folder, "lineitem").select(ratio.alias("x")))
    return cleaned.agg(F.count("*").alias("n"), F.count("x").alias("finite"), r(F.sum("x"), 4).alias("total"))


HOLES = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 5 THEN l_tax END AS t, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS d FROM lineitem)"


def _holes(spark, folder):
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 5, F.col("l_tax")).alias("t"),
        F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("d"),
    )


@query("b16_split_complete", f"SELECT 'complete' AS part, count(*) AS n FROM {HOLES} WHERE t IS NOT NULL AND d IS NOT NULL UNION ALL SELECT 'holes', count(*) FROM {HOLES} WHERE t IS NULL OR d IS NULL")
def _(spark, folder):
    whole, holes = clean.split_complete(_holes(spark, folder))
    return whole.agg(F.lit("complete").alias("part"), F.count("*").alias("n")).unionByName(holes.agg(F.lit("holes").alias("part"), F.count("*").alias("n")))


@query("b17_incomplete_rows", "SELECT event_id, props FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'placeholder' ELSE props END AS props FROM events) WHERE props = 'placeholder'")
def _(spark, folder):
    rows = load(spark, folder, "events").select("event_id", F.when(F.col("event_type") == "click", "placeholder").otherwise(F.col("props")).alias("props"))
    return clean.incomplete_rows(rows, ["props"])


@query("b18_keep_known_labels", """WITH v AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> (SELECT max(p_type) FROM part)))
 SELECT p_partkey, id AS label_id FROM part JOIN v USING (p_type)""")
def _(spark, folder):
    part = load(spark, folder, "part")
    fit = part.filter(F.col("p_type") != F.lit(part.agg(F.max("p_type")).first()[0]))
    return clean.keep_known_labels(part, fit, "p_type").select("p_partkey", big("label_id").alias("label_id"))


@query("b19_escapes", r"""SELECT conv_id, turn, length(replace(concat(role, '\n', text), '\n', chr(10))) AS prompt, ltrim(concat(chr(10), chr(13), text), chr(10) || chr(13)) AS answer FROM conversations""")
def _(spark, folder):
    rows = load(spark, folder, "conversations")
    return rows.select(
        "conv_id", "turn", F.length(fn.unescape_newlines(F.concat("role", F.lit("\\n"), "text"))).cast("bigint").alias("prompt"),
        fn.strip_leading_breaks(F.concat(F.lit("\n\r"), "text")).alias("answer"),
    )


# ------------------------------------------------------------------- C: joins
@query("c3_semi_join", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48)")
def _(spark, folder):
    part = load(spark, folder, "part")
    return overlap.semi_by_vocabulary(part, "p_brand", part.filter("p_size > 48")).select("p_partkey", "p_brand")


@query("c3_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, folder):
    orders = load(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return overlap.semi_by_vocabulary(load(spark, folder, "customer"), "c_custkey", orders, known=False).select("c_custkey")


@query("c4_disjoint_splits", """SELECT part, n FROM (SELECT 'train' AS part, CAST(least(1000, count(*)) AS BIGINT) AS n FROM orders UNION ALL
 SELECT 'valid', CAST(greatest(0, least(200, count(*) - 1000)) AS BIGINT) FROM orders UNION ALL SELECT 'test', CAST(greatest(0, count(*) - 1200) AS BIGINT) FROM orders)""")
def _(spark, folder):
    from veritab.operators.synth import split_by_seed

    return split_by_seed(load(spark, folder, "orders"), ["o_orderkey"], 1000, 200, [11]).groupBy("part").agg(F.count("*").alias("n"))


@query("c5_dictionary_lookup", "SELECT o_orderkey, CAST(CASE lower(o_orderpriority) WHEN '1-urgent' THEN 1 WHEN '2-high' THEN 2 ELSE 0 END AS BIGINT) AS id FROM orders")
def _(spark, folder):
    ids = {"1-URGENT": 1, "2-High": 2}
    return load(spark, folder, "orders").select(
        "o_orderkey", big(clean.dictionary_lookup(F.col("o_orderpriority"), ids, 0, ignore_case=True)).alias("id")
    )


# -------------------------------------------------------------- D: aggregates
@query("d1_value_counts", "SELECT p_brand, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 9) AS share FROM part GROUP BY p_brand")
def _(spark, folder):
    return aggregates.shares(load(spark, folder, "part"), ["p_brand"]).withColumn("share", r("share"))


@query("d2_class_shares", "SELECT concat('l_returnflag_', l_returnflag) AS scorer, round_even(count(*) / (SELECT count(*) FROM lineitem), 2) AS score FROM lineitem GROUP BY l_returnflag")
def _(spark, folder):
    return aggregates.class_share_rows(load(spark, folder, "lineitem"), "l_returnflag")


@query("d3_joint_frequency", "SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY ALL")
def _(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", big("l_linenumber").alias("l_linenumber"))
    return aggregates.shares(lines, ["l_returnflag", "l_linestatus", "l_linenumber"]).withColumn("share", r("share"))


@query("d4_pair_shares", f"SELECT t, d, count(*) AS n, round(count(*) / (SELECT count(*) FROM {HOLES} WHERE t IS NOT NULL AND d IS NOT NULL), 9) AS share FROM {HOLES} WHERE t IS NOT NULL AND d IS NOT NULL GROUP BY t, d")
def _(spark, folder):
    return aggregates.pair_shares(_holes(spark, folder), "t", "d").withColumn("share", r("share"))


@query("d5_distinct_vocabulary", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, folder):
    return load(spark, folder, "part").select("p_brand", "p_type").distinct()


@query("d6_d7_moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean,
 round(stddev_pop({c}), 6) AS std, round(skewness({c}), 6) AS skewness FROM {t}"""
    for c, t in [("l_quantity", "lineitem"), ("l_extendedprice", "lineitem")]))
def _(spark, folder):
    table = aggregates.moments(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return table.select("column", "n", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"),
                        r("mean", 6).alias("mean"), r("std", 6).alias("std"), r("skewness", 6).alias("skewness"))


def _edges(df, column, pieces, **options):
    edges = ranks.exact_quantiles(df, {"x": fn.numeric_of(df, column)}, pieces, **options)["x"]
    one = df.sparkSession.range(1)
    return one.select(F.posexplode(fn.literal_array(edges)).alias("i", "edge")).select(big("i").alias("i"), r("edge", 6).alias("edge"))


D8_SQL = "SELECT unnest(range(21)) AS i, round(unnest(quantile_cont(o_totalprice, [{}])), 6) AS edge FROM orders".format(
    ", ".join(str(i / 20) for i in range(21)))


@query("d8_quantile_edges", D8_SQL)
def _(spark, folder):
    return _edges(load(spark, folder, "orders"), "o_totalprice", 20)


@query("d8_quantile_edges_distributed", D8_SQL)
def _(spark, folder):
    """With a coarse sketch, so that wide brackets hold many values."""
    return _edges(load(spark, folder, "orders"), "o_totalprice", 20, accuracy=200)


@query("d9_median", """SELECT 'o_totalprice' AS "column", round(median(o_totalprice), 6) AS median FROM orders UNION ALL SELECT 'nothing', 0.0::DOUBLE""")
def _(spark, folder):
    orders = load(spark, folder, "orders").withColumn("nothing", F.nullif(F.col("o_totalprice"), F.col("o_totalprice")))
    return aggregates.medians(orders, ["o_totalprice", "nothing"]).withColumn("median", r("median", 6))


@query("d10_rates", f""" SELECT 'd' AS "column", round(avg(CASE WHEN d = 0 THEN 1 ELSE 0 END), 9) AS zero_rate, round(avg(CASE WHEN d IS NULL THEN 1 ELSE 0 END), 9) AS null_rate,
 round(avg(CASE WHEN d IS NOT NULL THEN 1 ELSE 0 END), 9) AS parse_rate FROM {HOLES} UNION ALL SELECT 't', round(avg(CASE WHEN t = 0 THEN 1 ELSE 0 END), 9),
 round(avg(CASE WHEN t IS NULL THEN 1 ELSE 0 END), 9), round(avg(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END), 9) FROM {HOLES}""")
def _(spark, folder):
    table = aggregates.rates(_holes(spark, folder), ["d", "t"])
    return table.select("column", r("zero_rate").alias("zero_rate"), r("null_rate").alias("null_rate"), r("parse_rate").alias("parse_rate"))


@query("d11_missing_cells", f"SELECT CAST((t IS NULL)::INT + (d IS NULL)::INT AS BIGINT) AS missing, count(*) AS n FROM {HOLES} GROUP BY 1")
def _(spark, folder):
    return _holes(spark, folder).groupBy(clean.null_count(["t", "d"]).cast("bigint").alias("missing")).agg(F.count("*").alias("n"))


@query("d12_mean_pm_std", """SELECT l_returnflag, l_linestatus, concat(CAST(round_even(avg(l_quantity), 1) AS VARCHAR), '±', CAST(round_even(stddev_samp(l_quantity), 0) AS VARCHAR)) AS summary
 FROM lineitem GROUP BY ALL""")
def _(spark, folder):
    return aggregates.mean_pm_std(load(spark, folder, "lineitem"), [F.col("l_returnflag"), F.col("l_linestatus")], F.col("l_quantity"))


@query("d13_across_seeds", """SELECT p_type, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM (SELECT p_type, p_brand, CASE WHEN p_brand <> 'Brand#11' THEN avg(p_retailprice) END AS v FROM part GROUP BY p_type, p_brand) GROUP BY p_type""")
def _(spark, folder):
    runs = load(spark, folder, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("v"))
    runs = runs.withColumn("v", F.when(F.col("p_brand") == "Brand#11", float("nan")).otherwise(F.col("v")))
    table = aggregates.across_seeds(runs, [F.col("p_type")], F.col("v"))
    return table.select("p_type", r("mean", 6).alias("mean"), r("std", 6).alias("std"))


D14_SQL = """WITH g AS (SELECT l_returnflag, l_shipmode, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_shipmode) AS rk FROM
 (SELECT l_returnflag, CAST(l_suppkey AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY l_returnflag, l_shipmode)
 SELECT a.l_returnflag, a.n, round(s, 9) AS positive_share, round(t, 9) AS positive_mean, round(m, 6) AS mean, top FROM
 (SELECT l_returnflag, count(*) AS n, avg(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) AS s, avg(l_discount) AS t, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag) a
 JOIN (SELECT l_returnflag, string_agg(l_shipmode || ':' || n, ',' ORDER BY rk) AS top FROM g WHERE rk <= 5 GROUP BY l_returnflag) b USING (l_returnflag)"""


@query("d14_class_summary", D14_SQL)
def _(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_returnflag", "l_discount", "l_quantity", F.col("l_suppkey").cast("string").alias("supplier"))
    table = overlap.group_summary(lines, [F.col("l_returnflag")], "l_discount", "l_quantity", "supplier")
    return table.select("l_returnflag", "n", r("positive_share").alias("positive_share"), r("positive_mean").alias("positive_mean"), r("mean", 6).alias("mean"), "top")


@query("d15_pivot", """SELECT p_brand, """ + ", ".join(f"round(avg(p_retailprice) FILTER (p_size = {s}), 6) AS \"{s}\"" for s in range(1, 51)) + " FROM part GROUP BY p_brand")
def _(spark, folder):
    wide = aggregates.pivot_mean(load(spark, folder, "part"), ["p_brand"], "p_size", "p_retailprice", list(range(1, 51)))
    return wide.select("p_brand", *[r(F.col(f"`{s}`"), 6).alias(str(s)) for s in range(1, 51)])


# ------------------------------------------------------------ E: order, limits
@query("e1_percent_rank01", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(greatest((rk + (c - 1) / 2) / n, 1e-6) - 1e-6, 9) AS u FROM
 (SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) AS rk, count(*) OVER (PARTITION BY l_quantity) AS c, count(*) OVER () AS n FROM lineitem)""")
def _(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ranked = ranks.percent_rank01(lines, "l_quantity", "u")
    return ranked.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), r("u").alias("u"))


@query("e1_percent_rank01_distinct", """SELECT o_orderkey, round(greatest((rk + (c - 1) / 2) / n, 1e-6) - 1e-6, 9) AS u FROM
 (SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) AS rk, count(*) OVER (PARTITION BY o_totalprice) AS c, count(*) OVER () AS n FROM orders)""")
def _(spark, folder):
    ranked = ranks.percent_rank01(load(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "u")
    return ranked.select("o_orderkey", r("u").alias("u"))


E2_SQL = """SELECT l_returnflag, l_suppkey, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) AS BIGINT) AS running FROM lineitem GROUP BY l_returnflag, l_suppkey"""


@query("e2_running_counts", E2_SQL)
def _(spark, folder):
    counts = load(spark, folder, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return ranks.running_totals(counts, ["l_returnflag"], ["l_suppkey"], ["n"]).select("l_returnflag", "l_suppkey", F.col("running_n").alias("running"))


@query("e2_running_counts_two_step", E2_SQL)
def _(spark, folder):
    """The range-partitioned path that large tables take."""
    counts = load(spark, folder, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    table = ranks.running_totals(counts, ["l_returnflag"], ["l_suppkey"], ["n"], rows_per_task=10)
    return table.select("l_returnflag", "l_suppkey", F.col("running_n").alias("running"))


@query("e3_full_sort", "SELECT p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part ORDER BY ALL")
def _(spark, folder):
    return load(spark, folder, "part").select("p_brand", "p_type", big("p_size").alias("p_size")).orderBy("p_brand", "p_type", "p_size")


@query("e4_top_k", """SELECT event_type, user, n, rank FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS user, count(*) AS n,
 row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS rank FROM events GROUP BY event_type, user_id) WHERE rank <= 50""")
def _(spark, folder):
    counts = load(spark, folder, "events").groupBy("event_type", F.col("user_id").cast("string").alias("user")).agg(F.count("*").alias("n"))
    return ranks.top_values(counts, ["event_type"], 50, value="user").select("event_type", "user", "n", big("rank").alias("rank"))


@query("e5_head", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, folder):
    top = clean.head_by(load(spark, folder, "orders"), 100, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return top.select("o_orderkey", r("o_totalprice", 4).alias("o_totalprice"))


@query("e6_every_nth_step", """SELECT event_type, step, n FROM (SELECT event_type, user_id % 500 AS step, count(*) AS n FROM events GROUP BY ALL) WHERE step % 100 = 0""")
def _(spark, folder):
    steps = load(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 500).alias("step")).agg(F.count("*").alias("n"))
    return clean.every_nth(steps, "step", 100)


@query("e7_first_and_last", "SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def _(spark, folder):
    turns = load(spark, folder, "conversations")
    last = clean.first_or_last_by_key(turns, ["conv_id"], "turn", ["text"], last=True).withColumnRenamed("text", "last_text")
    first = clean.first_or_last_by_key(turns, ["conv_id"], "turn", ["text"], last=False).withColumnRenamed("text", "first_text")
    return first.join(last, "conv_id")


# ------------------------------------------------------------------ F: set ops
@query("f1_tagged_union", "SELECT 'nation' AS tag, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'customer', c_name FROM customer")
def _(spark, folder):
    parts = [load(spark, folder, t).select(F.lit(t).alias("tag"), F.col(c).alias("name")) for t, c in [("nation", "n_name"), ("region", "r_name"), ("customer", "c_name")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f2_union_distinct", "SELECT p_brand, CAST(CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS BIGINT) AS p_size FROM part UNION SELECT p_type, CAST(p_size AS BIGINT) FROM part")
def _(spark, folder):
    part = load(spark, folder, "part")
    left = part.select("p_brand", big(F.when(F.col("p_size") <= 40, F.col("p_size"))).alias("p_size"))
    return overlap.union_distinct(left, part.select(F.col("p_type").alias("p_brand"), big("p_size").alias("p_size")))


F3_SQL = """SELECT count(*) AS shared FROM (SELECT l_quantity, l_discount, CASE WHEN l_linenumber <> 7 THEN l_tax END FROM lineitem WHERE l_orderkey % 2 = 0
 INTERSECT SELECT l_quantity, l_discount, CASE WHEN l_linenumber <> 7 THEN l_tax END FROM lineitem WHERE l_orderkey % 2 = 1)"""


@query("f3_shared_rows", F3_SQL)
def _(spark, folder):
    rows = load(spark, folder, "lineitem").select(parity_side("l_orderkey"), "l_quantity", "l_discount", F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("t"))
    return overlap.exact_duplicates(rows, {"shared": ("real", "fake")}).select(F.col("score").alias("shared"))


@query("f4_vocabulary_difference", "SELECT p_brand AS value FROM (SELECT DISTINCT p_brand || p_size AS p_brand FROM part WHERE p_partkey % 4 = 0 EXCEPT SELECT p_brand || p_size FROM part WHERE p_partkey % 4 <> 0)")
def _(spark, folder):
    pair = load(spark, folder, "part").select(
        F.when(F.col("p_partkey") % 4 == 0, "fake").otherwise("real").alias("side"), F.concat("p_brand", F.col("p_size").cast("string")).alias("b")
    )
    return overlap.vocabulary_counts(pair, ["b"]).filter((F.col("n_train") == 0) & (F.col("n_other") > 0)).select("value")


@query("f4_vocabulary_union", "SELECT p_type AS value FROM part UNION SELECT p_brand FROM part")
def _(spark, folder):
    part = load(spark, folder, "part")
    return part.select(F.col("p_type").alias("value")).unionByName(part.select(F.col("p_brand").alias("value"))).distinct()


# ------------------------------------------------------------------- G: scalars
@query("g1_string_functions", """SELECT p_partkey, ltrim(concat('  ', p_name)) AS stripped, upper(p_name) AS up, replace(p_brand, '#', '-') AS replaced,
 list_last(string_split(p_name, ' ')) AS last_word, starts_with(p_type, 'S') AS starts, contains(p_name, 'a') AS holds, array_to_string(string_split(p_name, ' '), '_') AS joined FROM part""")
def _(spark, folder):
    words = F.split("p_name", " ")
    return load(spark, folder, "part").select(
        "p_partkey", F.ltrim(F.concat(F.lit("  "), "p_name")).alias("stripped"), F.upper("p_name").alias("up"),
        F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")).alias("replaced"), F.try_element_at(words, F.lit(-1)).alias("last_word"),
        F.col("p_type").startswith("S").alias("starts"), F.contains(F.col("p_name"), F.lit("a")).alias("holds"), F.concat_ws("_", words).alias("joined"),
    )


@query("g2_path_parts", "SELECT page_id, string_split(url, '/')[-1] AS last, string_split(url, '/')[-2] AS second, regexp_replace(url, '^https?://', '') AS bare FROM pages")
def _(spark, folder):
    url = F.col("url")
    return load(spark, folder, "pages").select(
        "page_id", paths.part_from_end(url, 1).alias("last"), paths.part_from_end(url, 2).alias("second"), F.regexp_replace(url, "^https?://", "").alias("bare")
    )


@query("g3_math", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, greatest(0.02, least(0.06, l_discount)) AS clipped, round(ln(l_extendedprice), 9) AS logged,
 round(sqrt(l_quantity), 9) AS rooted, floor(l_extendedprice) AS floored, CAST(l_orderkey % 7 AS BIGINT) AS remainder, round_even(l_quantity / 4, 0) AS half_even FROM lineitem""")
def _(spark, folder):
    return load(spark, folder, "lineitem").select(
        "l_orderkey", big("l_linenumber").alias("l_linenumber"), fn.clip(F.col("l_discount"), 0.02, 0.06).alias("clipped"), r(F.log("l_extendedprice")).alias("logged"),
        r(F.sqrt("l_quantity")).alias("rooted"), F.floor("l_extendedprice").cast("double").alias("floored"), big(F.pmod("l_orderkey", F.lit(7))).alias("remainder"),
        F.bround(F.col("l_quantity").cast("double") / 4, 0).alias("half_even"),
    )


@query("g4_truncate_digits", "SELECT c_custkey, floor(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE AS cut FROM customer")
def _(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", fn.truncate_digits(F.col("c_acctbal"), 1).alias("cut"))


@query("g5_normalize_score", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_discount - 0) / (1 - 0), 9) AS bounded, round(exp(l_discount - 1), 9) AS upper_only,
 round(1 - exp(0 - l_quantity), 9) AS lower_only, round(1 / (1 + exp(-l_tax)), 9) AS open, round(1 - (1 - exp(0 - l_discount)), 9) AS minimized FROM lineitem""")
def _(spark, folder):
    inf = math.inf
    q, d, t = F.col("l_quantity").cast("double"), F.col("l_discount"), F.col("l_tax")
    return load(spark, folder, "lineitem").select(
        "l_orderkey", big("l_linenumber").alias("l_linenumber"), r(fn.normalize_score(d, 0.0, 1.0)).alias("bounded"), r(fn.normalize_score(d, -inf, 1.0)).alias("upper_only"),
        r(fn.normalize_score(q, 0.0, inf)).alias("lower_only"), r(fn.normalize_score(t, -inf, inf)).alias("open"),
        r(fn.normalize_score(d, 0.0, inf, goal="minimize")).alias("minimized"),
    )


@query("g6_null_predicates", f"SELECT t IS NULL AS t_missing, d IS NULL AS d_missing, coalesce(d IN (0.0, 0.05), false) AS listed, count(*) AS n FROM {HOLES} GROUP BY ALL")
def _(spark, folder):
    holes = _holes(spark, folder)
    return holes.groupBy(
        F.isnull("t").alias("t_missing"), F.isnull("d").alias("d_missing"), F.coalesce(F.col("d").isin(0.0, 0.05), F.lit(False)).alias("listed")
    ).agg(F.count("*").alias("n"))


@query("schema_policies", f"""SELECT 'kind' AS "column", round(avg(CASE WHEN TRY_CAST(k AS DOUBLE) IS NULL THEN 0 ELSE 1 END), 9) AS parse_rate FROM
 (SELECT CASE WHEN l_linenumber = 1 THEN '?' ELSE CAST(l_quantity AS VARCHAR) END AS k FROM lineitem)""")
def _(spark, folder):
    """Share of a text column that reads as a number: the input of the parsing policies."""
    lines = load(spark, folder, "lineitem").select(F.when(F.col("l_linenumber") == 1, "?").otherwise(F.col("l_quantity").cast("string")).alias("kind"))
    return aggregates.rates(lines, ["kind"]).select("column", r("parse_rate").alias("parse_rate"))

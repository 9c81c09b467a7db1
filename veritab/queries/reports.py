"""Runner and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import paths
from veritab.plans import reports, runner
from veritab.queries.common import Registry, big, load, r
from veritab.operators.sides import ColumnTypes
from veritab.queries.metrics import DUPLICATE_TAGS, H13_SQL, LEVEL, _part_three, h2_sql, matrix_sql, similarity_sql

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql


def _line_tables(spark, folder):
    lines = load(spark, folder, "lineitem")
    third = F.col("l_orderkey") % 3
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
    test, train, fake = (lines.filter(third == i).select(*names) for i in range(3))
    return runner.Tables(train, test, fake, "train.csv", "test.csv", "fake.csv")


SIZES = "(SELECT count(*) FILTER (l_orderkey % 3 = 0) AS test, count(*) FILTER (l_orderkey % 3 = 1) AS train, count(*) FILTER (l_orderkey % 3 = 2) AS fake FROM lineitem)"


@query("n1_run_histogram", f"""SELECT 'test.csv' AS real_path, CASE tag WHEN 'real' THEN 'train.csv' ELSE 'fake.csv' END AS fake_path, test AS real_size,
 CASE tag WHEN 'real' THEN train ELSE fake END AS fake_size, score, 'histogram_intersection' AS metric, scorer, tag, 50.0::DOUBLE AS bins FROM ({h2_sql()}), {SIZES}""")
def _(spark, folder):
    rows = runner.run_metric(_line_tables(spark, folder), "histogram_intersection")
    return rows.select("real_path", "fake_path", "real_size", "fake_size", r("score").alias("score"), "metric", "scorer", "tag", "bins")


@query("n1_run_duplicates", f"SELECT tag, CAST(score AS DOUBLE) AS score, CASE tag WHEN 'fake_train' THEN 'sum_fake_train' ELSE 'sum' END AS scorer FROM ({H13_SQL})")
def _(spark, folder):
    three = _part_three(spark, folder)
    by = {s: three.filter(F.col("side") == s).drop("side") for s in ("test", "train", "fake")}
    return runner.run_metric(runner.Tables(by["train"], by["test"], by["fake"]), "exact_duplicates").select("tag", "score", "scorer")


RUN_TYPES = ColumnTypes(["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])
# test rows against train (1) or synthetic (2) rows
RUN_PAIR = """(SELECT CASE l_orderkey % 3 WHEN 0 THEN 'real' ELSE 'fake' END AS side, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus
 FROM lineitem WHERE l_orderkey % 3 <> {})"""


@query("n1_run_correlation", " UNION ALL ".join(
    f"SELECT '{tag}' AS tag, 'accuracy' AS scorer, score FROM ({matrix_sql(RUN_PAIR.format(left_out), RUN_TYPES)} SELECT round(avg(CASE WHEN {LEVEL.format('x')} = {LEVEL.format('y')} THEN 1 ELSE 0 END), 9) AS score FROM c)"
    for tag, left_out in [("real", 2), ("fake", 1)]))
def _(spark, folder):
    return runner.run_metric(_line_tables(spark, folder), "correlation_accuracy").select("tag", "scorer", r("score").alias("score"))


@query("n1_run_pairwise", " UNION ALL ".join(
    f"SELECT '{tag}' AS tag, 'mean' AS scorer, score FROM ({similarity_sql(RUN_PAIR.format(left_out), RUN_TYPES)} SELECT round(avg(similarity), 9) AS score FROM t)"
    for tag, left_out in [("real", 2), ("fake", 1)]))
def _(spark, folder):
    return runner.run_metric(_line_tables(spark, folder), "pairwise_similarity").select("tag", "scorer", r("score").alias("score"))


@query("n1_run_efficacy")
def _(spark, folder):
    return runner.run_metric(_line_tables(spark, folder), "efficacy_test", model="tree", scorer="accuracy", target="l_returnflag")


@query("n2_full_evaluation")
def _(spark, folder):
    """All metrics of one synthetic table; the missing one is skipped."""
    t = _line_tables(spark, folder)
    return runner.run_full_evaluation(
        spark, t.train, t.test, {"fake.csv": t.fake, "absent.csv": None}, "l_linestatus"
    )


# report rows derived from orders: one "dataset" per priority, one metric per status
REPORT_ROWS = """(SELECT o_orderpriority AS dataset, CASE WHEN o_orderkey % 5 = 0 THEN 'correlation_accuracy' WHEN o_orderstatus = 'F' THEN 'histogram_intersection' WHEN o_orderstatus = 'O' THEN 'efficacy_test' ELSE 'exact_duplicates' END AS metric,
 CASE WHEN o_custkey % 3 = 0 THEN 'real' WHEN o_custkey % 3 = 1 THEN 'fake' ELSE 'fake_train' END AS tag, CASE WHEN o_custkey % 2 = 0 THEN 'xgb' ELSE 'logistic' END AS model_name,
 CASE WHEN o_orderkey % 2 = 0 THEN 'auc' ELSE 'f1' END AS scorer, o_totalprice / 500000 AS score FROM orders)"""


def _report_rows(spark, folder):
    status, third = F.col("o_orderstatus"), F.col("o_custkey") % 3
    return load(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("dataset"),
        F.when(F.col("o_orderkey") % 5 == 0, "correlation_accuracy").when(status == "F", "histogram_intersection").when(status == "O", "efficacy_test").otherwise("exact_duplicates").alias("metric"),
        F.when(third == 0, "real").when(third == 1, "fake").otherwise("fake_train").alias("tag"),
        F.when(F.col("o_custkey") % 2 == 0, "xgb").otherwise("logistic").alias("model_name"),
        F.when(F.col("o_orderkey") % 2 == 0, "auc").otherwise("f1").alias("scorer"), (F.col("o_totalprice") / 500000).alias("score"),
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def pivot_sql(metric: str, index: str, fake_tag: str) -> str:
    base = f"WITH s AS (SELECT * FROM {REPORT_ROWS}), f AS (SELECT min(dataset) AS d FROM s WHERE tag = 'real')"
    heads = [f"round(avg(score) FILTER (tag = 'real' AND dataset = d), 9) AS real_data"]
    heads += [f"round(avg(score) FILTER (tag = '{fake_tag}' AND dataset = '{p}'), 9) AS \"{p}\"" for p in PRIORITIES]
    return f"{base} SELECT {index}, {', '.join(heads)} FROM s, f WHERE metric = '{metric}' AND ((tag = 'real' AND dataset = d) OR tag = '{fake_tag}') GROUP BY {index}"


def _pivot(name, index):
    def build(spark, folder):
        wide = reports.summary_pivots(_report_rows(spark, folder))[name]
        return wide.select(*index, *[r(F.col(f"`{c}`")).alias(c) for c in ["real_data", *PRIORITIES]])

    return build


query("n3_pivot_efficacy", pivot_sql("efficacy_test", "model_name, scorer", "fake"))(_pivot("efficacy", ["model_name", "scorer"]))
query("n3_pivot_histogram", pivot_sql("histogram_intersection", "metric", "fake"))(_pivot("histogram", ["metric"]))
query("n3_pivot_correlation", pivot_sql("correlation_accuracy", "metric", "fake"))(_pivot("correlation", ["metric"]))
query("n3_pivot_duplicates", pivot_sql("exact_duplicates", "metric", "fake_train"))(_pivot("duplicates", ["metric"]))


# run paths derived from lineitem
N4_SQL = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
 concat('/data/x/y/z/out/runs/LR0.0005-x_uniform_y_shuffle-', shuffle, '_wl0.65/job', l_suppkey, '/w/adult/', CASE WHEN nondp THEN 'NonDP' ELSE 'DP' END,
  '/GPT2/full/m-bs', q, '-epoch', l_linenumber, '-eps', l_linenumber, '-clip1.5/epoch', q, '/synth_impute-False/a/t.csv') AS fake_path,
 'adult' AS dataset, CASE WHEN nondp THEN 'NonDP' ELSE 'DP' END AS setting, 'GPT2' AS llm, 'full' AS finetune_type,
 concat('LR0.0005-x_uniform_y_shuffle-', shuffle, '_wl0.65_job', l_suppkey) AS exp, 'synth_impute-False' AS folder_name, q AS bs, l_linenumber AS train_epoch,
 CAST(q AS VARCHAR) AS chkt_epoch, CASE WHEN nondp THEN 'nondp' ELSE CAST(l_linenumber AS VARCHAR) END AS eps, CASE WHEN nondp THEN 'nondp' ELSE '1.5' END AS clip,
 '0.0005' AS "LR", shuffle, '0.65' AS wl, 'False' AS impute, 'uniform' AS approach
 FROM (SELECT *, l_quantity::INT AS q, CASE WHEN l_returnflag = 'A' THEN 'True' ELSE 'False' END AS shuffle, l_returnflag = 'N' AS nondp FROM lineitem)"""

# Where the runs of this layout keep their settings: runs/<experiment>/<job>/w/<dataset>/<setting>/<model>/<tuning>/<training>/<checkpoint>/<synthesis>/...
RUN = r"/runs/[^/]+/[^/]+/w/"
RUN_SETTINGS = [
    paths.Setting("dataset", RUN + r"([^/]+)/", default="real"),
    paths.Setting("setting", RUN + r"[^/]+/([^/]+)/", default="real"),
    paths.Setting("llm", RUN + r"[^/]+/[^/]+/([^/]+)/", default="real"),
    paths.Setting("finetune_type", RUN + r"[^/]+/[^/]+/[^/]+/([^/]+)/", default="real"),
    paths.Setting("exp", r"/runs/([^/]+/[^/]+)/", default="real", replace=("/", "_")),
    paths.Setting("folder_name", r"/(synth[^/]*)/", default="-1"),
    paths.Setting("bs", r"-bs([0-9]+)(?:-|/)", "int", -1),
    paths.Setting("train_epoch", r"-epoch([0-9]+)(?:-|/)", "int", -1),
    paths.Setting("chkt_epoch", r"/(?:epoch)?((?<=epoch)[0-9]+|step[^/]*)/", default="-1"),
    paths.Setting("eps", r"-eps([0-9]+)(?:\.[0-9]+)?(?:-|/)", default="-1", marks=((r"/NonDP/", "nondp"),)),
    paths.Setting("clip", r"-clip([0-9.]+)(?:-|/)", default="-1", marks=((r"/NonDP/", "nondp"),)),
    paths.Setting("LR", r"/runs/LR([0-9.e]+)-", default="-1"),
    paths.Setting("shuffle", r"_shuffle-([A-Za-z]+)", default="-1"),
    paths.Setting("wl", r"_wl([0-9.]+)", default="-1"),
    paths.Setting("impute", r"_impute-([A-Za-z]+)", default="-1"),
    paths.Setting("approach", default="-1", marks=((r"/runs/[^/]*uniform", "uniform"), (r"/runs/[^/]*[Ss]tandard", "standard"))),
]


def _run_paths(spark, folder):
    q, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    slash = F.lit("/")
    dp = F.when(F.col("l_returnflag") == "N", "NonDP").otherwise("DP")
    shuffle = F.when(F.col("l_returnflag") == "A", "True").otherwise("False")
    path = F.concat(
        F.lit("/data/x/y/z/out/runs/LR0.0005-x_uniform_y_shuffle-"), shuffle, F.lit("_wl0.65/job"), F.col("l_suppkey").cast("string"),
        F.lit("/w/adult/"), dp, F.lit("/GPT2/full/m-bs"), q, F.lit("-epoch"), line, F.lit("-eps"), line, F.lit("-clip1.5/epoch"), q,
        F.lit("/synth_impute-False/a/t.csv"),
    )
    return load(spark, folder, "lineitem").select("l_orderkey", big("l_linenumber").alias("l_linenumber"), path.alias("fake_path"))


def _scorings(spark, folder):
    lines = load(spark, folder, "lineitem")
    metric = F.when(F.col("l_linenumber") < 3, "efficacy_test").when(F.col("l_linenumber") < 5, "histogram_intersection").otherwise("exact_duplicates")
    return lines.select(
        metric.alias("metric"), F.when(F.col("l_returnflag") == "A", "auc").otherwise("mean").alias("scorer"), F.col("l_discount").alias("score"),
        F.col("l_linestatus").alias("model_name"), big("l_linenumber").alias("bins"), F.col("l_returnflag").alias("dataset"), F.col("l_tax").alias("tax"),
    )


SCORINGS = """(SELECT CASE WHEN l_linenumber < 3 THEN 'efficacy_test' WHEN l_linenumber < 5 THEN 'histogram_intersection' ELSE 'exact_duplicates' END AS metric,
 CASE l_returnflag WHEN 'A' THEN 'auc' ELSE 'mean' END AS scorer, l_discount AS score, l_linestatus AS model_name, l_linenumber AS bins, l_returnflag AS dataset, l_tax AS tax FROM lineitem)"""


@query("n4_experiment_dimensions", N4_SQL)
def _(spark, folder):
    return reports.experiment_dimensions(_run_paths(spark, folder), RUN_SETTINGS)


@query("n4_path_settings", """SELECT CAST(l_quantity::INT AS BIGINT) AS bs, CAST(l_linenumber AS BIGINT) AS train_epoch, CAST(l_quantity::INT AS VARCHAR) AS chkt_epoch,
 CASE WHEN l_returnflag = 'N' THEN 'nondp' ELSE CAST(l_linenumber AS VARCHAR) END AS eps, CASE WHEN l_returnflag = 'N' THEN 'nondp' ELSE '1.5' END AS clip,
 concat('LR0.0005-x_uniform_y_shuffle-', CASE l_returnflag WHEN 'A' THEN 'True' ELSE 'False' END, '_wl0.65') AS run, 'uniform' AS approach, '0.0005' AS lr, 'False' AS impute, count(*) AS n
 FROM lineitem GROUP BY ALL""")
def _(spark, folder):
    table = reports.experiment_dimensions(_run_paths(spark, folder), RUN_SETTINGS)
    return table.groupBy(
        big("bs").alias("bs"), big("train_epoch").alias("train_epoch"), "chkt_epoch", "eps", "clip", F.regexp_replace("exp", "_job.*$", "").alias("run"), "approach",
        F.col("LR").alias("lr"), "impute",
    ).agg(F.count("*").alias("n"))


@query("n5_merged_metric_name", f"""SELECT name, short, count(*) AS n FROM (SELECT CASE metric WHEN 'efficacy_test' THEN concat('efficacy_', model_name, '_', scorer) WHEN 'histogram_intersection' THEN concat('histogram_', bins, '_', scorer)
 ELSE concat('exact_', scorer) END AS name, concat(string_split(metric, '_')[1], '_', scorer) AS short FROM {SCORINGS}) GROUP BY ALL""")
def _(spark, folder):
    rows = _scorings(spark, folder)
    name = paths.merged_metric_name(F.col("metric"), F.col("scorer"), F.col("model_name"), F.col("bins"))
    return rows.groupBy(name.alias("name"), paths.short_metric_name(F.col("metric"), F.col("scorer")).alias("short")).agg(F.count("*").alias("n"))


def paper_sql() -> str:
    text = "concat(CAST(round_even(avg({0}), 1) AS VARCHAR), '±', CAST(round_even(stddev_samp({0}), 0) AS VARCHAR))"
    heads = {"efficacy_auc": ("efficacy_test", "auc"), "efficacy_mean": ("efficacy_test", "mean"), "histogram_mean": ("histogram_intersection", "mean")}
    columns = ", ".join(
        f"coalesce(CASE WHEN count(*) FILTER (metric = '{m}' AND scorer = '{s}') > 0 THEN {text.format(f'CASE WHEN metric = {chr(39)}{m}{chr(39)} AND scorer = {chr(39)}{s}{chr(39)} THEN score * 100 END')} END, '-') AS {h}"
        for h, (m, s) in heads.items()
    )
    return f"SELECT dataset, model_name, {columns} FROM {SCORINGS} WHERE tax < 0.07 GROUP BY dataset, model_name"


@query("n6_paper_table", paper_sql())
def _(spark, folder):
    return reports.paper_table(
        _scorings(spark, folder), F.col("tax") < 0.07, ["dataset", "model_name"], ["efficacy_auc", "efficacy_mean", "histogram_mean"],
        order={"dataset": ["R", "N", "A"], "model_name": ["O", "F"]},
    )


@query("n7_perplexity_curves", """SELECT step, """ + ", ".join(f"round(avg(value) FILTER (method = '{m}'), 6) AS \"{m}\"" for m in EVENT_TYPES) + """ FROM
 (SELECT event_id % 2000 AS step, event_type AS method, value FROM events) WHERE step % 100 = 0 GROUP BY step""")
def _(spark, folder):
    logs = load(spark, folder, "events").select((F.col("event_id") % 2000).alias("step"), F.col("event_type").alias("method"), "value")
    table = reports.perplexity_curves(logs, "step", EVENT_TYPES, "value")
    return table.select("step", *[r(m, 6).alias(m) for m in EVENT_TYPES])

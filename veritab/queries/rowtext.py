"""Row-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.operators import profile, rowtext
from veritab.operators.sides import ColumnTypes
from veritab.queries.common import Registry, big, load, r, uniform_sql
from veritab.queries.synthesis import category_sql, empirical_sql

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql

COLUMNS = ["p_name", "p_brand", "p_size"]
SOURCE = "(SELECT p_partkey, concat(' ', p_name, ' ') AS p_name, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS p_brand, p_size FROM part)"
VALUES = {"p_name": "trim(p_name)", "p_brand": "coalesce(p_brand, 'Missing')", "p_size": "CAST(p_size AS VARCHAR)"}
TOKENS = {"p_name": "[CAT]", "p_brand": "[CAT]", "p_size": "[NUM]"}


def _parts(spark, folder):
    part = load(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("p_name"),
        F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("p_brand"), "p_size",
    )
    return part, profile.build_profile(part.select(*COLUMNS), ColumnTypes(["p_size"], ["p_name", "p_brand"]))


def serialized_sql(style: str) -> str:
    if style == "apval":
        names, values = ", ".join(COLUMNS), ", ', ', ".join(VALUES[c] for c in COLUMNS)
        return f"concat(' {names} : ', {values})"
    sep = rowtext.STYLES[style].key_value
    cells = ", ' ', ".join(f"concat('{TOKENS[c]} {c} {sep} ', {VALUES[c]}, ' [EOC]')" for c in COLUMNS)
    return f"concat('[BOS] ', {cells}, ' [EOS]')"


def _serialize(style):
    def build(spark, folder):
        part, built = _parts(spark, folder)
        return rowtext.serialize(part, built, style, COLUMNS, keep=["p_partkey"])

    return build


for _style in rowtext.STYLES:
    query(f"t1_serialize_{_style}", f"SELECT p_partkey, {serialized_sql(_style)} AS text FROM {SOURCE}")(_serialize(_style))


@query("t2_shuffled_cells", f"SELECT p_partkey, list_aggregate(list_sort([{', '.join(VALUES[c] for c in COLUMNS)}]), 'string_agg', '|') AS cells FROM {SOURCE}")
def _(spark, folder):
    """Texts with a drawn column order hold the same cells."""
    part, built = _parts(spark, folder)
    texts = rowtext.serialize(part, built, "great", COLUMNS, seed=3, keys=["p_partkey"], keep=["p_partkey"])
    back = rowtext.deserialize(texts, "text", COLUMNS, keep=["p_partkey"])
    return back.select("p_partkey", F.array_join(F.array_sort(F.array(*COLUMNS)), "|").alias("cells"))


MESSY = "concat('p_brand is ', p_brand, ', other is 1, p_size is ', CAST(p_size AS VARCHAR), ', p_name, p_brand is ', p_type, ' is x')"


def _messy(spark, folder):
    return load(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("p_brand is "), "p_brand", F.lit(", other is 1, p_size is "), F.col("p_size").cast("string"),
                              F.lit(", p_name, p_brand is "), "p_type", F.lit(" is x")).alias("text"),
    )


@query("t3_deserialize_last", "SELECT p_partkey, 'placeholder' AS p_name, p_type AS p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, folder):
    return rowtext.deserialize(_messy(spark, folder), "text", COLUMNS, keep=["p_partkey"])


@query("t4_deserialize_first", "SELECT p_partkey, 'placeholder' AS p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, folder):
    return rowtext.deserialize(_messy(spark, folder), "text", COLUMNS, first_wins=True, keep=["p_partkey"])


def _style_round(style):
    def build(spark, folder):
        part, built = _parts(spark, folder)
        texts = rowtext.serialize(part, built, style, COLUMNS, keep=["p_partkey"])
        return rowtext.deserialize(texts, "text", COLUMNS, style, keep=["p_partkey"])

    return build


for _style in ("list", "text", "apval"):
    query(f"t3_deserialize_{_style}", f"SELECT p_partkey, {', '.join(f'{VALUES[c]} AS {c}' for c in COLUMNS)} FROM {SOURCE}")(_style_round(_style))


@query("u4_cells_from_text", """SELECT p_partkey, unnest(['p_brand', 'other', 'p_size', 'p_name', 'p_brand']) AS key,
 unnest([p_brand, '1', CAST(p_size AS VARCHAR), NULL, p_type]) AS value FROM part""")
def _(spark, folder):
    return _messy(spark, folder).select("p_partkey", F.explode(rowtext.parsed_cells(F.col("text"), "great")).alias("c")).select("p_partkey", "c.key", "c.value")


@query("t5_prompts_default", "SELECT p_partkey AS id, 'The p_size is' AS prompt FROM part")
def _(spark, folder):
    ids = load(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return rowtext.start_prompts(ids, "default", COLUMNS, "text", start="p_size")


@query("t5_prompts_value", "SELECT p_partkey AS id, concat('p_brand, p_name, p_size : ', p_brand, ',') AS prompt FROM part")
def _(spark, folder):
    part = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    return rowtext.start_prompts(part, "categorical", COLUMNS, "apval", start="p_brand", value=F.col("p_brand"))


T5_BRANDS = "(SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE 'Missing' END AS b FROM part)"


@query("t5_prompts_random", f"""SELECT k AS id, concat('p_brand is ', v, ', ', ['p_name', 'p_brand', 'p_size'][1 + floor({uniform_sql(5, 'k')} * 3)::INT], ' is') AS prompt
 FROM {category_sql(T5_BRANDS, 'b', 5, 'p_partkey')}""")
def _(spark, folder):
    """A drawn category followed by a drawn opening column."""
    from veritab.operators.synth import weighted_category

    part, built = _parts(spark, folder)
    ids = part.select(F.col("p_partkey").alias("id"))
    return rowtext.start_prompts(
        ids, "categorical_and_random", COLUMNS, "great", start="p_brand", value=weighted_category(built.of("p_brand"), 5, [F.col("id")]), seed=5
    )


@query("t5_prompts_continuous", f"SELECT k AS id, concat('p_size is ', v::DOUBLE, ',') AS prompt FROM {empirical_sql('part', 'p_size', 'part', 'p_partkey', 9)}")
def _(spark, folder):
    """A drawn observed number opens each prompt."""
    from veritab.operators.synth import empirical_sample

    part = load(spark, folder, "part")
    drawn = empirical_sample(part, "p_size", part.select(F.col("p_partkey").alias("id")), ["id"], seed=9, output="v")
    return rowtext.start_prompts(drawn, "continuous", COLUMNS, "great", start="p_size", value=F.col("v"))


@query("t5_prompts_custom", r"SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('first', chr(10), 'row') ELSE 'second' END AS prompt FROM part")
def _(spark, folder):
    ids = load(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return rowtext.start_prompts(ids, "custom", COLUMNS, custom=["first\\nrow", "second"])


HOLED = "(SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_brand END AS p_brand, CASE WHEN p_size % 2 > 0 THEN p_size END AS p_size, p_type FROM part)"


def _holed(spark, folder):
    size = F.col("p_size")
    return load(spark, folder, "part").select(
        "p_partkey", F.when(size % 3 > 0, F.col("p_brand")).alias("p_brand"), F.when(size % 2 > 0, size).alias("p_size"), "p_type"
    )


@query("t6_partial_prompts", f"""SELECT p_partkey, concat_ws(' ', CASE WHEN p_brand IS NOT NULL THEN concat('p_brand is ', p_brand, ',') END, CASE WHEN p_size IS NOT NULL THEN concat('p_size is ', p_size, ',') END,
 concat('p_type is ', p_type, ','), CASE WHEN p_brand IS NULL THEN 'p_brand is' WHEN p_size IS NULL THEN 'p_size is' END) AS prompt,
 CASE WHEN p_brand IS NULL THEN 'p_brand' WHEN p_size IS NULL THEN 'p_size' END AS open_column FROM {HOLED}""")
def _(spark, folder):
    return rowtext.partial_prompts(_holed(spark, folder), ["p_brand", "p_size", "p_type"], ["p_partkey"])


@query("t6_partial_prompts_shuffled")
def _(spark, folder):
    return rowtext.partial_prompts(_holed(spark, folder), ["p_brand", "p_size", "p_type"], ["p_partkey"], "list", seed=4)


@query("t7_expand_prompts", f"""WITH s AS (SELECT string_agg({serialized_sql('great')}, chr(10) ORDER BY p_partkey) AS shots FROM {SOURCE} WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 2))
 SELECT p_partkey AS id, concat('Rows like:', chr(10), shots, chr(10), 'p_size is') AS prompt FROM part, s""")
def _(spark, folder):
    part, built = _parts(spark, folder)
    shots = rowtext.serialize(part.orderBy("p_partkey").limit(2), built, "great", COLUMNS, keep=["p_partkey"])
    prompts = rowtext.start_prompts(part.select(F.col("p_partkey").alias("id")), "default", COLUMNS, "great", start="p_size")
    return rowtext.expand_prompts(prompts, "Rows like:\n{}\n", shots.select(F.col("p_partkey").alias("position"), "text"))


@query("t8_anchor_positions", f"""WITH w AS (SELECT p_partkey, string_split({serialized_sql('great')}, ' ')[1:9] AS words FROM {SOURCE}),
 a AS (SELECT p_partkey, list_filter(range(9), lambda i: words[i + 1] IN ('[NUM]', '[CAT]', '[MIX]')) AS hits FROM w)
 SELECT p_partkey, coalesce(hits[1], -1) AS first, coalesce(hits[2], -1) AS second, coalesce(hits[3], -1) AS third FROM a""")
def _(spark, folder):
    part, built = _parts(spark, folder)
    texts = rowtext.serialize(part, built, "great", COLUMNS, keep=["p_partkey"])
    anchors = rowtext.anchor_positions(texts, "text", 3, limit=9, keep=["p_partkey"])
    return anchors.select("p_partkey", *[big(F.get("anchors", F.lit(i))).alias(n) for i, n in enumerate(["first", "second", "third"])])


@query("t9_round_trip", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS failures FROM documents")
def _(spark, folder):
    """Whole documents as cells, in a drawn column order."""
    documents = load(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    built = profile.build_profile(documents.select("lang", "source", "text", "n_chars"), ColumnTypes(["n_chars"], ["lang", "source", "text"]))
    failures = rowtext.round_trip_failures(documents, built, ["doc_id"], "great", seed=1)
    return failures.agg(F.lit(documents.count()).cast("bigint").alias("rows"), F.count("*").alias("failures"))


@query("t10_token_inventory", f"""WITH n AS (SELECT count(*) AS n FROM part), k(role, token, times) AS (VALUES ('key', 'p_name', 1), ('key', 'p_brand', 1), ('key', 'p_size', 1), ('other', '[CAT]', 2), ('other', '[NUM]', 1),
 ('other', 'is', 3), ('other', '[EOC]', 3), ('other', '[BOS]', 1), ('other', '[EOS]', 1))
 SELECT role, token, n * times AS n FROM k, n UNION ALL SELECT 'value', token, count(*) FROM (SELECT unnest(list_concat(regexp_split_to_array({VALUES['p_name']}, '\\s+'), [{VALUES['p_brand']}, {VALUES['p_size']}])) AS token FROM {SOURCE}) GROUP BY token""")
def _(spark, folder):
    part, built = _parts(spark, folder)
    return rowtext.token_inventory(part, built).select("role", "token", big("n").alias("n"))

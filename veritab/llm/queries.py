"""Queries of the thirteen operators over the whole driver tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import ready
from veritab.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The file of a public tokenizer; the same path on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the word-ending vocabulary."""
    from veritab.llm.tokencounts import token_counts

    return token_counts(load(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids and decoded text of every document as counts and digests."""
    from veritab.llm.bpe import round_trip

    return round_trip(docs, vocabulary("byte_bpe_50k.json")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_bpe_transducer")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded by the byte-level vocabulary."""
    return bpe_digests(load(spark, folder, "documents"))


@query("op10_pii_spans")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in every document; the counts and the digest are those of the base patterns."""
    from veritab.llm.pii import KINDS, find

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rank = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    merged = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return (
        find(load(spark, folder, "documents"))
        .withColumn("merged", merged)
        .select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("merged").alias("spans"), F.size("added").cast("long").alias("n_added"))
    )


@query("op8_simhash_pivots")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from veritab.llm.simhash import near_duplicates

    return near_duplicates(load(spark, folder, "documents"))


@query("op3_fm_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of the whole benchmark."""
    from veritab.llm.fmindex import find

    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return find(load(spark, folder, "documents"), load(spark, folder, "benchmark")).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op5_rans_files")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All ids of all documents written to coded files in order of the documents, and read back."""
    from veritab.llm import rans

    files = scratch_folder(spark, "rans")
    rans.write(load(spark, folder, "documents"), files, vocabulary("word_bpe_49k.json"))
    return rans.describe(spark, files)


def remainder(divisor: int) -> Column:
    """CRC-32 of the id as text, modulo a number; NULL ids have remainder -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(-1))


@query("op1_quality_discriminant")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels whose remainder of 3 is not 1."""
    from veritab.llm.quality import score

    scored = score(load(spark, folder, "documents"), load(spark, folder, "labels"), remainder(3) != 1)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query("op6_toxicity_network")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels whose remainder of 5 is not 0."""
    from veritab.llm.toxicity import fit, score

    docs = load(spark, folder, "documents")
    model = fit(docs, load(spark, folder, "labels"), remainder(5) != 0)
    return score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@query("op7_cross_polytope")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest vectors of every fiftieth, among all vectors."""
    from veritab.llm.crosspolytope import nearest

    return nearest(load(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op11_filter_audit",
    """WITH d AS (SELECT coalesce(d.lang, '') AS part, d.doc_id, coalesce(d.text, '') AS text,
 regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+') AS words, g.good, g.toxic
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) g USING (doc_id)),
 m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
 doc_id > min(doc_id) OVER (PARTITION BY text)] AS f FROM d),
 i AS (SELECT unnest(range(1, 6)) AS i),
 o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM i a, i b, i c, i e, i g WHERE a.i NOT IN (b.i, c.i, e.i, g.i) AND b.i NOT IN (c.i, e.i, g.i) AND c.i NOT IN (e.i, g.i) AND e.i <> g.i),
 s AS (SELECT o, array_to_string([substr('ABCDE', x::BIGINT, 1) for x in o], '') AS filter_order, step, o[step] AS own FROM o, (SELECT unnest(range(1, 6)) AS step)),
 c AS (SELECT part, f, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM m GROUP BY ALL),
 t AS (SELECT *, list_bool_or([f[x] for x in o[1:step - 1]]) IS TRUE AS earlier, f[own] AS failing, len([x for x in f if x]) = 1 AS single FROM s, c),
 r AS (SELECT part, filter_order, step, own, sum(n * (NOT earlier AND NOT failing)::INT)::BIGINT AS kept, sum(n * (NOT earlier AND failing)::INT)::BIGINT AS removed,
 sum(n * (earlier AND failing)::INT)::BIGINT AS redundant, sum(n * (failing AND single)::INT)::BIGINT AS unique_fails,
 sum(good * (NOT earlier AND failing)::INT)::BIGINT AS good_lost, sum(toxic * (NOT earlier AND failing)::INT)::BIGINT AS toxic_lost FROM t GROUP BY ALL)
 SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all orders over all documents, by language."""
    from veritab.llm.filteraudit import audit

    return audit(load(spark, folder, "documents"), load(spark, folder, "labels"))


@query("op12_ngram_join")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents by the Jaccard similarity of their five-word shingles."""
    from veritab.llm.jaccardjoin import similarity_components

    return similarity_components(load(spark, folder, "documents"))


@query("op13_chebyshev_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors whitened over up to 32 components."""
    from veritab.llm.whitening import whiten

    return whiten(load(spark, folder, "embeddings"))


def damaged(stored: DataFrame) -> DataFrame:
    """A replica with faults: some records lost, some cut short, some with another byte."""
    rest = stored.where(F.coalesce(F.col("id") % 101 != 7, F.lit(True)))
    short = F.expr("substring(data, 1, octet_length(data) - 9)")
    other = F.expr("concat(substring(data, 1, octet_length(data) - 5), X'23', substring(data, octet_length(data) - 3, 4))")
    return rest.withColumn("data", F.when(F.col("id") % 103 == 5, short).when(F.col("id") % 97 == 13, other).otherwise(F.col("data")))


@query(
    "op2_warc_fixity",
    """WITH r AS (SELECT page_id // 4096 AS file, page_id % 4096 AS node, page_id AS id,
 strlen('WARC/1.1__WARC-Type: response__WARC-Target-URI: ' || url || '__WARC-Date: 2024-01-01T00:00:00Z__WARC-Record-ID: <urn:page:' || page_id
 || '>__Content-Type: text/html__Content-Length: ' || strlen(html) || '____' || html || '____') AS size,
 page_id % 101 = 7 AS lost, page_id % 103 = 5 AS short, page_id % 97 = 13 AND right(html, 1) <> '#' AS other FROM pages),
 s AS (SELECT *, CASE WHEN lost THEN 0 WHEN short THEN size - 9 ELSE size END AS kept FROM r),
 p AS (SELECT *, sum(size) OVER w - size AS start, sum(kept) OVER w - kept AS other_start FROM s WINDOW w AS (PARTITION BY file ORDER BY node))
 SELECT CAST(file AS BIGINT) AS file, CAST(node AS BIGINT) AS node, id, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size,
 CASE WHEN NOT lost THEN CAST(other_start AS BIGINT) END AS other_start, CASE WHEN NOT lost THEN CAST(kept AS BIGINT) END AS other_size,
 CASE WHEN lost THEN 'missing' ELSE 'changed' END AS fault FROM p WHERE lost OR short OR other""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Fixity audit of all pages as records against a damaged replica."""
    from veritab.llm.warc import audit, records, tree
    from veritab.session import freeze

    stored = records(load(spark, folder, "pages"))
    return audit(freeze(tree(stored)), freeze(tree(damaged(stored))))

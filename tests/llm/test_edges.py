"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables in every operator and stage."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

from veritab.llm import bpe, fmindex, pii, quality, rans, simhash, tokencounts, toxicity
from veritab.llm.queries import vocabulary
from veritab.session import scratch_folder

TEXTS = [
    (1, "A plain text of some words, nothing else in it at all."), (2, "A plain text of some words, nothing else in it at all."), (2, "A plain text of some words, nothing else in it at all."),
    (3, None), (4, ""), (5, " \n\t "), (None, "mail me at bob@example.com or +1 (499) 555-6503"), (None, None), (6, "stupid idiot " * 4),
    (7, "word " * 60000), (8, "x" * 300000), (9, "one two three four five six seven eight nine ten eleven twelve"), (10, "<|endoftext|> é 가"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, 0.5, "w", "i") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, word string, ids string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (6, 0, 1), (4, None, None), (None, 1, 1), (9, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, None), (3, ""), (None, "nothing else"), (4, "...")], "item_id long, text string")


def operators(labels, benchmark):
    path, words = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")

    def files(docs):
        folder = scratch_folder(docs.sparkSession, "edges")
        rans.write(docs, folder, words)
        return rans.describe(docs.sparkSession, folder)

    return {
        "quality": lambda d: quality.score(d, labels),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "decontamination": lambda d: fmindex.find(d, benchmark),
        "encode": lambda d: bpe.encode(d, path),
        "decode": lambda d: bpe.decode(bpe.encode(d, path), path),
        "files": files,
        "near_duplicates": simhash.near_duplicates,
        "counts": lambda d: tokencounts.token_counts(d, words),
        "pii": pii.find,
    }


NAMES = ["quality", "toxicity", "decontamination", "encode", "decode", "files", "near_duplicates", "counts", "pii"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(docs, labels, benchmark, name):
    found = operators(labels, benchmark)[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in TEXTS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, benchmark, name):
    assert operators(labels, benchmark)[name](docs.limit(0)).collect() == []


def test_without_labels(docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_defined_values(docs, benchmark):
    by_text = {r.doc_id: r for r in tokencounts.token_counts(docs, vocabulary("word_bpe_49k.json")).collect()}
    assert [(by_text[i].n_bytes, by_text[i].n_tokens) for i in (3, 4, 5)] == [(0, 0), (0, 0), (4, 0)]
    near = [r for r in simhash.near_duplicates(docs).collect()]
    assert {r.component_id for r in near if r.doc_id in (1, 2)} == {1}
    assert {(r.fingerprint, r.component_id) for r in near if r.doc_id in (3, 4, 5)} == {("0" * 16, 3)}
    assert {r.component_id for r in near if r.doc_id is None and r.fingerprint != "0" * 16} == {None}
    hits = {r.doc_id: r for r in fmindex.find(docs, benchmark).collect()}
    assert hits[9].items == ["1"] and [tuple(s) for s in hits[9].spans] == [(0, 10)] and [tuple(s) for s in hits[1].spans] == [(6, 8)] and hits[1].items == []
    assert fmindex.find(docs, benchmark.limit(0)).where(F.size("spans") > 0).count() == 0
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json")).collect() if r.doc_id}
    assert texts == {i: t or "" for i, t in TEXTS if i}


@pytest.fixture(scope="module")
def folder(spark, docs, labels, benchmark):
    place = scratch_folder(spark, "edge-tables")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{place}/{name}.parquet")
    return place


def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.mark.parametrize("index", range(5))
def test_stage_on_odd_rows(spark, docs, folder, index):
    name, stage = pipeline().STAGES[index]
    found = stage(spark, docs, folder)
    if index < 4:
        assert found.dtypes == docs.dtypes
    rows = found.collect()
    assert stage(spark, docs.limit(0), folder).collect() == []
    if name == "benchmark_decontamination":
        assert {r.text for r in rows if r.doc_id == 9} == {"eleven twelve"}
        assert {r.text for r in rows if r.doc_id == 3} == {None}
    if name == "simhash_near_dedup":
        kept = [r.doc_id for r in rows]
        assert sorted(kept, key=str) == sorted([1, 3, 6, 7, 8, 9, 10, None], key=str)  # the row without an id whose text is another's stays, the empty one goes
    if name == "pii":
        assert "mail me at [EMAIL] or [PHONE]" in {r.text for r in rows}


def test_pipeline_equals_its_stages(spark):
    """Each stage against a plain version of what it decides, on its own input."""
    from test_near_copies import plain_roots
    from test_texts import plain_hits

    where = "/root/testdata/sf0.001"
    stages = dict(pipeline().STAGES)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    clean = stages["toxicity"](spark, docs, where).cache()
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{where}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.where("score < 0.5").collect()}
    rows = {r.doc_id: r.text or "" for r in clean.collect()}
    single = stages["simhash_near_dedup"](spark, clean, where).cache()
    assert {r.doc_id for r in single.collect()} == set(plain_roots(rows)[0].values())  # five words, 0.8
    cut = stages["benchmark_decontamination"](spark, single, where).cache()
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in (single, cut))
    assert not any(hit for _, hit, _ in plain_hits(after.values(), items, 10))
    for doc_id, (_, hit, _) in zip(before, plain_hits(before.values(), items, 10), strict=True):
        assert (after[doc_id] == before[doc_id]) == (hit == 0)
    masked = {r.doc_id: (r.text, r.n_chars) for r in stages["pii"](spark, cut, where).collect()}
    assert masked == {i: (pii.masked(t), len(pii.masked(t))) for i, t in after.items()}
    for table in (clean, single, cut):
        table.unpersist()
    final = pipeline().run(spark, where).collect()
    assert {r.doc_id for r in final} == set(masked)


def test_rest_imports_without_the_subpackage(tmp_path):
    """The entry module works where the subpackage and the pipeline are missing."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/veritab", tmp_path / "veritab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})

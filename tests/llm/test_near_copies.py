"""The near-duplicate stage of the pipeline against brute force over all pairs of texts."""

import itertools
import random

from pyspark.sql import functions as F



def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    """Smallest id reachable through pairs with a Jaccard similarity of 0.8, and how many pairs of unequal sets there are."""
    sets, parent, pairs = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}, []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            pairs += [(i, j)] if a != b else []
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return {i: root(i) for i in sets}, pairs


def edited(draw, words, share):
    return [f"new{draw.random()}" if draw.random() < share else w for w in words]


def test_stage_drops_edited_copies(spark):
    """A copy with one word in fifty changed lies far outside two bits of a fingerprint, and has to go."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(500)]
    other = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [1, 3]


def test_stage_equals_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected, _ = plain_roots({r.doc_id: r.text for r in docs.collect()})
    kept = corpus_pipeline.drop_copies(spark, docs, "").select(F.col("doc_id")).collect()
    assert {r.doc_id for r in kept} == set(expected.values())


def test_templates_lose_no_link(spark):
    """Texts of one template with few words of their own: every group found, one row of each stays."""
    from veritab.llm import jaccardjoin

    draw = random.Random(21)
    common = [f"c{i}" for i in range(40)]
    texts = {}
    for k in range(700):
        # seventy groups over the template, some of their members too far from the others
        own = [f"g{k % 70}x{i}" for i in range(9)] + [f"o{draw.random()}" for _ in range(draw.choice([0, 1, 3, 8, 16]))]
        texts[k] = " ".join(common + own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected, pairs = plain_roots(texts)
    assert len(pairs) > 1000 and 70 <= len(set(expected.values())) < 600
    assert {r.doc_id for r in jaccardjoin.keep_first(docs).collect()} == set(expected.values())


def test_rows_that_repeat_and_rows_without_an_id(spark):
    from veritab.llm import jaccardjoin

    long = " ".join(f"w{i}" for i in range(300))
    rows = [(None, long), (None, long), (7, long + " x"), (7, long + " x"), (None, "only here now"), (None, "Only  here now"), (3, "a b c d e f"), (3, "other words of the same id")]
    docs = spark.createDataFrame([(i, t, k, "n") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int, name string")
    found = jaccardjoin.keep_first(docs)
    assert found.columns == docs.columns
    assert sorted((str(r.doc_id), r.text.lower().replace("  ", " ")) for r in found.collect()) == sorted([("7", long + " x"), ("None", "only here now"), ("3", "a b c d e f"), ("3", "other words of the same id")])

"""Classifiers, nearest neighbours and the fixity audit."""

import random
import zlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from veritab.llm import crosspolytope, quality, toxicity, warc
from veritab.llm.queries import QUERIES, SQL, damaged

FOLDER = "/root/testdata/sf0.01"


def held_out_accuracy(spark, name, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES[name](spark, FOLDER).where("held_out").join(labels, "doc_id")
    found = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert 0 <= found.low <= found.high <= 1
    return found.a


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, "op1_quality_discriminant", "quality") > 0.95


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, "op6_toxicity_network", "toxic") > 0.9  # 46 toxic documents to learn from


def test_discriminant_equals_densities():
    draw = np.random.default_rng(1)
    classes = [draw.normal(0, 1, (200, 3)), draw.normal(1, 2, (300, 3))]
    model = quality.discriminant(
        np.array([200.0, 300.0]), np.array([c.sum(axis=0) for c in classes]), np.array([c.T @ c for c in classes]), to_pooled=0, to_identity=0
    )
    x = draw.normal(0, 2, (50, 3))
    logs = []
    for c in classes:
        covariance = np.cov(c.T, bias=True) + 1e-6 * np.eye(3)
        z = x - c.mean(axis=0)
        logs.append(np.log(len(c)) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(covariance), z) - 0.5 * np.log(np.linalg.det(covariance)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_network_gradients():
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(1).items()}
    scores, buckets = draw.normal(size=(5, 4, 4)), draw.integers(0, toxicity.VECTORS, (5, 4, 3))
    mask = np.ones((5, 4), dtype=bool)
    mask[3:, 1] = mask[1:, 2] = False
    label = np.array([0, 1, 1, 0])
    _, gradients = toxicity.fit_step(p, scores, buckets, mask, label)
    for name in ("out", "attend", "query", "rec_f", "rec_b", "in_f", "in_b", "bias_f"):
        at = tuple(draw.integers(0, s) for s in p[name].shape)
        sides = []
        for move in (0.01, -0.01):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += move
            sides.append(toxicity.fit_step(q, scores, buckets, mask, label)[0])
        assert np.isclose((sides[0] - sides[1]) / 0.02, gradients[name][at], rtol=1e-2, atol=1e-6)


def test_windows_cover_every_token():
    for n in (0, 1, 63, 64, 65, 96, 97, 128, 1000):
        ids = np.arange(1, n + 1)
        found = toxicity.cut(ids)
        assert set(found.reshape(-1)) - {0} == set(ids)
        assert found.shape[1] == toxicity.WINDOW


def test_batches_do_not_change_scores():
    draw = random.Random(1)
    words = [b"".join(draw.choices([b"ab", b"cd", b"ef"], k=3)) for _ in range(30)]
    texts = [(b" ".join(draw.choices([*words, b"nasty"] if i % 3 == 0 else words, k=draw.randint(1, 200))), int(i % 3 == 0)) for i in range(60)]
    scorer = toxicity.Scorer(toxicity.train(texts, steps=10))
    whole = scorer.texts([t for t, _ in texts])
    assert np.allclose(whole, [scorer.texts([t])[0] for t, _ in texts], atol=1e-5)
    assert np.allclose(whole, scorer.texts([t for t, _ in texts], at_once=3), atol=1e-5)


def neighbours(rows, k):
    """Exact cosines of every fiftieth row."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    norms = np.linalg.norm(x, axis=1)
    for i in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[i] / norms / norms[i]
        order = [j for j in np.lexsort((ids, -cosine.round(12))) if ids[j] != ids[i]][:k]
        yield int(ids[i]), [(int(ids[j]), cosine[j]) for j in order]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = {}
    for r in QUERIES["op7_cross_polytope"](spark, folder).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for query, best in neighbours(rows, 5):
        mine = [found[query][rank] for rank in sorted(found[query])]
        assert [(-s, i) for i, s in mine] == sorted((-s, i) for i, s in mine)
        hits += len({i for i, _ in mine} & {i for i, _ in best})
        total += len(best)
    assert hits / total >= 0.9


def test_parts_and_equal_vectors(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(i, draw.normal(size=3).tolist()) for i in range(40, 101)]
    rows += [(200, [0.0, 0.0, 0.0]), (250, None), (300, [1.0, None, 2.0]), (350, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (400, []), (450, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(crosspolytope, "PART", 4)
    found = {}
    for r in crosspolytope.nearest(table, F.col("vec_id") % 50 == 0, tables=8, probes=8).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [i for _, i, _ in sorted(found[0])] == [1, 2, 3, 4, 5]
    whole = {q: [i for i, _ in best] for q, best in neighbours(rows[:101], 5)}
    assert {q: [i for _, i, _ in sorted(found[q])] for q in (0, 50, 100)} == whole
    assert set(found) == {0, 50, 100}  # a vector of another length has no candidates
    assert crosspolytope.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_audit_equals_sql(spark):
    for folder in ("/root/testdata/sf0.001", FOLDER):
        assert compare(QUERIES["op2_warc_fixity"](spark, folder), connect(folder), SQL["op2_warc_fixity"]) is None


def test_audit_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", "a"), (1, "u", "b"), (2, None, None), (None, "x", "y"), (None, "x", "y"), (9000, "é", "ü" * 50), (13, "u", "z")], "page_id long, url string, html string"
    ).withColumn("data", F.lit("clash"))
    stored = warc.records(pages)
    assert warc.audit(warc.tree(stored), warc.tree(stored)).count() == 0
    found = {r.id: r.fault for r in warc.audit(warc.tree(stored), warc.tree(damaged(stored))).collect()}
    assert found == {13: "changed"}
    found = {(r.id, r.fault) for r in warc.audit(warc.tree(stored.where("id = 1")), warc.tree(stored.where("id <= 2"))).collect()}
    assert found == {(2, "extra")}
    assert warc.audit(warc.tree(stored.limit(0)), warc.tree(stored.limit(0))).count() == 0


def test_small_tables_are_searched_whole(spark):
    """Every candidate comes back where there are fewer than five, whatever the buckets; several lengths, huge and tiny entries."""
    draw = np.random.default_rng(17)
    rows = [(50 * i, (draw.normal(size=64) * 10.0 ** draw.choice([-200, 0, 200])).tolist()) for i in range(4)]
    rows += [(5000 + 50 * i, draw.normal(size=100).tolist()) for i in range(3)] + [(9000, draw.normal(size=7).tolist())]
    table = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, size int, code int, ids string, rank int")
    found = {}
    for r in crosspolytope.nearest(table, F.col("vec_id") % 50 == 0, tables=2, probes=1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: {i for i, _ in x} for q, x in found.items()} == {i: {j for j, w in rows if j != i and len(w) == len(v)} for i, v in rows if len(v) != 7}
    vectors = dict(rows)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    assert all(abs(s - unit(vectors[q]) @ unit(vectors[i])) < 1e-12 for q, x in found.items() for i, s in x)


def test_many_equal_scores_and_repeated_ids(spark):
    """Scaled copies tie: the smallest ids come first; a row that repeats the query's id is not its neighbour."""
    base = np.random.default_rng(3).normal(size=16)
    rows = [(0, base.tolist())] + [(i, (base * 2.0**i).tolist()) for i in range(30, 0, -1)] + [(0, (-base).tolist()), (7, base.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = {r["rank"]: r.vec_id for r in crosspolytope.nearest(table, F.col("vec_id") == 1).collect()}
    assert best == {1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_word_parts_together():
    """Checksums of all parts at once equal those of each part, also of words shorter than a part."""
    words = [b"a", b"it", b"the", b"word", b"\xc3\xa9t\xc3\xa9", b"0123456789" * 9, b"a"]
    marked = [b"<" + w + b">" for w in words]
    parts = [[zlib.crc32(m[i : i + n], n) & (toxicity.BUCKETS - 1) for n in range(3, 7) for i in range(max(1, len(m) - n + 1))] for m in marked]
    flat, starts, sizes = toxicity.ngram_buckets(words, at_once=3)
    assert [flat[a : a + n].tolist() for a, n in zip(starts, sizes)] == parts


def test_new_words_of_many_texts_are_looked_up_together(monkeypatch):
    model = toxicity.train([(f"word{i} is {'bad' if i % 2 else 'fine'}".encode(), i % 2) for i in range(40)], steps=2)
    calls, gates = [], toxicity.Model.gates
    monkeypatch.setattr(toxicity.Model, "gates", lambda self, words: calls.append(1) or gates(self, words))
    texts = [f"new{i} words {i}".encode() for i in range(100)] + [b""]
    together = toxicity.Scorer(model).texts(texts)
    assert len(calls) == 1
    assert together.tolist() == pytest.approx([toxicity.Scorer(model).texts([t])[0] for t in texts], abs=1e-5)

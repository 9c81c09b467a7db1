"""Filter audit, similarity join and whitening against brute force, and on odd rows."""

import itertools
import random

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from veritab.llm import filteraudit, jaccardjoin, skew, whitening
from veritab.llm.queries import QUERIES, SQL
from veritab.session import freeze, scratch_folder

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    (1, "a b c d e f g"), (2, "A  b c\td e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, " \n"), (None, "a b c d e f g"), (None, None),
    (6, "b"), (7, "B"), (8, "word " * 60000), (9, "WORD " * 70000), (10, "x" * 300000), (11, "#one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 6 else "en", 0, "t", 1, 2, "v", "d") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, token string, ka int, node int, v string, digest string")


# ---- filter audit


def plain_audit(rows, labels):
    """All orders applied one document at a time, left to right."""
    import re

    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        fails |= {"D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        facts.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    found = {}
    for part in {p for p, *_ in facts}:
        own = [f for f in facts if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
    for (part, order, step), row in found.items():
        f = order[step - 1]
        row.append(sum(r[1] for (p, o, s), r in found.items() if p == part and o[s - 1] == f))
    return {k: tuple(v) for k, v in found.items()}


def test_audit_equals_all_orders(spark, docs):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, None, 1), (None, 1, 1), (77, 1, 1)]
    found = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == plain_audit([(i, t, None if i == 6 else "en") for i, t in TEXTS], labels)


def test_audit_on_tables(spark):
    assert compare(QUERIES["op11_filter_audit"](spark, FOLDER), connect(FOLDER), SQL["op11_filter_audit"]) is None


def test_potentials_are_whole_and_efficient(spark):
    rows = spark.range(1000).select(F.lit("p").alias("part"), F.pmod(F.hash("id"), F.lit(32)).alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    game = filteraudit.potentials(filteraudit.coalitions(rows)).first()
    for s in range(1, 32):
        below = sum(game.potential[s & ~(1 << i)] for i in range(5) if s >> i & 1)
        assert s.bit_count() * game.potential[s] == 60 * game.v[s] + below
    assert sum(game.potential[31] - game.potential[31 & ~(1 << i)] for i in range(5)) == 60 * game.v[31]


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    assert filteraudit.audit(docs, labels).where("good_lost + toxic_lost > 0").count() == 0


# ---- similarity join


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets, parent = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def joined(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.similarity_components(docs).collect()}


def edited(draw, words, share):
    return [f"new{draw.random()}" if draw.random() < share else w for w in words]


@pytest.mark.parametrize("frequent", [16, 2])
def test_join_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccardjoin, "FREQUENT", frequent)
    monkeypatch.setattr(skew, "LIGHT", 100)
    monkeypatch.setattr(jaccardjoin, "BUCKET", 3000)
    draw, texts = random.Random(12), {}
    for _ in range(30):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([8, 60, 400]))]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.1):
            texts[len(texts)] = " ".join(edited(draw, base, share))
    # crowds: edits of one text, with links between some only; a template with own words; chains of growing texts
    base = [f"b{i}" for i in range(120)]
    for _ in range(90):
        texts[len(texts)] = " ".join(edited(draw, base, draw.choice([0.01, 0.025, 0.03])))
    for k in range(90):
        texts[len(texts)] = " ".join([f"t{i}" for i in range(40)] + [f"own{k}x{i}" for i in range(draw.choice([2, 4, 6, 9]))])
    for k in range(60):
        texts[len(texts)] = " ".join(f"c{i}" for i in range(20 + 3 * k))
    texts |= {9000: "", 9001: " \n", 9002: None, 9003: "Two words", 9004: "two  WORDS", 9005: "a a a a a a", 9006: "a a a a a a a a"}
    expected = plain_components(texts)
    assert len({c for _, c in expected.values()}) < 0.9 * len(expected)
    assert joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == expected


def test_join_on_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op12_ngram_join"](spark, FOLDER).collect()} == plain_components(texts)


def test_join_of_odd_rows(docs):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccardjoin.similarity_components(docs).collect()]
    expected = [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 3, 1), (None, 0, None), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8), (10, 1, 10), (11, 1, 11)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(rows, key=order) == sorted(expected, key=order)
    assert jaccardjoin.similarity_components(docs.limit(0)).count() == 0


def test_prefixes_keep_every_pair(spark):
    """Any two sets that meet the threshold share the smaller need in the prefixes of their roles."""
    draw, rows = random.Random(3), []
    for node in range(60):
        kept = sorted(draw.sample(range(40), draw.randint(30, 40)))
        own = draw.randint(0, 6)
        rows.append((node, len(kept) + own, [(t + 2, t) for t in kept]))
    nodes = spark.createDataFrame(rows, "node long, n long, tokens array<struct<df: long, token: long>>")
    index = {}
    for r in jaccardjoin.prefixes(nodes, (4, 5)).collect():
        index.setdefault(r.node, []).append(r)
    needs = {r.need for rows_ in index.values() for r in rows_}
    assert needs <= {1, 2, 3, 4}
    links = 0
    for (a, n, s), (b, m, t) in itertools.combinations(rows, 2):
        shared = len(set(s) & set(t))
        if 5 * shared < 4 * (n + m - shared):
            continue
        links += 1
        (_, small), (_, large) = sorted([((n, a), a), ((m, b), b)])
        met = {r.token for r in index[small] if r.small} & {r.token for r in index[large]}
        assert len(met) >= min(index[small][0].need, index[large][0].need)
    assert links > 30


def test_salted_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT", 10)
    rows = freeze(spark.range(500).select("id", F.when(F.col("id") % 7 > 0, 1).when(F.col("id") % 2 > 0, F.col("id")).alias("k")))
    table = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c"), (5, "d")], "k long, x string")
    for how in ("inner", "left"):
        got, expected = (sorted(map(str, x.select("id", "k", "x").collect())) for x in (skew.salted_join(rows, table, ["k"], how), rows.join(table, "k", how)))
        assert got == expected


# ---- whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:32], turn[:, ::-1][:, :32]
    return centred @ turn / np.sqrt(values), values / np.trace(centred.T @ centred / n), ((n * x - sums) ** 2).sum(axis=1)


def whitened(table):
    rows = whitening.whiten(table).toPandas()
    return rows, rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()


def up_to_sign(found, expected):
    return np.abs(found * np.sign((found * expected).sum(axis=0)) - expected).max()


def test_whitening_equals_eigenvectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows, found = whitened(table)
    expected, explained, deviations = plain_whitening([r.embedding for r in table.orderBy("vec_id").collect()])
    assert up_to_sign(found, expected) < 1e-9
    first = rows[rows.component == 1].sort_values("vec_id")
    assert (first.deviation.to_numpy() == deviations).all() and set(rows.n) == {len(expected)}
    assert np.allclose(rows.groupby("component").explained.first(), explained, rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9


@pytest.mark.parametrize("spare,degree", [(2, 4), (8, 12)])
def test_filter_finds_close_eigenvalues(spark, spare, degree):
    """A slowly falling spectrum, and more columns than wanted and spare ones together."""
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.normal(size=(90, 90)))[0]
    x = (draw.normal(size=(400, 90)) * np.linspace(3, 1, 90)) @ turn
    table = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = whitening.numbers(table, "vec_id", "embedding")
    n, sums = whitening.moments(rows)
    blocks = whitening.store(rows, scratch_folder(spark, "test"))
    model = whitening.components(blocks, n, sums, wanted=8, spare=spare, degree=degree)
    expected, explained, _ = plain_whitening(x)
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    assert up_to_sign(model.whiten(whole), expected[:, :8]) < 1e-7
    assert np.allclose(model.values / model.trace, explained[:8])


def test_filter_damps_the_unwanted_part():
    values = np.linspace(0, 2, 41)
    found = whitening.damped(lambda q: values[:, None] * q, np.ones((41, 1)), upper=1.0, top=2.0, degree=6)[:, 0]
    assert np.isclose(found[-1], 1) and np.abs(found[values <= 1]).max() < 1e-4 and (np.diff(found[values > 1.05]) > 0).all()


def test_partial_sums_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GROUP", 1)
    rows = spark.range(1000).repartition(9).select(F.col("id"), F.array(F.col("id"), F.col("id") * 2).alias("x"))
    blocks = whitening.store(rows, scratch_folder(spark, "test"))
    found = whitening.summed(blocks, lambda x: x.sum(axis=0, keepdims=True).astype(float), (1, 2))
    assert found.tolist() == [[499500.0, 999000.0]]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [-1.0, 0.25, 4.0]), (4, [3.0, -2.0, 1.0]), (5, [0.0, 0.0, 9.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [inf, 1.0, 1.0]), (11, [1.0, 2.0]), (12, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, n int, component int, x string")
    rows = whitening.whiten(table).toPandas()
    assert len(rows) == 15 and rows.vec_id.isna().sum() == 3 and set(rows.n) == {5} and rows.identity_error[0] < 1e-9
    _, explained, deviations = plain_whitening([v for _, v in good])
    assert sorted(rows[rows.component == 1].deviation) == sorted(deviations)
    assert np.allclose(rows.groupby("component").explained.first(), explained)
    for few in (table.limit(0), table.where("vec_id = 4"), table.where("vec_id = 1"), table.where("vec_id > 5 AND vec_id < 11")):
        assert whitening.whiten(few).count() == 0
    rank = whitening.whiten(table.where("vec_id IN (1, 4)"))
    assert {r.component for r in rank.collect()} == {1}


def test_deviations_beyond_a_long():
    x = np.array([[0, 10**15], [10**15, 0]], np.int64)
    assert whitening._deviations(x, 2, np.array([10**15, 10**15], object)) == [None, None]
    assert whitening._deviations(x // 10**6, 2, np.array([10**9, 10**9], object)) == [2 * 10**18, 2 * 10**18]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_shared_shingles_across_batches(size):
    """Buckets that span batches, rows without a name, and negative buckets."""
    import pyarrow as pa

    draw = random.Random(size)
    rows = sorted(((draw.choice([-3, -1, 0, 0, 1, 4]), draw.choice([None, 0, 1, 2, 5]), draw.sample(range(2**40, 2**40 + 9), draw.randint(1, 3))) for _ in range(60)), key=lambda r: r[0])
    rows = [(b, n, [t * 5 + b % 5 for t in ts]) for b, n, ts in rows if n is not None or b >= 0]
    batches = [
        pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()),
            pa.array([b"".join(t.to_bytes(6, "little") for t in r[2]) for r in part], pa.binary()),
        ], names=["bucket", "name", "tokens"])
        for part in (rows[i : i + size] for i in range(0, len(rows), size))
    ]
    found = {(r["token"], r["name"]) for b in jaccardjoin.keep_shared(iter(batches)) for r in b.to_pylist()}
    met = {}
    for bucket, name, tokens in rows:
        for t in tokens if bucket >= 0 else ():
            met.setdefault((bucket, t), set()).add(name)
    expected = {(t, n) for (_, t), names in met.items() for n in names if n is not None and len(names) > 1}
    assert found == expected | {(t, n) for b, n, tokens in rows if b < 0 for t in tokens}

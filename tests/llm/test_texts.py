"""Operators over texts against brute force, the libraries themselves and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from veritab.llm import bpe, fmindex, pii, rans, simhash, tokencounts
from veritab.llm.queries import QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"
TRICKY = [*"aAbé ÉΣς\t\n\x1c\x85\xa0 '<|>０1 2İ́ß%", "<|endoftext|>", "<|startoftext|>", "'ll", "é", "가", " ", " the", "ing"]


def tricky(n, most=60, seed=1):
    draw = random.Random(seed)
    return ["", " ", "\n\n", *("".join(draw.choices(TRICKY, k=draw.randint(0, most))) for _ in range(n))]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


# ------------------------------------------------------------- encoding


def test_piece_encoder_equals_library(documents):
    data = [*documents.values(), *tricky(3000), "é" * 3000, "x" * 5000]
    library = tokencounts.load_tokenizer(vocabulary("word_bpe_49k.json"))
    found = tokencounts.PieceEncoder(vocabulary("word_bpe_49k.json"), list, lambda parts: [i for p in parts for i in p])
    ids = [[i for piece in pieces for i in piece] for pieces in found.documents([d.encode() for d in data])]
    assert ids == [e.ids for e in library.encode_batch(data, add_special_tokens=False)]


def test_transducer_equals_library(documents):
    draw = random.Random(2)
    long_words = ["".join(draw.choices(alphabet, k=draw.choice([50, 500, 2000]))) for alphabet in ["ab", "aab", "estion", "etaoinshr"] for _ in range(40)]
    long_words += ["".join(draw.choices(["er", "tion", "ing", "th", "e", "s", "al", "in", "on"], k=400)) for _ in range(100)]
    data = [*documents.values(), *tricky(3000), *long_words, "-" * 5000, " " * 3000 + "x"]
    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    for text, expected in zip(data, library.encode_batch(data, add_special_tokens=False), strict=True):
        parts = list(own.encode(text))
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == expected.ids
        assert bpe.decode_parts(own.merges.bytes_of, parts) == library.decode(expected.ids, skip_special_tokens=False)


def test_transducer_keeps_little(monkeypatch):
    own = bpe.Encoder(vocabulary("byte_bpe_50k.json"))
    machine, most = bpe.Transducer(own.merges, own.machine.reach), 0
    for _ in range(300):
        list(machine.feed(b"ationing" * 20))
        most = max(most, len(machine.buffer))
    assert most <= 6 * own.machine.reach


def test_slices_change_nothing(monkeypatch):
    own = bpe.Encoder(vocabulary("byte_bpe_50k.json"))
    text = " ".join(tricky(300))
    whole = b"".join(own.encode(text))
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert b"".join(own.encode(text)) == whole


def test_decoder_holds_split_characters_back():
    own = bpe.Encoder(vocabulary("byte_bpe_50k.json"))
    ids = b"".join(own.encode("añ가😀b"))
    assert bpe.decode_parts(own.merges.bytes_of, [ids[i : i + 4] for i in range(0, len(ids), 4)]) == "añ가😀b"


def test_bpe_query(spark, documents):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for doc_id, row in rows_of(spark, "op4_bpe_transducer").items():
        ids = library.encode(documents[doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_count_query(spark, documents):
    library = tokencounts.load_tokenizer(vocabulary("word_bpe_49k.json"))
    for doc_id, row in rows_of(spark, "op9_token_counts").items():
        n = len(library.encode(documents[doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(documents[doc_id].encode()), n, n > 2048)


# ------------------------------------------------------------- coded files


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000, 65536, 65537, 150000])
def test_coder_round_trip(size):
    draw = np.random.default_rng(size)
    for tokens in (draw.integers(0, 49408, size), np.full(size, 7), draw.zipf(1.3, size) % 49408):
        tokens = tokens.astype("<u4")
        assert (rans.decode(rans.encode(tokens)) == tokens).all()


def test_coder_notices_damage():
    coded = rans.encode(np.arange(5000, dtype="<u4") % 77)
    coded.words[0] = coded.words[0].copy()
    coded.words[0][3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(coded)


def test_crc_join():
    first, second = b"hello" * 100, b"worlds" * 77
    assert rans.crc_join(zlib.crc32(first), zlib.crc32(second), len(second)) == zlib.crc32(first + second)


@pytest.mark.parametrize("segment", [1 << 21, 1000])
def test_file_query(spark, documents, monkeypatch, segment):
    monkeypatch.setattr(rans, "SEGMENT", segment)
    library, start = tokencounts.load_tokenizer(vocabulary("word_bpe_49k.json")), 0
    found = rows_of(spark, "op5_rans_files")
    for doc_id in sorted(documents):
        ids = [*library.encode(documents[doc_id], add_special_tokens=False).ids, 2]
        row = found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# ------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text, pattern=WORD):
    return pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def plain_hits(texts, items, width):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        size = min(width, len(words))
        for a in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[a : a + size]), set()).add(item)
    for text in texts:
        words = plain_words(text)
        hit, found = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                if tuple(words[a : a + size]) in windows:
                    found |= windows[tuple(words[a : a + size])]
                    hit[a : a + size] = [True] * size
        yield len(words), sum(hit), sorted(map(str, found))


class Block:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize(("width", "shard", "blocks"), [(3, 1 << 20, 1), (3, 7, 1), (10, 50, 1), (4, 30, 3)])
def test_index_equals_brute_force(monkeypatch, width, shard, blocks):
    monkeypatch.setattr(fmindex, "SHARD_WORDS", shard)
    draw = random.Random(width * shard)
    texts = [" ".join(draw.choices(["a", "b", "É", "c1", "B"], k=draw.randint(0, 80))) for _ in range(120)]
    texts += texts[:20] + ["", "..."]
    items = [(i, " ".join(draw.choices(["a", "b", "É", "c1", "zz"], k=draw.randint(0, 6)))) for i in range(12)] + [(99, ""), (7, texts[0][:40])]
    encoded = [(i, t.encode()) for i, t in items]
    parts = [Block(fmindex.Windows(encoded[k::blocks], width)) for k in range(blocks)]
    kept = [p.value for p in parts]
    if blocks > 1:  # broadcasts load their value again
        for part, value in zip(parts, kept, strict=True):
            part._value = value
        monkeypatch.setattr(Block, "value", property(lambda self: kept[parts.index(self)]), raising=False)
        for part in parts:
            vars(part).pop("value", None)
    hits = fmindex.scan([t.encode() for t in texts], parts, width)
    assert [(h.words, sum(b - a for a, b in h.spans), sorted(map(str, h.items))) for h in hits] == list(plain_hits(texts, items, width))


def test_decontamination_query(spark, documents):
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found, ids = rows_of(spark, "op3_fm_decontamination"), sorted(documents)
    for doc_id, (n, hit, named) in zip(ids, plain_hits([documents[i] for i in ids], items, 10), strict=True):
        row = found[doc_id]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, hit, len(named), hit > 0)
        assert row.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()


def test_removal_leaves_no_window(spark):
    from pyspark.sql import functions as F

    docs, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    cleaned = fmindex.decontaminate(docs, benchmark)
    assert cleaned.columns == docs.columns
    before = fmindex.find(docs, benchmark).where(F.size("spans") == 0).select("doc_id").join(docs, "doc_id")
    assert cleaned.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old").count() == 0
    assert fmindex.find(cleaned, benchmark).where(F.size("spans") > 0).count() == 0


# ------------------------------------------------------------- near-duplicates


def plain_fingerprint(text):
    words = plain_words(text, re.compile(r"[^\x20\x09-\x0D]+"))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(words):
    """Smallest id reachable, by comparing everything with everything."""
    values = np.array(sorted({w for _, w in words}), dtype=np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2):
            parent[root(i + 1 + int(j))] = root(i)
    group = {int(v): root(i) for i, v in enumerate(values.tolist())}
    smallest = {}
    for doc_id, word in words:
        smallest[group[word]] = min(doc_id, smallest.get(group[word], doc_id))
    return {doc_id: smallest[group[word]] for doc_id, word in words}


def test_simhash_query(spark, documents):
    found = rows_of(spark, "op8_simhash_pivots")
    words = [(i, plain_fingerprint(t)) for i, t in documents.items()]
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{w:016x}" for i, w in words}
    assert {i: r.component_id for i, r in found.items()} == plain_components(words)


@pytest.mark.parametrize("crowd", [64, 4])
def test_links_reach_what_brute_force_reaches(spark, monkeypatch, crowd):
    from pyspark.sql import functions as F

    from veritab.llm.graph import components

    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw, words = random.Random(3), []
    for group in range(12):
        base = draw.getrandbits(64)
        for _ in range(draw.choice([2, 5, 120])):
            word = base
            for _ in range(draw.choice([0, 1, 1, 2, 3, 4])):
                word ^= 1 << draw.randrange(64 if group % 2 else 20)
            words.append((len(words), word))
    words += [(len(words) + k, draw.getrandbits(64)) for k in range(200)]
    table = spark.createDataFrame([(i, simhash.signed(w)) for i, w in words], "id long, word long")
    nodes = table.groupBy("word").agg(F.min("id").alias("id")).select("word", F.struct(F.lit(False).alias("unnamed"), "id", "word").alias("node"))
    roots = components(simhash.links(nodes))
    found = nodes.join(roots, nodes["node"] == roots["v"], "left").select("word", F.coalesce("root.id", "node.id").alias("c"))
    assert {r.id: r.c for r in table.join(found, "word").collect()} == plain_components(words)


# ------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", match[0])
            doubled = sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, digits[::-1])))
            if {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in match[0].split(".")),
                "card": 14 <= len(digits) <= 19 and doubled % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]:
                yield kind, match.start(), match.end()


def test_base_spans_equal_patterns(documents):
    draw = random.Random(4)
    for text in [*documents.values(), *("".join(draw.choices("a.@+1234-5 ().0_é", k=60)) for _ in range(5000))]:
        assert pii.base_spans(text) == list(plain_spans(text))


def test_pii_query(spark, documents):
    for doc_id, row in rows_of(spark, "op10_pii_spans").items():
        base = sorted(plain_spans(documents[doc_id]), key=lambda s: (s[1], list(PATTERNS).index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("user[at]site[dot]org", "email", "user[at]site[dot]org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊｏｈｎ＠example．com", "email", "ｊｏｈｎ＠example．com"),
        ("a​b@c​d.com", "email", "a​b@c​d.com"),
        ("call plus one four nine nine five five five six five zero three ok", "phone", "plus one four nine nine five five five six five zero three"),
        ("+１４９９５５５６５０３", "phone", "+１４９９５５５６５０３"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("one-nine-two dot one-six-eight dot zero dot one", "ip", "one-nine-two dot one-six-eight dot zero dot one"),
        ("4l11 1111 1111 1111 and", "card", "4l11 1111 1111 1111"),
    ],
)
def test_disguises_map_back(text, kind, part):
    start = text.index(part)
    assert (kind, start, start + len(part)) in pii.added_spans(text, pii.base_spans(text))


@pytest.mark.parametrize("text", ["look at the. one of two", "at one point the dot matrix", "meet me at example.com", "plus one more", "deux ou trois"])
def test_plain_prose_has_no_disguise(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


@pytest.mark.parametrize("text", ["1" * 100000, "a" * 100000 + "@", "1 " * 50000, "+1" + " " * 50000, "one " * 20000, "a." * 50000 + " at b", "1o" * 50000])
def test_long_runs_take_linear_time(text):
    pii.masked(text)


def test_words_merged_together():
    """The merges of many words side by side are those of each alone."""
    draw = random.Random(4)
    merges = bpe.Encoder(vocabulary("byte_bpe_50k.json")).merges
    words = [bytes(draw.choice(b"abcdefghi \xc3\xa9\xe4aaathe") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    words += [b"a" * n for n in range(90)] + [b"", b" the", b" the"]
    assert merges.merge_many(words) == [bpe.packed(merges.merge(w)) for w in words]
    assert merges.merge_many([]) == [] and merges.merge_many([b"", b""]) == [b"", b""]


def test_learnt_batches_equal_the_library(monkeypatch):
    """Caches that overflow and pieces of every kind, against the library."""
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    path, draw = vocabulary("byte_bpe_50k.json"), random.Random(5)
    pieces = ["don't", "x", "", "\n", "a\n", "\tb", "\u00e9t\u00e9", "\uac00", "x\u0301", "12", "a1,", "<|endoftext|>", "<|end", "\u3000", "we'll", "..."]
    data = [" ".join(draw.choice(pieces) if draw.random() < 0.5 else "".join(draw.choices("abcdeXY\u00df", k=draw.randint(1, 12))) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    both, found = bpe.Encoder(path), []
    for i in range(0, len(data), 40):
        both.learn(data[i : i + 40])
        found += [np.frombuffer(b"".join(both.encode(t)), "<u4").tolist() for t in data[i : i + 40]]
    library = Tokenizer.from_file(path)
    assert found == [e.ids for e in library.encode_batch(data, add_special_tokens=False)]


def test_every_part_of_a_segment_is_guarded():
    """One flipped bit in words, states, table or size is an error, never wrong ids."""
    import dataclasses

    tokens = (np.random.default_rng(9).pareto(1.2, 150_000) * 3).astype("<u4") % 5000
    coded = rans.encode(tokens)
    assert (rans.decode(coded) == tokens).all()
    flip = lambda a: np.concatenate([a.reshape(-1)[:7], a.reshape(-1)[7:8] ^ 1, a.reshape(-1)[8:]]).reshape(a.shape)
    damaged = [{"words": [flip(coded.words[0]), *coded.words[1:]]}, {"words": [coded.words[0][:-1], np.append(coded.words[0][-1:], coded.words[1]), *coded.words[2:]]}]
    damaged += [{"states": flip(coded.states)}, {"symbols": flip(coded.symbols)}, {"frequencies": flip(coded.frequencies)}, {"size": coded.size - 1}, {"size": 3 * coded.size}]
    for change in damaged:
        with pytest.raises(ValueError):
            rans.decode(dataclasses.replace(coded, **change))


def test_ids_are_counted_without_sorting(monkeypatch):
    """Small ids by an array, large ones by a sort: the same symbols, counts and ranks."""
    small = np.array([7, 3, 3, 48999, 0, 7, 7], "<u4")
    for tokens in (small, small * 80000):
        symbols, ranks, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        found = rans.counted(tokens)
        assert [x.tolist() for x in found] == [symbols.tolist(), counts.tolist(), ranks.tolist()]
        assert (rans.decode(rans.encode(tokens)) == tokens).all()
    monkeypatch.setattr(np, "unique", None)
    assert rans.counted(small)[1].tolist() == [1, 2, 3, 1]


def test_new_words_are_not_encoded_one_by_one(documents, monkeypatch):
    """All ids of a batch come as one array, equal to the library's, with one call for its new words, even if caches overflow."""
    import pyarrow as pa

    path, draw = vocabulary("word_bpe_49k.json"), random.Random(6)
    pieces = ["l'été", "don't", "DON'T", "''s", "x'", "...'s", "Été,", "×÷", "a×b", "12a34", "½", "µß", "<|endoftext|>", "<|End", "<", "|", "é", "Straße.", "\x1c", "a\x00b", "ПриветΣ", "İ", "가나", "z" * 90]
    made = [draw.choice(" \n\t").join(draw.choice(pieces) if draw.random() < 0.4 else "".join(draw.choices("abcXYZé9.<|'Àÿ", k=draw.randint(1, 9))) for _ in range(draw.randint(0, 50))) for _ in range(600)]
    data = [None, "", *documents.values(), *tricky(2000, seed=7), *made, "<", "|x", "a", "b"]
    expected = [e.ids for e in tokencounts.load_tokenizer(path).encode_batch([d or "" for d in data], add_special_tokens=False)]
    for remembered, window in ((tokencounts.REMEMBERED, tokencounts.WINDOW), (500, 3000)):
        monkeypatch.setattr(tokencounts, "REMEMBERED", remembered)
        monkeypatch.setattr(tokencounts, "WINDOW", window)
        found = tokencounts.PieceEncoder(path)
        for texts, known in ((data, expected), (data[5:], expected[5:]), ([None], [[]])):
            sizes, ids = found.ids(pa.array(["skipped", *texts], pa.string())[1:])
            assert sizes.tolist() == [len(i) for i in known] and ids.tolist() == [i for own in known for i in own]
            sizes, ids = found.ids(pa.array(texts, pa.string()), 2)
            assert sizes.tolist() == [len(i) + 1 for i in known] and ids.tolist() == [i for own in known for i in [*own, 2]]
    calls = []
    found = tokencounts.PieceEncoder(path)
    merge = found.merge
    found.merge = lambda parts: calls.append(len(parts)) or merge(parts)
    found.ids(pa.array(["one two, three. Four", "five one Two"], pa.string()))
    assert calls == [7]

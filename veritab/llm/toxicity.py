"""Operator 6: toxicity by a bidirectional gated recurrent network over overlapping windows.

A token's input joins words and characters: how much more often the word, and each of
its character n-grams, surely occurs in toxic than in other training documents (bounds
of log-odds: from below, for the n-grams the largest and the mean, and from above for
words that speak against toxicity), and learned vectors of the word, its first and its
last characters.  Gated recurrent units read a window from both sides,
attention pools their states, and a logistic unit scores the window.  The score of a
document is that of its worst window, over all windows of the whole text.

Training runs in numpy on the driver over a bounded sample: the first `per_class`
labelled documents of each class in hash order, those longer than `longest` bytes left
out of the fit.  Each training document sees bounds without its own occurrences, so
that rare words of its own teach nothing.  A toxic document trains on its most
suspicious windows, as its other windows may be clean; a clean one on its most
suspicious windows and one at random.

Defined results: NULL, empty and wordless texts have one window without tokens and
get the score of the bias; NULL labels and ids are not learned from; a document with
several label rows is toxic if one says so; without labels of both classes every score
is the share of label 1 (0 without labels); repeated rows and ids give one row each;
other columns are ignored by `score` and pass through `keep_clean`.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import kept, map_batches, ready, release, utf8

WINDOW, STRIDE = 64, 32
HIDDEN, ATTENTION, LEARNED = 8, 8, 4
BUCKETS = 1 << 20
VECTORS = 1 << 14
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Remembered words of a worker; only the speed depends on it.
REMEMBERED = 200_000


def tokens(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def _checksum_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _checksum_table()


def _seeded(size: int, seed: int) -> int:
    """What a seed changes in the CRC-32 of any `size` bytes."""
    return zlib.crc32(bytes(size), seed) ^ zlib.crc32(bytes(size))


def ngram_buckets(words: list[bytes], at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 3- to 6-byte parts of all words with their edges marked, one word after the other; where each word's begin, and how many.

    A bucket is the CRC-32 of a part, seeded with the intended size; a word shorter than
    that is a part of its own.  The checksums of all parts from a place on are steps of one.
    """
    found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), at_once):
        some = words[i : i + at_once]
        data = np.frombuffer(b"<" + b"><".join(some) + b">" + bytes(6), np.uint8).astype(np.uint32)
        length = np.fromiter(map(len, some), np.int64, len(some)) + 2
        start = np.cumsum(length) - length
        state, after = np.full(len(data) - 6, 0xFFFFFFFF, np.uint32), {}
        for k in range(6):
            state = _TABLE[(state ^ data[k : len(data) - 6 + k]) & 255] ^ (state >> 8)
            after[k + 1] = ~state
        parts = {n: np.maximum(1, length - n + 1) for n in range(3, 7)}
        sizes = sum(parts.values())
        flat, place = np.empty(sizes.sum(), np.uint32), np.cumsum(sizes) - sizes
        for n, each in parts.items():
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            values = after[n][np.repeat(start, each) + inner] ^ np.uint32(_seeded(n, n))
            for short in range(3, n):
                words_of = np.flatnonzero(length == short)
                values[(np.cumsum(each) - each)[words_of]] = after[short][start[words_of]] ^ np.uint32(_seeded(short, n))
            flat[np.repeat(place, each) + inner] = values
            place = place + each
        found.append((flat & (BUCKETS - 1)).astype(np.int32))
        counts.append(sizes)
    sizes = np.concatenate(counts)
    return np.concatenate(found), np.cumsum(sizes) - sizes, sizes


def vector_buckets(word: bytes) -> tuple[int, int, int]:
    return tuple(zlib.crc32(part, seed) & (VECTORS - 1) for seed, part in enumerate((word, word[:4], word[-4:])))


class Odds:
    """In how many documents of each class a bucket occurs, and what that says."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> None:
        self.toxic, self.clean, self.n_toxic, self.n_clean = toxic, clean, n_toxic, n_clean

    def bounds(self, own: int | None = None) -> np.ndarray:
        """(buckets, 2): log-odds less one deviation, and plus one where that is below zero; half of each.

        `own` is the class of a document that leaves itself out.
        """
        a = self.toxic - (own == 1) * (self.toxic > 0)
        b = self.clean - (own == 0) * (self.clean > 0)
        odds = np.log((a + 0.5) / (self.n_toxic + 1)) - np.log((b + 0.5) / (self.n_clean + 1))
        deviation = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        both = np.stack([np.maximum(odds - deviation, 0), np.minimum(odds + deviation, 0)], axis=1)
        return np.where((a + b > 0)[:, None], both / 2, 0).astype(np.float32)


def character_scores(table: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray], at_once: int = 1 << 16) -> np.ndarray:
    """Largest and mean score of the n-grams of each word."""
    flat, starts, sizes = grams
    found = np.zeros((len(starts), 2), dtype=np.float32)
    for i in range(0, len(starts), at_once):
        own, n = starts[i : i + at_once], sizes[i : i + at_once]
        values = table[flat[own[0] : own[-1] + n[-1]]]
        found[i : i + at_once, 0] = np.maximum.reduceat(values, own - own[0])
        found[i : i + at_once, 1] = np.add.reduceat(values, own - own[0]) / n
    return found


INPUT = 4 + 3 * LEARNED


def new_parameters(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
    p = {"vectors": normal(3, VECTORS, LEARNED, scale=0.05), "attend": normal(2 * HIDDEN, ATTENTION, scale=0.3), "attend_bias": np.zeros(ATTENTION, np.float32)}
    p |= {"query": normal(ATTENTION, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}
    for side in "fb":
        p |= {f"in_{side}": normal(INPUT, 3 * HIDDEN, scale=0.25), f"bias_{side}": np.zeros(3 * HIDDEN, np.float32), f"rec_{side}": normal(HIDDEN, 3 * HIDDEN, scale=0.25)}
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def recur(gates: np.ndarray, rec: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction; `gates` is (steps, windows, 3 * HIDDEN) in reading order."""
    h = np.zeros((gates.shape[1], HIDDEN), dtype=np.float32)
    states = np.empty((*gates.shape[:2], HIDDEN), dtype=np.float32)
    for t, x in enumerate(gates):
        u = h @ rec
        zr = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, u[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states[t] = h
    return states


def pool(p: dict, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of the windows, with what training needs again; `mask` is (steps, windows)."""
    both = np.concatenate([forward, backward], axis=2)
    inner = np.tanh(both @ p["attend"] + p["attend_bias"])
    weight = np.where(mask, inner @ p["query"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    return pooled @ p["out"] + p["out_bias"][0], both, inner, weight, pooled


def recur_back(grad: np.ndarray, kept: list, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of the recurrent weights."""
    gates = np.empty((*grad.shape[:2], 3 * HIDDEN), dtype=np.float32)
    weights = np.zeros_like(rec)
    carry = np.zeros(grad.shape[1:], dtype=np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, u = kept[t]
        d = grad[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        gates[t] = np.concatenate([dz, dr, dn], axis=1)
        du = np.concatenate([dz, dr, dn * r], axis=1)
        weights += h.T @ du
        carry = d * z + du @ rec.T
    return gates, weights


def fit_step(p: dict, scores: np.ndarray, buckets: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean log loss of some windows and its gradients; the arrays are (steps, windows, ...)."""
    x = np.concatenate([scores, *[p["vectors"][k][buckets[..., k]] for k in range(3)]], axis=2)
    x *= mask[..., None]
    stay = np.where(mask, 0, 30).astype(np.float32)[..., None]  # where there is no token the state stays
    kept: dict[str, list] = {"f": [], "b": []}
    states = {}
    for side, order in (("f", slice(None)), ("b", slice(None, None, -1))):
        gates = x @ p[f"in_{side}"] + p[f"bias_{side}"]
        gates[..., :HIDDEN] += stay
        states[side] = recur(gates[order], p[f"rec_{side}"], kept[side])[order]
    logit, both, inner, weight, pooled = pool(p, states["f"], states["b"], mask)
    probability = sigmoid(logit)
    loss = -np.mean(np.where(label == 1, np.log(probability + 1e-7), np.log(1 - probability + 1e-7)))
    d = ((probability - label) / len(label)).astype(np.float32)
    g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
    d_pooled = d[:, None] * p["out"]
    d_both = weight[..., None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", both, d_pooled)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["query"] = np.einsum("tb,tba->a", d_energy, inner)
    d_inner = d_energy[..., None] * p["query"] * (1 - inner * inner)
    g["attend"] = np.einsum("tbh,tba->ha", both, d_inner, optimize=True)
    g["attend_bias"] = d_inner.sum(axis=(0, 1))
    d_both = d_both + d_inner @ p["attend"].T
    d_x = np.zeros_like(x)
    for side, order, half in (("f", slice(None), slice(0, HIDDEN)), ("b", slice(None, None, -1), slice(HIDDEN, None))):
        d_gates, g[f"rec_{side}"] = recur_back(d_both[..., half][order], kept[side], p[f"rec_{side}"])
        d_gates = d_gates[order]
        flat = d_gates.reshape(-1, 3 * HIDDEN)
        g[f"in_{side}"] = x.reshape(-1, INPUT).T @ flat
        g[f"bias_{side}"] = flat.sum(axis=0)
        d_x += d_gates @ p[f"in_{side}"].T
    d_x *= mask[..., None]
    g["vectors"] = np.zeros_like(p["vectors"])
    for k in range(3):
        np.add.at(g["vectors"][k], buckets[..., k].reshape(-1), d_x[..., 4 + k * LEARNED : 4 + (k + 1) * LEARNED].reshape(-1, LEARNED))
    return float(loss), g


class Model:
    """What a worker needs: score tables and network weights."""

    def __init__(self, p: dict, words: np.ndarray, grams: np.ndarray) -> None:
        self.p, self.words, self.grams = p, words, grams
        self.inputs = np.concatenate([p["in_f"], p["in_b"]], axis=1)
        self.bias = np.concatenate([p["bias_f"], p["bias_b"]])

    def __getstate__(self):
        return self.p, self.words, self.grams

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def gates(self, words: list[bytes]) -> np.ndarray:
        """The input of both directions for each word."""
        learned = np.array([vector_buckets(w) for w in words]).reshape(-1, 3)
        x = np.concatenate(
            [self.words[[word_bucket(w) for w in words]], character_scores(self.grams, ngram_buckets(words)), *[self.p["vectors"][k][learned[:, k]] for k in range(3)]],
            axis=1,
        )
        return (x @ self.inputs + self.bias).astype(np.float32)


class Scorer:
    """Scores texts with a memory of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), dtype=np.float32)
        self.table[0] = self.model.bias
        for side in (0, 3 * HIDDEN):  # row 0: no token, the state stays
            self.table[0, side : side + HIDDEN] += 30

    def number(self, words: list[bytes]) -> list[int]:
        found = list(map(self.rows.get, words))
        if None in found:
            fresh = list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None))
            first = len(self.rows) + 1
            if first + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(fresh)), self.table.shape[1]), np.float32)])
            self.table[first : first + len(fresh)] = self.model.gates(fresh)
            self.rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            found = list(map(self.rows.__getitem__, words))
        return found

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """(windows, steps, gates) to probabilities."""
        p, gates = self.model.p, self.table[ids.T]
        forward = recur(gates[..., : 3 * HIDDEN], p["rec_f"])
        backward = recur(gates[::-1, :, 3 * HIDDEN :], p["rec_b"])[::-1]
        return sigmoid(pool(p, forward, backward, ids.T > 0)[0])

    def texts(self, data: list[bytes], at_once: int = 2048, words_at_once: int = 1 << 15) -> np.ndarray:
        """The worst window's probability for each text."""
        if len(self.rows) > REMEMBERED:
            self.reset()
        best = np.zeros(len(data), dtype=np.float64)
        blocks: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            if blocks:
                ids, owner = np.concatenate(blocks), np.concatenate(owners)
                for i in range(0, len(ids), at_once):
                    np.maximum.at(best, owner[i : i + at_once], self.windows(ids[i : i + at_once]).astype(np.float64))
                blocks.clear()
                owners.clear()

        def look_up() -> None:
            """Numbers the words of all waiting texts together; new words are costly one text at a time."""
            nonlocal held
            ids, stop = np.array(self.number([w for _, words in waiting for w in words]), dtype=np.int64), 0
            for number, words in waiting:
                block = cut(ids[stop : stop + len(words)])
                stop += len(words)
                blocks.append(block)
                owners.append(np.full(len(block), number))
                held += len(block)
                if held >= at_once:
                    flush()
                    held = 0
            waiting.clear()

        waiting: list[tuple[int, list[bytes]]] = []
        size = 0
        for number, text in enumerate(data):
            waiting.append((number, tokens(text)))
            size += len(waiting[-1][1])
            if size >= words_at_once:
                look_up()
                size = 0
        look_up()
        flush()
        return best


def cut(ids: np.ndarray) -> np.ndarray:
    """All windows of a sequence, the last one ending with it; a short one is filled with 0."""
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None]
    starts = np.minimum(np.arange(0, len(ids) - WINDOW + STRIDE, STRIDE), len(ids) - WINDOW)
    return ids[starts[:, None] + np.arange(WINDOW)]


def train(sample: list[tuple[bytes, int]], seed: int = 6, steps: int = 160, batch: int = 256, rate: float = 0.02) -> Model:
    """A model from texts and labels of both classes."""
    known: dict[bytes, int] = {}
    own, learned = array("i"), array("i", (0, 0, 0))
    numbered = []
    for text, label in sample:
        words = tokens(text)
        for word in dict.fromkeys(words):
            if word not in known:
                known[word] = len(known) + 1
                own.append(word_bucket(word))
                learned.extend(vector_buckets(word))
        numbered.append((np.fromiter(map(known.__getitem__, words), np.int32, len(words)), label))
    grams = ngram_buckets(list(known))
    known.clear()
    buckets = np.array(learned, dtype=np.int32).reshape(-1, 3)
    own_bucket = np.array(own, dtype=np.int32)
    flat, starts, sizes = grams
    n = Counter(label for _, label in numbered)
    word_counts, gram_counts = ({label: np.zeros(BUCKETS, np.int32) for label in (0, 1)} for _ in range(2))
    for ids, label in numbered:
        seen = np.unique(ids) - 1
        word_counts[label][np.unique(own_bucket[seen])] += 1
        if len(seen):
            shift = np.repeat(starts[seen] - np.concatenate([[0], np.cumsum(sizes[seen])[:-1]]), sizes[seen])
            gram_counts[label][np.unique(flat[shift + np.arange(len(shift))])] += 1
    word_odds, gram_odds = (Odds(c[1], c[0], n[1], n[0]) for c in (word_counts, gram_counts))
    features = {}
    for label in (0, 1):
        characters = character_scores(gram_odds.bounds(label)[:, 0], grams)
        features[label] = np.concatenate([np.zeros((1, 4), np.float32), np.concatenate([word_odds.bounds(label)[own_bucket], characters], axis=1)])
    draw = np.random.default_rng(seed)
    rows, labels = [], []
    for ids, label in numbered:
        blocks = cut(ids)
        suspicion = (features[label][blocks] @ np.array([1, 1, 1, 0])).max(axis=1)
        order = np.argsort(-suspicion, kind="stable")
        chosen = [order[0]] if label else [*order[:2], draw.integers(len(blocks))]
        rows += [blocks[i] for i in dict.fromkeys(chosen)]
        labels += [label] * len(dict.fromkeys(chosen))
    rows, labels = np.array(rows), np.array(labels)
    p = new_parameters(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = np.concatenate([draw.permutation(len(rows)) for _ in range(-(-steps * batch // len(rows)))])
    for step in range(1, steps + 1):
        chosen = order[(step - 1) * batch : step * batch]
        ids = rows[chosen].T
        scores = np.where(labels[chosen][None, :, None] == 1, features[1][ids], features[0][ids])
        _, gradients = fit_step(p, scores, buckets[ids], ids > 0, labels[chosen])
        for k, g in gradients.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= rate * (1 - step / (steps + 1)) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        p["vectors"] *= 0.97  # words seen in few windows fall back to no opinion
    return Model(p, word_odds.bounds(), gram_odds.bounds()[:, 0])


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, longest: int, id_col: str, text_col: str, label_col: str) -> list[tuple[bytes, int]]:
    """Training texts and labels: at most `per_class` of each class, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label_col).alias("label"))
    shuffled = F.xxhash64(F.col(id_col).cast("string"))
    chosen = [known.where(F.col("label") == label).orderBy(shuffled, id_col).limit(per_class) for label in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most twice `per_class` rows
    rows = docs.select(id_col, text_col).where(F.octet_length(text_col) <= longest).join(few, id_col)
    found = rows.orderBy(shuffled, id_col, text_col).limit(4 * per_class).select(text_col, "label").collect()
    return [((text or "").encode("utf-8"), int(label)) for text, label in dict.fromkeys(map(tuple, found))]


def _scorer(model: Broadcast) -> Scorer:
    """One scorer for each worker and model."""
    scorer = kept("toxicity", id(model.value), lambda: Scorer(model.value))
    if scorer.model is not model.value:  # another model at the place of an old one
        release()
        scorer = kept("toxicity", id(model.value), lambda: Scorer(model.value))
    return scorer


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = 2000, longest: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """A model, or the share of label 1 if only one class is labelled; `learn` picks the rows of `labels`."""
    ready(docs.sparkSession)
    rows = sample(docs, labels, F.lit(True) if learn is None else learn, per_class, longest, id_col, text_col, label_col)
    if len({label for _, label in rows}) == 2:
        return train(rows)
    return sum(label for _, label in rows) / max(1, len(rows))


def _score(model: Broadcast, data: list[bytes]) -> np.ndarray:
    return np.full(len(data), model.value) if isinstance(model.value, float) else _scorer(model).texts(data)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        found = _score(shared, utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, score double, predicted int", keeps="toxicity")


def keep_clean(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """The rows with a score under 0.5, with all their columns."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("toxicity")
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_score(shared, utf8(batch.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)

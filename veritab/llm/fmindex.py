"""Operator 3: benchmark decontamination with an FM-index per training shard.

A task forms shards of about `SHARD_WORDS` words from its documents, equal texts once.
A shard's words, as 64-bit hashes numbered within the shard, are sorted by suffix;
the preceding words form the transform, which a wavelet matrix stores with counted
bit ranks.  All windows of the benchmark are searched backwards together, a word a
step; the rows that remain are located by walking back to sampled suffix positions.
The hits of a document are merged into removal spans.

Texts longer than a shard are cut into pieces that overlap by a window less one word.
The benchmark travels in broadcast blocks of at most `BLOCK_BYTES` of text, made one
after another; each shard is indexed once and searched for every block, so a benchmark
of any size is searched whole.  Words are equal if their 64-bit hashes are.

Defined results: NULL, empty and wordless texts have no words and no hits; NULL,
empty and wordless items have no windows and an item with a NULL id is not named;
repeated rows and ids give one row each; other columns are ignored by `find` and pass
through `decontaminate`; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import map_batches, ready, release, utf8, words_of

SHARD_WORDS = 1 << 20
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 2 << 20
#: Every this many positions, the row of a suffix remembers where it is.
SAMPLE = 16

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept by the worker."""
    if not _powers or len(_powers[0]) < size:
        tables = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of a text, ASCII letters in lower case."""
    low = np.frombuffer(data.lower(), dtype=np.uint8)
    starts, ends = words_of(low, WORD_BYTES)
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, side="right")))
        part = low[begin : ends[last - 1]]
        powers, inverse = _power_tables(max(len(part), SLICE_BYTES) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[part] * powers[: len(part)], out=sums[1:])
        a, b = starts[first:last] - begin, ends[first:last] - begin
        hashes[first:last] = (sums[b] - sums[a]) * inverse[a]
        first = last
    return hashes, starts, ends


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; prefix doubling over the groups not yet told apart."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    cells = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    items, key, step = order, text[order].astype(np.int64), 1
    while True:
        fresh = np.empty(len(items), dtype=bool)
        fresh[:1] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        rank[items] = np.maximum.accumulate(np.where(fresh, cells, 0))
        alone = fresh & np.append(fresh[1:], True)
        cells = cells[~alone]
        if not len(cells):
            return order
        items = order[cells]
        after = items + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[items] * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        items, key = items[sort], key[sort]
        order[cells] = items
        step *= 2


class BitRanks:
    """Bits in words of 64 with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks and symbols of a sequence over 0 .. size - 1."""

    def __init__(self, sequence: np.ndarray, size: int) -> None:
        self.levels: list[BitRanks] = []
        self.depth = max(1, int(size - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bits = (sequence >> level) & 1
            self.levels.append(BitRanks(bits))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.first = np.searchsorted(self._reversed(sequence), self._reversed(np.arange(size)))

    def _reversed(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols with their bits in reverse, the order of the last level."""
        found = np.zeros_like(symbols)
        for level in range(self.depth):
            found |= ((symbols >> level) & 1) << (self.depth - 1 - level)
        return found

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the sequence."""
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, bits.zeros + ones, i - ones)
        return i - self.first[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros_like(i)
        for bits in self.levels:
            ones, bit = bits.ones(i), bits.bit(i)
            i = np.where(bit, bits.zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol, i - self.first[symbol]


class FMIndex:
    """Index of one shard: pieces of hashed words, each followed by an end mark."""

    def __init__(self, pieces: list[np.ndarray]) -> None:
        words = np.concatenate(pieces)
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        sizes = np.array([len(p) for p in pieces])
        #: Start of each piece in the shard's text, where 1 ends a piece and 0 the text.
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.ones(self.offsets[-1] + 1, dtype=np.int64)
        text[-1] = 0
        inside = np.ones(len(text), dtype=bool)
        inside[self.offsets[1:] - 1] = False
        inside[-1] = False
        text[inside] = numbers + 2
        order = suffix_array(text)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 2))])
        self.matrix = WaveletMatrix(text[order - 1], len(self.vocabulary) + 2)
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = BitRanks(sampled), order[sampled]

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, with the first and end row of their suffixes; `windows` is right-aligned."""
        at = np.minimum(np.searchsorted(self.vocabulary, windows), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == windows, at + 2, 0)
        width = windows.shape[1]
        needed = np.arange(width) >= width - sizes[:, None]
        live = np.flatnonzero(~((number == 0) & needed).any(axis=1))
        symbol = number[live, width - 1]
        low, high = self.starts[symbol], self.starts[symbol + 1]
        found = []
        for back in range(1, width + 1):
            done = sizes[live] == back
            if done.any():
                found.append((live[done], low[done], high[done]))
                live, low, high = live[~done], low[~done], high[~done]
            if not len(live):
                break
            symbol = number[live, width - 1 - back]
            low, high = (self.starts[symbol] + self.matrix.rank(symbol, x) for x in (low, high))
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return tuple(np.concatenate(x) if found else np.empty(0, dtype=np.int64) for x in (zip(*found) if found else ((), (), ())))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        position = np.empty(len(rows), dtype=np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            here = self.sampled.bit(rows)
            position[left[here]] = self.samples[self.sampled.ones(rows[here])] + steps
            left, rows = left[~here], rows[~here]
            symbol, rank = self.matrix.symbol_and_rank(rows)
            rows = self.starts[symbol] + rank
            steps += 1
        return position


class Windows:
    """Distinct windows of some items, right-aligned, and the items of each."""

    def __init__(self, items: list[tuple[object, bytes]], width: int) -> None:
        known: dict[bytes, int] = {}
        self.items: list[list] = []
        rows, sizes = [], []
        for item, text in items:
            hashes = word_hashes(text)[0]
            size = min(width, len(hashes))
            for start in range(len(hashes) - size + 1) if size else ():
                window = hashes[start : start + size]
                at = known.setdefault(window.tobytes(), len(known))
                if at == len(rows):
                    rows.append(np.concatenate([np.zeros(width - size, dtype=np.uint64), window]))
                    sizes.append(size)
                    self.items.append([])
                if item is not None and item not in self.items[at][-1:]:
                    self.items[at].append(item)
        self.hashes = np.array(rows, dtype=np.uint64).reshape(-1, width)
        self.sizes = np.array(sizes, dtype=np.int64)


class Hits:
    """What was found in one text."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.spans: list[tuple[int, int]] = []  # in words, merged
        self.bytes: list[tuple[int, int]] = []
        self.items: set = set()


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    merged: list[list[int]] = []
    for start, end in spans[np.lexsort(spans.T[::-1])].tolist():
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def scan(data: list[bytes], blocks: list[Broadcast], width: int) -> list[Hits]:
    """Hits of each text; equal texts share one object."""
    places: dict[bytes, int] = {}
    for text in data:
        places.setdefault(text, len(places))
    parsed = [word_hashes(text) for text in places]
    hits = [Hits(len(hashes)) for hashes, _, _ in parsed]
    found: dict[int, list[np.ndarray]] = {}
    shard: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        index = FMIndex([piece for _, _, piece in shard])
        document = np.array([d for d, _, _ in shard])
        base = np.array([o for _, o, _ in shard])
        for block in blocks:
            windows: Windows = block.value
            if len(windows.sizes):
                window, low, high = index.search(windows.hashes, windows.sizes)
                count = high - low
                if len(window):
                    which = np.repeat(window, count)
                    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    position = index.locate(rows)
                    piece = np.searchsorted(index.offsets, position, side="right") - 1
                    start = base[piece] + position - index.offsets[piece]
                    docs = document[piece]
                    sort = np.argsort(docs, kind="stable")
                    cuts = np.flatnonzero(np.diff(docs[sort])) + 1
                    for part in np.split(sort, cuts):
                        doc = int(docs[part[0]])
                        found.setdefault(doc, []).append(np.stack([start[part], start[part] + windows.sizes[which[part]]], axis=1))
                        for w in np.unique(which[part]).tolist():
                            hits[doc].items.update(windows.items[w])
            if len(blocks) > 1:
                vars(block).pop("_value", None)  # the next block takes its place in memory
        shard.clear()

    for doc, (hashes, _, _) in enumerate(parsed):
        for offset in range(0, max(1, len(hashes) - width + 1) if len(hashes) else 0, SHARD_WORDS):
            piece = hashes[offset : offset + SHARD_WORDS + width - 1]
            if held and held + len(piece) > SHARD_WORDS:
                flush()
                held = 0
            shard.append((doc, offset, piece))
            held += len(piece)
    if shard:
        flush()
    for doc, spans in found.items():
        _, starts, ends = parsed[doc]
        hits[doc].spans = _merged(np.concatenate(spans))
        hits[doc].bytes = [(int(starts[a]), int(ends[b - 1])) for a, b in hits[doc].spans]
    return [hits[places[text]] for text in data]


def window_blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> list[Broadcast]:
    """The benchmark's windows in broadcasts of bounded size, made one at a time."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = size // BLOCK_BYTES + 1
    blocks = []
    for number in range(count):
        rows = benchmark.select(item_col, text_col).where(F.pmod(F.xxhash64(item_col, text_col), F.lit(count)) == number)
        blocks.append(spark.sparkContext.broadcast(Windows([(r[0], (r[1] or "").encode("utf-8")) for r in rows.toLocalIterator()], width)))
    return blocks


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, items): merged hit spans in words, and the items with an occurring window, by name."""
    ready(docs.sparkSession)
    blocks = window_blocks(benchmark, width, item_col, item_text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch):
        hits = scan(utf8(batch.column(1)), blocks, width)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([h.words for h in hits], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in h.spans] for h in hits], span),
                pa.array([sorted(map(str, h.items)) for h in hits], pa.list_(pa.string())),
            ],
            names=[id_col, "n_words", "spans", "items"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    return map_batches(docs.select(id_col, text_col), work, schema)


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text less some byte spans; a blank keeps the words on both sides apart."""
    pieces, last = [], 0
    for start, end in spans:
        pieces.append(data[last:start])
        last = end
    return b" ".join([p.strip() for p in [*pieces, data[last:]] if p.strip()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The same rows and columns with the removal spans cut out of the texts; clean texts stay as they are."""
    ready(docs.sparkSession)
    blocks = window_blocks(benchmark, width, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data = utf8(batch.column(at))
            kept = batch.column(at).to_pylist()
            for i, hit in enumerate(scan(data, blocks, width)):
                if hit.bytes:
                    kept[i] = without(data[i], hit.bytes).decode("utf-8")
            columns = list(batch.columns)
            columns[at] = pa.array(kept, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

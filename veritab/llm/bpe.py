"""Operator 4: byte-pair encoding and decoding as bounded-lookahead transducers.

Encoding.  Whether a merge happens across a position depends on what stands to the
left, and on the right only as far as merges of ever smaller rank can reach: a rule
`(x, y)` at a position needs `y`, and may lose a token on the right edge of `y` to a
rule of smaller rank, which again needs its own right part, and so on.  `lookahead`
computes the longest such reach from the merge list.  `Transducer` keeps a buffer of
a few reaches, emits every token whose end lies at least one reach before the end of
the buffer, and so encodes a word of any length in constant memory.

Decoding joins the bytes of each id and feeds them to an incremental UTF-8 machine,
which holds back at most three bytes and replaces what is malformed.

Texts are cut at safe boundaries first: a character that is no white space followed
by white space always ends a word of the vocabulary's pattern.  The new pieces between
single blanks of a batch run through the transducer together, a merge of each at a time,
and are remembered by the worker; a word that fits the buffer is stable when it ends.  Special strings inside a text give their id.

Defined results: NULL and empty text have no ids and decode to the empty text;
repeated rows and ids give one row each; a NULL id is kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import codecs
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veritab.llm.common import kept, map_batches, texts

#: Unicode white space, as the word pattern means it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Words of the byte-level vocabulary (fixed value of its pre-tokenizer).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""".replace(r"[^\s", f"[^{SPACE}").replace(
    r"\s", f"[{SPACE}]"
).replace(r"\S", f"[^{SPACE}]")
#: Remembered pieces of a worker; only the speed depends on it.
REMEMBERED = 400_000
SHORT = 64
#: Characters handled at a time; a text is cut at the first safe boundary after them.
SLICE = 1 << 18


#: Larger than any rank.
NO_RULE = np.iinfo(np.int64).max
_SLOT_BITS = 18


def _slot(keys: np.ndarray, table: int) -> np.ndarray:
    """Place of a pair of ids in a hash table."""
    mixed = keys.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[table % 2] + 2 * table)
    return (mixed >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Merges:
    """Ids, bytes and merge rules of a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = as_bytes(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode("utf-8")
        self.id_of_byte = [0] * 256
        for letter, b in letters.items():
            self.id_of_byte[b] = vocab[letter]
        #: (left id, right id) -> (rank, id of both)
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            self.rules.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))

        self.byte_ids = np.array(self.id_of_byte, np.int64)
        self.tables, self.made = self.pair_table()

    def lookahead(self) -> int:
        """Bytes right of a position that decide whether a merge crosses it.

        Rules are taken by rank, so every rule that can interfere is known before.
        The merge list must be proper: a rule only joins tokens of smaller rank.
        """
        made_by: dict[int, tuple[int, int, int]] = {}
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}  # running maximum over the rules that begin with a token
        most = 0
        for (left, right), (rank, both) in sorted(self.rules.items(), key=lambda rule: rule[1][0]):
            for part in (left, right):
                if len(self.bytes_of[part]) > 1 and part not in made_by:
                    raise ValueError("a merge rule uses a token that no earlier rule makes")
            need, edge, limit = 0, right, rank
            while True:
                known = ranks.get(edge, [])
                at = bisect.bisect_left(known, limit)
                if at:
                    need = max(need, reach[edge][at - 1])
                if edge not in made_by:
                    break
                limit, _, edge = made_by[edge]
            need += len(self.bytes_of[right])
            ranks.setdefault(left, []).append(rank)
            best = reach.setdefault(left, [])
            best.append(max(need, best[-1] if best else 0))
            made_by.setdefault(both, (rank, left, right))
            most = max(most, need)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of one buffer: always the pair of smallest rank, the leftmost of equals."""
        ids = list(map(self.id_of_byte.__getitem__, data))
        if len(ids) > 40:
            return self._merge_long(ids)
        get = self.rules.get
        rules = list(map(get, zip(ids, ids[1:])))
        while best := min(filter(None, rules), default=None):  # ranks differ, so the least rule is the first in rank
            at = rules.index(best)
            ids[at : at + 2] = best[1:]
            rules[at : at + 2] = [get((best[1], ids[at + 1]))] if at + 1 < len(ids) else ()
            if at:
                rules[at - 1] = get((ids[at - 1], best[1]))
        return ids

    def pair_table(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Rules as hash tables of pairs, tried one after the other, and the id that each rank makes."""
        ranked = sorted((rank, left << 32 | right, both) for (left, right), (rank, both) in self.rules.items())
        made = np.zeros(ranked[-1][0] + 1 if ranked else 1, np.int64)
        made[[r for r, _, _ in ranked]] = [b for _, _, b in ranked]
        keys, ranks = np.array([k for _, k, _ in ranked], np.int64), np.array([r for r, _, _ in ranked], np.int64)
        tables = []
        while len(keys):
            at = _slot(keys, len(tables))
            _, first = np.unique(at, return_index=True)
            table_keys, table_ranks = np.full(1 << _SLOT_BITS, -1), np.full(1 << _SLOT_BITS, NO_RULE)
            table_keys[at[first]], table_ranks[at[first]] = keys[first], ranks[first]
            tables.append((table_keys, table_ranks))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks = keys[left], ranks[left]
        return tables, made

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the rule of each pair, `NO_RULE` where there is none."""
        key = left << np.int64(32) | right
        found = np.full(len(key), NO_RULE)
        for i, (keys, ranks) in enumerate(self.tables):
            at = _slot(key, i)
            np.copyto(found, ranks[at], where=keys[at] == key)
        return found

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """`merge` of every word, as packed ids: all words take their next merge together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        name = np.repeat(np.arange(len(words)), sizes)
        rank = np.append(self.ranks_of(ids[:-1], ids[1:]), NO_RULE) if len(ids) else np.zeros(0, np.int64)
        rank[np.cumsum(sizes)[sizes > 0] - 1] = NO_RULE  # the last byte of a word has no pair
        done_ids, done_names = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            lengths = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == NO_RULE, lengths)
            done_ids.append(ids[over])
            done_names.append(name[over])
            least = np.repeat(least, lengths)[~over]
            ids, name, rank = ids[~over], name[~over], rank[~over]
            hits = np.flatnonzero(rank == least)
            hits = hits[np.concatenate([[True], name[hits[1:]] != name[hits[:-1]]])] if len(hits) else hits  # the leftmost of equals
            ids[hits] = self.made[rank[hits]]
            rank[hits] = rank[hits + 1]  # a pair now starts where the right part's pair did
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            place = (np.cumsum(keep) - 1)[hits]
            ids, name, rank = ids[keep], name[keep], rank[keep]
            inner = place[(place + 1 < len(ids))]
            inner = inner[name[inner] == name[np.minimum(inner + 1, len(ids) - 1)]]
            rank[inner] = self.ranks_of(ids[inner], ids[inner + 1])
            before = place[place > 0] - 1
            before = before[name[before] == name[before + 1]]
            rank[before] = self.ranks_of(ids[before], ids[before + 1])
        if not done_ids:
            return [b""] * len(words)
        names, packed = np.concatenate(done_names), np.concatenate(done_ids).astype("<u4")
        order = np.argsort(names, kind="stable")
        data, ends = packed[order].tobytes(), (4 * np.cumsum(np.bincount(names, minlength=len(words)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.rules.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rule[0], i, ids[i], ids[i + 1], rule[1]) for i in range(n - 1) if (rule := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, both = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = both, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if rule := get((both, ids[k])):
                    heapq.heappush(heap, (rule[0], i, both, ids[k], rule[1]))
            if (h := before[i]) >= 0 and (rule := get((ids[h], both))):
                heapq.heappush(heap, (rule[0], h, ids[h], both, rule[1]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Encodes one word fed in parts; holds at most `4 * reach` bytes and one part."""

    def __init__(self, merges: Merges, reach: int) -> None:
        self.merges, self.reach, self.room = merges, reach, 4 * reach
        self.buffer = b""

    def run(self, data: bytes) -> list[int]:
        """Ids of one whole word; one that fits the buffer is stable as soon as it ends."""
        if len(data) <= self.room:
            return self.merges.merge(data)
        return [*self.feed(data), *self.finish()]

    def run_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words; those that fit the buffer go step by step together."""
        short = [w for w in words if len(w) <= self.room]
        found = iter(self.merges.merge_many(short))
        return [next(found) if len(w) <= self.room else packed(self.run(w)) for w in words]

    def feed(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.room):
            self.buffer += data[start : start + self.room]
            if len(self.buffer) > self.room:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        end = 0
        for token in self.merges.merge(self.buffer):
            size = len(self.merges.bytes_of[token])
            if end + size + self.reach > len(self.buffer):
                break
            end += size
            yield token
        self.buffer = self.buffer[end:]

    def finish(self) -> Iterator[int]:
        yield from self.merges.merge(self.buffer)
        self.buffer = b""


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.machine = Transducer(self.merges, self.merges.lookahead())
        self.words = regex.compile(WORDS)
        self.units = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.ends_in_space = regex.compile(f"[{SPACE}]\\Z")
        self.cut = regex.compile(f"(?<=[^{SPACE}])[{SPACE}]")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")") if self.merges.special else None
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            found = packed(self.machine.run(word.encode("utf-8")))
            if len(word) <= SHORT:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[word] = found
        return found

    def unit(self, unit: str) -> bytes:
        """Ids of a stretch that begins and ends at safe boundaries."""
        if self.specials is None or "<|" not in unit:
            return b"".join(map(self.word, self.words.findall(unit)))
        special = self.merges.special
        return b"".join(
            special[part].to_bytes(4, "little") if part in special else b"".join(map(self.word, self.words.findall(part)))
            for part in self.specials.split(unit)
        )

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE:
            at = self.cut.search(text, start + SLICE)
            if at is None:
                break
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def learn(self, batch: list[str]) -> None:
        """Run the new words between blanks of some texts through the transducer together."""
        for cache in (self.known, self.parts):
            if len(cache) > REMEMBERED // 2:
                cache.clear()
        pieces = set().union(*(text.split(" ") for text in batch)).difference(self.known)
        # letters of the older scripts are one word of the pattern with the blank before them
        plain = [p for p in pieces if len(p) <= SHORT and p.isalpha() and (p.isascii() or max(p) < "\u0250")]
        self.known.update(zip(plain, self.machine.run_many([b" " + p.encode("utf-8") for p in plain]), strict=True))
        # the others are cut by the pattern; those that hold special strings or end in white space are left to `encode`
        cuts = {
            p: self.words.findall(" " + p) for p in pieces.difference(plain) if p and len(p) <= SHORT and "<|" not in p and not self.ends_in_space.search(p)
        }
        words = list(set().union(*cuts.values()).difference(self.parts))
        self.parts.update(zip(words, self.machine.run_many([w.encode("utf-8") for w in words]), strict=True))
        self.known.update((p, b"".join(map(self.word, found))) for p, found in cuts.items())

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the slices of a text."""
        for part in self.slices(text):
            first, *pieces = part.split(" ")
            found = list(map(self.known.get, pieces))
            safe = not pieces or (not self.ends_in_space.search(first) and (first or pieces[0]))
            if safe and None in found:
                for i, piece in enumerate(pieces):
                    if found[i] is None:
                        if not piece or self.ends_in_space.search(piece):
                            safe = False
                            break
                        found[i] = self.remember(piece)
            if safe:
                yield self.unit(first) + b"".join(found)
            else:
                yield b"".join(map(self.unit, self.units.findall(part)))

    def remember(self, piece: str) -> bytes:
        ids = self.unit(" " + piece)
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids


class Decoder:
    """Ids to text, part by part; at most three bytes wait for the next part."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, numbers)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return kept("bpe", path, lambda: Encoder(path))


def decode_parts(bytes_of: list[bytes], parts: Iterable[bytes]) -> str:
    machine = Decoder(bytes_of)
    return "".join([*map(machine.feed, parts), machine.finish()])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, four little-endian bytes each."""

    def work(batch: pa.RecordBatch):
        both, data = encoder(path), texts(batch.column(1))
        both.learn(data)
        ids = [b"".join(both.encode(text)) for text in data]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, ids binary", keeps="bpe")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every sequence of ids; NULL ids are the empty text."""

    def work(batch: pa.RecordBatch):
        bytes_of = encoder(path).merges.bytes_of
        step = 1 << 18
        found = [decode_parts(bytes_of, (ids[i : i + step] for i in range(0, len(ids), step))) for ids in (x or b"" for x in batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_batches(tokens.select(id_col, ids_col), work, f"`{id_col}` {kind}, text string", keeps="bpe")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): both transducers in one pass over the rows."""

    def work(batch: pa.RecordBatch):
        both, data = encoder(path), texts(batch.column(1))
        both.learn(data)
        encoded = [list(both.encode(text)) for text in data]
        decoded = [decode_parts(both.merges.bytes_of, parts) for parts in encoded]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([b"".join(parts) for parts in encoded], pa.binary()), pa.array(decoded, pa.string())],
            names=[id_col, "ids", "decoded"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, ids binary, decoded string", keeps="bpe")

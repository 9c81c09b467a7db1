"""Operator 9: token counts by batch encoding inside Arrow functions.

Only lengths leave the Python workers.  Texts are cut at ASCII white space, which the
vocabulary's own rules drop and never join across (Unicode composition, lower-casing
and the word pattern all stop there, and no special token holds a space), so the ids of
a text are the ids of its pieces.  Bytes are cut and looked up as arrays: the texts of an
Arrow batch become units, the units a dictionary, and a dictionary's new entries are
encoded together; short ones are remembered.

Defined results: NULL and empty text have 0 bytes and 0 tokens; repeated rows and ids
give one row each; a NULL id is kept; other columns are ignored; an empty table gives
an empty result.  A text without white space is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from veritab.llm.common import by_bytes, kept, map_batches

#: Remembered pieces of a worker; only the speed depends on it.
REMEMBERED = 600_000
#: Longer pieces are encoded each time instead of being remembered.
SHORT = 64
#: Bytes cut at a time; a text of more is cut at a blank.
WINDOW = 1 << 22
#: Latin-1 without controls and white space: composition leaves these characters alone and lower-casing maps one to one.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff]+")
#: Units that are a part of a word: what no piece with an apostrophe, a special string or other characters matches.
PART = regex.compile(rb"(?!.*<\|)(?:[\x21-\x26\x28-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Kinds of bytes for the cut; bytes above ASCII count as letters, which only those behind 0xC3 need.
BLANK, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[[*b" \t\n\v\f\r"]] = BLANK
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = LETTER
KIND[[*b"0123456789"]] = DIGIT
#: Bytes that leave their piece in one unit.
WHOLE = (KIND != BLANK) & ((np.arange(256) < 0x21) | (np.arange(256) > 0x7E) | (np.arange(256) == ord("'")))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def load_tokenizer(path: str):
    """The library's tokenizer without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Store:
    """Ids of remembered names in two arrays; only the ids' places are Python objects."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[str | bytes, int] = {}
        self.sizes, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

    def places(self, names: list, learn: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each name, valid until the next call; `learn` gives the sizes and the ids of new names."""
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(at < 0)
        if not len(fresh):
            return at
        asked = [names[i] for i in fresh]
        new = list(dict.fromkeys(asked))
        if len(self.sizes) + len(new) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.clear()
            at, fresh, asked, new = np.empty_like(at), slice(None), names, list(dict.fromkeys(names))
        sizes, ids = learn(new)
        self.place.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        at[fresh] = np.fromiter(map(self.place.__getitem__, asked), np.int64, len(asked))
        for name in new:
            if len(name) > SHORT:
                del self.place[name]
        return at

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each place has, and the ids of all of them."""
        return gathered(self.sizes, self.ids, at)


def gathered(sizes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `ids`, which lie there by their `sizes`, one after another in the order `at`."""
    n = sizes[at]
    shift = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n)
    source = np.repeat(shift, n)
    source += np.arange(len(source))
    return n, ids[source]


def windows(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about `WINDOW` bytes that end before a blank."""
    begin = 0
    while begin < len(data):
        end = begin + WINDOW
        while end < len(data):
            blank = np.flatnonzero(KIND[data[end : end + WINDOW]] == BLANK)
            if len(blank):
                end += int(blank[0])
                break
            end += WINDOW
        yield begin, min(end, len(data))
        begin = end


def cut(data: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of texts that lie one after another, and how many units each has; `stops` has the bounds of the texts.

    A piece of white-space separated text whose characters are all ASCII or Latin letters of
    two bytes gives its parts, lower-cased: runs of letters, single digits, runs of others.
    Pieces with an apostrophe, a special string or any other character are one unit, unchanged.
    """
    kind = KIND[data]
    inside = kind != BLANK
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = stops[stops < len(data)]
    begins[first] = inside[first]
    starts = begins.copy()
    starts[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    whole = WHOLE[data]
    whole[lead] = whole[lead + 1] = False
    special = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    special[first[first > 0] - 1] = False  # of two texts
    whole[:-1] |= special
    lower = LOWER[data]
    after = data[lead + 1]
    lower[lead + 1] = np.where(after <= 0x9E, after + 0x20, after)
    if whole.any():
        pieces = np.append(np.flatnonzero(begins), len(data))
        found = np.unique(np.searchsorted(pieces, np.flatnonzero(whole), side="right") - 1)
        edges = np.zeros(len(data) + 1, dtype=np.int8)
        edges[pieces[found]] += 1
        edges[pieces[found + 1]] -= 1
        unchanged = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
        starts &= begins | ~unchanged
        np.copyto(lower, data, where=unchanged)
    at = np.flatnonzero(starts)
    bounds = np.append(np.cumsum(inside)[at] - 1, np.count_nonzero(inside))
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(lower[inside])])
    return units, np.diff(np.searchsorted(at, stops))


class PieceEncoder:
    """Texts to ids, by the units that `cut` makes of them.

    Units met before are looked up.  Of the new ones, parts of words go through the
    library's model in one call for a batch; a unit that is a whole piece is first cut by the
    vocabulary's word pattern, if it is short Latin-1, or else goes through the whole tokenizer.

    `documents` gives what `keep` makes of the ids of each text; there is nothing to join.
    """

    def __init__(self, path: str, keep=list, join=None, batch_bytes: int = 1 << 20) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(f"{pattern}|\n")  # no word holds white space, so a line end stays apart
        self.model = self.tokenizer.model
        self.words = Tokenizer(self.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # the ids that end a word
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.keep, self.batch_bytes = keep, batch_bytes
        self.units, self.parts = Store(), Store()

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new parts; a line end has none."""
        other = [p for p in parts if not p.isascii()]
        letters = "\n".join(other).encode("utf-8").decode("latin-1").translate(BYTE_LETTERS | {10: 10}).split("\n")
        spelled = dict(zip(other, letters))
        words = [spelled.get(p, p) for p in parts if p != "\n"]
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        sizes = np.diff(ends, prepend=0)
        if len(ends) != len(words) or sizes.sum() != len(ids):  # a vocabulary that does not mark the ends of words
            each = [[token.id for token in self.model.tokenize(word)] for word in words]
            sizes, ids = np.array([*map(len, each)], dtype=np.int64), np.array([i for found in each for i in found], dtype="<u4")
        return np.insert(sizes, parts.index("\n"), 0) if "\n" in parts else sizes, ids

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new units."""
        texts = b"\n".join(units).decode("utf-8").split("\n")
        way = np.array([0 if u.isalpha() or PART.fullmatch(u) else 1 if len(u) <= SHORT and PLAIN.fullmatch(t) and "<|" not in t else 2 for u, t in zip(units, texts)])
        sizes, ids = self.merge([texts[i] for i in np.flatnonzero(way == 0)])
        if not way.any():
            return sizes, ids
        sizes, ids = [sizes], [ids]
        if latin := [texts[i] for i in np.flatnonzero(way == 1)]:
            at = self.parts.places(self.pattern.findall("".join(f"{t}\n" for t in latin).lower()), self.merge)
            n, found = self.parts.gather(at)
            sizes.append(np.diff(np.cumsum(n)[at == self.parts.place["\n"]], prepend=0))
            ids.append(found)
        for group in by_bytes([units[i] for i in np.flatnonzero(way == 2)], self.batch_bytes):
            for found in self.tokenizer.encode_batch_fast([u.decode("utf-8") for u in group], add_special_tokens=False):
                sizes.append(np.array([len(found.ids)]))
                ids.append(np.array(found.ids, dtype="<u4"))
        place = np.empty(len(units), dtype=np.int64)
        place[np.argsort(way, kind="stable")] = np.arange(len(units))
        return gathered(np.concatenate(sizes), np.concatenate(ids), place)

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all of them; `end` is put behind each text."""
        column = texts.fill_null("").cast(pa.large_binary())
        stops = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[stops[0] : stops[-1]]
        stops = stops - stops[0]
        sizes, found = np.zeros(len(column), dtype=np.int64), [np.zeros(0, dtype="<u4")]
        for a, b in windows(data):
            units, counts = cut(data[a:b], np.clip(stops, a, b) - a)
            units = units.dictionary_encode()
            at = self.units.places(units.dictionary.to_numpy(zero_copy_only=False).tolist(), self.learn)
            n, ids = self.units.gather(at[units.indices.to_numpy()])
            sizes += np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)], prepend=0)
            found.append(ids)
        ids = np.concatenate(found)
        return (sizes, ids) if end is None else (sizes + 1, np.insert(ids, np.cumsum(sizes), end))

    def documents(self, data: list[bytes]) -> Iterator[list]:
        """For each text, a list of what is kept of its ids."""
        for group in by_bytes(data, self.batch_bytes):
            sizes, ids = self.ids(pa.array(group, pa.binary()).cast(pa.string()))
            stops = np.cumsum(sizes).tolist()
            yield from ([self.keep(ids[a:b].tolist())] for a, b in zip([0, *stops], stops))


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return kept("pieces", path, lambda: PieceEncoder(path))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; `path` is a JSON vocabulary of the tokenizers library."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"

    def work(batch: pa.RecordBatch):
        counts, _ = encoder(path).ids(batch.column(1))
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), size, pa.array(counts, pa.int64()), pa.array(counts > limit)],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(docs.select(id_col, text_col), work, schema, keeps="pieces")

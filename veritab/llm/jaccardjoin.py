"""Operator 12: similarity join of shingle sets by adaptive multi-match prefixes.

Texts with the same words are one node.  The shingles of all nodes meet in one
shuffle; those of a single node can be in no intersection, so only the others travel on
(packed by buckets; a shingle that is frequent inside a batch is spread over salts).
A node's shingles are ordered by rising document frequency.  If two sets meet the
threshold, the first  n - ceil(required share of n) + l  shingles of each hold l common
ones; the smaller set needs the share 2t / (1 + t), the larger the share t.  Every node
chooses its own l: a longer prefix meets more postings, but a pair then has to share
more of it before it is verified, and the l of least estimated cost is taken.  A pair
is verified if its prefixes share at least the smaller of both l, from the shared
shingles alone, since the others cannot intersect.

No posting is expanded into its pairs.  First every node of a posting is paired with
the posting's hub, the node with the fewest shingles of its own, and the verified pairs
give provisional components.  A posting whose nodes are all of one component has nothing
left to find.  In the others, only nodes outside the largest component are paired with
the posting's nodes of other components, and sizes and positions have to allow the
threshold.  Any pair left out lies in one component already, so components are exact.

Defined results: NULL, empty and blank texts have no shingles and are linked with
nothing; texts with fewer words than a shingle have one, of all words; upper and lower
case of ASCII and kinds of blanks are equal; rows that repeat an id each give a row; rows
with a NULL id take part in linking and never name a component, which is NULL if it holds
no other id; other columns are ignored; an empty table gives an empty result.  Shingles
are told apart by 48 bits, texts by 128 (names of 64 bits, made again with another seed
if two texts share one).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm import simhash
from veritab.llm.common import map_batches, ready, release, stored, utf8
from veritab.llm.graph import components
from veritab.llm.skew import heavy_keys, salted_join
from veritab.session import freeze

WIDTH = 5
#: Linked at this similarity or more, as a fraction.
NEAR = (4, 5)
#: Longest multi-match, and the cost of verifying a pair against that of meeting it in a posting.
MOST, VERIFY = 4, 8
#: A shingle that so many documents of a batch hold is spread over salts.
FREQUENT, SALTS = 16, 256
#: Two sets of 500 shingles share one by mistake with a probability of 1e-9.
TOKEN_BYTES = 6
#: Shingles of a bucket, on average, as a task holds one bucket at a time; and the least number of buckets, so that a text
#: is cut into as many rows in a small table.
BUCKET, BUCKETS = 1 << 21, 64
#: Texts that a task remembers.
KEPT = 200_000
_COEFFICIENTS = np.random.default_rng(12).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible pattern."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, made from the hashes of its words."""
    if not words:
        return np.zeros(0, np.int64)
    each = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total += each[i : len(words) - size + 1 + i] * _COEFFICIENTS[i]
    found = np.sort(_mixed(total) >> np.uint64(64 - 8 * TOKEN_BYTES)).view(np.int64)
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _name(words: list[bytes], seed: int) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed) - (1 << 63)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, mark: Callable[[bytes], int] | None = None) -> DataFrame:
    """(id, name, other, n, mark) of every row: two names of its words, the number of its shingles and what `mark` gives of its text."""

    def work(batch: pa.RecordBatch):
        rows = []
        for text in utf8(batch.column(1)):
            words = text.lower().split()
            rows.append((_name(words, seed), _name(words, seed + (1 << 32)), len(shingles(words, width)), mark(text) if mark else 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], names=["id", "name", "other", "n", "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col)), work, f"id {kind}, name long, other long, n long, mark long")


def named_rows(docs: DataFrame, id_col: str, text_col: str, width: int, mark: Callable[[bytes], int] | None = None) -> tuple[DataFrame, int]:
    """(id, name, n, mark) with the seed of the names, chosen so that no two texts share one."""
    for seed in range(100):
        rows = freeze(sketches(docs, id_col, text_col, width, seed, mark))
        if rows.groupBy("name").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low != high").isEmpty():
            return rows.select("id", "name", "n", "mark"), seed
    raise RuntimeError("texts share a name under every seed")


def postings(docs: DataFrame, text_col: str, width: int, seed: int, buckets: int) -> DataFrame:
    """(bucket, name, tokens) of every text that this task has not met yet: its shingles of a bucket, six bytes each.

    Shingles that are frequent in a batch are shared for certain.  They go to negative
    buckets by text, and a row without a name tells their own bucket, so that their
    other rows there count as shared as well.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        met = set()
        for batch in batches:
            names, sets = [], []
            for text in utf8(batch.column(0)):
                words = text.lower().split()
                name = _name(words, seed)
                if words and name not in met:
                    if len(met) >= KEPT:
                        met.clear()
                    met.add(name)
                    names.append(name)
                    sets.append(shingles(words, width))
            if not names:
                continue
            token, text_of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.sort(token)
            ends = order[FREQUENT - 1 :]
            frequent = np.unique(ends[ends == order[: len(ends)]])
            named = np.array(names, np.int64)
            bucket = np.where(np.isin(token, frequent), -1 - named[text_of] % SALTS, token % buckets)
            token, bucket = np.concatenate([token, frequent]), np.concatenate([bucket, frequent % buckets])
            text_of = np.concatenate([text_of, np.full(len(frequent), len(names))])
            order = np.lexsort((text_of, bucket))
            token, bucket, text_of = token[order], bucket[order], text_of[order]
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (text_of[1:] != text_of[:-1])]))
            offsets = (np.append(starts, len(token)) * TOKEN_BYTES).astype(np.int32)
            packed = token.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()
            owner = text_of[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts].astype(np.int32)), pa.array(np.append(named, 0)[owner], mask=owner == len(names)),
                    pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                ],
                names=["bucket", "name", "tokens"],
            )

    return docs.select(text_col).mapInArrow(run, "bucket int, name long, tokens binary")


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows after one another, and how many each row has."""
    rows = column.to_pylist()
    wide = np.zeros((sum(map(len, rows)) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.reshape(-1).view("<i8"), np.fromiter(map(len, rows), np.int64, len(rows)) // TOKEN_BYTES


def keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, name) of the shingles of two texts or more, from (bucket, name, tokens) rows sorted by bucket.

    Holds one bucket at a time.  A name may come twice.
    """
    release()
    names = ["token", "name"]

    def shared(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        token, name, blank = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(token)
        token, name, blank = token[order], name[order], blank[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        several = (np.minimum.reduceat(name, starts) != np.maximum.reduceat(name, starts)) | np.logical_or.reduceat(blank, starts)
        out = np.repeat(several, np.diff(np.append(starts, len(token)))) & ~blank
        return pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(name[out])], names=names)

    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, sizes = _unpack(batch.column(2))
        bucket = np.repeat(batch.column(0).to_numpy(), sizes)
        name, blank = np.repeat(batch.column(1).fill_null(0).to_numpy(), sizes), np.repeat(batch.column(1).is_null().to_numpy(zero_copy_only=False), sizes)
        sure = bucket < 0
        if sure.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[sure]), pa.array(name[sure])], names=names)
            bucket, token, name, blank = bucket[~sure], token[~sure], name[~sure], blank[~sure]
        if not len(bucket):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            if bucket[a] != at and held:
                yield shared(held)
                held = []
            at = bucket[a]
            held.append((token[a:b], name[a:b], blank[a:b]))
    if held:
        yield shared(held)


def shared_tokens(docs: DataFrame, text_col: str, width: int, seed: int, total: int) -> DataFrame:
    """(token, name) of the shingles that more than one text has, some of them more than once; `total` bounds their number."""
    rows = postings(docs, text_col, width, seed, max(BUCKETS, 1 + total // BUCKET))
    return stored(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(keep_shared, "token long, name long"), "shingles")


def _least(n: Column, share: tuple[int, int]) -> Column:
    """The smallest whole number that is at least a share of n."""
    return F.ceil(n * share[0] / share[1])


def eligible(rows: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(name, n, tokens) of texts that share enough shingles with others to be linked, from (name, n, t)."""
    sets = rows.groupBy("name", "n").agg(F.sort_array(F.collect_set("t")).alias("tokens"))
    return sets.where(near[1] * F.size("tokens") >= near[0] * F.col("n"))


def recount(sets: DataFrame) -> DataFrame:
    """(name, n, t) with `t` of frequency and shingle, among `sets` only, of shingles that still are shared."""
    rows = stored(sets.select("name", "n", F.explode("tokens").alias("token")), "eligible")
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return salted_join(rows, counts, ["token"]).select("name", "n", F.struct("df", "token").alias("t"))


def prefixes(nodes: DataFrame, near: tuple[int, int], most: int = MOST, verify: int = VERIFY) -> DataFrame:
    """(token, node, n, own, need, place, small) of the shingles in every node's prefix.

    `need` is the l that the node chose, `own` the shingles that no other node has and
    that therefore come first, `place` the rank of the shingle, and `small` whether it
    is also in the prefix for partners that are no smaller.
    """
    own = F.col("n") - F.size("tokens")
    longer = (2 * near[0], near[0] + near[1])

    def length(need: Column, share: tuple[int, int]) -> Column:
        return F.col("n") - _least(F.col("n"), share) + need

    def cost(need: int) -> Column:
        taken = F.greatest(F.lit(0).cast("long"), F.least(length(F.lit(need), near) - own, F.size("tokens").cast("long"))).cast("int")
        met = F.aggregate(F.slice("tokens", 1, taken), F.lit(0.0), lambda total, t: total + t["df"])
        # no pair can be asked to share more shingles than the threshold makes it share
        asked = F.when(_least(F.col("n"), near) >= need, met * (1 + verify / need)).otherwise(float("inf"))
        return F.struct(asked.alias("cost"), F.lit(need).alias("need"))

    chosen = nodes.select("node", "n", own.alias("own"), "tokens", F.array_min(F.array(*[cost(need) for need in range(1, most + 1)]))["need"].alias("need"))
    places = chosen.select("*", F.posexplode("tokens").alias("at", "t")).withColumn("place", F.col("own") + F.col("at"))
    return places.where(F.col("place") < length(F.col("need"), near)).select(
        F.col("t.token").alias("token"), "node", "n", "own", "need", "place", (F.col("place") < length(F.col("need"), longer)).alias("small")
    )


def verified(pairs: DataFrame, nodes: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(a, b): the pairs whose sets meet the threshold, from their shared shingles."""
    pairs = freeze(pairs.select("a", "b"))
    found = pairs
    for side in "ab":
        sets = nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens.token").alias(f"set_{side}"))
        found = salted_join(found, sets, [side], heavy=heavy_keys(pairs, [side]), by=F.xxhash64("a", "b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return found.where((near[0] + near[1]) * shared >= near[0] * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _pairs(met: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(a, b) from rows of two nodes (x_, y_) that meet in a shingle: those that sizes, places and the number of shared shingles allow."""
    low = F.least("x_n", "y_n")
    ahead = F.least(F.col("x_place") - F.col("x_own"), F.col("y_place") - F.col("y_own"))
    behind = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    smaller = F.when(F.struct("x_n", "x_node") < F.struct("y_n", "y_node"), F.col("x_small")).otherwise(F.col("y_small"))
    can = (near[1] * low >= near[0] * F.greatest("x_n", "y_n")) & smaller & ((near[0] + near[1]) * (ahead + behind) >= near[0] * (F.col("x_n") + F.col("y_n")))
    return (
        met.where(can)
        .groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        .agg(F.count("*").alias("met"), F.min(F.least("x_need", "y_need")).alias("need"))
        .where("met >= need")
        .select("a", "b")
    )


_FIELDS = ["node", "n", "own", "need", "place", "small"]


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in [*_FIELDS, *more]])


def hub_pairs(index: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(a, b): each node with the hubs of its postings."""
    hub = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), *_FIELDS)).alias("hub")
    hubs = index.groupBy("token").agg(hub, F.count("*").alias("nodes")).where("nodes > 1").select("token", *[F.col(f"hub.{c}").alias(f"y_{c}") for c in _FIELDS])
    return _pairs(salted_join(_side(index, "x"), hubs, ["token"]).where("x_node != y_node"), near)


def crossing_pairs(index: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(a, b): nodes of one posting that lie in different components (`top`), but not both in its largest."""
    members = index.groupBy("token", "top").agg(F.count("*").alias("nodes"))
    main = members.groupBy("token").agg(F.max(F.struct("nodes", "top")).alias("main"), F.count("*").alias("tops")).where("tops > 1")
    mixed = freeze(salted_join(index, main.select("token", F.col("main.top").alias("main")), ["token"]))
    outer = mixed.where("top != main")
    met = salted_join(_side(mixed, "x", "top", "main"), _side(outer, "y", "top"), ["token"], by=F.xxhash64("x_node"))
    # two outer nodes meet twice, once from each side
    return _pairs(met.where("x_top != y_top AND (x_top = x_main OR x_node < y_node)"), near)


def _grouped(docs: DataFrame, near: tuple[int, int], width: int, id_col: str, text_col: str, mark: Callable[[bytes], int] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, name, n, mark), the components of linked names (name, root), and the seed of the names."""
    rows, seed = named_rows(docs, id_col, text_col, width, mark)
    kinds = rows.groupBy("name", "n").agg(F.min("id").alias("id"))
    total = kinds.agg(F.sum("n")).first()[0] or 0
    tokens = shared_tokens(docs, text_col, width, seed, total).join(kinds.select("name", "n"), "name")
    nodes = eligible(tokens.select("name", "n", F.col("token").alias("t")), near)
    # what is shared with texts that cannot be linked does not count
    sets = eligible(recount(nodes), near)
    nodes = freeze(sets.select(F.monotonically_increasing_id().alias("node"), "*"))
    index = freeze(prefixes(nodes, near))
    links = freeze(verified(hub_pairs(index, near), nodes, near))
    tops = components(links).select(F.col("v").alias("node"), F.col("root").alias("top"))
    placed = freeze(index.join(tops, "node", "left").withColumn("top", F.coalesce("top", "node")))
    links = freeze(links.unionByName(verified(crossing_pairs(placed, near), nodes, near)))
    tops = components(links).select(F.col("v").alias("node"), "root")
    return rows, nodes.select("node", "name").join(tops, "node").select("name", "root"), seed


def similarity_components(docs: DataFrame, near: tuple[int, int] = NEAR, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the smallest id reachable through links, for every row."""
    rows, linked, _ = _grouped(docs, near, width, id_col, text_col)
    kinds = rows.groupBy("name").agg(F.min("id").alias("id"))
    named = linked.join(kinds, "name")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.join(least, "root").select("name", "component_id")
    found = kinds.join(linked, "name", "left").select("name", F.coalesce("component_id", "id").alias("component_id"))
    joined = salted_join(rows, found, ["name"], by=F.monotonically_increasing_id())
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_first(docs: DataFrame, near: tuple[int, int] = NEAR, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay if one row of every group of near copies does: that with the smallest id.

    Texts are linked by operator 8, with fingerprints of shingles of this width and its
    pivot tables, and by the similarity itself, which no two bits of a fingerprint reach.
    Rows without an id stay only where no row of their group has one.  Texts without
    words are one group.  Of rows that repeat both id and words one stays.
    """
    ready(docs.sparkSession)
    rows, linked, seed = _grouped(docs, near, width, id_col, text_col, lambda text: simhash.signed(simhash.fingerprint(text, width, 42)))
    prints = stored(rows.groupBy(F.col("mark").alias("word")).agg(F.min("name").alias("name")).select("word", "name", F.struct("name", "word").alias("node")), "prints")
    hubs = linked.groupBy("root").agg(F.min("name").alias("b"))
    edges = (
        linked.join(hubs, "root").select(F.col("name").alias("a"), "b")
        .union(simhash.links(prints).select("a.name", "b.name"))
        .union(rows.select("name", F.col("mark").alias("word")).distinct().join(prints.select("word", F.col("name").alias("b")), "word").select("name", "b"))
    )
    linked = components(edges.where("a != b")).select(F.col("v").alias("name"), "root")
    kinds = rows.groupBy("name", "id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "name", "rows")).alias("first")
    winners = (
        kinds.join(linked, "name", "left")
        .groupBy(F.when(F.col("root").isNull(), F.col("name")).alias("alone"), "root").agg(first)
        .select(F.col("first.id").alias("_id"), F.col("first.name").alias("_name"), (F.col("first.rows") > 1).alias("_again"))
    )
    winners = freeze(winners)
    columns = docs.columns

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names = [_name(text.lower().split(), seed) for text in utf8(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*columns, "_name"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_name", T.LongType())])
    kept = docs.mapInArrow(name, schema).alias("d").join(winners.alias("w"), F.expr(f"d._name = w._name AND d.`{id_col}` <=> w._id")).select("d.*", "_again")
    single = kept.where("NOT _again").select(*columns)
    if winners.where("_again").isEmpty():
        return single
    packed = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row")
    again = kept.where("_again").groupBy("_name").agg(packed)  # a name wins with one id at most
    return single.unionByName(again.select("row.*"))

"""Operator 2: WARC fixity audit with Merkle trees.

Pages become WARC response records in files, each for a span of ids; an id has a slot,
and a record its byte range, in order of the slots of its file.  Records are hashed,
and ordered ranges of `fanout` slots or nodes are hashed into parents, level by level,
up to one root for each file.  An audit compares the roots of two replicas, and goes
down only from nodes that differ: each level is joined with the children of the
mismatching nodes of the level above, so equal subtrees are never compared.  The
mismatching leaves are the corrupt ranges.

A replica can lack records or hold more; a tree without a counterpart mismatches as a
whole.  Everything is DataFrame operations.

Defined results: a NULL url or body is empty; pages with a NULL id have files and
slots by their content; pages that share a slot are one leaf; other columns are ignored; an empty table has no files and no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.session import freeze

FANOUT = 16
#: Records of a file; a file has one root.
FILE_RECORDS = 4096


def record_bytes(url: Column, body: Column, number: Column) -> Column:
    """A WARC 1.1 response record; the date is fixed so that a record depends on its page alone."""
    content = F.encode(body, "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:"), number,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), content, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, slot, id, data): the records of all pages; a file holds the ids of one span of `file_records`.

    Pages without an id are dealt over files of their own by their content.
    """
    url, body = (F.coalesce(F.col(c), F.lit("")) for c in (url_col, body_col))
    data = record_bytes(url, body, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    spread = F.crc32(F.concat(url, body))
    return pages.select(
        F.coalesce(F.floor(F.col(id_col) / file_records).cast("long"), -(1 << 40) - spread % 1024).alias("file"),
        F.coalesce(F.pmod(F.col(id_col), F.lit(file_records)), F.floor(spread / 1024) % file_records).cast("long").alias("slot"),
        F.col(id_col).alias("id"),
        data.alias("data"),
    )


def leaves(stored: DataFrame) -> DataFrame:
    """(file, level, node, hash, start, size, id): one leaf for each slot, with its byte range.

    Only digests and lengths are shuffled, not the records.  Records that share a slot
    form one leaf, whose digest comes from sums over their digests, so that a slot with
    very many records is combined before the shuffle.
    """
    hashed = stored.select("file", "slot", "id", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("size"))
    part = lambda i: F.sum(F.conv(F.substring("hash", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    order = Window.partitionBy("file").orderBy("node")
    return (
        hashed.groupBy("file", F.col("slot").alias("node"))
        .agg(F.count("*").alias("n"), F.min("hash").alias("one"), F.concat_ws(",", *map(part, range(5))).alias("many"), F.sum("size").alias("size"), F.min("id").cast("long").alias("id"))
        .select(
            "file", F.lit(0).alias("level"), "node",
            F.when(F.col("n") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws(",", "n", "many").cast("binary"), 256)).alias("hash"),
            (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
            "size", "id",
        )
    )


def tree(stored: DataFrame, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> DataFrame:
    """All nodes of the trees of all files; a parent hashes the digests and lengths of its children in order."""
    level = freeze(leaves(stored))
    levels = [level]
    height, width = 0, file_records
    while width > 1:
        height, width = height + 1, -(-width // fanout)
        child = F.concat_ws(":", "hash", "size")
        level = (
            level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent"))
            .agg(F.sort_array(F.collect_list(F.struct("node", child.alias("text")))).alias("children"), F.min("start").alias("start"), F.sum("size").alias("size"))
            .select(
                "file", F.lit(height).alias("level"), F.col("parent").alias("node"),
                F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"], c["text"])), ",").cast("binary"), 256).alias("hash"),
                "start", "size", F.lit(None).cast("long").alias("id"),
            )
        )
        levels.append(level)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, node, id, start, size, other_start, other_size, fault): leaves at which two trees differ."""
    height, width = 0, file_records
    while width > 1:
        height, width = height + 1, -(-width // fanout)
    suspect = None
    for level in range(height, -1, -1):
        sides = []
        for side, nodes in (("a", first), ("b", second)):
            here = nodes.where(F.col("level") == level)
            if suspect is not None:  # only below what differs
                here = here.withColumn("above", F.floor(F.col("node") / fanout).cast("long")).join(suspect, ["file", "above"]).drop("above")
            sides.append(here.select("file", "node", *[F.col(c).alias(f"{side}_{c}") for c in ("hash", "start", "size", "id")]))
        compared = sides[0].join(sides[1], ["file", "node"], "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
        if level:
            suspect = freeze(compared.select("file", F.col("node").alias("above")))
    fault = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").otherwise("changed")
    return compared.select(
        "file", "node", F.coalesce("a_id", "b_id").alias("id"), F.col("a_start").alias("start"), F.col("a_size").alias("size"),
        F.col("b_start").alias("other_start"), F.col("b_size").alias("other_size"), fault.alias("fault"),
    )

"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a key of hexadecimal digits: the digest of the text, doc_id, and the row's own place. So equal
texts lie together, yet a group of copies, and even of repeated rows, is split where a boundary falls into it.
Splitters are found by counting: each round counts, over all partitions, the exact rows and bytes below equally spaced
candidate keys inside the intervals that still hold a splitter, and keeps the interval that the target falls into,
until that interval's bytes are within the tolerance or it holds one row. Then rows move once, into their order; a
row's slot is its rank less the exact count of rows below its shard.

A null text has no bytes but its row's overhead, as an empty one; a text of any length is one row. A null doc_id sorts
first. Ties of text and doc_id are ordered by the rows' places. Extra columns are ignored. An empty table gives an
empty result; shards may be empty where there are fewer rows than shards.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import Scratch, in_order, with_uid

#: Hexadecimal digits that one round resolves: 16 ** DIGITS probes in each open interval.
DIGITS = 3
#: Digits of a key: 32 of the text's digest, 16 each of doc_id, the file's hash and the place in it, and one to fill up.
LENGTH = 81


def _sixteen(x: Column) -> Column:
    """A 64-bit integer as 16 digits in its own order; null as the least."""
    return F.lpad(F.lower(F.hex(F.coalesce(x, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


def _after(prefix: str) -> str | None:
    """The least prefix of its length beyond it; None at the end."""
    n = int(prefix, 16) + 1
    return None if n == 16 ** len(prefix) else f"{n:0{len(prefix)}x}"


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[str | None, int]]:
    """For each of shards - 1 boundaries, in order, the least key beyond it and the rows below it.

    keyed has key and size. The driver sees at most (shards - 1) * 16 ** DIGITS counts a round, whatever the table's size.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    found: dict[int, tuple[str | None, int]] = {}
    open_: dict[str, tuple[int, int, list[int]]] = {"": (0, 0, list(range(1, shards)))} if total else {}  # bytes and rows below
    for depth in range(0, LENGTH, DIGITS):
        if not open_:
            break
        rows = keyed.select("size", F.substring("key", 1, depth).alias("prefix"), F.substring("key", depth + 1, DIGITS).alias("digits"))
        if depth:  # shards - 1 intervals at most
            rows = rows.where(reduce(or_, (F.col("prefix") == p for p in open_)))
        counted: dict[str, list[tuple[str, int, int]]] = {}
        for r in rows.groupBy("prefix", "digits").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            counted.setdefault(r["prefix"], []).append((r["digits"], r["bytes"], r["n"]))
        after: dict[str, tuple[int, int, list[int]]] = {}
        for prefix, (below, before, wanted) in open_.items():
            cells = sorted(counted[prefix])
            for s in wanted:
                at, rows_at = below, before
                for digits, size, n in cells:
                    if (at + size) * shards >= total * s:
                        break
                    at, rows_at = at + size, rows_at + n
                if n == 1 or size * shards <= tolerance * total or depth + DIGITS >= LENGTH:
                    over = 2 * total * s > (2 * at + size) * shards  # the cell's far end is the nearer
                    found[s] = (_after(prefix + digits), rows_at + n) if over else (prefix + digits, rows_at)
                else:
                    after.setdefault(prefix + digits, (at, rows_at, []))[2].append(s)
        open_ = after
    return [found[s] for s in sorted(found)]


def shard_by_bytes(docs: DataFrame, *, shards: int = 40, overhead: int = 16, tolerance: float = 0.001, scratch: Scratch | None = None) -> DataFrame:
    """uid, doc_id, size, text_crc32, shard and slot of every row; slots are in key order.

    tolerance: part of a shard's bytes that may lie between a boundary's neighbouring candidates when its search ends;
    0 goes on to single rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    rows = with_uid(docs.select("doc_id", "text"), scratch=scratch).withColumn("doc_id", F.col("doc_id").cast("long"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    key = F.rpad(F.concat(F.md5(data), _sixteen(F.col("doc_id")), _sixteen(F.col("uid.f")), _sixteen(F.col("uid.r"))), LENGTH, "0")
    keyed = rows.select("uid", "doc_id", (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key.alias("key"))
    keyed = scratch.save(keyed, "keyed")
    cuts = splitters(keyed, shards, tolerance)
    shard = sum(((F.col("key") >= cut).cast("int") for cut, _ in cuts if cut is not None), F.lit(0))
    # A literal a shard; which of them, by the shard's number.
    below = F.element_at(F.array(F.lit(0), *[F.lit(n) for _, n in cuts]), F.col("shard") + 1)
    ordered = in_order(keyed, ["key"], scratch, "ordered").withColumn("shard", shard)
    return ordered.select("uid", "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("rank") - below).cast("long").alias("slot"))

"""Barcoded libraries: a dictionary of barcodes within one mismatch, three look-ups, new ids, a shorter read 2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixsieve.params import QCParams

#: Strings of an expansion (31 a barcode of 10 bases, of which there are 4**10) up to which it is broadcast.
BROADCAST_ROWS = 2_000_000


def expand(barcodes: DataFrame) -> DataFrame:
    """(segment, barcode_id) of every string within one substitution of ACGT; later entries of the list win.

    barcodes: barcode, barcode_id and ord, the place in the list. Equal barcodes are one before they expand.
    """
    barcodes = barcodes.groupBy("barcode").agg(F.max_by("barcode_id", "ord").alias("barcode_id"), F.max("ord").alias("ord"))
    at = F.explode(F.sequence(F.lit(1), F.length("barcode"))).alias("at")
    spots = barcodes.select("barcode", "barcode_id", "ord", at)
    spots = spots.select("*", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"))
    segment = F.concat(F.substr("barcode", F.lit(1), F.col("at") - 1), "base", F.substr("barcode", F.col("at") + 1))
    return spots.groupBy(segment.alias("segment")).agg(F.max_by("barcode_id", "ord").alias("barcode_id"))


def most_segments(barcodes: DataFrame) -> int:
    """How many rows an expansion has at most: of the letters ACGT, no more than there are strings of these lengths."""
    odd = F.when(~F.col("barcode").rlike("^[ACGT]*$"), F.col("barcode"))
    kinds = barcodes.groupBy(F.length("barcode").alias("n")).agg(F.countDistinct("barcode").alias("all"), F.countDistinct(odd).alias("odd"))
    size = lambda r: 4 * max(r["n"], 2)
    return sum(min(size(r) * r["all"], 4 ** r["n"] + size(r) * r["odd"]) for r in kinds.collect() if r["n"] is not None)  # a row a length


def with_barcodes(df: DataFrame, barcodes: DataFrame, p: QCParams) -> DataFrame:
    """Add b1, b2, b3 and barcode (0_0_0 unless all are known), rewrite ids, and cut read 2 before its barcodes.

    too_short flags pairs whose read 2 ends before its last region: no barcode, and nothing is cut.
    """
    regions = sorted(p.barcode_regions)
    known = expand(barcodes)
    if most_segments(barcodes) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    for i, (start, length) in enumerate(regions, 1):
        own = known.select(F.col("segment").alias(f"_s{i}"), F.col("barcode_id").alias(f"b{i}"))
        df = df.withColumn(f"_s{i}", F.substr("seq2", F.lit(start), F.lit(length))).join(own, f"_s{i}", "left").drop(f"_s{i}")
    names = [f"b{i}" for i in range(1, len(regions) + 1)]
    found = ~F.greatest(*(F.col(n).isNull().cast("int") for n in names)).cast("boolean")
    last = max(s + n - 1 for s, n in regions)
    df = df.withColumn("too_short", F.length("seq2") < last).withColumn("has_barcode", found & (F.length("seq2") >= last))
    df = df.withColumn("barcode", F.when(F.col("has_barcode"), F.concat_ws("_", *(F.col(n).cast("string") for n in names))).otherwise("_".join("0" * len(names))))
    stem = lambda m: F.regexp_replace(f"id{m}", f"/{m}$", "")
    for m in (1, 2):
        new = F.concat(stem(m), F.lit("_1\tBX:Z:"), "barcode") if p.ten_x else F.concat(stem(m), F.lit("#"), "barcode", F.lit(f"/{m}"))
        df = df.withColumn(f"id{m}", new)
    cut = F.col("has_barcode") | (F.lit(p.cut_without_barcode) & ~F.col("too_short"))
    for name in ("seq2", "qual2"):
        df = df.withColumn(name, F.when(cut, F.substr(name, F.lit(1), F.lit(regions[0][0] - 1))).otherwise(F.col(name)))
    return df.drop(*names)


def bad_ids(df: DataFrame) -> DataFrame:
    """Pairs whose ids don't end in /1 and /2, or differ before that."""
    same = F.regexp_replace("id1", "/1$", "") == F.regexp_replace("id2", "/2$", "")
    return df.where(~(F.endswith("id1", F.lit("/1")) & F.endswith("id2", F.lit("/2")) & same))


def barcode_stats(df: DataFrame, n_barcodes: int, regions: int = 3) -> DataFrame:
    """Pairs, pairs with a barcode, distinct barcodes, and how many there could be."""
    own = F.when(F.col("has_barcode"), F.col("barcode"))
    return df.agg(F.count("*").alias("pairs"), F.count(own).alias("pairs_with_barcode"), F.countDistinct(own).alias("distinct_barcodes")).withColumn("possible_barcodes", F.lit(n_barcodes**regions).cast("long"))

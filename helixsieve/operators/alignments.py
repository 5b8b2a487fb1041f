"""Quality control of alignment files: records of one name are one read or pair, whose verdict marks all its records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixsieve.functions.features import reverse_complement
from helixsieve.operators.cascade import judge
from helixsieve.params import QCParams

QC_FAIL = 512


def stranded(records: DataFrame) -> DataFrame:
    """Add rseq and rqual: the read as it was sequenced, for records on the reverse strand too."""
    back = F.col("flag").bitwiseAND(16) != 0
    return records.withColumn("rseq", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("rqual", F.when(back, F.reverse("qual")).otherwise(F.col("qual")))


def grouped(records: DataFrame, paired: bool) -> DataFrame:
    """One row a name: its first record, by ord, or the first of each mate. Works for any order of the file."""
    first = lambda which: F.min_by(F.struct("rseq", "rqual"), F.when(which, F.col("ord")))
    flag = F.col("flag")
    if not paired:
        out = stranded(records).groupBy("qname").agg(F.min("ord").alias("ord"), first(F.lit(True)).alias("m1"), F.count("*").alias("records"))
        return out.select("ord", "records", F.col("qname").alias("id1"), F.col("m1.rseq").alias("seq1"), F.col("m1.rqual").alias("qual1"))
    one, two = flag.bitwiseAND(64) != 0, flag.bitwiseAND(128) != 0
    out = stranded(records).groupBy("qname").agg(F.min("ord").alias("ord"), first(one).alias("m1"), first(two).alias("m2"), F.max(one).alias("has1"), F.max(two).alias("has2"), F.count("*").alias("records"))
    m = lambda i: (F.col("qname").alias(f"id{i}"), F.when(F.col(f"has{i}"), F.col(f"m{i}.rseq")).alias(f"seq{i}"), F.when(F.col(f"has{i}"), F.col(f"m{i}.rqual")).alias(f"qual{i}"))
    return out.select("ord", "records", *m(1), *m(2))


def usable(reads: DataFrame, p: QCParams) -> DataFrame:
    """Reads with every mate's bases and qualities; SAM writes * for what is missing."""
    return reads.where(" and ".join(f"seq{m} is not null and seq{m} != '*' and qual{m} is not null and qual{m} != '*'" for m in p.mates()))


def mark(records: DataFrame, p: QCParams) -> tuple[DataFrame, DataFrame]:
    """(records with the fail bit set on those of discarded reads, names that couldn't be judged).

    Nothing is trimmed. All records stay; those of rejected names keep their flags.
    """
    p = replace(p, module="filterHts", adapter_mode="discard", hard_trim=None, trim_bad_head=None, trim_bad_tail=None)
    reads = grouped(records, p.paired)
    good = usable(reads, p)
    judged = judge(good, p)
    bad = judged.where("reason is not null").select(F.col("id1").alias("qname"), "reason")
    out = records.join(bad, "qname", "left")
    flag = F.when(F.col("reason").isNotNull(), F.col("flag").bitwiseOR(QC_FAIL)).otherwise(F.col("flag"))
    return out.withColumn("flag", flag), reads.select(F.col("id1").alias("qname")).join(good.select(F.col("id1").alias("qname")), "qname", "left_anti")

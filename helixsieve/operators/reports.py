"""Statistics of raw, trimmed and clean reads: totals, histograms by position, trims, discards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixsieve.functions.arrow import flat
from helixsieve.operators.trims import winning_cuts
from helixsieve.params import QCParams

STAGES = ("raw", "trim", "clean")


def _cells(texts: pa.Array) -> np.ndarray:
    """Counts of bytes by place and byte, flat: 256 cells a place."""
    x, edges = flat(texts)
    if not len(x):
        return np.zeros(0, np.int64)
    sizes = np.diff(edges)
    at = np.arange(len(x)) - np.repeat(edges[:-1], sizes)
    return np.bincount(at * 256 + x, minlength=int(sizes.max()) * 256)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of reads of other lengths together."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def histograms(judged: DataFrame, p: QCParams, stages: tuple[str, ...] = ("raw", "clean")) -> DataFrame:
    """(kind, stage, mate, pos, symbol, n): counts of each byte of seq and of qual at each position, from 1, and of reads.

    Letters of seq are counted as upper-case. The kind ``read`` has its count at position and symbol 0. A task counts its
    reads in arrays and gives one row a cell, so the exchange carries cells, not bases. Reads that nothing cuts go to
    Python once for all stages.
    """
    own: list[tuple[int, str, list[str]]] = []  # mate, prefix of its columns, stages that they show
    for m in p.mates():
        cut = f"cuts{m}" in judged.columns and set(judged.schema[f"cuts{m}"].dataType.names) - {"len", "head", "tail"}
        shown = {"": [s for s in stages if s == "raw" or not cut], "t": [s for s in stages if s != "raw" and cut]}
        own += [(m, prefix, names) for prefix, names in shown.items() if names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, str, bool], np.ndarray] = {}
        for batch in batches:
            for clean in (True, False):
                rows = batch.filter(pc.equal(batch.column("clean"), clean))
                for m, prefix, _ in own:
                    for kind in ("seq", "qual"):
                        key = (kind, m, prefix, clean)
                        held[key] = _sum(held.get(key, np.zeros(0, np.int64)), _cells(rows.column(f"{prefix}{kind}{m}")))
                    key = ("read", m, prefix, clean)
                    held[key] = held.get(key, 0) + np.array([rows.num_rows])
        for m, prefix, names in own if held else []:
            for kind in ("seq", "qual", "read"):
                parts = held[(kind, m, prefix, True)], held[(kind, m, prefix, False)]
                for stage in names:
                    x = parts[0] if stage == "clean" else _sum(*parts)
                    at = np.flatnonzero(x)
                    n, pos, symbol = len(at), at // 256 + (kind != "read"), at % 256
                    if kind == "seq":
                        symbol = np.where((symbol >= ord("a")) & (symbol <= ord("z")), symbol - 32, symbol)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([stage] * n, pa.string()), pa.array([m] * n, pa.int32()), pa.array(pos, pa.int32()), pa.array(symbol, pa.int32()), pa.array(x[at], pa.int64())], ["kind", "stage", "mate", "pos", "symbol", "n"])

    clean = F.col("reason").isNull() if "clean" in stages else F.lit(True)
    rows = judged.select(clean.alias("clean"), *(f"{prefix}{kind}{m}" for m, prefix, _ in own for kind in ("seq", "qual")))
    parts = rows.mapInArrow(run, "kind string, stage string, mate int, pos int, symbol int, n long")
    return parts.groupBy("kind", "stage", "mate", "pos", "symbol").agg(F.sum("n").alias("n"))


def general_stats(hist: DataFrame, phred: int = 33) -> DataFrame:
    """Reads, bases, counts of bases and of good qualities, and lengths, by stage and mate."""
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    seq, qual, symbol = F.col("kind") == "seq", F.col("kind") == "qual", F.col("symbol")
    out = hist.groupBy("stage", "mate").agg(
        total(F.col("kind") == "read").alias("reads"), total(seq).alias("bases"), *(total(seq & (symbol == ord(b))).alias(b.lower()) for b in "ACGTN"),
        total(qual & (symbol >= 20 + phred)).alias("q20"), total(qual & (symbol >= 30 + phred)).alias("q30"), F.coalesce(F.max(F.when(seq, F.col("pos"))), F.lit(0)).cast("long").alias("max_length"),
    )
    return out.withColumn("mean_length", F.round(F.col("bases") / F.col("reads"), 2))


def base_by_position(hist: DataFrame) -> DataFrame:
    """Counts and percentages of bases at each position."""
    cells = hist.where("kind = 'seq'")
    out = cells.groupBy("stage", "mate", "pos").agg(F.sum("n").alias("total"), *(F.coalesce(F.sum(F.when(F.col("symbol") == ord(b), F.col("n"))), F.lit(0)).alias(b.lower()) for b in "ACGTN"))
    return out.select("*", *(F.round(100 * F.col(b) / F.col("total"), 2).alias(f"{b}_pct") for b in "acgtn"))


def quality_by_position(hist: DataFrame, phred: int = 33) -> DataFrame:
    """Mean (whole number) and percentiles of qualities at each position.

    A percentile of N values is the one with floor(N * share) values before it in order.
    """
    cells = hist.where("kind = 'qual'").select("stage", "mate", "pos", (F.col("symbol") - phred).alias("q"), "n")
    at = W.partitionBy("stage", "mate", "pos")
    cells = cells.withColumn("upto", F.sum("n").over(at.orderBy("q"))).withColumn("total", F.sum("n").over(at))
    share = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("total") * num / den), F.col("q")))
    return cells.groupBy("stage", "mate", "pos").agg(
        F.sum("n").alias("total"), F.floor(F.sum(F.col("q") * F.col("n")) / F.sum("n")).cast("int").alias("mean"),
        *(share(a, b).alias(name) for name, a, b in (("p10", 1, 10), ("lower", 1, 4), ("median", 1, 2), ("upper", 3, 4), ("p90", 9, 10))),
    )


def good_by_position(hist: DataFrame, phred: int = 33) -> DataFrame:
    """Counts and percentages of qualities of 20 and 30 or more at each position."""
    cells = hist.where("kind = 'qual'").withColumn("q", F.col("symbol") - phred)
    least = lambda q: F.coalesce(F.sum(F.when(F.col("q") >= q, F.col("n"))), F.lit(0))
    out = cells.groupBy("stage", "mate", "pos").agg(F.sum("n").alias("total"), least(20).alias("q20"), least(30).alias("q30"))
    return out.withColumn("q20_pct", F.round(100 * F.col("q20") / F.col("total"), 2)).withColumn("q30_pct", F.round(100 * F.col("q30") / F.col("total"), 2))


def trim_positions(judged: DataFrame, p: QCParams) -> DataFrame:
    """(stage, mate, kind, pos, n) of the cuts that won: the last base cut at a head, the first at a tail."""
    rows = []
    for m in p.mates():
        cuts = set(judged.schema[f"cuts{m}"].dataType.names) - {"len", "head", "tail"}
        head, tail = winning_cuts(m, cuts)
        c = F.col(f"cuts{m}")
        for kind, pos in ((head, F.least(c["head"], c["len"])), (tail, F.greatest(F.lit(1), c["len"] - c["tail"] + 1))):
            for stage in ("raw", "clean"):
                own = F.struct(F.lit(stage).alias("stage"), F.lit(m).alias("mate"), kind.alias("kind"), pos.cast("int").alias("pos"))
                rows.append(own if stage == "raw" else F.when(F.col("reason").isNull(), own))
    out = judged.select(F.explode(F.array(*rows)).alias("x")).where("x.kind is not null").select("x.*")
    return out.groupBy("stage", "mate", "kind", "pos").agg(F.count("*").alias("n"))


def filter_report(judged: DataFrame) -> DataFrame:
    """Reads (or pairs) discarded under each reason, total and by mate, and all of them under ``total``.

    One pass: the total is the rollup's. Without a discarded read there is no row.
    """
    mate = lambda *codes: F.count(F.when(F.col("code").isin(*codes), 1))
    lost = judged.where("reason is not null").rollup("reason")
    out = lost.agg(F.count("*").alias("total"), mate(1, 3).alias("mate1"), mate(2, 3).alias("mate2"), mate(3).alias("both"))
    return out.withColumn("reason", F.coalesce("reason", F.lit("total")))


def phred_check(reads: DataFrame, p: QCParams, first: int = 20_000) -> int:
    """How much better the declared quality encoding fits the first reads than the other one.

    An encoding gets 1 point without a value out of range, 3 times the share in range, and 2 for a mean from 10 to the
    highest quality. A difference under -3 raises; callers may warn below 0.
    """
    cells = histograms(reads.orderBy("ord").limit(first), p, ("raw",)).where("kind = 'qual'")
    cells = {r["symbol"]: r["n"] for r in cells.groupBy("symbol").agg(F.sum("n").alias("n")).collect()}  # 256 rows at most

    def score(phred: int) -> float:
        total = sum(cells.values())
        good = sum(n for c, n in cells.items() if 0 <= c - phred <= p.max_quality)
        mean = sum((c - phred) * n for c, n in cells.items()) / total
        return (good == total) + 3 * good / total + 2 * (10 <= mean <= p.max_quality)

    if not cells:
        return 0
    lead = int(score(p.phred_in) - score(97 - p.phred_in))
    if lead < -3:
        raise ValueError(f"qualities don't look like Phred+{p.phred_in}")
    return lead
